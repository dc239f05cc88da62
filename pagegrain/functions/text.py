"""Text helpers that reproduce Python string semantics with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as str.strip() and str.split() see it (Unicode spaces included).
_WS = r"[\s\x1c-\x1f]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), rf"(?U)^{_WS}+|{_WS}+\z", "")


def words(c: Column | str) -> Column:
    return F.filter(F.split(_c(c), rf"(?U){_WS}+"), lambda w: w != "")


def squeeze(c: Column | str) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return F.array_join(words(c), " ")


def middles(a: Column, b: Column) -> Column:
    """Struct (x, y) of what lies between the common start and the common end of two texts, read backwards.

    Their edit distance is that of the whole texts. A common start is found by halving,
    in as many comparisons as its length has binary digits.
    """
    pair = lambda x, y: F.array(F.struct(x.alias("x"), y.alias("y")))
    step = lambda i: F.call_function("shiftleft", F.lit(1), i)

    def rest(p: Column) -> Column:
        x, y = p["x"], p["y"]
        shorter = F.least(F.length(x), F.length(y))
        start = F.aggregate(F.sequence(F.length(F.bin(shorter.cast("long"))) - 1, F.lit(0), F.lit(-1)), F.lit(0), lambda n, i: F.when(
            (n + step(i) <= shorter) & (F.substr(x, n + 1, step(i)) == F.substr(y, n + 1, step(i))), n + step(i)).otherwise(n))
        cut = F.transform(F.array(start), lambda n: F.struct(F.reverse(F.substr(x, n + 1)).alias("x"), F.reverse(F.substr(y, n + 1)).alias("y")))
        return F.element_at(cut, 1)

    return F.element_at(F.transform(F.transform(pair(a, b), rest), rest), 1)


def count_of(c: Column | str, piece: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    col = _c(c)
    return ((F.length(col) - F.length(F.replace(col, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def contains_any(c: Column | str, pieces: list[str]) -> Column:
    col = _c(c)
    out = F.lit(False)
    for p in pieces:
        out = out | F.contains(col, F.lit(p))
    return out


def starts_any(c: Column | str, pieces: list[str]) -> Column:
    col = _c(c)
    out = F.lit(False)
    for p in pieces:
        out = out | F.startswith(col, F.lit(p))
    return out


def lines_of(c: Column | str) -> Column:
    return F.split(_c(c), "\n")


def is_upper(c: Column | str) -> Column:
    """str.isupper(): at least one cased letter and none in lower or title case."""
    col = _c(c)
    return col.rlike(r"\p{Lu}") & ~col.rlike(r"[\p{Ll}\p{Lt}]")
