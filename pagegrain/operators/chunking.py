"""Cutting texts into chunks.

Every strategy is a scan over the pieces of one text that carries lengths and
positions only (``arrays.scan``), so chunk text is copied once, when the chunk is
emitted, and a text of very many pieces costs little more a piece than a short one.
All of it stays in the row of the document: no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.arrays import scan, unnest
from pagegrain.functions.clean import let
from pagegrain.functions.text import strip
from pagegrain.operators.skew import running_total

# Sentence ends, what marks them while a text is cut, and default sizes in characters.
ENDINGS = "。！？；.!?;"
MARK = "\x00"
SIZE, OVERLAP, MINIMUM = 500, 50, 50
CHUNK = "array<struct<content:string,start_char:int,end_char:int>>"


def _located(parts: Column, gaps: Column | None = None) -> Column:
    """Trim pieces that tile a text and give each its true start; blank pieces are dropped.

    ``gaps`` holds the separator that follows each piece.
    """
    def step(s: Column, p: Column) -> dict[str, Column]:
        lead = F.length(p["p"]) - F.length(F.regexp_replace(p["p"], r"(?U)^[\s\x1c-\x1f]+", ""))
        return {"at": s["at"] + F.length(p["p"]) + F.coalesce(F.length(p["g"]), F.lit(0)), "emit": s["at"] + lead}

    none = F.lit(None).cast("string")
    paired = F.transform(parts, lambda p: F.struct(p.alias("p"), none.alias("g"))) if gaps is None else F.zip_with(
        parts, gaps, lambda p, g: F.struct(p.alias("p"), g.alias("g")))

    def build(ps: Column) -> Column:
        starts = scan(ps, {"at": F.lit(0)}, step, "int")
        return F.filter(F.zip_with(ps, starts, lambda p, s: F.struct(strip(p["p"]).alias("t"), s.alias("at"))), lambda x: x["t"] != "")

    return let(paired, build)


def paragraphs(text: Column) -> Column:
    """Array of (t, at): trimmed paragraphs and where they start."""
    sep = r"(?U)\n\s*\n"
    return let(text, lambda t: _located(F.split(t, sep), F.regexp_extract_all(t, F.lit(sep), 0)))


def sentences(text: Column) -> Column:
    """Array of (t, at): runs up to and with a sentence end; an end that follows another or stands first belongs to no sentence."""
    def build(t: Column) -> Column:
        marked = t
        for end in ENDINGS:
            marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
        # Both cut after every end; a split at one character needs no pattern, which takes several times as long.
        return let(F.when(F.contains(t, F.lit(MARK)), F.split(t, f"(?<=[{ENDINGS}])")).otherwise(F.split(marked, MARK)), located)

    def located(cut: Column) -> Column:
        # Ends that stand alone are no sentences; they become gaps.
        alone = lambda p: p.isin(*ENDINGS)
        return _located(F.transform(cut, lambda p: F.when(alone(p), "").otherwise(p)), F.transform(cut, lambda p: F.when(alone(p), p)))

    return let(text, build)


def _packed(pieces: Column, joiner: str, extra: int, size: int, minimum: int) -> Column:
    """Greedy packing of (t, at) pieces: start a new chunk when the next would pass ``size``."""
    def step(s: Column, p: Column) -> dict[str, Column]:
        n = F.length(p["t"])
        over = (s["len"] > 0) & (s["len"] + n + extra > size)
        grown = F.when(s["len"] == 0, n).otherwise(s["len"] + n + len(joiner))
        return {"len": F.when(over, n).otherwise(grown), "i": s["i"] + 1, "emit": F.when(over | (s["len"] == 0), s["i"])}

    def build(ps: Column) -> Column:
        cuts = F.array_append(scan(ps, {"len": F.lit(0), "i": F.lit(1)}, step, "int"), F.size(ps) + 1)
        return let(cuts, lambda at: F.transform(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), lambda a, k: _chunk(F.slice(ps, a, F.element_at(at, k + 2) - a), joiner)))

    return F.filter(let(pieces, build), lambda c: F.length(c["content"]) >= minimum)


def _chunk(part: Column, joiner: str) -> Column:
    last = F.element_at(part, -1)
    return F.struct(F.array_join(F.transform(part, lambda p: p["t"]), joiner).alias("content"), F.element_at(part, 1)["at"].cast("int").alias("start_char"),
                    (last["at"] + F.length(last["t"])).cast("int").alias("end_char"))


def by_paragraph(text: Column, size: int = SIZE, minimum: int = MINIMUM, **_) -> Column:
    return _packed(paragraphs(text), "\n\n", 1, size, minimum)


def by_sentence(text: Column, size: int = SIZE, minimum: int = MINIMUM, **_) -> Column:
    return _packed(sentences(text), "", 0, size, minimum)


def mixed(text: Column, size: int = SIZE, minimum: int = MINIMUM, compat: bool = False, **_) -> Column:
    """Paragraph packing in which an over-long paragraph is cut by sentence.

    By default a long paragraph ends the pending chunk. With ``compat`` a
    pending chunk under the minimum is kept and goes on after it.
    """
    def step(s: Column, p: Column) -> dict[str, Column]:
        """The group of a piece: 0 for a long one, else counted from 1."""
        n = F.length(p["t"])
        pending, long = s["len"] > 0, n > size
        flush = pending & (s["len"] >= minimum) if compat else F.lit(True)
        new = ~pending | (s["len"] + n + 2 > size)
        group = F.when(new, s["group"] + 1).otherwise(s["group"])
        return {"len": F.when(long, F.when(flush, 0).otherwise(s["len"])).when(new, n).otherwise(s["len"] + n + 2),
                "group": F.when(long, s["group"]).otherwise(group), "emit": F.when(long, 0).otherwise(group)}

    def build(ps: Column) -> Column:
        groups = scan(ps, {"len": F.lit(0), "group": F.lit(0)}, step, "int")
        tagged = F.transform(F.arrays_zip(ps.alias("p"), groups.alias("g")), lambda x, i: F.struct(i.alias("i"), x["g"].alias("g"), x["p"].alias("p")))
        return let(tagged, emitted)

    def emitted(tagged: Column) -> Column:
        """Chunks in the order of each group's last piece, as they are emitted."""
        def sentences_of(x: Column) -> Column:
            return F.transform(by_sentence(x["p"]["t"], size, minimum), lambda c: F.struct(
                c["content"].alias("content"), (c["start_char"] + x["p"]["at"]).cast("int").alias("start_char"), (c["end_char"] + x["p"]["at"]).cast("int").alias("end_char")))

        long = F.transform(F.filter(tagged, lambda x: x["g"] == 0), lambda x: F.struct(x["i"].alias("i"), sentences_of(x).alias("c")))
        short = let(F.filter(tagged, lambda x: x["g"] > 0), runs)
        return F.flatten(F.transform(F.array_sort(F.concat(long, short), lambda x, y: x["i"] - y["i"]), lambda x: x["c"]))

    def runs(xs: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1))), lambda k: (k <= F.size(xs)) & ((k == 1) | (F.get(xs, k - 2)["g"] != F.get(xs, k - 1)["g"])))

        def cut(at: Column) -> Column:
            def one(a: Column, k: Column) -> Column:
                part = F.slice(xs, a, F.coalesce(F.get(at, k + 1), F.size(xs) + 1) - a)
                return let(part, lambda q: F.struct(F.element_at(q, -1)["i"].alias("i"), F.array(_chunk(F.transform(q, lambda x: x["p"]), "\n\n")).alias("c")))
            return F.transform(at, one)
        return let(first, cut)

    return F.filter(let(paragraphs(text), build), lambda c: F.length(c["content"]) >= minimum)


def fixed(text: Column, size: int = SIZE, minimum: int = MINIMUM, overlap: int = OVERLAP, **_) -> Column:
    """Fixed-size chunks with overlap, each end moved back to the nearest sentence end within 100.

    Ends when the text is consumed, also for a tail shorter than the minimum.
    """
    ends = ENDINGS + "\n"

    def step(t: Column):
        n = F.length(t)

        def go(s: Column, _i: Column) -> Column:
            start, aim = s["at"], s["at"] + size
            low = F.greatest(start + minimum, aim - 100)
            window = F.substring(t, low + 1, aim - low)
            cut = F.when(aim < n, F.length(F.regexp_extract(window, f"(?s)^.*[{ends}]", 0)))

            # Each part is bound once: written out in full they would be evaluated many times per step.
            def at_end(end: Column) -> Column:
                return let(F.length(strip(F.substring(t, start + 1, end - start))) >= minimum, lambda good: moved(end, good))

            def moved(end: Column, good: Column) -> Column:
                back = end - overlap
                # The previous start guards against standing still, as does reaching the end of the text.
                last = F.when(good, start).otherwise(s["last"])
                nxt = F.when(end >= n, n).when(F.coalesce(back <= last, F.lit(False)), end).otherwise(F.greatest(back, F.lit(0)))
                return F.struct(nxt.alias("at"), last.alias("last"), F.when(good, F.struct(start.alias("a"), end.alias("b"))).alias("emit"))

            nothing = F.struct(s["at"].alias("at"), s["last"].alias("last"), F.lit(None).cast("struct<a:int,b:int>").alias("emit"))
            return F.when(start >= n, nothing).otherwise(let(cut, lambda c: let(F.when(aim >= n, n).when(c > 0, low + c).otherwise(aim), at_end)))

        return go

    def build(t: Column) -> Column:
        # An upper bound on the number of steps: every step moves by at least this much.
        pace = max(1, max(size - 100, minimum) - overlap)
        steps = F.sequence(F.lit(0), (F.length(t) / pace).cast("int") + 2)
        cuts = scan(steps, {"at": F.lit(0), "last": F.lit(None).cast("int")}, step(t), "struct<a:int,b:int>")
        return F.transform(cuts, lambda c: F.struct(strip(F.substring(t, c["a"] + 1, c["b"] - c["a"])).alias("content"), c["a"].alias("start_char"), c["b"].alias("end_char")))

    return let(text, build)


STRATEGIES: dict[str, Callable[..., Column]] = {"fixed": fixed, "paragraph": by_paragraph, "sentence": by_sentence, "mixed": mixed}


def register_strategy(name: str, make: Callable[..., Column]) -> None:
    """Add a strategy: a function of a text column giving an array of (content, start_char, end_char)."""
    STRATEGIES[name] = make


def chunk_array(text: Column, strategy: str = "mixed", **options) -> Column:
    """Chunks of a text; blank text has none. Offsets refer to the trimmed text."""
    body = strip(F.coalesce(text, F.lit("")))
    made = let(body, lambda t: STRATEGIES.get(strategy, mixed)(t, **options))
    return F.when(body != "", made).otherwise(F.array().cast(CHUNK))


def chunks(df: DataFrame, key: str, text: str = "text", strategy: str = "mixed", **options) -> DataFrame:
    """Chunk rows with their 0-based index."""
    made = F.transform(chunk_array(F.col(text), strategy, **options), lambda c, i: F.struct(
        i.alias("idx"), c["content"].alias("content"), c["start_char"].alias("start_char"), c["end_char"].alias("end_char")))
    return unnest(df, made, key, guard="idx")


def page_chunks(pages: DataFrame, key: str, page: str, text: str = "text", strategy: str = "mixed", width: int = 1024, **options) -> DataFrame:
    """Chunks of paged documents with an index that runs on over the pages of a document.

    Chunks are made per page. Page offsets come from a bucketed running total
    of chunk counts, so a document with very many pages stays distributed.
    """
    made = pages.select(key, page, chunk_array(F.col(text), strategy, **options).alias("_c"))
    counted = running_total(made, [key], page, F.size("_c"), F.floor(F.col(page) / width), "_base", inclusive=False)
    rows = F.transform("_c", lambda c, i: F.struct((F.col("_base") + i).alias("idx"), c["content"].alias("content"), c["start_char"].alias("start_char"), c["end_char"].alias("end_char")))
    return unnest(counted, rows, key, page, guard="idx")
