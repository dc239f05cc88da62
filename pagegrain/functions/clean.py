"""Unicode clean-up, repair rules, redaction and whole-text comparison."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain.functions.text import middles, squeeze, words

# Typographic characters and what replaces them.
TYPOGRAPHIC = {
    "\u201c": '"', "\u201d": '"', "\u2018": "'", "\u2019": "'", "\u2013": "-", "\u2014": "--",
    "\u2026": "...", "\u00a0": " ", "\u00ad": "", "\ufeff": "",
}
# Repair rules in the order they apply.
REPAIRS = [
    (r"\b0(?=[a-zA-Z])", "O"), (r"\b1(?=[a-zA-Z])", "I"), (r"(?<=[a-zA-Z])0\b", "O"), (r"(?<=[a-zA-Z])1\b", "l"),
    (r"rn", "m"), (r"cl", "d"), (r"vv", "w"), (r",,", ","), (r"\.\.", "."), (r"\s+", " "),
]
# Personal-data patterns in the order they apply.
REDACTIONS = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b\d{3}-\d{3}-\d{4}\b", "[PHONE]"),
    (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CARD]"),
]
PATH_PAIR = r"/[^/\s]+/[^/\s]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """Canonical composition; plain ASCII text never leaves the JVM."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def normalize_unicode(c: Column) -> Column:
    out = nfc(c)
    single = {k: v for k, v in TYPOGRAPHIC.items() if len(v) == 1}
    out = F.translate(out, "".join(single) + "".join(k for k, v in TYPOGRAPHIC.items() if not v), "".join(single.values()))
    for k, v in TYPOGRAPHIC.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(out, r"[\p{C}&&[^\n\r\t]]", "")


def decoded(data: Column, encoding: str | None = None) -> Column:
    """Struct of text, encoding and confidence: the given encoding where the bytes can be that, then UTF-8,
    then UTF-16 by its mark, then Latin-1, which takes any bytes.

    A given encoding counts as certain; the others are guesses of 0.7. Bytes are
    tested before they are decoded, so none of them fails the job.
    """
    head, even = F.hex(F.substring(data, 1, 2)), F.octet_length(data) % 2 == 0
    latin = F.decode(data, "ISO-8859-1")

    def paired(high: str) -> Column:
        """Whether units of two bytes are whole, and every half of a pair stands by its other half: seen from the high bytes alone."""
        rest = F.regexp_replace(F.regexp_replace(latin, high, "$1"), "[\\x{D8}-\\x{DB}][\\x{DC}-\\x{DF}]", "")
        return even & ~rest.rlike("[\\x{D8}-\\x{DF}]")

    little, big = paired("(?s).(.)"), paired("(?s)(.).")
    narrow = F.is_valid_utf8(data) & ~latin.rlike("[^\\x00-\\x7F]")
    tests = {"utf-8": F.is_valid_utf8(data), "us-ascii": narrow, "iso-8859-1": F.lit(True), "utf-16le": little, "utf-16be": big}
    aliases = {"utf8": "utf-8", "ascii": "us-ascii", "latin-1": "iso-8859-1", "latin1": "iso-8859-1", "utf-16-le": "utf-16le", "utf-16-be": "utf-16be", "utf-16": "utf-16le"}

    def arm(ok: Column, charset: str, name: str, confidence: float) -> Column:
        return F.when(ok, F.struct(F.decode(F.when(ok, data), charset).alias("text"), F.lit(name).alias("encoding"), F.lit(confidence).alias("confidence")))

    arms = []
    if encoding:
        known = aliases.get(encoding.lower(), encoding.lower())
        if known in tests:
            if encoding.lower() == "utf-16":
                arms.append(arm((head == "FFFE") & little | (head == "FEFF") & big, "UTF-16", encoding, 1.0))
            arms.append(arm(tests[known], known.upper(), encoding, 1.0))
    arms += [arm(tests["utf-8"], "UTF-8", "utf-8", 0.7), arm((head == "FFFE") & little | (head == "FEFF") & big, "UTF-16", "utf-16", 0.7), arm(F.lit(True), "ISO-8859-1", "latin-1", 0.7)]
    return F.when(data.isNotNull(), F.coalesce(*arms))


def corruption(c: Column, ignore_scripts: bool = False) -> Column:
    """Struct with the number of corruption signs, a flag and a confidence.

    ``ignore_scripts`` leaves out runs of three or more non-ASCII characters,
    which text in other scripts has everywhere.
    """
    marks = F.length(c) - F.length(F.replace(c, F.lit("\ufffd"), F.lit("")))
    runs = F.lit(0) if ignore_scripts else F.size(F.regexp_extract_all(c, F.lit(r"[^\x00-\x7F]{3,}"), 0))
    controls = F.size(F.regexp_extract_all(c, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), 0))
    mark_runs = F.size(F.regexp_extract_all(c, F.lit("\ufffd+"), 0))
    latin = c.rlike(r"[^\x00-\xFF]").cast("int")
    # The characters above U+00FF that code page 1252 can hold, and the C1 codes it can.
    cp = c.rlike("[^\\x00-\\x7F\\xA0-\\xFF€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]").cast("int")
    n = marks + runs + controls + mark_runs + latin + cp
    return F.struct(marks.alias("replacement_chars"), n.alias("issues"), (n > 0).alias("is_corrupted"),
                    F.when(n > 0, F.greatest(F.lit(0.1), F.lit(1.0) - n * 0.1)).otherwise(1.0).alias("confidence"))


def repaired(c: Column) -> Column:
    """Recognition repairs; they rewrite letter pairs anywhere, so pipelines leave them off by default."""
    out = c
    for pattern, to in REPAIRS:
        out = F.regexp_replace(out, "(?U)" + pattern, to)
    return squeeze(out)


def chars(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), 0)


def positional_changes(a: Column, b: Column) -> Column:
    """Characters that differ position by position, plus the difference in length."""
    differ = F.filter(F.zip_with(chars(a), chars(b), lambda x, y: x != y), lambda d: d)
    return F.size(differ) + F.abs(F.length(a) - F.length(b))


def text_integrity(a: Column, b: Column) -> Column:
    """Length change, character changes, score and flags of a processed text."""
    def build(n: Column) -> Column:
        score = F.when(F.length(a) > 0, F.greatest(F.lit(0.0), F.lit(1.0) - n / F.length(a))).otherwise(1.0)
        return F.struct(
            (F.length(b) - F.length(a)).alias("length_change"), n.alias("character_changes"), score.alias("integrity_score"),
            (score >= 0.9).alias("content_preserved"),
            (F.abs(F.length(b) - F.length(a)) > F.length(a) * 0.1).alias("large_length_change"),
            (n > F.length(a) * 0.05).alias("high_change_rate"))
    return let(positional_changes(a, b), build)


def comparable(c: Column, ignore_case: bool = False, unicode: bool = False) -> Column:
    out = squeeze(c)
    out = F.lower(out) if ignore_case else out
    return nfc(out) if unicode else out


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def similarity_ratio(a: Column, b: Column, floor: float | None = None) -> Column:
    """Matching-block ratio of two whole texts.

    Equal texts are 1 without leaving the JVM. With ``floor``, pairs whose
    lengths alone keep them under it get that upper bound instead of the ratio.
    """
    bound = F.least(F.length(a), F.length(b)) * 2.0 / (F.length(a) + F.length(b))
    easy = (a == b) if floor is None else ((a == b) | (bound < floor))
    exact = _ratio(F.when(~easy, a), F.when(~easy, b))
    short = F.when(a == b, 1.0)
    if floor is not None:
        short = short.when(bound < floor, bound)
    return F.coalesce(short, exact)


def edit_ratio(a: Column, b: Column) -> Column:
    """Native alternative to the ratio: 1 - edit distance / longer length."""
    def ratio(p: Column) -> Column:
        longest = F.greatest(F.length(p["a"]), F.length(p["b"]))
        edits = let(middles(p["a"], p["b"]), lambda m: F.levenshtein(m["x"], m["y"]))
        return F.when(longest == 0, 1.0).when(p["a"] == p["b"], 1.0).otherwise(F.lit(1.0) - edits / longest)
    return let(F.struct(a.alias("a"), b.alias("b")), ratio)


def quotient(x: Column, y: Column) -> Column:
    """x / y for x of 0 or more, as doubles have it in SQL without errors: by 0, 0 is NaN and the rest infinite."""
    return F.when(y != 0, x / y).when(x == 0, float("nan")).when(x > 0, float("inf"))


def integrity_score(ratio: Column, a: Column, b: Column, loss: float = 0.05, of_nothing=lambda change: F.lit(0.0)) -> Column:
    """Ratio, lowered when length or word count moved by more than ``loss``.

    ``of_nothing`` gives the relative change, from the absolute one, of an original without characters or words; none by default.
    """
    def relative(x: Column, y: Column) -> Column:
        return F.when(x > 0, F.abs(y - x) / x).otherwise(of_nothing(F.abs(y - x)))

    by_len = relative(F.length(a), F.length(b))
    by_words = relative(F.size(words(a)), F.size(words(b)))
    score = ratio * F.when(by_len > loss, F.lit(1.0) - by_len).otherwise(1.0)
    score = score * F.when(by_words > loss, F.lit(1.0) - by_words * 0.5).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def redacted(c: Column) -> Column:
    """Personal data replaced by tags, and path pairs by a hash of their text."""
    out = c
    for pattern, tag in REDACTIONS:
        # A cheap look first: most texts have no address and no long number.
        sign = (lambda t: F.contains(t, F.lit("@"))) if "@" in pattern else (lambda t: t.rlike("[0-9]{3}"))
        out = _where_needed(out, sign, "(?U)" + pattern, tag.replace("[", r"\[").replace("]", r"\]"))
    return let(out, lambda t: F.when(F.contains(t, F.lit("/")), _hash_paths(t)).otherwise(t))


def _where_needed(c: Column, sign, pattern: str, to: str) -> Column:
    return let(c, lambda t: F.when(sign(t), F.regexp_replace(t, pattern, to)).otherwise(t))


def _hash_paths(t: Column) -> Column:
    pattern = "(?U)" + PATH_PAIR
    tags = F.transform(F.regexp_extract_all(t, F.lit(pattern), 0),
                       lambda m: F.concat(F.lit("/[PATH_HASH_"), F.substring(F.md5(m.cast("binary")), 1, 8), F.lit("]")))
    return F.array_join(F.zip_with(F.split(t, pattern), tags, lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit("")))), "")


def html_text(c: Column) -> Column:
    """Markup to text: tags become spaces, then whitespace is squeezed."""
    return squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def safe_name(c: Column) -> Column:
    """A storage-safe name: letters, digits and underscores, 3 to 63 long, starting with a letter."""
    out = F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_")
    out = F.when((out != "") & ~out.rlike(r"^\p{L}"), F.concat(F.lit("c_"), out)).otherwise(out)
    out = F.substring(out, 1, 63)
    return F.when(F.length(out) < 3, F.concat(out, F.lit("_col"))).otherwise(out)


def pseudonym(c: Column, size: int = 32) -> Column:
    """Name by the MD5 digest of a text; fewer than its 32 hex digits make names collide where there are many."""
    return F.when(c.isNotNull() & (c != ""), F.substring(F.md5(c.cast("binary")), 1, size)).otherwise("anonymous")
