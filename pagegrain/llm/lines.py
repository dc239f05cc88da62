"""Line dedup: an exact set-similarity join of lines, in DataFrame functions alone.

A line is the set of its words, lower-cased and cut at white space. It goes when
an earlier line of the corpus has Jaccard similarity of at least 0.8 with it;
earlier is by document key, then by the hash of the text for rows that share a
key, then by position. So of equal lines the first one stays, and a line may go
because of one that goes itself.

Words are ordered by rarity: the occurrences of all words are counted in
``RARITY_BUCKETS`` buckets of their hash, and a word ranks by its bucket, then by
its hash. Any order gives the same result; this one needs no join of every word
with its count. Of a line of n words the first n - ceil(0.8 n) + 1 are its
prefix; similar lines share a prefix word. Pairs are also tested by length, by
position and by a parity map of the words, whose differing bits bound the overlap
from above, before their words are compared. The map has 64 bits, or 128 for a line
of more than ``WIDE`` words; either half of the longer one folds into the shorter. Of its pairs a line is first
compared in the likeliest one, and in the others only where that is no match.

Equal sets are one class from the start. A word that occurs once is in no pair, and
one that occurs ``LIGHT`` times at most is shared by no more classes, so these need
no counting. Where more than ``LIGHT`` classes share
a prefix word, each is first compared with the earliest alone, and only those
that stay are compared with all that are earlier; so a large group of near
copies never becomes all its pairs.

Lines without words stay. A null text stays null; a text whose lines all go is
empty; no row goes. Rows equal in key and text keep the same lines. Null keys
come first. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrain.llm.common import cut

RARITY_BUCKETS = 1 << 20
#: Levels a doubling of the occurrences.
LEVELS = 48
LIGHT = 640
#: Words of a line beyond which 64 bits tell little: two lines that share nothing differ in about half of them.
WIDE = 96
#: Rows up to which keys or positions are broadcast, some tens of MB; beyond, the optimizer shuffles.
BROADCAST_ROWS = 1 << 20
PERCENT = 80
ROW = ("doc", "at", "nj", "bits", "wide")


def plain(text: Column) -> Column:
    """Lower-cased, with a space for each tab, vertical tab, form feed and carriage return."""
    low = F.lower(text)
    return F.when(low.rlike(r"[\t\x0B\f\r]"), F.translate(low, "\t\x0b\f\r", "    ")).otherwise(low)


def rarity(texts: DataFrame, text: str) -> DataFrame:
    """One row, ``levels``: for each bucket of word hashes a number that grows with the occurrences of its words, in the highest bits."""
    space = texts.sparkSession.range(RARITY_BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).cast("bigint").alias("n"))
    words = texts.select(F.explode(F.split(F.replace(plain(F.col(text)), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where(F.col("w") != "")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(RARITY_BUCKETS - 1).alias("bucket")).agg(F.count("*").alias("n"))
    each = counts.unionByName(space).groupBy("bucket").agg(F.sum("n").alias("n"))
    level = F.shiftleft(F.least(F.lit(2047), F.floor(F.log2(F.col("n") + 1) * LEVELS)).cast("bigint"), 52)
    return each.select("bucket", level.alias("level")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "level"))), lambda x: x["level"]).alias("levels"))


def prefix_length(n: Column) -> Column:
    return (n - F.ceil(F.lit(PERCENT) * n / 100) + 1).cast("int")


def row_hash(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(0x7FFFFFFF)


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, at (hash of the text, then line number) and line, made plain, of the lines that have words."""
    row = docs.select(F.col(key).alias("doc"), F.shiftleft(row_hash(F.col(text)), 32).alias("row"), F.split(plain(F.col(text)), "\n").alias("lines"))
    each = row.select("doc", "row", F.posexplode_outer("lines").alias("pos", "line"))
    return each.where(F.trim("line") != "").select("doc", (F.col("row") + F.col("pos")).alias("at"), "line")


def prefixes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, at, sig, n, bits, wide, prefix of every line that has words, written to the shared folder.

    No filter stands on a derived array, since the optimizer would push it down
    and compute the array twice.
    """
    hashed = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    coded = F.transform("hashes", lambda h: F.get("levels", h.bitwiseAND(RARITY_BUCKETS - 1).cast("int")).bitwiseOR(F.shiftrightunsigned(h, 12)))
    rows = numbered_lines(docs, key, text).withColumn("hashes", hashed).withColumn("levels", rarity(docs, text).scalar())
    rows = rows.select("doc", "at", F.sort_array(coded).alias("codes"))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), c.bitwiseAND(63).cast("int"))
    parity = lambda codes: F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: a.bitwiseXOR(bit(c)))
    upper = F.when(F.size("codes") > WIDE, parity(F.filter("codes", lambda c: c.bitwiseAND(64) != 0))).otherwise(F.lit(0).cast("bigint"))
    return cut(rows.select("doc", "at", F.xxhash64("codes").alias("sig"), F.size("codes").alias("n"), parity("codes").alias("bits"), upper.alias("wide"),
                           F.slice("codes", 1, prefix_length(F.size("codes"))).alias("prefix")), "lines")


def candidates(lines: DataFrame) -> DataFrame:
    """kind, code, a, b: pairs of classes that share a light word and may match, or for a heavy word its row b and the earliest row a.

    The sides of a join read one shuffle by word; the filters are part of the join,
    so that only pairs that may match become rows. Words that the corpus holds too
    seldom to be heavy are joined as they are, the others are counted first.
    """
    classes = lines.groupBy("sig", "n").agg(F.min(F.struct("doc", "at", "bits", "wide", "prefix")).alias("first"))
    rows = classes.select("n", "first.doc", "first.at", "first.bits", "first.wide", F.posexplode("first.prefix").alias("j", "code"))
    nj = (F.shiftleft(F.col("n").cast("bigint"), 32) + F.col("j")).alias("nj")
    packed = rows.select("code", "doc", "at", "bits", "wide", nj).where(F.col("code").isNotNull() & (level("code") > LEVELS))
    whole = Window.partitionBy("code")
    seldom = level("code") <= F.lit(int(LEVELS * math.log2(LIGHT + 1)) - 1)
    posted = packed.where(~seldom).withColumn("many", F.count("*").over(whole)).where(F.col("many") > 1)

    def pairs(side: DataFrame) -> DataFrame:
        return matching(side).select(F.lit(0).alias("kind"), "code", "a", "b")

    heavy = posted.where(F.col("many") > LIGHT).select("code", F.struct(*ROW).alias("b")).withColumn("a", F.min("b").over(whole))
    return pairs(packed.where(seldom)).unionByName(pairs(posted.where(F.col("many") <= LIGHT))).unionByName(heavy.select(F.lit(1).alias("kind"), "code", "a", "b"))


def level(code: str) -> Column:
    """Level of a word's bucket: of n occurrences floor(LEVELS * log2(n + 1)), so that n < 2 ** ((level + 1) / LEVELS); ``LEVELS`` for one."""
    return F.shiftrightunsigned(code, 52)


def matching(rows: DataFrame) -> DataFrame:
    """code, a, b: rows that share a word, of which a is the earlier one, and may match."""
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, (F.col("a.code") == F.col("b.code")) & may_match("a", "b") & before("a", "b"))
    return both.select("a.code", *(F.struct(*(F.col(f"{x}.{c}") for c in ROW)).alias(x) for x in ("a", "b")))


def before(a: str, b: str) -> Column:
    """As structs (doc, at) compare, without making them for every pair: null keys first."""
    (x, i), (y, j) = ((F.col(f"{r}.doc"), F.col(f"{r}.at")) for r in (a, b))
    return F.coalesce(x < y, x.isNull() & y.isNotNull()) | (x.eqNullSafe(y) & (i < j))


def may_match(a: str, b: str) -> Column:
    """Position, length and parity filters on rows that share the word at position j; in whole numbers, the cheapest first."""
    nx, ny = (F.shiftright(f"{r}.nj", 32) for r in (a, b))
    after = F.least(*(F.shiftright(f"{r}.nj", 32) - F.col(f"{r}.nj").bitwiseAND(0xFFFFFFFF) for r in (a, b)))
    similar = lambda shared, both: (100 + PERCENT) * shared >= PERCENT * both
    return similar(after, nx + ny) & (100 * F.least(nx, ny) >= PERCENT * F.greatest(nx, ny)) & similar(nx + ny - apart(a, b), 2 * (nx + ny))


def apart(a: str, b: str) -> Column:
    """Differing bits of the parity maps, at most the number of words that only one of the lines has.

    ``bits`` is the map of all words, ``wide`` that of the upper half of the 128 for a long line; the lower half is what differs between them.
    """
    whole, upper = (F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("bits", "wide"))
    long = F.least(F.shiftright(f"{a}.nj", 32), F.shiftright(f"{b}.nj", 32)) > WIDE
    return F.when(long, F.bit_count(whole.bitwiseXOR(upper)) + F.bit_count(upper)).otherwise(F.bit_count(whole))


def ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.struct("a.doc", "a.at").alias("a"), F.struct("b.doc", "b.at").alias("b")).distinct()


def verified(docs: DataFrame, key: str, text: str, pairs: DataFrame) -> DataFrame:
    """b of the pairs (a, b) whose lines are similar by their words."""
    pairs = cut(pairs, "line-pairs")
    wanted = cut(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).groupBy("a").agg(F.lit(1).alias("one")).select("a.doc", "a.at"), "line-ids")
    by_doc = wanted.groupBy("doc", F.shiftright("at", 32).alias("row")).agg(F.collect_list("at").alias("ats"))
    if wanted.count() <= BROADCAST_ROWS:
        by_doc = F.broadcast(by_doc)
    row = row_hash(F.col(text))
    found = docs.select(F.col(key).alias("d"), row.alias("r"), F.col(text).alias("t")).join(by_doc, F.col("d").eqNullSafe(F.col("doc")) & (F.col("r") == F.col("row")))
    cut_once = found.select("doc", "ats", F.split(plain(F.col("t")), "\n").alias("lines"))
    each = cut_once.select("doc", F.explode(F.transform("ats", lambda at: F.struct(at.alias("at"), F.get("lines", at.bitwiseAND(0x7FFFFFFF).cast("int")).alias("line")))).alias("l")).select("doc", "l.at", "l.line")
    # Lines travel as text, which is half of what their words take as arrays.
    texts = each.select(F.struct("doc", "at").alias("id"), "line").dropDuplicates(["id"])
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    words = lambda line: F.array_remove(F.array_distinct(F.split(line, " ")), "")
    both = both.select("a", "b", words("la").alias("wa"), words("lb").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.where(100 * shared >= PERCENT * (F.size("wa") + F.size("wb") - shared)).select("b.doc", "b.at").distinct()


def likeness(a: str, b: str) -> Column:
    """Bound of the similarity by the parity maps."""
    both, differ = F.shiftright(f"{a}.nj", 32) + F.shiftright(f"{b}.nj", 32), apart(a, b)
    return (both - differ) / (both + differ)


def matches(docs: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """doc, at of the rows b of ``found`` with a similar row a.

    One match is enough, so every b is compared with its likeliest a first, and only
    those without a match with all others: a group of near copies takes about as
    many comparisons as it has lines.
    """
    likeliest = F.max(F.struct(likeness("a", "b").alias("likeness"), F.struct("a.doc", "a.at").alias("a")))
    tried = cut(found.groupBy(F.struct("b.doc", "b.at").alias("b")).agg(likeliest["a"].alias("a")), "line-likeliest")
    first = cut(verified(docs, key, text, tried.select("a", "b")), "line-matches")
    matched = first.select(F.struct("doc", "at").alias("m"))
    open_ = cut(tried.join(matched, F.col("b").eqNullSafe(F.col("m")), "left_anti").select(F.col("b").alias("ob"), F.col("a").alias("oa")), "line-open")
    if open_.count() <= BROADCAST_ROWS:
        open_ = F.broadcast(open_)
    pairs = found.select(F.struct("a.doc", "a.at").alias("a"), F.struct("b.doc", "b.at").alias("b"))
    rest = pairs.join(open_, F.col("b").eqNullSafe(F.col("ob")) & ~F.col("a").eqNullSafe(F.col("oa"))).select("a", "b").distinct()
    return cut(first.unionByName(verified(docs, key, text, rest)), "line-matches")


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, row (hash of the text), at array: the lines that go, one row a document that loses any."""
    lines = prefixes(docs, key, text)
    found = cut(candidates(lines), "line-candidates")
    heavy = found.where("kind = 1")
    first = matches(docs, key, text, found.where((F.col("kind") == 0) | (before("a", "b") & may_match("a", "b"))))
    gone = first.select(F.col("doc").alias("gd"), F.col("at").alias("ga"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    flat = heavy.select("code", *(f"b.{c}" for c in ROW))
    left = flat.join(gone, F.col("doc").eqNullSafe(F.col("gd")) & (F.col("at") == F.col("ga")), "left_anti")
    a, b = flat.repartition("code").alias("a"), left.repartition("code").alias("b")
    rest = b.join(a, (F.col("a.code") == F.col("b.code")) & may_match("a", "b") & before("a", "b"))
    matched = first.unionByName(verified(docs, key, text, ids(rest))) if heavy.take(1) else first
    classes = lines.groupBy("sig", "n").agg(F.min(F.struct("doc", "at")).alias("first"))
    lost = matched.distinct().select(F.struct("doc", "at").alias("lost"))
    judged = classes.join(lost, F.col("first").eqNullSafe(F.col("lost")), "left").select("sig", "n", F.when(F.col("lost").isNull(), F.col("first")).alias("stays"))
    out = lines.select("doc", "at", "sig", "n").join(judged, ["sig", "n"]).where(~F.col("stays").eqNullSafe(F.struct("doc", "at")))
    return out.groupBy("doc", F.shiftright("at", 32).alias("row")).agg(F.collect_set(F.col("at").bitwiseAND(0x7FFFFFFF).cast("int")).alias("at"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", lost: str | None = None) -> DataFrame:
    """``docs`` without their later similar lines; ``lost`` names a column for the number of lines that went."""
    gone = cut(removed(docs, key, text), "line-removals")
    names = {"d": "__doc", "r": "__row", "at": "__at"}
    while set(names.values()) & set(docs.columns):
        names = {k: v + "_" for k, v in names.items()}
    gone = gone.toDF(*(names[k] for k in ("d", "r", "at")))
    size = gone.agg(F.sum(F.size(names["at"]))).first()[0] or 0
    if size <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    row = row_hash(docs[text])
    joined = docs.join(gone, docs[key].eqNullSafe(gone[names["d"]]) & (row == gone[names["r"]]), "left")
    at = F.col(names["at"])
    kept = F.when(at.isNull(), docs[text]).otherwise(F.array_join(F.filter(F.split(docs[text], "\n"), lambda line, i: ~F.array_contains(at, i)), "\n"))
    out = [kept.alias(c) if c == text else docs[c] for c in docs.columns]
    return joined.select(*out, *([F.coalesce(F.size(at), F.lit(0)).cast("bigint").alias(lost)] if lost else []))


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``docs`` without their later similar lines and with ``chars`` as the length of what stays.

    A document that loses lines and has no word left is wholly a repetition of
    earlier ones and goes; a text that had no words before stays.
    """
    lost = "__lost"
    while lost in docs.columns:
        lost += "_"
    rows = dedup(docs, key, text, lost=lost).where((F.col(lost) == 0) | F.col(text).rlike(r"\S"))
    return rows.select(*(F.length(text).cast(docs.schema[chars].dataType).alias(c) if c == chars else F.col(f"`{c}`") for c in docs.columns))
