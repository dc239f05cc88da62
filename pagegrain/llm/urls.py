"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

The host of a URL is what follows the first ``://`` up to ``/``, ``?``, ``#`` or
the end, A-Z lower-cased; the path follows up to ``?``, ``#`` or the end. A null
URL, or one without ``://``, has neither. A rule fits its host and all its
subdomains where the path starts with the rule's; the longest wins. Where no
rule fits, the list decides.

The list becomes a table of 256-bit blocks, a bit in each of eight words for
every listed URL. It is broadcast, so its size is bounded by ``MAX_BLOCKS``: a
longer list only makes more false hits. Pages without a hit are never shuffled;
those with one meet the list in an exact join, which removes the false hits.
Only DataFrame functions are used.

Equal pages each give a row; equal and null list entries count once or not at
all; an empty list blocks nothing. Other columns of the input stay, results come
first, and an input column of the same name as a result is replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL = 16
#: Blocks of eight words: 64 MB of rows at most.
MAX_BLOCKS = 1 << 19
WORDS = 8


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without closing ``/`` and ``.html``, query without tracking parameters, no fragment; null without a host."""
    h = F.regexp_replace(host(url), r"^www\.|:(?:80|443)$", "")
    p = F.regexp_replace(path(url), r"(?:\.html?|/+)$", "")
    q = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(q, "&"), lambda x: (x != "") & ~x.rlike(r"^(?:utm_\w+|ref|fbclid|gclid)(?:=|$)"))), "&")
    return F.when(h != "", F.concat(h, p, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_for(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _place(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a URL and its bit in each word."""
    second = F.xxhash64(url, F.lit(1))
    return F.pmod(F.xxhash64(url), F.lit(blocks)), [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(second, 5 * i).bitwiseAND(31).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """block, w0 .. w7."""
    block, bits = _place(F.col(url), blocks)
    rows = listed.select(block.alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(bits)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """host, path, rule and verdict of every page; ``listed`` has one column of URLs to block."""
    own = "__url"
    while any(c.lower().startswith(own) for c in pages.columns):
        own += "_"
    key, entry, at, hit = (f"{own}_{n}" for n in ("canonical", "listed", "block", "hit"))
    words = [f"{own}_w{i}" for i in range(WORDS)]
    entries = listed.select(canonical(F.col(listed.columns[0])).alias(entry)).where(F.col(entry).isNotNull()).distinct()
    blocks = max(1, min(MAX_BLOCKS, -(-entries.count() * BITS_PER_URL // 256)))
    table = bloom(entries, entry, blocks).toDF(at, *words)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url)), key: canonical(F.col(url))})
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    block, bits = _place(F.col(key), blocks)
    probed = rows.withColumn(at, block).join(F.broadcast(table), at, "left")
    found = F.col("verdict").isNull() & F.col(key).isNotNull()
    for w, b in zip(words, bits):
        found = found & F.coalesce(F.col(w).bitwiseAND(b) != 0, F.lit(False))
    marked = probed.withColumn(hit, found).drop(at, *words)
    clear = marked.where(~F.col(hit)).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    maybe = marked.where(F.col(hit)).join(entries, F.col(key) == F.col(entry), "left").withColumn("verdict", F.when(F.col(entry).isNotNull(), "block").otherwise("allow"))
    return clear.unionByName(maybe.drop(entry)).drop(key, hit)
