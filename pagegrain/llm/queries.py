"""The registered queries of this package and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import bpe, contamination, extraction, jaccard, katz, language, lines, nearest, ranked, shards, urls, warc, whitening
from pagegrain.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op6_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text as tokens of the 50k byte-level vocabulary and back."""
    return byte_bpe(table(spark, sf, "documents"))


def byte_bpe(docs: DataFrame) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return bpe.digests(rows, F.col("ids"), F.col("decoded"))


@query
def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark windows in every whole text, and the verdict."""
    found = contamination.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "found")
    c = F.col("found")
    return found.select("doc_id", c["n_words"].alias("n_words"), contamination.n_hit(c).alias("n_hit"), F.size(c["items"]).cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), contamination.contaminated(c).alias("contaminated"))


SQL["op10_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bl) WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every whole text, learned from two thirds of the documents."""
    docs, held_out = table(spark, sf, "documents"), language.remainder("doc_id", 3) == 1
    model = language.fit(docs, ~held_out)
    found = language.predict(docs, model, "found")
    return found.select("doc_id", held_out.alias("held_out"), "found.lang_pred", "found.score")


@query
def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines that resemble an earlier line."""
    out = lines.dedup(table(spark, sf, "documents"), lost="n_removed")
    return out.select("doc_id", "text", "n_removed")


SQL["op5_line_dedup"] = r"""
WITH l AS (SELECT doc_id, i, list_distinct(list_filter(regexp_split_to_array(lower(x[i]), '[ \t\x0B\f\r]+'), lambda w: w <> '')) AS w, x[i] AS line
           FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
e AS (SELECT doc_id, i, unnest(w) AS t FROM l),
c AS (SELECT t, count(*) AS c FROM e GROUP BY t),
o AS (SELECT e.doc_id, e.i, e.t, count(*) OVER (PARTITION BY e.doc_id, e.i) AS n, row_number() OVER (PARTITION BY e.doc_id, e.i ORDER BY c.c, e.t) AS j FROM e JOIN c USING (t)),
p AS (SELECT * FROM o WHERE j <= n - CAST(ceil(80 * n / 100.0) AS BIGINT) + 1),
m AS (SELECT DISTINCT a.doc_id AS da, a.i AS ia, b.doc_id AS db, b.i AS ib FROM p a JOIN p b
      ON a.t = b.t AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.i < b.i) AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
g AS (SELECT DISTINCT m.db AS doc_id, m.ib AS i FROM m JOIN l x ON x.doc_id = m.da AND x.i = m.ia JOIN l y ON y.doc_id = m.db AND y.i = m.ib
      WHERE 100 * len(list_intersect(x.w, y.w)) >= 80 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))))
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text, count(g.i) AS n_removed
FROM l LEFT JOIN g USING (doc_id, i) GROUP BY l.doc_id
UNION ALL SELECT doc_id, text, 0 FROM documents WHERE text IS NULL
"""


@query
def op7_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents that share four fifths of their five-word shingles."""
    return jaccard.join(table(spark, sf, "documents"))


SQL["op7_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS fp FROM s GROUP BY doc_id),
c AS (SELECT fp, min(doc_id) AS rep, any_value(n) AS n, count(*) AS n_copies FROM n GROUP BY fp),
t AS (SELECT s.doc_id, s.g, c.n FROM s JOIN c ON s.doc_id = c.rep),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id, coalesce(c.n_copies, 1) AS n_copies
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (fp) LEFT JOIN m ON m.node = c.rep
"""


@query
def op9_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every whole page."""
    out = extraction.extract(table(spark, sf, "pages"), "text")
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: Fixed values of the query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Fixed values of the query: sites whose pages are on the list.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


@query
def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Every page judged by the rules, then by the list of the pages of listed sites."""
    pages = table(spark, sf, "pages")
    listed = pages.select("url").where(urls.host(F.col("url")).rlike(rf"(?:^|\.)(?:{'|'.join(LISTED_SITES)})\."))
    return urls.judge(pages.select("page_id", "url"), listed, RULES).select("page_id", "host", "path", "rule", "verdict")


_URL_PARTS = r"""
  SELECT page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS q
  FROM (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
"""
SQL["op3_url_filter"] = rf"""
WITH p AS ({_URL_PARTS}),
c AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_\w+|ref|fbclid|gclid)(?:=|$)'))) AS k FROM p),
u AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(?:80|443)$', '') || regexp_replace(path, '(?:\.html?|/+)$', '')
             || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END END AS can FROM c),
l AS (SELECT DISTINCT can FROM u WHERE regexp_matches(host, '(?:^|\.)(?:{'|'.join(LISTED_SITES)})\.')),
r(verdict, h, p) AS (VALUES {', '.join(str(x) for x in RULES)}),
b AS (SELECT u.page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
      FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, CASE WHEN l.can IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN b USING (page_id) LEFT JOIN l ON u.can = l.can
"""


@query
def op4_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in eight shards along a curve over language, source and size."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
                                                F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = shards.assign(docs, ["lang", "source", "size"], ["text_crc32", "doc_id"], 8, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op2_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty nearest of every twentieth vector among all others."""
    return nearest.search(table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


@query
def op8_katz_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text under a trigram Katz model of all n-grams of six sevenths of the documents."""
    scored, _ = katz.score(table(spark, sf, "documents"), language.remainder("doc_id", 7) != 2, order=katz.ORDER, least=1)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_warc_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a record of seekable bundles, read back from them."""
    folder = shared_dir(spark, "warc")
    warc.write(table(spark, sf, "pages"), folder)
    rows = warc.read(spark, folder, payloads=False)
    return rows.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector on the 32 first components of all vectors, one row a component."""
    rows = whitening.whiten(table(spark, sf, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"), "whitened",
                       F.get("explained", F.col("at")).alias("explained"), "identity_error")


@query
def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL["op13_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM n),
q AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
x AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY t),
p AS (SELECT q.item_id, f.doc_id, CAST(sum(q.qtf * x.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * n.n * s.nd) // s.nt)))) AS BIGINT) AS score
      FROM q JOIN f USING (t) JOIN x USING (t) JOIN n ON n.doc_id = f.doc_id, s GROUP BY q.item_id, f.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
SQL["op11_warc_bundles"] = """
WITH p AS (SELECT page_id, CAST(encode(coalesce(html, '')) AS BLOB) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS s, max(page_id) OVER (PARTITION BY payload) AS top FROM p),
b AS (SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', s[i + 1]) - 1) AS x FROM h),
c AS (SELECT *, list_transform(range(0, 160), lambda i: (x[i // 4 + 1] >> (3 - i % 4)) & 1) AS bits FROM b)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * bits[5 * i + 1] + 8 * bits[5 * i + 2] + 4 * bits[5 * i + 3] + 2 * bits[5 * i + 4] + bits[5 * i + 5], 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM c
"""
