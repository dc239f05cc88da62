"""Confidence scores, warnings and reports over layout regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import labels
from pagegrain.functions.arrays import unnest
from pagegrain.operators import confidence, spatial
from pagegrain.plans import inputs
from pagegrain.plans.ansi import s_map, s_strip, with_ll, with_lr
from pagegrain.plans.registry import query
from pagegrain.plans.spatial import JN1_SQL


_RTYPE = s_map("type", labels.ITEM_TO_REGION, "'paragraph'")


def _typed(df):
    return df.withColumn("region_type", labels.region_type(F.col("type")))


def _band(e: str, scale: str) -> str:
    bounds, rest = labels.BANDS[scale]
    return "CASE " + " ".join(f"WHEN {e} >= {b} THEN '{n}'" for b, n in bounds) + f" ELSE '{rest}' END"


_CONF = f""", t AS (SELECT *, {_RTYPE} AS region_type, (x2 - x1) * (y2 - y1) AS area FROM src),
a AS (SELECT doc_id, count(*) AS region_count, count(*) FILTER (WHERE confidence > 0) AS with_confidence,
   coalesce(sum(CAST(confidence AS DECIMAL(20, 9))) FILTER (WHERE confidence > 0)::DOUBLE / nullif(count(*) FILTER (WHERE confidence > 0), 0), 0) AS text_confidence, count(DISTINCT region_type) AS n_types,
   avg(CASE WHEN length({s_strip('content')}) > 3 THEN 1.0 ELSE 0.0 END) AS cf, avg(CASE WHEN area > 50 AND area < 10000000 THEN 1.0 ELSE 0.0 END) AS sf
  FROM t GROUP BY doc_id),
b AS (SELECT *, with_confidence / region_count AS coverage,
   cf * 0.5::DOUBLE + sf * 0.3::DOUBLE + CASE WHEN n_types >= 3 THEN 1.0::DOUBLE WHEN n_types = 2 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END * 0.2::DOUBLE AS layout_confidence FROM a),
c AS (SELECT *, (text_confidence * 0.7::DOUBLE + layout_confidence * 0.3::DOUBLE)
   * (0.5::DOUBLE + 0.5::DOUBLE * CASE WHEN coverage < 0.5 THEN least(1.0::DOUBLE, coverage / 0.5::DOUBLE) ELSE 1.0::DOUBLE END) AS overall FROM b)"""
_SCORES = """round(text_confidence, 6) AS text_confidence, round(layout_confidence, 6) AS layout_confidence,
 round(coverage, 6) AS coverage, round(overall, 6) AS overall"""
_FROM_LR = ", src AS (SELECT doc_id, ord, type, content, confidence, x1, y1, x2, y2 FROM lr)" + _CONF


def _rounded(df, *cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("agg1_3_document_confidence", with_lr(
    _FROM_LR + f" SELECT doc_id, region_count, with_confidence, region_count - with_confidence AS without_confidence, {_SCORES} FROM c"))
def document_confidence(spark, sf):
    d = confidence.document_confidence(_typed(inputs.lr(spark, sf)))
    return d.select("doc_id", "region_count", "with_confidence", "without_confidence",
                    *_rounded(d, "text_confidence", "layout_confidence", "coverage", "overall"))


def badly_read(spark, sf):
    """Flagship: score every region from its matching lines, then every document. Flags stand for the text, which never moves."""
    regions = confidence.flagged(_typed(inputs.lr(spark, sf)))
    d = confidence.confidence_of_flags(spatial.region_confidence(regions, inputs.ll(spark, sf), carry=confidence.FLAGS))
    return d.select("doc_id", "region_count", "with_confidence", *[F.round(c, 9).alias(c) for c in ("text_confidence", "layout_confidence", "coverage", "overall")])


query("document_readability", with_lr(f""", m AS ({JN1_SQL.replace('round(avg(l.confidence), 6)', 'sum(CAST(l.confidence AS DECIMAL(20, 9)))::DOUBLE / nullif(count(l.confidence), 0)')}),
src AS (SELECT lr.doc_id, lr.ord, type, content, m.confidence, x1, y1, x2, y2 FROM lr JOIN m ON lr.doc_id = m.doc_id AND lr.ord = m.ord)
{_CONF} SELECT doc_id, region_count, with_confidence, {_SCORES.replace(', 6)', ', 9)')} FROM c"""))(badly_read)


_METRICS = _FROM_LR + """, m AS (SELECT c.doc_id, round(c.overall, 9) AS overall, round(c.overall, 9) AS layout, round(coalesce(x.text, 0.5), 9) AS text, round(coalesce(x.tab, 0.6), 9) AS tab
 FROM c JOIN (SELECT doc_id, avg(confidence) FILTER (WHERE region_type IN ('paragraph', 'header')) AS text,
   avg(confidence) FILTER (WHERE region_type = 'table') AS tab FROM t GROUP BY doc_id) x USING (doc_id))"""


def _metrics(spark, sf):
    regions = _typed(inputs.lr(spark, sf))
    m = confidence.conversion_metrics(regions, confidence.document_confidence(regions))
    return m.select("doc_id", *[F.round(c, 9).alias(c) for c in ("overall", "text", "layout", "table")])


@query("agg4_conversion_metrics", with_lr(_METRICS + """
SELECT doc_id, round(overall, 6) AS overall, round(text, 6) AS text, round(layout, 6) AS layout, round(tab, 6) AS "table" FROM m"""))
def conversion_metrics(spark, sf):
    m = _metrics(spark, sf)
    return m.select("doc_id", *_rounded(m, "overall", "text", "layout", "table"))


_B = lambda e: _band(e, "monitor")
_WARN = f""", w AS (
 SELECT doc_id, 'low_overall_confidence' AS warning, {_B('overall')} AS level, overall AS score,
  CASE {_B('overall')} WHEN 'very_poor' THEN 'high' WHEN 'poor' THEN 'medium' ELSE 'low' END AS severity, 'entire_document' AS areas FROM m WHERE overall < 0.70
 UNION ALL SELECT doc_id, 'low_text_confidence', {_B('text')}, text, 'medium', 'text_content, paragraphs, headers' FROM m WHERE text < 0.75
 UNION ALL SELECT doc_id, 'low_layout_confidence', {_B('layout')}, layout, 'medium', 'document_structure, headers, sections' FROM m WHERE layout < 0.65
 UNION ALL SELECT doc_id, 'low_table_confidence', {_B('tab')}, tab, 'medium', 'tables, table_structure, table_content' FROM m WHERE tab < 0.70
 UNION ALL SELECT doc_id, 'mixed_confidence', {_B('overall')}, overall, 'medium',
  array_to_string(list_filter([CASE WHEN text < 0.75 THEN 'text_recognition' END, CASE WHEN layout < 0.65 THEN 'layout_detection' END,
   CASE WHEN tab < 0.70 THEN 'table_recognition' END], lambda a: a IS NOT NULL), ', ')
  FROM m WHERE greatest(overall, text, layout, tab) - least(overall, text, layout, tab) > 0.20)"""


@query("agg5_confidence_warnings", with_lr(_METRICS + _WARN + " SELECT doc_id, warning, level, round(score, 6) AS score, severity, areas FROM w"))
def confidence_warnings(spark, sf):
    w = confidence.confidence_warnings(_metrics(spark, sf))
    return w.select("doc_id", "warning", "level", F.round("score", 6).alias("score"), "severity", "areas")


_A = confidence.ASSESSMENTS


@query("agg6_confidence_report", with_lr(_METRICS + _WARN + f"""
, k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE severity = 'high') AS h, count(*) FILTER (WHERE severity = 'medium') AS md FROM w GROUP BY doc_id)
SELECT m.doc_id, {_B('overall')} AS overall_level, {_B('text')} AS text_level, {_B('layout')} AS layout_level, {_B('tab')} AS table_level,
 {s_map(_B('overall'), confidence.DESCRIPTIONS, 'NULL')} AS description, coalesce(n, 0) AS warning_count,
 CASE WHEN coalesce(n, 0) = 0 THEN '{_A[0]}' WHEN h > 0 THEN '{_A[1]}' WHEN md > 2 THEN '{_A[2]}' WHEN md > 0 THEN '{_A[3]}' ELSE '{_A[4]}' END AS assessment
FROM m LEFT JOIN k ON m.doc_id = k.doc_id"""))
def confidence_report(spark, sf):
    return confidence.confidence_report(_metrics(spark, sf))


@query("agg7_region_assembly", with_ll("""
SELECT doc_id, (line_no // 4)::BIGINT AS ord, coalesce(string_agg(CASE WHEN line_no % 6 <> 5 THEN text END, chr(10) ORDER BY line_no), '') AS content,
  round(avg(CASE WHEN line_no % 6 <> 5 THEN confidence END), 6) AS confidence
FROM ll GROUP BY doc_id, line_no // 4"""))
def region_assembly(spark, sf):
    blanked = F.transform("lines", lambda l: l.withField("text", F.when(l["line_no"] % 6 == 5, "").otherwise(l["text"])))
    p = inputs.line_pages(spark, sf).select("doc_id", blanked.alias("lines"))
    n = F.size("lines")
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), ((n - 1) / 4).cast("int")))
    groups = F.transform(starts, lambda g: F.struct(g.cast("bigint").alias("ord"), F.slice("lines", g * 4 + 1, F.lit(4)).alias("ls")))
    rows = unnest(p, groups, "doc_id", guard="ord")
    return confidence.assembled_regions(rows, F.col("ls")).select("doc_id", "ord", "content", F.round("confidence", 6).alias("confidence"))


_RESULTS = """, res AS (SELECT doc_id, line_no // 5 AS table_no, avg(coalesce(confidence, 0)) AS score, count(*) AS n_scores FROM ll GROUP BY doc_id, line_no // 5)"""


def _with_results(spark, sf):
    n = F.size("lines")
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), ((n - 1) / 5).cast("int")))
    scores = F.transform(starts, lambda g: F.transform(
        F.slice("lines", g * 5 + 1, F.lit(5)), lambda l: F.coalesce(l["confidence"], F.lit(0.0))))
    return inputs.pages(spark, sf).withColumn("table_scores", scores)


@query("jn3_table_result_confidence", with_lr(_RESULTS + """
SELECT t.doc_id, t.ord, t.table_no, round(res.score, 6) AS confidence
FROM (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS table_no FROM lr WHERE type = 'table') t
LEFT JOIN res ON res.doc_id = t.doc_id AND res.table_no = t.table_no"""))
def table_result_confidence(spark, sf):
    return confidence.table_scores(_with_results(spark, sf)).select("doc_id", "ord", "table_no", F.round("confidence", 6).alias("confidence"))


@query("agg25_table_scores", with_ll(_RESULTS + " SELECT doc_id, table_no::BIGINT AS table_no, n_scores, round(score, 6) AS score FROM res"))
def table_scores(spark, sf):
    scored = inputs.ll(spark, sf).select("doc_id", F.floor(F.col("line_no") / 5).alias("table_no"), F.coalesce("confidence", F.lit(0.0)).alias("c"))
    return scored.groupBy("doc_id", "table_no").agg(F.count("c").alias("n_scores"), F.round(F.avg("c"), 6).alias("score"))


@query("agg12_block_counts", with_lr("SELECT doc_id, type, count(*) AS n FROM lr GROUP BY doc_id, type UNION ALL SELECT doc_id, 'total', count(*) FROM lr GROUP BY doc_id"))
def block_counts(spark, sf):
    return confidence.block_counts(inputs.lr(spark, sf))


@query("txt22_confidence_bands", with_lr(f"""
SELECT doc_id, ord, {_band('confidence', 'monitor')} AS level, {_band('confidence', 'cached')} AS cached_level, {_band('confidence', 'colour')} AS colour
FROM lr WHERE confidence IS NOT NULL"""))
def confidence_bands(spark, sf):
    c = F.col("confidence")
    return inputs.lr(spark, sf).where(c.isNotNull()).select(
        "doc_id", "ord", labels.confidence_band(c, "monitor").alias("level"),
        labels.confidence_band(c, "cached").alias("cached_level"), labels.confidence_band(c, "colour").alias("colour"))
