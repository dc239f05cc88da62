"""Joins by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions.arrays import unnest
from pagegrain.operators import layout, spatial
from pagegrain.plans import inputs
from pagegrain.plans.ansi import with_ll, with_lr
from pagegrain.plans.registry import query

_INTER = """greatest(0, least(r.x2, l.x2) - greatest(r.x1, l.x1)) * greatest(0, least(r.y2, l.y2) - greatest(r.y1, l.y1))"""
JN1_SQL = f"""
SELECT r.doc_id, r.ord, round(avg(l.confidence), 6) AS confidence, count(l.confidence) AS n_matched
FROM lr r LEFT JOIN ll l ON r.doc_id = l.doc_id AND (r.x2 - r.x1) * (r.y2 - r.y1) > 0
 AND (((l.x1 + l.x2) / 2 BETWEEN r.x1 AND r.x2 AND (l.y1 + l.y2) / 2 BETWEEN r.y1 AND r.y2)
  OR {_INTER} > 0.3 * ((r.x2 - r.x1) * (r.y2 - r.y1) + (l.x2 - l.x1) * (l.y2 - l.y1) - {_INTER}))
GROUP BY r.doc_id, r.ord"""


@query("jn1_region_line_confidence", with_lr(JN1_SQL))
def region_line_confidence(spark, sf):
    out = spatial.region_confidence(inputs.lr(spark, sf), inputs.ll(spark, sf))
    return out.select("doc_id", "ord", F.round("confidence", 6).alias("confidence"), "n_matched")


_SHIFTED = "SELECT doc_id, line_no, confidence, x1 + 40 AS x1, y1 + (line_no % 5) * 4 AS y1, x2 + 40 AS x2, y2 + (line_no % 5) * 4 AS y2 FROM ll"


@query("jn2_region_line_overlap", with_lr(f""", sh AS ({_SHIFTED})
SELECT r.doc_id, r.ord, round(avg(l.confidence), 6) AS confidence, count(l.confidence) AS n_matched
FROM lr r LEFT JOIN sh l ON r.doc_id = l.doc_id AND l.confidence > 0
 AND {_INTER} > 0.5 * greatest((l.x2 - l.x1) * (l.y2 - l.y1), 1)
GROUP BY r.doc_id, r.ord"""))
def region_line_overlap(spark, sf):
    dy = (F.col("line_no") % 5) * 4
    shifted = inputs.ll(spark, sf).withColumns({
        "x1": F.col("x1") + 40, "x2": F.col("x2") + 40, "y1": F.col("y1") + dy, "y2": F.col("y2") + dy})
    out = spatial.region_confidence(inputs.lr(spark, sf), shifted, rule="covers_line")
    return out.select("doc_id", "ord", F.round("confidence", 6).alias("confidence"), "n_matched")


_STANDALONE = """SELECT l.doc_id, l.line_no, l.text, l.confidence, l.x1, l.y1, l.x2, l.y2 FROM ll l WHERE NOT EXISTS (
  SELECT 1 FROM lr r WHERE r.doc_id = l.doc_id AND r.ord % 3 <> 1
   AND (l.x1 + l.x2) / 2 BETWEEN r.x1 AND r.x2 AND (l.y1 + l.y2) / 2 BETWEEN r.y1 AND r.y2)"""


@query("jn4_lines_outside_regions", with_lr(f"SELECT doc_id, line_no FROM ({_STANDALONE})"))
def lines_outside_regions(spark, sf):
    thinned = inputs.lr(spark, sf).where(F.col("ord") % 3 != 1)
    return spatial.outside_regions(inputs.ll(spark, sf), thinned).select("doc_id", "line_no")


@query("set1_regions_and_lines", with_lr(f""", o AS ({_STANDALONE}),
u AS (SELECT doc_id, 'region' AS kind, ord AS pos, y1 AS y, length(content) AS n_chars FROM lr WHERE ord % 3 <> 1
UNION ALL SELECT doc_id, 'line', line_no, y1, length(text) FROM o)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, kind DESC, pos) - 1 AS at FROM u"""))
def regions_and_lines(spark, sf):
    thinned = inputs.lr(spark, sf).where(F.col("ord") % 3 != 1)
    lone = spatial.outside_regions(inputs.ll(spark, sf), thinned)
    shown = lambda df, pos, text: df.select("doc_id", F.col(pos).alias("pos"), F.col("y1").alias("y"), F.length(text).alias("n_chars"))
    return spatial.merged_by_y(shown(thinned, "ord", "content"), shown(lone, "line_no", "text"))


# Copies shifted a little, some with other or no text, so that removal depends on what was kept.
_JITTER = r"""
concat(regions,
  transform(regions, r -> named_struct('ord', r.ord + 1000000, 'type', r.type, 'x1', r.x1 + 2, 'y1', r.y1 + 1 + r.ord % 3,
    'x2', r.x2 + 2, 'y2', r.y2 + 1 + r.ord % 3,
    'content', if(r.ord % 4 = 0, '', if(r.ord % 4 = 1, concat(r.content, '!'), r.content)), 'n_lines', r.n_lines, 'confidence', r.confidence)),
  transform(regions, r -> named_struct('ord', r.ord + 2000000, 'type', r.type, 'x1', r.x1, 'y1', r.y1 + 30,
    'x2', r.x2, 'y2', r.y2 + 30, 'content', if(r.ord % 2 = 0, '', r.content), 'n_lines', r.n_lines, 'confidence', r.confidence)))
"""


_KEPT = with_lr("""
, cand AS (
  SELECT doc_id, ord, x1, y1, x2, y2, content FROM lr
  UNION ALL SELECT doc_id, ord + 1000000, x1 + 2, y1 + 1 + ord % 3, x2 + 2, y2 + 1 + ord % 3,
         CASE ord % 4 WHEN 0 THEN '' WHEN 1 THEN content || '!' ELSE content END FROM lr
  UNION ALL SELECT doc_id, ord + 2000000, x1, y1 + 30, x2, y2 + 30, CASE WHEN ord % 2 = 0 THEN '' ELSE content END FROM lr),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y1, ord) AS i FROM cand),
rep AS (SELECT b.doc_id, b.i AS i, list(a.i) AS hits FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.i < b.i
  AND least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)
  AND (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))
      / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) > 0.7
  AND (b.content = a.content OR b.content = '') GROUP BY b.doc_id, b.i),
f AS (SELECT doc_id, 1::BIGINT AS i, [1::BIGINT] AS kept FROM s WHERE i = 1
  UNION ALL SELECT f.doc_id, s.i, CASE WHEN coalesce(list_has_any(f.kept, rep.hits), false) THEN f.kept ELSE list_append(f.kept, s.i) END
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1 LEFT JOIN rep ON rep.doc_id = s.doc_id AND rep.i = s.i),
last AS (SELECT doc_id, max_by(kept, i) AS kept FROM f GROUP BY doc_id)
SELECT s.doc_id, s.ord FROM s JOIN last USING (doc_id) WHERE list_contains(last.kept, s.i)""", recursive=True)


@query("jn5_overlap_dedup", _KEPT)
def overlap_dedup(spark, sf):
    p = inputs.pages(spark, sf).select("doc_id", F.expr(_JITTER).alias("regions"))
    kept = spatial.kept_regions(layout.sort_regions(p, "y"))
    return unnest(kept, "regions", "doc_id", guard="ord").select("doc_id", "ord")


@query("jn5_overlap_rounds", _KEPT)
def overlap_rounds(spark, sf):
    """The same removal over region rows, decided in rounds."""
    p = inputs.pages(spark, sf).select("doc_id", F.expr(_JITTER).alias("regions"))
    return spatial.kept_region_rows(unnest(p, "regions", "doc_id", guard="ord")).select("doc_id", "ord")
