"""Projections, filters, orderings and unions over layout regions and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import labels
from pagegrain.functions.arrays import unnest
from pagegrain.functions.text import strip, words
from pagegrain.operators import layout
from pagegrain.plans import inputs
from pagegrain.plans.ansi import s_map, s_strip, s_words, with_ll, with_lr
from pagegrain.plans.registry import query


_RTYPE = s_map("type", labels.ITEM_TO_REGION, "'paragraph'")


@query("prj1_label_maps", with_lr(f"""
SELECT doc_id, ord, type AS item_type, {_RTYPE} AS region_type,
       {s_map("type", labels.RAW_TO_DISPLAY, "'text'")} AS display_type,
       {s_map(_RTYPE, labels.REGION_TO_BLOCK, "'paragraph'")} AS block_type
FROM lr"""))
def label_maps(spark, sf):
    item = labels.item_type(F.col("type"))
    region = labels.region_type(item)
    return inputs.lr(spark, sf).select(
        "doc_id", "ord", item.alias("item_type"), region.alias("region_type"),
        labels.display_type(F.col("type")).alias("display_type"), labels.block_type(region).alias("block_type"))


@query("prj1_stage_status", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status
FROM events""")
def stage_status(spark, sf):
    stage = F.when(F.col("event_type") == "purchase", "completed").when(
        F.col("event_type") == "error", "failed").otherwise("ocr_processing")
    return inputs.table(spark, sf, "events").select("event_id", labels.job_status(stage).alias("status"))


@query("prj2_xywh", with_lr("""
SELECT doc_id, ord, x1 AS x, y1 AS y, x2 - x1 AS width, y2 - y1 AS height,
       trunc(x2 * 1.37)::BIGINT - trunc(x1 * 1.37)::BIGINT AS whole_width
FROM lr WHERE ord % 6 <> 5"""))
def xywh(spark, sf):
    box = F.when(F.col("ord") % 6 == 5, F.array("x1", "y1")).otherwise(F.array("x1", "y1", "x2", "y2"))
    flat = layout.box_to_xywh(inputs.lr(spark, sf).withColumn("bbox", box))
    enlarged = flat.drop("x", "y").withColumnRenamed("width", "w0").withColumnRenamed("height", "h0").withColumn(
        "bbox", F.transform("bbox", lambda v: v * 1.37))
    whole = layout.box_to_xywh(enlarged, whole=True)
    return whole.select("doc_id", "ord", F.col("x1").alias("x"), F.col("y1").alias("y"),
                        F.col("w0").alias("width"), F.col("h0").alias("height"), F.col("width").alias("whole_width"))


@query("prj3_polygon_boxes", with_ll(""", n AS (SELECT doc_id, count(*) AS k FROM ll GROUP BY doc_id)
SELECT ll.doc_id, line_no, text, confidence, x1, y1, x2, y2 + 1 AS y2
FROM ll JOIN n USING (doc_id) WHERE line_no < k - k // 10"""))
def polygon_boxes(spark, sf):
    p = inputs.line_pages(spark, sf)
    corner = lambda x, y: F.array(x, y)
    polys = F.transform("lines", lambda l: F.array(
        corner(l["x1"], l["y1"]), corner(l["x2"], l["y1"]), corner(l["x2"], l["y2"] + 1), corner(l["x1"], l["y2"])))
    kept = F.size("lines") - F.floor(F.size("lines") / 10).cast("int")
    arrays = p.select("doc_id", polys.alias("polys"), F.transform("lines", lambda l: l["text"]).alias("texts"),
                      F.slice(F.transform("lines", lambda l: l["confidence"]), F.lit(1), kept).alias("scores"))
    return layout.polygon_boxes(arrays)


_SCALE_SQL = "(1.0::DOUBLE + (doc_id % 3) * 0.25::DOUBLE)"


@query("prj4_rescale", with_lr(f"""
SELECT doc_id, ord, x1 * {_SCALE_SQL} AS x1, y1 * {_SCALE_SQL} AS y1, x2 * {_SCALE_SQL} AS x2, y2 * {_SCALE_SQL} AS y2,
       doc_id % 3 <> 0 AS scaled
FROM lr"""))
def rescale(spark, sf):
    scale = F.lit(1.0) + (F.col("doc_id") % 3) * 0.25
    out = layout.rescale(inputs.lr(spark, sf), scale, scale, F.col("doc_id") % 3 != 0)
    return out.select("doc_id", "ord", "x1", "y1", "x2", "y2", F.col("scaling").isNotNull().alias("scaled"))


@query("prj5_zoom", with_lr("""
SELECT doc_id, ord, x1 * 1.5::DOUBLE AS zx, y1 * 1.5::DOUBLE AS zy, (x2 - x1) * 1.5::DOUBLE AS zw, (y2 - y1) * 1.5::DOUBLE AS zh FROM lr"""))
def zoom(spark, sf):
    return layout.zoomed(inputs.lr(spark, sf), 150.0).select("doc_id", "ord", "zx", "zy", "zw", "zh")


@query("prj6_relative_geometry", with_lr("""
SELECT doc_id, ord, round(x1 / 1240.0::DOUBLE, 6) AS x_ratio, round(y1 / 1754.0::DOUBLE, 6) AS y_ratio,
       round((x2 - x1) / 1240.0::DOUBLE, 6) AS width_ratio, round((y2 - y1) / 1754.0::DOUBLE, 6) AS height_ratio,
       (x2 - x1) * (y2 - y1) AS area FROM lr"""))
def relative_geometry(spark, sf):
    g = layout.relative_geometry(inputs.lr(spark, sf), F.lit(1240.0), F.lit(1754.0))
    return g.select("doc_id", "ord", *[F.round(c, 6).alias(c) for c in ("x_ratio", "y_ratio", "width_ratio", "height_ratio")], "area")


def _res_json(content):
    """The five shapes a ``res`` field takes, chosen by region position."""
    lines = F.split(content, "\n")
    return (F.when(F.col("ord") % 5 == 0, F.to_json(F.struct(content.alias("v"))))
            .when(F.col("ord") % 5 == 1, F.to_json(F.struct(F.transform(lines, lambda t: F.struct(t.alias("text"))).alias("v"))))
            .when(F.col("ord") % 5 == 2, F.to_json(F.struct(lines.alias("v"))))
            .when(F.col("ord") % 5 == 3, F.to_json(F.struct(F.struct(content.alias("text")).alias("v"))))
            .otherwise(F.to_json(F.struct(F.struct(F.concat(F.lit("<table><tr><td>"), content, F.lit("</td></tr></table>")).alias("html")).alias("v")))))


@query("prj7_flatten_res", with_lr(f"""
SELECT doc_id, ord,
  CASE WHEN ord % 5 IN (1, 2) THEN replace(content, chr(10), ' ') WHEN ord % 5 = 4 THEN regexp_replace(content, '<[^>]+>', '', 'g') ELSE content END AS export_text,
  CASE WHEN ord % 5 IN (1, 2) THEN replace(content, chr(10), ' ') WHEN ord % 5 = 4 THEN '[表格]' WHEN ord % 5 = 0 THEN {s_strip("content")} ELSE content END AS display_text,
  CASE WHEN ord % 5 = 1 THEN replace(content, chr(10), ' ') WHEN ord % 5 IN (2, 4) THEN '' WHEN ord % 5 = 0 THEN {s_strip("content")} ELSE content END AS route_text,
  CASE WHEN ord % 5 IN (1, 2) THEN replace(content, chr(10), ' ') WHEN ord % 5 = 4 THEN array_to_string({s_words("regexp_replace(content, '<[^>]+>', ' ', 'g')")}, ' ') ELSE content END AS retrieval_text
FROM lr"""))
def flatten_res(spark, sf):
    src = inputs.lr(spark, sf).withColumn("res", F.try_variant_get(F.try_parse_json(_res_json(F.col("content"))), "$.v", "variant"))
    return src.select("doc_id", "ord", *[
        layout.res_text(F.col("res"), m).alias(f"{m}_text") for m in ("export", "display", "route", "retrieval")])


_BLANKED = "CASE WHEN ord % 4 = 1 THEN '' ELSE content END"


@query("flt1_drop_empty", with_lr(f"""
SELECT doc_id, ord, type, length(c) AS n_chars FROM (SELECT *, {_BLANKED} AS c FROM lr) WHERE c <> '' OR type = 'table'"""))
def drop_empty(spark, sf):
    blanked = inputs.lr(spark, sf).withColumn("content", F.when(F.col("ord") % 4 == 1, "").otherwise(F.col("content")))
    return layout.drop_empty(blanked).select("doc_id", "ord", "type", F.length("content").alias("n_chars"))


_TAGGED = """CASE ord % 7 WHEN 4 THEN CASE WHEN doc_id % 3 = 0 THEN ' <TABLE border=1>' || content WHEN doc_id % 3 = 1 THEN '  ' ELSE content END
             WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'x <table>' || content ELSE content END ELSE content END"""


@query("flt2_retype", with_lr(f"""
SELECT doc_id, ord,
  CASE WHEN type = 'figure' AND {s_strip("c")} <> '' AND ish THEN 'table' WHEN type = 'figure' AND {s_strip("c")} <> '' THEN 'paragraph' ELSE {_RTYPE} END AS region_type,
  CASE WHEN type <> 'table' AND ish THEN 'table' ELSE type END AS item_type
FROM (SELECT *, starts_with(lc, '<html') OR starts_with(lc, '<table') OR contains(lc, '<table>') AS ish
      FROM (SELECT *, {s_strip("lower(c)")} AS lc FROM (SELECT *, {_TAGGED} AS c FROM lr)))"""))
def retype(spark, sf):
    c = F.col("content")
    tagged = (F.when(F.col("ord") % 7 == 4, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" <TABLE border=1>"), c))
                     .when(F.col("doc_id") % 3 == 1, F.lit("  ")).otherwise(c))
              .when((F.col("ord") % 7 == 1) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("x <table>"), c)).otherwise(c))
    src = inputs.lr(spark, sf).withColumn("content", tagged)
    return src.select("doc_id", "ord", layout.retyped_region(F.col("type"), F.col("content")).alias("region_type"),
                      layout.retyped_item(F.col("type"), F.col("content")).alias("item_type"))


@query("flt3_valid_confidence", with_lr("SELECT doc_id, ord, round(confidence, 6) AS confidence FROM lr WHERE confidence IS NOT NULL AND confidence > 0"))
def valid_confidence(spark, sf):
    return inputs.lr(spark, sf).where(layout.valid_confidence(F.col("confidence"))).select(
        "doc_id", "ord", F.round("confidence", 6).alias("confidence"))


@query("flt4_viewport", with_ll(""", n AS (SELECT doc_id, count(*) AS k FROM ll GROUP BY doc_id)
SELECT ll.doc_id, line_no FROM ll JOIN n USING (doc_id)
WHERE k <= 20 OR (x2 * 1.25 >= 0 - 50 AND x1 * 1.25 <= 800 + 50 AND y2 * 1.25 >= 300 - 50 AND y1 * 1.25 <= 900 + 50)"""))
def viewport(spark, sf):
    flat = unnest(inputs.line_pages(spark, sf), "lines", "doc_id", F.size("lines").alias("n_blocks"), guard="line_no")
    return layout.visible_blocks(flat, "n_blocks", (0, 300, 800, 900), zoom=125.0, overscan=50.0, threshold=20).select("doc_id", "line_no")


@query("flt5_table_like", with_ll(f"""
SELECT doc_id, line_no, len({s_words("text")}) AS n_cells FROM ll
WHERE (contains(text, chr(9)) OR contains(text, '|') OR (length(text) - length(replace(text, ' ', ''))) > length(text) * 0.3::DOUBLE)
  AND length({s_strip("text")}) > 10 AND len({s_words("text")}) >= 2"""))
def table_like(spark, sf):
    return inputs.ll(spark, sf).where(layout.table_like(F.col("text"))).select(
        "doc_id", "line_no", F.size(words("text")).alias("n_cells"))


@query("flt8_min_text", f"SELECT doc_id, length({s_strip('text')}) AS n FROM documents WHERE length({s_strip('text')}) >= 50")
def min_text(spark, sf):
    n = F.length(strip("text"))
    return inputs.table(spark, sf, "documents").where(n >= 50).select("doc_id", n.alias("n"))


@query("ord1_reading_order", with_lr("""
SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY floor(y1j / 50), trunc(x1)::BIGINT, ord) - 1 AS rank
FROM (SELECT *, y1 + (ord % 3) * 130 - 260 * (ord % 2) AS y1j FROM lr)"""))
def reading_order(spark, sf):
    jig = F.transform("regions", lambda r: r.withField("y1", r["y1"] + (r["ord"] % 3) * 130 - (r["ord"] % 2) * 260))
    p = inputs.pages(spark, sf).withColumn("regions", jig)
    return layout.ordered_regions(p, "reading").select("doc_id", "ord", "rank")


@query("ord2_y_order", with_lr("""
SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN ord % 9 = 8 THEN 0 ELSE y1 END, ord) - 1 AS rank FROM lr"""))
def y_order(spark, sf):
    gone = F.transform("regions", lambda r: r.withField("y1", F.when(r["ord"] % 9 != 8, r["y1"])))
    return layout.ordered_regions(inputs.pages(spark, sf).withColumn("regions", gone), "y").select("doc_id", "ord", "rank")


@query("ord3_yx_order", with_lr("""
SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY floor(y1 / 200) * 200, x1, ord) - 1 AS rank FROM lr"""))
def yx_order(spark, sf):
    snapped = F.transform("regions", lambda r: r.withField("y1", F.floor(r["y1"] / 200).cast("double") * 200))
    return layout.ordered_regions(inputs.pages(spark, sf).withColumn("regions", snapped), "yx").select("doc_id", "ord", "rank")
