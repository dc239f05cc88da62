"""Document confidence: scores, warnings and reports.

Inputs are flat regions. Every score is a partial aggregate on (document), so
only one small row per document and task is shuffled, however large the
document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.labels import confidence_band
from pagegrain.functions.text import strip
from pagegrain.operators.spatial import exact_mean

DOC = "doc_id"

# Thresholds under which a score earns a warning, and the wording.
WARN_BELOW = {"overall": 0.70, "text": 0.75, "layout": 0.65, "table": 0.70}
MIXED_ABOVE = 0.20
AREAS = {
    "overall": ["entire_document"],
    "text": ["text_content", "paragraphs", "headers"],
    "layout": ["document_structure", "headers", "sections"],
    "table": ["tables", "table_structure", "table_content"],
}
LOW_AREA = {"text": "text_recognition", "layout": "layout_detection", "table": "table_recognition"}
DESCRIPTIONS = {
    "excellent": "Excellent - Very high accuracy expected",
    "good": "Good - High accuracy with minimal errors",
    "fair": "Fair - Moderate accuracy, some review recommended",
    "poor": "Poor - Lower accuracy, careful review needed",
    "very_poor": "Very Poor - Low accuracy, significant review required",
}
ASSESSMENTS = [
    "Document processed successfully with high confidence. Results should be accurate.",
    "Document processed with significant confidence concerns. Careful review is strongly recommended.",
    "Document processed with multiple confidence concerns. Review is recommended for accuracy.",
    "Document processed with some confidence concerns. Review of specific areas is recommended.",
    "Document processed with minor confidence concerns. Overall results should be reliable.",
]


FLAGS = ["region_type", "has_text", "fair_size"]


def flagged(regions: DataFrame) -> DataFrame:
    """Adds what a document's confidence needs to know of a region's text and box: two flags instead of the text."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return regions.withColumns({"has_text": F.coalesce(F.length(strip("content")) > 3, F.lit(False)), "fair_size": (area > 50) & (area < 10000000)})


def document_confidence(regions: DataFrame) -> DataFrame:
    """Text, layout and overall confidence per document.

    Needs ``region_type``, ``content``, ``confidence`` and the box.
    """
    return confidence_of_flags(flagged(regions))


def confidence_of_flags(regions: DataFrame) -> DataFrame:
    """As ``document_confidence``, from ``flagged`` regions and their ``confidence``.

    The number of distinct types comes from a set of type names, which the type
    list bounds. Scores are summed exactly, so that no order of rows shows.
    """
    conf = F.col("confidence")
    scored = conf.isNotNull() & (conf > 0)
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    agg = regions.groupBy(DOC).agg(
        F.count(F.lit(1)).alias("region_count"),
        F.count_if(scored).alias("with_confidence"),
        F.coalesce(exact_mean(F.when(scored, conf)), F.lit(0.0)).alias("text_confidence"),
        F.size(F.collect_set("region_type")).alias("n_types"),
        share(F.col("has_text")).alias("content_factor"),
        share(F.col("fair_size")).alias("size_factor"))
    diversity = F.when(F.col("n_types") >= 3, 1.0).when(F.col("n_types") == 2, 0.9).otherwise(0.7)
    out = agg.withColumns({
        "without_confidence": F.col("region_count") - F.col("with_confidence"),
        "coverage": F.col("with_confidence") / F.col("region_count"),
        "layout_confidence": F.col("content_factor") * 0.5 + F.col("size_factor") * 0.3 + diversity * 0.2})
    penalty = F.when(F.col("coverage") < 0.5, F.least(F.lit(1.0), F.col("coverage") / 0.5)).otherwise(1.0)
    base = F.col("text_confidence") * 0.7 + F.col("layout_confidence") * 0.3
    return out.withColumn("overall", base * (F.lit(0.5) + penalty * 0.5))


def conversion_metrics(blocks: DataFrame, overall: DataFrame) -> DataFrame:
    """Metrics of a conversion: means over text regions and table blocks, with defaults."""
    c = F.col("confidence")
    per_doc = blocks.groupBy(DOC).agg(
        F.avg(F.when(F.col("region_type").isin("paragraph", "header"), c)).alias("text"),
        F.avg(F.when(F.col("region_type") == "table", c)).alias("table"))
    score = overall.select(DOC, F.col("overall"), F.col("overall").alias("layout"))
    return score.join(per_doc, DOC, "left").select(
        DOC, "overall", F.coalesce("text", F.lit(0.5)).alias("text"), "layout", F.coalesce("table", F.lit(0.6)).alias("table"))


def _warnings() -> Column:
    rows = []
    for m, limit in WARN_BELOW.items():
        level = confidence_band(F.col(m))
        severity = F.when(level == "very_poor", "high").when(level == "poor", "medium").otherwise("low") if m == "overall" else F.lit("medium")
        rows.append(F.when(F.col(m) < limit, F.struct(
            F.lit(f"low_{m}_confidence").alias("warning"), level.alias("level"), F.col(m).alias("score"),
            severity.alias("severity"), F.lit(", ".join(AREAS[m])).alias("areas"))))
    scores = [F.col(m) for m in WARN_BELOW]
    low = F.array_join(F.filter(F.array(*[F.when(F.col(m) < WARN_BELOW[m], name) for m, name in LOW_AREA.items()]),
                                lambda a: a.isNotNull()), ", ")
    rows.append(F.when(F.greatest(*scores) - F.least(*scores) > MIXED_ABOVE, F.struct(
        F.lit("mixed_confidence").alias("warning"), confidence_band(F.col("overall")).alias("level"),
        F.col("overall").alias("score"), F.lit("medium").alias("severity"), low.alias("areas"))))
    return F.filter(F.array(*rows), lambda w: w.isNotNull())


def confidence_warnings(metrics: DataFrame) -> DataFrame:
    """One row per metric under its threshold, plus one when the metrics spread too far."""
    rows = metrics.select(DOC, F.explode_outer(_warnings()).alias("w"))
    return rows.where(F.col("w").isNotNull()).select(DOC, "w.*")


def confidence_report(metrics: DataFrame) -> DataFrame:
    """Level and description per metric, number of warnings and an overall assessment."""
    described = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])
    m = metrics.withColumn("warnings", _warnings())
    sev = lambda s: F.size(F.filter("warnings", lambda w: w["severity"] == s))
    assessment = (F.when(F.size("warnings") == 0, ASSESSMENTS[0]).when(sev("high") > 0, ASSESSMENTS[1])
                  .when(sev("medium") > 2, ASSESSMENTS[2]).when(sev("medium") > 0, ASSESSMENTS[3]).otherwise(ASSESSMENTS[4]))
    levels = [confidence_band(F.col(c)).alias(f"{c}_level") for c in WARN_BELOW]
    return m.select(DOC, *levels, described[confidence_band(F.col("overall"))].alias("description"),
                    F.size("warnings").alias("warning_count"), assessment.alias("assessment"))


def assembled_regions(lines: DataFrame, group: Column) -> DataFrame:
    """Region text and score from its text lines: joined non-empty texts, mean of known scores.

    A region's lines arrive together on one record, so ``group`` is an array
    column of line structs on each row and nothing is gathered.
    """
    texts = F.filter(F.transform(group, lambda l: l["text"]), lambda t: t.isNotNull() & (t != ""))
    scores = F.filter(F.transform(F.filter(group, lambda l: l["text"] != ""), lambda l: l["confidence"]), lambda c: c.isNotNull())
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, c: a + c) / F.size(scores))
    return lines.withColumns({"content": F.array_join(texts, "\n"), "confidence": mean})


def table_scores(pages: DataFrame, regions: str = "regions", results: str = "table_scores") -> DataFrame:
    """Give the n-th table region the mean of the n-th list of recognition scores."""
    tables = F.filter(regions, lambda r: r["type"] == "table")
    rows = pages.select(DOC, F.col(results).alias("_res"), F.posexplode_outer(tables).alias("table_no", "r")).where(
        F.col("table_no").isNotNull())
    got = F.try_element_at("_res", F.col("table_no") + 1)
    mean = F.when(F.size(got) > 0, F.aggregate(got, F.lit(0.0), lambda a, c: a + c) / F.size(got))
    return rows.select(DOC, F.col("r.ord").alias("ord"), "table_no", mean.alias("confidence"))


def block_counts(blocks: DataFrame, kind: str = "type") -> DataFrame:
    """Blocks per type, and the total of the document as the type ``total``, in one pass."""
    counted = blocks.rollup(DOC, kind).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")).where(F.col("_g") < 3)
    return counted.select(DOC, F.when(F.col("_g") == 1, "total").otherwise(F.col(kind)).alias(kind), "n")
