"""Layout items and regions: reshaping, retyping, scaling and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import labels
from pagegrain.functions.arrays import unnest_at
from pagegrain.functions.text import strip, words

DOC = "doc_id"


def box_to_xywh(items: DataFrame, bbox: str = "bbox", whole: bool = False) -> DataFrame:
    """Corner box array to x, y, width, height; rows whose box is not length 4 are dropped.

    ``whole`` truncates each coordinate before subtracting, as display does.
    """
    kept = items.where(F.size(bbox) == 4)
    kind = "int" if whole else "double"
    p = [F.col(bbox)[i].cast(kind) for i in range(4)]
    return kept.withColumns({"x": p[0], "y": p[1], "width": p[2] - p[0], "height": p[3] - p[1]})


def polygon_boxes(pages: DataFrame, polys: str = "polys", texts: str = "texts", scores: str = "scores") -> DataFrame:
    """Per-document polygon, text and score arrays to line rows with a bounding box.

    Lines beyond the shorter of the arrays are dropped.
    """
    n = F.least(F.size(polys), F.size(texts), F.size(scores))
    zipped = F.slice(F.arrays_zip(F.col(polys).alias("poly"), F.col(texts).alias("text"), F.col(scores).alias("confidence")), F.lit(1), n)
    rows = unnest_at(pages, zipped, DOC, pos="line_no", item="l")
    xs = F.transform("l.poly", lambda p: p[0])
    ys = F.transform("l.poly", lambda p: p[1])
    return rows.select(
        DOC, "line_no", F.col("l.text").alias("text"), F.col("l.confidence").alias("confidence"),
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"),
        F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def rescale(regions: DataFrame, scale_x: Column, scale_y: Column, resized: Column) -> DataFrame:
    """Multiply boxes by the factors of their document; a no-op where it was not resized.

    The factors live on the layout record of the document, so no join is needed.
    """
    fx = F.when(resized, scale_x).otherwise(F.lit(1.0))
    fy = F.when(resized, scale_y).otherwise(F.lit(1.0))
    return regions.withColumns({
        "x1": F.col("x1") * fx, "x2": F.col("x2") * fx, "y1": F.col("y1") * fy, "y2": F.col("y2") * fy,
        "scaling": F.when(resized, F.to_json(F.struct(scale_x.alias("scale_x"), scale_y.alias("scale_y")))),
    })


def zoomed(regions: DataFrame, zoom: float) -> DataFrame:
    """Boxes projected to the screen at a zoom level in percent."""
    s = zoom / 100.0
    return regions.withColumns({
        "zx": F.col("x1") * s, "zy": F.col("y1") * s,
        "zw": (F.col("x2") - F.col("x1")) * s, "zh": (F.col("y2") - F.col("y1")) * s})


def relative_geometry(regions: DataFrame, page_width: Column, page_height: Column) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return regions.withColumns({
        "x_ratio": F.col("x1") / page_width, "y_ratio": F.col("y1") / page_height,
        "width_ratio": w / page_width, "height_ratio": h / page_height, "area": w * h})


def res_text(res: Column, mode: str = "export") -> Column:
    """Flatten a polymorphic ``res`` variant to text.

    Modes differ only in detail: ``export`` strips tags of a table, ``display``
    shows a table marker and trims plain strings, ``route`` and ``cache`` read
    text objects only, ``retrieval`` turns a table's tags into spaces.
    """
    shape = F.schema_of_variant(res)
    as_list = F.try_variant_get(res, "$", "array<variant>")

    def piece(v: Column) -> Column:
        s = F.schema_of_variant(v)
        out = F.when(F.startswith(s, F.lit("OBJECT")), F.try_variant_get(v, "$.text", "string"))
        if mode not in ("route", "cache"):
            out = out.when(s == "STRING", F.try_variant_get(v, "$", "string"))
        return out

    joined = F.array_join(F.filter(F.transform(as_list, piece), lambda t: t.isNotNull()), " ")
    plain = F.try_variant_get(res, "$", "string")
    html = F.try_variant_get(res, "$.html", "string")
    table = {
        "export": F.regexp_replace(html, "<[^>]+>", ""),
        "display": F.when(html.isNotNull(), F.lit("[表格]")),
        "route": F.lit(None).cast("string"),
        "cache": F.lit(None).cast("string"),
        "retrieval": F.array_join(words(F.regexp_replace(html, "<[^>]+>", " ")), " "),
    }[mode]
    return F.coalesce(
        F.when(shape == "STRING", strip(plain) if mode in ("display", "route") else plain)
        .when(F.startswith(shape, F.lit("ARRAY")), joined)
        .when(F.startswith(shape, F.lit("OBJECT")), F.coalesce(F.try_variant_get(res, "$.text", "string"), table)),
        F.lit(""))


def is_html_table(text: Column) -> Column:
    low = strip(F.lower(text))
    return F.startswith(low, F.lit("<html")) | F.startswith(low, F.lit("<table")) | F.contains(low, F.lit("<table>"))


def retyped_region(item: Column, text: Column) -> Column:
    """Region type after looking at content: a figure holding a table or text is not an image."""
    has_text = F.coalesce(F.length(strip(text)) > 0, F.lit(False))
    return (F.when((item == "figure") & has_text & is_html_table(text), "table")
            .when((item == "figure") & has_text, "paragraph")
            .otherwise(labels.region_type(item)))


def retyped_item(item: Column, text: Column) -> Column:
    """Item type after looking at content: any item holding an HTML table is a table."""
    return F.when((item != "table") & F.coalesce(is_html_table(text), F.lit(False)), "table").otherwise(item)


def drop_empty(regions: DataFrame, item: str = "type", content: str = "content") -> DataFrame:
    """Keep regions with content; tables stay even when empty."""
    return regions.where((F.coalesce(F.col(content), F.lit("")) != "") | (F.col(item) == "table"))


def valid_confidence(c: Column) -> Column:
    return c.isNotNull() & (c > 0)


def table_like(text: Column) -> Column:
    """A line that looks like a table row: separators or many spaces, long enough, two cells."""
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    marked = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("|")) | (spaces > F.length(text) * 0.3)
    return marked & (F.length(strip(text)) > 10) & (F.size(words(text)) >= 2)


def visible_blocks(blocks: DataFrame, n_blocks: str, viewport: tuple[float, float, float, float] | None,
                   zoom: float = 100.0, overscan: float = 200.0, threshold: int = 0) -> DataFrame:
    """Blocks meeting the widened viewport; documents of at most ``threshold`` blocks and a missing viewport keep all.

    ``viewport`` is (left, top, right, bottom) on screen; ``n_blocks`` names the
    block count carried by each row.
    """
    if viewport is None:
        return blocks
    left, top, right, bottom = viewport
    s = zoom / 100.0
    hit = ((F.col("x2") * s >= left - overscan) & (F.col("x1") * s <= right + overscan)
           & (F.col("y2") * s >= top - overscan) & (F.col("y1") * s <= bottom + overscan))
    return blocks.where((F.col(n_blocks) <= threshold) | hit)


def ordered_regions(pages: DataFrame, rule: str = "y", array: str = "regions") -> DataFrame:
    """Sort the region array of each document and explode it with its 0-based rank.

    Rules: ``reading`` groups rows of 50 px then x; ``y`` is y alone; ``yx`` is y
    then x. Input position breaks ties, so the sort is stable.
    """
    return unnest_at(sort_regions(pages, rule, array), array, DOC, pos="rank", item="r").select(DOC, "rank", "r.*")


def sort_regions(pages: DataFrame, rule: str = "y", array: str = "regions") -> DataFrame:
    """The same sort kept in array form, for operators that read the order in place."""
    def key(r: Column) -> list[Column]:
        zero = F.lit(0.0)
        x, y = F.coalesce(r["x1"], zero), F.coalesce(r["y1"], zero)
        if rule == "reading":
            return [F.floor(y / 50), x.cast("int")]
        return [y, x] if rule == "yx" else [y]

    keyed = F.array_sort(F.transform(array, lambda r: F.struct(
        *[k.alias(f"k{i}") for i, k in enumerate(key(r))], r["ord"].alias("ord"), r.alias("r"))))
    return pages.withColumn(array, F.transform(keyed, lambda s: s["r"]))
