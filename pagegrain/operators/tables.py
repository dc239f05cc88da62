"""Table operators: cell statistics in long form, cell clustering and table blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import grids
from pagegrain.functions.arrays import scan, unnest_at
from pagegrain.functions.clean import let
from pagegrain.functions.text import strip


def cell_metadata(cells: DataFrame, key: str = "table_no") -> DataFrame:
    """Counts, mean length and content flags per table, from long cells.

    Long form keeps tables of any size distributed: each task reduces its cells
    to one row per table before the shuffle.
    """
    full = grids.filled(F.col("text"))
    return cells.groupBy(key).agg(
        F.count(F.lit(1)).alias("cell_count"), F.count_if(full).alias("non_empty"),
        F.coalesce(F.avg(F.when(full, F.length("text"))), F.lit(0.0)).alias("mean_length"),
        F.bool_or(full & F.col("text").rlike(r"\p{Nd}")).alias("has_digit"),
        F.bool_or(full & F.col("text").rlike(r"\p{L}")).alias("has_letter"))


def column_types(cells: DataFrame, key: str = "table_no", column: str = "c") -> DataFrame:
    full = grids.filled(F.col("text"))
    agg = cells.groupBy(key, column).agg(
        F.count_if(full).alias("n"), F.count_if(full & grids.is_numeric(F.col("text"))).alias("numeric"))
    text = F.col("n") - F.col("numeric")
    kind = F.when(F.col("n") == 0, "empty").when(F.col("numeric") > text, "numeric").when(text > 0, "text").otherwise("mixed")
    return agg.select(key, column, "n", "numeric", kind.alias("column_type"))


def confidence_from_cells(cells: DataFrame, key: str = "table_no", row: str = "r", base: float = 0.7) -> DataFrame:
    """Table confidence from long cells: rows first, then a row per table and width, then one per table.

    The width that holds the first row is the expected one, so nothing is joined
    and a hot table sends one row per width and task.
    """
    full = grids.filled(F.col("text"))
    rows = cells.groupBy(key, row).agg(
        F.count(F.lit(1)).alias("w"), F.count_if(full).alias("full"),
        F.count_if(full & (F.length(strip("text")) <= 100)).alias("sane"))
    widths = rows.groupBy(key, "w").agg(F.count(F.lit(1)).alias("rows"), F.sum("full").alias("full"), F.sum("sane").alias("sane"), F.min(row).alias("at"))
    t = widths.groupBy(key).agg(F.sum("rows").alias("n"), F.sum("full").alias("full"), F.sum("sane").alias("sane"), F.min_by(F.struct("w", "rows"), "at").alias("first"))
    t = t.withColumns({"first_w": F.col("first.w"), "even": F.col("first.rows")})
    total = F.col("n") * F.col("first_w")
    parts = F.array(F.when(total > 0, F.col("full") / total), F.col("even") / F.col("n"),
                    F.when(F.col("full") > 0, F.col("sane") / F.col("full")), F.lit(base))
    known = F.filter(parts, lambda p: p.isNotNull())
    return t.select(key, (F.aggregate(known, F.lit(0.0), lambda a, p: a + p) / F.size(known)).alias("confidence"))


def anchored_rows(centres: Column, tolerance: float) -> Column:
    """Row number of every value of an ascending array.

    A new row starts when a value is further than ``tolerance`` from the first
    value of the current row, so this is a fold and not a gap test.
    """
    def step(s: Column, y: Column) -> dict[str, Column]:
        new = F.abs(y - s["first"]) > tolerance
        row = F.when(new, s["row"] + 1).otherwise(s["row"])
        return {"first": F.when(new, y).otherwise(s["first"]), "row": row, "emit": row}

    return let(centres, lambda ys: scan(ys, {"first": F.coalesce(F.try_element_at(ys, F.lit(1)), F.lit(0.0)), "row": F.lit(0)}, step, "int"))


def clustered_cells(pages: DataFrame, array: str, y: str, x: str, tolerance: float, *keep: str) -> DataFrame:
    """Arrange boxes into rows and columns by anchored clustering on ``y`` then order on ``x``.

    Emits every element with its 0-based row and column.
    """
    by_y = F.array_sort(F.transform(array, lambda e, i: F.struct(
        e[y].cast("double").alias("cy"), e[x].cast("double").alias("cx"), i.alias("i"), e.alias("e"))))
    placed = pages.select(*keep, by_y.alias("_s"))
    rows = anchored_rows(F.transform("_s", lambda s: s["cy"]), tolerance)
    tagged = placed.select(*keep, F.array_sort(F.zip_with("_s", rows, lambda s, r: F.struct(
        r.alias("row"), s["cx"].alias("cx"), s["cy"].alias("cy"), s["i"].alias("i"), s["e"].alias("e")))).alias("_t"))
    # Column = position minus the position where the row starts.
    starts = F.transform(F.filter(F.transform("_t", lambda t, i: F.struct(t["row"].alias("row"), i.alias("i"))),
                                  lambda s: (s["i"] == 0) | (F.try_element_at(F.col("_t"), s["i"])["row"] != s["row"])), lambda s: s["i"])
    based = tagged.select(*keep, "_t", starts.alias("_b"))
    out = unnest_at(based, "_t", *keep, "_b", pos="_p", item="_t")
    return out.select(*keep, F.col("_t.row").alias("row"),
                      (F.col("_p") - F.element_at("_b", F.col("_t.row") + 1)).alias("col"), F.col("_t.e").alias("cell"))


def tolerant_order(pages: DataFrame, array: str, y: str, x: str, tolerance: float, *keep: str) -> DataFrame:
    """Blocks on the same line (within ``tolerance`` of its first block) go left to right, lines go down."""
    by_y = F.array_sort(F.transform(array, lambda e, i: F.struct(
        e[y].cast("double").alias("cy"), e[x].cast("double").alias("cx"), i.alias("i"), e.alias("e"))))
    placed = pages.select(*keep, by_y.alias("_s"))
    rows = anchored_rows(F.transform("_s", lambda s: s["cy"]), tolerance)
    final = F.array_sort(F.zip_with("_s", rows, lambda s, r: F.struct(
        r.alias("row"), s["cx"].alias("cx"), s["cy"].alias("cy"), s["i"].alias("i"), s["e"].alias("e"))))
    out = unnest_at(placed, final, *keep, pos="rank", item="_t")
    return out.select(*keep, "rank", F.col("_t.e").alias("block"))


def bucketed_cells(pages: DataFrame, array: str, y: str, x: str, height: float, *keep: str) -> DataFrame:
    """Arrange boxes by fixed row buckets of ``height``, ordered by ``x`` inside a bucket."""
    tagged = F.array_sort(F.transform(array, lambda e, i: F.struct(
        (e[y] / height).cast("int").alias("row"), e[x].cast("double").alias("x"), i.alias("i"), e.alias("e"))))
    rows = F.array_sort(F.array_distinct(F.transform("_t", lambda t: t["row"])))
    out = pages.select(*keep, tagged.alias("_t")).select(*keep, "_t", rows.alias("_r"))
    flat = unnest_at(out, "_t", *keep, "_r", pos="_p", item="_t")
    return flat.select(*keep, (F.array_position("_r", F.col("_t.row")) - 1).alias("row"), F.col("_p").alias("pos"), F.col("_t.e").alias("cell"))


def table_result(res: Column) -> Column:
    """Grid of a polymorphic table result: HTML, cell boxes, list rows or a string.

    ``res`` is a variant. Cell boxes are ``[x1, y1, x2, y2, text]`` rows.
    """
    shape = F.schema_of_variant(res)
    is_obj, is_list = F.startswith(shape, F.lit("OBJECT")), F.startswith(shape, F.lit("ARRAY"))
    html = F.when(is_obj, F.try_variant_get(res, "$.html", "string")).when(shape == "STRING", F.try_variant_get(res, "$", "string"))
    boxes = F.try_variant_get(res, "$.cell_bbox", "array<array<string>>")
    ok = F.filter(boxes, lambda b: F.size(b) >= 5)
    keyed = F.array_sort(F.transform(ok, lambda b, i: F.struct(
        ((b[1].cast("double") + b[3].cast("double")) / 2 / 20).cast("int").alias("k"), b[0].cast("double").alias("x"), i.alias("i"), b[4].alias("t"))))
    box_grid = let(keyed, lambda s: F.when(F.size(s) > 0, grids.padded(F.transform(
        F.array_distinct(F.transform(s, lambda c: c["k"])),
        lambda k: F.transform(F.filter(s, lambda c: c["k"] == k), lambda c: c["t"])))))
    listed = F.try_variant_get(res, "$", "array<variant>")
    row = lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")),
                           F.try_variant_get(v, "$", "array<string>")).otherwise(grids.text_cells(F.try_variant_get(v, "$", "string")))
    list_grid = F.when(F.size(listed) > 0, grids.padded(F.transform(listed, row)))
    return (F.when(html.isNotNull(), grids.from_html_in_order(html)).when(is_obj & boxes.isNotNull(), box_grid).when(is_list, list_grid))


def table_blocks(tables: DataFrame, grid: str = "cells", header: str = "has_headers") -> DataFrame:
    """Cleaned and normalised grid, its HTML, metadata and confidence; empty tables give no block."""
    some = tables.where(F.size(F.try_element_at(F.col(grid), F.lit(1))) > 0)
    live = some.withColumn("_g", grids.normalised(grids.cleaned(F.col(grid))))
    return live.withColumns({
        "content": F.col("_g"), "html": grids.to_html(F.col("_g"), F.col(header)), "stats": grids.statistics(F.col("_g")),
        "confidence": grids.table_confidence(F.col("_g"))}).drop("_g")
