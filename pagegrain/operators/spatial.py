"""Joins by position on the page.

Boxes are spread over grid tiles and joined on (document, tile), so a document
with very many boxes is split over many tasks. A pair that shares several tiles
is kept only in the tile that owns the upper-left corner of the overlap, which
makes a later distinct unnecessary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrain.session import written

DOC = "doc_id"
TILE = (1024.0, 256.0)


def tiled(df: DataFrame, box: tuple[str, str, str, str], tile: tuple[float, float] = TILE) -> DataFrame:
    """One row per tile a box touches, in columns ``tx`` and ``ty``."""
    x1, y1, x2, y2 = box
    w, h = tile

    def span(lo: str, hi: str, step: float) -> Column:
        return F.sequence(F.floor(F.col(lo) / step), F.floor(F.greatest(F.col(lo), F.col(hi)) / step))

    return df.withColumn("tx", F.explode_outer(span(x1, x2, w))).withColumn("ty", F.explode_outer(span(y1, y2, h)))


def _overlap(a: str, b: str) -> tuple[Column, Column, Column, Column]:
    lo, hi = F.greatest, F.least
    return (lo(F.col(f"{a}x1"), F.col(f"{b}x1")), lo(F.col(f"{a}y1"), F.col(f"{b}y1")),
            hi(F.col(f"{a}x2"), F.col(f"{b}x2")), hi(F.col(f"{a}y2"), F.col(f"{b}y2")))


def _area(p: str) -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def iou_or_centre(a: str, b: str, limit: float = 0.3) -> Column:
    """IoU above ``limit``, or the centre of ``b`` inside ``a`` (closed); an empty ``a`` never matches."""
    ox1, oy1, ox2, oy2 = _overlap(a, b)
    inter = F.when((ox2 > ox1) & (oy2 > oy1), (ox2 - ox1) * (oy2 - oy1)).otherwise(0.0)
    union = _area(a) + _area(b) - inter
    cx = (F.col(f"{b}x1") + F.col(f"{b}x2")) / 2
    cy = (F.col(f"{b}y1") + F.col(f"{b}y2")) / 2
    inside = cx.between(F.col(f"{a}x1"), F.col(f"{a}x2")) & cy.between(F.col(f"{a}y1"), F.col(f"{a}y2"))
    return (_area(a) > 0) & (inside | ((union > 0) & (inter > union * limit)))


def covers_line(a: str, b: str, limit: float = 0.5) -> Column:
    """Overlap above ``limit`` of the area of ``b``, that area being at least 1."""
    ox1, oy1, ox2, oy2 = _overlap(a, b)
    return (ox2 > ox1) & (oy2 > oy1) & ((ox2 - ox1) * (oy2 - oy1) > F.greatest(_area(b), F.lit(1.0)) * limit)


def exact_mean(c: Column | str) -> Column:
    """Mean by way of an exact decimal sum, the same for every order of rows; null where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(20,9)")).cast("double") / F.nullif(F.count(c), F.lit(0))


def region_confidence(regions: DataFrame, lines: DataFrame, rule: str = "iou_or_centre",
                      tile: tuple[float, float] = TILE, carry: list[str] | None = None) -> DataFrame:
    """Mean confidence of the lines matching each region, null when none does.

    Both sides are cut to keys, box and score before they move. The join is
    inner, so a skewed tile can be split on either side; regions come back
    through a union into the same aggregate, which needs no second join and
    combines before its shuffle. ``carry`` names small columns of a region that
    its row keeps, so that none has to be joined again.
    """
    box = lambda p: [F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")]
    r = tiled(regions.select(DOC, "ord", *box("r_")), ("r_x1", "r_y1", "r_x2", "r_y2"), tile)
    kept = lines.where(F.col("confidence").isNotNull()) if rule == "iou_or_centre" else lines.where(F.col("confidence") > 0)
    l = tiled(kept.select(DOC, F.col("confidence").alias("score"), *box("l_")), ("l_x1", "l_y1", "l_x2", "l_y2"), tile)
    match = (iou_or_centre if rule == "iou_or_centre" else covers_line)("r_", "l_")
    ox1, oy1, _, _ = _overlap("r_", "l_")
    owner = (F.floor(ox1 / tile[0]) == F.col("tx")) & (F.floor(oy1 / tile[1]) == F.col("ty"))
    pairs = r.join(l, [DOC, "tx", "ty"]).where(owner & match).select(DOC, "ord", "score")
    every = regions.select(DOC, "ord", F.lit(None).cast("double").alias("score"), *(carry or []))
    return pairs.unionByName(every, allowMissingColumns=True).groupBy(DOC, "ord").agg(
        exact_mean("score").alias("confidence"), F.count("score").alias("n_matched"), *(F.max(c).alias(c) for c in carry or []))


def outside_regions(lines: DataFrame, regions: DataFrame, tile: tuple[float, float] = TILE) -> DataFrame:
    """Lines whose centre lies in no region: a point needs one tile, so an anti join suffices."""
    pts = lines.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    pts = pts.withColumns({"tx": F.floor(F.col("cx") / tile[0]), "ty": F.floor(F.col("cy") / tile[1])}).alias("l")
    r = tiled(regions.select(DOC, "x1", "y1", "x2", "y2"), ("x1", "y1", "x2", "y2"), tile).alias("r")
    on = ((F.col(f"l.{DOC}") == F.col(f"r.{DOC}")) & (F.col("l.tx") == F.col("r.tx")) & (F.col("l.ty") == F.col("r.ty"))
          & F.col("l.cx").between(F.col("r.x1"), F.col("r.x2")) & F.col("l.cy").between(F.col("r.y1"), F.col("r.y2")))
    return pts.join(r, on, "left_anti").drop("cx", "cy", "tx", "ty")


def merged_by_y(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Regions and standalone lines as one list: ``at`` counts by y from 0; at one height regions come first, then the earlier position.

    Both sides give DOC, pos, y and any further columns of equal names.
    """
    both = regions.withColumn("kind", F.lit("region")).unionByName(lines.withColumn("kind", F.lit("line")))
    order = Window.partitionBy(DOC).orderBy(F.coalesce("y", F.lit(0.0)), F.desc("kind"), "pos")
    return both.withColumn("at", F.row_number().over(order) - 1)


def kept_regions(pages: DataFrame, limit: float = 0.7, array: str = "regions") -> DataFrame:
    """Greedy removal of overlapping repeats, in the given array order.

    A region goes when it overlaps an already kept one by more than ``limit`` of
    the smaller area and has the same text or none. The kept set matters, so
    this is a fold over the document's own array; the accumulator holds array
    positions only.
    """
    fold = F.expr(f"""
      aggregate(if(size({array}) > 0, sequence(1, size({array})), cast(array() as array<int>)), cast(array() as array<int>), (kept, i) ->
        if(exists(kept, k -> {_repeat(f'element_at({array}, k)', f'element_at({array}, i)', limit)}), kept, array_append(kept, i)))
    """)
    return pages.withColumn(array, F.transform(fold, lambda k: F.element_at(F.col(array), k)))


def overlap_conflicts(regions: DataFrame, limit: float = 0.7, tile: tuple[float, float] = TILE) -> DataFrame:
    """Pairs (doc_id, a, b) of region numbers where ``b``, later by y and number, repeats ``a``; from the tiled join.

    Of regions with one box and one text the first alone takes part: the others go
    whatever happens to it.
    """
    box, order = ["x1", "y1", "x2", "y2"], F.struct("y1", "ord")
    first = regions.groupBy(DOC, *box, F.md5(F.col("content").cast("binary")).alias("tag")).agg(F.min("ord").alias("ord"), F.first(F.col("content") == "").alias("bare"))
    boxes = first.where("x2 > x1 AND y2 > y1").withColumn("at", order)
    side = lambda p: tiled(boxes.select(DOC, *[F.col(c).alias(f"{p}{c}") for c in (*box, "tag", "ord", "bare", "at")]), (f"{p}x1", f"{p}y1", f"{p}x2", f"{p}y2"), tile)
    pairs = side("a_").join(side("b_"), [DOC, "tx", "ty"])
    ox1, oy1, ox2, oy2 = _overlap("a_", "b_")
    owner = (F.floor(ox1 / tile[0]) == F.col("tx")) & (F.floor(oy1 / tile[1]) == F.col("ty"))
    shared = (ox2 - ox1) * (oy2 - oy1) / F.least(_area("a_"), _area("b_"))
    same = (F.col("b_tag") == F.col("a_tag")) | F.col("b_bare")
    return pairs.where((F.col("a_at") < F.col("b_at")) & owner & (ox2 > ox1) & (oy2 > oy1) & (shared > limit) & same).select(DOC, F.col("a_ord").alias("a"), F.col("b_ord").alias("b"))


def kept_region_rows(regions: DataFrame, limit: float = 0.7, tile: tuple[float, float] = TILE) -> DataFrame:
    """The greedy removal of ``kept_regions`` for regions as rows, in (y1, ord) order: one document may lie in many tasks.

    The kept set is the first independent set of the conflict graph in that order. In
    every round the regions that no open conflict points at are kept and what they point
    at goes; conflicts of decided regions are dropped. There are as many rounds as the
    longest chain of regions that decide each other, in which every second one stays.
    Needs doc_id, ord (unique in a document), a box and content; a null content
    repeats nothing. Null boxes and empty ones stay.
    """
    node = [DOC, "ord"]
    box = ["x1", "y1", "x2", "y2"]
    whole = regions.where("x2 > x1 AND y2 > y1")
    copies = whole.groupBy(DOC, *box, F.md5(F.col("content").cast("binary")).alias("tag")).agg(F.min("ord").alias("first"))
    repeated = (whole.withColumn("tag", F.md5(F.col("content").cast("binary"))).join(copies, [DOC, *box, "tag"]).where("ord > first").select(*node))
    gone = [repeated]
    edges, n = written(overlap_conflicts(regions, limit, tile), "conflicts", F.count(F.lit(1)))
    while n:
        to = edges.select(DOC, F.col("b").alias("ord")).distinct()
        free = edges.select(DOC, F.col("a").alias("ord")).distinct().join(to, node, "left_anti").withColumnRenamed("ord", "a")
        hit, _ = written(edges.join(free, [DOC, "a"], "left_semi").select(DOC, F.col("b").alias("ord")).distinct(), "removed")
        gone.append(hit)
        rest = edges.join(hit.withColumnRenamed("ord", "b"), [DOC, "b"], "left_anti").join(hit.withColumnRenamed("ord", "a"), [DOC, "a"], "left_anti").select(DOC, "a", "b")
        edges, n = written(rest, "conflicts", F.count(F.lit(1)))
    return regions.join(reduce(DataFrame.unionByName, gone), node, "left_anti")


def _repeat(a: str, b: str, limit: float) -> str:
    """``b`` repeats ``a``: enough overlap, and equal or missing text."""
    w = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda r: f"(({r}.x2 - {r}.x1) * ({r}.y2 - {r}.y1))"
    small = f"least({area(a)}, {area(b)})"
    return (f"({w} > 0 AND {h} > 0 AND {small} > 0 AND {w} * {h} / {small} > {limit}D "
            f"AND ({b}.content = {a}.content OR {b}.content = ''))")
