"""Layout tables derived from the supplied tables.

The supplied tables hold no boxes, so lines and regions are laid out with plain
arithmetic on line numbers. ``pages`` is the canonical physical form: one row
per document holding its lines and regions as arrays, as a layout result file
does. Per-document order-dependent operators read the arrays in place, so they
need no shuffle and no group is ever assembled on one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.functions.arrays import unnest


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A supplied table.

    Large tables come in many row groups and are read in parallel as they are.
    Where one file holds a whole text table, ``pagegrain.input.partitions``
    spreads its rows over that many tasks; unset, nothing is shuffled.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    n = spark.conf.get("pagegrain.input.partitions", None)
    return df.repartition(int(n)) if n and name in ("documents", "pages", "conversations") else df


_LINES = r"""
transform(
  transform(filter(split(text, '\n'), t -> t <> ''),
            (t, i) -> named_struct('t', t, 'i', cast(i as bigint), 'h', (doc_id * 31 + i * 17) % 50)),
  s -> named_struct(
    'line_no', s.i,
    'text', s.t,
    'confidence', if(s.h < 2, null, 0.5D + s.h / 100D),
    'x1', cast(s.i % 3 * 10 as double),
    'y1', cast(s.i * 24 as double),
    'x2', cast(s.i % 3 * 10 + least(length(s.t), 120) * 7 as double),
    'y2', cast(s.i * 24 + 18 as double)))
"""

_REGIONS = r"""
transform(
  if(size(lines) = 0, cast(array() as array<int>), sequence(0, (size(lines) - 1) div 4)),
  g -> named_struct('ord', cast(g as bigint), 'ls', slice(lines, g * 4 + 1, 4)))
"""

_REGION = r"""
transform(grouped, g -> named_struct(
    'ord', g.ord,
    'type', element_at(array('title', 'text', 'text', 'table', 'figure', 'header', 'reference'), cast(g.ord % 7 + 1 as int)),
    'x1', array_min(transform(g.ls, l -> l.x1)),
    'y1', array_min(transform(g.ls, l -> l.y1)) - 2,
    'x2', array_max(transform(g.ls, l -> l.x2)),
    'y2', array_max(transform(g.ls, l -> l.y2)) + 2,
    'content', array_join(transform(g.ls, l -> l.text), '\n'),
    'n_lines', cast(size(g.ls) as bigint),
    'confidence', if(g.ord % 5 = 4, null, 0.6D + ((doc_id * 13 + g.ord * 7) % 40) / 100D)))
"""


def line_pages(spark: SparkSession, sf: str, blank: bool = True) -> DataFrame:
    """doc_id, lines array<struct<line_no, text, confidence, x1, y1, x2, y2>>; ``blank``: also of documents without any line."""
    d = table(spark, sf, "documents")
    d = d if blank else d.where(F.col("text").rlike(r"[^\n]"))
    return d.select("doc_id", F.expr(_LINES).alias("lines"))


def pages(spark: SparkSession, sf: str, blank: bool = True) -> DataFrame:
    """doc_id, lines, regions array<struct<ord, type, x1..y2, content, n_lines, confidence>>."""
    grouped = line_pages(spark, sf, blank).withColumn("grouped", F.expr(_REGIONS))
    return grouped.select("doc_id", "lines", F.expr(_REGION).alias("regions"))


def ll(spark: SparkSession, sf: str) -> DataFrame:
    """Flat text lines."""
    return unnest(line_pages(spark, sf), "lines", "doc_id", guard="line_no")


def lr(spark: SparkSession, sf: str) -> DataFrame:
    """Flat layout regions."""
    return unnest(pages(spark, sf), "regions", "doc_id", guard="ord")


_CELLS = r"""
CASE WHEN (c_custkey div 32) % 2 = 0 AND c_custkey % 32 = 0 THEN array('Key', 'Name', 'Balance', 'Segment')
     WHEN c_custkey % 13 IN (5, 9) THEN array('', '', '', '')
     WHEN c_custkey % 13 = 6 THEN array(cast(c_custkey as string), '', '', '')
     ELSE slice(transform(
        array(cast(c_custkey as string),
              if(c_custkey % 4 = 1, concat('  ', c_name, ' │'), c_name),
              concat('$', cast(c_acctbal as string)),
              c_mktsegment),
        (v, i) -> if((c_custkey * 7 + i * 3) % 11 = 0, '', v)), 1, if(c_custkey % 5 = 0, 3, 4)) END
"""


def grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    """table_no, r, cells: customers laid out as rows of 32-row tables."""
    c = table(spark, sf, "customer")
    return c.select(F.expr("c_custkey div 32").alias("table_no"), (F.col("c_custkey") % 32).alias("r"), F.expr(_CELLS).alias("cells"))


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """table_no, cells array<array<string>>: a table has 32 rows at most, by its key."""
    g = grid_rows(spark, sf).groupBy("table_no").agg(F.array_sort(F.collect_list(F.struct("r", "cells"))).alias("s"))
    return g.select("table_no", F.transform("s", lambda s: s["cells"]).alias("cells"))


def long_cells(spark: SparkSession, sf: str) -> DataFrame:
    """table_no (the customer's nation), r, c, text: tables that grow with the data."""
    rows = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("table_no"), F.col("c_custkey").alias("r"),
        F.posexplode(F.array(F.col("c_custkey").cast("string"), "c_name", F.concat(F.lit("$"), F.col("c_acctbal").cast("string")),
                             "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.lit("n/a")).otherwise("12%"))).alias("c", "v"))
    blank = (F.col("r") * 7 + F.col("c") * 3) % 11 == 0
    return rows.select("table_no", "r", "c", F.when(blank, "").otherwise(F.col("v")).alias("text"))


def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    """table_no, html: the 32-row tables as HTML with header cells, spans, nested tags and pipes."""
    cell = lambda c, k, tag: F.concat(F.lit(f"<{tag}"), k, F.lit(">"), c, F.lit(f"</{tag}>"))
    none = F.lit("")

    def row(r, i):
        head = (F.col("table_no") % 2 == 0) & (i == 0)
        span = F.when((i % 4 == 2) & (F.col("table_no") % 3 == 0), F.lit(' colspan="2"')).when(
            i % 5 == 3, F.lit(' colspan="1"')).otherwise(none)
        body = F.transform(r, lambda c, j: F.when(head, cell(c, none, "th")).when(
            j == 0, cell(F.concat(F.lit("<b>"), c, F.lit("</b>")), span, "td")).otherwise(cell(F.concat(F.lit(" a|"), c), none, "TD")))
        return F.concat(F.lit("<tr>"), F.array_join(body, ""), F.lit("</tr>"))

    html = F.concat(F.lit("<table>"), F.array_join(F.transform("cells", row), "\n"), F.lit("</table>"))
    return grids(spark, sf).select("table_no", html.alias("html"))


_AS_TABLE = r"concat('<table><tr><td>', replace(replace(r.content, '\n', '</td></tr><tr><td>'), ', ', '</td><td>'), '</td></tr></table>')"
_TYPED = rf"""
transform(regions, r -> named_struct(
  'ord', r.ord, 'type', r.type, 'x1', r.x1, 'y1', r.y1, 'x2', r.x2, 'y2', r.y2, 'confidence', r.confidence,
  'region_type', element_at(array('header', 'paragraph', 'paragraph', 'table', 'image', 'header', 'list'), cast(r.ord % 7 + 1 as int)),
  'content', if(r.ord % 7 = 3, {_AS_TABLE}, r.content)))
"""


def block_pages(spark: SparkSession, sf: str, blank: bool = True) -> DataFrame:
    """doc_id, regions with a region type; tables hold HTML of their lines, references are lists."""
    return pages(spark, sf, blank).select("doc_id", F.expr(_TYPED).alias("regions"))


def block_rows(spark: SparkSession, sf: str) -> DataFrame:
    return unnest(block_pages(spark, sf), "regions", "doc_id", guard="ord")


_ITEMS = rf"""
transform(regions, r -> named_struct(
  'ord', r.ord, 'x1', r.x1, 'y1', r.y1, 'x2', r.x2, 'y2', r.y2, 'confidence', r.confidence,
  'type', CASE r.ord % 11 WHEN 10 THEN 'list' WHEN 9 THEN 'equation' WHEN 8 THEN 'figure_caption' ELSE r.type END,
  'text', if(r.ord % 11 < 8 AND r.ord % 7 = 3, '', r.content),
  'html', if(r.ord % 11 < 8 AND r.ord % 7 = 3,
             if(doc_id % 2 = 0, {_AS_TABLE}, concat('<table><tr><td colspan="2">', r.content, '</td></tr></table>')), null)))
"""


def item_pages(spark: SparkSession, sf: str, blank: bool = True) -> DataFrame:
    """doc_id, items: layout items with text or table HTML, in y order."""
    return pages(spark, sf, blank).select("doc_id", F.expr(_ITEMS).alias("items"))
