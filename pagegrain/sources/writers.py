"""Writing results, texts, indexes and logs.

Results, texts and indexes are keyed tables (``keyed``): saving some documents
leaves all others as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.functions.text import strip
from pagegrain.sources import keyed

_KEEP = {"ignoreNullFields": "false"}


def layout_results(pages: DataFrame, key: str = "doc_id", items: str = "items") -> DataFrame:
    """One JSON text per document: item number, type, box and reduced content; null items give nothing, a null type stays null."""
    def one(i: Column, n: Column) -> Column:
        cell = F.struct(F.coalesce(i["html"], F.lit("")).alias("html"), F.array().cast("array<double>").alias("cell_bbox"), i["confidence"].alias("confidence"))
        line = F.array(F.struct(i["text"].alias("text"), i["confidence"].alias("confidence")))
        res = F.when(i["html"].isNotNull(), F.parse_json(F.to_json(F.struct(cell.alias("r")), _KEEP))).otherwise(F.parse_json(F.to_json(F.struct(line.alias("r")), _KEEP)))
        return F.struct(n.alias("index"), i["type"].alias("type"), F.array(i["x1"], i["y1"], i["x2"], i["y2"]).alias("bbox"), F.variant_get(res, "$.r", "variant").alias("res"))

    record = F.struct(F.col(key).cast("string").alias("job_id"), F.size(items).alias("total_items"), F.transform(items, one).alias("items"))
    return pages.select(key, F.to_json(record, _KEEP).alias("value"))


def write_json_lines(results: DataFrame, path: str) -> None:
    """JSON texts, one per line; many documents share a file."""
    results.select("value").write.mode("overwrite").text(path)


def write_files(rows: DataFrame, path: str, key: str, text: str) -> None:
    """One text file a row in a folder ``key=value``, as tools outside Spark leave and expect them."""
    rows.select(key, F.col(text).alias("value")).write.partitionBy(key).text(path)


def write_results(df: DataFrame, path: str, key: str) -> None:
    """Final results as JSON in place of the earlier results of the same documents."""
    keyed.save(df, path, key, fmt="json")


def write_markdown(df: DataFrame, path: str, key: str = "doc_id", text: str = "markdown",
                   reindex: Callable[[DataFrame], DataFrame] | None = None, index: str | None = None) -> None:
    """Corrected Markdown; empty texts and white space alone are refused, one JSON row per document keeps line breaks.

    ``reindex``, a function from the saved rows to index rows, and ``index`` name
    the index to refresh for the documents saved.
    """
    good = df.where(strip(text) != "").select(key, F.col(text).alias("markdown"))
    write_results(good, path, key)
    if reindex is not None:
        write_index(reindex(good), index, key)


def checked_vectors(df: DataFrame, texts: str, vectors: str, metadata: str | None = None) -> DataFrame:
    """Rows of parallel arrays to vector rows; arrays of different length are an error.

    Missing ids and metadata get defaults.
    """
    same = F.size(texts) == F.size(vectors)
    if metadata:
        same = same & (F.col(metadata).isNull() | (F.size(metadata) == F.size(texts)))
    guard = F.when(same, F.col(texts)).otherwise(F.raise_error(F.lit("texts, vectors and metadata differ in number")).cast("array<string>"))
    rows = df.withColumn("_t", guard).select("doc_id", F.posexplode_outer(F.arrays_zip(F.col("_t").alias("text"), F.col(vectors).alias("embedding"))).alias("idx", "r"))
    return rows.where(F.col("idx").isNotNull()).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), "idx").alias("chunk_id"), "doc_id", "r.text", "r.embedding", F.to_json(F.struct(F.col("idx").alias("index"))).alias("metadata"))


def write_index(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """Chunk rows as Parquet in place of the earlier chunks of the same documents."""
    keyed.save(rows, path, key)


def delete_from_index(keys: DataFrame, path: str, key: str = "doc_id") -> None:
    """Remove all chunks of these documents."""
    keyed.remove(keys, path, key)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
