"""Vector retrieval: encode, filter, rank and pack context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagegrain.functions import vectors
from pagegrain.functions.text import words

TOP_K, DOCUMENT_K, CONTEXT = 30, 5, 4000


def hashed_terms(df: DataFrame, text: str = "text", dims: int = 512, out: str = "embedding") -> DataFrame:
    """Default encoder: hashed term counts scaled to unit length."""
    stages = [HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims), Normalizer(inputCol="_tf", outputCol="_n", p=2.0)]
    ready = df.withColumn("_w", words(F.lower(text)))
    model = Pipeline(stages=stages).fit(ready)
    return model.transform(ready).withColumn(out, vector_to_array("_n", "float32")).drop("_w", "_tf", "_n")


Encoder = Callable[[DataFrame, str], DataFrame]


#: Models that this worker has loaded, by name.
_LOADED: dict[str, Callable[[list[str]], list]] = {}


def batched(name: str, load: Callable[[], Callable[[list[str]], list]], batch: int = 32) -> Encoder:
    """An encoder that loads its model once a worker and hands it ``batch`` texts at a time.

    ``load`` gives a function from texts to vectors of one length; it is named, as
    workers serve many tasks and keep what they have loaded. A null text gets no vector.
    """
    @F.arrow_udf("array<double>")
    def vectors_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pagegrain.operators.retrieval import _LOADED as loaded
        if name not in loaded:
            loaded[name] = load()
        model = loaded[name]
        for column in columns:
            out: list = [None] * len(column)
            at = [i for i in range(len(column)) if column[i].is_valid]
            for k in range(0, len(at), batch):
                some = at[k:k + batch]
                for i, v in zip(some, model([column[i].as_py() for i in some])):
                    out[i] = [float(x) for x in v]
            yield pa.array(out, pa.list_(pa.float64()))

    return lambda df, text: df.withColumn("embedding", vectors_of(F.col(text)))


def encode(df: DataFrame, text: str = "text", is_query: bool = False, encoder: Encoder | None = None, instruction: str = "") -> DataFrame:
    """Add an ``embedding`` column; queries get an instruction in front of their text.

    ``encoder`` maps (df, text column) to the same rows plus ``embedding``. A
    model runs best as an iterator ``pandas_udf`` that loads once per worker.
    """
    src = df.withColumn("_text", F.concat(F.lit(instruction), F.col(text)) if is_query else F.col(text))
    return (encoder or hashed_terms)(src, "_text").drop("_text")


def similar(queries: DataFrame, chunk_vectors: DataFrame, on: list[str], k: int = TOP_K, where: Column | None = None,
            query_vector: str = "query_vector", vector: str = "embedding", chunk: str = "chunk_id", parts: int = 1) -> DataFrame:
    """The ``k`` nearest chunks of every query within its collection.

    Queries meet the vectors of their own collection only (``on``), never all of
    them. The filter is applied before ranking and reaches the scan. The optimizer
    broadcasts the queries where they are small; otherwise a hot collection is
    dealt over ``parts`` of its vectors, which the queries of the collection visit
    in turn. Only keys and distances are ranked: ``k`` rows per query on every
    task before the final shuffle. Ties go by chunk id.
    """
    pool = chunk_vectors if where is None else chunk_vectors.where(where)
    if parts > 1:
        pool = pool.withColumn("_part", F.pmod(F.xxhash64(chunk), F.lit(parts)).cast("int"))
        queries, on = queries.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [*on, "_part"]
    near = pool.join(queries, on).drop("_part")
    d = near.withColumn("distance", vectors.squared_l2(F.col(query_vector), F.col(vector))).drop(query_vector, vector)
    w = W.partitionBy("query_id").orderBy("distance", chunk)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", vectors.score(F.col("distance")))


def packed_context(hits: DataFrame, limit: int = CONTEXT, text: str = "text") -> DataFrame:
    """Join the texts of each query's hits in rank order, up to the first that would pass ``limit``.

    A query has at most k hits, so its group is small by construction.
    """
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t")))).alias("h"))

    def step(s: Column, h: Column) -> Column:
        n = s["len"] + F.length(h["t"])
        stop = s["stop"] | (n > limit)
        return F.struct(F.when(stop, s["len"]).otherwise(n).alias("len"), stop.alias("stop"), F.when(stop, s["n"]).otherwise(s["n"] + 1).alias("n"))

    zero = F.struct(F.lit(0).alias("len"), F.lit(False).alias("stop"), F.lit(0).alias("n"))
    kept = got.withColumn("n_used", F.aggregate("h", zero, step, lambda s: s["n"]))
    return kept.select("query_id", "n_used", F.array_join(F.transform(F.slice("h", F.lit(1), F.col("n_used")), lambda h: h["t"]), "\n\n").alias("context"))


def build_context(queries: DataFrame, chunk_vectors: DataFrame, indexed: DataFrame, on: list[str], k: int = TOP_K, limit: int = CONTEXT,
                  where: Column | None = None, texts: DataFrame | None = None, chunk: str = "chunk_id") -> DataFrame:
    """Index gate, filter, ranking and packing; a query over an unindexed collection gets an empty context.

    ``texts`` (chunk, text) is joined to the hits alone, ``k`` a query at most.
    """
    open_q = queries.join(indexed.where(F.col("indexed")).select(*on), on, "left_semi")
    hits = similar(open_q, chunk_vectors, on, k, where, chunk=chunk)
    packed = packed_context(hits if texts is None else hits.join(texts, chunk), limit)
    return queries.select("query_id").join(packed, "query_id", "left").select(
        "query_id", F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("context", F.lit("")).alias("context"))


def index_rows(chunk_rows: DataFrame, key: str, texts: str = "content") -> DataFrame:
    """Rows to store: chunk id from document and index, default metadata where there is none."""
    meta = F.to_json(F.struct(F.col("idx").alias("index"), "start_char", "end_char"))
    return chunk_rows.select(F.concat(F.col(key).cast("string"), F.lit("_chunk_"), "idx").alias("chunk_id"), key, F.col(texts).alias("text"), meta.alias("metadata"))


def index_status(documents: DataFrame, chunk_vectors: DataFrame, key: str) -> DataFrame:
    """Indexed flag and chunk count of every document, zero when it has none."""
    n = chunk_vectors.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"))
    out = documents.join(n, key, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    return out.withColumn("indexed", F.col("chunk_count") > 0)


def replaced_index(current: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Index with the rows of re-indexed documents swapped for fresh ones."""
    return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def deleted_index(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return current.join(gone.select(key).distinct(), key, "left_anti")
