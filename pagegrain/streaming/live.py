"""Streaming forms of the job, history, ingestion, correction and metric operators.

Streams run on built-in aggregates wherever the state is a min, max or max-by:
those combine on every task before the shuffle, which a per-key Python state
cannot do for a hot key. Micro-batch sinks append change rows tagged with the
batch; readers take the latest row per key. A batch that runs again after a
failure overwrites its own folder, so results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagegrain.operators import chunking, jobs, retrieval
from pagegrain.operators.skew import last_n, latest_by

Sink = Callable[[DataFrame, int], None]


def table_stream(spark: SparkSession, folder: str, name: str, parts: int = 3) -> DataFrame:
    """A stream over one table, a file or a folder of files, in about ``parts`` batches; NTZ times become instants, which watermarks need."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    schema, files = table.schema, len(table.inputFiles())
    # A pattern, since the stream takes a plain path for a folder.
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // parts))).parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else s


def replay(table: DataFrame, path: str, order: str, parts: int = 3) -> DataFrame:
    """A table as a stream of ``parts`` batches in time order, rows without a time in the first.

    Parts are written one after the other, each by many tasks into a folder of its
    own; empty files make up the number of files that a trigger takes. The table is
    read once a part and once for the cuts, so one that is costly to make is written first.
    """
    cuts = table.agg(F.percentile_approx(F.unix_micros(F.col(order).cast("timestamp")), [i / parts for i in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    at = F.unix_micros(F.col(order).cast("timestamp"))
    edges = [None, *cuts, None]
    spark, files = table.sparkSession, max(1, table.rdd.getNumPartitions())
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part, folder = table, f"{path}/{i}"
        if lo is not None:
            part = part.where(at > lo)
        if hi is not None:
            part = part.where(at <= hi if lo is not None else (at <= hi) | at.isNull())
        part.repartition(files).write.parquet(folder)
        for _ in range(files - len(spark.read.schema(table.schema).parquet(folder).inputFiles())):
            spark.createDataFrame([], table.schema).coalesce(1).write.mode("append").parquet(folder)
    s = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")
    return s.withColumn(order, F.col(order).cast("timestamp"))


def batch_folder(path: str, *labels: str) -> Sink:
    """Sink that writes every micro-batch to its own folder, replacing it on a retry."""
    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet("/".join([path, *labels, f"part={batch}"]))
    return write


def run_available(df: DataFrame, sink: Sink, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start a query that handles what is there now and stops."""
    return df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_state_changes(events: DataFrame) -> DataFrame:
    """Changed job states; the batch operator is itself a streaming aggregate."""
    return jobs.job_states(events)


def current_states(changes: DataFrame, key: str = "job_id") -> DataFrame:
    """State table from change rows."""
    return latest_by(changes, [key], ["batch"]).drop("batch", "part")


def history_sink(path: str, job: str = "job_id", ts: str = "ts", tie: str = "event_id", cap: int = jobs.HISTORY) -> Sink:
    """Append the last ``cap`` updates per job of each batch: all a later reader can need."""
    write = batch_folder(path)

    def sink(df: DataFrame, batch: int) -> None:
        write(last_n(df, [job], [F.col(ts).desc(), F.col(tie).desc()], cap).drop("_rn"), batch)
    return sink


def ingest_sink(path: str, strategy: str = "paragraph", minimum: int = 50) -> Sink:
    """Validate documents, index the good ones and keep the others with a reason.

    The batch is read once per output, so it is kept in executor memory or on
    disk while both are written.
    """
    good, bad = batch_folder(path, "index"), batch_folder(path, "rejects")

    def sink(df: DataFrame, batch: int) -> None:
        from pagegrain.functions.text import strip
        reason = F.when(F.col("text").isNull(), "no_text").when(F.length(strip("text")) < minimum, "too_short")
        judged = df.withColumn("reason", reason).persist()
        try:
            rows = chunking.chunks(judged.where(F.col("reason").isNull()).select("doc_id", "text"), "doc_id", strategy=strategy)
            good(retrieval.index_rows(rows, "doc_id"), batch)
            bad(judged.where(F.col("reason").isNotNull()).select("doc_id", "reason"), batch)
        finally:
            judged.unpersist()
    return sink


def corrections_sink(path: str, keys: list[str], order: list[str], position: str) -> Sink:
    """Append each batch's latest correction per key with its first position."""
    write = batch_folder(path)

    def sink(df: DataFrame, batch: int) -> None:
        write(jobs.upserted(df, keys, order, position), batch)
    return sink


def current_corrections(path_rows: DataFrame, keys: list[str], order: list[str], position: str) -> DataFrame:
    """Corrections over all batches: latest text, earliest position."""
    return jobs.upserted(path_rows.drop("batch", "part"), keys, order, position)


def windowed_metrics(ops: DataFrame, width: str = "1 hour", late: str = "10 minutes", name: str = "name", duration: str = "duration") -> DataFrame:
    """Live figures and alert counts per operation and window; old windows leave the state."""
    limits = jobs.TIME_LIMITS
    return (ops.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col(name)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("failed"), F.sum(duration).alias("total_duration"), F.max(duration).alias("max_duration"),
        F.count_if(F.col(duration) > limits[0]).alias("critical"), F.count_if((F.col(duration) <= limits[0]) & (F.col(duration) > limits[1])).alias("warning"))
        .select(F.col("w.start").alias("window_start"), name, "n", "failed", "total_duration", "max_duration", "critical", "warning"))


def paired_streams(starts: DataFrame, ends: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Start and end events of one operation id, joined as streams within a time bound."""
    s = starts.withWatermark("ts", late).select(F.col("op_id").alias("s_op"), F.col("ts").alias("started_at"), "name")
    e = ends.withWatermark("ts", late).select(F.col("op_id").alias("e_op"), F.col("ts").alias("ended_at"), "success")
    on = (F.col("s_op") == F.col("e_op")) & (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {within}"))
    j = s.join(e, on)
    return j.select(F.col("s_op").alias("op_id"), "name", "success", ((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000000).alias("duration"))
