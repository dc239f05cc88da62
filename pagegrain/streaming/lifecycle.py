"""Job states kept in the stream: a job lives from its creation to its end or its deadline.

Rows of a job wait in its state until the watermark has passed them and are then
applied in time order, so the result does not depend on how rows fall into batches
or in which order they arrive. An event-time timer wakes a job for its next waiting row
or its deadline. An ended job gives one row and leaves the state; live jobs are read
from the state itself.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagegrain.operators.jobs import STAGE_WEIGHTS, TIMEOUT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

STATE = "created long, updated long, stage string, message string, progress double, error string, completed boolean, failed boolean"
EVENT = "at long, tie long, kind string, stage string, progress double, message string, error string, names array<string>, texts array<string>"
_FIELDS = ["at", "tie", "kind", "stage", "progress", "message", "error", "names", "texts"]
COLUMNS = ["created_at", "updated_at", "stage", "message", "progress", "error", "completed", "failed"]


def overall(stage: str | None, progress: float | None) -> float:
    """Shares of the stages before this one and the done part of its own; an unknown stage counts from the start."""
    before = 0.0
    for s, w in STAGE_WEIGHTS.items():
        if s == stage:
            return max(0.0, min(1.0, before + w * (progress or 0.0)))
        before += w
    return 0.0


class JobLifecycle(StatefulProcessor):
    """States of one job: ``job`` (its value), ``metadata`` (key by key), ``waiting`` (rows not yet passed by the watermark)."""

    def __init__(self, limit: int | None):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)
        self.metadata = handle.getMapState("metadata", "key string", "value string")
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in _FIELDS) for r in rows]
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new), sooner=True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        before = job = self.job.get()
        # State is read and written once a call; new is what the metadata gains, None where it starts anew.
        new: dict[str | None, str | None] = {}
        for r in (Row(*_FIELDS)(*r) for r in rows if r[0] <= settled):
            if self._overdue(job, r.at):
                yield self._ended(key, self._timed_out(job), new)
                job = None
            if r.kind == "create":
                job, new = (r.at, r.at, "uploading", "Job created", 0.0, None, False, False), {None: None}
            if job is None:
                continue
            new |= dict(zip(r.names or [], r.texts or []))
            if r.kind != "create":
                job = self._updated(job, r)
                if job[6] or job[7]:
                    yield self._ended(key, job, new)
                    job = None
        if self._overdue(job, settled):
            yield self._ended(key, self._timed_out(job), new)
            job = None
        # What was not there before has nothing to be cleared.
        if before is not None and (job is None or None in new):
            self.metadata.clear()
        if job is None:
            if before is not None:
                self.job.clear()
        else:
            self.job.update(tuple(job))
            for k, v in new.items():
                if k is not None:
                    self.metadata.updateValue((k,), (v,))
        later = [tuple(r) for r in rows if r[0] > settled]
        if later:
            self.waiting.put(later)
        elif rows:
            self.waiting.clear()
        ats = [r[0] for r in later[:1]] + ([self._deadline(job) + 1] if self.limit and job is not None else [])
        self._wake(min(ats, default=None))

    def _wake(self, at: int | None, sooner: bool = False) -> None:
        """One timer: for the first waiting row or the deadline, whichever is first. With ``sooner`` a timer that is due earlier stays."""
        t, timers = at if at is None else -(-at // 1000), list(self.handle.listTimers())
        if sooner and timers and min(timers) <= t:
            return
        for old in timers:
            self.handle.deleteTimer(old)
        if t is not None:
            self.handle.registerTimer(t)

    def _deadline(self, job) -> int:
        return job[0] + self.limit * 1_000_000

    def _overdue(self, job, now: int) -> bool:
        return bool(self.limit) and job is not None and now > self._deadline(job)

    def _timed_out(self, job) -> tuple:
        note = f"Processing timeout: Job exceeded {self.limit // 60} minute time limit"
        return job[0], self._deadline(job), "failed", f"Processing failed: {note}", job[4], note, False, True

    def _updated(self, job, r: Row) -> tuple:
        """A failure keeps the progress; a message of an earlier error stays."""
        failed = r.error is not None or r.stage == "failed"
        done = not failed and r.stage == "completed"
        progress = job[4] if failed else 1.0 if done else overall(r.stage, r.progress)
        return job[0], r.at, r.stage, r.message, progress, r.error if r.error is not None else job[5], done, failed

    def _ended(self, key, job, new: dict) -> Row:
        kept = {} if None in new or not self.metadata.exists() else {k[0]: v[0] for k, v in self.metadata.iterator()}
        pairs = {k: v for k, v in (kept | new).items() if k is not None}
        new.clear()
        new[None] = None
        return Row("job_id", *COLUMNS, "names", "texts")(key[0], *job, list(pairs), list(pairs.values()))

    def close(self) -> None:
        pass


def ended_jobs(events: DataFrame, limit: int | None = TIMEOUT, late: str = "1 minute") -> DataFrame:
    """A stream of job rows -> one row a job that completed, failed or passed its deadline.

    ``events`` needs job_id, ts, event_id, kind (create or update), stage, progress,
    message, error and metadata (a map, merged key by key). A creation starts the job
    anew; updates outside a life are ignored, as are rows that come more than ``late``
    behind the latest time seen, or have no time. Of rows at one time the larger
    event_id is the later. A job whose age passes ``limit`` seconds fails at that moment.
    """
    rows = events.where(F.col("ts").isNotNull() & F.col("job_id").isNotNull()).withWatermark("ts", late)
    rows = rows.select("job_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.col("event_id"), F.lit(0)).cast("long").alias("tie"), "kind", "stage", F.col("progress").cast("double").alias("progress"), "message", "error",
                       F.map_keys("metadata").alias("names"), F.map_values("metadata").alias("texts"))
    kind = rows.schema["job_id"].dataType.simpleString()
    out = rows.groupBy("job_id").transformWithState(JobLifecycle(limit), f"job_id {kind}, {_result()}", "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("created_at", "updated_at")}).withColumn("metadata", F.map_from_arrays("names", "texts")).drop("names", "texts")


def _result() -> str:
    return ", ".join(f"{c} {t}" for c, t in zip(COLUMNS, ("long", "long", "string", "string", "double", "string", "boolean", "boolean"))) + ", names array<string>, texts array<string>"


def started(stream: DataFrame, checkpoint: str, **sink) -> StreamingQuery:
    """Start a stateful query that handles what is there and stops; its state lies in RocksDB, whatever the session has set."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = stream.writeStream.outputMode(sink.get("mode", "append")).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if sink.get("each"):
            return writer.foreachBatch(sink["each"]).start()
        if sink.get("path"):
            return writer.format("parquet").start(sink["path"])
        return writer.format("noop").start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The rows of one state variable as they are now: columns of the key and of the value, or of the list's elements."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    parts = [c for c in ("key", "value", "list_element", "user_map_key", "user_map_value") if c in rows.columns]
    return rows.select(*parts)


def live_jobs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Jobs that have neither ended nor timed out, read from the state."""
    jobs = state(spark, checkpoint, "job").select("key.*", "value.*")
    pairs = state(spark, checkpoint, "metadata").select("key.*", F.col("user_map_key.key").alias("k"), F.col("user_map_value.value").alias("v"))
    merged = pairs.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))
    shown = jobs.join(merged, "job_id", "left")
    return shown.select("job_id", F.timestamp_micros("created").alias("created_at"), F.timestamp_micros("updated").alias("updated_at"), "stage", "message", "progress", "error", "completed", "failed",
                        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


class BoundedHistory(StatefulProcessor):
    """The last ``cap`` rows of a key as list state; nothing is emitted, readers read the state."""

    def __init__(self, cap: int, columns: list[str], schema: str):
        self.cap, self.columns, self.schema = cap, columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("history", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        # nlargest holds cap rows at a time, however many the batch has.
        last = heapq.nlargest(self.cap, itertools.chain(old, (tuple(r[c] for c in self.columns) for r in rows)), key=lambda r: r[:2])
        self.rows.put(last[::-1])
        return iter(())

    def close(self) -> None:
        pass


def bounded_history(events: DataFrame, cap: int, *columns: str, key: str = "job_id") -> DataFrame:
    """A stream that keeps the last ``cap`` rows of every key by (ts, event_id) in the state; its output is empty.

    Rows may come in any order and any batch. Rows without a key, a time or an id are left out.
    """
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("event_id").isNotNull())
    rows = rows.select(key, F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), *columns)
    names = ["at", "event_id", *columns]
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.groupBy(key).transformWithState(BoundedHistory(cap, names, schema), f"{key} {rows.schema[key].dataType.simpleString()}", "Update", "None")


def kept_history(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The history as the state has it: the key, seq from 1, ts, event_id and the further columns."""
    rows = state(spark, checkpoint, "history")
    return rows.select("key.*", F.timestamp_micros("list_element.at").alias("ts"), *[f"list_element.{f.name}" for f in rows.schema["list_element"].dataType.fields if f.name != "at"])


class LatestCorrections(StatefulProcessor):
    """The latest correction of every block of a document as map state; the blocks a batch has changed are emitted."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("corrections", "block_index long", "at long, tie long, corrected string, position long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best: dict[int, tuple] = {}
        for r in rows:
            new, old = (r["at"], r["tie"], r["corrected"], r["position"]), best.get(r["block_index"])
            best[r["block_index"]] = (*max(old, new, key=lambda v: v[:2])[:3], min(old[3], new[3])) if old else new
        for block, new in best.items():
            old = self.blocks.getValue((block,)) if self.blocks.containsKey((block,)) else None
            value = (*max(tuple(old), new, key=lambda v: v[:2])[:3], min(old[3], new[3])) if old else new
            if not old or tuple(old) != value:
                self.blocks.updateValue((block,), value)
                yield Row("doc_id", "block_index", "corrected", "position")(key[0], block, value[2], value[3])

    def close(self) -> None:
        pass


def latest_corrections(corrections: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A stream of (doc_id, block_index, corrected, ts, event_id, position) -> the blocks each batch changes.

    Latest text by (ts, event_id), earliest position. With ``keep_ms`` a block leaves the
    state so long after its last change, which must exceed how late a correction may
    come; such a stream needs a trigger that goes on, since one that stops when
    nothing is left never finds that with clocks in its state. Rows without a document, block, time or id are left out.
    """
    good = F.col("doc_id").isNotNull() & F.col("block_index").isNotNull() & F.col("ts").isNotNull() & F.col("event_id").isNotNull()
    rows = corrections.where(good).select("doc_id", F.col("block_index").cast("long").alias("block_index"), F.unix_micros("ts").alias("at"), F.col("event_id").cast("long").alias("tie"),
                                          "corrected", F.col("position").cast("long").alias("position"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("doc_id").transformWithState(LatestCorrections(keep_ms), f"doc_id {kind}, block_index long, corrected string, position long", "Update", "ProcessingTime" if keep_ms else "None")


def kept_corrections(spark: SparkSession, checkpoint: str) -> DataFrame:
    rows = state(spark, checkpoint, "corrections")
    return rows.select("key.*", "user_map_key.block_index", "user_map_value.corrected", "user_map_value.position")


def reindexing(blocks: Callable[[DataFrame], DataFrame], index: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, DataFrame], None]):
    """A sink for changed blocks: the documents concerned get new texts and a new index, the others stay.

    ``blocks`` maps document ids to their present rows (doc_id, block_index, text),
    ``index`` corrected rows to index rows, ``save`` takes (corrected rows, index rows).
    A batch that runs again ends in the same state.
    """
    def sink(changed: DataFrame, batch: int) -> None:
        changed = changed.persist()
        try:
            docs = changed.select("doc_id").distinct()
            # Corrected blocks replace, also by an empty text; a block the document lacks is appended to it.
            both = blocks(docs).select("doc_id", "block_index", "text", F.lit(0).alias("_p")).unionByName(
                changed.select("doc_id", "block_index", F.col("corrected").alias("text"), F.lit(1).alias("_p")))
            rows = both.groupBy("doc_id", "block_index").agg(F.max_by("text", "_p").alias("text"))
            save(rows, index(rows))
        finally:
            changed.unpersist()
    return sink
