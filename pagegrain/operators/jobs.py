"""Job events, operation metrics, call logs and upserts.

Keys such as a job or a user may be hot. Latest states and summaries are
partial aggregates; bounded histories filter by rank before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.operators.skew import last_n, latest_by, running_total


# Stages in order with their share of the whole, and alert limits.
STAGE_WEIGHTS = {
    "uploading": 0.1, "validating": 0.1, "pdf_processing": 0.15, "ocr_processing": 0.3, "layout_analysis": 0.15,
    "data_normalization": 0.1, "schema_validation": 0.1, "completed": 0.0,
}
TIMEOUT, HISTORY = 300, 100
TIME_LIMITS, MEMORY_LIMITS, SLOW_MS = (25.0, 20.0), (3072.0, 2048.0), 100.0


def overall_progress(stage: Column, progress: Column) -> Column:
    """Earlier stage shares plus this stage's share done so far; an unknown stage counts from the start."""
    done, before, share = 0.0, {}, STAGE_WEIGHTS
    for s, w in share.items():
        before[s], done = done, done + w
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    zero = F.lit(0.0)
    total = F.coalesce(F.try_element_at(table(before), stage), zero) + F.coalesce(F.try_element_at(table(share), stage), zero) * progress
    return F.greatest(zero, F.least(F.lit(1.0), total))


def job_states(events: DataFrame, job: str = "job_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Current state of every created job, folded from its updates.

    Needs ``kind`` (create or update), ``stage``, ``progress``, ``message`` and
    ``error``. Updates before the creation of a job, and of jobs never created,
    are ignored; a failure keeps the last progress. Of updates at one time the
    one with the largest ``tie``, the order of arrival, is the last. Every part is
    a min, max or max-by, so tasks combine their events before the shuffle.
    """
    at = lambda cond: F.when(cond, F.struct(ts, tie))
    update = F.col("kind") == "update"
    broken = update & F.col("error").isNotNull()
    failed = broken | (update & (F.col("stage") == "failed"))
    done = update & F.col("error").isNull() & (F.col("stage") == "completed")
    moving = update & ~failed
    value = F.when(done, 1.0).otherwise(overall_progress(F.col("stage"), F.col("progress")))
    row = F.struct("stage", "message")
    agg = events.groupBy(job).agg(
        F.min(F.when(F.col("kind") == "create", F.col(ts))).alias("created_at"),
        F.max(F.when(update, F.col(ts))).alias("_up"), F.max_by(F.when(update, row), at(update)).alias("_last"),
        F.max(F.when(failed, F.col(ts))).alias("_failed"), F.max(F.when(broken, F.col(ts))).alias("_broken"), F.max_by(F.when(broken, F.col("error")), at(broken)).alias("_error"),
        F.max(F.when(done, F.col(ts))).alias("_done"), F.max(F.when(moving, F.col(ts))).alias("_mv"), F.max_by(F.when(moving, value), at(moving)).alias("_progress"))
    after = lambda c: F.coalesce(F.col(c) >= F.col("created_at"), F.lit(False))
    live = agg.where(F.col("created_at").isNotNull())
    return live.select(
        job, "created_at", F.when(after("_up"), F.col("_up")).otherwise(F.col("created_at")).alias("updated_at"),
        F.when(after("_up"), F.col("_last.stage")).otherwise("uploading").alias("stage"),
        F.when(after("_up"), F.col("_last.message")).otherwise("Job created").alias("message"),
        F.when(after("_mv"), F.col("_progress")).otherwise(0.0).alias("progress"), F.when(after("_broken"), F.col("_error")).alias("error"),
        after("_done").alias("completed"), after("_failed").alias("failed"))


def timed_out(states: DataFrame, as_of: Column, limit: int = TIMEOUT) -> DataFrame:
    """Active jobs older than ``limit`` seconds since creation become failed."""
    age = F.unix_micros(as_of) - F.unix_micros("created_at")
    late = ~F.col("completed") & ~F.col("failed") & (age > limit * 1000000)
    note = f"Processing timeout: Job exceeded {limit // 60} minute time limit"
    return states.withColumns({
        "stage": F.when(late, "failed").otherwise(F.col("stage")), "error": F.when(late, note).otherwise(F.col("error")),
        "message": F.when(late, f"Processing failed: {note}").otherwise(F.col("message")), "failed": F.col("failed") | late})


def job_counts(states: DataFrame) -> DataFrame:
    """Totals by outcome; a job both completed and failed counts as completed."""
    c, f = F.col("completed"), F.col("failed")
    return states.agg(F.count(F.lit(1)).alias("total"), F.count_if(c).alias("completed"), F.count_if(~c & f).alias("failed"), F.count_if(~c & ~f).alias("active"))


def progress_view(states: DataFrame, as_of: Column) -> DataFrame:
    """Progress as shown to a user, with elapsed time and the time left where it can be told."""
    elapsed = (F.unix_micros(as_of) - F.unix_micros("created_at")) / 1000000
    p = F.col("progress")
    left = F.when(~F.col("completed") & ~F.col("failed") & (p > 0.1), F.greatest(F.lit(0), (elapsed / p - elapsed).cast("bigint")))
    return states.withColumns({"progress_percent": F.format_string("%.1f%%", F.bround(p * 100, 1)), "elapsed": elapsed, "remaining_seconds": left})


def history(events: DataFrame, job: str, ts: str, limit: int | None = None, cap: int | None = None, tie: str = "event_id") -> DataFrame:
    """Last ``cap`` updates of every job, then the last ``limit``, in time order from 1; without either, all of them."""
    n = min(x for x in (cap, limit, 1 << 62) if x)
    if n == 1 << 62:
        # All of them: numbered in buckets of a day, so that a hot job lies in many tasks; rows without a time come first.
        at = events.withColumn("_o", F.struct(ts, tie))
        day = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 86_400_000_000)
        return running_total(at, [job], "_o", F.lit(1), F.coalesce(day, F.lit(-(1 << 40))), "seq").drop("_o")
    kept = last_n(events, [job], [F.col(ts).desc(), F.col(tie).desc()], n)
    # At most n rows per job remain, so a window over them is bounded.
    size = F.count(F.lit(1)).over(W.partitionBy(job))
    return kept.withColumn("seq", size - F.col("_rn") + 1).drop("_rn")


def upserted(rows: DataFrame, keys: list[str], order: list[str], position: str) -> DataFrame:
    """Latest record of every key; a replaced record keeps its first place."""
    return latest_by(rows, keys, order, first=position)


def registry(old: DataFrame, new: DataFrame, key: str, saved_at: str, defaults: dict[str, Column]) -> DataFrame:
    """Job registry after saving: missing columns of old rows get defaults, later saves win."""
    every = old.unionByName(new, allowMissingColumns=True)
    for name, value in defaults.items():
        every = every.withColumn(name, F.coalesce(F.col(name), value))
    return latest_by(every, [key], [saved_at])


def recent(jobs: DataFrame, created: str, tie: str, n: int = 20) -> DataFrame:
    """The newest jobs; a top-k that keeps n rows per task."""
    return jobs.orderBy(F.col(created).desc(), F.col(tie).desc()).limit(n)


def judged_jobs(jobs: DataFrame, files: DataFrame, key: str, kind: str = "kind") -> DataFrame:
    """Every job with ``valid``: a layout file and either a page image or an uploaded one.

    ``files`` lists all files with their kind (layout, image, upload); it is read
    once and shrinks to one row of flags a job before the join.
    """
    flags = files.groupBy(key).agg(F.bool_or(F.col(kind) == "layout").alias("_layout"), F.bool_or(F.col(kind).isin("image", "upload")).alias("_picture"))
    return jobs.join(flags, key, "left").withColumn("valid", F.coalesce(F.col("_layout") & F.col("_picture"), F.lit(False))).drop("_layout", "_picture")


def paired_operations(events: DataFrame, op: str = "op_id") -> DataFrame:
    """Start and end of every operation on one row; an end without a start is ignored.

    An operation without an end stays active. Pairing is one aggregate on the
    operation id, so no join is needed.
    """
    start = F.col("kind") == "start"
    agg = events.groupBy(op).agg(
        F.max_by("name", start).alias("name"), F.min(F.when(start, F.col("ts"))).alias("started_at"), F.max(F.when(~start, F.col("ts"))).alias("ended_at"),
        F.max(F.when(~start, F.col("memory_mb"))).alias("memory_mb"), F.bool_and(F.when(~start, F.col("success"))).alias("success"))
    secs = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000000
    return agg.where(F.col("started_at").isNotNull()).withColumns({"duration": secs, "active": F.col("ended_at").isNull()})


def operation_summary(ops: DataFrame, duration: str = "duration", memory: str = "memory_mb") -> DataFrame:
    """Totals, outcomes, and mean and peak figures that leave out zero and null."""
    d, m = F.nullif(F.col(duration), F.lit(0.0)), F.nullif(F.col(memory), F.lit(0.0))
    zero = F.lit(0.0)
    return ops.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("success")).alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.avg(d), zero).alias("mean_duration"), F.coalesce(F.max(d), zero).alias("max_duration"),
        F.coalesce(F.avg(m), zero).alias("mean_memory"), F.coalesce(F.max(m), zero).alias("peak_memory"))


def alerts(ops: DataFrame, duration: str = "duration", memory: str = "memory_mb") -> DataFrame:
    """Time and memory alerts of every operation over a limit."""
    def level(c: str, limits: tuple[float, float], what: str) -> Column:
        v = F.col(c)
        return F.when(v > limits[0], F.struct(F.lit(what).alias("metric"), F.lit("critical").alias("severity"), v.alias("value"))).when(
            v > limits[1], F.struct(F.lit(what).alias("metric"), F.lit("warning").alias("severity"), v.alias("value")))

    both = F.filter(F.array(level(duration, TIME_LIMITS, "time"), level(memory, MEMORY_LIMITS, "memory")), lambda a: a.isNotNull())
    rows = ops.select("*", F.explode_outer(both).alias("_a"))
    return rows.where(F.col("_a").isNotNull()).select(*ops.columns, "_a.*")


def retry_statistics(attempts: DataFrame, function: str, call: str) -> DataFrame:
    """Calls, outcomes and retries per function from one row per attempt.

    Retries never go below zero, also when a first attempt failed for good.
    """
    calls = attempts.groupBy(function, call).agg(F.count_if(F.col("recorded")).alias("n"), F.bool_or("success").alias("ok"))
    retries = F.greatest(F.col("n") - 1, F.lit(0))
    return calls.groupBy(function).agg(
        F.count(F.lit(1)).alias("total_calls"), F.count_if("ok").alias("successful_calls"), F.count_if(~F.col("ok")).alias("failed_calls"),
        F.sum(retries).alias("total_retries"), F.max(retries).alias("max_retries"), F.avg(retries).alias("average_retries"))


def numbered_calls(calls: DataFrame, job: str, order: str, width: int = 1024) -> DataFrame:
    """Call number of every logged call in its job, by time; jobs are cut into buckets of ``order``."""
    return running_total(calls, [job], order, F.lit(1), F.floor(F.col(order) / width), "call_id")


def call_summary(calls: DataFrame, job: str) -> DataFrame:
    return calls.groupBy(job).agg(
        F.count(F.lit(1)).alias("total_calls"), F.count_if("success").alias("successful_calls"), F.count_if(~F.col("success")).alias("failed_calls"),
        F.round(F.sum(F.round("processing_time", 3)), 3).alias("total_processing_time"),
        F.sum("prompt_length").alias("prompt_length"), F.sum("response_length").alias("response_length"))


def metric_summary(metrics: DataFrame, name: str, duration: str, order: list[Column], cap: int | None = None) -> DataFrame:
    """Count, mean, min, max and slow count per name, over all metrics or the last ``cap``.

    A cap is a top-k over all metrics, kept on every task.
    """
    kept = metrics if cap is None else metrics.orderBy(*order).limit(cap)
    return kept.groupBy(name).agg(F.count(F.lit(1)).alias("count"), F.avg(duration).alias("avg"), F.min(duration).alias("min"), F.max(duration).alias("max"),
                                  F.count_if(F.col(duration) > SLOW_MS).alias("slow"))


def trimmed_metrics(metrics: DataFrame, order: list[Column], over: int = 1000, keep: int = 500) -> DataFrame:
    """The last ``keep`` metrics once there are more than ``over``, else all of them, as a bounded buffer does.

    A top-k of ``over + 1`` rows, kept on every task, shows which case holds; the
    plan is the same for both and no count reaches the driver.
    """
    last = metrics.orderBy(*order).limit(over + 1)
    numbered = last.withColumns({"_rank": F.row_number().over(W.orderBy(*order)), "_n": F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))})
    return numbered.where((F.col("_n") <= over) | (F.col("_rank") <= keep)).drop("_rank", "_n")


def step_durations(events: DataFrame, *keys: str) -> DataFrame:
    """Milliseconds from the last start to the last end of every step; null until it has ended after a start."""
    agg = events.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "start", F.col("ts"))).alias("s"), F.max(F.when(F.col("kind") == "end", F.col("ts"))).alias("e"))
    ms = lambda c: F.floor(F.unix_micros(c) / 1000)
    return agg.select(*keys, F.when(F.col("e") >= F.col("s"), ms("e") - ms("s")).alias("duration_ms"))


def page_kinds(pages: DataFrame, key: str, page: str, text: Column, first: int = 5, minimum: int = 50) -> DataFrame:
    """Whether a document's first pages are all text, all image or mixed."""
    head = last_n(pages.withColumn("_t", F.length(text) >= minimum), [key], [F.col(page)], first)
    agg = head.groupBy(key).agg(F.bool_and("_t").alias("a"), F.bool_or("_t").alias("o"), F.count(F.lit(1)).alias("pages_checked"), F.count_if("_t").alias("text_pages"))
    return agg.select(key, F.when(F.col("a"), "text").when(~F.col("o"), "image").otherwise("mixed").alias("kind"), "pages_checked", "text_pages")
