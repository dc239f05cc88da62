"""Job states, operation metrics, call logs and upserts over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions.text import strip
from pagegrain.operators import jobs
from pagegrain.plans import inputs
from pagegrain.plans.ansi import s_strip
from pagegrain.plans.registry import query


_STAGE = {"view": "ocr_processing", "click": "layout_analysis", "signup": "data_normalization", "purchase": "completed", "error": "failed"}


def job_events(spark, sf):
    """Events as job updates: a user is a job, created by its first sign-up."""
    e = inputs.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return updates(e)


def updates(e):
    stage = F.create_map(*[F.lit(x) for kv in _STAGE.items() for x in kv])[F.col("event_type")]
    create = (F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0)
    return e.select("event_id", F.col("user_id").alias("job_id"), "ts", "value", F.when(create, "create").otherwise("update").alias("kind"), stage.alias("stage"),
                    ((F.col("event_id") % 10) / 10).alias("progress"), F.concat(F.lit("m"), "event_id").alias("message"),
                    F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.concat(F.lit("e"), "event_id")).alias("error"))


def _progress(stage: str, p: str) -> str:
    done, arms = 0.0, []
    for s, w in jobs.STAGE_WEIGHTS.items():
        arms.append(f"WHEN '{s}' THEN {done!r}::DOUBLE + {w!r}::DOUBLE * {p}")
        done += w
    return f"greatest(0, least(1, CASE {stage} {' '.join(arms)} ELSE 0 END))::DOUBLE"


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STAGE.items()) + " END"
_J = f"""j AS (SELECT event_id, user_id AS job_id, ts, value, CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'create' ELSE 'update' END AS kind, {_CASE} AS stage, (event_id % 10) / 10.0::DOUBLE AS progress,
  'm' || event_id AS message, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'e' || event_id END AS error FROM events),
c AS (SELECT job_id, min(ts) AS created_at FROM j WHERE kind = 'create' GROUP BY job_id),
u AS (SELECT j.*, created_at FROM j JOIN c USING (job_id) WHERE kind = 'update' AND ts >= created_at),
s AS (SELECT c.job_id, any_value(c.created_at) AS created_at, coalesce(max(ts), any_value(c.created_at)) AS updated_at, coalesce(arg_max(stage, (ts, event_id)), 'uploading') AS stage, coalesce(arg_max(message, (ts, event_id)), 'Job created') AS message,
  coalesce(arg_max(CASE WHEN stage = 'completed' THEN 1.0 ELSE {_progress('stage', 'progress')} END, (ts, event_id)) FILTER (WHERE error IS NULL AND stage <> 'failed'), 0)::DOUBLE AS progress,
  arg_max(error, (ts, event_id)) FILTER (WHERE error IS NOT NULL) AS error, coalesce(bool_or(stage = 'completed'), false) AS completed, coalesce(bool_or(stage = 'failed'), false) AS failed
  FROM c LEFT JOIN (SELECT job_id, ts, event_id, stage, message, progress, error FROM u) u ON u.job_id = c.job_id GROUP BY c.job_id)"""
_END = "TIMESTAMP '2024-02-01 00:00:00'"


def _as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def _when(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}"


@query("win3_stage_progress", f"WITH {_J} SELECT event_id, round({_progress('stage', 'progress')}, 6) AS overall FROM j")
def stage_progress(spark, sf):
    return job_events(spark, sf).select("event_id", F.round(jobs.overall_progress(F.col("stage"), F.col("progress")), 6).alias("overall"))


STATE_SQL = f"WITH {_J} SELECT job_id, {_when('created_at')}, {_when('updated_at')}, stage, message, round(progress, 6) AS progress, error, completed, failed FROM s"


def shown_states(s):
    return s.select("job_id", _text("created_at"), _text("updated_at"), "stage", "message", F.round("progress", 6).alias("progress"), "error", "completed", "failed")


@query("str1_job_states", STATE_SQL)
def job_states(spark, sf):
    return shown_states(jobs.job_states(job_events(spark, sf)))


@query("str2_timed_out_jobs", f"""WITH {_J} SELECT job_id, CASE WHEN late THEN 'failed' ELSE stage END AS stage, CASE WHEN late THEN 'Processing timeout: Job exceeded 5 minute time limit' ELSE error END AS error, failed OR late AS failed
FROM (SELECT *, NOT completed AND NOT failed AND {_END} - created_at > INTERVAL 300 SECOND AS late FROM s)""")
def timed_out_jobs(spark, sf):
    return jobs.timed_out(jobs.job_states(job_events(spark, sf)), _as_of()).select("job_id", "stage", "error", "failed")


@query("agg15_job_counts", f"WITH {_J} SELECT count(*) AS total, count(*) FILTER (WHERE completed) AS completed, count(*) FILTER (WHERE NOT completed AND failed) AS failed, count(*) FILTER (WHERE NOT completed AND NOT failed) AS active FROM s")
def job_counts(spark, sf):
    return jobs.job_counts(jobs.job_states(job_events(spark, sf)))


@query("win14_progress_view", f"""WITH {_J} SELECT job_id, stage, printf('%.1f', progress * 100) || '%' AS progress_percent, round(epoch_us({_END} - created_at) / 1e6, 3) AS elapsed, completed, failed FROM s""")
def progress_view(spark, sf):
    v = jobs.progress_view(jobs.job_states(job_events(spark, sf)), _as_of())
    return v.select("job_id", "stage", "progress_percent", F.round("elapsed", 3).alias("elapsed"), "completed", "failed")


@query("win13_time_left", f"""WITH {_J} SELECT job_id, CASE WHEN NOT completed AND NOT failed AND progress > 0.1 THEN greatest(0, trunc(el / progress - el)::BIGINT) END AS remaining_seconds FROM (SELECT *, epoch_us({_END} - created_at) / 1e6::DOUBLE AS el FROM s)""")
def time_left(spark, sf):
    return jobs.progress_view(jobs.job_states(job_events(spark, sf)), _as_of()).select("job_id", "remaining_seconds")


@query("win5_history", """SELECT job_id, event_id, seq FROM (SELECT user_id AS job_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n,
 least(10, count(*) OVER (PARTITION BY user_id)) - row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) + 1 AS seq FROM events) WHERE k <= 10""")
def history(spark, sf):
    return jobs.history(job_events(spark, sf), "job_id", "ts", limit=10).select("job_id", "event_id", "seq")


@query("str3_bounded_history", """SELECT user_id AS job_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 100""")
def bounded_history(spark, sf):
    return jobs.history(job_events(spark, sf), "job_id", "ts", cap=jobs.HISTORY).select("job_id", "event_id")


@query("win6_upsert", """
SELECT user_id AS doc_id, event_id % 7 AS block_index, arg_max(event_type, (ts, event_id)) AS corrected, min(event_id) AS position FROM events GROUP BY user_id, event_id % 7""")
def upsert(spark, sf):
    e = inputs.table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).alias("block_index"), F.col("event_type").alias("corrected"), "ts", "event_id", F.col("event_id").alias("position"))
    return jobs.upserted(e, ["doc_id", "block_index"], ["ts", "event_id"], "position").select("doc_id", "block_index", "corrected", "position")


@query("snk7_job_registry", """
SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'invoice' ELSE 'none' END AS document_type_id FROM orders""")
def job_registry(spark, sf):
    o = inputs.table(spark, sf, "orders")
    old = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.lit(0).alias("saved_at"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit("F").alias("status"), F.lit(1).alias("saved_at"), F.lit("invoice").alias("document_type_id"))
    return jobs.registry(old, new, "job_id", "saved_at", {"document_type_id": F.lit("none")}).select("job_id", "status", "document_type_id")


@query("top2_recent_jobs", "SELECT o_orderkey AS job_id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def recent_jobs(spark, sf):
    r = jobs.recent(inputs.table(spark, sf, "orders"), "o_orderdate", "o_orderkey")
    return r.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))


_VALID = """v AS (SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 OR l_tax > 0.06))"""


@query("jn9_valid_jobs", f"WITH {_VALID} SELECT o_orderkey AS job_id, o_orderkey IN (SELECT o_orderkey FROM v) AS valid FROM orders")
def valid_jobs(spark, sf):
    o = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"))
    kinds = F.filter(F.array(F.when(F.col("l_returnflag") == "R", "layout"), F.when(F.col("l_linenumber") == 1, "image"), F.when(F.col("l_tax") > 0.06, "upload")), lambda k: k.isNotNull())
    files = inputs.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.explode(kinds).alias("kind"))
    return jobs.judged_jobs(o, files, "job_id")


# Views start and purchases end an operation named by user and a number of the day.
_OPS = """e AS (SELECT user_id * 100 + extract(day FROM ts) AS op_id, CASE WHEN event_type = 'view' THEN 'start' ELSE 'end' END AS kind, 'op' || user_id % 5 AS name, ts, value * 10 AS memory_mb, event_id % 4 <> 0 AS success FROM events WHERE event_type IN ('view', 'purchase')),
o AS (SELECT op_id, max(name) FILTER (WHERE kind = 'start') AS name, min(ts) FILTER (WHERE kind = 'start') AS started_at, max(ts) FILTER (WHERE kind = 'end') AS ended_at, max(memory_mb) FILTER (WHERE kind = 'end') AS memory_mb, bool_and(success) FILTER (WHERE kind = 'end') AS success FROM e GROUP BY op_id),
p AS (SELECT *, epoch_us(ended_at - started_at) / 1e6::DOUBLE AS duration, ended_at IS NULL AS active FROM o WHERE started_at IS NOT NULL)"""


def op_events(e):
    return e.where(F.col("event_type").isin("view", "purchase")).select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("op_id"), F.when(F.col("event_type") == "view", "start").otherwise("end").alias("kind"),
        F.concat(F.lit("op"), F.col("user_id") % 5).alias("name"), "ts", (F.col("value") * 10).alias("memory_mb"), (F.col("event_id") % 4 != 0).alias("success"))


def _ops(spark, sf):
    return jobs.paired_operations(op_events(inputs.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))))


@query("jn14_paired_operations", f"WITH {_OPS} SELECT op_id, name, round(duration, 3) AS duration, round(memory_mb, 6) AS memory_mb, success, active FROM p")
def paired_operations(spark, sf):
    return _ops(spark, sf).select("op_id", "name", F.round("duration", 3).alias("duration"), F.round("memory_mb", 6).alias("memory_mb"), "success", "active")


@query("agg13_operation_summary", """
SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successful, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(nullif(value / 10, 0)), 6) AS mean_duration, round(max(value / 10), 6) AS max_duration,
 round(avg(nullif(value * 10, 0)), 6) AS mean_memory, round(max(value * 10), 6) AS peak_memory FROM events""")
def operation_summary(spark, sf):
    s = jobs.operation_summary(_measured(spark, sf))
    return s.select("total", "successful", "failed", *[F.round(c, 6).alias(c) for c in ("mean_duration", "max_duration", "mean_memory", "peak_memory")])


def _measured(spark, sf):
    return inputs.table(spark, sf, "events").select("event_id", F.col("event_type").alias("name"), (F.col("value") / 10).alias("duration"), (F.col("value") * 10).alias("memory_mb"), (F.col("event_type") != "error").alias("success"))


@query("agg13_operation_counts", "SELECT event_type AS name, count(*) AS n FROM events GROUP BY event_type")
def operation_counts(spark, sf):
    return _measured(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("agg14_alerts", """
SELECT event_id, 'time' AS metric, CASE WHEN value / 10 > 25 THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE value / 10 > 20
UNION ALL SELECT event_id, 'memory', CASE WHEN value * 10 > 3072 THEN 'critical' ELSE 'warning' END FROM events WHERE value * 10 > 2048""")
def alerts(spark, sf):
    return jobs.alerts(_measured(spark, sf)).select("event_id", "metric", "severity")


@query("agg17_retry_statistics", """
WITH c AS (SELECT event_type, user_id, count(*) FILTER (WHERE event_id % 6 <> 0) AS n, bool_or(event_id % 6 <> 0 AND value > 40) AS ok FROM events GROUP BY event_type, user_id)
SELECT event_type AS function, count(*) AS total_calls, count(*) FILTER (WHERE ok) AS successful_calls, count(*) FILTER (WHERE NOT ok) AS failed_calls, sum(greatest(n - 1, 0))::BIGINT AS total_retries, max(greatest(n - 1, 0)) AS max_retries, round(avg(greatest(n - 1, 0)), 6) AS average_retries FROM c GROUP BY event_type""")
def retry_statistics(spark, sf):
    a = inputs.table(spark, sf, "events").select(F.col("event_type").alias("function"), F.col("user_id").alias("call"), (F.col("event_id") % 6 != 0).alias("recorded"), ((F.col("event_id") % 6 != 0) & (F.col("value") > 40)).alias("success"))
    return jobs.retry_statistics(a, "function", "call").withColumn("average_retries", F.round("average_retries", 6))


def _calls(spark, sf):
    c = inputs.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.length("text").alias("response_length"), (F.length("text") * 2).alias("prompt_length"), (F.length("text") % 7 != 0).alias("success"), (F.length("text") / 1000).alias("processing_time"))


@query("agg16_call_summary", """
SELECT conv_id, count(*) AS total_calls, count(*) FILTER (WHERE length(text) % 7 <> 0) AS successful_calls, count(*) FILTER (WHERE length(text) % 7 = 0) AS failed_calls, round(sum(round(length(text) / 1000, 3)), 3) AS total_processing_time,
 sum(length(text) * 2)::BIGINT AS prompt_length, sum(length(text))::BIGINT AS response_length FROM conversations GROUP BY conv_id""")
def call_summary(spark, sf):
    return jobs.call_summary(_calls(spark, sf), "conv_id")


@query("snk6_call_numbers", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS call_id, length(text) AS response_length FROM conversations")
def call_numbers(spark, sf):
    return jobs.numbered_calls(_calls(spark, sf), "conv_id", "turn", width=3).select("conv_id", "turn", "call_id", "response_length")


@query("agg27_all_metrics", """
SELECT event_type AS name, count(*) AS count, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(*) FILTER (WHERE value > 100) AS slow FROM events GROUP BY event_type""")
def all_metrics(spark, sf):
    m = jobs.metric_summary(inputs.table(spark, sf, "events"), "event_type", "value", [])
    return m.select(F.col("event_type").alias("name"), "count", F.round("avg", 6).alias("avg"), "min", "max", "slow")


@query("agg27_metric_summary", """
SELECT event_type AS name, count(*) AS count, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(*) FILTER (WHERE value > 100) AS slow FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) GROUP BY event_type""")
def metric_summary(spark, sf):
    m = jobs.metric_summary(inputs.table(spark, sf, "events"), "event_type", "value", [F.col("ts").desc(), F.col("event_id").desc()], cap=100)
    return m.select(F.col("event_type").alias("name"), "count", F.round("avg", 6).alias("avg"), "min", "max", "slow")


@query("top3_metric_cap", "SELECT event_id, value FROM events QUALIFY (SELECT count(*) FROM events) <= 1000 OR row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 500")
def metric_cap(spark, sf):
    return jobs.trimmed_metrics(inputs.table(spark, sf, "events"), [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "value")


@query("win12_step_durations", """
SELECT user_id, step, CASE WHEN e >= s THEN epoch_us(e) // 1000 - epoch_us(s) // 1000 END AS duration_ms FROM (
 SELECT user_id, event_id % 3 AS step, max(ts) FILTER (WHERE event_type = 'click') AS s, max(ts) FILTER (WHERE event_type = 'signup') AS e FROM events WHERE event_type IN ('click', 'signup') GROUP BY user_id, event_id % 3)""")
def step_durations(spark, sf):
    e = inputs.table(spark, sf, "events").where(F.col("event_type").isin("click", "signup")).select(
        "user_id", (F.col("event_id") % 3).alias("step"), F.when(F.col("event_type") == "click", "start").otherwise("end").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.step_durations(e, "user_id", "step")


@query("agg21_page_kinds", f"""
WITH h AS (SELECT conv_id, length({s_strip('text')}) >= 150 AS t FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5)
SELECT conv_id, CASE WHEN bool_and(t) THEN 'text' WHEN NOT bool_or(t) THEN 'image' ELSE 'mixed' END AS kind, count(*) AS pages_checked, count(*) FILTER (WHERE t) AS text_pages FROM h GROUP BY conv_id""")
def page_kinds(spark, sf):
    return jobs.page_kinds(inputs.table(spark, sf, "conversations"), "conv_id", "turn", strip("text"), minimum=150)
