"""Streams replayed over the supplied files; each result equals its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.operators import chunking, jobs
from pagegrain.operators.skew import latest_by
from pagegrain.plans import inputs
from pagegrain.plans.ansi import s_strip, with_it
from pagegrain.plans.chunks import _PARA, _by_line, _chunks_sql, _fold
from pagegrain.plans.jobs import STATE_SQL, _END, _J, _progress, shown_states, updates
from pagegrain.plans.registry import query
from pagegrain.session import shared_dir, written
from pagegrain.sources import keyed, writers
from pagegrain.streaming import ingest, lifecycle, live


def _events(spark, sf):
    """All events in three batches by time."""
    return live.replay(inputs.table(spark, sf, "events"), shared_dir(spark, "events"), "ts")


def _run(spark, df, sink_of, mode="append"):
    root = shared_dir(spark, "stream")
    live.run_available(df, sink_of(f"{root}/out"), f"{root}/checkpoint", mode).awaitTermination()
    return f"{root}/out"


def _states(spark, sf):
    out = _run(spark, live.job_state_changes(updates(_events(spark, sf))), live.batch_folder, "update")
    return live.current_states(spark.read.parquet(out))


@query("str1_live_job_states", STATE_SQL)
def live_job_states(spark, sf):
    return shown_states(_states(spark, sf))


@query("str2_live_timeouts", f"""WITH {_J} SELECT job_id, failed OR late AS failed, CASE WHEN late THEN 'failed' ELSE stage END AS stage
FROM (SELECT *, NOT completed AND NOT failed AND {_END} - created_at > INTERVAL 300 SECOND AS late FROM s)""")
def live_timeouts(spark, sf):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return jobs.timed_out(_states(spark, sf), as_of).select("job_id", "failed", "stage")


@query("str3_live_history", "SELECT user_id AS job_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20")
def live_history(spark, sf):
    out = _run(spark, updates(_events(spark, sf)), lambda p: live.history_sink(p, cap=20))
    return jobs.history(spark.read.parquet(out), "job_id", "ts", cap=20).select("job_id", "event_id")


@query("str4_live_ingest", f"""WITH RECURSIVE {_PARA.replace("replace(text, chr(10), chr(10) || chr(10))", "text")}, {_fold('doc_id', 2, 1, 500)}, {_chunks_sql('doc_id', 'chr(10) || chr(10)')}
SELECT doc_id, 'indexed' AS outcome, count(*) AS n_chunks FROM k GROUP BY doc_id UNION ALL SELECT doc_id, 'too_short', 0 FROM b WHERE length(t) < 50""")
def live_ingest(spark, sf):
    out = _run(spark, live.table_stream(spark, sf, "documents").select("doc_id", "text"), live.ingest_sink)
    good = spark.read.parquet(f"{out}/index").groupBy("doc_id").agg(F.lit("indexed").alias("outcome"), F.count(F.lit(1)).alias("n_chunks"))
    bad = spark.read.parquet(f"{out}/rejects").select("doc_id", F.col("reason").alias("outcome"), F.lit(0).cast("bigint").alias("n_chunks"))
    return good.unionByName(bad)


@query("str5_live_corrections", "SELECT user_id AS doc_id, event_id % 7 AS block_index, arg_max(event_type, (ts, event_id)) AS corrected, min(event_id) AS position FROM events GROUP BY user_id, event_id % 7")
def live_corrections(spark, sf):
    keys = ["doc_id", "block_index"]
    c = _events(spark, sf).select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).alias("block_index"), F.col("event_type").alias("corrected"), "ts", "event_id", F.col("event_id").alias("position"))
    out = _run(spark, c, lambda p: live.corrections_sink(p, keys, ["ts", "event_id"], "position"))
    return live.current_corrections(spark.read.parquet(out), keys, ["ts", "event_id"], "position").select(*keys, "corrected", "position")


@query("str6_live_metrics", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS name, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, round(sum(value / 10), 6) AS total_duration, round(max(value / 10), 6) AS max_duration,
 count(*) FILTER (WHERE value / 10 > 25) AS critical, count(*) FILTER (WHERE value / 10 <= 25 AND value / 10 > 20) AS warning FROM events GROUP BY date_trunc('hour', ts), event_type""")
def live_metrics(spark, sf):
    ops = _events(spark, sf).select("ts", F.col("event_type").alias("name"), (F.col("value") / 10).alias("duration"), (F.col("event_type") != "error").alias("success"))
    out = _run(spark, live.windowed_metrics(ops), live.batch_folder, "update")
    m = latest_by(spark.read.parquet(out), ["window_start", "name"], ["batch"])
    return m.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "name", "n", "failed", F.round("total_duration", 6).alias("total_duration"),
                    F.round("max_duration", 6).alias("max_duration"), "critical", "warning")


@query("str6_live_pairs", """
SELECT a.event_id // 2 AS op_id, 'op' || a.event_type AS name, b.value > 20 AS success, round(epoch_us(b.ts - a.ts) / 1e6::DOUBLE, 3) AS duration FROM events a JOIN events b ON a.event_id // 2 = b.event_id // 2 AND a.event_id % 2 = 0 AND b.event_id % 2 = 1
WHERE b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
def live_pairs(spark, sf):
    """Even events start an operation and the next odd event ends it."""
    events = _events(spark, sf)
    e = lambda k: events.where(F.col("event_id") % 2 == k).select(
        F.floor(F.col("event_id") / 2).alias("op_id"), "ts", F.concat(F.lit("op"), "event_type").alias("name"), (F.col("value") > 20).alias("success"))
    out = _run(spark, live.paired_streams(e(0), e(1)), live.batch_folder)
    return spark.read.parquet(out).select("op_id", "name", "success", F.round("duration", 3).alias("duration"))


#: Seconds a job may take, and how far behind a row may come, in the queries below.
_LONG, _LATE_MS = 5 * 86_400, 60_000


def _lives_sql(limit: int) -> str:
    """Every life of every job by windows: a creation starts one; its first end, its deadline or the next creation closes it."""
    return f"""WITH {_J}, w AS (SELECT (epoch_ms(max(ts)) - {_LATE_MS}) * 1000 AS seen FROM events),
i AS (SELECT j.*, epoch_us(j.ts) AS us, 'k' || event_id % 4 AS mk, sum(CASE WHEN kind = 'create' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY epoch_us(j.ts), event_id) AS life FROM j, w WHERE epoch_us(j.ts) <= seen),
l AS (SELECT *, created + {limit * 1_000_000} AS deadline, lead(created) OVER (PARTITION BY job_id ORDER BY life) AS next_created FROM (SELECT job_id, life, min(us) FILTER (WHERE kind = 'create') AS created FROM i WHERE life > 0 GROUP BY job_id, life)),
v AS (SELECT i.*, kind = 'update' AND (i.error IS NOT NULL OR stage = 'failed') AS fails, kind = 'update' AND i.error IS NULL AND stage = 'completed' AS done FROM i JOIN l USING (job_id, life) WHERE us <= deadline),
e AS (SELECT job_id, life, min((us, event_id)) AS last FROM v WHERE fails OR done GROUP BY job_id, life),
k AS (SELECT v.* FROM v LEFT JOIN e USING (job_id, life) WHERE last IS NULL OR (us, event_id) <= last),
m AS (SELECT job_id, life, string_agg(mk || '=' || message, ';' ORDER BY mk) AS metadata FROM (SELECT job_id, life, mk, arg_max(message, (us, event_id)) AS message FROM k GROUP BY job_id, life, mk) GROUP BY job_id, life),
st AS (SELECT job_id, life, max(us) AS updated, arg_max(CASE WHEN kind = 'create' THEN 'uploading' ELSE stage END, (us, event_id)) AS stage, arg_max(CASE WHEN kind = 'create' THEN 'Job created' ELSE message END, (us, event_id)) AS message,
        coalesce(arg_max(CASE WHEN done THEN 1.0 ELSE {_progress('stage', 'progress')} END, (us, event_id)) FILTER (WHERE kind = 'update' AND NOT fails), 0)::DOUBLE AS progress,
        arg_max(error, (us, event_id)) FILTER (WHERE fails) AS error, bool_or(done) AS completed, bool_or(fails) AS failed FROM k GROUP BY job_id, life),
r AS (SELECT st.*, created, deadline, metadata, NOT completed AND NOT failed AND least(coalesce(next_created, seen), seen) > deadline AS late, next_created FROM st JOIN l USING (job_id, life) JOIN m USING (job_id, life), w)
"""


def _lifecycle_sql(limit: int) -> str:
    note = f"Processing timeout: Job exceeded {limit // 60} minute time limit"
    at = lambda c: f"strftime(make_timestamp({c}), '%Y-%m-%d %H:%M:%S.%f')"
    return _lives_sql(limit) + f"""SELECT job_id, {at('created')} AS created_at, {at('CASE WHEN late THEN deadline ELSE updated END')} AS updated_at, CASE WHEN late THEN 'failed' ELSE stage END AS stage,
CASE WHEN late THEN 'Processing failed: {note}' ELSE message END AS message, round(progress, 6) AS progress, CASE WHEN late THEN '{note}' ELSE error END AS error, completed, failed OR late AS failed, metadata,
NOT completed AND NOT failed AND NOT late AS live FROM r WHERE completed OR failed OR late OR next_created IS NULL"""


def _lives(spark, sf, limit):
    """Ended jobs from the stream's sink and live ones from its state."""
    root = shared_dir(spark, "lifecycle")
    events = updates(_events(spark, sf)).withColumn("metadata", F.create_map(F.concat(F.lit("k"), F.col("event_id") % 4), F.col("message")))
    lifecycle.started(lifecycle.ended_jobs(events, limit), f"{root}/checkpoint", path=f"{root}/ended").awaitTermination()
    ended = spark.read.parquet(f"{root}/ended").withColumn("live", F.lit(False))
    rows = ended.unionByName(lifecycle.live_jobs(spark, f"{root}/checkpoint").withColumn("live", F.lit(True)))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("job_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("created_at", "updated_at")], "stage", "message", F.round("progress", 6).alias("progress"),
                       "error", "completed", "failed", pairs.alias("metadata"), "live")


@query("str1_job_lifecycle", _lifecycle_sql(_LONG))
def job_lifecycle(spark, sf):
    return _lives(spark, sf, _LONG)


@query("str2_job_expiry", _lifecycle_sql(jobs.TIMEOUT))
def job_expiry(spark, sf):
    return _lives(spark, sf, jobs.TIMEOUT)


@query("str3_history_state", "SELECT user_id AS job_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20")
def history_state(spark, sf):
    """The last updates of every job, read from the stream's state."""
    at = f"{shared_dir(spark, 'history')}/checkpoint"
    events = _events(spark, sf).withColumnRenamed("user_id", "job_id")
    lifecycle.started(lifecycle.bounded_history(events, 20, "event_type"), at, mode="update").awaitTermination()
    return lifecycle.kept_history(spark, at).select("job_id", "event_id", "event_type")


@query("str5_corrections_reindexed", """
WITH c AS (SELECT user_id AS doc_id, event_id % 7 AS b, repeat(arg_max(event_type, (ts, event_id)), 5) AS text, min(event_id) AS position FROM events GROUP BY user_id, event_id % 7),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS b FROM documents),
n AS (SELECT doc_id, b, coalesce(c.text, l.text) AS text, position FROM l FULL JOIN c USING (doc_id, b) WHERE doc_id IN (SELECT doc_id FROM documents)),
s AS (SELECT doc_id, b, text, position FROM n)
SELECT doc_id, count(*) FILTER (WHERE length(text) >= 20) AS n_chunks, md5(coalesce(string_agg(text, chr(10) ORDER BY b) FILTER (WHERE length(text) >= 20), '')) AS digest, count(position) AS corrected FROM s GROUP BY doc_id HAVING count(*) FILTER (WHERE length(text) >= 20) > 0""")
def corrections_reindexed(spark, sf):
    """Corrections arrive in three batches; texts and index of the documents they touch are replaced, what was corrected is read from the state."""
    root = shared_dir(spark, "corrections")
    docs = inputs.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_index", "text"))
    keyed.save(docs.withColumn("block_index", F.col("block_index").cast("long")), f"{root}/texts", "doc_id")
    index = lambda rows: rows.where(F.length("text") >= 20)
    keyed.save(index(docs.withColumn("block_index", F.col("block_index").cast("long"))), f"{root}/index", "doc_id")

    def save(rows, chunks):
        # Both are made from the present texts, so these are replaced last; a state that no one reads any more is dropped at once.
        for table, name in ((chunks, "index"), (rows, "texts")):
            keyed.save(table, f"{root}/{name}", "doc_id")
            keyed.vacuum(spark, f"{root}/{name}")

    present = lambda ids: keyed.load(spark, f"{root}/texts").join(ids, "doc_id", "left_semi")
    known = inputs.table(spark, sf, "documents").select("doc_id")
    c = _events(spark, sf).select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).alias("block_index"), F.repeat("event_type", 5).alias("corrected"), "ts", "event_id", F.col("event_id").alias("position"))
    stream = lifecycle.latest_corrections(c.join(known, "doc_id", "left_semi"))
    lifecycle.started(stream, f"{root}/checkpoint", mode="update", each=lifecycle.reindexing(present, index, save)).awaitTermination()
    marks = lifecycle.kept_corrections(spark, f"{root}/checkpoint").groupBy("doc_id").agg(F.count(F.lit(1)).alias("corrected"))
    rows = keyed.load(spark, f"{root}/index").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list(F.struct("block_index", "text"))).alias("r"))
    return rows.join(marks, "doc_id", "left").select("doc_id", "n_chunks", F.md5(F.array_join(F.transform("r", lambda x: x["text"]), "\n").cast("binary")).alias("digest"), F.coalesce("corrected", F.lit(0)).cast("bigint").alias("corrected"))


@query("str4_live_layouts", with_it(f"""
, b AS (SELECT doc_id, {s_strip('CASE WHEN html IS NOT NULL THEN html ELSE text END')} AS t FROM it),
n AS (SELECT doc_id, count(*) FILTER (WHERE t <> '') AS n_blocks, coalesce(sum(len(list_filter(string_split(t, chr(10)), lambda l: length(l) >= 20))), 0)::BIGINT AS n_chunks FROM b GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 3 THEN 'parse:not_json' WHEN d.doc_id % 10 = 5 THEN 'layout:no_items' WHEN d.doc_id % 10 = 9 THEN 'read:empty' WHEN d.doc_id % 10 = 7 OR n.doc_id IS NULL THEN 'regions:no_box'
 WHEN n_blocks = 0 THEN 'blocks:no_text' WHEN n_chunks = 0 THEN 'index:no_chunk' ELSE 'indexed' END AS outcome,
 CASE WHEN d.doc_id % 10 IN (3, 5, 7, 9) THEN 0 ELSE coalesce(n_blocks, 0) END AS n_blocks, CASE WHEN d.doc_id % 10 IN (3, 5, 7, 9) THEN 0 ELSE coalesce(n_chunks, 0) END AS n_chunks
FROM (SELECT DISTINCT doc_id FROM lr) d LEFT JOIN n USING (doc_id)"""))
def live_layouts(spark, sf):
    """Layout results in three batches, broken ones in each: their blocks, index and failures."""
    chunking.register_strategy("line", _by_line)
    k = F.col("doc_id") % 10
    made = writers.layout_results(inputs.item_pages(spark, sf).where(F.size("items") > 0))
    value = (F.when(k == 3, F.expr("substring(value, 1, length(value) - 3)")).when(k == 5, '{"other": [1]}').when(k == 9, " ")
             .when(k == 7, F.regexp_replace("value", r'"bbox":\[[^\]]*\]', '"bbox":[1,2,3]')).otherwise(F.col("value")))
    # The stream is laid out in several passes over its table; the texts are made once.
    files, _ = written(made.select("doc_id", value.alias("value"), F.timestamp_micros("doc_id").alias("ts")), "layout-texts")
    stream = live.replay(files, shared_dir(spark, "layouts"), "ts").select("doc_id", "value")
    out = _run(spark, stream, lambda p: ingest.layouts_sink(p, strategy="line"))
    count = lambda n: spark.read.parquet(f"{out}/{n}").groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"n_{n}"))
    failed = spark.read.parquet(f"{out}/failures").select("doc_id", F.concat_ws(":", "step", "reason").alias("outcome"))
    rows = files.select("doc_id").join(failed, "doc_id", "left").join(count("blocks"), "doc_id", "left").join(count("index"), "doc_id", "left")
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(n)
    return rows.select("doc_id", F.coalesce("outcome", F.lit("indexed")).alias("outcome"), zero("n_blocks", "n_blocks"), zero("n_index", "n_chunks"))
