"""Stateful streams over batches written by hand: order, lateness, deadlines, replays."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagegrain.plans.registry import load_all
from pagegrain.sources import uploads
from pagegrain.streaming import ingest, lifecycle, live

T0 = datetime(2024, 1, 1)
JOB = "job_id string, ts timestamp, event_id long, kind string, stage string, progress double, message string, error string, metadata map<string,string>"


@pytest.fixture
def stream_of(spark, tmp_path):
    """A stream that takes one of the given batches at a time."""
    def make(schema, *batches):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            os.utime(next(p for p in (tmp_path / f"in/{i}").iterdir() if p.suffix == ".parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    return make


def event(job, at, i, kind="update", stage="ocr_processing", progress=0.5, error=None, **metadata):
    return (job, None if at is None else T0 + timedelta(seconds=at), i, kind, stage, progress, f"m{i}", error, metadata)


def test_job_lifecycle(spark, tmp_path, stream_of):
    batches = [
        [event("a", 10, 2, a="1"), event("a", 0, 1, "create", source="up"), event("x", 5, 3), event("b", None, 4)],
        [event("a", 5, 5, a="0", b="2", stage="validating"), event("b", 60, 6, "create"), event("c", 61, 7, "create"), event("c", 62, 8, stage="failed", error="bad")],
        [event("b", 100, 9, stage="completed", done="yes"), event("b", 101, 10, stage="validating"), event("d", 400, 11, "create"), event("d", 500, 12, progress=1.0), event("d", 650, 13, "create", again="1"), event("e", 1000, 14, "create")],
        [event("e", 1001, 17, progress=0.25)],
        # behind the watermark that the batch before has settled: left out
        [event("b", 90, 15, late="1"), event("a", 20, 16, "create"), event("f", 1100, 18, "create")]]
    stream = lifecycle.ended_jobs(stream_of(JOB, *batches), limit=300)
    run = lambda: lifecycle.started(stream, f"{tmp_path}/checkpoint", path=f"{tmp_path}/ended").awaitTermination()
    run()

    def seen():
        ended = {r.job_id: r for r in spark.read.parquet(f"{tmp_path}/ended").collect()}
        return ended, {r.job_id: r for r in lifecycle.live_jobs(spark, f"{tmp_path}/checkpoint").collect()}

    ended, live = seen()
    assert sorted(ended) == ["a", "b", "c", "d"] and sorted(live) == ["e"]
    a, b, c, d = (ended[k] for k in "abcd")
    # the row at 5 s came a batch later than the row at 10 s and still precedes it
    assert (a.stage, a.failed, a.metadata) == ("failed", True, {"source": "up", "a": "1", "b": "2"})
    assert a.updated_at == T0 + timedelta(seconds=300) and a.error == "Processing timeout: Job exceeded 5 minute time limit" and round(a.progress, 6) == 0.5
    assert (b.completed, b.failed, b.progress, b.metadata) == (True, False, 1.0, {"done": "yes"})
    assert (c.failed, c.error, c.progress) == (True, "bad", 0.0)
    # created anew at 650: the first life's metadata and time are gone; it ends 300 s after the second creation
    assert d.created_at == T0 + timedelta(seconds=650) and d.updated_at == T0 + timedelta(seconds=950) and d.metadata == {"again": "1"}
    assert (live["e"].stage, round(live["e"].progress, 6)) == ("ocr_processing", 0.425)
    # a batch that runs again after its commit was lost ends in the same state
    commits = sorted((p for p in (tmp_path / "checkpoint/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "checkpoint/commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    run()
    assert seen() == (ended, live)


def test_history_and_corrections_in_any_order(spark, tmp_path, stream_of):
    rows = [("k", T0 + timedelta(seconds=(i * 7) % 50), i, f"v{i}") for i in range(50)] + [("k", T0, 0, "v0"), (None, T0, 1, "x"), ("k", None, 2, "x")]
    s = stream_of("job_id string, ts timestamp, event_id long, value string", rows[:20], rows[20:])
    lifecycle.started(lifecycle.bounded_history(s, 5, "value"), f"{tmp_path}/h", mode="update").awaitTermination()
    got = sorted((r.ts, r.event_id, r.value) for r in lifecycle.kept_history(spark, f"{tmp_path}/h").collect())
    assert got == sorted((t, i, v) for k, t, i, v in rows if k and t)[-5:]


def test_broken_layouts_give_one_row_each(spark, tmp_path):
    good = '{"items": [{"type": "text", "bbox": [0, 0, 9, 9], "res": [{"text": "' + "word " * 30 + '"}]}, {"type": "text", "bbox": null, "res": []}]}'
    rows = [(1, good), (2, "{"), (3, None), (4, "7"), (5, '{"items": [{"bbox": [1, 2]}]}'), (6, '{"items": [{"type": "text", "bbox": [0, 0, 1, 1], "res": [{"text": " "}]}]}'),
            (7, good.replace("word " * 30, "short")), (8, "[]")]
    sink = ingest.layouts_sink(str(tmp_path))
    frame = spark.createDataFrame(rows, "doc_id long, value string")
    for _ in range(2):  # the second run is the same batch again
        sink(frame, 0)
        failed = {r.doc_id: (r.step, r.reason) for r in spark.read.parquet(f"{tmp_path}/failures").collect()}
        assert failed == {2: ("parse", "not_json"), 3: ("read", "empty"), 4: ("layout", "no_items"), 5: ("regions", "no_box"), 6: ("blocks", "no_text"), 7: ("index", "no_chunk"), 8: ("regions", "no_box")}
        assert [r.doc_id for r in spark.read.parquet(f"{tmp_path}/index").collect()] == [1]
        assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/blocks").collect()) == [1, 7]


def test_uploads_are_listed_with_their_first_bytes(spark, tmp_path):
    folder = f"file://{tmp_path}/up"
    names = [(f"{i}.pdf", bytes([i]) * i) for i in range(30)] + [("none.png", None)]
    assert uploads.save(spark.createDataFrame(names, "name string, content binary").repartition(3), folder) == 31
    got = {r.path.rsplit("/", 1)[1]: (r["length"], bytes(r.content)) for r in uploads.listed(spark, folder, files=7).collect()}
    assert got == {n: (len(c or b""), (c or b"")[:8]) for n, c in names}
    (tmp_path / "empty").mkdir()
    assert uploads.listed(spark, str(tmp_path / "empty")).where(F.lit(True)).collect() == []


def test_a_stream_over_a_table_of_one_file_or_many(spark, tmp_path):
    rows = spark.range(40).withColumnRenamed("id", "doc_id")
    rows.repartition(7).write.parquet(f"{tmp_path}/many/documents.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "one/documents.parquet")
    rows.write.parquet(f"{tmp_path}/many/documents_old.parquet")
    for folder, batches in (("many", 3), ("one", 1)):
        seen = []
        stream = live.table_stream(spark, f"{tmp_path}/{folder}", "documents")
        live.run_available(stream, lambda df, n: seen.append(sorted(r.doc_id for r in df.collect())), f"{tmp_path}/{folder}-checkpoint").awaitTermination()
        assert len(seen) == batches and sorted(sum(seen, [])) == list(range(40))


def test_a_job_asks_little_of_its_state():
    """Rows that come cost no reading of the rows that wait; a timer that is due earlier stays."""
    from types import SimpleNamespace

    from pagegrain.streaming.lifecycle import _FIELDS, JobLifecycle
    calls, timers = [], []
    noted = lambda name, f=lambda *a: None: lambda *a: (calls.append(name), f(*a))[1]
    p = JobLifecycle(300)
    p.handle = SimpleNamespace(listTimers=noted("list", lambda: list(timers)), registerTimer=noted("register", timers.append), deleteTimer=noted("delete", timers.remove))
    p.waiting = SimpleNamespace(exists=noted("exists", lambda: True), get=noted("get", lambda: iter(())), appendList=noted("append"))
    p.job = SimpleNamespace(exists=noted("exists", lambda: False), get=noted("get"))
    row = lambda at: dict.fromkeys(_FIELDS) | {"at": at}
    for at in (5_000_000, 9_000_000, 2_000_000):
        list(p.handleInputRows(("j",), iter([row(at)]), None))
    assert timers == [2000] and calls == ["append", "list", "register", "append", "list", "append", "list", "delete", "register"]


def test_layout_texts_of_the_stream_are_made_once(spark, sf, monkeypatch):
    """The table that is laid out in several passes is a written one, not the query that makes the texts."""
    plans, replay = [], live.replay

    def spied(table, *args, **more):
        plans.append(table._jdf.queryExecution().optimizedPlan().toString())
        return replay(table, *args, **more)

    monkeypatch.setattr(live, "replay", spied)
    assert load_all()["str4_live_layouts"].build(spark, sf).count() > 0
    assert len(plans) == 1 and "json" not in plans[0]
