"""Files in and out, and behaviour that only a run can show."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from pagegrain.functions.clean import let
from pagegrain.operators import skew
from pagegrain.plans import stages
from pagegrain.session import shared_dir
from pagegrain.sources import keyed, readers, spread, writers


def test_uploads(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.png": b"\x89PNG\r\n\x1a\nzz", "c.jpg": b"nope", "d.exe": b"MZ", "e.pdf": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in readers.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": None, "b.png": None, "c.jpg": "signature_mismatch", "d.exe": "unsupported_type", "e.pdf": "empty"}
    row = spark.createDataFrame([("up/e.pdf", 0, b"")], "path string, length long, content binary")
    assert readers.judged_uploads(row).first().reason == "empty"


def test_layout_items_of_three_shapes(spark, tmp_path):
    item = {"type": "title", "bbox": [100, 50, 500, 80], "score": 0.95, "res": [{"text": "T"}]}
    (tmp_path / "j1_layout.json").write_text(json.dumps({"items": [item]}))
    (tmp_path / "j2.json").write_text(json.dumps({"res": [item, item]}))
    (tmp_path / "j3.json").write_text(json.dumps([item]))
    rows = readers.layout_items(spark, str(tmp_path)).collect()
    assert sorted((r.job_id, r.ord) for r in rows) == [("j1", 0), ("j2", 0), ("j2", 1), ("j3", 0)]
    assert rows[0].bbox == [100.0, 50.0, 500.0, 80.0] and rows[0].score == "0.95"


def test_saving_some_keeps_the_rest(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit("_chunk_0")).alias("chunk_id"), F.lit("t").alias("text"))
    path = str(tmp_path / "index")
    for _ in range(2):
        writers.write_index(rows, path)
    writers.write_index(rows.where("doc_id = 7").withColumn("text", F.lit("new")), path)
    writers.delete_from_index(rows.where("doc_id = 8"), path)
    for vacuumed in (False, True):
        got = {r.doc_id: r.text for r in keyed.load(spark, path).collect()}
        assert got == {i: "new" if i == 7 else "t" for i in range(50) if i != 8}
        if not vacuumed:
            keyed.vacuum(spark, path)
    writers.delete_from_index(rows, path)
    assert keyed.load(spark, path).count() == 0 and keyed.load(spark, path).columns == rows.columns
    writers.write_results(rows, str(tmp_path / "results"), "doc_id")
    writers.write_results(rows.where("doc_id = 7").withColumn("text", F.lit("a\n\"b\"")), str(tmp_path / "results"), "doc_id")
    got = {r.doc_id: r.text for r in keyed.load(spark, str(tmp_path / "results")).collect()}
    assert len(got) == 50 and got[7] == 'a\n"b"'


def test_a_first_save_writes_its_rows_once(spark, tmp_path):
    rows = spark.range(5).selectExpr("id AS k", "'a' AS t")
    keyed.save(rows, f"{tmp_path}/t", "k")
    assert not (tmp_path / "t/staged").exists() and {tuple(r) for r in keyed.load(spark, f"{tmp_path}/t").collect()} == {(i, "a") for i in range(5)}
    keyed.save(spark.createDataFrame([(2, "b"), (9, "b")], "k long, t string"), f"{tmp_path}/t", "k")
    keyed.remove(rows.where("k = 4"), f"{tmp_path}/t", "k")
    assert {tuple(r) for r in keyed.load(spark, f"{tmp_path}/t").collect()} == {(0, "a"), (1, "a"), (2, "b"), (3, "a"), (9, "b")}


def test_layout_results_keep_nulls_and_quotes(spark):
    items = spark.createDataFrame([(1, [("ti\"t\\le", 1.0, 2.0, 3.0, 4.0, "a\nb", None, 0.5), (None, 1.0, 2.0, 3.0, 4.0, None, "<table>", None)])],
                                  "doc_id long, items array<struct<type:string,x1:double,y1:double,x2:double,y2:double,text:string,html:string,confidence:double>>")
    record = json.loads(writers.layout_results(items).first()["value"])
    assert record["total_items"] == 2 and [i["type"] for i in record["items"]] == ['ti"t\\le', None]
    assert record["items"][0]["res"][0] == {"text": "a\nb", "confidence": 0.5} and record["items"][1]["res"]["html"] == "<table>"


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    from pagegrain.streaming import live
    sink = live.corrections_sink(str(tmp_path / "c"), ["k"], ["ts"], "position")
    first, second = (spark.createDataFrame(rows, "k long, v string, ts long, position long") for rows in ([(1, "a", 1, 1), (2, "b", 1, 2)], [(1, "c", 2, 3)]))
    for df, batch in ((first, 0), (second, 1), (second, 1)):
        sink(df, batch)
    got = live.current_corrections(spark.read.parquet(str(tmp_path / "c")), ["k"], ["ts"], "position").collect()
    assert sorted((r.k, r.v, r.position) for r in got) == [(1, "c", 1), (2, "b", 2)]


def test_vector_count_mismatch_is_an_error(spark):
    bad = spark.createDataFrame([(1, ["a", "b"], [[0.1]])], "doc_id long, texts array<string>, vectors array<array<float>>")
    with pytest.raises(Exception, match="differ in number"):
        writers.checked_vectors(bad, "texts", "vectors").collect()


def test_running_total_of_a_hot_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("t"))
    got = skew.running_total(df, ["k"], "t", F.lit(1), F.floor(F.col("t") / 50), "n").where("k = 'hot'").orderBy("t").collect()
    assert [r.n for r in got] == list(range(1, len(got) + 1))


def test_rank_filter_runs_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = skew.last_n(df, ["k"], [F.col("id").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_no_cross_join_in_spatial_plans(spark, sf):
    from pagegrain.plans.registry import load_all
    for name in ("jn1_region_line_confidence", "jn2_region_line_overlap", "jn4_lines_outside_regions", "top1_nearest_chunks"):
        plan = load_all()[name].build(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_stage_counts_and_tracking(spark):
    out, seen = stages.run_stages(spark.range(10), {"even": lambda d: d.where("id % 2 = 0"), "big": lambda d: d.where("id > 3")})
    assert out.count() == 3
    assert (seen["even"].get["rows"], seen["big"].get["rows"]) == (5, 3)
    assert stages.tracked("ok", lambda: None)["success"] and "ZeroDivisionError" in stages.tracked("bad", lambda: 1 / 0)["error"]


def test_compositions(spark, sf):
    from pagegrain.plans import inputs
    scored = stages.scored_documents(inputs.lr(spark, sf), inputs.ll(spark, sf))
    assert scored.where("overall < 0 OR overall > 1").isEmpty() and scored.count() == inputs.lr(spark, sf).select("doc_id").distinct().count()
    assert stages.typed_blocks(inputs.lr(spark, sf)).where("data IS NULL").isEmpty()
    rows = stages.indexed_texts(inputs.table(spark, sf, "documents"))
    assert rows.where(F.size("embedding") != 512).isEmpty()
    assert stages.workbench_markdown(inputs.item_pages(spark, sf)).where("markdown NOT LIKE '<!-- @block:block_001%'").where("markdown <> ''").isEmpty()


def test_shared_folder_is_used_when_named():
    class Named:
        sparkContext = None

        class conf:
            get = staticmethod(lambda key, default=None: "/shared/cp" if key == "spark.checkpoint.dir" else default)

    assert shared_dir(Named, "x").startswith("/shared/cp/x-")


def test_an_unset_folder_is_an_error_on_a_cluster():
    class Unset:
        class sparkContext:
            master = "yarn"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Unset, "x")


def test_user_encoder_and_query_instruction(spark):
    from pagegrain.operators import retrieval
    seen = retrieval.encode(spark.createDataFrame([(1, "abc")], "id int, text string"), is_query=True, instruction="find: ",
                            encoder=lambda df, c: df.withColumn("embedding", F.array(F.length(c).cast("float")))).first()
    assert seen.embedding == [9.0] and seen.text == "abc"


def test_let_binds_once(spark):
    assert spark.range(1).select(let(F.rand(1), lambda v: v == v).alias("same")).first().same


def test_replay_keeps_rows_without_a_time(spark, tmp_path):
    from pagegrain.streaming import live
    rows = [(i, None if i % 10 == 0 else f"2024-01-{1 + i // 4:02d} 00:00:00") for i in range(40)]
    table = spark.createDataFrame(rows, "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3)
    s = live.replay(table, str(tmp_path / "in"), "ts")
    live.run_available(s, live.batch_folder(str(tmp_path / "out")), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("event_id", "batch", "ts").collect()
    assert sorted(r.event_id for r in got) == list(range(40))
    assert {r.batch for r in got if r.ts is None} == {0} and {r.batch for r in got} == {0, 1, 2}
    assert all(max(r.ts for r in got if r.ts and r.batch == b) < min(r.ts for r in got if r.ts and r.batch == b + 1) for b in (0, 1))


def test_an_encoder_loads_once_a_worker_and_takes_small_batches(spark, tmp_path):
    from pagegrain.operators import retrieval
    log = str(tmp_path)

    def load():
        import os
        import uuid
        open(f"{log}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            open(f"{log}/batch-{len(texts)}-{uuid.uuid4().hex}", "w").close()
            return [[len(t), 1.0] for t in texts]
        return model

    encoder = retrieval.batched(log, load)
    frame = spark.createDataFrame([(i, None if i == 7 else "x" * i) for i in range(100)], "i int, text string").repartition(4)
    for _ in range(2):
        got = {r.i: r.embedding for r in retrieval.encode(frame, encoder=encoder).select("i", "embedding").collect()}
        assert got == {i: None if i == 7 else [float(i), 1.0] for i in range(100)}
    names = [p.name.split("-") for p in tmp_path.iterdir()]
    loads = [n[1] for n in names if n[0] == "load"]
    assert loads and len(loads) == len(set(loads))
    assert all(int(n[1]) <= 32 for n in names if n[0] == "batch")


def test_files_dealt_over_folders(spark, tmp_path):
    rows = [(f"{i}.txt", f"a {i}\n\n" if i % 3 else "") for i in range(300)] + [("none.txt", None)]
    assert spread.save(spark.createDataFrame(rows, "name string, value string").repartition(7), f"{tmp_path}/f") == 301
    # many files share a folder, and each is whole and exact
    assert len(list((tmp_path / "f").iterdir())) <= spread.FOLDERS and (tmp_path / f"f/{spread.folder_of('7.txt')}/7.txt").read_bytes() == b"a 7\n\n"
    assert {tuple(r) for r in spread.texts(spark, f"{tmp_path}/f").collect()} == {(n, v or "") for n, v in rows}
    assert {r.job_id for r in readers.spread_texts(spark, f"{tmp_path}/f", "t").where("t = ''").collect()} == {"none", *(str(i) for i in range(0, 300, 3))}


@pytest.mark.parametrize("name", ["src2_layout_files", "src3_raw_lines", "src4_text_preference"])
def test_no_folder_is_made_for_a_single_file(spark, sf, name, tmp_path, monkeypatch):
    from pagegrain.plans import files
    monkeypatch.setattr(files, "shared_dir", lambda s, label: f"{tmp_path}/{label}")
    from pagegrain.plans.registry import load_all
    assert load_all()[name].build(spark, sf).count() > 0
    assert all(len(list(root.iterdir())) <= 1024 and not any("=" in p.name for p in root.iterdir()) for root in tmp_path.iterdir())


def test_texts_of_files_are_not_broadcast(spark, tmp_path):
    files = {}
    for n, rows in {"a": [(1, "x"), (2, "")], "b": [(1, "y"), (2, "z")]}.items():
        spread.save(spark.createDataFrame([(f"{j}.txt", t) for j, t in rows], "name string, value string"), f"{tmp_path}/{n}")
        files[n] = readers.spread_texts(spark, f"{tmp_path}/{n}", n)
    out = readers.first_content(spark.createDataFrame([("1",), ("2",), ("3",)], "job_id string"), "job_id", **files)
    assert sorted(tuple(r) for r in out.collect()) == [("1", "a", "x"), ("2", "b", "z"), ("3", None, None)]
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


def _shuffles(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {n for n in (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())) if n.startswith("shuffle_")}


def test_saving_keeps_no_shuffle_files(spark, tmp_path):
    before = _shuffles(spark)
    keyed.save(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), str(tmp_path / "t"), "doc_id")
    deadline = time.time() + 20
    while _shuffles(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not _shuffles(spark) - before


def test_corrections_leave_one_state_of_texts_and_index(spark, sf, tmp_path, monkeypatch):
    from pagegrain.plans import streams
    from pagegrain.plans.registry import load_all
    monkeypatch.setattr(streams, "shared_dir", lambda s, label: f"{tmp_path}/{label}")
    assert load_all()["str5_corrections_reindexed"].build(spark, sf).count() > 0
    for table in ("texts", "index"):
        root = tmp_path / "corrections" / table
        assert not (root / "staged").exists() and len(list((root / "data").iterdir())) == len({s.folder for s in keyed._state(spark, str(root))}) <= 4
