"""Literal cases, one per rule, with the values the rules must give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagegrain.functions import classify, clean, grids, labels, markdown, vectors
from pagegrain.functions.clean import edit_ratio
from pagegrain.functions.text import middles
from pagegrain.operators import blocks, chunking, confidence, documents, integrity, jobs, layout, nested, prompts, retrieval, skew, spatial, tables
from pagegrain.sources import readers


def one(spark, **cols):
    """Evaluate expressions on a single row."""
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_control_characters_are_removed(spark):
    r = one(spark, t=clean.normalize_unicode(F.lit("Hello\x01\x02World\x7f")), q=clean.normalize_unicode(F.lit("“a” — b… c­")))
    assert r.t == "HelloWorld"
    assert r.q == '"a" -- b... c'


def test_corruption(spark):
    r = one(spark, a=clean.corruption(F.lit("clean text")), b=clean.corruption(F.lit("bad �� text")), c=clean.corruption(F.lit("你好世界"), True))
    assert not r.a.is_corrupted and r.a.confidence == 1.0
    assert r.b.is_corrupted and r.b.replacement_chars == 2
    assert r.c.issues == 2  # two charsets cannot hold it; the run itself is ignored


def test_change_count(spark):
    r = one(spark, r=clean.text_integrity(F.lit("Hello world"), F.lit("Hello world!"))).r
    assert (r.length_change, r.character_changes) == (1, 1) and r.integrity_score > 0.9


def test_whitespace_is_not_a_difference(spark):
    r = one(spark, same=clean.comparable(F.lit("Hello    World")) == clean.comparable(F.lit("Hello World")), ratio=clean.similarity_ratio(F.lit("abcd"), F.lit("bcde")))
    assert r.same and r.ratio == pytest.approx(0.75)


def test_repair_order(spark):
    assert one(spark, t=clean.repaired(F.lit("0pen  1t modern vvord,,"))).t == "Open It modem word,"


def test_redaction(spark):
    r = one(spark, t=clean.redacted(F.lit("a.b@x.com 123-45-6789 555-123-4567 4111-1111-1111-1111 in /etc/passwd")))
    assert r.t.startswith("[EMAIL] [SSN] [PHONE] [CARD] in /[PATH_HASH_") and "passwd" not in r.t


def test_label_map(spark):
    raw = ["title", "doc_title", "header", "footer", "figure", "equation", "unknown_type"]
    got = [one(spark, t=labels.display_type(F.lit(x))).t for x in raw]
    assert got == ["title", "title", "header", "footer", "figure", "equation", "text"]


def test_bands_are_monotone(spark):
    order = {"very_poor": 0, "poor": 1, "fair": 2, "good": 3, "excellent": 4}
    rows = spark.range(0, 101).select(labels.confidence_band(F.col("id") / 100).alias("b")).collect()
    ranks = [order[r.b] for r in rows]
    assert ranks == sorted(ranks) and set(ranks) == set(order.values())


def test_block_ids(spark):
    ids = [r[0] for r in spark.range(0, 1200).select(markdown.block_id(F.col("id"))).collect()]
    assert ids[0] == "block_001" and ids[9] == "block_010" and ids[14] == "block_015" and ids[999] == "block_1000"


def test_anchor_parse_order_and_old_formats(spark):
    text = "<!-- @block:block_003 1,2,3,4 -->\nx\n<!-- @block:block_001 5,6,7,8 -->\n<!-- block:old 1,2,3,4 --> <a id='block_9'></a>\n<!-- @block:block_002 9,9,9,9 -->"
    a = one(spark, a=markdown.parsed_anchors(F.lit(text))).a
    assert [x.block_id for x in a] == ["block_003", "block_001", "block_002"]
    assert [x.position for x in a] == [text.index("<!-- @block:" + x.block_id) for x in a]
    assert (a[0].x, a[0].y, a[0].width, a[0].height) == (1, 2, 3, 4)
    bad = ["<!-- @block:a 1,2,3 -->", "<!-- @block:a -1,2,3,4 -->", "<!--@block: 1,2,3,4-->", "<!-- block:a 1,2,3,4 -->"]
    assert not any(one(spark, v=markdown.is_anchor(F.lit(b))).v for b in bad)


def test_anchor_round_trip_on_every_document(spark, sf):
    from pagegrain.plans.markdown import _parts, _rows
    emitted = _rows(spark, sf).where("x >= 0 AND y >= 0").select("doc_id", "block_id", "x", "y", "width", "height", F.col("position").cast("bigint"))
    parsed = documents.anchors(documents.anchored_markdown(_parts(spark, sf))).select("doc_id", "block_id", "x", "y", "width", "height", F.col("position").cast("bigint"))
    assert emitted.exceptAll(parsed).isEmpty() and parsed.exceptAll(emitted).isEmpty()


def test_as_of_is_nearest_before(spark, sf):
    from pagegrain.plans.markdown import _rows
    marks = _rows(spark, sf).select("doc_id", "position", "block_id")
    cursors = spark.range(0, 4000, 37).select(F.lit(3).cast("bigint").alias("doc_id"), F.col("id").alias("position"))
    got = {r.position: r.b for r in skew.as_of(cursors, marks, ["doc_id"], "position", F.col("block_id"), lambda c: F.floor(c / 64), "b").collect()}
    at = sorted((r.position, r.block_id) for r in marks.where("doc_id = 3").collect())
    for pos, b in got.items():
        before = [x for x in at if x[0] <= pos]
        assert b == (before[-1][1] if before else None)


def test_zoom_is_linear(spark):
    b = spark.createDataFrame([(1.0, 2.0, 5.0, 8.0)], "x1 double, y1 double, x2 double, y2 double")
    r, q = layout.zoomed(b, 50.0).first(), layout.zoomed(b, 200.0).first()
    assert (q.zx, q.zy, q.zw, q.zh) == (r.zx * 4, r.zy * 4, r.zw * 4, r.zh * 4)


def test_region_confidence_matches_brute_force(spark, sf):
    from pagegrain.plans import inputs
    regions, lines = inputs.lr(spark, sf), inputs.ll(spark, sf)
    got = {(r.doc_id, r.ord): r.confidence for r in spatial.region_confidence(regions, lines, tile=(50.0, 40.0)).collect()}
    by_doc: dict = {}
    for l in lines.collect():
        by_doc.setdefault(l.doc_id, []).append(l)
    for r in regions.collect():
        hit = []
        for l in by_doc[r.doc_id]:
            w, h = min(r.x2, l.x2) - max(r.x1, l.x1), min(r.y2, l.y2) - max(r.y1, l.y1)
            inter = w * h if w > 0 and h > 0 else 0
            union = (r.x2 - r.x1) * (r.y2 - r.y1) + (l.x2 - l.x1) * (l.y2 - l.y1) - inter
            inside = r.x1 <= (l.x1 + l.x2) / 2 <= r.x2 and r.y1 <= (l.y1 + l.y2) / 2 <= r.y2
            if (inside or inter / union > 0.3) and l.confidence is not None:
                hit.append(l.confidence)
        want = sum(hit) / len(hit) if hit else None
        assert got[r.doc_id, r.ord] == (None if want is None else pytest.approx(want))


def test_list_parsing(spark):
    r = one(spark, i=classify.list_items(F.lit("• one\n- two\n3. three\n12345. four\n\n*")), s=classify.list_style(F.lit("1. a\n2. b\nc")), u=classify.list_style(F.lit("1. a\nb\nc")))
    assert r.i == ["one", "two", "three", "12345. four"]
    assert (r.s, r.u) == ("ordered", "unordered")


def test_font_size_tie_takes_smaller(spark):
    r = one(spark, a=classify.font_size(F.lit("x"), F.lit(17.4)), b=classify.font_size(F.lit("x"), F.lit(1000.0)), c=classify.font_size(F.lit(""), F.lit(5.0)))
    assert (r.a, r.b, r.c) == (12, 72, 14)


def test_document_confidence_of_a_small_page(spark):
    rows = [(1, "header", "Title", 0.9, 0.0, 0.0, 100.0, 20.0), (1, "paragraph", "Body text", 0.8, 0.0, 30.0, 100.0, 60.0), (1, "table", "", None, 0.0, 70.0, 5.0, 75.0)]
    d = confidence.document_confidence(spark.createDataFrame(rows, "doc_id long, region_type string, content string, confidence double, x1 double, y1 double, x2 double, y2 double")).first()
    assert d.text_confidence == pytest.approx(0.85)
    lay = 0.5 * 2 / 3 + 0.3 * 2 / 3 + 0.2
    assert d.layout_confidence == pytest.approx(lay) and d.overall == pytest.approx(0.7 * 0.85 + 0.3 * lay)


def test_complex_table(spark):
    t = lambda a: one(spark, c=grids.is_complex(F.lit(f"<table><tr><td{a}>x</td></tr></table>"))).c
    assert t(' colspan="2"') and t(" rowspan='3'") and not t(' colspan="1"') and not t(' colspan="x" rowspan="2"') and not t("")


def test_grid_round_trip(spark):
    g = F.array(F.array(F.lit("Header 1"), F.lit("Header 2")), F.array(F.lit("Data 1"), F.lit("Data 2")))
    r = one(spark, g=grids.from_html(grids.to_html(g, F.lit(True))), h=grids.has_header(g), n=grids.from_html(F.lit("no table")))
    assert r.g == [["Header 1", "Header 2"], ["Data 1", "Data 2"]] and r.h and r.n == [["no table"]]


def test_numeric_cells(spark):
    got = [one(spark, n=grids.is_numeric(F.lit(x))).n for x in ("1,234.5", "$5", "12%", "abc", "1_000", "", "5d")]
    assert got == [True, True, True, False, False, False, False]


def test_chunker_bounds(spark):
    text = " ".join(f"Sentence number {i} has a few words." for i in range(40))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "Short text only.")], "doc_id long, text string")
    for s in ("fixed", "paragraph", "sentence", "mixed"):
        rows = chunking.chunks(df, "doc_id", strategy=s, size=100, overlap=20, minimum=10).collect()
        assert not [r for r in rows if r.doc_id == 2]
        assert [r.idx for r in rows if r.doc_id == 3] == [0]
    fixed = chunking.chunks(df, "doc_id", strategy="fixed", size=100, overlap=20, minimum=10).where("doc_id = 1").collect()
    assert all(len(r.content) <= 150 for r in fixed) and fixed[-1].end_char == len(text)
    for r in fixed:
        assert text[r.start_char:r.end_char].strip() == r.content
    sentences = chunking.chunks(df, "doc_id", strategy="sentence", size=100, minimum=10).where("doc_id = 1").collect()
    assert all(len(r.content) <= 100 for r in sentences)


def test_fixed_chunks_end_on_short_text(spark):
    df = spark.createDataFrame([(1, "tiny"), (2, "x" * 510)], "doc_id long, text string")
    assert [(r.doc_id, r.start_char, r.end_char) for r in chunking.chunks(df, "doc_id", strategy="fixed").collect()] == [(2, 0, 500), (2, 450, 510)]


def test_paged_chunks_number_on(spark):
    p = spark.createDataFrame([("d", i, f"This is the only sentence on page {i}, long enough to stay.") for i in (1, 2, 3)], "job string, page int, text string")
    rows = chunking.page_chunks(p, "job", "page", width=2).orderBy("idx").collect()
    assert [(r.idx, r.page) for r in rows] == [(0, 1), (1, 2), (2, 3)]


def test_vector_top_k(spark):
    v = lambda x: [x] + [0.1] * 511
    chunks = spark.createDataFrame([("a", 1, v(0.9)), ("b", 1, v(0.8)), ("c", 1, [0.1] * 512)], "chunk_id string, job int, embedding array<float>")
    q = spark.createDataFrame([(7, 1, v(0.85))], "query_id int, job int, query_vector array<float>")
    hits = retrieval.similar(q, chunks, ["job"], k=2).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == ["a", "b"] or {h.chunk_id for h in hits} == {"a", "b"}
    assert one(spark, s=vectors.score(F.lit(0.1))).s == pytest.approx(0.9)
    assert one(spark, c=vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).c == 0.0


@pytest.mark.parametrize("parts", [1, 3])
def test_a_hot_collection_may_be_dealt_over_parts(spark, parts):
    chunks = spark.createDataFrame([("a", 1, [0.5]), ("b", 2, [0.1])], "chunk_id string, job int, embedding array<float>")
    q = spark.createDataFrame([(7, 1, [0.4])], "query_id int, job int, query_vector array<float>")
    assert [h.chunk_id for h in retrieval.similar(q, chunks, ["job"], parts=parts).collect()] == ["a"]


def test_equal_times_go_by_arrival(spark):
    rows = [(1, "j", 1.0, "create", None, 0.0, "c", None), (3, "j", 2.0, "update", "completed", 1.0, "late", None), (2, "j", 2.0, "update", "ocr_processing", 0.5, "early", None)]
    for order in (rows, rows[::-1]):
        assert jobs.job_states(_events(spark, order).repartition(3)).first().message == "late"


def test_caps_are_arguments(spark):
    many = spark.range(1200).select(F.col("id").alias("event_id"), F.lit("j").alias("job"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("v"))
    assert jobs.history(many, "job", "ts").count() == 1200 and jobs.history(many, "job", "ts", cap=5).count() == 5
    newest = [F.col("event_id").desc()]
    assert jobs.metric_summary(many, "job", "v", newest).first()["count"] == 1200 and jobs.metric_summary(many, "job", "v", newest, cap=7).first()["count"] == 7
    assert jobs.trimmed_metrics(many, newest).count() == 500 and jobs.trimmed_metrics(many.limit(1000), newest).count() == 1000


def test_progress_weights(spark):
    got = [one(spark, p=jobs.overall_progress(F.lit(s), F.lit(p))).p for s, p in (("uploading", 1.0), ("validating", 1.0), ("ocr_processing", 0.5), ("nowhere", 0.5), ("completed", 1.0))]
    assert got[:3] == [pytest.approx(0.1), pytest.approx(0.2), pytest.approx(0.5)] and got[3] == 0.0 and got[4] == pytest.approx(1.0)


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id int, job_id string, at double, kind string, stage string, progress double, message string, error string").withColumn("ts", F.timestamp_seconds("at"))


def test_job_states(spark):
    e = _events(spark, [
        (1, "a", 10.0, "create", None, None, None, None), (2, "a", 11.0, "update", "ocr_processing", 0.5, "half", None), (3, "a", 12.0, "update", "failed", 0.0, "broke", "boom"),
        (4, "b", 5.0, "update", "validating", 1.0, "early", None), (5, "b", 10.0, "create", None, None, None, None), (6, "c", 1.0, "update", "validating", 1.0, "unknown job", None)])
    s = {r.job_id: r for r in jobs.job_states(e).collect()}
    assert set(s) == {"a", "b"}
    assert (s["a"].stage, s["a"].failed, s["a"].error) == ("failed", True, "boom") and s["a"].progress == pytest.approx(0.5)
    assert (s["b"].stage, s["b"].progress, s["b"].message) == ("uploading", 0.0, "Job created")
    late = {r.job_id: r for r in jobs.timed_out(jobs.job_states(e), F.timestamp_seconds(F.lit(12.0)), limit=1).collect()}
    assert late["b"].failed and "timeout" in late["b"].error and late["a"].error == "boom"


def test_an_error_before_the_creation_is_not_the_jobs_error(spark):
    e = _events(spark, [(1, "a", 1.0, "update", "failed", 0.0, "old", "e1"), (2, "a", 2.0, "create", None, None, None, None), (3, "a", 3.0, "update", "failed", 0.0, "new", None),
                        (4, "b", 1.0, "create", None, None, None, None), (5, "b", 2.0, "update", "ocr_processing", 0.0, "first", "e5"), (6, "b", 3.0, "update", "failed", 0.0, "second", None)])
    s = {r.job_id: r for r in jobs.job_states(e).collect()}
    assert (s["a"].failed, s["a"].message, s["a"].error) == (True, "new", None) and s["b"].error == "e5"


def test_operation_summary(spark):
    ops = spark.createDataFrame([("a", 1.0, 10.0, True), ("a", 0.0, None, True), ("b", 3.0, 30.0, True), ("b", 2.0, 20.0, False)], "name string, duration double, memory_mb double, success boolean")
    s = jobs.operation_summary(ops).first()
    assert (s.total, s.successful, s.failed) == (4, 3, 1) and s.mean_duration == pytest.approx(2.0) and s.peak_memory == 30.0


def test_retries_never_negative(spark):
    a = spark.createDataFrame([("f", 1, False, False), ("f", 2, True, True), ("f", 2, True, False)], "function string, call int, recorded boolean, success boolean")
    r = jobs.retry_statistics(a, "function", "call").first()
    assert (r.total_calls, r.failed_calls, r.total_retries, r.max_retries) == (2, 1, 1, 1)


def test_correction_replaces_and_keeps_its_place(spark):
    c = spark.createDataFrame([(1, 0, "x", 1, 0), (1, 2, "y", 2, 1), (1, 0, "z", 3, 2)], "doc_id int, block_index int, corrected string, ts int, position int")
    rows = jobs.upserted(c, ["doc_id", "block_index"], ["ts"], "position").orderBy("position").collect()
    assert [(r.block_index, r.corrected) for r in rows] == [(0, "z"), (2, "y")]


@pytest.mark.parametrize(("a", "b", "want"), [
    ('{"name": "n", "value": 1, "extra": 2}', '{"name": "n", "value": 1}', {("root.extra", "missing_key")}),
    ('{"v": 123}', '{"v": "123"}', {("root.v", "type_change"), ("root.v", "value_change")}),
    ('{"v": [1, 2, 3, 4, 5]}', '{"v": [1, 2, 3]}', {("root.v", "length_change")}),
    ('{"v": [1, 2]}', '{"v": [1, 9]}', {("root.v[1]", "value_change")}),
    ('{"v": 1}', '{"v": 1.0}', {("root.v", "type_change")}),
    ('{"t": "Hello    World"}', '{"t": "Hello World"}', set()),
    ('{"t": "abcdefghij"}', '{"t": "abcdefxxxx"}', {("root.t", "value_change")}),
    ('{"t": "abcdefghijklmnopqrst"}', '{"t": "abcdefghij_lmnopqrst"}', set()),
    ('{"a": {"b": [{"c": null}]}}', '{"a": {"b": [{"c": 0}]}}', {("root.a.b[0].c", "type_change"), ("root.a.b[0].c", "value_change")}),
    ('{"a": {"b": {"c": 1}}}', '{"a": {"b": 5}}', {("root.a.b", "type_change"), ("root.a.b", "value_change")}),
    ('{"a": {"b": {"c": 1}}}', '{"a": {}}', {("root.a.b", "missing_key")}),
    ('[]', '{}', {("root", "type_change"), ("root", "value_change")}),
    ('1', None, {("root", "missing_key")}), (None, None, set()), ('{}', '{}', set()),
])
def test_structural_diff(spark, a, b, want):
    pairs = spark.createDataFrame([(1, a, b)], "doc_id long, a string, b string").select("doc_id", F.try_parse_json("a").alias("a"), F.try_parse_json("b").alias("b"))
    rows = nested.changes(pairs, "a", "b", "doc_id").collect()
    assert {(r.path, r.kind) for r in rows if r.kind} == want
    assert rows and all(r.doc_id == 1 for r in rows)


def test_edit_distance_looks_at_what_lies_between_common_ends(spark):
    texts = [("", ""), ("", "ab"), ("ab", "ab"), ("aba", "ababa"), ("aaaa", "aa"), ("kitten", "sitting"), ("äöü x", "äöü yx"), ("日本語の本", "日本の本"), ("abcdef", "abXdef"), ("x", None), (None, None)]
    rows = spark.createDataFrame(texts, "a string, b string").select("a", "b", middles(F.col("a"), F.col("b")).alias("m"), F.levenshtein("a", "b").alias("d")).withColumn("e", F.levenshtein("m.x", "m.y")).collect()
    assert all(r.d == r.e for r in rows)
    m = {(r.a, r.b): (r.m.x, r.m.y) for r in rows}
    assert m["abcdef", "abXdef"] == ("c", "X") and m["aba", "ababa"] == ("", "ba") or m["aba", "ababa"] == ("", "ab")
    # a distance of the whole texts would take hours
    long = spark.range(2, numPartitions=2).select(F.concat(F.repeat(F.lit("ab c"), 50_000), F.lit("x"), F.repeat(F.lit("de "), 50_000)).alias("a"), F.repeat(F.lit("ab c"), 50_000).alias("b")).withColumn("b", F.concat("b", F.lit("yz"), F.repeat(F.lit("de "), 50_000)))
    assert {tuple(r) for r in long.select(nested.changed_text(F.col("a"), F.col("b")), edit_ratio(F.col("a"), F.col("b")) == 1 - 2.0 / 350_002).collect()} == {(False, True)}


def test_walk_gives_paths_depths_and_issues(spark):
    texts = ['{"a b": [1, {"c": "x\\u0001"}], "n": 9007199254740993}', "[" * 9 + "]" * 9, "7", None, "{", '{"e": [], "o": {}, "z": null}']
    records = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.try_parse_json("t").alias("v"))
    nodes = nested.walk(records, "v", "k", limit=5)
    at = {(r.k, r.path): (r.depth, r.kind, r["size"]) for r in nodes.collect()}
    assert at[0, "root"] == (0, "dict", 2) and at[0, "root.a b[1].c"] == (3, "str", 2) and at[0, "root.n"] == (1, "int", None)
    assert at[2, "root"] == (0, "int", None) and not [k for k in at if k[0] in (3, 4)]
    assert {p: v[1:] for (k, p), v in at.items() if k == 5} == {"root": ("dict", 3), "root.e": ("list", 0), "root.o": ("dict", 0), "root.z": ("null", None)}
    assert max(v[0] for (k, _), v in at.items() if k == 1) == 6
    issues = {(r.k, r.severity, r.issue, r.path) for r in nested.issues(nodes, "k").collect()}
    assert issues == {(0, "warning", "control_characters", "root.a b[1].c"), (0, "warning", "unsafe_integer", "root.n"), (1, "error", "too_deep", "root" + "[0]" * 6)}
    verdicts = {r.k: (r.is_serialisable, r.depth, r.errors, r.warnings) for r in nested.verdicts(nodes, "k").collect()}
    assert verdicts == {0: (True, 3, 0, 2), 1: (False, 6, 1, 0), 2: (True, 0, 0, 0), 5: (True, 1, 0, 0)}


def test_large_containers_warn(spark):
    record = spark.range(1).select("id", F.to_variant_object(F.struct(F.sequence(F.lit(1), F.lit(10_001)).alias("l"), F.repeat(F.lit("x"), 95_000).alias("s"))).alias("v"))
    nodes = nested.walk(record, "v", "id")
    assert [(r.issue, r.path) for r in nested.issues(nodes, "id").collect()] == [("large_array", "root.l")]
    v = nested.verdicts(nodes, "id").first()
    assert (v.large, v.warnings, v.array_length, v.string_length) == (True, 2, 10_001, 95_000)


def test_special_floats(spark):
    got = [one(spark, i=integrity.number_issue(F.lit(x))).i for x in (float("nan"), float("inf"), float("-inf"), 1.23, 0.0)]
    assert got == ["nan", "infinity", "infinity", None, None]
    assert one(spark, i=integrity.integer_issue(F.lit(2 ** 60))).i == "unsafe_integer"


def test_response_recovery(spark):
    t = lambda s: one(spark, j=prompts.recovered_json(F.lit(s))).j
    assert t('```json\n{"a": 1}\n```') == '{"a": 1}' and t('x {"a": {"b": 1}} y') == '{"a": {"b": 1}}' and t("no json {") is None


def test_good_blocks_have_no_findings(spark):
    b = spark.createDataFrame([(1, 0, "a", "header", '{"text": "T", "level": 1}', None)], "doc_id long, index long, block_id string, block_type string, data string, metadata string")
    assert [r.severity for r in blocks.validated_blocks(b).collect()] == [None]


def test_markdown_lists_win_over_emphasis(spark):
    runs = one(spark, r=markdown.markdown_runs(F.lit("# A\n\n| x | y |\n| --- | --- |\n\n*text*\n- b\n> q\n$$e$$\nplain"))).r
    assert [(r.kind, len(r.lines)) for r in runs] == [("header", 1), ("table", 2), ("list", 2), ("quote", 1), ("formula", 1), ("paragraph", 1)]


def test_two_corrections_of_a_block_keep_the_last(spark):
    pages = spark.sql("SELECT 1L AS doc_id, array(named_struct('text', 'a', 'items', cast(null as array<string>)), named_struct('text', 'b', 'items', cast(null as array<string>))) AS regions")
    c = spark.createDataFrame([(1, 0, "second", 2), (1, 0, "first", 1), (1, 1, "", 5), (1, None, "lost", 9)], "doc_id long, block_index int, corrected string, ts int")
    assert documents.corrected_text(pages, c, order=("ts",)).first().text == "second"
    assert documents.corrected_text(pages, c).first().text == "second"


def test_as_of_takes_the_last_of_equal_positions(spark):
    left = spark.createDataFrame([("k", 5), ("k", 25)], "key string, at int")
    right = spark.createDataFrame([("k", 5, "x", 1), ("k", 5, "a", 3), ("k", 5, "z", 2)], "key string, at int, v string, arrival int")
    found = lambda **o: [r.found for r in skew.as_of(left, right, ["key"], "at", F.col("v"), lambda c: F.floor(c / 10), **o).orderBy("at").collect()]
    assert found(tie=F.col("arrival")) == ["a", "a"] and found() == ["z", "z"]


def test_uncapped_history_is_numbered_over_days(spark):
    rows = spark.sql("SELECT 'k' AS job_id, timestamp_seconds(id * 40000 % 700001) AS ts, id AS event_id FROM range(300)").unionByName(
        spark.sql("SELECT 'k' AS job_id, cast(null AS timestamp) AS ts, 1000L AS event_id UNION ALL SELECT cast(null AS string), timestamp_seconds(5), 7L"))
    got = jobs.history(rows, "job_id", "ts").collect()
    ordered = sorted((r for r in got if r.job_id), key=lambda r: (r.ts is not None, r.ts, r.event_id) if r.ts else (False, None, 0))
    assert [r.seq for r in ordered] == list(range(1, 302)) and [r.seq for r in got if r.job_id is None] == [1]


def test_repeated_ids(spark):
    pages = spark.createDataFrame([(1, ["a", "", "b", "a", None, "", "a", None]), (2, []), (3, None)], "doc_id long, ids array<string>")
    assert sorted((r.doc_id, r["index"], r.block_id) for r in blocks.repeated_ids(pages).collect()) == [(1, 3, "a"), (1, 6, "a")]


def test_confidence_log(spark):
    region = "array<struct<type: string, content: string, confidence: double, x1: double, y1: double, x2: double, y2: double>>"
    rows = [(1, [("header", "A | title\nof a page, longer than the preview", 0.5, 0.0, 0.0, 10.0, 10.0), ("table", None, None, 0.0, 0.0, 5.0, 5.0),
                 (None, " abc ", 0.0, 0.0, 0.0, 100.0, 100.0)], "2024-01-01 00:00:00"), (2, [], None), (3, None, None)]
    df = spark.createDataFrame(rows, f"doc_id int, regions {region}, at string")
    got = {r.doc_id: r.log for r in documents.confidence_log(df, started=F.col("at")).collect()}
    lines = got[1].split("\n")
    for line in ("**任务 ID**: `1`", "- **开始时间**: 2024-01-01 00:00:00", "- **有置信度的区域**: 1", "- **置信度覆盖率**: 33.3%",
                 "| 1 | header | (0, 0) | 10×10 | 0.5 | A \\| title of a page, longer th... |", "| 2 | table | (0, 0) | 5×5 | 无 |  |", "           = (0.5) / 1",
                 "- 检测到的区域类型: header, table", "- **类型多样性因子**: 0.90", "- 合理尺寸区域数: 2 / 3", "- 有效内容区域数: 1 / 3",
                 "- 惩罚因子 = min(1.0, 0.333333333333 / 0.5) = 0.666666666667"):
        assert line in lines, line
    layout = 1 / 3 * 0.5 + 2 / 3 * 0.3 + 0.9 * 0.2
    overall = (0.5 * 0.7 + layout * 0.3) * (0.5 + 0.5 * (1 / 3 / 0.5))
    assert f"| **总体置信度** | **{overall:.12f}".rstrip("0") in got[1] and f"| 布局置信度 | {layout:.12f}".rstrip("0") in got[1]
    assert got[2].replace("`2`", "") == got[3].replace("`3`", "") and "*无区域数据，总体置信度 = 0.0*" in got[2] and "开始时间" not in got[2]
    assert "| 置信度覆盖率 | 0% |" in got[2] and "| **总体置信度** | **0.0** |" in got[2]


def test_table_confidence_of_mixed_widths(spark):
    cells = [(1, 0, "a"), (1, 0, "1"), (1, 1, "b"), (1, 1, ""), (1, 2, "c" * 101), (2, 3, "x"), (None, 0, "n")]
    df = spark.createDataFrame(cells, "table_no int, r int, text string")
    got = {r.table_no: r.confidence for r in tables.confidence_from_cells(df).collect()}
    assert got[1] == pytest.approx((4 / 6 + 2 / 3 + 3 / 4 + 0.7) / 4) and got[2] == pytest.approx((1 + 1 + 1 + 0.7) / 4) and len(got) == 3


def test_first_content(spark):
    jobs = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    a = spark.createDataFrame([(1, "one"), (2, ""), (3, None)], "k int, layout string")
    b = spark.createDataFrame([(1, "other"), (2, "two"), (None, "lost"), (9, "no job")], "k int, raw string")
    got = sorted(((r.k, r.source, r.content) for r in readers.first_content(jobs, "k", layout=a, raw=b).collect()), key=repr)
    assert got == [(1, "layout", "one"), (2, "raw", "two"), (3, None, None), (None, None, None)]
