"""Integrity of documents between steps, and checks of the JSON that carries them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.operators import integrity, nested
from pagegrain.plans import inputs
from pagegrain.plans.ansi import s_squeeze, s_words, with_ll
from pagegrain.plans.registry import query

_HALF = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, length(text) // 2) ELSE text || ' and more' END"


@query("agg26_content_statistics", f"""
SELECT doc_id, length(a) AS original_length, length(b) AS processed_length, length(b) - length(a) AS length_difference, wa AS original_words, wb AS processed_words, wb - wa AS word_difference
FROM (SELECT *, len({s_words('a')}) AS wa, len({s_words('b')}) AS wb FROM (SELECT doc_id, text AS a, {_HALF} AS b FROM documents))""")
def content_statistics(spark, sf):
    k = F.col("doc_id") % 3
    b = F.when(k == 0, F.col("text")).when(k == 1, F.expr("substring(text, 1, length(text) div 2)")).otherwise(F.concat("text", F.lit(" and more")))
    d = inputs.table(spark, sf, "documents").select("doc_id", F.col("text").alias("a"), b.alias("b"))
    return d.select("doc_id", *integrity.content_statistics(F.col("a"), F.col("b")))


_DIFF = """
, b AS (SELECT doc_id, line_no, CASE WHEN line_no % 10 = 3 THEN text || ' x' ELSE text END AS text FROM ll WHERE line_no % 10 <> 7
  UNION ALL SELECT doc_id, line_no, text FROM ll WHERE line_no % 10 = 5),
u AS (SELECT doc_id, text, 1 AS n, line_no FROM ll UNION ALL SELECT doc_id, text, -1, line_no FROM b)
, d AS (SELECT doc_id, text AS line, CASE WHEN sum(n) > 0 THEN 'deletion' ELSE 'addition' END AS change, abs(sum(n))::BIGINT AS times,
 CASE WHEN sum(n) > 0 THEN min(line_no) FILTER (WHERE n > 0) ELSE min(line_no) FILTER (WHERE n < 0) END AS first_at
FROM u GROUP BY doc_id, text HAVING sum(n) <> 0)"""


@query("txt10_line_diff", with_ll(_DIFF + " SELECT * FROM d"))
def line_diff(spark, sf):
    a = inputs.ll(spark, sf).select("doc_id", "line_no", "text")
    m = F.col("line_no") % 10
    copies = F.when(m == 7, 0).when(m == 5, 2).otherwise(1)
    b = a.withColumn("text", F.when(m == 3, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))
    b = b.withColumn("k", F.explode_outer(F.array_repeat(F.lit(1), copies))).where(F.col("k").isNotNull()).drop("k")
    return integrity.line_diff(a, b)


@query("top3_first_differences", with_ll(_DIFF + " SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY first_at, change, line) <= 10"))
def first_differences(spark, sf):
    return integrity.first_differences(line_diff(spark, sf))


@query("top3_bad_characters", r"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]')[1:5], lambda c: '\u' || lpad(lower(to_hex(ascii(c))), 4, '0')), ',') AS shown
FROM (SELECT doc_id, replace(replace(replace(text, ' le', chr(1) || 'le'), ' th', chr(31) || 'th'), 'ie', chr(11)) AS t FROM documents)""")
def bad_characters(spark, sf):
    t = F.col("text")
    for a, b in ((" le", "\x01le"), (" th", "\x1fth"), ("ie", "\x0b")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return inputs.table(spark, sf, "documents").select("doc_id", F.array_join(integrity.bad_characters(t), ",").alias("shown"))


# A record per document, and a copy damaged in one of seven ways.
_WHOLE = {"ignoreNullFields": "false"}


def _records(spark, sf):
    tags, n, lang, source = F.slice(F.split("text", " "), 1, 3).alias("tags"), F.col("n_chars"), F.col("lang"), F.col("source")
    s = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    meta = s(lang=lang, source=source).alias("meta")
    parts = F.to_json(F.array(s(n=n.cast("string"), s=F.array(lang, source)), s(n=F.lit("x"), s=F.array(F.lit("y")))), _WHOLE)
    made = lambda *c: F.to_json(F.struct(*c), _WHOLE)
    whole = made(meta, n, "text", tags, F.parse_json(parts).alias("parts"))
    moved = F.concat(F.lit('[{"n":1,"s":['), n.cast("string"), F.lit(',2.5,true]},{"m":null},3]'))
    kept = F.parse_json(parts).alias("parts")
    k = F.col("doc_id") % 7
    hurt = (F.when(k == 1, made(meta, "text", tags, kept))
            .when(k == 2, made(meta, n, "text", tags, F.parse_json(moved).alias("parts"), F.lit(1).alias("extra")))
            .when(k == 3, made(meta, n.cast("string").alias("n_chars"), "text", tags, kept))
            .when(k == 4, made(meta, n, F.expr("substring(text, 1, length(text) div 2)").alias("text"), F.slice(tags, 1, 2).alias("tags"), kept))
            .when(k == 5, made(s(lang=F.lit("xx")).alias("meta"), n.cast("double").alias("n_chars"), F.replace("text", F.lit(" "), F.lit("  ")).alias("text"), tags, kept))
            .when(k == 6, made(F.lit("gone").alias("meta"), (n + 1).alias("n_next"), F.concat("text", F.lit("."), F.lit(" ")).alias("text"), tags, kept))
            .otherwise(whole))
    return inputs.table(spark, sf, "documents").select("doc_id", F.try_parse_json(whole).alias("a"), F.try_parse_json(hurt).alias("b"))


def _record(**change: str) -> str:
    """The record as a DuckDB JSON expression with some of its parts changed or, by an empty text, left out."""
    parts = {"meta": "json_object('lang', lang, 'source', source)", "n_chars": "n_chars", "text": "text", "tags": "string_split(text, ' ')[1:3]",
             "parts": "json_array(json_object('n', n_chars::VARCHAR, 's', [lang, source]), json_object('n', 'x', 's', ['y']))"} | change
    return "json_object(" + ", ".join(f"'{k}', {v}" for k, v in parts.items() if v) + ")"


_MOVED = "json_array(json_object('n', 1, 's', json_array(n_chars, 2.5::DOUBLE, true)), json_object('m', NULL), 3)"
_PAIRS = f"""pairs AS (SELECT doc_id, {_record()} AS a, CASE doc_id % 7 WHEN 1 THEN {_record(n_chars="")} WHEN 2 THEN {_record(parts=_MOVED, extra="1")} WHEN 3 THEN {_record(n_chars="n_chars::VARCHAR")}
 WHEN 4 THEN {_record(text="substr(text, 1, length(text) // 2)", tags="string_split(text, ' ')[1:2]")} WHEN 5 THEN {_record(meta="json_object('lang', 'xx')", n_chars="n_chars::DOUBLE", text="replace(text, ' ', '  ')")}
 WHEN 6 THEN {_record(meta="'gone'", n_chars="", n_next="n_chars + 1", text="text || '. '")} ELSE {_record()} END AS b FROM documents)"""
_KIND = "CASE type WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str' WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'float' END"


def _tree(side: str) -> str:
    return f"SELECT doc_id, x.fullkey AS p, {_KIND} AS kind, x.value AS v, CASE WHEN type = 'ARRAY' THEN json_array_length(x.value) END AS n, x.value ->> '$' AS t FROM pairs, json_tree(pairs.{side}) x"


def _changes_sql(root: str) -> str:
    """Both records walked by the engine's JSON tree, joined by path; what lies below a stop is left out."""
    x, y = s_squeeze("aw"), s_squeeze("bw")
    long = f"greatest(length({x}), length({y}))"
    text = f"CASE WHEN {x} = {y} THEN false WHEN abs(length({x}) - length({y})) > floor({long} * 0.05 + 1e-9) THEN true ELSE levenshtein({x}, {y}) > floor({long} * 0.05 + 1e-9) END"
    number = "ak IN ('int', 'float', 'bool') AND bk IN ('int', 'float', 'bool')"
    return f"""WITH {_PAIRS}, ta AS ({_tree('a')}), tb AS ({_tree('b')}),
f AS (SELECT doc_id, p, ta.kind AS ak, tb.kind AS bk, ta.n AS an, tb.n AS bn, ta.t AS aw, tb.t AS bw FROM ta FULL JOIN tb USING (doc_id, p)),
st AS (SELECT doc_id, p FROM f WHERE ak IS NULL OR bk IS NULL OR ak <> bk),
vis AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.doc_id = f.doc_id AND (starts_with(f.p, st.p || '.') OR starts_with(f.p, st.p || '[')))),
num AS (SELECT *, {number} AND CASE aw WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE TRY_CAST(aw AS DOUBLE) END = CASE bw WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE TRY_CAST(bw AS DOUBLE) END AS same FROM vis)
SELECT doc_id, '{root}' || substr(p, 2) AS path, unnest(list_filter([CASE WHEN bk IS NULL AND NOT ends_with(p, ']') THEN 'missing_key' END, CASE WHEN ak IS NULL AND NOT ends_with(p, ']') THEN 'added_key' END, CASE WHEN ak <> bk THEN 'type_change' END,
 CASE WHEN ak = 'list' AND bk = 'list' AND an <> bn THEN 'length_change' END,
 CASE WHEN (ak <> bk AND NOT coalesce(same, false)) OR (ak = bk AND ak NOT IN ('dict', 'list', 'str', 'null') AND aw <> bw AND NOT coalesce(same, false)) OR (ak = 'str' AND bk = 'str' AND {text}) THEN 'value_change' END], lambda k: k IS NOT NULL)) AS kind FROM num"""


def _changes(spark, sf):
    return nested.changes(_records(spark, sf), "a", "b", "doc_id")


@query("jn12_structural_diff", _changes_sql("root"))
def structural_diff(spark, sf):
    return _changes(spark, sf).where(F.col("kind").isNotNull())


_SEV = "CASE WHEN n = 0 THEN 'none' WHEN n <= 2 THEN 'minor' WHEN n <= 5 THEN 'moderate' ELSE 'severe' END"
_LOSS = f"""SELECT d.doc_id, count(*) FILTER (WHERE kind IN ('missing_key', 'type_change', 'value_change')) AS n, coalesce(bool_or(kind <> 'added_key'), false) AS has_loss
 FROM documents d LEFT JOIN ({_changes_sql('root')}) c ON d.doc_id = c.doc_id GROUP BY d.doc_id"""


@query("agg19_loss_severity", f"SELECT doc_id, n AS issues, has_loss, {_SEV} AS severity FROM ({_LOSS})")
def loss_severity(spark, sf):
    return integrity.loss_severity(_changes(spark, sf))


def _stages(spark, sf):
    """Three stages: the record, the same record again, and the damaged one."""
    r = _records(spark, sf)
    st = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).alias("record"))
    pairs = integrity.stage_pairs(r.select("doc_id", F.array(st("input", "a"), st("processed", "a"), st("output", "b")).alias("stages")))
    return nested.changes(pairs, "a", "b", "doc_id", "pair", "to_stage", root=F.col("pair"))


@query("jn13_stage_changes", f"SELECT *, 'processed->output' AS pair FROM ({_changes_sql('processed->output')})")
def stage_changes(spark, sf):
    return _stages(spark, sf).where(F.col("kind").isNotNull()).select("doc_id", "pair", "path", "kind")


@query("agg20_chain_score", f"""
SELECT doc_id, NOT has_loss AS intact, round((1.0 + CASE {_SEV} WHEN 'none' THEN 1.0 WHEN 'minor' THEN 0.9 WHEN 'moderate' THEN 0.7 ELSE 0.4 END) / 2, 6)::DOUBLE AS score FROM ({_LOSS})""")
def chain_score(spark, sf):
    s = integrity.loss_severity(_stages(spark, sf), "doc_id", "pair")
    return integrity.chain_score(s).withColumn("score", F.round("score", 6))


@query("agg20_lost_paths", f"SELECT doc_id, path, 'output' AS stages FROM ({_changes_sql('processed->output')}) WHERE kind = 'missing_key'")
def lost_paths(spark, sf):
    lost = _stages(spark, sf).where(F.col("kind") == "missing_key")
    return lost.groupBy("doc_id", "path").agg(F.array_join(F.array_sort(F.collect_set("to_stage")), ",").alias("stages"))


_OTHER = "CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{\"j\": 1}' ELSE replace(props, '}', ', \"x\": 2}') END"


@query("set4_key_differences", f"""
SELECT event_id, array_to_string(list_filter(json_keys(props), lambda k: NOT list_contains(json_keys(o), k)), ',') AS missing,
 array_to_string(list_sort(list_filter(json_keys(o), lambda k: NOT list_contains(json_keys(props), k))), ',') AS added,
 array_to_string(list_filter(json_keys(props), lambda k: list_contains(json_keys(o), k)), ',') AS common FROM (SELECT event_id, props, {_OTHER} AS o FROM events)""")
def key_differences(spark, sf):
    k = F.col("event_id") % 3
    other = F.when(k == 0, F.col("props")).when(k == 1, '{"j": 1}').otherwise(F.replace("props", F.lit("}"), F.lit(', "x": 2}')))
    d = inputs.table(spark, sf, "events").select("event_id", *integrity.key_differences(F.col("props"), other))
    return d.select("event_id", *[F.array_join(c, ",").alias(c) for c in ("missing", "added", "common")])


_DAMAGED = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN substr(props, 1, length(props) - 1) WHEN 2 THEN '  ' WHEN 3 THEN '[' || props || ', 2]' WHEN 4 THEN '{"a": "}", "b": [1, 2]}' ELSE '"text"' END"""


@query("jsn1_json_check", f"""
SELECT event_id, ok AS is_valid, CASE WHEN trim(j) = '' THEN 'empty' WHEN NOT json_valid(j) THEN 'syntax' END AS error,
 CASE WHEN ok THEN CASE json_type(j) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' ELSE 'str' END END AS root_type,
 CASE WHEN ok THEN CASE json_type(j) WHEN 'OBJECT' THEN len(json_keys(j)) WHEN 'ARRAY' THEN json_array_length(j)::BIGINT END END AS root_size,
 ok AND length(replace(j, chr(123), '')) <> length(replace(j, chr(125), '')) AS unbalanced_braces, ok AND length(replace(j, '[', '')) <> length(replace(j, ']', '')) AS unbalanced_brackets
FROM (SELECT *, trim(j) <> '' AND json_valid(j) AS ok FROM (SELECT event_id, {_DAMAGED} AS j FROM events))""")
def json_check(spark, sf):
    k, p = F.col("event_id") % 6, F.col("props")
    j = (F.when(k == 0, p).when(k == 1, F.expr("substring(props, 1, length(props) - 1)")).when(k == 2, "  ").when(k == 3, F.concat(F.lit("["), p, F.lit(", 2]")))
         .when(k == 4, '{"a": "}", "b": [1, 2]}').otherwise('"text"'))
    d = inputs.table(spark, sf, "events").select("event_id", j.alias("j")).select("event_id", integrity.json_check(F.col("j")).alias("c"))
    return d.select("event_id", "c.*").drop("very_large")


def _strange(spark, sf):
    n = F.col("l_orderkey") + F.col("l_linenumber")
    price = (F.when(n % 10 == 1, float("nan")).when(n % 10 == 2, float("inf")).when(n % 10 == 3, float("-inf")).when(n % 10 == 4, 1.5e308).otherwise(F.col("l_extendedprice")))
    return inputs.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", price.alias("price"), F.when(n % 5 == 0, F.col("l_partkey") + (1 << 60)).otherwise(F.col("l_partkey")).alias("big"),
        F.when(n % 7 == 0, F.concat("l_returnflag", F.lit("\x02"))).otherwise(F.col("l_returnflag")).alias("flag"), "l_shipdate")


_STRANGE = """SELECT l_orderkey, l_partkey, l_linenumber, CASE n % 10 WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-inf'::DOUBLE WHEN 4 THEN 1.5e308 ELSE l_extendedprice END AS price,
 CASE WHEN n % 5 = 0 THEN l_partkey + 1152921504606846976 ELSE l_partkey END AS big, CASE WHEN n % 7 = 0 THEN l_returnflag || chr(2) ELSE l_returnflag END AS flag, l_shipdate
FROM (SELECT *, l_orderkey + l_linenumber AS n FROM lineitem)"""


@query("jsn2_serialisable", f"""
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN isnan(price) THEN 'nan' WHEN isinf(price) THEN 'infinity' WHEN abs(price) > 1e308 THEN 'very_large' END AS number_issue,
 CASE WHEN abs(big) > 9007199254740992 THEN 'unsafe_integer' END AS integer_issue, CASE WHEN regexp_matches(flag, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'control_characters' END AS text_issue
FROM ({_STRANGE})""")
def serialisable(spark, sf):
    s = _strange(spark, sf)
    return s.select("l_orderkey", "l_partkey", "l_linenumber", integrity.number_issue(F.col("price")).alias("number_issue"),
                    integrity.integer_issue(F.col("big")).alias("integer_issue"), integrity.text_issue(F.col("flag")).alias("text_issue"))


@query("jsn3_json_repair", f"""
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN NOT isnan(price) AND NOT isinf(price) THEN price END AS price, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS shipped FROM ({_STRANGE})""")
def json_repair(spark, sf):
    """Times to the second, as the SQL shows them."""
    seconds = _strange(spark, sf).withColumn("l_shipdate", F.date_trunc("second", "l_shipdate"))
    return integrity.repaired_columns(seconds).select("l_orderkey", "l_partkey", "l_linenumber", "price", F.col("l_shipdate").alias("shipped"))


#: Depth beyond which the queries below call a value too deep.
_DEEP = 8


def _walked(spark, sf):
    """Every third document's record is whole, every third holds what a check warns of, every third lies ten lists deep."""
    k = F.col("doc_id") % 3
    odd = F.concat(F.lit('{"big":12345678901234567890,"safe":9007199254740992,"over":9007199254740993,"huge":1.5e308,"tab":"a\\tb","bell":"a\\u0007b\\u0001","a\\u0002b":[null,true,-0.5,{"n":'), F.col("n_chars").cast("string"), F.lit("}]}"))
    deep = F.concat(F.repeat(F.lit("["), 10), F.col("n_chars").cast("string"), F.repeat(F.lit("]"), 10))
    j = F.when(k == 0, F.to_json(F.struct(F.struct("lang", "source").alias("meta"), "n_chars", "text", F.split("text", " ").alias("words")), _WHOLE)).when(k == 1, odd).otherwise(deep)
    return nested.walk(inputs.table(spark, sf, "documents").select("doc_id", F.try_parse_json(j).alias("v")), "v", "doc_id", limit=_DEEP)


_WALKED = f"""texts AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN json_object('meta', json_object('lang', lang, 'source', source), 'n_chars', n_chars, 'text', text, 'words', string_split(text, ' '))::VARCHAR
 WHEN 1 THEN '{{"big":12345678901234567890,"safe":9007199254740992,"over":9007199254740993,"huge":1.5e308,"tab":"a\\tb","bell":"a\\u0007b\\u0001","a\\u0002b":[null,true,-0.5,{{"n":' || n_chars || '}}]}}'
 ELSE repeat('[', 10) || n_chars || repeat(']', 10) END AS j FROM documents),
tree AS (SELECT doc_id, x.id, x.parent, x.key, {_KIND} AS kind, x.value ->> '$' AS t, CASE type WHEN 'ARRAY' THEN json_array_length(x.value)::BIGINT WHEN 'OBJECT' THEN len(json_keys(x.value)) WHEN 'VARCHAR' THEN length(x.value ->> '$') END AS size FROM texts, json_tree(texts.j::JSON) x),
walked AS (SELECT doc_id, id, 0 AS depth, 'root' AS path, NULL::VARCHAR AS name, kind, t, size FROM tree WHERE parent IS NULL
 UNION ALL SELECT c.doc_id, c.id, w.depth + 1, w.path || CASE WHEN w.kind = 'list' THEN '[' || c.key || ']' ELSE '.' || c.key END, CASE WHEN w.kind = 'dict' THEN c.key END, c.kind, c.t, c.size
 FROM walked w JOIN tree c ON c.doc_id = w.doc_id AND c.parent = w.id WHERE w.depth <= {_DEEP})"""
_BAD = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
_ISSUES = f"""issues AS (
 SELECT doc_id, 'error' AS severity, 'too_deep' AS issue, path, depth::VARCHAR AS detail FROM walked WHERE depth > {_DEEP}
 UNION ALL SELECT doc_id, 'warning', 'control_characters', path, array_to_string(list_transform(regexp_extract_all(t, '{_BAD}')[1:5], lambda c: printf('\\u%04x', ascii(c))), ',') FROM walked WHERE depth <= {_DEEP} AND kind = 'str' AND regexp_matches(t, '{_BAD}')
 UNION ALL SELECT doc_id, 'warning', 'control_characters', path || '(key)', array_to_string(list_transform(regexp_extract_all(name, '{_BAD}')[1:5], lambda c: printf('\\u%04x', ascii(c))), ',') FROM walked WHERE regexp_matches(name, '{_BAD}')
 UNION ALL SELECT doc_id, 'warning', 'very_large', path, NULL FROM walked WHERE depth <= {_DEEP} AND kind = 'float' AND abs(t::DOUBLE) > 1e308
 UNION ALL SELECT doc_id, 'warning', 'unsafe_integer', path, NULL FROM walked WHERE depth <= {_DEEP} AND kind = 'int' AND abs(t::HUGEINT) > 9007199254740992
 UNION ALL SELECT doc_id, 'warning', 'very_long', path, length(t)::VARCHAR FROM walked WHERE depth <= {_DEEP} AND kind = 'str' AND length(t) > 1000000
 UNION ALL SELECT doc_id, 'warning', CASE kind WHEN 'list' THEN 'large_array' ELSE 'large_object' END, path, size::VARCHAR FROM walked WHERE depth <= {_DEEP} AND kind IN ('list', 'dict') AND size > 10000)"""
_PROFILE = f"""profile AS (SELECT doc_id, max(depth)::BIGINT AS depth, coalesce(sum(size) FILTER (WHERE kind = 'str'), 0)::BIGINT AS string_length, coalesce(sum(size) FILTER (WHERE kind = 'list' AND depth <= {_DEEP}), 0)::BIGINT AS array_length,
 coalesce(sum(size) FILTER (WHERE kind = 'dict'), 0)::BIGINT AS object_keys FROM walked GROUP BY doc_id)"""


@query("agg24_json_profile", f"WITH RECURSIVE {_WALKED}, {_PROFILE} SELECT *, string_length + array_length + object_keys > 100000 AS large FROM profile")
def json_profile(spark, sf):
    return nested.verdicts(_walked(spark, sf), "doc_id").select("doc_id", "depth", "string_length", "array_length", "object_keys", "large")


@query("jsn2_json_verdict", f"""WITH RECURSIVE {_WALKED}, {_PROFILE}, {_ISSUES},
n AS (SELECT doc_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM issues GROUP BY doc_id)
SELECT doc_id, coalesce(errors, 0) = 0 AS is_serialisable, depth, coalesce(errors, 0) AS errors, coalesce(warnings, 0) + (string_length + array_length + object_keys > 100000)::BIGINT AS warnings FROM profile LEFT JOIN n USING (doc_id)""")
def json_verdict(spark, sf):
    return nested.verdicts(_walked(spark, sf), "doc_id").select("doc_id", "is_serialisable", "depth", "errors", "warnings")


@query("jsn2_json_issues", f"WITH RECURSIVE {_WALKED}, {_ISSUES} SELECT * FROM issues")
def json_issues(spark, sf):
    return nested.issues(_walked(spark, sf), "doc_id")


@query("jsn2_typed_issues", f"""
SELECT l_orderkey, l_partkey, l_linenumber, unnest(list_filter([CASE WHEN isnan(price) THEN 'error nan root.price' WHEN isinf(price) THEN 'error infinity root.price' WHEN abs(price) > 1e308 THEN 'warning very_large root.price' END,
 CASE WHEN abs(big) > 9007199254740992 THEN 'warning unsafe_integer root.ids[1]' END, CASE WHEN regexp_matches(flag, '{_BAD}') THEN 'warning control_characters root.more.flag' END, 'error not_serialisable root.more.l_shipdate'], lambda i: i IS NOT NULL)) AS issue
FROM ({_STRANGE})""")
def typed_issues(spark, sf):
    """Rows of typed columns, nested, as they are before they become JSON."""
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    record = F.struct("price", F.array(F.lit(1).cast("bigint"), "big").alias("ids"), F.struct("flag", "l_shipdate").alias("more"))
    rows = nested.walk(_strange(spark, sf).select(*keys, F.to_variant_object(record).alias("v")), "v", *keys)
    return nested.issues(rows, *keys).select(*keys, F.concat_ws(" ", "severity", "issue", "path").alias("issue"))
