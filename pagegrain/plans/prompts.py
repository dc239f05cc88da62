"""Prompts, responses, review figures and the document-type dimension."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from pagegrain.functions.classify import answer_confidence
from pagegrain.operators import prompts
from pagegrain.operators.skew import running_total
from pagegrain.plans import inputs
from pagegrain.plans.ansi import s_strip
from pagegrain.plans.registry import query


# A document-type configuration as a user would load it.
TYPES = [
    ("invoice", "发票", ["发票号码", "开票日期", "金额"], "发票号码是多少？\n\n开票日期是什么？"), ("contract", "合同", ["合同编号", "甲方", "乙方"], "合同编号是多少？\n  \n甲方和乙方分别是谁？\n"),
    ("receipt", "收据", ["收据编号", "金额"], "金额是多少？"), ("empty", "空", [], ""),
]
_SCHEMA = "id string, name string, fields array<string>, checkpoints string, hint string"


def types_table(spark):
    """The types as a table of known size, which the optimizer broadcasts; else the texts would be dealt by type, a type a task."""
    columns = zip(*((i, n, f, c, f"这是一份{n}，请仔细提取相关信息") for i, n, f, c in TYPES))
    return spark.createDataFrame(pa.table(dict(zip(("id", "name", "fields", "checkpoints", "hint"), map(list, columns)))), _SCHEMA)


_DIM = ("dim(id, name, fields, checkpoints, hint) AS (VALUES " + ", ".join(
    "('{}', '{}', [{}]::VARCHAR[], '{}', '这是一份{}，请仔细提取相关信息')".format(i, n, ", ".join(f"'{x}'" for x in f), c, n) for i, n, f, c in TYPES) + ")")
_NAMES = ["invoice", "contract", "receipt", "empty", "unknown"]
_DOC = f"d AS (SELECT doc_id, text, [{', '.join(repr(n) for n in _NAMES)}][doc_id % 5 + 1] AS doc_type, CASE WHEN doc_id % 10 = 4 THEN ['own a', 'own b'] ELSE []::VARCHAR[] END AS own FROM documents)"
_TYPED = f"{_DIM}, {_DOC}, t AS (SELECT d.*, name AS type_name, CASE WHEN len(own) > 0 THEN own ELSE coalesce(fields, []) END AS f, coalesce(hint, '请仔细分析文档内容') AS h, checkpoints FROM d LEFT JOIN dim ON id = doc_type)"


def _documents(spark, sf):
    kind = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id") % 5 + 1).cast("int"))
    own = F.when(F.col("doc_id") % 10 == 4, F.array(F.lit("own a"), F.lit("own b"))).otherwise(F.array().cast("array<string>"))
    return inputs.table(spark, sf, "documents").select("doc_id", "text", kind.alias("doc_type"), own.alias("fields"))


@query("jn10_typed_documents", f"WITH {_TYPED} SELECT doc_id, doc_type, type_name, array_to_string(f, ',') AS fields, h AS hint, CASE WHEN len(f) = 0 THEN '未指定提取字段' END AS error FROM t")
def typed_documents(spark, sf):
    t = prompts.typed_documents(_documents(spark, sf), types_table(spark))
    return t.select("doc_id", "doc_type", "type_name", F.array_join("fields", ",").alias("fields"), "hint", "error")


@query("jn11_checkpoint_questions", f"""WITH {_TYPED} SELECT doc_id, i - 1 AS question_no, q AS question FROM (SELECT doc_id, unnest(qs) AS q, generate_subscripts(qs, 1) AS i FROM
 (SELECT doc_id, list_filter(list_transform(string_split(checkpoints, chr(10)), lambda q: {s_strip('q')}), lambda q: q <> '') AS qs FROM t WHERE checkpoints IS NOT NULL))""")
def checkpoint_questions(spark, sf):
    return prompts.checkpoint_questions(_documents(spark, sf), types_table(spark)).select("doc_id", "question_no", "question")


@query("set3_field_lists", f"""WITH {_TYPED} SELECT doc_id, array_to_string(list_concat(list_concat(coalesce(f, []), CASE WHEN doc_id % 2 = 0 THEN ['temp'] ELSE [] END),
 list_filter(list_transform(string_split('金额' || chr(10) || '  ' || chr(10) || ' ' || doc_type || ' ', chr(10)), lambda x: {s_strip('x')}), lambda x: x <> '')), ',') AS fields FROM t""")
def field_lists(spark, sf):
    t = prompts.typed_documents(_documents(spark, sf), types_table(spark))
    temp = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("temp")))
    custom = F.concat(F.lit("金额\n  \n "), "doc_type", F.lit(" "))
    return t.select("doc_id", F.array_join(prompts.field_list(F.col("fields"), temp, custom), ",").alias("fields"))


@query("top4_truncated_text", "SELECT doc_id, length(substr(text, 1, 8000)) AS n, md5(substr(text, 1, 8000)) AS digest FROM documents")
def truncated_text(spark, sf):
    """The prompt limit itself is the feature; the stored text stays whole."""
    t = prompts.truncated(F.col("text"), prompts.PROMPT_LIMIT)
    return inputs.table(spark, sf, "documents").select("doc_id", F.length(t).alias("n"), F.md5(t.cast("binary")).alias("digest"))


def _quoted(text: str) -> str:
    """A text as SQL."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("txt29_prompts", f"""WITH {_TYPED} SELECT doc_id, md5('你是一个专业的文档信息提取助手。请从以下文档内容中提取指定的字段信息。' || chr(10) || chr(10) || h || chr(10) || chr(10) || '文档内容：' || chr(10) || substr(text, 1, 32000) || chr(10) || chr(10) || '需要提取的字段：' || chr(10) || array_to_string(f, ', ')
 || chr(10) || chr(10) || '请按照以下 JSON 格式返回结果，不要添加任何其他说明文字：' || chr(10) || chr(123) || chr(10) || array_to_string(list_transform(f, lambda x: '    "' || x || '": "提取的值或null"'), ',' || chr(10)) || chr(10) || chr(125) || {_quoted(prompts.EXTRACT_NOTES)}) AS digest,
 md5('你是一个专业的文档问答助手。请基于以下文档内容回答用户的问题。' || chr(10) || chr(10) || '文档内容：' || chr(10) || substr(text, 1, 32000) || chr(10) || chr(10) || '用户问题：' || doc_type || {_quoted(prompts.ANSWER_NOTES)}) AS question_digest FROM t WHERE len(f) > 0""")
def prompt_texts(spark, sf):
    t = prompts.typed_documents(_documents(spark, sf), types_table(spark)).where(F.col("error").isNull())
    p = prompts.extraction_prompt(F.col("hint"), F.col("text"), F.col("fields"))
    q = prompts.question_prompt(F.col("text"), F.col("doc_type"))
    return t.select("doc_id", F.md5(p.cast("binary")).alias("digest"), F.md5(q.cast("binary")).alias("question_digest"))


@query("txt30_json_recovery", """
SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL ELSE CASE WHEN event_id % 6 = 4 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END END AS k, event_id % 6 < 4 AS recovered FROM events""")
def json_recovery(spark, sf):
    m, p = F.col("event_id") % 6, F.col("props")
    response = (F.when(m == 0, p).when(m == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(m == 2, F.concat(F.lit("Here: ```json "), p, F.lit(" ``` done {x}")))
                .when(m == 3, F.concat(F.lit("the answer is "), p, F.lit(" ok"))).when(m == 4, F.lit("no {broken")).otherwise(F.lit("")))
    j = prompts.recovered_json(response)
    d = inputs.table(spark, sf, "events").select("event_id", j.alias("j"))
    return d.select("event_id", F.get_json_object("j", "$.k").cast("bigint").alias("k"), F.col("j").isNotNull().alias("recovered"))


_FOUND = "map(['amount', 'date', 'name'], [CASE WHEN doc_id % 2 = 0 THEN '5' END, CASE WHEN doc_id % 3 = 0 THEN 'd' END, CASE WHEN doc_id % 5 = 0 THEN '未找到' ELSE lang END])"


def _found():
    k = F.col("doc_id")
    return F.create_map(F.lit("amount"), F.when(k % 2 == 0, "5"), F.lit("date"), F.when(k % 3 == 0, "d"), F.lit("name"), F.when(k % 5 == 0, "未找到").otherwise(F.col("lang")))


@query("agg18_extraction_coverage", """
SELECT doc_id, round((4 - n) / 4, 6) AS confidence, n AS missing, CASE WHEN n > 0 THEN '有 ' || n || ' 个字段未能从文档中找到' END AS warning FROM (SELECT doc_id, 1 + (doc_id % 2 <> 0)::BIGINT + (doc_id % 3 <> 0)::BIGINT AS n FROM documents)""")
def extraction_coverage(spark, sf):
    wanted = F.array(*[F.lit(f) for f in ("amount", "date", "name", "absent")])
    d = inputs.table(spark, sf, "documents").select("doc_id", prompts.extraction_coverage(_found(), wanted).alias("c"))
    return d.select("doc_id", F.round("c.confidence", 6).alias("confidence"), "c.missing", "c.warning")


@query("agg28_review_summary", """
SELECT doc_id, 3::BIGINT AS total_fields, (doc_id % 2 = 0)::BIGINT + (doc_id % 3 = 0)::BIGINT + (doc_id % 5 <> 0)::BIGINT AS found_fields, round(((doc_id % 10) / 10.0::DOUBLE + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 0.3::DOUBLE END) / 2 * 100, 0)::BIGINT AS mean_percent FROM documents""")
def review_summary(spark, sf):
    scores = F.array((F.col("doc_id") % 10) / 10.0, F.when(F.col("doc_id") % 4 != 0, 0.3))
    d = inputs.table(spark, sf, "documents").select("doc_id", prompts.review_summary(_found(), scores).alias("r"))
    return d.select("doc_id", "r.*")


_EXCHANGES = """x AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM x WHERE role = 'user' AND next_role = 'assistant')"""


def _exchanges(spark, sf):
    """Question and answer are neighbouring turns: an equi join on the next turn, numbered per conversation in buckets."""
    c = inputs.table(spark, sf, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return running_total(q.join(a, ["conv_id", "turn"]), ["conv_id"], "turn", F.lit(1), F.floor(F.col("turn") / 4), "number")


@query("md8_transcript", f"""
WITH {_EXCHANGES}
SELECT conv_id, turn, md5('## 对话 ' || number || chr(10) || chr(10) || '### 🙋 用户问题' || chr(10) || chr(10) || text || chr(10) || chr(10) || '### 🤖 AI 回答' || chr(10) || chr(10) || answer || chr(10) || chr(10)
 || CASE WHEN number % 2 = 1 THEN '#### 📎 参考原文' || chr(10) || chr(10) || '> 1. "' || substr(answer, 1, 9) || '"' || chr(10) || chr(10) || '> 2. "' || number || '"' || chr(10) || chr(10) ELSE '' END || '#### 📊 元数据' || chr(10) || chr(10)
 || '| 指标 | 值 |' || chr(10) || '|------|----|' || chr(10) || '| 置信度 | ' || CASE WHEN length(answer) > 50 THEN '90.0' ELSE '80.0' END || '% |' || chr(10) || '| 处理时间 | ' || printf('%.2f', length(answer) / 100) || 's |' || chr(10)
 || '| 文档中找到 | ' || CASE WHEN length(answer) > 60 THEN '是' ELSE '否' END || ' |' || chr(10) || CASE WHEN number % 3 = 1 THEN '| 回答时间 | t' || number || ' |' || chr(10) ELSE '' END || chr(10) || '---' || chr(10) || chr(10)) AS digest FROM q""")
def transcript(spark, sf):
    n, length = F.col("number"), F.length("answer")
    t = _exchanges(spark, sf).withColumns({
        "confidence": answer_confidence(F.col("answer")), "references": F.when(n % 2 == 1, F.array(F.substring("answer", 1, 9), n.cast("string"))), "processing_time": length / 100, "found": length > 60,
        "answered_at": F.when(n % 3 == 1, F.concat(F.lit("t"), n.cast("string")))})
    return prompts.transcript(t, "conv_id", "turn").select("conv_id", "turn", F.md5(F.col("section").cast("binary")).alias("digest"))


@query("md8_transcript_header", f"""WITH {_EXCHANGES} SELECT conv_id, '# 文档问答对话日志' || chr(10) || chr(10) || '**导出时间**: now' || chr(10) || '**文档 Job ID**: ' || conv_id || chr(10) || '**对话轮数**: ' || count(*) || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS section FROM q GROUP BY conv_id""")
def transcript_header(spark, sf):
    return prompts.transcript_header(_exchanges(spark, sf), "conv_id", "now")


# Changes: parts by key; keys beyond the base are inserts, some of them faulty.
_CH = """b AS (SELECT p_partkey AS id, p_name AS name, p_type AS fields, p_size < 10 AS is_default FROM part WHERE p_partkey % 3 <> 0),
c AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' END AS op, CASE WHEN p_partkey % 8 <> 0 THEN 'new ' || p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'f' END AS fields FROM part WHERE p_partkey % 4 <> 3),
j AS (SELECT coalesce(b.id, c.id) AS id, b.name AS bn, b.fields AS bf, b.is_default AS bd, c.op, c.name AS cn, c.fields AS cf,
 CASE WHEN op = 'insert' AND coalesce(c.name, '') = '' THEN 'missing_name' WHEN op = 'insert' AND b.id IS NOT NULL THEN 'duplicate_id' WHEN op IN ('update', 'delete') AND b.id IS NULL THEN 'unknown_id' WHEN op = 'delete' AND b.is_default THEN 'default_not_deletable' END AS reason
 FROM b FULL JOIN c ON b.id = c.id)"""


def _maintained(spark, sf):
    p, k = inputs.table(spark, sf, "part"), F.col("p_partkey")
    base = p.where(k % 3 != 0).select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("fields"), (F.col("p_size") < 10).alias("is_default"))
    op = F.when(k % 4 == 0, "insert").when(k % 4 == 1, "update").otherwise("delete")
    ch = p.where(k % 4 != 3).select(k.alias("id"), op.alias("op"), F.when(k % 8 != 0, F.concat(F.lit("new "), "p_name")).alias("name"), F.when(k % 5 == 0, "f").alias("fields"))
    return prompts.maintained_types(base, ch)


@query("jn16_maintained_types", f"""WITH {_CH} SELECT id, CASE WHEN op IS NOT NULL AND reason IS NULL THEN coalesce(cn, bn) ELSE bn END AS name, CASE WHEN op IS NOT NULL AND reason IS NULL THEN coalesce(cf, bf) ELSE bf END AS fields, coalesce(bd, false) AS is_default FROM j
WHERE NOT (coalesce(op = 'delete', false) AND reason IS NULL) AND (bn IS NOT NULL OR reason IS NULL)""")
def maintained_types(spark, sf):
    return _maintained(spark, sf)[0]


@query("jn16_rejected_changes", f"WITH {_CH} SELECT id, op, reason FROM j WHERE reason IS NOT NULL")
def rejected_changes(spark, sf):
    return _maintained(spark, sf)[1]
