"""Prompts and responses as tables, and the document-type dimension behind them.

The model call sits between two tables and belongs to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.text import strip

CONTEXT_LIMIT, PROMPT_LIMIT = 32000, 8000
# Markers that mean a field was not found.
MISSING = ["未找到", "null"]
# The wording of the prompts.
EXTRACT_HEAD = "你是一个专业的文档信息提取助手。请从以下文档内容中提取指定的字段信息。\n\n"
ANSWER_HEAD = "你是一个专业的文档问答助手。请基于以下文档内容回答用户的问题。\n\n文档内容：\n"
JSON_HEAD = "\n\n请按照以下 JSON 格式返回结果，不要添加任何其他说明文字：\n{\n"


# What follows the JSON of an extraction prompt, and the question of a question prompt.
EXTRACT_NOTES = """

注意事项：
1. 如果某个字段在文档中找不到，返回 null
2. 保持提取值的原始格式（如日期、金额格式）
3. 只返回 JSON，不要添加 markdown 代码块标记或其他说明
4. 确保 JSON 格式正确，可以被解析"""
ANSWER_NOTES = """

请按照以下要求回答：
1. 只基于文档内容回答，不要编造信息
2. 如果文档中没有相关信息，请明确告知
3. 在回答中引用文档原文作为依据
4. 使用简洁清晰的语言

请按照以下 JSON 格式返回，不要添加任何其他说明文字：
{
    "answer": "你的回答",
    "references": ["引用的原文片段1", "引用的原文片段2"],
    "found_in_document": true或false
}

注意：只返回 JSON，不要添加 markdown 代码块标记或其他说明"""


def typed_documents(documents: DataFrame, types: DataFrame, type_col: str = "doc_type") -> DataFrame:
    """Documents with the fields and hint of their type.

    A document's own field list wins over its type's; none at all is an error
    row. Whether the types are broadcast is left to the optimizer, which checks
    their size.
    """
    dim = types.select(F.col("id").alias(type_col), F.col("fields").alias("_fields"), F.col("name").alias("type_name"), F.col("hint").alias("_hint"))
    own = F.when(F.size("fields") > 0, F.col("fields"))
    out = documents.join(dim, type_col, "left")
    out = out.withColumns({"fields": F.coalesce(own, "_fields", F.array().cast("array<string>")), "hint": F.coalesce("_hint", F.lit("请仔细分析文档内容"))})
    return out.withColumn("error", F.when(F.size("fields") == 0, "未指定提取字段")).drop("_fields", "_hint")


def checkpoint_questions(documents: DataFrame, types: DataFrame, type_col: str = "doc_type") -> DataFrame:
    """One row per document and non-blank checkpoint question of its type."""
    lines = F.filter(F.transform(F.split("checkpoints", "\n"), strip), lambda q: q != "")
    dim = types.select(F.col("id").alias(type_col), F.posexplode_outer(lines).alias("question_no", "question")).where(F.col("question_no").isNotNull())
    return documents.join(dim, type_col)


def field_list(template: Column, temporary: Column, custom: Column) -> Column:
    """Template, temporary and custom fields in order; blank custom lines are dropped, repeats kept."""
    none = F.array().cast("array<string>")
    own = F.filter(F.transform(F.split(custom, "\n"), strip), lambda f: f != "")
    return F.concat(F.coalesce(template, none), F.coalesce(temporary, none), F.coalesce(own, none))


def truncated(text: Column, limit: int = CONTEXT_LIMIT) -> Column:
    """A prompt holds at most ``limit`` characters of context; the text itself is kept whole elsewhere."""
    return F.substring(text, 1, limit)


def extraction_prompt(hint: Column, content: Column, fields: Column, limit: int = CONTEXT_LIMIT) -> Column:
    """Prompt of one document: hint, content, field list, the JSON to fill in and notes."""
    skeleton = F.array_join(F.transform(fields, lambda f: F.concat(F.lit('    "'), f, F.lit('": "提取的值或null"'))), ",\n")
    return F.concat(F.lit(EXTRACT_HEAD), hint, F.lit("\n\n文档内容：\n"), truncated(content, limit),
                    F.lit("\n\n需要提取的字段：\n"), F.array_join(fields, ", "), F.lit(JSON_HEAD), skeleton, F.lit("\n}"), F.lit(EXTRACT_NOTES))


def question_prompt(content: Column, question: Column, limit: int = CONTEXT_LIMIT) -> Column:
    """Prompt of one question: content, question and the form of the answer."""
    return F.concat(F.lit(ANSWER_HEAD), truncated(content, limit), F.lit("\n\n用户问题："), question, F.lit(ANSWER_NOTES))


def recovered_json(response: Column) -> Column:
    """JSON of a model response as text: fences removed, else the whole, else a fenced block, else the outermost braces."""
    t = strip(response)
    bare = strip(F.regexp_replace(F.regexp_replace(t, r"^```(json)?", ""), r"```\z", ""))
    fenced = F.regexp_extract(response, r"```(?:json)?\s*(\{[\s\S]*?\})\s*```", 1)
    braces = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & (c != ""), c)
    return F.coalesce(ok(bare), ok(fenced), ok(braces))


def extraction_coverage(found: Column, fields: Column) -> Column:
    """Share of requested fields with a value, and the count of those without."""
    n = F.size(fields)
    missing = F.size(F.filter(fields, lambda f: F.try_element_at(found, f).isNull()))
    return F.struct(F.when(n > 0, (n - missing) / n).otherwise(0.0).alias("confidence"), missing.alias("missing"),
                    F.when(missing > 0, F.concat(F.lit("有 "), missing.cast("string"), F.lit(" 个字段未能从文档中找到"))).alias("warning"))


def review_summary(found: Column, confidences: Column) -> Column:
    """Total and found fields, and mean checkpoint confidence as a whole percent."""
    real = F.filter(F.map_values(found), lambda v: F.coalesce((v != "") & ~v.isin(MISSING), F.lit(False)))
    total = F.aggregate(F.transform(confidences, lambda c: F.coalesce(c, F.lit(0.0))), F.lit(0.0), lambda a, c: a + c)
    pct = F.when(F.size(confidences) > 0, F.round(total / F.size(confidences) * 100, 0).cast("bigint")).otherwise(0)
    return F.struct(F.size(found).alias("total_fields"), F.size(real).alias("found_fields"), pct.alias("mean_percent"))


def transcript_header(turns: DataFrame, key: str, exported_at: str) -> DataFrame:
    """The head of every conversation's transcript: time of export, key and number of exchanges."""
    n = turns.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    text = F.concat(F.lit("# 文档问答对话日志\n\n**导出时间**: "), F.lit(exported_at), F.lit("\n**文档 Job ID**: "), F.coalesce(F.col(key).cast("string"), F.lit("未知")),
                    F.lit("\n**对话轮数**: "), F.col("_n").cast("string"), F.lit("\n\n---\n\n"))
    return n.select(key, text.alias("section"))


def transcript(turns: DataFrame, key: str, order: str) -> DataFrame:
    """Transcript sections, one row per exchange, ready to be written in order after the header.

    Sections stay separate rows so that a conversation of any length is never
    gathered on one task. Needs ``number``, ``question``, ``answer``, ``confidence``,
    ``references`` (array), ``processing_time`` in seconds, ``found`` and
    ``answered_at`` (text); the line of a null time is left out.
    """
    quoted = F.array_join(F.transform("references", lambda r, i: F.concat(F.lit("> "), (i + 1).cast("string"), F.lit('. "'), r, F.lit('"\n\n'))), "")
    sources = F.when(F.size("references") > 0, F.concat(F.lit("#### 📎 参考原文\n\n"), quoted)).otherwise("")
    when = F.when(F.col("answered_at").isNotNull(), F.concat(F.lit("| 回答时间 | "), "answered_at", F.lit(" |\n"))).otherwise("")
    text = F.concat(F.lit("## 对话 "), F.col("number").cast("string"), F.lit("\n\n### 🙋 用户问题\n\n"), "question", F.lit("\n\n### 🤖 AI 回答\n\n"), "answer", F.lit("\n\n"), sources,
                    F.lit("#### 📊 元数据\n\n| 指标 | 值 |\n|------|----|\n| 置信度 | "), F.format_string("%.1f%%", F.col("confidence") * 100),
                    F.lit(" |\n| 处理时间 | "), F.format_string("%.2fs", F.col("processing_time")), F.lit(" |\n| 文档中找到 | "), F.when(F.col("found"), "是").otherwise("否"),
                    F.lit(" |\n"), when, F.lit("\n---\n\n"))
    return turns.select(key, order, text.alias("section"))


def maintained_types(base: DataFrame, changes: DataFrame, allow_preset_update: bool = True) -> tuple[DataFrame, DataFrame]:
    """Apply inserts, updates and deletes to a keyed dimension.

    ``base`` has id, name, fields (text) and is_default; ``changes`` has id, op
    and new values, one change per id. Returns the new dimension and the
    rejected changes with a reason.
    """
    b = base.select("id", *[F.col(c).alias(f"b_{c}") for c in ("name", "fields", "is_default")])
    j = b.join(changes, "id", "full_outer")
    known, op = F.col("b_name").isNotNull(), F.col("op")
    preset = F.coalesce(F.col("b_is_default"), F.lit(False))
    reason = (F.when((op == "insert") & (F.coalesce("name", F.lit("")) == ""), "missing_name").when((op == "insert") & known, "duplicate_id")
              .when(op.isin("update", "delete") & ~known, "unknown_id").when((op == "delete") & preset, "default_not_deletable")
              .when((op == "update") & preset & F.lit(not allow_preset_update), "preset_not_changeable"))
    judged = j.withColumn("reason", reason)
    take = op.isNotNull() & F.col("reason").isNull()
    live = judged.where(~(take & (op == "delete")) & (known | take))
    pick = lambda c: F.when(take, F.coalesce(c, f"b_{c}")).otherwise(F.col(f"b_{c}")).alias(c)
    dim = live.select("id", pick("name"), pick("fields"), F.coalesce("b_is_default", F.lit(False)).alias("is_default"))
    return dim, judged.where(F.col("reason").isNotNull()).select("id", "op", "reason")
