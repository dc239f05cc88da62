"""Comparing a document before and after a step, and the JSON that carries it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import clean
from pagegrain.functions.text import squeeze, words
from pagegrain.operators.skew import last_n

DOC = "doc_id"
# Score of each loss severity, and of an unknown one.
SEVERITY_SCORES = {"none": 1.0, "minor": 0.9, "moderate": 0.7, "severe": 0.4}
UNKNOWN_SCORE = 0.5
SIMILAR = 0.95
SAFE_INTEGER = 2 ** 53
BAD = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def content_statistics(original: Column, processed: Column) -> list[Column]:
    a, b = F.size(words(original)), F.size(words(processed))
    return [F.length(original).alias("original_length"), F.length(processed).alias("processed_length"),
            (F.length(processed) - F.length(original)).alias("length_difference"),
            a.alias("original_words"), b.alias("processed_words"), (b - a).alias("word_difference")]


def line_diff(before: DataFrame, after: DataFrame, key: str = DOC, text: str = "text", pos: str = "line_no") -> DataFrame:
    """Lines that occur more often on one side, with how many and where first.

    Both sides become signed counts of (document, line), combined before the
    shuffle; a line repeated very often costs one row per task.
    """
    a = before.select(key, F.col(text).alias("line"), F.col(pos).alias("at"), F.lit(1).alias("n"))
    b = after.select(key, F.col(text).alias("line"), F.col(pos).alias("at"), F.lit(-1).alias("n"))
    agg = a.unionByName(b).groupBy(key, "line").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("n") > 0, F.col("at"))).alias("at_before"),
        F.min(F.when(F.col("n") < 0, F.col("at"))).alias("at_after"))
    return agg.where(F.col("n") != 0).select(
        key, "line", F.when(F.col("n") > 0, "deletion").otherwise("addition").alias("change"), F.abs("n").alias("times"),
        F.when(F.col("n") > 0, F.col("at_before")).otherwise(F.col("at_after")).alias("first_at"))


def loss_severity(changes: DataFrame, *keep: str) -> DataFrame:
    """Loss flag and severity per document from its change rows."""
    cols = keep or (DOC,)
    lossy = F.col("kind").isin("missing_key", "type_change", "value_change")
    agg = changes.groupBy(*cols).agg(
        F.count_if(lossy).alias("issues"), F.coalesce(F.bool_or(lossy | (F.col("kind") == "length_change")), F.lit(False)).alias("has_loss"))
    n = F.col("issues")
    return agg.withColumn("severity", F.when(n == 0, "none").when(n <= 2, "minor").when(n <= 5, "moderate").otherwise("severe"))


def stage_pairs(documents: DataFrame, stages: str = "stages", *keep: str) -> DataFrame:
    """Consecutive stages of each document from its ordered array of (name, record)."""
    cols = keep or (DOC,)
    n = F.size(stages)
    pairs = F.zip_with(F.slice(stages, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(stages, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(
        F.concat(a["name"], F.lit("->"), b["name"]).alias("pair"), b["name"].alias("to_stage"), a["record"].alias("a"), b["record"].alias("b")))
    return documents.select(*cols, F.inline_outer(pairs)).where(F.col("pair").isNotNull())


def chain_score(severities: DataFrame, key: str = DOC) -> DataFrame:
    """Integrity of a chain of stages: all-clear flag and mean severity score."""
    score = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_SCORES.items() for x in kv]), F.col("severity")), F.lit(UNKNOWN_SCORE))
    return severities.groupBy(key).agg(F.bool_and(~F.col("has_loss")).alias("intact"), F.avg(score).alias("score"))


def key_differences(a: Column, b: Column) -> list[Column]:
    """Keys only in the first JSON object, only in the second, and in both."""
    ka, kb = F.json_object_keys(a), F.json_object_keys(b)
    none = F.array().cast("array<string>")
    ka, kb = F.coalesce(ka, none), F.coalesce(kb, none)
    return [F.array_sort(F.array_except(ka, kb)).alias("missing"), F.array_sort(F.array_except(kb, ka)).alias("added"),
            F.array_sort(F.array_intersect(ka, kb)).alias("common")]


def json_check(c: Column) -> Column:
    """Struct of verdict, error, root type and size, and balance and size warnings."""
    v = F.try_parse_json(c)
    blank = squeeze(c) == ""
    count = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    shape = F.schema_of_variant(v)
    root = (F.when(F.startswith(shape, F.lit("OBJECT")), "dict").when(F.startswith(shape, F.lit("ARRAY")), "list").when(shape == "STRING", "str")
            .when(shape == "BIGINT", "int").when(shape == "BOOLEAN", "bool").when(shape == "VOID", "null").when(shape.isNotNull(), "float"))
    size = F.when(root == "dict", F.size(F.json_object_keys(c))).when(root == "list", F.json_array_length(c))
    ok = ~blank & v.isNotNull()
    return F.struct(ok.alias("is_valid"), F.when(blank, "empty").when(v.isNull(), "syntax").alias("error"), root.alias("root_type"), size.alias("root_size"),
                    (ok & (count("{") != count("}"))).alias("unbalanced_braces"), (ok & (count("[") != count("]"))).alias("unbalanced_brackets"),
                    (ok & (F.length(c) > 1000000)).alias("very_large"))


def number_issue(c: Column) -> Column:
    """Why a float cannot be written as JSON, or a warning about its size."""
    return (F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), "infinity").when(F.abs(c) > 1e308, "very_large"))


def integer_issue(c: Column) -> Column:
    return F.when(F.abs(c) > SAFE_INTEGER, "unsafe_integer")


def text_issue(c: Column) -> Column:
    return F.when(c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control_characters").when(F.length(c) > 1000000, "very_long")


def bad_characters(c: Column, n: int = 5) -> Column:
    """The first ``n`` control characters of a text as escapes, for a warning line."""
    found = F.slice(F.regexp_extract_all(c, F.lit(BAD), 0), 1, n)
    return F.transform(found, lambda x: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(x))), 4, "0")))


def first_differences(diff: DataFrame, key: str = DOC, n: int = 10) -> DataFrame:
    """The first ``n`` changed lines of every document, for a report."""
    return last_n(diff, [key], [F.col("first_at"), F.col("change"), F.col("line")], n).drop("_rn")


def repaired_columns(df: DataFrame) -> DataFrame:
    """Make every column JSON-safe by its type.

    NaN and infinities become null, decimals doubles, times ISO text, bytes text.
    """
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif kind == "decimal":
            c = c.cast("double")
        elif kind in ("timestamp", "timestamp_ntz"):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            part = F.date_format(c, "SSSSSS")
            c = F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "binary":
            c = clean.decoded(c)["text"]
        out.append(c.alias(f.name))
    return df.select(*out)
