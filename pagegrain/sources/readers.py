"""Reading layout results, raw lines, uploads, text files and configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.sources import spread
from pagegrain.sources.uploads import listed

# Accepted upload types, their leading bytes and the size limit.
SIGNATURES = {"pdf": "25504446", "jpg": "FFD8FF", "jpeg": "FFD8FF", "png": "89504E470D0A1A0A"}
MAX_UPLOAD = 10 * 1024 * 1024
LINE_SCHEMA = """job_id string, scale_info struct<scale_x:double,scale_y:double>,
  ocr_result array<struct<text:string,confidence:double,bbox:struct<x:double,y:double,width:double,height:double>>>"""


def job_of(path: Column, suffix: str = "") -> Column:
    """Job id from a file path: the file name up to an optional suffix and the extension."""
    return F.regexp_extract(path, rf"([^/]+?){suffix}\.[A-Za-z0-9]+$", 1)


def upload_reason(ext: Column, size: Column, head: Column) -> Column:
    """First rule an upload breaks, or null: type, size limit, emptiness, leading bytes."""
    ok = None
    for e, sig in SIGNATURES.items():
        hit = (ext == e) & F.startswith(F.hex(head), F.lit(sig))
        ok = hit if ok is None else ok | hit
    return (F.when(~F.coalesce(ext, F.lit("")).isin(*SIGNATURES), "unsupported_type").when(size > MAX_UPLOAD, "too_large")
            .when(size == 0, "empty").when(~F.coalesce(ok, F.lit(False)), "signature_mismatch"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with a verdict, empty files too; of each no more than its first 8 bytes is read."""
    return judged_uploads(listed(spark, path))


def judged_uploads(f: DataFrame) -> DataFrame:
    """Verdict on files given as (path, length, content)."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    out = f.select("path", F.col("length").alias("size"), ext.alias("ext"), F.substring("content", 1, 8).alias("head"))
    out = out.withColumn("reason", upload_reason(F.col("ext"), F.col("size"), F.col("head")))
    return out.withColumn("is_valid", F.col("reason").isNull()).drop("head")


def layout_items(spark: SparkSession, path: str, suffix: str = "(?:_layout)?", folder: str | None = None) -> DataFrame:
    """Layout result files, one per job, to item rows with a variant ``res``.

    ``suffix`` is what follows the job id in a file name; ``folder`` names it
    where it is a folder ``name=id`` instead. A file holds an object with
    ``items`` or ``res``, or a bare list.
    """
    job = F.col(folder).cast("string") if folder else job_of(F.col("_metadata.file_path"), suffix)
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), job.alias("job_id"))
    return items_of(raw)


def spread_texts(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """Files saved by ``spread``, a job each: job_id (the file name up to the extension) and the text as ``name``."""
    return spread.texts(spark, path).select(F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "").alias("job_id"), F.col("value").alias(name))


def items_of(results: DataFrame) -> DataFrame:
    """Item rows of parsed layout results (``job_id``, variant ``v``)."""
    kind = "array<variant>"
    items = F.coalesce(F.try_variant_get("v", "$.items", kind), F.try_variant_get("v", "$.res", kind), F.try_variant_get("v", "$", kind))
    rows = results.select("job_id", F.posexplode_outer(items).alias("ord", "i")).where(F.col("ord").isNotNull())
    get = lambda k, t: F.try_variant_get("i", f"$.{k}", t)
    return rows.select("job_id", "ord", F.coalesce(get("type", "string"), F.lit("text")).alias("type"), get("bbox", "array<double>").alias("bbox"),
                       F.coalesce(get("res", "variant"), get("text", "variant")).alias("res"),
                       F.coalesce(get("score", "string"), get("confidence", "string")).alias("score"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw recognition files to line rows."""
    return lines_of(spark.read.schema(LINE_SCHEMA).option("multiLine", "true").json(path))


def lines_of(raw: DataFrame) -> DataFrame:
    """Line rows of recognition results (``LINE_SCHEMA``)."""
    rows = raw.select("job_id", F.posexplode_outer("ocr_result").alias("line_no", "l")).where(F.col("line_no").isNotNull())
    x, y = F.col("l.bbox.x"), F.col("l.bbox.y")
    return rows.select("job_id", "line_no", "l.text", "l.confidence", x.alias("x1"), y.alias("y1"), (x + F.col("l.bbox.width")).alias("x2"), (y + F.col("l.bbox.height")).alias("y2"))


def whole_texts(spark: SparkSession, path: str, name: str, folder: str | None = None) -> DataFrame:
    """Text files as one row each, keyed by job: the file name, or the folder ``name=id`` that ``folder`` names."""
    t = spark.read.text(path, wholetext=True)
    job = F.col(folder).cast("string") if folder else job_of(F.col("_metadata.file_path"))
    return t.select(job.alias("job_id"), F.col("value").alias(name))


def first_content(jobs: DataFrame, key: str, **sources: DataFrame) -> DataFrame:
    """First non-empty content of each job over the sources, in the order given.

    Which source a job takes is settled on keys alone, a partial aggregate; then
    the texts are joined once, however many sources there are. A job without any
    content has nulls; equal keys in the chosen source each give a row. Rows that
    come from files have no size the planner knows, so both joins are told to merge:
    texts and keys are never gathered on the driver for a broadcast.
    """
    tagged = reduce(DataFrame.unionByName, [s.where(F.col(n) != "").select(key, F.lit(i).alias("_rank"), F.col(n).alias("content")) for i, (n, s) in enumerate(sources.items())])
    chosen = jobs.select(key).join(tagged.groupBy(key).agg(F.min("_rank").alias("_rank")).hint("merge"), key, "left")
    name = F.coalesce(*[F.when(F.col("_rank") == i, n) for i, n in enumerate(sources)])
    return chosen.join(tagged.hint("merge"), [key, "_rank"], "left").select(key, name.alias("source"), "content")


def config_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small JSON list used as a dimension."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def first_found(key: str, *roots: DataFrame) -> DataFrame:
    """One row per key from the first root that has it, as a partial aggregate over a union."""
    tagged = [r.withColumn("_p", F.lit(i)) for i, r in enumerate(roots)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in every.columns if c not in (key, "_p")]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), "_p").alias("_r"), F.min("_p").alias("root")).select(key, "_r.*", "root")
