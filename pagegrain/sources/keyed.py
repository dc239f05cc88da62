"""Tables on disk from which single keys are replaced or removed, the rest staying as it is.

Rows lie in buckets of their key. A save reads the touched buckets alone, drops
the rows of the keys it writes, adds the new ones, writes these buckets to a
folder of its own version and then appends one row a bucket to the manifest,
which names the folder that holds a bucket now. Readers follow the manifest, so
they see the state before a save or after it; a save that fails leaves files no
one reads. Old folders stay until ``vacuum``. One writer at a time.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain.session import shuffles_freed

BUCKETS = 64
_MANIFEST = "version long, buckets int, bucket int, folder string, columns string, format string"


def bucket_of(key: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _state(spark: SparkSession, path: str) -> list:
    """The manifest's last row of every bucket; as many rows as buckets at most."""
    if not _exists(spark, f"{path}/manifest"):
        return []
    m = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    rest = F.struct(*[c for c in m.columns if c != "bucket"])
    return m.groupBy("bucket").agg(F.max_by(rest, "version").alias("r")).select("bucket", "r.*").collect()


def _rows(spark: SparkSession, path: str, state: list) -> DataFrame | None:
    """The current rows of these buckets, with their bucket."""
    held = [s for s in state if s.folder]
    if not held:
        return None
    last = max(state, key=lambda s: s.version)
    schema = T.StructType.fromJson(json.loads(last.columns))
    return spark.read.format(last.format).schema(schema).option("basePath", f"{path}/data").load([f"{path}/data/version={s.folder}/bucket={s.bucket}" for s in held]).drop("version")


def load(spark: SparkSession, path: str) -> DataFrame:
    """All rows as they are now."""
    state = _state(spark, path)
    if not state:
        raise ValueError(f"no table at {path}")
    rows = _rows(spark, path, state)
    last = max(state, key=lambda s: s.version)
    schema = T.StructType.fromJson(json.loads(last.columns))
    return (rows if rows is not None else spark.createDataFrame([], schema)).drop("bucket")


def save(df: DataFrame, path: str, key: str, fmt: str = "parquet", buckets: int | None = None) -> None:
    """Write ``df`` in place of the rows of its keys. ``buckets`` counts for the first save only."""
    _replace(df.sparkSession, path, key, df, None, fmt, buckets)


def remove(keys: DataFrame, path: str, key: str) -> None:
    """Remove the rows of the keys in ``keys``."""
    _replace(keys.sparkSession, path, key, None, keys.select(key).distinct(), "parquet", None)


def _replace(spark: SparkSession, path: str, key: str, df: DataFrame | None, gone: DataFrame | None, fmt: str, buckets: int | None) -> None:
    state = _state(spark, path)
    if df is None and not state:
        return
    n = state[0].buckets if state else buckets or BUCKETS
    fmt = state[0].format if state else fmt
    version = max((s.version for s in state), default=0) + 1
    folder = f"{version:09d}-{os.urandom(4).hex()}"
    if df is not None and not state:
        # Nothing is there to be replaced: the rows go to their buckets at once.
        df, gone = df.withColumn("bucket", bucket_of(key, n)), None
    elif df is not None:
        staged = f"{path}/staged/{folder}"
        with shuffles_freed(spark):
            df.withColumn("bucket", bucket_of(key, n)).write.parquet(staged)
        df = spark.read.parquet(staged)
        gone = df.select(key).distinct()
    if gone is not None:
        # Keys on disk have a size the planner knows: few of them are sent to the old rows, which then are shuffled once, to their buckets.
        keys = f"{path}/staged/{folder}-keys"
        with shuffles_freed(spark):
            gone.write.parquet(keys)
        gone = spark.read.parquet(keys)
    touched = set(range(n)) if gone is None else {r["b"] for r in gone.select(bucket_of(key, n).alias("b")).distinct().collect()}
    old = _rows(spark, path, [s for s in state if s.bucket in touched])
    kept = old.join(gone, key, "left_anti") if old is not None else None
    merged = df if kept is None else kept if df is None else kept.unionByName(df, allowMissingColumns=True)
    if merged is None:
        return
    with shuffles_freed(spark):
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").format(fmt).save(f"{path}/data/version={folder}")
    columns = T.StructType([f for f in merged.schema.fields if f.name != "bucket"])
    filled = {b for b in touched if _exists(spark, f"{path}/data/version={folder}/bucket={b}")}
    rows = [(version, n, b, folder if b in filled else None, columns.json(), fmt) for b in sorted(touched if state else filled)]
    if rows:
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete the folders that no bucket refers to any more, and what saves have staged."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop(path).getFileSystem(conf)
    used = {s.folder for s in _state(spark, path)}
    if fs.exists(hadoop(f"{path}/data")):
        for f in fs.listStatus(hadoop(f"{path}/data")):
            if f.getPath().getName().removeprefix("version=") not in used:
                fs.delete(f.getPath(), True)
    fs.delete(hadoop(f"{path}/staged"), True)
