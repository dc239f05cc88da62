"""Session settings the operators rely on."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Only where no master is given: a high number of partitions for the optimizer to start from, and stream state on disk.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(name: str = "pagegrain", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **({} if master else CLUSTER_SETTINGS), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` names that folder. Where it is unset, a local session
    uses a temporary folder; on a cluster, whose executors do not share one, that
    is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset; with master {master} it must name a folder that driver and executors share")
        return os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), label)
    return os.path.join(root, f"{label}-{os.urandom(6).hex()}")


#: Spark removes the shuffle files of a query as it ends where this is set; older versions don't know it and go on as before.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go with the write, not when the driver comes to collect its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before) if before else spark.conf.unset(FREED)


def written(df: DataFrame, label: str, count: Column | None = None) -> tuple[DataFrame, int]:
    """``df`` written to the shared folder and read back, so that its lineage ends there, with what ``count`` counted on the way."""
    path, seen = shared_dir(df.sparkSession, label), Observation()
    (df if count is None else df.observe(seen, count.alias("n"))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), 0 if count is None else seen.get["n"]
