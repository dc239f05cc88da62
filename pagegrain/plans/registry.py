"""Registry of runnable queries and the SQL that states the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Build
    sql: str | None


ENTRIES: dict[str, Entry] = {}

MODULES = (
    "layout", "spatial", "confidence", "text", "integrity", "tables", "blocks", "markdown", "chunks", "retrieval", "jobs", "prompts", "files", "streams",

)


def _plain_types(df: DataFrame) -> DataFrame:
    """Widen numbers so that both engines report the same column types."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)`` under ``name``; ``sql`` is its oracle."""

    def wrap(build: Build) -> Build:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(lambda spark, sf: _plain_types(build(spark, sf)), sql)
        return build

    return wrap


def load_all() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"pagegrain.plans.{module}")
    return ENTRIES
