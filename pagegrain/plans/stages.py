"""User-defined stages, and the three entry points as compositions of operators."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagegrain.functions import labels
from pagegrain.operators import blocks, chunking, confidence, documents, layout, prompts, retrieval, spatial


class Stage(Protocol):
    """A validator, recogniser, normaliser or any other step: rows in, rows out."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def run_stages(df: DataFrame, stages: dict[str, Stage]) -> tuple[DataFrame, dict[str, Observation]]:
    """Chain named stages; every stage reports its row count when the result is computed."""
    seen: dict[str, Observation] = {}
    for name, stage in stages.items():
        seen[name] = Observation(name)
        df = stage(df).observe(seen[name], F.count(F.lit(1)).alias("rows"))
    return df, seen


def tracked(name: str, step: Callable[[], None]) -> dict[str, object]:
    """Run a step and describe it as an operation row: outcome, duration and error."""
    start = time.time()
    try:
        step()
        return {"name": name, "success": True, "duration": time.time() - start, "error": None}
    except Exception as e:  # the row is the result
        return {"name": name, "success": False, "duration": time.time() - start, "error": f"{type(e).__name__}: {e}"[:500]}


def scored_documents(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Layout regions and recognised lines to document confidence."""
    typed = confidence.flagged(regions.withColumn("region_type", layout.retyped_region(F.col("type"), F.col("content"))))
    return confidence.confidence_of_flags(spatial.region_confidence(typed, lines, carry=confidence.FLAGS))


def typed_blocks(regions: DataFrame) -> DataFrame:
    """Layout regions to typed blocks in one narrow pass."""
    kept = layout.drop_empty(regions)
    return blocks.region_blocks(kept.withColumn("region_type", labels.region_type(F.col("type"))))


def indexed_texts(texts: DataFrame, key: str = "doc_id", strategy: str = "mixed", encoder: retrieval.Encoder | None = None) -> DataFrame:
    """Document texts to chunk vectors ready to be stored; short texts are left out."""
    long = texts.where(F.length(F.trim("text")) >= 50)
    rows = retrieval.index_rows(chunking.chunks(long, key, strategy=strategy), key)
    return retrieval.encode(rows, "text", encoder=encoder)


def prompt_table(queries: DataFrame, chunk_vectors: DataFrame, indexed: DataFrame, on: list[str], question: Column) -> DataFrame:
    """Questions with vectors to a table of prompts over retrieved context."""
    context = retrieval.build_context(queries, chunk_vectors, indexed, on)
    asked = queries.join(context, "query_id")
    return asked.select("query_id", prompts.question_prompt(F.col("context"), question).alias("prompt"))


def workbench_markdown(pages: DataFrame, items: str = "items") -> DataFrame:
    """Layout items to anchored Markdown, in y order."""
    return documents.anchored_markdown(documents.anchored_parts(layout.sort_regions(pages, "y", items), items))
