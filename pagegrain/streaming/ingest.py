"""Continuous ingestion of layout results: regions, blocks, chunks, and a row for every document that fails.

A document is judged by itself, at each step, with functions that give null where they
can't go on; so a broken one becomes a failure row and the others of its batch pass.
Every output has a folder a batch, replaced when the batch runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.text import strip
from pagegrain.operators import chunking, retrieval
from pagegrain.plans.stages import typed_blocks
from pagegrain.sources.readers import items_of
from pagegrain.streaming.live import Sink, batch_folder

DOC = "doc_id"


def parsed(files: DataFrame) -> DataFrame:
    """Layout texts (doc_id, value) with their variant and the first step that fails, if any."""
    listed = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$.items", "$.res", "$")])
    blank = F.coalesce(strip("value") == "", F.lit(True))
    fails = F.when(blank, "read:empty").when(F.col("v").isNull(), "parse:not_json").when(listed.isNull(), "layout:no_items")
    return files.select(DOC, "value").withColumn("v", F.try_parse_json("value")).select(DOC, "v", fails.alias("failed"))


def regions(results: DataFrame) -> DataFrame:
    """Region rows of parsed results; items without four numbers for a box are no regions."""
    items = items_of(results.select(F.col(DOC).alias("job_id"), "v"))
    text = F.coalesce(F.try_variant_get("res", "$.html", "string"), F.try_variant_get("res", "$[0].text", "string"), F.try_variant_get("res", "$", "string"), F.lit(""))
    box = [F.element_at("bbox", i + 1).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    good = items.where((F.size("bbox") == 4) & ~F.exists("bbox", lambda x: x.isNull()))
    return good.select(F.col("job_id").alias(DOC), "ord", "type", *box, text.alias("content"))


def texts(blocks: DataFrame) -> DataFrame:
    """A document's blocks as one text, from top to bottom."""
    each = F.array_sort(F.collect_list(F.struct("y1", "ord", strip("content").alias("t"))))
    return blocks.groupBy(DOC).agg(each.alias("b")).select(DOC, F.array_join(F.transform("b", lambda b: b["t"]), "\n\n").alias("text"))


def _failures(stage_docs: DataFrame, passed: DataFrame, failed: str) -> DataFrame:
    return stage_docs.select(DOC).join(passed.select(DOC).distinct(), DOC, "left_anti").select(DOC, F.lit(failed).alias("failed"))


def layouts_sink(path: str, strategy: str = "mixed", **options: Column | int) -> Sink:
    """Sink for (doc_id, value): folders ``blocks``, ``index`` and ``failures`` (doc_id, step, reason)."""
    save = {n: batch_folder(path, n) for n in ("blocks", "index", "failures")}

    def sink(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        back = lambda n: spark.read.parquet(f"{path}/{n}/part={batch}")
        judged = parsed(df).persist()
        try:
            good = judged.where("failed IS NULL")
            placed = regions(good)
            save["blocks"](typed_blocks(placed).select(DOC, "ord", "block_id", "block_type", "content", "data", "y1"), batch)
            blocks = back("blocks")
            save["index"](retrieval.index_rows(chunking.chunks(texts(blocks), DOC, strategy=strategy, **options), DOC), batch)
            seen = placed.select(DOC).distinct()
            failed = (judged.where("failed IS NOT NULL").select(DOC, "failed").unionByName(_failures(good, seen, "regions:no_box"))
                      .unionByName(_failures(seen, blocks, "blocks:no_text")).unionByName(_failures(blocks.select(DOC).distinct(), back("index"), "index:no_chunk")))
            parts = F.split("failed", ":")
            save["failures"](failed.select(DOC, parts[0].alias("step"), parts[1].alias("reason")), batch)
        finally:
            judged.unpersist()
    return sink
