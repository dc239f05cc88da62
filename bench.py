"""Time the headline queries and print one JSON line.

Every query runs once untimed at a small scale to warm the session, then once
timed over the whole tables of $BENCH_SF_DIR; results go to a sink that reads
every row and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagegrain.plans.registry import load_all  # noqa: E402
from pagegrain.session import build_session  # noqa: E402

HEADLINE = [
    "document_readability", "jn1_region_line_confidence", "jn4_lines_outside_regions", "jn5_overlap_dedup", "ord1_reading_order", "agg1_3_document_confidence",
    "agg9_column_types", "win8_anchored_rows", "win10_split_tables", "blk1_region_blocks", "val4_document_verdicts", "md3_anchored_markdown", "md4_parsed_anchors", "md6_markdown_blocks",
    "jn6_last_view", "jn12_structural_diff", "txt1_normalize_unicode", "txt4_recognition_repair", "txt11_redaction", "txt24_error_triage", "chk1_fixed_chunks", "chk2_paragraph_chunks", "chk4_mixed_chunks",
    "win11_page_chunks", "top1_nearest_chunks", "win4_packed_context", "str1_job_states", "win5_history", "win6_upsert", "jn9_valid_jobs", "snk3_index_append",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "pagegrain.input.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_all()
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    times: dict[str, float] = {}
    for name in HEADLINE:
        if os.path.isdir(warm):
            entries[name].build(spark, warm).write.format("noop").mode("overwrite").save()
        start = time.time()
        entries[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
