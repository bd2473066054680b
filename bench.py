"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagelayout.plans import catalog  # noqa: E402
from pagelayout.session import local_session  # noqa: E402

HEADLINE = [
    "page_summary", "F1_filter_boxes", "W1_group_lines", "W2_group_paragraphs", "W3_text_offsets", "A11_page_text", "A6_ocr_quality",
    "F6_shift_tiles_to_page", "J1_overlap_pairs", "J3_seam_pairs", "O6_dedupe_paragraphs", "W6_row_detail_score", "W7_choose_cuts",
    "W4_allocate_words", "J5_fill_missing_segments", "T6_sanitize_marked_text", "T7_merge_overlap_text", "F9_token_quads", "A5_oriented_bounds",
    "W8_curve_offsets", "A15_render_overlay_html", "S6_extract_page_images", "A7_batch_progress", "W12_stage_durations", "A14_stage_latency",
    "J13_stale_results", "R6_throttle",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    known = catalog.registered()
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
