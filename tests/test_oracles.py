"""Registered queries against their SQL on the smallest driver tables.

All of them run with PAGELAYOUT_ALL=1 or ``python tests/oracle.py sf0.01``; by default one of each family.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import oracle  # noqa: E402
from pagelayout.plans import catalog  # noqa: E402

SF = f"{oracle.TESTDATA}/sf0.001"
FAMILIES = [
    "page_summary", "W2_group_paragraphs", "A6_ocr_quality", "J4_match_translations", "J5_repair_meta", "W4_allocate_words", "T6_sanitize_marked_text",
    "T11_parse_responses", "J3_seam_pairs", "W6_row_detail_score", "A5_oriented_bounds", "W8_curve_offsets", "W16_fit_font_size", "A7_batch_progress",
    "A14_stage_latency", "J13_stale_results", "W10_queue_position", "T21_classify_error", "S6_extract_page_images", "J16_match_targets", "J9_conform_provider_model",
    "R1_idempotent_submissions", "R2_job_state_stream", "R10_event_windows_stream",
]
NAMES = sorted(catalog.registered()) if os.environ.get("PAGELAYOUT_ALL") else FAMILIES


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    q = catalog.registered()[name]
    df = q.run(spark, SF)
    if q.sql:
        assert oracle.compare(df, con, q.sql) == ""
    else:
        assert df.count() > 0
