"""Pages that fit in a task get their lines where their boxes lie; the result is that of pages cut in ranges."""

import re

from test_scale_paths import brute_lines, random_boxes

from pagelayout.operators import layout
from pagelayout.plans import layout_queries
from pagelayout.plans.catalog import registered

SCHEMA = "image_id long, box_id long, text string, confidence double, l double, t double, r double, b double, angle_deg double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, path):
    texts = [(1, "a b\nc " * 40), (2, ""), (3, None), (4, "one two  three"), (4, "a longer text of the same number " * 9), (None, "x y")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_boxes_are_not_moved(spark, tmp_path):
    d = documents(spark, tmp_path)
    for name in ("W1_group_lines", "page_summary"):
        plan = plan_of(registered()[name].run(spark, d))
        lines = plan.splitlines()
        arrow = [i for i, x in enumerate(lines) if "FlatMapGroupsInArrow" in x]
        words = [i for i, x in enumerate(lines) if "Generate" in x]
        assert len(arrow) == 1 and len(words) == 1  # every box is made once, and no second branch makes it again
        assert not re.search("Exchange|Window", "\n".join(lines[arrow[0] : words[0]]))


def test_sizes_meet_texts_before_words(spark, tmp_path):
    rows = layout_queries.views.sized_boxes(spark, documents(spark, tmp_path)).groupBy("image_id", "h").count().collect()
    got = sorted((r.image_id, r["count"]) for r in rows)
    assert got == [(1, 120), (4, 66), (4, 66)]  # two documents of one number: all their words with both sizes, as a join of boxes gives
    assert "Join" not in plan_of(layout_queries.views.sized_boxes(spark, str(tmp_path))).partition("Generate")[0]


def test_whole_and_spread_pages_agree(spark):
    rows = [(p, *b[1:2], f" w{b[1]} " if b[1] % 7 else None, *b[3:8], float(b[1] % 5) if b[1] % 3 else None) for p in (1, 2) for b in random_boxes(150 * p, p)]
    rows += [(3, 1, "a", 0.5, 5.0, 0.0, 9.0, 10.0, 1.0), (3, 1, "b", 0.5, 5.0, 0.0, 9.0, 10.0, 2.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    large = layout.large_pages(frame)
    assert large is not None
    got = {(r.image_id, r.box_id): r.line_no for r in layout._whole_pages(frame).collect()}
    assert got == {(r.image_id, r.box_id): r.line_no for r in layout._spread_pages(frame, large).collect()}
    assert {k[1]: n for k, n in got.items() if k[0] == 2} == brute_lines([r for r in rows if r[0] == 2])
    whole = layout._offsets(layout._paragraphs(layout._whole_page_lines(frame, ["confidence"]), None), None)
    spread = layout._spread_layout(frame, large, ["confidence"]).select(*whole.columns)
    flat = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert whole.dtypes == spread.dtypes and flat(whole) == flat(spread)
