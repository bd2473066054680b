"""Small inputs with known answers."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from pagelayout.functions import text as tx
from pagelayout.operators import layout, pages, render, tiles
from pagelayout.sources import images as im

BOX = "image_id long, box_id long, text string, confidence double, l double, t double, r double, b double, angle_deg double, w int, h int"


def boxes(spark, rows, w=200, h=200):
    return spark.createDataFrame([(1, i, t, c, float(l), float(a), float(r), float(b), 0.0, w, h) for i, (t, c, l, a, r, b) in enumerate(rows)], BOX)


def test_two_lines_make_one_paragraph(spark):
    lines = layout.layout_from_boxes(boxes(spark, [("HELLO", 0.9, 10, 20, 110, 50), ("WORLD", 0.9, 12, 70, 120, 100)]))
    p = layout.paragraph_table(lines).collect()
    assert [r.text for r in p] == ["HELLO\nWORLD"]
    item = layout.lines_to_items(lines.withColumns({"w": F.lit(200), "h": F.lit(200)})).orderBy("item_index").collect()[0]
    assert (item.box.left, item.box.top) == (0.05, 0.1)


def test_filter_clamps_and_drops(spark):
    rows = [("LOW", 0.1, 0, 0, 50, 50), ("TINY", 0.9, 10, 10, 11, 11), ("OK", 0.9, -5, -5, 50, 30)]
    kept = layout.filter_boxes(boxes(spark, rows, 100, 100)).collect()
    assert [(r.text, r.l, r.t, r.r, r.b) for r in kept] == [("OK", 0, 0, 50, 30)]


def test_reading_order(spark):
    rows = [("B", 0.9, 60, 10, 90, 30), ("A", 0.9, 10, 10, 40, 30), ("C", 0.9, 10, 60, 40, 80)]
    lines = layout.line_table(layout.group_lines(boxes(spark, rows))).orderBy("line_no").collect()
    assert [r.text for r in lines] == ["A B", "C"]


def test_resize_and_scale_back(spark):
    plan = layout.resize_plan(spark.createDataFrame([(1, 240, 120)], "image_id long, w int, h int"), 120).collect()[0]
    assert (plan.ocr_w, plan.ocr_h, plan.scale_x, plan.scale_y) == (120, 60, 2.0, 2.0)


def test_both_recogniser_shapes(spark):
    nested = '[[[[[10,20],[110,20],[110,50],[10,50]],["HELLO",0.94]],[[[12,70],[120,70],[120,100],[12,100]],["WORLD","bad"]]]]'
    flat = '{"res": {"rec_texts": ["A", " ", "B"], "rec_scores": [0.9, 0.5, 0.8], "rec_boxes": [[1,2,30,12],[0,0,1,1],[40,3,80,15]]}}'
    got = im.ingest_ocr_boxes(spark.createDataFrame([(1, nested), (2, flat), (3, "no json")], "image_id long, raw string")).orderBy("image_id", "box_id").collect()
    assert [(r.image_id, r.text, r.confidence, r.l, r.t, r.r, r.b) for r in got] == [
        (1, "HELLO", 0.94, 10, 20, 110, 50), (1, "WORLD", 1.0, 12, 70, 120, 100), (2, "A", 0.9, 1, 2, 30, 12), (2, "B", 0.8, 40, 3, 80, 15),
    ]


def test_recogniser_results_with_faults(spark):
    square = [[0, 0], [10, 0], [10, 5], [0, 5]]
    raws = [
        [[[square, ["hi", 0.9]], [square, ["  ", 0.9]], [[[0, 0], ["x"], [10, 0], [10, 5], [0, "5.5"]], ["one bad point", None]], [square[:3], ["three points", 1]]]],
        {"res": {"rec_texts": ["a", "b", None, "d"], "rec_scores": [0.5, "x"], "rec_polys": [square], "rec_boxes": [[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4], ["q", 1, 2, 3]]}},
        [{"data": [[square, ["n", 1]]]}, {"texts": [], "rec_texts": ["z"], "boxes": [[0, 0, 1, 1]]}, {"other": 1}, 5, None],
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(raws)] + [(3, "no json"), (4, None), (5, " "), (6, "[" * 70 + "]" * 70), (7, "[]"), (8, "5")]
    d = spark.createDataFrame(rows, "image_id long, raw string")
    got = [(r.image_id, r.box_id, r.text, r.confidence, r.l, r.t, r.r, r.b) for r in im.ingest_ocr_boxes(d).orderBy("image_id", "box_id").collect()]
    assert got == [(0, 0, "hi", 0.9, 0, 0, 10, 5), (0, 1, "one bad point", 1.0, 0, 0, 10, 5.5), (1, 0, "a", 0.5, 0, 0, 10, 5), (1, 1, "b", 1.0, 1, 2, 3, 4), (2, 0, "n", 1.0, 0, 0, 10, 5), (2, 1, "z", 1.0, 0, 0, 1, 1)]
    assert {(r.image_id, r.reason) for r in im.ocr_rejects(d).collect()} == {(3, "no JSON"), (6, "nested too deep")}
    assert im.ingest_ocr_boxes(d.limit(0)).count() == 0


PARA = "image_id long, side string, rid long, text string, l double, t double, r double, b double"
TILE = "image_id long, tile_no int, y int, h int, page_h int"


def test_duplicate_paragraphs(spark):
    rows = [(1, "original", i, t, *map(float, b)) for i, (t, b) in enumerate([("WHY ARE YOU HERE", (200, 2920, 610, 3060)), ("WHY ARE YOU HERE", (202, 2924, 612, 3064)), ("SOMETHING ELSE NOW", (210, 3180, 590, 3290))])]
    kept = tiles.dedupe_paragraphs(spark.createDataFrame(rows, PARA)).orderBy("para_index").collect()
    assert [(r.rid, r.para_index) for r in kept] == [(0, 0), (2, 1)]


def seam_case(spark):
    rows = [(1, "original", 0, "WHY ARE YOU TELLING THIS LIKE", 200.0, 1000.0, 600.0, 1090.0), (1, "original", 1, "LIKE IT'S SOME KIND OF HORROR STORY?", 202.0, 1010.0, 602.0, 1200.0)]
    return spark.createDataFrame(rows, PARA), spark.createDataFrame([(1, 0, 0, 1100, 3000), (1, 1, 920, 1500, 3000)], TILE)


def test_seam_merge(spark):
    p, t = seam_case(spark)
    for near in (1, 24):
        got = tiles.merge_seam_paragraphs(p, t, near=near).collect()
        assert [(r.text, r.merged, r.t, r.b) for r in got] == [("WHY ARE YOU TELLING THIS LIKE IT'S SOME KIND OF HORROR STORY?", 1, 1000.0, 1200.0)]


def test_markers(spark):
    d = spark.createDataFrame([(1, "<<TP_P1>> b b\r\n\r\n<<TP_P0>>\na <<TP_Px> c\nmid <<TP_P0>> word", 2)], "image_id long, marked_text string, expected int")
    clean = tx.sanitize_marked_text(d, "marked_text", "clean").collect()[0].clean
    assert clean == "<<TP_P0>>\na c mid word\n\n<<TP_P1>>\nb b"
    row = d.select(tx.markers_complete("marked_text", "expected").alias("c"), tx.needs_retry("marked_text", "expected").alias("r")).collect()[0]
    assert (row.c, row.r) == (False, False)


def test_long_marker_numbers(spark):
    text = "<<TP_P0000000001>>\nhello\n\n<<TP_P99999999999999999999999999999999999999999>>\nfar\n\n<<TP_P0>> x"
    d = spark.createDataFrame([(1, text, 2)], "image_id long, marked_text string, expected int")
    assert {r.para_index: r.segment for r in tx.marker_segments_for_layout(d, ["image_id"]).collect()} == {0: "x", 1: "hello"}
    assert [(r.para_index, r.segment) for r in tx.marker_segments(d, ["image_id"]).collect()] == [(0, "x")]
    assert not d.select(tx.markers_complete("marked_text", "expected").alias("c")).first().c
    assert d.select(F.size(tx.marker_numbers("marked_text")).alias("n")).first().n == 3


def test_last_click_before_a_result(spark):
    results = spark.createDataFrame([(1, 10, None, "u", 20_000_000), (1, 11, None, "u", 40_000_000), (1, 12, None, "u", 1_000_000)], "page_id long, result_id long, key string, url string, us long")
    images = spark.createDataFrame([], "page_id long, img_no long, key string, original string, current string, src string")
    recent = spark.createDataFrame([], "page_id long, url string, img_no long, us long")
    clicks = spark.createDataFrame([(1, 1, 19_500_000, ["u"]), (1, 2, 25_000_000, ["u"]), (1, 3, 900_000_000, ["u"])], "page_id long, img_no long, us long, urls array<string>")
    assert [(r.result_id, r.rule, r.img_no) for r in pages.match_targets(results, images, recent, clicks).collect()] == [(10, 4, 1)]


def test_merge_overlap(spark):
    d = spark.createDataFrame([("a b c", "b c d"), ("abcd", "cdef"), ("x", "y"), ("", "z ")], "a string, b string")
    got = [r.j for r in tx.merge_overlap_text(d, "a", "b", "j").collect()]
    assert got == ["a b c d", "abcdef", "x y", "z"]
    assert [tiles.join_texts(*r) for r in (("a b c", "b c d"), ("abcd", "cdef"), ("x", "y"), ("", "z "))] == got


def test_allocation_keeps_all_words(spark):
    from pagelayout.operators.align import allocate_words

    d = spark.createDataFrame([("one two three four five", [3, 9]), ("", [1, 2]), ("w x", [0, 0])], "t string, n array<long>")
    assert [r.o for r in allocate_words(d, "t", "n", "o").collect()] == [["one", "two three four five"], ["", ""], ["", "w x"]]


def test_wrap(spark):
    words = [("word", "aaaa", 40.0), ("space", " ", 10.0), ("word", "bbbb", 40.0), ("space", " ", 10.0), ("word", "cccc", 40.0)]
    marked = [("space", " ", 10.0), ("word", "a", 10.0), ("word", "\u200b", 0.0), ("word", "b", 10.0), ("space", " ", 5.0), ("space", " ", 5.0), ("word", "", 0.0), ("word", "c", 10.0), ("space", " ", 10.0)]
    cases = [
        (words, [100.0, 100.0, 100.0], 1, ["aaaa bbbb", "cccc", ""]),
        (words, [1000.0, 1000.0], 2, ["aaaa", "bbbb cccc"]),
        (words, [95.0, 95.0, 95.0], 2, ["aaaa", "bbbb", "cccc"]),  # two words do not fit in nine tenths of a line that is to be spread
        (words, [10.0], 1, ["aaaa bbbb cccc"]),
        (words, [], 1, []),
        ([], [50.0, 50.0], 2, ["", ""]),
        (words, [1000.0] * 5, 5, ["aaaa", "bbbb", "cccc", "", ""]),
        (marked, [1000.0], 1, ["a\u200bb  c"]),
        (marked, [1000.0, 1000.0], 2, ["a\u200b", "b  c"]),
        (marked, [1000.0, 1000.0, 1000.0], 3, ["a\u200b", "b", "c"]),
    ]
    d = spark.createDataFrame([(i, t, c, m) for i, (t, c, m, _) in enumerate(cases)], "i int, t array<struct<kind:string,text:string,width:double>>, c array<double>, m int")
    got = {r.i: r.x for r in d.select("i", render.wrap_words(F.col("t"), F.col("c"), F.col("m")).alias("x")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)}


def test_overlay_html(spark):
    rect = "struct<l:double,t:double,r:double,b:double,deg:double>"
    p = spark.createDataFrame([(1, 0, "Hi & you", (10.0, 20.0, 110.0, 40.0, 0.0))], f"image_id long, para_index int, text string, rect {rect}")
    i = spark.createDataFrame([(1, 0, 0, "Hi & you", (10.0, 20.0, 110.0, 40.0, 0.0), None, False)], f"image_id long, para_index int, item_index int, text string, rect {rect}, font_px int, wrap boolean")
    html = render.render_overlay_html(p, i, spark.createDataFrame([(1, 200, 100)], "image_id long, w int, h int")).collect()[0].html
    assert html == (
        '<div class="tp-draw-scope" style="width: 200px; height: 100px;"><div class="tp-para tp-para-0" data-para-index="0" style="left: 10.000000px; top: 20.000000px; width: 100.000000px; height: 20.000000px;">'
        '<div class="tp-item tp-item-0" data-para-index="0" data-item-index="0" style="left: 0.000000px; top: 0.000000px; width: 100.000000px; height: 20.000000px; font-size: 17px; line-height: 19px; padding-bottom: 0px;"><span>Hi &amp; you</span></div></div></div>'
    )
    nums = spark.createDataFrame([(0.1,), (-12.3456789,), (100.0,), (9.9999999,)], "x double").select(render.short_number(F.col("x")).alias("s")).collect()
    assert [r.s for r in nums] == ["0.1", "-12.3457", "100", "10"]


def test_natural_sort(spark):
    rows = [("3", "page 10.png"), ("1", "Page 2.png"), ("2", "páge 1.png")]
    d = spark.createDataFrame(rows, "id string, name string").withColumn("relative_path", F.lit(""))
    assert [r.id for r in pages.natural_sort(d).collect()] == ["2", "1", "3"]
    long = d.limit(0).union(spark.createDataFrame([("a", "9" * 12_000, ""), ("b", "1" + "0" * 12_000, "")], "id string, name string, relative_path string"))
    assert [r.id for r in pages.natural_sort(long).collect()] == ["a", "b"]


def png(path, rows):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for px in r for v in (px, px, px)) for r in rows)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_picture_rows_and_catalog(spark, tmp_path):
    png(tmp_path / "a.png", [[0, 0], [10, 30], [10, 30], [255, 255], [255, 255]])
    (tmp_path / "note.txt").write_text("x")
    found = im.catalog_images(spark, str(tmp_path)).collect()
    assert [(r.name, r.relative_path, r.mime) for r in found] == [("a.png", "a.png", "image/png")]
    got = im.row_profile(spark.read.format("image").load(str(tmp_path / "a.png"))).orderBy("y").collect()
    assert [(r.y, r.dy, r.dx, r.dark) for r in got] == [(0, 20.0, 0.0, 1.0), (1, 20.0, 20.0, 1.0), (2, 0.0, 20.0, 1.0), (3, 235.0, 0.0, 0.0), (4, 0.0, 0.0, 0.0)]


def test_last_sighting_before_a_result(spark):
    """The latest picture with the URL not later than the result; ties, unknown times, empty and null URLs, repeated rows."""
    results = spark.createDataFrame([(1, n, None, u, us) for n, u, us in [(10, "u", 5), (11, "u", 9), (12, "u", 20), (13, "", 20), (14, None, 20), (15, "v", 20)]], "page_id long, result_id long, key string, url string, us long")
    images = spark.createDataFrame([], "page_id long, img_no long, key string, original string, current string, src string")
    clicks = spark.createDataFrame([], "page_id long, img_no long, us long, urls array<string>")
    rows = [(1, "u", 7, 6), (1, "u", 2, 9), (1, "u", 4, 9), (1, "u", 4, 9), (1, "u", 9, None), (1, "", 9, 1), (1, None, 9, 1), (2, "v", 9, 1)]
    recent = spark.createDataFrame(rows, "page_id long, url string, img_no long, us long")
    got = sorted((r.result_id, r.rule, r.img_no) for r in pages.match_targets(results, images, recent, clicks).collect())
    assert got == [(11, 3, 4), (12, 3, 4)]


def test_cache_lookup_keeps_caches_apart(spark):
    from pagelayout.operators import jobs

    req = "request_id long, mode string, img_hash string, source string, cache_key string, us long"
    rows = [
        (1, "lens_text", "h", "translated", "k", 10),  # stored before
        (2, "lens_text", "h", "ai", "k", 10),  # the same key, but only in the plain cache
        (3, "lens_text", "h", "cli_codex", "m", 10),  # ai cache
        (4, "lens_text", "h", "translated", "k", 5),  # stored at the same time
        (5, "lens_images", "h", "translated", "k", 10),
        (6, "lens_text", None, "translated", "k", 10),
        (7, "lens_text", "h", None, "k", 10),
        (8, "lens_text", "h", "translated", None, 10),
        (9, "lens_text", "h", "translated", "k", None),
        (1, "lens_text", "h", "translated", "k", 10),
    ]
    requests = spark.createDataFrame(rows, req).withColumn("cache_kind", jobs.cache_kind(F.col("source")))
    stored = spark.createDataFrame([("plain", "k", 5), ("plain", "k", 9), ("ai", "m", 1), ("ai", None, 1), ("plain", "n", None)], "cache_kind string, cache_key string, us long")
    got = sorted((r.request_id, r.cache_kind, r.cache) for r in jobs.cache_lookup(requests, stored).collect())
    kinds = [(1, "plain", "hit"), (1, "plain", "hit"), (2, "ai", "miss"), (3, "ai", "hit"), (4, "plain", "miss"), (5, "plain", "off"), (6, "plain", "off"), (7, "plain", "hit"), (8, "plain", "off"), (9, "plain", "miss")]
    assert got == kinds
    assert {r.cache for r in jobs.cache_lookup(requests, stored.limit(0)).collect()} == {"miss", "off"}
    assert jobs.cache_lookup(requests.limit(0), stored).count() == 0
