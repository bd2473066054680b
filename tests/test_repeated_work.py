"""Work that is done once, not once per mention; answers stay the same."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from pagelayout.functions import text as tx
from pagelayout.operators import geometry as geo
from pagelayout.operators import layout, render, tiles
from pagelayout.plans import catalog
from pagelayout.sources import images as im
from pagelayout.sources import views
from pagelayout.streaming import feeds


def mentions(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count(what)


def test_long_thai_runs(spark):
    run = "ไท ย " * 40_000
    d = spark.createDataFrame([(1, "ab" + run + "\nไ\t\nx")], "doc_id long, text string")
    got = [(r.run, r.is_thai) for r in tx.script_runs(d, ["doc_id"], "text").orderBy("run_no").collect()]
    assert got == [("ab", False), (run, True), ("\n", None), ("ไ\t", True), ("\n", None), ("x", False)]


def test_words_of_a_paragraph_are_numbered_once(spark):
    d = spark.createDataFrame([([("word", "a", 5.0)], [9.0], 1)], "t array<struct<kind:string,text:string,width:double>>, c array<double>, m int")
    assert mentions(d.select(render.wrap_words(F.col("t"), F.col("c"), F.col("m")).alias("x")), "aggregate(") <= 3


def test_angles_are_worked_out_once(spark):
    d = spark.createDataFrame([([(0.0, 0.0), (-1.0, 1.0)],), ([(0.0, 0.0)],), (None,), ([(0.0, 0.0), (None, 1.0)],), ([(0.0, 0.0), (0.0, -2.0)],)], "p array<struct<x:double,y:double>>")
    angle = d.select(layout.poly_angle(F.col("p")).alias("a"))
    assert [r.a for r in angle.collect()] == [-45.0, 0.0, 0.0, None, -90.0]
    assert mentions(angle, "atan2") == 1


def test_baselines_are_worked_out_once(spark):
    names = "i long, x1 double, y1 double, x2 double, y2 double, height_norm double, t0 double, t1 double, w int, h int"
    d = spark.createDataFrame([(1, 0.9, 0.5, 0.1, 0.5, 0.1, None, 0.75, 100, 200), (2, 0.5, 0.5, 0.5, 0.5, 0.1, 0.0, 1.0, 100, 200), (3, 0.1, 0.5, 0.9, 0.5, 0.1, None, None, 100, 200), (4, None, 0.5, 0.9, 0.5, 0.1, 0.0, 1.0, 100, 200)], names)
    g = geo.span_geometry(d)
    got = [(r.i, r.t0, *(round(r[c], 9) for c in ("left", "top", "width", "height", "rotation_deg", "cx", "cy"))) for r in g.collect()]
    assert got == [(1, 0.0, 0.1, 0.45, 0.6, 0.1, 0.0, 0.4, 0.5)]
    assert mentions(g, "atan2(") == 1 and mentions(g, "hypot(") == 1


def test_bends_are_worked_out_once(spark):
    names = "image_id long, para_index int, item_index int, cx double, cy double, width double, height double, rotation_deg double, w int, h int"
    d = geo.curve_offsets(spark.createDataFrame([(1, 0, i, 0.1 * i, 0.1 * i * i, 0.5, 0.2, 3.0, 100, 200) for i in range(3)], names))
    assert [r.curve_px == 0.0 for r in d.orderBy("item_index").collect()] == [True, False, True]  # the ends bend by 3 px, under 0.12 of their height
    assert mentions(d, "atan2(") <= 3


def test_letters_of_a_text_are_counted_in_one_split(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc xyzไé") for _ in range(rng.randint(1, 60))) for _ in range(20)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tiles._letters("t").alias("n"))
    for r in d.collect():
        assert r.n == [sum(ord(c) % 32 == i for c in r.t) for i in range(32)]
    assert mentions(d, "split(") and not mentions(d, "filter(transform(split(")  # in front of the bins, not in each


def test_polygons_of_results_are_read_once(spark):
    d = spark.createDataFrame([(1, "[]"), (2, "  \n"), (3, None), (4, "[")], "image_id long, raw string")
    boxes = im.ingest_ocr_boxes(d)
    assert mentions(boxes, "array<array<double>>") <= 4 and boxes.count() == 0
    assert [(r.image_id, r.reason) for r in im.ocr_rejects(d).collect()] == [(4, "no JSON")]


def test_uris_are_decoded_once(spark):
    d = spark.createDataFrame([(" data:image/png;xyz1,aGk\n",), ("data:,aGk=",), ("none",), (None,), ("ZGF0YTppbWFnZS9wbmc7YmFzZTY0LGFHaw",)], "u string")
    assert mentions(d.select(im.unwrap_data_uris("u").alias("x")), "unbase64") == 1
    got = [(r.mime, bytes(r.bytes), r.x) for r in im.decode_data_uris(d, "u").select("*", im.unwrap_data_uris("u").alias("x")).collect()]
    assert got == [("image/png", b"hi", None), ("application/octet-stream", b"hi", None), ("", b"", None), ("", b"", None), ("", b"", "data:image/png;base64,aGk")]


def test_pages_are_put_together_in_one_exchange(spark):
    page = "image_id long, side string, para_index int"
    paras = spark.createDataFrame([(1, "o", 1, "q"), (1, "o", 0, "p"), (2, "o", 0, None), (None, "o", 0, "n"), (3, "o", 0, "d"), (3, "o", 0, "d")], f"{page}, text string")
    items = spark.createDataFrame([(1, "o", 0, 1, "b", 2.0), (1, "o", 0, 0, "a", 1.0), (1, "o", 9, 0, "lost", 1.0), (None, "o", 0, 0, "n", 1.0), (3, "o", 0, 0, "e", 1.0), (3, "o", 0, 0, "e", 1.0)], f"{page}, item_index int, text string, box double")
    spans = spark.createDataFrame([(1, "o", 0, 1, 1, "y"), (1, "o", 0, 1, 0, "x"), (1, "o", 0, 0, -1, "whole"), (1, "o", 1, 7, 0, "lost"), (3, "o", 0, 0, 0, "f"), (None, "o", 0, 0, 0, "n")], f"{page}, item_index int, span_index int, text string")
    spans = spans.select("*", F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), F.lit(5.0).alias("box"))
    d = layout.assemble_layout(paras, items, spans)
    got = {r.image_id: [(p.para_index, p.text, p["items"] and [(i.item_index, i.text, i.box, i.spans and [(s.span_index, s.text) for s in i.spans]) for i in p["items"]]) for p in r.paragraphs] for r in d.collect()}
    twice = (0, "d", [(0, "e", 1.0, [(0, "f")])] * 2)
    assert got == {1: [(0, "p", [(0, "a", 1.0, []), (1, "b", 2.0, [(0, "x"), (1, "y")])]), (1, "q", None)], 2: [(0, None, None)], None: [(0, "n", None)], 3: [twice, twice]}
    assert layout.assemble_layout(paras, items, spans)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_the_last_hour_of_a_complete_feed_is_given_out(spark, tmp_path):
    rows = [(i, f"2026-01-01 {h}:00:00", 7, "view") for i, h in enumerate(("08", "09", "10"))]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
    for zone in ("timestamp", "timestamp_ntz"):
        sf = str(tmp_path / zone)
        events.withColumn("ts", F.col("ts").cast(zone)).write.parquet(f"{sf}/events.parquet")
        sent = catalog.registered()["R1_idempotent_submissions"].run(spark, sf).collect()
        assert sorted(tuple(r) for r in sent) == [("tp:7-10", 2, 2, False), ("tp:7-8", 0, 0, False), ("tp:7-9", 1, 1, False)]
        let = catalog.registered()["R6_throttle_stream"].run(spark, sf).collect()
        assert sorted(tuple(r) for r in let) == [("2026-01-01", 0), ("2026-01-01", 1), ("2026-01-01", 2)]


def test_keys_of_streams_share_the_state_of_a_slot(spark, tmp_path):
    rows = [(i, f"2026-01-01 0{i % 7}:00:00", f"b{i % 3}", f"i{i % 50}", ("queued", "running", "done")[i % 3], i % 2) for i in range(300)]
    schema = "event_id long, ts string, batch_id string, image_key string, status string, attempt int"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("message", F.lit(None).cast("string"))
    events.write.parquet(str(tmp_path / "events"))
    feed = feeds.read_feed(spark, str(tmp_path / "events"), events.schema)
    items = feeds.batch_items_stream(feed)
    for stream in (items, feeds.throttle_stream(feed, F.col("image_key"), 1)):
        assert "slot#" in stream._jdf.queryExecution().analyzed().toString()
    newest = {}
    for i, ts, batch, image, status, attempt in sorted(rows, key=lambda r: (r[1], r[0])):
        newest[batch, image] = (attempt, "processing" if status == "running" else status)
    got = feeds.newest(feeds.replay(items, "update"), ["batch_id", "image_key"]).collect()
    assert {(r.batch_id, r.image_key): (r.attempt, r.status) for r in got} == newest and len(got) == len(newest)


def test_texts_with_too_little_in_common_are_not_measured(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts += [t[3:] + "x" for t in texts if len(t) > 9]
    for a in texts:
        for b in texts:
            for c, e in ((True, True), (True, False), (False, True), (False, False)):
                assert tiles.texts_same(a, b, c, e) == ((c and tiles.contained_enough(a, b)) or (e and tiles.alike_enough(a, b)))
    assert tiles.in_common(tiles.letter_places("abcbdab"), 7, "bdcaba") == 4

    def measured(*_):
        raise AssertionError("measured")

    monkeypatch.setattr(tiles, "SequenceMatcher", measured)
    fold = tiles._DedupeFold()
    for i, text in enumerate(("one thing or another " * 9, "quite wild jumps by lazy dogs " * 6)):
        assert fold.add((i, 0.0, 100.0 * i, 50.0, 100.0 * i + 90.0, text)) == []
    assert [r[1] for r in fold.close()] == [0, 1]


def test_seams_of_texts_are_looked_up(monkeypatch):
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(2))
        want = max(k for k in range(min(len(a), len(b)) + 1) if not k or a[-k:] == b[:k])
        assert tiles.longest_seam(a, b) == want == tiles.longest_seam(list(a), list(b))
    many = "a" * 500
    assert tiles.longest_seam("b" + many, many + "b") == 500 and tiles.longest_seam(many, many[:200] + "b" + many) == 200

    def walked(*_):
        raise AssertionError("every letter walked")

    monkeypatch.setattr(tiles, "_longest_border", walked)
    assert tiles.join_texts("the end of one strip", "of one strip and more") == "the end of one strip and more"
    assert tiles.join_texts("the end of one str", "one strip and more") == "the end of one strip and more"


def test_pages_of_paragraphs_are_counted(spark, tmp_path):
    texts = ["", " \n", None, "w", "w " * 48, "w " * 49, "\n a b"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "w " * 100), (None, "w")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = views.paras(spark, str(tmp_path)).filter("para_index = 0").select("image_id", "w", "h")
    counted = views.pages_of_paras(spark, str(tmp_path))
    assert counted.schema == made.schema
    assert sorted(map(str, counted.collect())) == sorted(map(str, made.collect())) and counted.count() == 6


def test_overlays_are_made_in_methods_that_the_machine_compiles(spark, tmp_path):
    spark.createDataFrame([(1, "w " * 99), (1, "v <b> " * 30), (2, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.registered()["S8_export_overlays"].run(spark, str(tmp_path))._jdf.queryExecution()
        codegen = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", codegen)]
    assert sizes and max(sizes) < 8000  # larger ones are run byte code by byte code


def test_lines_of_one_number_share_their_texts(spark):
    box = "struct<l:double,t:double,r:double,b:double,deg:double>"
    rect = (0.0, 0.0, 50.0, 20.0, 0.0)
    items = spark.createDataFrame([(1, 0, 0, "a", rect, 12, False), (1, 0, 0, "b", rect, 12, False), (1, 0, 1, "c", rect, 12, False), (1, 0, None, "n", rect, 12, False)], f"image_id long, para_index int, item_index int, text string, rect {box}, font_px int, wrap boolean")
    paras = spark.createDataFrame([(1, 0, "p", rect), (1, 0, "q", (0.0, 0.0, 80.0, 20.0, 5.0))], f"image_id long, para_index int, text string, rect {box}")
    html = render.render_overlay_html(paras, items, spark.createDataFrame([(1, 100, 50)], "image_id long, w int, h int")).collect()[0].html
    assert [html.count(f"<span>{t}</span>") for t in "abcn"] == [16, 16, 8, 0]
    got = {(r.deg, round(r.r - r.l, 6)) for r in geo.oriented_bounds(paras, items).collect()}
    assert len(got) == 2 and (0.0, 80.0) not in got


def test_areas_to_erase_are_made_from_words_and_plain_columns(spark, tmp_path):
    texts = ["", " \n", None, "w", "w " * 48, "ab \n\n c " * 30, "\n a  b\nไท"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "w " * 100), (None, "w")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["image_id", "para_index", "item_index", "span_index", "text", "w", "h", "left", "top", "width", "height", "rotation_deg"]
    spans = views.spans(spark, str(tmp_path))
    cut = views.items(spark, str(tmp_path)).select(*[n for n in names if n not in ("span_index", "text", "left", "width")], F.posexplode(F.split("text", " ")).alias("span_index", "text"))
    cut = cut.withColumns({"left": (20.0 + 96.0 * F.col("span_index")) / F.col("w"), "width": 8.0 * F.length("text") / F.col("w")})
    assert spans.dtypes == cut.select(*names).dtypes
    assert sorted(map(str, spans.collect())) == sorted(map(str, cut.select(*names).collect())) and spans.count() == 1 + 48 + 60 + 3 + 100 + 1

    areas = catalog.registered()["F17_erase_regions"].run(spark, str(tmp_path))
    assert mentions(areas, "split(") <= 4 and mentions(areas, "lambdafunction(") <= 2  # once a side and kind of span; none for spans with a box
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("F9_token_quads", "F10_clip_quads", "F17_erase_regions"):
            plan = catalog.registered()[name].run(spark, str(tmp_path))._jdf.queryExecution()
            sizes = re.findall(r"maxMethodCodeSize:(\d+)", plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")))
            assert sizes and max(map(int, sizes)) < 8000, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert areas.count() == 2 * spans.count()


def test_corners_are_rounded_before_they_are_clipped(spark):
    names = "i int, left double, top double, width double, height double, rotation_deg double, w int, h int, p1 struct<x:double,y:double>, p2 struct<x:double,y:double>, t0 double, t1 double, height_raw double, valid_text boolean"
    rows = [
        (0, 0.1, 0.2, 0.30004, 0.1, None, 100, 200, None, None, None, None, None, None),
        (1, 0.5, 0.5, 0.2, 0.1, 90.0, 100, 200, None, None, None, None, None, None),
        (2, 0.1, 0.2, 0.0, 0.1, 0.0, 100, 200, (0.5, 0.5), (0.1, 0.5), 0.0, 1.0, 0.1, True),
        (3, 0.1, 0.2, 0.0, 0.1, 0.0, 100, 200, None, None, None, None, None, None),
        (4, None, None, None, 0.1, 0.0, 100, 200, None, None, None, None, None, None),
        (5, 2.0, 0.2, 0.1, 0.1, 0.0, 100, 200, None, None, None, None, None, None),
        (6, None, 0.2, 0.1, 0.1, 0.0, 100, 200, None, None, None, None, None, None),
    ]
    one, two = spark.createDataFrame(rows, names), spark.createDataFrame(rows[:1], names)
    got = {(r.source_order, r.i): ([tuple(p) for p in r.quad], r.clip and tuple(r.clip)) for r in geo.erase_regions(one, two, 2.0, digits=1).collect()}
    assert got == {
        (0, 0): ([(8.0, 38.0), (42.0, 38.0), (42.0, 62.0), (8.0, 62.0)], (8, 38, 42, 62)),
        (1, 0): ([(8.0, 38.0), (42.0, 38.0), (42.0, 62.0), (8.0, 62.0)], (8, 38, 42, 62)),
        (0, 1): ([(72.0, 98.0), (72.0, 122.0), (48.0, 122.0), (48.0, 98.0)], (48, 98, 72, 122)),
        (0, 2): ([(8.0, 96.0), (52.0, 96.0), (52.0, 120.0), (8.0, 120.0)], (8, 96, 52, 120)),
        (0, 3): ([(8.0, 38.0), (12.0, 38.0), (12.0, 62.0), (8.0, 62.0)], (8, 38, 12, 62)),
        (0, 5): ([(198.0, 38.0), (212.0, 38.0), (212.0, 62.0), (198.0, 62.0)], None),
        (0, 6): ([(None, 38.0), (None, 38.0), (None, 62.0), (None, 62.0)], None),
    }
    plain = {r.i: (r.quad, r.clip) for r in geo.clip_quads(geo.token_quads(one, 2.0)).collect()}
    assert len(plain) == 7 and plain[4] == (None, None) and plain[0][1].r == 43  # 42.004 px, not rounded
    assert {r.i: (r.quad, r.clip) for r in geo.erase_regions(one, one.limit(0), 2.0).collect()} == {i: v for i, v in plain.items() if i != 4}


class _Held:
    """State in memory, for one key."""

    def __init__(self):
        self.value, self.map = None, {}

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    clear = lambda self: setattr(self, "value", None)
    update = put = lambda self, v: setattr(self, "value", v)
    keys = lambda self: iter(list(self.map))
    getValue = lambda self, k: self.map[k]
    removeKey = lambda self, k: self.map.pop(k)

    def appendList(self, rows):
        self.value = (self.value or []) + rows

    def updateValue(self, k, v):
        self.map[k] = v


class _Handle:
    def __init__(self):
        self.timers = set()

    getListState = getValueState = getMapState = lambda self, *_: _Held()
    registerTimer = lambda self, ms: self.timers.add(ms)
    deleteTimer = lambda self, ms: self.timers.discard(ms)


class _Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_cache_gives_its_rows_out_hour_by_hour(monkeypatch):
    monkeypatch.setattr(feeds, "HELD_ROWS", 70)
    hour, rng = 3_600_000_000, random.Random(8)
    rows = [(rng.randrange(40 * hour), i, f"k{rng.randrange(9)}") for i in range(1000)]
    cache = feeds._BoundedCache(4, 5 * hour)
    cache.init(_Handle())
    for i in range(0, 1000, 50):
        list(cache.handleInputRows(("c",), iter([pd.DataFrame(rows[k : k + 25], columns=cache.names) for k in (i, i + 25)]), None))
    parts = []
    for until in (20 * hour + hour // 2, 100 * hour):
        parts += list(cache.handleExpiredTimer(("c",), _Now(until // 1000), None))
    assert max(map(len, parts)) < 60
    held, want = {}, []
    for us, request, name in sorted(rows):
        stored = held.pop(name, None)
        hit = stored is not None and us - stored <= 5 * hour
        held[name] = stored if hit else us
        if len(held) > 4:
            del held[next(iter(held))]
        want.append(("c", request, us, name, hit))
    assert [tuple(r) for p in parts for r in p.itertuples(index=False)] == want
