"""Operators on large and small keys equal brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pagelayout.operators import jobs, layout, tiles
from pagelayout.operators.scans import exact_percentiles, group_stats, large_keys, ordered_scan, ranged, top_n
from pagelayout.streaming import feeds


def scanned(d):
    args = dict(sums={"s": F.col("v")}, maxs={"m": F.col("v")}, suffix_mins={"u": F.col("v")}, lags={"g": F.col("n")}, leads={"e": F.col("n")}, lasts={"z": F.col("n")}, number="no")
    return sorted(map(tuple, ordered_scan(d, ["k"], ["i"], **args).select("k", "i", "s", "m", "u", "g", "e", "z", "no").collect()), key=str)


def plain_scan(rows):
    """The ordered columns by a walk over each key's rows (k, i, v, n)."""
    out = []
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        last = None
        for at, (_, i, v, n) in enumerate(own):
            before = [r[2] for r in own[:at]]
            last = n if n is not None else last
            out.append((k, i, sum(before), max(before, default=None), min(r[2] for r in own[at:]), own[at - 1][3] if at else None, own[at + 1][3] if at + 1 < len(own) else None, last, at))
    return sorted(out, key=str)


@pytest.mark.parametrize("keys", [["a", "b", None], [None]])
def test_scan_with_and_without_ranges(spark, keys):
    rng = random.Random(1)
    rows = [(k, i * i, rng.randint(-9, 9), rng.choice([None, i])) for k in keys for i in range(150 if k != "b" else 900)]
    d = spark.createDataFrame(rows, "k string, i int, v int, n int").repartition(5)
    assert plain_scan(rows) == scanned(d)
    large = large_keys(d, ["k"], ["i"])
    blocks = ranged(d, ["k"], ["i"], large).groupBy("k", "__block").count().collect()
    assert max(r["count"] for r in blocks) <= len(rows) / 4 + 50 and len(blocks) >= 8  # no range has more than a task's share
    stats = group_stats(ranged(d.withColumn("g", F.floor(F.col("i") / 5000)), ["k"], ["i"], large), ["k"], ["g"], {"low": ("min", F.col("v")), "all": ("sum", F.col("v"))}, large)
    whole = group_stats(ranged(d, ["k"], ["i"], large), ["k"], [], {"low": ("max", F.col("v")), "all": ("sum", F.lit(1))}, large)
    for r in stats.collect():
        own = [x[2] for x in rows if x[0] == r["k"] and x[1] // 5000 == r["g"]]
        assert (r["low"], r["all"]) == (min(own), sum(own))
    for r in whole.collect():
        own = [x[2] for x in rows if x[0] == r["k"]]
        assert (r["low"], r["all"]) == (max(own), len(own))


def test_nothing_is_large_in_many_small_keys(spark):
    d = spark.range(2000).select((F.col("id") % 400).alias("k"), "id")
    assert large_keys(d, ["k"], ["id"]) is None
    assert ordered_scan(d, ["k"], ["id"], number="n").where("n <> (id - k) / 400").isEmpty()
    assert ordered_scan(d.limit(0), ["k"], ["id"], number="n").isEmpty()


def test_null_keys(spark):
    schema = "image_id long, box_id long, text string, confidence double, l double, t double, r double, b double, angle_deg double"
    boxes = random_boxes(260, 3)
    frame = spark.createDataFrame([(None, *b[1:]) for b in boxes] + boxes[:5], schema)
    want, few = brute_lines(boxes), brute_lines(boxes[:5])
    got = layout.group_lines(frame).collect()
    assert len(got) == 265 and all(r.line_no == (want if r.image_id is None else few)[r.box_id] for r in got)
    work = spark.createDataFrame([(i, None if i % 2 else 4, i * jobs.DAY_MICROS, None) for i in range(6)], "job_id long, tab_id long, opened_us long, closed_us long")
    moves = spark.createDataFrame([(None, 40 * jobs.DAY_MICROS), (4, 3 * jobs.DAY_MICROS)], "tab_id long, us long")
    assert sorted(r.job_id for r in jobs.cancel_tab_work(work, moves).collect()) == [0, 1, 2, 3, 5]


def random_boxes(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t, l, h = rng.uniform(0, 300), rng.uniform(0, 300), rng.choice([8, 20, 45])
        out.append((1, i, "x", 0.9, l, t, l + 30, t + h, 0.0))
    return out


def brute_lines(rows):
    order = sorted(rows, key=lambda b: ((b[5] + b[7]) / 2, b[4], b[1]))
    lines = []
    for b in order:
        cy, h = (b[5] + b[7]) / 2, max(1.0, b[7] - b[5])
        for line in lines:
            mcy = sum((x[5] + x[7]) / 2 for x in line) / len(line)
            mh = sum(max(1.0, x[7] - x[5]) for x in line) / len(line)
            if abs(cy - mcy) <= max(h, mh) * 0.55:
                line.append(b)
                break
        else:
            lines.append([b])
    lines.sort(key=lambda ln: min(x[5] for x in ln))
    return {x[1]: n for n, ln in enumerate(lines) for x in ln}


def test_lines_equal_brute_force_on_tangled_boxes(spark):
    schema = "image_id long, box_id long, text string, confidence double, l double, t double, r double, b double, angle_deg double"
    for seed, n in ((1, 60), (2, 400)):
        rows = random_boxes(n, seed)
        want = brute_lines(rows)
        frame = spark.createDataFrame(rows, schema)
        assert {r.box_id: r.line_no for r in layout.group_lines(frame).collect()} == want
        lines = layout.layout_from_boxes(frame).collect()
        assert sorted(r.line_no for r in lines) == sorted(set(want.values())) and sum(r.n_boxes for r in lines) == n


def test_percentiles_and_top(spark):
    d = spark.createDataFrame([("a", v) for v in [1, 2, 3, 4, 100]] + [("b", 7)], "k string, v long")
    got = {r.k: (r.p50, r.p95) for r in exact_percentiles(d, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got["a"][0] == 3.0 and abs(got["a"][1] - 80.8) < 1e-9 and got["b"] == (7.0, 7.0)
    assert sorted(r.v for r in top_n(d, ["k"], [F.col("v").desc()], 2, ["v"]).collect()) == [4, 7, 100]


def test_throttle_equals_walk(spark):
    rng = random.Random(3)
    rows = [("b", i, t) for i, t in enumerate(sorted(rng.sample(range(5000), 300)))]
    got = {r.event_id for r in jobs.throttle(spark.createDataFrame(rows, "k string, event_id long, us long"), ["k"], "us", "event_id", 40).collect()}
    last, want = None, set()
    for _, i, t in rows:
        if last is None or t - last >= 40:
            want.add(i)
            last = t
    assert got == want


def test_job_state_over_several_batches(spark, tmp_path):
    files = [[("a", 2, "2024-01-01 12:00:00", "running", "ocr")], [("a", 1, "2024-01-01 11:00:00", "error", "download"), ("b", 3, "2024-01-01 11:30:00", "queued", "queue")], [("a", 4, "2024-01-01 12:05:00", "done", "ocr")]]
    schema = "job_id string, event_id long, ts timestamp_ntz, status string, stage string"
    for i, rows in enumerate(files):
        d = spark.createDataFrame(rows, "job_id string, event_id long, ts string, status string, stage string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        d.coalesce(1).write.parquet(f"{tmp_path}/feed/no={i}")
        for f in (tmp_path / "feed" / f"no={i}").glob("part-*"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = feeds.read_feed(spark, f"{tmp_path}/feed/*/", spark.createDataFrame([], schema).schema, files_per_batch=1)
    out = feeds.replay(feeds.job_state_stream(stream), "update")
    assert out.select("epoch").distinct().count() >= 3
    got = {r.job_id: (r.status, r.stage, r.last_us - r.stage_us) for r in feeds.newest(out, ["job_id"]).collect()}
    assert got == {"a": ("done", "ocr", 300_000_000), "b": ("queued", "queue", 0)}


def brute_cuts(scores, max_h):
    import numpy as np

    s, out, y, total = np.array(scores, np.float32), [], 0, len(scores)
    while y < total:
        if total - y <= max_h:
            out.append((y, total - y))
            break
        target = y + max_h
        lo, hi = max(y + min(1200, max(1, max_h - 700)), target - 700), min(target, total - 1)
        end = target
        if hi > lo:
            c = np.arange(lo, hi + 1)
            x = s[c]
            med = float(np.median(x))
            mad = float(np.median(np.abs(x - med))) or 1.0
            rank = (x - med) / mad + (target - c).astype(np.float32) / 700.0 * 0.45
            end = max(y + 1, min(int(c[int(np.argmin(rank))]), target))
        out.append((y, end - y))
        y = max(y + 1, end - min(420, max(0, end - y - 100)))
    return out


def test_cuts_cover_the_page(spark):
    rng = random.Random(5)
    scores = [rng.uniform(0, 30) for _ in range(2500)]
    rows = spark.createDataFrame([(1, y, s) for y, s in enumerate(scores)], "image_id long, y long, smooth double")
    for max_h in (900, 300, 5200):
        got = [(r.y, r.h) for r in tiles.choose_cuts(rows, max_h).orderBy("tile_no").collect()]
        assert got == brute_cuts(scores, max_h)
        assert got[0][0] == 0 and got[-1][0] + got[-1][1] == 2500
        assert all(a[0] + a[1] - b[0] <= 420 for a, b in zip(got, got[1:]))


def plain_seams(rows, seams):
    """Rounds over one page side, as the rule reads: rows (rid, text, box or None)."""
    rows = [(rid, text, box, 0) for rid, text, box in sorted(rows, key=lambda r: r[0])]
    centre = lambda r: (r[2][1] + r[2][3]) / 2 if r[2] else 0.0

    def fits(p, q):
        if not (p[2] and q[2]):
            return False
        a, b = p[2], q[2]
        narrow = min(a[2] - a[0], b[2] - b[0])
        return max(0, min(a[2], b[2]) - max(a[0], b[0])) / narrow >= 0.5 and -80 <= b[1] - a[3] <= 200 and any(centre(p) < s < centre(q) for s in seams)

    while True:
        rows.sort(key=centre)
        used, out = set(), []
        for i, p in enumerate(rows):
            if i in used:
                continue
            partner = next((j for j in range(i + 1, min(i + 6, len(rows))) if j not in used and fits(p, rows[j])), None)
            if partner is not None:
                used.add(partner)
                q = rows[partner]
                box = (min(p[2][0], q[2][0]), min(p[2][1], q[2][1]), max(p[2][2], q[2][2]), max(p[2][3], q[2][3]))
                p = (p[0], tiles.join_texts(p[1], q[1]), box, p[3] + q[3] + 1)
            out.append(p)
        if not used:
            return sorted(rows)
        rows = out


@pytest.mark.parametrize("near", [2, 24])
def test_seams_settled_near_them_equal_whole_pages(spark, near):
    rng = random.Random(7 + near)
    rows, seams, strips = [], {}, []
    for page in range(6):
        n, high = (60, 30 * (page + 1)) if page else (12, 60)
        for i in range(n):
            left, top = rng.choice([20.0, 20.0, 220.0]), float(i * high + rng.randint(-10, 20))
            box = None if rng.random() < 0.05 else (left, top, left + rng.choice([180.0, 400.0]), top + rng.choice([15.0, 60.0, 200.0]))
            rows.append((page if page < 5 else None, "original" if i % 7 else None, i, f"w{i} text w{i + 1}", box))
        height = n * high
        strips += [(page if page < 5 else None, k, k * height // 4, height // 4 + 40, height) for k in range(4)]
        seams[page if page < 5 else None] = [float(k * height // 4 + height // 4 + 40) for k in range(3)]
    schema = "image_id long, side string, rid long, text string, l double, t double, r double, b double"
    p = spark.createDataFrame([(i, s, r, x, *(b or (None,) * 4)) for i, s, r, x, b in rows], schema).repartition(3)
    t = spark.createDataFrame([s for s in strips if s[0] is not None], "image_id long, tile_no int, y int, h int, page_h int")
    got = {}
    for r in tiles.merge_seam_paragraphs(p, t, near=near).collect():
        got.setdefault((r.image_id, r.side), []).append((r.rid, r.text, None if r.l is None else (r.l, r.t, r.r, r.b), r.merged))
    want = {}
    for key in {(i, s) for i, s, *_ in rows}:
        own = [(r, x, b) for i, s, r, x, b in rows if (i, s) == key]
        want[key] = plain_seams(own, seams[key[0]] if key[0] is not None else [])
    assert {k: sorted(v) for k, v in got.items()} == want and sum(r[3] for v in want.values() for r in v) > 20


def test_merged_items_keep_spans_and_are_renumbered(spark):
    item = "struct<item_index:int,text:string,left:double,top:double,width:double,height:double,cy:double,base:string,spans:array<struct<text:string>>>"
    up = [(0, "one", 0.1, 0.10, 0.5, 0.02, 0.11, "A", [("one",)]), (1, "two", 0.1, 0.20, 0.5, 0.02, 0.21, "B", [("two",)])]
    low = [(0, "two more", 0.1, 0.2002, 0.5, 0.02, 0.2102, "C", [("two",), ("more",)]), (1, "three", 0.1, 0.15, 0.5, 0.02, 0.16, "D", []), (2, "flat", 0.1, 0.15, 0.5, 0.0, 0.0, "E", None)]
    rows = [(1, "original", 0, "one two", 10.0, 100.0, 60.0, 190.0, up), (1, "original", 1, "two more", 10.0, 195.0, 60.0, 260.0, low), (1, "translated", 2, "alone", 10.0, 195.0, 60.0, 260.0, None)]
    p = spark.createDataFrame(rows, f"image_id long, side string, rid long, text string, l double, t double, r double, b double, items array<{item}>")
    t = spark.createDataFrame([(1, 0, 0, 200, 400), (1, 1, 150, 250, 400)], "image_id long, tile_no int, y int, h int, page_h int")
    got = {r.rid: r for r in tiles.merge_seam_paragraphs(p, t).collect()}
    assert set(got) == {0, 2} and got[2]["items"] is None and got[0].text == "one two more" and got[0].merged == 1
    assert [(x.item_index, x.text, x.base, x.spans and [s.text for s in x.spans]) for x in got[0]["items"]] == [(0, "one", "A", ["one"]), (1, "flat", "E", None), (2, "three", "D", []), (3, "two more", "B", ["two", "more"])]


def plain_dedupe(rows):
    """rows (rid, text, box or None) -> rids kept, in order."""
    from difflib import SequenceMatcher

    def same(p, k):
        (_, at, a), (_, bt, b) = p, k
        if not (a and b):
            return bool(at) and at == bt
        iw, ih = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if iw > 0 and ih > 0 and iw * ih / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - iw * ih) >= 0.35:
            return True
        if not at or not bt:
            return False
        gap, both = abs(a[1] + a[3] - b[1] - b[3]) / 2, max(1, a[3] - a[1]) + max(1, b[3] - b[1])
        short, long = sorted((at, bt), key=len)
        inside = 1.0 if short in long else sum(m.size for m in SequenceMatcher(None, short, long).get_matching_blocks()) / len(short)
        if len(short) >= 4 and inside >= 0.7 and gap <= max(18, min(200, both)):
            return True
        return SequenceMatcher(None, at, bt).ratio() >= 0.78 and gap <= max(18, min(120, both * 0.75))

    kept = []
    for p in sorted(rows, key=lambda r: ((r[2][1] + r[2][3]) / 2 if r[2] else 0.0, r[1], r[0])):
        hit = next((i for i in range(max(0, len(kept) - 8), len(kept)) if same(p, kept[i])), None)
        if hit is None:
            kept.append(p)
        elif len(p[1]) > len(kept[hit][1]):
            kept[hit] = p
    return [r[0] for r in kept]


def page_rows(seed, pages=5):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = []
    for page in range(pages):
        top = 0.0
        for i in range(300 if page == 0 else 60):
            top += rng.choice([5.0, 20.0, 60.0, 400.0])
            box = None if rng.random() < (0.1 if page % 2 else 0.0) else (10.0, top, 300.0, top + rng.choice([20.0, 80.0]))
            rows.append((page, i, " ".join(rng.choices(words, k=rng.choice([1, 1, 6]))), box))
    return rows


def test_dedupe_equals_the_rule(spark):
    rows = page_rows(9)
    schema = "image_id long, side string, rid long, text string, l double, t double, r double, b double"
    p = spark.createDataFrame([(i, "original", r, x, *(b or (None,) * 4)) for i, r, x, b in rows], schema).repartition(4)
    got = {}
    for r in tiles.dedupe_paragraphs(p).collect():
        got.setdefault(r.image_id, {})[r.para_index] = r.rid
    assert {i: [own[k] for k in range(len(own))] for i, own in got.items()} == {i: plain_dedupe([r[1:] for r in rows if r[0] == i]) for i in range(5)}


def test_pairs_equal_brute_force(spark):
    from difflib import SequenceMatcher

    rows = page_rows(4, 3) + [(0, 900, "big", (0.0, 0.0, 5000.0, 90000.0)), (0, 901, "big", (1.0, 0.0, 5200.0, 89000.0)), (0, 902, "thin", (0.0, 0.0, 5000.0, 0.5)), (1, 903, "alpha", (9.0, 1.0, 9.0, 1.0))]
    schema = "image_id long, side string, rid long, text string, l double, t double, r double, b double"
    p = spark.createDataFrame([(i, "original", r, x, *(b or (None,) * 4)) for i, r, x, b in rows], schema).repartition(4)
    boxed = lambda b: b and b[2] > b[0] and b[3] > b[1]
    over, alike = set(), set()
    for i, r, x, a in rows:
        for j, s, y, b in rows:
            if i != j or r >= s:
                continue
            if not (boxed(a) and boxed(b)):
                if x == y:
                    alike.add((i, r, s))
                continue
            iw, ih = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if iw > 0 and ih > 0 and iw * ih / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - iw * ih) >= 0.35:
                over.add((i, r, s))
            gap, both = abs(a[1] + a[3] - b[1] - b[3]) / 2, max(1, a[3] - a[1]) + max(1, b[3] - b[1])
            short, long = sorted((x, y), key=len)
            inside = 1.0 if short in long else sum(m.size for m in SequenceMatcher(None, short, long).get_matching_blocks()) / len(short)
            near = len(short) >= 4 and inside >= 0.7 and gap <= max(18, min(200, both))
            if near or (SequenceMatcher(None, x, y).ratio() >= 0.78 and gap <= max(18, min(120, both * 0.75))):
                alike.add((i, r, s))
    assert {(r.image_id, r.a_rid, r.b_rid) for r in tiles.overlap_pairs(p).collect()} == over and (0, 900, 901) in over
    got = [(r.image_id, r.a_rid, r.b_rid) for r in tiles.similar_pairs(p).collect()]
    assert len(got) == len(set(got)) and set(got) == alike


def cut_feed(spark, folder, batches, schema, columns):
    """A feed of one file per micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).selectExpr(*columns).coalesce(1).write.parquet(f"{folder}/no={i}")
        for f in folder.glob(f"no={i}/part-*"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    plain = spark.createDataFrame(batches[0], schema).selectExpr(*columns)
    return feeds.read_feed(spark, f"{folder}/*/", plain.schema, files_per_batch=1)


def jumbled(rng, rows, late):
    """Rows (time in minutes first) in batches; some come up to ``late`` minutes after newer ones. At the end time moves far on, so that nothing waits."""
    arrival = sorted(rows, key=lambda r: r[0] + rng.uniform(0, late))
    size = len(rows) // 3 + 1
    return [arrival[i : i + size] for i in range(0, len(arrival), size)]


MINUTE = 60_000_000


def test_submissions_live_as_long_as_their_jobs_are_updated(spark, tmp_path):
    rng = random.Random(6)
    rows = [(m, i, f"k{rng.randrange(3)}", rng.random() < 0.5) for i, m in enumerate(sorted(rng.sample(range(3000), 160)))]
    last = [(9000, 900, "end", False), (99000, 901, "end", False)]
    feed = cut_feed(spark, tmp_path, [*jumbled(rng, rows, 50), last[:1], last[1:]], "m long, event_id long, k string, renews boolean", ["event_id", "k", "renews", f"m * {MINUTE} AS us"])
    sent = feed.filter("NOT renews").selectExpr("event_id", "k AS idempotency_key", "cast(timestamp_micros(us) AS timestamp_ntz) AS ts")
    got = feeds.replay(feeds.idempotent_submissions(sent, 60 * MINUTE, updates=feed.filter("renews").selectExpr("k AS key", "us"))).collect()
    want, held = {}, {}
    for m, i, k, renews in rows:
        owner, touched = held.get(k, (None, -999))
        living = m - touched <= 60
        if renews:
            held[k] = (owner, m) if living else (owner, touched)
        else:
            held[k] = (owner, touched) if living else (i, m)
            want[i] = (held[k][0], living)
    assert {r.event_id: (r.job_event, r.idempotent) for r in got} == want | {900: (900, False)}


def test_tab_work_is_cancelled_once(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i, m in enumerate(sorted(rng.sample(range(100_000), 200))):
        kind = rng.choice([1, 1, 1, 2, 3])
        rows.append((m, kind, i, rng.randrange(4), rng.randrange(3), m + rng.randrange(4000) if rng.random() < 0.5 else None))
    batches = [*jumbled(rng, rows, 50), [(200_000, 3, 900, 99, 0, None)], [(900_000, 3, 901, 99, 0, None)]]
    columns = ["kind", "job_id", "tab_id", "cast(b AS string) AS batch_id", f"m * {MINUTE} AS us", f"z * {MINUTE} AS closed_us"]
    feed = cut_feed(spark, tmp_path, batches, "m long, kind int, job_id long, tab_id long, b long, z long", columns)
    out = feeds.cancelled_jobs_stream(feed.filter("kind = 1"), feed.filter("kind = 3"), feed.filter("kind = 2"))
    got = sorted((r.job_id, r.tab_id, r.aborted_us // MINUTE, r.reason) for r in feeds.replay(out).collect())
    want = []
    for m, kind, job, tab, batch, z in rows:
        ends = sorted((n, k) for n, k, _, t, b, _ in rows if kind == 1 and k in (2, 3) and t == tab and n >= m and (k == 3 or b == batch) and (z is None or n < z))
        want += [(job, tab, ends[0][0], "navigation" if ends[0][1] == 3 else "cancel")] if ends else []
    assert got == sorted(want) and {w[3] for w in want} == {"navigation", "cancel"}
    flat = spark.createDataFrame(rows, "m long, kind int, job_id long, tab_id long, b long, z long").selectExpr(*columns)
    batch = jobs.cancel_tab_work(flat.filter("kind = 1").withColumnRenamed("us", "opened_us"), flat.filter("kind = 3"), flat.filter("kind = 2"))
    assert sorted((r.job_id, r.tab_id, r.aborted_us // MINUTE) for r in batch.collect()) == [w[:3] for w in sorted(want)]


def test_bounded_cache_in_the_order_of_time(spark, tmp_path):
    rng = random.Random(2)
    rows = [(m, i, f"c{i % 2}", f"k{int(rng.random() ** 2 * 12)}") for i, m in enumerate(sorted(rng.sample(range(4000), 300)))]
    feed = cut_feed(spark, tmp_path, [*jumbled(rng, rows, 50), [(9000, 900, "end", "x")], [(99000, 901, "end", "x")]], "m long, request_id long, cache string, cache_key string", ["request_id", "cache", "cache_key", f"cast(timestamp_micros(m * {MINUTE}) AS timestamp_ntz) AS ts"])
    got = {r.request_id: r.hit for r in feeds.replay(feeds.bounded_cache_stream(feed, 4, 90 * MINUTE)).collect()}
    want, held = {}, {}
    for m, i, c, k in rows:
        own = held.setdefault(c, [])
        old = next((e for e in own if e[0] == k), None)
        want[i] = old is not None and m - old[1] <= 90
        held[c] = [*[e for e in own if e[0] != k], (k, old[1] if want[i] else m)][-4:]
    assert got == want | {900: False} and 20 < sum(want.values()) < 280
