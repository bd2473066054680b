"""Pairs of paragraphs meet on their page side, in the order of their centres; texts are moved to their side and no further."""

import random

from pagelayout.operators import tiles
from pagelayout.operators.scans import large_keys
from pagelayout.plans import catalog

PARA = "image_id long, side string, rid long, text string, l double, t double, r double, b double"


def brute(rows):
    boxed = lambda p: None not in p[4:] and p[6] > p[4] and p[7] > p[5]
    found = set()
    for a in rows:
        for b in rows:
            if a[0] is None or a[1] is None or a[:2] != b[:2] or a[2] >= b[2] or not a[3].strip() or not b[3].strip():
                continue
            x, y = (" ".join(p[3].lower().split()) for p in (a, b))
            if not (boxed(a) and boxed(b)):
                if x == y:
                    found.add((*a[:3], b[2]))
                continue
            gap, both = abs((a[5] + a[7]) / 2 - (b[5] + b[7]) / 2), max(1.0, a[7] - a[5]) + max(1.0, b[7] - b[5])
            if min(len(x), len(y)) >= 4 and gap <= max(18, min(200, both)) and tiles.contained_enough(x, y):
                found.add((*a[:3], b[2]))
            elif gap <= max(18, min(120, both * 0.75)) and tiles.alike_enough(x, y):
                found.add((*a[:3], b[2]))
    return found


def test_pairs_of_hot_and_small_sides(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta"]
    rows = []
    for image, side, n, step in ((1, "o", 420, 30.0), (2, "o", 6, 40.0), (2, "t", 6, 40.0), (3, None, 4, 0.0), (None, "o", 4, 0.0), (4, "o", 5, 250.0)):
        numbers = rng.sample(range(n), n)  # numbers do not follow the order on the page
        for i in range(n):
            t = i * step + rng.choice([0.0, 3.5, 90.0])
            box = rng.choice([(0.0, t, 50.0, t + 60.0)] * 12 + [(5.0, t, 5.0, t + 9.0), (None, t, 9.0, None)])
            rows.append((image, side, numbers[i], rng.choice(["", " "] + [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(12)]), *box))
    # ends of the reach, one place for many, one number twice
    rows += [(5, "o", i, x, 0.0, t, 9.0, t + 200.0) for i, (x, t) in enumerate([("same text", 0.0), ("same text here", 200.0), ("same text", 400.5), ("same text", 400.5), ("same text", 601.0)])]
    rows += [(6, "o", 7, "twice", 0.0, 0.0, 9.0, 9.0), (6, "o", 7, "twice", 0.0, 0.0, 9.0, 9.0), (6, "o", 3, "twice", 0.0, 0.0, 9.0, 9.0)]
    p = spark.createDataFrame(rows, PARA).repartition(4)
    assert [r["__key"].image_id for r in large_keys(p.selectExpr("image_id", "side", "(t + b) / 2 AS cy").filter("cy IS NOT NULL"), ["image_id", "side"], ["cy"]).collect()] == [1]
    got = [tuple(r) for r in tiles.similar_pairs(p).select("image_id", "side", "a_rid", "b_rid").collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got)) + 1  # the number that is there twice
    small = [r for r in rows if r[0] in (2, 4, 5)]
    got = [tuple(r) for r in tiles.similar_pairs(spark.createDataFrame(small, PARA)).select("image_id", "side", "a_rid", "b_rid").collect()]
    assert set(got) == brute(small) and len(got) == len(set(got))


def test_texts_are_moved_once_to_their_side(spark):
    p = spark.createDataFrame([(1, "o", i, f"text {i % 3}", 0.0, 9.0 * i, 9.0, 9.0 * i + 5.0) for i in range(9)], PARA).repartition("image_id", "side")
    d = tiles.similar_pairs(p)
    plan = d._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "explode(" not in plan and "letters" not in plan and plan.count("mapinarrow") == 1
    assert {(r.a_rid, r.b_rid) for r in d.collect()} == {(i, j) for i in range(9) for j in range(i + 1, 9) if 9 * (j - i) <= 18}


def test_long_texts_are_bounded_by_their_letters():
    a, b = "ab" * 9000, "cd" * 9000
    assert not tiles.texts_same(a, b, True, True) and tiles.texts_same(a, a, True, True)


def test_texts_of_the_query_stay_where_their_numbers_were_made(spark, tmp_path):
    spark.createDataFrame([(i, " ".join(f"w{j % (i + 2)}" for j in range(900))) for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = catalog.registered()["J2_similar_pairs"].run(spark, str(tmp_path))
    assert d.count() == d.distinct().count() > 0
    d.collect()
    assert "REPARTITION_BY_COL" not in d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
