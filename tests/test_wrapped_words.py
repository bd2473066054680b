"""Lines of a batch of paragraphs are filled together; each paragraph gets the lines it would get alone."""

import math
import random
import re

from pyspark.sql import functions as F

from pagelayout.operators import render
from pagelayout.plans import catalog
from pagelayout.sources import views

TOKENS = "array<struct<kind:string,text:string,width:double>>"


def alone(tokens, caps, least):
    """One paragraph, token by token."""
    n = len(caps or [])
    if not n:
        return []
    if tokens is None:
        return None
    words, gap, wide = [], "", 0.0
    add = lambda a, b: None if a is None or b is None else a + b
    more = lambda a, b: a is not None and b is not None and (a > b or (math.isnan(a) and not math.isnan(b)))
    for kind, text, width in (t or (None,) * 3 for t in tokens):
        if kind == "space":
            gap, wide = add(gap, text), add(wide, width)
        elif text:
            if kind is not None:
                words.append((text, width, gap, wide))
            gap, wide = "", 0.0
    wanted = max(1, min(n if least is None else least, n))
    lines, used = [], 0.0
    for text, width, gap, wide in words:
        line = max(len(lines) - 1, 0)
        cap = caps[line]
        limit = cap if cap is None or wanted == 1 or line >= wanted or not cap * 0.9 < cap else cap * 0.9
        longer = add(add(used, width), wide if lines else 0.0)
        if lines and line < n - 1 and more(limit, 0.0) and more(longer, limit):
            lines.append([])
            longer = width
        lines = lines or [[]]
        lines[-1].append((text, gap))
        used = longer
    for _ in range(wanted):
        counts = [sum(t != "​" for t, _ in x) for x in lines]
        if len(lines) < wanted and counts and max(counts) > 1:
            i = counts.index(max(counts))
            k = [j for j, (t, _) in enumerate(lines[i]) if t != "​"][max(counts) // 2]
            lines[i : i + 1] = [lines[i][:k], lines[i][k:]]
    made = ["".join(x for x in [line[0][0], *[add(g, t) for t, g in line[1:]]] if x is not None) for line in lines]
    return made + [""] * (n - len(made))


def test_lines_of_many_paragraphs_are_those_of_each_alone(spark):
    rng = random.Random(11)
    nan, rows = float("nan"), []
    for i in range(3000):
        odd = i % 3 == 0  # nulls, texts of no kind, widths that are no numbers
        kinds, widths = ["word", "space", "space"] + [None, "other"] * odd, [0.1, 0.7, 5.3, 8.0, 0.0] + [None, nan, -1.0] * odd
        texts = {"word": ["a", "bcd", "é😀", "​", ""] + [None] * odd, "space": [" ", "\n", "  ", ""] + [None] * odd}
        tokens = []
        for _ in range(rng.choice([0, 1, 2, 5, 12, 40])):
            kind = rng.choice(kinds)
            tokens.append(None if odd and rng.random() < 0.02 else (kind, rng.choice(texts["space" if kind == "space" else "word"]), rng.choice(widths)))
        caps = [rng.choice([3.0, 9.7, 20.0, 100.0] + [0.0, -4.0, None, nan, math.inf] * odd) for _ in range(rng.choice([0, 1, 2, 3, 6]))]
        rows.append((i, None if odd and rng.random() < 0.05 else tokens, None if odd and rng.random() < 0.05 else caps, rng.choice([0, 1, 2, 3, 9, -1] + [None] * odd)))
    d = spark.createDataFrame(rows, f"i int, t {TOKENS}, c array<double>, m int")
    wrapped = d.select("i", render.wrap_words(F.col("t"), F.col("c"), F.col("m")).alias("x"))
    assert "aggregate(" not in wrapped._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.i: r.x for r in wrapped.collect()}
    wrong = [(r, got[r[0]], alone(*r[1:])) for r in rows if got[r[0]] != alone(*r[1:])]
    assert not wrong, wrong[0]
    assert spark.createDataFrame([(0, None, None, None)], d.schema).select(render.wrap_words(F.col("t"), F.col("c"), F.col("m")).alias("x")).head().x == []


def test_paragraphs_of_the_query_are_wrapped_once(spark, tmp_path):
    texts = [(1, " ".join(f"w{i}" * (i % 4 + 1) for i in range(150))), (2, "a\tb \x0b c\nd" + " ẞé" * 60), (3, None), (4, " \n "), (5, "one"), (None, "x y"), (5, "two words")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = catalog.registered()["W15_wrap_words"].run(spark, str(tmp_path))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("_wrapped(") == 1
    want = []
    for p in views.paras(spark, str(tmp_path)).collect():
        tokens = [("word" if t.replace("\n", " ").strip(" ") else "space", t, 8.0 * len(t)) for t in re.findall(r"[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+", p.text)]
        caps = [(p.r - p.l) * (1.0 - i * 0.1) for i in range(p.para_index % 6 + 1)]
        want += [(p.image_id, p.para_index, i, x) for i, x in enumerate(alone(tokens, caps, p.para_index % 4))]
    assert sorted(map(repr, map(tuple, d.collect()))) == sorted(map(repr, want))
