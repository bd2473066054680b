"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelayout.llm import decontamination, fingerprints, html, lm, mixing, neardup, quality, sharding, substrings, suffixes, warc
from pagelayout.llm.common import column

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node string, size long, salt int, chunk int"


def words(rng, n, top=60):
    return " ".join(f"w{int(rng.random() ** 2 * top)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [words(rng, rng.choice([3, 8, 40, 90, 200]), 400) for _ in range(40)]
    texts += [texts[0]] * 12 + [texts[3] + " tail"] + [words(rng, 4000, 4000)]
    long = words(rng, 300, 3000)
    texts += [long] + [" ".join("edit" if i == k else w for i, w in enumerate(long.split())) for k in (30, 150, 290)]
    texts += [None, None, "", " \n ", "é", "ÀÉ ü x", "one two", "one two"]
    rows = [(i * 3, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 7, "r", "n", 5, 1, 2) for i, t in enumerate(texts)]
    rows += [(None, "null id words here now again", "en", "s1", 1, "r", "n", 5, 1, 2), rows[2], rows[2]]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r[0] is None, r[0] or 0)


def test_shards_are_contiguous_gapless_and_even(spark, docs, corpus):
    rows = sharding.balanced_shards(docs, 4).select("row.doc_id", "size", "shard", "slot").collect()
    assert len(rows) == len(corpus) and sorted(key(r) for r in rows) == sorted(key(r) for r in corpus)
    in_order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [key(r) for r in in_order] == sorted(key(r) for r in corpus)
    total, done = sum(r["size"] for r in rows), 0
    for shard, part in itertools.groupby(in_order, lambda r: r["shard"]):
        slots = [r["slot"] for r in part]
        assert slots == list(range(len(slots)))
    for r in in_order:
        assert r["shard"] == min(3, (2 * done + r["size"]) * 4 // (2 * total))
        done += r["size"]
    assert sharding.balanced_shards(empty(spark), 4).count() == 0


def test_shards_of_one_hot_key(spark):
    hot = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("text"))
    rows = sharding.balanced_shards(hot, 4).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert sorted(r["shard"] for r in rows) == [0, 1, 2, 3] and all(r["m"] == r["n"] - 1 and 90 < r["n"] < 110 for r in rows)


def test_mix_meets_targets(spark, docs, corpus):
    rows = mixing.mix_sources(docs, shards=5, blocks_per_shard=8).select(F.col("row.source").alias("s"), "row.doc_id", "size", "source_size", "target", "taken", "copies").collect()
    assert len(rows) == len(corpus)
    sizes = collections.Counter()
    for r in corpus:
        sizes[r[3]] += len(re.findall(mixing.WORD, r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in full} if full else share
        left -= sum(3.0 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    for s in order:
        own = [r for r in rows if r["s"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(r["size"] for r in own) / 2 + 1
    assert all(r["taken"] == len(r["copies"]) * r["size"] <= 3 * r["size"] for r in rows)
    assert {c["shard"] for r in rows for c in r["copies"]} <= set(range(5))
    again = mixing.mix_sources(docs.repartition(3), shards=5, blocks_per_shard=8).select("row.doc_id", "taken").collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in rows)
    assert mixing.mixed(docs, shards=5).count() == sum(len(r["copies"]) for r in rows)
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    quotas = spark.createDataFrame([(1, 7), (2, 0), (3, 400), (4, 93)], "rank int, blocks long")
    rows = mixing.split_quotas(quotas, 7, 3).collect()
    for rank, n in ((1, 7), (2, 0), (3, 400), (4, 93)):
        assert sum(r["blocks"] for r in rows if r["rank"] == rank) == n
    per = [sum(r["blocks"] for r in rows if r["shard"] == s) for s in range(7)]
    assert per == [(s + 1) * 500 // 7 - s * 500 // 7 for s in range(7)]
    draws = spark.range(1, 2000).select(mixing.hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), F.col("id") / 2000).alias("x"))
    share = {r["x"]: r["count"] / 1999 for r in draws.groupBy("x").count().collect()}
    for x, p in share.items():
        assert abs(p - math.comb(20, x) * math.comb(30, 10 - x) / math.comb(50, 10)) < 2e-3


def test_quality_keeps_good_and_rejects_bad(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        t = words(rng, 30)
        rows.append((i, t.upper().replace(" ", "!! ") if bad else t, None if i % 7 == 0 else f"h{i % 3}", "en"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(900, None, "h1", "en"), (901, "", None, None), (None, "w1 w2 w3", "h1", "en"), (902, "w " * 50000, "lone", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame(labels + [(None, 1, 0), (900, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, known).select("row.doc_id", "keep", "evidence", "host_posterior").collect()}
    assert len(got) == len(rows) and all(got[i]["keep"] == (i % 4 != 0) for i in range(300))
    assert got[900]["evidence"] == 0 and got[901]["keep"]
    assert quality.quality_scores(docs, known.limit(0)).where("keep").count() == len(rows)
    assert quality.quality_scores(docs.limit(0), known).count() == 0


def test_text_features_follow_patterns():
    patterns = [r"[A-ZÄÖÜÉ]{2,}", r"[*#$%&!|~^=_<>\[\]{}\\/@+]+", r"[0-9]+", r"[.,;:?]", r"\n", r"(?<![\w])[A-ZÄÖÜÉ][a-zäöüéß]"]
    texts = ["Ein ÄÖ Text.\n\nNEW!! a1 22 Bb cC_d <<x>> É é\u00a0Zz", "one", " \t", "", None, "A" * 70_000 + " z", "\U0001f600 Go\x0bGo", "漢字 𠀀 Ab"]
    for text in texts:
        words = re.findall(r"[^ \t\n\x0b\f\r]+", text or "")
        got = quality.text_features(text)
        if not words:
            assert got is None
            continue
        counts = [len(re.findall(p, text)) for p in patterns] + [len(text)]
        assert np.allclose(got, [*np.log1p(np.array(counts) / len(words)), np.log1p(len(words))]), text


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 0.2)] * 200 + [("other", "a", 0.9)] * 200 + [("tiny", "a", 0.0)]
    got = {r["host"]: r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert abs(got["big"]["host_posterior"] - 0.2) < 0.05 < got["tiny"]["host_posterior"]


def brute_classes(rows):
    texts = sorted({r[1] or "" for r in rows})
    sets = {}
    for t in texts:
        w = t.split()
        sets[t] = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        if sets[a] and sets[b]:
            both = sum((sets[a] & sets[b]).values())
            if both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= 0.8:
                root[find(a)] = find(b)
    least = {}
    for r in rows:
        c = find(r[1] or "")
        least[c] = min(least.get(c, (True, 0)), key(r))
    return [(r[0], least[find(r[1] or "")]) for r in rows]


def test_near_duplicates_match_brute_force(spark, docs, corpus):
    rows = neardup.near_duplicates(docs).select("row.doc_id", "class_id").collect()
    got = sorted((key(r), (r["class_id"] is None, r["class_id"] or 0)) for r in rows)
    assert got == sorted((key((i,)), c) for i, c in brute_classes(corpus))
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(key(r) for r in kept.collect()) == sorted({c for _, c in brute_classes(corpus)})
    assert neardup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("work", [neardup.WORK, 0])
def test_near_duplicates_find_all_links_between_components(spark, monkeypatch, work):
    """Copies changed to similarities around the threshold: with turns and without, and turns end when bounds rule out all pairs."""
    monkeypatch.setattr(neardup, "WORK", work)
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 400, n) for n in (40, 80, 160) for _ in range(4)]
    rows = []
    for i in range(240):
        words = base[rng.integers(len(base))].copy()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.integers(len(words))] = rng.integers(400)
        rows.append((i, " ".join(f"w{w}" for w in words)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "class_id").collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in found) == sorted((i, c[1]) for i, c in brute_classes(rows))


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 100, 100))
        agree.append(np.mean(neardup.dart_signature(np.concatenate([both, a])) == neardup.dart_signature(np.concatenate([both, b]))))
    assert abs(np.mean(agree) - 600 / 800) < 0.025
    one = neardup.dart_signature(a[:1])
    assert (one != 0).all() and not neardup.dart_signature(a[:0]).any()


def brute_leaks(rows, items):
    out = set()
    for i, t in rows:
        w = (t or "").lower().split()
        for item, text in items:
            v = (text or "").lower().split()
            size = min(5, len(v))
            own = collections.Counter(tuple(v[k : k + size]) for k in range(len(v) - size + 1)) if v else None
            for s in range(-len(v), len(w)) if own else ():
                x = w[max(0, s) : s + len(v)]
                c = collections.Counter(tuple(x[k : k + size]) for k in range(len(x) - size + 1))
                both = sum((own & c).values())
                if both and both / (sum(own.values()) + sum(c.values()) - both) >= 0.8:
                    out.add((i, item))
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    items = [(i, words(rng, n, 500)) for i, n in enumerate([40, 12, 60, 30, 3, 1])]
    items += [(8, None), (9, ""), (10, items[0][1])]
    docs = [(i, words(rng, 80, 500)) for i in range(20)]
    docs[2] = (2, f"{words(rng, 30)}\n{items[0][1].upper()} {words(rng, 50)}")
    docs[4] = (4, items[1][1])
    docs[6] = (6, words(rng, 9) + " " + " ".join(items[2][1].split()[:-2]))
    docs[7] = (7, items[3][1].replace(" ", "\n") + " x")
    docs[9] = (9, "q " + " ".join("X" if k == 29 else w for k, w in enumerate(items[2][1].split())) + " q")
    docs += [(50, docs[2][1])] * 5 + [(60, None), (61, ""), (None, docs[4][1]), (62, items[4][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, key string, salt int")
    got = decontamination.contaminated_documents(frame, benchmark).select("row.doc_id", "item").collect()
    want = [(d[0], i) for d in docs for i in (x for x in range(8) if (d[0], x) in brute_leaks([d], items))]
    assert sorted(map(str, ((r[0], r[1]) for r in got))) == sorted(map(str, want))
    clean = decontamination.decontaminated(frame, benchmark).collect()
    assert sorted(str(r["doc_id"]) for r in clean) == sorted(str(d[0]) for d in docs if not brute_leaks([d], items))
    assert decontamination.decontaminated(frame, benchmark.limit(0)).count() == len(docs)
    assert decontamination.contaminated_documents(frame.limit(0), benchmark).count() == 0


def test_decontamination_finds_reordered_and_repeating_items(spark):
    rng = random.Random(21)
    a, b = [f"a{k}" for k in range(29)], [f"b{k}" for k in range(30)]
    items = [(0, " ".join(a + b)), (1, words(rng, 50, 90)), (2, " ".join(["x", "y"] * 20)), (3, " ".join(["x"] * 9 + [f"c{k}" for k in range(12)]))]
    docs = [(0, " ".join(b + a)), (1, f"{words(rng, 40)} {' '.join(b + a)} {words(rng, 40)}"), (2, " ".join(a)), (3, " ".join((a + b)[9:] + ["q"] * 30))]
    docs += [(4, " ".join((items[1][1].split() * 3)[20:130])), (5, " ".join(["y", "x"] * 21)), (6, " ".join(["x", "y"] * 19)), (7, items[3][1][4:] + " tail"), (8, None), (9, "x " * 30)]
    got = decontamination.contaminated_windows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    node = {hashlib.md5(t.encode()).hexdigest(): i for i, t in docs if t}
    assert {(node[r["node"]], r["item"]) for r in got} == brute_leaks(docs, items) >= {(0, 0), (1, 0)}
    assert len({(r["node"], r["item"], r["start"], r["n"]) for r in got}) == len(got)
    want = set()
    for i, t in docs:
        for item, text in items:
            w, v = (t or "").split(), text.split()
            for s in range(-len(v), len(w)):
                x = w[max(0, s) : s + len(v)]
                if brute_leaks([(i, " ".join(x))], [(item, text)]) and len(x) == len(v):
                    own, c = (collections.Counter(tuple(y[k : k + 5]) for k in range(len(y) - 4)) for y in (v, x))
                    both = sum((own & c).values())
                    if both / (sum(own.values()) + sum(c.values()) - both) >= 0.8:
                        want.add((i, item, s))
    assert {(node[r["node"]], r["item"], r["start"]) for r in got if r["n"] == len(dict(items)[r["item"]].split())} == want


def test_hamming_blocks_meet_within_the_radius(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), decontamination.RADIUS):
            y ^= 1 << b
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    frame = spark.createDataFrame(pairs, "x long, y long")
    met = frame.where(F.arrays_overlap(decontamination.hamming_blocks(F.col("x")), decontamination.hamming_blocks(F.col("y"))))
    assert met.count() == 200


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="ad">Buy now. Long text of an advert that goes on and on.</div>
<article><h1>Head &amp; line</h1><p>First   para&nbsp;one<br>two <b>bold</b><p>Second &lt;x&gt; &#233;<aside>side</aside><div class="comments"><p>troll</p></div><p>End.</article>
<form>f</form><footer>&copy; foot</footer></body></html>"""


def test_html_main_text(spark):
    assert html.main_text(PAGE) == "Head & line\nFirst para one two bold\nSecond <x> é\nEnd."
    assert html.main_text("") == "" and html.main_text("<p>short") == "short" and html.main_text("<script>x") == ""
    para = "<p>" + "Plain words of a story without links, " * 4 + "</p>"
    page = f"<body><div><a href=1>Home</a></div><div><a href=2>News</a></div><br><div id=main>{para}{para}</div><div></div><div></div><div><a href=3>More</a></div>"
    assert html.main_text(page).count("\n") == 1 and "Home" not in html.main_text(page) and "More" not in html.main_text(page)
    assert len(html.main_text("<article><p>" + "word " * 200000)) == 999999
    rows = spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string").select(html.extract_text(F.col("html")).alias("t")).collect()
    assert [r["t"] for r in rows][1] == ""


def test_html_text_outside_an_article_is_judged_too():
    para = "<p>" + "Plain words of a story without links, " * 4 + "</p>"
    teaser, links = "<article><a href=1>Teaser</a></article>", "<div><a href=2>More</a> of it</div>"
    page = f"<body>{links}<div>{para}{para}</div>{links}<div></div><div></div>{teaser}{links}</body>"
    lines = html.main_text(page).split("\n")
    assert sum(line.startswith("Plain words") for line in lines) == 2 and lines[-1] == "Teaser"
    assert html.main_text(f"<div>Short note</div><main><p>a</main><div>{links}</div>") == "a"


def test_html_of_broken_pages_takes_one_pass():
    start = time.perf_counter()
    assert html.main_text('<div class="ad">x' * 4000) != ""
    for page in ("<a <a " * 200_000, '<p "' * 200_000, "<div><span>" * 100_000, "<!-- " * 100_000, "</div>" * 100_000):
        html.main_text(page)
    assert time.perf_counter() - start < 20
    assert html.main_text('<article><p>' + "Real text. " * 20 + '<div class="ad">one<div>two</div>three</div><p>' + "More text. " * 20) == ("Real text. " * 20).strip() + "\n" + ("More text. " * 20).strip()


def test_html_names_are_taken_whole():
    body = "<p>" + "Words of the article itself, in a row. " * 5 + "</p>"
    for name in ("social-history", "share-prices", "menu-planning", "banner-of-hope", "promontory", "headermost"):
        assert "The social history of bread" in html.main_text(f'<article>{body}<div class="{name}"><p>The social history of bread</p></div></article>')
    for name in ("ad", "x cookie-banner y", "share_buttons", "comment-list", "related-posts", "recent-posts", "site-nav", "footer", "ad-2"):
        assert "Something" not in html.main_text(f'<article>{body}<div class="{name}"><p>Something else here</p></div></article>')


def test_html_notices_behind_an_article_go():
    body = "<p>" + "Words of the article itself, in a row. " * 9 + "</p>"
    notice, longer = "<div>" + "We use crumbs " * 6 + "</div>", "<p>" + "We use crumbs " * 8 + "</p>"
    for page in (f"<article>{body}{body}</article>{notice}{longer}", f"{longer}<main>{body}</main>{notice}"):
        text = html.main_text(page)
        assert "crumbs" not in text and text.count("Words of the article") in (9, 18)


def test_warc_round_trip_over_small_ranges(spark):
    rng = random.Random(3)
    rows = [(i, f"http://x/{i}?q=a b%20", words(rng, rng.choice([1, 50, 3000]))) for i in range(30)]
    rows += [(100 + i, "http://copy", rows[4][2]) for i in range(9)] + [(200, None, None), (201, "u\r\nv", ""), (None, "n", "null id"), (7, "again", rows[7][2])]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    folder = warc.write_warc(pages.repartition(3))
    got = warc.read_warc(spark, folder, range_bytes=97).collect()
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    least = {}
    for i, _, h in rows:
        least[h or ""] = min(least.get(h or "", (True, 0)), key((i,)))
    for page, part in itertools.groupby(sorted(got, key=lambda r: r["record_id"]), lambda r: r["record_id"]):
        part = list(part)
        name = page[len("<urn:page:") : -1]
        own = [(i, u, h or "") for i, u, h in rows if (str(i) if i is not None else "") == name]
        assert len(part) == len(own)
        assert sorted((r["payload_bytes"], r["payload_digest"]) for r in part) == sorted((len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for _, _, h in own)
        assert sorted(str(r["target_uri"]) for r in part) == sorted(str(u) for _, u, _ in own)
        for r in part:
            if r["record_type"] == "revisit":
                assert r["payload"] is None and r["refers_to"] == f"<urn:page:{least[own[0][2]][1]}>"
            else:
                assert bytes(r["payload"]).decode() == own[0][2]
    firsts = [r for r in got if r["record_type"] == "response"]
    assert len(firsts) == len(least)
    assert warc.read_warc(spark, warc.write_warc(pages.where("page_id = 4"))).count() == 1


def test_suffix_arrays_match_sorting():
    rng = np.random.default_rng(0)
    for _ in range(400):
        s = np.append(rng.integers(1, 1 + rng.integers(1, 5), rng.integers(1, 50)), 0)
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeated_strings_match_brute_force(spark, group):
    rng, length = random.Random(6), 60
    shared = [words(rng, n, 5000) for n in (14, 16, 30, 80)]
    texts = [words(rng, 40, 5000) for _ in range(25)]
    for i in range(20):
        texts.append(f"{words(rng, 9, 5000)} {shared[i % 4][i % 3:]} {words(rng, 9, 5000)}")
    texts += [texts[0], texts[0], "aé" * 90, "x" * 59, "x" * 60, "y" * 61, None, ""]
    docs = spark.createDataFrame([(i if i else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, start int, node int")
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    want = []
    for b in raw:
        gone = {x for s in range(len(b) - length + 1) if count[b[s : s + length]] > 1 for x in range(s, s + length)}
        want.append((len(b), bytes(c for k, c in enumerate(b) if k not in gone), sum(x - 1 not in gone for x in gone)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    spans = substrings.repeated_spans(rows.select(F.col("doc_id").alias("id"), "node", "text"), length, group).collect()
    gone = collections.defaultdict(set)
    for s in spans:
        gone[s["node"]] |= set(range(s["start"], s["end"]))
    for r, (n, kept, _) in zip(rows.collect(), want):
        assert n - len(gone[r["node"]]) == len(kept)
    left = substrings.without_repeats(docs, length=length).select("row.doc_id", "n_bytes", "kept", F.size("starts")).collect()
    assert sorted((r[1], bytes(r[2]), r[3]) for r in left) == sorted(want)
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_anchors_over_stretch_borders_are_one_place(monkeypatch):
    raw = np.frombuffer(random.Random(12).randbytes(20_000).hex().encode(), np.uint8)
    for stretch, part in ((1, raw[:1500]), (7, raw[:3000]), (100, raw), (401, raw), (4096, raw)):
        want = [np.concatenate(x) for x in zip(*substrings.anchors(part, 400))]
        with monkeypatch.context() as m:
            m.setattr(substrings, "_STRETCH", stretch)
            got = [np.concatenate(x) for x in zip(*substrings.anchors(part, 400))]
        assert all(g.tolist() == w.tolist() for g, w in zip(got, want))


def test_long_unique_text_stays_whole(spark):
    text = random.Random(13).randbytes((substrings._STRETCH + 6000) // 2).hex()
    left = substrings.without_repeats(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"))
    assert left.where("row.doc_id = 1").select("n_bytes", F.octet_length("kept"), F.size("starts")).collect() == [(len(text), len(text), 0)]


def test_lm_scores_match_brute_force(spark, docs, corpus):
    got = lm.lm_scores(docs, group_bytes=2000).collect()
    own = [(r[0], re.findall(mixing.WORD, r[1] or "")) for r in corpus]  # one text has a no-break space inside a word
    grams = [collections.Counter(tuple(w[a : a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1)) for _, w in own]
    whole = sum(grams, collections.Counter())
    tokens, want = sum(len(w) for _, w in own), []
    for (i, w), c in zip(own, grams):
        other = lambda g: whole[g] - c[g]
        score = 0.0
        for j in range(len(w)):
            f = 1.0
            for n in range(min(j, 2) + 1, 1, -1):
                g = tuple(w[j - n + 1 : j + 1])
                if other(g):
                    score += math.log10(f * other(g) / other(g[:-1]))
                    break
                f *= 0.4
            else:
                x = other((w[j],))
                score += math.log10(f * x / (tokens - len(w)) if x else f * 0.4 / (tokens - len(w) + 1))
        want.append((str(i), len(w), round(score, 6)))
    assert sorted((str(r["id"]), r["words"], round(r["score"], 6) + 0.0) for r in got) == sorted(want)
    assert lm.lm_scores(empty(spark)).count() == 0


def test_fingerprints_follow_order_and_neighbours(spark, docs, corpus):
    rows = fingerprints.neighbour_fingerprints(docs).select("row.doc_id", "text", "fingerprint", "next_text", "next_fingerprint").collect()
    assert len(rows) == len(corpus)
    texts = collections.defaultdict(set)
    for r in rows:
        texts[r["text"]].add(tuple(r["fingerprint"]))
    assert all(len(f) == 1 for f in texts.values())
    in_order = sorted({(key(r), r[1] or "") for r in corpus})
    following = {a: b for a, b in zip(in_order, in_order[1:] + in_order[:1])}
    for r in rows:
        if r["doc_id"] != corpus[2][0]:  # that row is there three times
            assert r["next_text"] == following[key(r), r["text"]][1]
    a = "".join(random.Random(1).choices("abcdefgh ", k=600))
    swapped = a[300:] + a[:300]
    near, far = fingerprints.order_minhash(a, hashes=256), fingerprints.order_minhash(swapped, hashes=256)
    edited = fingerprints.order_minhash(a[:250] + "#" + a[250:], hashes=256)
    assert np.mean(near == edited) > 0.8 > np.mean(near == far)
    assert fingerprints.neighbour_fingerprints(empty(spark)).count() == 0
    lone = fingerprints.neighbour_fingerprints(docs.where("doc_id = 0").limit(1)).collect()
    assert lone[0]["text"] == lone[0]["next_text"]
