"""Removal of repeated word windows against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from pagelayout.llm import hashing, queries, recompression

SCHEMA = "doc_id long, text string, row string, node string, kept string, id int, salt int"


def plain(rows, window):
    """(doc_id, words, removed words, kept text) by looking at every window."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    times = collections.Counter(tuple(w[a : a + window]) for _, w in split for a in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - window + 1):
            if times[tuple(w[a : a + window])] > 1:
                gone.update(range(a, a + window))
        out.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def texts(window, seed=1):
    rng = random.Random(seed)
    word = lambda top: f"w{int(rng.random() ** 2 * top)}"
    passage = [word(500) for _ in range(window + 9)]
    out = []
    for k in range(70):
        own = [word(rng.choice([30, 5000])) for _ in range(rng.randint(0, 4 * window))]
        if k % 3 == 0:  # parts of the passage, some just too short, some changed
            a = rng.randint(0, 12)
            part = passage[a : a + rng.choice([window - 1, window, window + 3])]
            if k % 9 == 0:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(own))
            own[at:at] = part
        out.append(rng.choice([" ", "\n", "\t \x0b"]).join(own))
    out += [out[0], out[0], None, None, "", " \n", " ".join(passage), " ".join(["one"] * (3 * window)), " ".join(["one"] * (window - 1)), " ".join(["one"] * (window - 1) + ["two"])]
    out += [" ".join(["a", "b"] * (2 * window)), " ".join((["a"] * (k % 7) + ["b"])[j] for k in range(window) for j in range(k % 7 + 1)), " ".join(["one"] * (window + 20) + ["two", "one"])]
    out += [" ".join(["x"] * k + ["y"] * (window - k)) for k in range(0, window, 3)] + [" ".join(["z"] + ["x"] * k + ["y"] * (window - k) + ["z"]) for k in range(0, window, 3)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "n", "k", 1, 2) for i, t in rows], SCHEMA).repartition(4)


def found(df):
    return sorted((str(r["doc_id"]), r["n_words"], sum(z - a for a, z in zip(r["starts"], r["ends"])), r["kept"]) for r in df.select("row.doc_id", "n_words", "kept", "starts", "ends").collect())


@pytest.mark.parametrize("window, stretch, piece", [(35, 1 << 18, 1 << 20), (35, 64, 300), (6, 50, 1000), (12, 1 << 18, 1), (70, 97, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, window, stretch, piece):
    monkeypatch.setattr(recompression, "STRETCH", stretch)
    monkeypatch.setattr(hashing, "PIECE", piece)
    rows = [(i * 2, t) for i, t in enumerate(texts(window, window))]
    rows += [(None, rows[3][1]), rows[6], rows[6]]
    assert found(recompression.without_repeated_words(frame(spark, rows), window=window)) == plain(rows, window)


def test_registered_query(spark, tmp_path):
    rows = list(enumerate(texts(35, 8)))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_substring_dedup(spark, str(tmp_path)).collect()
    want = sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(rows, 35))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    frame(spark, rows).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_substring_dedup(spark, f"{tmp_path}/none").count() == 0


def test_interior_symbols_do_not_depend_on_what_stands_beside():
    rng = np.random.default_rng(3)
    for window in (11, 35, 70, 200):
        limits = recompression.caps(window)
        margin = sum(limits)
        for _ in range(60):
            inner = rng.integers(0, rng.choice([1, 2, 3, 50]), window).astype(np.uint64) + np.uint64(1)
            seen = []
            for _ in range(6):
                left, right = (rng.integers(0, 3, rng.integers(0, 12)).astype(np.uint64) + np.uint64(1) for _ in range(2))
                names, lengths = recompression.recompress(np.concatenate([left, inner, right]), limits)
                begin = np.cumsum(lengths) - lengths - len(left)
                inside = (begin >= margin) & (begin + lengths <= window - margin)
                seen.append((names[inside].tolist(), begin[inside].tolist()))
                assert lengths.max() <= max([1, *limits]) and inside.any()
            assert all(s == seen[0] for s in seen)
