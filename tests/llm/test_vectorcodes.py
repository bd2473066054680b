"""Vector codes against plain Lloyd rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from pagelayout.llm import queries, vectorcodes
from pagelayout.llm.covertree import CoverTree

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row int, v string"


def plain(rows, parts, entries, rounds):
    """rows (vec_id, vector, label), as the contract reads; returns rows and the digest."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    size = width // parts
    whole = [[math.floor(float(np.float32(x)) * 256) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    cut = [[w[p * size : (p + 1) * size] for p in range(parts)] for w in whole]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))[:entries]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = [[] for _ in books[p]]
            for c in cut:
                got[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(g) for col in zip(*g)] if g else e for g, e in zip(got, books[p])]
    out = []
    for r, c in zip(kept, cut):
        near = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{i:02x}" for _, i in near), sum(d for d, _ in near)))
    of_label = {}
    for _, label, _, error in out:
        of_label[label] = of_label.get(label, 0) + error
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted((str(i), str(label), code, error, of_label[label]) for i, label, code, error in out), hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    rows = [(i * 2 if i else None, [rng.gauss(0, 0.1) for _ in range(32)], rng.choice([1, 2, None])) for i in range(500)]
    rows += [(3, [0.0] * 32, 1)] * 300 + [(3, [0.25] * 32, 1), rows[5], rows[5]]  # a frequent vector, ties, repeated rows
    rows += [(9, None, 1), (11, [None] + [0.0] * 31, 1), (13, [float("nan")] * 32, 2), (15, [float("inf")] * 32, 2), (17, [-float("inf")] + [1.0] * 31, 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def check(got, sha, want):
    assert sorted((str(r["id"]), str(r["label"]), r["code"], r["error"], r["label_error"]) for r in got) == want[0] and sha == want[1]


def test_codes_against_plain_rounds(spark, rows, monkeypatch):
    monkeypatch.setattr(vectorcodes, "CHUNK", 100)
    codes = vectorcodes.vector_codes(frame(spark, rows), parts=4, entries=20, rounds=3)
    check(codes.vectors.collect(), codes.sha256(), plain(rows, 4, 20, 3))


@pytest.mark.parametrize("case", ["few", "lengths", "hollow", "empty", "nothing kept"])
def test_corner_cases(spark, rows, case):
    some = {"few": rows[:5], "lengths": [(1, [0.5, -0.5, 0.1], 1), (2, [0.3], None), (3, [], 2), (4, [0.2] * 7, 1)], "hollow": [(1, [], None), (2, [], 1)], "empty": [], "nothing kept": [(1, None, 1), (2, [float("nan")], None)]}[case]
    codes = vectorcodes.vector_codes(frame(spark, some) if some else frame(spark, rows).limit(0), parts=4, entries=8)
    check(codes.vectors.collect(), codes.sha256(), plain(some, 4, 8, 2))


def test_registered_query(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_vector_codes(spark, str(tmp_path)).collect()
    want = plain(rows, 16, 64, 2)
    assert {r["codebooks_sha256"] for r in got} == {want[1]}
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got) == sorted((w[0], *w[2:]) for w in want[0])


def test_cover_tree_nodes_and_assignment():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-40, 40, (700, 3)), np.zeros((100, 3), int), rng.integers(5000, 5010, (200, 3))])
    tree = CoverTree.build(points)
    assert (points[tree.order] == tree.points).all()
    for low, high, place, radius, child, children in tree.nodes.tolist():
        away = ((tree.points[low:high] - tree.points[place]) ** 2).sum(1)
        assert away.max() == radius
        if children:
            below = tree.nodes[child : child + children]
            assert below[0, 0] == low and below[-1, 1] == high and (below[1:, 0] == below[:-1, 1]).all()
            centres = tree.points[below[:, 2]]
            apart = ((centres[:, None] - centres[None]) ** 2).sum(-1)[np.triu_indices(children, 1)]
            assert (apart > below[:, 3].max()).all()
    for k in (1, 2, 9, 64):
        centres = points[rng.integers(0, len(points), k)]
        nearest, sums, counts = tree.assign(centres)
        want = ((tree.points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        assert (nearest == want).all() and (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[i] == tree.points[want == i].sum(0)).all() for i in range(k))
    assert len(CoverTree.build(points[:0]).assign(points[:3])[0]) == 0
