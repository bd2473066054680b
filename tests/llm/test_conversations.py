"""Repair of conversations against an enumeration of all edits."""

import hashlib
import random
import re
import zlib

import pytest

from pagelayout.llm import conversations, queries
from pagelayout.llm.common import column

SCHEMA = "conv_id long, turn long, role string, text string, row string, conv string, used int"
LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """turns: (role, text, must_go, truncated). All edits that cost no more than deleting everything, by trying them."""
    best = [(4 * len(turns) + 1, "", [])]

    def go(i, cost, audit, out):
        if cost > best[0][0]:
            return
        roles = "".join(r[:1] or "?" for r, _ in out)
        if not re.fullmatch(r"s?(ua)*u?", roles):  # nothing that follows can mend the beginning
            return
        if i == len(turns):
            if LEGAL.fullmatch(roles):
                best[0] = min(best[0], (cost, audit, out), key=lambda b: b[:2])
        else:
            role, text, must_go, truncated = turns[i]
            go(i + 1, cost + 4, audit + "D", out)
            if not must_go:
                go(i + 1, cost + 3 * truncated, audit + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, cost + 3 + 3 * truncated, audit + "R", [*out, (r, text)])
        for r in ("user", "assistant"):
            go(i, cost + 3, audit + "I", [*out, (r, "")])

    go(0, 0, "", [])
    return best[0]


def expected(rows, harmed):
    """conv -> digest columns, from rows (conv, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if harmed else 9
        own = convs.setdefault(conv, [])
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        own += [(turn, role, text)] * (2 if harm == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        numbers = [t[0] for t in own if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, turns, faults = set(), [], [0, 0, 0]
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            turns.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = cheapest(turns)
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = ((gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), made)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    rows = []
    for conv in range(160):
        for turn in range(rng.randint(0, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "student", "umpire", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "so", "Why? \n", " \t", "", None, "é.", "Yes."])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, 2, "assistant", "Ho."), (500, None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_and_repaired_turns(spark, rows):
    turns = frame(spark, rows)
    found = conversations.repair_conversations(turns)
    want = expected(rows, harmed=False)
    assert {r["conv"]: tuple(r[c] for c in NAMES) for r in found.collect()} == {c: w[0] for c, w in want.items()}
    made = {c: [] for c in want}
    for r in conversations.repaired_turns(turns, found).orderBy("conv", "position").collect():
        assert r["position"] == len(made[r["conv"]])
        made[r["conv"]].append((r["role"], r["text"]))
    assert made == {c: w[1] for c, w in want.items()}
    none = turns.limit(0)
    assert conversations.repair_conversations(none).count() == 0 == conversations.repaired_turns(none, conversations.repair_conversations(none)).count()


def test_registered_query(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_repair_conversations(spark, str(tmp_path)).collect()
    want = expected(rows, harmed=True)
    assert len(got) == len(want) and {r["conv_id"]: tuple(r[c] for c in NAMES) for r in got} == {c: w[0] for c, w in want.items()}
    frame(spark, rows).limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op13_repair_conversations(spark, f"{tmp_path}/none").count() == 0


def test_backpointers_spill_and_batches_join(spark, monkeypatch):
    rng = random.Random(3)
    turns = [(rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c!"]), rng.random() < 0.1, rng.random() < 0.2) for _ in range(3000)]

    def run():
        repair = conversations.Repair()
        for t in turns:
            repair.turn(*t)
        return repair.end()

    whole = run()
    monkeypatch.setattr(conversations, "HELD", 256)
    assert run() == whole and len(whole[1].replace("I", "")) == 3000
    # one conversation over many Arrow batches, beside many short ones
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(4000)] + [(100 + i, 0, "user", "x.") for i in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = {r["conv"]: r for r in conversations.repair_conversations(frame(spark, rows), dropped=column("turn") == 17).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 51 and found[7]["gaps"] == 1 and found[7]["cost"] == 3 and found[7]["audit"] == "K" * 17 + "I" + "K" * 3982
