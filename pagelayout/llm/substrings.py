"""Removal of repeated byte strings, by suffix arrays over what can repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelayout.llm import hashing
from pagelayout.llm.common import column, cut, drop_table, table, wrap
from pagelayout.llm.hashing import U64, mix64, rolling
from pagelayout.llm.suffixes import suffix_array

LENGTH = 400
BLOCK = 10  # string starts that are settled together
GROUP = 20_000  # texts around one anchor that a task takes at once
SALTS = 8
_PLACE = U64((1 << 24) - 1)
_STRETCH = 4 << 20  # string starts of a text that are searched at a time


def _gram(length: int) -> int:
    return max(1, length * 3 // 4)


def anchors(raw: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, context, at, first, last) of a text.

    Every string of ``length`` bytes has an anchor: of the grams of three quarters of its length inside it, the first with the smallest
    hash. Equal strings have equal anchors at equal distances. An anchor stands for a run of string starts, first to last; its
    context is a hash of all bytes that a string with this anchor can cover. A run that goes on over a stretch's border is one row.
    """
    gram, n = _gram(length), len(raw)
    reach = length - gram
    held = None  # the last row of the stretches so far, whose run may go on
    for a in range(0, n - length + 1, _STRETCH):
        part = raw[a : min(n, a + _STRETCH + length - 1)]
        grams = mix64(rolling(part.astype(U64) + U64(1), gram))
        low, width = (grams & ~_PLACE) | np.arange(len(grams), dtype=U64), 1
        while width * 2 <= reach + 1:
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        if width <= reach:
            rest = reach + 1 - width
            low = np.minimum(low[:-rest], low[rest:])
        at, first = np.unique((low & _PLACE).astype(np.int64), return_index=True)
        last = np.append(first[1:], len(low)) - 1
        # contexts reach over the stretch's borders
        base = max(0, a - reach)
        around = raw[base : min(n, a + _STRETCH + length + reach)]
        powers = hashing._powers(hashing.BASE, len(around))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum((around.astype(U64) + U64(1)) * powers[:-1], dtype=U64)])
        at = at + a
        lo, hi = np.maximum(at - reach, 0), np.minimum(at + length, n)
        context = mix64((sums[hi - base] - sums[lo - base]) * hashing._powers(hashing._INVERSE, len(around))[lo - base] + ((at - lo) * 65536 + (hi - at)).astype(U64))
        rows = [grams[at - a], context, at, first + a, last + a]
        if held is not None:
            if held[2][0] == at[0]:
                rows[3][0] = held[3][0]
            else:
                rows = [np.append(h, r) for h, r in zip(held, rows)]
        held = [r[-1:] for r in rows]
        yield tuple(r[:-1] for r in rows)
    if held is not None:
        yield tuple(held)


def _runs(at: int, starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans that the strings at these sorted starts cover, joined where starts follow each other."""
    cut_at = np.flatnonzero(np.diff(starts) > 1) + 1
    return [(at + int(s[0]), at + int(s[-1]) + length) for s in np.split(starts, cut_at) if len(s)]


def repeated_windows(group: np.ndarray, times: np.ndarray, sides: np.ndarray, reach: int) -> np.ndarray:
    """Which of the ``reach + 1`` strings around each anchor occur again: a row per text, a column per start.

    ``sides`` has the ``reach`` letters before and after the anchor's gram, -1 where the text ends; texts of one group share the
    gram, so a string is a window of ``reach`` letters. ``times``: how often a text with its surroundings occurs.

    Starts are settled in blocks: strings of a block share a core; a core that occurs once settles the block, and so do surroundings that occur
    twice. The ragged rest goes to a suffix array: the core as one letter with the letters around it, where equal strings are neighbours.
    """
    n, width = sides.shape
    out = np.zeros((n, reach + 1), dtype=bool)
    known = sides >= 0
    left, right = known[:, :reach].sum(1), known[:, reach:].sum(1)
    starts = np.arange(reach + 1)
    valid = (starts >= reach - left[:, None]) & (starts <= right[:, None])
    powers = hashing._powers(hashing.BASE, width)
    sums = np.concatenate([np.zeros((n, 1), U64), np.cumsum((sides + 2).astype(U64) * powers[:-1], axis=1, dtype=U64)], axis=1)

    def digest(a: int, z: int) -> np.ndarray:
        return mix64((sums[:, z] - sums[:, a]) + mix64(group.astype(U64) + U64(a * 1024 + z)))

    texts, owners, places = [], [], []
    symbol = 1000
    for a in range(0, reach + 1, BLOCK):
        z = min(a + BLOCK, reach + 1) - 1
        rows = np.flatnonzero(valid[:, a : z + 1].any(1))
        if not len(rows):
            continue
        _, core, shared = np.unique(digest(z, a + reach)[rows], return_inverse=True, return_counts=True)
        _, whole = np.unique(digest(a, min(z + reach, width))[rows], return_inverse=True)
        often = np.bincount(whole, weights=times[rows])[whole] >= 2
        out[rows[often], a : z + 1] = True
        ragged = (~often) & (shared[core] >= 2)
        mixed = np.isin(core, core[ragged])  # with the settled ones, as partners
        if ragged.any():
            rows, core, own = rows[mixed], core[mixed], ragged[mixed]
            # one copy of equal surroundings is partner enough
            _, one = np.unique(whole[mixed], return_index=True)
            rows, core, own = rows[one], core[one], own[one]
            before, after = sides[rows, a:z] + 2, sides[rows, a + reach : z + reach] + 2
            texts.append(np.hstack([before, symbol + core[:, None], after]).astype(np.int64).ravel())
            symbol += int(core.max()) + 1
            size = 2 * (z - a) + 1
            owners.append(np.repeat(np.where(own, rows, -1 - rows), size))
            step = np.tile(np.arange(size), len(rows))
            places.append(np.where(step <= z - a, a + step, -1))
    if texts:
        text, owner, place = np.concatenate([*texts, np.ones(BLOCK, np.int64), np.zeros(1, np.int64)]), np.concatenate(owners), np.concatenate(places)
        order = suffix_array(text)
        order = order[order < len(owner)]
        order = order[place[order] >= 0]
        row = np.where(owner[order] < 0, -1 - owner[order], owner[order])
        ok = valid[row, place[order]]
        order, row = order[ok], row[ok]
        # windows of one block have its size; the core's letter keeps blocks apart
        windows = text[order[:, None] + np.arange(BLOCK)]
        size = np.minimum(BLOCK, reach + 1 - place[order] // BLOCK * BLOCK)
        windows[np.arange(BLOCK) >= size[:, None]] = 0
        same = (windows[1:] == windows[:-1]).all(1) & (place[order][1:] == place[order][:-1])
        again = np.zeros(len(order), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        out[row[again], place[order][again]] = True
    return out & valid


def _sides(raw: np.ndarray, at: int, length: int) -> bytes:
    gram = _gram(length)
    reach = length - gram
    out = np.full(2 * reach, -1, dtype=np.int16)
    before = raw[max(0, at - reach) : at]
    after = raw[at + gram : at + length]
    out[reach - len(before) : reach] = before
    out[reach : reach + len(after)] = after
    return out.tobytes()


def repeated_spans(rows: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(id, node, text) rows to (node, start, end): spans of the text with hash ``node`` that repeated strings cover; they may overlap.

    Anchors with one occurrence cannot be in a repeated string; counting them is the only step that sees all. Where an anchor's whole context
    occurs again, all its strings do. What is left are texts around an anchor that differ somewhere near it, one per distinct context;
    those of one anchor meet in a task. An anchor with more than ``group`` of them goes another exact way: each of its strings is
    hashed and counted.
    """
    reach = length - _gram(length)
    kind = rows.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for r in batch.itertuples(index=False):
                for anchor, context, at, first, last in anchors(np.frombuffer(r.text.encode("utf-8"), np.uint8), length):
                    parts.append(pd.DataFrame({"anchor": anchor.view(np.int64), "context": context.view(np.int64), "id": r.id, "node": r.node, "at": at, "first": first, "last": last}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    long_rows = rows.where(F.octet_length("text") >= length)
    found = table(long_rows.mapInPandas(find, f"anchor long, context long, id {kind}, node long, at int, first int, last int"))
    # written first, so that the join has two plain exchanges and adaptive execution can split a frequent anchor
    often = cut(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"))
    every, found = found, table(found.join(often, "anchor"))
    drop_table(every)
    contexts = cut(found.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "node", "at")).alias("one")))
    whole = found.join(contexts.where("times > 1").select("anchor", "context"), ["anchor", "context"]).select("node", F.col("first").alias("start"), (F.col("last") + length).alias("end")).distinct()

    groups = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    wanted = contexts.join(groups, "anchor").select("one.id", "one.node", F.struct("anchor", "texts", "times", "one.at").alias("w"))
    wanted = wanted.groupBy(F.col("id").alias("i"), F.col("node").alias("n")).agg(F.collect_list("w").alias("w"))
    wanted = wanted.select("i", "n", *[F.col(f"w.{c}").alias(c) for c in ("anchor", "texts", "times", "at")])
    holders = long_rows.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("node") == F.col("n"))).dropDuplicates(["i", "n"])

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                raw = np.frombuffer(r.text.encode("utf-8"), np.uint8)
                yield pd.DataFrame({"anchor": r.anchor, "texts": r.texts, "times": r.times, "node": r.node, "at": r.at, "sides": [_sides(raw, p, length) for p in r.at]})

    shown = table(holders.select("node", "text", "anchor", "texts", "times", "at").mapInPandas(show, "anchor long, texts long, times long, node long, at int, sides binary"))

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        sides = np.frombuffer(b"".join(part["sides"]), np.int16).reshape(len(part), 2 * reach)
        hit = repeated_windows(part["anchor"].to_numpy(), part["times"].to_numpy(), sides, reach)
        spans = [(n, *s) for n, at, h in zip(part["node"], part["at"], hit) if h.any() for s in _runs(int(at) - reach, np.flatnonzero(h), length)]
        return pd.DataFrame(spans, columns=["node", "start", "end"])

    def settle_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for batch in batches:  # sorted by anchor: the last anchor of a batch may go on
            held = pd.concat([held, batch], ignore_index=True) if len(held) else batch
            last = held["anchor"] == held["anchor"].iloc[-1]
            if not last.all():
                yield settle(held[~last])
                held = held[last]
        if len(held):
            yield settle(held)

    span = "node long, start int, end int"
    few = shown.where(F.col("texts") <= group).repartition("anchor").sortWithinPartitions("anchor").mapInPandas(settle_all, span)

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                sides = np.frombuffer(r.sides, np.int16)
                known = np.convolve(sides >= 0, np.ones(reach, int), "valid") == reach
                hashes = mix64(rolling((sides + 2).astype(U64), reach))
                starts = np.flatnonzero(known)
                yield pd.DataFrame({"anchor": r.anchor, "place": starts, "string": hashes[starts].view(np.int64), "times": r.times, "node": r.node, "start": r.at - reach + starts})

    each = shown.where(F.col("texts") > group).mapInPandas(strings, "anchor long, place int, string long, times long, node long, start int")
    again = each.groupBy("anchor", "place", "string").agg(F.sum("times").alias("n")).where("n > 1").select("anchor", "place", "string")
    many = each.join(again, ["anchor", "place", "string"]).select("node", "start", (F.col("start") + length).alias("end"))
    return whole.union(few).union(many)


def _without(text: Column, starts: Column, ends: Column) -> Column:
    """struct<kept, starts, ends>: the remaining bytes, and the maximal spans that are gone."""

    @F.pandas_udf("kept binary, starts array<int>, ends array<int>")
    def made(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, firsts, lasts in batches:
            rows = []
            for t, a, z in zip(texts, firsts, lasts):
                raw = t.encode("utf-8")
                if a is None or not len(a):
                    rows.append((raw, [], []))
                    continue
                order = np.argsort(a, kind="stable")
                a, z = np.asarray(a)[order], np.maximum.accumulate(np.asarray(z)[order])
                new = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
                a, z = a[new], z[np.append(new[1:], len(z)) - 1]
                edges = [0, *np.stack([a, z], 1).ravel().tolist(), len(raw)]
                rows.append((b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])), a, z))
            yield pd.DataFrame(rows, columns=["kept", "starts", "ends"])

    return made(text, starts, ends)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every document without the bytes that repeated strings cover.

    ``row``, n_bytes, kept (remaining bytes), starts and ends of the maximal removed spans.

    A string of ``length`` bytes is repeated if it starts anywhere else too, in this document or another; all its copies go, the first as
    well. Strings do not cross documents and are judged on the input. Texts are taken as UTF-8, nulls are empty; shorter texts stay whole. Copies of a
    text are known by a 64-bit hash of it. Repeated rows count as copies; null ids are ids.
    """
    rows = wrap(docs)
    rows = rows.select("row", column(doc_id).alias("id"), F.coalesce(column(text), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    spans = repeated_spans(rows.select("id", "node", "text"), length)
    spans = spans.groupBy(F.col("node").alias("n")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.select("n", F.col("spans.start").alias("a"), F.col("spans.end").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(spans, (F.col("node") == F.col("n")) & (F.col("salt") == F.col("s")), "left")
    rows = rows.select("row", F.octet_length("text").cast("long").alias("n_bytes"), _without(F.col("text"), F.col("a"), F.col("z")).alias("left"))
    return rows.select("row", "n_bytes", "left.*")
