"""Removal of repeated word sequences, by recompression: runs and pairs of symbols get names, and shared names show what repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelayout.llm import hashing
from pagelayout.llm.common import column, cut, drop_table, table, wrap
from pagelayout.llm.hashing import U64, mix64, pieces, rolling

WINDOW = 35
SALTS = 8
STRETCH = 1 << 18  # windows that are searched at a time
_PLACE = U64((1 << 24) - 1)
_SEED = 0x9E3779B97F4A7C15


def caps(window: int) -> list[int]:
    """Most words of a symbol after each round.

    A round can change up to ``cap`` words at either end of a window by what stands beside it. So the words from ``sum(caps)`` to
    ``window - sum(caps)`` have the same symbols in all occurrences, and these must have room for a whole symbol, with something over.
    """
    out = []
    while 4 * (2 * sum(out) + 4 * (2 << len(out)) - 1) <= 3 * window:
        out.append(2 << len(out))
    return out


def recompress(words: np.ndarray, limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(names, lengths in words) of the symbols after a round per limit.

    A round first names runs: equal symbols in a row become one symbol, if it has at most ``limit`` words. Then it names pairs: a hash deals every symbol
    a side, and a left one followed by a right one becomes one symbol, within the limit; symbols of a run that is too long stay
    alone. Names are hashes of what they stand for, so they are the same in every task, and what happens depends on the neighbours only.
    """
    names, lengths = mix64(words + U64(1)), np.ones(len(words), np.int64)
    for turn, limit in enumerate(limits):
        seed = U64((turn + 1) * _SEED & 0xFFFFFFFFFFFFFFFF)
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(names)))
        short = (times > 1) & (times * lengths[first] <= limit)
        stays = np.repeat(~short, times)
        stays[first] = True
        alone = np.repeat((times > 1) & ~short, times)[stays]
        run = first[short]
        names[run] = mix64(names[run] * U64(3) + times[short].astype(U64) * U64(_SEED) + seed)
        lengths[run] *= times[short]
        names, lengths = names[stays], lengths[stays]
        right = (mix64(names ^ seed) >> U64(63)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & ~alone[:-1] & ~alone[1:] & (lengths[:-1] + lengths[1:] <= limit))
        names[pair] = mix64(names[pair] * U64(_SEED) + mix64(names[pair + 1] + seed))
        lengths[pair] += lengths[pair + 1]
        names, lengths = np.delete(names, pair + 1), np.delete(lengths, pair + 1)
    return names, lengths


def _prefix(words: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, U64), np.cumsum(words * hashing._powers(hashing.BASE, len(words))[:-1], dtype=U64)])


def anchors(words: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor, context, doc, at, first, last) over the words of texts that end at ``ends``; places count from the first word of all.

    Every window has an anchor: of the symbols that begin in its inner part, that with the smallest hash. Equal windows have equal symbols there, so
    they have equal anchors at equal distances. ``anchor`` is a hash of the symbol's place and its sure neighbourhood, which all windows around it
    contain; it stands for a run of windows, first to last. ``context`` is a hash of all words that windows around the anchor can reach.
    """
    limits = caps(window)
    margin, largest = sum(limits), max([1, *limits])
    starts = window - 2 * margin - largest + 1  # places in a window at which its anchor may begin
    at, first, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(words) - window + 1, STRETCH):
        names, lengths = recompress(words[a : a + STRETCH + window - 1], limits)
        n = int(lengths.sum())
        begin = np.cumsum(lengths) - lengths
        low = np.full(n, np.iinfo(np.uint64).max, U64)
        low[begin] = (mix64(names + U64(7)) & ~_PLACE) | begin.astype(U64)
        low, width = low[margin : n - margin - largest + 1], 1
        while width * 2 <= starts:
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        if width < starts:
            low = np.minimum(low[: width - starts], low[starts - width :])
        where = (low & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        at.append(where[new] + a)
        first.append(new + a)
        last.append(np.append(new[1:], len(where)) - 1 + a)
    at, first, last = np.concatenate(at), np.concatenate(first), np.concatenate(last)
    if len(at):  # one row for a run that goes on over a stretch's border
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        at, first, last = at[new], first[new], last[np.append(new[1:], len(at)) - 1]
    begins = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(ends, at, side="right")
    first, last = np.maximum(first, begins[doc]), np.minimum(last, ends[doc] - window)  # windows do not cross texts
    held = first <= last
    at, first, last, doc = at[held], first[held], last[held], doc[held]
    sums, inverse = _prefix(words), hashing._powers(hashing._INVERSE, len(words))

    def digest(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return (sums[z] - sums[a]) * inverse[a]

    sure = mix64(digest(at - margin, at + largest + margin))
    lo = np.maximum(at - (window - margin - largest), begins[doc])
    hi = np.minimum(at - margin + window, ends[doc])
    context = mix64(digest(lo, hi) + ((at - lo) * 65536 + (hi - at)).astype(U64))
    return sure, context, doc, at - begins[doc], first - begins[doc], last - begins[doc]


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, node, text) rows to (node, start, end): word ranges of the text with digest ``node`` that repeated windows cover; they may overlap.

    Rounds of names run inside the tasks, since a name follows from its content. Spark then counts over all texts, always with partial sums: anchors, of
    which those that occur once settle all their windows; whole contexts, of which those that occur again settle theirs; and single
    windows of what is left, one copy of each context, by anchor, distance and hash.
    """
    found_kind = "anchor long, context long, node binary, at int, first int, last int"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, words, ends in pieces(list(batch["text"])):
                anchor, context, doc, at, first, last = anchors(words, ends, window)
                if len(at):
                    yield pd.DataFrame({"anchor": anchor.view(np.int64), "context": context.view(np.int64), "node": batch["node"].to_numpy()[a + doc], "at": at, "first": first, "last": last})

    long_rows = rows.where(F.octet_length("text") >= 2 * window - 1)
    every = table(long_rows.select("node", "text").mapInPandas(find, found_kind))
    often = cut(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"))
    found = table(every.join(often, "anchor"))
    drop_table(every)
    contexts = cut(found.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("node", "at", "first", "last")).alias("one")))
    whole = found.join(contexts.where("times > 1").select("anchor", "context"), ["anchor", "context"]).select("node", F.col("first").alias("start"), (F.col("last") + window).alias("end")).distinct()

    groups = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    wanted = contexts.join(groups, "anchor").select("one.node", F.struct("anchor", "times", "one.at", "one.first", "one.last").alias("w"))
    wanted = wanted.groupBy(F.col("node").alias("n")).agg(F.collect_list("w").alias("w"))  # anchors of one text
    # one row of each text holds it, found by its id too, so that a frequent text does not meet in one task
    ids = long_rows.groupBy("node").agg(F.min("id").alias("i"))
    wanted = wanted.join(ids, F.col("n") == F.col("node")).select("i", "n", *[F.col(f"w.{c}").alias(c) for c in ("anchor", "times", "at", "first", "last")])
    holders = long_rows.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("node") == F.col("n"))).dropDuplicates(["i", "n"])

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, words, ends in pieces(list(batch["text"])):
                digest = mix64(rolling(mix64(words ^ U64(_SEED)), window))
                some = batch.iloc[a : a + len(ends)]
                base = np.repeat(np.concatenate([[0], ends[:-1]]), some["anchor"].str.len())
                anchor, times, at, first, last = (np.concatenate(list(some[c])) for c in ("anchor", "times", "at", "first", "last"))
                size = last - first + 1
                which = np.repeat(np.arange(len(size)), size)
                start = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which]
                node = np.repeat(some["node"].to_numpy(), some["anchor"].str.len())
                yield pd.DataFrame({"anchor": anchor[which], "away": at[which] - start, "digest": digest[base[which] + start].view(np.int64), "times": times[which], "node": node[which], "start": start})

    each = table(holders.select("node", "text", "anchor", "times", "at", "first", "last").mapInPandas(show, "anchor long, away int, digest long, times long, node binary, start int"))
    same = ["anchor", "away", "digest"]
    again = each.groupBy(*same).agg(F.sum("times").alias("all")).where("all > 1").select(*same)
    single = each.join(again, same).select("node", "start", (F.col("start") + window).alias("end"))
    return whole.union(single)


def _kept(text: Column, starts: Column, ends: Column) -> Column:
    """struct<n_words, kept, starts, ends>: the remaining words joined by one space, and the maximal ranges that are gone."""

    @F.pandas_udf("n_words long, kept string, starts array<int>, ends array<int>")
    def made(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, firsts, lasts in batches:
            out = []
            for t, a, z in zip(texts, firsts, lasts):
                words = t.encode("utf-8").split()
                n = len(words)
                if a is not None and len(a):
                    order = np.argsort(a, kind="stable")
                    a, z = np.asarray(a)[order], np.maximum.accumulate(np.asarray(z)[order])
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
                    a, z = a[new], z[np.append(new[1:], len(z)) - 1]
                    edges = [0, *np.stack([a, z], 1).ravel().tolist(), n]
                    words = [w for x, y in zip(edges[::2], edges[1::2]) for w in words[x:y]]
                out.append((n, b" ".join(words).decode("utf-8"), [] if a is None else a, [] if a is None else z))
            yield pd.DataFrame(out, columns=["n_words", "kept", "starts", "ends"])

    return made(text, starts, ends)


def without_repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every document without the words that repeated windows cover.

    ``row``, n_words long, kept (remaining words joined by one space), starts and ends of the maximal removed ranges of words.

    Words are cut at ASCII white space and compared as they are. ``window`` words in a row of one document are repeated if the same words start anywhere else too,
    in this document or another; all occurrences go. Windows are judged on the input and do not cross documents. Null texts are empty; a
    document with fewer words stays whole. Repeated rows count as copies; null ids are ids. No rows give no rows.
    """
    rows = wrap(docs)
    rows = rows.select("row", column(doc_id).alias("id"), F.coalesce(column(text), F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5(F.col("text"))))
    spans = repeated_windows(rows.select("id", "node", "text"), window)
    spans = spans.groupBy(F.col("node").alias("n")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.select("n", F.col("spans.start").alias("a"), F.col("spans.end").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(spans, (F.col("node") == F.col("n")) & (F.col("salt") == F.col("s")), "left")
    return rows.select("row", _kept(F.col("text"), F.col("a"), F.col("z")).alias("left")).select("row", "left.*")
