"""Order MinHash: fingerprints that feel both which pieces a text has and in which order they stand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from pagelayout.llm.common import column, cut, ordered_chunk, partitions, quantile_bounds, row_hash, wrap
from pagelayout.llm.hashing import U64, mix64, rolling

K, TUPLE, HASHES = 8, 2, 32
CHUNKS_PER_TASK = 2
_PLACE = 24  # bits for a position while occurrences are numbered
_BLOCK = 1 << 20  # elements hashed at a time


def _elements(text: str, k: int) -> np.ndarray:
    """One 64-bit value per k-mer and its occurrence number, in text order; a text shorter than k is one k-mer."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(U64) + U64(1)
    kmers = mix64(rolling(points, k)) if len(points) >= k else mix64(np.array([np.sum(points * (np.arange(len(points), dtype=U64) * U64(2) + U64(3))) + U64(len(points))], dtype=U64))
    n = len(kmers)
    kmers &= ~U64((1 << _PLACE) - 1)
    if n < 1 << _PLACE:
        keyed = np.sort(kmers | np.arange(n, dtype=U64))
        place, value = (keyed & U64((1 << _PLACE) - 1)).astype(np.int64), keyed >> U64(_PLACE)
    else:
        place = np.argsort(kmers, kind="stable")
        value = kmers[place] >> U64(_PLACE)
    first = np.concatenate([[True], value[1:] != value[:-1]])
    rank = np.arange(n)
    times = rank - np.maximum.accumulate(np.where(first, rank, 0))
    out = np.empty(n, dtype=U64)
    out[place] = mix64(value * U64(0x9E3779B97F4A7C15) + times.astype(U64))
    return out


def _factors(hashes: int) -> np.ndarray:
    return mix64(np.arange(1, hashes + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)


def order_minhash(text: str, k: int = K, size: int = TUPLE, hashes: int = HASHES) -> np.ndarray:
    """The fingerprint of one text: ``hashes`` 32-bit values.

    Each hash function takes the ``size`` smallest occurrence-numbered k-mers, puts them back in text order and hashes
    the tuple. A text with fewer elements gives shorter tuples.
    """
    elements = _elements(text, k)
    keys = (elements >> U64(32)).astype(np.uint32)
    factors, out = (_factors(hashes) >> U64(32)).astype(np.uint32) | np.uint32(1), np.empty(hashes, dtype=np.uint32)
    n, take = len(elements), min(size, len(elements))
    for i, factor in enumerate(factors):
        best: list[tuple[int, int]] = []
        for at in range(0, n, _BLOCK):
            # an odd factor permutes the 32-bit keys; the first of equal keys counts as smaller
            order = keys[at : at + _BLOCK] * factor
            order ^= order >> np.uint32(15)
            for _ in range(min(take, len(order))):
                p = int(order.argmin())
                best.append((int(order[p]), at + p))
                order[p] = 0xFFFFFFFF
        chosen = sorted(p for _, p in sorted(best)[:take])
        value = i
        for p in chosen:
            value = (value * 0x100000001B3 + int(elements[p])) & 0xFFFFFFFFFFFFFFFF
        out[i] = (value ^ (value >> 32)) & 0xFFFFFFFF
    return out


def fingerprint(text: Column, k: int = K, size: int = TUPLE, hashes: int = HASHES) -> Column:
    """Column of fingerprints, array<int>; null counts as the empty text."""

    @F.pandas_udf("array<int>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([order_minhash(t or "", k, size, hashes).view(np.int32) for t in texts], index=texts.index, dtype=object)

    return made(text)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples of two fingerprints, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def as_text(fp: Column) -> Column:
    """A fingerprint as lowercase hex, eight digits a tuple."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def neighbour_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """Every document with its fingerprint, the next document's text and fingerprint in the order of ``key``.

    ``row`` (the input row without its text), text, fingerprint, next_text, next_fingerprint. After the last comes the first; a lone document follows itself.

    Keys ascend, null keys come last, rows of one key go by a hash of the row. The order is cut into chunks by quantiles of the
    key; each chunk also gets the first row of the chunk after it, so every text moves once and no task holds more than
    its chunk. Null texts are empty; no rows give no rows.
    """
    rows = wrap(docs)
    others = F.struct(*[column(c).alias(c) for c in docs.columns if c != text])
    rows = rows.select(others.alias("row"), column(key).alias("k"), row_hash(rows).alias("tie"), F.coalesce(column(text), F.lit("")).alias("text"))
    chunks = CHUNKS_PER_TASK * partitions(docs.sparkSession)
    bounds = quantile_bounds(rows, F.col("k"), chunks)
    rows = rows.withColumn("chunk", ordered_chunk(F.col("k"), F.col("tie"), bounds))
    place = F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"), (F.col("tie") < 0).alias("high"), F.col("tie").alias("tie"))
    rows = rows.withColumn("place", place)

    heads = rows.groupBy("chunk").agg(F.min("place").alias("head"))  # at most one row per chunk
    earlier = F.lag("chunk").over(W.orderBy("chunk"))
    heads = cut(heads.select("chunk", "head", F.coalesce(earlier, F.max("chunk").over(W.partitionBy())).alias("lender")))
    rows = rows.join(F.broadcast(heads), "chunk")
    to = F.when(F.col("place") == F.col("head"), F.array(F.struct("chunk", F.lit(False).alias("borrowed")), F.struct(F.col("lender").alias("chunk"), F.lit(True).alias("borrowed"))))
    to = F.coalesce(to, F.array(F.struct("chunk", F.lit(False).alias("borrowed"))))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text"), **params))
    rows = rows.select("row", "text", "fingerprint", "place", F.explode(to).alias("to")).select("row", "text", "fingerprint", "place", "to.chunk", "to.borrowed")
    inside = W.partitionBy("chunk").orderBy("borrowed", "place")
    rows = rows.withColumn("next_text", F.lead("text").over(inside)).withColumn("next_fingerprint", F.lead("fingerprint").over(inside))
    return rows.where(~F.col("borrowed")).select("row", "text", "fingerprint", "next_text", "next_fingerprint")
