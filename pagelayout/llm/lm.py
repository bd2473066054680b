"""Language-model scores by stupid backoff, from n-gram counts over all documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelayout.llm.common import column, partitions, wrap
from pagelayout.llm.hashing import U64, mix64, pieces

ORDER, FACTOR = 3, 0.4
GROUP_BYTES = 10 << 20  # text of a group of documents
BUCKET_BYTES = 8 << 20  # text whose n-grams a partition of the count table takes, about
HASH_BITS = 56  # sorted hashes are sent as gaps, so a shorter hash is a smaller shuffle; a trillion n-grams collide once in 70,000


def word_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, and document and place of each."""
    words = []
    for a, part, ends in pieces(texts):
        words.append((part, a, ends))
    flat = np.concatenate([w for w, _, _ in words]) if words else np.zeros(0, U64)
    sizes = np.concatenate([np.diff(ends, prepend=0) for _, _, ends in words]) if words else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    return flat, doc, place


def longer_grams(shorter: np.ndarray | None, flat: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at each word, from those one word shorter; 0 where the document is too short before it."""
    short = U64(64 - HASH_BITS)
    if n == 1:
        return (mix64(flat + U64(1)) >> short) | U64(1)
    longer = np.zeros(len(flat), U64)
    longer[1:] = (mix64(shorter[:-1] * U64(0x9E3779B97F4A7C15) + flat[1:] + U64(n)) >> short) | U64(1)
    longer[place < n - 1] = 0
    return longer


def ngrams(texts: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each word, per n, and document and place of each word."""
    flat, doc, place = word_table(texts)
    found: list[np.ndarray] = []
    for n in range(1, order + 1):
        found.append(longer_grams(found[-1] if found else None, flat, place, n))
    return found, doc, place


_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(values: np.ndarray) -> bytes:
    """Longs by byte plane, entropy-coded: planes of small numbers shrink to nothing, and of gaps only the even bits stay."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + _ZSTD.compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = _ZSTD.decompress(data[8:], decompressed_size=8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash; it never falls along sorted hashes."""
    return ((keys >> U64(HASH_BITS - 32)) * U64(buckets)) >> U64(32)


def _sorted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all n-grams in the order of their hashes, where each hash begins there, and the hashes."""
    order = np.argsort(grams, kind="stable")[int((grams == 0).sum()) :]
    held = grams[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
    return order, first, held[first]


def _others(grams: np.ndarray, doc: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For each place how often the other documents have its n-gram; totals come in the order of the hashes."""
    order, first, _ = _sorted(grams)
    out = np.zeros(len(grams), np.int64)
    if len(order):
        # places of one hash are in document order, so those of one document stand together
        key = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        own_doc = doc[order]
        run = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own_doc[1:] != own_doc[:-1])]))
        size = np.diff(np.append(run, len(order)))
        out[order] = totals[key] - np.repeat(size, size)
    return out


def _scores(texts: list[str], order: int, totals: list[np.ndarray], tokens: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log10 scores per document, with the counts of the other documents; one order at a time is held."""
    flat, doc, place = word_table(texts)
    sizes = np.bincount(doc, minlength=len(texts))
    grams = longer_grams(None, flat, place, 1)
    others = _others(grams, doc, totals[0])
    rest = (tokens - sizes)[doc]
    steps = np.minimum(place, order - 1)  # words of context that there are
    log = np.where(others > 0, np.log10(np.maximum(others, 1) / np.maximum(rest, 1)), np.log10(factor / (rest + 1.0))) + steps * np.log10(factor)
    del rest
    for n in range(2, order + 1):
        grams = longer_grams(grams, flat, place, n)
        context = np.concatenate([[0], others[:-1]]) if len(others) else others
        others = _others(grams, doc, totals[n - 1])
        own = np.log10(np.maximum(others, 1) / np.maximum(context, 1)) + (steps - (n - 1)) * np.log10(factor)
        log = np.where(others > 0, own, log)
    return sizes, np.bincount(doc, weights=log, minlength=len(texts))


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, factor: float = FACTOR, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Every document with its words and the sum of log10 scores of its words under the n-gram counts of all other documents.

    ``id``, words long, score double (0 without words).

    A word with k words before it (at most order - 1) scores c(k+1-gram) / c(context) if the other documents have that n-gram, else
    ``factor`` times the score for one word of context less; at the end stands c(word) / N, and ``factor`` / (N + 1) for a
    word that no other document has, N being the words of the others. Words are cut at ASCII white space; null texts are empty.

    Documents go by a hash of id and text into groups of about ``group_bytes``. A group counts its distinct n-grams and sends them, by hash, to
    the partitions of the count table; so a frequent n-gram arrives once per group. A partition adds up the counts of each
    n-gram and answers every group with the totals of what it asked for; joined to its documents these give the scores. Texts and
    n-grams move once.
    """
    rows = wrap(docs).select(column(doc_id).alias("id"), F.coalesce(column(text), F.lit("")).alias("text"))
    whole = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()
    # tasks hold a group or a bucket, so both follow the text, not the cluster
    groups, tokens = int(whole[0]) // group_bytes + 1, int(whole[1])
    buckets = max(partitions(docs.sparkSession), int(whole[0]) // BUCKET_BYTES + 1)
    group = F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int")
    rows = rows.withColumn("group", group).repartition(min(groups, partitions(docs.sparkSession)), "group")

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        asked, grams = [], None
        flat, _, place = word_table(list(part["text"]))
        for n in range(order):
            grams = longer_grams(grams, flat, place, n + 1)
            held = np.sort(grams[grams != 0])
            first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
            keys, counts = held[first], np.diff(np.append(first, len(held)))
            ends = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1, dtype=U64))
            asked += [(b, part["group"].iloc[0], n, _pack(np.diff(keys[a:z], prepend=U64(0))), _pack(counts[a:z])) for b, (a, z) in enumerate(zip(ends, ends[1:])) if a < z]
        return pd.DataFrame(asked, columns=["bucket", "group", "n", "keys", "counts"])

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        answered = []
        for n, own in part.groupby("n"):
            asked = [np.cumsum(_unpack(k).view(U64), dtype=U64) for k in own["keys"]]
            ends = np.cumsum([0, *map(len, asked)])
            keys = np.concatenate(asked)
            by_key = np.argsort(keys)
            keys = keys[by_key]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sums = np.add.reduceat(np.concatenate([_unpack(c) for c in own["counts"]])[by_key], first)
            totals = np.empty(len(keys), np.int64)
            totals[by_key] = np.repeat(sums, np.diff(np.append(first, len(keys))))
            answered += [(g, b, n, _pack(totals[a:z])) for g, b, a, z in zip(own["group"], own["bucket"], ends, ends[1:])]
        return pd.DataFrame(answered, columns=["group", "bucket", "n", "totals"])

    def score(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("bucket")
        totals = [np.concatenate([np.zeros(0, np.int64), *map(_unpack, answers["totals"][answers["n"] == n])]) for n in range(order)]
        sizes, scores = _scores(list(part["text"]), order, totals, tokens, factor)
        return pd.DataFrame({"id": part["id"], "words": sizes, "score": scores})

    asked = rows.groupBy("group").applyInPandas(ask, "bucket int, group int, n int, keys binary, counts binary")
    answered = asked.groupBy("bucket").applyInPandas(answer, "group int, bucket int, n int, totals binary")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.groupBy("group").cogroup(answered.groupBy("group")).applyInPandas(score, f"id {kind}, words long, score double")
