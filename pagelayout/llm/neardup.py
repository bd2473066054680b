"""Near-duplicate documents: DartMinHash signatures, banded joins, exact verification, connected components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from pagelayout.llm.common import column, table, wrap
from pagelayout.llm.components import components
from pagelayout.llm.hashing import U64, mix64, shingles

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
COORDINATES = BANDS * ROWS
AGREE = 32  # of 64 coordinates; a pair at 0.8 agrees on fewer with a probability below 1e-7
SALTS = 8
LEAST_YIELD = 0.25  # links per comparison below which such turns end
BITS = 2048  # of the map of a text's units, from which pairs are ruled out
WORK = 100  # open pairs per bucket entry up to which pairs across components are compared outright
_GOLD = U64(0x9E3779B97F4A7C15)


def weighted_units(text: str, size: int = SHINGLE) -> np.ndarray:
    """The units of a text's weighted set: a shingle that occurs w times has units 0 to w - 1."""
    s = np.sort(shingles(text.encode("utf-8"), size))
    if not len(s):
        return s
    at = np.arange(len(s))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), at, 0))
    return mix64(s + (at - first).astype(U64) * _GOLD)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts by their units; two empty texts are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def dart_signature(units: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """DartMinHash of a weighted set: per coordinate the value of the earliest dart.

    Darts fall on the plane of element weight and time as a Poisson process fixed by hashes: each unit of weight has gaps
    between its darts drawn from the exponential distribution. A set sees the darts in its own region up to the time at which about
    k ln k + 2k have fallen; if a coordinate still has none, time doubles. So two sets share a coordinate's earliest dart with
    the probability of their weighted Jaccard similarity. An empty set has an all-zero signature.
    """
    out = np.zeros(k, dtype=U64)
    if not len(units):
        return out
    until = k * (np.log(k) + 2) / len(units)
    while True:
        live, time, turn = units, np.zeros(len(units)), 0
        values, times = [], []
        while len(live):
            turn += 1
            dart = mix64(live + U64(turn * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((dart >> U64(11)).astype(np.float64) + 0.5) / 2.0**53)
            kept = time <= until
            live, time, dart = live[kept], time[kept], dart[kept]
            values.append(mix64(dart))
            times.append(time)
        values, times = np.concatenate(values), np.concatenate(times)
        if len(values):
            late_first = np.argsort(-times, kind="stable")
            values = values[late_first]
            place = ((values >> U64(32)) % U64(k)).astype(np.int64)
            hit = np.zeros(k, dtype=bool)
            out[place] = values  # of darts on one coordinate the last assigned, the earliest, stays
            hit[place] = True
            if hit.all():
                return out
        until *= 2


SIGNED = "weight int, bands array<long>, bytes array<long>"


def signature(text: Column) -> Column:
    """struct<weight, bands, bytes>: size of the weighted set, a hash per band, and the low byte of each coordinate, eight to a long."""

    @F.pandas_udf(SIGNED)
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            weight, bands, low = [], [], []
            for t in texts:
                units = weighted_units(t or "")
                sig = dart_signature(units)
                weight.append(len(units))
                grouped = sig.reshape(BANDS, ROWS)
                band = np.arange(1, BANDS + 1, dtype=U64) * _GOLD
                for r in range(ROWS):
                    band = mix64(band + grouped[:, r])
                bands.append(band.view(np.int64))
                low.append((sig & U64(255)).astype(np.uint8).view(np.int64))
            yield pd.DataFrame({"weight": pd.Series(weight, dtype="int32"), "bands": bands, "bytes": low})

    return made(text)


def _agreement(a: str, b: str) -> Column:
    """Coordinates on which two packed signatures agree: zero bytes of the longs' differences."""
    total = F.lit(COORDINATES)
    for i in range(COORDINATES // 8):
        x = F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))
        for shift in (4, 2, 1):  # a byte's lowest bit becomes the union of its bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def _plausible() -> Column:
    """Weights and signatures leave it open that a pair (a_weight, a_bytes), (b_weight, b_bytes) reaches the threshold."""
    ratio = F.least("a_weight", "b_weight") >= F.greatest("a_weight", "b_weight") * THRESHOLD
    return ratio & (_agreement("a_bytes", "b_bytes") >= AGREE)


def _share_enough() -> Column:
    """Two upper bounds of the units that a and b share leave it open that they reach the threshold.

    What no other text has cannot be shared, and every bit that is set in only one map stands for a unit that is not shared.
    """

    def within(both: Column) -> Column:
        return both / (F.col("a_weight") + F.col("b_weight") - both) >= THRESHOLD

    def without(x: str, y: str) -> Column:
        bits = F.zip_with(f"{x}_map", f"{y}_map", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.col(f"{x}_weight") - F.aggregate(bits, F.lit(0), lambda total, n: total + n)

    shareable = F.least(F.col("a_weight") - F.col("a_private"), F.col("b_weight") - F.col("b_private"))
    return within(shareable) & within(F.least(without("a", "b"), without("b", "a")))


def _private_units(texts: DataFrame) -> DataFrame:
    """(node, private, map) of a table of texts (node, text): how many units no other of its texts has, and a bit for each unit's hash."""

    @F.pandas_udf("array<long>")
    def units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            yield pd.Series([weighted_units(x).view(np.int64) for x in xs])

    @F.pandas_udf("array<long>")
    def unit_map(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            maps = []
            for x in xs:
                bits = np.zeros(BITS, dtype=np.uint8)
                bits[(weighted_units(x) % U64(BITS)).astype(np.int64)] = 1
                maps.append(np.packbits(bits).view(np.int64))
            yield pd.Series(maps)

    # two 64-bit hashes stand for the node, since the minimum of a number, unlike that of bytes, is kept in a hash aggregate
    hashes = [F.xxhash64("node").alias("h"), F.xxhash64(F.lit(1), "node").alias("k")]
    spread = texts.select(*hashes, F.explode(units("text")).alias("unit"))
    alone = spread.groupBy("unit").agg(F.count(F.lit(1)).alias("c"), F.min("h").alias("h"), F.min("k").alias("k")).where("c = 1")
    counts = alone.groupBy("h", "k").agg(F.count(F.lit(1)).alias("private"))
    mapped = texts.select("node", *hashes, unit_map("text").alias("map"))
    return mapped.join(counts, ["h", "k"], "left").select("node", F.coalesce("private", F.lit(0)).alias("private"), "map")


def _first_band() -> Column:
    """The bucket's band is the first that the pair shares, so that a pair comes once and not once per band."""
    first = F.lit(BANDS)
    for i in reversed(range(BANDS)):
        first = F.when(F.get("a_bands", F.lit(i)) == F.get("b_bands", F.lit(i)), i).otherwise(first)
    return F.col("band") == first


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of pairs (a, b, ...) whose weighted shingle sets are similar enough, from a table of texts (node, text)."""
    columns = pairs.columns
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    left = pairs.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").withColumnRenamed("text", "text_a")
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, ["a", "salt"]).select(*columns, "text_a", "text_b")

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        at, units = None, None  # pairs come by a, whose units serve all its partners
        for xs, ys in batches:
            near = []
            for x, y in zip(xs, ys, strict=True):
                if x != at:
                    at, units = x, weighted_units(x)
                near.append(similarity(units, weighted_units(y)) >= THRESHOLD)
            yield pd.Series(near, dtype=bool)

    return joined.where(similar("text_a", "text_b")).select(*columns)


def _sides(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table of nodes as the a and as the b of pairs."""
    return tuple(profile.select(*[F.col(c).alias(side if c == "node" else f"{side}_{c}") for c in profile.columns]) for side in "ab")


def _mixed_buckets(rooted: DataFrame) -> DataFrame:
    """(band, bucket, main, largest, all) of the buckets whose members are in several components; main is the largest one."""
    per_root = rooted.groupBy("band", "bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = per_root.groupBy("band", "bucket").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("largest"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("roots"))
    return mixed.where("roots > 1").select("band", "bucket", "main", "largest", "all")


def _merges(found: DataFrame) -> DataFrame:
    """(old, new) roots after links between components, (a_root, b_root); only roots that are linked."""
    merged = components(found.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    return merged.select(F.col("node").alias("old"), F.col("root").alias("new"))


def _merged(rooted: DataFrame, merges: DataFrame) -> DataFrame:
    """Rows (node, root, ...) with their new roots; salted, as one component may hold most rows."""
    salted = merges.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    parted = rooted.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    joined = parted.join(salted, (F.col("root") == F.col("old")) & (parted["part"] == salted["part"]), "left")
    return joined.select(*[F.coalesce("new", "root").alias(c) if c == "root" else parted[c] for c in rooted.columns])


def near_duplicate_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text) rows to (node, first, n) per distinct text and (node, root) for texts with a near duplicate.

    Signatures of distinct texts meet in buckets, one per band. First every member of a bucket is held against its smallest
    member, which makes stars, not pairs, of a group of copies. In buckets with several components the units are counted that a text
    shares with no other of these texts: they bound the similarity of its pairs, as do bit maps of the units, which rules out most
    copies that have been changed too much. While many pairs across components are open, each turn holds the members outside a bucket's largest component
    against one that is inside, first the one with the smallest share of such units. Members that are then still in
    different components are held against each other, those outside the largest one against all, so no link between components is
    missed that the bands have found. Every accepted link is verified on the whole texts. Links found after the stars join components, not
    texts, so only roots meet again.
    """
    rows = rows.select("id", "text", F.unhex(F.md5(F.col("text"))).alias("node"))
    signed = table(rows.withColumn("s", signature(F.col("text"))).select("id", "node", "s.*"))
    nodes = table(signed.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("weight").alias("weight"), F.max("bands").alias("bands"), F.max("bytes").alias("bytes")))

    entries = nodes.where("weight > 0").select("node", "first", F.posexplode("bands").alias("band", "bucket"))
    crowded = entries.groupBy("band", "bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    salted = crowded.select("band", "bucket", "leader", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    entries = entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    entries = table(entries.join(salted, ["band", "bucket", "salt"]).select("band", "bucket", "salt", "node", "first", "leader"))

    a, b = _sides(nodes.select("node", "weight", "bytes"))
    stars = entries.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = table(stars.join(a, "a").join(b, "b").where(_plausible()).select("a", "b"))

    # the texts that a comparison may ask for: one row each, found by its id, so that a frequent text does not meet in one task
    wanted = entries.select(F.col("node").alias("n"), F.col("first").alias("i")).distinct()
    texts = rows.join(wanted, (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("i")))
    texts = table(texts.select("node", "text").dropDuplicates(["node"]))

    roots = components(table(_verified(stars, texts)))
    rooted = entries.join(roots, "node", "left").select("band", "bucket", "salt", "node", "leader", F.coalesce("root", "node").alias("root"))
    rooted = table(rooted)
    size = rooted.count()
    mixed_nodes = rooted.join(_mixed_buckets(rooted).select("band", "bucket"), ["band", "bucket"]).select("node").distinct()
    private = _private_units(texts.join(mixed_nodes, "node")).join(nodes.select("node", "weight", "bytes", "bands"), "node")
    able = table(private.where((F.col("weight") - F.col("private")) / F.col("weight") >= THRESHOLD))
    rooted = table(rooted.join(able.select("node", (F.col("private") / F.col("weight")).alias("lonely")), "node"))

    a, b = _sides(able)
    tried, last = None, False
    for turn in itertools.count():
        mixed = table(_mixed_buckets(rooted))
        inside = rooted.join(mixed.select("band", "bucket", "main"), ["band", "bucket"])
        open_pairs = mixed.agg(F.sum((F.col("all") - F.col("largest")) * F.col("all"))).first()[0] or 0
        if last or open_pairs <= WORK * size:
            break
        # a member of the largest component, another one each turn, against all that are outside
        chance = F.pmod(F.xxhash64(F.lit(turn + 1), "node"), F.lit(1000)) / 1000 * turn
        chosen = inside.where("root = main").groupBy("band", "bucket").agg(F.min_by("node", F.struct(F.col("lonely") + chance, "node")).alias("chosen"))
        chosen = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        near = inside.where("root <> main").join(chosen, ["band", "bucket", "salt"])
        near = near.select(F.col("chosen").alias("a"), F.col("node").alias("b"), F.col("main").alias("a_root"), F.col("root").alias("b_root")).distinct()
        near = table(near.join(a, "a").join(b, "b").where(_plausible() & _share_enough()).select("a", "b", "a_root", "b_root"))
        found = table(_verified(near, texts))
        last = found.count() <= LEAST_YIELD * near.count()  # also if no pair was left to compare
        both = near.select("a", "b").union(near.select("b", "a"))
        tried = both if tried is None else tried.union(both)
        if not found.isEmpty():
            merges = _merges(found)
            rooted = table(_merged(rooted, merges))
            roots = _grown(roots, merges)

    minor = inside.where("root <> main").join(b.withColumnRenamed("b", "node"), "node").select("band", "bucket", F.col("node").alias("b"), F.col("root").alias("b_root"), "b_weight", "b_bytes", "b_bands", "b_private", "b_map", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    every = inside.join(a.withColumnRenamed("a", "node"), "node").select("band", "bucket", "main", "leader", F.col("node").alias("a"), F.col("root").alias("a_root"), "a_weight", "a_bytes", "a_bands", "a_private", "a_map", "salt")
    # two minor members meet in both orders, and a bucket's leader has been held against all
    once = (F.col("a_root") == F.col("main")) | (F.col("a") < F.col("b"))
    new = (F.col("a_root") != F.col("b_root")) & once & (F.col("a") != F.col("leader")) & (F.col("b") != F.col("leader"))
    rest = every.join(minor, ["band", "bucket", "salt"]).where(new & _plausible() & _first_band() & _share_enough()).select("a", "b", "a_root", "b_root")
    rest = table(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"))
    more = table(_verified(rest, texts))
    if not more.isEmpty():
        roots = _grown(roots, _merges(more))
    return nodes.select("node", "first", "n"), roots


def _grown(roots: DataFrame, merges: DataFrame) -> DataFrame:
    """(node, root) after merges of roots; an old root that had no row was a text by itself."""
    known = roots.union(merges.select("old", "old")).distinct()
    return table(_merged(known, merges))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its class of near duplicates.

    ``row``, node (digest of the text), class_id (smallest id of the class), first (smallest id with this text), alone (no other
    row is in the class), head (this text holds class_id and the row's id is class_id).

    Classes are the connected components of links between texts whose weighted sets of five-word shingles have a Jaccard similarity
    of 0.8 or more; equal texts are in one class. Words are cut at ASCII white space; a text of fewer words is one shingle. Texts without
    words, null included, have no shingles: they link only if equal, null counting as the empty text. Null ids come last.
    """
    rows = wrap(docs).select("row", column(doc_id).alias("id"), F.coalesce(column(text), F.lit("")).alias("text"))
    nodes, roots = near_duplicate_texts(rows.select("id", "text"))
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = joined.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "node")).alias("head"), F.sum("n").alias("size"))
    # only texts that share a class with other rows need a partner; salted, as one text may be a large share of the rows
    shared = table(joined.join(classes, "root").where("size > 1").select("node", F.col("first"), F.col("head.first").alias("class_id"), (F.col("head.node") == F.col("node")).alias("is_head")))
    shared = shared.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.select("row", "id", F.unhex(F.md5(F.col("text"))).alias("node"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    rows = rows.join(shared, ["node", "salt"], "left")
    alone = F.col("is_head").isNull()
    return rows.select(
        "row",
        "id",
        "node",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("first")).alias("first"),
        alone.alias("alone"),
        (alone | (F.col("is_head") & F.col("id").eqNullSafe(F.col("class_id")))).alias("head"),
    )


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class: the smallest id, and of rows that repeat id and text one."""
    kept = near_duplicates(docs, doc_id, text).where("head")
    first = F.row_number().over(W.partitionBy("node", "id").orderBy(F.lit(0)))
    return kept.withColumn("turn", first).where("turn = 1").select("row.*")
