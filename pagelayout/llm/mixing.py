"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from pagelayout.llm.common import column, cut, row_hash, small, wrap

WORD = r"[^\x20\x09-\x0D]+"
# Largest table of sources that is broadcast; beyond it the join shuffles.
MOST_SOURCES = 10_000
# An odd prime: b -> b * PRIME mod k is one-to-one for every k it does not divide.
PRIME = 2_654_435_761


def word_count(text: str = "text") -> Column:
    """Words of a text, cut at ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, source_size) with rank, weight and target.

    Sources by code point, null last, take the weights in turn. Targets share the sum of all sizes by weight; none exceeds
    ``cap`` times its source, and the excess goes to the others by weight until none is above. That is
    ``min(cap * size, level * weight)``, and the level is the largest of those at which the k sources with the least
    room per weight are full.
    """
    rank = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))).cast("int")
    given = F.array(*[F.lit(w) for w in weights])
    room = (F.lit(cap) * F.col("source_size")).cast("double")
    s = sizes.withColumn("rank", rank).withColumn("weight", F.get(given, F.pmod(F.col("rank") - 1, F.lit(len(weights)))).cast("double")).withColumn("room", room)
    by_room = W.orderBy(F.col("room") / F.col("weight"), "rank")
    full = F.coalesce(F.sum("room").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(by_room.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    s = s.withColumn("level", (total - full) / open_).withColumn("level", F.max("level").over(W.partitionBy()))
    return s.select("source", "source_size", "rank", "weight", F.least("room", F.col("level") * F.col("weight")).alias("target"), total.alias("total"))


def _upto(first: Column, last: Column, step: int) -> Column:
    going = (first <= last) if step > 0 else (first >= last)
    return F.when(going, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(whole: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The number of marked ones among ``drawn`` out of ``whole``, for a uniform ``u`` in (0, 1).

    Inverts the distribution function. Probabilities come as ratios of neighbours outward from the mode and are kept for
    twelve standard deviations; what lies beyond is below the resolution of a double.
    """
    n, k, m = (c.cast("double") for c in (whole, marked, drawn))
    low, high = F.greatest(F.lit(0), drawn + marked - whole).cast("long"), F.least(marked, drawn).cast("long")
    mode = F.least(F.greatest(F.floor((m + 1) * (k + 1) / (n + 2)), low), high).cast("long")
    share = k / F.greatest(n, F.lit(1.0))
    reach = F.ceil(12 * F.sqrt(F.greatest(m * share * (1 - share), F.lit(0.0))) + 12).cast("long")
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)
    up = F.aggregate(
        _upto(mode, last - 1, 1),
        F.array(F.lit(1.0)),
        lambda p, x: F.concat(p, F.array(F.element_at(p, -1) * (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1)))),
    )
    down = F.aggregate(
        _upto(mode, first + 1, -1),
        F.array(F.lit(1.0)),
        lambda p, x: F.concat(p, F.array(F.element_at(p, -1) * x * (n - k - m + x) / ((k - x + 1) * (m - x + 1)))),
    )
    weights = F.concat(F.reverse(F.slice(down, 2, F.size(down))), up)
    mass = F.aggregate(weights, F.lit(0.0), lambda a, p: a + p)
    passed = F.aggregate(
        weights,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((a["sum"] + p).alias("sum"), F.when(a["sum"] + p < u * mass, a["n"] + 1).otherwise(a["n"]).alias("n")),
        lambda a: a["n"],
    )
    return F.when(high <= low, low).otherwise(F.least(first + passed, last))


def _uniform(*parts: Column) -> Column:
    return ((F.shiftrightunsigned(F.xxhash64(*parts), 11)).cast("double") + 0.5) / F.lit(2.0**53)


def split_quotas(targets: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, blocks) of all sources to (rank, shard, blocks): which shard takes how many blocks of which source.

    The root holds every source's block quota. A node with several shards sends to its left half as many blocks as these
    shards hold, drawn without replacement from the node's blocks: one hypergeometric draw per source, each from what the
    earlier sources left. Sums are exact at every node. Nodes of a level are rows; the tree has log2(shards) levels.
    """
    root = targets.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "blocks"))), lambda x: x["blocks"]).alias("own")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "own", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x).alias("all")
    )

    def held(shard: Column) -> Column:
        return F.floor(shard.cast("long") * F.col("all") / shards).cast("long")

    nodes = root
    for _ in range((shards - 1).bit_length()):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        nodes = nodes.withColumn("mid", mid).withColumn("room", held(F.col("mid")) - held(F.col("lo")))

        def draw(s: Column, x: Column) -> Column:
            got = hypergeometric(s["left"], x, s["room"], _uniform(F.lit(seed), F.col("lo"), F.col("hi"), F.size(s["out"])))
            return F.struct((s["left"] - x).alias("left"), (s["room"] - got).alias("room"), F.concat(s["out"], F.array(got)).alias("out"))

        start = F.struct(F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x).alias("left"), F.col("room").alias("room"), F.array().cast("array<bigint>").alias("out"))
        drawn = F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("own", start, draw, lambda s: s["out"]))
        nodes = nodes.withColumn("taken", drawn)
        left = F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("taken").alias("own"))
        right = F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.zip_with("own", "taken", lambda a, b: a - b).alias("own"))
        leaf = F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("own").alias("own"))
        nodes = nodes.select("all", F.explode(F.when(F.col("taken").isNull(), F.array(leaf)).otherwise(F.array(left, right))).alias("n")).select("n.*", "all")
    return nodes.select(F.col("lo").alias("shard"), F.posexplode("own")).select((F.col("pos") + 1).alias("rank"), "shard", F.col("col").alias("blocks"))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, shards: int = 16, blocks_per_shard: int = 64, seed: int = 17, buckets: int = 4096, source: str = "source", size: Column | None = None
) -> DataFrame:
    """Every row with its part in a mix whose sources come near their target sizes.

    A source's rows are put in a random order by hash; the line of its words, repeated up to ``cap`` times, is cut at
    its target and into blocks of equal length. ``split_quotas`` says how many blocks of each source a shard holds; the
    blocks of a source, permuted, go to the shards in disjoint stretches. Within a shard, rows are ordered by another hash.

    ``row``, size, source_size, target, taken (words taken, repeats counted), copies array<struct<pass, block, shard, key>>:
    one entry for each time the row is taken, at most ``cap``; ``key`` is its place in the shard's local shuffle.

    A row is taken where its middle falls before the target, so a source misses its target by half a row at most. The
    running sum over a source is cut by hash into ``buckets`` parts, so a source that holds most rows spreads over as many
    tasks. The result depends on the rows and the seed only; identical rows are interchangeable. Null sources are one source,
    the last. Rows without words are in no copy; no rows give no rows.
    """
    rows = wrap(docs)
    rows = rows.select("row", column(source).alias("source"), (word_count() if size is None else size).alias("size"), row_hash(rows, seed).alias("h"))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)).cast("int"))

    parts = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    block = F.greatest(F.ceil(F.col("total") / (shards * blocks_per_shard)), F.lit(1)).cast("long")
    passes = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(cap)).cast("int")
    targets = targets.withColumn("block", block).withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    targets = cut(targets.withColumn("blocks", F.ceil(F.col("target") / F.col("block")).cast("long")))
    up_to = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    ends = split_quotas(targets, shards, seed).withColumn("end", F.sum("blocks").over(up_to))
    ends = ends.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    targets = cut(targets.join(ends, "rank"))

    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
    # the salt is part of the key, so a large source is many groups
    placed = rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = W.partitionBy("source", "bucket").orderBy("h", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))

    quotas = small(targets.select(F.col("source").alias("s"), "source_size", "rank", "target", "block", "blocks", "passes", "rest", "ends"), MOST_SOURCES)
    placed = placed.join(quotas, F.col("source").eqNullSafe(F.col("s")))
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + F.when(F.col("passes") >= cap, 0).when(F.col("start") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0))
    placed = placed.withColumn("times", times.cast("int"))

    def copy(i: Column) -> Column:
        at = F.least(F.floor((i.cast("long") * F.col("source_size") + F.col("start")) / F.col("block")).cast("long"), F.col("blocks") - 1)
        permuted = F.pmod(at * F.lit(PRIME) + F.xxhash64(F.lit(seed), F.col("rank")) % 1_000_003, F.col("blocks"))
        shard = F.size(F.filter("ends", lambda e: e <= permuted))
        return F.struct(i.alias("pass"), at.alias("block"), shard.cast("int").alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("h"), i).alias("key"))

    copies = F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0), F.col("times") - 1), copy)).otherwise(F.filter(F.array(copy(F.lit(0))), lambda _: F.lit(False)))
    return placed.select("row", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with shard and key, its shards in turn and shuffled locally."""
    taken = mix_sources(docs, shards=shards, **options).select("row", F.explode("copies").alias("copy"))
    rows = taken.select("row", F.col("copy.shard").alias("shard"), F.col("copy.key").alias("key"))
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key")
