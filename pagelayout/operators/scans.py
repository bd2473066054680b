"""Ordered scans for keys of every size.

A plain window sorts all rows of a key in one task.  Here a key that holds more than a task's fair share of the rows is
cut in *ranges* of its order at splitters from a sample, so that a range never holds much more than a fair share,
whatever the order's values are; all other keys are one range.  A local window runs per range, and one summary row per range
is scanned per key and joined back, so only the summaries of a key ever meet in one task.

The sample (the rows with the smallest hashes, a number fixed by the number of tasks) is taken before the plan is made: each scan
refers to its rows twice, for the rows and for their summaries, which would double a lazy plan with every further scan. So a
frame with large keys is written between scans, and one without is left with plain windows. What is large follows the share of
a key, never its number of rows.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

SAMPLES_PER_TASK = 64  # rows of the sample per task of a shuffle
RANGE_SAMPLES = 16  # of them to a range; a key is cut if it has those of a whole task
MOST_SAMPLES = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in spark.checkpoint.dir.

    Only where that is unset (tests, a laptop) a temporary folder is chosen.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = _LOCAL_DIRS.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="pagelayout-")
        _LOCAL_DIRS[spark.sparkContext.applicationId] = named
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(named, "cut"))
    return named


_LOCAL_DIRS: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate that is read more than once, so it is computed once and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, where all ``keys`` are the same; null is the same as null."""
    other = right.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__same_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"__same_{k}" for k in keys])


# ---------------------------------------------------------------- ranges of large keys


def _key(keys: Sequence[str]) -> Column:
    """All keys in one struct, which is never null itself, so null keys meet like any others."""
    return F.struct(*keys)


def large_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame | None:
    """(__key, __cuts): keys that hold more than a task's fair share of the rows, with places along ``order`` that cut them; None if there are none.

    At most as many rows as the sample has.
    """
    spark = df.sparkSession
    size = min(SAMPLES_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_SAMPLES)
    place = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    rows = df.select(_key(keys).alias("__key"), place.alias("__place"), F.xxhash64(*keys, *order).alias("__hash"))
    sample = rows.orderBy("__hash", "__key", "__place").limit(size)
    cuts = sample.groupBy("__key").agg(F.array_sort(F.collect_list("__place")).alias("__cuts"))
    picked = F.filter("__cuts", lambda c, i: i % RANGE_SAMPLES == RANGE_SAMPLES - 1)
    cuts = cuts.filter(F.size("__cuts") >= SAMPLES_PER_TASK).select("__key", picked.alias("__cuts"))
    found = cuts.collect()
    return spark.createDataFrame(found, cuts.schema) if found else None


def _rank(cuts: str, place: Column, first_only: bool) -> Column:
    """How many cuts lie at or below ``place``: a binary search."""

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        at = F.get(F.col(cuts), middle)
        below = F.coalesce((at["o0"] if first_only else at) <= place, F.lit(True))
        more = s["lo"] < s["hi"]
        return F.struct(F.when(more & below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(more & ~below, middle).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_SAMPLES.bit_length())), start, step, lambda s: s["lo"])


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], large: DataFrame | None, at: Column | None = None) -> DataFrame:
    """Add ``__key`` and ``__block``, the range of a row, if there are large keys; scans of the result keep both columns.

    ``at``: a value to be compared with the first order column of the cuts, never falling along the order of the scans that follow.
    """
    if large is None:
        return df
    if at is None:
        place, first_only = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)]), False
    else:
        place, first_only = at, True
    d = df.withColumn("__key", _key(keys)).join(F.broadcast(large), "__key", "left")
    block = F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(_rank("__cuts", place, first_only))
    return d.withColumn("__block", block).drop("__cuts")


def unranged(df: DataFrame) -> DataFrame:
    return df.drop("__key", "__block")


def _of_large(d: DataFrame, large: DataFrame) -> DataFrame:
    return d.join(F.broadcast(large.select("__key")), "__key", "left_semi")


# ---------------------------------------------------------------- scans

SAMPLE = "sample"  # large keys are yet to be found


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    large: DataFrame | str | None = SAMPLE,
    sums: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
    suffix_mins: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add ordered columns to ``df``; if it is the result of ``ranged``, with the same ``large``.

    ``order`` must be total within a key; null keys are one key.

    sums         sum over the earlier rows (0 for the first)
    maxs         maximum over the earlier rows (null for the first)
    suffix_mins  minimum over this and all later rows
    lags, leads  value of the neighbouring row
    lasts        last non-null value over the earlier rows and this one
    number       0-based position
    """
    if isinstance(large, str):
        large = large_keys(df, keys, order)
    own = "__block" not in df.columns
    bk = list(keys) if large is None else ["__key", "__block"]
    d = df if large is None else cut(ranged(df, keys, order, large) if own else df)

    sums = dict(sums or {})
    if number:
        sums[number] = F.lit(1).cast("long")
    pos = F.struct(*order)
    local = W.partitionBy(*bk).orderBy(*[F.col(o).asc() for o in order])
    back = W.partitionBy(*bk).orderBy(*[F.col(o).desc() for o in order]).rowsBetween(W.unboundedPreceding, 0)
    before = local.rowsBetween(W.unboundedPreceding, -1)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    kw = W.partitionBy("__key").orderBy("__block")
    kbefore = kw.rowsBetween(W.unboundedPreceding, -1)
    kafter = kw.rowsBetween(1, W.unboundedFollowing)

    # per column: value within the range, summary of a range, what the other ranges add, both together
    parts: dict[str, tuple[Column, Column, object, object]] = {}
    for name, c in sums.items():
        parts[name] = (F.sum(c).over(before), F.sum(c), lambda a: F.sum(a).over(kbefore), lambda own_, other: F.coalesce(other, F.lit(0)) + F.coalesce(own_, F.lit(0)))
    for name, c in (maxs or {}).items():
        parts[name] = (F.max(c).over(before), F.max(c), lambda a: F.max(a).over(kbefore), lambda own_, other: F.greatest(other, own_))
    for name, c in (suffix_mins or {}).items():
        parts[name] = (F.min(c).over(back), F.min(c), lambda a: F.min(a).over(kafter), lambda own_, other: F.least(other, own_))
    for name, c in (lags or {}).items():
        held = F.struct(c.alias("v"))
        parts[name] = (F.lag(held).over(local), F.max_by(held, pos), lambda a: F.lag(a).over(kw), lambda own_, other: F.coalesce(own_, other)["v"])
    for name, c in (leads or {}).items():
        held = F.struct(c.alias("v"))
        parts[name] = (F.lead(held).over(local), F.min_by(held, pos), lambda a: F.lead(a).over(kw), lambda own_, other: F.coalesce(own_, other)["v"])
    for name, c in (lasts or {}).items():
        parts[name] = (F.last(c, ignorenulls=True).over(upto), F.max_by(c, F.when(c.isNotNull(), pos)), lambda a: F.last(a, ignorenulls=True).over(kbefore), lambda own_, other: F.coalesce(own_, other))

    names = [c for c in (df.columns if own else d.columns) if c not in parts]
    scanned = d.select("*", *[p[0].alias(f"__s_{n}") for n, p in parts.items()])
    if large is None:
        return scanned.select(*names, *[p[3](F.col(f"__s_{n}"), F.lit(None)).alias(n) for n, p in parts.items()])
    totals = _of_large(d, large).groupBy(*bk).agg(*[p[1].alias(f"__a_{n}") for n, p in parts.items()])
    totals = totals.select(*bk, *[p[2](F.col(f"__a_{n}")).alias(f"__c_{n}") for n, p in parts.items()])
    out = scanned.join(totals, bk, "left")
    return out.select(*names, *[p[3](F.col(f"__s_{n}"), F.col(f"__c_{n}")).alias(n) for n, p in parts.items()])


_MERGE = {"min": F.min, "max": F.max, "sum": F.sum, "or": F.bit_or}


def group_stats(d: DataFrame, keys: Sequence[str], group: Sequence[str], stats: Mapping[str, tuple[str, Column]], large: DataFrame | None) -> DataFrame:
    """Add aggregates (``min``, ``max``, ``sum`` or bitwise ``or`` of a column) of a row's group to the result of ``ranged``.

    Groups lie within a key and are contiguous in its order; without group columns the key is the group. Only groups that go over a range's
    border meet again, as one row per range.
    """
    if large is None:
        w = W.partitionBy(*keys, *group)
        return d.select("*", *[_MERGE[k](c).over(w).alias(n) for n, (k, c) in stats.items()])
    d = cut(d)
    bk = ["__key", "__block"]
    w = W.partitionBy(*bk, *group)
    name = F.struct(*group) if group else F.lit(0)
    partial = _of_large(d, large).groupBy(*bk, *group).agg(*[_MERGE[k](c).alias(n) for n, (k, c) in stats.items()])
    wide = partial.groupBy("__key", *group).agg(*[_MERGE[k](n).alias(n) for n, (k, _) in stats.items()], F.collect_list("__block").alias("__blocks"))
    wide = wide.filter(F.size("__blocks") > 1).select("__key", F.explode("__blocks").alias("__block"), F.struct(name.alias("k"), F.struct(*stats).alias("v")).alias("__e"))
    wide = wide.groupBy(*bk).agg(F.map_from_entries(F.collect_list("__e")).alias("__wide"))
    out = d.select("*", *[_MERGE[k](c).over(w).alias(f"__l_{n}") for n, (k, c) in stats.items()]).join(wide, bk, "left")
    found = F.try_element_at("__wide", name)
    return out.select(*d.columns, *[F.when(found.isNull(), F.col(f"__l_{n}")).otherwise(found[n]).alias(n) for n in stats])


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, tie: Sequence[str], salts: int = 64) -> DataFrame:
    """The first ``n`` rows per key, in two steps so a hot key is first cut down per salt."""
    by = [*order, *[F.col(t) for t in tie]]
    salt = F.pmod(F.xxhash64(*tie), F.lit(salts))
    first = (
        df.withColumn("__salt", salt)
        .withColumn("__rn", F.row_number().over(W.partitionBy(*keys, "__salt").orderBy(*by)))
        .filter(F.col("__rn") <= n)
    )
    return (
        first.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*by)))
        .filter(F.col("__rn") <= n)
        .drop("__salt", "__rn")
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = False) -> DataFrame:
    """One row per key: the first (or last) along ``order``; map-side combined, so no key is gathered."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if descending else F.min_by
    one = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return one.select(*[F.col(k) if k in keys else F.col("__row")[k].alias(k) for k in df.columns])


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value counts per key with the rank range of each value: ``lo`` (0-based) .. ``hi`` (exclusive)."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    scanned = ordered_scan(counts, keys, [value], sums={"lo": F.col("n")})
    return scanned.withColumn("hi", F.col("lo") + F.col("n"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Interpolated percentiles per key without gathering a key's values."""
    dist = distribution(df, keys, value)
    total = dist.groupBy(*keys).agg(F.max("hi").alias("__n"))
    d = join_same(dist, total, list(keys))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col(value)))

    aggs = []
    for name, p in points.items():
        rank = (F.col("__n") - 1) * F.lit(float(p))
        aggs += [at(F.floor(rank)).alias(f"__lo_{name}"), at(F.ceil(rank)).alias(f"__hi_{name}")]
    out = d.groupBy(*keys, "__n").agg(*aggs)
    cols = []
    for name, p in points.items():
        rank = (F.col("__n") - 1) * F.lit(float(p))
        frac = rank - F.floor(rank)
        cols.append((F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * frac).alias(name))
    return out.select(*keys, *cols)
