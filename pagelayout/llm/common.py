"""Helpers shared by the operators of this subpackage.

Operators wrap the input row as one struct column ``row`` and put their results beside it, so no input column can
clash with a result column, whatever it is called.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelayout.operators.scans import cut, shared_dir

__all__ = ["column", "cut", "drop_table", "load", "ordered_chunk", "partitions", "quantile_bounds", "row_hash", "shared_dir", "small", "table", "wrap"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the cluster sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wrap(df: DataFrame) -> DataFrame:
    """The whole input row as one column ``row``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def column(name: str) -> Column:
    """A field of the wrapped row."""
    return F.col("row").getField(name)


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """64-bit hash of the wrapped row; fields that cannot be hashed (maps, variants) are left out."""

    def hashable(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return all(hashable(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return hashable(kind.elementType)
        return not isinstance(kind, (T.MapType, T.VariantType))

    fields = [f.name for f in df.schema["row"].dataType.fields if hashable(f.dataType)]
    return F.xxhash64(F.lit(seed), *[column(c) for c in fields])


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """Marked for broadcast if a count shows at most ``most_rows`` rows; otherwise left to a shuffle join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def quantile_bounds(df: DataFrame, key: Column, chunks: int) -> list:
    """``chunks - 1`` values of ``key`` that cut its rows in about equal parts; sorted, with repeats where a value is frequent.

    One mergeable sketch per task reaches the driver's side, of a size fixed by ``chunks``; which values it gives has no
    influence on any result, only on how evenly tasks are filled.
    """
    if chunks < 2:
        return []
    parts = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
    found = df.agg(F.percentile_approx(key, parts, F.lit(100 * chunks)).alias("b")).first()["b"]
    return sorted(found) if found else []


def _rank(key: Column, bounds: Sequence, *, strict: bool) -> Column:
    """How many bounds lie below ``key`` (``strict``), or at it and below: a binary search."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b) for b in bounds])
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        here = F.get(array, mid)
        below = (here < key) if strict else (here <= key)
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(steps, start, step, lambda s: s["lo"])


def ordered_chunk(key: Column, tie: Column, bounds: Sequence) -> Column:
    """Chunk of a row in the order (key, tie), null keys last; a frequent key spreads over several chunks by its 64-bit tie."""
    low, high = _rank(key, bounds, strict=True), _rank(key, bounds, strict=False)
    share = (F.shiftrightunsigned(tie, 1) / F.lit(2.0**63)).cast("double")  # follows the unsigned order of tie
    return F.when(key.isNull(), F.lit(len(bounds) + 1)).otherwise(low + F.floor(share * (high - low + 1))).cast("int")


def table(df: DataFrame) -> DataFrame:
    """A wide intermediate, written as compressed Parquet to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``table`` that nothing reads any more."""
    spark = df.sparkSession
    for file in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
