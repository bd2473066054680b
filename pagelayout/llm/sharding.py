"""Contiguous shards of equal bytes, cut on global prefix sums of the sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from pagelayout.llm.common import column, cut, ordered_chunk, partitions, quantile_bounds, row_hash, wrap

CHUNKS_PER_TASK = 4


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text plus one; a null text has none."""
    return F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("long") + 1


def balanced_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """Rows in the order of ``key`` cut into ``shards`` contiguous shards of about equal size.

    The order is cut into chunks by quantiles of the key. Each chunk's total size comes from one grouped aggregation with
    partial sums per partition; the running sum over these totals tells where a chunk begins in the whole, and a window
    inside the chunk adds the rest. A row belongs to the shard in which its middle byte falls, so a shard differs from
    an equal share by less than its largest rows.

    ``row`` (the input row), size long, shard int, slot long: gapless from 0 within a shard.

    Order: key ascending, null keys last; rows of one key by a hash of the whole row; identical rows are interchangeable.
    A key that many rows share spreads over several chunks. Shards that get no bytes stay empty; no rows give no rows.
    A row larger than a share takes a shard for itself. Sizes are not negative; if all are 0, shard 0 takes all.
    """
    rows = wrap(docs)
    rows = rows.select("row", column(key).alias("k"), row_hash(rows).alias("tie"), (text_bytes() if size is None else size).alias("size"))
    bounds = quantile_bounds(rows, F.col("k"), CHUNKS_PER_TASK * partitions(docs.sparkSession))
    rows = rows.withColumn("chunk", ordered_chunk(F.col("k"), F.col("tie"), bounds))

    totals = rows.groupBy("chunk").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    earlier, whole = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    offsets = cut(
        totals.select(
            "chunk",
            F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(whole).alias("all_bytes"),
        )
    )  # one row per chunk, at most CHUNKS_PER_TASK times the number of tasks

    # unsigned order of the tie, as ordered_chunk has it
    inside = W.partitionBy("chunk").orderBy(F.asc_nulls_last("k"), F.col("tie") < 0, "tie", "size")

    def placed(part: DataFrame) -> DataFrame:
        part = part.join(F.broadcast(offsets), "chunk")
        end = F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) + F.col("bytes_before")
        part = part.withColumn("end", end).withColumn("at", F.row_number().over(inside) - 1 + F.col("rows_before"))
        middle = F.expr(f"(2 * end - size) * {shards} div greatest(2 * all_bytes, 1)")
        return part.withColumn("shard", F.least(middle, F.lit(shards - 1)).cast("int"))

    starts = placed(rows.drop("row")).groupBy("shard").agg(F.min("at").alias("start"))  # one row per shard
    return placed(rows).join(F.broadcast(starts), "shard").select("row", "size", "shard", (F.col("at") - F.col("start")).alias("slot"))
