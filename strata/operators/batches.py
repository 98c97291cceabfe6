"""Epoch shuffles with exact batch sizes.

Each epoch orders the rows by ``md5("<row_id>:<seed>:<epoch>")``: a keyed permutation
that needs no state and is the same under any partitioning. Places come from a
two-level prefix count: rows per hash prefix (a bounded histogram), and a rank
inside each prefix. The table is never ranked in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash that make a prefix: 65,536 of them.
PREFIX = 4


def epoch_hash(row_id: str, seed: int, epoch: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(row_id).cast("string"), F.lit("")), F.lit(f":{seed}:{epoch}")).cast("binary"))


def epoch_batches(df: DataFrame, row_id: str, batch_rows: int, seed: int = 42, epoch: int = 1, out: str = "batch") -> DataFrame:
    """Adds ``out``: the row's batch (from 0) in the epoch's order. All batches
    have exactly ``batch_rows`` rows but the last. Rows of one id lie together;
    their order among themselves is open, the sizes are not."""
    if batch_rows < 1:
        raise ValueError("batch_rows must be at least 1")
    h = epoch_hash(row_id, seed, epoch)
    prefix = F.substring("_h", 1, PREFIX)
    hist = df.select(F.substring(h, 1, PREFIX).alias("_p")).groupBy("_p").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over at most 65,536 rows
    before = hist.select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_h", row_id))
    ranked = df.withColumn("_h", h).withColumn("_p", prefix).withColumn("_r", rank).join(F.broadcast(before), "_p")
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], F.floor((F.col("_before") + F.col("_r") - 1) / batch_rows).alias(out))
