"""Exact, reproducible train/validation split.

Each row gets ``h = md5("<row_id>:<seed>")``; the validation set is exactly the
``ceil(frac * n)`` rows with the smallest ``h``. The cut-off hash is found
without sorting the table: count rows per 4-hex-digit prefix (65,536 buckets,
a bounded histogram), locate the bucket holding the boundary rank, repeat
with the next 4 digits inside it, and rank only the few rows of the final
sub-bucket. The split is then the predicate ``h <= cutoff`` — independent of
partitioning and recomputation (unlike ``randomSplit``), and identical to
``row_number() over (order by md5(...))`` in SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_hash(row_id: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))


def split_cutoff(df: DataFrame, row_id: str, frac: float = 0.2, seed: int = 42,
                 direct_rows: int = 1_000_000) -> str | None:
    """The largest hash inside the validation set (``None`` if it is empty).

    Reads only the row-id column. Each level is one small job over a bounded
    histogram of the next four digits; levels go on until the boundary bucket
    holds at most ``direct_rows`` rows (or the hash ends), which are then ranked
    directly (a top-k). Row ids must be there and unique: a null one, or a repeated
    one at the cut-off (where it would change the size), is an error."""
    hashed = df.select(split_hash(row_id, seed).alias("_h"))
    prefix, need, n_bucket = "", None, None
    while n_bucket is None or (n_bucket > direct_rows and len(prefix) < 32):
        depth = len(prefix) + 4  # 65,536 buckets per level
        sub = hashed.filter(F.col("_h").startswith(prefix)) if prefix else hashed
        hist = sub.groupBy(F.substring("_h", 1, depth).alias("_p")).count().collect()
        if any(r["_p"] is None for r in hist):
            raise ValueError(f"split: {row_id} holds nulls; a row without an id belongs to no side")
        hist.sort(key=lambda r: r["_p"])  # at most 65,536 rows
        if need is None:
            need = math.ceil(frac * sum(r["count"] for r in hist))
            if need == 0:
                return None
        for row in hist:
            if need <= row["count"]:
                prefix, n_bucket = row["_p"], row["count"]
                break
            need -= row["count"]
    if len(prefix) == 32:
        if n_bucket > 1:
            raise ValueError(f"split: {row_id} repeats at the cut-off, so no exact split exists")
        return prefix
    at_cut = hashed.filter(F.col("_h").startswith(prefix)).orderBy("_h").limit(need + 1).orderBy(F.desc("_h")).limit(2).collect()
    if n_bucket == need:  # the bucket ends here
        return at_cut[0]["_h"]
    if at_cut[0]["_h"] == at_cut[1]["_h"]:
        raise ValueError(f"split: {row_id} repeats at the cut-off, so no exact split exists")
    return at_cut[1]["_h"]


def split_flag(row_id: str, cutoff: str | None, seed: int = 42) -> Column:
    """The split as a row predicate: no join is needed to apply it."""
    return F.lit(False) if cutoff is None else (split_hash(row_id, seed) <= F.lit(cutoff))


def split_exact(df: DataFrame, row_id: str = "row_id", frac: float = 0.2, seed: int = 42,
                out: str = "is_val") -> DataFrame:
    """Adds boolean ``out``: True for the validation rows (row ids must be unique)."""
    return df.withColumn(out, split_flag(row_id, split_cutoff(df, row_id, frac, seed), seed))
