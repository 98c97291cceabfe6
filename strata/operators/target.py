"""Leakage-safe target encoding: statistics fitted on training rows only,
applied to any frame (train, validation, test, a stream)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.relational import lookup
from strata.operators.stats import statistics, value_bins
from strata.session import materialize


@dataclass
class TargetEncoding:
    """Fitted encoding: per-key table + global fallbacks (unseen keys)."""
    table: DataFrame           # key, <prefix>_mean, <prefix>_median
    key: str
    mean_col: str
    median_col: str
    global_mean: float | None
    global_median: float | None
    n_bytes: int | None = None  # measured bytes of ``table``


def target_encode_fit(train: DataFrame, key: str, y: str, prefix: str | None = None) -> TargetEncoding:
    """Mean and exact median of ``y`` per ``key`` on the given (training) rows,
    plus the global mean/median, from one set of value bins (written once).
    The per-key table is written too: it is small, reused by every apply, and
    its measured row count decides whether an apply may broadcast it."""
    prefix = prefix or f"{key}_target"
    mean_col, median_col = f"{prefix}_mean", f"{prefix}_median"
    bins, m = materialize(value_bins(train, [key], y, null_keys=True))
    table, tm = materialize(statistics(bins.filter(F.col(key).isNotNull()), [key], y, ("mean", "median"), (mean_col, median_col),
                                         n_bins=m["count"]))
    g = statistics(bins.groupBy(y).agg(F.sum("_n").alias("_n")), [], y, ("mean", "median"), ("m", "md"), n_bins=m["count"]).collect()[0]
    return TargetEncoding(table, key, mean_col, median_col, g["m"], g["md"], tm["bytes"])


def target_encode_apply(df: DataFrame, enc: TargetEncoding) -> DataFrame:
    """Left join the per-key statistics; unseen keys take the global values."""
    return lookup(df, enc.table, enc.key, defaults={enc.mean_col: enc.global_mean,
                                                    enc.median_col: enc.global_median}, n_bytes=enc.n_bytes)


# --- out-of-fold encoding


def fold_of(row_id: str, folds: int, seed: int = 42) -> Column:
    """A row's fold, 0 to ``folds`` - 1, by the hash of its id; null without an id."""
    h = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}:fold")).cast("binary"))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % folds).cast("int")


@dataclass
class FoldEncoding:
    """Per key and fold, the statistics of the key's rows in all *other* folds."""
    table: DataFrame  # key, fold, <prefix>_mean, <prefix>_median
    key: str
    folds: int
    seed: int
    mean_col: str
    median_col: str
    by_fold: dict[int, tuple[float | None, float | None]]  # of all rows outside the fold
    n_bytes: int


def target_encode_oof_fit(train: DataFrame, row_id: str, key: str, y: str, folds: int = 5, seed: int = 42, prefix: str | None = None) -> FoldEncoding:
    """Statistics of the complement of every fold, from one scan.

    Bins ``(key, fold, value) -> count`` are written once. A complement's mean is the
    key's sum less its fold's; its exact median is selected in the merged histogram
    of the other folds (bins, never rows, are repeated per fold, and a key with very
    many values is refined as anywhere else). A key of one fold only has no
    statistics there. Rows without an id, a key or a target are left out."""
    if folds < 2:
        raise ValueError("out-of-fold encoding needs at least two folds")
    prefix = prefix or f"{key}_target"
    mean_col, median_col = f"{prefix}_mean", f"{prefix}_median"
    rows = train.select(F.col(key), F.col(y).cast("double").alias("_y"), fold_of(row_id, folds, seed).alias("fold")).filter(F.col("fold").isNotNull() & F.col(key).isNotNull())
    bins, m = materialize(value_bins(rows, [key, "fold"], "_y"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    # a sum per key and fold, subtracted from the key's
    sums = bins.groupBy(key, "fold").agg(F.sum(F.col("_y") * F.col("_n")).alias("s"), F.sum("_n").alias("n"))
    merged = bins.select(key, F.explode(others).alias("fold"), "_y", "_n").groupBy(key, "fold", "_y").agg(F.sum("_n").alias("_n"))
    medians = statistics(merged, [key, "fold"], "_y", ("median",), (median_col,), n_bins=folds * m["count"])
    whole = sums.groupBy(key).agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    left = whole.select(key, "s_all", "n_all", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")).join(sums, [key, "fold"], "left")
    means = left.withColumn("n_out", F.col("n_all") - F.coalesce("n", F.lit(0))).filter("n_out > 0").select(
        key, "fold", ((F.col("s_all") - F.coalesce("s", F.lit(0.0))) / F.col("n_out")).alias(mean_col))
    table, tm = materialize(means.join(medians, [key, "fold"], "left"))
    outside = bins.select(F.explode(others).alias("fold"), "_y", "_n").groupBy("fold", "_y").agg(F.sum("_n").alias("_n"))
    g = statistics(outside, ["fold"], "_y", ("mean", "median"), ("m", "md"), n_bins=folds * m["count"]).collect()  # a row per fold
    return FoldEncoding(table, key, folds, seed, mean_col, median_col, {r["fold"]: (r["m"], r["md"]) for r in g}, tm["bytes"])


def target_encode_oof_apply(df: DataFrame, enc: FoldEncoding, row_id: str) -> DataFrame:
    """Each row takes the statistics of the other folds' rows of its key, so never its
    own target; a key unseen there takes those of all rows of the other folds.
    Adds ``fold`` too."""
    out = lookup(df.withColumn("fold", fold_of(row_id, enc.folds, enc.seed)), enc.table, [enc.key, "fold"], n_bytes=enc.n_bytes)
    for k, c in enumerate((enc.mean_col, enc.median_col)):
        default = F.lit(None).cast("double")
        for fold, values in sorted(enc.by_fold.items()):
            default = F.when(F.col("fold") == fold, F.lit(values[k]).cast("double")).otherwise(default)
        out = out.withColumn(c, F.coalesce(F.col(c), default))
    return out
