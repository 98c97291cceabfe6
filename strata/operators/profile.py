"""Profiling aggregates: one aggregation pass each, results as small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.stats import present, quantiles, statistics, value_bins
from strata.session import cut_lineage, materialize


def _stack(df: DataFrame, cols: Sequence[str], fields: Sequence[str], prefix: str = "") -> DataFrame:
    """Unpivot ``<prefix><col>__<field>`` columns of a one-row frame into one row per column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"),
                              *[F.col(f"{prefix}{c}__{f}").alias(f) for f in fields]) for c in cols])
    return df.select(F.inline(rows))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each non-null value (sort by ``count desc, value`` when shown)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_null, n_rows)`` for every column, from one aggregation; NaN
    counts as null."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(~present(df, c)).alias(f"{c}__n_null") for c in cols])
    one = one.select("*", *[F.col("_rows").alias(f"{c}__n_rows") for c in cols])
    return _stack(one, cols, ["n_null", "n_rows"])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def n_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact distinct counts (nulls not counted)."""
    return df.agg(*[F.count_distinct(c).alias(f"n_distinct_{c}") for c in cols])


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.min(c).cast("double").alias(f"{c}__min") for c in cols],
                 *[F.max(c).cast("double").alias(f"{c}__max") for c in cols])
    return _stack(one, cols, ["min", "max"])


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (exact, linear), max per column.

    One scan: the columns are unpivoted to ``(column, value)`` and binned
    (map-side combined). Moments follow from the bins (deviations from the mean,
    so nothing cancels), quartiles from one grouped exact-quantile aggregation — a value
    map per column within the map bound, one rank search for all quartiles beyond it
    (no column's values are ever gathered into one unbounded task buffer). NaN counts
    as null; a column without values has count 0 and nulls."""
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    bins, m = materialize(value_bins(df.select(F.inline(names)), ["column"], "value"))  # total bins bound every group
    v, n = F.col("value"), F.col("_n")
    first = bins.groupBy("column").agg(F.sum(n).alias("count"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    first = cut_lineage(first)  # a row per column
    spread = bins.join(F.broadcast(first.select("column", "mean", "count")), "column").groupBy("column", "count").agg(F.sum(n * (v - F.col("mean")) ** 2).alias("ss"))
    std = spread.select("column", F.when(F.col("count") > 1, F.sqrt(F.col("ss") / (F.col("count") - 1))).alias("std"))
    q = quantiles(bins, ["column"], "value", (0.25, 0.5, 0.75), ["p25", "p50", "p75"], bins_bound=m["count"])
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    return (every.join(first, "column", "left").join(std, "column", "left").join(q, "column", "left")
            .select("column", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max"))


def col_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.sum(c).cast("long").alias(c) for c in cols])


def shape_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, and the table's row count."""
    n = df.count()
    rows = [(i, f.name, f.dataType.simpleString(), n) for i, f in enumerate(df.schema.fields)]
    schema = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("column", T.StringType()),
                           T.StructField("dtype", T.StringType()), T.StructField("n_rows", T.LongType())])
    return df.sparkSession.createDataFrame(rows, schema)


def global_stats(df: DataFrame, col: str, stats: Sequence[str] = ("mean", "median"),
                 names: Sequence[str] | None = None) -> DataFrame:
    """One row: global mean / median / mode / count of ``col`` (exact;
    skew-safe); nulls if the column has no value."""
    return statistics(value_bins(df, [], col), [], col, stats, list(names or stats))


def group_stats(df: DataFrame, keys: Sequence[str], col: str, stats: Sequence[str] = ("mean", "median"),
                names: Sequence[str] | None = None) -> DataFrame:
    """Per-group statistics from one set of value bins (one scan, one
    aggregation). Null keys form no group; a group without values has no row."""
    return statistics(value_bins(df, keys, col), keys, col, stats, list(names or stats))


def group_count(df: DataFrame, keys: Sequence[str], col: str, out: str = "n") -> DataFrame:
    """Values of ``col`` per group, 0 included; null keys form no group."""
    rows = df
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.when(present(df, col), F.lit(1))).alias(out))


def head_by(df: DataFrame, order: Sequence[str] | str, n: int = 5) -> DataFrame:
    """First ``n`` rows by an explicit order (a top-k plan, not a full sort)."""
    order = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*order).limit(n)


def sorted_distinct(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)
