"""Standardisation: mean and *population* std fitted once, applied anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaler_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: ``<col>_mean``, ``<col>_std`` (ddof=0) for every column, one pass."""
    return df.agg(*[F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in cols],
                  *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_std") for c in cols])


def scaler_params(stats: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """The fitted row (bounded: two numbers per column) as ``col -> (mean, scale)``;
    a zero std scales by 1."""
    row = stats.collect()[0]
    out = {}
    for c in cols:
        std = row[f"{c}_std"]
        out[c] = (row[f"{c}_mean"], std if std else 1.0)
    return out


def scaler_apply(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """``(x - mean) / scale`` in place, as literals (no join)."""
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


def standardize(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str]):
    """Fit on ``train``, apply to it and every other frame."""
    params = scaler_params(scaler_fit(train, cols), cols)
    return scaler_apply(train, params), [scaler_apply(o, params) for o in others], params
