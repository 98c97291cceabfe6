"""Categorical and time encoders (all native Column expressions)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import close_vocab, cyclical, minute_of_day, parse_hm, recode, time_index


def binary_encode(df: DataFrame, col: str, mapping: Mapping[Any, int], default: int | None = None) -> DataFrame:
    """Two-value recode in place. ``default=None`` is strict (unmapped -> null,
    which the pipelines' gates fail on); ``default=0`` is the lenient form."""
    return df.withColumn(col, recode(col, mapping, default).cast("int"))


def one_hot(df: DataFrame, col: str, vocab: Sequence[str], prefix: str | None = None,
            default: str | None = None, skip_existing: bool = False, drop: bool = True) -> DataFrame:
    """Fixed-vocabulary 0/1 int columns ``<prefix>_<value>`` in vocabulary order.

    default: an off-vocabulary (or null) value is first mapped to it; with
    ``None`` such a row is all zeros. A class absent from the data still gets
    its (all-zero) column. ``skip_existing`` leaves columns that already exist.
    """
    prefix = prefix or col
    src = close_vocab(col, vocab, default) if default is not None else F.col(col)
    new = {}
    for v in vocab:
        name = f"{prefix}_{v}"
        if skip_existing and name in df.columns:
            continue
        new[name] = src.eqNullSafe(F.lit(v)).cast("int")
    out = df.withColumns(new)
    return out.drop(col) if drop else out


def time_features(df: DataFrame, col: str = "timestamp", style: str = "hour_minute",
                  keep_parts: bool = True, drop: bool = True) -> DataFrame:
    """Parse ``"H:M"`` and encode the time of day.

    style ``hour_minute``: hour, minute, hour_sin/cos (period 24), min_sin/cos
    (period 60), time_index (15-minute slot). style ``day_minute``: time_sin/cos
    of the minute of the day (period 1440).
    """
    hour, minute = parse_hm(col)
    out = df.withColumns({"hour": hour, "minute": minute})
    if style == "hour_minute":
        hs, hc = cyclical("hour", 24)
        ms, mc = cyclical("minute", 60)
        out = out.withColumns({"hour_sin": hs, "hour_cos": hc, "min_sin": ms, "min_cos": mc,
                               "time_index": time_index("hour", "minute")})
    elif style == "day_minute":
        ts, tc = cyclical(minute_of_day("hour", "minute"), 1440)
        out = out.withColumns({"time_sin": ts, "time_cos": tc})
    else:
        raise ValueError(f"unknown style {style!r}")
    if not keep_parts:
        out = out.drop("hour", "minute")
    return out.drop(col) if drop else out
