"""Scalar column functions. Every function returns a native ``Column``: no
Python UDF, so all of it stays inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- time of day -------------------------------------------------------------

def parse_hm(col: ColumnOrName, strict: bool = True) -> tuple[Column, Column]:
    """``"H:M"`` (padded or not) -> (hour, minute) ints.

    strict: a malformed value raises (ANSI cast), like ``int()`` would.
    lenient: a malformed value gives null.
    """
    parts = F.split(_c(col), ":")
    if strict:
        return parts.getItem(0).cast("int"), parts.getItem(1).cast("int")
    return (F.try_element_at(parts, F.lit(1)).try_cast("int"),
            F.try_element_at(parts, F.lit(2)).try_cast("int"))


def time_index(hour: ColumnOrName, minute: ColumnOrName, slot_minutes: int = 15) -> Column:
    """Slot of the day: ``hour * (60/slot) + minute // slot`` (0..95 for 15 min)."""
    per_hour = 60 // slot_minutes
    return (_c(hour) * per_hour + F.floor(_c(minute) / slot_minutes)).cast("int")


def minute_of_day(hour: ColumnOrName, minute: ColumnOrName) -> Column:
    return (_c(hour) * 60 + _c(minute)).cast("int")


def cyclical(col: ColumnOrName, period: float) -> tuple[Column, Column]:
    """(sin, cos) of ``2*pi*x/period``; evaluated as ``(2*pi*x)/period``."""
    angle = F.lit(2 * math.pi) * _c(col) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


# --- strings / categories ------------------------------------------------------

def geo_prefix(col: ColumnOrName, n: int) -> Column:
    """First ``n`` characters (the parent cell of a geohash)."""
    return F.substring(_c(col), 1, n)


def recode(col: ColumnOrName, mapping: Mapping[Any, Any], default: Any = None) -> Column:
    """Literal dictionary map. Unmapped (and null) -> ``default`` (null = strict)."""
    c = _c(col)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def close_vocab(col: ColumnOrName, vocab: Sequence[Any], default: Any) -> Column:
    """Keep values inside a closed vocabulary; anything else (null too) -> default."""
    c = _c(col)
    return F.when(c.isin(list(vocab)), c).otherwise(F.lit(default))


def eq_flag(col: ColumnOrName, value: Any) -> Column:
    """``col == value`` as 0/1; a null operand gives 0."""
    return _c(col).eqNullSafe(F.lit(value)).cast("int")


def add_flag(df: DataFrame, col: str, value: Any, out: str, keep_existing: bool = True) -> DataFrame:
    """``df`` with the flag ``out``; a column of that name is kept as it is, or
    replaced if not ``keep_existing``."""
    return df if keep_existing and out in df.columns else df.withColumn(out, eq_flag(col, value))


def band_rule(col: ColumnOrName, bands: Sequence[tuple[float, Any]], else_label: Any,
              null_label: Any = None) -> Column:
    """Ordered numeric bands: first ``value < upper`` wins, else ``else_label``.
    A null input gives ``null_label``."""
    c = _c(col)
    out = F.when(c.isNull(), F.lit(null_label))
    for upper, label in bands:
        out = out.when(c < F.lit(upper), F.lit(label))
    return out.otherwise(F.lit(else_label))


@dataclass(frozen=True)
class Bands:
    """``band_rule`` as a value, so that a fitted ladder can be saved with it."""
    bands: tuple[tuple[float, Any], ...]
    else_label: Any
    null_label: Any = None

    def __call__(self, col: ColumnOrName) -> Column:
        return band_rule(col, self.bands, self.else_label, self.null_label)


# --- conditionals ----------------------------------------------------------------

def fill_where(col: ColumnOrName, stat: ColumnOrName, guard: Column | None = None) -> Column:
    """Masked assignment: ``col`` if present, else ``stat`` when it exists and the guard holds."""
    c, s = _c(col), _c(stat)
    cond = c.isNull() & s.isNotNull()
    if guard is not None:
        cond = cond & guard
    return F.when(cond, s).otherwise(c)


def is_in(col: ColumnOrName, values: Sequence[Any]) -> Column:
    return _c(col).isin(list(values))


def between(col: ColumnOrName, lo: Any, hi: Any) -> Column:
    return _c(col).between(lo, hi)


# --- numeric ---------------------------------------------------------------------

def clip_lower(col: ColumnOrName, lower: float = 0.0) -> Column:
    """Values below ``lower`` -> ``lower``; null stays null."""
    c = _c(col)
    return F.when(c < F.lit(lower), F.lit(lower).cast("double")).otherwise(c)


def residual(actual: ColumnOrName, predicted: ColumnOrName) -> tuple[Column, Column]:
    err = _c(actual) - _c(predicted)
    return err, F.abs(err)


def score100(r2: ColumnOrName) -> Column:
    """``max(0, 100*r2)``."""
    return F.greatest(F.lit(0.0), F.lit(100.0) * _c(r2))


def to_int(col: ColumnOrName) -> Column:
    return _c(col).cast("int")


def to_float(col: ColumnOrName) -> Column:
    return _c(col).cast("float")
