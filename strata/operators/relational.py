"""Projections, lookups, semi/anti joins and keyed zips.

Row identity is an explicit key column (never position), so every "side by
side" operation is an equi-join on it or, better, never separates the columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.profile import group_count, group_stats
from strata.session import BROADCAST_BYTES, materialize


class SchemaError(ValueError):
    pass


def align(df: DataFrame, cols: Sequence[str], drop_extra: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Exact ordered column list; fails if one is missing (metadata only, no job).
    ``keep``: identity columns carried in front (e.g. ``row_id``)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    if not drop_extra:
        rest = [c for c in df.columns if c not in cols and c not in keep]
        return df.select(*keep, *cols, *rest)
    return df.select(*keep, *cols)


def drop_extra(df: DataFrame, allowed: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keep only allowed columns (in the frame's order); return the dropped names."""
    dropped = [c for c in df.columns if c not in allowed]
    return df.select(*[c for c in df.columns if c in allowed]), dropped


def split_label(df: DataFrame, candidates: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """Features / label split with a fallback list of label names; returns
    (label frame with ``keep`` columns, chosen label name)."""
    for c in candidates:
        if c in df.columns:
            return df.select(*keep, c), c
    raise SchemaError(f"none of the label candidates exist: {list(candidates)}")


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str] | str, defaults: Mapping[str, object] | None = None,
           broadcast_bytes: int | None = BROADCAST_BYTES, check_unique: bool = False,
           n_bytes: int | None = None) -> DataFrame:
    """Left equi-join onto a unique-key table; missing matches take ``defaults``.

    The lookup side is written once, measured, and broadcast only within
    ``broadcast_bytes``; otherwise the planner's shuffle join (AQE splits a
    skewed key). ``check_unique`` fails on duplicate keys (they would multiply
    rows). ``n_bytes``: the table's already measured bytes, if known."""
    on = [on] if isinstance(on, str) else list(on)
    if n_bytes is None and (check_unique or broadcast_bytes is not None):
        table, m = materialize(table)
        n_bytes = m["bytes"]
    if check_unique and not table.groupBy(*on).count().filter(F.col("count") > 1).isEmpty():
        raise ValueError(f"lookup key {on} is not unique")
    right = F.broadcast(table) if broadcast_bytes is not None and n_bytes <= broadcast_bytes else table
    out = df.join(right, on, "left")
    if defaults:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    return out


def unseen(df: DataFrame, ref: DataFrame, key: str, ref_key: str | None = None) -> DataFrame:
    """Distinct keys of ``df`` that ``ref`` does not have (anti join)."""
    ref_key = ref_key or key
    r = ref.select(F.col(ref_key).alias(key)).distinct()
    return df.select(key).distinct().join(r, key, "left_anti")


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key appears in ``ids`` (semi join: no duplication)."""
    return df.join(ids.select(key), key, "left_semi")


def set_difference(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct values of ``a.col`` not in ``b.col``."""
    return a.select(col).distinct().join(b.select(col), col, "left_anti")


def zip_by_key(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Pair two column blocks of the same rows (inner join on the row id)."""
    return a.join(b, key, "inner")


def group_transform(df: DataFrame, keys: Sequence[str], col: str, stat: str | Mapping[str, str], out: str | None = None,
                    broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Group statistics attached to every row (``groupby.transform``): one
    ``stat`` as ``out``, or several as ``{out: stat}`` from the same bins.

    Computed as value bins -> per-group statistics (one aggregation) -> lookup,
    not as a window: the aggregate is map-side combined, so a hot group never
    lands in one task. The statistics are broadcast while their measured bytes
    allow; beyond, the join is split by AQE on a hot key. Null keys get null
    (they form no group)."""
    keys = list(keys)
    stats = {out: stat} if isinstance(stat, str) else dict(stat)
    if set(stats.values()) == {"count"}:
        g = group_count(df, keys, col, "_n")
        g = g.select(*keys, *[F.col("_n").alias(o) for o in stats])
    else:
        g = group_stats(df, keys, col, list(stats.values()), list(stats))
    j = lookup(df, g, keys, broadcast_bytes=broadcast_bytes)
    counts = {o: F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]), F.coalesce(F.col(o), F.lit(0)))
              for o, s in stats.items() if s == "count"}
    return j.withColumns(counts).select(*df.columns, *stats)
