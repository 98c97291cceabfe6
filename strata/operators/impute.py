"""Hierarchical (cascading) imputation with provenance.

A cascade fills the nulls of one column tier by tier; each tier's statistic
is computed *after* the previous tier wrote its fills (sequential semantics,
not a one-shot ``coalesce``). Every filled cell records the rule that filled
it, and ``impute_audit`` turns that provenance into one audit row per
originally-null cell.

Execution:

1. one pass over the rows builds the *bin table*: value bins at the finest
   grain any tier groups by (map-side combined, so a hot cell is
   pre-aggregated before the shuffle) plus null bins, one per distinct key
   combination of the null cells. It is checkpointed and its size measured.
2. tiers run in bin space; fills are extra counts at the filled value.
   ``window`` strategy (bin table within a bound): all tiers form one linear
   plan of window aggregates, no intermediate jobs. ``bins`` strategy (any
   size): each tier aggregates the value bins plus the fills so far to its
   keys (partial aggregation), joins the statistic onto the open null bins and
   cuts the lineage (checkpoint), so the plan never doubles per tier; medians
   of groups with too many distinct values use exact rank refinement.
3. the fills of all columns are joined back: while the fill tables' measured
   bytes are under a bound, broadcast joins in one pass over the rows; otherwise
   the rows are split once into those with and without any open cell, only the
   former go through the (shuffle) joins, and the two parts are unioned: two
   scans, however many columns.

Null keys never form a group: an equi-join does not match a null key, so a
row with a null key is left for a later tier, as pandas does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from strata.operators.stats import CONST_KEY, MAX_DISTINCT, group_stat, present
from strata.session import BROADCAST_BYTES, cut_lineage, materialize

WINDOW_MAX_BINS = MAX_DISTINCT
GROUP_STATS = ("median", "mode", "mean")


@dataclass(frozen=True)
class Tier:
    """One rung of a ladder.

    stat: ``median`` | ``mode`` | ``mean`` (group statistic over ``keys``; no
    keys = global), ``derive`` (a row expression of ``derive_from``), ``const``.
    min_count: the group needs at least this many non-null values.
    """
    rule: str
    keys: tuple[str, ...] = ()
    stat: str = "median"
    min_count: int = 0
    derive: Callable[[Column], Column] | None = None
    derive_from: str | None = None
    value: Any = None


def _uniq(xs: Sequence[str]) -> list[str]:
    out: list[str] = []
    for x in xs:
        if x not in out:
            out.append(x)
    return out


def prov_cols(col: str) -> tuple[str, str]:
    """Names of the provenance columns carried for ``col``."""
    return f"_null_{col}", f"_rule_{col}"


@dataclass
class Fills:
    """A cascade's result in bin space: one row per null-key combination."""
    col: str
    table: DataFrame     # keys..., _fill, _rule, _n (cells)
    keys: list[str]
    n_bytes: int         # measured


def widen(df: DataFrame, col: str, tiers: Sequence[Tier]) -> DataFrame:
    """An integral column that a median or mean can fill becomes double, as the
    statistic need not be a whole number; NaN of a fractional column is null."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.IntegralType) and any(t.stat in ("median", "mean") for t in tiers):
        return df.withColumn(col, F.col(col).cast("double"))
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return df.withColumn(col, F.when(~F.isnan(col), F.col(col)))
    return df


def cascade_fills(df: DataFrame, col: str, tiers: Sequence[Tier], strategy: str = "auto",
                  window_max_bins: int = WINDOW_MAX_BINS, materialize_fills: bool = True) -> Fills:
    """Run the tiers of one column in bin space and return its fill table.

    strategy: ``window`` (all tiers in one linear plan of windows over the bin
    table), ``bins`` (per-tier aggregate + join, cut after each tier, exact
    median refinement for huge groups), or ``auto``: ``window`` when the whole
    bin table has at most ``window_max_bins`` rows (so no window partition can
    exceed it), else ``bins``.
    """
    df = widen(df, col, tiers)
    bins, group_keys, null_keys, dtype, n_total, n_bytes = _bin_table(df, col, tiers)
    fills = _cascade(bins, tiers, group_keys, null_keys, dtype, n_total, strategy, window_max_bins)
    if materialize_fills:
        fills = cut_lineage(fills)
    return Fills(col, fills, null_keys, n_bytes)


def _cascade(bins: DataFrame, tiers: Sequence[Tier], group_keys: Sequence[str], null_keys: Sequence[str], dtype, n_bins: int,
             strategy: str, window_max_bins: int) -> DataFrame:
    if strategy == "auto":
        strategy = "window" if n_bins <= window_max_bins else "bins"
    if strategy == "window":
        return _tiers_window(bins, tiers, null_keys, dtype, n_bins)
    if strategy == "bins":
        return _tiers_join(bins, tiers, group_keys, null_keys, dtype, n_bins)
    raise ValueError(f"unknown strategy {strategy!r}")


def _bin_table(df: DataFrame, col: str, tiers: Sequence[Tier]):
    """One scan: value bins at the finest tier grain + null bins, from one
    map-side combined count, checkpointed and measured. Null bins also keep the
    values that a ``derive`` tier reads. The bytes are those of the null bins."""
    group_keys = _uniq([k for t in tiers if t.stat in GROUP_STATS for k in t.keys])
    null_keys = _uniq(group_keys + [t.derive_from for t in tiers if t.stat == "derive" and t.derive_from])
    dtype = df.schema[col].dataType
    is_null = F.col(col).isNull()
    at = [F.col(k) if k in group_keys else F.when(is_null, F.col(k)).alias(k) for k in null_keys]
    counted = df.select(*at, F.col(col).alias("_v")).groupBy(*null_keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    shape = counted.select(*null_keys, "_v", "_n", F.col("_v").isNull().alias("_isnull"), F.lit(None).cast("string").alias("_rule"))
    bins, m = materialize(shape, F.coalesce(F.sum(F.when(F.col("_isnull"), _null_bytes(null_keys))), F.lit(0)).alias("null_bytes"))
    return bins, group_keys, null_keys, dtype, m["count"], m["null_bytes"]


@dataclass
class TierLookup:
    """A tier's statistic frozen on a reference table: ``table`` is
    ``(keys..., _stat, _cnt)`` (``n_bytes`` measured) for a keyed tier,
    ``value`` for a global one; row rules carry neither."""
    tier: Tier
    table: DataFrame | None = None
    n_bytes: int = 0
    value: Any = None


def ladder_lookups(df: DataFrame, col: str, tiers: Sequence[Tier]) -> list[TierLookup]:
    """Fit every tier's statistic on ``df`` with the cascade's sequential
    semantics (tier k sees the fills of tiers < k) and keep them as lookups.
    Applied in order to new rows (``apply_lookups``) they reproduce the
    cascade on ``df`` itself exactly, and they need no state on a stream."""
    bins, group_keys, null_keys, dtype, n_total, _ = _bin_table(widen(df, col, tiers), col, tiers)
    captured: list[TierLookup] = []
    _tiers_join(bins, tiers, group_keys, null_keys, dtype, n_total, capture=captured)
    return captured


def impute_cascade(df: DataFrame, col: str, tiers: Sequence[Tier], strategy: str = "auto",
                   window_max_bins: int = WINDOW_MAX_BINS,
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Fill ``col`` tier by tier. Adds ``_null_<col>`` (was null) and
    ``_rule_<col>`` (rule that filled it, null if none). See ``cascade_fills``."""
    f = cascade_fills(df, col, tiers, strategy, window_max_bins, materialize_fills=False)
    return apply_fills(widen(df, col, tiers), [f], broadcast_bytes)


def _tier_update(c: DataFrame, cols: Sequence[str], cond: Column, cand: Column, rule: str) -> DataFrame:
    return c.select(*cols, "_n", "_isnull",
                    F.when(cond, cand).otherwise(F.col("_v")).alias("_v"),
                    F.when(cond, F.lit(rule)).otherwise(F.col("_rule")).alias("_rule"))


def _global_stat(c: DataFrame, stat: str, bound: int) -> DataFrame:
    """A one-row table (``_g`` key) with the statistic over all current values."""
    vb = c.filter(F.col("_v").isNotNull()).select("_v", "_n")
    return group_stat(vb, [], "_v", stat, bins_bound=bound).withColumn(CONST_KEY, F.lit(0))


def _tiers_window(bins: DataFrame, tiers: Sequence[Tier], keys: Sequence[str], dtype, bound: int) -> DataFrame:
    """All tiers as one plan. Group statistics are window aggregates over the
    bin table; consecutive tiers sharing a key are served by one repartition.
    A global tier is a one-row aggregate, broadcast."""
    c = bins
    part: set[str] | None = None
    has_v = F.col("_v").isNotNull()
    for i, t in enumerate(tiers):
        open_ = F.col("_isnull") & F.col("_v").isNull()
        if t.stat in GROUP_STATS and t.keys:
            if part is None or not part <= set(t.keys):
                common = set(t.keys)
                for nxt in tiers[i + 1:]:
                    if nxt.stat not in GROUP_STATS or not nxt.keys or not common & set(nxt.keys):
                        break
                    common &= set(nxt.keys)
                part = common
                c = c.repartition(*[k for k in t.keys if k in common])
            w = Window.partitionBy(*t.keys)
            if t.stat == "median":
                cand = F.percentile(F.col("_v"), F.lit(0.5), F.col("_n")).over(w)
            elif t.stat == "mean":
                cand = F.sum(F.col("_v") * F.col("_n")).over(w) / F.sum(F.when(has_v, F.col("_n"))).over(w)
            else:
                per_value = F.sum(F.col("_n")).over(Window.partitionBy(*t.keys, "_v"))
                c = c.withColumn("_nv", per_value)
                cand = F.min(F.when(has_v, F.struct((-F.col("_nv")).alias("neg"), F.col("_v").alias("v")))).over(w)["v"]
            cnt = F.sum(F.when(has_v, F.col("_n"))).over(w)
            keys_ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in t.keys])
            cond = open_ & keys_ok & cand.isNotNull()
            if t.min_count:
                cond = cond & (cnt >= t.min_count)
            c = _tier_update(c, keys, cond, cand.cast(dtype), t.rule)
        elif t.stat in GROUP_STATS:
            if part is not None:
                # the statistic and the update both read the window results:
                # cut here so the window stages run once (a pruned copy of
                # them would not be reused as the same exchange)
                c, m = materialize(c, F.count_if(open_).alias("open"))
                part = None
                if not m["open"]:  # nothing is left for this and later tiers
                    break
            stats = F.broadcast(_global_stat(c, t.stat, bound))
            j = c.withColumn(CONST_KEY, F.lit(0)).join(stats, CONST_KEY, "left")
            cand = F.col("_stat").cast(dtype)
            c = _tier_update(j, keys, open_ & cand.isNotNull(), cand, t.rule)
        else:
            cand, cond = _row_rule(t, dtype, open_)
            c = _tier_update(c, keys, cond, cand, t.rule)
    return c.filter(F.col("_isnull")).select(*keys, F.col("_v").alias("_fill"), "_rule", "_n")


def _row_rule(t: Tier, dtype, open_: Column) -> tuple[Column, Column]:
    if t.stat == "derive":
        cand = t.derive(F.col(t.derive_from)).cast(dtype)
        return cand, open_ & cand.isNotNull()
    if t.stat == "const":
        return F.lit(t.value).cast(dtype), open_
    raise ValueError(f"unknown tier stat {t.stat!r}")


def _tiers_join(bins: DataFrame, tiers: Sequence[Tier], group_keys: Sequence[str],
                keys: Sequence[str], dtype, bound: int, capture: list | None = None) -> DataFrame:
    """Scale path: per tier, aggregate the value bins plus the fills so far to
    the tier's keys (partial aggregation), join the statistic onto the open
    null bins (null keys never match), and cut the lineage."""
    hist = bins.filter(~F.col("_isnull")).select(*group_keys, "_v", "_n")
    nb = cut_lineage(bins.filter(F.col("_isnull")))
    for t in tiers:
        open_ = F.col("_v").isNull()
        if t.stat in GROUP_STATS:
            tk = list(t.keys)
            added = nb.filter(F.col("_v").isNotNull()).select(*tk, "_v", "_n")
            vb = hist.select(*tk, "_v", "_n").unionByName(added)
            stats = group_stat(vb, tk, "_v", t.stat, bins_bound=bound)
            if capture is not None:
                stats, sm = materialize(stats)
                if tk:
                    capture.append(TierLookup(t, stats, sm["bytes"]))
                else:
                    row = stats.collect()  # a global statistic: one row
                    capture.append(TierLookup(t, value=row[0]["_stat"] if row else None))
            if tk:
                j = nb.join(stats, tk, "left")
            else:  # a global statistic is exactly one row: broadcast it
                j = (nb.withColumn(CONST_KEY, F.lit(0))
                     .join(F.broadcast(stats.withColumn(CONST_KEY, F.lit(0))), CONST_KEY, "left"))
            cand = F.col("_stat").cast(dtype)
            cond = open_ & cand.isNotNull()
            if t.min_count:
                cond = cond & (F.col("_cnt") >= t.min_count)
        else:
            j = nb
            cand, cond = _row_rule(t, dtype, open_)
            if capture is not None:
                capture.append(TierLookup(t))
        nb, m = materialize(_tier_update(j, keys, cond, cand, t.rule), F.count_if(F.col("_v").isNull()).alias("open"))
        if capture is None and not m["open"]:  # nothing is left for later tiers
            break
    return nb.select(*keys, F.col("_v").alias("_fill"), "_rule", "_n")


def _join_fills(df: DataFrame, f: Fills, broadcast: bool) -> DataFrame:
    """One fill table onto the null cells of its column; a left join, so rows
    whose cell is set match nothing."""
    was_null, rule = prov_cols(f.col)
    names = {k: f"__k{i}" for i, k in enumerate(f.keys)}
    right = f.table.select(*[F.col(k).alias(n) for k, n in names.items()], "_fill", "_rule")
    cond = [df[f.col].isNull()] + [df[k].eqNullSafe(right[n]) for k, n in names.items()]
    j = df.join(F.broadcast(right) if broadcast else right, cond, "left")
    return j.select(*[F.coalesce(F.col(f.col), F.col("_fill")).alias(c) if c == f.col else F.col(c)
                      for c in df.columns if c not in (was_null, rule)],
                    df[f.col].isNull().alias(was_null), F.col("_rule").alias(rule))


def apply_fills(df: DataFrame, fills: Sequence[Fills], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join the fill tables onto the rows, in order, adding the provenance
    columns. Small ones (measured bytes, all together) are broadcast in one pass;
    otherwise only rows with an open cell go through the joins."""
    if sum(f.n_bytes for f in fills) <= broadcast_bytes:
        for f in fills:
            df = _join_fills(df, f, True)
        return df
    some_open = reduce(lambda a, b: a | b, [F.col(f.col).isNull() for f in fills])
    filled, kept = df.filter(some_open), df.filter(~some_open)
    for f in fills:
        filled = _join_fills(filled, f, False)
        was_null, rule = prov_cols(f.col)
        kept = kept.withColumns({was_null: F.lit(False), rule: F.lit(None).cast("string")})
    return filled.unionByName(kept)


def apply_lookups(df: DataFrame, col: str, lookups: Sequence[TierLookup],
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Fill ``col`` from frozen tier lookups, in tier order (first match wins).
    Row-wise plus lookup joins only, so it runs unchanged on a streaming
    DataFrame (stream-static joins). Adds the same provenance columns."""
    was_null, rule = prov_cols(col)
    df = widen(df, col, [lk.tier for lk in lookups])
    dtype = df.schema[col].dataType
    out = df.withColumns({was_null: F.col(col).isNull(), rule: F.lit(None).cast("string")})
    for i, lk in enumerate(lookups):
        t = lk.tier
        open_ = F.col(col).isNull()
        if lk.table is not None:
            s, c = f"__s{i}", f"__c{i}"
            tab = lk.table.select(*t.keys, F.col("_stat").alias(s), F.col("_cnt").alias(c))
            tab = F.broadcast(tab) if lk.n_bytes <= broadcast_bytes else tab
            out = out.join(tab, list(t.keys), "left")
            cand = F.col(s).cast(dtype)
            cond = open_ & cand.isNotNull()
            if t.min_count:
                cond = cond & (F.col(c) >= t.min_count)
        elif t.stat in GROUP_STATS:
            cand = F.lit(lk.value).cast(dtype)
            cond = open_ & cand.isNotNull()
        else:
            cand, cond = _row_rule(t, dtype, open_)
        out = out.withColumns({col: F.when(cond, cand).otherwise(F.col(col)),
                               rule: F.when(cond, F.lit(t.rule)).otherwise(F.col(rule))})
        if lk.table is not None:
            out = out.drop(f"__s{i}", f"__c{i}")
    return out


def _reads(tiers: Sequence[Tier]) -> set[str]:
    return {k for t in tiers for k in t.keys} | {t.derive_from for t in tiers if t.derive_from}


Plan = Sequence[tuple[str, Sequence[Tier]]]


# --- bins of a whole plan from one scan


@dataclass(frozen=True)
class LadderKeys:
    """What a ladder's bins are keyed by: ``group`` in every row, ``null`` (those and
    the inputs of derived tiers) in rows without a value, and ``extra`` where such an
    input is itself missing: the keys that its own ladder fills it by."""
    group: tuple[str, ...]
    null: tuple[str, ...]
    extra: tuple[tuple[str, tuple[str, ...]], ...] = ()


def ladder_keys(plan: Plan) -> dict[str, LadderKeys]:
    out: dict[str, LadderKeys] = {}
    for col, tiers in plan:
        group = _uniq([k for t in tiers if t.stat in GROUP_STATS for k in t.keys])
        null = _uniq(group + [t.derive_from for t in tiers if t.stat == "derive" and t.derive_from])
        extra = []
        for d in null:
            if d in out and d not in group:  # an earlier column of the plan, as a derived tier's input
                extra.append((d, tuple(k for k in _uniq([*out[d].null, *(x for _, ks in out[d].extra for x in ks)]) if k != col)))
        out[col] = LadderKeys(tuple(group), tuple(null), tuple(extra))
    return out


def one_scan(plan: Plan) -> bool:
    """Whether bins of the plan's columns can come from one scan: no ladder groups by a
    column that an earlier one fills (its groups would change with the fills)."""
    done: set[str] = set()
    for col, tiers in plan:
        if done & {k for t in tiers if t.stat in GROUP_STATS for k in t.keys}:
            return False
        done.add(col)
    return True


LADDER = "_ladder"


def _all_keys(keys: dict[str, LadderKeys]) -> list[str]:
    return _uniq([k for lk in keys.values() for k in (*lk.null, *(x for _, xs in lk.extra for x in xs))])


def plan_bins(df: DataFrame, plan: Plan) -> DataFrame:
    """``(_ladder, keys..., _v_<column>..., _n)``: value bins and null bins of every
    ladder from one scan and one map-side combined count (a row goes to each ladder's
    grain, as in grouping sets). Counts are additive, so bins of two tables together
    are ``merge_bins`` of theirs."""
    for col, tiers in plan:
        df = widen(df, col, tiers)
    keys = ladder_keys(plan)
    names = _all_keys(keys)
    grains = []
    for col, lk in keys.items():
        is_null = F.col(col).isNull()
        at = {}
        for k in names:
            nothing = F.lit(None).cast(df.schema[k].dataType)
            if k in lk.group:
                at[k] = F.col(k)
            elif k in lk.null:
                at[k] = F.when(is_null, F.col(k))
            else:
                missing = [F.col(d).isNull() for d, xs in lk.extra if k in xs]
                at[k] = F.when(is_null & reduce(lambda a, b: a | b, missing), F.col(k)) if missing else nothing
        values = [(F.col(c) if c == col else F.lit(None).cast(df.schema[c].dataType)).alias(f"_v_{c}") for c in keys]
        grains.append(F.struct(F.lit(col).alias(LADDER), *[c.alias(k) for k, c in at.items()], *values))
    rows = df.select(F.inline(F.array(*grains)))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))


def merge_bins(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.unionByName(b)
    return both.groupBy(*[c for c in both.columns if c != "_n"]).agg(F.sum("_n").alias("_n"))


def _ladder_bins(bins: DataFrame, col: str, lk: LadderKeys, fill) -> DataFrame:
    """One ladder's bins in the form of ``_bin_table``. ``fill(rows, column)`` fills
    an earlier column in the null bins that a derived tier reads it in."""
    own = bins.filter(F.col(LADDER) == col)
    shape = [*lk.null, F.col(f"_v_{col}").alias("_v"), "_n"]
    if not lk.extra:
        own = own.select(*shape)
    else:
        missing = own.filter(F.col(f"_v_{col}").isNull())
        for d, _ in lk.extra:
            missing = fill(missing, d)
        own = own.filter(F.col(f"_v_{col}").isNotNull()).select(*shape).unionByName(missing.select(*shape).groupBy(*lk.null, "_v").agg(F.sum("_n").alias("_n")))
    return own.select(*lk.null, "_v", "_n", F.col("_v").isNull().alias("_isnull"), F.lit(None).cast("string").alias("_rule"))


def _null_bytes(keys: Sequence[str]) -> Column:
    per_row = F.lit(64)
    for k in keys:
        per_row = per_row + F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) + 8
    return per_row.cast("long")


def measured_bins(df: DataFrame, plan: Plan) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """The plan's bins, written once, with each ladder's number of bins and the
    bytes of its null bins, measured while they are written."""
    metrics = []
    for i, (col, lk) in enumerate(ladder_keys(plan).items()):
        own = F.col(LADDER) == col
        metrics += [F.count_if(own).alias(f"n{i}"), F.coalesce(F.sum(F.when(own & F.col(f"_v_{col}").isNull(), _null_bytes(lk.null))), F.lit(0)).alias(f"b{i}")]
    bins, m = materialize(plan_bins(df, plan), *metrics)
    return bins, {col: (m[f"n{i}"], m[f"b{i}"]) for i, (col, _) in enumerate(plan)}


def plan_lookups(bins: DataFrame, plan: Plan, bound: int) -> list[tuple[str, list[TierLookup]]]:
    """Every tier's statistic of a whole plan from its bins alone, frozen as lookups
    (see ``ladder_lookups``); ``bound``: a bound on the bins of a ladder."""
    frozen: dict[str, list[TierLookup]] = {}
    for (col, tiers), lk in zip(plan, ladder_keys(plan).values()):
        own = _ladder_bins(bins, col, lk, lambda rows, d: apply_lookups(rows, d, frozen[d]).drop(*prov_cols(d)))
        frozen[col] = []
        _tiers_join(cut_lineage(own), tiers, lk.group, lk.null, bins.schema[f"_v_{col}"].dataType, bound, capture=frozen[col])
    return list(frozen.items())


def freeze_plan(df: DataFrame, plan: Plan) -> list[tuple[str, list[TierLookup]]]:
    """Lookups of a whole plan (columns in dependency order: a later ladder sees the
    earlier ones' fills). All bins come from one scan of ``df`` unless a ladder groups by
    a column that an earlier one fills; then each ladder scans the rows with the
    lookups before it."""
    plan = list(plan)
    if one_scan(plan) and len({col for col, _ in plan}) == len(plan):
        bins, sizes = measured_bins(df, plan)
        return plan_lookups(bins, plan, max((n for n, _ in sizes.values()), default=0))
    frozen = []
    for col, tiers in plan:
        lk = ladder_lookups(df, col, tiers)
        frozen.append((col, lk))
        df = apply_lookups(df, col, lk)
    return frozen


def plan_fills(df: DataFrame, plan: Plan, strategy: str = "auto", broadcast_bytes: int = BROADCAST_BYTES,
               max_parallel: int = 4) -> list[Fills]:
    """Fill tables of several cascades with sequential semantics: a later cascade
    sees the fills of every earlier column it reads (as a key or a derive input).

    All bins come from one scan of the rows (``plan_bins``) unless a ladder groups by a
    column that an earlier one fills; then each cascade scans the rows with the
    fills it depends on. A cascade that reads no earlier column does not wait for it:
    independent ones compute their fill tables concurrently (one driver thread
    each submitting Spark jobs under the caller's job group and pool)."""
    plan = list(plan)
    futures: dict[str, Future] = {}
    keys = ladder_keys(plan)
    bins, sizes = measured_bins(df, plan) if one_scan(plan) else (None, {})

    def scanned(i: int) -> Fills:
        col, tiers = plan[i]
        deps = [futures[c].result() for c, _ in plan[:i] if c in _reads(tiers)]
        return cascade_fills(apply_fills(df, deps, broadcast_bytes) if deps else df, col, tiers, strategy, materialize_fills=True)

    def from_bins(i: int) -> Fills:
        col, tiers = plan[i]
        lk, (n, n_bytes) = keys[col], sizes[col]

        def fill(rows: DataFrame, d: str) -> DataFrame:
            f = futures[d].result()
            return _join_fills(rows, f, f.n_bytes <= broadcast_bytes).drop(*prov_cols(d))

        own = _ladder_bins(bins, col, lk, fill)
        fills = _cascade(own, tiers, list(lk.group), list(lk.null), bins.schema[f"_v_{col}"].dataType, n, strategy, WINDOW_MAX_BINS)
        return Fills(col, cut_lineage(fills), list(lk.null), n_bytes)

    run = from_bins if bins is not None else scanned
    with ThreadPoolExecutor(max_workers=max_parallel) as pool:
        for i, (col, _) in enumerate(plan):
            futures[col] = pool.submit(inheritable_thread_target(df.sparkSession)(run), i)
        return [futures[col].result() for col, _ in plan]


def impute_all(df: DataFrame, plan: Plan, strategy: str = "auto", broadcast_bytes: int = BROADCAST_BYTES,
               max_parallel: int = 4) -> DataFrame:
    """Fill several columns (see ``plan_fills``); all fill tables are applied to
    the rows at once, in plan order."""
    for col, tiers in plan:
        df = widen(df, col, tiers)
    return apply_fills(df, plan_fills(df, plan, strategy, broadcast_bytes, max_parallel), broadcast_bytes)


def plan_summary(fills: Sequence[Fills]) -> DataFrame:
    """Cells per (column, rule), as ``rule_summary`` of the audit, straight from
    the fill tables: no pass over the rows."""
    cells = None
    for f in fills:
        one = f.table.select(F.lit(f.col).alias("column"), F.col("_rule").alias("rule_used"), "_n")
        cells = one if cells is None else cells.unionAll(one)
    return cells.groupBy("column", "rule_used").agg(
        F.sum("_n").alias("n_cells"), F.sum(F.when(F.col("rule_used").isNotNull(), F.col("_n")).otherwise(F.lit(0))).alias("n_filled"))


AUDIT_COLUMNS = ["original_row_index", "column", "geohash", "day", "timestamp",
                 "filled_value", "rule_used", "fill_successful"]


def impute_audit(df: DataFrame, columns: Sequence[str], row_id: str = "row_id",
                 context: Sequence[str] = ("geohash", "day", "timestamp")) -> DataFrame:
    """One row per originally-null cell: row id, column, context, filled value
    (as string), rule, success. Single scan: the provenance columns are
    unpivoted with ``inline`` and filtered."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"),
                               F.col(c).cast("string").alias("filled_value"),
                               F.col(prov_cols(c)[1]).alias("rule_used"),
                               F.col(prov_cols(c)[0]).alias("_was_null")) for c in columns])
    return (df.select(F.col(row_id).alias("original_row_index"), *context, F.inline(cells))
            .filter(F.col("_was_null"))
            .select("original_row_index", "column", *context, "filled_value", "rule_used",
                    F.col("rule_used").isNotNull().alias("fill_successful")))


def rule_summary(audit: DataFrame) -> DataFrame:
    """Fills per (column, rule) and success rate per column."""
    return (audit.groupBy("column", "rule_used")
            .agg(F.count(F.lit(1)).alias("n_cells"),
                 F.count_if(F.col("fill_successful")).alias("n_filled")))


def unfilled(audit: DataFrame) -> DataFrame:
    return audit.filter(~F.col("fill_successful"))


def null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a null (or NaN) in any of ``cols``."""
    return df.filter(reduce(lambda a, b: a | b, [~present(df, c) for c in cols]))


def fill_const(df: DataFrame, col: str, value: Any) -> DataFrame:
    """Nulls (and NaN) of ``col`` take a constant."""
    return df.withColumn(col, F.when(present(df, col), F.col(col)).otherwise(F.lit(value).cast(df.schema[col].dataType)))


def stack_audit(df: DataFrame, columns: Sequence[str], row_id: str = "row_id",
                context: Sequence[str] = ("geohash", "day", "timestamp")) -> DataFrame:
    """One row per null (or NaN) cell of ``columns``: row id, column, context;
    one scan."""
    cells = F.array(*[F.when(~present(df, c), F.lit(c)) for c in columns])
    return df.select(F.col(row_id).alias("original_row_index"), F.explode(F.array_compact(cells)).alias("column"), *context)


def fill_global(df: DataFrame, col: str, stat: str = "median") -> DataFrame:
    """Nulls (and NaN) of ``col`` take its global statistic; an all-null column
    stays null. The driver holds the one value."""
    from strata.operators.profile import global_stats

    df = widen(df, col, [Tier("global", stat=stat)])
    value = global_stats(df, col, (stat,)).collect()[0][stat]
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value).cast(df.schema[col].dataType)))
