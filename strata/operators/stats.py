"""Exact group statistics over value bins.

A *bin table* is ``(keys..., value, n)``: the multiplicity of every distinct
value per group. It is what a ``groupBy(keys, value).count()`` produces, with
map-side partial aggregation, so a hot group (a third of all rows) collapses to
its distinct values before the shuffle and is spread over tasks by the value.

From bins:

* **mode** (most frequent, tie -> smallest) is ``min(struct(-n, value))`` —
  a declarative aggregate, partial on the map side, skew-safe.
* **mean** is ``sum(value*n)/sum(n)`` — declarative, skew-safe.
* **median** (exact, linear interpolation as pandas / DuckDB) uses the
  ``percentile(value, 0.5, n)`` aggregate when every group has at most
  ``max_distinct`` distinct values; its buffer is a value->count map of one
  group. Groups with more distinct values (a hot group of a continuous column,
  or a global median) are resolved by refinement: the distinct values still in
  question are cut at their approximate ``buckets``-quantiles, only the part
  holding the target rank is kept, and so on until it holds at most
  ``max_distinct`` values, which are ranked. A part holds a bounded share of the
  values, however they are spread, so every round shrinks by a factor. No group
  is ever gathered whole into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONST_KEY = "_g"
MAX_DISTINCT = 1_000_000  # per-group value map bound: ~80 MB of task buffer
BUCKETS = 32


def present(df: DataFrame, col: str):
    """Not null, and not NaN in a floating-point column."""
    ok = F.col(col).isNotNull()
    return ok & ~F.isnan(col) if df.schema[col].dataType.typeName() in ("double", "float") else ok


def value_bins(df: DataFrame, keys: Sequence[str], value: str, n: str = "_n", null_keys: bool = False) -> DataFrame:
    """``(keys, value, n)`` over the values of ``value`` (null and NaN are none).
    Rows with a null key form no group, unless ``null_keys``."""
    rows = df.filter(present(df, value))
    if not null_keys:
        for k in keys:
            rows = rows.filter(F.col(k).isNotNull())
    return rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))


def statistics(bins: DataFrame, keys: Sequence[str], value: str, stats: Sequence[str], names: Sequence[str],
               n: str = "_n", max_distinct: int | None = None, n_bins: int | None = None) -> DataFrame:
    """Mean, median, mode and count per group from one bin table (one row per
    group and value), in one aggregation while every group has at most
    ``max_distinct`` values (``n_bins``: a known bound; else the bins are written once and counted). Without keys: one
    row, nulls if there is no value."""
    from strata.session import materialize

    max_distinct = MAX_DISTINCT if max_distinct is None else max_distinct
    if n_bins is None:
        bins, m = materialize(bins)
        n_bins = m["count"]
    v, w = F.col(value), F.col(n)
    one = {"mean": lambda: F.sum(v * w) / F.sum(w), "count": lambda: F.coalesce(F.sum(w), F.lit(0)),
           "mode": lambda: F.min(F.struct((-w).alias("neg"), v.alias("v")))["v"],
           "median": lambda: F.percentile(v.cast("double"), F.lit(0.5), w)}
    if n_bins <= max_distinct or "median" not in stats:
        return bins.groupBy(*keys).agg(*[one[s]().alias(nm) for s, nm in zip(stats, names)])
    rest = [(s, nm) for s, nm in zip(stats, names) if s != "median"]
    b, k = _keyed(bins, keys)
    med = group_median(b, k, value, n=n, out="_median", count_out=None, max_distinct=max_distinct)
    others = b.groupBy(*k).agg(*[one[s]().alias(nm) for s, nm in rest], F.sum(n).alias("_any"))
    j = others.join(med, k, "left")
    return _unkey(j.select(*k, *[F.col("_median").alias(nm) if s == "median" else F.col(nm) for s, nm in zip(stats, names)]), keys)


def _keyed(bins: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return bins, list(keys)
    return bins.withColumn(CONST_KEY, F.lit(0)), [CONST_KEY]


def _unkey(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df if keys else df.drop(CONST_KEY)


def group_mode(bins: DataFrame, keys: Sequence[str], value: str, n: str = "_n",
               out: str = "_stat", count_out: str | None = "_cnt") -> DataFrame:
    """Most frequent value per group, ties -> smallest value. ``count_out``:
    number of non-null values in the group."""
    b, k = _keyed(bins, keys)
    per_value = b.groupBy(*k, value).agg(F.sum(n).alias(n))
    aggs = [F.min(F.struct((-F.col(n)).alias("neg"), F.col(value).alias("v")))["v"].alias(out)]
    if count_out:
        aggs.append(F.sum(n).alias(count_out))
    return _unkey(per_value.groupBy(*k).agg(*aggs), keys)


def group_mean(bins: DataFrame, keys: Sequence[str], value: str, n: str = "_n",
               out: str = "_stat", count_out: str | None = "_cnt") -> DataFrame:
    b, k = _keyed(bins, keys)
    aggs = [(F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias(out)]
    if count_out:
        aggs.append(F.sum(n).alias(count_out))
    return _unkey(b.groupBy(*k).agg(*aggs), keys)


def group_median(bins: DataFrame, keys: Sequence[str], value: str, n: str = "_n",
                 out: str = "_stat", count_out: str | None = "_cnt",
                 max_distinct: int | None = None, buckets: int = BUCKETS,
                 bins_bound: int | None = None) -> DataFrame:
    """Exact median per group (linear interpolation between the two middle
    values), from bins. See module doc for the two execution paths.
    ``bins_bound``: a known upper bound on the bin rows of any group (skips
    the measuring job when it is within ``max_distinct``)."""
    return group_quantile(bins, keys, value, 0.5, n, out, count_out, max_distinct, buckets, bins_bound)


def group_quantile(bins: DataFrame, keys: Sequence[str], value: str, q: float, n: str = "_n",
                   out: str = "_stat", count_out: str | None = "_cnt",
                   max_distinct: int | None = None, buckets: int = BUCKETS,
                   bins_bound: int | None = None) -> DataFrame:
    """Exact ``q`` quantile per group (see ``quantiles``)."""
    return quantiles(bins, keys, value, (q,), (out,), n, bins_bound, max_distinct, buckets, count_out)


def quantiles(bins: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], names: Sequence[str],
              n: str = "_n", bins_bound: int | None = None, max_distinct: int | None = None,
              buckets: int = BUCKETS, count_out: str | None = None) -> DataFrame:
    """Exact quantiles per group (position ``q*(N-1)``, linear interpolation —
    ``percentile`` / ``quantile_cont``), from bins: one ``percentile`` aggregate for
    groups of at most ``max_distinct`` values (default: the module's ``MAX_DISTINCT`` at
    call time; ``bins_bound``: a known bound on the bins of any group, which saves
    measuring), else one rank search for all of a group's quantiles together."""
    from strata.session import BROADCAST_BYTES, materialize

    max_distinct = MAX_DISTINCT if max_distinct is None else max_distinct
    b, k = _keyed(bins, keys)
    b = b.withColumn(value, F.col(value).cast("double"))

    def direct(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*k).agg(F.percentile(F.col(value), F.array(*[F.lit(float(q)) for q in qs]), F.col(n)).alias("_q"), F.sum(n).alias("_N"))
        return found.select(*k, *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)], "_N")

    def done(res: DataFrame) -> DataFrame:
        return _unkey(res.withColumnRenamed("_N", count_out) if count_out else res.drop("_N"), keys)

    if bins_bound is not None and bins_bound <= max_distinct:
        return done(direct(b))
    shape = b.groupBy(*k).agg(F.sum(n).alias("_N"), F.count(F.lit(1)).alias("_D"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    big, bm = materialize(shape.filter(F.col("_D") > max_distinct))
    if not bm["count"]:
        return done(direct(b))
    marked = F.broadcast(big) if bm["bytes"] <= BROADCAST_BYTES else big
    return done(direct(b.join(marked.select(*k), k, "left_anti")).unionByName(_search(b, marked, k, value, n, qs, names, max_distinct, buckets)))


def _search(b: DataFrame, big: DataFrame, k: list[str], value: str, n: str, qs: Sequence[float], names: Sequence[str],
            max_distinct: int, buckets: int) -> DataFrame:
    """Quantiles of groups with many distinct values, by rank selection. One state
    table holds all ranks of all groups, and every round refines them together, so
    several quantiles cost the passes of one. Few groups can be large, so the state
    is small (its bytes are measured) and is broadcast to the bins."""
    from strata.session import BROADCAST_BYTES, cut_lineage, materialize

    # one row per (group, value): bins may repeat a value (e.g. observed
    # values plus fills), and the rank window below needs distinct values
    b = cut_lineage(b.join(big.select(*k), k, "left_semi").groupBy(*k, value).agg(F.sum(n).alias(n)))
    at = [(F.col("_N") - 1) * F.lit(float(q)) for q in qs]
    wanted = F.array(*[F.struct(F.lit(2 * i + side).alias("_id"), side_of(p).cast("long").alias("_r")) for i, p in enumerate(at) for side, side_of in ((0, F.floor), (1, F.ceil))])
    # per (group, rank): the interval of values that still holds it, its distinct
    # values, and how many values lie below it
    state = big.select(*k, F.inline(wanted), "_lo", "_hi", "_D").withColumn("_below", F.lit(0).cast("long"))
    state, m = materialize(state, F.count_if(F.col("_D") > max_distinct).alias("open"))

    def candidates() -> DataFrame:
        st = F.broadcast(state) if m["bytes"] <= BROADCAST_BYTES else state
        return b.join(st, k).filter((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi")))

    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    while m["open"]:
        cand = candidates()
        # bounds from the distinct values: each part holds about 1/buckets of them
        bounds, bm = materialize(cand.groupBy(*k, "_id").agg(F.percentile_approx(F.col(value), cuts, 100 * buckets).alias("_cuts")))
        part = F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(value)))
        # the row estimate leaves the cuts out: 8 bytes each
        near = F.broadcast(bounds) if bm["bytes"] + 8 * buckets * bm["count"] <= BROADCAST_BYTES else bounds
        per_part = (cand.join(near, [*k, "_id"]).withColumn("_b", part)
                    .groupBy(*k, "_id", "_r", "_below", "_b")
                    .agg(F.sum(n).alias("_c"), F.count(F.lit(1)).alias("_d"), F.min(value).alias("_blo"), F.max(value).alias("_bhi")))
        w = Window.partitionBy(*k, "_id").orderBy("_b")  # <= `buckets` rows per partition
        picked = (per_part.withColumn("_cum", F.sum("_c").over(w))
                  .filter((F.col("_cum") - F.col("_c") <= F.col("_r") - F.col("_below")) & (F.col("_r") - F.col("_below") < F.col("_cum"))))
        state, m = materialize(picked.select(
            *k, "_id", "_r", F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"), F.col("_d").alias("_D"),
            (F.col("_below") + F.col("_cum") - F.col("_c")).alias("_below")), F.count_if(F.col("_d") > max_distinct).alias("open"))

    # rank inside the remaining interval: a window over few distinct values per group
    w = Window.partitionBy(*k, "_id").orderBy(value)
    hit = (candidates().withColumn("_cum", F.sum(n).over(w))
           .filter((F.col("_cum") - F.col(n) <= F.col("_r") - F.col("_below")) & (F.col("_r") - F.col("_below") < F.col("_cum"))))
    found = hit.groupBy(*k).agg(*[F.max(F.when(F.col("_id") == i, F.col(value))).alias(f"_v{i}") for i in range(2 * len(qs))]).join(big.select(*k, "_N"), k)
    out = []
    for i, (p, nm) in enumerate(zip(at, names)):
        frac = p - F.floor(p)
        out.append(((F.lit(1.0) - frac) * F.col(f"_v{2 * i}") + frac * F.col(f"_v{2 * i + 1}")).alias(nm))
    return found.select(*k, *out, "_N")


def group_stat(bins: DataFrame, keys: Sequence[str], value: str, stat: str, n: str = "_n",
               out: str = "_stat", count_out: str | None = "_cnt", bins_bound: int | None = None) -> DataFrame:
    if stat == "median":
        return group_median(bins, keys, value, n=n, out=out, count_out=count_out, bins_bound=bins_bound)
    fn = {"mode": group_mode, "mean": group_mean}[stat]
    return fn(bins, keys, value, n=n, out=out, count_out=count_out)
