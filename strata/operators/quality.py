"""Data-quality gates, evaluated together in one aggregation.

A check is ``(name, violations_expr)`` where the expression is a per-row
boolean "this row violates". ``expect`` runs all of them in a single pass and
returns ``(check, violations, passed)``; ``enforce=True`` raises afterwards.
Schema checks need no job at all (they read ``df.schema``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class GateError(AssertionError):
    pass


@dataclass(frozen=True)
class Check:
    name: str
    violation: Column | None = None   # per-row violation predicate (counted)
    agg: Column | None = None         # or an aggregate giving the violation count directly


def not_null(cols: Sequence[str], nan: bool = False) -> list[Check]:
    """``nan``: NaN in a floating-point column is a violation too."""
    return [Check(f"not_null:{c}", F.col(c).isNull() | F.isnan(c) if nan else F.col(c).isNull()) for c in cols]


def guard(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Row checks without a pass of their own: the rows flow on unchanged, and a
    violating row fails the job that reads it, naming the check."""
    for c in checks:
        if c.violation is None:
            raise ValueError(f"{c.name} is not a check per row")
    if not checks:
        return df
    any_bad = reduce(lambda a, b: a | b, [F.coalesce(c.violation, F.lit(False)) for c in checks])
    # the names are put together only inside the error. The test must stay where it
    # stands: pushed down, it would repeat the expressions behind every checked column.
    # A filter is not pushed through a projection that holds rand()
    names = F.concat_ws("; ", *[F.when(c.violation, F.lit(c.name)) for c in checks])
    passes = F.when(any_bad, F.raise_error(F.concat(F.lit("quality gate: "), names)).cast("boolean")).otherwise(F.col("__pin") >= 0)
    return df.withColumn("__pin", F.rand(0)).filter(passes).drop("__pin")


def failed(checks: Sequence[Check]) -> Column:
    """The names of the row checks that a row breaks, as an array."""
    if not checks:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(c.violation, F.lit(c.name)) for c in checks]))


def domain(col: str, allowed: Sequence[Any], exact: bool = False) -> list[Check]:
    """Values within ``allowed`` (null counts as a violation); ``exact`` also
    requires every allowed value to occur."""
    checks = [Check(f"domain:{col}", F.col(col).isNull() | ~F.col(col).isin(list(allowed)))]
    if exact:
        missing = reduce(lambda a, b: a + b, [F.lit(1) - F.coalesce(F.max((F.col(col) == F.lit(a)).cast("int")), F.lit(0)) for a in allowed])
        checks.append(Check(f"domain_all_present:{col}", agg=missing.cast("long")))
    return checks


def in_range(col: str, lo: Any, hi: Any) -> list[Check]:
    return [Check(f"range:{col}", F.col(col).isNull() | ~F.col(col).between(lo, hi))]


def slots(col: str, allowed: Sequence[Any] | None = None, n: int | None = None) -> list[Check]:
    out = []
    if allowed is not None:
        out.append(Check(f"slots:{col}", ~F.col(col).isin(list(allowed))))
    if n is not None:
        out.append(Check(f"n_slots:{col}", agg=F.abs(F.count_distinct(col) - F.lit(n)).cast("long")))
    return out


def onehot_sum(cols: Sequence[str], name: str | None = None) -> list[Check]:
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols])
    return [Check(f"onehot_sum:{name or cols[0].split('_')[0]}", total != 1)]


def rowcount(expected: int) -> list[Check]:
    return [Check("rowcount", agg=F.abs(F.count(F.lit(1)) - F.lit(expected)).cast("long"))]


def expect(df: DataFrame, checks: Sequence[Check], enforce: bool = False) -> DataFrame:
    """All checks in one aggregation -> ``(check, violations, passed)``."""
    aggs = []
    for i, c in enumerate(checks):
        expr = c.agg if c.agg is not None else F.count_if(c.violation)
        aggs.append(expr.cast("long").alias(f"c{i}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c.name).alias("check"), F.col(f"c{i}").alias("violations"))
                     for i, c in enumerate(checks)])
    res = one.select(F.inline(rows)).withColumn("passed", F.col("violations") == 0)
    if enforce:
        bad = res.filter(~F.col("passed")).collect()
        if bad:
            raise GateError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))
    return res


def schema_report(df: DataFrame, cols: Sequence[str], ordered: bool = True, absent: Sequence[str] = (),
                  no_strings: bool = True, allow_strings: Sequence[str] = ()) -> list[tuple[str, int]]:
    """Schema contract, metadata only: (check, violations)."""
    have = df.columns
    out = [("schema:present", sum(c not in have for c in cols)),
           ("schema:absent", sum(c in have for c in absent)),
           ("schema:count", abs(len(have) - len(cols)))]
    if ordered:
        out.append(("schema:order", int(have != list(cols))))
    if no_strings:
        out.append(("schema:no_strings", sum(isinstance(f.dataType, T.StringType) and f.name not in allow_strings
                                             for f in df.schema.fields)))
    return out


def typed(contract: Mapping[str, str]) -> list[Check]:
    """Rows whose column is null or cannot be read as its declared SQL type."""
    return [Check(f"typed:{c}", F.col(c).try_cast(t).isNull()) for c, t in contract.items()]


def schema_check(df: DataFrame, cols: Sequence[str], enforce: bool = False, **kw) -> DataFrame:
    rep = schema_report(df, cols, **kw)
    if enforce and any(v for _, v in rep):
        raise GateError(str([r for r in rep if r[1]]))
    schema = "check string, violations long"
    return (df.sparkSession.createDataFrame(rep, schema).withColumn("passed", F.col("violations") == 0))


def audit_complete(df: DataFrame, audit: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The audit holds exactly one successful row per originally-null cell:
    (initial null cells) - (successful audit rows), computed, not pinned."""
    nulls = df.agg(*[F.count_if(F.col(f"_null_{c}")).alias(c) for c in cols])
    filled = audit.groupBy("column").agg(F.count_if(F.col("fill_successful")).alias("filled"))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])
    return (nulls.select(F.inline(rows)).join(filled, "column", "left")
            .select(F.concat(F.lit("audit_complete:"), F.col("column")).alias("check"),
                    (F.col("nulls") - F.coalesce(F.col("filled"), F.lit(0))).alias("violations"))
            .withColumn("passed", F.col("violations") == 0))
