"""Faults mended once, each held by a test: header order, null keys, integral
medians, empty columns, NaN, gates, plans without doubled scans, bounds."""

import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001
from strata.functions import add_flag
from strata.operators import impute as I
from strata.operators import profile as prof
from strata.operators import quality as qa
from strata.operators import relational as rel
from strata.operators import stats as S
from strata.operators.scale import standardize
from strata.operators.split import split_exact
from strata.operators.target import target_encode_fit
from strata.plans import ladders
from strata.plans import pipelines as P
from strata.sources import io
from strata.sources.fixtures import readings


def relations(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def rows(df):
    return sorted(map(repr, df.collect()))


# --- sources

def test_csv_columns_by_name(spark, tmp_path):
    p = str(tmp_path / "swapped.csv")
    with open(p, "w") as f:
        f.write("b,extra,a\n10,x,1\n#N/A,y,2\n-1.#IND,z,NA\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    assert rows(io.read_csv(spark, p, schema)) == rows(spark.createDataFrame([(1, 10.0), (2, None), (None, None)], schema))
    with pytest.raises(ValueError, match="missing"):
        io.read_csv(spark, p, T.StructType([T.StructField("c", T.IntegerType())]))


def test_submission_gates(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "row_id long, p double")
    with pytest.raises(Exception, match="quality gate"):
        io.submission(df, "row_id", "p").collect()
    assert io.submission(df, "row_id", "p", enforce=False).count() == 2
    ok = df.fillna(0.0)
    assert io.submission(ok, "row_id", "p", expected=df.select("row_id")).count() == 2
    with pytest.raises(qa.GateError):
        io.submission(ok.limit(1), "row_id", "p", expected=df.select("row_id"))
    with pytest.raises(qa.GateError):
        io.submission(ok.unionAll(ok), "row_id", "p", expected=df.select("row_id"))


# --- statistics

def test_null_keys_form_no_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 4.0), ("b", None)], "k string, v double")
    got = {r.k: (r.mean, r.median) for r in prof.group_stats(df, ["k"], "v").collect()}
    assert got == {"a": (2.0, 2.0)}
    assert {r.k: r.n for r in prof.group_count(df, ["k"], "v").collect()} == {"a": 2, "b": 0}
    enc = target_encode_fit(df, "k", "v")
    assert {r.k for r in enc.table.collect()} == {"a"} and enc.global_mean == 2.5 and enc.global_median == 2.5


def test_all_null_column_gives_a_row(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert prof.global_stats(df, "v", ("mean", "median", "mode")).collect()[0].asDict() == {"mean": None, "median": None, "mode": None}
    assert [r.v for r in I.fill_global(df, "v").collect()] == [None, None]
    enc = target_encode_fit(df.withColumn("k", F.lit("a")), "k", "v")
    assert enc.global_mean is None and enc.table.count() == 0


@pytest.mark.parametrize("strategy", ["window", "bins"])
def test_median_of_integers_is_not_cut(spark, strategy):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, None), (2, None)], "k int, v int")
    out = I.impute_cascade(df, "v", [I.Tier("g", ("k",), "median"), I.Tier("all", (), "median")], strategy=strategy)
    pdf = pd.DataFrame({"k": [1, 1, 1, 2], "v": [1.0, 2.0, None, None]})
    pdf["v"] = pdf.v.fillna(pdf.groupby("k").v.transform("median"))
    pdf["v"] = pdf.v.fillna(pdf.v.median())
    assert sorted(r.v for r in out.collect()) == sorted(pdf.v)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, float("nan")), (1, None)], "k int, v double")
    assert [r.v for r in I.impute_cascade(df, "v", [I.Tier("g", ("k",), "mean")]).orderBy("v").collect()] == [1.0, 2.0, 2.0, 3.0]
    assert prof.group_count(df, ["k"], "v").collect()[0].n == 2
    assert prof.global_stats(df, "v", ("median",)).collect()[0][0] == 2.0
    assert {r.column: r.n_null for r in prof.null_profile(df).collect()} == {"k": 0, "v": 2}
    assert I.null_rows(df, ["v"]).count() == 2 and sorted(r.v for r in I.fill_const(df, "v", 9.0).collect()) == [1.0, 3.0, 9.0, 9.0]
    assert I.stack_audit(df, ["v"], row_id="k", context=()).count() == 2


def test_refinement_over_many_magnitudes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.concatenate([10.0 ** rng.uniform(-300, 300, 3000), -(10.0 ** rng.uniform(-300, 300, 500))])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": v}))
    want = {q: float(np.quantile(v, q)) for q in (0.25, 0.5, 0.75)}
    bins = S.value_bins(df, ["k"], "v")
    for q, w in want.items():
        got = S.group_quantile(bins, ["k"], "v", q, max_distinct=20).collect()[0]["_stat"]
        assert got == pytest.approx(w, rel=1e-12)
    # the same above the bound in every caller
    monkeypatch.setattr(S, "MAX_DISTINCT", 100)
    med = pytest.approx(want[0.5], rel=1e-12)
    assert prof.group_stats(df, ["k"], "v", ("median", "count")).collect()[0].asDict() == {"k": "a", "median": med, "count": 3500}
    assert prof.global_stats(df, "v", ("median",)).collect()[0][0] == med
    d = prof.describe(df, ["v"]).collect()[0]
    assert (d.p25, d.p50, d.p75) == tuple(pytest.approx(want[q], rel=1e-12) for q in (0.25, 0.5, 0.75))
    enc = target_encode_fit(df, "k", "v")
    assert enc.global_median == med and enc.table.collect()[0][enc.median_col] == med


# --- imputation plans

PLANS = {"training": ladders.training_plan(), "serving": ladders.serving_plan(), "alt": ladders.alt_plan(),
         "nomin": [("Temperature", ladders.temperature_ladder(min_count=0))]}


@pytest.mark.parametrize("name", PLANS)
def test_both_strategies_agree(spark, name):
    src = ladders.with_helpers(readings(spark, SF001))
    a, b = (I.impute_all(src, PLANS[name], strategy=s) for s in ("window", "bins"))
    assert a.columns == b.columns and rows(a) == rows(b)


def test_large_fills_scan_twice_at_most(spark):
    src = ladders.with_helpers(readings(spark, SF001))
    small = I.impute_all(src, ladders.training_plan())
    large = I.impute_all(src, ladders.training_plan(), broadcast_bytes=-1)
    assert relations(small) == 1 and relations(large) <= 2
    assert rows(small) == rows(large.select(*small.columns))


def test_bins_need_one_scan(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(I, "materialize", lambda df, *m: (seen.append(relations(df)), __import__("strata.session").session.materialize(df, *m))[1])
    I.cascade_fills(ladders.with_helpers(readings(spark, SF001)), "Temperature", ladders.temperature_ladder())
    assert seen[0] == 1 and sum(seen) == 1  # what follows reads the bins


def test_summary_from_fills_equals_the_audit(spark):
    src = ladders.with_helpers(readings(spark, SF001))
    plan = ladders.training_plan()
    audit = I.impute_audit(I.impute_all(src, plan), P.IMPUTED)
    assert rows(I.plan_summary(I.plan_fills(src, plan)).select("column", "rule_used", "n_cells", "n_filled")) == rows(I.rule_summary(audit))


def test_training_jobs(spark):
    sc = spark.sparkContext
    sc.setJobGroup("train-jobs", "count")
    P.train_features(readings(spark, SF001))[0].write.format("noop").mode("overwrite").save()
    n = len(sc.statusTracker().getJobIdsForGroup("train-jobs"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < n < 50


# --- lookups

@pytest.mark.parametrize("bound", [0, 1 << 30])
def test_lookup_bound_in_bytes(spark, bound):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, x int")
    tab = spark.createDataFrame([("a", 10)], "k string, y int")
    out = rel.lookup(df, tab, "k", defaults={"y": 0}, broadcast_bytes=bound, check_unique=True)
    assert sorted((r.x, r.y) for r in out.collect()) == [(1, 10), (2, 0), (3, 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (bound > 0)
    with pytest.raises(ValueError, match="unique"):
        rel.lookup(df, tab.unionAll(tab), "k", check_unique=True)


def test_transform_several_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "k string, v double")
    out = rel.group_transform(df, ["k"], "v", {"m": "median", "c": "count"})
    assert sorted(((r.k, r.v, r.m, r.c) for r in out.collect()), key=repr) == sorted(
        [("a", 1.0, 2.0, 2), ("a", 3.0, 2.0, 2), ("b", None, None, 0), (None, 5.0, None, None)], key=repr)


# --- gates

@pytest.mark.parametrize("col,bad", [("LargeVehicles", "Perhaps"), ("Landmarks", None), ("timestamp", "7:7"), ("geohash", "aaa")])
def test_pipeline_gates_fail_on_a_bad_value(spark, col, bad):
    r = readings(spark, SF001)
    broken = r.withColumn(col, F.when(F.col("row_id") == r.agg(F.min("row_id")).collect()[0][0], F.lit(bad).cast("string")).otherwise(F.col(col)))
    if col != "geohash":
        with pytest.raises(Exception, match="quality gate"):
            P.train_features(broken)[0].write.format("noop").mode("overwrite").save()
        P.train_features(broken, enforce=False)[0].write.format("noop").mode("overwrite").save()
    with pytest.raises(Exception, match="quality gate"):
        P.serve_features(broken.drop("demand"), r).write.format("noop").mode("overwrite").save()


def test_exact_domain_counts_missing_values(spark):
    df = spark.createDataFrame([("a",), ("b",), ("junk",), (None,)], "c string")
    got = {r.check: r.violations for r in qa.expect(df, qa.domain("c", ["a", "b", "z"], exact=True)).collect()}
    assert got == {"domain:c": 2, "domain_all_present:c": 1}


def test_typed_contract(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "c string")
    assert qa.expect(df, qa.typed({"c": "int"})).collect()[0].violations == 2


# --- small pieces

def test_add_flag_keeps_an_existing_one(spark):
    df = spark.createDataFrame([(49, 7)], "day int, f int")
    assert add_flag(df, "day", 49, "f").collect()[0].f == 7
    assert add_flag(df, "day", 49, "f", keep_existing=False).collect()[0].f == 1


def test_standardize_other_frames(spark):
    a = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    b = spark.createDataFrame([(5.0,)], "x double")
    fitted, (other,), params = standardize(a, [b], ["x"])
    assert [r.x for r in fitted.collect()] == [-1.0, 1.0] and other.collect()[0].x == 3.0 and params["x"] == (2.0, 1.0)


def test_split_goes_on_until_the_bucket_is_small(spark):
    df = spark.range(3000).withColumnRenamed("id", "row_id")
    a = split_exact(df).filter("is_val")
    from strata.operators import split as sp
    cut = sp.split_cutoff(df, "row_id", direct_rows=0)
    assert a.count() == 600 and df.filter(sp.split_flag("row_id", cut)).count() == 600


def test_gbt_uses_the_validation_rows(spark):
    from strata.operators.model import fit_regressor
    df = spark.createDataFrame([(float(i), float(i % 7), i % 5 == 0) for i in range(200)], "x double, y double, is_val boolean")
    m = fit_regressor(df, ["x"], "y", is_val="is_val", kind="gbt", max_iter=5).stages[-1]
    assert m.getOrDefault("validationIndicatorCol") == "is_val" and 1 <= m.getNumTrees <= 5


def test_linear_fit_on_all_features_is_not_collinear(spark):
    from strata.operators.model import fit_regressor
    df, _ = P.train_features(readings(spark, SF001))
    m = fit_regressor(df, P.LINEAR_FEATURES, "demand", is_val="is_val").stages[-1]
    assert len(m.coefficients) == 19 and np.isfinite(m.coefficients.toArray()).all()


def test_scoring_needs_no_package_on_the_workers(tmp_path):
    code = """
import sys; sys.path.insert(0, {repo!r})
from strata.session import local_session
from strata.operators import model as M
s = local_session(2, extra={{"spark.driver.memory": "1g"}})
df = s.range(4).selectExpr("id as row_id", "double(id) as a", "double(1) as b")
print("SCORED", M.mlp_score(df, ["a", "b"], M.init_mlp_weights(2, hidden=(4, 3, 2))).count())
""".format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONNECT_MODE")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "SCORED 4" in out.stdout, out.stderr[-2000:]
