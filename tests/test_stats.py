import numpy as np
import pandas as pd

from strata.operators import stats as S


def _frame(spark, pdf):
    return spark.createDataFrame(pdf)


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("a", "Street"), ("a", "Highway"), ("a", None), ("b", None)], "k string, v string")
    out = {r.k: r._stat for r in S.group_mode(S.value_bins(df, ["k"], "v"), ["k"], "v").collect()}
    assert out == {"a": "Highway"}  # all-null group b forms no bins -> no statistic


def test_median_exact_matches_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 5, 2000), "v": rng.normal(size=2000).round(2)})
    df = _frame(spark, pdf)
    got = {r.k: r._stat for r in S.group_median(S.value_bins(df, ["k"], "v"), ["k"], "v").collect()}
    for k, g in pdf.groupby("k"):
        assert abs(got[k] - float(np.median(g.v))) < 1e-12


def test_median_refinement_path_matches_numpy(spark):
    rng = np.random.default_rng(2)
    # one hot group with many distinct values and two small ones
    pdf = pd.DataFrame({"k": np.r_[np.zeros(3000, int), np.ones(11, int), np.full(4, 2)],
                        "v": np.r_[rng.exponential(size=3000), rng.normal(size=11), [1.0, 2.0, 2.0, 7.5]]})
    df = _frame(spark, pdf)
    bins = S.value_bins(df, ["k"], "v")
    got = {r.k: r._stat for r in S.group_median(bins, ["k"], "v", max_distinct=50, buckets=16).collect()}
    for k, g in pdf.groupby("k"):
        assert abs(got[k] - float(np.median(g.v))) < 1e-12, k
    glob = S.group_median(S.value_bins(df, [], "v"), [], "v", max_distinct=50, buckets=8).collect()[0]._stat
    assert abs(glob - float(np.median(pdf.v))) < 1e-12


def test_mean_and_count(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = {r.k: (r._stat, r._cnt) for r in S.group_mean(S.value_bins(df, ["k"], "v"), ["k"], "v").collect()}
    assert got == {"a": (2.0, 2), "b": (2.0, 1)}


def test_quantiles_refinement_matches_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.exponential(size=2500)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    bins = S.value_bins(df, [], "v")
    fast = S.quantiles(bins, [], "v", (0.25, 0.5, 0.75), ["a", "b", "c"]).collect()[0]
    slow = S.quantiles(bins, [], "v", (0.25, 0.5, 0.75), ["a", "b", "c"], max_distinct=40).collect()[0]
    exp = np.quantile(v, [0.25, 0.5, 0.75])
    for got in (fast, slow):
        assert all(abs(got[i] - exp[i]) < 1e-12 for i in range(3))


def test_many_ranks_cost_the_rounds_of_one(spark, monkeypatch):
    """All quartiles of all groups are refined together."""
    import strata.session as session
    rows = [(g, float((k * 7919) % 1009) ** 2, 1 + k % 3) for g in "ab" for k in range(900)] + [("c", 1.0, 2)]
    bins = spark.createDataFrame(rows, "g string, v double, _n long")
    calls, real = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, *m: calls.append(1) or real(df, *m))
    one = S.quantiles(bins, ["g"], "v", (0.5,), ["m"], max_distinct=30).orderBy("g").collect()
    rounds = len(calls)
    three = S.quantiles(bins, ["g"], "v", (0.25, 0.5, 0.75), ["a", "m", "z"], max_distinct=30).orderBy("g").collect()
    assert rounds > 3 and len(calls) == 2 * rounds and [r.m for r in one] == [r.m for r in three]
    whole = S.quantiles(bins, ["g"], "v", (0.25, 0.5, 0.75), ["a", "m", "z"]).orderBy("g").collect()
    assert all(abs(x - y) < 1e-9 for p, q in zip(three, whole) for x, y in zip(p[1:], q[1:]))
