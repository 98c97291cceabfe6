import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from strata.operators import model as M
from strata.operators.scale import scaler_apply, scaler_fit, scaler_params
from strata.operators.split import split_cutoff, split_exact
from strata.operators.target import target_encode_apply, target_encode_fit


def test_split_exact_size_and_set(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet").select(F.col("event_id").alias("row_id"))
    s = split_exact(ev)
    n = ev.count()
    val = {r.row_id for r in s.filter("is_val").collect()}
    assert len(val) == math.ceil(0.2 * n)
    ref = duckdb.sql(f"SELECT event_id FROM '{SF01}/events.parquet' QUALIFY row_number() OVER "
                     f"(ORDER BY md5(CAST(event_id AS VARCHAR) || ':42')) <= ceil(0.2 * count(*) OVER ())").fetchall()
    assert val == {r[0] for r in ref}
    # deterministic under repartitioning, and the multi-level path agrees with the direct one
    assert split_cutoff(ev.repartition(7), "row_id") == split_cutoff(ev, "row_id", direct_rows=0)


def test_target_encoding_unseen_key_gets_global(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "g string, y double")
    enc = target_encode_fit(train, "g", "y", prefix="t")
    assert enc.global_mean == 14.0 / 3 and enc.global_median == 3.0
    test = spark.createDataFrame([("a",), ("zz",)], "g string")
    got = {r.g: (r.t_mean, r.t_median) for r in target_encode_apply(test, enc).collect()}
    assert got == {"a": (2.0, 2.0), "zz": (14.0 / 3, 3.0)}


def test_scaler_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (6.0, 5.0)], "x double, c double")
    p = scaler_params(scaler_fit(df, ["x", "c"]), ["x", "c"])
    assert abs(p["x"][1] - np.std([1, 2, 3, 6])) < 1e-12  # ddof=0
    out = scaler_apply(df, p).collect()
    assert all(r.c == 0.0 for r in out)


def test_regression_metrics(spark):
    y = [1.0, 2.0, 3.0, 4.0]
    p = [1.5, 2.0, 2.0, 5.0]
    df = spark.createDataFrame(list(zip(y, p)), "y double, p double")
    m = M.regression_metrics(df, "y", "p").collect()[0]
    ss_res = sum((a - b) ** 2 for a, b in zip(y, p))
    ss_tot = sum((a - np.mean(y)) ** 2 for a in y)
    assert abs(m.r2 - (1 - ss_res / ss_tot)) < 1e-12
    assert abs(m.rmse - math.sqrt(ss_res / 4)) < 1e-12 and abs(m.mae - 0.625) < 1e-12
    const = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert M.regression_metrics(const, "y", "p").collect()[0].r2 == 1.0
    const2 = spark.createDataFrame([(2.0, 1.0), (2.0, 2.0)], "y double, p double")
    assert M.regression_metrics(const2, "y", "p").collect()[0].r2 == 0.0


def test_mlp_score_matches_numpy(spark):
    w = M.init_mlp_weights(3, hidden=(8, 4, 2))
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "row_id long, a double, b double, c double")
    got = {r.row_id: r.prediction for r in M.mlp_score(df, ["a", "b", "c"], w).collect()}
    exp = M.mlp_forward(x, w, 4)
    assert all(abs(got[i] - float(exp[i])) < 1e-6 for i in range(50))
