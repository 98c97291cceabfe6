"""Metrics, residuals, distributed model fitting and batch scoring.

Metrics are one aggregation each. Scoring a fixed network runs in
``mapInPandas`` over Arrow batches with the weights broadcast once (the only
Python boundary in the library). Fitting uses ``pyspark.ml`` estimators.
"""

from __future__ import annotations

from collections.abc import Sequence

import sys

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import residual, score100


def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """n, R^2 (coefficient of determination, not squared correlation),
    ``max(0, 100*R^2)``, RMSE, MAE — one pass. A constant target gives R^2 1
    when predicted perfectly, else 0."""
    err = F.col(y) - F.col(pred)
    g = df.groupBy(*by) if by else df
    m = g.agg(F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("_ss_res"),
              (F.var_pop(y) * F.count(F.lit(1))).alias("_ss_tot"),
              F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))
    r2 = (F.when(F.col("_ss_tot") > 0, F.lit(1.0) - F.col("_ss_res") / F.col("_ss_tot"))
          .when(F.col("_ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return m.select(*by, "n", r2.alias("r2"), score100(r2).alias("score"), "rmse", "mae")


def prediction_stats(df: DataFrame, pred: str) -> DataFrame:
    p = F.col(pred)
    return df.agg(F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"),
                  F.stddev_pop(p).alias("std"), F.count_if(p < 0).alias("n_negative"))


def residual_table(df: DataFrame, y: str, pred: str, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    err, abs_err = residual(y, pred)
    return df.select(*keep, F.col(y).alias("actual"), F.col(pred).alias("predicted"),
                     err.alias("error"), abs_err.alias("abs_error"))


# The forward pass goes to the Python workers by value: they need no copy of this package.
register_pickle_by_value(sys.modules[__name__])


# --- fixed network scoring ---------------------------------------------------------

# Layer layout of the scored network (Linear, BatchNorm, ReLU, Dropout blocks, then a
# Linear head), addressed by the positional parameter names of a sequential model.
HIDDEN = (256, 128, 64)
BN_EPS = 1e-5


def mlp_layout(in_dim: int, hidden: Sequence[int] = HIDDEN) -> list[tuple[str, int, int]]:
    """[(name prefix, fan_in, fan_out)] of the linear layers; each hidden
    linear at index 4*i is followed by its BatchNorm at 4*i+1."""
    dims = [in_dim, *hidden, 1]
    return [(f"network.{4 * i}", dims[i], dims[i + 1]) for i in range(len(dims) - 1)]


def init_mlp_weights(in_dim: int, hidden: Sequence[int] = HIDDEN) -> dict[str, np.ndarray]:
    """Deterministic parameters (linears by a formula, identity BatchNorm) for a
    network of this layout — a stand-in where no trained checkpoint exists.
    ``weight[o, i] = sin(12.9898 * (o * fan_in + i + 1) + layer) * sqrt(6 / fan_in)``."""
    w: dict[str, np.ndarray] = {}
    layout = mlp_layout(in_dim, hidden)
    for i, (name, fi, fo) in enumerate(layout):
        at = np.arange(1, fo * fi + 1, dtype=np.float64)
        w[f"{name}.weight"] = (np.sin(12.9898 * at + i) * np.sqrt(6.0 / fi)).reshape(fo, fi)
        w[f"{name}.bias"] = np.zeros(fo)
        if i < len(layout) - 1:
            bn = f"network.{4 * i + 1}"
            w[f"{bn}.weight"] = np.ones(fo)
            w[f"{bn}.bias"] = np.zeros(fo)
            w[f"{bn}.running_mean"] = np.zeros(fo)
            w[f"{bn}.running_var"] = np.ones(fo)
    return w


def weights_from_table(table: DataFrame) -> dict[str, np.ndarray]:
    """Weights table -> arrays. Bounded by the model size, not the data."""
    return {r["name"]: np.asarray(r["values"], dtype=np.float64).reshape(r["shape"]) for r in table.collect()}


def mlp_forward(x: np.ndarray, w: dict[str, np.ndarray], n_layers: int) -> np.ndarray:
    """Eval-mode forward pass (dropout is the identity, BatchNorm uses running stats)."""
    h = x.astype(np.float64)
    for i in range(n_layers):
        name = f"network.{4 * i}"
        h = h @ w[f"{name}.weight"].T + w[f"{name}.bias"]
        if i < n_layers - 1:
            bn = f"network.{4 * i + 1}"
            h = (h - w[f"{bn}.running_mean"]) / np.sqrt(w[f"{bn}.running_var"] + BN_EPS)
            h = h * w[f"{bn}.weight"] + w[f"{bn}.bias"]
            h = np.maximum(h, 0.0)
    return h[:, 0]


def mlp_score(df: DataFrame, features: Sequence[str], weights: dict[str, np.ndarray],
              keep: Sequence[str] = ("row_id",), out: str = "prediction") -> DataFrame:
    """Batch inference with ``mapInPandas``: the weights go out once as a
    broadcast variable; each Arrow batch (``spark.sql.execution.arrow.
    maxRecordsPerBatch`` rows) is one matrix product chain in double precision."""
    spark = df.sparkSession
    bw = spark.sparkContext.broadcast(weights)
    n_layers = sum(1 for k in weights if k.endswith(".weight") and f"{k[:-7]}.running_mean" not in weights)
    feats, keep = list(features), list(keep)
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField(out, T.DoubleType())])

    def score(batches):
        w = bw.value
        for pdf in batches:
            y = mlp_forward(pdf[feats].to_numpy(dtype=np.float64), w, n_layers)
            res = pdf[keep].copy()
            res[out] = y.astype(np.float64)
            yield res

    return df.select(*dict.fromkeys([*keep, *feats])).mapInPandas(score, schema)


def fit_regressor(df: DataFrame, features: Sequence[str], y: str, is_val: str | None = None,
                  kind: str = "linear", seed: int = 42, max_iter: int = 50):
    """Fit a ``pyspark.ml`` regressor on the training rows. ``gbt`` stops early
    on the validation rows (``validationIndicatorCol``); ``linear`` fits the
    training rows only. Returns the fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    asm = VectorAssembler(inputCols=list(features), outputCol="_features")
    if kind == "gbt":
        est = GBTRegressor(featuresCol="_features", labelCol=y, predictionCol="prediction", maxIter=max_iter,
                           seed=seed, **({"validationIndicatorCol": is_val} if is_val else {}))
        train = df
    elif kind == "linear":
        est = LinearRegression(featuresCol="_features", labelCol=y, predictionCol="prediction",
                               maxIter=max_iter, regParam=0.0)
        train = df.filter(~F.col(is_val)) if is_val else df
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return Pipeline(stages=[asm, est]).fit(train)

