"""Fitted preparations that can be saved: Spark ML estimators and models for the
ladders, the encoders, the target encoding, the scaler and the network.

A model is its metadata (JSON) and its tables (Parquet), written below one path of
the shared store; loaded again it needs no data to be fitted on. They chain in
``pyspark.ml.Pipeline`` and are saved and loaded with ``PipelineModel``. Transforming
is row-wise expressions and lookup joins only, so a loaded model serves a stream
as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.columns import Bands, close_vocab
from strata.operators import scale
from strata.operators.impute import Plan, Tier, TierLookup, apply_lookups, freeze_plan, prov_cols
from strata.operators.model import mlp_score, weights_from_table
from strata.operators.network import Schedule, fit_network
from strata.operators.relational import align
from strata.operators.target import TargetEncoding, target_encode_apply, target_encode_fit
from strata.plans import ladders
from strata.plans import pipelines as P


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        content, tables = self.instance._content()
        for name, df in tables.items():
            df.write.parquet(f"{path}/tables/{name}")
        # the metadata comes last: without it, what a lost driver left is no model
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"content": content, "tables": sorted(tables)})


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls._of(spark, meta["content"], {n: spark.read.parquet(f"{path}/tables/{n}") for n in meta["tables"]})
        return model._resetUid(meta["uid"])


class Saved(MLWritable, MLReadable):
    """Something whose state is ``_content() -> (JSON value, tables by name)`` and
    that ``_of(spark, content, tables)`` makes again."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


# --- ladders


def _tier_content(t: Tier) -> dict[str, Any]:
    if t.derive is not None and not isinstance(t.derive, Bands):
        raise ValueError(f"tier {t.rule!r} derives by a Python function, which cannot be saved; use Bands")
    derive = None if t.derive is None else {"bands": [list(b) for b in t.derive.bands], "else_label": t.derive.else_label, "null_label": t.derive.null_label}
    return {"rule": t.rule, "keys": list(t.keys), "stat": t.stat, "min_count": t.min_count, "derive": derive, "derive_from": t.derive_from, "value": t.value}


def _tier(c: dict[str, Any]) -> Tier:
    derive = c["derive"] and Bands(tuple(tuple(b) for b in c["derive"]["bands"]), c["derive"]["else_label"], c["derive"]["null_label"])
    return Tier(**{**c, "keys": tuple(c["keys"]), "derive": derive})


class LadderModel(Model, Saved):
    """Frozen ladders: every tier's statistic on the table it was fitted on."""

    def __init__(self, lookups: Sequence[tuple[str, list[TierLookup]]] = (), provenance: bool = False):
        super().__init__()
        self.lookups, self.provenance = list(lookups), provenance

    def _transform(self, df: DataFrame) -> DataFrame:
        out = ladders.with_helpers(df)
        for col, lk in self.lookups:
            out = apply_lookups(out, col, lk)
        out = ladders.drop_helpers(out)
        return out if self.provenance else out.drop(*[p for col, _ in self.lookups for p in prov_cols(col)])

    def _content(self):
        content, tables = [], {}
        for col, lk in self.lookups:
            rungs = []
            for k, one in enumerate(lk):
                name = f"{col}-{k}" if one.table is not None else None
                if name:
                    tables[name] = one.table
                rungs.append({"tier": _tier_content(one.tier), "table": name, "n_bytes": one.n_bytes, "value": one.value})
            content.append([col, rungs])
        return {"ladders": content, "provenance": self.provenance}, tables

    @classmethod
    def _of(cls, spark, content, tables):
        return cls([(col, [TierLookup(_tier(r["tier"]), tables.get(r["table"]), r["n_bytes"], r["value"]) for r in rungs]) for col, rungs in content["ladders"]],
                   content["provenance"])


class LadderImputer(Estimator):
    """Freezes the ladders of ``plan`` (columns in dependency order) on a table."""

    def __init__(self, plan: Plan, provenance: bool = False):
        super().__init__()
        self.plan, self.provenance = plan, provenance

    def _fit(self, df: DataFrame) -> LadderModel:
        return LadderModel(freeze_plan(ladders.with_helpers(df), self.plan), self.provenance)


# --- encoders


class ReadingsEncoder(Transformer, Saved):
    """Closed vocabularies, coordinates, binary maps, time of day, one-hots and the day
    flag, with their gates; nothing to fit."""

    def __init__(self, rounded: bool = True, keep_time_parts: bool = False, enforce: bool = True):
        super().__init__()
        self.settings = {"rounded": rounded, "keep_time_parts": keep_time_parts, "enforce": enforce}

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.settings
        df = df.withColumns({"Weather": close_vocab("Weather", P.WEATHERS, "Sunny"), "RoadType": close_vocab("RoadType", P.ROAD_TYPES, "Residential")})
        return P.encode(P.decode(df, rounded=s["rounded"]), keep_time_parts=s["keep_time_parts"], checks=P.row_checks() if s["enforce"] else ())

    def _content(self):
        return self.settings, {}

    @classmethod
    def _of(cls, spark, content, tables):
        return cls(**content)


class Columns(Transformer, Saved):
    """The exact ordered columns, after the identity columns; a missing one fails."""

    def __init__(self, columns: Sequence[str], keep: Sequence[str] = ("row_id",)):
        super().__init__()
        self.columns, self.keep = list(columns), list(keep)

    def _transform(self, df: DataFrame) -> DataFrame:
        return align(df, self.columns, keep=self.keep)

    def _content(self):
        return {"columns": self.columns, "keep": self.keep}, {}

    @classmethod
    def _of(cls, spark, content, tables):
        return cls(**content)


# --- target encoding and scaler


class TargetEncodingModel(Model, Saved):
    def __init__(self, encoding: TargetEncoding):
        super().__init__()
        self.encoding = encoding

    def _transform(self, df: DataFrame) -> DataFrame:
        return target_encode_apply(df, self.encoding)

    def _content(self):
        e = self.encoding
        return {"key": e.key, "mean_col": e.mean_col, "median_col": e.median_col, "global_mean": e.global_mean, "global_median": e.global_median, "n_bytes": e.n_bytes}, {"statistics": e.table}

    @classmethod
    def _of(cls, spark, content, tables):
        return cls(TargetEncoding(tables["statistics"], **content))


class TargetEncoder(Estimator):
    """Mean and exact median of ``y`` per ``key`` on the table given (training rows)."""

    def __init__(self, key: str, y: str, prefix: str | None = None):
        super().__init__()
        self.key, self.y, self.prefix = key, y, prefix

    def _fit(self, df: DataFrame) -> TargetEncodingModel:
        return TargetEncodingModel(target_encode_fit(df, self.key, self.y, self.prefix))


class StandardizerModel(Model, Saved):
    """``(x - mean) / population std``; a zero std divides by 1."""

    def __init__(self, params: dict[str, tuple[float, float]]):
        super().__init__()
        self.params_by_column = {c: (m, s) for c, (m, s) in params.items()}

    def _transform(self, df: DataFrame) -> DataFrame:
        return scale.scaler_apply(df, self.params_by_column)

    def _content(self):
        return {c: list(v) for c, v in self.params_by_column.items()}, {}

    @classmethod
    def _of(cls, spark, content, tables):
        return cls({c: tuple(v) for c, v in content.items()})


class Standardizer(Estimator):
    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, df: DataFrame) -> StandardizerModel:
        return StandardizerModel(scale.scaler_params(scale.scaler_fit(df, self.columns), self.columns))


# --- network


class NetworkModel(Model, Saved):
    """Batch inference of a fitted network; adds the prediction column."""

    def __init__(self, weights: dict[str, np.ndarray], features: Sequence[str], prediction: str = "prediction"):
        super().__init__()
        self.weights, self.features, self.prediction = weights, list(features), prediction

    def _transform(self, df: DataFrame) -> DataFrame:
        return mlp_score(df, self.features, self.weights, keep=df.columns, out=self.prediction)

    def _content(self):
        rows = [(k, [int(n) for n in v.shape], [float(x) for x in v.ravel()]) for k, v in self.weights.items()]
        table = SparkSession.active().createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1)
        return {"features": self.features, "prediction": self.prediction}, {"weights": table}

    @classmethod
    def _of(cls, spark, content, tables):
        return cls(weights_from_table(tables["weights"]), **content)


class NetworkRegressor(Estimator):
    """``network.fit_network`` as an estimator; ``path`` is the run's folder on the
    shared store, where a run that was lost goes on."""

    def __init__(self, features: Sequence[str], y: str, path: str, is_val: str = "is_val", row_id: str = "row_id", schedule: Schedule = Schedule(), prediction: str = "prediction"):
        super().__init__()
        self.features, self.y, self.path, self.is_val, self.row_id, self.schedule, self.prediction = list(features), y, path, is_val, row_id, schedule, prediction

    def _fit(self, df: DataFrame) -> NetworkModel:
        weights, _ = fit_network(df, self.features, self.y, self.path, self.is_val, self.row_id, self.schedule)
        return NetworkModel(weights, self.features, self.prediction)


# --- whole preparations


def fit_serving(reference: DataFrame, train_raw: DataFrame, plan: Plan | None = None) -> PipelineModel:
    """The serving path as one model that can be saved: ladders frozen on ``reference``,
    target statistics of ``train_raw``'s training split, encoders and the ordered
    contract. On ``reference`` itself it gives what ``serve_features`` gives."""
    return PipelineModel([LadderImputer(plan or ladders.serving_plan()).fit(reference), ReadingsEncoder(rounded=True),
                          TargetEncodingModel(P.train_encoding_from_raw(train_raw)), Columns(P.FEATURES)])


def fit_scoring(train_features: DataFrame, path: str, schedule: Schedule = Schedule()) -> PipelineModel:
    """Scaler (on the training rows) and network, from ``train_features``'s output."""
    scaler = Standardizer(P.CONTINUOUS).fit(train_features.filter(~F.col("is_val")))
    network = NetworkRegressor(P.FEATURES, "demand", path, schedule=schedule).fit(scaler.transform(train_features))
    return PipelineModel([scaler, network])
