"""Serving on a stream.

Cascaded imputation needs group statistics over the whole table, which a
stream does not have. The serving path therefore freezes every tier's
statistic on a reference (batch) table — with the cascade's sequential
semantics — and applies the lookups to new rows in tier order. Everything
downstream (decode, encoders, target lookup, alignment) is row-wise or a
stream-static join, so the same function serves a batch frame and a
streaming one, with no state store and no watermark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.functions.columns import close_vocab
from strata.operators.impute import TierLookup, apply_lookups, freeze_plan
from strata.operators.quality import Check, failed
from strata.operators.relational import align
from strata.operators.target import TargetEncoding, target_encode_apply
from strata.plans import ladders
from strata.plans import pipelines as P


@dataclass
class ServeModel:
    """Everything the serving path needs, fitted once on batch tables."""
    lookups: list[tuple[str, list[TierLookup]]]
    encoding: TargetEncoding


def fit_serve_model(reference: DataFrame, train_raw: DataFrame, plan=None) -> ServeModel:
    """Freeze the serving ladders on ``reference`` (columns in dependency
    order: a later ladder is fitted on the earlier ladders' output) and fit
    the target encoding on the training split of ``train_raw``."""
    frozen = freeze_plan(ladders.with_helpers(reference), plan or ladders.serving_plan())
    return ServeModel(frozen, P.train_encoding_from_raw(train_raw))


def serve_features_frozen(df: DataFrame, model: ServeModel, enforce: bool = True) -> DataFrame:
    """(row_id, 21 ordered features) for a batch or streaming frame. ``enforce``: a
    row that breaks a gate fails the job (on a stream, see ``run_gated_stream`` for
    rows that are set aside instead)."""
    out = ladders.with_helpers(df)
    for col, lk in model.lookups:
        out = apply_lookups(out, col, lk)
    out = P._drop_provenance(ladders.drop_helpers(out))
    out = out.withColumns({"Weather": close_vocab("Weather", P.WEATHERS, "Sunny"),
                           "RoadType": close_vocab("RoadType", P.ROAD_TYPES, "Residential")})
    out = P.encode(P.decode(out, rounded=True), keep_time_parts=False, checks=P.row_checks() if enforce else ())
    out = target_encode_apply(out, model.encoding)
    return align(out, P.FEATURES, keep=["row_id"])


def run_stream(spark: SparkSession, source_dir: str, schema, model: ServeModel, sink_dir: str,
               checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """File stream -> serving features -> parquet sink (append). With
    ``available_now`` every file present is processed and the query stops."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    q = (serve_features_frozen(stream, model).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()


def gated_batch(batch: DataFrame, batch_id: int, features, checks: Sequence[Check], sink_dir: str, quarantine_dir: str, metrics_dir: str) -> dict:
    """One micro-batch: rows that pass go through ``features`` to the sink, the others,
    with the names of the checks they break, to the quarantine, and the counts to
    the metrics table. Each is a folder of its own per batch that is replaced as a
    whole, so a batch that is run again after a failure leaves nothing twice."""
    seen = Observation()
    tagged = batch.withColumn("_failed", failed(checks)).observe(
        seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("_failed") > 0).alias("n_quarantined"),
        *[F.count_if(F.array_contains("_failed", c.name)).alias(c.name) for c in checks]).persist()
    try:
        at = f"batch={batch_id}"
        tagged.where(F.size("_failed") > 0).write.mode("overwrite").parquet(f"{quarantine_dir}/{at}")
        features(tagged.where(F.size("_failed") == 0).drop("_failed")).write.mode("overwrite").parquet(f"{sink_dir}/{at}")
        counts = seen.get
        rows = [(name, int(n)) for name, n in counts.items()]
        batch.sparkSession.createDataFrame(rows, "metric string, n long").coalesce(1).write.mode("overwrite").parquet(f"{metrics_dir}/{at}")
        return counts
    finally:
        tagged.unpersist()


def run_gated_stream(spark: SparkSession, source_dir: str, schema, model: ServeModel, sink_dir: str, quarantine_dir: str,
                     metrics_dir: str, checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """File stream -> gate -> serving features. A bad row lands in the quarantine with
    its reasons, the rest of its micro-batch goes on; counts per check and batch
    are kept (read the three folders with ``spark.read.parquet``; ``batch`` is a column)."""
    def each(batch: DataFrame, batch_id: int) -> None:
        gated_batch(batch, batch_id, lambda good: serve_features_frozen(good, model), P.raw_checks(), sink_dir, quarantine_dir, metrics_dir)

    q = spark.readStream.schema(schema).parquet(source_dir).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()


__all__ = ["ServeModel", "fit_serve_model", "gated_batch", "run_gated_stream", "run_stream", "serve_features_frozen"]
