"""Ladders kept up to date: the bins of a plan as a state that grows with a stream.

Bins are counts, so the bins of all rows so far are the sum of the old ones and those
of a micro-batch. Each micro-batch writes the new state into the next of three
slots and then appends a pointer row to it; readers follow the pointer of the last
batch, so they never see a half-written state, and a batch that is run again after a
failure starts from the state before it and replaces its own. Lookups fitted on the
state equal a refit on all rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators.impute import Plan, merge_bins, plan_bins, plan_lookups
from strata.plans import ladders
from strata.plans.fitted import LadderModel

#: States kept: the current one, the one before (for readers) and the next.
SLOTS = 3
_POINTER = "batch long, slot int, n_bins long"


def _pointer(spark: SparkSession, path: str, before: int | None = None):
    """The pointer row of the last batch (before one)."""
    try:
        rows = spark.read.schema(_POINTER).parquet(f"{path}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.orderBy(F.desc("batch")).limit(1).first()


def update(batch: DataFrame, batch_id: int, plan: Plan, path: str) -> None:
    """Add one micro-batch of readings to the state at ``path`` (shared store)."""
    spark = batch.sparkSession
    last = _pointer(spark, path, batch_id)
    bins = plan_bins(ladders.with_helpers(batch), plan)
    if last is not None:
        bins = merge_bins(spark.read.schema(bins.schema).parquet(f"{path}/slot-{last['slot']}"), bins)
    slot = (last["slot"] + 1) % SLOTS if last is not None else 0
    bins.write.mode("overwrite").parquet(f"{path}/slot-{slot}")
    n = spark.read.parquet(f"{path}/slot-{slot}").count()
    spark.createDataFrame([(batch_id, slot, n)], _POINTER).coalesce(1).write.mode("append").parquet(f"{path}/pointers")


def current(spark: SparkSession, plan: Plan, path: str) -> LadderModel:
    """The ladders as the current state has them, ready to impute or to be saved."""
    at = _pointer(spark, path)
    if at is None:
        raise ValueError(f"{path} holds no ladder state yet")
    return LadderModel(plan_lookups(spark.read.parquet(f"{path}/slot-{at['slot']}"), plan, at["n_bins"]))


def run_ladder_stream(spark: SparkSession, source_dir: str, schema, plan: Plan, path: str, checkpoint_dir: str, available_now: bool = True,
                      files_per_batch: int | None = None) -> StreamingQuery:
    """File stream of readings -> ladder state."""
    reader = spark.readStream.schema(schema)
    reader = reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)
    q = reader.parquet(source_dir).writeStream.foreachBatch(lambda batch, i: update(batch, i, plan, path)).option("checkpointLocation", checkpoint_dir)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()
