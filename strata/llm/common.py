"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import BROADCAST_BYTES, cut_lineage, ensure_checkpoint_dir, materialize

__all__ = ["ascii_lower", "cut_lineage", "rows_of", "shared_path", "ships_by_value", "table", "task_slices", "without"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ships_by_value(module_name: str) -> None:
    """Pickle a module's functions by value, so that Python workers need no copy
    of this package on their path."""
    register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder, as a URI."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("/"):
        base = f"file://{base}"
    elif base.startswith("file:/") and not base.startswith("file://"):
        base = f"file://{base[len('file:'):]}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def ascii_lower(col):
    """Lower-case A-Z only, whatever the locale or script."""
    return F.translate(col, _UPPER, _UPPER.lower())


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches, one at a time (a batch's texts are never all
    Python strings at once)."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in cols)


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in the one column of ``ids``; rows
    without an id stay. The ids are broadcast if their measured bytes allow."""
    ids, m = materialize(ids.toDF("_gone_id").where("_gone_id is not null").distinct())
    gone = F.broadcast(ids) if m["bytes"] <= BROADCAST_BYTES else ids
    return docs.join(gone, docs[id_col] == gone["_gone_id"], "left_anti")


def task_slices(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], weigh, limit: int) -> Iterator[list[tuple]]:
    """Lists of rows whose summed ``weigh(row)`` reaches ``limit`` (one heavier
    row makes a list of its own); bounds what a task holds at once."""
    held, weight = [], 0
    for row in rows_of(batches, *names):
        w = weigh(row)
        if held and weight + w > limit:
            yield held
            held, weight = [], 0
        held.append(row)
        weight += w
    if held:
        yield held


ships_by_value(__name__)
