"""Connected components of a link table, without collecting links anywhere.

Every round works on edges only (two columns of ids): each task first merges the
edges it holds into a spanning forest, then alternating *large-star* and
*small-star* steps (an aggregate and a join per step) pull every node towards
the smallest id of its component. A star of any size is rows of a join, which
adaptive execution splits; no neighbour list is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage, ships_by_value

#: Edges merged at once inside a task.
TASK_EDGES = 1_000_000


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the pairs (i, j)."""
    lab = np.arange(n)
    while len(i):
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
        open_ = lab[i] != lab[j]
        i, j = i[open_], j[open_]
    while not np.array_equal(lab[lab], lab):
        lab = lab[lab]
    return lab


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(parts):
        u = np.concatenate([p[0] for p in parts])
        v = np.concatenate([p[1] for p in parts])
        ids, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
        lab = forest(inv[: len(u)], inv[len(u):], len(ids))
        keep = np.flatnonzero(lab != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[lab[keep]])], names=["u", "v"])

    parts, held = [], 0
    for b in batches:
        if b.num_rows:
            parts.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            held += b.num_rows
            if held >= TASK_EDGES:
                yield flush(parts)
                parts, held = [], 0
    if parts:
        yield flush(parts)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(low, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def state() -> list[Column]:
    """Aggregates that differ for different sets of edges, of any number: a sum
    of hashes would leave 64 bits."""
    return [F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "v", "u")).alias("y")]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` that is not its
    component's smallest id; ``component`` is the smallest id reachable.

    Null ends and loops are ignored, repeated edges count once; an empty table
    gives an empty result. Ids are 64-bit integers.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v")
    e = cut_lineage(e.mapInArrow(_merge, "u long, v long").distinct())
    mark = None
    while True:
        row = e.agg(*state(), F.count_distinct("u").alias("nu")).collect()[0]
        if row["n"] == 0:
            break
        if row["n"] == row["nu"]:
            # every node has one parent; done when no parent has a parent itself
            if e.alias("x").join(e.alias("y"), F.col("x.v") == F.col("y.u"), "left_semi").isEmpty():
                break
        now = (row["n"], row["x"], row["y"])
        if now == mark:
            break
        mark = now
        e = cut_lineage(_small_star(_large_star(e)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


ships_by_value(__name__)
