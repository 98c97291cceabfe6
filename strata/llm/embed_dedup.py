"""Embedding near-duplicates: PCA-ordered tiled comparison.

1. Equal embeddings form one class; only its smallest id is compared, with the
   class size as its weight.
2. The principal axes come from one aggregation of the second moments (one
   dim x dim matrix). Vectors are normalised in double precision and rotated, so
   that leading dimensions tell most.
3. Linked vectors lie within sqrt(2 - 2t) of each other in every direction. The
   first two axes are cut into cells of that width; a vector meets its own cell
   and the neighbours only, over an equi-join on cells. Cells are dealt in tiles
   of bounded rows, and each pair of tiles meets in one place, so a hot cell is
   spread over its pairs of tiles.
4. In a pair of tiles, products of the leading dimensions are formed first; what
   the others can add is at most the product of the suffix norms. Pairs that
   can't reach the threshold stop there, the rest go on with more dimensions. What is left is decided by the
   cosine of the vectors themselves in double precision.
5. A pair of tiles returns weighted link counts per vector and a spanning forest
   of the links, never the links; components are found on the forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage, ships_by_value
from strata.llm.components import connected_components, forest

THRESHOLD = 0.95
#: Rows of a tile, and of the strips of a tile that are compared at once.
TILE, STRIP = 4096, 256
#: Dimensions summed before the first and the second test.
LEADING, SECOND = 16, 32
#: Room for rounding in the bounds (the first is formed in single precision, of
#: numbers up to 1); the decision itself has none.
ROUGH, SLACK = 1e-5, 1e-9
#: Linked pairs a task holds before it merges them into its forest.
HELD_PAIRS = 2_000_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that can link with others, as bytes of doubles; with their length."""
    for b in batches:
        ids, vecs, dims = [], [], []
        for i, v in zip(b.column(0), b.column(1)):
            if v.is_valid and len(v) and not v.values.null_count:
                x = v.values.to_numpy().astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(i.as_py())
                    vecs.append((x + 0.0).tobytes())  # -0.0 is 0.0
                    dims.append(len(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "v", "dim"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # norms neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1))[:, None]


def principal_axes(reps: DataFrame, dim: int) -> np.ndarray:
    """Columns are the axes of the second moments of the unit vectors, largest
    first. The driver receives dim * dim sums."""
    def moments(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column(0), dim))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["at", "s"])

    rows = reps.select("v").mapInArrow(moments, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    m = np.zeros(dim * dim)
    for r in rows:
        m[r["at"]] = r["s"]
    _, axes = np.linalg.eigh(m.reshape(dim, dim))
    return axes[:, ::-1].copy()


def _tile_links(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, threshold: float, same: bool):
    """Linked pairs (rows of a, rows of b) of two tiles, strip by strip.

    ``a``, ``b`` are unit vectors, ``pa_``, ``pb`` the same rotated to the axes.
    """
    d = a.shape[1]
    first, second = min(LEADING, d), min(SECOND, d)
    # the product of the suffix norms joins the sum as one more dimension
    rough_a = np.concatenate([pa_[:, :first], np.sqrt((pa_[:, first:] ** 2).sum(1))[:, None]], 1).astype(np.float32)
    rough_b = np.concatenate([pb[:, :first], np.sqrt((pb[:, first:] ** 2).sum(1))[:, None]], 1).astype(np.float32).T.copy()
    rest_a, rest_b = np.sqrt((pa_[:, second:] ** 2).sum(1)), np.sqrt((pb[:, second:] ** 2).sum(1))
    for s in range(0, len(a), STRIP):
        e = min(len(a), s + STRIP)
        at = np.flatnonzero((rough_a[s:e] @ rough_b).ravel() >= threshold - ROUGH)
        if not len(at):
            continue
        i, j = s + at // len(b), at % len(b)
        if same:
            up = i < j
            i, j = i[up], j[up]
        if len(i) > 0.2 * (e - s) * len(b):  # most go on: whole products are cheaper
            full = a[s:e] @ b.T
            linked = full[i - s, j] >= threshold
            yield i[linked], j[linked]
            continue
        for k in range(0, len(i), 1 << 17):
            x, y = i[k:k + (1 << 17)], j[k:k + (1 << 17)]
            on = np.einsum("ij,ij->i", pa_[x, :second], pb[y, :second]) + rest_a[x] * rest_b[y] >= threshold - SLACK
            x, y = x[on], y[on]
            linked = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            yield x[linked], y[linked]


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

        def finish(rows: list[pa.RecordBatch]):
            ids, w, side = (np.concatenate([b.column(c).to_numpy() for b in rows]) for c in (0, 1, 2))
            dim = rows[0].column(3)[0].as_py()
            u = _unit(np.concatenate([_matrix(b.column(4), dim) for b in rows]))
            p = u @ axes[dim]
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            same = not len(right)
            if not len(left):
                return
            if same:
                right = left
            n = np.zeros(len(ids), np.int64)
            hi, hj, held = [], [], 0

            def merge():
                lab = forest(np.concatenate(hi), np.concatenate(hj), len(ids))
                moved = np.flatnonzero(lab != np.arange(len(ids)))
                return [moved], [lab[moved]], 0

            for x, y in _tile_links(u[left], u[right], p[left], p[right], threshold, same):
                x, y = left[x], right[y]
                n += np.bincount(x, weights=w[y], minlength=len(ids)).astype(np.int64) + np.bincount(y, weights=w[x], minlength=len(ids)).astype(np.int64)
                hi.append(x)
                hj.append(y)
                held += len(x)
                if held > HELD_PAIRS:
                    hi, hj, held = merge()
            if hi:
                hi, hj, held = merge()
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(n[has]), pa.nulls(len(has), pa.int64())], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hi[0]]), pa.array(np.zeros(len(hi[0]), np.int64)), pa.array(ids[hj[0]])], schema=schema)

        held, key = [], None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in (5, 6)]
            if not b.num_rows:
                continue
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            cuts = [0, *change.tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                now = (cols[0][s], cols[1][s])
                if now != key and held:
                    yield from finish(held)
                    held = []
                key = now
                held.append(b.slice(s, e - s))
        if held:
            yield from finish(held)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, as do rows without an id, and vectors of different lengths
    with each other.
    Repeated rows (ids are meant to be unique) link as if they were others.
    Extra columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].alias("embedding"))
    usable = cut_lineage(rows.where("vec_id is not null").mapInArrow(_usable, "vec_id long, v binary, dim int"))
    classes = usable.groupBy("v", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    reps = cut_lineage(classes)
    dims = [r["dim"] for r in reps.select("dim").distinct().collect()]  # lengths of vectors: a few
    axes = {d: principal_axes(reps.where(F.col("dim") == d), d) for d in dims}
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {}
            for d in np.unique(b.column(1).to_numpy()).tolist():
                at = np.flatnonzero(b.column(1).to_numpy() == d)
                p = _unit(_matrix(b.column(0).take(pa.array(at)), d)) @ axes[d][:, :2]
                c = np.floor(np.concatenate([p, np.zeros((len(p), 2 - p.shape[1]))], 1) / width).astype(np.int32)
                out.update(zip(at.tolist(), c.tolist()))
            c = np.array([out[k] for k in range(b.num_rows)], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(1), b.column(0), pa.array(c[:, 0]), pa.array(c[:, 1])],
                                             names=["rep", "w", "dim", "v", "cx", "cy"])

    placed = cut_lineage(reps.select("v", "dim", "rep", "w").mapInArrow(cells, "rep long, w long, dim int, v binary, cx int, cy int"))
    size = placed.groupBy("dim", "cx", "cy").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("tiles"))
    # a cell meets itself and the four neighbours that follow it
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    meet = size.select("dim", "cx", "cy", "tiles", F.explode(steps).alias("s")).select(
        "dim", "cx", "cy", "tiles", (F.col("cx") + F.col("s.x")).alias("ox"), (F.col("cy") + F.col("s.y")).alias("oy"))
    other = size.select("dim", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("tiles").alias("o_tiles"))
    meet = cut_lineage(meet.join(other, ["dim", "ox", "oy"]))
    own = placed.join(size, ["dim", "cx", "cy"]).withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).drop("tiles")
    as_left = own.join(meet, ["dim", "cx", "cy"])
    same = (F.col("cx") == F.col("ox")) & (F.col("cy") == F.col("oy"))
    # left: with every tile of the other cell (of the own cell: with those that do not precede it)
    left = as_left.withColumn("o", F.explode(F.sequence(F.when(same, F.col("t")).otherwise(F.lit(0)), F.col("o_tiles") - 1))).select(
        F.struct("dim", "cx", "cy", "ox", "oy", "t", "o").alias("k"), "rep", "w", F.lit(0).alias("side"), "dim", "v")
    theirs = own.select("dim", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("t").alias("o"), "rep", "w", "v").join(meet, ["dim", "ox", "oy"])
    last = F.when(same, F.col("o") - 1).otherwise(F.col("tiles") - 1)
    right = theirs.where(last >= 0).withColumn("t", F.explode(F.sequence(F.lit(0), last))).select(
        F.struct("dim", "cx", "cy", "ox", "oy", "t", "o").alias("k"), "rep", "w", F.lit(1).alias("side"), "dim", "v")
    pairs = left.unionAll(right).select(F.col("rep").alias("vec_id"), "w", "side", "dim", "v", F.xxhash64("k").alias("k1"), F.xxhash64(F.lit(3), "k").alias("k2"))
    found = cut_lineage(pairs.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(
        _compare(axes, threshold), "vec_id long, links long, other long"))
    links = found.where("other is null").groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null"), "vec_id", "other").select(F.col("node").alias("n_id"), "component")
    per_class = reps.join(links, reps["rep"] == links["vec_id"], "left").join(parts, F.col("rep") == F.col("n_id"), "left").select(
        "v", "dim", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("comp"))
    per_row = usable.join(per_class, ["v", "dim"]).select(F.col("vec_id").alias("u_id"), "n", "comp").groupBy("u_id").agg(F.max("n").alias("n"), F.min("comp").alias("comp"))
    out = rows.select("vec_id").join(per_row, F.col("vec_id") == F.col("u_id"), "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"))


ships_by_value(__name__)
