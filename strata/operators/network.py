"""Fitting the scored network where its rows lie.

The network is the one ``model.mlp_score`` runs: blocks of Linear, BatchNorm, ReLU and
Dropout, then a Linear head; mean squared error, Adam with weight decay. A step is
a few passes over the rows of its batch. In each pass every task adds up what the
rows of its Arrow batches contribute and sends one vector; vectors are summed in
order of the tasks, over a middle level when there are many, so the driver holds a few
of them. With ``L`` hidden layers there are

* ``L`` passes forward, one per BatchNorm, for the exact mean and variance of the
  layer's inputs over the whole batch. The first sums the rows' products, from which
  the moments of any first layer follow: over the same rows it runs once, not per step;
* ``L // 2 + 1`` passes backward, from the head down, as the gradient through a
  BatchNorm needs two sums over the batch as well. A pass brings those of two layers:
  below the layer whose gradient it holds, the gradient is linear in that layer's
  sums, so the next layer's follow from sums that do not need them yet.

So the result is that of one machine holding the batch, whatever the partitioning.
Dropout is drawn by a hash of (seed, step, layer, row id, unit), batches by a keyed
permutation of the row ids: a repeated task or run draws the same.

After every epoch the whole training state (parameters, moments, rate, plateau
and patience counters, best parameters) is appended to a table in the run's folder
on the shared store. A run on a folder with states goes on after the last one.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.batches import epoch_batches
from strata.operators.model import BN_EPS, HIDDEN, mlp_forward, mlp_layout
from strata.operators.quality import guard, not_null
from strata.session import cut_lineage

#: Tasks whose vectors are summed on the driver; more go over a middle level.
DIRECT_TASKS = 32
#: Rows that a task takes through the layers at once.
BLOCK_ROWS = 256
#: Bytes of a packed row; an Arrow batch holds ``maxRecordsPerBatch`` of them.
PACK_BYTES = 2048
#: Packed rows that a task unpacks at once, 4 MB.
PART = 2048


@dataclass(frozen=True)
class Schedule:
    """The defaults are fixed values of the scored network's training.

    ``batch_rows`` None: one step an epoch, over all training rows. On a large
    table choose batches of many rows: a step is ``L + L // 2 + 1`` jobs."""
    epochs: int = 50
    batch_rows: int | None = 512
    rate: float = 1e-3
    decay: float = 1e-5
    factor: float = 0.5
    plateau: int = 5
    patience: int = 10
    hidden: tuple[int, ...] = HIDDEN
    dropout: tuple[float, ...] = (0.3, 0.2, 0.1)
    momentum: float = 0.1
    seed: int = 42


# Adam's constants, and the relative gain that counts on a plateau.
BETA1, BETA2, ADAM_EPS, GAIN = 0.9, 0.999, 1e-8, 1e-4


def initial_weights(in_dim: int, hidden: Sequence[int] = HIDDEN, seed: int = 42) -> dict[str, np.ndarray]:
    """Uniform in +-1/sqrt(fan in) for linear layers; BatchNorm starts as the identity."""
    rng, w = np.random.default_rng(seed), {}
    layout = mlp_layout(in_dim, hidden)
    for i, (name, fi, fo) in enumerate(layout):
        bound = 1 / math.sqrt(fi)
        w[f"{name}.weight"], w[f"{name}.bias"] = rng.uniform(-bound, bound, (fo, fi)), rng.uniform(-bound, bound, fo)
        if i < len(layout) - 1:
            bn = f"network.{4 * i + 1}"
            w |= {f"{bn}.weight": np.ones(fo), f"{bn}.bias": np.zeros(fo), f"{bn}.running_mean": np.zeros(fo), f"{bn}.running_var": np.ones(fo)}
    return w


def trained(name: str) -> bool:
    return "running" not in name


# --- what the rows of a batch contribute to a pass


def kept_units(ids: np.ndarray, width: int, share: float, key: int) -> np.ndarray:
    """Which units dropout keeps. A unit is dropped if the hash's upper 53 bits, as a
    fraction, are below ``share``."""
    with np.errstate(over="ignore"):
        z = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        shifted = np.empty_like(z)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            np.right_shift(z, np.uint64(shift), out=shifted)
            z ^= shifted
            if factor > 1:
                z *= np.uint64(factor)
    # the bound's low 11 bits are 0, so two bits less compare alike; then no bit pattern is a
    # negative or infinite double, and doubles, which compare faster, order as their patterns
    z >>= np.uint64(2)
    return z.view(np.float64) >= np.uint64(math.ceil(share * 2 ** 53) << 9).view(np.float64)


def keep_mask(ids: np.ndarray, width: int, share: float, key: int) -> np.ndarray:
    """Dropout's factors: 0 for a dropped unit, else 1 / (1 - share)."""
    return kept_units(ids, width, share, key) / (1 - share)


@dataclass
class Step:
    """What a pass needs: parameters, the batch sums known so far, dropout."""
    w: dict[str, np.ndarray]
    depth: int
    dropout: tuple[float, ...]
    key: int
    n: int = 0
    #: Mean and 1 / standard deviation of each BatchNorm's inputs.
    moments: tuple = ()
    #: (sum of the gradient at each BatchNorm's output, and of it times the normed input), from the last layer down.
    through: tuple = ()

    def linear(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights and bias; the weights take the factor of the units kept below them."""
        weight = self.w[f"network.{4 * i}.weight"]
        return (weight / (1 - self.dropout[i - 1]) if i else weight), self.w[f"network.{4 * i}.bias"]

    def norm(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.w[f"network.{4 * i + 1}.weight"], self.w[f"network.{4 * i + 1}.bias"]

    @cached_property
    def _linears(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self.linear(i) for i in range(self.depth + 1)]

    @cached_property
    def _joined(self) -> list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
        """Linear and BatchNorm as one linear map, to its normed inputs and to its output."""
        out = []
        for i, (mean, inv) in enumerate(self.moments):
            (weight, bias), (gamma, beta) = self._linears[i], self.norm(i)
            normed = weight * inv[:, None], (bias - mean) * inv
            out.append((normed, (normed[0] * gamma[:, None], normed[1] * gamma + beta)))
        return out

    def _forward(self, x, ids, layers, normed_from):
        """What leaves the last of the layers (without the factor of kept units), and of
        each layer ``(its input, normed, mask)``; normed from ``normed_from`` on."""
        h, kept = x, []
        for i in range(layers):
            to_normed, to_out = self._joined[i]
            normed = None
            if i >= normed_from:
                gamma, beta = self.norm(i)
                normed = h @ to_normed[0].T
                normed += to_normed[1]
                out = normed * gamma
                out += beta
            else:
                out = h @ to_out[0].T
                out += to_out[1]
            live = kept_units(ids, out.shape[1], self.dropout[i], (self.key + (i << 56)) & (1 << 64) - 1)
            live &= out > 0
            mask = live.astype(np.float64)
            kept.append((h, normed, mask))
            out *= mask
            h = out
        return h, kept

    def sums(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The pass's sums over these rows, as one vector; taken over blocks of rows
        whose intermediate arrays fit a core's cache."""
        held = self._sums(x[:BLOCK_ROWS], y[:BLOCK_ROWS], ids[:BLOCK_ROWS])
        for k in range(BLOCK_ROWS, len(x), BLOCK_ROWS):
            held += self._sums(x[k:k + BLOCK_ROWS], y[k:k + BLOCK_ROWS], ids[k:k + BLOCK_ROWS])
        return held

    def _sums(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
        level = len(self.moments)
        if level < self.depth:  # forward: inputs of the next BatchNorm
            if not level:
                return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
            h, _ = self._forward(x, ids, level, level)
            weight, bias = self._linears[level]
            z = h @ weight.T
            z += bias
            return np.concatenate([[len(x)], z.sum(0), np.einsum("ij,ij->j", z, z)])
        known = self.depth - len(self.through)  # the lowest linear layer whose gradient is known
        h, kept = self._forward(x, ids, self.depth, max(0, known - 2))
        weight, bias = self._linears[self.depth]
        err = h @ weight.T
        err += bias
        err -= y[:, None]
        g = 2 * err  # the mean is taken on the driver
        parts = [np.array([len(x), (err * err).sum()])]
        if not self.through:
            parts += [(g.T @ h).ravel(), g.sum(0)]
        for i, (da, da_normed) in zip(range(self.depth - 1, known - 1, -1), self.through):  # back through the BatchNorms whose sums are known
            h, normed, mask = kept[i]
            g = g @ self._linears[i + 1][0]
            g *= mask
            scale = self.norm(i)[0] * self.moments[i][1]
            g *= scale
            mean = normed * (scale * da_normed / self.n)
            mean += scale * da / self.n
            g -= mean
            if i < known + 2:  # the others came out of passes before
                parts += [(g.T @ h).ravel(), g.sum(0)]
        if known:
            i = known - 1
            h, normed, mask = kept[i]
            g = g @ self._linears[known][0]
            g *= mask
            parts += [g.sum(0), np.einsum("ij,ij->j", g, normed)]
            if not i:
                parts.append((g.T @ h).ravel())
            else:  # of the layer below: sums of its gradient as far as known, and what the two new sums are taken times
                _, normed_below, mask_below = kept[i - 1]
                g *= self.norm(i)[0] * self.moments[i][1]
                g = g @ self._linears[i][0]
                g *= mask_below
                live = mask_below * normed_below
                parts += [g.sum(0), np.einsum("ij,ij->j", g, normed_below), mask_below.sum(0), live.sum(0), (normed.T @ mask_below).ravel(), (normed.T @ live).ravel()]
        return np.concatenate(parts)


def packed(rows: DataFrame, width: int) -> DataFrame:
    """Rows ``(id, x, y, is_val)`` with the numbers of a few rows as bytes in one, in the same
    order: a pass takes them as they lie instead of converting each value."""
    some = max(1, PACK_BYTES // (8 * (width + 2)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of_val = b.column(3).to_numpy(zero_copy_only=False)
            for x, y, ids in _arrays(b):
                for flag in (False, True):
                    at = np.flatnonzero(of_val == flag)
                    cuts = [at[k:k + some] for k in range(0, len(at), some)]
                    yield pa.RecordBatch.from_arrays([*[pa.array([np.ascontiguousarray(v[c]).tobytes() for c in cuts], pa.binary()) for v in (ids, x, y)],
                                                      pa.array([flag] * len(cuts), pa.bool_())], names=["id", "x", "y", "is_val"])

    return rows.mapInArrow(pack, "id binary, x binary, y binary, is_val boolean")


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(x, y, ids)`` of plain rows, and of packed ones in parts of bounded size."""
    ids, x, y = (batch.column(c) for c in range(3))
    if pa.types.is_integer(ids.type):
        if batch.num_rows:
            yield x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), y.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
        return
    for k in range(0, batch.num_rows, PART):
        i, v, t = (np.frombuffer(b"".join(c.slice(k, PART).to_pylist()), kind) for c, kind in ((ids, np.int64), (x, np.float64), (y, np.float64)))
        yield v.reshape(len(i), -1), t, i


def _added(vectors: list[tuple[int, bytes]]) -> np.ndarray:
    return np.sum([np.frombuffer(v) for _, v in sorted(vectors)], axis=0)


def total(rows: DataFrame, step: Step) -> np.ndarray:
    """The pass's sums over all rows ``(id, x, y)``."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(step)
    names = ["part", "v"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for part in _arrays(b):
                v = sent.value.sums(*part)
                held = v if held is None else held + v
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=names)

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(r["part"], r["v"]) for b in batches for r in b.to_pylist()]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([min(held)[0]], pa.int64()), pa.array([_added(held).tobytes()], pa.binary())], names=names)

    tasks = spark.sparkContext.defaultParallelism
    if tasks > DIRECT_TASKS:
        sums = rows.mapInArrow(add, "part long, v binary").repartition(math.isqrt(tasks), "part").mapInArrow(middle, "part long, v binary")
    else:  # as many tasks as cores, so few vectors
        sums = rows.coalesce(tasks).mapInArrow(add, "part long, v binary")
    got = [(r["part"], bytes(r["v"])) for r in sums.collect()]
    sent.destroy()
    return _added(got) if got else np.zeros(0)


def gradients(sum_up, w: dict[str, np.ndarray], hidden: Sequence[int], dropout: Sequence[float], key: int, in_dim: int, products: np.ndarray | None = None):
    """``(gradients, batch moments, rows, mean squared error)`` of a batch;
    ``sum_up(step)`` gives a pass's sums over its rows. ``products``: the first pass's, if known."""
    depth, step, grads = len(hidden), Step(w, len(hidden), tuple(dropout), key), {}
    raw = []
    for i, width in enumerate(hidden):
        s = sum_up(step) if i or products is None else products
        if not len(s):
            return None
        if not i:  # moments of the first linear layer, from those of its inputs
            weight, bias = step.linear(0)
            n, of_x, of_xx = s[0], s[1:1 + in_dim], s[1 + in_dim:].reshape(in_dim, in_dim)
            mean, at = weight @ (of_x / n) + bias, of_x / n
            var = np.maximum(((weight @ (of_xx / n - np.outer(at, at))) * weight).sum(1), 0)
        else:
            n, mean = s[0], s[1:1 + width] / s[0]
            var = np.maximum(s[1 + width:] / n - mean * mean, 0)
        raw.append((mean, var))
        step = Step(w, depth, step.dropout, key, int(n), (*step.moments, (mean, 1 / np.sqrt(var + BN_EPS))))
    sizes = [in_dim, *hidden, 1]
    first, known = depth, depth  # the linear layers whose gradients the pass brings
    while True:
        s = sum_up(step)
        if not len(s):
            return None
        n, loss, at = int(s[0]), s[1] / s[0], 2

        def take(*shape):
            nonlocal at
            at += math.prod(shape)
            return s[at - math.prod(shape):at].reshape(shape)

        def put(i, weight, bias):
            grads[f"network.{4 * i}.weight"], grads[f"network.{4 * i}.bias"] = weight / n / (1 - dropout[i - 1] if i else 1), bias / n

        def put_norm(i, da, da_normed):
            grads[f"network.{4 * i + 1}.weight"], grads[f"network.{4 * i + 1}.bias"] = da_normed / n, da / n

        for i in range(first, known - 1, -1):
            put(i, take(sizes[i + 1], sizes[i]), take(sizes[i + 1]))
        if not known:
            break
        i = known - 1
        da, da_normed = take(sizes[known]), take(sizes[known])
        put_norm(i, da, da_normed)
        (mean, inv), (gamma, _), (weight, bias) = step.moments[i], step.norm(i), step.linear(i)
        by_da, by_normed = gamma * inv * da / n, gamma * inv * da_normed / n
        if not i:  # back through the first BatchNorm, whose normed inputs are linear in x
            normed = weight @ of_x + n * (bias - mean), weight @ of_xx + np.outer(bias - mean, of_x)
            by_normed = by_normed * inv
            put(0, (gamma * inv)[:, None] * take(sizes[1], in_dim) - np.outer(by_da, of_x) - by_normed[:, None] * normed[1], -by_normed * normed[0])
            break
        below = sizes[i]
        g, g_normed, live, live_normed = (take(below) for _ in range(4))
        rest = by_da @ weight
        sums = [v - rest * many - ((by_normed[:, None] * weight) * take(sizes[known], below)).sum(0) for v, many in ((g, live), (g_normed, live_normed))]
        put_norm(i - 1, *sums)
        step = Step(w, depth, step.dropout, key, n, step.moments, (*step.through, (da, da_normed), tuple(sums)))
        first, known = known - 1, known - 2
    return grads, raw, n, float(loss)


# --- the training state


class State:
    """Everything a run needs to go on: arrays by name and scalars by name."""

    def __init__(self, arrays: dict[str, np.ndarray], scalars: dict[str, float]):
        self.arrays, self.scalars = arrays, scalars

    @classmethod
    def initial(cls, in_dim: int, s: Schedule) -> State:
        w = initial_weights(in_dim, s.hidden, s.seed)
        arrays = {f"w:{k}": v for k, v in w.items()} | {f"best:{k}": v for k, v in w.items()}
        arrays |= {f"{m}:{k}": np.zeros_like(v) for m in "mv" for k, v in w.items() if trained(k)}
        return cls(arrays, {"epoch": 0, "step": 0, "rate": s.rate, "plateau_best": -math.inf, "plateau_bad": 0, "best_score": -math.inf, "best_epoch": 0, "waited": 0})

    def weights(self, kind: str = "w") -> dict[str, np.ndarray]:
        return {k[len(kind) + 1:]: v for k, v in self.arrays.items() if k.startswith(f"{kind}:")}

    def adam(self, grads: dict[str, np.ndarray], moments: list, n: int, s: Schedule) -> None:
        self.scalars["step"] += 1
        t, a = self.scalars["step"], self.arrays
        for k, g in grads.items():
            g = g + s.decay * a[f"w:{k}"]
            a[f"m:{k}"] = BETA1 * a[f"m:{k}"] + (1 - BETA1) * g
            a[f"v:{k}"] = BETA2 * a[f"v:{k}"] + (1 - BETA2) * g * g
            a[f"w:{k}"] = a[f"w:{k}"] - self.scalars["rate"] * (a[f"m:{k}"] / (1 - BETA1 ** t)) / (np.sqrt(a[f"v:{k}"] / (1 - BETA2 ** t)) + ADAM_EPS)
        for i, (mean, var) in enumerate(moments):
            for name, new in (("running_mean", mean), ("running_var", var * n / max(1, n - 1))):
                k = f"w:network.{4 * i + 1}.{name}"
                a[k] = (1 - s.momentum) * a[k] + s.momentum * new

    def close_epoch(self, train_loss: float, val: dict[str, float], s: Schedule) -> None:
        """Rate halving on a plateau of the score, best-epoch weights, patience."""
        c, score = self.scalars, val["score"]
        c |= {"train_loss": train_loss, **val}
        c["epoch"] += 1
        if math.isnan(score):  # nothing to validate on: the last weights are the best
            c |= {"best_epoch": c["epoch"]}
            self.arrays |= {f"best:{k}": v for k, v in self.weights().items()}
            return
        gained = score > c["plateau_best"] * (1 + GAIN) if math.isfinite(c["plateau_best"]) else True
        c["plateau_best"], c["plateau_bad"] = (score, 0) if gained else (c["plateau_best"], c["plateau_bad"] + 1)
        if c["plateau_bad"] > s.plateau:
            c["rate"], c["plateau_bad"] = c["rate"] * s.factor, 0
        if score > c["best_score"]:
            c |= {"best_score": score, "best_epoch": c["epoch"], "waited": 0}
            self.arrays |= {f"best:{k}": v for k, v in self.weights().items()}
        else:
            c["waited"] += 1

    def done(self, s: Schedule) -> bool:
        return self.scalars["epoch"] >= s.epochs or self.scalars["waited"] >= s.patience


_STATE = "name string, shape array<int>, values array<double>, epoch int"


def save_state(spark: SparkSession, state: State, schedule: str, path: str) -> None:
    """Append the epoch's state; readers see it once the job has committed."""
    epoch = int(state.scalars["epoch"])
    rows = [(k, [int(n) for n in v.shape], v.ravel().tolist(), epoch) for k, v in state.arrays.items()]
    rows += [(f"scalar:{k}", [], [float(v)], epoch) for k, v in state.scalars.items()] + [(f"schedule:{schedule}", [], [], epoch)]
    spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("append").partitionBy("epoch").parquet(f"{path}/state")


def _states(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_STATE).parquet(f"{path}/state")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_state(spark: SparkSession, path: str, schedule: str | None = None) -> State | None:
    """The last state in the folder (bounded by the model); one of another
    schedule is refused."""
    states = _states(spark, path)
    last = states.agg(F.max("epoch")).first()[0] if states is not None else None
    if last is None:
        return None
    arrays, scalars = {}, {}
    for r in states.where(F.col("epoch") == last).collect():
        kind, _, name = r["name"].partition(":")
        if kind == "scalar":
            scalars[name] = r["values"][0]
        elif kind == "schedule":
            if schedule is not None and name != schedule:
                raise ValueError(f"{path} holds a run of another schedule: {name}")
        else:
            arrays[r["name"]] = np.array(r["values"], np.float64).reshape(r["shape"])
    return State(arrays, scalars)


def history(spark: SparkSession, path: str) -> DataFrame:
    """One row an epoch: training loss (mean of the batches' means), validation RMSE,
    MAE, R2 and score, the rate of the next epoch, and the best epoch so far."""
    names = ["train_loss", "rmse", "mae", "r2", "score", "rate", "best_epoch"]
    rows = _states(spark, path).where(F.col("name").startswith("scalar:"))
    return rows.groupBy("epoch").agg(*[F.max(F.when(F.col("name") == f"scalar:{n}", F.col("values")[0])).alias(n) for n in names])


# --- training


def evaluate(rows: DataFrame, w: dict[str, np.ndarray]) -> dict[str, float]:
    """R2, score, RMSE and MAE of the network in eval mode; NaN without rows."""
    n_layers = 1 + sum(k.endswith("running_mean") for k in w)
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def add(batches):
        s = np.zeros(5)
        for b in batches:
            for x, y, _ in _arrays(b):
                for k in range(0, len(y), BLOCK_ROWS):
                    t = y[k:k + BLOCK_ROWS]
                    err = mlp_forward(x[k:k + BLOCK_ROWS], sent.value, n_layers) - t
                    s += [len(t), (err * err).sum(), np.abs(err).sum(), t.sum(), (t * t).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in s], names=["n", "se", "ae", "y", "yy"])

    got = rows.mapInArrow(add, "n double, se double, ae double, y double, yy double").agg(*[F.sum(c).alias(c) for c in ("n", "se", "ae", "y", "yy")]).first()
    sent.destroy()
    if not got["n"]:
        return {"r2": math.nan, "score": math.nan, "rmse": math.nan, "mae": math.nan}
    ss = got["yy"] - got["y"] ** 2 / got["n"]
    r2 = 1 - got["se"] / ss if ss > 0 else float(got["se"] == 0)
    return {"r2": r2, "score": max(0.0, 100 * r2), "rmse": math.sqrt(got["se"] / got["n"]), "mae": got["ae"] / got["n"]}


def _batches(train: DataFrame, s: Schedule, epoch: int, path: str) -> Iterator[DataFrame]:
    if s.batch_rows is None:
        yield train
        return
    # one epoch's order on the shared store, the next one replaces it; a batch is a
    # few files, the others are skipped by their statistics
    dealt = epoch_batches(train, "id", s.batch_rows, s.seed, epoch)
    dealt.repartitionByRange("batch").sortWithinPartitions("batch").write.mode("overwrite").parquet(f"{path}/batches")
    written = train.sparkSession.read.parquet(f"{path}/batches")
    n = written.agg(F.max("batch")).first()[0]
    for k in range(0 if n is None else n + 1):
        yield written.where(F.col("batch") == k).drop("batch")


def fit_network(df: DataFrame, features: Sequence[str], y: str, path: str, is_val: str = "is_val", row_id: str = "row_id",
                schedule: Schedule = Schedule(), epochs_now: int | None = None) -> tuple[dict[str, np.ndarray], State]:
    """Train on the rows that are not ``is_val``, validate on the others after every
    epoch, and return the weights of the best epoch and the last state.

    ``path``: the run's folder on the shared store; a run found there goes on.
    ``epochs_now`` stops after so many epochs (to be resumed). ``row_id`` is an integer
    key. A null or NaN feature or target fails the run; a null ``is_val`` is a
    training row. Without training rows the initial weights come back."""
    spark, features = df.sparkSession, list(features)
    if len(schedule.dropout) != len(schedule.hidden):
        raise ValueError("dropout needs one share per hidden layer")
    checked = guard(df, not_null([*features, y], nan=True))
    rows = checked.select(F.coalesce(F.col(row_id).cast("long"), F.lit(0)).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
                          F.col(y).cast("double").alias("y"), F.coalesce(F.col(is_val), F.lit(False)).alias("is_val"))
    # every pass reads these rows: dealt to all cores, however few files the table has;
    # by their values and sorted, so that sums are added in the same order in every run
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "id", "x", "y").sortWithinPartitions("id", "y", "x")
    rows = cut_lineage(packed(rows, len(features)) if schedule.batch_rows is None else rows)
    train, val = rows.where(~F.col("is_val")).drop("is_val"), rows.where("is_val").drop("is_val")
    signature = f"{features}, {asdict(schedule)}"
    state = load_state(spark, path, signature) or State.initial(len(features), schedule)
    until = math.inf if epochs_now is None else state.scalars["epoch"] + epochs_now
    products = None
    while not state.done(schedule) and state.scalars["epoch"] < until:
        losses = []
        for batch in _batches(train, schedule, int(state.scalars["epoch"]) + 1, path):
            key = (schedule.seed * 0x9E3779B97F4A7C15 + int(state.scalars["step"]) * 0xBF58476D1CE4E5B9) & (1 << 56) - 1
            if schedule.batch_rows is None and products is None:  # every step is over the same rows
                products = total(batch, Step(state.weights(), len(schedule.hidden), schedule.dropout, key)) if schedule.hidden else None
            got = gradients(lambda step: total(batch, step), state.weights(), schedule.hidden, schedule.dropout, key, len(features), products)
            if got is None:
                break
            state.adam(*got[:3], schedule)
            losses.append(got[3])
        if not losses:
            break
        state.close_epoch(float(np.mean(losses)), evaluate(val, state.weights()), schedule)
        save_state(spark, state, signature, path)
    return state.weights("best"), state


register_pickle_by_value(sys.modules[__name__])
