"""Training of the network against one NumPy run over whole batches, resuming, and
the epoch's batches against plain ranking."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import network as net
from strata.operators.batches import epoch_batches
from strata.operators.model import BN_EPS, mlp_forward
from strata.operators.network import Schedule
from strata.session import ensure_checkpoint_dir

SMALL = Schedule(epochs=4, batch_rows=None, rate=1e-2, hidden=(7, 5), dropout=(0.3, 0.1))


def made(spark, n=300, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = x[:, 0] * 2 - np.maximum(x[:, 1], 0) + 0.1 * rng.normal(size=n)
    rows = [(int(i), *map(float, x[i]), float(y[i]), bool(i % 5 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, y double, is_val boolean"), rows


def run_path(spark, name):
    import uuid
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def autodiff_free_step(w, x, y, ids, s, key):
    """Gradients of one batch held whole: textbook formulas with np.mean over the batch."""
    h, cache, n = x, [], len(x)
    for i in range(len(s.hidden)):
        z = h @ w[f"network.{4 * i}.weight"].T + w[f"network.{4 * i}.bias"]
        mean, var = z.mean(0), z.var(0)
        normed = (z - mean) / np.sqrt(var + BN_EPS)
        out = normed * w[f"network.{4 * i + 1}.weight"] + w[f"network.{4 * i + 1}.bias"]
        mask = (out > 0) * net.keep_mask(ids, out.shape[1], s.dropout[i], (key + (i << 56)) & (1 << 64) - 1)
        cache.append((h, normed, mask, mean, var))
        h = out * mask
    i = len(s.hidden)
    err = h @ w[f"network.{4 * i}.weight"].T + w[f"network.{4 * i}.bias"] - y[:, None]
    g, grads = 2 * err / n, {}
    grads[f"network.{4 * i}.weight"], grads[f"network.{4 * i}.bias"] = g.T @ h, g.sum(0)
    for i in reversed(range(len(s.hidden))):
        h, normed, mask, _, var = cache[i]
        g = (g @ w[f"network.{4 * i + 4}.weight"]) * mask
        grads[f"network.{4 * i + 1}.weight"], grads[f"network.{4 * i + 1}.bias"] = (g * normed).sum(0), g.sum(0)
        d = g * w[f"network.{4 * i + 1}.weight"]
        g = (d - d.mean(0) - normed * (d * normed).mean(0)) / np.sqrt(var + BN_EPS)
        grads[f"network.{4 * i}.weight"], grads[f"network.{4 * i}.bias"] = g.T @ h, g.sum(0)
    return grads, [(c[3], c[4]) for c in cache], float((err * err).mean())


def numpy_run(rows, s, batches_of):
    data = np.array([r[1:6] for r in rows])
    ids, val = np.array([r[0] for r in rows]), np.array([r[6] for r in rows])
    w = net.initial_weights(4, s.hidden, s.seed)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    rate, t, best, plateau, bad, losses = s.rate, 0, (-math.inf, None), -math.inf, 0, []
    for epoch in range(1, s.epochs + 1):
        loss = []
        for at in batches_of(epoch):
            key = (s.seed * 0x9E3779B97F4A7C15 + t * 0xBF58476D1CE4E5B9) & (1 << 56) - 1
            grads, moments, mse = autodiff_free_step(w, data[at, :4], data[at, 4], ids[at], s, key)
            t += 1
            loss.append(mse)
            for k, g in grads.items():
                g = g + s.decay * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
            for i, (mean, var) in enumerate(moments):
                bn = f"network.{4 * i + 1}"
                w[f"{bn}.running_mean"] = 0.9 * w[f"{bn}.running_mean"] + 0.1 * mean
                w[f"{bn}.running_var"] = 0.9 * w[f"{bn}.running_var"] + 0.1 * var * len(at) / (len(at) - 1)
        losses.append(np.mean(loss))
        err = mlp_forward(data[val, :4], w, len(s.hidden) + 1) - data[val, 4]
        score = max(0.0, 100 * (1 - (err ** 2).sum() / ((data[val, 4] - data[val, 4].mean()) ** 2).sum()))
        bad = 0 if plateau == -math.inf or score > plateau * 1.0001 else bad + 1
        plateau = score if bad == 0 else plateau
        if bad > s.plateau:
            rate, bad = rate * s.factor, 0
        if score > best[0]:
            best = (score, {k: a.copy() for k, a in w.items()})
    return w, best, losses, rate


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-6, atol=1e-9, err_msg=k)


@pytest.mark.parametrize("parts", [1, 6])
def test_full_batches_equal_one_numpy_run(spark, parts):
    df, rows = made(spark)
    s = Schedule(**{**SMALL.__dict__, "plateau": 0, "epochs": 6, "rate": 0.2})  # a high rate: plateaus occur
    train = np.array([k for k, r in enumerate(rows) if not r[6]])
    want, best, losses, rate = numpy_run(rows, s, lambda epoch: [train])
    path = run_path(spark, "net")
    w, state = net.fit_network(df.repartition(parts), ["a", "b", "c", "d"], "y", path, schedule=s)
    close(state.weights(), want)
    close(w, best[1])
    assert state.scalars["rate"] == rate and math.isclose(state.scalars["best_score"], best[0], rel_tol=1e-9)
    hist = {r.epoch: r for r in net.history(spark, path).collect()}
    assert sorted(hist) == list(range(1, 7)) and np.allclose([hist[e].train_loss for e in sorted(hist)], losses)


def batches_in_order(rows, epoch, size, seed=42):
    order = sorted((k for k, r in enumerate(rows) if not r[6]), key=lambda k: hashlib.md5(f"{rows[k][0]}:{seed}:{epoch}".encode()).hexdigest())
    return [np.array(order[i:i + size]) for i in range(0, len(order), size)]


def test_small_batches_middle_level_and_resume(spark, monkeypatch):
    monkeypatch.setattr(net, "DIRECT_TASKS", 2)  # sums over a middle level
    df, rows = made(spark)
    s = Schedule(**{**SMALL.__dict__, "batch_rows": 100, "epochs": 3})
    want, *_ = numpy_run(rows, s, lambda epoch: batches_in_order(rows, epoch, 100))
    whole, broken = run_path(spark, "net"), run_path(spark, "net")
    _, state = net.fit_network(df, ["a", "b", "c", "d"], "y", whole, schedule=s)
    close(state.weights(), want)
    # a run that is lost after each epoch and taken up from the shared store
    for _ in range(3):
        _, again = net.fit_network(df.repartition(3), ["a", "b", "c", "d"], "y", broken, schedule=s, epochs_now=1)
    close(again.weights(), state.weights())
    close(again.weights("best"), state.weights("best"))
    assert again.scalars.keys() == state.scalars.keys() and again.scalars["epoch"] == 3
    best, done = net.fit_network(df, ["a", "b", "c", "d"], "y", broken, schedule=s)  # nothing left to do
    close(best, again.weights("best"))
    with pytest.raises(ValueError, match="another schedule"):
        net.fit_network(df, ["a", "b", "c", "d"], "y", broken, schedule=SMALL)


def test_network_edges(spark):
    df, rows = made(spark, 60)
    feats = ["a", "b", "c", "d"]
    w, state = net.fit_network(df.where("is_val"), feats, "y", run_path(spark, "net"), schedule=SMALL)  # no training rows
    close(w, net.initial_weights(4, SMALL.hidden))
    w, state = net.fit_network(df.where("not is_val"), feats, "y", run_path(spark, "net"), schedule=SMALL)  # nothing to validate on
    close(w, state.weights())
    assert state.scalars["best_epoch"] == 4
    w, _ = net.fit_network(df, ["a"], "y", run_path(spark, "net"), schedule=Schedule(epochs=2, batch_rows=None, hidden=(), dropout=()))  # a linear model
    assert sorted(w) == ["network.0.bias", "network.0.weight"]
    bad = df.withColumn("a", F.when(F.col("row_id") == 7, F.lit(None)).otherwise(F.col("a")))
    with pytest.raises(Exception, match="not_null:a"):
        net.fit_network(bad, feats, "y", run_path(spark, "net"), schedule=SMALL)
    with pytest.raises(ValueError, match="one share"):
        net.fit_network(df, feats, "y", "x", schedule=Schedule(hidden=(3,)))


@pytest.mark.parametrize("n,size", [(0, 5), (1, 5), (1000, 64), (1000, 1000), (1000, 3000), (77, 1)])
def test_batches_are_exact(spark, n, size):
    df = spark.range(n).withColumnRenamed("id", "row_id").withColumn("_x", F.lit(1)).repartition(4)
    for epoch in (1, 2):
        got = {r.row_id: r.batch for r in epoch_batches(df, "row_id", size, 42, epoch).collect()}
        order = sorted(range(n), key=lambda i: hashlib.md5(f"{i}:42:{epoch}".encode()).hexdigest())
        assert got == {i: k // size for k, i in enumerate(order)}
    repeated = df.select(F.lit(3).alias("row_id"))
    sizes = sorted(r["count"] for r in epoch_batches(repeated, "row_id", size).groupBy("batch").count().collect())
    assert sum(sizes) == n and sizes[1:] == [size] * len(sizes[1:])


def test_passes_are_dealt_to_all_cores_and_taken_in_blocks(spark, monkeypatch):
    df, rows = made(spark)
    parts, plain = [], net.total
    monkeypatch.setattr(net, "total", lambda batch, step: parts.append(batch.rdd.getNumPartitions()) or plain(batch, step))
    s = Schedule(**{**SMALL.__dict__, "epochs": 1})
    w, _ = net.fit_network(df.coalesce(1), ["a", "b", "c", "d"], "y", run_path(spark, "net"), schedule=s)
    assert min(parts) >= spark.sparkContext.defaultParallelism > 1  # one file, yet a share for every core
    again, _ = net.fit_network(df.orderBy("y").coalesce(1), ["a", "b", "c", "d"], "y", run_path(spark, "net"), schedule=s)
    assert all((w[k] == again[k]).all() for k in w)  # added in the same order, whatever the order of the table

    rng = np.random.default_rng(3)
    x, y, ids = rng.normal(size=(1000, 4)), rng.normal(size=1000), np.arange(1000)
    step = net.Step(net.initial_weights(4, s.hidden), len(s.hidden), s.dropout, 5)
    sizes, blocks = [], net.Step._sums
    monkeypatch.setattr(net.Step, "_sums", lambda self, x, y, ids: sizes.append(len(x)) or blocks(self, x, y, ids))
    np.testing.assert_allclose(step.sums(x, y, ids), blocks(step, x, y, ids), rtol=1e-12)
    assert max(sizes) <= net.BLOCK_ROWS and sum(sizes) == 1000


def test_dropout_draws_the_upper_bits_as_a_fraction():
    ids, m = np.array([0, 1, 7, -3, 1 << 62]), (1 << 64) - 1
    for share in (0.0, 0.1, 0.25, 1 / 3):
        got = net.keep_mask(ids, 5, share, 77)
        for a, i in enumerate(ids.tolist()):
            for b in range(5):
                z = (i * 0x9E3779B97F4A7C15 + 77 + (b + 1) * 0xD1B54A32D192ED03) & m
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    z = (z ^ z >> shift) * factor & m
                z ^= z >> 31
                assert got[a, b] == ((z >> 11) * 2.0 ** -53 >= share) / (1 - share)


@pytest.mark.parametrize("hidden", [(), (5,), (7, 5), (9, 8, 7), (9, 8, 7, 6), (6, 5, 4, 3, 2)])
def test_few_passes_bring_the_gradients_of_the_whole_batch(hidden):
    rng, n = np.random.default_rng(len(hidden)), 700
    x, y, ids = rng.normal(size=(n, 4)) + [0, 1, -2, 3], rng.normal(size=n), rng.integers(-1 << 40, 1 << 40, n)
    s = Schedule(hidden=hidden, dropout=(0.3, 0.0, 0.2, 0.1, 0.25)[:len(hidden)])
    w = {k: v if v.ndim == 2 else rng.normal(size=v.shape) for k, v in net.initial_weights(4, hidden).items()}
    for i in range(len(hidden)):
        w[f"network.{4 * i + 1}.weight"][0] = 0  # a unit whose scale is 0
    passes = []

    def sum_up(step):
        passes.append(step)
        return np.sum([step.sums(x[at], y[at], ids[at]) for at in np.array_split(np.arange(n), 3)], axis=0)

    got, moments, rows, loss = net.gradients(sum_up, w, hidden, s.dropout, 99, 4)
    want, want_moments, want_loss = autodiff_free_step(w, x, y, ids, s, 99)
    assert got.keys() == want.keys() and rows == n and math.isclose(loss, want_loss, rel_tol=1e-12)
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-9, atol=1e-12, err_msg=k)
    for a, b in zip(moments, want_moments, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)
    assert len(passes) == len(hidden) + len(hidden) // 2 + 1  # 2 per layer and 1 if each waits for the sums of one layer


def test_full_batches_sum_the_products_once_and_read_packed_rows(spark, monkeypatch):
    df, _ = made(spark)
    passes, plain = [], net.total
    monkeypatch.setattr(net, "total", lambda batch, step: passes.append(batch.schema["x"].dataType.simpleString()) or plain(batch, step))
    net.fit_network(df, ["a", "b", "c", "d"], "y", run_path(spark, "net"), schedule=SMALL)
    assert passes == ["binary"] * (1 + SMALL.epochs * 3)

    monkeypatch.setattr(net, "PACK_BYTES", 3 * 8 * 6)
    monkeypatch.setattr(net, "PART", 2)
    rows = df.select(F.col("row_id").alias("id"), F.array("a", "b", "c", "d").alias("x"), "y", "is_val").coalesce(1).sortWithinPartitions("row_id")
    packs = net.packed(rows, 4)
    for flag in (False, True):
        some = packs.where(F.col("is_val") == flag).drop("is_val").toArrow()
        assert max(len(i) for i in some["id"].to_pylist()) == 3 * 8  # three rows a pack
        x, y, ids = (np.concatenate(v) for v in zip(*(p for b in some.to_batches() for p in net._arrays(b))))
        want = rows.where(F.col("is_val") == flag).collect()
        assert ids.tolist() == [r.id for r in want] and y.tolist() == [r.y for r in want] and x.tolist() == [r.x for r in want]
