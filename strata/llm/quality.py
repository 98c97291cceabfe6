"""Quality of documents: a byte-level convolutional network in numpy.

The bytes of the whole text are embedded; learned filters of ``WIDTH`` bytes slide
over them ``STRIDE`` bytes at a time. Their rectified outputs are max-pooled over
overlapping chunks of two ``HOP`` bytes that cover the document from its first byte to
its last, a hidden layer reads each chunk, its units are max-pooled over all chunks,
and a logistic layer combines the maxima into one probability.

Only the strongest chunk of a hidden unit, and in it the strongest place of a
filter, has a gradient, so training computes the network forward over whole
documents and backward at those places alone. It is fitted by Adam on a sample of
labelled documents, bounded in documents a class and in bytes a document, in one task;
class weights restore the shares that the classes have among all labelled
documents. The weights (some thousand numbers) then go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage, rows_of, ships_by_value

#: Filters and the bytes each one sees, the step between two places, and the size
#: of a byte's embedding.
FILTERS, WIDTH, STRIDE, EMBED = 32, 8, 2, 8
#: Half a chunk in bytes; units of the hidden layer.
HOP, HIDDEN = 128, 16
#: Bounds of the training sample: documents a class, and bytes of a document.
MAX_DOCS_PER_CLASS, MAX_DOC_BYTES = 1200, 16384
#: Training: steps, documents a step, and Adam's first rate.
STEPS, STEP_DOCS, RATE = 500, 32, 4e-3
#: Bytes of text that go through the filters at once.
SPAN = 1 << 15
#: A document is predicted to be of quality from this score on.
PREDICTED_FROM = 0.3

_HOP_PLACES = HOP // STRIDE


def initial(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, by: (rng.normal(size=shape) / np.sqrt(by)).astype(np.float32)
    return {"embed": normal(256, EMBED, by=2), "filters": normal(WIDTH * EMBED, FILTERS, by=WIDTH * EMBED / 2), "shift": np.zeros(FILTERS, np.float32),
            "hidden": normal(FILTERS, HIDDEN, by=FILTERS / 2), "lift": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, by=HIDDEN), "bias": np.zeros(1, np.float32)}


def padded(text: str | None) -> np.ndarray:
    """The text's bytes, followed by at least one window of zero bytes, up to whole hops."""
    raw = (text or "").encode()
    hops = max(2, -(-len(raw) // HOP))
    x = np.zeros(hops * HOP + WIDTH, np.uint8)
    x[:len(raw)] = np.frombuffer(raw, np.uint8)
    return x


def _places(x: np.ndarray, w: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
    """Filter outputs, a block of whole hops at a time."""
    for s in range(0, len(x) - WIDTH, SPAN):
        e = w["embed"][x[s:s + SPAN + WIDTH]]
        n = (min(SPAN, len(x) - WIDTH - s)) // STRIDE
        seen = np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (STRIDE * e.strides[0], e.strides[1]))
        yield seen @ w["filters"]


def hops(x: np.ndarray, w: dict[str, np.ndarray], where: bool = False):
    """Largest output of each filter in every hop, and with ``where`` its place."""
    top, at = [], []
    for y in _places(x, w):
        y = y.reshape(-1, _HOP_PLACES, FILTERS)
        if where:
            k = y.argmax(1)
            at.append(k)
            top.append(np.take_along_axis(y, k[:, None], 1)[:, 0])
        else:
            top.append(y.max(1))
    return np.concatenate(top), np.concatenate(at) if where else None


def chunk_units(top: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pooled filters and hidden units of each chunk (two neighbouring hops)."""
    pooled = np.maximum(np.maximum(top[:-1], top[1:]) + w["shift"], 0)
    return pooled, np.maximum(pooled @ w["hidden"] + w["lift"], 0)


def score(text: str | None, w: dict[str, np.ndarray]) -> float:
    """Probability that a text is of quality; an empty one is scored like any other."""
    units = chunk_units(hops(padded(text), w)[0], w)[1].max(0)
    return float(1 / (1 + np.exp(-np.clip(float(units @ w["out"] + w["bias"][0]), -30, 30))))


def _backward(x: np.ndarray, label: float, weight: float, w: dict[str, np.ndarray], grad: dict[str, np.ndarray]) -> None:
    """Add one document's gradient of the weighted log loss."""
    top, at = hops(x, w, where=True)
    pooled, units = chunk_units(top, w)
    chunk = units.argmax(0)
    best = units[chunk, np.arange(HIDDEN)]
    p = 1 / (1 + np.exp(-np.clip(best @ w["out"] + w["bias"][0], -30, 30)))
    d = np.float32((p - label) * weight)
    grad["bias"] += d
    grad["out"] += d * best
    du = d * w["out"] * (best > 0)
    grad["lift"] += du
    seen = pooled[chunk]  # the chunk of each unit: (HIDDEN, FILTERS)
    grad["hidden"] += seen.T * du
    df = np.where(seen > 0, du[:, None] * w["hidden"].T, 0)
    grad["shift"] += df.sum(0)
    c, f = chunk[:, None], np.arange(FILTERS)
    hop = c + (top[c + 1, f] > top[c, f])
    place = (hop * _HOP_PLACES + at[hop, f]) * STRIDE
    window = x[place[:, :, None] + np.arange(WIDTH)]
    grad["filters"] += np.einsum("ufk,uf->kf", w["embed"][window].reshape(HIDDEN, FILTERS, -1), df)
    back = (df[:, :, None] * w["filters"].T).reshape(-1, EMBED)
    for j in range(EMBED):
        grad["embed"][:, j] += np.bincount(window.ravel(), back[:, j], 256)


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Fit the network: Adam with a falling rate over shuffled documents."""
    w, rng = initial(seed), np.random.default_rng(seed + 1)
    xs = [padded(t) for t in texts]
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    ahead: list[int] = []
    for t in range(1, STEPS + 1):
        if len(ahead) < STEP_DOCS:
            ahead += rng.permutation(len(xs)).tolist()
        rows, ahead = ahead[:STEP_DOCS], ahead[STEP_DOCS:]
        grad = {k: np.zeros_like(a) for k, a in w.items()}
        for i in rows:
            _backward(xs[i], labels[i], weights[i], w, grad)
        rate = RATE * 0.5 * (1 + np.cos(np.pi * t / STEPS))
        for k in w:
            g = grad[k] / len(rows)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return w


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are not learned from (a row without an id has no label)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """A fitted network, or a constant score where the labels hold no two classes."""

    def __init__(self, weights: dict[str, np.ndarray] | None, constant: float = 0.5):
        self.weights, self.constant = weights, constant

    def score(self, text: str | None) -> float:
        return self.constant if self.weights is None else score(text, self.weights)


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(doc_id, label)``: one row per labelled document. One that is marked more
    than once is of quality only if every mark says so; null ids and marks are no labels."""
    rows = labels.select(labels[id_col].cast("long").alias("doc_id"), (labels[label_col] > 0).cast("int").alias("label"))
    return rows.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``MAX_DOCS_PER_CLASS`` documents of each class, those of the
    smallest hash of their id, of up to ``MAX_DOC_BYTES`` bytes, among the labelled
    rows that ``learn`` (a condition on ``doc_id``) selects. Only ids are counted over
    all labels; a few times the sample's ids meet the documents, by a broadcast."""
    known = cut_lineage(labelled(labels, id_col, label_col).where(learn))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / sum(n.values()) if n else 0.5
    if len(n) < 2:
        return Model(None, share)
    order = F.xxhash64("doc_id")
    rate = F.when(F.col("label") == 1, F.lit(min(1.0, 3 * MAX_DOCS_PER_CLASS / n[1]))).otherwise(F.lit(min(1.0, 3 * MAX_DOCS_PER_CLASS / n[0])))
    near = known.where(F.shiftrightunsigned(order, 11) < rate * float(1 << 53)).withColumnRenamed("doc_id", "labelled_id")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_DOC_BYTES)
    rows = texts.join(F.broadcast(near), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "label", "text")
    by_class = Window.partitionBy("label").orderBy(order, "doc_id", "text")
    sample = rows.withColumn("rank", F.row_number().over(by_class)).where(F.col("rank") <= MAX_DOCS_PER_CLASS)

    def fit_task(batches):
        got = sorted((label, rank, text or "") for label, rank, text in rows_of(batches, "label", "rank", "text"))
        y = np.array([r[0] for r in got], np.float32)
        if len(set(y.tolist())) < 2:
            return
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
        w = train([r[2] for r in got], y, weight)
        yield pa.RecordBatch.from_arrays([pa.array(list(w)), pa.array([list(a.shape) for a in w.values()], pa.list_(pa.int32())), pa.array([a.tobytes() for a in w.values()], pa.binary())], names=["name", "shape", "data"])

    got = sample.select("label", "rank", "text").coalesce(1).mapInArrow(fit_task, "name string, shape array<int>, data binary").collect()
    return Model({r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in got} or None, share)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` of every row from its whole text. Null and
    empty texts are scored alike, repeated rows each; without two classes of labels
    every score is the share of label 1 (0.5 without labels). Other columns are
    not read, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.constant))

    def run(batches):
        m = Model(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                scores = [m.score(text) for (text,) in rows_of([part], "text")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: labels of held-out documents are
    not learned from."""
    scored = score_documents(docs, fit(docs, labels, ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


ships_by_value(__name__)
