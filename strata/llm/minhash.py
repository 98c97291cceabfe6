"""Near-duplicate documents: b-bit MinHash signatures, multi-index Hamming join.

Two texts are linked when 100 * |A n B| >= 75 * |A u B| for their sets of
distinct 5-word shingles. The job:

1. *Sketch* (one scan): per document the size and a 128-bit digest of its
   shingle set, and a signature of ``SYMBOLS`` MinHash values cut to 16 bits.
   Documents with equal digests form one class; only its smallest id goes on.
2. *Multi-index Hamming join*: links must differ in at most ``MAX_DISTANCE``
   symbols. The signature is split into ``CHUNKS`` chunks, so by pigeonhole one
   chunk of a pair has at most ``MAX_DISTANCE // CHUNKS`` (one) wrong symbol.
   Leaving out each symbol of a chunk in turn enumerates the allowed errors: all
   pairs within the distance share a key. Keys held once are dropped by their
   count; the others meet in blocks of bounded size (a hot key is dealt over
   pairs of blocks), where whole signatures are compared. A block returns a
   spanning forest of the pairs within the distance, never the pairs.
3. *Candidate clusters*: components of those forests. Every link lies inside one
   cluster.
4. *Confirmation on full sets*: the clustered documents' shingle sets are built
   again and dealt to blocks of bounded bytes (pairs of blocks for a large
   cluster); each block counts exact intersections, one document against all
   others at once, and again returns a spanning forest, of the links.
5. Components of links and class memberships give ``component_id``.

A pair at similarity 0.75 differs in 16 of the 64 symbols on average, and in
more than 30 with a probability of about 4e-5; at 0.8, about 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage, rows_of, ships_by_value
from strata.llm.components import connected_components, forest

SHINGLE = 5
#: A link: INTER * |A n B| >= UNION * |A u B|.
INTER, UNION = 100, 75
SYMBOLS, CHUNKS, MAX_DISTANCE = 64, 16, 30
CHUNK = SYMBOLS // CHUNKS
#: Rows of a key, and shingles of a cluster, that meet in one block.
KEY_BLOCK = 4096
SET_BLOCK = 600_000
#: Distinct words whose hashes a task remembers.
MEMO_WORDS = 300_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _factors() -> np.ndarray:
    raw = [int.from_bytes(hashlib.sha256(b"symbol %d" % k).digest()[:8], "little") | 1 for k in range(SYMBOLS)]
    return np.array(raw, np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: five words each (or
    all, if there are fewer); none for a null text or one without words."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = max(1, len(w) - SHINGLE + 1)
    s = np.full(n, len(w) if len(w) < SHINGLE else 0, np.uint64)
    for j in range(min(SHINGLE, len(w))):
        s = s * _STEP + h[j:j + n]
    s ^= s >> _S29
    s *= _MIX
    s ^= s >> _S32
    return np.unique(s)


def signature(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` MinHash values, cut to 16 bits."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):
        m = s[None, a:a + 4096] * factors[:, None]
        m ^= m >> _S32
        np.minimum(low, m.min(1), out=low)
    return (low & np.uint64(0xFFFF)).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, factors = _Words(), _factors()
    out: tuple[list, ...] = ([], [], [], [])

    def flush():
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n", "digest", "sig"])

    for i, text in rows_of(batches, "doc_id", "text"):
        s = shingle_set(text, words)
        row = (i, len(s), hashlib.md5(s.tobytes()).digest(), signature(s, factors).tobytes()) if len(s) else (i, 0, None, None)
        for c, v in zip(out, row):
            c.append(v)
        if len(out[0]) == 4096:
            yield flush()
            out = ([], [], [], [])
    if out[0]:
        yield flush()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """64 keys of every signature: 16 chunks, each without one of its symbols.

    The 48 bits of the symbols that are left and the number of the key share 64
    bits by mixing; should two different keys coincide, signatures tell."""
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).to_numpy()
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(len(ids), SYMBOLS).astype(np.uint64)
        for c in range(CHUNKS):
            keys = []
            for out in range(CHUNK):
                k = np.full(len(ids), (c * CHUNK + out + 1) & 0xFFFF, np.uint64)
                for x in range(CHUNK):
                    if x != out:
                        k = (k << np.uint64(16)) | sig[:, c * CHUNK + x]
                keys.append(k * _STEP)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, CHUNK))], names=["key", "doc_id"])


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of the sorted stream with equal ``keys``; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy() for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            piece = b.slice(a, z - a)
            if held and a == 0 and all(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() == c[0] for k, c in zip(keys, cols)):
                held.append(piece)
                continue
            if held:
                yield held
            held = [piece]
    if held:
        yield held


def _near(sig: np.ndarray) -> np.ndarray:
    """Component (row number) of every signature, linked within MAX_DISTANCE."""
    n = len(sig)
    lab = np.arange(n)
    todo = np.arange(n)
    while len(todo) > 1:
        seed, todo = todo[0], todo[1:]
        front = np.array([seed])
        while len(front) and len(todo):
            hit = np.zeros(len(todo), bool)
            for f in front:
                rest = np.flatnonzero(~hit)
                if not len(rest):
                    break
                hit[rest] = (sig[todo[rest]] != sig[f]).sum(1) <= MAX_DISTANCE
            front, todo = todo[hit], todo[~hit]
            lab[front] = seed
    return lab


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    us, vs = [], []
    for run in _runs(batches, ("key", "i", "j")):
        ids = np.concatenate([b.column(0).to_numpy() for b in run])
        if len(ids) < 2:
            continue
        sig = np.frombuffer(b"".join(x for b in run for x in b.column(1).to_pylist()), np.uint16).reshape(len(ids), SYMBOLS)
        lab = _near(sig)
        moved = np.flatnonzero(lab != np.arange(len(ids)))
        us.append(ids[moved])
        vs.append(ids[lab[moved]])
        if len(us) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])
            us, vs = [], []
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for i, cluster, text in rows_of(batches, "doc_id", "cluster", "text"):
        s = shingle_set(text, words)
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([cluster], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["doc_id", "cluster", "hashes"])


def links_within(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Component (number) of every set over the links in a block, counted exactly.

    With two values in ``side``, links across the sides only. Sets already in
    one component are not compared again.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    start = np.concatenate([[0], np.cumsum(size)])
    _, code = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    mark = np.zeros(code.max(initial=0) + 1, np.int32)
    lab = np.arange(n)
    both = len(set(side.tolist())) > 1
    for x in range(n - 1):
        # partners are as large or larger, by at most the factor of the threshold
        end = int(np.searchsorted(size, size[x] * INTER // UNION, side="right"))
        y = np.arange(x + 1, end)
        y = y[lab[y] != lab[x]]
        if both:
            y = y[side[y] != side[x]]
        if not len(y):
            continue
        mark[code[start[x]:start[x + 1]]] = 1
        if len(y) * 2 > end - x - 1:
            sums = np.add.reduceat(mark[code[start[x + 1]:start[end]]], start[x + 1:end] - start[x + 1])
            inter = sums[y - x - 1]
        else:
            inter = np.array([mark[code[start[k]:start[k + 1]]].sum() for k in y])
        mark[code[start[x]:start[x + 1]]] = 0
        union = size[x] + size[y] - inter
        for k in np.unique(lab[y[INTER * inter >= UNION * union]]):
            if k != lab[x]:
                low, high = min(k, lab[x]), max(k, lab[x])
                lab[lab == high] = low
    out = np.empty(n, np.int64)
    out[order] = order[lab]
    return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, ("cluster", "i", "j")):
        ids = np.concatenate([b.column(0).to_numpy() for b in run])
        side = np.concatenate([b.column(1).to_numpy() for b in run])
        sets = [np.frombuffer(x, np.uint64) for b in run for x in b.column(2).to_pylist()]
        lab = links_within(sets, side)
        moved = np.flatnonzero(lab != np.arange(len(ids)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[lab[moved]])], names=["u", "v"])


def _dealt(rows: DataFrame, blocks: str, block: str, *keys: str) -> DataFrame:
    """Every row once per pair (i <= j) of blocks that its own block belongs to;
    a group of one block stays as it is."""
    pair = F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda o: F.struct(
        F.least(F.col(block), o).alias("i"), F.greatest(F.col(block), o).alias("j")))
    return rows.withColumn("_p", F.explode(pair)).select(*keys, F.col("_p.i").alias("i"), F.col("_p.j").alias("j"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, digest, sig)``, written once to the shared folder."""
    return cut_lineage(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        _sketch, "doc_id long, n long, digest binary, sig binary"))


def candidate_clusters(reps: DataFrame) -> DataFrame:
    """``(doc_id, cluster)`` of the representatives within the signature distance
    of another one, directly or over others."""
    keys = reps.select("doc_id", "sig").mapInArrow(_keys, "key long, doc_id long")
    # counted before the rows meet, so that a hot key is rows of a join, which can be split
    shared = keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    blocks = F.ceil(F.col("n") / F.lit(KEY_BLOCK)).cast("int")
    own = shared.withColumn("b", blocks).withColumn("k", F.pmod(F.xxhash64("doc_id"), F.col("b")).cast("int"))
    # narrow rows are dealt to their block pairs, then joined with the signatures
    dealt = _dealt(own, "b", "k", "doc_id", "key").join(reps.select("doc_id", "sig"), "doc_id")
    pairs = dealt.select("doc_id", "sig", "key", "i", "j").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        _candidates, "u long, v long")
    found = connected_components(pairs, "u", "v")
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).unionAll(
        found.select(F.col("component").alias("doc_id"), F.col("component").alias("cluster")).distinct())


def confirmed_links(docs: DataFrame, reps: DataFrame, clusters: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(u, v)``: spanning forests of the links, confirmed on whole sets."""
    clusters = cut_lineage(clusters)
    text = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    weight = clusters.join(reps.select("doc_id", "n"), "doc_id").groupBy("cluster").agg(F.sum("n").alias("w"))
    sets = text.join(clusters, "doc_id").dropDuplicates(["doc_id"]).mapInArrow(_sets, "doc_id long, cluster long, hashes binary")
    own = sets.join(weight, "cluster").withColumn("b", F.ceil(F.col("w") / F.lit(SET_BLOCK)).cast("int")).withColumn(
        "k", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("b")).cast("int"))
    return _dealt(own, "b", "k", "doc_id", "k", "hashes", "cluster").repartition("cluster", "i", "j").sortWithinPartitions(
        "cluster", "i", "j").mapInArrow(_confirm, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row.

    Null texts and texts without words have 0 shingles, link with nothing and
    are kept. Rows that repeat a doc_id are taken as one document with one of
    its texts' sets for linking (ids are meant to be unique); each gives a row.
    A null id gives a row that is its own component (null) and is kept. Other
    columns are not read, whatever their names; an empty table gives no rows.
    """
    sk = sketches(docs, id_col, text_col)
    classes = sk.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = sk.join(classes, (sk["digest"] == classes["digest"]) & (sk["doc_id"] == classes["rep"]), "left_semi").dropDuplicates(["doc_id"])
    reps = cut_lineage(reps)
    links = confirmed_links(docs, reps, candidate_clusters(reps), id_col, text_col)
    stars = sk.join(classes, "digest").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    parts = connected_components(links.unionAll(stars), "u", "v")
    out = sk.join(parts, sk["doc_id"] == parts["node"], "left")
    comp = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


ships_by_value(__name__)
