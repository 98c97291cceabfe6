"""Token-id output: documents packed into rows of a fixed number of ids.

Each task encodes its documents, ends each with the separator, cuts those longer
than a row into pieces without loss, and packs the pieces of ``HELD_TOKENS`` ids
at a time by best-fit decreasing: a segment tree over remaining capacities finds
the fullest row that still takes a piece. Nothing is shuffled, and a task holds
one such lot. Rows carry the matrix row of ids, the cumulative segment lengths
and positions that start again with every segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import rows_of, ships_by_value
from strata.llm.tokens import encoder, id_type, load_vocab

ROW_TOKENS = 2048
#: Ids packed together by a task.
HELD_TOKENS = 4 << 20

SCHEMA = "lot long, row int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, n_tokens int, input_ids binary, position_ids binary"


class Capacities:
    """Segment tree over 0..``top``: the smallest capacity held that is at least
    a length, in O(log top)."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(top + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        k = capacity + self.leaves
        while k and not self.any[k]:
            self.any[k] = True
            k >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, row) of the best fit, taken out; None if nothing fits."""
        held, k = self.any, length + self.leaves
        if not held[k]:
            while k > 1 and (k & 1 or not held[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if held[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            held[k] = False
            k >>= 1
            while k and not (held[2 * k] or held[2 * k + 1]):
                held[k] = False
                k >>= 1
        return capacity, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Piece numbers of every row; longest pieces first, ties in their order."""
    tree, rows = Capacities(capacity), []
    for p in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        found = tree.take(lengths[p])
        left, row = found if found else (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(p)
        if left > lengths[p]:
            tree.add(left - lengths[p], row)
    return rows


def pack(docs: DataFrame, ranks_path: str, row_tokens: int = ROW_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows, see ``SCHEMA``. ``input_ids`` is a matrix row of
    ``row_tokens`` little-endian ids (2 bytes if the vocabulary allows, else 4),
    filled up with the separator (the first id the vocabulary leaves free);
    ``doc_ids`` and ``pieces`` name the segments that ``cu_seqlens`` bounds;
    ``position_ids`` are 4-byte integers, 0 after the last segment.

    A null or empty text is a separator alone; repeated rows are packed each;
    extra columns are not read; an empty table gives no rows.
    """
    raw = load_vocab(ranks_path)
    kind = id_type(encoder(raw)[1] + 1)
    spec = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, sep = encoder(spec.value)
        lot = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        names: list[tuple[int, int]] = []
        held: list[np.ndarray] = []
        total = 0
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())

        def packed():
            rows = best_fit_decreasing([len(p) for p in held], row_tokens)
            ramp = np.arange(row_tokens, dtype="<i4")
            for a in range(0, len(rows), 1024):
                out = []
                for k in range(a, min(len(rows), a + 1024)):
                    segments = rows[k]
                    n = [len(held[p]) for p in segments]
                    cu = np.concatenate([[0], np.cumsum(n)])
                    ids = np.full(row_tokens, sep, kind)
                    at = np.zeros(row_tokens, "<i4")
                    for p, s, e in zip(segments, cu, cu[1:]):
                        ids[s:e] = held[p]
                        at[s:e] = ramp[:e - s]
                    out.append((lot, k, [names[p][0] for p in segments], [names[p][1] for p in segments], cu, int(cu[-1]), ids.tobytes(), at.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(8)],
                                                 names=["lot", "row", "doc_ids", "pieces", "cu_seqlens", "n_tokens", "input_ids", "position_ids"])

        for i, text in rows_of(batches, "doc_id", "text"):
            found = encode(text)
            ids = np.empty(len(found) + 1, kind)
            ids[:-1], ids[-1] = found, sep
            for k in range(0, len(ids), row_tokens):
                names.append((i, k // row_tokens))
                held.append(ids[k:k + row_tokens])
            total += len(ids)
            if total >= HELD_TOKENS:
                yield from packed()
                names, held, total = [], [], 0
                lot += 1
        if held:
            yield from packed()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, path: str, ranks_path: str, row_tokens: int = ROW_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the packed rows as Parquet."""
    pack(docs, ranks_path, row_tokens, id_col, text_col).write.parquet(path)


ships_by_value(__name__)
