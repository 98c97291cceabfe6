"""Token counts from flat token files without an index.

A token file holds the ids of document after document, each ended by a separator
id, and nothing else. Files are cut into blocks of ``BLOCK_BYTES``; each task
reads its blocks by byte range and finds all separators at once. A document that
runs over blocks is stitched by a prefix scan over the blocks' summaries
(separators so far, end of the last one), itself done in two levels, so that a
file of any length needs no single task.

Token files are written as a side effect of the job that returns their manifest:
names are unique per attempt, and only files of committed attempts are in the
manifest, so a lost executor leaves at most files that nobody names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage, rows_of, ships_by_value
from strata.llm.tokens import encoder, id_type, load_vocab

#: Bytes of a file that a task searches at once (a multiple of every id size).
BLOCK_BYTES = 4 << 20
#: Ids after which a task starts a new file.
FILE_TOKENS = 64 << 20
#: Blocks per group in the prefix scan.
GROUP = 1024


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """Write the documents' ids to flat files below ``folder`` (a URI).

    Returns the manifest ``(file, ordinal, doc_id)``, the bytes of an id and the
    separator, which is the first id the vocabulary leaves free. A null or empty
    text is a separator alone.
    """
    raw = load_vocab(ranks_path)
    n_ids = encoder(raw)[1] + 1
    kind = id_type(n_ids)
    spec = docs.sparkSession.sparkContext.broadcast(raw)
    step = 1 << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sep = encoder(spec.value)
        out, name, ids, count = None, "", [], 0
        end = np.array([sep], kind)
        held, size = [], 0

        def manifest():
            return pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64())],
                                              names=["file", "ordinal", "doc_id"])

        for i, text in rows_of(batches, "doc_id", "text"):
            if out is None:
                store, path = _open(folder)
                store.create_dir(path, recursive=True)
                leaf = f"tokens-{uuid.uuid4().hex}.bin"
                out, name, ids, count = store.open_output_stream(f"{path}/{leaf}"), f"{folder}/{leaf}", [], 0
            found = encode(text).astype(kind)
            held += [found, end]
            size += len(found) + 1
            ids.append(i)
            if size >= step:
                out.write(np.concatenate(held).tobytes())
                count, held, size = count + size, [], 0
                if count >= FILE_TOKENS:
                    out.close()
                    out = None
                    yield manifest()
        if out is not None:
            if held:
                out.write(np.concatenate(held).tobytes())
            out.close()
            yield manifest()

    text = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return cut_lineage(text.mapInArrow(run, "file string, ordinal long, doc_id long")), kind.itemsize, n_ids - 1


def scan(files: DataFrame, id_bytes: int, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file, ordinal, start, n_tokens)`` of every document in ``files(file)``.

    ``start`` is the position of the first id in the file. Two separators in a
    row are an empty document; ids after the last separator are a document
    without an end; an empty file has none. Rows that repeat a file count once.
    """
    block_bytes -= block_bytes % id_bytes
    kind = np.dtype(f"<u{id_bytes}")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (f,) in rows_of(batches, "file"):
            store, path = _open(f)
            n = store.get_file_info(path).size
            blocks = -(-n // block_bytes)
            for a in range(0, blocks, 65536):
                k = np.arange(a, min(blocks, a + 65536))
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(k), pa.string()), pa.array(k), pa.array(np.minimum(block_bytes, n - k * block_bytes))],
                                                 names=["file", "block", "size"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("last", pa.int64())])
        for f, block, size in rows_of(batches, "file", "block", "size"):
            store, path = _open(f)
            with store.open_input_file(path) as file:
                ids = np.frombuffer(file.read_at(size, block * block_bytes), kind)
            first = block * (block_bytes // id_bytes)
            at = first + np.flatnonzero(ids == separator)
            n = len(at)
            # one row per separator (the first one's start is not known here), one for the block
            start = np.concatenate([[-1], at[:-1] + 1, [first + len(ids)]]) if n else np.array([first + len(ids)])
            stop = np.concatenate([at, [n]])
            last = np.concatenate([np.full(n, -1), [at[-1] + 1 if n else -1]])
            k = np.concatenate([np.arange(n), [-1]])
            yield pa.RecordBatch.from_arrays([pa.array([f] * (n + 1), pa.string()), pa.array(np.full(n + 1, block)), *(pa.array(c.astype(np.int64)) for c in (k, start, stop, last))], schema=schema)

    blocks = files.select("file").distinct().mapInArrow(sizes, "file string, block long, size long")
    found = cut_lineage(blocks.repartition("file", "block").mapInArrow(search, "file string, block long, k long, start long, stop long, last long"))
    per = found.where("k = -1").select("file", "block", F.floor(F.col("block") / GROUP).alias("grp"), F.col("stop").alias("n"), "last", F.col("start").alias("end"))
    groups = per.groupBy("file", "grp").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    before = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("g_n"), F.coalesce(F.max("last").over(before), F.lit(0)).alias("g_last"))
    inner = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = per.withColumn("n0", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("last0", F.coalesce(F.max("last").over(inner), F.lit(0))).join(
        groups, ["file", "grp"]).select("file", "block", (F.col("g_n") + F.col("n0")).alias("ordinal0"), F.greatest("g_last", "last0", F.lit(0)).alias("start0"), "end")
    closed = found.where("k >= 0").join(scanned, ["file", "block"]).select(
        "file", (F.col("ordinal0") + F.col("k")).alias("ordinal"), F.when(F.col("k") == 0, F.col("start0")).otherwise(F.col("start")).alias("start"), "stop")
    tails = per.groupBy("file").agg(F.sum("n").alias("ordinal"), F.greatest(F.max("last"), F.lit(0)).alias("start"), F.max("end").alias("stop")).where("stop > start")
    return closed.unionByName(tails).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))


def token_counts(docs: DataFrame, folder: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of every row: its ids are written to flat files
    below ``folder``, and counted by scanning those. Null and empty texts have 0;
    repeated rows give a row each; extra columns are not read."""
    manifest, id_bytes, sep = write_token_files(docs, folder, ranks_path, id_col, text_col)
    return scan(manifest.select("file"), id_bytes, sep).join(manifest, ["file", "ordinal"]).select("doc_id", "n_tokens")


ships_by_value(__name__)
