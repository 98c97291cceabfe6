"""Sharding by extendible hashing. DataFrame functions only.

Rows are addressed by the leading bits of a 60-bit hash of their key. The
directory starts with one bucket; a bucket whose bytes exceed the limit is split
on its next bit, and only such buckets are, until every one fits. A round
resolves ``ROUND_BITS`` bits at once from one histogram of the rows in buckets
that are still too large, so the number of rounds is that of the depth divided
by ``ROUND_BITS``. A bucket of one single hash (a key that repeats, however
often) can't be split by bits; its rows go to numbered pages that fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage

HASH_BITS = 60
ROUND_BITS = 10
#: Bytes of a shard, at most (a single larger row is a shard of its own).
LIMIT_BYTES = 128 << 20
#: Directory rows up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key as text; a null key hashes as no text does."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, bits) -> Column:
    return F.shiftright(h, HASH_BITS - bits) if isinstance(bits, int) else F.expr(f"shiftright(h, {HASH_BITS} - {bits})")


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """``(at, leaf, depth, prefix, whole)`` from ``(h, n_bytes)``: every hash
    whose first ``at`` bits are ``leaf`` belongs to the bucket of the first
    ``depth`` bits, ``prefix``. ``whole``: a single hash, larger than the limit.
    """
    done, open_rows, at = None, sized, 0
    while True:
        step = min(ROUND_BITS, HASH_BITS - at)
        leaves = open_rows.groupBy(_prefix(F.col("h"), at + step).alias("leaf")).agg(
            F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        first = 0 if at == 0 else at + 1
        above = leaves.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(at + step)))).withColumn(
            "prefix", F.expr(f"shiftright(leaf, {at + step} - depth)"))
        total = above.groupBy("depth", "prefix").agg(F.sum("b").alias("total"), F.min("lo").alias("lo_all"), F.max("hi").alias("hi_all"))
        fits = total.where((F.col("total") <= limit) | (F.col("lo_all") == F.col("hi_all"))).select(
            "depth", "prefix", (F.col("total") > limit).alias("whole"))
        found = above.select("leaf", "depth", "prefix").join(fits, ["depth", "prefix"], "left").groupBy("leaf").agg(
            F.min(F.when(F.col("whole").isNotNull(), F.struct("depth", "prefix", "whole"))).alias("s"))
        level = cut_lineage(found.select(F.lit(at + step).alias("at"), "leaf", "s"))
        here = level.where("s is not null").select("at", "leaf", "s.depth", "s.prefix", "s.whole")
        done = here if done is None else done.unionAll(here)
        left = level.where("s is null").select(F.col("leaf").alias("open"))
        at += step
        if at >= HASH_BITS or left.isEmpty():
            return done
        open_rows = open_rows.join(left, _prefix(F.col("h"), at) == F.col("open"), "left_semi")


def assign(docs: DataFrame, limit: int = LIMIT_BYTES, key_col: str = "doc_id", size: Column | None = None) -> DataFrame:
    """``(row, n_bytes, depth, shard)``: every row of ``docs`` (as a struct) with
    its shard, named by the bucket's bits, with ``.page`` for pages of one hash.

    ``size`` is a row's bytes (default: of the column ``text``); null counts as
    0. Rows only meet the directory, which is broadcast while it is small.
    """
    size = F.octet_length(docs["text"]) if size is None else size
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"), key_hash(docs[key_col]).alias("h"))
    buckets = cut_lineage(directory(cut_lineage(rows.select("h", "n_bytes")), limit))
    levels = buckets.groupBy("at").count().collect()  # at most HASH_BITS / ROUND_BITS rows
    out, picked = rows, [F.lit(None).cast("struct<depth:int,prefix:bigint,whole:boolean>")]
    for r in sorted(levels, key=lambda r: r["at"]):
        mine = buckets.where(F.col("at") == r["at"]).select(F.col("leaf").alias(f"leaf{r['at']}"), F.struct("depth", "prefix", "whole").alias(f"s{r['at']}"))
        mine = F.broadcast(mine) if r["count"] <= BROADCAST_ROWS else mine
        out = out.join(mine, _prefix(F.col("h"), r["at"]) == F.col(f"leaf{r['at']}"), "left")
        picked.append(F.col(f"s{r['at']}"))
    bits = F.expr("concat('s', case when s.depth = 0 then '' else lpad(conv(s.prefix, 10, 2), s.depth, '0') end)")
    out = out.withColumn("s", F.coalesce(*picked)).select("row", "h", "n_bytes", "s.depth", "s.whole", bits.alias("shard"))
    flat = out.where("not whole").select("row", "n_bytes", "depth", "shard")
    # pages: rows of one hash in the order they lie in their partition
    wide = cut_lineage(out.where("whole").select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("r")))
    before = Window.partitionBy("h", "pid").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    most = wide.groupBy("h").agg(F.max("n_bytes").alias("most"))
    local = F.floor(F.col("sum") / F.greatest(F.lit(1), F.lit(limit + 1) - F.col("most")))
    cut = wide.withColumn("sum", F.coalesce(F.sum("n_bytes").over(before), F.lit(0))).join(most, "h").withColumn("local", local)
    number = cut.select("h", "pid", "local").distinct().withColumn("page", F.row_number().over(Window.partitionBy("h").orderBy("pid", "local")) - 1)
    name = F.concat("shard", F.when(F.col("page") > 0, F.concat(F.lit("."), F.col("page").cast("string"))).otherwise(""))
    paged = cut.join(number, ["h", "pid", "local"]).select("row", "n_bytes", "depth", name.alias("shard"))
    return flat.unionAll(paged)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, key_col: str = "doc_id", size: Column | None = None) -> None:
    """Write ``docs`` as Parquet, one folder ``shard=...`` and one file in it per
    shard. A column ``shard`` of the input, if any, is replaced."""
    placed = assign(docs, limit, key_col, size).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "shard"], "shard")
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


def shards(docs: DataFrame, limit: int = LIMIT_BYTES, key_col: str = "doc_id", size: Column | None = None) -> DataFrame:
    """``(key, shard, depth, n_bytes)`` of every row. Null keys share one bucket;
    repeated rows share a bucket while they fit; an empty table gives no rows;
    extra columns are not read."""
    size = F.octet_length(docs["text"]) if size is None else size
    narrow = cut_lineage(docs.select(docs[key_col].alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes")))
    found = assign(narrow, limit, "key", narrow["n_bytes"])
    return found.select(F.col("row.key").alias(key_col), "shard", F.col("depth").cast("long").alias("depth"), "n_bytes")
