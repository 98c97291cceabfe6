"""Chat formatting: collapse logged snapshots of growing conversations, then
render what is left. DataFrame functions only.

A chat service that logs the whole history with every reply leaves one
conversation as many, each the prefix of the next. Turn hashes that include the
turn's position are summed up along a conversation, so the running sum after k
turns stands for its first k turns. A conversation whose full sum is a running
sum of a longer one is a prefix of it: an anti-join keeps the maximal ones, and
of equal ones the smallest id. Turns get their places from a range partitioning
with two-level counts, whatever their numbers are; conversations are then handled in
blocks of exactly ``BLOCK`` turns with a prefix scan over blocks, so one of any length is
never sorted, summed or rendered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage

#: Turns handled (and rendered into one row) together.
BLOCK = 256
#: The markers of the rendered format.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def _offsets(blocks: DataFrame, **sums: Column) -> DataFrame:
    """Sums over the earlier blocks of a conversation, and over all of them."""
    per = blocks.groupBy("conv", "blk").agg(*[c.alias(k) for k, c in sums.items()])
    before = Window.partitionBy("conv").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    zero = F.lit(0)
    return per.select("conv", "blk", *[F.coalesce(F.sum(k).over(before), zero).alias(f"{k}_before") for k in sums],
                      *[F.sum(k).over(whole).alias(f"{k}_all") for k in sums])


def _rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    c = conversations
    return c.select(c[conv_col].alias("conv"), c[turn_col].cast("long").alias("turn"), c[role_col].alias("role"), c[text_col].alias("text"),
                    F.md5(c[text_col].cast("binary")).alias("digest")).where("conv is not null")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their place ``pos`` (from 1) in the conversation and its size ``n``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(rows.repartitionByRange(parts, "conv", "turn", "role", "digest").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy("conv", "part").agg(F.count("*").alias("c"))
    per = per.select("conv", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("earlier"), F.sum("c").over(Window.partitionBy("conv")).alias("n"))
    order = Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first())
    at = dealt.withColumn("k", F.row_number().over(order)).join(per, ["conv", "part"])
    return at.withColumn("pos", F.col("earlier") + F.col("k")).drop("part", "k", "earlier")


def turns(rows: DataFrame) -> DataFrame:
    """``(conv, pos, turn, role, digest, n, p1, p2, f1, f2)``: the turns in order
    with the running hash sums up to each (p) and of the conversation (f). Texts
    do not travel here, only their digests.

    Repeated rows count once; turns order by number, role and digest of the text,
    nulls first; rows without a conversation id belong to none and are left out.
    """
    at = _placed(rows.select("conv", "turn", "role", "digest").distinct()).withColumn("blk", F.floor((F.col("pos") - 1) / BLOCK))
    for j in (1, 2):  # two independent 64-bit hashes; sums are exact decimals
        at = at.withColumn(f"h{j}", F.xxhash64(F.lit(j), "pos", F.col("role").isNull(), "role", F.col("digest").isNull(), "digest").cast("decimal(38,0)"))
    at = cut_lineage(at.select("conv", "blk", "pos", "n", "turn", "role", "digest", "h1", "h2"))
    sums = _offsets(at, h1=F.sum("h1"), h2=F.sum("h2"))
    run = Window.partitionBy("conv", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = at.withColumns({f"r{j}": F.sum(f"h{j}").over(run) for j in (1, 2)}).join(sums, ["conv", "blk"])
    return out.select("conv", "pos", "turn", "role", "digest", "n", *[(F.col(f"r{j}") + F.col(f"h{j}_before")).alias(f"p{j}") for j in (1, 2)],
                      *[F.col(f"h{j}_all").alias(f"f{j}") for j in (1, 2)])


def maximal(ordered: DataFrame) -> DataFrame:
    """``(conv, n_copies)``: conversations that are no proper prefix of another
    one, one (the smallest id) of equal ones."""
    whole = ordered.where("pos = n").groupBy("n", "f1", "f2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    # a prefix shared by many conversations is one row
    prefixes = ordered.where("pos < n").select(F.col("pos").alias("n"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).distinct()
    return whole.join(prefixes, ["n", "f1", "f2"], "left_anti").select("conv", "n_copies")


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, part, n_turns, n_copies, chat)``: the maximal conversations,
    rendered in parts of ``BLOCK`` turns.

    A turn without a role is rendered with an empty one, a null text as empty.
    Extra columns are not read; an empty table gives no rows.
    """
    rows = _rows(conversations, conv_col, turn_col, role_col, text_col)
    ordered = cut_lineage(turns(rows))
    kept = ordered.join(maximal(ordered), "conv").select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"), "pos", "n_copies")
    line = F.concat(F.lit(TURN_START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(TURN_END + "\n"))
    same = (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & F.col("role").eqNullSafe(F.col("r")) & F.col("digest").eqNullSafe(F.col("d"))
    lines = rows.join(kept, same).select("conv", F.floor((F.col("pos") - 1) / BLOCK).alias("part"), "n_copies", F.struct("pos", line.alias("line")).alias("l"))
    parts = lines.groupBy("conv", "part", "n_copies").agg(F.array_sort(F.collect_set("l")).alias("l"))  # a set: repeated rows meet here again
    return parts.select(F.col("conv").alias("conv_id"), "part", F.size("l").cast("long").alias("n_turns"), "n_copies", F.array_join("l.line", "").alias("chat"))
