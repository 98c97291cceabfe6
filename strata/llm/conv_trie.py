"""Prefix trie of conversations by a splitter skeleton.

Every conversation is a path of turn digests. Paths are sorted and cut into shards
at sampled splitters ``(path, conversation)``. The members of a trie node lie one
behind the other, so a node is spread over shards only if it is a prefix of a
splitter's path: the trie of the splitter paths, the *skeleton*, is broadcast. Each
shard is then read once in order, with a stack as deep as a path, and finishes every
other node alone. For skeleton nodes it emits partial aggregates, which are reduced
by key; one pass over the reduced skeleton (its size is bounded by the splitters)
completes them. Splitters hold the conversation too, so a path that many
conversations share is cut like any other.

A path longer than ``SEGMENT`` turns goes on in further rows: a segment's trie hangs
at the node where the segment before it ends, found by a running hash of
the segments. What lies below such nodes (leaves, savings) is summed up the chain of
segments first, by pointer doubling, and enters the pass above as a number.

Turns get their places from a range partitioning with two-level counts, so one
conversation of any length is never sorted in one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut_lineage, ships_by_value
from strata.session import BROADCAST_BYTES, materialize

#: Turns of a path in one row, and rows (of turns, of segments) counted together.
SEGMENT, COUNTED = 256, 4096
#: Turns a shard should hold, the most shards, and sampled rows a shard.
SHARD_TURNS, MAX_SHARDS, SAMPLED = 50_000, 20_000, 16
#: Conversation ids hashed (or, in the skeleton, sent on as one row) together.
ENDS = 4096

_ROOT = bytes(16)
_NOTHING = hashlib.sha256(b"").hexdigest()


def _sized(df: DataFrame) -> DataFrame:
    """``df``, written once, to be broadcast if its measured bytes allow."""
    df, m = materialize(df)
    return F.broadcast(df) if m["bytes"] <= BROADCAST_BYTES else df


# --- paths


def places(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, pos, digest, chars)``: the turns of every conversation, counted from
    1, by number (null first), then digest; a repeated row is a turn of its own."""
    c = conversations
    role, text = F.coalesce(c[role_col].cast("string"), F.lit("")), F.coalesce(c[text_col], F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = c.select(c[conv_col].cast("long").alias("conv"), c[turn_col].cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = rows.where("conv is not null").groupBy("conv", "turn", "digest").agg(F.max("chars").alias("chars"), F.count("*").alias("n"))
    n = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(rows.repartitionByRange(n, "conv", "turn", "digest").withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy("conv", "part").agg(F.sum("n").alias("n")).select("conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    upto = Window.partitionBy("conv", "part").orderBy("turn", "digest").rowsBetween(Window.unboundedPreceding, 0)
    at = dealt.withColumn("upto", F.sum("n").over(upto)).join(per, ["conv", "part"]).withColumn("last", F.col("before") + F.col("upto"))
    return cut_lineage(at.select("conv", F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last"))).alias("pos"), "digest", "chars"))


def as_logged(at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of the conversations as they are: ``(conv, pos, digest, chars)`` and
    ``(conv, size)``."""
    return at, at.groupBy("conv").agg(F.count("*").alias("size"))


def rebuilt(at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: the first h turns of conversation c - c % 100,
    then c's own turns after its first h, with h = crc32(decimal c) % 6."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    base = F.col("conv") - F.col("conv") % 100
    heads = at.where((F.col("pos") <= 5) & (F.col("conv") % 100 == 0)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("heads"))
    own = at.groupBy("conv").agg(F.count("*").alias("own")).withColumns({"h": h, "base": base})
    convs = own.join(heads, "base", "left").withColumn("heads", F.filter(F.coalesce("heads", F.array()), lambda x: x["pos"] <= F.col("h")))
    convs = convs.select("conv", "h", "own", "heads", F.size("heads").cast("long").alias("b"))
    convs = cut_lineage(convs.withColumn("size", F.col("b") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    # a conversation's numbers meet its turns in pieces, so a long one is not one join key
    moves = convs.select("conv", "h", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / COUNTED))).alias("piece"))
    later = at.where(F.col("pos") > h).withColumn("piece", F.floor(F.col("pos") / COUNTED)).join(moves, ["conv", "piece"])
    turns = later.select("conv", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "digest", "chars").unionByName(
        convs.select("conv", F.inline("heads")).select("conv", "pos", "digest", "chars"))
    return turns, convs.select("conv", "size")


def segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv, seg, n, path, chars, last)``: up to ``SEGMENT`` turns a row; a
    conversation without turns has one empty row."""
    rows = turns.groupBy("conv", F.floor((F.col("pos") - 1) / SEGMENT).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("t"))
    pieces = convs.where("size > 0").select("conv", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / SEGMENT))).alias("seg"))
    rows = rows.join(pieces, ["conv", "seg"]).select("conv", "seg", F.size("t").alias("n"), F.unhex(F.array_join("t.digest", "")).alias("path"),
                                                     F.col("t.chars").alias("chars"), (F.col("size") <= (F.col("seg") + 1) * SEGMENT).alias("last"))
    empty = convs.where("size = 0").select("conv", F.lit(0).cast("long").alias("seg"), F.lit(0).alias("n"), F.lit(b"").alias("path"),
                                           F.array().cast("array<bigint>").alias("chars"), F.lit(True).alias("last"))
    return rows.unionByName(empty)


def _sums(rows: DataFrame) -> DataFrame:
    """Running hash sums over a conversation's segments, before (b) and after (a) each."""
    for j in (1, 2):  # two independent 64-bit hashes; sums are exact decimals
        rows = rows.withColumn(f"h{j}", F.xxhash64(F.lit(j), "seg", "path").cast("decimal(38,0)"))
    rows = rows.withColumn("block", F.floor(F.col("seg") / COUNTED))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("conv", "block").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("conv", "block").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    blocks = blocks.select("conv", "block", *[F.coalesce(F.sum(f"s{j}").over(before), F.lit(0)).alias(f"o{j}") for j in (1, 2)])
    rows = rows.withColumns({f"a{j}": F.sum(f"h{j}").over(run) for j in (1, 2)}).join(blocks, ["conv", "block"])
    return rows.withColumns({f"a{j}": F.col(f"a{j}") + F.col(f"o{j}") for j in (1, 2)}).withColumns({f"b{j}": F.col(f"a{j}") - F.col(f"h{j}") for j in (1, 2)})


def _place(seg: Column, s1: Column, s2: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", seg.cast("string"), s1.cast("string"), s2.cast("string")).cast("binary")))


# --- shards, skeleton and the pass over a shard

_ROW = ("shard", "key", "conv", "seg", "chars", "last", "x_kids", "x_leaves", "x_saved", "root_conv")
_OUT = "kind string, key binary, parent_key binary, conv long, depth long, parent_conv long, n long, kids long, leaves long, saved long, ends string, chars long, seg long, more boolean, x_kids long, x_leaves long, x_saved long, root_conv long"
_TYPES = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in _OUT.split(", "))])


class _Node:
    __slots__ = ("key", "depth", "seg", "chars", "conv", "n", "kids", "leaves", "saved", "more", "x", "root_conv", "waiting", "sha", "ids", "spread")

    def __init__(self, key: bytes, seg: int, chars: int, root_conv: int | None, spread: bool):
        self.key, self.seg, self.chars, self.root_conv, self.spread = key, seg, chars, root_conv, spread
        self.depth = len(key) // 16 - 1 + seg * SEGMENT
        self.conv = None
        self.n = self.kids = self.leaves = self.saved = 0
        self.more, self.x = False, (0, 0, 0)
        self.waiting: list[dict] = []  # finished children, until this node's smallest member is known
        self.sha, self.ids = None, []

    def add(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n

    def finish(self) -> dict:
        """Totals of a node whose children are all in."""
        self.kids += self.x[0]
        self.leaves += self.x[1] + (not self.kids and not self.more)
        self.saved += self.x[2] + (self.n - 1) * self.chars
        return {"kind": "node", "key": self.key, "conv": self.conv, "depth": self.depth, "n": self.n, "kids": self.kids, "leaves": self.leaves, "saved": self.saved, "seg": self.seg}


class _Rows:
    """Emitted rows, as Arrow batches of bounded size."""

    def __init__(self):
        self.rows: list[dict] = []

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_pylist(self.rows, schema=_SCHEMA)
            self.rows = []


def _hand_up(node: _Node, record: dict, parent: _Node | None, out: list[dict]) -> None:
    """Where a finished node goes: under the conversation of its parent once that
    is known, or at once with the key of a parent that is spread over shards."""
    out += [r | {"parent_conv": node.conv} for r in node.waiting]
    if parent is None:
        out.append(record | {"kind": "root" if node.seg == 0 else "below"})
        return
    parent.add(node.conv, node.n)
    parent.kids += 1
    parent.leaves += node.leaves
    parent.saved += node.saved
    if len(parent.key) == 16 and parent.seg:  # the parent ends the segment before
        out.append(record | {"parent_conv": parent.root_conv})
    elif parent.spread:
        out.append(record | {"kind": "top", "parent_key": parent.key})
    else:
        parent.waiting.append(record)


def _walk(skeleton):
    """The pass over sorted shards."""
    def run(batches):
        spread, out = skeleton.value[1], _Rows()
        stack: list[_Node] = []
        before, shard = b"", None

        def send_ids(node: _Node) -> None:
            if node.ids:
                text = ",".join(map(str, node.ids))
                if node.spread:
                    out.rows.append({"kind": "ends", "key": node.key, "conv": node.ids[0], "ends": text})
                else:
                    first = node.sha is None
                    node.sha = node.sha or hashlib.sha256()
                    node.sha.update((text if first else "," + text).encode())
                node.ids = []

        def close() -> None:
            node = stack.pop()
            parent = stack[-1] if stack else None
            send_ids(node)
            if node.spread:
                out.rows.append({"kind": "part", "key": node.key, "conv": node.conv, "depth": node.depth, "n": node.n, "kids": node.kids, "leaves": node.leaves, "saved": node.saved, "chars": node.chars,
                                 "seg": node.seg, "more": node.more, "x_kids": node.x[0], "x_leaves": node.x[1], "x_saved": node.x[2], "root_conv": node.root_conv})
            else:
                _hand_up(node, node.finish() | {"ends": node.sha.hexdigest() if node.sha else _NOTHING}, parent, out.rows)

        for batch in batches:
            for row in range(batch.num_rows):
                at, key, conv, seg, chars, last, x_kids, x_leaves, x_saved, root_conv = (batch.column(c)[row].as_py() for c in range(len(_ROW)))
                same, end = 0, 0 if at != shard else min(len(before), len(key))
                while same < end and before[same:same + 16] == key[same:same + 16]:
                    same += 16
                while 16 * len(stack) > same:
                    close()
                for depth in range(len(stack), len(key) // 16):
                    node_key = key[:16 * (depth + 1)]
                    stack.append(_Node(node_key, seg, chars[depth - 1] if depth else 0, root_conv, node_key in spread))
                top = stack[-1]
                top.add(conv, 1)
                if last:
                    top.ids.append(conv)
                    if len(top.ids) == ENDS:
                        send_ids(top)
                else:
                    top.more, top.x = True, (x_kids, x_leaves, x_saved)
                before, shard = key, at
                yield from out.batches(1 << 14)
        while stack:
            close()
        yield from out.batches(1)

    return run


def _complete(batches):
    """The pass over the reduced skeleton, in order of keys."""
    out, stack = _Rows(), []

    def close() -> None:
        node = stack.pop()
        _hand_up(node, node.finish(), stack[-1] if stack else None, out.rows)

    for batch in batches:
        for r in batch.to_pylist():
            while stack and not r["key"].startswith(stack[-1].key):
                close()
            node = _Node(r["key"], r["seg"], r["chars"], r["root_conv"], False)
            node.conv, node.n, node.kids, node.leaves, node.saved, node.more = r["conv"], r["n"], r["kids"], r["leaves"], r["saved"], r["more"]
            node.x = (r["x_kids"], r["x_leaves"], r["x_saved"])
            stack.append(node)
            yield from out.batches(1 << 14)
    while stack:
        close()
    yield from out.batches(1)


def _hash_ends(batches):
    """SHA-256 of each skeleton node's ids from its ordered pieces, one at a time."""
    key, sha, done = None, None, []
    for batch in batches:
        for i in range(batch.num_rows):
            at, text = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
            if at != key:
                if sha is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = at, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], (pa.binary(), pa.string())[c]) for c in (0, 1)], names=["key", "ends"])
        done = []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "ends"])


def _splitters(rows: DataFrame, n_turns: int, n_shards: int) -> list[tuple[bytes, int]]:
    """Keys that cut the rows into about ``n_shards`` shards of equal turns."""
    if n_shards < 2:
        return []
    share = F.lit(min(1.0, SAMPLED * n_shards / max(1, n_turns))) * (F.size("chars") + 1)
    sample, m = materialize(rows.where(F.shiftrightunsigned(F.xxhash64("conv", "seg"), 11) < share * float(1 << 53)).select("key", "conv"))
    every = max(1, m["count"] // n_shards)
    ranked = sample.withColumn("r", F.row_number().over(Window.orderBy("key", "conv")))  # over the bounded sample
    return [(bytes(r["key"]), r["conv"]) for r in ranked.where(F.col("r") % every == 0).orderBy("r").collect()]


def _trie(rows: DataFrame, n_turns: int) -> tuple[DataFrame, DataFrame]:
    """Finished nodes of the tries of ``rows``: (those of the shards, with the ends'
    digest; those of the skeleton, without it) and the pieces of the skeleton's ends."""
    spark = rows.sparkSession
    n_shards = int(min(MAX_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // SHARD_TURNS))))
    cuts = _splitters(rows, n_turns, n_shards)
    skeleton = spark.sparkContext.broadcast((cuts, {key[:k] for key, _ in cuts for k in range(16, len(key) + 1, 16)}))

    def deal(batches):
        at = skeleton.value[0]
        for b in batches:
            shards = [bisect_right(at, (k.as_py(), c.as_py())) for k, c in zip(b.column(0), b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *b.columns], names=["shard", *b.schema.names])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.select(*_ROW[1:])
    dealt = rows.mapInArrow(deal, "shard int, " + ", ".join(f"{c} {kinds[c]}" for c in _ROW[1:]))
    sorted_rows = dealt.repartition(n_shards, "shard").sortWithinPartitions("shard", "key", "conv")
    walked = cut_lineage(sorted_rows.mapInArrow(_walk(skeleton), _OUT))
    parts = walked.where("kind = 'part'").groupBy("key").agg(
        *[F.min(c).alias(c) for c in ("conv", "root_conv")], *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")],
        *[F.max(c).alias(c) for c in ("depth", "chars", "seg", "more", "x_kids", "x_leaves", "x_saved")])
    spine = cut_lineage(parts.repartition(1).sortWithinPartitions("key").mapInArrow(_complete, _OUT))  # bounded by the splitters
    return walked, spine


def _below(rows: DataFrame, n_turns: int, links: DataFrame, deepest: int) -> DataFrame:
    """``(tip, x_kids, x_leaves, x_saved)``: what hangs below the end of a segment.

    Each further segment's trie gives its own sums; pointer doubling adds those of
    all tries below it, in as many rounds as the depth in segments has bits."""
    walked, spine = _trie(rows, n_turns)
    own = walked.where("kind = 'below'").unionByName(spine.where("kind = 'below'")).select(F.col("key").alias("tip"), F.col("kids").alias("x_kids"), F.col("leaves").alias("x_leaves"), F.col("saved").alias("x_saved"))
    sums = cut_lineage(own.join(links.select("tip", F.col("root").alias("up")), "tip"))
    reach = 1
    while reach < deepest:
        lower = sums.groupBy("up").agg(F.sum("x_leaves").alias("l"), F.sum("x_saved").alias("s")).withColumnRenamed("up", "tip")
        over = sums.select(F.col("tip").alias("up"), F.col("up").alias("upper"))
        sums = cut_lineage(sums.join(lower, "tip", "left").join(over, "up", "left").select(
            "tip", F.coalesce("upper", F.lit(_ROOT)).alias("up"), "x_kids", (F.col("x_leaves") + F.coalesce("l", F.lit(0))).alias("x_leaves"), (F.col("x_saved") + F.coalesce("s", F.lit(0))).alias("x_saved")))
        reach *= 2
    return sums.drop("up")


def prefix_trie(conversations: DataFrame, paths=as_logged, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct prefix of the conversations' turns (role and text), from
    the empty one on: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``
    (of the parent; null for the root), ``n_convs`` (members), ``n_children``,
    ``n_leaves`` (childless nodes in its subtree), ``saved_tokens`` (over its subtree,
    members but one times code points of the node's last text: what a shared prefix
    cache saves), ``ends_sha256`` (of the ids of members that end there).

    ``paths`` may rebuild the turns first. Null roles and texts count as empty; rows
    without a conversation id belong to none and are left out; turns of one number
    order by the digest of role and text; repeated rows are turns of their own; extra
    columns are not read; an empty table has no node.
    """
    turns, convs = paths(places(conversations, conv_col, turn_col, role_col, text_col))
    total = convs.agg(F.sum("size").alias("n"), F.max("size").alias("longest")).first()
    n_turns, longest = total["n"] or 0, total["longest"] or 0
    rows = cut_lineage(segments(turns, convs))
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    plain = {"x_kids": zero, "x_leaves": zero, "x_saved": zero}
    if longest <= SEGMENT:
        keyed = rows.withColumn("key", F.concat(F.lit(_ROOT), "path")).withColumns({**plain, "root_conv": none})
    else:
        sums = _sums(rows)
        root = F.when(F.col("seg") == 0, F.lit(_ROOT)).otherwise(_place(F.col("seg"), F.col("b1"), F.col("b2")))
        sums = cut_lineage(sums.withColumns({"root": root, "tip": F.when(F.col("n") == SEGMENT, _place(F.col("seg") + 1, F.col("a1"), F.col("a2")))}).drop("a1", "a2", "b1", "b2", "h1", "h2", "o1", "o2", "block"))
        links = cut_lineage(sums.where("tip is not null").groupBy("tip").agg(F.min("conv").alias("root_conv"), F.min("root").alias("root")))
        roots = _sized(links.select(F.col("tip").alias("root"), "root_conv"))
        sums = sums.join(roots, "root", "left").withColumn("key", F.concat("root", "path"))
        lower = sums.where("seg > 0").withColumns(plain)
        below = _sized(_below(lower, n_turns, links, -(-longest // SEGMENT)))
        keyed = sums.join(below, "tip", "left")
    keyed = cut_lineage(keyed.select(*[c for c in _ROW[1:]]))
    walked, spine = _trie(keyed, n_turns)
    ends = walked.where("kind = 'ends'").select("key", "conv", "ends")
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = ends.repartition(n, "key").sortWithinPartitions("key", "conv").mapInArrow(_hash_ends, "key binary, ends string")
    skeleton = spine.where("kind in ('node', 'root')").drop("ends").join(hashed, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(_NOTHING)))
    over = _sized(spine.where("kind in ('node', 'root')").select(F.col("key").alias("parent_key"), F.col("conv").alias("over")))
    tops = walked.where("kind = 'top'").drop("parent_conv").join(over, "parent_key").withColumnRenamed("over", "parent_conv")
    out = ["conv", "depth", "parent_conv", "n", "kids", "leaves", "saved", "ends"]
    nodes = walked.where("kind in ('node', 'root')").select(*out).unionByName(tops.select(*out)).unionByName(skeleton.select(*out))
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
                        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


ships_by_value(__name__)
