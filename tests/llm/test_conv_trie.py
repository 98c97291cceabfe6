"""The prefix trie of conversations against a brute-force version, with short
segments and many shards too, and on edge rows."""

import hashlib
import random
import zlib

import pytest

from conftest import SF001, SF01
from strata.llm import conv_trie, queries
from strata.llm.common import table


def brute(conversations: dict[int, list[tuple[str, str]]], rebuild: bool):
    paths = {}
    for c, turns in conversations.items():
        if rebuild:
            h = zlib.crc32(str(c).encode()) % 6
            turns = conversations.get(c - c % 100, [])[:h] + turns[h:]
        paths[c] = turns
    members: dict[tuple, list[int]] = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, list[tuple]] = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids.get(p, []))
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def rows_of(df):
    conversations: dict[int, list] = {}
    for r in df.collect():
        if r.conv_id is not None:
            role, text = r.role or "", r.text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            conversations.setdefault(r.conv_id, []).append(((r.turn is not None, r.turn or 0), digest, (role, text)))
    return {c: [t for *_, t in sorted(x)] for c, x in conversations.items()}


def check(df, rebuild=True):
    want = brute(rows_of(df), rebuild)
    got = conv_trie.prefix_trie(df, conv_trie.rebuilt if rebuild else conv_trie.as_logged)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def made(seed, n=60, longest=14, words=3):
    """Conversations that share prefixes, copies, and a group of exact copies of a third."""
    rng = random.Random(seed)
    convs = {}
    for _ in range(n):
        c = rng.choice([rng.randrange(0, 320), rng.randrange(0, 8) * 100])
        old = list(convs.values())
        turns = list(rng.choice(old))[:rng.randrange(0, longest)] if old and rng.random() < 0.7 else []
        turns += [(rng.choice(["user", "assistant"]), "wörd " * rng.randrange(words)) for _ in range(rng.randrange(0, longest - len(turns) + 1))]
        convs[c] = turns
    same = rng.choice([t for t in convs.values() if len(t) >= 3])
    convs |= {1000 + k: list(same) for k in range(n // 2)}
    rows = [(c, k, role, text, 1) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, pos int"


@pytest.mark.parametrize("segment,shard", [(256, 50_000), (3, 50), (4, 20), (1, 100), (256, 10)])
def test_trie_against_brute_force(spark, monkeypatch, segment, shard):
    monkeypatch.setattr(conv_trie, "SEGMENT", segment)
    monkeypatch.setattr(conv_trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(conv_trie, "ENDS", 4)
    df = spark.createDataFrame(made(segment), SCHEMA).repartition(3)
    check(df, rebuild=True)
    if segment == 3:
        check(df, rebuild=False)


def test_trie_of_the_table(spark):
    df = table(spark, SF001, "conversations")
    got = queries.op11(spark, SF001)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows_of(df), True), key=key)


def test_edge_rows(spark):
    edge = [(1, None, None, None, 0), (1, None, "", "", 0), (1, 3, "user", "x" * 5000, 0), (1, 3, "user", "x" * 5000, 0), (None, 1, "user", "nobody", 0),
            (2, 5, None, "", 0), (100, -1, "a", "é", 0), (100, 7, "a", None, 0), (-5, 1, "a", "é", 0), (163, 1, "user", "later", 0)]
    check(spark.createDataFrame(edge, SCHEMA))
    check(spark.createDataFrame(edge, SCHEMA), rebuild=False)


def test_only_turnless_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conv_trie.prefix_trie(empty, conv_trie.rebuilt).count() == 0
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 2)
    check(spark.createDataFrame([(lone, 0, "user", "hello", 0)], SCHEMA))  # its own turn goes and none comes
