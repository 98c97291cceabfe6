"""Embedding near-dedup, token files and packing: against brute force and exact
round trips, and on edge rows."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from strata.llm import embed_dedup, packing, token_scan, tokens
from strata.llm.common import shared_path, table
from strata.llm.components import forest

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGE = [(1, None), (2, ""), (3, "some text"), (3, "some text"), (None, "no id"), (4, "x" * 20_000), (5, "word " * 20_000), (6, "<|endoftext|>")]


@pytest.fixture(scope="module")
def encode():
    with open(RANKS, "rb") as f:
        return tokens.encoder(f.read())[0]


# --- embeddings

def brute_links(rows, threshold=0.95):
    usable = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            usable[k] = x / np.sqrt((x * x).sum())
    n, low = [0] * len(rows), list(range(len(rows)))
    for a in usable:
        for b in usable:
            if a != b and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= threshold:
                n[a] += 1
                x, y = low[a], low[b]
                low = [min(x, y) if v in (x, y) else v for v in low]
    first = {}
    for (i, _), c in zip(rows, low):
        first[c] = min(i, first.get(c, i))
    return sorted((i, n[k], first[low[k]], first[low[k]] == i) for k, (i, _) in enumerate(rows))


def vectors(seed=3, groups=12, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(40 if g == 0 else 6):
            rows.append((len(rows), (centre + rng.normal(size=dim) * rng.uniform(0, 0.4)).astype(np.float32).tolist()))
    rows += [(len(rows) + k, rows[k * 3][1]) for k in range(15)]  # copies
    rows.append((len(rows), (2 * np.array(rows[0][1])).tolist()))
    for odd in (None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 0.0], [1.0, 0.01], [5.0], [-5.0], [1e-30] * dim):
        rows.append((len(rows), odd))
    return rows


@pytest.mark.parametrize("tile", [embed_dedup.TILE, 7])
def test_links_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("w", F.lit(1)).withColumn("v", F.lit("x")).withColumn("rep", F.lit(0)).repartition(3)
    got = embed_dedup.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = brute_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert sorted(map(tuple, got.collect())) == want


def test_links_of_the_table(spark):
    df = table(spark, SF01, "embeddings")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    u = np.array([v for _, v in rows])
    u /= np.sqrt((u * u).sum(1))[:, None]
    linked = u @ u.T >= 0.9  # a lower threshold, so that there are links
    np.fill_diagonal(linked, False)
    lab = forest(*np.nonzero(linked), len(rows))
    got = sorted(map(tuple, embed_dedup.near_duplicates(df, 0.9).collect()))
    assert got == sorted((i, int(linked[k].sum()), rows[lab[k]][0], lab[k] == k) for k, (i, _) in enumerate(rows))


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(300, 40)), rng.normal(size=(200, 40))
    b[:60] = a[:60] + rng.normal(size=(60, 40)) * np.linspace(0, 0.8, 60)[:, None]
    a, b = embed_dedup._unit(a), embed_dedup._unit(b)
    axes = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    for t in (0.5, 0.8, 0.95):
        got = sorted((int(i), int(j)) for x, y in embed_dedup._tile_links(a, b, a @ axes, b @ axes, t, False) for i, j in zip(x, y))
        assert got == sorted(zip(*(k.tolist() for k in np.nonzero(a @ b.T >= t))))


def test_embedding_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embed_dedup.near_duplicates(odd).collect()), key=repr) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


# --- token files

@pytest.mark.parametrize("block", [2, 64, 1 << 20])
def test_scan_of_tiny_files(spark, tmp_path, block):
    rng = random.Random(block)
    want, names = [], []
    for f in range(6):
        ids = [rng.choice([9, 1, 2, 3]) if f else 9 for _ in range(rng.randrange(0, 400))]
        if f == 5:
            ids = [1] * 300  # a document without an end
        path = tmp_path / f"{f}.bin"
        path.write_bytes(np.array(ids, "<u2").tobytes())
        names.append(f"file://{path}")
        start, k = 0, 0
        for p, x in enumerate(ids + [9] if ids and ids[-1] != 9 else ids):
            if x == 9:
                want.append((names[-1], k, start, p - start))
                start, k = p + 1, k + 1
    files = spark.createDataFrame([(n,) for n in names + names[:1]], "file string")
    assert sorted(map(tuple, token_scan.scan(files, 2, 9, block_bytes=block).collect())) == sorted(want)


def test_scan_prefix_over_groups_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_scan, "GROUP", 3)
    path = tmp_path / "long.bin"
    path.write_bytes(np.array([1] * 100 + [9] + [1] * 57 + [9, 9] + [2] * 40, "<u4").tobytes())
    got = token_scan.scan(spark.createDataFrame([(f"file://{path}",)], "file string"), 4, 9, block_bytes=16)
    assert sorted((r.ordinal, r.start, r.n_tokens) for r in got.collect()) == [(0, 0, 100), (1, 101, 57), (2, 159, 0), (3, 160, 40)]


def test_token_counts_of_the_table(spark, encode):
    docs = table(spark, SF01, "documents")
    got = {r.doc_id: r.n_tokens for r in token_scan.token_counts(docs, shared_path(spark, "t"), RANKS).collect()}
    assert got == {r.doc_id: len(encode(r.text)) for r in docs.select("doc_id", "text").collect()}


def test_token_count_edges(spark, encode, monkeypatch):
    monkeypatch.setattr(token_scan, "FILE_TOKENS", 1)
    df = spark.createDataFrame(EDGE, "doc_id long, text string").selectExpr("*", "'f' as file", "1 as ordinal", "2 as n_tokens")
    got = token_scan.token_counts(df, shared_path(spark, "t"), RANKS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, len(encode(t))) for i, t in EDGE), key=repr)
    assert token_scan.token_counts(df.limit(0), shared_path(spark, "t"), RANKS).count() == 0


# --- packing

def test_best_fit_decreasing_against_a_scan():
    rng = random.Random(2)
    for _ in range(100):
        cap = rng.randrange(1, 40)
        lengths = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(0, 60))]
        left = []
        for n in sorted(lengths, reverse=True):
            fits = [k for k in range(len(left)) if left[k] >= n]
            if fits:
                left[min(fits, key=lambda k: left[k])] -= n
            else:
                left.append(cap - n)
        rows = packing.best_fit_decreasing(lengths, cap)
        assert sorted(p for r in rows for p in r) == list(range(len(lengths)))
        assert sorted(cap - sum(lengths[p] for p in r) for r in rows) == sorted(left)


def unpacked(rows, width):
    segments = {}
    for r in rows:
        ids, at = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == len(at) == width and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for d, p, s, e in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert at[s:e].tolist() == list(range(e - s))
            segments.setdefault((d, p), []).append(ids[s:e])
        assert (ids[r.n_tokens:] == 50256).all() and (at[r.n_tokens:] == 0).all()
    return segments


def test_packing_round_trip_of_the_table(spark, encode, monkeypatch):
    monkeypatch.setattr(packing, "HELD_TOKENS", 100_000)
    docs = table(spark, SF01, "documents")
    rows = packing.pack(docs, RANKS, row_tokens=512).collect()
    segments = unpacked(rows, 512)
    assert len({(r.lot, r.row) for r in rows}) == len(rows)
    for r in docs.select("doc_id", "text").collect():
        parts, k = [], 0
        while (r.doc_id, k) in segments:
            parts += segments[r.doc_id, k]
            k += 1
        ids = np.concatenate(parts)
        assert ids[-1] == 50256 and np.array_equal(ids[:-1], encode(r.text))
    assert sum(r.n_tokens for r in rows) > 0.97 * 512 * len(rows)


def test_packing_edges(spark, encode, tmp_path):
    df = spark.createDataFrame(EDGE, "doc_id long, text string").selectExpr("*", "1 as lot", "2 as row", "3 as input_ids")
    rows = packing.pack(df, RANKS, row_tokens=64).collect()
    segments = unpacked(rows, 64)
    assert {d for d, _ in segments} == {1, 2, 3, 4, 5, 6, None}
    assert [s.tolist() for s in segments[1, 0]] == [[50256]] and len(segments[3, 0]) == 2
    assert packing.pack(df.limit(0), RANKS).count() == 0
    packing.write_packed(df, str(tmp_path / "packed"), RANKS, row_tokens=64)
    assert spark.read.parquet(str(tmp_path / "packed")).count() == len(rows)
