"""The corpus pipeline and the registered queries of this subpackage."""

import hashlib
import os
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF001, SF01
from strata.llm import langid, queries
from strata.llm.common import table

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_text_operators import brute_components, brute_report, edge, empty  # noqa: E402

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def test_run_against_brute_force(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    # the first stage is a trained model: its predictions are taken, its rule is applied here
    labelled = table(spark, SF001, "documents")
    model = langid.fit(langid.training_sample(labelled, F.lit(True)))
    score = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    rows = [r for r in rows if score[r[0]][0] != "und" and score[r[0]][1] >= langid.MIN_SCORE]
    kept = {i for i, _, _, own in brute_components(rows) if own}
    rows = [r for r in rows if r[0] in kept]
    items = [tuple(r) for r in table(spark, SF001, "benchmark").select("item_id", "text").collect()]
    bad = {r[0] for r in brute_report(rows, items) if r[-1]}
    assert bad
    want = {}
    for i, text in rows:
        if i not in bad:
            ids = library.encode(text, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.token_ids) for r in corpus_pipeline.run(spark, SF001).collect()}
    assert got == want


def test_stages_keep_the_columns_and_take_edges(spark):
    for rows in (edge(spark), empty(spark)):
        docs = rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF001)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]


def test_one_query_per_operator():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF01), con.execute(queries.SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_queries_bind_whole_tables(spark):
    counts = {"op1": "documents", "op2": "documents", "op9": "pages"}
    for name, f in queries.QUERIES.items():
        base = name.split("_")[0]
        if base in counts:
            assert f(spark, SF001).count() == table(spark, SF001, counts[base]).count()
