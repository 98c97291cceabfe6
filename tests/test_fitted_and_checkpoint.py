"""Saved preparations against refitted ones; checkpoint files by hand; the CSV
dialect against pandas; splits with bad ids; gated streams."""

import io as pyio
import pickle
import struct
import uuid
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001
from strata.operators import impute as imp
from strata.operators import model as mdl
from strata.operators import quality as qa
from strata.operators.impute import Tier
from strata.operators.network import Schedule
from strata.operators.split import split_exact
from strata.plans import fitted, ladders
from strata.plans import pipelines as P
from strata.session import ensure_checkpoint_dir
from strata.sources import checkpoint as ckpt
from strata.sources import io
from strata.sources.fixtures import readings
from strata.streaming.serve import fit_serve_model, run_gated_stream, serve_features_frozen


def shared(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def by_row(df):
    return df.toPandas().sort_values("row_id").reset_index(drop=True)


# --- saved models


def test_serving_from_a_loaded_model(spark):
    r = readings(spark, SF001)
    test = r.drop("demand")
    path = shared(spark, "serving")
    fitted.fit_serving(test, r).write().save(path)
    loaded = PipelineModel.load(path)
    pd.testing.assert_frame_equal(by_row(loaded.transform(test)), by_row(P.serve_features(test, r)))
    few = test.where("row_id % 7 = 3")  # fitted on all rows, so fewer rows come out the same
    pd.testing.assert_frame_equal(by_row(loaded.transform(few)), by_row(loaded.transform(test).where("row_id % 7 = 3")))


def test_ladders_are_frozen_from_one_scan(spark, monkeypatch):
    test = ladders.with_helpers(readings(spark, SF001).drop("demand"))
    plan = ladders.serving_plan()
    with monkeypatch.context() as m:
        m.setattr(imp, "one_scan", lambda plan: False)  # a scan per ladder
        want = imp.freeze_plan(test, plan)
    monkeypatch.setattr(imp, "_bin_table", None)  # not called: the bins of all ladders come from one scan
    got = imp.freeze_plan(test, plan)
    assert [c for c, _ in got] == [c for c, _ in want]
    for (_, a), (_, b) in zip(got, want):
        assert [(k.tier, k.value, k.n_bytes) for k in a] == [(k.tier, k.value, k.n_bytes) for k in b]
        for x, y in zip(a, b):
            assert (x.table is None) == (y.table is None)
            if x.table is not None:
                assert x.table.schema == y.table.schema and x.table.exceptAll(y.table).isEmpty() and y.table.exceptAll(x.table).isEmpty()


def test_generated_methods_are_small_enough_to_be_compiled(spark):
    """The JVM only interprets methods of more than 8,000 bytes."""
    r = readings(spark, SF001)
    test = r.drop("demand")
    frames = [fitted.fit_serving(test, r).transform(test), P.serve_features(test, r), P.train_features(r)[0], P.alt_features(test, r)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan is generated only while it runs
    try:
        for df in frames:
            codes = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
            sizes = [codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_features_used_twice_in_a_plan(spark):
    r = readings(spark, SF001)
    one = P.serve_features(r.drop("demand"), r)
    n = one.count()
    assert one.unionAll(one).count() == 2 * n
    assert one.join(one.select("row_id", F.col("latitude").alias("lat")), "row_id").count() == n


def test_scaler_and_network_come_back(spark):
    train = spark.createDataFrame([(k, float(k % 7), float(k % 3), float(k % 7) * 2 - k % 3, k % 4 == 0) for k in range(80)], "row_id long, a double, b double, demand double, is_val boolean")
    scaler = fitted.Standardizer(["a"]).fit(train)
    schedule = Schedule(epochs=2, batch_rows=None, hidden=(4,), dropout=(0.0,))
    net = fitted.NetworkRegressor(["a", "b"], "demand", shared(spark, "run"), schedule=schedule).fit(scaler.transform(train))
    chain, path = PipelineModel([scaler, net]), shared(spark, "scoring")
    chain.write().save(path)
    pd.testing.assert_frame_equal(by_row(PipelineModel.load(path).transform(train)), by_row(chain.transform(train)))
    assert chain.transform(train).columns == [*train.columns, "prediction"]


def test_ladders_with_python_functions_are_not_saved(spark):
    df = spark.createDataFrame([(1, "a", None, "1:0")], "row_id long, geohash string, Temperature double, timestamp string")
    model = fitted.LadderImputer([("Temperature", [Tier("f", stat="derive", derive=lambda c: c, derive_from="row_id")])], provenance=True).fit(df)
    assert model.transform(df).first()["Temperature"] == 1.0
    with pytest.raises(ValueError, match="cannot be saved"):
        model.write().save(shared(spark, "none"))


# --- checkpoints


def test_checkpoint_round_trip(spark):
    w = mdl.init_mlp_weights(5, (4, 3))
    path = shared(spark, "model") + "/best.pt"
    ckpt.save_checkpoint(w, path)
    got = mdl.weights_from_table(io.load_weights(spark, path))
    assert got.keys() == w.keys() and all(np.array_equal(got[k], w[k]) for k in w)


def archive(index: bytes, records: dict[str, bytes], path: str):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("best_model/data.pkl", index)
        for k, v in records.items():
            z.writestr(f"best_model/{k}", v)


def tensor(name, kind, key, numel, offset, shape, strides):
    ints = lambda v: b"(" + b"".join(b"K" + bytes([x]) for x in v) + b"t"
    text = lambda s: b"X" + struct.pack("<I", len(s)) + s.encode()
    return (text(name) + b"ctorch._utils\n_rebuild_tensor_v2\n(" + b"(" + text("storage") + f"ctorch\n{kind}\n".encode() + text(key) + text("cpu") + b"K" + bytes([numel]) + b"tQ"
            + b"K" + bytes([offset]) + ints(shape) + ints(strides) + b"\x89ccollections\nOrderedDict\n)RtR")


HEAD = b"\x80\x02ccollections\nOrderedDict\n)R("


def test_checkpoint_built_by_hand(spark, tmp_path):
    """Float, half, bfloat16 and long storages, a transposed view, a shared storage, nesting."""
    f4 = np.arange(6, dtype="<f4")
    bf = np.array([1.0, -2.5], np.float32).view(np.uint32) >> 16
    inner = b"X\x05\x00\x00\x00state" + b"}(" + tensor("w", "FloatStorage", "0", 6, 0, (3, 2), (1, 3)) + tensor("tail", "FloatStorage", "0", 6, 4, (2,), (1,)) + b"u"
    index = HEAD + inner + tensor("h", "HalfStorage", "1", 2, 0, (2,), (1,)) + tensor("b", "BFloat16Storage", "2", 2, 0, (2, 1), (1, 1)) + tensor("n", "LongStorage", "3", 1, 0, (), ()) \
        + tensor("none", "FloatStorage", "0", 6, 0, (0, 4), (4, 1)) + b"X\x05\x00\x00\x00epochK\x07" + b"u."
    path = str(tmp_path / "model.pt")
    archive(index, {"data/0": f4.tobytes(), "data/1": np.array([0.5, 3], "<f2").tobytes(), "data/2": bf.astype("<u2").tobytes(), "data/3": np.array([42], "<i8").tobytes(), "byteorder": b"little"}, path)
    got = mdl.weights_from_table(io.load_weights(spark, path))
    want = {"state.w": f4.reshape(2, 3).T, "state.tail": f4[4:], "h": [0.5, 3], "b": [[1.0], [-2.5]], "n": 42, "none": np.zeros((0, 4))}
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)


def test_checkpoint_refuses_foreign_content(spark, tmp_path):
    class Evil:
        def __reduce__(self):
            return (eval, ("1 + 1",))

    path = str(tmp_path / "evil.pt")
    for index, record, why in [(pickle.dumps({"w": Evil()}), b"", "refused: .*eval"), (HEAD + tensor("w", "FloatStorage", "0", 2, 1, (2,), (1,)) + b"u.", b"12345678", "beyond its storage"),
                               (HEAD + tensor("w", "FloatStorage", "0", 2, 0, (2,), (1,)) + b"u.", b"123", "cut short"), (b"\x80\x02cut", b"", "cannot be read")]:
        archive(index, {"data/0": record}, path)
        with pytest.raises(Exception, match=why):
            io.load_weights(spark, path).collect()
    with open(path, "wb") as f:
        f.write(b"no container")
    with pytest.raises(Exception, match="no checkpoint container"):
        io.load_weights(spark, path).collect()


# --- CSV


TEXTS = ['say "hi" now', "a, b", "two\nlines", '"', "plain", "", None, " led", "tab\there", "back\\slash", "it's"]


def test_csv_dialect_equals_pandas(spark, tmp_path):
    frame = pd.DataFrame({"k": range(len(TEXTS)), "text": TEXTS})
    frame.to_csv(tmp_path / "by_pandas.csv", index=False)
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("text", T.StringType())])
    want = {k: None if pd.isna(t) else t for k, t in pd.read_csv(tmp_path / "by_pandas.csv").itertuples(index=False)}
    read = io.read_csv(spark, str(tmp_path / "by_pandas.csv"), schema)
    assert {r.k: r.text for r in read.collect()} == want
    io.write_table(read, str(tmp_path / "ours"), "csv")
    parts = [pd.read_csv(p) for p in sorted((tmp_path / "ours").glob("part-*.csv"))]
    again = {int(k): None if pd.isna(t) else t for k, t in pd.concat(parts).itertuples(index=False)}
    assert again == want
    assert {r.k: r.text for r in io.read_csv(spark, str(tmp_path / "ours"), schema).collect()} == want
    no_breaks = frame[~frame.text.fillna("").str.contains("\n")]
    no_breaks.to_csv(tmp_path / "one_line.csv", index=False)
    assert io.read_csv(spark, str(tmp_path / "one_line.csv"), schema, line_breaks=False).count() == len(no_breaks)


# --- splits, submission, gates


def test_split_names_bad_ids(spark):
    ids = spark.range(50).withColumnRenamed("id", "row_id")
    with pytest.raises(ValueError, match="holds nulls"):
        split_exact(ids.unionAll(spark.createDataFrame([(None,)], "row_id long")))
    with pytest.raises(ValueError, match="repeats at the cut-off"):
        split_exact(ids.select(F.lit(1).cast("long").alias("row_id")))
    assert split_exact(ids).where("is_val").count() == 10 and split_exact(ids, frac=1.0).where("is_val").count() == 50


def test_submission_runs_its_plan_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    df = spark.range(40).selectExpr("id as row_id", "cast(id as double) / 2 as p").mapInArrow(count, "row_id long, p double")
    out = io.submission(df, "row_id", "p", expected=spark.range(40).withColumnRenamed("id", "row_id"))
    assert out.count() == 40 and ran.value == 40


@pytest.mark.parametrize("path", ["const", "alt", "frozen"])
def test_gates_in_every_path(spark, path):
    r = readings(spark, SF001)
    first = r.agg(F.min("row_id")).first()[0]
    broken = r.withColumn("timestamp", F.when(F.col("row_id") == first, "25:0").otherwise(F.col("timestamp"))).drop("demand")
    build = {"const": lambda **k: P.const_features(broken, r, **k), "alt": lambda **k: P.alt_features(broken, r, **k),
             "frozen": lambda **k: serve_features_frozen(broken, fit_serve_model(r.drop("demand"), r), **k)}[path]
    with pytest.raises(Exception, match="quality gate: range:hour"):
        build().write.format("noop").mode("overwrite").save()
    build(enforce=False).write.format("noop").mode("overwrite").save()


def test_bad_rows_of_a_stream_are_set_aside(spark, tmp_path):
    r = readings(spark, SF001)
    test = r.drop("demand")
    a, b, c = [x.row_id for x in test.select("row_id").orderBy("row_id").limit(3).collect()]
    dirty = test.withColumns({"timestamp": F.when(F.col("row_id") == a, "nonsense").otherwise(F.col("timestamp")),
                              "geohash": F.when(F.col("row_id").isin(a, b), "aaa").otherwise(F.col("geohash")),
                              "Landmarks": F.when(F.col("row_id") == c, F.lit(None)).otherwise(F.col("Landmarks"))})
    dirty.repartition(2).write.parquet(str(tmp_path / "src"))
    model = fit_serve_model(test, r)
    dirs = [str(tmp_path / d) for d in ("sink", "bad", "metrics", "ckpt")]
    run_gated_stream(spark, str(tmp_path / "src"), test.schema, model, *dirs).awaitTermination(300)
    bad = {x.row_id: set(x._failed) for x in spark.read.parquet(dirs[1]).collect()}
    assert bad == {a: {"range:hour", "slots:minute", "domain:geohash"}, b: {"domain:geohash"}, c: {"domain:Landmarks"}}
    got = spark.read.parquet(dirs[0]).drop("batch")
    pd.testing.assert_frame_equal(by_row(got), by_row(serve_features_frozen(test.where(~F.col("row_id").isin(a, b, c)), model)))
    counts = {x.metric: x.n for x in spark.read.parquet(dirs[2]).groupBy("metric").agg(F.sum("n").alias("n")).collect()}
    assert counts["n_rows"] == test.count() and counts["n_quarantined"] == 3 and counts["domain:geohash"] == 2


def test_failed_lists_every_broken_check(spark):
    df = spark.createDataFrame([(1, None), (5, "x")], "a int, b string")
    got = df.select(qa.failed(qa.in_range("a", 3, 9) + qa.not_null(["b"])).alias("f")).collect()
    assert [r.f for r in got] == [["range:a", "not_null:b"], []]
