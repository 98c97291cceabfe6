import pandas as pd

from conftest import SF001
from strata.plans import pipelines as P
from strata.sources.fixtures import readings
from strata.streaming.serve import fit_serve_model, run_stream, serve_features_frozen


def _sorted(df):
    return df.toPandas().sort_values("row_id").reset_index(drop=True)


def test_frozen_lookups_reproduce_the_cascade(spark):
    r = readings(spark, SF001)
    test = r.drop("demand")
    model = fit_serve_model(test, r)
    pd.testing.assert_frame_equal(_sorted(serve_features_frozen(test, model)), _sorted(P.serve_features(test, r)))


def test_stream_matches_batch(spark, tmp_path):
    r = readings(spark, SF001)
    test = r.drop("demand")
    src = str(tmp_path / "src")
    test.repartition(3).write.parquet(src)  # three files arrive in the source folder
    model = fit_serve_model(test, r)
    q = run_stream(spark, src, test.schema, model, str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    got = _sorted(spark.read.parquet(str(tmp_path / "sink")))
    exp = _sorted(serve_features_frozen(spark.read.parquet(src), model))
    pd.testing.assert_frame_equal(got, exp)
