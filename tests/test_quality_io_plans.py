import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001
from strata.operators import quality as Q
from strata.operators.relational import SchemaError, align
from strata.sources import io
from strata.sources.fixtures import readings


def test_expect_counts_violations_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a", 1, 0), (None, "z", 0, 0), (3, "b", 1, 1)], "x int, c string, o1 int, o2 int")
    res = {r.check: r.violations for r in Q.expect(df, Q.not_null(["x"]) + Q.domain("c", ["a", "b"]) +
                                                  Q.in_range("x", 0, 2) + Q.onehot_sum(["o1", "o2"], "o")).collect()}
    assert res == {"not_null:x": 1, "domain:c": 1, "range:x": 2, "onehot_sum:o": 2}
    with pytest.raises(Q.GateError):
        Q.expect(df, Q.not_null(["x"]), enforce=True)


def test_schema_contract_and_align(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert {r.check: r.violations for r in Q.schema_check(df, ["b", "a"]).collect()}["schema:order"] == 1
    assert align(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(SchemaError):
        align(df, ["c"])


def test_read_csv_null_tokens_and_no_inference(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,ts,v\n1,2:0,NA\n2,13:45,null\n3,0:15,nan\n4,1:30,N/A\n5,2:45,\n6,3:0,4.5\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.StringType()),
                           T.StructField("v", T.DoubleType())])
    rows = io.read_csv(spark, str(p), schema).orderBy("id").collect()
    assert [r.v for r in rows] == [None, None, None, None, None, 4.5]
    assert rows[0].ts == "2:0"


def test_scan_prunes_columns(spark):
    plan = readings(spark, SF001).select("row_id", "Temperature")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_apply_fills_broadcasts_small_fill_table(spark):
    from strata.operators.impute import impute_cascade
    from strata.plans import ladders
    out = impute_cascade(ladders.with_helpers(readings(spark, SF001)), "RoadType", ladders.road_ladder())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_window_ladder_shares_one_repartition_for_nested_tiers(spark):
    """TM-1..3 group by (geohash, ...): one hash exchange on geohash serves all
    three windows; Weather needs a second; the global tier starts after a cut."""
    from strata.operators import impute as I
    from strata.plans import ladders
    r = ladders.with_helpers(readings(spark, SF001))
    bins, _, nk, dt, n, _ = I._bin_table(r, "Temperature", ladders.temperature_ladder())
    tiers = ladders.temperature_ladder()[:4]  # keyed tiers only: one plan, no cut
    plan = I._tiers_window(bins, tiers, nk, dt, n)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2
