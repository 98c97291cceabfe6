"""Bins of a whole plan from one scan, merged over batches, against refits."""

import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from strata.operators import impute as imp
from strata.operators.impute import Tier
from strata.plans import fitted, ladders
from strata.session import ensure_checkpoint_dir
from strata.sources.fixtures import readings
from strata.streaming import ladder_state as state


def by_row(df):
    return df.toPandas().sort_values("row_id").reset_index(drop=True)


def test_state_after_batches_equals_a_refit(spark, tmp_path):
    plan = ladders.training_plan()
    r = readings(spark, SF001).drop("demand")
    path = f"{ensure_checkpoint_dir(spark)}/ladders-{uuid.uuid4().hex}"
    with pytest.raises(ValueError, match="no ladder state"):
        state.current(spark, plan, path)
    src = str(tmp_path / "src")
    r.repartition(4, "row_id").write.parquet(src)
    state.run_ladder_stream(spark, src, r.schema, plan, path, str(tmp_path / "ckpt"), files_per_batch=1).awaitTermination(600)
    refit = fitted.LadderImputer(plan).fit(r)
    pd.testing.assert_frame_equal(by_row(state.current(spark, plan, path).transform(r)), by_row(refit.transform(r)))
    # the last batch once more, as after a failure: nothing is counted twice
    last = state._pointer(spark, path)["batch"]
    n = spark.read.parquet(f"{path}/pointers").count()
    state.update(r.limit(0), last + 1, plan, path)
    pd.testing.assert_frame_equal(by_row(state.current(spark, plan, path).transform(r)), by_row(refit.transform(r)))
    state.update(r, 10 ** 6, plan, path)
    state.update(r.limit(0), 10 ** 6, plan, path)
    assert n == 4 and state._pointer(spark, path)["batch"] == 10 ** 6
    pd.testing.assert_frame_equal(by_row(state.current(spark, plan, path).transform(r)), by_row(refit.transform(r)))


@pytest.mark.parametrize("plan", [ladders.training_plan, ladders.serving_plan, ladders.alt_plan])
@pytest.mark.parametrize("strategy", ["window", "bins"])
def test_one_scan_equals_scans_per_ladder(spark, monkeypatch, plan, strategy):
    r = ladders.with_helpers(readings(spark, SF001))
    assert imp.one_scan(plan())
    got = by_row(imp.impute_all(r, plan(), strategy=strategy))
    monkeypatch.setattr(imp, "one_scan", lambda plan: False)
    pd.testing.assert_frame_equal(got, by_row(imp.impute_all(r, plan(), strategy=strategy)))


def test_plan_that_groups_by_a_filled_column(spark):
    """Weather's fills change the groups of Temperature: no single scan can bin them."""
    plan = [("w", [Tier("W", ("k",), "mode")]), ("t", [Tier("T", ("w",), "median")])]
    assert not imp.one_scan(plan)
    df = spark.createDataFrame([(1, "a", "x", 1.0), (2, "a", None, None), (3, "b", "y", 5.0), (4, "b", "y", 7.0), (5, "b", None, None)], "row_id long, k string, w string, t double")
    got = {r.row_id: (r.w, r.t) for r in imp.impute_all(df, plan).collect()}
    assert got == {1: ("x", 1.0), 2: ("x", 1.0), 3: ("y", 5.0), 4: ("y", 7.0), 5: ("y", 6.0)}


def test_bins_of_parts_add_up(spark):
    r = ladders.with_helpers(readings(spark, SF001))
    plan = ladders.serving_plan()
    halves = imp.merge_bins(imp.plan_bins(r.where("row_id % 2 = 0"), plan), imp.plan_bins(r.where("row_id % 2 = 1"), plan))
    assert halves.exceptAll(imp.plan_bins(r, plan)).isEmpty() and imp.plan_bins(r, plan).exceptAll(halves).isEmpty()


def test_gates_do_not_repeat_what_they_read(spark):
    """The gate's filter stands above the projections, with columns only."""
    from strata.plans import pipelines as P
    r = readings(spark, SF001).withColumns({"Temperature": F.lit(1.0), "RoadType": F.lit("Street"), "Weather": F.lit("Sunny")})
    plan = P.encode(P.decode(r), checks=P.row_checks())._jdf.queryExecution().optimizedPlan().toString()
    gate = next(line for line in plan.splitlines() if "quality gate" in line)
    assert "Filter" in gate and "split(" not in gate and "RLIKE" not in gate
