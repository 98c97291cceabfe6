"""Registered queries: one per operator of the inventory, each over the whole
input tables (readings view over ``events``, or the TPC-H-like tables), with
its DuckDB oracle SQL. Computed doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata import functions as fn
from strata.operators import encode as enc
from strata.operators import impute as imp
from strata.operators import model as mdl
from strata.operators import profile as prof
from strata.operators import quality as qa
from strata.operators import relational as rel
from strata.operators.batches import epoch_batches
from strata.operators.network import Schedule, fit_network
from strata.operators.scale import scaler_apply, scaler_fit, scaler_params, standardize
from strata.operators.split import split_exact
from strata.plans import fitted, ladders
from strata.plans import oracle as O
from strata.plans import pipelines as P
from strata.session import cut_lineage, ensure_checkpoint_dir
from strata.sources import io
from strata.sources.checkpoint import save_checkpoint
from strata.sources.fixtures import readings, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(f):
        QUERIES[name] = lambda spark, sf_dir: r6(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f
    return deco


def _r6(c):
    snapped = F.round(c * F.lit(1e9), 0) / F.lit(1e9)
    return F.round(snapped * F.lit(1e6), 0) / F.lit(1e6) + F.lit(0.0)


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 places (oracle hygiene): snap to 9
    decimals to drop summation-order noise, then round to 6 — the same IEEE
    steps as the SQL side (``oracle.r6``), so both engines agree bit for bit."""
    return df.select(*[_r6(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def R(spark, sf):
    return readings(spark, sf)


def scratch(spark) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/strata-io/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- SQL pieces
W = O.with_
R_OUT = (f"SELECT row_id, geohash, day, timestamp, {O.r6('demand')} AS demand, RoadType, NumberofLanes, "
         f"LargeVehicles, Landmarks, {O.r6('Temperature')} AS Temperature, Weather FROM r")
HM = ("SELECT *, CAST(split_part(timestamp, ':', 1) AS INTEGER) AS hour, "
      "CAST(split_part(timestamp, ':', 2) AS INTEGER) AS minute FROM {src}")
PI2 = "(2 * pi())"
TRAIN_PLAN = ladders.training_plan()
SERVE_PLAN = ladders.serving_plan()


def rt_cols(vocab, default, col="RoadType", prefix=None):
    prefix = prefix or col
    src = f"CASE WHEN {col} IN ({', '.join(O.q(v) for v in vocab)}) THEN {col} ELSE {O.q(default)} END" \
        if default is not None else col
    return ", ".join(f"CAST(coalesce(({src}) = {O.q(v)}, false) AS INTEGER) AS {prefix}_{v}" for v in vocab)


def enc_select(src: str, rounded: bool = False, keep_parts: bool = True) -> str:
    """The encode step (binary maps, time features, one-hots, day flag) over ``src``."""
    lat, lon = O.geohash_rounded_sql("geohash") if rounded else O.geohash_sql("geohash")[:2]
    parts = "hour, minute, " if keep_parts else ""
    return (f"SELECT row_id, geohash, demand, NumberofLanes, Temperature, {lat} AS latitude, {lon} AS longitude, "
            f"CAST(CASE LargeVehicles WHEN 'Allowed' THEN 1 WHEN 'Not Allowed' THEN 0 END AS INTEGER) AS LargeVehicles, "
            f"CAST(CASE Landmarks WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INTEGER) AS Landmarks, {parts}"
            f"sin({PI2} * hour / 24.0) AS hour_sin, cos({PI2} * hour / 24.0) AS hour_cos, "
            f"sin({PI2} * minute / 60.0) AS min_sin, cos({PI2} * minute / 60.0) AS min_cos, "
            f"CAST(hour * 4 + floor(minute / 15) AS INTEGER) AS time_index, "
            f"{rt_cols(P.ROAD_TYPES, 'Residential')}, {rt_cols(P.WEATHERS, 'Sunny', 'Weather')}, "
            f"CAST(coalesce(day = 49, false) AS INTEGER) AS is_day_49 FROM ({HM.format(src=src)})")


def split_sql(src: str, out: str = "is_val") -> str:
    return (f"SELECT *, row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR) || ':42')) "
            f"<= ceil(0.2 * count(*) OVER ()) AS {out} FROM {src}")


def target_ctes(src: str = "r") -> list[tuple[str, str]]:
    """Geohash target statistics on the training split of ``src`` (needs row_id, geohash, demand)."""
    return [("tsp", split_sql(f"(SELECT row_id, geohash, demand FROM {src})")),
            ("tstat", "SELECT geohash, avg(demand) AS geohash_target_mean, median(demand) AS geohash_target_median "
                      "FROM tsp WHERE NOT is_val GROUP BY geohash"),
            ("tglob", "SELECT avg(demand) AS gm, median(demand) AS gmed FROM tsp WHERE NOT is_val")]


def target_apply(src: str) -> str:
    return (f"SELECT s.*, coalesce(t.geohash_target_mean, g.gm) AS geohash_target_mean, "
            f"coalesce(t.geohash_target_median, g.gmed) AS geohash_target_median "
            f"FROM {src} s LEFT JOIN tstat t ON s.geohash = t.geohash CROSS JOIN tglob g")


def feat_cols(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return ", ".join(f"{O.r6(a + c)} AS {c}" if c in P.CONTINUOUS and c != "NumberofLanes" else f"{a}{c}"
                     for c in P.FEATURES)


TRAIN_IMP, TRAIN_LAST = O.plan_ctes("rh", TRAIN_PLAN)
TRAIN_CTES = (O.base_ctes() + TRAIN_IMP
              + [("imp", f"SELECT * EXCLUDE (_hour, _geo4, _geo3) FROM {TRAIN_LAST}"),
                 ("enc", enc_select("imp")), ("sp", split_sql("enc"))] + target_ctes("r")
              + [("tf", target_apply("sp"))])
SERVE_IMP, SERVE_LAST = O.plan_ctes("rh", SERVE_PLAN, name="s", null_label="Sunny")
SERVE_CTES = (O.base_ctes() + SERVE_IMP
              + [("simp", f"SELECT * EXCLUDE (_hour, _geo4, _geo3) REPLACE ("
                          f"CASE WHEN Weather IN ({', '.join(O.q(w) for w in P.WEATHERS)}) THEN Weather ELSE 'Sunny' END AS Weather, "
                          f"CASE WHEN RoadType IN ({', '.join(O.q(w) for w in P.ROAD_TYPES)}) THEN RoadType ELSE 'Residential' END AS RoadType) "
                          f"FROM {SERVE_LAST}"),
                 ("senc", enc_select("simp", rounded=True, keep_parts=False))] + target_ctes("r")
              + [("sf", target_apply("senc"))])


def audit_sql(src: str, cols) -> str:
    blocks = []
    for c in cols:
        blocks.append(f"SELECT row_id AS original_row_index, {O.q(c)} AS \"column\", geohash, day, timestamp, "
                      f"CAST({c} AS VARCHAR) AS filled_value, _rule_{c} AS rule_used, "
                      f"_rule_{c} IS NOT NULL AS fill_successful FROM {src} WHERE _null_{c}")
    return " UNION ALL ".join(blocks)


def gates_sql(pairs) -> str:
    """(check, violations expr over one aggregate row) -> UNION ALL table."""
    return " UNION ALL ".join(f"SELECT {O.q(n)} AS \"check\", CAST({v} AS BIGINT) AS violations, "
                              f"CAST({v} AS BIGINT) = 0 AS passed FROM {src}" for n, v, src in pairs)


# ---------------------------------------------------------------- 2.1 sources / sinks
@query("read_table", W(O.base_ctes(False), R_OUT))
def q_read_table(spark, sf):
    path = scratch(spark)
    r = R(spark, sf)
    r.select(*reversed(r.columns)).write.option("header", True).option("nullValue", "NA").csv(path)  # read by name
    schema = T.StructType([T.StructField(n, t) for n, t in [
        ("row_id", T.LongType()), ("geohash", T.StringType()), ("day", T.IntegerType()),
        ("timestamp", T.StringType()), ("demand", T.DoubleType()), ("RoadType", T.StringType()),
        ("NumberofLanes", T.IntegerType()), ("LargeVehicles", T.StringType()), ("Landmarks", T.StringType()),
        ("Temperature", T.DoubleType()), ("Weather", T.StringType())]])
    return io.read_csv(spark, path, schema)


@query("write_table", W(O.base_ctes(False), R_OUT))
def q_write_table(spark, sf):
    path = scratch(spark)
    io.write_table(R(spark, sf), path)
    return spark.read.parquet(path)


@query("save_index", W(O.base_ctes(False), "SELECT row_id FROM r"))
def q_save_index(spark, sf):
    return io.split_identity(R(spark, sf), "row_id")[0]


@query("submission", W(SERVE_CTES, f"SELECT row_id AS \"Index\", {O.r6('greatest(geohash_target_mean, 0.0)')} AS demand FROM sf"))
def q_submission(spark, sf):
    r = R(spark, sf)
    feats = P.serve_features(r.drop("demand"), r)
    pred = feats.withColumn("pred", fn.clip_lower("geohash_target_mean", 0.0))
    return io.submission(pred, "row_id", "pred", expected=r.select("row_id"))


# ---------------------------------------------------------------- 2.2 projections
@query("select_ordered", W(TRAIN_CTES, f"SELECT row_id, {feat_cols()} FROM tf"))
def q_select_ordered(spark, sf):
    df, _ = P.train_features(R(spark, sf))
    return rel.align(df, P.FEATURES, keep=["row_id"])


@query("drop_extra", W(O.base_ctes(False), R_OUT))
def q_drop_extra(spark, sf):
    out, dropped = rel.drop_extra(ladders.with_helpers(R(spark, sf)), O.READINGS_COLS)
    assert dropped == list(ladders.HELPERS)
    return out


@query("drop_if_exists", W(O.base_ctes(False), "SELECT * EXCLUDE (LargeVehicles, demand, Temperature) FROM r"))
def q_drop_if_exists(spark, sf):
    return R(spark, sf).drop("Index", "LargeVehicles", "demand", "Temperature")


@query("separate_target", W(O.base_ctes(False), f"SELECT row_id, {O.r6('demand')} AS demand FROM r"))
def q_separate_target(spark, sf):
    return rel.split_label(R(spark, sf), ["TrafficVolume", "demand"], keep=["row_id"])[0]


@query("rename_stats", W(O.base_ctes(False), f"SELECT geohash, {O.r6('avg(demand)')} AS geohash_target_mean, "
                                              f"{O.r6('median(demand)')} AS geohash_target_median FROM r GROUP BY geohash"))
def q_rename_stats(spark, sf):
    g = prof.group_stats(R(spark, sf), ["geohash"], "demand", ("mean", "median"))
    return g.withColumnsRenamed({"mean": "geohash_target_mean", "median": "geohash_target_median"})


@query("hconcat", W(O.base_ctes(False), f"SELECT row_id, {O.r6(f'sin({PI2} * hour / 24.0)')} AS hour_sin, "
                                         f"{O.r6(f'cos({PI2} * hour / 24.0)')} AS hour_cos FROM ({HM.format(src='r')})"))
def q_hconcat(spark, sf):
    r = R(spark, sf)
    h, _ = fn.parse_hm("timestamp")
    s, c = fn.cyclical(h, 24)
    return r.withColumns({"hour_sin": s, "hour_cos": c}).select("row_id", "hour_sin", "hour_cos")


# ---------------------------------------------------------------- 2.3 filters / conditionals
@query("masked_assign", W(O.base_ctes(False),
                          f"SELECT row_id, {O.r6('CASE WHEN Temperature IS NULL AND m IS NOT NULL AND c >= 2 THEN m ELSE Temperature END')} "
                          f"AS Temperature FROM (SELECT *, median(Temperature) OVER (PARTITION BY geohash) AS m, "
                          f"count(Temperature) OVER (PARTITION BY geohash) AS c FROM r)"))
def q_masked_assign(spark, sf):
    r = rel.group_transform(R(spark, sf), ["geohash"], "Temperature", {"_m": "median", "_c": "count"})
    return r.select("row_id", fn.fill_where("Temperature", "_m", F.col("_c") >= 2).alias("Temperature"))


@query("fill_const", W(O.base_ctes(False), f"SELECT row_id, {O.r6('coalesce(Temperature, 16.3803)')} AS Temperature FROM r"))
def q_fill_const(spark, sf):
    return imp.fill_const(R(spark, sf), "Temperature", 16.3803).select("row_id", "Temperature")


@query("fill_global", W(O.base_ctes(False), f"SELECT row_id, {O.r6('coalesce(Temperature, median(Temperature) OVER ())')} AS Temperature FROM r"))
def q_fill_global(spark, sf):
    return imp.fill_global(R(spark, sf), "Temperature").select("row_id", "Temperature")


@query("null_filter", W(O.base_ctes(False), R_OUT + " WHERE Temperature IS NULL"))
def q_null_filter(spark, sf):
    return imp.null_rows(R(spark, sf), ["Temperature"])


RT1_ONLY = [("RoadType", [ladders.road_ladder()[0]])]
_u_ctes, _u_last = O.plan_ctes("rh", RT1_ONLY, name="u")


@query("unfilled_report", W(O.base_ctes() + _u_ctes + [("a", audit_sql(_u_last, ["RoadType"]))],
                            "SELECT * FROM a WHERE NOT fill_successful"))
def q_unfilled_report(spark, sf):
    out = imp.impute_all(ladders.with_helpers(R(spark, sf)), RT1_ONLY)
    return imp.unfilled(imp.impute_audit(out, ["RoadType"]))


@query("is_in_between", W(O.base_ctes(False), "SELECT row_id, minute IN (0, 15, 30, 45) AS minute_ok, "
                                               "hour BETWEEN 0 AND 23 AS hour_ok FROM (" + HM.format(src="r") + ")"))
def q_is_in_between(spark, sf):
    h, m = fn.parse_hm("timestamp")
    return R(spark, sf).select("row_id", fn.is_in(m, [0, 15, 30, 45]).alias("minute_ok"),
                               fn.between(h, 0, 23).alias("hour_ok"))


@query("eq_flag", W(O.base_ctes(False), "SELECT row_id, CAST(coalesce(day = 49, false) AS INTEGER) AS is_day_49 FROM r"))
def q_eq_flag(spark, sf):
    df = fn.add_flag(R(spark, sf), "day", 49, "is_day_49")
    return fn.add_flag(df, "day", 48, "is_day_49").select("row_id", "is_day_49")  # an existing flag stays


@query("band_rule", W(O.base_ctes(False), f"SELECT row_id, {O.band_sql('Temperature', None)} AS weather_inferred, "
                                           f"{O.band_sql('Temperature', 'Sunny')} AS weather_inferred_lenient FROM r"))
def q_band_rule(spark, sf):
    return R(spark, sf).select("row_id", ladders.infer_weather(None)(F.col("Temperature")).alias("weather_inferred"),
                               ladders.infer_weather("Sunny")(F.col("Temperature")).alias("weather_inferred_lenient"))


@query("closed_vocab", W(O.base_ctes(False), "SELECT row_id, CASE WHEN Weather IN ('Sunny','Rainy','Foggy','Snowy','Cloudy') "
                                              "THEN Weather ELSE 'Sunny' END AS Weather, CASE WHEN RoadType IN ('Residential','Street') "
                                              "THEN RoadType ELSE 'Residential' END AS RoadType FROM r"))
def q_closed_vocab(spark, sf):
    return R(spark, sf).select("row_id", fn.close_vocab("Weather", P.WEATHERS, "Sunny").alias("Weather"),
                               fn.close_vocab("RoadType", ["Residential", "Street"], "Residential").alias("RoadType"))


# ---------------------------------------------------------------- 2.4 joins
_LAT, _LON, _LE, _OE = O.geohash_sql("geohash")
GEO_TABLE_SQL = (f"SELECT geohash, {O.r6(_LAT)} AS latitude, {O.r6(_LON)} AS longitude, {O.r6(_LE)} AS latitude_err, "
                 f"{O.r6(_OE)} AS longitude_err FROM (SELECT DISTINCT geohash FROM r)")


def geohash_table(df: DataFrame) -> DataFrame:
    return fn.with_geohash_coords(df.select("geohash").distinct(), keep_err=True)


@query("lookup_left", W(O.base_ctes(False) + [("g", GEO_TABLE_SQL)],
                        "SELECT r.row_id, r.geohash, g.latitude, g.longitude FROM r LEFT JOIN g ON r.geohash = g.geohash"))
def q_lookup_left(spark, sf):
    r = R(spark, sf)
    return rel.lookup(r.select("row_id", "geohash"), geohash_table(r).drop("latitude_err", "longitude_err"),
                      "geohash", check_unique=True)


@query("map_lookup", W(O.base_ctes(False) + [("m", "SELECT geohash, avg(demand) AS geohash_mean FROM r GROUP BY geohash")],
                       f"SELECT r.row_id, {O.r6('m.geohash_mean')} AS geohash_mean FROM r LEFT JOIN m ON r.geohash = m.geohash"))
def q_map_lookup(spark, sf):
    r = R(spark, sf)
    m = prof.group_stats(r, ["geohash"], "demand", ("mean",), names=("geohash_mean",))
    return rel.lookup(r.select("row_id", "geohash"), m, "geohash").select("row_id", "geohash_mean")


@query("dict_map", W(O.base_ctes(False), "SELECT row_id, CASE LargeVehicles WHEN 'Allowed' THEN 1 WHEN 'Not Allowed' THEN 0 END "
                                          "AS LargeVehicles, CASE Landmarks WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS Landmarks FROM r"))
def q_dict_map(spark, sf):
    return R(spark, sf).select("row_id", fn.recode("LargeVehicles", P.LARGE_VEHICLES).alias("LargeVehicles"),
                               fn.recode("Landmarks", P.LANDMARKS).alias("Landmarks"))


@query("unseen_keys", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders "
                      "WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT') AND c_custkey IS NOT NULL")
def q_unseen_keys(spark, sf):
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return rel.unseen(table(spark, sf, "customer"), urgent, "c_custkey", "o_custkey").filter(F.col("c_custkey").isNotNull())


@query("seen_rows", W(O.base_ctes(False), R_OUT + " WHERE row_id IN (SELECT row_id FROM r WHERE RoadType IS NULL)"))
def q_seen_rows(spark, sf):
    r = R(spark, sf)
    return rel.semi(r, r.filter(F.col("RoadType").isNull()), "row_id")


@query("zip_by_key", W(O.base_ctes(False), f"SELECT row_id, {O.r6('demand')} AS demand, {O.r6('Temperature')} AS Temperature FROM r"))
def q_zip_by_key(spark, sf):
    r = R(spark, sf)
    return rel.zip_by_key(r.select("row_id", "demand"), r.select("row_id", "Temperature"))


# ---------------------------------------------------------------- 2.5 aggregations
@query("group_mean_median", W(O.base_ctes(False), f"SELECT geohash, Weather, {O.r6('avg(demand)')} AS mean, "
                                                   f"{O.r6('median(demand)')} AS median FROM r WHERE Weather IS NOT NULL GROUP BY geohash, Weather"))
def q_group_mean_median(spark, sf):
    return prof.group_stats(R(spark, sf), ["geohash", "Weather"], "demand", ("mean", "median"))  # Weather has nulls


MODE_SQL = ("SELECT {k}, {c} AS {out} FROM (SELECT {k}, {c}, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, {c}) "
            "AS rn FROM {src} WHERE {c} IS NOT NULL GROUP BY {k}, {c}) WHERE rn = 1")


@query("group_mode", W(O.base_ctes(False), MODE_SQL.format(k="geohash, Weather", c="RoadType", out="RoadType_mode",
                                                           src="(SELECT * FROM r WHERE Weather IS NOT NULL)")))
def q_group_mode(spark, sf):
    return prof.group_stats(R(spark, sf), ["geohash", "Weather"], "RoadType", ("mode",), names=("RoadType_mode",))


@query("group_count", W(O.base_ctes(), "SELECT geohash, day, _hour, count(Temperature) AS n FROM rh GROUP BY geohash, day, _hour"))
def q_group_count(spark, sf):
    return prof.group_count(ladders.with_helpers(R(spark, sf)), ["geohash", "day", "_hour"], "Temperature")


@query("global_stats", W(O.base_ctes(False), f"SELECT {O.r6('avg(Temperature)')} AS mean, {O.r6('median(Temperature)')} AS median, "
                                              f"(SELECT Weather FROM r WHERE Weather IS NOT NULL GROUP BY Weather "
                                              f"ORDER BY count(*) DESC, Weather LIMIT 1) AS weather_mode FROM r"))
def q_global_stats(spark, sf):
    r = R(spark, sf)
    t = prof.global_stats(r, "Temperature", ("mean", "median"))
    w = prof.global_stats(r, "Weather", ("mode",)).withColumnRenamed("mode", "weather_mode")
    return t.withColumn("_k", F.lit(0)).join(F.broadcast(w.withColumn("_k", F.lit(0))), "_k").drop("_k")


@query("value_counts", W(O.base_ctes(False), "SELECT Weather, count(*) AS count FROM r WHERE Weather IS NOT NULL GROUP BY Weather"))
def q_value_counts(spark, sf):
    return prof.value_counts(R(spark, sf), "Weather")


@query("value_counts_orders", "SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL "
                              "GROUP BY o_orderpriority")
def q_value_counts_orders(spark, sf):
    return prof.value_counts(table(spark, sf, "orders"), "o_orderpriority")


def _null_profile_sql(cols, src):
    return " UNION ALL ".join(f"SELECT {O.q(c)} AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null, "
                              f"count(*) AS n_rows FROM {src}" for c in cols)


@query("null_profile", W(O.base_ctes(False), _null_profile_sql(O.READINGS_COLS, "r")))
def q_null_profile(spark, sf):
    return prof.null_profile(R(spark, sf))


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("null_profile_lineitem", _null_profile_sql(LINEITEM_COLS, "lineitem"))
def q_null_profile_lineitem(spark, sf):
    return prof.null_profile(table(spark, sf, "lineitem"))


@query("n_distinct", "WITH " + "r AS (" + O.READINGS_SQL + ") SELECT count(DISTINCT geohash) AS n_distinct_geohash, "
                     "count(DISTINCT timestamp) AS n_distinct_timestamp FROM r")
def q_n_distinct(spark, sf):
    return prof.n_distinct(R(spark, sf), ["geohash", "timestamp"])


@query("distinct_values", W(O.base_ctes(False), "SELECT DISTINCT geohash FROM r"))
def q_distinct_values(spark, sf):
    return prof.distinct_values(R(spark, sf), "geohash")


NUM_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("min_max", " UNION ALL ".join(f"SELECT {O.q(c)} AS \"column\", {O.r6(f'CAST(min({c}) AS DOUBLE)')} AS min, "
                                     f"{O.r6(f'CAST(max({c}) AS DOUBLE)')} AS max FROM lineitem" for c in NUM_LI))
def q_min_max(spark, sf):
    return prof.min_max(table(spark, sf, "lineitem"), NUM_LI)


def _describe_sql(cols, src):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT {O.q(c)} AS \"column\", count({x}) AS count, {O.r6(f'avg({x})')} AS mean, "
                     f"{O.r6(f'stddev_samp({x})')} AS std, {O.r6(f'min({x})')} AS min, "
                     f"{O.r6(f'quantile_cont({x}, 0.25)')} AS p25, {O.r6(f'quantile_cont({x}, 0.5)')} AS p50, "
                     f"{O.r6(f'quantile_cont({x}, 0.75)')} AS p75, {O.r6(f'max({x})')} AS max FROM {src}")
    return " UNION ALL ".join(parts)


@query("describe", _describe_sql(NUM_LI, "lineitem"))
def q_describe(spark, sf):
    return prof.describe(table(spark, sf, "lineitem"), NUM_LI)


@query("describe_readings", W(O.base_ctes(False), _describe_sql(["Temperature", "demand"], "r")))
def q_describe_readings(spark, sf):
    return prof.describe(R(spark, sf), ["Temperature", "demand"])


OH_COLS = [f"RoadType_{v}" for v in P.ROAD_TYPES] + [f"Weather_{v}" for v in P.WEATHERS]


@query("col_sums", W(O.base_ctes(False), "SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in OH_COLS) +
                     f" FROM (SELECT {rt_cols(P.ROAD_TYPES, 'Residential')}, {rt_cols(P.WEATHERS, 'Sunny', 'Weather')} FROM r)"))
def q_col_sums(spark, sf):
    r = enc.one_hot(R(spark, sf), "RoadType", P.ROAD_TYPES, default="Residential")
    r = enc.one_hot(r, "Weather", P.WEATHERS, default="Sunny")
    return prof.col_sums(r, OH_COLS)


_R_TYPES = ["bigint", "string", "int", "string", "double", "string", "int", "string", "string", "double", "string"]


@query("shape_profile", W(O.base_ctes(False), "SELECT t.position, t.\"column\", t.dtype, n.n_rows FROM (VALUES " +
                          ", ".join(f"({i}, {O.q(c)}, {O.q(d)})" for i, (c, d) in enumerate(zip(O.READINGS_COLS, _R_TYPES))) +
                          ") t(position, \"column\", dtype) CROSS JOIN (SELECT count(*) AS n_rows FROM r) n"))
def q_shape_profile(spark, sf):
    return prof.shape_profile(R(spark, sf))


@query("scaler_fit", "SELECT " + ", ".join(f"{O.r6(f'avg({c})')} AS {c}_mean" for c in NUM_LI) + ", " +
       ", ".join(f"{O.r6(f'stddev_pop({c})')} AS {c}_std" for c in NUM_LI) + " FROM lineitem")
def q_scaler_fit(spark, sf):
    return scaler_fit(table(spark, sf, "lineitem"), NUM_LI)


def _metrics_sql(src, y, p, by):
    err = f"({y} - {p})"
    r2 = (f"CASE WHEN var_pop({y}) * count(*) > 0 THEN 1 - sum({err} * {err}) / (var_pop({y}) * count(*)) "
          f"WHEN sum({err} * {err}) = 0 THEN 1.0 ELSE 0.0 END")
    return (f"SELECT {by}, count(*) AS n, {O.r6(r2)} AS r2, {O.r6(f'greatest(0.0, 100 * ({r2}))')} AS score, "
            f"{O.r6(f'sqrt(avg({err} * {err}))')} AS rmse, {O.r6(f'avg(abs({err}))')} AS mae FROM {src} GROUP BY {by}")


@query("regression_metrics", W(TRAIN_CTES, _metrics_sql("tf", "demand", "geohash_target_mean", "is_val")))
def q_regression_metrics(spark, sf):
    df, _ = P.train_features(R(spark, sf))
    return mdl.regression_metrics(df, "demand", "geohash_target_mean", by=["is_val"])


@query("prediction_stats", W(TRAIN_CTES, f"SELECT {O.r6('min(geohash_target_median)')} AS min, {O.r6('max(geohash_target_median)')} AS max, "
                                          f"{O.r6('avg(geohash_target_median)')} AS mean, {O.r6('stddev_pop(geohash_target_median)')} AS std, "
                                          f"count(*) FILTER (WHERE geohash_target_median < 0) AS n_negative FROM tf WHERE is_val"))
def q_prediction_stats(spark, sf):
    df, _ = P.train_features(R(spark, sf))
    return mdl.prediction_stats(df.filter("is_val"), "geohash_target_median")


TRAIN_AUDIT = W(O.base_ctes() + TRAIN_IMP + [("a", audit_sql(TRAIN_LAST, P.IMPUTED))], "{final}")


@query("rule_summary", TRAIN_AUDIT.format(final="SELECT \"column\", rule_used, count(*) AS n_cells, "
                                                "count(*) FILTER (WHERE fill_successful) AS n_filled FROM a GROUP BY ALL"))
def q_rule_summary(spark, sf):
    return imp.plan_summary(imp.plan_fills(ladders.with_helpers(R(spark, sf)), TRAIN_PLAN))


def _train_clean(spark, sf):
    return imp.impute_all(ladders.with_helpers(R(spark, sf)), TRAIN_PLAN)


def _train_audit(spark, sf):
    return imp.impute_audit(_train_clean(spark, sf), P.IMPUTED)


# ---------------------------------------------------------------- 2.6 group transforms
@query("transform_median", W(O.base_ctes(), f"SELECT row_id, {O.r6('CASE WHEN geohash IS NOT NULL AND day IS NOT NULL AND _hour IS NOT NULL THEN median(Temperature) OVER (PARTITION BY geohash, day, _hour) END')} AS median_temp FROM rh"))
def q_transform_median(spark, sf):
    r = ladders.with_helpers(R(spark, sf))
    return rel.group_transform(r, ["geohash", "day", "_hour"], "Temperature", "median", "median_temp") \
        .select("row_id", "median_temp")


@query("transform_mode", W(O.base_ctes() + [("m", MODE_SQL.format(k="geohash", c="RoadType", out="mode_road", src="r"))],
                           "SELECT r.row_id, m.mode_road FROM r LEFT JOIN m ON r.geohash = m.geohash"))
def q_transform_mode(spark, sf):
    return rel.group_transform(R(spark, sf), ["geohash"], "RoadType", "mode", "mode_road").select("row_id", "mode_road")


@query("transform_count", W(O.base_ctes(), "SELECT row_id, count(Temperature) OVER (PARTITION BY geohash, day, _hour) AS n_temp FROM rh"))
def q_transform_count(spark, sf):
    r = ladders.with_helpers(R(spark, sf))
    return rel.group_transform(r, ["geohash", "day", "_hour"], "Temperature", "count", "n_temp").select("row_id", "n_temp")


# ---------------------------------------------------------------- 2.7 sorts / limits / sampling
@query("head_n", W(O.base_ctes(False), R_OUT + " ORDER BY row_id LIMIT 5"))
def q_head_n(spark, sf):
    return prof.head_by(R(spark, sf), "row_id", 5)


@query("sorted_distinct", W(O.base_ctes(False), "SELECT DISTINCT CAST(split_part(timestamp, ':', 2) AS INTEGER) AS minute FROM r ORDER BY 1"))
def q_sorted_distinct(spark, sf):
    _, m = fn.parse_hm("timestamp")
    return prof.sorted_distinct(R(spark, sf).select(m.alias("minute")), "minute")


@query("split_exact", W(O.base_ctes(False), "SELECT row_id, is_val FROM (" + split_sql("(SELECT row_id FROM r)") + ")"))
def q_split_exact(spark, sf):
    return split_exact(R(spark, sf).select("row_id"), "row_id", 0.2, 42)


# ---------------------------------------------------------------- 2.8 set operations
@query("audit_union", W(O.base_ctes(False), " UNION ALL ".join(
    f"SELECT row_id AS original_row_index, {O.q(c)} AS \"column\", geohash, day, timestamp FROM r WHERE {c} IS NULL"
    for c in P.IMPUTED)))
def q_audit_union(spark, sf):
    return imp.stack_audit(R(spark, sf), P.IMPUTED)


@query("set_difference", W(O.base_ctes(False), "SELECT DISTINCT geohash FROM r WHERE Temperature IS NULL AND geohash NOT IN "
                           "(SELECT geohash FROM r WHERE RoadType IS NULL AND day = 48)"))
def q_set_difference(spark, sf):
    r = R(spark, sf)
    return rel.set_difference(r.filter(F.col("Temperature").isNull()), r.filter(F.col("RoadType").isNull() & (F.col("day") == 48)), "geohash")


@query("domain_check", W(O.base_ctes(False), gates_sql([
    ("domain:Weather", "count(*) FILTER (WHERE Weather IS NULL OR Weather NOT IN ('Sunny','Rainy','Foggy','Snowy','Cloudy'))", "r"),
    ("domain:RoadType", "count(*) FILTER (WHERE RoadType IS NULL OR RoadType NOT IN ('Residential','Street','Highway'))", "r"),
    ("domain_all_present:RoadType", "3 - count(DISTINCT RoadType)", "r")])))
def q_domain_check(spark, sf):
    return qa.expect(R(spark, sf), qa.domain("Weather", P.WEATHERS) + qa.domain("RoadType", P.ROAD_TYPES, exact=True))


# ---------------------------------------------------------------- 2.9 scalar functions
@query("parse_hm", W(O.base_ctes(False), "SELECT row_id, hour, minute FROM (" + HM.format(src="r") + ")"))
def q_parse_hm(spark, sf):
    h, m = fn.parse_hm("timestamp")
    return R(spark, sf).select("row_id", h.alias("hour"), m.alias("minute"))


@query("time_index", W(O.base_ctes(False), "SELECT row_id, CAST(hour * 4 + floor(minute / 15) AS INTEGER) AS time_index FROM (" + HM.format(src="r") + ")"))
def q_time_index(spark, sf):
    h, m = fn.parse_hm("timestamp")
    return R(spark, sf).select("row_id", fn.time_index(h, m).alias("time_index"))


@query("minute_of_day", W(O.base_ctes(False), "SELECT row_id, CAST(hour * 60 + minute AS INTEGER) AS minute_of_day FROM (" + HM.format(src="r") + ")"))
def q_minute_of_day(spark, sf):
    h, m = fn.parse_hm("timestamp")
    return R(spark, sf).select("row_id", fn.minute_of_day(h, m).alias("minute_of_day"))


@query("cyclical", W(O.base_ctes(False), "SELECT row_id, " + ", ".join(
    f"{O.r6(f'{f}({PI2} * {x} / {p})')} AS {n}" for n, f, x, p in [
        ("hour_sin", "sin", "hour", "24.0"), ("hour_cos", "cos", "hour", "24.0"), ("min_sin", "sin", "minute", "60.0"),
        ("min_cos", "cos", "minute", "60.0"), ("time_sin", "sin", "(hour * 60 + minute)", "1440.0"),
        ("time_cos", "cos", "(hour * 60 + minute)", "1440.0")]) + " FROM (" + HM.format(src="r") + ")"))
def q_cyclical(spark, sf):
    h, m = fn.parse_hm("timestamp")
    hs, hc = fn.cyclical(h, 24)
    ms, mc = fn.cyclical(m, 60)
    ts, tc = fn.cyclical(fn.minute_of_day(h, m), 1440)
    return R(spark, sf).select("row_id", hs.alias("hour_sin"), hc.alias("hour_cos"), ms.alias("min_sin"),
                               mc.alias("min_cos"), ts.alias("time_sin"), tc.alias("time_cos"))


@query("geo_prefix", W(O.base_ctes(False), "SELECT row_id, substr(geohash, 1, 4) AS geo4, substr(geohash, 1, 3) AS geo3 FROM r"))
def q_geo_prefix(spark, sf):
    return R(spark, sf).select("row_id", fn.geo_prefix("geohash", 4).alias("geo4"), fn.geo_prefix("geohash", 3).alias("geo3"))


@query("geohash_decode", W(O.base_ctes(False), f"SELECT row_id, {O.r6(_LAT)} AS latitude, {O.r6(_LON)} AS longitude, "
                                                f"{O.r6(_LE)} AS latitude_err, {O.r6(_OE)} AS longitude_err FROM r"))
def q_geohash_decode(spark, sf):
    d = fn.geohash_decode("geohash")  # the Column form (the table form is used by the pipelines)
    return R(spark, sf).select("row_id", d["latitude"].alias("latitude"), d["longitude"].alias("longitude"),
                               d["latitude_err"].alias("latitude_err"), d["longitude_err"].alias("longitude_err"))


_RLAT, _RLON = O.geohash_rounded_sql("geohash")


@query("geohash_rounded", W(O.base_ctes(False), f"SELECT geohash, {O.r6(_RLAT)} AS latitude, {O.r6(_RLON)} AS longitude "
                                                 f"FROM (SELECT DISTINCT geohash FROM r)"))
def q_geohash_rounded(spark, sf):
    return fn.with_geohash_coords(R(spark, sf).select("geohash").distinct(), rounded=True)


@query("clip0", W(O.base_ctes(False), f"SELECT row_id, {O.r6('CASE WHEN demand - 0.2 < 0 THEN 0.0 ELSE demand - 0.2 END')} AS clipped FROM r"))
def q_clip0(spark, sf):
    return R(spark, sf).select("row_id", fn.clip_lower(F.col("demand") - 0.2, 0.0).alias("clipped"))


@query("residuals", W(O.base_ctes(False) + [("m", "SELECT geohash, avg(demand) AS p FROM r GROUP BY geohash")],
                      f"SELECT r.row_id, {O.r6('r.demand - m.p')} AS error, {O.r6('abs(r.demand - m.p)')} AS abs_error "
                      f"FROM r JOIN m ON r.geohash = m.geohash"))
def q_residuals(spark, sf):
    r = rel.group_transform(R(spark, sf), ["geohash"], "demand", "mean", "p")
    e, a = fn.residual("demand", "p")
    return r.select("row_id", e.alias("error"), a.alias("abs_error"))


@query("to_int_float", W(O.base_ctes(False), "SELECT row_id, CAST(Landmarks = 'Yes' AS INTEGER) AS landmark_flag, "
                                              "CAST(demand AS FLOAT) AS demand_f32 FROM r"))
def q_to_int_float(spark, sf):
    return R(spark, sf).select("row_id", fn.to_int(F.col("Landmarks") == "Yes").alias("landmark_flag"),
                               fn.to_float("demand").alias("demand_f32"))


@query("scaler_apply", W(TRAIN_CTES + [("st", "SELECT " + ", ".join(
    f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s"
    for c in P.CONTINUOUS) + " FROM tf WHERE NOT is_val")],
    "SELECT row_id, " + ", ".join(f"{O.r6(f'({c} - {c}_m) / {c}_s')} AS {c}" for c in P.CONTINUOUS) + " FROM tf CROSS JOIN st"))
# NumberofLanes is an int column; the scaler turns it into a double on both sides
def q_scaler_apply(spark, sf):
    df, _ = P.train_features(R(spark, sf))
    params = scaler_params(scaler_fit(df.filter(~F.col("is_val")), P.CONTINUOUS), P.CONTINUOUS)
    return scaler_apply(df, params).select("row_id", *P.CONTINUOUS)


# ---------------------------------------------------------------- 2.10 composites
def _cascade_query(plan, cols, null_label=None, name="k"):
    ctes, last = O.plan_ctes("rh", plan, name=name, null_label=null_label)
    sel = ", ".join(f"{O.r6(c) if c == 'Temperature' else c} AS {c}, _rule_{c}" for c in cols)
    return W(O.base_ctes() + ctes, f"SELECT row_id, {sel} FROM {last}")


def _cascade_spark(spark, sf, plan, cols):
    out = imp.impute_all(ladders.with_helpers(R(spark, sf)), plan)
    return out.select("row_id", *[x for c in cols for x in (c, f"_rule_{c}")])


MODE_PLAN = [("RoadType", ladders.road_ladder())]
MEDIAN_PLAN = [("Temperature", ladders.temperature_ladder())]
NOMIN_PLAN = [("Temperature", ladders.temperature_ladder(min_count=0))]
INFER_PLAN = [("Temperature", ladders.temperature_ladder()), ("Weather", ladders.weather_ladder())]
ALT_PLAN = ladders.alt_plan()


@query("impute_cascade_mode", _cascade_query(MODE_PLAN, ["RoadType"]))
def q_cascade_mode(spark, sf):
    return _cascade_spark(spark, sf, MODE_PLAN, ["RoadType"])


@query("impute_cascade_median", _cascade_query(MEDIAN_PLAN, ["Temperature"]))
def q_cascade_median(spark, sf):
    return _cascade_spark(spark, sf, MEDIAN_PLAN, ["Temperature"])


@query("impute_cascade_median_nomin", _cascade_query(NOMIN_PLAN, ["Temperature"]))
def q_cascade_median_nomin(spark, sf):
    return _cascade_spark(spark, sf, NOMIN_PLAN, ["Temperature"])


@query("impute_cascade_infer", _cascade_query(INFER_PLAN, ["Temperature", "Weather"]))
def q_cascade_infer(spark, sf):
    return _cascade_spark(spark, sf, INFER_PLAN, ["Temperature", "Weather"])


@query("impute_ladder_alt", _cascade_query(ALT_PLAN, P.IMPUTED))
def q_ladder_alt(spark, sf):
    return _cascade_spark(spark, sf, ALT_PLAN, P.IMPUTED)


@query("impute_audit", TRAIN_AUDIT.format(final="SELECT * FROM a"))
def q_impute_audit(spark, sf):
    return _train_audit(spark, sf)


@query("impute_all", W(O.base_ctes() + TRAIN_IMP, f"SELECT * EXCLUDE (_hour, _geo4, _geo3) REPLACE ({O.r6('demand')} AS demand, "
                                                   f"{O.r6('Temperature')} AS Temperature) FROM {TRAIN_LAST}"))
def q_impute_all(spark, sf):
    return ladders.drop_helpers(_train_clean(spark, sf))


@query("geohash_table", W(O.base_ctes(False), GEO_TABLE_SQL))
def q_geohash_table(spark, sf):
    return geohash_table(R(spark, sf))


@query("binary_encode", W(O.base_ctes(False), "SELECT row_id, CAST(CASE LargeVehicles WHEN 'Allowed' THEN 1 WHEN 'Not Allowed' THEN 0 END AS INTEGER) "
                                               "AS LargeVehicles, CAST(CASE Landmarks WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INTEGER) AS Landmarks FROM r"))
def q_binary_encode(spark, sf):
    r = enc.binary_encode(R(spark, sf), "LargeVehicles", P.LARGE_VEHICLES)
    r = enc.binary_encode(r, "Landmarks", P.LANDMARKS)
    qa.expect(r, qa.domain("LargeVehicles", [0, 1], exact=True) + qa.domain("Landmarks", [0, 1], exact=True), enforce=True)
    return r.select("row_id", "LargeVehicles", "Landmarks")




@query("binary_encode_lenient", W(O.base_ctes(False), "SELECT row_id, CAST(coalesce(CASE LargeVehicles WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END, 0) AS INTEGER) "
                                                       "AS LargeVehicles, CAST(coalesce(CASE Landmarks WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END, 0) AS INTEGER) AS Landmarks FROM r"))
def q_binary_encode_lenient(spark, sf):
    r = R(spark, sf)
    for c in ("LargeVehicles", "Landmarks"):
        r = enc.binary_encode(r, c, P.LENIENT_MAP, default=0)
    return r.select("row_id", "LargeVehicles", "Landmarks")


@query("one_hot", W(O.base_ctes(False), f"SELECT row_id, {rt_cols(P.ROAD_TYPES, 'Residential')}, {rt_cols(P.WEATHERS, 'Sunny', 'Weather')} FROM r"))
def q_one_hot(spark, sf):
    r = enc.one_hot(R(spark, sf), "RoadType", P.ROAD_TYPES, default="Residential")
    return enc.one_hot(r, "Weather", P.WEATHERS, default="Sunny").select("row_id", *OH_COLS)


OPEN_RT, OPEN_WE = P.OPEN_ROAD_TYPES, P.OPEN_WEATHERS


@query("one_hot_open", W(O.base_ctes(False), f"SELECT row_id, {rt_cols(OPEN_RT, None)}, {rt_cols(OPEN_WE, None, 'Weather')} FROM r"))
def q_one_hot_open(spark, sf):
    r = enc.one_hot(R(spark, sf), "RoadType", OPEN_RT, skip_existing=True)
    r = enc.one_hot(r, "Weather", OPEN_WE, skip_existing=True)
    return r.select("row_id", *[f"RoadType_{v}" for v in OPEN_RT], *[f"Weather_{v}" for v in OPEN_WE])


ORDER_STATUS = ["F", "O", "P"]
EVENT_TYPES = ["click", "view", "error", "signup", "purchase"]


@query("one_hot_orders", f"SELECT o_orderkey, {rt_cols(ORDER_STATUS, None, 'o_orderstatus')} FROM orders")
def q_one_hot_orders(spark, sf):
    return enc.one_hot(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ORDER_STATUS)


@query("one_hot_events", f"SELECT event_id, {rt_cols(EVENT_TYPES, None, 'event_type')} FROM events")
def q_one_hot_events(spark, sf):
    return enc.one_hot(table(spark, sf, "events").select("event_id", "event_type"), "event_type", EVENT_TYPES)


@query("time_features", W(O.base_ctes(False), f"SELECT row_id, hour, minute, {O.r6(f'sin({PI2} * hour / 24.0)')} AS hour_sin, "
                                               f"{O.r6(f'cos({PI2} * hour / 24.0)')} AS hour_cos, {O.r6(f'sin({PI2} * minute / 60.0)')} AS min_sin, "
                                               f"{O.r6(f'cos({PI2} * minute / 60.0)')} AS min_cos, CAST(hour * 4 + floor(minute / 15) AS INTEGER) AS time_index "
                                               f"FROM ({HM.format(src='r')})"))
def q_time_features(spark, sf):
    return enc.time_features(R(spark, sf).select("row_id", "timestamp"), "timestamp")


@query("time_features_day", W(O.base_ctes(False), f"SELECT row_id, {O.r6(f'sin({PI2} * (hour * 60 + minute) / 1440.0)')} AS time_sin, "
                                                   f"{O.r6(f'cos({PI2} * (hour * 60 + minute) / 1440.0)')} AS time_cos FROM ({HM.format(src='r')})"))
def q_time_features_day(spark, sf):
    return enc.time_features(R(spark, sf).select("row_id", "timestamp"), "timestamp", style="day_minute", keep_parts=False)


@query("target_encode_fit", W(O.base_ctes(False) + target_ctes("r"),
                              f"SELECT geohash, {O.r6('geohash_target_mean')} AS geohash_target_mean, "
                              f"{O.r6('geohash_target_median')} AS geohash_target_median FROM tstat"))
def q_target_encode_fit(spark, sf):
    return P.train_encoding_from_raw(R(spark, sf)).table


@query("target_encode_apply", W(O.base_ctes(False) + target_ctes("r"),
                                "SELECT row_id, " + O.r6("geohash_target_mean") + " AS geohash_target_mean, " +
                                O.r6("geohash_target_median") + " AS geohash_target_median FROM (" + target_apply("r") + ")"))
def q_target_encode_apply(spark, sf):
    r = R(spark, sf)
    from strata.operators.target import target_encode_apply
    return target_encode_apply(r, P.train_encoding_from_raw(r)).select("row_id", "geohash_target_mean", "geohash_target_median")


@query("target_encode_orders", "WITH s AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42')) "
       "<= ceil(0.2 * count(*) OVER ()) AS is_val FROM orders), st AS (SELECT o_custkey, avg(o_totalprice) AS m, median(o_totalprice) AS md "
       "FROM s WHERE NOT is_val GROUP BY o_custkey), g AS (SELECT avg(o_totalprice) AS gm, median(o_totalprice) AS gmd FROM s WHERE NOT is_val) "
       f"SELECT c.c_custkey, {O.r6('coalesce(st.m, g.gm)')} AS cust_price_mean, {O.r6('coalesce(st.md, g.gmd)')} AS cust_price_median "
       "FROM customer c LEFT JOIN st ON c.c_custkey = st.o_custkey CROSS JOIN g")
def q_target_encode_orders(spark, sf):
    from strata.operators.target import target_encode_apply, target_encode_fit
    o = split_exact(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    e = target_encode_fit(o.filter(~F.col("is_val")).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey",
                          "o_totalprice", prefix="cust_price")
    return target_encode_apply(table(spark, sf, "customer").select("c_custkey"), e)


@query("standardize", "WITH st AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s"
    for c in NUM_LI) + " FROM lineitem WHERE l_linenumber <> 1) SELECT l_orderkey, l_linenumber, " +
    ", ".join(f"{O.r6(f'({c} - {c}_m) / {c}_s')} AS {c}" for c in NUM_LI) + " FROM lineitem CROSS JOIN st")
def q_standardize(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *NUM_LI)
    first = F.col("l_linenumber") == 1
    fitted, (other,), _ = standardize(li.filter(~first), [li.filter(first)], NUM_LI)  # fitted on the one, applied to both
    return fitted.unionByName(other)


@query("residual_table", W(TRAIN_CTES, f"SELECT row_id, {O.r6('demand')} AS actual, {O.r6('geohash_target_mean')} AS predicted, "
                                        f"{O.r6('demand - geohash_target_mean')} AS error, {O.r6('abs(demand - geohash_target_mean)')} AS abs_error "
                                        f"FROM tf WHERE is_val"))
def q_residual_table(spark, sf):
    df, _ = P.train_features(R(spark, sf))
    return mdl.residual_table(df.filter("is_val"), "demand", "geohash_target_mean")


@query("train_pipeline", W(TRAIN_CTES, f"SELECT row_id, {feat_cols()}, {O.r6('demand')} AS demand, is_val FROM tf"))
def q_train_pipeline(spark, sf):
    return P.train_features(R(spark, sf))[0]


@query("serve_pipeline", W(SERVE_CTES, f"SELECT row_id, {feat_cols()} FROM sf"))
def q_serve_pipeline(spark, sf):
    r = R(spark, sf)
    return P.serve_features(r.drop("demand"), r)


CONST_COLS = ["NumberofLanes", "Temperature", "latitude", "longitude", "LargeVehicles", "Landmarks", "hour", "minute",
              "hour_sin", "hour_cos", "min_sin", "min_cos", "time_index", *OH_COLS, "is_day_49",
              "geohash_target_mean", "geohash_target_median"]
_CONST_DOUBLES = {"Temperature", "latitude", "longitude", "hour_sin", "hour_cos", "min_sin", "min_cos",
                  "geohash_target_mean", "geohash_target_median"}


@query("const_pipeline", W(O.base_ctes(False) + [("c0", "SELECT * REPLACE (coalesce(Temperature, 16.3803) AS Temperature) FROM r"),
                                                 ("cenc", enc_select("c0"))] + target_ctes("r") + [("cf", target_apply("cenc"))],
                           "SELECT row_id, " + ", ".join(f"{O.r6(c)} AS {c}" if c in _CONST_DOUBLES else c for c in CONST_COLS) + " FROM cf"))
def q_const_pipeline(spark, sf):
    r = R(spark, sf)
    return P.const_features(r.drop("demand"), r).select("row_id", *CONST_COLS)


@query("serve_stream", W(SERVE_CTES, f"SELECT row_id, {feat_cols()} FROM sf"))
def q_serve_stream(spark, sf):
    """The serving path on a Structured Streaming file source: ladder lookups
    frozen on the test table, rows arriving as parquet files, processed with
    an available-now trigger into a parquet sink (read back here)."""
    from strata.streaming.serve import fit_serve_model, run_stream
    r = R(spark, sf)
    test = r.drop("demand")
    base = scratch(spark)
    test.write.parquet(f"{base}/src")
    model = fit_serve_model(test, r)
    q = run_stream(spark, f"{base}/src", test.schema, model, f"{base}/sink", f"{base}/ckpt")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/sink")


_AIMP, _ALAST = O.plan_ctes("rh", ALT_PLAN, name="al")
_ALT_OH = [f"RoadType_{v}" for v in OPEN_RT] + [f"Weather_{v}" for v in OPEN_WE]


@query("alt_pipeline", W(O.base_ctes() + _AIMP + [("ac", HM.format(src=_ALAST)), ("ae", f"SELECT row_id, geohash, NumberofLanes, Temperature, "
    f"CAST(coalesce(CASE LargeVehicles WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END, 0) AS INTEGER) AS LargeVehicles, "
    f"CAST(coalesce(CASE Landmarks WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END, 0) AS INTEGER) AS Landmarks, "
    f"{rt_cols(OPEN_RT, None)}, {rt_cols(OPEN_WE, None, 'Weather')}, sin({PI2} * (hour * 60 + minute) / 1440.0) AS time_sin, "
    f"cos({PI2} * (hour * 60 + minute) / 1440.0) AS time_cos, CAST(coalesce(day = 49, false) AS INTEGER) AS is_day_49, "
    f"{_LAT} AS latitude, {_LON} AS longitude FROM ac")] + target_ctes("r") + [("af", target_apply("ae"))],
    "SELECT row_id, NumberofLanes, LargeVehicles, Landmarks, is_day_49, " + ", ".join(_ALT_OH) + ", " + ", ".join(
        f"{O.r6(c)} AS {c}" for c in ("Temperature", "time_sin", "time_cos", "latitude", "longitude", "geohash_target_mean", "geohash_target_median")) + " FROM af"))
def q_alt_pipeline(spark, sf):
    r = R(spark, sf)
    return P.alt_features(r.drop("demand"), r).select("row_id", "NumberofLanes", "LargeVehicles", "Landmarks", "is_day_49", *_ALT_OH, "Temperature",
                                                      "time_sin", "time_cos", "latitude", "longitude", "geohash_target_mean", "geohash_target_median")


# ---------------------------------------------------------------- model boundary
# One feature, so that SQL has the same fit: demand by the number of lanes, least squares on the training rows.
@query("fit_regressor", W(O.base_ctes(False) + [
    ("x", split_sql("(SELECT row_id, demand, NumberofLanes AS f FROM r)")),
    ("fit", "SELECT regr_slope(demand, f) AS a, regr_intercept(demand, f) AS b FROM x WHERE NOT is_val")],
    f"SELECT row_id, {O.r6('demand')} AS actual, {O.r6('a * f + b')} AS predicted, {O.r6('demand - (a * f + b)')} AS error, "
    f"{O.r6('abs(demand - (a * f + b))')} AS abs_error FROM x CROSS JOIN fit WHERE is_val"))
def q_fit_regressor(spark, sf):
    df = split_exact(R(spark, sf).select("row_id", "demand", "NumberofLanes"))
    model = mdl.fit_regressor(df, ["NumberofLanes"], "demand", is_val="is_val", kind="linear")
    return mdl.residual_table(model.transform(df.filter("is_val")), "demand", "prediction")


def mlp_ctes(src: str) -> list[tuple[str, str]]:
    """The scoring path in SQL: features of ``src`` scaled by the training rows
    (``st``), then the layers as list products with the formula's weights."""
    x = ", ".join(f"(CAST({c} AS DOUBLE) - {c}_m) / {c}_s" if c in P.CONTINUOUS else f"CAST({c} AS DOUBLE)" for c in P.FEATURES)
    dims = [len(P.FEATURES), *mdl.HIDDEN, 1]
    ctes = [("st", "SELECT " + ", ".join(
        f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s"
        for c in P.CONTINUOUS) + " FROM tf WHERE NOT is_val"),
        ("l0", f"SELECT row_id, [{x}] AS h FROM {src} CROSS JOIN st")]
    for k, (fi, fo) in enumerate(zip(dims, dims[1:])):
        ctes.append((f"w{k}", f"SELECT list_transform(range({fo}), lambda o: list_transform(range({fi}), lambda i: "
                              f"sin(12.9898 * (o * {fi} + i + 1) + {k}) * sqrt(6.0 / {fi}))) AS w"))
        out = f"list_dot_product(h, v) / sqrt(1.0 + {mdl.BN_EPS})"
        act = f"greatest(0.0, {out})" if k < len(dims) - 2 else "list_dot_product(h, v)"
        ctes.append((f"l{k + 1}", f"SELECT row_id, list_transform(w, lambda v: {act}) AS h FROM l{k} CROSS JOIN w{k}"))
    return ctes


_names = {n for n, _ in TRAIN_CTES}
SCORE_OUT = f"SELECT row_id AS \"Index\", {O.r6('greatest(0.0, h[1])')} AS demand FROM l{len(mdl.HIDDEN) + 1}"


@query("mlp_score", W(TRAIN_CTES + [c for c in SERVE_CTES if c[0] not in _names] + mlp_ctes("sf"), SCORE_OUT))
def q_mlp_score(spark, sf):
    r = R(spark, sf)
    train, feats = P.train_and_serve(r, r.drop("demand"))
    return P.score(feats, train, mdl.init_mlp_weights(len(P.FEATURES)))


@query("load_weights", W(TRAIN_CTES + mlp_ctes("tf"), SCORE_OUT))
def q_load_weights(spark, sf):
    path = scratch(spark)
    io.save_weights(spark, mdl.init_mlp_weights(len(P.FEATURES)), path)
    w = mdl.weights_from_table(io.load_weights(spark, path))
    train, _ = P.train_features(R(spark, sf))
    return P.score(train.select("row_id", *P.FEATURES), train, w)


# ---------------------------------------------------------------- training, saved models, streams with gates
BATCH_ROWS = 512
_EPOCHS = (1, 2)
_BATCHED = " UNION ALL ".join(f"SELECT {e} AS epoch, row_id, demand, CAST(floor((row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR) || ':42:{e}')) - 1) / {BATCH_ROWS}) AS BIGINT) AS batch FROM r"
                              for e in _EPOCHS)


def _batched(spark, sf):
    r = R(spark, sf).select("row_id", "demand")
    out = None
    for e in _EPOCHS:
        one = epoch_batches(r, "row_id", BATCH_ROWS, 42, e).withColumn("epoch", F.lit(e))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("epoch", "batch").agg(F.count("*").alias("n_rows"), F.avg("demand").alias("mean_demand"), F.avg((F.col("demand") - F.lit(0.5)) ** 2).alias("loss"))


@query("epoch_batches", W(O.base_ctes(False) + [("b", _BATCHED)], f"SELECT CAST(epoch AS INTEGER) AS epoch, batch, count(*) AS n_rows, {O.r6('avg(demand)')} AS mean_demand FROM b GROUP BY epoch, batch"))
def q_epoch_batches(spark, sf):
    return _batched(spark, sf).select("epoch", "batch", "n_rows", "mean_demand")


@query("epoch_losses", W(O.base_ctes(False) + [("b", _BATCHED), ("l", "SELECT epoch, batch, avg((demand - 0.5) * (demand - 0.5)) AS loss FROM b GROUP BY epoch, batch")],
                         f"SELECT CAST(epoch AS INTEGER) AS epoch, count(*) AS n_batches, {O.r6('avg(loss)')} AS mean_of_batch_means, {O.r6('sqrt(avg(loss))')} AS rmse FROM l GROUP BY epoch"))
def q_epoch_losses(spark, sf):
    return _batched(spark, sf).groupBy("epoch").agg(F.count("*").alias("n_batches"), F.avg("loss").alias("mean_of_batch_means"), F.sqrt(F.avg("loss")).alias("rmse"))


FOLDS = 5


@query("target_encode_oof", W(O.base_ctes(False) + [
    ("f", f"SELECT row_id, geohash, demand, CAST(CAST('0x' || substr(md5(CAST(row_id AS VARCHAR) || ':42:fold'), 1, 8) AS BIGINT) % {FOLDS} AS INTEGER) AS fold FROM r"),
    ("k", f"SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS fold"),
    ("st", "SELECT f.geohash, k.fold, avg(demand) AS m, median(demand) AS md FROM k JOIN f ON f.fold <> k.fold GROUP BY f.geohash, k.fold"),
    ("g", "SELECT k.fold, avg(demand) AS gm, median(demand) AS gmd FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold")],
    f"SELECT f.row_id, f.fold, {O.r6('coalesce(st.m, g.gm)')} AS geohash_target_mean, {O.r6('coalesce(st.md, g.gmd)')} AS geohash_target_median "
    "FROM f LEFT JOIN st ON f.geohash = st.geohash AND f.fold = st.fold JOIN g ON f.fold = g.fold"))
def q_target_encode_oof(spark, sf):
    from strata.operators.target import target_encode_oof_apply, target_encode_oof_fit
    r = R(spark, sf).select("row_id", "geohash", "demand")
    enc = target_encode_oof_fit(r, "row_id", "geohash", "demand", FOLDS)
    return target_encode_oof_apply(r, enc, "row_id").select("row_id", "fold", "geohash_target_mean", "geohash_target_median")


@query("load_checkpoint", W(TRAIN_CTES + mlp_ctes("tf"), SCORE_OUT))
def q_load_checkpoint(spark, sf):
    """The weights go through a checkpoint file, read by the data source."""
    path = scratch(spark) + "/best.pt"
    save_checkpoint(mdl.init_mlp_weights(len(P.FEATURES)), path)
    train, _ = P.train_features(R(spark, sf))
    return P.score(train.select("row_id", *P.FEATURES), train, mdl.weights_from_table(io.load_weights(spark, path)), expected=R(spark, sf))


@query("serve_saved", W(SERVE_CTES, f"SELECT row_id, {feat_cols()} FROM sf"))
def q_serve_saved(spark, sf):
    """The serving path from a model that was saved and loaded: nothing is refitted."""
    r = R(spark, sf)
    path = scratch(spark)
    fitted.fit_serving(r.drop("demand"), r).write().save(path)
    return PipelineModel.load(path).transform(r.drop("demand"))


#: One row in so many is broken on its way into the stream.
BROKEN = 97


@query("serve_gated_stream", W(SERVE_CTES, f"SELECT row_id, {feat_cols()} FROM sf WHERE row_id % {BROKEN} <> 0"))
def q_serve_gated_stream(spark, sf):
    """The stream with gates: rows with a broken time are set aside, the others come out."""
    from strata.streaming.serve import fit_serve_model, run_gated_stream
    r = R(spark, sf)
    test, base = r.drop("demand"), scratch(spark)
    test.withColumn("timestamp", F.when(F.col("row_id") % BROKEN == 0, F.lit("late")).otherwise(F.col("timestamp"))).write.parquet(f"{base}/src")
    run_gated_stream(spark, f"{base}/src", test.schema, fit_serve_model(test, r), f"{base}/sink", f"{base}/quarantine", f"{base}/metrics", f"{base}/ckpt").awaitTermination()
    return spark.read.parquet(f"{base}/sink").drop("batch")


@query("fit_network")
def q_fit_network(spark, sf):
    """Training of the scored network on the 21 features, validated after every epoch;
    residuals of its best epoch on the validation rows. Steps over all training rows, so
    that the number of jobs does not grow with the table. (Sums in another order give
    other last digits, which training amplifies; tests hold it against NumPy.)"""
    train = cut_lineage(P.train_features(R(spark, sf))[0])
    scaler = fitted.Standardizer(P.CONTINUOUS).fit(train.filter(~F.col("is_val")))
    scaled = scaler.transform(train)
    weights, _ = fit_network(scaled, P.FEATURES, "demand", scratch(spark), schedule=Schedule(epochs=6, batch_rows=None, rate=1e-2))
    val = scaled.filter("is_val")
    return mdl.residual_table(mdl.mlp_score(val, P.FEATURES, weights, keep=["row_id", "demand"]), "demand", "prediction")


# ---------------------------------------------------------------- 2.11 quality gates
@query("q_rowcount", W(O.base_ctes(False), gates_sql([
    ("rowcount", "abs(count(*) FILTER (WHERE Weather IS NOT NULL) - (SELECT count(*) FROM events))", "r")])))
def q_q_rowcount(spark, sf):
    n = table(spark, sf, "events").count()  # the readings view keeps every event; those without weather are lost here
    return qa.expect(R(spark, sf).filter(F.col("Weather").isNotNull()), qa.rowcount(n))


@query("q_not_null", W(O.base_ctes() + TRAIN_IMP, gates_sql([(f"not_null:{c}", f"count(*) FILTER (WHERE {c} IS NULL)", TRAIN_LAST)
                                                            for c in O.READINGS_COLS])))
def q_q_not_null(spark, sf):
    return qa.expect(_train_clean(spark, sf), qa.not_null(O.READINGS_COLS))


@query("q_domain", W(O.base_ctes() + TRAIN_IMP, gates_sql([
    ("domain:Weather", "count(*) FILTER (WHERE Weather IS NULL OR Weather NOT IN ('Sunny','Rainy','Foggy','Snowy','Cloudy'))", TRAIN_LAST),
    ("domain:RoadType", "count(*) FILTER (WHERE RoadType IS NULL OR RoadType NOT IN ('Residential','Street','Highway'))", TRAIN_LAST)])))
def q_q_domain(spark, sf):
    return qa.expect(_train_clean(spark, sf), qa.domain("Weather", P.WEATHERS) + qa.domain("RoadType", P.ROAD_TYPES))


@query("q_range", W(O.base_ctes(False) + [("d", f"SELECT *, {_LAT} AS latitude, {_LON} AS longitude FROM r")], gates_sql([
    ("range:latitude", "count(*) FILTER (WHERE latitude IS NULL OR latitude NOT BETWEEN -90 AND 90)", "d"),
    ("range:longitude", "count(*) FILTER (WHERE longitude IS NULL OR longitude NOT BETWEEN -180 AND 180)", "d"),
    ("range:Temperature", "count(*) FILTER (WHERE Temperature IS NULL OR Temperature NOT BETWEEN 5 AND 30)", "d")])))
def q_q_range(spark, sf):
    return qa.expect(P.decode(R(spark, sf)), qa.in_range("latitude", -90, 90) + qa.in_range("longitude", -180, 180) +
                     qa.in_range("Temperature", 5, 30))


@query("q_slots", W(O.base_ctes(False), gates_sql([
    ("slots:minute", "count(*) FILTER (WHERE NOT minute IN (0, 15, 30, 45))", "(" + HM.format(src="r") + ")"),
    ("n_slots:time_index", "abs(count(DISTINCT hour * 4 + minute // 15) - 96)", "(" + HM.format(src="r") + ")")])))
def q_q_slots(spark, sf):
    t = enc.time_features(R(spark, sf), "timestamp")
    return qa.expect(t, qa.slots("minute", [0, 15, 30, 45]) + qa.slots("time_index", n=96))


@query("q_onehot_sum", W(O.base_ctes(False) + [("oh", f"SELECT {rt_cols(P.ROAD_TYPES, 'Residential')}, {rt_cols(P.WEATHERS, None, 'Weather')} FROM r")], gates_sql([
    ("onehot_sum:RoadType", "count(*) FILTER (WHERE RoadType_Residential + RoadType_Street + RoadType_Highway <> 1)", "oh"),
    ("onehot_sum:Weather", "count(*) FILTER (WHERE Weather_Sunny + Weather_Rainy + Weather_Foggy + Weather_Snowy + Weather_Cloudy <> 1)", "oh")])))
def q_q_onehot_sum(spark, sf):
    df = enc.one_hot(R(spark, sf), "RoadType", P.ROAD_TYPES, default="Residential")
    df = enc.one_hot(df, "Weather", P.WEATHERS)  # no default: a missing weather has no class
    return qa.expect(df, qa.onehot_sum([f"RoadType_{v}" for v in P.ROAD_TYPES], "RoadType") +
                     qa.onehot_sum([f"Weather_{v}" for v in P.WEATHERS], "Weather"))


# The columns' declared types, as the rows must be readable.
CONTRACT = {"row_id": "bigint", "day": "int", "demand": "double", "Temperature": "double", "NumberofLanes": "int", "geohash": "double"}


@query("q_schema", W(O.base_ctes(False), gates_sql(
    [(f"typed:{c}", f"count(*) FILTER (WHERE TRY_CAST({c} AS {t}) IS NULL)", "r") for c, t in CONTRACT.items()])
    + " UNION ALL SELECT * FROM (VALUES ('schema:present', 0::BIGINT, true), ('schema:absent', 1::BIGINT, false)) t(\"check\", violations, passed)"))
def q_q_schema(spark, sf):
    """Column names from the schema, types from the rows: how many do not read as
    their declared type (a geohash read as a number shows what fails)."""
    r = R(spark, sf)
    names = qa.schema_check(r, list(CONTRACT), absent=("Index", "day"), ordered=False, no_strings=False).filter(F.col("check").isin("schema:present", "schema:absent"))
    return qa.expect(r, qa.typed(CONTRACT)).unionByName(names)


# The ladders without their global fallbacks leave cells open: a violation to find.
OPEN_PLAN = [("RoadType", ladders.road_ladder()[:1]), ("Temperature", ladders.temperature_ladder()[:1]), ("Weather", ladders.weather_ladder()[:2])]
_open_ctes, _open_last = O.plan_ctes("rh", OPEN_PLAN, name="o")


@query("q_audit_complete", W(O.base_ctes() + _open_ctes + [("a", audit_sql(_open_last, P.IMPUTED))], gates_sql([
    (f"audit_complete:{c}", f"(SELECT count(*) FROM r WHERE {c} IS NULL) - count(*) FILTER (WHERE \"column\" = {O.q(c)} "
                            f"AND fill_successful)", "a") for c in P.IMPUTED])))
def q_q_audit_complete(spark, sf):
    out = imp.impute_all(ladders.with_helpers(R(spark, sf)), OPEN_PLAN)
    return qa.audit_complete(out, imp.impute_audit(out, P.IMPUTED), P.IMPUTED)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
