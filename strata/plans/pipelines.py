"""End-to-end compositions: training features, serving features, the cheap
constant preparation, and batch scoring. Train and serve share the same
operators; only the parameters (ladders, decode mode) differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import add_flag, clip_lower, close_vocab, parse_hm
from strata.functions.geo import is_valid_geohash, with_geohash_coords
from strata.operators.encode import binary_encode, one_hot, time_features
from strata.operators.impute import fill_const, impute_all, prov_cols
from strata.operators.model import mlp_score
from strata.operators import quality
from strata.operators.relational import align
from strata.operators.scale import scaler_apply, scaler_fit, scaler_params
from strata.operators.split import split_cutoff, split_flag
from strata.operators.target import TargetEncoding, target_encode_apply, target_encode_fit
from strata.plans import ladders
from strata.session import stage_end
from strata.sources.io import submission

# Vocabularies, binary maps and the model's ordered input contract.
ROAD_TYPES = ["Residential", "Street", "Highway"]
WEATHERS = ["Sunny", "Rainy", "Foggy", "Snowy", "Cloudy"]
LARGE_VEHICLES = {"Allowed": 1, "Not Allowed": 0}
LANDMARKS = {"Yes": 1, "No": 0}
CONTINUOUS = ["NumberofLanes", "Temperature", "latitude", "longitude", "hour_sin", "hour_cos", "min_sin",
              "min_cos", "geohash_target_mean", "geohash_target_median"]
BINARY = ["LargeVehicles", "Landmarks", "is_day_49", "RoadType_Residential", "RoadType_Street",
          "RoadType_Highway", "Weather_Sunny", "Weather_Rainy", "Weather_Foggy", "Weather_Snowy",
          "Weather_Cloudy"]
FEATURES = CONTINUOUS + BINARY
# For a linear fit with intercept: one class of each one-hot set is the reference.
LINEAR_FEATURES = [c for c in FEATURES if c not in ("RoadType_Residential", "Weather_Sunny")]
IMPUTED = ["RoadType", "Temperature", "Weather"]
SPLIT_SEED = 42
VAL_FRACTION = 0.2


def _drop_provenance(df: DataFrame, cols=IMPUTED) -> DataFrame:
    return df.drop(*[p for c in cols for p in prov_cols(c)])


def clean(readings: DataFrame, plan=None, strategy: str = "auto") -> DataFrame:
    """Imputed readings with provenance columns (helpers dropped)."""
    df = ladders.with_helpers(readings)
    df = impute_all(df, plan or ladders.training_plan(), strategy=strategy)
    return ladders.drop_helpers(df)


def decode(df: DataFrame, rounded: bool = False, keep_err: bool = False) -> DataFrame:
    # imputation before and encoding after it: with them, one method too large to be compiled
    return stage_end(with_geohash_coords(stage_end(df), "geohash", rounded=rounded, keep_err=keep_err))


def row_checks(domains: bool = False) -> list[quality.Check]:
    """What every encoded row has to hold: a Temperature, hours and minutes on the
    15-minute grid, decoded coordinates, closed binary maps, one class per one-hot
    set; with ``domains`` the categories had to lie in their vocabulary before they
    were encoded. They read columns that ``encode`` has computed anyway."""
    checks = quality.not_null(["Temperature"], nan=True)
    checks += quality.domain("RoadType", ROAD_TYPES) + quality.domain("Weather", WEATHERS) if domains else []
    checks += [quality.Check("range:hour", ~F.coalesce(F.col("hour").between(0, 23), F.lit(False))),
               quality.Check("slots:minute", ~F.coalesce(F.col("minute").isin([0, 15, 30, 45]), F.lit(False))),
               quality.Check("domain:geohash", F.col("latitude").isNull() | F.col("longitude").isNull())]
    checks += quality.domain("LargeVehicles", [0, 1]) + quality.domain("Landmarks", [0, 1])
    checks += quality.onehot_sum([f"RoadType_{v}" for v in ROAD_TYPES], "RoadType")
    return checks + quality.onehot_sum([f"Weather_{v}" for v in WEATHERS], "Weather")


def raw_checks(binary: bool = True) -> list[quality.Check]:
    """Checks on readings as they arrive: times on the grid, geohashes that decode,
    values that the binary maps know. They never raise on a malformed value."""
    hour, minute = parse_hm("timestamp", strict=False)
    checks = [quality.Check("range:hour", ~F.coalesce(hour.between(0, 23), F.lit(False))),
              quality.Check("slots:minute", ~F.coalesce(minute.isin([0, 15, 30, 45]), F.lit(False))),
              quality.Check("domain:geohash", ~F.coalesce(is_valid_geohash("geohash"), F.lit(False)))]
    return checks + (quality.domain("LargeVehicles", list(LARGE_VEHICLES)) + quality.domain("Landmarks", list(LANDMARKS)) if binary else [])


def encode(df: DataFrame, keep_time_parts: bool = True, checks: Sequence[quality.Check] = ()) -> DataFrame:
    """Binary maps, time of day, closed-vocabulary one-hots, day flag. ``checks``
    are tested on the encoded rows, before the columns that only they need go."""
    df = binary_encode(df, "LargeVehicles", LARGE_VEHICLES)
    df = binary_encode(df, "Landmarks", LANDMARKS)
    df = time_features(df, "timestamp")
    df = one_hot(df, "RoadType", ROAD_TYPES, default="Residential", drop=False)
    df = one_hot(df, "Weather", WEATHERS, default="Sunny", drop=False)
    df = quality.guard(add_flag(df, "day", 49, "is_day_49"), checks)
    return df.drop("day", "RoadType", "Weather", *([] if keep_time_parts else ["hour", "minute"]))


def fit_target(train_rows: DataFrame) -> TargetEncoding:
    return target_encode_fit(train_rows, "geohash", "demand", prefix="geohash_target")


def train_features(readings: DataFrame, strategy: str = "auto", enforce: bool = True) -> tuple[DataFrame, TargetEncoding]:
    """Training path: impute -> exact decode -> encode -> exact 80/20 split ->
    target encoding fitted on training rows -> (row_id, 21 features, demand, is_val).

    The split and the target statistics depend only on columns that are never
    imputed (row_id, geohash, demand), so both are fitted on a narrow scan of
    the raw table; the split is then a row predicate and the encoding a lookup
    on the imputed frame, whose plan runs once. ``enforce``: a row that breaks a
    gate fails the job that reads the result."""
    cutoff = split_cutoff(readings, "row_id", VAL_FRACTION, SPLIT_SEED)
    enc = train_encoding_from_raw(readings, cutoff)
    df = _drop_provenance(clean(readings, strategy=strategy))
    df = encode(decode(df), checks=row_checks(domains=True) if enforce else ())
    df = target_encode_apply(df.withColumn("is_val", split_flag("row_id", cutoff, SPLIT_SEED)), enc)
    return df.select("row_id", *FEATURES, "demand", "is_val"), enc


def train_encoding_from_raw(train_raw: DataFrame, cutoff: str | None | bool = False) -> TargetEncoding:
    """Target statistics straight from the raw training table, split with the
    same seed on the same row ids (so the same rows as the training path)."""
    if cutoff is False:
        cutoff = split_cutoff(train_raw, "row_id", VAL_FRACTION, SPLIT_SEED)
    train = train_raw.select("row_id", "geohash", "demand").filter(~split_flag("row_id", cutoff, SPLIT_SEED))
    return fit_target(train)


def serve_features(test: DataFrame, train_raw: DataFrame, strategy: str = "auto", enforce: bool = True) -> DataFrame:
    """Serving path on a test table (statistics from the test table itself):
    serving ladder -> rounded decode -> encode -> target encoding from the raw
    training table -> (row_id, 21 ordered features)."""
    df = _drop_provenance(clean(test, ladders.serving_plan(), strategy=strategy))
    df = df.withColumns({"Weather": close_vocab("Weather", WEATHERS, "Sunny"),
                         "RoadType": close_vocab("RoadType", ROAD_TYPES, "Residential")})
    df = encode(decode(df, rounded=True), keep_time_parts=False, checks=row_checks() if enforce else ())
    df = target_encode_apply(df, train_encoding_from_raw(train_raw))
    return align(df, FEATURES, keep=["row_id"])


def const_features(test: DataFrame, train_raw: DataFrame, temperature: float = 16.3803, enforce: bool = True) -> DataFrame:
    """The cheap test preparation: constant Temperature, exact decode, binary
    maps, time features (parts kept), vocab closure (null -> default),
    one-hots, day flag, geohash target encoding fitted on the training split
    (same rows as the training path); geohash dropped (24 columns + row_id)."""
    df = fill_const(test, "Temperature", temperature)
    df = encode(decode(df), checks=row_checks() if enforce else ())
    df = target_encode_apply(df, train_encoding_from_raw(train_raw))
    return df.drop("geohash")


# The second test preparation's open categories and lenient flags.
OPEN_ROAD_TYPES = ["Arterial", "Highway", "Street"]
OPEN_WEATHERS = ["Clear", "Rainy", "Snowy"]
LENIENT_MAP = {"Yes": 1, "No": 0}


def alt_features(test: DataFrame, train_raw: DataFrame, strategy: str = "auto", enforce: bool = True) -> DataFrame:
    """The second test preparation: the alternative ladders, lenient Yes/No maps,
    open-vocabulary one-hots, time of day over 1440 minutes, an existing day flag
    kept, target encoding from the raw training table. Its maps and vocabularies are
    open, so only times, coordinates and Temperature are checked."""
    df = _drop_provenance(clean(test, ladders.alt_plan(), strategy=strategy))
    for c in ("LargeVehicles", "Landmarks"):
        df = binary_encode(df, c, LENIENT_MAP, default=0)
    df = one_hot(df, "RoadType", OPEN_ROAD_TYPES, skip_existing=True)
    df = one_hot(df, "Weather", OPEN_WEATHERS, skip_existing=True)
    df = decode(add_flag(time_features(df, "timestamp", style="day_minute"), "day", 49, "is_day_49"))
    time_and_place = ("not_null:Temperature", "range:hour", "domain:geohash")
    df = quality.guard(df, [c for c in row_checks() if c.name in time_and_place] if enforce else ())
    return target_encode_apply(df.drop("day", "hour", "minute"), train_encoding_from_raw(train_raw)).drop("geohash")


def train_and_serve(readings: DataFrame, test: DataFrame, strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Both feature paths, built concurrently: they share no intermediate
    result, so their (small, bounded) fitting jobs overlap on the cluster."""
    inherit = inheritable_thread_target(readings.sparkSession)
    with ThreadPoolExecutor(max_workers=2) as pool:
        tr = pool.submit(inherit(train_features), readings, strategy)
        sv = pool.submit(inherit(serve_features), test, readings, strategy)
        return tr.result()[0], sv.result()


def score(features: DataFrame, train_features_df: DataFrame, weights: dict, clip: bool = True, expected: DataFrame | None = None) -> DataFrame:
    """Scoring path: scaler refit on the training rows' continuous columns,
    applied to the serving features, batched network inference, clip at 0,
    checked output contract ``Index, demand``. ``expected``: the table whose row ids
    must all come out, each once (see ``submission``)."""
    train_rows = train_features_df.filter(~F.col("is_val"))
    params = scaler_params(scaler_fit(train_rows, CONTINUOUS), CONTINUOUS)
    scaled = scaler_apply(features, params)
    pred = mlp_score(scaled, FEATURES, weights, keep=["row_id"], out="demand")
    if clip:
        pred = pred.withColumn("demand", clip_lower("demand", 0.0))
    return submission(pred, "row_id", "demand", expected=expected)
