"""Imputation ladders for road readings: tiers, keys and rule labels.

The rule labels are fixed values: they must read exactly as the reference's
audit table does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from strata.functions.columns import Bands, geo_prefix, parse_hm
from strata.operators.impute import Tier

# Rule labels of the training ladders.
RT1 = "RT-1: geohash mode"
RT2 = "RT-2: geohash4 prefix mode"
RT3 = "RT-3: global mode fallback"
TM1 = "TM-1: geohash+day+hour median"
TM2 = "TM-2: geohash+hour median"
TM3 = "TM-3: geohash median"
TM4 = "TM-4: weather median"
TM5 = "TM-5: global median fallback"
WE1 = "WE-1: geohash+day mode"
WE2 = "WE-2: geohash mode"
WE3 = "WE-3: temperature inference"
WE4 = "WE-4: global mode fallback"

# Temperature bands for inferring weather (upper bound, label), else Sunny.
WEATHER_BANDS = [(2, "Snowy"), (10, "Rainy"), (20, "Cloudy")]
WEATHER_ELSE = "Sunny"

HELPERS = ("_hour", "_geo4", "_geo3")


def with_helpers(df: DataFrame, ts: str = "timestamp", geohash: str = "geohash") -> DataFrame:
    """Temporary grouping keys: hour of the "H:M" string, 4- and 3-char parents."""
    hour, _ = parse_hm(ts)
    return df.withColumns({"_hour": hour, "_geo4": geo_prefix(geohash, 4), "_geo3": geo_prefix(geohash, 3)})


def infer_weather(null_label=None):
    return Bands(tuple(WEATHER_BANDS), WEATHER_ELSE, null_label)


def road_ladder() -> list[Tier]:
    return [Tier(RT1, ("geohash",), "mode"), Tier(RT2, ("_geo4",), "mode"), Tier(RT3, (), "mode")]


def temperature_ladder(min_count: int = 2) -> list[Tier]:
    """min_count=2 is the training rule for TM-1; the serving ladder has none."""
    return [Tier(TM1, ("geohash", "day", "_hour"), "median", min_count=min_count),
            Tier(TM2, ("geohash", "_hour"), "median"),
            Tier(TM3, ("geohash",), "median"),
            Tier(TM4, ("Weather",), "median"),
            Tier(TM5, (), "median")]


def weather_ladder(null_label=None) -> list[Tier]:
    """null_label: weather inferred for a null temperature (training: none;
    the serving path's row rule falls through to Sunny)."""
    return [Tier(WE1, ("geohash", "day"), "mode"),
            Tier(WE2, ("geohash",), "mode"),
            Tier(WE3, stat="derive", derive_from="Temperature", derive=infer_weather(null_label)),
            Tier(WE4, (), "mode")]


def training_plan():
    """Columns in dependency order: RoadType; Temperature (TM-4 uses the raw
    Weather); Weather (WE-3 uses the filled Temperature)."""
    return [("RoadType", road_ladder()), ("Temperature", temperature_ladder()), ("Weather", weather_ladder())]


def serving_plan():
    """Test-side ladder: no min count at TM-1, weather inference treats a
    missing temperature as Sunny. Order Temperature -> Weather -> RoadType."""
    return [("Temperature", temperature_ladder(min_count=0)),
            ("Weather", weather_ladder(null_label=WEATHER_ELSE)),
            ("RoadType", road_ladder())]


# Variant ladders (second test-side preparation): rule labels reuse the tier names.
def alt_plan():
    return [
        ("RoadType", [Tier("RT-1", ("geohash",), "mode"), Tier("RT-2", ("_geo4",), "mode"),
                      Tier("RT-3", ("_geo3",), "mode"), Tier("RT-global", (), "mode")]),
        ("Temperature", [Tier("TM-1", ("geohash", "_hour"), "median"), Tier("TM-2", ("geohash",), "median"),
                         Tier("TM-3", ("_geo4",), "median"), Tier("TM-4", ("_hour",), "median"),
                         Tier("TM-global", (), "median")]),
        ("Weather", [Tier("WE-1", ("geohash", "_hour"), "mode"), Tier("WE-2", ("geohash",), "mode"),
                     Tier("WE-3", ("_hour",), "mode"), Tier("WE-global", (), "mode")]),
    ]


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*HELPERS)
