"""Road-reading view over the driver's ``events`` table.

The reference's own inputs are not shipped, so the readings table (one row
per cell and 15-minute slot, with gaps in RoadType, Temperature and Weather)
is a deterministic projection of ``events``. The derivation rules below are
fixed values shared with the SQL oracle; they run unchanged in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READINGS_COLUMNS = ["row_id", "geohash", "day", "timestamp", "demand", "RoadType", "NumberofLanes",
                    "LargeVehicles", "Landmarks", "Temperature", "Weather"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def road_readings(events: DataFrame) -> DataFrame:
    """events -> (row_id, geohash, day, timestamp "H:M", demand, RoadType,
    NumberofLanes, LargeVehicles, Landmarks, Temperature, Weather)."""
    uid, eid, ts = F.col("user_id"), F.col("event_id"), F.col("ts")
    dom = F.dayofmonth(ts)
    geohash = F.concat(
        F.lit("qp"),
        F.substr(F.lit("0123"), (uid % 4).cast("int") + 1, F.lit(1)),
        F.substr(F.lit("bcdefghj"), (uid % 8).cast("int") + 1, F.lit(1)),
        F.translate(F.substr(F.md5(uid.cast("string")), F.lit(1), F.lit(2)), "a", "g"),
    )
    slot_minute = (F.floor(F.minute(ts) / 15) * 15).cast("int")
    road = (F.when((uid % 8 == 3) | (uid % 10 == 1) | (eid % 13 == 0), F.lit(None).cast("string"))
            .when(eid % 3 == 0, "Residential").when(eid % 3 == 1, "Street").otherwise("Highway"))
    temp = (F.when((uid % 12 == 5) | (eid % 4 == 0), F.lit(None).cast("double"))
            .otherwise((eid * 7 % 35).cast("double")))
    et = F.col("event_type")
    weather = (F.when((uid % 9 == 4) | (eid % 11 == 0) | (uid % 24 == 5) | ((uid % 7 == 2) & (dom % 2 == 0)),
                      F.lit(None).cast("string"))
               .when(et == "click", "Sunny").when(et == "view", "Rainy").when(et == "error", "Foggy")
               .when(et == "signup", "Snowy").otherwise("Cloudy"))
    return events.select(
        eid.alias("row_id"),
        geohash.alias("geohash"),
        (F.lit(48) + dom % 2).cast("int").alias("day"),
        F.concat(F.hour(ts).cast("string"), F.lit(":"), slot_minute.cast("string")).alias("timestamp"),
        (F.col("value") / 100.0).alias("demand"),
        road.alias("RoadType"),
        (F.lit(1) + uid % 5).cast("int").alias("NumberofLanes"),
        F.when(uid % 2 == 0, "Allowed").otherwise("Not Allowed").alias("LargeVehicles"),
        F.when(uid % 3 == 0, "Yes").otherwise("No").alias("Landmarks"),
        temp.alias("Temperature"),
        weather.alias("Weather"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return road_readings(table(spark, sf_dir, "events"))
