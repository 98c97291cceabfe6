import random

import pytest
from pyspark.sql import functions as F

from strata import functions as fn
from strata.functions.geo import GEOHASH_ALPHABET
from strata.plans import ladders


def bisect_decode(g):
    """Reference decoder by interval bisection (test oracle)."""
    lat, lon = [-90.0, 90.0], [-180.0, 180.0]
    even = True
    for ch in g:
        d = GEOHASH_ALPHABET.index(ch)
        for b in (16, 8, 4, 2, 1):
            iv = lon if even else lat
            mid = (iv[0] + iv[1]) / 2
            if d & b:
                iv[0] = mid
            else:
                iv[1] = mid
            even = not even
    return ((lat[0] + lat[1]) / 2, (lon[0] + lon[1]) / 2, (lat[1] - lat[0]) / 2, (lon[1] - lon[0]) / 2)


def test_parse_hm_and_slots(spark):
    df = spark.createDataFrame([("2:0",), ("13:45",), ("02:15",)], "t string")
    h, m = fn.parse_hm("t")
    rows = df.select(h.alias("h"), m.alias("m"), fn.time_index(h, m).alias("slot"),
                     fn.minute_of_day(h, m).alias("mod")).collect()
    assert [(r.h, r.m, r.slot, r.mod) for r in rows] == [(2, 0, 8, 120), (13, 45, 55, 825), (2, 15, 9, 135)]


def test_parse_hm_strict_vs_lenient(spark):
    df = spark.createDataFrame([("x:1",), ("5",)], "t string")
    with pytest.raises(Exception):
        df.select(fn.parse_hm("t")[0]).collect()
    h, m = fn.parse_hm("t", strict=False)
    assert [tuple(r) for r in df.select(h, m).collect()] == [(None, 1), (5, None)]


def test_band_edges(spark):
    df = spark.createDataFrame([(1.9,), (2.0,), (9.9,), (10.0,), (20.0,), (None,)], "t double")
    strict = [r[0] for r in df.select(ladders.infer_weather(None)(F.col("t"))).collect()]
    lenient = [r[0] for r in df.select(ladders.infer_weather("Sunny")(F.col("t"))).collect()]
    assert strict == ["Snowy", "Rainy", "Rainy", "Cloudy", "Sunny", None]
    assert lenient[-1] == "Sunny"


def test_vocab_and_flags(spark):
    df = spark.createDataFrame([("Street",), ("Dirt",), (None,)], "c string")
    assert [r[0] for r in df.select(fn.close_vocab("c", ["Street", "Highway"], "Residential")).collect()] == \
        ["Street", "Residential", "Residential"]
    assert [r[0] for r in df.select(fn.eq_flag("c", "Street")).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(fn.recode("c", {"Street": 1})).collect()] == [1, None, None]
    assert [r[0] for r in df.select(fn.recode("c", {"Street": 1}, default=0)).collect()] == [1, 0, 0]


def test_clip_and_score(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(fn.clip_lower("x")).collect()] == [0.0, 2.0, None]
    assert [r[0] for r in df.select(fn.score100(F.col("x"))).collect()][:2] == [0.0, 200.0]


def test_geohash_decode_matches_bisection(spark):
    rnd = random.Random(7)
    hashes = ["".join(rnd.choice(GEOHASH_ALPHABET) for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(h,) for h in hashes], "g string")
    d = fn.geohash_decode("g")
    got = {r.g: (r.latitude, r.longitude, r.latitude_err, r.longitude_err)
           for r in df.select("g", d["latitude"].alias("latitude"), d["longitude"].alias("longitude"),
                              d["latitude_err"].alias("latitude_err"),
                              d["longitude_err"].alias("longitude_err")).collect()}
    for h in hashes:
        assert got[h] == bisect_decode(h), h


def test_geohash_invalid_rejected(spark):
    df = spark.createDataFrame([("qpa0",), ("qp0bcdefghjkm",), ("",), ("QP",)], "g string")
    d = fn.geohash_decode("g")
    assert all(r[0] is None and r[1] is None for r in df.select(d["latitude"], d["longitude"]).collect())
    t = fn.with_geohash_coords(df, "g").collect()
    assert all(r.latitude is None and r.longitude is None for r in t)


def test_table_decode_matches_column_decode(spark):
    rnd = random.Random(11)
    hashes = ["".join(rnd.choice(GEOHASH_ALPHABET) for _ in range(rnd.randint(1, 12))) for _ in range(200)]
    df = spark.createDataFrame([(h,) for h in hashes], "g string")
    t = {r.g: (r.latitude, r.longitude, r.latitude_err, r.longitude_err)
         for r in fn.with_geohash_coords(df, "g", keep_err=True).collect()}
    for h in hashes:
        assert t[h] == bisect_decode(h), h
    r = {x.g: (x.latitude, x.longitude) for x in fn.with_geohash_coords(df, "g", rounded=True).collect()}
    d = fn.geohash_decode_rounded("g")
    c = {x.g: (x.la, x.lo) for x in df.select("g", d["latitude"].alias("la"), d["longitude"].alias("lo")).collect()}
    assert r == c


def test_geohash_rounded_is_close(spark):
    df = spark.createDataFrame([("qp3b",), ("qp3bcd",), ("u4pruydqqvj",)], "g string")
    d, r = fn.geohash_decode("g"), fn.geohash_decode_rounded("g")
    import math

    def decimals(err):
        return max(1, round(-math.log10(err))) - 1

    for row in df.select(d.alias("d"), r.alias("r")).collect():
        for v, e, rv in ((row.d.latitude, row.d.latitude_err, row.r.latitude),
                         (row.d.longitude, row.d.longitude_err, row.r.longitude)):
            assert abs(rv - v) <= 0.5 * 10 ** -decimals(e) + 1e-12
            assert rv == round(rv, decimals(e))
