"""DuckDB oracle SQL for the registered queries.

Independent formulations of the same semantics: cascades are sequential
window CTEs (not value bins), modes are ranked ``count desc, value asc``, the
geohash is decoded bit by bit with list lambdas, the split is a
``row_number()`` over the hash. Computed doubles are rounded to 6 places on
both sides (the Spark side rounds in ``registry.r6``).
"""

from __future__ import annotations

from collections.abc import Sequence

from strata.functions.geo import GEOHASH_ALPHABET
from strata.operators.impute import Tier

# The readings view over ``events`` (same rules as sources.fixtures).
READINGS_SQL = """SELECT event_id AS row_id,
       concat('qp', substr('0123', CAST(user_id % 4 AS INT) + 1, 1),
                    substr('bcdefghj', CAST(user_id % 8 AS INT) + 1, 1),
                    translate(substr(md5(CAST(user_id AS VARCHAR)), 1, 2), 'a', 'g')) AS geohash,
       CAST(48 + extract(day FROM ts) % 2 AS INT) AS day,
       concat(CAST(extract(hour FROM ts) AS VARCHAR), ':',
              CAST(CAST(floor(extract(minute FROM ts) / 15) * 15 AS INT) AS VARCHAR)) AS timestamp,
       value / 100.0 AS demand,
       CASE WHEN user_id % 8 = 3 OR user_id % 10 = 1 OR event_id % 13 = 0 THEN NULL
            WHEN event_id % 3 = 0 THEN 'Residential' WHEN event_id % 3 = 1 THEN 'Street'
            ELSE 'Highway' END AS RoadType,
       CAST(1 + user_id % 5 AS INT) AS NumberofLanes,
       CASE WHEN user_id % 2 = 0 THEN 'Allowed' ELSE 'Not Allowed' END AS LargeVehicles,
       CASE WHEN user_id % 3 = 0 THEN 'Yes' ELSE 'No' END AS Landmarks,
       CASE WHEN user_id % 12 = 5 OR event_id % 4 = 0 THEN NULL
            ELSE CAST(event_id * 7 % 35 AS DOUBLE) END AS Temperature,
       CASE WHEN user_id % 9 = 4 OR event_id % 11 = 0 OR user_id % 24 = 5
                  OR (user_id % 7 = 2 AND extract(day FROM ts) % 2 = 0) THEN NULL
            WHEN event_type = 'click' THEN 'Sunny' WHEN event_type = 'view' THEN 'Rainy'
            WHEN event_type = 'error' THEN 'Foggy' WHEN event_type = 'signup' THEN 'Snowy'
            ELSE 'Cloudy' END AS Weather
FROM events"""

READINGS_COLS = ["row_id", "geohash", "day", "timestamp", "demand", "RoadType", "NumberofLanes",
                 "LargeVehicles", "Landmarks", "Temperature", "Weather"]

HELPERS_SQL = ("SELECT *, CAST(split_part(timestamp, ':', 1) AS INTEGER) AS _hour, "
               "substr(geohash, 1, 4) AS _geo4, substr(geohash, 1, 3) AS _geo3 FROM {src}")


def r6(expr: str) -> str:
    """Oracle hygiene, the same IEEE steps as ``registry.r6``: snap to 9
    decimals (drops summation-order noise), then round to 6, each as
    ``round(x * 10^k) / 10^k`` (half away from zero in both engines)."""
    return f"(round(round(({expr}) * 1e9) / 1e9 * 1e6) / 1e6 + 0.0)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_(ctes: Sequence[tuple[str, str]], final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in ctes) + "\n" + final


def base_ctes(helpers: bool = True) -> list[tuple[str, str]]:
    ctes = [("r", READINGS_SQL)]
    if helpers:
        ctes.append(("rh", HELPERS_SQL.format(src="r")))
    return ctes


def band_sql(col: str, null_label: str | None) -> str:
    nl = "NULL" if null_label is None else q(null_label)
    return (f"CASE WHEN {col} IS NULL THEN {nl} WHEN {col} < 2 THEN 'Snowy' WHEN {col} < 10 THEN 'Rainy' "
            f"WHEN {col} < 20 THEN 'Cloudy' ELSE 'Sunny' END")


def cascade_ctes(src: str, col: str, tiers: Sequence[Tier], name: str, sql_type: str,
                 derive_sql: dict | None = None) -> tuple[list[tuple[str, str]], str]:
    """Sequential tiers as CTEs over ``src``; adds ``_null_<col>``, ``_rule_<col>``.
    Returns (ctes, name of the last CTE)."""
    rule = f"_rule_{col}"
    ctes = [(f"{name}0", f"SELECT *, {col} IS NULL AS _null_{col}, CAST(NULL AS VARCHAR) AS {rule} FROM {src}")]
    prev = f"{name}0"
    for i, t in enumerate(tiers, 1):
        cur = f"{name}{i}"
        lab = q(t.rule)
        if t.stat == "mode":
            keys = list(t.keys)
            m = f"{name}m{i}"
            if keys:
                kl = ", ".join(keys)
                ctes.append((m, f"SELECT {kl}, _m FROM (SELECT {kl}, {col} AS _m, row_number() OVER "
                                f"(PARTITION BY {kl} ORDER BY count(*) DESC, {col}) AS _rn FROM {prev} "
                                f"WHERE {col} IS NOT NULL GROUP BY {kl}, {col}) WHERE _rn = 1"))
                on = " AND ".join(f"p.{k} = m.{k}" for k in keys)
            else:
                ctes.append((m, f"SELECT {col} AS _m FROM {prev} WHERE {col} IS NOT NULL GROUP BY {col} "
                                f"ORDER BY count(*) DESC, {col} LIMIT 1"))
                on = "TRUE"
            cond = f"p.{col} IS NULL AND m._m IS NOT NULL"
            ctes.append((cur, f"SELECT p.* REPLACE (CASE WHEN {cond} THEN m._m ELSE p.{col} END AS {col}, "
                              f"CASE WHEN {cond} THEN {lab} ELSE p.{rule} END AS {rule}) "
                              f"FROM {prev} p LEFT JOIN {m} m ON {on}"))
        elif t.stat in ("median", "mean"):
            fn = "median" if t.stat == "median" else "avg"
            over = f"OVER (PARTITION BY {', '.join(t.keys)})" if t.keys else "OVER ()"
            guard = " AND ".join([f"{k} IS NOT NULL" for k in t.keys] + ["_s IS NOT NULL"])
            if t.min_count:
                guard += f" AND _c >= {t.min_count}"
            cond = f"{col} IS NULL AND {guard}"
            ctes.append((cur, f"SELECT * EXCLUDE (_s, _c) REPLACE (CASE WHEN {cond} THEN CAST(_s AS {sql_type}) "
                              f"ELSE {col} END AS {col}, CASE WHEN {cond} THEN {lab} ELSE {rule} END AS {rule}) "
                              f"FROM (SELECT *, {fn}({col}) {over} AS _s, count({col}) {over} AS _c FROM {prev})"))
        elif t.stat == "derive":
            expr = (derive_sql or {})[t.rule]
            cond = f"{col} IS NULL AND ({expr}) IS NOT NULL"
            ctes.append((cur, f"SELECT * REPLACE (CASE WHEN {cond} THEN {expr} ELSE {col} END AS {col}, "
                              f"CASE WHEN {cond} THEN {lab} ELSE {rule} END AS {rule}) FROM {prev}"))
        elif t.stat == "const":
            cond = f"{col} IS NULL"
            ctes.append((cur, f"SELECT * REPLACE (CASE WHEN {cond} THEN CAST({t.value!r} AS {sql_type}) ELSE {col} "
                              f"END AS {col}, CASE WHEN {cond} THEN {lab} ELSE {rule} END AS {rule}) FROM {prev}"))
        prev = cur
    return ctes, prev


SQL_TYPES = {"RoadType": "VARCHAR", "Weather": "VARCHAR", "Temperature": "DOUBLE"}


def plan_ctes(src: str, plan, name: str = "c", null_label: str | None = None) -> tuple[list[tuple[str, str]], str]:
    """Several cascades in order (a later one sees the earlier fills).
    ``null_label``: weather inferred for a null temperature."""
    ctes, prev = [], src
    for j, (col, tiers) in enumerate(plan):
        derive = {t.rule: band_sql("Temperature", null_label) for t in tiers if t.stat == "derive"}
        c, prev = cascade_ctes(prev, col, tiers, f"{name}{j}_", SQL_TYPES[col], derive)
        ctes += c
    return ctes, prev


def geohash_sql(g: str) -> tuple[str, str, str, str]:
    """(lat, lon, lat_err, lon_err) SQL: bit p of the hash is bit (4 - p%5) of
    character p//5; even bits build the longitude cell index, odd the latitude."""
    n = f"length({g})"
    bit = f"(((instr('{GEOHASH_ALPHABET}', substr({g}, p // 5 + 1, 1)) - 1) >> (4 - p % 5)) & 1)"
    n_lon = f"((5 * {n} + 1) // 2)"
    n_lat = f"((5 * {n}) // 2)"
    k_lon = f"list_sum(list_transform(range(0, 5 * {n}, 2), lambda p: {bit} * pow(2, {n_lon} - 1 - p // 2)))"
    k_lat = f"list_sum(list_transform(range(1, 5 * {n}, 2), lambda p: {bit} * pow(2, {n_lat} - 1 - p // 2)))"
    lat = f"(-90 + ({k_lat} + 0.5) * 180.0 / pow(2, {n_lat}))"
    lon = f"(-180 + ({k_lon} + 0.5) * 360.0 / pow(2, {n_lon}))"
    return lat, lon, f"(90.0 / pow(2, {n_lat}))", f"(180.0 / pow(2, {n_lon}))"


def geohash_rounded_sql(g: str) -> tuple[str, str]:
    lat, lon, le, oe = geohash_sql(g)

    def rnd(v, e):
        return f"round_even({v}, CAST(greatest(1, round(-log10({e}))) - 1 AS INTEGER))"
    return rnd(lat, le), rnd(lon, oe)
