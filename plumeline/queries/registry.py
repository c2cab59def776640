"""Registered queries on the driver's tables, and the SQL with the same rows.

The tables have no vessels: positions are made from `events` by the same integer formulas in both
engines. Thresholds that the sparse events would never meet are widened; defaults stay with the
operators.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ship_class
from ..sources.staging import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HEAD = {"west": -95.0, "south": 28.0, "east": -93.0, "north": 30.0, "rows": 40, "cols": 40}
T0, T1 = "2024-01-10T00:00:00Z", "2024-01-13T00:00:00Z"
T0_US, T1_US = 1704844800000000, 1705104000000000


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u, i = F.col("user_id"), F.col("event_id")
    code = (i % 100).cast("int")
    return e.select(
        "event_id", (u + 200000000).cast("string").alias("mmsi"), F.col("ts").cast("timestamp").alias("ts"), (-95 + ((u * 7919 + i * 31) % 2000) / F.lit(1000.0)).alias("lon"), (28 + ((u * 104729 + i * 17) % 2000) / F.lit(1000.0)).alias("lat"),
        (F.col("value") / 10).alias("sog"), ((i * 37) % 360).cast("double").alias("cog"), F.when(i % 3 == 0, "gfw").otherwise("noaa").alias("source"), code.alias("type_code"), ship_class(code).alias("vessel_type"),
        F.concat(F.lit("V"), (i % 7).cast("string")).alias("name"), (i % 5).cast("int").alias("cargo_code"),
    )


POS = """pos AS (SELECT event_id, (200000000 + user_id)::VARCHAR AS mmsi, epoch_us(ts) AS us, -95 + ((user_id * 7919 + event_id * 31) % 2000) / 1000.0::DOUBLE AS lon,
 28 + ((user_id * 104729 + event_id * 17) % 2000) / 1000.0::DOUBLE AS lat, value / 10 AS sog, ((event_id * 37) % 360)::DOUBLE AS cog, CASE WHEN event_id % 3 = 0 THEN 'gfw' ELSE 'noaa' END AS source,
 (event_id % 100)::INTEGER AS type_code, CASE WHEN event_id % 100 BETWEEN 80 AND 89 THEN 'tanker' WHEN event_id % 100 BETWEEN 70 AND 79 THEN 'cargo' WHEN event_id % 100 = 30 THEN 'fishing'
 WHEN event_id % 100 BETWEEN 60 AND 69 THEN 'passenger' ELSE 'other' END AS vessel_type, 'V' || (event_id % 7) AS name, (event_id % 5)::INTEGER AS cargo_code FROM events)"""


def grid(spark: SparkSession) -> DataFrame:
    """A 40 x 40 Gaussian about (-94, 29)."""
    k = F.col("id")
    r, c = F.floor(k / 40).cast("int"), (k % 40).cast("int")
    x, y = (-95 + c * 2.0 / 39 + 94) / 0.4, (30 - r * 2.0 / 39 - 29) / 0.3
    return spark.range(1600).select(r.alias("r"), c.alias("c"), F.round(F.exp(-0.5 * (x * x + y * y)), 6).alias("p"))


GRID = """grid AS (SELECT (i // 40)::INTEGER AS r, (i % 40)::INTEGER AS c, round(exp(-0.5 * (pow((-95 + (i % 40) * 2.0::DOUBLE / 39 + 94) / 0.4::DOUBLE, 2) + pow((30 - (i // 40) * 2.0::DOUBLE / 39 - 29) / 0.3::DOUBLE, 2))), 6) AS p
 FROM range(1600) AS t(i))"""


def sampled(pos: str = "pos", name: str = "smp") -> str:
    """CTE with p, the nearest node's value, zero outside."""
    return f"""{name} AS (SELECT q.*, coalesce(g.p, 0) AS p FROM {pos} AS q LEFT JOIN grid AS g ON lon BETWEEN -95 AND -93 AND lat BETWEEN 28 AND 30
 AND g.r = round_even((30 - lat) / 2 * 39, 0)::INTEGER AND g.c = round_even((lon + 95) / 2 * 39, 0)::INTEGER)"""


def hav(a: str, b: str, c: str, d: str) -> str:
    """Great-circle km as SQL, from (a, b) to (c, d), lon first."""
    return f"(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(({d}) - ({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians(({c}) - ({a})) / 2), 2)))))"


def brg(a: str, b: str, c: str, d: str) -> str:
    t = f"radians(({c}) - ({a}))"
    y, x = f"sin({t}) * cos(radians({d}))", f"cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos({t})"
    return f"(((degrees(atan2({y}, {x})) % 360) + 360) % 360)"


def ang(a: str, b: str) -> str:
    return f"abs((((({a}) - ({b}) + 180) % 360) + 360) % 360 - 180)"


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def us(x: Column | str) -> Column:
    return F.unix_micros(x)


def folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(spark)}/plumeline-queries/{uuid.uuid4().hex}"


def instant(text: str) -> Column:
    return F.to_timestamp(F.lit(text))
