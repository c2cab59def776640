"""Synthetic fleets, grids and offenders. Randomness is a hash of a seed and an id: the same on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG, local_xy_km


def uniform(*ids: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the ids and the seed only."""
    return F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def fleet(spark: SparkSession, vessels: int, fixes: int, start_us: int, minutes: float, box: tuple[float, float, float, float], seed: int = 0) -> DataFrame:
    """Vessels that cross a box on straight courses, one fix every few minutes."""
    west, south, east, north = box
    v = spark.range(vessels).select((F.col("id") + 201000000).cast("string").alias("mmsi"), uniform("id", seed=seed).alias("a"), uniform("id", seed=seed + 1).alias("b"), uniform("id", seed=seed + 2).alias("c"))
    v = v.withColumn("sog", 5 + 15 * F.col("c")).withColumn("cog", 360 * F.col("b"))
    f = v.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(fixes - 1))))
    km = F.col("sog") * 1.852 * F.col("k") * minutes / 60
    lat0, lon0 = south + (north - south) * F.col("a"), west + (east - west) * uniform("mmsi", seed=seed + 3)
    return f.select(
        "mmsi", F.timestamp_micros(F.lit(start_us) + (F.col("k") * minutes * 60e6).cast("long")).alias("ts"), (lon0 + km * F.sin(F.radians("cog")) / (KM_PER_DEG * math.cos(math.radians((south + north) / 2)))).alias("lon"),
        (lat0 + km * F.cos(F.radians("cog")) / KM_PER_DEG).alias("lat"), "sog", "cog", F.lit("noaa").alias("source"), F.element_at(F.array(*(F.lit(x) for x in ("tanker", "cargo", "fishing", "passenger", "other"))), (F.pmod(F.xxhash64("mmsi"), F.lit(5)) + 1).cast("int")).alias("vessel_type"),
    )


def gaussian_grid(spark: SparkSession, head: dict, lon0: float, lat0: float, sd_major_km: float, sd_minor_km: float, axis_deg: float) -> DataFrame:
    """(r, c, p): an elongated Gaussian with a peak of one, four decimals, row 0 in the north."""
    from .grid import node_lonlat

    cells = spark.range(head["rows"] * head["cols"]).select(F.floor(F.col("id") / head["cols"]).cast("int").alias("r"), F.pmod("id", F.lit(head["cols"])).cast("int").alias("c"))
    x, y = local_xy_km(*node_lonlat(F.col("r"), F.col("c"), head), lon0, lat0)
    s, c = math.sin(math.radians(axis_deg)), math.cos(math.radians(axis_deg))
    along, across = (x * s + y * c) / sd_major_km, (x * c - y * s) / sd_minor_km
    return cells.select("r", "c", F.bround(F.exp(-0.5 * (along * along + across * across)), 4).alias("p"))


def offender(spark: SparkSession, trials: DataFrame, hours: float = 12.0, minutes: float = 5.0) -> DataFrame:
    """Tracks of invented offenders (trial_id, mmsi, ts, lon, lat, sog, cog): each passes its discharge point on time,
    slows down there and keeps silent for gap_min about it.

    trials: (trial_id, lon, lat, at_us, cog, sog, gap_min).
    """
    n = int(hours * 60 / minutes)
    f = trials.withColumn("k", F.explode(F.sequence(F.lit(-n // 2), F.lit(n // 2))))
    f = f.where((F.abs(F.col("k")) * minutes > F.col("gap_min") / 2) | (F.col("k") == 0))
    km = F.col("k") * minutes / 60 * F.col("sog") * 1.852
    return f.select(
        "trial_id", F.concat(F.lit("2990"), F.lpad(F.col("trial_id").cast("string"), 5, "0")).alias("mmsi"), F.timestamp_micros(F.col("at_us") + (F.col("k") * minutes * 60e6).cast("long")).alias("ts"),
        (F.col("lon") + km * F.sin(F.radians("cog")) / (KM_PER_DEG * F.cos(F.radians("lat")))).alias("lon"), (F.col("lat") + km * F.cos(F.radians("cog")) / KM_PER_DEG).alias("lat"),
        F.when(F.abs(F.col("k")) <= 2, F.col("sog") * 0.4).otherwise(F.col("sog")).alias("sog"), "cog",
    )


def radar_scene(spark: SparkSession, scene_id: str, rows: int, cols: int, slick: tuple[float, float, float, float, float] | None = None, ships: tuple[tuple[int, int], ...] = (), depth_db: float = 8.0, noise_db: float = 1.0, seed: int = 0) -> DataFrame:
    """A sea of noise with a dark ellipse (r, c, semi_r, semi_c, turn) and bright squares; gt marks the ellipse."""
    p = spark.range(rows * cols).select(F.lit(scene_id).alias("scene_id"), F.floor(F.col("id") / cols).cast("int").alias("r"), F.pmod("id", F.lit(cols)).cast("int").alias("c"), "id")
    u1, u2 = F.greatest(uniform("id", seed=seed), F.lit(1e-12)), uniform("id", seed=seed + 1)
    db = F.lit(-18.0) + noise_db * F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
    inside = F.lit(False)
    if slick:
        r0, c0, a, b, turn = slick
        s, k = math.sin(turn), math.cos(turn)
        y, x = F.col("r") - r0, F.col("c") - c0
        inside = F.pow((y * k + x * s) / a, F.lit(2.0)) + F.pow((x * k - y * s) / b, F.lit(2.0)) <= 1
    bright = F.lit(False)
    for r0, c0 in ships:
        bright = bright | (F.col("r").between(r0 - 1, r0 + 1) & F.col("c").between(c0 - 1, c0 + 1))
    return p.select("scene_id", "r", "c", F.when(bright, 5.0).otherwise(db - F.when(inside, depth_db).otherwise(0.0)).alias("db"), inside.cast("int").alias("gt"))
