"""Closed-form age rules: spreading, shear, diffusion, weathering and the choice between hypotheses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RHO_WATER, GRAVITY, NU_WATER = 1025.0, 9.81, 1.05e-6
K_RANGE, RHO_OIL_RANGE = (1.1, 1.5), (850.0, 950.0)
MOST_H, BAND, WIDE_BAND = 72.0, 0.35, 0.55
WIND_LO, WIND_HI, GRADIENT_DB = 3.0, 10.0, 2.0


def okubo_diffusivity(length_m: Column) -> Column:
    """Horizontal diffusivity in m2/s at a length scale in metres."""
    return F.lit(0.0103) * F.pow(length_m * 100, F.lit(1.15)) * 1e-4


def fay_radius_km(hours: Column, volume_m3: Column, k: Column, rho_oil: Column) -> Column:
    """Radius under gravity-viscous spreading, which grows with the fourth root of time; 0 outside its domain."""
    delta = (RHO_WATER - rho_oil) / RHO_WATER
    c = F.pow(delta * GRAVITY * volume_m3 * volume_m3 / math.sqrt(NU_WATER), F.lit(1 / 6))
    return F.when((delta > 0) & (volume_m3 > 0) & (hours > 0), k * c * F.pow(hours * 3600, F.lit(0.25)) / 1000).otherwise(0.0)


def fay_band(slicks: DataFrame) -> DataFrame:
    """(case_id, lo_h, hi_h, regime): slicks (case_id, area_km2, volume_m3) inverted over four corners of assumptions.

    No band without a reported volume, nor where spreading can't reach the area within 72 hours.
    """
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(r).alias("rho")) for k in K_RANGE for r in RHO_OIL_RANGE)))
    c = slicks.select("*", corner.alias("c")).withColumn("k", F.col("c.k")).withColumn("rho", F.col("c.rho"))
    reach = math.pi * F.pow(fay_radius_km(F.lit(MOST_H), F.col("volume_m3"), F.col("k"), F.col("rho")), F.lit(2.0))
    unit = F.nullif(fay_radius_km(F.lit(1 / 3600), F.col("volume_m3"), F.col("k"), F.col("rho")), F.lit(0.0))
    hours = F.pow(F.sqrt(F.col("area_km2") / math.pi) / unit, F.lit(4.0)) / 3600
    a = c.groupBy("case_id").agg(F.max(reach).alias("reach"), F.min(hours).alias("lo"), F.max(hours).alias("hi"), F.first("area_km2").alias("area"), F.first("volume_m3").alias("v"))
    regime = F.when(F.col("v").isNull() | (F.col("v") <= 0), "no volume").when(F.col("area") > F.col("reach"), "shear_dominated").otherwise("gravity_viscous")
    hi = F.least("hi", F.lit(MOST_H))
    ok = (regime == "gravity_viscous") & (F.col("lo") < hi)
    return a.select("case_id", F.when(ok, F.col("lo")).alias("lo_h"), F.when(ok, hi).alias("hi_h"), regime.alias("regime"))


def age_gate(discharge: Column) -> Column:
    """refuse for a source under way, allow for a point release, allow_widened where the shape doesn't tell."""
    return F.when(discharge == "chronic", "refuse").when(discharge == "acute", "allow").otherwise("allow_widened")


def elongation_band(elongation: Column, shear_s: Column, discharge: Column) -> tuple[Column, Column]:
    """(lo_h, hi_h) of a patch stretched by simple shear; null where no age can be read."""
    a = F.when(elongation > 1, elongation)
    # greatest() skips nulls, so the guard comes first
    hours = F.when(a.isNotNull(), F.sqrt(F.greatest(a + 1 / a - 2, F.lit(0.0)))) / F.when(shear_s > 0, shear_s) / 3600
    gate = age_gate(discharge)
    share = F.when(gate == "allow_widened", WIDE_BAND).otherwise(BAND)
    lo = hours * (1 - share)
    ok = (gate != "refuse") & (lo < MOST_H)
    return F.when(ok, F.greatest(lo, F.lit(0.0))), F.when(ok, F.least(hours * (1 + share), F.lit(MOST_H)))


def deformation_rate(east: tuple[Column, Column], west: tuple[Column, Column], north: tuple[Column, Column], south: tuple[Column, Column], dx_m: Column, dy_m: Column) -> Column:
    """Strain rate per second from the velocities (u, v) at four neighbours, dx and dy apart."""
    ux, vx = (east[0] - west[0]) / dx_m, (east[1] - west[1]) / dx_m
    uy, vy = (north[0] - south[0]) / dy_m, (north[1] - south[1]) / dy_m
    return F.hypot(ux - vy, vx + uy)


def weathering(wind_ms: Column, centre_db: Column, edge_db: Column) -> Column:
    """fresh or weathered by the contrast from centre to edge, in winds that let it be read; else unknown."""
    readable = wind_ms.between(WIND_LO, WIND_HI) & centre_db.isNotNull() & edge_db.isNotNull()
    return F.when(readable, F.when(F.abs(centre_db - edge_db) >= GRADIENT_DB, "fresh").otherwise("weathered")).otherwise("unknown")


def detectability(surface_share: Column) -> Column:
    """Likelihood that oil with this share still afloat is seen: 0 up to 5 percent, 1 from 30."""
    return F.when(surface_share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (surface_share - 0.05) / 0.25)))


def choose_hypothesis(patch_gain: Column, track_gain: Column, least: float = 0.10) -> Column:
    """Which account of the shape the evidence supports: patch, track, both or none."""
    p, t = F.coalesce(patch_gain, F.lit(0.0)) >= least, F.coalesce(track_gain, F.lit(0.0)) >= least
    return F.when(p & t, "both").when(p, "patch").when(t, "track").otherwise("none")


def shape_likelihood(members: DataFrame, ln_length: float, ln_width: float, axis_deg: float, sd_length: float = 0.35, sd_width: float = 0.45, kappa: float = 2.0) -> DataFrame:
    """(case_id, hours, lik): mean over members of how well their length, width and bearing fit the slick's."""
    z1, z2 = (F.col("ln_length") - ln_length) / sd_length, (F.col("ln_width") - ln_width) / sd_width
    turn = kappa * (F.cos(2 * F.radians(F.col("axis_deg") - axis_deg)) - 1)
    return members.groupBy("case_id", "hours").agg(F.avg(F.exp(-0.5 * (z1 * z1 + z2 * z2) + turn)).alias("lik"))


def monotone_until(curve: DataFrame, keys: list[str], target: float, slack: float = 0.02) -> DataFrame:
    """(keys, crossing, monotone): first step at which a curve (keys, k, v) reaches a target, and whether it rose until then."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("k")
    c = curve.withColumn("before", F.lag("v").over(w))
    first = c.groupBy(*keys).agg(F.min(F.when(F.col("v") >= target, F.col("k"))).alias("crossing"))
    fell = c.join(first, keys).where(F.col("before").isNotNull() & (F.col("k") <= F.coalesce("crossing", F.lit(2**31 - 1))))
    bad = fell.groupBy(*keys).agg(F.bool_and(F.col("v") >= F.col("before") - slack * F.abs("before")).alias("monotone"))
    return first.join(bad, keys, "left").withColumn("monotone", F.coalesce("monotone", F.lit(True)))


def invert_curve(curve: DataFrame, keys: list[str], target: float) -> DataFrame:
    """(keys, at): where a curve (keys, k, v) first reaches a target, linear between its points; null where it never does."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("k")
    c = curve.withColumn("k0", F.lag("k").over(w)).withColumn("v0", F.lag("v").over(w))
    at = F.when(F.col("v0") < target, F.col("k0") + (F.lit(target) - F.col("v0")) / (F.col("v") - F.col("v0")) * (F.col("k") - F.col("k0")))
    return c.groupBy(*keys).agg(F.min(F.when(F.col("v") >= target, F.struct("k", at.alias("at"))))["at"].alias("at"))


def calibration_search(scores: DataFrame, keys: list[str], goal: float = 0.8, penalty: float = 5.0) -> DataFrame:
    """The setting whose mean log score, less a penalty for missing the coverage goal, is best.

    scores: (keys of a setting, twin_id, log_score, covered).
    """
    s = scores.groupBy(*keys).agg(F.avg("log_score").alias("log_score"), F.avg(F.col("covered").cast("double")).alias("coverage"))
    s = s.withColumn("objective", F.col("log_score") - penalty * F.abs(F.col("coverage") - goal))
    return s.orderBy(F.desc("objective"), *keys).limit(1)
