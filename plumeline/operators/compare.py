"""Comparisons between models, forward impact, growth of uncertainty and calibration of posteriors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import displacement_km
from .grid import radii


def separation(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, separation_km, r90_ratio) of two models' clouds."""
    x = radii(a, keys).select(*keys, F.col("clon").alias("x1"), F.col("clat").alias("y1"), F.col("r90_km").alias("r1"))
    y = radii(b, keys).select(*keys, F.col("clon").alias("x2"), F.col("clat").alias("y2"), F.col("r90_km").alias("r2"))
    return x.join(y, keys).select(*keys, displacement_km("x1", "y1", "x2", "y2").alias("separation_km"), (F.col("r2") / F.nullif("r1", F.lit(0.0))).alias("r90_ratio"))


def paired_separation(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(step, mean_km, max_km) between the same particles of two models."""
    y = b.select(*keys, F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    d = a.join(y, keys).withColumn("km", displacement_km("lon", "lat", "lon2", "lat2"))
    return d.groupBy("step").agg(F.avg("km").alias("mean_km"), F.max("km").alias("max_km"))


def match_particles(a: DataFrame, b: DataFrame, limit_m: float = 1.0) -> DataFrame:
    """(case_id, pid, pid2, residual_m): the closest pairs first, each particle once; an incomplete or loose match is an error.

    Which pair is taken depends on those before, so a case is matched in one group; ids that both
    models carry need no matching. Only pairs within the limit can stand in a match that is no error,
    so particles meet by cells of its size, never all with all.
    """

    def one(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        wide = 111320.0 * np.cos(np.radians(pd.concat([x["lat"], y["lat"]]).mean()))
        to = lambda d: np.stack([d["lon"] * wide, d["lat"] * 111320.0], axis=1)
        side = limit_m or 1.0
        near = []
        for d in (to(x), to(y)):
            cell = np.floor(d / side).astype("int64")
            near.append(pd.DataFrame({"n": np.arange(len(d)), "east": d[:, 0], "north": d[:, 1], "cx": cell[:, 0], "cy": cell[:, 1]}))
        around = pd.concat([near[1].assign(cx=near[1]["cx"] + dx, cy=near[1]["cy"] + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        met = near[0].merge(around, on=["cx", "cy"])
        met["gap"] = np.hypot(met["east_x"] - met["east_y"], met["north_x"] - met["north_y"])
        left, right, rows = set(range(len(x))), set(range(len(y))), []
        for i, j, gap in met[met["gap"] <= limit_m].sort_values(["gap", "n_x", "n_y"])[["n_x", "n_y", "gap"]].itertuples(index=False):
            if i in left and j in right:
                rows.append((x["case_id"].iloc[0], x["pid"].iloc[i], y["pid"].iloc[j], gap))
                left.remove(i)
                right.remove(j)
        if left or right:
            raise ValueError("particles of the two models are not the same set")
        return pd.DataFrame(rows, columns=["case_id", "pid", "pid2", "residual_m"])

    # fresh columns: two tables made from one share theirs, which a cogroup would confuse
    a, b = (d.select(*(F.col(c).alias(c) for c in ("case_id", "pid", "lon", "lat"))) for d in (a, b))
    return a.groupBy("case_id").cogroup(b.groupBy("case_id")).applyInPandas(one, "case_id string, pid int, pid2 int, residual_m double")


def growth(particles: DataFrame, minutes: float) -> DataFrame:
    """(case_id, hours_back, r50_km, r90_km) of the cloud at each step."""
    r = radii(particles, ["case_id", "step"])
    return r.select("case_id", (F.col("step") * minutes / 60.0).alias("hours_back"), "r50_km", "r90_km")


def forward_impact(heads: DataFrame, landfall: DataFrame) -> DataFrame:
    """Where the oil went: radii, centroid and share ashore; landfall fields are null where nothing came ashore."""
    here = F.col("stranded_fraction") > 0
    j = heads.join(landfall, "case_id", "left")
    return j.select("case_id", "hours", "radius_50_km", "radius_90_km", F.coalesce("stranded_fraction", F.lit(0.0)).alias("stranded_fraction"), F.when(here, F.col("first_h")).alias("landfall_h"), F.when(here, F.bround("lon", 5)).alias("landfall_lon"), F.when(here, F.bround("lat", 5)).alias("landfall_lat"))


def required_pad_deg(speed_ms: Column, hours: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude by which a field must reach beyond a scene, at its most poleward edge."""
    km = F.greatest(F.lit(55.0), 1.3 * 3.6 * speed_ms * hours)
    return km / (111.32 * F.greatest(F.cos(F.radians(F.abs(lat))), F.lit(0.01))), km / 111.32


def calibration(twins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, answered, coverage, mean_width_h, mean_log_score, pit_spread): how posteriors of known ages did.

    twins: (keys, twin_id, truth_h, lo_h, hi_h, p_truth, pit), null bounds where no age was given.
    """
    ok = F.col("lo_h").isNotNull()
    inside = F.col("truth_h").between(F.col("lo_h"), F.col("hi_h"))
    return twins.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("answered"), F.avg(F.when(ok, inside.cast("double"))).alias("coverage"), F.avg(F.col("hi_h") - F.col("lo_h")).alias("mean_width_h"),
        F.avg(F.when(ok, F.log(F.greatest("p_truth", F.lit(1e-12))))).alias("mean_log_score"), F.avg(F.when(ok, F.abs(F.col("pit") - 0.5))).alias("pit_spread"),
    )


def leave_one_out(twins: DataFrame, field: str = "field") -> DataFrame:
    """twins once for each field, without that field's own, keyed by `without`."""
    fields = twins.select(F.col(field).alias("without")).distinct()
    return twins.join(fields, F.col(field) != F.col("without"))


def release_points(particles: DataFrame, ages: DataFrame, minutes: float) -> DataFrame:
    """(case_id, age_h, lon, lat): the middle of the cloud at each candidate age."""
    k = ages.select("case_id", "age_h", F.bround(F.col("age_h") * 60 / minutes, 0).cast("int").alias("step"))
    return particles.join(k, ["case_id", "step"]).groupBy("case_id", "age_h").agg(F.median("lon").alias("lon"), F.median("lat").alias("lat"))


def field_coverage(field: DataFrame) -> DataFrame:
    """(case_id, t_lo, t_hi): the time that all kinds of field cover."""
    k = field.groupBy("case_id", "kind").agg(F.min("t_epoch").alias("a"), F.max("t_epoch").alias("b"))
    return k.groupBy("case_id").agg(F.max("a").alias("t_lo"), F.min("b").alias("t_hi"))
