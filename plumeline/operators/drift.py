"""Lagrangian drift: midpoint integration of particles through vector fields, and ensembles.

Only the time loop is imperative: it runs in NumPy, one ensemble member a group. What goes in and
what comes out are rows, and pooling, radii and windows are DataFrame plans.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_quantile

# Fixed values.
M_PER_DEG, WIND_SHARE, MAX_SPEED = 111320.0, 0.03, 3.0
WIND_RANGE, CURRENT_SD, LEAST_SCALE, JITTER_M = (0.025, 0.035), 0.15, 0.05, 300.0
DIP, LEAST_PROB, ABSTAIN_KM = 0.90, 1e-4, 40.0
MEMBER = "case_id string, member int, step int, pid int, lon double, lat double, stranded boolean"

Field = Callable[[np.ndarray, np.ndarray, float], tuple[np.ndarray, np.ndarray]]


def constant_field(u: float, v: float) -> Field:
    return lambda lon, lat, t: (np.full(len(lon), u), np.full(len(lon), v))


def vortex_field(lon0: float, lat0: float, size_deg: float, speed: float) -> Field:
    """Cells of closed circulation without divergence."""
    def at(lon: np.ndarray, lat: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.pi * (lon - lon0) / size_deg, np.pi * (lat - lat0) / size_deg
        return speed * np.sin(x) * np.cos(y), -speed * np.cos(x) * np.sin(y)
    return at


def shear_field(rate: float, lat0: float) -> Field:
    """Eastward flow that grows northward at a rate per second."""
    return lambda lon, lat, t: (rate * (lat - lat0) * M_PER_DEG, np.zeros(len(lon)))


class Gridded:
    """Bilinear in space, linear in time, held at the edges; corners on land give the mean of the wet ones."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.t, self.y, self.x = (np.sort(rows[c].unique()).astype(float) for c in ("t_epoch", "lat", "lon"))
        place = tuple(np.searchsorted(a, rows[c]) for a, c in ((self.t, "t_epoch"), (self.y, "lat"), (self.x, "lon")))
        self.uv = np.full((2, len(self.t), len(self.y), len(self.x)), np.nan)
        for k, c in enumerate("uv"):
            self.uv[k][place] = rows[c].to_numpy(float)

    @staticmethod
    def _bracket(axis: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(at, axis[0], axis[-1])
        hi = np.clip(np.searchsorted(axis, at, "right"), 1, max(len(axis) - 1, 1))
        lo = hi - 1
        hi = np.minimum(hi, len(axis) - 1)
        return lo, hi, np.where(hi > lo, (at - axis[lo]) / np.where(hi > lo, axis[hi] - axis[lo], 1), 0.0)

    def __call__(self, lon: np.ndarray, lat: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        t0, t1, ft = self._bracket(self.t, np.full(len(lon), t))
        y0, y1, fy = self._bracket(self.y, lat)
        x0, x1, fx = self._bracket(self.x, lon)
        out = []
        for grid in self.uv:
            slabs = []
            for k in (t0, t1):
                corners = np.stack([grid[k, y0, x0], grid[k, y0, x1], grid[k, y1, x0], grid[k, y1, x1]])
                share = np.stack([(1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx])
                wet = ~np.isnan(corners)
                n = wet.sum(axis=0)
                mean = np.where(n > 0, np.where(wet, corners, 0).sum(axis=0) / np.maximum(n, 1), 0.0)
                slabs.append(np.where(n == 4, (np.where(wet, corners, 0) * share).sum(axis=0), mean))
            out.append(slabs[0] + ft * (slabs[1] - slabs[0]))
        return out[0], out[1]


def velocity(lon: np.ndarray, lat: np.ndarray, t: float, current: Field, wind: Field, share: float = WIND_SHARE, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    (cu, cv), (wu, wv) = current(lon, lat, t), wind(lon, lat, t)
    return scale * cu + share * wu, scale * cv + share * wv


def step(lon: np.ndarray, lat: np.ndarray, t: float, dt: float, move: Callable) -> tuple[np.ndarray, np.ndarray]:
    """One midpoint step of dt seconds, backward where dt is negative."""
    def shift(u: np.ndarray, v: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray]:
        wide = M_PER_DEG * np.maximum(np.cos(np.radians(lat)), 1e-6)
        return (lon + u * s / wide + 180) % 360 - 180, lat + v * s / M_PER_DEG
    mid = shift(*move(lon, lat, t), dt / 2)
    return shift(*move(*mid, t + dt / 2), dt)


def integrate(lon: np.ndarray, lat: np.ndarray, t0: float, dt: float, n_steps: int, move: Callable, is_land: Callable | None = None, kept: set[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and stranding at n_steps instants, the first being the start; the run lasts n_steps - 1 steps.

    A particle that would come ashore stays at its last wet place for good. With `kept`, only these instants are held and returned, in order.
    """
    now = (lon, lat, is_land(lon, lat) if is_land else np.zeros(len(lon), bool))
    told = [now] if kept is None or 0 in kept else []
    for k in range(n_steps - 1):
        x, y = step(now[0], now[1], t0 + k * dt, dt, move)
        land = now[2] | (is_land(x, y) if is_land else False)
        now = (np.where(land, now[0], x), np.where(land, now[1], y), land)
        if kept is None or k + 1 in kept:
            told.append(now)
    xs, ys, ashore = (np.stack(v) for v in zip(*told, strict=True))
    return xs, ys, ashore


def member_draws(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(member, wind_share, current_scale): one draw from each of n equal strata, shuffled independently by hash."""
    base = spark.range(n).select(F.col("id").cast("int").alias("member"))
    def place(salt: int) -> Column:
        return F.row_number().over(Window.orderBy(F.xxhash64("member", F.lit(seed), F.lit(salt)))) - 1
    def inside(salt: int) -> Column:
        return F.pmod(F.xxhash64("member", F.lit(seed), F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    lo, hi = WIND_RANGE
    a, b = (place(1) + inside(2)) / n, F.greatest(F.least((place(3) + inside(4)) / n, F.lit(1 - 1e-9)), F.lit(1e-9))
    return base.select("member", (lo + (hi - lo) * a).alias("wind_share"), b.alias("_q")).withColumn("current_scale", F.greatest(1 + CURRENT_SD * normal_quantile("_q"), F.lit(LEAST_SCALE))).drop("_q")


def log_uniform_draws(spark: SparkSession, n: int, lo: float, hi: float, seed: int = 0) -> DataFrame:
    """(k, value): one draw from each of n equal strata of the logarithm."""
    inside = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return spark.range(n).select(F.col("id").alias("k"), F.exp(F.log(F.lit(lo)) + (F.col("id") + inside) / n * (F.log(F.lit(hi)) - F.log(F.lit(lo)))).alias("value"))


def run_ensemble(seeds: DataFrame, members: DataFrame, current: Field, wind: Field, t0: float, minutes: float, n_steps: int, steps: list[int] | None = None, keep: int | None = None, jitter_m: float = 0.0, is_land: Callable | None = None, seed: int = 0) -> DataFrame:
    """Backward particles (case_id, member, step, pid, lon, lat, stranded).

    seeds: (case_id, pid, lon, lat); members: (member, wind_share, current_scale). Members run in
    parallel, a group for each case and member. Last positions of all particles are returned, and at
    the requested steps those of the first `keep`.
    """
    wanted = set(steps or [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        lon, lat = pdf["lon"].to_numpy(float), pdf["lat"].to_numpy(float)
        share, scale = float(pdf["wind_share"].iloc[0]), float(pdf["current_scale"].iloc[0])
        if jitter_m:
            rng = np.random.default_rng([seed, int(pdf["member"].iloc[0])])
            lat = lat + rng.normal(scale=jitter_m, size=len(lat)) / M_PER_DEG
            lon = lon + rng.normal(scale=jitter_m, size=len(lon)) / (M_PER_DEG * np.cos(np.radians(lat)))
        move = lambda x, y, t: velocity(x, y, t, current, wind, share, scale)
        told = sorted(k for k in wanted | {n_steps - 1} if 0 <= k < n_steps)
        xs, ys, ashore = integrate(lon, lat, t0, -minutes * 60, n_steps, move, is_land, set(told))
        out = []
        for j, k in enumerate(told):
            few = slice(None) if k == n_steps - 1 or keep is None else slice(keep)
            out.append(pd.DataFrame({"case_id": pdf["case_id"].iloc[0], "member": int(pdf["member"].iloc[0]), "step": k, "pid": pdf["pid"].to_numpy()[few], "lon": xs[j][few], "lat": ys[j][few], "stranded": ashore[j][few]}))
        return pd.concat(out)

    return seeds.crossJoin(F.broadcast(members)).groupBy("case_id", "member").applyInPandas(run, MEMBER)


def pool_by_age(frames: DataFrame, posterior: DataFrame, minutes: float, band: tuple[float, float] | None = None) -> DataFrame:
    """frames with weight w: an age's probability spread over its frame's points, weights of a case summing to one."""
    kept = posterior.where(F.col("p") >= LEAST_PROB)
    if band:
        kept = kept.where(F.col("age_h").between(band[0] - 1e-9, band[1] + 1e-9))
    kept = kept.select("case_id", F.bround(F.col("age_h") * 60 / minutes, 0).cast("int").alias("step"), F.col("p").alias("_p"))
    n = frames.groupBy("case_id", "step").agg(F.count("*").alias("_n"))
    mass = kept.join(n, ["case_id", "step"])
    total = mass.groupBy("case_id").agg(F.sum("_p").alias("_t"))
    each = mass.join(total, "case_id").groupBy("case_id", "step").agg((F.sum(F.col("_p") / F.col("_t")) / F.first("_n")).alias("w"))
    return frames.join(each, ["case_id", "step"])


def pool_models(clouds: DataFrame) -> DataFrame:
    """(…, w): clouds of several models of a case, each model with the same total weight."""
    per = clouds.groupBy(F.col("case_id").alias("_c"), F.col("model").alias("_m")).agg(F.count("*").alias("_n"))
    each = per.select("_c", "_m", (1 / (F.col("_n") * F.count("_m").over(Window.partitionBy("_c")))).alias("w"))
    same = F.col("case_id").eqNullSafe(F.col("_c")) & F.col("model").eqNullSafe(F.col("_m"))
    return clouds.join(F.broadcast(each), same).select(*(c for c in clouds.columns if c != "w"), "w")


def time_window(members: DataFrame, minutes: float, n_steps: int, bands: DataFrame | None = None) -> DataFrame:
    """(case_id, hours_back_from, hours_back_to, method): when the release took place.

    members: (case_id, member, step, spread_km). A measured age band comes first; else the tightest
    steps' 10th to 90th percentile, if members tighten to 0.9 of their start well inside the run;
    else the last two thirds of the run.
    """
    least = members.groupBy("case_id", "member").agg(F.min_by("step", F.struct("spread_km", "step")).alias("k"), F.min("spread_km").alias("lo"), F.min_by("spread_km", "step").alias("start"))
    s = least.groupBy("case_id").agg(F.median(F.col("lo") / F.greatest("start", F.lit(1e-9))).alias("ratio"), F.median("k").alias("med"), F.percentile("k", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    narrow = hi - lo < 1
    lo, hi = F.when(narrow, F.greatest(lo - 1, F.lit(0.0))).otherwise(lo), F.when(narrow, F.least(hi + 1, F.lit(float(n_steps - 1)))).otherwise(hi)
    span = (n_steps - 1) * minutes / 60.0
    real = (F.col("ratio") <= DIP) & (F.col("med") > 1) & (F.col("med") < n_steps - 2) & (hi > lo)
    if bands is not None:
        s = s.join(bands.select("case_id", F.col("lo_h").alias("b0"), F.col("hi_h").alias("b1")), "case_id", "left")
    else:
        s = s.withColumn("b0", F.lit(None).cast("double")).withColumn("b1", F.lit(None).cast("double"))
    b0 = F.greatest("b0", F.lit(0.0))
    b1 = F.greatest(F.least("b1", F.lit(span)), b0 + minutes / 60.0)
    aged = F.col("b0").isNotNull() & F.col("b1").isNotNull()
    return s.select(
        "case_id", F.when(aged, b1).when(real, hi * minutes / 60.0).otherwise(span).alias("hours_back_from"), F.when(aged, b0).when(real, lo * minutes / 60.0).otherwise(span / 3).alias("hours_back_to"),
        F.when(aged, "age").when(real, "convergence").otherwise("bounded").alias("method"),
    )


def run_guards(particles: DataFrame, minutes: float) -> DataFrame:
    """(case_id, guard, value, ok): displacement between 5 km in 48 h and 3 m/s throughout."""
    from ..functions.geo import displacement_km

    w = Window.partitionBy("case_id", "member", "pid").orderBy("step")
    ends = particles.groupBy("case_id", "member", "pid").agg(F.min_by(F.struct("lon", "lat"), "step").alias("a"), F.max_by(F.struct("lon", "lat"), "step").alias("b"), (F.max("step") - F.min("step")).alias("n"))
    km = ends.withColumn("km", displacement_km(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))).groupBy("case_id").agg(F.median("km").alias("value"), F.max("n").alias("n"))
    hours = F.col("n") * minutes / 60.0
    moved = km.select("case_id", F.lit("displacement_km").alias("guard"), "value", F.col("value").between(5.0 / 48 * hours, MAX_SPEED * 3.6 * hours).alias("ok"))
    hop = particles.withColumn("px", F.lag("lon").over(w)).withColumn("py", F.lag("lat").over(w)).withColumn("dn", F.col("step") - F.lag("step").over(w)).where("px is not null")
    fast = hop.withColumn("ms", displacement_km("px", "py", "lon", "lat") * 1000 / (F.col("dn") * minutes * 60)).groupBy("case_id").agg(F.max("ms").alias("value"))
    return moved.union(fast.select("case_id", F.lit("max_speed_ms").alias("guard"), "value", (F.col("value") <= MAX_SPEED * 1.0001).alias("ok")))


def sticky_stranding(particles: DataFrame, is_land: Column) -> DataFrame:
    """stranded and frozen positions for particles that were moved on without regard to land."""
    w = Window.partitionBy("case_id", "member", "pid").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    df = particles.withColumn("stranded", F.max(is_land).over(w))
    last = F.last(F.when(~F.col("stranded"), F.struct("lon", "lat")), ignorenulls=True).over(w)
    keep = F.coalesce(last, F.struct("lon", "lat"))
    return df.withColumn("_p", keep).withColumn("lon", F.col("_p.lon")).withColumn("lat", F.col("_p.lat")).drop("_p")


def landfall(particles: DataFrame, minutes: float) -> DataFrame:
    """One row for each case: share ashore, first landfall in hours, its box and centre; null where nothing came ashore."""
    first = particles.where("stranded").groupBy("case_id", "member", "pid").agg(F.min("step").alias("step"), F.min_by(F.struct("lon", "lat"), "step").alias("at"))
    total = particles.select("case_id", "member", "pid").distinct().groupBy("case_id").agg(F.count("*").alias("n"))
    hit = first.groupBy("case_id").agg(
        F.count("*").alias("n_ashore"), (F.min("step") * minutes / 60.0).alias("first_h"), F.min("at.lon").alias("west"), F.max("at.lon").alias("east"), F.min("at.lat").alias("south"), F.max("at.lat").alias("north"),
        F.avg("at.lon").alias("lon"), F.avg("at.lat").alias("lat"),
    )
    return total.join(hit, "case_id", "left").withColumn("stranded_fraction", F.coalesce("n_ashore", F.lit(0)) / F.col("n"))


def stranding_curve(particles: DataFrame, minutes: float, every_h: float = 3.0) -> DataFrame:
    """(case_id, hour, fraction): share ashore by then, every few hours of the run."""
    k = int(every_h * 60 / minutes)
    return particles.where(F.col("step") % k == 0).groupBy("case_id", (F.col("step") * minutes / 60.0).alias("hour")).agg(F.avg(F.col("stranded").cast("double")).alias("fraction"))


def wind_share_of_drift(samples: DataFrame) -> DataFrame:
    """(case_id, wind_share): mean windage speed over mean current and windage speed; null for synthetic fields."""
    s = samples.groupBy("case_id").agg(F.avg(F.hypot("cu", "cv")).alias("c"), F.avg(F.hypot("wu", "wv") * WIND_SHARE).alias("w"), F.bool_or("synthetic").alias("s"))
    return s.select("case_id", F.when(~F.col("s"), F.col("w") / F.nullif(F.col("c") + F.col("w"), F.lit(0.0))).alias("wind_share"))
