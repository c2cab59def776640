"""Age evidence from shape: dispersion of simulated clouds, width of tracks, contrast inside a slick."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_quantile
from .age import invert_curve, okubo_diffusivity
from .drift import M_PER_DEG, step, velocity
from .image import dense, distance_to, label_components
from .synth import uniform

# Ranges that a track's width is read with.
WAKE_SIGMA_M, WIDTH_PER_SIGMA, WIDTH_ERROR_M, OKUBO_SPREAD, LEAST_ASPECT, END_SHARE = (10.0, 40.0), (2.5, 4.0), 40.0, 3.0, 3.0, 0.10
CURVE = "case_id string, member int, hours double, length_km double, width_km double, axis_deg double"


def dispersion_curves(seeds: DataFrame, members: DataFrame, current: Callable, wind: Callable, hours: list[float], minutes: float, seed: int = 0) -> DataFrame:
    """(case_id, member, hours, length_km, width_km, axis_deg) of clouds that a flow shears and turbulence spreads.

    seeds: (case_id, pid, lon, lat); members: (member, wind_share, current_scale, k_m2s). Clouds run
    forward, a case and member to a group; length and width are four standard deviations.
    """
    wanted = {round(h * 60 / minutes): h for h in hours}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lon, lat = pdf["lon"].to_numpy(float), pdf["lat"].to_numpy(float)
        share, scale, k = (float(pdf[c].iloc[0]) for c in ("wind_share", "current_scale", "k_m2s"))
        rng = np.random.default_rng([seed, int(pdf["member"].iloc[0])])
        move = lambda x, y, t: velocity(x, y, t, current, wind, share, scale)
        dt, out = minutes * 60, []
        for n in range(max(wanted) + 1):
            if n in wanted:
                xy = np.stack([(lon - lon.mean()) * M_PER_DEG * np.cos(np.radians(lat.mean())), (lat - lat.mean()) * M_PER_DEG]) / 1000
                values, axes = np.linalg.eigh(np.cov(xy))
                sd = np.sqrt(np.maximum(values, 0))
                out.append((pdf["case_id"].iloc[0], int(pdf["member"].iloc[0]), wanted[n], 4 * sd[1], 4 * sd[0], math.degrees(math.atan2(axes[0, 1], axes[1, 1])) % 180))
            lon, lat = step(lon, lat, n * dt, dt, move)
            walk = rng.normal(scale=math.sqrt(2 * k * dt), size=(2, len(lon)))
            lon, lat = lon + walk[0] / (M_PER_DEG * np.cos(np.radians(lat))), lat + walk[1] / M_PER_DEG
        return pd.DataFrame(out, columns=[c.split()[0] for c in CURVE.split(", ")])

    return seeds.crossJoin(F.broadcast(members)).groupBy("case_id", "member").applyInPandas(run, CURVE)


def length_ages(curves: DataFrame, observed_km: float) -> DataFrame:
    """(case_id, member, age_h, censored): when each member first is as long as the slick; 'old' where it never is."""
    c = curves.select("case_id", "member", F.col("hours").alias("k"), F.col("length_km").alias("v"))
    got = invert_curve(c, ["case_id", "member"], observed_km)
    first = c.groupBy("case_id", "member").agg(F.min_by("v", "k").alias("v0"), F.max("v").alias("v1"))
    return got.join(first, ["case_id", "member"]).select("case_id", "member", F.col("at").alias("age_h"), F.when(F.col("v0") >= observed_km, "young").when(F.col("v1") < observed_km, "old").alias("censored"))


def age_band(samples: DataFrame, keys: list[str], lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """(keys, lo_h, hi_h, n): percentiles of the members that gave an age."""
    p = F.percentile("age_h", F.array(F.lit(lo), F.lit(hi)))
    s = samples.where("age_h is not null").groupBy(*keys).agg(p.alias("p"), F.count("*").alias("n"))
    return s.select(*keys, F.col("p")[0].alias("lo_h"), F.col("p")[1].alias("hi_h"), "n")


def member_diffusivities(members: DataFrame, scale_m: float, seed: int = 0) -> DataFrame:
    """members with k_m2s: the diffusivity of the slick's size times a threefold lognormal scatter, stratified."""
    n = members.count()
    u = F.greatest(F.least((F.col("member") + uniform("member", seed=seed)) / n, F.lit(1 - 1e-9)), F.lit(1e-9))
    return members.withColumn("_u", u).withColumn("k_m2s", okubo_diffusivity(F.lit(float(scale_m))) * F.exp(math.log(OKUBO_SPREAD) * normal_quantile("_u"))).drop("_u")


def track_age_samples(tracks: DataFrame, draws: int = 4000, seed: int = 143) -> DataFrame:
    """(case_id, sample_h): ages of the widest end of track-shaped slicks (case_id, width_tail_m), by Monte Carlo.

    A wake spreads sideways as sigma^2 = sigma0^2 + 2 K t; width, its sigmas, the wake and K are drawn
    from stated ranges, by hashes of case and draw.
    """
    few = tracks.repartition(tracks.sparkSession.sparkContext.defaultParallelism)  # few bytes, much work: a small file would be one task
    t = few.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = lambda k: F.greatest(uniform("case_id", "draw", seed=seed + k), F.lit(1e-9))
    t = t.select("case_id", "width_tail_m", *(u(k).alias(f"u{k}") for k in range(5)))
    normal = lambda a, b: F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * F.col(b))
    w = F.greatest(F.col("width_tail_m") + WIDTH_ERROR_M * normal(F.col("u0"), "u1"), F.lit(1.0))
    span = lambda r, c: r[0] + (r[1] - r[0]) * F.col(c)
    t = t.withColumn("w", w).withColumn("s", F.col("w") / span(WIDTH_PER_SIGMA, "u2")).withColumn("s0", span(WAKE_SIGMA_M, "u3"))
    k = okubo_diffusivity(F.col("w")) * F.exp(math.log(OKUBO_SPREAD) * normal(F.col("u4"), "u2"))
    return t.select("case_id", ((F.col("s") * F.col("s") - F.col("s0") * F.col("s0")) / (2 * k) / 3600).alias("sample_h"))


PROFILE = "case_id string, width_tail_m double, width_head_m double, mean_width_m double, length_m double, aspect double"


def width_profile(pixels: DataFrame, pixel_m: float) -> DataFrame:
    """Widths along slicks (case_id, r, c), masks of one slick a case.

    The middle line is where the distance to the edge has a ridge; a place's width is twice that
    distance. It is no thinning, so its number of pixels differs a little from a skeleton's. Ends are
    the outer tenths of the long axis; the wider one is the tail.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((int(pdf["r"].max()) + 3, int(pdf["c"].max()) + 3), bool)
        mask[pdf["r"] + 1, pdf["c"] + 1] = True
        d = distance_to(~mask)
        ridge = mask.copy()
        for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
            ahead, back = (np.roll(d, (s * dr, s * dc), (0, 1)) for s in (1, -1))
            ridge &= (d >= ahead) | (d >= back)
        r, c = np.nonzero(ridge & (d >= 0.5 * d.max()))
        xy = np.stack([c, -r]).astype(float)
        _, axes = np.linalg.eigh(np.cov(np.stack(np.nonzero(mask))[::-1] * np.array([[1.0], [-1.0]])))
        along = axes[:, 1] @ xy
        width = 2 * d[r, c] * pixel_m
        span = np.ptp(along) or 1.0
        ends = [float(np.median(width[part])) for part in (along <= along.min() + END_SHARE * span, along >= along.max() - END_SHARE * span)]
        length = (span + 1) * pixel_m
        mean = mask.sum() * pixel_m**2 / length
        return pd.DataFrame([(str(pdf["case_id"].iloc[0]), max(ends), min(ends), mean, length, length / mean)], columns=[x.split()[0] for x in PROFILE.split(", ")])

    return pixels.groupBy("case_id").applyInPandas(one, PROFILE)


def track_widths(profiles: DataFrame, discharge: DataFrame) -> DataFrame:
    """Profiles that may be read as tracks: long for their width, and not known to be point releases."""
    return profiles.join(discharge, "case_id", "left").where((F.col("aspect") >= LEAST_ASPECT) & (F.coalesce("discharge_class", F.lit("unknown")) != "acute"))


CONTRAST = "scene_id string, centre_db double, edge_db double, sea_db double"


def centre_edge_contrast(pixels: DataFrame, ring_px: int = 3, least: int = 10) -> DataFrame:
    """(scene_id, centre_db, edge_db, sea_db) from pixels (scene_id, r, c, db, gt): medians over the surrounding sea's.

    Null where core, edge or sea have fewer than ten pixels.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        db, mask = dense(pdf), dense(pdf, "gt") > 0
        if not mask.any() or mask.all():
            return pd.DataFrame([(str(pdf["scene_id"].iloc[0]), None, None, None)], columns=[x.split()[0] for x in CONTRAST.split(", ")])
        deep, off = distance_to(~mask), distance_to(mask)
        valid = np.isfinite(db)
        parts = [mask & (deep > ring_px) & valid, mask & (deep <= ring_px) & valid, ~mask & (off <= 2 * ring_px) & valid]
        if min(int(p.sum()) for p in parts) < least:
            values = (None, None, None)
        else:
            core, edge, sea = (float(np.median(db[p])) for p in parts)
            values = (core - sea, edge - sea, sea)
        return pd.DataFrame([(str(pdf["scene_id"].iloc[0]), *values)], columns=[x.split()[0] for x in CONTRAST.split(", ")])

    return pixels.groupBy("scene_id").applyInPandas(one, CONTRAST)


def trace_outline(mask: np.ndarray) -> np.ndarray:
    """Corners (row, column) of the longest border of a mask, in order; the first is not repeated."""
    m = np.pad(mask, 1)
    ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in zip(*np.nonzero(m), strict=True):
        for inside, a, b in ((m[r - 1, c], (r, c), (r, c + 1)), (m[r, c + 1], (r, c + 1), (r + 1, c + 1)), (m[r + 1, c], (r + 1, c + 1), (r + 1, c)), (m[r, c - 1], (r + 1, c), (r, c))):
            if not inside:
                ahead.setdefault(a, []).append(b)
    best: list[tuple[int, int]] = []
    while ahead:
        at = next(iter(ahead))
        ring = []
        while at in ahead:
            ring.append(at)
            nxt = ahead[at].pop()
            if not ahead[at]:
                del ahead[at]
            at = nxt
        if len(ring) > len(best):
            best = ring
    pts = np.array(best) - 1 if best else np.zeros((0, 2), int)
    if len(pts):
        turn = np.any(np.diff(pts, axis=0, prepend=pts[-1:]) != np.diff(pts, axis=0, append=pts[:1]), axis=1)
        pts = pts[turn]
    return pts


OUTLINE = "case_id string, ring array<struct<lon:double,lat:double>>, area_px int"


def density_outline(cells: DataFrame, head: dict, threshold: float = 0.2) -> DataFrame:
    """(case_id, ring, area_px): the outline of a cloud's largest region with at least a share of its peak density.

    cells: (case_id, r, c, w), as histogram2d and blur make them.
    """
    rows, cols = head["rows"], head["cols"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros((rows, cols))
        w[pdf["r"], pdf["c"]] = pdf["w"]
        lab = label_components(w >= threshold * w.max())
        big = lab == 1 + int(np.argmax(np.bincount(lab.ravel())[1:]))
        ring = [{"lon": head["west"] + c * (head["east"] - head["west"]) / cols, "lat": head["north"] - r * (head["north"] - head["south"]) / rows} for r, c in trace_outline(big).tolist()]
        return pd.DataFrame({"case_id": [str(pdf["case_id"].iloc[0])], "ring": [ring], "area_px": [int(big.sum())]})

    return cells.where("w > 0").groupBy("case_id").applyInPandas(one, OUTLINE)


def horizon_frames(particles: DataFrame, bands: DataFrame, minutes: float, most: int = 120) -> DataFrame:
    """Frames up to a case's age horizon at the finest of 15, 30, 45 and 60 minutes that needs at most `most` of them.

    particles: (case_id, step, ...); bands: (case_id, hi_h), null for no measured age, which keeps the
    whole span and the coarsest cadence that divides it. Adds output_min; cadences that are no whole
    number of steps are passed over. Frames and cases meet by a sorted merge: Spark takes rows made by
    an explode for few, and would broadcast them.
    """
    last = particles.groupBy("case_id").agg(F.max("step").alias("last")).join(bands, "case_id", "left")
    span = F.col("last") * minutes / 60.0
    end = F.when((F.col("hi_h") > 0) & (F.col("hi_h") < span), F.ceil(F.col("hi_h") * 60 / minutes)).otherwise(F.col("last"))
    pick: Column = F.lit(None).cast("struct<every:bigint,stop:bigint>")
    for dt in (60, 45, 30, 15):
        if dt % minutes == 0:
            k = int(dt / minutes)
            up = F.ceil(end / k) * k
            stop = F.when(up > F.col("last"), F.floor(F.col("last") / k) * k).otherwise(up)
            pick = F.when(stop / k + 1 <= most, F.struct(F.lit(k).cast("bigint").alias("every"), stop.cast("bigint").alias("stop"))).otherwise(pick)
    chosen = last.select("case_id", F.coalesce(pick, F.struct(F.lit(1).cast("bigint").alias("every"), F.col("last").cast("bigint").alias("stop"))).alias("f"))
    return particles.join(chosen.hint("merge"), "case_id").where((F.col("step") <= F.col("f.stop")) & (F.col("step") % F.col("f.every") == 0)).withColumn("output_min", F.col("f.every") * minutes).drop("f")


def every_nth_frame(particles: DataFrame, stride: int) -> DataFrame:
    """Every stride-th step; a case whose span the stride does not divide is an error, since it would change the span."""
    last = particles.groupBy("case_id").agg(F.max("step").alias("_last"))
    fits = F.when(F.col("_last") % stride == 0, F.col("step") % stride == 0).otherwise(F.raise_error(F.lit("the stride does not divide the span")).cast("boolean"))
    return particles.join(last.hint("merge"), "case_id").where(fits).drop("_last")


def frame_at(particles: DataFrame, hours_back: Column, minutes: float) -> DataFrame:
    """The frame nearest to some hours back, held at the ends of a case's span."""
    last = particles.groupBy("case_id").agg(F.max("step").alias("_last"))
    want = F.greatest(F.lit(0.0), F.least(F.bround(hours_back * 60 / minutes, 0), F.col("_last").cast("double")))
    return particles.join(last.hint("merge"), "case_id").where(F.col("step") == want).drop("_last")


def on_land(points: DataFrame, land: DataFrame, cell_deg: float = 0.01) -> DataFrame:
    """points with is_land, by an equi join on the cell of a land table (cx, cy); no land table, no land."""
    key = lambda c: F.floor(F.col(c) / cell_deg).cast("int")
    keyed = points.withColumn("cx", key("lon")).withColumn("cy", key("lat"))
    return keyed.join(land.select("cx", "cy").distinct().withColumn("_l", F.lit(True)), ["cx", "cy"], "left").withColumn("is_land", F.coalesce("_l", F.lit(False))).drop("_l", "cx", "cy")


def gated_scenes(detections: DataFrame, gates: DataFrame, threshold: float) -> DataFrame:
    """Detections of scenes whose classifier says oil; a scene below the threshold has none."""
    return detections.join(gates.where(F.col("p_oil") >= threshold).select("scene_id"), "scene_id", "left_semi")


def erased_scenes(pixels: DataFrame) -> DataFrame:
    """pixels with the true slick painted over by the scene's median sea: what a scorer must no longer find."""
    sea = pixels.where("gt = 0").groupBy("scene_id").agg(F.median("db").alias("_sea"))
    return pixels.join(sea, "scene_id", "left").withColumn("db", F.when(F.col("gt") == 1, F.col("_sea")).otherwise(F.col("db"))).drop("_sea")
