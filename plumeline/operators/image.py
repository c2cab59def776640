"""Image kernels for radar scenes, in NumPy, one scene or tile a group.

Scenes are pixel rows (scene_id, r, c, db). What needs a pixel's neighbourhood runs inside
applyInPandas on a scene, whose size is bounded by the sensor; what is a statistic stays in the plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import percentiles

# Fixed values.
WEAK_DB, STRONG_DB, WEAK_MADS, STRONG_MADS, TILE = 1.0, 2.0, 1.5, 3.0, 256
RING_OUT, RING_IN, CLOSE_SIZE, SEA_SIGMA = 25, 5, 11, 3.0
CHRONIC_ELONGATION, STRAIGHT, ACUTE_ELONGATION = 5.0, 0.60, 3.0
VH_USABLE_DB = -24.0


def dense(pdf: pd.DataFrame, value: str = "db") -> np.ndarray:
    """The pixels of one scene as a matrix, missing ones not a number."""
    out = np.full((int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1), np.nan)
    out[pdf["r"], pdf["c"]] = pdf[value]
    return out


def _sliding(a: np.ndarray, size: int, axis: int, pick) -> np.ndarray:  # noqa: ANN001
    """Running extreme over a centred window, edges repeated; pick is a ufunc, and windows are put together by doubling."""
    half, n = size // 2, a.shape[axis]
    pad = [(half, size - 1 - half) if k == axis else (0, 0) for k in range(a.ndim)]
    a = np.moveaxis(np.pad(a, pad, mode="edge"), axis, 0)
    wide = 1
    while 2 * wide <= size:
        a, wide = pick(a[:-wide], a[wide:]), 2 * wide
    return np.moveaxis(pick(a[:n], a[size - wide : size - wide + n]), 0, axis)


def grey_closing(a: np.ndarray, size: int) -> np.ndarray:
    """Maximum then minimum over a square: dark spots narrower than it are filled."""
    for pick in (np.maximum, np.minimum):
        a = _sliding(_sliding(a, size, 0, pick), size, 1, pick)
    return a


def median_filter(a: np.ndarray, size: int) -> np.ndarray:
    half = size // 2
    view = np.lib.stride_tricks.sliding_window_view(np.pad(a, half, mode="edge"), (size, size))
    if size % 2 and not np.isnan(a).any():
        return np.partition(view.reshape(*a.shape, size * size), size * size // 2, axis=-1)[..., size * size // 2]
    return np.nanmedian(view, axis=(-2, -1))


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Mean over a centred square, by sums of sums; edges repeated."""
    half = size // 2
    s = np.pad(np.pad(a, half, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, cut off at four sigmas, edges mirrored."""
    half = round(4 * sigma)
    weight = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis in (0, 1):
        n = a.shape[axis]
        at = np.abs(np.arange(-half, n + half)) % max(2 * n - 2, 1)
        wide = np.take(a, np.where(at >= n, 2 * n - 2 - at, at) if n > 1 else at * 0, axis=axis)
        a = sum(w * np.take(wide, np.arange(k, k + n), axis=axis) for k, w in enumerate(weight))
    return a


def depth_map(db: np.ndarray, sizes: tuple[int, ...] = (41, 121, 361), smooth: int = 3, sea_sigma: float = SEA_SIGMA) -> np.ndarray:
    """How much darker each pixel is than the water around it, the most over several scales, never negative.

    The water is a closing of a blurred copy: of single pixels it would pick the brightest noise.
    """
    filled = np.where(np.isnan(db), np.nanmedian(db), db)
    soft = median_filter(filled, smooth) if smooth > 1 else filled
    sea = gaussian(soft, sea_sigma) if sea_sigma else soft
    return np.maximum(np.max([grey_closing(sea, min(s, 2 * min(soft.shape) - 1) | 1) for s in sizes], axis=0) - soft, 0.0)


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of the ellipse inscribed in a square of odd size: each row as wide as the circle at its height."""
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= round(r * (1 - (dy / r) ** 2) ** 0.5)] if r else [(0, 0)]


def closed(mask: np.ndarray, size: int = CLOSE_SIZE) -> np.ndarray:
    """Morphological closing with an ellipse; what lies outside the scene neither adds nor removes pixels."""
    h, w = mask.shape
    r = size // 2
    for seed, join in ((False, np.logical_or), (True, np.logical_and)):
        wide = np.pad(mask, r, constant_values=seed)
        mask = np.full((h, w), seed)
        for dy, dx in ellipse(size):
            mask = join(mask, wide[r + dy : r + dy + h, r + dx : r + dx + w])
    return mask


def steps_to(mask: np.ndarray) -> np.ndarray:
    """Steps along rows and columns from each pixel to the nearest true one."""
    d = np.where(mask, 0, sum(mask.shape) + 1)
    for axis in (0, 1):
        d = np.moveaxis(d, axis, 0)
        for k in range(1, len(d)):
            d[k] = np.minimum(d[k], d[k - 1] + 1)
        for k in range(len(d) - 2, -1, -1):
            d[k] = np.minimum(d[k], d[k + 1] + 1)
        d = np.moveaxis(d, 0, axis)
    return d


def label_components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Numbers of connected regions from 1 on, in the order of their first pixel; 0 outside."""
    h, w = mask.shape
    r, c = np.nonzero(mask)
    place = np.full((h + 1, w + 2), -1)
    place[r, c + 1] = np.arange(len(r))
    near = [place[r + dr, c + 1 + dc] for dr, dc in [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])]
    met = [np.flatnonzero(b >= 0) for b in near]
    a, b = np.concatenate(met), np.concatenate([x[m] for x, m in zip(near, met, strict=True)])
    root = np.arange(len(r))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    out = np.zeros((h, w), int)
    out[r, c] = np.cumsum(root == np.arange(len(r)))[root]
    return out


def held(weak: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Pixels of the weak regions that hold a strong one."""
    lab = label_components(weak)
    keep = np.zeros(int(lab.max(initial=0)) + 1, bool)
    keep[lab[strong]] = True
    keep[0] = False
    return keep[lab]


def hysteresis(depth: np.ndarray, weak: float, strong: float) -> np.ndarray:
    """Weak regions that hold a strong pixel, labelled."""
    return label_components(held(depth >= weak, depth >= strong))


def binary_dilate(mask: np.ndarray, times: int = 1) -> np.ndarray:
    return _sliding(_sliding(mask.astype(np.int8), 2 * times + 1, 0, np.maximum), 2 * times + 1, 1, np.maximum) > 0


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Distance in pixels to the nearest true one, in two passes over columns and rows."""
    h, w = mask.shape
    far = float(h + w)
    d = np.where(mask, 0.0, far)
    for k in range(1, h):
        d[k] = np.minimum(d[k], d[k - 1] + 1)
    for k in range(h - 2, -1, -1):
        d[k] = np.minimum(d[k], d[k + 1] + 1)
    c = np.arange(w)
    gap = (c[:, None] - c[None, :]) ** 2
    return np.sqrt(np.stack([(row[None, :] ** 2 + gap).min(axis=1) for row in d]))


REGION = "scene_id string, region_id int, area_px int, mean_depth_db double, max_depth_db double, contrast_db double, elongation double, edge_gradient double, solidity double, r double, c double"


def region_boxes(lab: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first row, last row, first column, last column) of each labelled region."""
    r, c = np.nonzero(lab)
    k, n = lab[r, c] - 1, int(lab.max(initial=0))
    lo, hi = np.full((2, n), max(lab.shape)), np.full((2, n), -1)
    for i, x in enumerate((r, c)):
        np.minimum.at(lo[i], k, x)
        np.maximum.at(hi[i], k, x)
    return list(zip(lo[0].tolist(), hi[0].tolist(), lo[1].tolist(), hi[1].tolist(), strict=True))


def regions_of(scene_id: str, db: np.ndarray, pixel_km2: float, least_km2: float, most_km2: float, least_extent: int, sizes: tuple[int, ...], close: int = CLOSE_SIZE) -> pd.DataFrame:
    """Dark regions of one scene with their shape and contrast.

    A region counts if it is large enough or long enough, and not too large. Its background is the
    ring of 5 to 25 steps about it; all of that lies in a window about the region's box.
    """
    depth = depth_map(db, sizes)
    med = np.median(depth)
    mad = 1.4826 * np.median(np.abs(depth - med))
    lab = label_components(closed(held(depth >= med + max(WEAK_DB, WEAK_MADS * mad), depth >= med + max(STRONG_DB, STRONG_MADS * mad)), close))
    gy, gx = np.gradient(np.where(np.isnan(db), np.nanmedian(db), db))
    slope = np.hypot(gx, gy)
    out = []
    for k, (r0, r1, c0, c1) in enumerate(region_boxes(lab), 1):
        near = (slice(max(0, r0 - RING_OUT - 1), r1 + RING_OUT + 2), slice(max(0, c0 - RING_OUT - 1), c1 + RING_OUT + 2))
        own, here = lab[near] == k, db[near]
        n, extent = int(own.sum()), max(r1 - r0, c1 - c0) + 1
        if n * pixel_km2 > most_km2 or (n * pixel_km2 < least_km2 and extent < least_extent):
            continue
        r, c = np.nonzero(own)
        cov = np.cov(np.stack([r, c])) if n > 2 else np.eye(2)
        lo, hi = np.sqrt(np.maximum(np.linalg.eigvalsh(cov), 1 / 12))
        away = steps_to(own)
        ring = here[(away <= RING_OUT) & (away > RING_IN) & ~np.isnan(here)]
        inside = here[own & ~np.isnan(here)]
        contrast = float(np.median(inside) - np.median(ring)) if ring.size and inside.size else None
        edge = own & binary_dilate(~own)
        at = depth[near][own]
        box = (r1 - r0 + 1) * (c1 - c0 + 1)
        out.append((scene_id, len(out) + 1, n, float(at.mean()), float(at.max()), contrast, float(hi / lo), float(slope[near][edge].mean()) if edge.any() else 0.0, n / box, float(r.mean() + near[0].start), float(c.mean() + near[1].start)))
    return pd.DataFrame(out, columns=[x.split()[0] for x in REGION.split(", ")])


def dark_regions(pixels: DataFrame, pixel_km2: float = 1e-4, least_km2: float = 0.05, most_km2: float = 500.0, least_extent: int = 80, sizes: tuple[int, ...] = (41, 121, 361)) -> DataFrame:
    """Dark regions of every scene, a scene a task."""
    return pixels.groupBy("scene_id").applyInPandas(lambda pdf: regions_of(str(pdf["scene_id"].iloc[0]), dense(pdf), pixel_km2, least_km2, most_km2, least_extent, sizes), REGION)


CONTACT = "scene_id string, contact_id int, r double, c double, px_area int, peak_db double, fill double"


def bright_contacts(pixels: DataFrame, least_db: float = -10.0, k: float = 4.0, min_px: int = 4, max_px: int = 4000, fill: float = 0.20, merge_px: float = 5.0) -> DataFrame:
    """Ships: bright compact components, the brightest first taking those within merge_px of it."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        db = dense(pdf)
        med = np.nanmedian(db)
        cut = max(least_db, med + k * 1.4826 * np.nanmedian(np.abs(db - med)))
        lab = label_components(np.nan_to_num(db, nan=-1e9) >= cut)
        found = []
        for i in range(1, lab.max(initial=0) + 1):
            r, c = np.nonzero(lab == i)
            share = len(r) / ((np.ptp(r) + 1) * (np.ptp(c) + 1))
            if min_px <= len(r) <= max_px and share >= fill:
                found.append((float(db[r, c].max()), float(r.mean()), float(c.mean()), len(r), float(share)))
        kept = []
        for peak, r, c, n, share in sorted(found, reverse=True):
            near = next((x for x in kept if np.hypot(x[1] - r, x[2] - c) <= merge_px), None)
            if near:
                near[3] += n
            else:
                kept.append([peak, r, c, n, share])
        rows = [(str(pdf["scene_id"].iloc[0]), j + 1, r, c, n, peak, share) for j, (peak, r, c, n, share) in enumerate(kept)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in CONTACT.split(", ")])

    return pixels.groupBy("scene_id").applyInPandas(one, CONTACT)


def classify_shape(elongation, straightness):  # noqa: ANN001, ANN201
    """chronic, acute or unknown, by shape alone."""
    return F.when((elongation >= CHRONIC_ELONGATION) & (straightness >= STRAIGHT), "chronic").when(elongation < ACUTE_ELONGATION, "acute").otherwise("unknown")


def rule_score(contrast, elongation):  # noqa: ANN001, ANN201
    """(classification, confidence) by thresholds where no model is at hand; confidence grows with the margin."""
    oil = (contrast <= -3.0) & (elongation >= 2.5)
    margin = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.abs(contrast + 3.0) / 6.0))
    return F.when(oil, "oil").otherwise("lookalike"), F.bround(0.5 + 0.5 * margin, 3)


def demote_small(detections: DataFrame, least_km2: float, cap: float = 0.45) -> DataFrame:
    """Oil below an area is a lookalike of low confidence."""
    small = (F.col("classification") == "oil") & (F.col("area_km2") < least_km2)
    return detections.withColumn("confidence", F.when(small, F.least("confidence", F.lit(cap))).otherwise(F.col("confidence"))).withColumn("classification", F.when(small, "lookalike").otherwise(F.col("classification")))


def rank_detections(detections: DataFrame) -> DataFrame:
    """Ids det-01 on, by confidence within a case."""
    k = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("confidence"), F.desc("area_km2"), "region_id"))
    return detections.withColumn("id", F.format_string("det-%02d", k))


def sea_reference(pixels: DataFrame, share: float = 0.2, block: int = 51) -> DataFrame:
    """(scene_id, sea_db): a low percentile of block means, which land and ships don't raise."""
    b = pixels.groupBy("scene_id", F.floor(F.col("r") / block).alias("br"), F.floor(F.col("c") / block).alias("bc")).agg(F.avg("db").alias("m"))
    return b.groupBy("scene_id").agg(F.percentile("m", share).alias("sea_db"))


def normalise(pixels: DataFrame, most: float = 6.0) -> DataFrame:
    """x in [-1, 1]: decibels over the scene's median in robust deviations, cut at six."""
    med = percentiles(pixels, ["scene_id"], "db", {"med": 0.5})
    off = pixels.join(F.broadcast(med), "scene_id").select("scene_id", F.abs(F.col("db") - F.col("med")).alias("off"))
    spread = percentiles(off, ["scene_id"], "off", {"mad": 0.5}).join(med, "scene_id").select("scene_id", "med", (F.col("mad") * 1.4826 + 1e-6).alias("mad"))
    mad = pixels.select("scene_id").where("scene_id is not null").distinct().join(spread, "scene_id", "left")  # a row each, also without a value
    z = (F.col("db") - F.col("med")) / F.col("mad")
    x = F.when(F.col("db").isNotNull(), F.greatest(F.lit(-most), F.least(F.lit(most), z)) / most)
    return pixels.join(F.broadcast(mad), "scene_id").withColumn("x", x).drop("med", "mad")


def histogram_modes(pixels: DataFrame, bins: int = 256, lo: float = -40.0, hi: float = 0.0) -> DataFrame:
    """(scene_id, bin, n, smooth): smoothed local maxima of the decibel histogram, the candidates for open sea."""
    b = F.least(F.greatest(F.floor((F.col("db") - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1))
    h = pixels.groupBy("scene_id", b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    # the 5-tap mean of counts, bins that are missing counting as zero
    s = h.select("scene_id", "n", F.explode(F.sequence(F.col("bin") - 2, F.col("bin") + 2)).alias("bin")).groupBy("scene_id", "bin").agg((F.sum("n") / 5.0).alias("smooth"))
    w = Window.partitionBy("scene_id").orderBy("bin")
    s = s.withColumn("a", F.coalesce(F.lag("smooth").over(w), F.lit(0.0))).withColumn("z", F.coalesce(F.lead("smooth").over(w), F.lit(0.0)))
    return s.where((F.col("smooth") > F.col("a")) & (F.col("smooth") >= F.col("z"))).select("scene_id", "bin", "smooth")


def tiles(pixels: DataFrame, size: int = TILE) -> DataFrame:
    """(scene_id, tr, tc, n, oil_frac, mean_db) of square tiles; pixels carry gt (0 or 1)."""
    return pixels.groupBy("scene_id", F.floor(F.col("r") / size).cast("int").alias("tr"), F.floor(F.col("c") / size).cast("int").alias("tc")).agg(F.count("*").alias("n"), F.avg("gt").alias("oil_frac"), F.avg("db").alias("mean_db"))


def choose_tiles(tiled: DataFrame, positives: int = 12, hard: int = 8) -> DataFrame:
    """The richest tiles of a scene, as many others by hash, and the darkest clean ones; role says which."""
    w = Window.partitionBy("scene_id")
    t = tiled.withColumn("pos", F.row_number().over(w.orderBy(F.desc("oil_frac"), "tr", "tc"))).withColumn("is_pos", (F.col("oil_frac") > 0) & (F.col("pos") <= positives))
    t = t.withColumn("n_pos", F.count_if("is_pos").over(w))
    clean = F.col("oil_frac") == 0
    t = t.withColumn("any", F.row_number().over(w.orderBy(F.desc(clean), F.xxhash64("scene_id", "tr", "tc")))).withColumn("dark", F.row_number().over(w.orderBy(F.desc(clean), "mean_db", "tr", "tc")))
    role = F.when(F.col("is_pos"), "positive").when(clean & (F.col("dark") <= hard), "hard").when(clean & (F.col("any") <= F.col("n_pos")), "negative")
    return t.withColumn("role", role).where("role is not null").select("scene_id", "tr", "tc", "role")


def merge_tiles(scores: DataFrame) -> DataFrame:
    """Mean of overlapping tiles' pixel scores (scene_id, r, c, p, w) by their weights, highest in the middle of a tile."""
    return scores.groupBy("scene_id", "r", "c").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"))


def region_overlap(region_pixels: DataFrame, truth: DataFrame, least: float = 0.25) -> DataFrame:
    """(scene_id, region_id, overlap, label): share of a region's pixels (scene_id, region_id, r, c) in the truth (scene_id, r, c)."""
    hit = region_pixels.join(truth.select("scene_id", "r", "c", F.lit(1).alias("gt")), ["scene_id", "r", "c"], "left")
    return hit.groupBy("scene_id", "region_id").agg((F.sum(F.coalesce("gt", F.lit(0))) / F.count("*")).alias("overlap")).withColumn("label", (F.col("overlap") >= least).cast("int"))


def burn(rings: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels (scene_id, r, c, lon, lat) whose centre lies in a ring (scene_id, ring), by counting crossings.

    Equal rings of a scene and pixels of one place meet once; a place meets only rings that its latitude crosses.
    """
    def crossings(ring, x, y):  # noqa: ANN001, ANN202
        n = F.size(ring)
        def crossed(i):  # noqa: ANN001, ANN202
            a, b = F.element_at(ring, i + 1), F.element_at(ring, (i + 1) % n + 1)
            spans = (a["lat"] > y) != (b["lat"] > y)
            return F.when(spans & (x < a["lon"] + (y - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) * (b["lon"] - a["lon"])), 1).otherwise(0)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crossed(i))
    at = ["scene_id", "lon", "lat"]
    tasks = pixels.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: adaptive execution would put them in one task
    places = pixels.select(*at).distinct().repartition(tasks, *at)
    high = F.transform("ring", lambda p: p["lat"])
    each = rings.select("scene_id", "ring").distinct().withColumns({"low": F.array_min(high), "high": F.array_max(high)}).repartition(tasks, "scene_id", "ring")
    met = places.join(each, "scene_id").where((F.col("lat") >= F.col("low")) & (F.col("lat") < F.col("high")))
    inside = met.where(crossings(F.col("ring"), F.col("lon"), F.col("lat")) % 2 == 1).select(*at).distinct()
    return pixels.join(inside, at, "left_semi").select("scene_id", "r", "c").distinct()
