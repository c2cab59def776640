"""Dark spots of scenes of any size, from the prepared scene to regions with their contrast; a task holds one tile and what its windows reach."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import image, masks, regions
from .masks import KEYS

# Fixed values.
SCALES, SMOOTH, LEAST_MAD = (41, 121, 361), 3, 1e-3


def depths(prepared: DataFrame, scenes: DataFrame, sizes: tuple[int, ...] = SCALES, smooth: int = SMOOTH, sea_sigma: float = image.SEA_SIGMA, tile: int = image.TILE) -> DataFrame:
    """(scene_id, r, c, v): how much darker than the water around it each place of a prepared scene is."""
    reach = 2 * (max(sizes) // 2) + smooth // 2 + math.ceil(5 * sea_sigma) + 1
    filled = prepared.where("filled is not null").select(*KEYS, F.col("filled").alias("v"))
    return masks.over_tiles(filled, scenes, reach, lambda a: image.depth_map(a, sizes, smooth, sea_sigma), tile, missing=np.nan)


def noise_floor(depth: DataFrame) -> DataFrame:
    """(scene_id, med, mad): median and 1.4826 median deviations, at least 0.001, of the depths (scene_id, v) of valid places."""
    med = masks.quantiles(depth, 0.5).withColumnRenamed("q", "med")
    off = masks.quantiles(depth.hint("merge").join(med, "scene_id").select("scene_id", F.abs(F.col("v") - F.col("med")).alias("v")), 0.5)
    return med.join(off, "scene_id").select("scene_id", "med", F.greatest(1.4826 * F.col("q"), F.lit(LEAST_MAD)).alias("mad"))


def rings(labels: DataFrame, scenes: DataFrame, inner: int = image.RING_IN, outer: int = image.RING_OUT, tile: int = image.TILE) -> DataFrame:
    """(scene_id, label, r, c): places more than inner and at most outer steps (up, down and aside) from a region of labels (scene_id, r, c, label).

    A place may belong to the rings of several regions, also inside other regions.
    """
    size = scenes.groupBy("scene_id").agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"))
    near = lambda x, most: F.explode(F.sequence(F.greatest(F.floor((F.col(x) - outer) / tile), F.lit(0)), F.least(F.floor((F.col(x) + outer) / tile), F.floor((F.col(most) - 1) / tile))))
    sent = labels.select(*KEYS, "label").hint("merge").join(size, "scene_id").withColumn("tr", near("r", "rows")).withColumn("tc", near("c", "cols"))
    kind = labels.schema["scene_id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf.tr.iloc[0]) * tile, int(pdf.tc.iloc[0]) * tile
        bottom, right = min(top + tile, int(pdf.rows.iloc[0])), min(left + tile, int(pdf.cols.iloc[0]))
        out = []
        for label, own in pdf.groupby("label"):
            r, c = own.r.to_numpy(), own.c.to_numpy()
            r0, c0 = r.min() - outer, c.min() - outer
            m = np.zeros((r.max() + outer + 1 - r0, c.max() + outer + 1 - c0), bool)
            m[r - r0, c - c0] = True
            away = image.steps_to(m)
            y, x = np.nonzero((away > inner) & (away <= outer))
            y, x = y + r0, x + c0
            here = (y >= top) & (y < bottom) & (x >= left) & (x < right)
            out.append(pd.DataFrame({"label": label, "r": y[here], "c": x[here]}))
        return pd.concat(out).assign(scene_id=pdf.scene_id.iloc[0])[["scene_id", "label", "r", "c"]]

    return sent.groupBy("scene_id", "tr", "tc").applyInPandas(one, f"scene_id {kind}, label long, r int, c int")


_SPOT = "label long, n_px long, area_km2 double, r0 int, r1 int, c0 int, c1 int, r double, c double, elongation double, fill double, mean_depth_db double, max_depth_db double, contrast_db double"


def _spots(rows: int, cols: int, r: np.ndarray, c: np.ndarray, filled: np.ndarray, valid: np.ndarray, pixel_km2: float, sizes: tuple[int, ...], close: int, least_km2: float, most_km2: float, least_extent: int) -> dict[str, np.ndarray] | None:  # noqa: PLR0913
    """The steps of ``dark_spots`` on one prepared scene within a tile."""
    db, ok = np.full((rows, cols), np.nan), np.zeros((rows, cols), bool)
    db[r, c], ok[r, c] = filled, valid.astype(float) > 0
    ok &= ~np.isnan(db)
    if not ok.any():
        return None
    depth = image.depth_map(db, sizes, SMOOTH, image.SEA_SIGMA)
    med = masks.quantile(depth[ok], 0.5)
    mad = max(1.4826 * masks.quantile(np.abs(depth[ok] - med), 0.5), LEAST_MAD)
    over = lambda least, mads: ok & (depth >= med + max(least, mads * mad))
    shut = image.closed(image.held(over(image.WEAK_DB, image.WEAK_MADS), over(image.STRONG_DB, image.STRONG_MADS)), close)
    lab = image.label_components(shut & ok)
    out = []
    for k, (r0, r1, c0, c1) in enumerate(image.region_boxes(lab), 1):
        top, left = max(0, r0 - image.RING_OUT), max(0, c0 - image.RING_OUT)
        near = (slice(top, r1 + image.RING_OUT + 1), slice(left, c1 + image.RING_OUT + 1))
        own = lab[near] == k
        y, x = np.nonzero(own)
        n = len(y)
        area, extent = n * float(pixel_km2), max(r1 - r0, c1 - c0) + 1
        if area > most_km2 or (area < least_km2 and extent < least_extent):
            continue
        away = image.steps_to(own)
        ring = db[near][ok[near] & (away > image.RING_IN) & (away <= image.RING_OUT)]
        contrast = masks.quantile(db[near][own], 0.5) - masks.quantile(ring, 0.5) if ring.size else np.nan
        half, apart = (y.var() + x.var()) / 2, np.hypot((y.var() - x.var()) / 2, ((y - y.mean()) * (x - x.mean())).mean())
        long, short = (np.sqrt(max(v, 1 / 12)) for v in (half + apart, half - apart))
        at = depth[near][own]
        first = (int(y[0]) + top) * (1 << 32) + int(x[0]) + left
        out.append((first, n, area, r0, r1, c0, c1, y.mean() + top, x.mean() + left, long / short, n / ((r1 - r0 + 1) * (c1 - c0 + 1)), at.mean(), at.max(), contrast))
    kinds = [{"long": np.int64, "int": np.int32, "double": float}[x.split()[1]] for x in _SPOT.split(", ")]
    return {x.split()[0]: np.array(v, t) for x, t, v in zip(_SPOT.split(", "), kinds, zip(*out, strict=True), strict=True)} if out else None


def dark_spots(pixels: DataFrame, scenes: DataFrame, pixel_km2: float, *, prepared: DataFrame | None = None, sizes: tuple[int, ...] = SCALES, close: int = image.CLOSE_SIZE, least_km2: float = 0.05, most_km2: float = 500.0, least_extent: int = 80, tile: int = image.TILE) -> DataFrame:  # noqa: PLR0913
    """(scene_id, label, n_px, area_km2, r0, r1, c0, c1, r, c, elongation, fill, mean_depth_db, max_depth_db, contrast_db) of dark regions.

    Noise, weak and strong pixels, closing and background rings take valid places alone (``masks.prepare``, whose
    result may be handed in). A region counts if it is large or long enough and not too large. Contrast is the median
    inside less that of the ring of 5 to 25 steps; without a valid place in the ring it is null. A scene without valid places has no rows.
    Scenes that one tile holds are gone through whole, many in one call, larger ones over tiles.
    """
    prep = prepared if prepared is not None else masks.prepare(pixels, scenes, pixel_km2, tile=tile)
    small, large, some = masks.by_size(scenes, tile)
    prep = staged(prep.select(*KEYS, "filled", "valid"), "prepared") if some else prep
    kernel = lambda rows, cols, r, c, filled, valid: _spots(rows, cols, r, c, filled, valid, pixel_km2, sizes, close, least_km2, most_km2, least_extent)
    values = prep.select(*KEYS, F.col("filled").cast("double").alias("filled"), F.coalesce("valid", F.lit(False)).cast("int").alias("valid"))
    each = masks.by_scene(values, small, ["filled", "valid"], kernel, _SPOT)
    if not some:
        return each
    of = prep.join(large.select("scene_id").hint("merge"), "scene_id", "left_semi")
    return each.unionByName(_spots_over_tiles(of, large, pixel_km2, sizes, close, least_km2, most_km2, least_extent, tile))


def _spots_over_tiles(prepared: DataFrame, scenes: DataFrame, pixel_km2: float, sizes: tuple[int, ...], close: int, least_km2: float, most_km2: float, least_extent: int, tile: int) -> DataFrame:  # noqa: PLR0913
    prep = staged(prepared, "prepared")
    valid = prep.where("valid").select(*KEYS, F.col("filled").alias("db"))
    depth = staged(depths(prep, scenes, sizes, tile=tile).join(valid.hint("merge"), KEYS).select(*KEYS, "v", "db"), "depths")
    rated = depth.hint("merge").join(staged(noise_floor(depth.select("scene_id", "v")), "noise"), "scene_id")
    over = lambda db, mads: rated.where(F.col("v") >= F.col("med") + F.greatest(F.lit(db), mads * F.col("mad"))).select(*KEYS)
    spots = regions.held(over(image.WEAK_DB, image.WEAK_MADS), over(image.STRONG_DB, image.STRONG_MADS), tile)
    shut = masks.over_tiles(spots.select(*KEYS, F.lit(1.0).alias("v")), scenes, 2 * (close // 2), lambda a: image.closed(a > 0, close), tile)
    labels = staged(regions.labelled(shut.join(valid.hint("merge"), KEYS, "left_semi"), tile), "spots")
    figures = regions.region_figures(labels).withColumn("area_km2", F.col("n_px") * F.lit(float(pixel_km2)))
    extent = F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")) + 1
    figures = figures.where((F.col("area_km2") <= most_km2) & ((F.col("area_km2") >= least_km2) | (extent >= least_extent)))
    own = labels.hint("merge").join(figures.select("scene_id", "label"), ["scene_id", "label"], "left_semi")
    inside = staged(own.join(depth.hint("merge"), KEYS).select(*KEYS, "label", "v", "db"), "inside")
    about = staged(rings(inside, scenes, tile=tile).join(valid.hint("merge"), KEYS).select("scene_id", "label", "db"), "rings")
    median = lambda rows, name: masks.quantiles(rows.select(F.struct("scene_id", "label").alias("scene_id"), F.col("db").alias("v")), 0.5).select("scene_id.scene_id", "scene_id.label", F.col("q").alias(name))
    deep = inside.groupBy("scene_id", "label").agg(F.avg("v").alias("mean_depth_db"), F.max("v").alias("max_depth_db"))
    at = ["scene_id", "label"]
    every = figures.join(deep, at).join(median(inside, "a"), at).join(median(about, "b"), at, "left")
    return every.select(*at, "n_px", "area_km2", "r0", "r1", "c0", "c1", "r", "c", "elongation", "fill", "mean_depth_db", "max_depth_db", (F.col("a") - F.col("b")).alias("contrast_db"))
