"""Medial axes of masks of any size: parallel thinning over tiles, widths across the mask, profiles along it.

Masks are rows of set pixels (scene_id, r, c); pixels may repeat, those without a scene or a place are
left out, and what is no row is unset. A task holds one tile and what lies within reach of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .image import TILE
from .regions import whole_groups

KEYS = ["scene_id", "r", "c"]
#: An axis of fewer pixels has no profile.
LEAST_AXIS = 20
# The neighbours of a pixel, clockwise from above it.
_RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def _moved(m: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """m at (r + dr, c + dc), unset beyond its sides."""
    p = np.pad(m, 2)
    return p[2 + dr : 2 + dr + m.shape[0], 2 + dc : 2 + dc + m.shape[1]]


def peeled(m: np.ndarray, second: bool) -> np.ndarray:
    """One half of a step of Zhang and Suen's thinning (1984).

    A pixel goes if two to six of its neighbours are set, they form one stretch, and it lies on the side
    that this half peels. A square of two by two with nothing around it, which would vanish, keeps its
    first pixel; so every result depends on pixels at most two away.
    """
    near = [_moved(m, dr, dc) for dr, dc in _RING]
    n = np.sum(near, axis=0, dtype=np.int8)
    runs = np.sum([~a & b for a, b in zip(near, near[1:] + near[:1], strict=True)], axis=0, dtype=np.int8)
    up, right, down, left = near[0], near[2], near[4], near[6]
    free = (~(up & right & left) & ~(up & down & left)) if second else (~(up & right & down) & ~(right & down & left))
    square = {(0, 0), (0, 1), (1, 0), (1, 1)}
    lone = m & right & down & near[3]
    for dr in range(-1, 3):
        for dc in range(-1, 3):
            if (dr, dc) not in square:
                lone = lone & ~_moved(m, dr, dc)
    return m & ~((n >= 2) & (n <= 6) & (runs == 1) & free & ~lone)


def _goes(second: bool) -> np.ndarray:
    """Whether a half of a step takes a pixel, by the block of four by four that begins above and left of it, a bit a place in row order."""
    bit = lambda dr, dc: (np.arange(1 << 16) >> (4 * (dr + 1) + dc + 1) & 1).astype(bool)
    near = [bit(dr, dc) for dr, dc in _RING]
    n = np.sum(near, axis=0, dtype=np.int8)
    runs = np.sum([~a & b for a, b in zip(near, near[1:] + near[:1], strict=True)], axis=0, dtype=np.int8)
    up, right, down, left = near[0], near[2], near[4], near[6]
    free = (~(up & right & left) & ~(up & down & left)) if second else (~(up & right & down) & ~(right & down & left))
    lone = np.arange(1 << 16) == sum(1 << (4 * (dr + 1) + dc + 1) for dr in (0, 1) for dc in (0, 1))
    return (n >= 2) & (n <= 6) & (runs == 1) & free & ~lone


def peeled_places(group: np.ndarray, r: np.ndarray, c: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept, late): whether each distinct place of a group is left after so many halves of steps, and whether one of the last two took it.

    Each place's neighbours are looked up once; a half of a step reads which of them are still set.
    """
    r, c = r - r.min() + 1, c - c.min() + 1
    wide = int(c.max()) + 3
    code = (group * (int(r.max()) + 3) + r) * wide + c
    order = np.argsort(code)
    code, n = code[order], len(code)
    block = []
    for k in range(16):
        to = code + (k // 4 - 1) * wide + k % 4 - 1
        at = np.minimum(np.searchsorted(code, to), n - 1)
        block.append(np.where(code[at] == to, at, n))
    goes = (_goes(False), _goes(True))
    on, early = np.append(np.ones(n, bool), False), None
    for k in range(steps):
        if k == steps - 2:
            early = on[:-1].copy()
        bits = np.zeros(n, np.int32)
        for j, at in enumerate(block):
            bits |= on[at].astype(np.int32) << j
        on[:-1] &= ~goes[k % 2][bits]
    kept, late = np.empty(n, bool), np.empty(n, bool)
    kept[order], late[order] = on[:-1], early & ~on[:-1]
    return kept, late


def thinned(mask: DataFrame, tile: int = TILE, reach: int = 32) -> DataFrame:
    """(scene_id, r, c): the mask's lines of one pixel, as joined (with corners) as it was.

    A round gives each tile what lies within reach and makes as many steps as that allows, many tiles in
    one call, by their set pixels alone; only tiles that lost a pixel in the round's last step, or that
    touch one, go on. Equal to steps over the whole scene.
    """
    if reach % 4 or not 0 < reach <= tile:
        raise ValueError("reach must be a multiple of four, at most a tile")
    return _thinned(staged(_places(mask), "mask"), tile, reach)


def _places(mask: DataFrame) -> DataFrame:
    return mask.select("scene_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).where("scene_id is not null and r is not null and c is not null").distinct()


def _thinned(kept: DataFrame, tile: int, reach: int) -> DataFrame:
    kind = kept.schema["scene_id"].dataType.simpleString()
    tiles = ["scene_id", "tr", "tc"]

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, tiles):
            r, c = t["r"].to_numpy() - t["tr"].to_numpy() * tile, t["c"].to_numpy() - t["tc"].to_numpy() * tile
            stays, late = peeled_places(np.repeat(np.arange(len(at)), np.diff(np.append(at, len(r)))), r, c, reach // 2)
            own = (r >= 0) & (r < tile) & (c >= 0) & (c < tile) & (stays | late)
            yield from t.select(KEYS).append_column("kept", pa.array(stays)).filter(pa.array(own)).combine_chunks().to_batches()

    at = lambda x: F.floor(F.col(x) / tile).alias(f"t{x}")
    reached = lambda x: F.explode(F.sequence(F.floor((F.col(x) - reach) / tile), F.floor((F.col(x) + reach) / tile)))
    busy = None
    while True:
        sent = kept.withColumn("tr", reached("r")).withColumn("tc", reached("c"))
        if busy is not None:
            sent = sent.hint("merge").join(busy, tiles, "left_semi")
        told = staged(sent.repartition(*tiles).sortWithinPartitions(*tiles).mapInArrow(many, f"scene_id {kind}, r long, c long, kept boolean"), "thinning")
        still = told.where("kept").select(*KEYS)
        if busy is not None:
            idle = kept.select(*KEYS, at("r"), at("c")).hint("merge").join(busy, tiles, "left_anti").select(*KEYS)
            still = still.union(idle)
        lost = told.where("not kept").select("scene_id", at("r"), at("c")).distinct()
        if lost.isEmpty():
            return still
        kept = staged(still, "thinned")
        side = lambda x: F.explode(F.sequence(F.col(x) - 1, F.col(x) + 1)).alias(x)
        busy = staged(lost.select("scene_id", side("tr"), "tc").select("scene_id", "tr", side("tc")).distinct(), "busy")


def half_widths(mask: DataFrame, places: DataFrame) -> DataFrame:
    """(scene_id, r, c, d): distance in pixels from each place (scene_id, r, c) of the mask to the nearest unset pixel.

    The distance within a pixel's own column bounds how far aside the nearest can lie, so a place meets as
    many columns as the mask is wide there; all joins are by equal keys. Places off the mask have none.
    """
    own = mask.select("scene_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).where("scene_id is not null and r is not null and c is not null").distinct()
    run = Window.partitionBy("scene_id", "c").orderBy("r")
    whole = Window.partitionBy("scene_id", "c", "run")
    up = own.withColumn("run", F.col("r") - F.row_number().over(run)).select(*KEYS, F.least(F.col("r") - F.min("r").over(whole) + 1, F.max("r").over(whole) + 1 - F.col("r")).alias("g"))
    up = staged(up, "columns")
    wanted = places.select("scene_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct().join(up.hint("merge"), KEYS)
    beside = wanted.select("scene_id", "r", F.col("c").alias("c0"), F.explode(F.sequence(F.col("c") - F.col("g"), F.col("c") + F.col("g"))).alias("c"))
    g, apart = F.coalesce(F.col("g"), F.lit(0)).cast("double"), (F.col("c") - F.col("c0")).cast("double")
    return beside.join(up.hint("merge"), KEYS, "left").groupBy("scene_id", "r", F.col("c0").alias("c")).agg(F.sqrt(F.min(apart * apart + g * g)).alias("d"))


def medial_profile(mask: DataFrame, pixel_m: float, tile: int = TILE, reach: int = 32) -> DataFrame:
    """(scene_id, r, c, along_m, width_m): the medial axis, its place along the mask's long axis and twice its distance to the edge.

    The long axis has the mask's second moments and points east (north where it is upright). Axes of fewer than twenty pixels are left out.
    """
    if reach % 4 or not 0 < reach <= tile:
        raise ValueError("reach must be a multiple of four, at most a tile")
    own = staged(_places(mask), "mask")
    axis = staged(_thinned(own, tile, reach), "axis")
    long_ = own.groupBy("scene_id").agg(F.avg("r").alias("r0"), F.avg("c").alias("c0"), (F.atan2(-2 * F.covar_pop("c", "r"), F.var_pop("c") - F.var_pop("r")) / 2).alias("turn"))
    enough = axis.groupBy("scene_id").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_AXIS).select("scene_id")
    at = half_widths(own, axis).join(enough.hint("merge"), "scene_id").join(long_.hint("merge"), "scene_id")
    along = ((F.col("c") - F.col("c0")) * F.cos("turn") - (F.col("r") - F.col("r0")) * F.sin("turn")) * F.lit(float(pixel_m))
    return at.select(*KEYS, along.alias("along_m"), (2 * F.col("d") * F.lit(float(pixel_m))).alias("width_m"))


def profile_figures(profile: DataFrame, mask: DataFrame, pixel_m: float) -> DataFrame:
    """(scene_id, axis_px, mean_width_m, length_km, aspect, widest_m) of profiles: length counts the axis, the mean width is the area over it."""
    area = mask.select(*KEYS).where("scene_id is not null and r is not null and c is not null").distinct().groupBy("scene_id").agg(F.count("*").alias("n"))
    each = profile.groupBy("scene_id").agg(F.count("*").alias("axis_px"), F.max("width_m").alias("widest_m")).join(area, "scene_id")
    px = F.lit(float(pixel_m))
    mean = F.col("n") * px / F.col("axis_px")
    return each.select("scene_id", "axis_px", mean.alias("mean_width_m"), (F.col("axis_px") * px / 1000).alias("length_km"), (F.col("axis_px") * px / mean).alias("aspect"), "widest_m")
