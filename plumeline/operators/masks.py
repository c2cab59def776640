"""Local means, masks and ships of scenes of any size: tiles with a border of their neighbours' pixels.

A scene is a row of scenes (scene_id, rows, cols) and pixels (scene_id, r, c, db); a place without a
pixel, or whose value is null, not finite or zero, has no data. A task holds one tile and as much
beside it as its window reaches; medians and percentiles are exact and gather a thousandth of a scene.
Pixels are joined by sorted merges: Spark takes made rows, and alike ones in a small file, for few and
would broadcast them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .image import TILE, box_mean, label_components
from .regions import labelled, whole_groups

# Fixed values.
SEA_WINDOW, SEA_SHARE, BRIGHT_DB, BRIGHT_STEPS = 51, 0.2, -10.0, 5
LAND_DB, LAND_CLOSE, LAND_KM2, LAND_STEPS = 7.0, 5, 0.5, 40
SHIP_DB, SHIP_MADS, SHIP_LEAST, SHIP_MOST, SHIP_FILL, SHIP_MERGE_M = -10.0, 4.0, 4, 4000, 0.20, 50.0
KEYS = ["scene_id", "r", "c"]
#: Scenes of more values have their quantile looked for between two approximate ones.
SMALL = 10_000


def quantiles(values: DataFrame, share: float, scenes: DataFrame | None = None) -> DataFrame:
    """(scene_id, q): the exact quantile of v of (scene_id, v), between ranks by their distance; nulls don't count.

    Approximate quantiles a thousandth below and above, good to a tenth of that, hold it between them;
    only values between these are ordered, equal ones once. scenes: (scene_id, rows, cols), where there is
    a value for each place at most; if all are small, nothing is sketched.
    """
    v = values.where("v is not null").select("scene_id", "v")
    small = scenes is not None and (scenes.agg(F.max(F.col("rows").cast("long") * F.col("cols"))).first()[0] or 0) <= SMALL
    beside = F.percentile_approx("v", [max(share - 1e-3, 0.0), min(share + 1e-3, 1.0)], 10_000)
    ends = v.groupBy("scene_id").agg(F.count("*").alias("n"), (F.lit(None).cast("array<double>") if small else beside).alias("at"))
    far = F.lit(float("inf"))
    low = F.when((F.col("n") <= SMALL) | F.lit(share <= 1e-3), -far).otherwise(F.col("at")[0])
    high = F.when((F.col("n") <= SMALL) | F.lit(share >= 1 - 1e-3), far).otherwise(F.col("at")[1])
    met = v.hint("merge").join(ends.select("scene_id", (share * (F.col("n") - 1)).alias("rank"), low.alias("low"), high.alias("high")), "scene_id").where("v <= high")
    each = met.groupBy("scene_id", "rank", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("scene_id").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = each.withColumn("upto", F.sum("n").over(order)).where("v is not null")
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    found = upto.groupBy("scene_id", "rank").agg(first(F.floor("rank")).alias("a"), first(F.ceil("rank")).alias("b"))
    return found.select("scene_id", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))).alias("q"))


def quantile(values: np.ndarray, share: float) -> float:
    """The same quantile of an array that is not empty."""
    rank = share * (len(values) - 1)
    low = math.floor(rank)
    at = np.partition(values, sorted({low, math.ceil(rank)}))
    return float(at[low] + (at[math.ceil(rank)] - at[low]) * (rank - low))


def by_size(scenes: DataFrame, tile: int) -> tuple[DataFrame, DataFrame, bool]:
    """Scenes (scene_id, rows, cols), each once: those that one tile holds, larger ones, and whether there are any of these."""
    each = scenes.where("scene_id is not null and rows > 0 and cols > 0").groupBy("scene_id").agg(F.max("rows").cast("int").alias("rows"), F.max("cols").cast("int").alias("cols"))
    fits = (F.col("rows") <= tile) & (F.col("cols") <= tile)
    large = each.where(~fits)
    return each.where(fits), large, not large.isEmpty()


def by_scene(pixels: DataFrame, small: DataFrame, values: list[str], kernel: Callable[..., dict[str, np.ndarray] | None], out: str) -> DataFrame:
    """(scene_id, out): kernel's columns for each scene of small, all within one tile; many scenes in one call.

    The kernel gets rows, cols and the columns r, c and values of the scene's pixels inside it; of these r and c are never null.
    """
    head = small.select("scene_id", (-F.col("rows")).alias("r"), F.col("cols").alias("c"), *(F.lit(None).cast(pixels.schema[v].dataType).alias(v) for v in values))
    own = pixels.where("scene_id is not null and r >= 0 and c >= 0").select("scene_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *values)
    kind, names = small.schema["scene_id"].dataType.simpleString(), [x.split()[0] for x in out.split(", ")]

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["scene_id"]):
            columns = {x: t[x].to_numpy() for x in ("r", "c", *values)}
            sizes = np.flatnonzero(columns["r"] < 0)
            known = np.searchsorted(at, sizes, side="right") - 1
            made, first = [], []
            for a, b, size in zip(at[known], np.append(at[1:], t.num_rows)[known], sizes, strict=True):
                rows, cols = -int(columns["r"][size]), int(columns["c"][size])
                r = columns["r"][a:b]
                inside = a + np.flatnonzero((r >= 0) & (r < rows) & (columns["c"][a:b] < cols))
                if (found := kernel(rows, cols, *(columns[x][inside] for x in ("r", "c", *values)))) is not None:
                    made.append(found)
                    first.append(np.full(len(found[names[0]]), a))
            if made:
                scene = t["scene_id"].combine_chunks().take(pa.array(np.concatenate(first)))
                rest = [pa.array(np.concatenate([m[x] for m in made]), from_pandas=True) for x in names]
                yield pa.RecordBatch.from_arrays([scene, *rest], ["scene_id", *names])

    sent = head.union(own).repartition("scene_id").sortWithinPartitions("scene_id")
    return sent.mapInArrow(many, f"scene_id {kind}, {out}")


def dealt(scenes: DataFrame) -> DataFrame:
    """Scenes in many tasks: they are few bytes, which one task would read, and many pixels once their places are told."""
    return scenes.repartition(4 * scenes.sparkSession.sparkContext.defaultParallelism, "scene_id")


def raster(pixels: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene_id, r, c, db): each place of each scene once, db null without data; of repeated pixels the brightest.

    Pixels outside their scene or without one are left out.
    """
    part = lambda x: F.floor(F.col(x) / TILE).cast("int")
    size = scenes.where("scene_id is not null and rows > 0 and cols > 0").groupBy("scene_id").agg(F.max("rows").cast("int").alias("rows"), F.max("cols").cast("int").alias("cols"))
    tiles = lambda x: F.explode(F.sequence(F.lit(0), F.floor((F.col(x) - 1) / TILE).cast("int")))
    # a tile begins with a row of its scene's size; tiles of pixels without one lie outside
    heads = size.withColumn("tr", tiles("rows")).withColumn("tc", tiles("cols")).select("scene_id", "tr", "tc", (-F.col("rows")).alias("r"), F.col("cols").alias("c"), F.lit(None).cast("double").alias("db"))
    own = pixels.where((F.col("r") >= 0) & (F.col("c") >= 0)).select("scene_id", part("r").alias("tr"), part("c").alias("tc"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("db").cast("double").alias("db"))
    keys, kind = ["scene_id", "tr", "tc"], size.schema["scene_id"].dataType.simpleString()

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, keys):
            r, c, db, tr, tc = (t[x].to_numpy() for x in ("r", "c", "db", "tr", "tc"))
            made = []
            for a, b in zip(at, np.append(at[1:], t.num_rows), strict=True):
                size = a + np.flatnonzero(r[a:b] < 0)
                if not len(size):
                    continue
                top, left = int(tr[a]) * TILE, int(tc[a]) * TILE
                high, wide = min(TILE, -int(r[size[0]]) - top), min(TILE, int(c[size[0]]) - left)
                y, x = r[a:b] - top, c[a:b] - left
                inside = np.flatnonzero((r[a:b] >= 0) & (y < high) & (x < wide) & np.isfinite(db[a:b]) & (db[a:b] != 0))
                held = np.full(high * wide, -np.inf)
                np.maximum.at(held, y[inside] * wide + x[inside], db[a:b][inside])
                place = np.arange(high * wide)
                made.append((np.full(high * wide, a), place // wide + top, place % wide + left, held))
            if made:
                first, y, x, held = (np.concatenate(m) for m in zip(*made, strict=True))
                scene = t["scene_id"].combine_chunks().take(pa.array(first))
                yield pa.RecordBatch.from_arrays([scene, pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(held, mask=held == -np.inf)], [*KEYS, "db"])

    sent = heads.union(own).repartition(*keys).sortWithinPartitions(*keys)
    return sent.mapInArrow(many, f"scene_id {kind}, r int, c int, db double")


def over_tiles(pixels: DataFrame, scenes: DataFrame, reach: int, kernel: Callable[[np.ndarray], np.ndarray], tile: int = TILE, missing: float = 0.0) -> DataFrame:
    """(scene_id, r, c, v): kernel's values, but those not a number and, where missing is zero, zeros.

    pixels: (scene_id, r, c, v). The kernel gets a tile's values and those up to `reach` beyond it, cut
    at the scene's sides, and returns as many; its result may depend on values within `reach` only.
    """
    size = scenes.groupBy("scene_id").agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"))
    spread = lambda x, most: F.explode(F.sequence(F.greatest(F.floor((F.col(x) - reach) / tile), F.lit(0)), F.least(F.floor((F.col(x) + reach) / tile), F.floor((F.col(most) - 1) / tile))))
    sent = pixels.hint("merge").join(size, "scene_id").withColumn("tr", spread("r", "rows")).withColumn("tc", spread("c", "cols"))
    kind = pixels.schema["scene_id"].dataType.simpleString()

    def one(rows: int, cols: int, tr: int, tc: int, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
        top, left = tr * tile, tc * tile
        r0, c0 = max(top - reach, 0), max(left - reach, 0)
        r1, c1 = min(top + tile + reach, rows), min(left + tile + reach, cols)
        held = np.full((r1 - r0, c1 - c0), missing)
        held[r - r0, c - c0] = v
        own = np.asarray(kernel(held), dtype=float)[top - r0 : top - r0 + tile, left - c0 : left - c0 + tile]
        r, c = np.nonzero(~np.isnan(own) & ((own != 0) | (missing != 0)))
        return r + top, c + left, own[r, c]

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["scene_id", "tr", "tc"]):
            x = [t[k].to_numpy() for k in ("rows", "cols", "tr", "tc", "r", "c", "v")]
            made = [one(*(int(k[a]) for k in x[:4]), *(k[a:b] for k in x[4:])) for a, b in zip(at, np.append(at[1:], t.num_rows), strict=True)]
            r, c, v = (np.concatenate(m) for m in zip(*made, strict=True))
            scene = t["scene_id"].combine_chunks().take(pa.array(np.repeat(at, [len(m[0]) for m in made])))
            yield pa.RecordBatch.from_arrays([scene, pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(v)], [*KEYS, "v"])

    # a window leaves a tile's rows side by side, and needs no further shuffle after the join by scene; so many small tiles are one call
    beside = Window.partitionBy("scene_id", "tr", "tc")
    return sent.select(*KEYS, "rows", "cols", "tr", "tc", F.col("v").cast("double").alias("v"), F.count("*").over(beside).alias("n")).mapInArrow(many, f"scene_id {kind}, r int, c int, v double")


def _cross(mask: np.ndarray, grow: bool) -> np.ndarray:
    """One step up, down and aside: what is set grows, or what is not, the outside among it."""
    wide = np.pad(mask, 1)
    near = (wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:])
    return np.logical_or.reduce(near) if grow else np.logical_and.reduce(near)


def grown(mask: np.ndarray, steps: int, grow: bool = True) -> np.ndarray:
    for _ in range(steps):
        mask = _cross(mask, grow)
    return mask


def _marked(mask: DataFrame) -> DataFrame:
    return mask.select(*KEYS, F.lit(1.0).alias("v"))


def dilated(mask: DataFrame, scenes: DataFrame, steps: int, tile: int = TILE) -> DataFrame:
    """The set pixels (scene_id, r, c) and all within so many steps up, down and aside."""
    return over_tiles(_marked(mask), scenes, steps, lambda a: grown(a > 0, steps), tile).select(*KEYS)


def mirrored_mean(a: np.ndarray, window: int) -> np.ndarray:
    """Mean of the centred square, mirrored at the sides."""
    half = window // 2
    return box_mean(np.pad(a, half, mode="symmetric"), window)[half : half + a.shape[0], half : half + a.shape[1]]


def local_means(full: DataFrame, scenes: DataFrame, window: int = SEA_WINDOW, tile: int = TILE) -> DataFrame:
    """(scene_id, r, c, v): mean of the centred square by sums of sums, mirrored at the scene's sides; no data counts as the scene's median.

    full: a raster. A scene without any data has no rows.
    """
    median = quantiles(full.select("scene_id", F.col("db").alias("v")), 0.5, scenes)
    whole = full.hint("merge").join(median, "scene_id").select(*KEYS, F.coalesce("db", "q").alias("v"))
    half = window // 2
    return over_tiles(whole, scenes, half, lambda a: mirrored_mean(a, window), max(tile, half + 1), missing=np.nan)


def filled_holes(mask: DataFrame, full: DataFrame, scenes: DataFrame, tile: int = TILE) -> DataFrame:
    """The set pixels and those from which no way of steps up, down and aside over unset ones leads to a side of the scene."""
    outside = labelled(full.select(*KEYS).hint("merge").join(mask, KEYS, "left_anti"), tile, diagonal=False)
    side = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == F.col("rows") - 1) | (F.col("c") == F.col("cols") - 1)
    open_ = outside.hint("merge").join(scenes, "scene_id").where(side).select("scene_id", "label").distinct()
    holes = outside.hint("merge").join(open_, ["scene_id", "label"], "left_anti").select(*KEYS)
    return mask.select(*KEYS).union(holes)


def land_mask(full: DataFrame, means: DataFrame, sea: DataFrame, scenes: DataFrame, pixel_km2: float, above_db: float = LAND_DB, close: int = LAND_CLOSE, least_km2: float = LAND_KM2, steps: int = LAND_STEPS, tile: int = TILE) -> DataFrame:
    """(scene_id, r, c) of land: local means far above the sea, and no data; closed, filled, without small ones, grown.

    Closing counts what lies outside the scene as unset. Pieces of land touch by their sides.
    """
    rated = full.hint("merge").join(means, KEYS, "left").join(sea.hint("merge"), "scene_id", "left")
    high = rated.where(F.col("db").isNull() | (F.col("v") > F.col("sea_db") + above_db))
    shut = staged(over_tiles(_marked(high), scenes, 2 * close, lambda a: grown(grown(a > 0, close), close, grow=False), tile).select(*KEYS), "closed")
    whole = labelled(filled_holes(shut, full, scenes, tile), tile, diagonal=False)
    large = whole.groupBy("scene_id", "label").agg(F.count("*").alias("n")).where(F.col("n") * pixel_km2 >= least_km2)
    kept = whole.hint("merge").join(large, ["scene_id", "label"], "left_semi")
    return dilated(kept, scenes, steps, tile)


def _prepared(rows: int, cols: int, r: np.ndarray, c: np.ndarray, db: np.ndarray, pixel_km2: float, window: int, bright_db: float, bright_steps: int, above_db: float, close: int, least_km2: float, land_steps: int) -> dict[str, np.ndarray]:  # noqa: PLR0913
    """The steps of ``prepare`` on one scene within a tile."""
    ok = np.isfinite(db) & (db != 0)
    full = np.full((rows, cols), -np.inf)
    np.maximum.at(full, (r[ok], c[ok]), db[ok])
    data = full > -np.inf
    sea, high = np.nan, ~data
    if data.any():
        means = mirrored_mean(np.where(data, full, quantile(full[data], 0.5)), window)
        sea = quantile(means[data], SEA_SHARE)
        high = high | (means > sea + above_db)
    shut = grown(grown(high, close), close, grow=False)
    outside = label_components(~shut, diagonal=False)
    open_ = np.zeros(int(outside.max(initial=0)) + 1, bool)
    for side in (outside[0], outside[-1], outside[:, 0], outside[:, -1]):
        open_[side] = True
    open_[0] = False
    whole = label_components(~open_[outside], diagonal=False)
    large = np.bincount(whole.ravel()) * pixel_km2 >= least_km2
    large[0] = False
    land = grown(large[whole], land_steps)
    bright = grown(data & (full > bright_db), bright_steps)
    valid = data & ~bright & ~land
    y, x = np.divmod(np.arange(rows * cols, dtype=np.int32), np.int32(cols))
    return {"r": y, "c": x, "filled": np.where(valid, full, sea).ravel(), "valid": valid.ravel(), "land": land.ravel(), "sea_db": np.full(rows * cols, sea)}


def prepare(pixels: DataFrame, scenes: DataFrame, pixel_km2: float, window: int = SEA_WINDOW, bright_db: float = BRIGHT_DB, bright_steps: int = BRIGHT_STEPS, above_db: float = LAND_DB, close: int = LAND_CLOSE, least_km2: float = LAND_KM2, land_steps: int = LAND_STEPS, coast: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """(scene_id, r, c, filled, valid, land, sea_db) of each place of each scene.

    sea_db is the 20th percentile of local means where there is data. Bright points grow by a few
    steps. A place is valid with data, away from bright points and land; others take the sea's level.
    Scenes that one tile holds are prepared whole, many in one call, larger ones over tiles.
    coast: (scene_id, r, c) of land known from elsewhere, as it is. A scene without data is all land, with a null level.
    """
    small, large, some = by_size(scenes, tile)
    kernel = lambda rows, cols, r, c, db: _prepared(rows, cols, r, c, db, pixel_km2, window, bright_db, bright_steps, above_db, close, least_km2, land_steps)
    each = by_scene(pixels.withColumn("db", F.col("db").cast("double")), small, ["db"], kernel, "r int, c int, filled double, valid boolean, land boolean, sea_db double")
    if coast is not None:
        land = coast.select(*KEYS, F.lit(True).alias("coast")).distinct().hint("merge")
        each = each.join(land, KEYS, "left").withColumns({"filled": F.when(F.col("coast"), F.col("sea_db")).otherwise(F.col("filled")), "valid": F.col("valid") & F.col("coast").isNull(), "land": F.col("land") | F.col("coast").isNotNull()}).drop("coast")
    if not some:
        return each
    of = pixels.join(large.select("scene_id").hint("merge"), "scene_id", "left_semi")
    return each.union(_prepared_over_tiles(of, large, pixel_km2, window, bright_db, bright_steps, above_db, close, least_km2, land_steps, coast, tile))


def _prepared_over_tiles(pixels: DataFrame, scenes: DataFrame, pixel_km2: float, window: int, bright_db: float, bright_steps: int, above_db: float, close: int, least_km2: float, land_steps: int, coast: DataFrame | None, tile: int) -> DataFrame:  # noqa: PLR0913
    full = staged(raster(pixels, scenes), "raster")
    means = staged(local_means(full, scenes, window, tile), "means")
    with_data = full.where("db is not null")
    sea = staged(quantiles(with_data.hint("merge").join(means, KEYS).select("scene_id", "v"), SEA_SHARE).withColumnRenamed("q", "sea_db"), "sea")
    bright = dilated(with_data.where(F.col("db") > bright_db), scenes, bright_steps, tile)
    land = land_mask(full, means, sea, scenes, pixel_km2, above_db, close, least_km2, land_steps, tile)
    land = land if coast is None else land.union(coast.select(*KEYS)).distinct()
    flag = lambda m, name: m.select(*KEYS, F.lit(True).alias(name)).hint("merge")
    each = full.join(flag(bright, "bright"), KEYS, "left").join(flag(land, "land"), KEYS, "left").join(sea.hint("merge"), "scene_id", "left")
    each = each.withColumns({"bright": F.coalesce("bright", F.lit(False)), "land": F.coalesce("land", F.lit(False))})
    valid = F.col("db").isNotNull() & ~F.col("bright") & ~F.col("land")
    return each.select(*KEYS, F.when(valid, F.col("db")).otherwise(F.col("sea_db")).alias("filled"), valid.alias("valid"), "land", "sea_db")


def _closed_square(a: np.ndarray) -> np.ndarray:
    """Closing by 3 x 3; what lies outside neither adds nor removes."""
    for seed, join in ((False, np.logical_or), (True, np.logical_and)):
        wide = np.pad(a, 1, constant_values=seed)
        a = join.reduce([wide[y : y + a.shape[0], x : x + a.shape[1]] for y in range(3) for x in range(3)])
    return a


def merged_contacts(found: DataFrame, reach: Column | float) -> DataFrame:
    """Contacts (scene_id, label, r, c, px_area, peak_db) with those near a brighter one taken into it.

    From the brightest on, a contact that no kept one reaches is kept, and others give their pixels to
    the brightest kept one in reach; equal peaks go by label. Rounds keep what outshines all undecided
    neighbours at once, so that no scene is gone through one by one. Neighbours meet in cells.
    """
    f = staged(found.withColumn("reach", (reach if isinstance(reach, Column) else F.lit(float(reach))).cast("double")), "contacts")
    cell = lambda x: F.floor(F.col(x) / F.col("reach"))
    at = f.select("scene_id", "label", "r", "c", "peak_db", "reach", cell("r").alias("y"), cell("c").alias("x"))
    beside = lambda x: F.explode(F.sequence(F.col(x) - 1, F.col(x) + 1))
    other = at.select("scene_id", F.col("label").alias("over"), F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("peak_db").alias("peak2"), F.col("y"), F.col("x"))
    met = at.withColumn("y", beside("y")).withColumn("x", beside("x")).join(other.hint("merge"), ["scene_id", "y", "x"])
    brighter = (F.col("peak2") > F.col("peak_db")) | ((F.col("peak2") == F.col("peak_db")) & (F.col("over") < F.col("label")))
    links = staged(met.where(brighter & (F.hypot(F.col("r") - F.col("r2"), F.col("c") - F.col("c2")) <= F.col("reach"))).select("scene_id", "label", "over", "peak2"), "links")
    open_, heads = staged(f.select("scene_id", "label"), "open"), None
    while not open_.isEmpty():
        waiting = links.join(open_.withColumnRenamed("label", "over"), ["scene_id", "over"], "left_semi").select("scene_id", "label")
        new = open_.join(waiting, ["scene_id", "label"], "left_anti")
        heads = staged(new if heads is None else heads.union(new), "heads")
        taken = links.join(heads.withColumnRenamed("label", "over"), ["scene_id", "over"], "left_semi").select("scene_id", "label")
        open_ = staged(open_.join(heads, ["scene_id", "label"], "left_anti").join(taken, ["scene_id", "label"], "left_anti"), "open")
    if heads is None:
        return f.drop("reach")
    to = links.join(heads.withColumnRenamed("label", "over"), ["scene_id", "over"], "left_semi").groupBy("scene_id", "label").agg(F.min(F.struct((-F.col("peak2")).alias("p"), "over")).alias("m"))
    given = f.join(to, ["scene_id", "label"], "left").groupBy("scene_id", F.coalesce("m.over", "label").alias("label")).agg(F.sum("px_area").alias("px_area"))
    return f.drop("px_area", "reach").join(given, ["scene_id", "label"]).select("scene_id", "label", "r", "c", "px_area", "peak_db")


def ships(pixels: DataFrame, scenes: DataFrame, pixel_m: float, exclude: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """(scene_id, label, r, c, px_area, peak_db): bright compact regions outside `exclude` (scene_id, r, c), near ones merged.

    A pixel is bright above -10 dB and four robust deviations over the scene's median, both over pixels
    with data that are not excluded. Bright ones are closed by 3 x 3, so that one dim pixel parts no hull; regions of 4 to 4000
    pixels that fill a fifth of their box count. label is a region's first pixel in row order.
    """
    own = staged(raster(pixels, scenes).where("db is not null"), "sea")
    full = own if exclude is None else staged(own.join(exclude.select(*KEYS).hint("merge"), KEYS, "left_anti"), "kept")
    median = quantiles(full.select("scene_id", F.col("db").alias("v")), 0.5, scenes).withColumnRenamed("q", "med")
    apart = full.hint("merge").join(median, "scene_id").select("scene_id", "med", F.abs(F.col("db") - F.col("med")).alias("v"))
    level = quantiles(apart, 0.5, scenes).join(median, "scene_id").select("scene_id", F.greatest(F.lit(SHIP_DB), F.col("med") + SHIP_MADS * 1.4826 * F.col("q")).alias("cut"))
    bright = staged(full.hint("merge").join(level, "scene_id").where("db > cut").select(*KEYS, "db"), "bright")
    # a region holds a bright pixel, which is its peak unless excluded ones lie in it
    lit = bright if exclude is None else own
    shut = over_tiles(_marked(bright), scenes, 2, lambda a: _closed_square(a > 0), tile).select(*KEYS)
    whole = labelled(shut, tile).hint("merge").join(lit, KEYS, "left")
    box = (F.max("r") - F.min("r") + 1) * (F.max("c") - F.min("c") + 1)
    each = whole.groupBy("scene_id", "label").agg(F.avg("r").alias("r"), F.avg("c").alias("c"), F.count("*").alias("px_area"), F.max("db").alias("peak_db"), (F.count("*") / box).alias("fill"))
    kept = each.where(F.col("px_area").between(SHIP_LEAST, SHIP_MOST) & (F.col("fill") >= SHIP_FILL)).drop("fill")
    return merged_contacts(kept, max(SHIP_MERGE_M / pixel_m, 1.0))
