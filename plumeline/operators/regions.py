"""Connected regions of scenes of any size: labels inside tiles, joined over the tiles' borders.

Scenes are rows of set pixels (scene_id, r, c). A task holds one tile; what regions of different tiles
have in common is a table of links, which alternating large and small stars contract.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .image import TILE

#: A pixel's place in row order as one number.
_ROW = 1 << 32


def _place(r: Column, c: Column) -> Column:
    return r.cast("long") * _ROW + c


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("scene_id", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def contracted(links: DataFrame) -> DataFrame:
    """(scene_id, node, root): the least node that each node of links (scene_id, a, b) reaches.

    Each round turns links to the least neighbour seen so far, which takes about as many rounds as the
    logarithm of the longest path. A hub's neighbours are joined to its least one, never gathered.
    Every round is a written table.
    """
    e = links.select("scene_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e, before = staged(e, "links"), None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("scene_id", "u", "v").cast("decimal(38,0)"))).first())
        if not now[0] or now == before:
            return e.select("scene_id", F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = e.union(e.select("scene_id", F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.hint("merge").join(_least(both), ["scene_id", "u"]).where("v > u").select("scene_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least(large)
        small = large.hint("merge").join(low, ["scene_id", "u"]).where("v <> m").select("scene_id", F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.union(low.select("scene_id", "u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")


def _turns(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are alike, and so is what is not a number."""
    x = column.combine_chunks()
    if pa.types.is_nested(x.type):
        v = x.to_pylist()
        return np.array([a != b for a, b in zip(v[1:], v[:-1], strict=True)], bool)
    a, b = x[1:], x[:-1]
    told = pc.not_equal(a, b).fill_null(False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(x.type):
        nan = lambda y: pc.is_nan(y).fill_null(False).to_numpy(zero_copy_only=False)
        told = told & ~(nan(a) & nan(b))
    void = x.is_null().to_numpy(zero_copy_only=False)
    return told | (void[1:] != void[:-1])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the place where each begins, of batches whose rows are sorted by keys: one call of Python for many small groups."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        now = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
        at = np.append(0, np.flatnonzero(np.logical_or.reduce([_turns(now[k]) for k in keys])) + 1)
        if len(at) > 1:
            yield now[: at[-1]], at[:-1]
        rest = now[at[-1] :]
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def joined_places(group: np.ndarray, r: np.ndarray, c: np.ndarray, tile: int, diagonal: bool = True) -> np.ndarray:
    """For each distinct place of a tile (group, r, c), the index of the first place in row order that it is joined to inside its tile."""
    wide = tile + 2
    code = (group * wide + r % tile) * wide + c % tile
    order = np.argsort(code)
    code = code[order]
    a, b = [], []
    for move in (1, wide, *((wide - 1, wide + 1) if diagonal else ())):
        at = np.minimum(np.searchsorted(code, code + move), len(code) - 1)
        met = np.flatnonzero(code[at] == code + move)
        a.append(met)
        b.append(at[met])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(code))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    out = np.empty(len(code), np.int64)
    out[order] = order[root]
    return out


def labelled(mask: DataFrame, tile: int = TILE, diagonal: bool = True) -> DataFrame:
    """(scene_id, r, c, label) of the set pixels (scene_id, r, c): pixels of one label touch, by sides or, where diagonal, corners.

    A label is the place of its region's first pixel in row order, r * 2^32 + c. A tile is labelled on its
    own, many tiles in one call; each pixel at a tile's border that touches a set pixel of another tile links two tiles' labels.
    Pixels may repeat; those without a scene or a place are left out. A scene without pixels has no rows.
    """
    pixels = mask.select("scene_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).where("scene_id is not null and r is not null and c is not null")
    kind = pixels.schema["scene_id"].dataType.simpleString()
    tiles = ["scene_id", "tr", "tc"]

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, tiles):
            r, c = t["r"].to_numpy(), t["c"].to_numpy()
            group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(r))))
            first = joined_places(group, r, c, tile, diagonal)
            yield from t.select(["scene_id", "r", "c"]).append_column("own", pa.array((r * _ROW + c)[first])).combine_chunks().to_batches()

    keyed = pixels.select("*", F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc")).repartition(*tiles).distinct()
    local = staged(keyed.sortWithinPartitions(*tiles).mapInArrow(many, f"scene_id {kind}, r long, c long, own long"), "local")
    row, column = F.pmod("r", F.lit(tile)), F.pmod("c", F.lit(tile))
    border = local.where(row.isin(0, tile - 1) | column.isin(0, tile - 1))
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, 0), *(((1, -1), (1, 1)) if diagonal else ())))))
    to = border.withColumn("o", moves).select("scene_id", "own", "r", "c", (F.col("r") + F.col("o.dr")).alias("r2"), (F.col("c") + F.col("o.dc")).alias("c2"))
    to = to.where((F.floor(F.col("r") / tile) != F.floor(F.col("r2") / tile)) | (F.floor(F.col("c") / tile) != F.floor(F.col("c2") / tile)))
    met = to.select("scene_id", F.col("own").alias("a"), F.col("r2").alias("r"), F.col("c2").alias("c")).join(border.withColumnRenamed("own", "b").hint("merge"), ["scene_id", "r", "c"])
    roots = contracted(met.select("scene_id", "a", "b").distinct()).withColumnRenamed("node", "own")
    return local.hint("merge").join(roots, ["scene_id", "own"], "left").select("scene_id", "r", "c", F.coalesce("root", "own").alias("label"))


def held(weak: DataFrame, strong: DataFrame, tile: int = TILE) -> DataFrame:
    """Labelled pixels of the weak regions that hold a strong pixel; both are (scene_id, r, c)."""
    labels = labelled(weak, tile)
    keys = ["scene_id", "r", "c"]
    keep = labels.hint("merge").join(strong.select(*keys).distinct(), keys, "left_semi").select("scene_id", "label").distinct()
    return labels.hint("merge").join(keep, ["scene_id", "label"], "left_semi").select(*keys, "label")


def region_figures(labels: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(scene_id, label, n_px, r0, r1, c0, c1, r, c, elongation, fill[, mean, low]) of each region.

    Elongation is the ratio of the axes of the ellipse with the region's second moments, each held at that
    of a single pixel; fill is the share of its box. With values (scene_id, r, c, db), the mean and the
    least of the region's own values; pixels without one count for the shape alone. Sums only, before the shuffle.
    """
    keys = ["scene_id", "r", "c"]
    rows = labels if values is None else labels.join(values.select(*keys, "db").hint("merge"), keys, "left")
    each = rows.groupBy("scene_id", "label").agg(
        F.count("*").alias("n_px"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.avg("r").alias("r"), F.avg("c").alias("c"),
        F.var_pop("r").alias("vr"), F.var_pop("c").alias("vc"), F.covar_pop("r", "c").alias("vrc"), *([] if values is None else [F.avg("db").alias("mean"), F.min("db").alias("low")]),
    )
    half, apart = (F.col("vr") + F.col("vc")) / 2, F.hypot((F.col("vr") - F.col("vc")) / 2, F.col("vrc"))
    axis = lambda x: F.sqrt(F.greatest(x, F.lit(1 / 12)))
    box = (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)
    return each.withColumn("elongation", axis(half + apart) / axis(half - apart)).withColumn("fill", F.col("n_px") / box).drop("vr", "vc", "vrc")
