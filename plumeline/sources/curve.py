"""Position extracts along a space-filling curve, and reads of boxes that open only the parts they need."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16  # of each axis
_SHAPE = "_columns"  # readers of the extract pass over names with an underscore
WORLD = (-180.0, -90.0, 180.0, 90.0)


def _spread(v: Column) -> Column:
    """The sixteen bits of v on the even places of thirty-two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def _step(low: float, high: float) -> float:
    return (1 << BITS) / (high - low)


def _cell(value: float, low: float, high: float) -> int:
    return int(min(max(math.floor((value - low) * _step(low, high)), 0), (1 << BITS) - 1))


def curve_key(lon: Column, lat: Column, extent: tuple[float, float, float, float] = WORLD) -> Column:
    """Place on a Z-shaped curve over the extent; what lies outside goes to the nearest edge, null and NaN are null."""

    def cell(v: Column, low: float, high: float) -> Column:
        v = F.nanvl(v.cast("double"), F.lit(None).cast("double"))
        return F.least(F.greatest(F.floor((v - F.lit(float(low))) * F.lit(_step(low, high))), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")

    west, south, east, north = extent
    return F.when(lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon.cast("double")) & ~F.isnan(lat.cast("double")), _spread(cell(lon, west, east)).bitwiseOR(F.shiftleft(_spread(cell(lat, south, north)), 1)))


def ranges_of_box(west: float, south: float, east: float, north: float, extent: tuple[float, float, float, float] = WORLD, most: int = 64) -> list[tuple[int, int]]:
    """Stretches of the curve, ends included, that together hold the box's cells.

    Squares are quartered from the whole extent down; one inside the box is taken, one outside left. When
    there are more than ``most``, those that the border still crosses are taken whole. A box whose west lies
    east of its east goes across the date line.
    """
    if not all(map(math.isfinite, (west, south, east, north))) or south > north:
        return []
    if west > east:
        return _merged(ranges_of_box(west, south, max(west, extent[2]), north, extent, most) + ranges_of_box(min(east, extent[0]), south, east, north, extent, most))
    x0, x1 = _cell(west, extent[0], extent[2]), _cell(east, extent[0], extent[2])
    y0, y1 = _cell(south, extent[1], extent[3]), _cell(north, extent[1], extent[3])
    whole, crossed, size = [], [(0, 0, 0)], 1 << BITS
    while crossed and size > 1 and len(whole) + 4 * len(crossed) <= most + 3:
        size //= 2
        nxt = []
        for x, y, key in crossed:
            for part in range(4):
                a, b, k = x + (part & 1) * size, y + (part >> 1) * size, key + part * size * size
                if a > x1 or b > y1 or a + size - 1 < x0 or b + size - 1 < y0:
                    continue
                inside = a >= x0 and b >= y0 and a + size - 1 <= x1 and b + size - 1 <= y1
                (whole if inside else nxt).append((k, k + size * size - 1) if inside else (a, b, k))
        crossed = nxt
    return _merged(whole + [(k, k + size * size - 1) for _, _, k in crossed])


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def write_by_place(positions: DataFrame, path: str, *, extent: tuple[float, float, float, float] = WORLD, zone_bits: int = 8, most_rows: int = 5_000_000) -> None:
    """An extract in folders of the curve's leading bits, each file a stretch of the curve, with time breaking ties.

    Rows of one place are parted by time and vessel, so a crowded place is no single task. Extent and bits
    are written with the key column. Rows without a place are kept, in a folder that no box opens. The
    columns curve_key and curve_zone are made here; columns of these names are replaced.
    """
    if not 0 <= zone_bits <= 2 * BITS:
        raise ValueError(f"zone_bits must lie between 0 and {2 * BITS}")
    keyed = positions.drop("curve_key", "curve_zone").withColumn("curve_key", curve_key(F.col("lon"), F.col("lat"), extent))
    keyed = keyed.withColumn("curve_zone", F.shiftright("curve_key", 2 * BITS - zone_bits))
    held = {"extent": list(extent), "zone_bits": zone_bits}
    order = ["curve_zone", "curve_key", "ts", "mmsi"]
    parted = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withMetadata("curve_key", held)
    parted.write.mode("overwrite").option("maxRecordsPerFile", most_rows).partitionBy("curve_zone").parquet(path)
    positions.sparkSession.createDataFrame([], parted.schema).coalesce(1).write.parquet(f"{path}/{_SHAPE}")  # an extract without rows has no files that hold the columns


def read_boxes(spark: SparkSession, path: str, boxes: list[tuple[float, float, float, float]], most: int = 64) -> DataFrame:
    """Positions in any of some boxes (west, south, east, north; sides included), each row once.

    Folders are chosen while planning, row groups by the stretches of the curve that go to the scan as
    filters; the boxes themselves decide. No boxes, no rows.
    """
    kept = spark.read.schema(spark.read.parquet(f"{path}/{_SHAPE}").schema).parquet(path)
    held = kept.schema["curve_key"].metadata
    shift = 2 * BITS - int(held["zone_bits"])
    stretches = _merged([r for box in boxes for r in ranges_of_box(*box, extent=tuple(held["extent"]), most=most)])
    columns = [c for c in kept.columns if c not in ("curve_key", "curve_zone")]
    if not stretches:
        return kept.where("false").select(*columns)
    zones = _merged([(a >> shift, z >> shift) for a, z in stretches])
    either = lambda tests: tests[0] if len(tests) == 1 else either(tests[: len(tests) // 2]) | either(tests[len(tests) // 2 :])
    lon, lat = F.col("lon"), F.col("lat")

    def inside(west: float, south: float, east: float, north: float) -> Column:
        across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
        return across & lat.between(south, north)

    near = either([F.col("curve_zone").between(a, z) for a, z in zones]) & either([F.col("curve_key").between(a, z) for a, z in stretches])
    return kept.where(near).where(either([inside(*b) for b in boxes]) & ~F.isnan(lon) & ~F.isnan(lat)).select(*columns)
