"""Probability grids: binning, sampling, blur, radii, weighted statistics.

Cells are rows (r, c, p), row 0 in the north. Sampling spaces nodes by (rows - 1), binning spaces
cells by rows: the two conventions differ by half a cell and both are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG, degrees_to_metres, haversine_km


def cell_of(lon: Column, lat: Column, head: dict) -> tuple[Column, Column]:
    """Row and column of the nearest node of a grid with west, south, east, north, rows and cols; ties to even."""
    r = F.bround((F.lit(head["north"]) - lat) / (head["north"] - head["south"]) * (head["rows"] - 1), 0).cast("int")
    c = F.bround((lon - F.lit(head["west"])) / (head["east"] - head["west"]) * (head["cols"] - 1), 0).cast("int")
    return r, c


def contains(lon: Column, lat: Column, head: dict) -> Column:
    return lon.between(head["west"], head["east"]) & lat.between(head["south"], head["north"])


def sample(points: DataFrame, cells: DataFrame, head: dict, lon: str = "lon", lat: str = "lat", name: str = "p") -> DataFrame:
    """points with the grid's value at the nearest node, 0 outside: an equi join on the computed cell.

    A grid has rows x cols cells whatever the number of points; Spark sends it to all executors as
    long as it is small, and shuffles by cell otherwise.
    """
    inside = contains(F.col(lon), F.col(lat), head)
    r, c = cell_of(F.col(lon), F.col(lat), head)
    keyed = points.withColumn("_r", F.when(inside, r)).withColumn("_c", F.when(inside, c))
    grid = cells.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("p").alias("_p"))
    return keyed.join(grid, ["_r", "_c"], "left").withColumn(name, F.coalesce("_p", F.lit(0.0))).drop("_r", "_c", "_p")


def node_lonlat(r: Column, c: Column, head: dict) -> tuple[Column, Column]:
    lon = F.lit(head["west"]) + c * ((head["east"] - head["west"]) / (head["cols"] - 1))
    lat = F.lit(head["north"]) - r * ((head["north"] - head["south"]) / (head["rows"] - 1))
    return lon, lat


def peak(cells: DataFrame, head: dict) -> DataFrame:
    """(r, c, p, lon, lat) of the largest value, the first in row order on a tie."""
    top = cells.agg(F.max_by(F.struct("r", "c", "p"), F.struct("p", (-(F.col("r") * head["cols"] + F.col("c"))).alias("k"))).alias("m")).select("m.*")
    lon, lat = node_lonlat(F.col("r"), F.col("c"), head)
    return top.withColumn("lon", lon).withColumn("lat", lat)


def histogram2d(points: DataFrame, head: dict, weight: str | None = None) -> DataFrame:
    """(r, c, w): summed weights by cell, row 0 in the north; the last bin takes its right edge."""
    ny, nx = head["rows"], head["cols"]
    inside = points.where(contains(F.col("lon"), F.col("lat"), head))
    up = F.least(F.floor((F.col("lat") - head["south"]) / (head["north"] - head["south"]) * ny), F.lit(ny - 1))
    c = F.least(F.floor((F.col("lon") - head["west"]) / (head["east"] - head["west"]) * nx), F.lit(nx - 1))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return inside.groupBy((F.lit(ny - 1) - up).cast("int").alias("r"), c.cast("int").alias("c")).agg(F.sum(w).alias("w"))


def blur(cells: DataFrame, sigma: float, rows: int, cols: int, value: str = "w") -> DataFrame:
    """A separable Gaussian blur with radius 3 sigma and zeros beyond the edge, as two scatter sums."""
    radius = max(int(3 * sigma), 1)
    k = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    kernel = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(x / sum(k)).alias("k")) for d, x in zip(range(-radius, radius + 1), k, strict=True)))

    def one_way(df: DataFrame, axis: str, other: str, size: int) -> DataFrame:
        spread = df.select(other, (F.col(axis)).alias("_a"), value, F.explode(kernel).alias("_k"))
        spread = spread.select(other, (F.col("_a") + F.col("_k.d")).alias(axis), (F.col(value) * F.col("_k.k")).alias(value))
        return spread.where(F.col(axis).between(0, size - 1)).groupBy(axis, other).agg(F.sum(value).alias(value))

    return one_way(one_way(cells.select("r", "c", value), "c", "r", cols), "r", "c", rows)


def blur_sigma(r50_km: Column, head: dict, share: float = 0.10) -> Column:
    """Cells of blur for a cloud: a tenth of its r50, at least one, at most an eighth of the rows."""
    cell_km = max((head["north"] - head["south"]) / head["rows"] * KM_PER_DEG, 1e-9)
    return F.least(F.greatest(F.lit(1.0), r50_km * share / cell_km), F.lit(head["rows"] / 8.0))


def normalise_peak(cells: DataFrame, value: str = "w") -> DataFrame:
    """(r, c, p): values over their largest, four decimals; no rows where all are zero."""
    top = cells.agg(F.max(value).alias("_top")).where("_top > 0")
    return cells.crossJoin(F.broadcast(top)).select("r", "c", F.bround(F.col(value) / F.col("_top"), 4).alias("p"))


def centroid(points: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, clon, clat): mean position, weighted if a weight is named."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return points.groupBy(*keys).agg((F.sum(F.col("lon") * w) / F.sum(w)).alias("clon"), (F.sum(F.col("lat") * w) / F.sum(w)).alias("clat"))


def _cell(value: Column) -> Column:
    """A whole number that never falls as value grows: its logarithm to a 4096th, with its sign; nulls first, what is not a number last."""
    x = value.cast("double")
    steps = F.floor(F.ln(F.least(F.abs(x), F.lit(1.7e308))) * 4096) + 4_000_000
    return F.when(x.isNull(), F.lit(-(1 << 40))).when(F.isnan(x), F.lit(1 << 40)).when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * steps).cast("long")


def _ordered(df: DataFrame, keys: list[str], value: str, weight: Column, goals: Column) -> DataFrame:
    """(_k, name, goal, _x, _w, _n, _upto, _before): for each goal, the rows of the cell in which a group's running weight reaches it.

    goals: an array of (name, goal) by the group's sum `_t`. Equal rows are counted first; a cell holds values that are
    alike to a 4096th of their logarithm, and only cells with a goal are put in order, so no task takes a whole group.
    _upto is the running weight up to the row and its equals, _before the value before it.
    """
    each = df.select(F.struct(*keys).alias("_k"), F.col(value).alias("_x"), weight.alias("_w")).groupBy("_k", "_x", "_w").agg(F.count("*").alias("_n")).withColumn("_p", _cell(F.col("_x")))
    cells = each.groupBy("_k", "_p").agg(F.sum(F.col("_w") * F.col("_n")).alias("_s"), F.max("_x").alias("_last"))
    run = Window.partitionBy("_k").orderBy("_p")
    upto = cells.select("_k", "_p", "_s", F.sum("_s").over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.lag("_last").over(run).alias("_before"), F.sum("_s").over(Window.partitionBy("_k")).alias("_t"))
    reached = upto.withColumn("_g", F.explode(goals)).where(F.col("_upto") >= F.col("_g.goal"))
    first = F.row_number().over(Window.partitionBy("_k", "_g.name").orderBy("_p"))
    chosen = reached.withColumn("_1", first).where("_1 = 1").select("_k", "_p", "_g", (F.col("_upto") - F.col("_s")).alias("_under"), "_before")
    rows = each.hint("merge").join(chosen, ["_k", "_p"])
    order = Window.partitionBy("_k", "_g.name").orderBy("_x", "_w")
    sofar = F.col("_under") + F.sum(F.col("_w") * F.col("_n")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("_k", "_g.name", "_g.goal", "_x", "_w", "_n", sofar.alias("_upto"), F.coalesce(F.lag("_x").over(order), "_before").alias("_before"))


def _spread(found: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row a group of rows (_k, name, v)."""
    wide = found.groupBy("_k").agg(*(F.first(F.when(F.col("name") == x, F.col("v")), ignorenulls=True).alias(x) for x in names))
    return wide.select(*(F.col(f"_k.{k}").alias(k) for k in keys), *names)


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """(keys, names): where the running weight in order of value reaches a share, by linear interpolation.

    Below the first value's weight the first value holds.
    """
    goals = F.array(*(F.struct(F.lit(name).alias("name"), (F.col("_t") * share).cast("double").alias("goal")) for name, share in shares.items()))
    rows = _ordered(df, keys, value, F.coalesce(F.col(weight), F.lit(0)), goals)
    under = F.col("_upto") - F.col("_w") * F.col("_n")
    part = F.when((F.col("goal") - under > F.col("_w")) | F.col("_before").isNull(), F.col("_x")).otherwise(F.col("_before") + (F.col("goal") - under) / F.nullif(F.col("_w"), F.lit(0)) * (F.col("_x") - F.col("_before")))
    met = rows.withColumn("v", part).groupBy("_k", "name").agg(F.coalesce(F.min_by("v", F.when(F.col("_upto") >= F.col("goal"), F.struct("_x", "_w"))), F.max("_x")).alias("v"))
    return _spread(met, keys, list(shares))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, names): exact percentiles between ranks by their distance, of groups of any size; nulls don't count."""
    rank = {name: (F.col("_t") - 1) * F.lit(float(share)) for name, share in shares.items()}
    ends = [F.struct(F.lit(f"{name} {side}").alias("name"), (of(r) + 1).cast("double").alias("goal")) for name, r in rank.items() for side, of in (("low", F.floor), ("high", F.ceil))]
    rows = _ordered(df.where(F.col(value).isNotNull()), keys, value, F.lit(1).cast("long"), F.array(*ends))
    at = rows.where((F.col("_upto") >= F.col("goal")) & (F.col("_upto") - F.col("_n") < F.col("goal"))).withColumn("v", F.col("_x").cast("double"))
    n = df.where(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("_k")).agg(F.count("*").alias("_t"))
    wide = at.groupBy("_k").agg(*(F.first(F.when(F.col("name") == f"{x} {side}", F.col("v")), ignorenulls=True).alias(f"_{side}_{x}") for x in shares for side in ("low", "high"))).join(n, "_k")
    between = lambda x: F.col(f"_low_{x}") + (F.col(f"_high_{x}") - F.col(f"_low_{x}")) * (rank[x] - F.floor(rank[x]))
    return wide.select(*(F.col(f"_k.{k}").alias(k) for k in keys), *(between(x).alias(x) for x in shares))


def distance_from(points: DataFrame, centre: DataFrame, keys: list[str]) -> DataFrame:
    """points with d_km, their planar distance to their group's (clon, clat)."""
    both = points.join(centre, keys) if keys else points.crossJoin(F.broadcast(centre))
    dx, dy = degrees_to_metres(F.col("lon") - F.col("clon"), F.col("lat") - F.col("clat"), F.col("lat"))
    return both.withColumn("d_km", F.hypot(dx, dy) / 1000.0)


def radii(points: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, clon, clat, r50_km, r90_km): circles about the centroid that hold half and nine tenths."""
    centre = centroid(points, keys, weight)
    far = distance_from(points, centre, keys)
    if weight:
        return centre.join(weighted_percentile(far, keys, "d_km", weight, {"r50_km": 0.5, "r90_km": 0.9}), keys)
    p = far.groupBy(*keys, "clon", "clat").agg(F.percentile("d_km", F.array(F.lit(0.5), F.lit(0.9))).alias("p"))
    return p.select(*keys, "clon", "clat", F.col("p")[0].alias("r50_km"), F.col("p")[1].alias("r90_km"))


def rms_spread(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spread_km): root mean square distance to the group's own centroid."""
    return distance_from(points, centroid(points, keys), keys).groupBy(*keys).agg(F.sqrt(F.avg(F.col("d_km") * F.col("d_km"))).alias("spread_km"))


def mass_radius(cells: DataFrame, lon0: float, lat0: float, head: dict, share: float) -> DataFrame:
    """The distance from a point within which a share of the grid's mass lies."""
    lon, lat = node_lonlat(F.col("r"), F.col("c"), head)
    far = cells.withColumn("d_km", haversine_km(lon, lat, lon0, lat0))
    order = Window.orderBy("d_km", "r", "c").rowsBetween(Window.unboundedPreceding, 0)
    run = far.groupBy("d_km").agg(F.sum("p").alias("p"), F.min("r").alias("r"), F.min("c").alias("c")).withColumn("cum", F.sum("p").over(order))
    total = cells.agg(F.sum("p").alias("total"))
    return run.crossJoin(F.broadcast(total)).where(F.col("cum") >= share * F.col("total")).agg(F.min("d_km").alias("radius_km"))


def robust_scale(df: DataFrame, keys: list[str], value: str, floor: float = 1e-3) -> DataFrame:
    """(keys, med, mad): median, and 1.4826 times the median distance to it, held at a floor."""
    med = df.groupBy(*keys).agg(F.median(value).alias("med"))
    return df.join(med, keys).groupBy(*keys, "med").agg(F.greatest(F.median(F.abs(F.col(value) - F.col("med"))) * 1.4826, F.lit(floor)).alias("mad"))


def principal_axis(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, axis_deg, sd_major, sd_minor, n): the long axis of a point set in km, its bearing in [0, 180)."""
    a = points.groupBy(*keys).agg(F.var_samp(x).alias("sxx"), F.var_samp(y).alias("syy"), F.covar_samp(x, y).alias("sxy"), F.count("*").alias("n"))
    theta = F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2
    mid, half = (F.col("sxx") + F.col("syy")) / 2, F.hypot((F.col("sxx") - F.col("syy")) / 2, "sxy")
    return a.select(*keys, F.pmod(90.0 - F.degrees(theta), F.lit(180.0)).alias("axis_deg"), F.sqrt(mid + half).alias("sd_major"), F.sqrt(F.greatest(mid - half, F.lit(0.0))).alias("sd_minor"), "n")
