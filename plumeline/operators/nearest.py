"""Nearest places: cells from coarse to fine, those too far to hold the nearest left out at each level.

A cell keeps the box of its own places and one of them. The box bounds a point's distance from below,
the one place from above, so a cell whose lower bound exceeds the least upper bound of all is left out.
Cells of few places are opened, others give way to their parts. No point meets all places of its case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km, wrap_lon
from ..sources.staging import staged

#: Bits of a cell's column and row, level by level: 5.6 degrees of longitude to 9 m.
LEVELS = (6, 10, 14, 18, 22)
#: A cell of so many places at most is opened.
LEAF = 32
#: Kilometres by which rounding may raise a lower bound over the distance that it bounds.
SLACK_KM = 1e-6


def _cell(bits: int) -> list[Column]:
    side = F.lit(float(1 << bits))
    return [F.floor((F.col("wlon") + 180) / 360 * side).alias("cx"), F.floor((F.col("vlat") + 90) / 180 * side).alias("cy")]


def _at_least_km(lon: Column, lat: Column) -> Column:
    """No more than the distance to any place in the box (w, s, e, n), whose sides do not cross 180 degrees."""
    middle, half = (F.col("w") + F.col("e")) / 2, (F.col("e") - F.col("w")) / 2
    aside = F.greatest(F.abs(wrap_lon(lon - middle)) - half, F.lit(0.0))
    up = F.greatest(F.col("s") - lat, lat - F.col("n"), F.lit(0.0))
    cos = F.cos(F.radians(lat)) * F.cos(F.radians(F.greatest(F.abs("s"), F.abs("n"))))
    root = F.sqrt(F.pow(F.sin(F.radians(up) / 2), 2) + cos * F.pow(F.sin(F.radians(aside) / 2), 2))
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), root)) - SLACK_KM


def nearest_pairs(points: DataFrame, vertices: DataFrame, keys: list[str], columns: list[str], leaf: int = LEAF) -> DataFrame:
    """(pid, keys, columns, d): the few vertices of its case that each point is held against, the nearest among them.

    keys and columns are structs of the named columns; every vertex at the least distance is there, of
    vertices at one place the least by its columns.
    """
    whole = lambda *names: F.expr(" and ".join(f"{n} is not null and not isnan({n})" for n in names))
    own = points.where(whole("lon", "lat")).select(F.monotonically_increasing_id().alias("pid"), "case_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.struct(*keys).alias("keys"))
    own = staged(own, "points")
    placed = vertices.where(whole("vlon", "vlat")).select("case_id", F.col("vlon").cast("double").alias("vlon"), F.col("vlat").cast("double").alias("vlat"), F.struct(*columns).alias("columns"))
    places = staged(placed.groupBy("case_id", "vlon", "vlat").agg(F.min("columns").alias("columns")).withColumn("wlon", wrap_lon("vlon")), "places")

    def cells(bits: int) -> DataFrame:
        by = places.select("case_id", "wlon", "vlat", *_cell(bits)).groupBy("case_id", "cx", "cy")
        one = F.min(F.struct("wlon", "vlat"))
        return by.agg(F.count("*").alias("n_in"), F.min("wlon").alias("w"), F.max("wlon").alias("e"), F.min("vlat").alias("s"), F.max("vlat").alias("n"), one.alias("one"))

    def bounded(met: DataFrame) -> DataFrame:
        lon, lat = F.col("lon"), F.col("lat")
        rated = met.withColumn("low", _at_least_km(lon, lat)).withColumn("high", F.least("best", haversine_km(lon, lat, F.col("one.wlon"), F.col("one.vlat"))))
        kept = rated.withColumn("best", F.min("high").over(Window.partitionBy("pid"))).where(F.col("low") <= F.col("best") + SLACK_KM)
        return kept.select("pid", "case_id", "lon", "lat", "keys", "best", "cx", "cy", "n_in")

    opened, front = None, own.withColumn("best", F.lit(float("inf"))).join(cells(LEVELS[0]), "case_id")
    for level, bits in enumerate(LEVELS):
        each, last = staged(bounded(front), "cells"), level + 1 == len(LEVELS)
        ready = each if last else each.where(F.col("n_in") <= leaf)
        inside = places.select("case_id", "vlon", "vlat", "columns", *_cell(bits))
        pairs = ready.join(inside, ["case_id", "cx", "cy"]).select("pid", "keys", "columns", haversine_km("lon", "lat", "vlon", "vlat").alias("d"))
        opened = pairs if opened is None else opened.union(pairs)
        wide = each.where(F.col("n_in") > leaf).select("pid", "case_id", "lon", "lat", "keys", "best", F.col("cx").alias("px"), F.col("cy").alias("py"))
        if last or wide.isEmpty():
            return opened
        step = LEVELS[level + 1] - bits
        parts = cells(LEVELS[level + 1]).withColumns({"px": F.shiftright("cx", step), "py": F.shiftright("cy", step)})
        front = wide.join(parts, ["case_id", "px", "py"])
    return opened


def nearest_vertex(points: DataFrame, vertices: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, near_km, columns): for each point (case_id, lon, lat) the nearest vertex (case_id, vlon, vlat) of its case.

    Equal distances go to the least by `columns`. Points of equal keys share the least of their
    distances. Points or vertices without a place or case take no part, a point in a case without
    vertices has no row; rows may repeat. Distances are great circles, over 180 degrees too.
    """
    least = nearest_pairs(points, vertices, keys, columns).groupBy("keys").agg(F.min(F.struct("d", "columns")).alias("m"))
    return least.select(*(F.col("keys")[k].alias(k) for k in keys), F.col("m.d").alias("near_km"), *(F.col("m.columns")[c].alias(c) for c in columns))
