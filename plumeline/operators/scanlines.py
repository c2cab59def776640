"""Burning outlines by scan lines: edges go to the rows they cross, a row's crossings are sorted, the runs between them filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def burned(rings: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene_id, ring_id, r, c): pixels whose centre lies in a ring, by the parity of crossings to its east.

    rings: (scene_id, ring_id, ring), an array of (lon, lat), open or closed, which may cross itself.
    scenes: (scene_id, rows, cols, west, south, east, north), row 0 in the north. The work is a row for
    each edge and row of pixels it crosses and for each pixel set; no pixel meets a ring that isn't
    there. A centre on a left or lower side is inside, on a right or upper side outside. Rings of one id
    in a scene are one outline with holes where they overlap. Rings of fewer than three points, without
    a scene or with a point that lacks a coordinate set nothing.
    """
    usable = F.col("ring").isNotNull() & (F.size("ring") >= 3) & F.forall("ring", lambda p: p.isNotNull() & p["lon"].isNotNull() & p["lat"].isNotNull() & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"]))
    size = scenes.where("scene_id is not null and rows > 0 and cols > 0 and east > west and north > south").dropDuplicates(["scene_id"])
    high, wide = (F.col("north") - F.col("south")) / F.col("rows"), (F.col("east") - F.col("west")) / F.col("cols")
    size = size.select("scene_id", "rows", "cols", "west", "north", high.alias("dy"), wide.alias("dx"))
    own = rings.where(usable).select("scene_id", "ring_id", "ring", F.posexplode("ring").alias("k", "a"))
    edge = own.select("scene_id", "ring_id", "a", F.element_at("ring", F.pmod(F.col("k") + 1, F.size("ring")) + 1).alias("b")).where("a.lat <> b.lat")
    row_of = lambda lat: (F.col("north") - lat) / F.col("dy") - 0.5
    first = F.greatest(F.floor(row_of(F.greatest("a.lat", "b.lat"))) - 1, F.lit(0))
    last = F.least(F.ceil(row_of(F.least("a.lat", "b.lat"))) + 1, F.col("rows") - 1)
    met = edge.join(size, "scene_id").withColumns({"first": first, "last": last}).where("first <= last").withColumn("r", F.explode(F.sequence(F.col("first").cast("long"), F.col("last").cast("long"))))
    met = met.withColumn("y", F.col("north") - (F.col("r") + 0.5) * F.col("dy")).where((F.col("a.lat") > F.col("y")) != (F.col("b.lat") > F.col("y")))
    at = F.col("a.lon") + (F.col("y") - F.col("a.lat")) / (F.col("b.lat") - F.col("a.lat")) * (F.col("b.lon") - F.col("a.lon"))
    keys = ["scene_id", "ring_id", "r"]
    order = Window.partitionBy(*keys).orderBy("x")
    runs = met.select(*keys, "cols", "west", "dx", at.alias("x")).withColumns({"to": F.lead("x").over(order), "place": F.row_number().over(order)}).where("place % 2 = 1")
    column = lambda x: (F.col(x) - F.col("west")) / F.col("dx") - 0.5
    runs = runs.withColumns({"c0": F.greatest(F.floor(column("x")) - 1, F.lit(0)), "c1": F.least(F.ceil(column("to")) + 1, F.col("cols") - 1)}).where("c0 <= c1")
    px = runs.withColumn("c", F.explode(F.sequence(F.col("c0").cast("long"), F.col("c1").cast("long")))).withColumn("lon", F.col("west") + (F.col("c") + 0.5) * F.col("dx"))
    return px.where("lon >= x and lon < to").select(*keys, "c")
