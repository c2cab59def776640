"""Radar scenes made of the given tables: one for each supplier, its values from its sales, its slick and ships from its key."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curves, image, masks, regions, scanlines, spots, thinning
from ..sources.staging import staged
from .registry import HEAD, query, r6, table

ROWS, COLS = 48, 64
_BRIGHT = ((6, 8), (40, 52), (8, 50))


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), F.lit(ROWS).alias("rows"), F.lit(COLS).alias("cols"))


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """(scene_id, r, c, db, gt): water of -18 dB, up to one more or less by the quantities sold; a slick 8 dB darker, which gt marks, and three ships."""
    k, at = F.col("scene_id"), F.col("at")
    r, c = F.col("l_orderkey") % ROWS, F.col("l_partkey") % COLS
    each = table(spark, sf, "lineitem").where((r >= 0) & (c >= 0)).groupBy("l_suppkey", (r * COLS + c).cast("int").alias("at")).agg(F.avg("l_quantity").alias("q"))
    sold = each.groupBy(F.col("l_suppkey").alias("scene_id")).agg(F.collect_list(F.struct("at", "q")).alias("sold"))
    # a scene's sales come as one row, of its places at most, and its pixels are made from it: no pixel is shuffled
    px = masks.dealt(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"))).join(sold, "scene_id", "left").withColumn("sold", F.coalesce("sold", F.array().cast("array<struct<at:int,q:double>>")))
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(ROWS * COLS - 1)), F.col("sold.at")), lambda x: F.struct(x.alias("at"), F.lit(None).cast("double").alias("q")))
    px = px.select("scene_id", F.inline(F.concat("sold", rest))).select("scene_id", "q", F.floor(at / COLS).cast("int").alias("r"), (at % COLS).alias("c"))
    y, x = F.col("r") - 20 - k % 8, F.col("c") - 26 - k % 12
    inside = 16 * y * y * (1 + k % 3) + x * x <= 196
    bright = F.lit(False)
    for r, c in _BRIGHT:
        bright = bright | (F.col("r").between(r, r + 2) & F.col("c").between(c, c + 1 + k % 2))
    px = px.withColumns({"ship": F.when(bright, 5.0 + k % 4), "gt": inside.cast("int")})
    water = F.lit(-18.0) + F.coalesce((F.col("q") - 25) / 25, F.lit(0.0)) - F.when(F.col("gt") == 1, 8.0).otherwise(0.0)
    return px.select("scene_id", "r", "c", F.coalesce("ship", water).alias("db"), "gt")


_SHIPS = " OR ".join(f"(r BETWEEN {r} AND {r + 2} AND c BETWEEN {c} AND {c + 1} + s % 2)" for r, c in _BRIGHT)
SCENES = f"""sold AS (SELECT l_suppkey AS s, l_orderkey % {ROWS} AS r, l_partkey % {COLS} AS c, avg(l_quantity) AS q FROM lineitem GROUP BY ALL),
px AS (SELECT s_suppkey AS s, r, c, 16 * (r - 20 - s_suppkey % 8) * (r - 20 - s_suppkey % 8) * (1 + s_suppkey % 3) + (c - 26 - s_suppkey % 12) * (c - 26 - s_suppkey % 12) <= 196 AS gt FROM supplier, range({ROWS}) AS a(r), range({COLS}) AS b(c)),
sea AS (SELECT s, r, c, CASE WHEN {_SHIPS} THEN 5.0::DOUBLE + s % 4 ELSE -18.0::DOUBLE + coalesce((q - 25) / 25, 0) - CASE WHEN gt THEN 8 ELSE 0 END END AS db, gt FROM px LEFT JOIN sold USING (s, r, c))"""


@query("n01_local_means", f"""WITH {SCENES}, near AS (SELECT s, r + y AS r, c + x AS c, db FROM sea, range(-4, 5) AS a(y), range(-4, 5) AS b(x)),
wide AS (SELECT s, CASE WHEN r < 0 THEN -1 - r WHEN r >= {ROWS} THEN 2 * {ROWS} - 1 - r ELSE r END AS r, CASE WHEN c < 0 THEN -1 - c WHEN c >= {COLS} THEN 2 * {COLS} - 1 - c ELSE c END AS c, r AS r0, c AS c0 FROM (SELECT s, i - 4 AS r, j - 4 AS c FROM (SELECT DISTINCT s FROM sea), range({ROWS} + 8) AS a(i), range({COLS} + 8) AS b(j))),
full_ AS (SELECT s, r0 AS r, c0 AS c, db FROM wide JOIN sea USING (s, r, c)), rows_ AS (SELECT s, r, c, sum(db) OVER (PARTITION BY s, r ORDER BY c ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS t FROM full_),
means AS (SELECT s, r, c, sum(t) OVER (PARTITION BY s, c ORDER BY r ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 81 AS m FROM rows_ QUALIFY r BETWEEN 0 AND {ROWS - 1} AND c BETWEEN 0 AND {COLS - 1})
SELECT s AS scene_id, round(quantile_cont(m, 0.2), 6) AS sea_db, round(avg(m), 6) AS mean_db, round(max(m), 6) AS top_db FROM means GROUP BY s""")
def n01_means(spark: SparkSession, sf: str) -> DataFrame:
    """Local means of 9 x 9 pixels, mirrored at the sides, and the sea's level."""
    size = sizes(spark, sf)
    means = staged(masks.local_means(staged(masks.raster(scenes(spark, sf), size), "raster"), size, 9, tile=32).select("scene_id", "v"), "means")
    return masks.quantiles(means, 0.2, size).join(means.groupBy("scene_id").agg(F.avg("v").alias("a"), F.max("v").alias("b")), "scene_id").select("scene_id", r6("q").alias("sea_db"), r6("a").alias("mean_db"), r6("b").alias("top_db"))


@query("n01_prepared_scenes")
def n01_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Valid and land pixels and the sea's level of each scene, land where its local mean of 9 x 9 lies 3 dB over the sea."""
    p = masks.prepare(scenes(spark, sf), sizes(spark, sf), 0.01, window=9, bright_steps=2, above_db=3.0, close=2, least_km2=0.05, land_steps=2)
    return p.groupBy("scene_id", F.round("sea_db", 6).alias("sea_db")).agg(F.count_if("valid").alias("n_valid"), F.count_if("land").alias("n_land"))


@query("n09_ships_of_scenes", f"""WITH RECURSIVE {SCENES}, m AS (SELECT s, median(db) AS med FROM sea GROUP BY s), t AS (SELECT s, greatest(-10, any_value(med) + 4 * 1.4826 * median(abs(db - med))) AS cut FROM sea JOIN m USING (s) GROUP BY s),
hot AS (SELECT s, r, c FROM sea JOIN t USING (s) WHERE db > cut), k AS (SELECT y, x FROM range(-1, 2) AS a(y), range(-1, 2) AS b(x)),
d AS (SELECT DISTINCT s, r + y AS r, c + x AS c FROM hot, k WHERE r + y BETWEEN 0 AND {ROWS - 1} AND c + x BETWEEN 0 AND {COLS - 1}),
e AS (SELECT s, r, c FROM (SELECT s, r + y AS r, c + x AS c FROM d, k) JOIN d USING (s, r, c) GROUP BY s, r, c HAVING count(*) = 9 - CASE WHEN r IN (0, {ROWS - 1}) THEN 3 ELSE 0 END - CASE WHEN c IN (0, {COLS - 1}) THEN 3 ELSE 0 END + CASE WHEN r IN (0, {ROWS - 1}) AND c IN (0, {COLS - 1}) THEN 1 ELSE 0 END),
w AS (SELECT s, r * 100 + c AS a, r, c FROM e UNION SELECT w.s, w.a, e.r, e.c FROM w JOIN e ON e.s = w.s AND e.r BETWEEN w.r - 1 AND w.r + 1 AND e.c BETWEEN w.c - 1 AND w.c + 1),
l AS (SELECT s, r, c, min(a) AS a FROM w GROUP BY ALL)
SELECT s AS scene_id, round(avg(r), 4) AS r, round(avg(c), 4) AS c, count(*) AS px_area, max(db) AS peak_db FROM l JOIN sea USING (s, r, c) GROUP BY s, a HAVING count(*) BETWEEN 4 AND 4000 AND count(*) / ((max(r) - min(r) + 1) * (max(c) - min(c) + 1)) >= 0.2""")
def n09_ships(spark: SparkSession, sf: str) -> DataFrame:
    """Ships of every scene over tiles; these lie too far apart to be merged."""
    found = masks.ships(scenes(spark, sf), sizes(spark, sf), 10.0, tile=32)
    return found.select("scene_id", F.round("r", 4).alias("r"), F.round("c", 4).alias("c"), "px_area", "peak_db")


@query("n09_bright_contacts")
def n09(spark: SparkSession, sf: str) -> DataFrame:
    return image.bright_contacts(scenes(spark, sf))


@query("n06_dark_regions")
def n06(spark: SparkSession, sf: str) -> DataFrame:
    return image.dark_regions(scenes(spark, sf), 0.01, 0.3, 500.0, 80, (21, 41))


@query("n08_edge_and_shape")
def n08(spark: SparkSession, sf: str) -> DataFrame:
    return image.dark_regions(scenes(spark, sf), 0.01, 0.3, 500.0, 80, (21, 41)).select("scene_id", "region_id", "edge_gradient", "solidity", "elongation")


@query("n05_component_sizes", f"WITH {SCENES} SELECT s AS scene_id, min(r) * {COLS} + min_by(c, (r, c)) AS first, count(*) AS n FROM sea WHERE gt GROUP BY s")
def n05(spark: SparkSession, sf: str) -> DataFrame:
    """A slick is one region."""
    own = regions.labelled(scenes(spark, sf).where("gt = 1"), tile=32).groupBy("scene_id", "label").agg(F.count("*").alias("n"))
    return own.select("scene_id", (F.shiftright("label", 32) * COLS + F.col("label").bitwiseAND(F.lit(0xFFFFFFFF))).alias("first"), "n")


@query("l13_width_profile")
def l13(spark: SparkSession, sf: str) -> DataFrame:
    return curves.width_profile(scenes(spark, sf).where("gt = 1").select(F.col("scene_id").alias("case_id"), "r", "c"), 50.0)


@query("l23_centre_edge_contrast")
def l23(spark: SparkSession, sf: str) -> DataFrame:
    return curves.centre_edge_contrast(scenes(spark, sf))


@query("n11_region_outline")
def n11(spark: SparkSession, sf: str) -> DataFrame:
    px = scenes(spark, sf).select(F.col("scene_id").alias("case_id"), "r", "c", F.col("gt").cast("double").alias("w"))
    return curves.density_outline(px, {**HEAD, "rows": ROWS, "cols": COLS})


@query("j14_scan_lines", """WITH pt AS (SELECT l_partkey AS ring_id, l_orderkey % 37 + 0.375::DOUBLE AS x, l_suppkey % 31 + 0.125::DOUBLE AS y, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS k, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem),
e AS (SELECT a.ring_id, a.x, a.y, b.x AS x2, b.y AS y2 FROM pt AS a JOIN pt AS b ON a.ring_id = b.ring_id AND b.k = a.k % a.n + 1 WHERE a.n >= 3),
cut AS (SELECT ring_id, r, x + (40 - (r + 0.5::DOUBLE) - y) / (y2 - y) * (x2 - x) AS cross_x FROM e, range(40) AS t(r) WHERE (y > 40 - (r + 0.5::DOUBLE)) <> (y2 > 40 - (r + 0.5::DOUBLE))),
px AS (SELECT ring_id, r, c FROM cut, range(40) AS t(c) WHERE c + 0.5::DOUBLE < cross_x GROUP BY ring_id, r, c HAVING count(*) % 2 = 1)
SELECT ring_id, count(*) AS n, sum(r * 40 + c)::BIGINT AS places FROM px GROUP BY ring_id""")
def j14_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's outline, through its sales in order, burned on a scene of 40 x 40 pixels."""
    point = F.struct("l_orderkey", "l_linenumber", "l_suppkey")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("ring_id")).agg(F.sort_array(F.collect_list(point)).alias("p"))
    ring = F.transform("p", lambda p: F.struct((p["l_orderkey"] % 37 + F.lit(0.375)).alias("lon"), (p["l_suppkey"] % 31 + F.lit(0.125)).alias("lat")))
    scene = spark.range(1).select(F.lit("s").alias("scene_id"), F.lit(40).alias("rows"), F.lit(40).alias("cols"), F.lit(0.0).alias("west"), F.lit(0.0).alias("south"), F.lit(40.0).alias("east"), F.lit(40.0).alias("north"))
    px = scanlines.burned(lines.select(F.lit("s").alias("scene_id"), "ring_id", ring.alias("ring")), scene)
    return px.groupBy("ring_id").agg(F.count("*").alias("n"), F.sum(F.col("r") * 40 + F.col("c")).alias("places"))


# The neighbours' places, clockwise from above, in a block of four by four that begins above and left of the pixel.
_P = [f"((m >> {k}) & 1)" for k in (1, 2, 6, 10, 9, 8, 4, 0)]
_RUNS = " + ".join(f"(1 - {a}) * {b}" for a, b in zip(_P, _P[1:] + _P[:1], strict=True))
_TRIO = [" OR ".join("(" + " AND ".join(f"{_P[i]} = 1" for i in t) + ")" for t in two) for two in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6)))]
AXES = f"""g AS (SELECT s, r, c FROM px WHERE gt),
t AS (SELECT s, r, c, 0 AS k FROM g UNION ALL SELECT s, r, c, k + 1 FROM (SELECT a.s, a.r, a.c, a.k, bit_or((1 << ((b.r - a.r + 1) * 4 + b.c - a.c + 1)::INTEGER)::INTEGER) AS m FROM t AS a JOIN t AS b ON a.s = b.s AND b.r BETWEEN a.r - 1 AND a.r + 2 AND b.c BETWEEN a.c - 1 AND a.c + 2 GROUP BY ALL)
 WHERE k < 40 AND (NOT ({" + ".join(_P)} BETWEEN 2 AND 6 AND {_RUNS} = 1 AND NOT CASE WHEN k % 2 = 0 THEN {_TRIO[0]} ELSE {_TRIO[1]} END) OR m = 1632)),
x AS (SELECT s, r, c FROM t WHERE k = 40), big AS (SELECT s FROM x GROUP BY s HAVING count(*) >= 20),
turn AS (SELECT s, count(*) AS n, avg(r) AS r0, avg(c) AS c0, atan2(-2 * covar_pop(c, r), var_pop(c) - var_pop(r)) / 2 AS a FROM g GROUP BY s),
w AS (SELECT x.s, x.r, x.c, 100 * sqrt(min((x.r - e.r) * (x.r - e.r) + (x.c - e.c) * (x.c - e.c))) AS w FROM x JOIN px AS e ON x.s = e.s AND NOT e.gt GROUP BY ALL)"""


@query("l13_medial_axes", f"""WITH RECURSIVE {SCENES}, {AXES}
SELECT s AS scene_id, r::BIGINT AS r, c::BIGINT AS c, round(50 * ((c - c0) * cos(a) - (r - r0) * sin(a)), 4) AS along_m, round(w, 4) AS width_m FROM w SEMI JOIN big USING (s) JOIN turn USING (s)""")
def l13_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Each slick's medial axis of pixels of 50 m, with the place along the slick and the width there."""
    p = thinning.medial_profile(scenes(spark, sf).where("gt = 1"), 50.0, tile=32, reach=16)
    return p.select("scene_id", "r", "c", F.round("along_m", 4).alias("along_m"), F.round("width_m", 4).alias("width_m"))


@query("l13_axis_figures", f"""WITH RECURSIVE {SCENES}, {AXES}
SELECT s AS scene_id, count(*) AS axis_px, round(any_value(n) * 50.0::DOUBLE / count(*), 6) AS mean_width_m, round(count(*) * 50.0::DOUBLE / 1000, 6) AS length_km, round(count(*)::DOUBLE * count(*) / any_value(n), 6) AS aspect, round(max(w), 6) AS widest_m FROM w SEMI JOIN big USING (s) JOIN turn USING (s) GROUP BY s""")
def l13_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Length, mean and largest width of each slick along its medial axis."""
    slicks = staged(scenes(spark, sf).where("gt = 1").select("scene_id", "r", "c"), "slicks")
    f = thinning.profile_figures(thinning.medial_profile(slicks, 50.0, tile=32, reach=16), slicks, 50.0)
    return f.select("scene_id", "axis_px", *(r6(c).alias(c) for c in ("mean_width_m", "length_km", "aspect", "widest_m")))


@query("n06_dark_spots_of_scenes")
def n06_spots(spark: SparkSession, sf: str) -> DataFrame:
    """Dark regions of each prepared scene with depth and contrast against valid water; ships and land are no part of either."""
    size, px = sizes(spark, sf), scenes(spark, sf)
    prepared = masks.prepare(px, size, 0.01, window=9, bright_steps=2, above_db=3.0, close=2, least_km2=0.05, land_steps=2)
    d = spots.dark_spots(px, size, 0.01, prepared=prepared, sizes=(21, 41), close=5, least_extent=20, tile=64)
    return d.select("scene_id", "label", "n_px", *(r6(c).alias(c) for c in ("area_km2", "elongation", "fill", "mean_depth_db", "max_depth_db", "contrast_db")))
