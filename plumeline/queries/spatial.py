"""Joins, windows, geometry and grids on the driver's tables."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import dark, drift, grid as G, image, ingest, tracks
from ..streaming import gaps
from .registry import GRID, HEAD, POS, T0, T0_US, T1, T1_US, ang, brg, grid, hav, instant, positions, query, r6, sampled, table, us

GAPS = "g AS (SELECT *, lead(us) OVER w AS nus, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat, lead(sog) OVER w AS nsog, lead(source) OVER w AS nsource FROM pos WINDOW w AS (PARTITION BY mmsi ORDER BY us))"


@query("d01_dense_wins", f"WITH {POS} SELECT event_id FROM pos AS q WHERE source = 'noaa' OR NOT EXISTS (SELECT 1 FROM pos AS n WHERE n.source = 'noaa' AND n.mmsi = q.mmsi AND n.us // 3600000000 = q.us // 3600000000)")
def d01(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.dense_wins(positions(spark, sf)).select("event_id")


@query("d02_grid_sample", f"WITH {POS}, {GRID}, {sampled()} SELECT event_id, p FROM smp")
def d02(spark: SparkSession, sf: str) -> DataFrame:
    return G.sample(positions(spark, sf), grid(spark), HEAD).select("event_id", "p")


def _asof(ceiling: str) -> str:
    return f"""WITH {POS}, {GAPS}, ask AS (SELECT mmsi, unnest(range({T0_US}, {T1_US}, 21600000000)) AS q_at FROM (SELECT DISTINCT mmsi FROM pos)),
j AS (SELECT ask.mmsi, q_at, g.* EXCLUDE (mmsi) FROM ask JOIN g ON g.mmsi = ask.mmsi AND g.us <= q_at AND (g.nus > q_at OR g.nus IS NULL))
SELECT mmsi, q_at AS at_us, us = q_at AS exact, round(CASE WHEN us = q_at THEN lon ELSE lon + (q_at - us)::DOUBLE / (nus - us) * (nlon - lon) END, 6) AS lon, round(CASE WHEN us = q_at THEN lat ELSE lat + (q_at - us)::DOUBLE / (nus - us) * (nlat - lat) END, 6) AS lat
FROM j WHERE us = q_at OR (nus - us) / 60e6 <= {ceiling}"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    m = positions(spark, sf).select("mmsi").distinct()
    return m.select("mmsi", F.explode(F.sequence(instant(T0), instant(T1) - F.expr("interval 6 hours"), F.expr("interval 6 hours"))).alias("at"))


@query("d03_position_at", _asof("720"))
def d03(spark: SparkSession, sf: str) -> DataFrame:
    d = tracks.positions_at(positions(spark, sf), _asked(spark, sf), 720, regimes=False)
    return d.select("mmsi", us("at").alias("at_us"), "exact", r6("lon").alias("lon"), r6("lat").alias("lat"))


@query("d04_interval_ceilings", _asof("least(900, CASE WHEN source = 'noaa' AND nsource = 'noaa' THEN 400 ELSE 800 END)"))
def d04(spark: SparkSession, sf: str) -> DataFrame:
    d = tracks.positions_at(positions(spark, sf), _asked(spark, sf), 900, dense=400, hourly=800)
    return d.select("mmsi", us("at").alias("at_us"), "exact", r6("lon").alias("lon"), r6("lat").alias("lat"))


def _contacts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("contact_id"), (-95 + ((k * 7919) % 2000) / F.lit(1000.0)).alias("lon"), (28 + ((k * 104729) % 2000) / F.lit(1000.0)).alias("lat"))


CONTACTS = "contacts AS (SELECT s_suppkey AS contact_id, -95 + ((s_suppkey * 7919) % 2000) / 1000.0::DOUBLE AS lon, 28 + ((s_suppkey * 104729) % 2000) / 1000.0::DOUBLE AS lat FROM supplier)"


def _knots(a: str, b: str, c: str, d: str, h: str) -> str:
    return f"CASE WHEN {h} <> 0 THEN least(25, greatest(6, {hav(a, b, c, d)} / 1.852 / {h} * 1.5)) ELSE 25 END"


_H = f"((b.us - a.us) / 3600e6)"  # noqa: F541
PRISM = f"""WITH {POS}, {CONTACTS}, f AS (SELECT *, lag(us) OVER w AS pus, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lead(us) OVER w AS nus, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat FROM pos WINDOW w AS (PARTITION BY mmsi ORDER BY us)),
near AS (SELECT * FROM f WHERE abs(us - {T0_US}) <= 5400000000),
v AS (SELECT DISTINCT mmsi FROM near), a AS (SELECT * FROM near WHERE us <= {T0_US} QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY us DESC) = 1), b AS (SELECT * FROM near WHERE us >= {T0_US} QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY us) = 1),
m AS (SELECT c.contact_id, CASE WHEN a.us IS NOT NULL AND b.us IS NOT NULL AND a.us <> b.us THEN {hav('a.lon', 'a.lat', 'c.lon', 'c.lat')} + {hav('c.lon', 'c.lat', 'b.lon', 'b.lat')} <= {_knots('a.lon', 'a.lat', 'b.lon', 'b.lat', _H)} * 1.852 * {_H} + 2
 WHEN a.us IS NOT NULL THEN {hav('a.lon', 'a.lat', 'c.lon', 'c.lat')} <= {_knots('a.plon', 'a.plat', 'a.lon', 'a.lat', '((a.us - a.pus) / 3600e6)')} * 1.852 * abs(({T0_US} - a.us) / 3600e6) + 1
 ELSE {hav('b.lon', 'b.lat', 'c.lon', 'c.lat')} <= {_knots('b.lon', 'b.lat', 'b.nlon', 'b.nlat', '((b.nus - b.us) / 3600e6)')} * 1.852 * abs((b.us - {T0_US}) / 3600e6) + 1 END AS hit
 FROM contacts AS c CROSS JOIN v LEFT JOIN a USING (mmsi) LEFT JOIN b USING (mmsi))
SELECT c.contact_id, coalesce(bool_or(hit), FALSE) AS matched FROM contacts AS c LEFT JOIN m USING (contact_id) GROUP BY c.contact_id"""


@query("d05_space_time_prism", PRISM)
def d05(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf)
    none = p.where("false").select("mmsi", "lon", "lat")
    return dark.match_contacts(_contacts(spark, sf), none, dark.scene_fixes(p, instant(T0)), instant(T0)).select("contact_id", "matched")


_SCENES = """sc AS (SELECT c_custkey AS contact_id, -95 + ((c_custkey * 7919) % 2000) / 1000.0::DOUBLE AS lon, 28 + ((c_custkey * 104729) % 2000) / 1000.0::DOUBLE AS lat, {t0} + (c_custkey % 90) * 3600000000 AS t FROM customer)"""
SCENES = f"""WITH {POS}, {_SCENES.format(t0=T0_US)}, f AS (SELECT *, lag(us) OVER w AS pus, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat, lead(us) OVER w AS nus, lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat FROM pos WINDOW w AS (PARTITION BY mmsi ORDER BY us)),
times AS (SELECT DISTINCT t FROM sc), vt AS (SELECT mmsi, t FROM (SELECT DISTINCT mmsi FROM pos) CROSS JOIN times),
a AS (SELECT vt.mmsi, vt.t, f.* EXCLUDE (mmsi) FROM vt ASOF JOIN f ON vt.mmsi = f.mmsi AND vt.t >= f.us WHERE vt.t - f.us <= 5400000000), b AS (SELECT vt.mmsi, vt.t, f.* EXCLUDE (mmsi) FROM vt ASOF JOIN f ON vt.mmsi = f.mmsi AND vt.t <= f.us WHERE f.us - vt.t <= 5400000000),
m AS (SELECT c.contact_id, vt.mmsi, CASE WHEN a.us IS NOT NULL AND b.us IS NOT NULL AND a.us <> b.us THEN {hav('a.lon', 'a.lat', 'c.lon', 'c.lat')} + {hav('c.lon', 'c.lat', 'b.lon', 'b.lat')} <= {_knots('a.lon', 'a.lat', 'b.lon', 'b.lat', _H)} * 1.852 * {_H} + 2
 WHEN a.us IS NOT NULL THEN {hav('a.lon', 'a.lat', 'c.lon', 'c.lat')} <= {_knots('a.plon', 'a.plat', 'a.lon', 'a.lat', '((a.us - a.pus) / 3600e6)')} * 1.852 * abs((c.t - a.us) / 3600e6) + 1
 ELSE {hav('b.lon', 'b.lat', 'c.lon', 'c.lat')} <= {_knots('b.lon', 'b.lat', 'b.nlon', 'b.nlat', '((b.nus - b.us) / 3600e6)')} * 1.852 * abs((b.us - c.t) / 3600e6) + 1 END AS hit
 FROM sc AS c JOIN vt USING (t) LEFT JOIN a ON a.mmsi = vt.mmsi AND a.t = vt.t LEFT JOIN b ON b.mmsi = vt.mmsi AND b.t = vt.t)
SELECT contact_id, bool_or(coalesce(hit, FALSE)) AS matched, count(*) FILTER (WHERE hit) AS n_vessels FROM m GROUP BY contact_id"""


@query("d05_contacts_of_scenes", SCENES)
def d05_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts of ninety scenes, an hour apart, against the tracks of all vessels."""
    p, k = positions(spark, sf), F.col("c_custkey")
    when = F.timestamp_micros(F.lit(T0_US) + (k % 90) * 3600000000)
    contacts = table(spark, sf, "customer").select(k.alias("contact_id"), (-95 + ((k * 7919) % 2000) / F.lit(1000.0)).alias("lon"), (28 + ((k * 104729) % 2000) / F.lit(1000.0)).alias("lat"), when.alias("t0"))
    none = p.where("false").select("mmsi", "lon", "lat", F.col("ts").alias("t0"))
    return dark.match_scene_contacts(contacts, none, p)


@query("d06_radius_match", f"""WITH {POS}, {CONTACTS}, placed AS (SELECT mmsi, arg_min(lon, abs(us - {T0_US})) AS lon, arg_min(lat, abs(us - {T0_US})) AS lat FROM pos GROUP BY mmsi)
SELECT c.contact_id, bool_or({hav('p.lon', 'p.lat', 'c.lon', 'c.lat')} <= 1) AS matched FROM contacts AS c CROSS JOIN placed AS p GROUP BY 1""")
def d06(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf)
    far = F.abs(us("ts") - F.lit(T0_US))
    placed = p.groupBy("mmsi").agg(F.min_by("lon", far).alias("lon"), F.min_by("lat", far).alias("lat"))
    none = dark.scene_fixes(p.where("false"), instant(T0))
    return dark.match_contacts(_contacts(spark, sf), placed, none, instant(T0)).select("contact_id", "matched")


@query("d07_nearest_vertex", f"""WITH {CONTACTS}, v AS (SELECT c_custkey, -95 + ((c_custkey * 31) % 2000) / 1000.0::DOUBLE AS vlon, 28 + ((c_custkey * 17) % 2000) / 1000.0::DOUBLE AS vlat FROM customer)
SELECT contact_id, round(min({hav('lon', 'lat', 'vlon', 'vlat')}), 6) AS near_km FROM contacts CROSS JOIN v GROUP BY contact_id""")
def d07(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    v = table(spark, sf, "customer").select(F.lit("c").alias("case_id"), k.alias("det_id"), (-95 + ((k * 31) % 2000) / F.lit(1000.0)).alias("vlon"), (28 + ((k * 17) % 2000) / F.lit(1000.0)).alias("vlat"))
    d = dark.nearest_vertex(_contacts(spark, sf).withColumn("case_id", F.lit("c")), v, ["contact_id"], ["det_id"])
    return d.select("contact_id", r6("near_km").alias("near_km"))


@query("d09_nearest_fix", f"WITH {POS} SELECT mmsi, arg_min(us, (abs(us - {T0_US}), us)) AS us, round(arg_min(sog, (abs(us - {T0_US}), us)), 6) AS sog FROM pos GROUP BY mmsi")
def d09(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf)
    at = p.select("mmsi").distinct().withColumn("at", instant(T0))
    return tracks.nearest_fix(p, at).select("mmsi", us("ts").alias("us"), r6("sog").alias("sog"))


@query("d10_last_outside", f"WITH {POS} SELECT mmsi, max(us) AS us, arg_max(cog, us) AS cog FROM pos WHERE us <= {T0_US} AND {hav('lon', 'lat', '-94', '29')} >= 40 GROUP BY mmsi")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf)
    at = p.select("mmsi").distinct().withColumn("at", instant(T0))
    return tracks.last_outside(p, at, -94.0, 29.0, 40.0).select("mmsi", us("ts").alias("us"), "cog")


@query("d11_heard_inside_silence", f"WITH {POS}, x AS (SELECT mmsi, min(us) AS a, max(us) AS b FROM pos WHERE source = 'noaa' AND us BETWEEN {T0_US} AND {T1_US} GROUP BY mmsi) SELECT x.mmsi, count(q.us) AS heard FROM x LEFT JOIN pos AS q ON q.mmsi = x.mmsi AND q.source = 'gfw' AND q.us > a AND q.us < b GROUP BY x.mmsi")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf)
    g = p.where((F.col("source") == "noaa") & F.col("ts").between(instant(T0), instant(T1))).groupBy("mmsi").agg(F.min("ts").alias("gap_start"), F.max("ts").alias("gap_end"))
    return tracks.heard_inside(g, p.where("source = 'gfw'"))


@query("d12_missing_tracks", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)")
def d12(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_nationkey <> 7").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_anti").select("o_orderkey")


@query("d14_nearest_hour", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 3, 0)::INTEGER AS step FROM lineitem")
def d14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 3, 0).cast("int").alias("step"))


@query("d16_region_overlap", "SELECT l_returnflag AS scene_id, l_suppkey AS region_id, round(avg((l_linenumber <= 2)::INTEGER), 6) AS overlap, (avg((l_linenumber <= 2)::INTEGER) >= 0.25)::INTEGER AS label FROM lineitem GROUP BY 1, 2")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    px = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene_id"), F.col("l_suppkey").alias("region_id"), F.monotonically_increasing_id().alias("r"), F.col("l_linenumber").alias("c"))
    px = px.withColumn("r", F.col("c"))
    truth = spark.range(1, 3).select(F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("scene_id"), F.col("id").cast("int").alias("r"), F.col("id").cast("int").alias("c"))
    return image.region_overlap(px, truth).select("scene_id", "region_id", r6("overlap").alias("overlap"), "label")


@query("d20_case_broadcast", "SELECT l_suppkey, count(*) AS n, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def d20(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return table(spark, sf, "lineitem").join(s, "l_suppkey").groupBy("l_suppkey", "s_nationkey").agg(F.count("*").alias("n"))


@query("e09_longest_silence", f"WITH {POS}, {GAPS} SELECT mmsi, coalesce(round_even(max((nus - us) / 60e6), 1), 0) AS max_gap_min, coalesce(round_even(max((nus - us) / 60e6) FILTER (WHERE us < {T1_US} AND nus > {T0_US}), 1), 0) AS window_gap_min FROM g GROUP BY mmsi")
def e09(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.longest_silence(positions(spark, sf), instant(T0), instant(T1))


@query("e18_centroid_and_radii", "WITH p AS (SELECT l_returnflag AS k, l_quantity / 50 AS lon, l_discount * 10 AS lat FROM lineitem), c AS (SELECT k, avg(lon) AS clon, avg(lat) AS clat FROM p GROUP BY k), d AS (SELECT k, clon, clat, sqrt(pow((lon - clon) * greatest(cos(radians(lat)), 1e-6) * 111320, 2) + pow((lat - clat) * 111320, 2)) / 1000 AS d FROM p JOIN c USING (k)) SELECT k, round(clon, 6) AS clon, round(clat, 6) AS clat, round(quantile_cont(d, 0.5), 5) AS r50_km, round(quantile_cont(d, 0.9), 5) AS r90_km FROM d GROUP BY k, clon, clat")
def e18(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_quantity") / 50).alias("lon"), (F.col("l_discount") * 10).alias("lat"))
    return G.radii(p, ["k"]).select("k", r6("clon").alias("clon"), r6("clat").alias("clat"), F.round("r50_km", 5).alias("r50_km"), F.round("r90_km", 5).alias("r90_km"))


@query("e20_rms_spread", "WITH p AS (SELECT l_orderkey % 50 AS m, l_quantity / 50 AS lon, l_discount * 10 AS lat FROM lineitem), c AS (SELECT m, avg(lon) AS clon, avg(lat) AS clat FROM p GROUP BY m) SELECT m, round(sqrt(avg((pow((lon - clon) * greatest(cos(radians(lat)), 1e-6) * 111320, 2) + pow((lat - clat) * 111320, 2)) / 1e6)), 6) AS spread_km FROM p JOIN c USING (m) GROUP BY m")
def e20(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("m"), (F.col("l_quantity") / 50).alias("lon"), (F.col("l_discount") * 10).alias("lat"))
    return G.rms_spread(p, ["m"]).select("m", r6("spread_km").alias("spread_km"))


HIST = f"{POS}, h AS (SELECT (39 - least(floor((lat - 28) / 2 * 40), 39))::INTEGER AS r, least(floor((lon + 95) / 2 * 40), 39)::INTEGER AS c, sum(sog) AS w FROM pos GROUP BY 1, 2)"


@query("e21_weighted_histogram", f"WITH {HIST} SELECT r, c, round(w, 6) AS w FROM h")
def e21(spark: SparkSession, sf: str) -> DataFrame:
    return G.histogram2d(positions(spark, sf), HEAD, "sog").select("r", "c", r6("w").alias("w"))


@query("e22_peak_normalised", f"WITH {HIST} SELECT r, c, round_even(w / (SELECT max(w) FROM h), 4) AS p FROM h")
def e22(spark: SparkSession, sf: str) -> DataFrame:
    return G.normalise_peak(G.histogram2d(positions(spark, sf), HEAD, "sog"))


@query("e23_peak_cell", f"WITH {HIST}, q AS (SELECT r, c, round(w, 6) AS p FROM h) SELECT r, c, p, round(-95 + c * 2.0::DOUBLE / 39, 6) AS lon, round(30 - r * 2.0::DOUBLE / 39, 6) AS lat FROM q ORDER BY p DESC, r, c LIMIT 1")
def e23(spark: SparkSession, sf: str) -> DataFrame:
    h = G.histogram2d(positions(spark, sf), HEAD, "sog").select("r", "c", r6("w").alias("p"))
    return G.peak(h, HEAD).select("r", "c", "p", r6("lon").alias("lon"), r6("lat").alias("lat"))


@query("e24_mass_radius", f"WITH {POS}, g AS (SELECT 39 - least(floor((lat - 28) / 2 * 40), 39)::INTEGER AS r, least(floor((lon + 95) / 2 * 40), 39)::INTEGER AS c, count(*) AS p FROM pos WHERE lon BETWEEN -95 AND -93 AND lat BETWEEN 28 AND 30 GROUP BY 1, 2), d AS (SELECT p, {hav('-95 + c * 2.0::DOUBLE / 39', '30 - r * 2.0::DOUBLE / 39', '-94', '29')} AS d FROM g), s AS (SELECT d, sum(sum(p)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum FROM d GROUP BY d) SELECT round(min(d), 3) AS radius_km FROM s WHERE cum >= 0.9 * (SELECT sum(p) FROM d)")
def e24(spark: SparkSession, sf: str) -> DataFrame:
    """About the middle of the box, the radius that holds nine tenths of all reports, counted by cell."""
    cells = G.histogram2d(positions(spark, sf), HEAD).withColumnRenamed("w", "p")
    return G.mass_radius(cells, -94.0, 29.0, HEAD, 0.9).select(F.round("radius_km", 3).alias("radius_km"))


@query("e26_principal_axis", "WITH a AS (SELECT l_suppkey AS k, var_samp(l_quantity) AS sxx, var_samp(l_discount * 300) AS syy, covar_samp(l_quantity, l_discount * 300) AS sxy, count(*) AS n FROM lineitem GROUP BY 1) SELECT k, round(((90 - degrees(0.5 * atan2(2 * sxy, sxx - syy))) % 180 + 180) % 180, 4) AS axis_deg, round(sqrt((sxx + syy) / 2 + sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy)), 6) AS sd_major, n FROM a")
def e26(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 300).alias("y"))
    return G.principal_axis(p, ["k"]).select("k", F.round("axis_deg", 4).alias("axis_deg"), r6("sd_major").alias("sd_major"), "n")


@query("f01_gaps", f"WITH {POS}, {GAPS} SELECT event_id, round((nus - us) / 60e6, 4) AS gap_min FROM g")
def f01(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.with_gaps(positions(spark, sf)).select("event_id", F.round("gap_min", 4).alias("gap_min"))


@query("f02_distinct_on", f"WITH {POS}, h AS (SELECT mmsi, us // 86400000000 AS day, source, type_code FROM pos) SELECT mmsi, day, source, type_code FROM h QUALIFY row_number() OVER (PARTITION BY mmsi, day ORDER BY source, type_code) = 1")
def f02(spark: SparkSession, sf: str) -> DataFrame:
    h = positions(spark, sf).select("mmsi", F.floor(us("ts") / 86400000000).alias("ts"), "source", "type_code")
    return ingest.distinct_positions(h).select("mmsi", F.col("ts").alias("day"), "source", "type_code")


@query("f03_day_continuity", "WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events WHERE day(ts) NOT IN (7, 8)), l AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM d) SELECT strftime(day, '%Y-%m-%d') AS day, (day - before)::DOUBLE AS step, CASE WHEN day - before = 0 THEN 'duplicate' WHEN day - before > 1 THEN 'hole' END AS problem FROM l")
def f03(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").where("day(ts) not in (7, 8)").select(F.to_date("ts").alias("day")).distinct()
    return ingest.day_continuity(d).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("step").cast("double").alias("step"), "problem")


@query("f04_fixed_cadence_walk", f"""WITH {POS}, {GAPS}, s AS (SELECT mmsi, greatest(min(us), {T0_US}) AS a, least(max(us), {T1_US}) AS b FROM pos GROUP BY mmsi), k AS (SELECT mmsi, a + unnest(range(1, (b - a) // 3600000000 + 1)) * 3600000000 AS q_at FROM s),
j AS (SELECT k.mmsi, q_at, us, nus, lon, nlon FROM k JOIN g ON g.mmsi = k.mmsi AND us <= q_at AND (nus > q_at OR nus IS NULL)) SELECT mmsi, count(*) AS n, round(sum(CASE WHEN us = q_at THEN lon ELSE lon + (q_at - us)::DOUBLE / (nus - us) * (nlon - lon) END), 5) AS s FROM j WHERE us = q_at OR (nus - us) / 60e6 <= 720 GROUP BY mmsi""")
def f04(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf)
    s = p.groupBy("mmsi").agg(F.greatest(F.min("ts"), instant(T0)).alias("walk_from"), F.least(F.max("ts"), instant(T1)).alias("walk_to"))
    d = tracks.positions_at(p, tracks.walk_instants(s, 3600), 720, regimes=False)
    return d.groupBy("mmsi").agg(F.count("*").alias("n"), F.round(F.sum("lon"), 5).alias("s"))


@query("f06_sticky_state", "WITH p AS (SELECT l_orderkey AS pid, l_linenumber AS step, l_quantity AS lon, max((l_discount >= 0.09)::INTEGER) OVER w = 1 AS stranded FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)) SELECT stranded, count(*) AS n FROM p GROUP BY stranded")
def f06(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    p = li.select(F.lit("c").alias("case_id"), F.lit(0).alias("member"), F.col("l_orderkey").alias("pid"), F.struct("l_linenumber", "l_quantity", "l_partkey", "l_suppkey").alias("step"), F.col("l_quantity").alias("lon"), F.lit(0.0).alias("lat"), "l_discount")
    return drift.sticky_stranding(p, F.col("l_discount") >= 0.09).groupBy("stranded").agg(F.count("*").alias("n"))


@query("f14_decimated_tracks", f"WITH {POS}, k AS (SELECT mmsi, event_id, row_number() OVER (PARTITION BY mmsi ORDER BY us) - 1 AS k, count(*) OVER (PARTITION BY mmsi) AS n FROM pos) SELECT event_id FROM k WHERE n <= 20 OR k IN (SELECT round_even(j * (n - 1)::DOUBLE / 19, 0)::BIGINT FROM range(20) AS t(j))")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.decimate(positions(spark, sf), 20).select("event_id")


@query("f15_cadence_thinning", f"""WITH RECURSIVE {POS}, o AS (SELECT mmsi, us, row_number() OVER (PARTITION BY mmsi ORDER BY us) AS k FROM pos),
r AS (SELECT mmsi, us, k, us AS kept FROM o WHERE k = 1 UNION ALL SELECT o.mmsi, o.us, o.k, CASE WHEN o.us - r.kept >= 43200000000 THEN o.us ELSE r.kept END FROM o JOIN r ON o.mmsi = r.mmsi AND o.k = r.k + 1) SELECT mmsi, us FROM r WHERE kept = us""")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.thin_by_cadence(positions(spark, sf).select("mmsi", "ts", "lon"), 43200).select("mmsi", us("ts").alias("us"))


@query("f18_clipped_tracks", f"WITH {POS}, k AS (SELECT *, us BETWEEN {T0_US} AND {T1_US} AS i, count(*) FILTER (WHERE us BETWEEN {T0_US} AND {T1_US}) OVER (PARTITION BY mmsi) AS n, row_number() OVER (PARTITION BY mmsi ORDER BY us) AS k FROM pos) SELECT event_id FROM k WHERE CASE WHEN n >= 2 THEN i ELSE k <= 2 END")
def f18(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.clip_to_window(positions(spark, sf), instant(T0), instant(T1)).select("event_id")


@query("j01_haversine", f"WITH {POS} SELECT event_id, round({hav('lon', 'lat', '-94', '29')}, 6) AS km FROM pos")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    return positions(spark, sf).select("event_id", r6(geo.haversine_km("lon", "lat", -94.0, 29.0)).alias("km"))


@query("j02_bearing_and_angle", f"WITH {POS} SELECT event_id, round({brg('lon', 'lat', '-94', '29')}, 6) AS bearing, round({ang('cog', brg('lon', 'lat', '-94', '29'))}, 6) AS off FROM pos")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    b = geo.bearing_deg("lon", "lat", -94.0, 29.0)
    return positions(spark, sf).select("event_id", r6(b).alias("bearing"), r6(geo.angle_between_deg("cog", b)).alias("off"))


SEG = "((-94.2 - lon) * 111.32 * cos(radians(lat)))", "((28.9 - lat) * 111.32)", "((-93.8 - lon) * 111.32 * cos(radians(lat)))", "((29.2 - lat) * 111.32)"
_T = f"greatest(0, least(1, -({SEG[0]} * ({SEG[2]} - {SEG[0]}) + {SEG[1]} * ({SEG[3]} - {SEG[1]})) / (pow({SEG[2]} - {SEG[0]}, 2) + pow({SEG[3]} - {SEG[1]}, 2))))"


@query("j05_point_to_segment", f"WITH {POS} SELECT event_id, round({_T}, 6) AS t, round(sqrt(pow({SEG[0]} + {_T} * ({SEG[2]} - {SEG[0]}), 2) + pow({SEG[1]} + {_T} * ({SEG[3]} - {SEG[1]}), 2)), 6) AS km FROM pos")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    km, t = geo.segment_km("lon", "lat", -94.2, 28.9, -93.8, 29.2)
    return positions(spark, sf).select("event_id", r6(t).alias("t"), r6(km).alias("km"))


@query("j07_drift_geometry", f"WITH {POS} SELECT event_id, round(((lon * 3 + 180) % 360 + 360) % 360 - 180, 6) AS wrapped, round(least((lon + 95) * cos(radians(lat)), (-93 - lon) * cos(radians(lat)), lat - 28, 30 - lat) * 111.32, 6) AS edge_km, round(lon + sog * sin(radians(cog)) / (cos(radians(lat)) * 111.32), 6) AS on_lon FROM pos")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf)
    return p.select("event_id", r6(geo.wrap_lon(F.col("lon") * 3)).alias("wrapped"), r6(geo.edge_distance_km("lon", "lat", -95.0, 28.0, -93.0, 30.0)).alias("edge_km"), r6(geo.offset_point("lon", "lat", "sog", "cog")[0]).alias("on_lon"))


@query("j09_ring_area", "SELECT s_suppkey AS id, round(a * b * 111.32 * 111.32 * cos(radians(28 + b / 2)), 6) AS km2 FROM (SELECT s_suppkey, (s_suppkey % 7 + 1) / 10.0::DOUBLE AS a, (s_suppkey % 5 + 1) / 10.0::DOUBLE AS b FROM supplier)")
def j09(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") % 7 + 1) / F.lit(10.0)).alias("a"), ((F.col("s_suppkey") % 5 + 1) / F.lit(10.0)).alias("b"))
    pt = lambda x, y: F.struct((-95 + x).alias("lon"), (28 + y).alias("lat"))
    ring = F.array(pt(F.lit(0.0), F.lit(0.0)), pt(F.col("a"), F.lit(0.0)), pt(F.col("a"), F.col("b")), pt(F.lit(0.0), F.col("b")))
    return s.select("id", r6(geo.ring_area_km2(ring)).alias("km2"))


@query("j11_slick_termini", f"WITH v AS (SELECT c_custkey, c_nationkey AS det_id, -95 + ((c_custkey * 31) % 2000) / 1000.0::DOUBLE AS vlon, 28 + ((c_custkey * 17) % 2000) / 1000.0::DOUBLE AS vlat FROM customer), d AS (SELECT *, {hav('vlon', 'vlat', '-94', '29')} AS d FROM v) SELECT c_custkey FROM d QUALIFY d >= 0.75 * max(d) OVER (PARTITION BY det_id)")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    v = table(spark, sf, "customer").select(k, F.lit("c").alias("case_id"), F.col("c_nationkey").alias("det_id"), (-95 + ((k * 31) % 2000) / F.lit(1000.0)).alias("vlon"), (28 + ((k * 17) % 2000) / F.lit(1000.0)).alias("vlat"), F.lit(-94.0).alias("clon"), F.lit(29.0).alias("clat"))
    return dark.termini(v).select("c_custkey")


@query("j13_circle_ring", "SELECT s_suppkey AS id, 97 AS n, round(28 + (s_suppkey % 9 + 1) / 111.32, 6) AS top FROM supplier")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    ring = geo.circle(-94.0, 28.0, (F.col("s_suppkey") % 9 + 1).cast("double"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.size(ring).alias("n"), r6(F.array_max(F.transform(ring, lambda p: p["lat"]))).alias("top"))


@query("j20_swapped_points", "SELECT count(*) AS n FROM customer WHERE c_custkey % 3 = 0")
def j20(spark: SparkSession, sf: str) -> DataFrame:
    sw = F.col("c_custkey") % 3 == 0
    p = table(spark, sf, "customer").select(F.when(sw, 29.0).otherwise(-94.0).alias("lon"), F.when(sw, -94.0).otherwise(29.0).alias("lat"))
    return p.where(geo.likely_swapped("lon", "lat", -95.0, 28.0, -93.0, 30.0)).agg(F.count("*").alias("n"))


@query("k12_separable_blur", f"""WITH {HIST}, k0 AS (SELECT d, exp(-(d * d) / (2 * 1.5::DOUBLE * 1.5)) AS k FROM range(-4, 5) AS t(d)), k AS (SELECT d, k / sum(k) OVER () AS k FROM k0),
x AS (SELECT r, (c + d) AS c, sum(w * k) AS w FROM h, k WHERE c + d BETWEEN 0 AND 39 GROUP BY 1, 2), y AS (SELECT (r + d) AS r, c, sum(w * k) AS w FROM x, k WHERE r + d BETWEEN 0 AND 39 GROUP BY 1, 2) SELECT r::INTEGER AS r, c::INTEGER AS c, round(w, 5) AS w FROM y""")
def k12(spark: SparkSession, sf: str) -> DataFrame:
    return G.blur(G.histogram2d(positions(spark, sf), HEAD, "sog"), 1.5, 40, 40).select("r", "c", F.round("w", 5).alias("w"))


@query("r01_gap_sessions", f"WITH {POS}, s AS (SELECT mmsi, us, sum(n) OVER (PARTITION BY mmsi ORDER BY us) AS k FROM (SELECT mmsi, us, CASE WHEN us - lag(us) OVER (PARTITION BY mmsi ORDER BY us) < 43200000000 THEN 0 ELSE 1 END AS n FROM pos)) SELECT mmsi, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY mmsi, k")
def r01(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.sessions(positions(spark, sf), 720).select("mmsi", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"), "n")


@query("r02_hourly_counts", f"WITH {POS} SELECT (us // 3600000000) * 3600000000 AS hour_us, source, count(*) AS n FROM pos GROUP BY 1, 2")
def r02(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.hourly_counts(positions(spark, sf)).select(us("hour").alias("hour_us"), "source", "n")
