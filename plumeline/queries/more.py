"""Slicks, comparisons, calibration and remaining rules on the driver's tables."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import age, compare, drift, evaluate, grid as G, image, posterior as P, slick, synth, tracks, validate as V
from ..sources import readers, sinks
from .registry import ORACLES, POS, T0, T0_US, T1, T1_US, hav, instant, positions, query, r6, table, us


def _cloud(spark: SparkSession, sf: str, shift: float = 0.0) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.lit("c").alias("case_id"), F.lit(0).alias("member"), F.col("l_linenumber").alias("step"), (F.col("l_orderkey") % 100).alias("pid"), (F.col("l_quantity") / 50 + shift).alias("lon"), (F.col("l_discount") * 10).alias("lat"))


def _disp(a: str, b: str, c: str, d: str) -> str:
    return f"(sqrt(pow(((((({c}) - ({a}) + 180) % 360) + 360) % 360 - 180) * greatest(cos(radians((({b}) + ({d})) / 2)), 1e-6) * 111320, 2) + pow((({d}) - ({b})) * 111320, 2)) / 1000)"


@query("b11_forward_impact", "SELECT s_suppkey AS case_id, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE round(s_suppkey % 10 / 10.0::DOUBLE, 6) END AS stranded_fraction, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 10 > 0 THEN s_suppkey::DOUBLE END AS landfall_h FROM supplier")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    heads = s.select(k.alias("case_id"), F.lit(48).alias("hours"), F.lit(5.0).alias("radius_50_km"), F.lit(9.0).alias("radius_90_km"))
    land = s.where("s_suppkey % 3 <> 0").select(k.alias("case_id"), (k % 10 / F.lit(10.0)).alias("stranded_fraction"), k.cast("double").alias("first_h"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))
    return compare.forward_impact(heads, land).select("case_id", r6("stranded_fraction").alias("stranded_fraction"), "landfall_h")


@query("b13_renamed_projection", "SELECT n_nationkey AS caseId, n_name AS displayName, NULL::VARCHAR AS note FROM nation")
def b13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "caseId", "n_name": "displayName"}).select("caseId", "displayName", F.lit(None).cast("string").alias("note"))


@query("a17_box_drift", "SELECT s_suppkey AS scene_id, s_suppkey % 4 <> 0 AS agrees FROM supplier")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    a = table(spark, sf, "supplier").select(k.alias("scene_id"), *(F.lit(1.0).alias(c) for c in ("west", "south", "east", "north")))
    b = a.withColumn("east", F.when(F.col("scene_id") % 4 == 0, 1.01).otherwise(1.0005))
    return readers.box_drift(a, b).select("scene_id", "agrees")


@query("a17_pixels_from_bytes", "SELECT l_linenumber AS value, round(-30 + l_linenumber / 255.0::DOUBLE * 25, 6) AS db, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def a17b(spark: SparkSession, sf: str) -> DataFrame:
    d = readers.pixels_from_bytes(table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("value")), -30.0, -5.0)
    return d.groupBy("value", r6("db").alias("db")).agg(F.count("*").alias("n"))


@query("u43_first_pass", "WITH i AS (SELECT c_custkey AS case_id, TIMESTAMP '1998-01-01' AS t FROM customer), b AS (SELECT case_id, i.t AS t0, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS scene_id, min(o_orderdate) AS t1 FROM i LEFT JOIN orders ON o_custkey = case_id AND o_orderdate >= i.t GROUP BY 1, 2) SELECT case_id, scene_id, CASE WHEN epoch_us(t1) - epoch_us(t0) <= 3 * 86400000000 THEN 'green' WHEN epoch_us(t1) - epoch_us(t0) <= 10 * 86400000000 THEN 'amber' ELSE 'red' END AS light FROM b")
def u43(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").cast("timestamp").alias("t"))
    i = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), instant("1998-01-01T00:00:00Z").alias("t_incident"))
    return readers.first_pass(c, i).select("case_id", "scene_id", "light")


@query("a21_feature_collections", "SELECT s_nationkey AS case_id, count(*)::INTEGER AS n FROM supplier GROUP BY 1")
def a21f(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("case_id"), F.col("s_suppkey").alias("id"), geo.circle(-94.0, 28.0, 5.0, 8).alias("ring"), F.struct("s_name").alias("properties"))
    d = sinks.feature_collections(s)
    return d.select("case_id", F.size(F.from_json("body", "features array<struct<id:bigint>>")["features"]).alias("n"))


@query("e33_landfall", """WITH f AS (SELECT l_orderkey % 10 AS k, l_orderkey AS pid, min(l_linenumber) AS s, arg_min(l_quantity, l_linenumber * 100000000 + l_partkey) AS lon FROM lineitem WHERE l_discount > 0.08 GROUP BY 1, 2), t AS (SELECT l_orderkey % 10 AS k, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT t.k, n, count(pid) AS n_ashore, round(min(s) * 0.25::DOUBLE, 6) AS first_h, round(count(pid) / n, 6) AS stranded_fraction FROM t LEFT JOIN f ON f.k = t.k GROUP BY t.k, n""")
def e33(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 10).alias("case_id"), F.lit(0).alias("member"), F.col("l_linenumber").alias("step"), F.col("l_orderkey").alias("pid"), F.col("l_quantity").alias("lon"), F.lit(1.0).alias("lat"), (F.col("l_discount") > 0.08).alias("stranded"))
    return drift.landfall(p, 15.0).select(F.col("case_id").alias("k"), "n", "n_ashore", r6("first_h").alias("first_h"), r6("stranded_fraction").alias("stranded_fraction"))


@query("e36_calibration", "SELECT l_returnflag AS field, count(*) AS n, count(*) FILTER (WHERE l_linenumber <> 4) AS answered, round(avg((l_quantity BETWEEN 10 AND 10 + l_linenumber * 5)::INTEGER) FILTER (WHERE l_linenumber <> 4), 6) AS coverage FROM lineitem GROUP BY 1")
def e36(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("field"), F.col("l_quantity").alias("truth_h"), F.when(F.col("l_linenumber") != 4, 10.0).alias("lo_h"), F.when(F.col("l_linenumber") != 4, 10.0 + F.col("l_linenumber") * 5).alias("hi_h"), F.col("l_discount").alias("p_truth"), F.col("l_tax").alias("pit"))
    return compare.calibration(t, ["field"]).select("field", "n", "answered", r6("coverage").alias("coverage"))


@query("e36_leave_one_field_out", "SELECT b.f AS without, count(*) AS n FROM lineitem JOIN (SELECT DISTINCT l_returnflag AS f FROM lineitem) AS b ON l_returnflag <> b.f GROUP BY b.f")
def e36b(spark: SparkSession, sf: str) -> DataFrame:
    return compare.leave_one_out(table(spark, sf, "lineitem").withColumn("field", F.col("l_returnflag"))).groupBy("without").agg(F.count("*").alias("n"))


@query("f08_monotone_curves", """WITH c AS (SELECT l_suppkey AS k, l_partkey * 10 + l_linenumber AS s, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2), d AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY s) AS b FROM c), x AS (SELECT k, min(s) FILTER (WHERE v >= 40) AS crossing FROM d GROUP BY k)
SELECT x.k, crossing, coalesce(bool_and(v >= b - 0.02 * abs(b)) FILTER (WHERE b IS NOT NULL AND s <= crossing), TRUE) AS monotone FROM x JOIN d ON d.k = x.k GROUP BY x.k, crossing HAVING crossing IS NOT NULL""")
def f08(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("kk"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("k")).agg(F.max("l_quantity").alias("v"))
    return age.monotone_until(c, ["kk"], 40.0).where("crossing is not null").select(F.col("kk").alias("k"), "crossing", "monotone")


@query("g04_silent_vessels", f"WITH {POS} SELECT mmsi, row_number() OVER (ORDER BY km NULLS LAST, mmsi)::INTEGER AS place FROM (SELECT mmsi, round(min({hav('lon', 'lat', '-94', '29')}) FILTER (WHERE us BETWEEN {T0_US} AND {T1_US}), 3) AS km FROM pos GROUP BY mmsi) QUALIFY place <= 20")
def g04(spark: SparkSession, sf: str) -> DataFrame:
    inside = F.col("ts").between(instant(T0), instant(T1))
    v = positions(spark, sf).groupBy("mmsi").agg(F.round(F.min(F.when(inside, geo.haversine_km("lon", "lat", -94.0, 29.0))), 3).alias("km"))
    return v.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("km"), "mmsi"))).where("place <= 20").select("mmsi", "place")


@query("g06_best_feature", "SELECT l_suppkey AS case_id, l_orderkey * 10 + l_linenumber AS det_id FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_tax DESC, l_orderkey * 10 + l_linenumber) = 1")
def g06(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("case_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("det_id"), F.col("l_tax").alias("confidence"), F.when(F.col("l_returnflag") == "R", "oil").otherwise("lookalike").alias("classification"))
    return slick.best_feature(d).select("case_id", "det_id")


@query("g07_chosen_tiles", "WITH t AS (SELECT l_suppkey AS scene_id, l_linenumber AS tc, avg((l_discount > 0.09)::INTEGER) AS f FROM lineitem GROUP BY 1, 2) SELECT scene_id, count(*) FILTER (WHERE f > 0) AS n_pos FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY f DESC, tc) AS k FROM t) WHERE k <= 3 GROUP BY scene_id HAVING count(*) FILTER (WHERE f > 0) > 0")
def g07(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("scene_id"), F.lit(0).alias("tr"), F.col("l_linenumber").alias("tc")).agg(F.avg((F.col("l_discount") > 0.09).cast("int")).alias("oil_frac"), F.avg("l_quantity").alias("mean_db"))
    return image.choose_tiles(t, 3, 2).where("role = 'positive'").groupBy("scene_id").agg(F.count("*").alias("n_pos"))


@query("h06_model_pool", "SELECT l_returnflag AS model, count(*) AS n, round(sum(1.0::DOUBLE / c / 3), 6) AS total FROM (SELECT l_returnflag, count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem) GROUP BY 1")
def h06(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(F.lit("c").alias("case_id"), F.col("l_returnflag").alias("model"))
    return drift.pool_models(d).groupBy("model").agg(F.count("*").alias("n"), r6(F.sum("w")).alias("total"))


def _outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Three parts of a ribbon and a lone patch in each of a few cases, or of all."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("case"), F.col("s_suppkey").cast("string")).alias("case_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    x = F.when(F.col("k") < 3, -94.0 + F.col("k") * 0.101).otherwise(-93.0)
    y = F.when(F.col("k") < 3, 28.5).otherwise(29.4)
    corner = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    return s.select("case_id", F.concat(F.lit("d"), F.col("k").cast("string")).alias("det_id"), F.lit("oil").alias("classification"), F.array(F.array(corner(0.0, 0.0), corner(0.1, 0.0), corner(0.1, 0.01), corner(0.0, 0.01))).alias("parts"), x.alias("lon"), y.alias("lat"), (F.col("k") + 1.0).alias("area_km2"), F.lit("unknown").alias("discharge_class"), F.lit(0.5).alias("confidence"), F.lit(4.0).alias("elongation"))


@query("h07_spill_groups", "SELECT 'case' || s_suppkey AS case_id, d AS det_id, CASE WHEN d = 'd3' THEN 2 ELSE 1 END AS group_id FROM supplier, (VALUES ('d0'), ('d1'), ('d2'), ('d3')) AS v(d)")
def h07(spark: SparkSession, sf: str) -> DataFrame:
    return slick.spill_groups(slick.outline_points(_outlines(spark, sf)))


@query("k14_ribbon_measures", "SELECT 'case' || s_suppkey AS case_id, 3::BIGINT AS n_parts, TRUE AS is_ribbon FROM supplier")
def k14(spark: SparkSession, sf: str) -> DataFrame:
    return slick.ribbon_measures(slick.outline_points(_outlines(spark, sf)).where("det_id <> 'd3'"), ["case_id"]).select("case_id", "n_parts", "is_ribbon")


@query("k15_merged_features", "SELECT 'case' || s_suppkey AS case_id, id, a AS area_km2, p AS place FROM supplier, (VALUES ('d2+d1+d0', 6.0::DOUBLE, 1), ('d3', 4.0, 2)) AS v(id, a, p)")
def k15(spark: SparkSession, sf: str) -> DataFrame:
    d = _outlines(spark, sf)
    return slick.merged_features(d, slick.spill_groups(slick.outline_points(d))).select("case_id", "id", "area_km2", "place")


@query("k17_seeds", "SELECT s_suppkey AS case_id, CASE s_suppkey % 4 WHEN 0 THEN 'line' WHEN 1 THEN 'point' WHEN 2 THEN 'line' ELSE 'point' END AS kind, 50::BIGINT AS n FROM supplier")
def k17(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    kind = slick.seed_shape(F.when(k == 0, "chronic").when(k == 1, "acute").otherwise("unknown"), F.when(k == 2, "linear").otherwise("blob"))
    f = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id"), kind.alias("kind"), F.lit(-94.0).alias("lon"), F.lit(28.0).alias("lat"), F.lit(30.0).alias("axis_deg"), F.lit(5.0).alias("length_km"))
    n = slick.seed_particles(f, 50).groupBy("case_id").agg(F.count("*").alias("n"))
    return f.join(n, "case_id").select("case_id", "kind", "n")


@query("k18_run_guards", "SELECT 'displacement_km' AS guard, TRUE AS ok UNION ALL SELECT 'max_speed_ms', TRUE")
def k18(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.lit("c").alias("case_id"), F.col("s_suppkey").cast("int").alias("pid"), F.lit(-94.0).alias("lon"), F.lit(28.5).alias("lat"))
    one = spark.createDataFrame([(0, 0.03, 1.0)], "member int, wind_share double, current_scale double")
    d = drift.run_ensemble(s, one, drift.constant_field(0.3, 0.1), drift.constant_field(4.0, 0.0), 0.0, 15.0, 97, steps=list(range(0, 97, 8)))
    return drift.run_guards(d, 15.0).select("guard", "ok")


@query("k20_model_separation", f"""WITH p AS (SELECT l_linenumber AS s, l_quantity / 50 AS lon, l_discount * 10 AS lat FROM lineitem), c AS (SELECT s, avg(lon) AS x, avg(lat) AS y FROM p GROUP BY s) SELECT s AS step, round({_disp('x', 'y', 'x + 0.1', 'y')}, 5) AS separation_km FROM c""")
def k20(spark: SparkSession, sf: str) -> DataFrame:
    return compare.separation(_cloud(spark, sf), _cloud(spark, sf, 0.1), ["step"]).select("step", F.round("separation_km", 5).alias("separation_km"))


@query("k22_growth", "SELECT l_linenumber * 0.25::DOUBLE AS hours_back, 1::BIGINT AS n FROM lineitem GROUP BY 1")
def k22(spark: SparkSession, sf: str) -> DataFrame:
    return compare.growth(_cloud(spark, sf), 15.0).where("r90_km >= r50_km").groupBy("hours_back").agg(F.count("*").alias("n"))


@query("k24_required_pad", "SELECT p_partkey, round(greatest(55, 1.3 * 3.6 * p_size / 20.0::DOUBLE * 48) / (111.32 * greatest(cos(radians(p_size)), 0.01)), 6) AS pad_lon FROM part")
def k24(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", r6(compare.required_pad_deg(s / F.lit(20.0), F.lit(48.0), s.cast("double"))[0]).alias("pad_lon"))


@query("d15_particle_matching", "SELECT s_suppkey::INTEGER AS pid, (-1 - s_suppkey)::INTEGER AS pid2 FROM supplier")
def d15(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey").cast("int")
    case = F.floor(k / 500).cast("string")  # a case is matched in one group
    a = table(spark, sf, "supplier").select(case.alias("case_id"), k.alias("pid"), (-94 + k % 500 * 0.001).alias("lon"), F.lit(28.0).alias("lat"))
    b = a.select("case_id", (F.lit(-1) - F.col("pid")).alias("pid"), (F.col("lon") + 1e-7).alias("lon"), "lat")
    return compare.match_particles(a, b).select("pid", "pid2")


@query("d17_mask_overlap", "SELECT l_returnflag AS scene_id, round(count(*) FILTER (WHERE l_quantity > 20 AND l_tax > 0.02) / count(*) FILTER (WHERE l_quantity > 20 OR l_tax > 0.02), 6) AS iou FROM lineitem GROUP BY 1")
def d17(spark: SparkSession, sf: str) -> DataFrame:
    p, g = F.col("l_quantity") > 20, F.col("l_tax") > 0.02
    s = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("scene_id")).agg(F.count_if(p & g).alias("inter"), F.count_if(p | g).alias("uni"), F.count_if(p).alias("pred"), F.count_if(g).alias("gt"))
    return evaluate.overlaps(s, ["scene_id"]).select("scene_id", r6("pooled_iou").alias("iou"))


@query("l02_floored_likelihood", "WITH b AS (SELECT l_suppkey AS k, l_linenumber AS age_h, min(-l_quantity) AS ll FROM lineitem GROUP BY 1, 2) SELECT k, age_h, round(greatest(ll, max(ll) OVER (PARTITION BY k) + ln(1e-4)), 6) AS ll FROM b")
def l02(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("age_h")).agg(F.min(-F.col("l_quantity")).alias("ll"))
    return P.floored(b, ["k"]).select("k", "age_h", r6("ll").alias("ll"))


@query("i15_log_age_interpolation", """WITH ages AS (SELECT i * 0.25::DOUBLE AS age_h FROM range(1, 289) AS t(i)), c AS (SELECT s_suppkey AS case_id, h, l / (1 + s_suppkey % 5) AS l FROM supplier, (VALUES (1.0::DOUBLE, 0.1::DOUBLE), (4.0, 0.9), (16.0, 0.3), (48.0, 0.05)) AS v(h, l)), d AS (SELECT *, lead(h) OVER (PARTITION BY case_id ORDER BY h) AS h2, lead(l) OVER (PARTITION BY case_id ORDER BY h) AS l2 FROM c),
v AS (SELECT case_id, age_h, CASE WHEN age_h < 1 OR h2 IS NULL THEN l ELSE l + (ln(age_h) - ln(h)) / (ln(h2) - ln(h)) * (l2 - l) END AS v FROM ages JOIN d ON (age_h >= h AND (age_h < h2 OR h2 IS NULL)) OR (age_h < 1 AND h = 1)) SELECT case_id, age_h, round(ln(v), 6) AS ll FROM v""")
def i15(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    few = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(v).alias("v")) for h, v in ((1.0, 0.1), (4.0, 0.9), (16.0, 0.3), (48.0, 0.05)))))
    c = table(spark, sf, "supplier").withColumn("x", few).select(k.alias("case_id"), F.col("x.h").alias("hours"), (F.col("x.v") / (1 + k % 5)).alias("lik"))
    return P.interpolate_likelihood(c, P.age_grid(spark), ["case_id"]).select("case_id", "age_h", r6("ll").alias("ll"))


@query("l08_pit", "WITH p AS (SELECT i * 0.25::DOUBLE AS age_h, 1 / 288.0::DOUBLE AS p FROM range(1, 289) AS t(i)) SELECT p_partkey AS k, round(least(1, greatest(1 / 288.0::DOUBLE, (p_size / 0.25::DOUBLE) / 288)), 6) AS pit FROM part")
def l08b(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("truth_h"))
    post = t.select("k").crossJoin(P.age_grid(spark)).withColumn("p", F.lit(1 / 288))
    return P.pit(post, t, ["k"]).select("k", r6("pit").alias("pit"))


@query("l11_shape_likelihood", "SELECT l_linenumber::DOUBLE AS hours, round(avg(exp(-0.5 * (pow((ln(l_quantity) - 3) / 0.35, 2) + pow((ln(l_tax + 1) - 0.05) / 0.45, 2)) + 2 * (cos(2 * radians(l_suppkey % 180 - 30)) - 1))), 8) AS lik FROM lineitem GROUP BY 1")
def l11(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").select(F.lit("c").alias("case_id"), F.col("l_linenumber").cast("double").alias("hours"), F.log("l_quantity").alias("ln_length"), F.log(F.col("l_tax") + 1).alias("ln_width"), (F.col("l_suppkey") % 180).alias("axis_deg"))
    return age.shape_likelihood(m, 3.0, 0.05, 30.0).select("hours", F.round("lik", 8).alias("lik"))


@query("l18_deformation_rate", "SELECT l_orderkey, l_linenumber, round(sqrt(pow((l_quantity / 100 - l_tax) / 9000 - (l_discount - l_tax) / 9000, 2) + pow((l_discount - l_quantity / 100) / 9000 + (l_tax - l_discount) / 9000, 2)) * 1e6, 5) AS rate FROM lineitem")
def l18(spark: SparkSession, sf: str) -> DataFrame:
    q, d, t = F.col("l_quantity") / 100, F.col("l_discount"), F.col("l_tax")
    rate = age.deformation_rate((q, d), (t, q), (t, d), (d, t), F.lit(9000.0), F.lit(9000.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(rate * 1e6, 5).alias("rate"))


@query("n13_usable_band", "SELECT l_returnflag AS scene_id, round(median(-l_quantity), 6) AS med, median(-l_quantity) > -24 AS usable FROM lineitem GROUP BY 1")
def n13(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("scene_id")).agg(F.median(-F.col("l_quantity")).alias("m"))
    return d.select("scene_id", r6("m").alias("med"), (F.col("m") > image.VH_USABLE_DB).alias("usable"))


@query("n01_sea_reference", "WITH b AS (SELECT l_returnflag AS scene_id, l_partkey // 51 AS br, l_suppkey // 51 AS bc, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2, 3) SELECT scene_id, round(quantile_cont(m, 0.2), 6) AS sea_db FROM b GROUP BY 1")
def n01(spark: SparkSession, sf: str) -> DataFrame:
    px = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene_id"), F.col("l_partkey").alias("r"), F.col("l_suppkey").alias("c"), F.col("l_quantity").alias("db"))
    return image.sea_reference(px).select("scene_id", r6("sea_db").alias("sea_db"))


@query("n02_depth_of_row_closing", "WITH p AS (SELECT l_suppkey AS r, l_partkey * 10 + l_linenumber AS c, max(l_quantity) AS db FROM lineitem GROUP BY 1, 2), a AS (SELECT *, max(db) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM p) SELECT r, c, min(m) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - db AS depth FROM a")
def n02(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("r").orderBy("c").rowsBetween(-2, 2)
    p = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("r"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("c")).agg(F.max("l_quantity").alias("db"))
    return p.withColumn("m", F.max("db").over(w)).withColumn("depth", F.min("m").over(w) - F.col("db")).select("r", "c", "depth")


@query("n21_threshold_sweep", "WITH k AS (SELECT i / 2.0::DOUBLE AS k FROM range(1, 9) AS t(i)) SELECT k, round(count(*) FILTER (WHERE l_quantity > k * 10 AND l_tax > 0.04) / count(*) FILTER (WHERE l_quantity > k * 10 OR l_tax > 0.04), 6) AS iou FROM lineitem, k GROUP BY k")
def n21(spark: SparkSession, sf: str) -> DataFrame:
    k = F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: i / F.lit(2.0)))
    d = table(spark, sf, "lineitem").select("l_quantity", "l_tax", k.alias("k"))
    p, g = F.col("l_quantity") > F.col("k") * 10, F.col("l_tax") > 0.04
    return d.groupBy("k").agg(r6(F.count_if(p & g) / F.count_if(p | g)).alias("iou"))


@query("j14_burned_polygon", """WITH px AS (SELECT c_nationkey AS scene_id, c_custkey // 20 AS r, c_custkey % 20 AS c, c_custkey % 20 + 0.5 AS x, c_custkey // 20 % 40 + 0.5 AS y FROM customer),
b AS (SELECT s_nationkey AS scene_id, s_suppkey % 7 AS x0, s_suppkey % 7 + 4 + s_suppkey % 5 AS x1, s_suppkey % 11 AS y0, s_suppkey % 11 + 6 + s_suppkey % 9 AS y1 FROM supplier)
SELECT DISTINCT scene_id, r, c FROM px JOIN b USING (scene_id) WHERE x > x0 AND x < x1 AND y > y0 AND y < y1""")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines of a nation's suppliers burned on pixels that its customers make."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    px = table(spark, sf, "customer").select(F.col("c_nationkey").alias("scene_id"), F.floor(k / 20).alias("r"), (k % 20).alias("c"), (k % 20 + 0.5).alias("lon"), (F.floor(k / 20) % 40 + 0.5).alias("lat"))
    x, y = s % 7, s % 11
    pt = lambda a, b: F.struct(a.cast("double").alias("lon"), b.cast("double").alias("lat"))
    right, top = x + 4 + s % 5, y + 6 + s % 9
    rings = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("scene_id"), F.array(pt(x, y), pt(right, y), pt(right, top), pt(x, top)).alias("ring"))
    return image.burn(rings, px).select("scene_id", "r", "c")


@query("j16_ellipse_ring", "SELECT s_suppkey AS id, round(28 + (s_suppkey % 9 + 2) / 111.32, 6) AS top FROM supplier")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    ring = geo.ellipse(-94.0, 28.0, (F.col("s_suppkey") % 9 + 2).cast("double"), 1.0, 0.0)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), r6(F.array_max(F.transform(ring, lambda p: p["lat"]))).alias("top"))


@query("j18_pixel_size", f"SELECT s_suppkey AS id, round({hav('-95', '28.5', '-93', '28.5')} / (s_suppkey + 10), 6) AS w_km, round({hav('-95', '28', '-95', '29')} / (s_suppkey + 5), 6) AS h_km FROM supplier")
def j18(spark: SparkSession, sf: str) -> DataFrame:
    w, h = geo.pixel_km(-95.0, 28.0, -93.0, 29.0, (F.col("s_suppkey") + 10).cast("double"), (F.col("s_suppkey") + 5).cast("double"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), r6(w).alias("w_km"), r6(h).alias("h_km"))


@query("u23_field_coverage", "SELECT l_suppkey AS case_id, max(a) AS t_lo, min(b) AS t_hi FROM (SELECT l_suppkey, l_returnflag, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def u23(spark: SparkSession, sf: str) -> DataFrame:
    return compare.field_coverage(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("t_epoch")))


@query("u26_release_points", "SELECT l_linenumber * 0.25::DOUBLE AS age_h, round(median(l_quantity / 50), 6) AS lon, round(median(l_discount * 10), 6) AS lat FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1")
def u26(spark: SparkSession, sf: str) -> DataFrame:
    ages = spark.range(1, 5).select(F.lit("c").alias("case_id"), (F.col("id") * 0.25).alias("age_h"))
    return compare.release_points(_cloud(spark, sf), ages, 15.0).select("age_h", r6("lon").alias("lon"), r6("lat").alias("lat"))


@query("o01_region_forest")
def o01(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("quality").cast("double").alias("label"), F.col("n_chars").cast("double").alias("a"), F.length(F.regexp_replace("text", "[^!$#%&|]", "")).cast("double").alias("b"))
    v = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(evaluate.balanced(d))
    out = evaluate.region_model(20).fit(v).transform(v)
    return evaluate.confusion(out.select("label", F.col("prediction").alias("predicted")), []).select("tp", "fp", "fn", "tn")


@query("q01_meta_rules", "SELECT s_suppkey AS case_id, 'meta.case_type' AS rule FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT s_suppkey, 'meta.attribute_needs_trace' FROM supplier WHERE s_suppkey % 4 = 0")
def q01(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    acts = F.when(k % 4 == 0, F.array(F.lit("detect"), F.lit("attribute"))).otherwise(F.array(F.lit("detect"), F.lit("trace"), F.lit("attribute")))
    m = table(spark, sf, "supplier").select(k.alias("case_id"), F.lit("t").alias("t0"), F.when(k % 6 == 0, "other").otherwise("spill").alias("case_type"), F.lit("satellite").alias("provenance"), acts.alias("acts_available"), F.lit("noaa_dense").alias("ais_source"))
    return V.check_meta(m).select("case_id", "rule")


@query("q03_detection_rules", "SELECT s_suppkey AS case_id, 'detections.ring_area' AS rule FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'detections.confidence' FROM supplier WHERE s_suppkey % 5 = 0")
def q03(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    pt = lambda x, y: F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat"))
    ring = F.array(pt(-94.0, 28.5), pt(-93.9, 28.5), pt(-93.9, 28.6), pt(-94.0, 28.6))
    d = table(spark, sf, "supplier").select(k.alias("case_id"), F.lit("det-01").alias("id"), F.lit("oil").alias("classification"), F.when(k % 5 == 0, 1.5).otherwise(0.5).alias("confidence"), F.when(k % 3 == 0, 500.0).otherwise(108.0).alias("area_km2"), F.lit("blob").alias("shape_class"), F.lit("acute").alias("discharge_class"), F.lit(1.5).alias("elongation"), ring.alias("ring"))
    b = d.select("case_id", F.lit(-95.0).alias("west"), F.lit(28.0).alias("south"), F.lit(-93.0).alias("east"), F.lit(30.0).alias("north"))
    return V.check_detections(d, b).select("case_id", "rule")


@query("q04_contact_rules", "SELECT s_suppkey AS case_id, 'contacts.px_area' AS rule FROM supplier WHERE s_suppkey % 8 = 0")
def q04(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return V.check_contacts(table(spark, sf, "supplier").select(k.alias("case_id"), k.alias("contact_id"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), (k % 8).alias("px_area"))).select("case_id", "rule")


@query("q05_particle_rules", "SELECT s_suppkey AS case_id, 'particles.constant_number' AS rule FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, 'particles.speed' FROM supplier WHERE s_suppkey % 7 = 0")
def q05(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    p = table(spark, sf, "supplier").select(k.alias("case_id"), F.lit(0).alias("member"), F.explode(F.array(F.lit(0), F.lit(48), F.lit(96))).alias("step")).withColumn("pid", F.explode(F.sequence(F.lit(0), F.when((F.col("case_id") % 5 == 0) & (F.col("step") == 96), 2).otherwise(3))))
    p = p.withColumn("lon", F.lit(-94.0)).withColumn("lat", 28 + F.col("step") * F.when(F.col("case_id") % 7 == 0, 0.1).otherwise(0.01))
    return V.check_particles(p, table(spark, sf, "supplier").select(k.alias("case_id")), 15.0).select("case_id", "rule")


@query("q06_forward_rules", "SELECT s_suppkey AS case_id, 'forward.landfall_null' AS rule FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT s_suppkey, 'forward.monotone' FROM supplier WHERE s_suppkey % 4 = 0")
def q06(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    i = s.select(k.alias("case_id"), F.lit(5.0).alias("radius_50_km"), F.lit(6.0).alias("radius_90_km"), F.lit(0.2).alias("stranded_fraction"), F.when(k % 6 != 0, 4.0).alias("landfall_h"))
    c = s.select(k.alias("case_id"), F.posexplode(F.when(k % 4 == 0, F.array(F.lit(0.2), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(0.2)))).alias("hour", "fraction"))
    return V.check_forward(i, c).select("case_id", "rule")


@query("q08_posterior_rules", "SELECT s_suppkey AS case_id, 'posterior.sum' AS rule FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'posterior.band' FROM supplier WHERE s_suppkey % 10 = 0")
def q08(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    p = s.select(k.alias("case_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("ord")).select("case_id", "ord", (F.col("ord") * 0.25).alias("age_h"), F.when(F.col("case_id") % 3 == 0, 0.3).otherwise(0.25).alias("prob"))
    b = s.select(k.alias("case_id"), F.when(k % 10 == 0, 5.0).otherwise(0.2).alias("lo_h"), F.lit(0.8).alias("hi_h"), F.lit(0.5).alias("median_h"))
    return V.check_posterior(p, b).select("case_id", "rule")


@query("q10_track_rules", f"WITH {POS} SELECT mmsi AS place, 'vessels.points' AS rule FROM pos GROUP BY mmsi HAVING count(*) < 2")
def q10(spark: SparkSession, sf: str) -> DataFrame:
    lines = tracks.track_lines(positions(spark, sf)).withColumn("case_id", F.lit("c"))
    return V.check_tracks(lines).select("place", "rule")




@query("q12_verification_rules", "SELECT s_suppkey AS case_id, 'verification.verdict' AS rule FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL SELECT s_suppkey, 'verification.claimed' FROM supplier WHERE s_suppkey % 2 = 1")
def q12(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    v = s.select(k.alias("case_id"), F.when(k % 9 == 0, "maybe").otherwise("hit").alias("verdict"), F.lit("https://example.org").alias("source_url"), F.array(F.when(k % 2 == 1, "1").otherwise("2")).alias("claimed_mmsi"))
    return V.check_verification(v, s.select(k.alias("case_id"), F.lit("2").alias("mmsi"))).select("case_id", "rule")


@query("a27_synthetic_fleet", "SELECT 20::BIGINT AS n_vessels, 500::BIGINT AS n_rows")
def a27(spark: SparkSession, sf: str) -> DataFrame:
    return synth.fleet(spark, 20, 25, T0_US, 10.0, (-95.0, 28.0, -93.0, 30.0)).agg(F.countDistinct("mmsi").alias("n_vessels"), F.count("*").alias("n_rows"))


@query("m18_injected_offenders", f"SELECT s_suppkey AS trial_id, {T0_US} + s_suppkey * 60000000 AS us, round(28 + s_suppkey % 100 / 100.0::DOUBLE, 6) AS lat FROM supplier")
def m18b(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = table(spark, sf, "supplier").select(k.alias("trial_id"), F.lit(-94.0).alias("lon"), (28 + k % 100 / F.lit(100.0)).alias("lat"), (F.lit(T0_US) + k * 60000000).alias("at_us"), (k * 7 % 360).cast("double").alias("cog"), F.lit(12.0).alias("sog"), F.lit(45.0).alias("gap_min"))
    d = synth.offender(spark, t)
    mid = d.join(t.select("trial_id", "at_us"), "trial_id").where(us("ts") == F.col("at_us"))
    return mid.select("trial_id", us("ts").alias("us"), r6("lat").alias("lat"))


@query("c08_strict_overlap", f"WITH {POS}, g AS (SELECT mmsi, us, lead(us) OVER (PARTITION BY mmsi ORDER BY us) AS nus FROM pos) SELECT mmsi, us FROM g WHERE us < {T1_US} AND nus > {T0_US}")
def c08(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.silences_over(tracks.with_gaps(positions(spark, sf)), instant(T0), instant(T1)).select("mmsi", us("ts").alias("us"))


@query("k10_weighted_radii", "WITH p AS (SELECT l_linenumber AS s, l_quantity / 50 AS lon, l_discount * 10 AS lat, l_quantity AS w FROM lineitem) SELECT s AS step, round(sum(lon * w) / sum(w), 6) AS clon, round(sum(lat * w) / sum(w), 6) AS clat FROM p GROUP BY s")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("step"), (F.col("l_quantity") / 50).alias("lon"), (F.col("l_discount") * 10).alias("lat"), F.col("l_quantity").alias("w"))
    return G.radii(li, ["step"], "w").select("step", r6("clon").alias("clon"), r6("clat").alias("clat"))
