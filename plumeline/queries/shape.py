"""Shape evidence, frames and gates on the driver's tables and on synthetic scenes."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curves, dark, drift, evaluate, grid as G, image, posterior as P, synth
from ..sources.staging import staged
from .registry import HEAD, POS, positions, query, r6, table


@query("l10_dispersion_ages")
def l10(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("pid") * (6.283185307179586 / 200)
    seeds = spark.range(200).select(F.lit("c").alias("case_id"), F.col("id").cast("int").alias("pid")).select("case_id", "pid", (-94 + 0.003 * F.cos(a)).alias("lon"), (28.5 + 0.003 * F.sin(a)).alias("lat"))
    m = curves.member_diffusivities(drift.member_draws(spark, 12), 2000.0)
    c = curves.dispersion_curves(seeds, m, drift.shear_field(5e-5, 28.5), drift.constant_field(0.0, 0.0), [1.0, 2.0, 4.0, 8.0, 16.0, 32.0], 30.0)
    return curves.age_band(curves.length_ages(c, 3.0), ["case_id"])


@query("l14_track_width_age")
def l14(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("case_id"), (300.0 + 200 * (F.col("s_suppkey") % 5)).alias("width_tail_m"))
    s = curves.track_age_samples(t, 2000)
    lo, hi = F.col("sample_h") < 0.25, F.col("sample_h") > 72
    s = staged(s.select("case_id", F.when(~lo & ~hi, F.col("sample_h")).alias("sample_h"), F.when(lo, "young").when(hi, "old").alias("censored")), "samples")
    g = P.age_grid(spark)
    post = P.fuse(P.kde_log_age(s, g, ["case_id"], 0.25, 72.0).withColumn("weight", F.lit(1.0)), P.log_prior(g), ["case_id"])
    return P.summarise(post, P.log_prior(g), ["case_id"])


@query("j17_density_outline")
def j17(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf).where(F.col("lon").between(-94.4, -93.6) & F.col("lat").between(28.7, 29.3))
    w = G.blur(G.histogram2d(p, HEAD), 1.5, 40, 40).withColumn("case_id", F.lit("c"))
    return curves.density_outline(w, HEAD).select("case_id", F.size("ring").alias("n"), "area_px")


@query("f16_every_nth_frame", "SELECT k, count(*) AS n FROM (SELECT l_orderkey % 7 AS k, l_linenumber * 6 AS s FROM lineitem) WHERE s % 3 = 0 GROUP BY k")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 7).alias("case_id"), (F.col("l_linenumber") * 6).alias("step"))
    return curves.every_nth_frame(p, 3).groupBy(F.col("case_id").alias("k")).agg(F.count("*").alias("n"))


@query("f20_frame_lookup", "SELECT l_orderkey % 9 AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 3 GROUP BY 1")
def f20(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 9).alias("case_id"), F.col("l_linenumber").alias("step"))
    return curves.frame_at(p, F.lit(0.8), 15.0).groupBy(F.col("case_id").alias("k")).agg(F.count("*").alias("n"))


@query("j15_land_lookup", f"WITH {POS}, l AS (SELECT DISTINCT floor((-95 + ((s_suppkey * 7919) % 2000) / 1000.0::DOUBLE) / 0.1)::INTEGER AS cx, floor((28 + ((s_suppkey * 104729) % 2000) / 1000.0::DOUBLE) / 0.1)::INTEGER AS cy FROM supplier) SELECT (cx IS NOT NULL) AS is_land, count(*) AS n FROM pos LEFT JOIN l ON cx = floor(lon / 0.1)::INTEGER AND cy = floor(lat / 0.1)::INTEGER GROUP BY 1")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    land = table(spark, sf, "supplier").select(F.floor((-95 + ((k * 7919) % 2000) / F.lit(1000.0)) / 0.1).cast("int").alias("cx"), F.floor((28 + ((k * 104729) % 2000) / F.lit(1000.0)) / 0.1).cast("int").alias("cy"))
    return curves.on_land(positions(spark, sf), land, 0.1).groupBy("is_land").agg(F.count("*").alias("n"))


@query("n19_scene_gate", "SELECT l_suppkey AS scene_id, count(*) AS n FROM lineitem WHERE l_suppkey % 10 / 10.0 >= 0.3 GROUP BY 1")
def n19(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("scene_id"))
    g = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), (F.col("s_suppkey") % 10 / F.lit(10.0)).alias("p_oil"))
    return curves.gated_scenes(d, g, 0.3).groupBy("scene_id").agg(F.count("*").alias("n"))


@query("u21_erased_scenes", "SELECT l_returnflag AS scene_id, round(sum(CASE WHEN l_linenumber = 1 THEN m ELSE l_quantity END), 3) AS s FROM lineitem JOIN (SELECT l_returnflag AS f, median(l_quantity) AS m FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1) ON f = l_returnflag GROUP BY 1")
def u21(spark: SparkSession, sf: str) -> DataFrame:
    px = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene_id"), F.col("l_quantity").alias("db"), (F.col("l_linenumber") == 1).cast("int").alias("gt"))
    return curves.erased_scenes(px).groupBy("scene_id").agg(F.round(F.sum("db"), 3).alias("s"))


@query("i13_log_sum_exp", "SELECT l_suppkey AS k, round(max(l_quantity) + ln(sum(exp(l_quantity - 50))) - (max(l_quantity) - 50), 6) AS v FROM lineitem GROUP BY 1")
def i13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(r6(F.lit(50.0) + F.log(F.sum(F.exp(F.col("l_quantity") - 50)))).alias("v"))


@query("i21_hemisphere_text", f"WITH {POS} SELECT event_id, printf('%.3f', abs(lat)) || CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || ' ' || printf('%.3f', abs(lon)) || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END AS said FROM pos")
def i21(spark: SparkSession, sf: str) -> DataFrame:
    half = lambda c, a, b: F.concat(F.format_string("%.3f", F.abs(c)), F.when(F.col(c) < 0, a).otherwise(b))
    return positions(spark, sf).select("event_id", F.concat(half("lat", "S", "N"), F.lit(" "), half("lon", "W", "E")).alias("said"))


@query("u01_own_contacts", "SELECT c_custkey AS contact_id, CASE WHEN c_custkey % 5 > 0 THEN round_even(sqrt(c_custkey % 5) * 10.5, 0) END AS est_length_m FROM customer")
def u01(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    s = table(spark, sf, "customer").select(F.lit("c").alias("case_id"), k.alias("contact_id"), F.lit(1.0).alias("lon"), F.lit(1.0).alias("lat"), (k % 5).alias("px_area"))
    return dark.own_contacts(s, F.lit(10.5)).select("contact_id", F.col("est_length_m").cast("double").alias("est_length_m"))


@query("o06_gated_and_ungated", "SELECT g AS gated, round(sum(CASE WHEN g AND l_suppkey % 3 = 0 THEN 0 ELSE l_quantity END) / sum(l_quantity + l_linenumber), 6) AS pooled_iou FROM lineitem, (VALUES (TRUE), (FALSE)) AS v(g) GROUP BY g")
def o06(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumn("gated", F.explode(F.array(F.lit(True), F.lit(False))))
    q = F.when(F.col("gated") & (F.col("l_suppkey") % 3 == 0), 0.0).otherwise(F.col("l_quantity"))
    d = d.select("gated", q.alias("inter"), (F.col("l_quantity") + F.col("l_linenumber")).alias("uni"), q.alias("pred"), F.col("l_quantity").alias("gt"))
    return evaluate.overlaps(d, ["gated"]).select("gated", r6("pooled_iou").alias("pooled_iou"))


@query("f17_age_horizon", "SELECT s_suppkey AS case_id, CASE s_suppkey % 3 WHEN 0 THEN 15.0::DOUBLE WHEN 1 THEN 30.0 ELSE 45.0 END AS output_min, CASE s_suppkey % 3 WHEN 0 THEN 41 WHEN 1 THEN 81 ELSE 97 END::BIGINT AS n, CASE s_suppkey % 3 WHEN 0 THEN 40 WHEN 1 THEN 160 ELSE 288 END::BIGINT AS last FROM supplier")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of every supplier's case: a short age, a long one, none."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    p = s.select(k.alias("case_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(288).cast("long"))).alias("step"))
    b = s.select(k.alias("case_id"), F.when(k % 3 == 0, 9.9).when(k % 3 == 1, 40.0).alias("hi_h"))
    return curves.horizon_frames(p, b, 15.0).groupBy("case_id", "output_min").agg(F.count("*").alias("n"), F.max("step").alias("last"))


@query("i14_normal_quantile")
def i14(spark: SparkSession, sf: str) -> DataFrame:
    p = (F.col("c_custkey") % 999 + 1) / 1000
    return table(spark, sf, "customer").select("c_custkey", p.alias("p"), S.normal_quantile(p).alias("z"))
