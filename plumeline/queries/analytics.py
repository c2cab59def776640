"""Scoring, posteriors, drift, images, validation and evaluation on the driver's tables."""

# ruff: noqa: E501
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import angle_between_deg, bearing_deg, haversine_km
from ..operators import age, dark, drift, evaluate, grid as G, image, posterior as P, score, synth, tracks, validate as V
from ..plans import attribution
from .registry import GRID, HEAD, POS, T0, T0_US, T1, T1_US, ang, brg, grid, hav, instant, positions, query, r6, sampled, table, us
from .spatial import GAPS

SMP = f"{POS}, {GRID}, {sampled()}"
BEST = f"best AS (SELECT mmsi, p AS value, us AS q_us, lon, lat FROM smp WHERE us BETWEEN {T0_US} AND {T1_US} AND p > 0 QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY p DESC, us) = 1)"


def _inside(spark: SparkSession, sf: str) -> DataFrame:
    return positions(spark, sf).where(F.col("ts").between(instant(T0), instant(T1)))


def _best(spark: SparkSession, sf: str) -> DataFrame:
    s = G.sample(_inside(spark, sf), grid(spark), HEAD).select(F.lit("c").alias("case_id"), "mmsi", F.col("ts").alias("at"), "lon", "lat", "p", F.lit(False).alias("walked"))
    return score.proximity(s)


@query("m01_proximity", f"WITH {SMP}, {BEST} SELECT mmsi, value, q_us AS at_us FROM best")
def m01(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf).select("mmsi", "value", us("at").alias("at_us"))


@query("m02_trajectory", f"""WITH {SMP}, {BEST}, o AS (SELECT q.mmsi, arg_max(q.cog, q.us) AS cog, arg_max(q.lon, q.us) AS lon, arg_max(q.lat, q.us) AS lat FROM pos AS q JOIN best AS b ON b.mmsi = q.mmsi AND q.us <= b.q_us WHERE {hav('q.lon', 'q.lat', '-94', '29')} >= 40 GROUP BY q.mmsi)
SELECT mmsi, CASE WHEN {ang('cog', brg('lon', 'lat', '-94', '29'))} <= 60 THEN 1.0::DOUBLE ELSE 0 END AS value FROM o""")
def m02(spark: SparkSession, sf: str) -> DataFrame:
    o = tracks.last_outside(positions(spark, sf), _best(spark, sf).select("mmsi", "at"), -94.0, 29.0, 40.0)
    off = angle_between_deg("cog", bearing_deg("lon", "lat", -94.0, 29.0))
    return o.select("mmsi", score.trajectory(F.lit(True), F.col("cog"), off, F.col("source") == "gfw")[0].alias("value"))


GAP_SQL = f"""WITH {POS}, {GAPS}, big AS (SELECT * FROM g WHERE us < {T1_US} AND nus > {T0_US} QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY nus - us DESC, us) = 1), v AS (SELECT mmsi, count(*) FILTER (WHERE source = 'noaa') AS n FROM pos GROUP BY mmsi),
b AS (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM pos)
SELECT v.mmsi, CASE WHEN v.n = 0 THEN 'hourly record only' WHEN us IS NULL THEN 'continuous coverage' WHEN sog < 2 OR nsog < 2 THEN 'not under way' WHEN least(abs(lon - w), abs(lon - e), abs(lat - s), abs(lat - b.n)) <= 0.02 THEN 'at the edge of the search box'
 WHEN (nus - us) / 60e6 >= 1500 THEN 'silence' ELSE 'short silence' END AS why FROM v CROSS JOIN b LEFT JOIN big ON big.mmsi = v.mmsi"""


@query("m03_gap", GAP_SQL)
def m03(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf)
    big = tracks.silences_over(tracks.with_gaps(p), instant(T0), instant(T1)).groupBy("mmsi").agg(F.max_by(F.struct("gap_min", "sog", "next_sog", "lon", "lat"), F.struct("gap_min", (-us("ts")).alias("t"))).alias("g"))
    v = p.groupBy("mmsi").agg(F.count_if(F.col("source") == "noaa").alias("n")).join(big, "mmsi", "left")
    box = p.agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("nn"))
    v = v.crossJoin(F.broadcast(box))
    edge = score.on_edge(F.col("g.lon"), F.col("g.lat"), *(F.col(c) for c in ("w", "s", "e", "nn")))
    why = score.gap(F.col("n") == 0, F.col("g.gap_min"), F.col("g.sog"), F.col("g.next_sog"), F.lit(False), edge, F.lit(0), 1500.0)[2]
    return v.select("mmsi", why.alias("why"))


@query("m04_slowdown", f"WITH {SMP}, {BEST}, u AS (SELECT mmsi, CASE WHEN count(*) FILTER (WHERE sog >= 2) >= 3 THEN median(sog) FILTER (WHERE sog >= 2) END AS med FROM pos GROUP BY mmsi), f AS (SELECT b.mmsi, arg_min(q.sog, (abs(q.us - b.q_us), q.us)) AS sog FROM best AS b JOIN pos AS q ON q.mmsi = b.mmsi GROUP BY b.mmsi) SELECT mmsi, CASE WHEN med IS NOT NULL THEN CASE WHEN sog <= med * 0.6 THEN 1.0::DOUBLE ELSE 0 END END AS value FROM f JOIN u USING (mmsi)")
def m04(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf)
    f = tracks.nearest_fix(p, _best(spark, sf).select("mmsi", "at")).join(tracks.underway_median(p), "mmsi")
    return f.select("mmsi", score.slowdown(F.lit(False), F.col("sog"), F.col("underway_median"))[0].alias("value"))


@query("m05_temporality", f"WITH {SMP}, {BEST} SELECT mmsi, round(greatest(0, 1 - abs(q_us - ({T0_US} + {T1_US}) / 2) / 1e6 / (({T1_US} - {T0_US}) / 2e6)), 6) AS value FROM best")
def m05(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf).select("mmsi", r6(score.temporality(F.lit("age"), F.col("at"), instant(T0), instant(T1))).alias("value"))


def _components(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as measured components: orders are cases, parts vessels, three values a vessel."""
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).cast("string").alias("case_id"), F.col("l_partkey").cast("string").alias("mmsi"), "l_quantity", "l_discount", "l_tax", "l_linenumber")
    one = li.groupBy("case_id", "mmsi").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.max("l_linenumber").alias("n"))
    value = F.stack(F.lit(3), F.lit("proximity"), F.col("q") / 50, F.lit(False), F.lit("gap"), F.when(F.col("n") > 2, F.when(F.col("d") > 0.05, 1.0).otherwise(0.0)), F.col("n") <= 1, F.lit("type_prior"), F.when(F.col("case_id") == "3", 1.0).otherwise(F.when(F.col("t") > 0.04, 1.0).otherwise(0.5)), F.lit(False)).alias("component", "value", "source_gated")
    return one.select("case_id", "mmsi", value).withColumn("note", F.lit(""))


COMP = """one AS (SELECT (l_suppkey % 20)::VARCHAR AS case_id, l_partkey::VARCHAR AS mmsi, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t, max(l_linenumber) AS n FROM lineitem GROUP BY 1, 2),
comp AS (SELECT case_id, mmsi, 'proximity' AS component, 0.30 / 0.85 AS w, q / 50 AS value, FALSE AS sg FROM one UNION ALL SELECT case_id, mmsi, 'gap', 0.15 / 0.85, CASE WHEN n > 2 THEN (d > 0.05)::INTEGER::DOUBLE END, n <= 1 FROM one
 UNION ALL SELECT case_id, mmsi, 'type_prior', 0.05 / 0.85, CASE WHEN case_id = '3' THEN 1.0 WHEN t > 0.04 THEN 1.0 ELSE 0.5 END, FALSE FROM one),
s AS (SELECT case_id, component, count(*) AS n, count(value) AS m, min(round_even(value, 6)) AS lo, max(round_even(value, 6)) AS hi, bool_or(value IS NULL AND sg) AS src FROM comp GROUP BY ALL),
gated AS (SELECT c.* EXCLUDE (value), CASE WHEN (component = 'type_prior' AND n >= 2 AND m = n AND lo = hi) OR (component = 'gap' AND n >= 2 AND m > 0 AND m < n AND src) THEN NULL ELSE value END AS value FROM comp AS c JOIN s USING (case_id, component)),
scored AS (SELECT case_id, mmsi, round_even(coalesce(least(1, greatest(0, sum(CASE WHEN value IS NOT NULL THEN w::DOUBLE * value END) / sum(CASE WHEN value IS NOT NULL THEN w::DOUBLE END))), 0), 3) AS score, round_even(coalesce(sum(CASE WHEN value IS NOT NULL THEN w::DOUBLE END), 0), 3) AS weight_live, count(value) AS n_applicable FROM gated GROUP BY 1, 2)"""


@query("e14_renormalised_scores", f"WITH {COMP.replace('FROM gated GROUP', 'FROM comp GROUP')} SELECT case_id, mmsi, score, weight_live, n_applicable FROM scored")
def e14(spark: SparkSession, sf: str) -> DataFrame:
    return score.weighted_scores(_components(spark, sf))


@query("e15_gated_components", f"WITH {COMP} SELECT case_id, component, count(*) AS n, count(value) AS m FROM gated GROUP BY 1, 2")
def e15(spark: SparkSession, sf: str) -> DataFrame:
    return score.gate_sources(score.gate_constants(_components(spark, sf))).groupBy("case_id", "component").agg(F.count("*").alias("n"), F.count("value").alias("m"))


@query("f22_ranked_candidates", f"WITH {COMP} SELECT case_id, mmsi, score, weight_live, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, weight_live DESC, n_applicable DESC, q DESC, mmsi)::INTEGER AS rank FROM scored JOIN one USING (case_id, mmsi) QUALIFY rank <= 5")
def f22(spark: SparkSession, sf: str) -> DataFrame:
    c = _components(spark, sf)
    facts = c.where("component = 'proximity'").select("case_id", "mmsi", F.col("value").alias("grid_probability"), F.lit(None).cast("double").alias("closest_km"))
    return score.score_candidates(c, facts).where("rank <= 5").select("case_id", "mmsi", "score", "weight_live", "rank")


@query("m13_ranking_confidence", f"""WITH {COMP}, r AS (SELECT case_id, score, weight_live, row_number() OVER w AS k, lead(score) OVER w AS s1, count(*) OVER (PARTITION BY case_id) AS n FROM scored JOIN one USING (case_id, mmsi) WINDOW w AS (PARTITION BY case_id ORDER BY score DESC, weight_live DESC, n_applicable DESC, q DESC, mmsi))
SELECT case_id, round_even((score - s1) / greatest(score, 1e-9), 4) AS separation, weight_live, CASE WHEN n > 40 THEN 'indicative' WHEN (score - s1) / greatest(score, 1e-9) < 0.03 OR weight_live < 0.4 OR score < 0.25 THEN 'low' WHEN (score - s1) / greatest(score, 1e-9) < 0.10 THEN 'moderate' ELSE 'high' END AS level FROM r WHERE k = 1""")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    c = _components(spark, sf)
    facts = c.where("component = 'proximity'").select("case_id", "mmsi", F.col("value").alias("grid_probability"), F.lit(None).cast("double").alias("closest_km"))
    gated = score.gate_sources(score.gate_constants(c))
    few = score.weighted_scores(gated).join(facts, ["case_id", "mmsi"])
    return score.confidence(score.rank(few), gated).select("case_id", "separation", "weight_live", "level")


@query("e17_shared_basis", f"WITH {COMP} SELECT case_id, string_agg(component, ',' ORDER BY component) AS basis FROM (SELECT case_id, component FROM comp GROUP BY 1, 2 HAVING count(*) = count(value)) GROUP BY case_id")
def e17(spark: SparkSession, sf: str) -> DataFrame:
    c = _components(spark, sf)
    s = c.groupBy("case_id", "component").agg(F.count("*").alias("n"), F.count("value").alias("m")).where("n = m")
    return s.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("component")), ",").alias("basis"))


@query("m12_abstention", "SELECT n_nationkey AS case_id, n_nationkey % 5 < 4 AS abstained, CASE n_nationkey % 5 WHEN 0 THEN 'no archive covers this region' WHEN 1 THEN 'searched and found empty' WHEN 2 THEN 'the origin is too diffuse' WHEN 3 THEN 'no vessel entered the origin' END AS why FROM nation")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    c = table(spark, sf, "nation").select(F.col("n_nationkey").alias("case_id"), (k != 0).alias("has_ais"), F.when(k == 1, 0).otherwise(9).alias("n_rows"), (k == 2).alias("origin_abstain"), F.when(k == 3, 0).otherwise(2).alias("plausible"))
    return score.abstention(c)


@query("m14_exclusion_reasons", f"WITH {SMP}, b AS (SELECT mmsi, max(p) AS p, max(event_id) % 3 AS k FROM smp GROUP BY mmsi) SELECT mmsi, CASE WHEN k = 0 THEN 'heading away from the origin' WHEN k = 1 AND p < 0.3 THEN 'peak grid probability ' || printf('%.2f', p) || ', broadcast throughout' WHEN p < 0.15 THEN 'peak grid probability ' || printf('%.2f', p) END AS reason FROM b WHERE abs(p * 100 - floor(p * 100) - 0.5) > 1e-6")
def m14(spark: SparkSession, sf: str) -> DataFrame:
    b = G.sample(positions(spark, sf), grid(spark), HEAD).groupBy("mmsi").agg(F.max("p").alias("p"), (F.max("event_id") % 3).alias("k"))
    b = b.where(F.abs(F.col("p") * 100 - F.floor(F.col("p") * 100) - 0.5) > 1e-6)
    return b.select("mmsi", score.exclusion_reason(F.col("p"), F.when(F.col("k") == 0, 0.0), F.when(F.col("k") == 1, 0.0)).alias("reason"))


@query("m15_contact_scores", f"""WITH {GRID}, c AS (SELECT s_suppkey AS contact_id, -95 + ((s_suppkey * 7919) % 2000) / 1000.0::DOUBLE AS lon, 28 + ((s_suppkey * 104729) % 2000) / 1000.0::DOUBLE AS lat FROM supplier), {sampled('c')}, d AS (SELECT *, {hav('lon', 'lat', '-94', '29')} AS km FROM smp)
SELECT contact_id, round_even(least(1, greatest(0, p, 1 - km / 30)), 3) AS score FROM d WHERE p > 0.01 OR km <= 30""")
def m15(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = table(spark, sf, "supplier").select(k.alias("contact_id"), (-95 + ((k * 7919) % 2000) / F.lit(1000.0)).alias("lon"), (28 + ((k * 104729) % 2000) / F.lit(1000.0)).alias("lat"))
    c = G.sample(c, grid(spark), HEAD).withColumn("near_km", haversine_km("lon", "lat", -94.0, 29.0)).where("p > 0.01 or near_km <= 30")
    c = c.select("*", F.lit(False).alias("matched"), F.lit(-94.0).alias("clon"), F.lit(29.0).alias("clat"), F.lit(30.0).alias("axis_deg"))
    return dark.contact_scores(c, F.lit(30.0)).select("contact_id", "score")


@query("m16_speed_bound", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber > 1 THEN least(25, greatest(6, l_quantity / 1.852 / (l_linenumber - 1) * 1.5)) ELSE 25 END, 6) AS knots FROM lineitem")
def m16(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem")
    return d.select("l_orderkey", "l_linenumber", r6(dark.speed_bound(F.col("l_quantity"), (F.col("l_linenumber") - 1).cast("double"))).alias("knots"))


@query("m17_structure_scores", "SELECT c_custkey AS id, round_even(0.6 * (c_custkey % 11) / 10.0::DOUBLE + CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 0.4 * exp(-(c_custkey % 7) / 2.0::DOUBLE) END, 3) AS score FROM customer WHERE round_even(0.6 * (c_custkey % 11) / 10.0::DOUBLE + CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 0.4 * exp(-(c_custkey % 7) / 2.0::DOUBLE) END, 3) >= 0.25")
def m17(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    s = table(spark, sf, "customer").select(k.alias("id"), F.col("c_name").alias("name"), ((k % 11) / F.lit(10.0)).alias("p"), F.nullif(k % 7, F.lit(0)).cast("double").alias("near_km"))
    return dark.structure_scores(s).select("id", "score")


@query("m18_ablated_scores", f"""WITH {COMP}, ab AS (SELECT c.*, x.w0 AS without FROM comp AS c JOIN (VALUES ('none'), ('proximity'), ('temporality'), ('trajectory'), ('gap'), ('slowdown'), ('type_prior')) AS x(w0) ON c.component <> x.w0)
SELECT without, count(DISTINCT (case_id, mmsi)) AS n, round(sum(w::DOUBLE * value), 4) AS total FROM ab GROUP BY without""")
def m18(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.ablation_totals(_components(spark, sf), score.weight(F.col("component")) * F.col("value")).select("without", "n", F.round("total", 4).alias("total"))


@query("m19_synthetic_grid", "WITH c AS (SELECT (i // 40)::INTEGER AS r, (i % 40)::INTEGER AS c, (-95 + (i % 40) * 2.0::DOUBLE / 39 + 94) * 111.32 * cos(radians(29)) AS x, (30 - (i // 40) * 2.0::DOUBLE / 39 - 29) * 111.32 AS y FROM range(1600) AS t(i)) SELECT r, c, round_even(exp(-0.5 * (pow((x * sin(radians(30)) + y * cos(radians(30))) / 40, 2) + pow((x * cos(radians(30)) - y * sin(radians(30))) / 15, 2))), 4) AS p FROM c")
def m19(spark: SparkSession, sf: str) -> DataFrame:
    return synth.gaussian_grid(spark, HEAD, -94.0, 29.0, 40.0, 15.0, 30.0)


AGE = "ages AS (SELECT i * 0.25::DOUBLE AS age_h FROM range(1, 289) AS t(i)), prior AS (SELECT age_h, (1 / age_h) / sum(1 / age_h) OVER () AS pr FROM ages)"


@query("l01_log_uniform_prior", f"WITH {AGE} SELECT p_partkey, age_h, round(ln(pr), 8) AS lp FROM part JOIN prior ON age_h = p_size / 4.0::DOUBLE")
def l01(spark: SparkSession, sf: str) -> DataFrame:
    """The prior at an age for each part, a quarter of its size."""
    at = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 4).alias("age_h"))
    return at.join(P.log_prior(P.age_grid(spark)), "age_h").select("p_partkey", "age_h", F.round("lp", 8).alias("lp"))


KDE = f"""{AGE}, smp AS (SELECT l_suppkey % 5 AS k, ln(l_quantity) AS ls FROM lineitem), bw AS (SELECT k, count(*) AS n, greatest(1.06 * stddev_pop(ls) * pow(count(*), -0.2), 0.15) AS b FROM smp GROUP BY k),
dens AS (SELECT k, age_h, sum(exp(-0.5 * pow((ln(age_h) - ls) / b, 2))) / (any_value(b) * sqrt(2 * pi())) / any_value(n) AS d FROM smp JOIN bw USING (k) CROSS JOIN ages GROUP BY k, age_h),
ll AS (SELECT k, age_h, greatest(CASE WHEN d > 0 THEN ln(d) ELSE -1e300 END, max(CASE WHEN d > 0 THEN ln(d) ELSE -1e300 END) OVER (PARTITION BY k) + ln(1e-4)) AS ll FROM dens),
post AS (SELECT k, age_h, exp(ll) * pr / sum(exp(ll) * pr) OVER (PARTITION BY k) AS p FROM ll JOIN prior USING (age_h))"""


def _ll(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("k"), F.col("l_quantity").alias("sample_h"), F.lit(None).cast("string").alias("censored"))
    return P.kde_log_age(s, P.age_grid(spark), ["k"])


def _post(spark: SparkSession, sf: str) -> DataFrame:
    return P.fuse(_ll(spark, sf).withColumn("weight", F.lit(1.0)), P.log_prior(P.age_grid(spark)), ["k"])


@query("l03_kde_in_log_age", f"WITH {KDE} SELECT k, age_h, round(ll, 6) AS ll FROM ll")
def l03(spark: SparkSession, sf: str) -> DataFrame:
    return _ll(spark, sf).select("k", "age_h", r6("ll").alias("ll"))


@query("l04_model_mixture", f"WITH {KDE}, m AS (SELECT age_h, avg(exp(ll - mx)) AS v FROM (SELECT *, max(ll) OVER (PARTITION BY k) AS mx FROM ll) GROUP BY age_h) SELECT age_h, round(ln(v), 6) AS ll FROM m")
def l04(spark: SparkSession, sf: str) -> DataFrame:
    m = P.mix_models(_ll(spark, sf).withColumn("case_id", F.lit("c")), ["case_id"], "k")
    return m.select("age_h", r6("ll").alias("ll"))


@query("l05_fused_posterior", f"WITH {KDE} SELECT k, age_h, round(p, 8) AS p FROM post")
def l05(spark: SparkSession, sf: str) -> DataFrame:
    return _post(spark, sf).select("k", "age_h", F.round("p", 8).alias("p"))


@query("l06_average_posterior", f"WITH {KDE}, a AS (SELECT age_h, sum(p * (k + 1)) / sum(k + 1) AS p FROM post GROUP BY age_h) SELECT age_h, round(p / (SELECT sum(p) FROM a), 8) AS p FROM a")
def l06(spark: SparkSession, sf: str) -> DataFrame:
    a = P.average(_post(spark, sf).withColumn("case_id", F.lit("c")).withColumn("weight", (F.col("k") + 1).cast("double")), ["case_id"])
    return a.select("age_h", F.round("p", 8).alias("p"))


@query("l07_hpd_band", f"WITH {KDE}, h AS (SELECT k, age_h, p, sum(p) OVER (PARTITION BY k ORDER BY p DESC, age_h DESC ROWS UNBOUNDED PRECEDING) - p AS before FROM post), s AS (SELECT k, age_h, age_h - lag(age_h) OVER (PARTITION BY k ORDER BY age_h) AS step FROM h WHERE before < 0.8) SELECT k, greatest(min(age_h) - 0.125, 0) AS lo_h, least(max(age_h) + 0.125, 72) AS hi_h, coalesce(bool_or(step > 0.375), FALSE) AS multimodal FROM s GROUP BY k")
def l07(spark: SparkSession, sf: str) -> DataFrame:
    return P.hpd(_post(spark, sf), ["k"])


@query("f12_posterior_quantiles", f"WITH {KDE}, c AS (SELECT k, age_h, sum(p) OVER (PARTITION BY k ORDER BY age_h) AS c FROM post), d AS (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY age_h) AS c0, lag(age_h) OVER (PARTITION BY k ORDER BY age_h) AS a0 FROM c) SELECT k, round(arg_min(CASE WHEN c0 IS NULL THEN age_h ELSE a0 + (0.5 - c0) / (c - c0) * (age_h - a0) END, age_h) FILTER (WHERE c >= 0.5), 6) AS median_h FROM d GROUP BY k")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    return P.quantile(_post(spark, sf), ["k"], 0.5, "median_h").select("k", r6("median_h").alias("median_h"))


@query("l08_information_gain", f"WITH {KDE} SELECT k, round(sum(p * (ln(p) - ln(pr))), 6) AS gain_nats FROM post JOIN prior USING (age_h) WHERE p > 0 GROUP BY k")
def l08(spark: SparkSession, sf: str) -> DataFrame:
    return P.information_gain(_post(spark, sf), P.log_prior(P.age_grid(spark)), ["k"]).select("k", r6("gain_nats").alias("gain_nats"))


@query("l09_refusal", f"WITH {KDE}, g AS (SELECT k, sum(p * (ln(p) - ln(pr))) AS g FROM post JOIN prior USING (age_h) WHERE p > 0 GROUP BY k) SELECT k, CASE WHEN g < 0.3 THEN 'none' ELSE 'ok' END AS status FROM g")
def l09(spark: SparkSession, sf: str) -> DataFrame:
    return P.summarise(_post(spark, sf), P.log_prior(P.age_grid(spark)), ["k"], 0.3).select("k", "status")


@query("l12_okubo_diffusivity", "SELECT p_partkey, round(0.0103 * pow(p_size * 100, 1.15) * 1e-4, 9) AS d FROM part")
def l12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(age.okubo_diffusivity(F.col("p_size").cast("double")), 9).alias("d"))


@query("l15_detectability", "SELECT p_partkey, round(greatest(0, least(1, (p_size / 50.0::DOUBLE - 0.05) / 0.25)), 6) AS lik FROM part")
def l15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", r6(age.detectability(F.col("p_size") / F.lit(50.0))).alias("lik"))


def _fay(h: str, v: str, k: str, rho: str) -> str:
    return f"({k} * pow((1025.0::DOUBLE - {rho}) / 1025.0 * 9.81 * {v} * {v} / sqrt(1.05e-6), 1.0::DOUBLE / 6) * pow({h} * 3600.0, 0.25) / 1000)"


@query("l16_fay_band", f"""WITH s AS (SELECT p_partkey AS case_id, p_size / 40.0::DOUBLE AS area, (p_partkey % 30 * 10)::DOUBLE AS v FROM part), c AS (SELECT case_id, area, v, k, rho FROM s, (VALUES (1.1::DOUBLE), (1.5)) AS a(k), (VALUES (850.0::DOUBLE), (950.0)) AS b(rho)),
m AS (SELECT case_id, any_value(area) AS area, any_value(v) AS v, max(pi() * pow({_fay('72', 'v', 'k', 'rho')}, 2)) AS reach, min(CASE WHEN v > 0 THEN pow(sqrt(area / pi()) / {_fay('(1 / 3600.0::DOUBLE)', 'v', 'k', 'rho')}, 4) / 3600 END) AS lo, max(CASE WHEN v > 0 THEN pow(sqrt(area / pi()) / {_fay('(1 / 3600.0::DOUBLE)', 'v', 'k', 'rho')}, 4) / 3600 END) AS hi FROM c GROUP BY case_id)
SELECT case_id, CASE WHEN v <= 0 THEN 'no volume' WHEN area > reach THEN 'shear_dominated' ELSE 'gravity_viscous' END AS regime, round(CASE WHEN v > 0 AND area <= reach AND lo < least(hi, 72) THEN lo END, 5) AS lo_h, round(CASE WHEN v > 0 AND area <= reach AND lo < least(hi, 72) THEN least(hi, 72) END, 5) AS hi_h FROM m""")
def l16(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("case_id"), (F.col("p_size") / F.lit(40.0)).alias("area_km2"), (F.col("p_partkey") % 30 * 10).cast("double").alias("volume_m3"))
    return age.fay_band(s).select("case_id", "regime", F.round("lo_h", 5).alias("lo_h"), F.round("hi_h", 5).alias("hi_h"))


@query("l17_elongation_band", """WITH s AS (SELECT p_partkey, p_size / 5.0::DOUBLE AS a, (p_partkey % 9) * 1e-5::DOUBLE AS s, CASE p_partkey % 3 WHEN 0 THEN 'chronic' WHEN 1 THEN 'acute' ELSE 'unknown' END AS dc FROM part), h AS (SELECT *, CASE WHEN a > 1 AND s > 0 THEN sqrt(a + 1 / a - 2) / s / 3600 END AS h, CASE WHEN dc = 'unknown' THEN 0.55 ELSE 0.35 END AS b FROM s)
SELECT p_partkey, round(CASE WHEN dc <> 'chronic' AND h * (1 - b) < 72 THEN greatest(h * (1 - b), 0) END, 5) AS lo_h, round(CASE WHEN dc <> 'chronic' AND h * (1 - b) < 72 THEN least(h * (1 + b), 72) END, 5) AS hi_h FROM h""")
def l17(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    lo, hi = age.elongation_band(F.col("p_size") / F.lit(5.0), (k % 9) * F.lit(1e-5), F.when(k % 3 == 0, "chronic").when(k % 3 == 1, "acute").otherwise("unknown"))
    return table(spark, sf, "part").select("p_partkey", F.round(lo, 5).alias("lo_h"), F.round(hi, 5).alias("hi_h"))


@query("l19_weathering_and_gate", "SELECT p_partkey, CASE WHEN p_size % 12 BETWEEN 3 AND 10 AND p_partkey % 4 <> 0 THEN CASE WHEN p_size / 10.0 >= 2 THEN 'fresh' ELSE 'weathered' END ELSE 'unknown' END AS flag, CASE p_partkey % 3 WHEN 0 THEN 'refuse' WHEN 1 THEN 'allow' ELSE 'allow_widened' END AS gate FROM part")
def l19(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    edge = F.when(k % 4 != 0, F.col("p_size") / F.lit(10.0))
    gate = age.age_gate(F.when(k % 3 == 0, "chronic").when(k % 3 == 1, "acute"))
    return table(spark, sf, "part").select("p_partkey", age.weathering((F.col("p_size") % 12).cast("double"), F.lit(0.0), edge).alias("flag"), gate.alias("gate"))


@query("l21_hypotheses", "SELECT p_partkey, CASE WHEN p_size % 10 >= 5 AND p_size % 7 >= 3 THEN 'both' WHEN p_size % 10 >= 5 THEN 'patch' WHEN p_size % 7 >= 3 THEN 'track' ELSE 'none' END AS hypothesis FROM part")
def l21(spark: SparkSession, sf: str) -> DataFrame:
    h = age.choose_hypothesis((F.col("p_size") % 10) / F.lit(50.0), (F.col("p_size") % 7) / F.lit(30.0))
    return table(spark, sf, "part").select("p_partkey", h.alias("hypothesis"))


@query("l22_combined_bands", "WITH b AS (SELECT l_orderkey AS k, l_quantity AS lo, l_quantity + l_linenumber * 5 AS hi FROM lineitem), a AS (SELECT k, max(lo) AS l, min(hi) AS h, min(lo) AS ul, max(hi) AS uh, count(*) AS n FROM b GROUP BY k) SELECT k, CASE WHEN l < h THEN l ELSE ul END AS lo_h, CASE WHEN l < h THEN h ELSE uh END AS hi_h, CASE WHEN n = 1 THEN 'single' WHEN l < h THEN 'combined' ELSE 'disagreement' END AS how FROM a")
def l22(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("lo_h"), (F.col("l_quantity") + F.col("l_linenumber") * 5).alias("hi_h"))
    return P.combine_bands(b, ["k"])


@query("l24_calibration_search", """WITH t AS (SELECT a, b, p_partkey, -abs(p_size / 10.0::DOUBLE - a) - b AS ls, p_size <= a * 14 AS cov FROM part, (VALUES (1), (2), (3)) AS x(a), (VALUES (0.1::DOUBLE), (0.2)) AS y(b)), s AS (SELECT a, b, avg(ls) - 5 * abs(avg(cov::INTEGER) - 0.8) AS o FROM t GROUP BY a, b) SELECT a, b, round(o, 6) AS objective FROM s ORDER BY o DESC, a, b LIMIT 1""")
def l24(spark: SparkSession, sf: str) -> DataFrame:
    setting = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (1, 2, 3) for b in (0.1, 0.2))))
    t = table(spark, sf, "part").select("p_partkey", "p_size", setting.alias("s")).select("s.a", "s.b", F.col("p_partkey").alias("twin_id"), (-F.abs(F.col("p_size") / F.lit(10.0) - F.col("s.a")) - F.col("s.b")).alias("log_score"), (F.col("p_size") <= F.col("s.a") * 14).alias("covered"))
    return age.calibration_search(t, ["a", "b"]).select("a", "b", r6("objective").alias("objective"))


@query("f09_curve_inversion", "WITH c AS (SELECT l_orderkey AS k, l_linenumber::DOUBLE AS x, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::DOUBLE AS i FROM lineitem), d AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY i) AS v0, lag(i) OVER (PARTITION BY k ORDER BY i) AS i0 FROM c) SELECT k, round(arg_min(CASE WHEN v0 < 60 THEN i0 + (60 - v0) / (v - v0) * (i - i0) ELSE -1 END, i) FILTER (WHERE v >= 60), 6) AS q FROM d GROUP BY k HAVING count(*) FILTER (WHERE v >= 60) > 0 AND min(i) FILTER (WHERE v >= 60) > 1")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k1"), F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("v"), F.row_number().over(w).cast("double").alias("k"))
    return age.invert_curve(c, ["k1"], 60.0).where("at is not null").select(F.col("k1").alias("k"), r6("at").alias("q"))


@query("k09_age_weighted_pool", "WITH f AS (SELECT l_linenumber AS step, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT i AS step, i / 28.0::DOUBLE AS p FROM range(1, 8) AS t(i)), m AS (SELECT step, n, p FROM f JOIN p USING (step)) SELECT step, n, round(p / (SELECT sum(p) FROM m) / n, 10) AS w FROM m")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").select(F.lit("c").alias("case_id"), F.col("l_linenumber").alias("step"), F.col("l_quantity").alias("lon"))
    p = spark.range(1, 8).select(F.lit("c").alias("case_id"), (F.col("id") / 4).alias("age_h"), (F.col("id") / F.lit(28.0)).alias("p"))
    return drift.pool_by_age(f, p, 15.0).groupBy("step").agg(F.count("*").alias("n"), F.round(F.max("w"), 10).alias("w"))


@query("k11_time_window", """WITH m AS (SELECT l_suppkey % 5 AS k, l_orderkey % 40 AS m, l_linenumber AS s, 10 + avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3), a AS (SELECT k, m, arg_min(s, (v, s)) AS kk, min(v) AS lo, arg_min(v, s) AS st FROM m GROUP BY k, m), s AS (SELECT k, median(lo / greatest(st, 1e-9)) AS ratio, median(kk) AS med, quantile_cont(kk, 0.1) AS q1, quantile_cont(kk, 0.9) AS q9 FROM a GROUP BY k)
SELECT k, CASE WHEN ratio <= 0.9 AND med > 1 AND med < 7 THEN round(q9 * 0.5, 6) ELSE 4.0 END AS from_h, CASE WHEN ratio <= 0.9 AND med > 1 AND med < 7 THEN 'convergence' ELSE 'bounded' END AS method FROM s WHERE q9 - q1 >= 1""")
def k11(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("case_id"), (F.col("l_orderkey") % 40).alias("member"), F.col("l_linenumber").alias("step")).agg((10 + F.avg("l_quantity")).alias("spread_km"))
    return drift.time_window(m, 30.0, 9).select(F.col("case_id").alias("k"), r6("hours_back_from").alias("from_h"), "method")


@query("k03_constant_current", "SELECT s_suppkey AS pid, round(-94 - 0.5 * 36000 / (111320 * cos(radians(28.5))), 4) AS lon, 28.5::DOUBLE AS lat, FALSE AS stranded FROM supplier")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.lit("c").alias("case_id"), F.col("s_suppkey").cast("int").alias("pid"), F.lit(-94.0).alias("lon"), F.lit(28.5).alias("lat"))
    one = spark.createDataFrame([(0, 0.0, 1.0)], "member int, wind_share double, current_scale double")
    d = drift.run_ensemble(s, one, drift.constant_field(0.5, 0.0), drift.constant_field(0.0, 0.0), 0.0, 15.0, 41)
    return d.select(F.col("pid").cast("long").alias("pid"), F.round("lon", 4).alias("lon"), r6("lat").alias("lat"), "stranded")


@query("k05_stratified_members")
def k05(spark: SparkSession, sf: str) -> DataFrame:
    return drift.member_draws(spark, 50)


@query("k08_ensemble_in_vortex")
def k08(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.lit("c").alias("case_id"), F.col("s_suppkey").cast("int").alias("pid"), F.lit(-94.0).alias("lon"), (28.5 + F.col("s_suppkey") / 1000).alias("lat"))
    d = drift.run_ensemble(s, drift.member_draws(spark, 20), drift.vortex_field(-94.0, 28.0, 1.0, 0.4), drift.constant_field(5.0, 0.0), 0.0, 15.0, 97, steps=[24, 48, 72], keep=20, jitter_m=300.0)
    return G.radii(d, ["case_id", "step"])


@query("f19_field_interpolation")
def f19(spark: SparkSession, sf: str) -> DataFrame:
    import numpy as np
    import pandas as pd

    rows = pd.DataFrame([(t, y, x, x + 2 * y + 3 * t, x - y) for t in (0.0, 1.0) for y in (0.0, 1.0, 2.0) for x in (0.0, 1.0, 2.0)], columns=["t_epoch", "lat", "lon", "u", "v"])
    field = drift.Gridded(rows)
    def at(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = field(pdf["x"].to_numpy(), pdf["y"].to_numpy(), 0.5)
        return pdf.assign(u=np.round(u, 6), v=np.round(v, 6))
    p = table(spark, sf, "supplier").select((F.col("s_suppkey") % 20 / F.lit(10.0)).alias("x"), (F.col("s_suppkey") % 7 / F.lit(4.0)).alias("y"))
    return p.mapInPandas(lambda it: map(at, it), "x double, y double, u double, v double")


@query("e34_stranding_curve", "SELECT (l_linenumber * 90 / 60.0)::DOUBLE AS hour, round(avg((l_discount > 0.05)::INTEGER), 6) AS fraction FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1")
def e34(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select(F.lit("c").alias("case_id"), F.col("l_linenumber").alias("step"), (F.col("l_discount") > 0.05).alias("stranded"))
    return drift.stranding_curve(p, 90.0, 3.0).select("hour", r6("fraction").alias("fraction"))


@query("e35_wind_share", "SELECT l_suppkey AS case_id, CASE WHEN l_suppkey % 2 = 0 THEN round(avg(l_tax * 5 * 0.03) / (avg(l_discount * 5) + avg(l_tax * 5 * 0.03)), 6) END AS wind_share FROM lineitem GROUP BY l_suppkey")
def e35(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("case_id"), (F.col("l_discount") * 3).alias("cu"), (F.col("l_discount") * 4).alias("cv"), (F.col("l_tax") * 3).alias("wu"), (F.col("l_tax") * 4).alias("wv"), (F.col("l_suppkey") % 2 == 1).alias("synthetic"))
    return drift.wind_share_of_drift(s).select("case_id", r6("wind_share").alias("wind_share"))


@query("e30_bootstrap_interval")
def e30(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 200).alias("scene"), F.col("l_discount").alias("a"), F.lit(1.0).alias("b"))
    return evaluate.bootstrap(d, "scene", "a", "b", 500)


@query("n15_normalised_pixels", "WITH m AS (SELECT l_returnflag AS k, l_quantity AS db, median(l_quantity) OVER (PARTITION BY l_returnflag) AS med FROM lineitem), s AS (SELECT k, med, 1.4826 * median(abs(db - med)) + 1e-6 AS mad FROM m GROUP BY k, med) SELECT k, round(sum(greatest(-6, least(6, (db - med) / mad)) / 6), 4) AS s FROM m JOIN s USING (k, med) GROUP BY k")
def n15(spark: SparkSession, sf: str) -> DataFrame:
    px = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene_id"), F.col("l_quantity").alias("db"))
    return image.normalise(px).groupBy(F.col("scene_id").alias("k")).agg(F.round(F.sum("x"), 4).alias("s"))


@query("n14_histogram_modes", """WITH h AS (SELECT l_returnflag AS k, least(greatest(floor((-l_quantity * 0.7 + 40) / 40 * 256), 0), 255)::INTEGER AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT k, b + d AS bin, sum(n) / 5.0::DOUBLE AS smooth FROM h, range(-2, 3) AS t(d) GROUP BY 1, 2), w AS (SELECT *, coalesce(lag(smooth) OVER (PARTITION BY k ORDER BY bin), 0) AS a, coalesce(lead(smooth) OVER (PARTITION BY k ORDER BY bin), 0) AS z FROM s)
SELECT k, bin::INTEGER AS bin, round(smooth, 6) AS smooth FROM w WHERE smooth > a AND smooth >= z""")
def n14(spark: SparkSession, sf: str) -> DataFrame:
    px = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene_id"), (-F.col("l_quantity") * 0.7).alias("db"))
    return image.histogram_modes(px).select(F.col("scene_id").alias("k"), "bin", r6("smooth").alias("smooth"))


@query("n17_merged_tiles", "SELECT l_partkey AS r, l_linenumber AS c, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS p FROM lineitem GROUP BY 1, 2")
def n17(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select(F.lit("s").alias("scene_id"), F.col("l_partkey").alias("r"), F.col("l_linenumber").alias("c"), F.col("l_discount").alias("p"), F.col("l_quantity").alias("w"))
    return image.merge_tiles(t).select("r", "c", F.round("p", 9).alias("p"))


@query("n20_tiles", "SELECT (l_partkey // 256)::INTEGER AS tr, (l_suppkey // 256)::INTEGER AS tc, count(*) AS n, round(avg((l_returnflag = 'R')::INTEGER), 6) AS oil_frac FROM lineitem GROUP BY 1, 2")
def n20(spark: SparkSession, sf: str) -> DataFrame:
    px = table(spark, sf, "lineitem").select(F.lit("s").alias("scene_id"), F.col("l_partkey").alias("r"), F.col("l_suppkey").alias("c"), F.col("l_quantity").alias("db"), (F.col("l_returnflag") == "R").cast("int").alias("gt"))
    return image.tiles(px).select("tr", "tc", "n", r6("oil_frac").alias("oil_frac"))


@query("n12_region_rules", "SELECT p_partkey, CASE WHEN -p_size / 5.0 <= -3 AND p_partkey % 6 >= 2.5 THEN 'oil' ELSE 'lookalike' END AS classification, CASE WHEN p_partkey % 6 >= 5 AND p_size % 10 / 10.0 >= 0.6 THEN 'chronic' WHEN p_partkey % 6 < 3 THEN 'acute' ELSE 'unknown' END AS discharge FROM part")
def n12(spark: SparkSession, sf: str) -> DataFrame:
    e = (F.col("p_partkey") % 6).cast("double")
    return table(spark, sf, "part").select("p_partkey", image.rule_score(-F.col("p_size") / F.lit(5.0), e)[0].alias("classification"), image.classify_shape(e, F.col("p_size") % 10 / F.lit(10.0)).alias("discharge"))


@query("g05_ranked_detections", "WITH d AS (SELECT l_suppkey AS case_id, l_orderkey * 10 + l_linenumber AS region_id, max(l_tax) AS confidence, max(l_quantity) AS area FROM lineitem GROUP BY 1, 2) SELECT case_id, region_id, printf('det-%02d', row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, area DESC, region_id)) AS id FROM d")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("case_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("region_id")).agg(F.max("l_tax").alias("confidence"), F.max("l_quantity").alias("area_km2"))
    return image.rank_detections(d).select("case_id", "region_id", "id")


@query("c17_small_demoted", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size / 10.0 >= 1.5 THEN 'oil' ELSE 'lookalike' END AS classification FROM part")
def c17(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "oil").otherwise("lookalike").alias("classification"), (F.col("p_size") / F.lit(10.0)).alias("area_km2"), F.lit(0.9).alias("confidence"))
    return image.demote_small(d, 1.5).select("p_partkey", "classification")


@query("q02_bounds_rules", "SELECT s_suppkey AS case_id, 'bounds.lon_order' AS rule FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, 'bounds.lat_range' FROM supplier WHERE s_suppkey % 7 = 0")
def q02(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    b = table(spark, sf, "supplier").select(k.alias("case_id"), F.lit(-95.0).alias("west"), F.when(k % 5 == 0, -96.0).otherwise(-93.0).alias("east"), F.lit(28.0).alias("south"), F.when(k % 7 == 0, 91.0).otherwise(30.0).alias("north"), F.lit(10).alias("width_px"), F.lit(10).alias("height_px"))
    return V.check_bounds(b).select("case_id", "rule")


@query("q07_origin_rules", "SELECT s_suppkey AS case_id, 'origin.abstain' AS rule FROM supplier WHERE s_suppkey > 40 UNION ALL SELECT s_suppkey, 'origin.radii' FROM supplier WHERE s_suppkey < 10")
def q07(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    h = table(spark, sf, "supplier").select(k.alias("case_id"), F.lit(2).alias("rows"), F.lit(2).alias("cols"), F.lit(10.0).alias("radius_50_km"), k.cast("double").alias("radius_90_km"), F.lit(False).alias("abstain"), instant(T0).alias("window_start"), instant(T1).alias("window_end"), F.lit("age").alias("time_window_method"))
    c = h.select("case_id", F.explode(F.array(F.lit(0.0), F.lit(0.2), F.lit(0.5), F.lit(1.0))).alias("p"))
    return V.check_origin(h, c).select("case_id", "rule")


@query("q11_suspect_rules", "WITH s AS (SELECT o_custkey % 30 AS case_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey) AS rank, o_orderkey % 13 AS x FROM orders) SELECT case_id, 'suspects.score_range' AS rule, o_orderkey::VARCHAR AS place FROM s WHERE x > 10 UNION ALL SELECT case_id, 'suspects.track', o_orderkey::VARCHAR FROM s WHERE o_orderkey % 3 = 0 UNION ALL SELECT case_id, 'suspects.sorted', o_orderkey::VARCHAR FROM (SELECT *, lag(x) OVER (PARTITION BY case_id ORDER BY rank) AS b FROM s) WHERE b < x")
def q11(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    s = table(spark, sf, "orders").select((F.col("o_custkey") % 30).alias("case_id"), k.cast("string").alias("mmsi"), F.row_number().over(Window.partitionBy(F.col("o_custkey") % 30).orderBy("o_orderkey")).alias("rank"), (k % 13 / F.lit(10.0)).alias("score"), F.lit(0.5).alias("weight_live"), k.alias("k"))
    n = s.groupBy("case_id").agg(F.count("*").alias("n"))
    f = n.select("case_id", *(F.col("n").alias(c) for c in ("in_region", "in_window", "plausible", "scored")))
    return V.check_suspects(s.drop("k"), f, s.where("k % 3 <> 0")).select("case_id", "rule", "place")


@query("q13_index_rules", "SELECT s_suppkey::VARCHAR AS case_id, 'index.exists' AS rule FROM supplier WHERE s_suppkey % 4 = 0")
def q13(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    i = table(spark, sf, "supplier").select(k.cast("string").alias("case_id"), (k == 0).alias("is_default"))
    m = table(spark, sf, "supplier").where("s_suppkey % 4 <> 0").select(k.cast("string").alias("case_id"))
    return V.check_index(i, m).select("case_id", "rule")


@query("flagship_suspects", f"""WITH {POS}, {GRID}, {sampled()}, {GAPS.replace('FROM pos', 'FROM pos')}, v AS (SELECT mmsi, count(*) AS n FROM pos GROUP BY mmsi HAVING count(*) >= 10), {BEST},
u AS (SELECT mmsi, CASE WHEN count(*) FILTER (WHERE sog >= 2) >= 3 THEN median(sog) FILTER (WHERE sog >= 2) END AS med FROM pos GROUP BY mmsi),
o AS (SELECT q.mmsi, arg_max(q.cog, q.us) AS cog, arg_max(q.lon, q.us) AS lon, arg_max(q.lat, q.us) AS lat FROM pos AS q JOIN best AS b ON b.mmsi = q.mmsi AND q.us <= b.q_us WHERE {hav('q.lon', 'q.lat', '-94', '29')} >= 40 GROUP BY q.mmsi),
s AS (SELECT b.mmsi, arg_min(q.sog, (abs(q.us - b.q_us), q.us)) AS sog FROM best AS b JOIN pos AS q ON q.mmsi = b.mmsi GROUP BY b.mmsi), t AS (SELECT mmsi, arg_max(vessel_type, us) AS vt FROM pos GROUP BY mmsi),
c AS (SELECT b.mmsi, b.value AS proximity, greatest(0, 1 - abs(b.q_us - ({T0_US} + {T1_US}) / 2) / 1e6 / (({T1_US} - {T0_US}) / 2e6)) AS temporality, CASE WHEN o.mmsi IS NOT NULL THEN ({ang('o.cog', brg('o.lon', 'o.lat', '-94', '29'))} <= 60)::INTEGER::DOUBLE END AS trajectory,
 CASE WHEN med IS NOT NULL THEN (sog <= med * 0.6)::INTEGER::DOUBLE END AS slowdown, CASE vt WHEN 'tanker' THEN 1.0 WHEN 'cargo' THEN 1.0 WHEN 'fishing' THEN 0.4 WHEN 'passenger' THEN 0.2 ELSE 0.5 END::DOUBLE AS type_prior, {hav('b.lon', 'b.lat', '-94', '29')} AS km
 FROM best AS b JOIN v USING (mmsi) LEFT JOIN o USING (mmsi) LEFT JOIN s USING (mmsi) LEFT JOIN u USING (mmsi) LEFT JOIN t USING (mmsi) WHERE b.value > 0.05),
w AS (SELECT *, 0.30 + 0.15 + 0.05 + CASE WHEN trajectory IS NULL THEN 0 ELSE 0.15 END + CASE WHEN slowdown IS NULL THEN 0 ELSE 0.05 END AS live, 0.30 * proximity + 0.15 * temporality + 0.05 * type_prior + coalesce(0.15 * trajectory, 0) + coalesce(0.05 * slowdown, 0) AS total FROM c),
r AS (SELECT mmsi, round_even(total::DOUBLE / live, 3) AS score, round_even(live::DOUBLE / 0.85, 3) AS weight_live, (3 + (trajectory IS NOT NULL)::INTEGER + (slowdown IS NOT NULL)::INTEGER) AS na, proximity, km FROM w)
SELECT mmsi, score, weight_live, row_number() OVER (ORDER BY score DESC, weight_live DESC, na DESC, round_even(proximity, 3) DESC, round_even(km, 2), mmsi)::INTEGER AS rank FROM r QUALIFY rank <= 10""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    head = {**HEAD, "case_id": "c", "clon": -94.0, "clat": 29.0, "radius_90_km": 40.0, "method": "age"}
    d = attribution.suspects(positions(spark, sf), grid(spark), head, instant(T0), instant(T1), min_points=10, with_gap=False, walk_seconds=None)
    return d.where("rank <= 10").select("mmsi", "score", "weight_live", "rank")


_ = math  # constants in SQL come from the engines
