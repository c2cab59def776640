"""Queries of records: defaults, sealed properties, placeholders, field figures, provenance, masks, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records, regions
from ..streaming import spaced
from .registry import ORACLES, folder, query, r6, table


@query("u17_bounds_with_clamp", "SELECT s_suppkey AS case_id, CASE WHEN s_suppkey % 3 = 0 THEN -25.0 ELSE -30.0 END::DOUBLE AS db_min, 0.0::DOUBLE AS db_max FROM supplier")
def u17(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id"), F.when(F.col("s_suppkey") % 3 != 0, -30.0).alias("db_min"))
    return records.with_defaults(b, records.DB_CLAMP)


@query("u25_calibration_over_defaults", "SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN p_size / 10.0::DOUBLE ELSE 1 END, 6) AS patch, 0.5::DOUBLE AS track, CASE WHEN p_partkey % 2 = 0 THEN 2.0::DOUBLE END AS further FROM part")
def u25(spark: SparkSession, sf: str) -> DataFrame:
    loaded = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("patch"), F.col("p_size") / F.lit(10.0), F.lit("further"), F.lit(2.0)))
    w = table(spark, sf, "part").select("p_partkey", records.merged_calibration(loaded, {"patch": 1.0, "track": 0.5}).alias("w"))
    return w.select("p_partkey", r6(F.col("w")["patch"]).alias("patch"), F.col("w")["track"].alias("track"), F.try_element_at("w", F.lit("further")).alias("further"))


@query("a12_sealed_properties", "SELECT s_suppkey AS case_id, s_suppkey::VARCHAR AS kept_id, s_name AS kept_s1_scene_id, (s_nationkey * 2)::VARCHAR AS kept_area, NULL::VARCHAR AS kept_linearity, 11 AS n_columns FROM supplier")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("s1_scene_id"), (F.col("s_nationkey") * 2).alias("area"), F.lit("answer").alias("slick_url"), F.lit(7).alias("cls")))
    kept = records.sealed_properties(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id"), body.alias("properties")))
    return kept.select("case_id", "kept_id", "kept_s1_scene_id", "kept_area", "kept_linearity", F.lit(len(kept.columns)).alias("n_columns"))


_DOC = """'{"a": "' || CASE WHEN s_suppkey % 2 = 0 THEN 'TODO later' ELSE 'done' END || '", "_note": "TODO", "list": [{"b": "x"}, {"b": "still TODO ' || s_suppkey || '"}], "n": 3, "_own": {"c": "TODO"}}'"""


@query("c22_placeholders", f"WITH d AS (SELECT s_suppkey AS case_id, {_DOC} AS body FROM supplier) SELECT case_id, substr(fullkey, 3) AS path FROM d, json_tree(body) AS t WHERE t.type = 'VARCHAR' AND contains(t.atom::VARCHAR, 'TODO') AND NOT regexp_matches(fullkey, '[.]\"?_')")
def c22(spark: SparkSession, sf: str) -> DataFrame:
    return records.placeholders(table(spark, sf, "supplier").selectExpr("s_suppkey as case_id", f"{_DOC} as body"))


_RECENT = "list_filter(r.rec, lambda x: h.t - x <= 60)"


@query("f21_rate_limit", f"""WITH RECURSIVE h AS (SELECT event_id, user_id AS who, epoch_us(ts) / 3600e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT who, k, event_id, TRUE AS accepted, [t] AS rec FROM h WHERE k = 1
 UNION ALL SELECT h.who, h.k, h.event_id, len({_RECENT}) < 5, CASE WHEN len({_RECENT}) < 5 THEN list_append({_RECENT}, h.t) ELSE {_RECENT} END FROM r JOIN h ON h.who = r.who AND h.k = r.k + 1)
SELECT event_id, accepted FROM r""")
def f21(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads of a user, a second for each hour of the events, five a minute."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("client"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600e6)).alias("at_s"))
    return records.limited(e).select("event_id", "accepted")


@query("f21_rate_limit_of_stream", ORACLES["f21_rate_limit"])
def f21_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same hits as a stream, five in sixty hours; stopped, and begun again with a last hit that takes the watermark past all others."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, check = (folder(spark) for _ in range(3))
    hits = table(own, sf, "events").select("event_id", F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    last = own.createDataFrame([(None, None, "2200-01-01 00:00:00")], "event_id long, client long, ts string").select("event_id", "client", F.col("ts").cast("timestamp").alias("ts"))
    for part in (hits, last):
        part.write.mode("append").parquet(source)
        told = spaced.limited(own.readStream.schema(hits.schema).parquet(source), window_s=216000.0, late="1 hour", grain_ms=3_600_000)
        told.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).where("event_id is not null").select("event_id", "accepted")


@query("u35_field_figures", "WITH f AS (SELECT l_suppkey % 7 AS case_id, sqrt(pow(l_quantity / 10, 2) + pow(l_tax, 2)) AS s, l_linenumber = 7 AS masked FROM lineitem) SELECT case_id, round(quantile_cont(s, 0.5) FILTER (WHERE NOT masked), 6) AS median_ms, round(quantile_cont(s, 0.99) FILTER (WHERE NOT masked), 6) AS p99_ms, round(max(s) FILTER (WHERE NOT masked), 6) AS max_ms, round(100.0::DOUBLE * count(*) FILTER (WHERE masked) / count(*), 6) AS masked_pct FROM f GROUP BY case_id")
def u35(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("case_id"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 10).alias("u"), F.col("l_tax").cast("double").alias("v"))
    return records.field_figures(f, ["case_id"]).select("case_id", *(r6(c).alias(c) for c in ("median_ms", "p99_ms", "max_ms", "masked_pct")))


@query("u31_held_last_snapshot", "WITH t AS (SELECT DISTINCT o_custkey AS case_id, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS t FROM orders), g AS (SELECT *, t - lag(t) OVER (PARTITION BY case_id ORDER BY t) AS gap, max(t) OVER (PARTITION BY case_id) AS last FROM t) SELECT case_id, t AS t_epoch FROM t UNION ALL SELECT case_id, t + gap FROM g WHERE t = last AND gap IS NOT NULL")
def u31(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.date_diff(F.to_date("o_orderdate"), F.to_date(F.lit("1990-01-01"))).cast("long").alias("t_epoch")).distinct()
    return records.hold_last(f, ["case_id"])


@query("u39_seed_provenance", """WITH m AS (SELECT l_suppkey AS case_id, avg(-94 + l_tax) AS x, avg(28 + l_discount) AS y FROM lineitem GROUP BY 1), s AS (SELECT case_id, x, y, -93.96 + (case_id % 5) * 0.002::DOUBLE AS lon, 28.05::DOUBLE AS lat FROM m),
k AS (SELECT case_id, sqrt(pow((x - lon) * 111.32 * cos(radians((y + lat) / 2)), 2) + pow((y - lat) * 111.32, 2)) AS a, sqrt(pow((x + 93.955) * 111.32 * cos(radians((y + 28.05) / 2)), 2) + pow((y - 28.05) * 111.32, 2)) AS b FROM s)
SELECT case_id, round(a, 5) AS chosen_km, a <= 1.0 AND (case_id % 2 = 0 OR a < b) AS vouched FROM k""")
def u39(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("case_id"), (-94 + F.col("l_tax")).cast("double").alias("lon"), (28 + F.col("l_discount")).cast("double").alias("lat"))
    s = table(spark, sf, "supplier").join(p.select("case_id").distinct(), k == F.col("case_id"), "left_semi")
    s = s.select(k.alias("case_id"), (-93.96 + (k % 5) * 0.002).alias("lon"), F.lit(28.05).alias("lat"), F.when(k % 2 == 1, -93.955).alias("other_lon"), F.when(k % 2 == 1, 28.05).alias("other_lat"))
    return records.seed_provenance(p, s).select("case_id", F.round("chosen_km", 5).alias("chosen_km"), "vouched")


@query("u41_forward_document", "WITH s AS (SELECT c_nationkey AS case_id, count(*) AS n, min(c_custkey) AS p FROM customer GROUP BY 1) SELECT case_id, 3 AS n_steps, n::INTEGER AS n_particles, 'forward' AS direction, p / 1000.0::DOUBLE AS first_lon FROM s")
def u41(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").select(F.col("c_nationkey").alias("case_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step"), F.col("c_custkey").alias("pid"), (F.col("c_custkey") / F.lit(1000.0)).alias("lon"), F.lit(28.0).alias("lat"))
    d = records.forward_document(p, p.select("case_id").distinct().withColumn("t0", F.lit("2024-01-10T00:00:00Z")), 15.0)
    return d.select("case_id", "n_steps", "n_particles", F.get_json_object("body", "$.direction").alias("direction"), F.get_json_object("body", "$.positions[0][0][0]").cast("double").alias("first_lon"))


_KERNEL = "(SELECT dy, dx FROM range(-3, 4) AS a(dy), range(-3, 4) AS b(dx) WHERE abs(dx) <= round(3 * sqrt(1 - dy * dy / 9.0::DOUBLE)))"


@query("n05_closed_mask", f"""WITH m AS (SELECT DISTINCT l_suppkey % 4 AS scene_id, l_orderkey % 60 AS r, l_partkey % 70 AS c FROM lineitem WHERE l_quantity <= 1), k AS {_KERNEL},
d AS (SELECT DISTINCT scene_id, r + dy AS r, c + dx AS c FROM m, k WHERE r + dy BETWEEN 0 AND 59 AND c + dx BETWEEN 0 AND 69)
SELECT scene_id, r, c FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE d.r + dy BETWEEN 0 AND 59 AND d.c + dx BETWEEN 0 AND 69 AND NOT EXISTS (SELECT 1 FROM d AS e WHERE e.scene_id = d.scene_id AND e.r = d.r + dy AND e.c = d.c + dx))""")
def n05b(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").where("l_quantity <= 1").select((F.col("l_suppkey") % 4).alias("scene_id"), (F.col("l_orderkey") % 60).alias("r"), (F.col("l_partkey") % 70).alias("c"))
    return records.close_mask(m, m.select("scene_id").distinct().withColumns({"rows": F.lit(60), "cols": F.lit(70)}))


@query("n18_regions_of_scores", "SELECT s_suppkey AS scene_id, 1 AS region_id, 400 AS n_px, 4.0::DOUBLE AS area_km2 FROM supplier")
def n18(spark: SparkSession, sf: str) -> DataFrame:
    """A bar of 4 x 100 pixels, a hole of one pixel in it and a speck beside it, in a scene for each supplier."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scene_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"), F.lit(0).alias("z"))
    bar = s.select("scene_id", (F.col("i") + 20).alias("r"), F.explode(F.sequence(F.lit(10), F.lit(109))).alias("c")).where("not (r = 21 and c = 50)")
    speck = s.where("i = 0").select("scene_id", F.lit(5).alias("r"), F.lit(5).alias("c"))
    px = bar.union(speck).withColumns({"p": F.lit(0.9), "valid": F.lit(True)})
    scenes = s.select("scene_id", F.lit(64).alias("rows"), F.lit(128).alias("cols")).distinct()
    return records.regions_of_scores(px, scenes, 0.5, 0.01).select("scene_id", "region_id", F.col("n_px").cast("int").alias("n_px"), r6("area_km2").alias("area_km2"))


_SPOTS = "px AS (SELECT DISTINCT l_suppkey AS s, l_orderkey % 61 AS r, l_partkey % 59 AS c FROM lineitem)"


@query("n06_tiled_regions", f"""WITH RECURSIVE {_SPOTS}, w AS (SELECT s, r * 100 + c AS a, r, c FROM px UNION SELECT w.s, w.a, px.r, px.c FROM w JOIN px ON px.s = w.s AND px.r BETWEEN w.r - 1 AND w.r + 1 AND px.c BETWEEN w.c - 1 AND w.c + 1),
l AS (SELECT s, r, c, min(a) AS a FROM w GROUP BY ALL)
SELECT s AS scene_id, a // 100 AS first_r, a % 100 AS first_c, count(*) AS n_px, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM l GROUP BY s, a""")
def n06_tiled(spark: SparkSession, sf: str) -> DataFrame:
    """A scene of 61 x 59 pixels for each supplier, a set one for each of its sales, labelled in tiles of 16."""
    px = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("scene_id"), (F.col("l_orderkey") % 61).alias("r"), (F.col("l_partkey") % 59).alias("c"))
    each = regions.region_figures(regions.labelled(px, tile=16))
    return each.select("scene_id", F.shiftright("label", 32).alias("first_r"), F.col("label").bitwiseAND(F.lit(0xFFFFFFFF)).alias("first_c"), "n_px", "r0", "r1", "c0", "c1")


@query("u08_shrunk_scene", "SELECT l_suppkey % 3 AS scene_id, l_orderkey % 100 // 8 AS r, l_partkey % 100 // 8 AS c, round(avg(l_quantity), 6) AS db FROM lineitem GROUP BY 1, 2, 3")
def u08(spark: SparkSession, sf: str) -> DataFrame:
    px = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).alias("scene_id"), (F.col("l_orderkey") % 100).alias("r"), (F.col("l_partkey") % 100).alias("c"), F.col("l_quantity").alias("db"))
    return records.shrunk(px, 8).select("scene_id", "r", "c", r6("db").alias("db"))


@query("u11_comparison_table", "WITH m AS (SELECT 'own' AS method, avg(l_tax)::DOUBLE AS iou, avg(l_discount)::DOUBLE AS recall FROM lineitem UNION ALL SELECT 'published', 0.5, NULL) SELECT method, 'iou' AS metric, round(iou, 6) AS value, 'shared over joined pixels' AS definition FROM m UNION ALL SELECT method, 'recall', round(recall, 6), 'found over true' FROM m")
def u11(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "lineitem").agg(F.avg("l_tax").cast("double").alias("iou"), F.avg("l_discount").cast("double").alias("recall")).withColumn("method", F.lit("own"))
    published = spark.createDataFrame([("published", 0.5)], "method string, iou double")
    long = records.comparison(own, published, {"iou": "shared over joined pixels", "recall": "found over true"})
    return long.select("method", "metric", r6("value").alias("value"), "definition")
