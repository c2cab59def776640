"""Sources, projections, filters, aggregates, sorts, sets and scalars on the driver's tables."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate, grid as G, ingest, score, tracks
from ..sources import curve, readers, sinks
from .registry import GRID, HEAD, POS, T0, T0_US, T1, T1_US, folder, grid, instant, positions, query, r6, sampled, table, us


def raw_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Positions as an archive would publish them, with sentinels and blanks."""
    p = positions(spark, sf)
    i = F.col("event_id")
    return p.select(
        F.col("mmsi").alias("MMSI"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("BaseDateTime"), F.col("lat").alias("LAT"), F.col("lon").alias("LON"), F.when(i % 11 == 0, 102.3).otherwise(F.col("sog")).alias("SOG"),
        F.when(i % 13 == 0, 360.0).otherwise(F.col("cog")).alias("COG"), F.when(i % 17 == 0, 511.0).otherwise(F.col("cog")).alias("Heading"), F.when(i % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "name")).alias("VesselName"),
        F.col("type_code").cast("string").alias("VesselType"), F.col("cargo_code").cast("string").alias("Cargo"),
    )


@query("a01_csv_scan_normalised", f"""WITH {POS} SELECT mmsi, (us // 1000000) * 1000000 AS us, round(lon, 6) AS lon, round(lat, 6) AS lat, CASE WHEN event_id % 11 <> 0 AND sog < 102 THEN round(sog, 6) END AS sog, CASE WHEN event_id % 13 <> 0 THEN cog END AS cog,
 CASE WHEN event_id % 17 <> 0 THEN cog END AS heading, CASE WHEN event_id % 5 <> 0 THEN name END AS name, type_code, vessel_type, cargo_code, 'noaa' AS source FROM pos""")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    raw_reports(spark, sf).write.option("header", True).csv(path)
    d = ingest.normalise_reports(readers.read_reports(spark, [f"{path}/*.csv"]))
    return d.select("mmsi", us("ts").alias("us"), r6("lon").alias("lon"), r6("lat").alias("lat"), r6("sog").alias("sog"), "cog", "heading", "name", "type_code", "vessel_type", "cargo_code", "source")


@query("a02_rejected_rows", "SELECT (SELECT count(*) FROM events)::BIGINT + 2 AS n_rows, (SELECT count(*) FROM events)::BIGINT + 1 AS n_located, 1::BIGINT AS n_bad")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    raw_reports(spark, sf).write.option("header", True).csv(f"{path}/a")
    head = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,VesselType,Cargo"
    spark.createDataFrame([(head,), ("123456789,2024-01-01T00:00:00,28,-94,1,1,1,X,70,1",), ("123456789,2024-01-01T00:00:00,north,-94,1,1,1,X,70,1",)], "value string").coalesce(1).write.text(f"{path}/b")
    d = readers.rejected(readers.read_reports(spark, [f"{path}/a/*.csv", f"{path}/b/*.txt"]))
    return d.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_located").alias("n_located"), F.sum("n_bad").alias("n_bad"))


@query("a04_file_days", "SELECT strftime(d, '%Y-%m-%d') AS day, 'AIS_' || strftime(d, '%Y_%m_%d') || '.csv' AS file FROM (SELECT DISTINCT ts::DATE AS d FROM events)")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    f = positions(spark, sf).select(F.concat(F.lit("AIS_"), F.date_format("ts", "yyyy_MM_dd"), F.lit(".csv")).alias("file")).distinct()
    return f.select(F.date_format(readers.file_day(F.col("file")), "yyyy-MM-dd").alias("day"), "file")


@query("a05_extract_round_trip", f"WITH {POS} SELECT source, count(*) AS n, round(sum(lon), 4) AS s FROM pos WHERE lon BETWEEN -94.5 AND -93.5 GROUP BY source")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    sinks.write_extract(positions(spark, sf).where(F.col("lon").between(-94.5, -93.5)), path)
    return readers.read_extracts(spark, [path]).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("lon"), 4).alias("s"))


_BOXES = [(-94.6, 28.3, -94.2, 28.9), (-94.3, 28.5, -93.9, 29.1), (-93.2, 29.7, -93.0, 30.0)]


@query("a05_boxes_of_curve_extract", f"WITH {POS} SELECT event_id, mmsi, us AS ts_us, round(lon, 6) AS lon, round(lat, 6) AS lat FROM pos WHERE " + " OR ".join(f"(lon BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n})" for w, s, e, n in _BOXES))
def a05_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Positions in any of three boxes, from an extract that is laid along a curve and opened where they lie."""
    path = folder(spark)
    curve.write_by_place(positions(spark, sf), path, extent=(-95.0, 28.0, -93.0, 30.0), zone_bits=4)
    return curve.read_boxes(spark, path, _BOXES).select("event_id", "mmsi", us("ts").alias("ts_us"), r6("lon").alias("lon"), r6("lat").alias("lat"))


@query("a06_union_by_name", f"WITH {POS} SELECT source, count(*) AS n FROM (SELECT source FROM pos WHERE event_id % 2 = 0 UNION ALL SELECT 'noaa' FROM pos WHERE event_id % 2 = 1) GROUP BY source")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    a, b = folder(spark), folder(spark)
    p = positions(spark, sf)
    p.where("event_id % 2 = 0").write.parquet(a)
    p.where("event_id % 2 = 1").drop("source").write.parquet(b)
    return readers.read_extracts(spark, [a, b]).groupBy("source").agg(F.count("*").alias("n"))


@query("a10_presence_rows", f"WITH {POS} SELECT mmsi, (us // 60000000) * 60000000 AS us, round(lon, 6) AS lon, round(lat, 6) AS lat, NULL::DOUBLE AS sog, CASE WHEN event_id % 4 = 0 THEN 'tanker' ELSE 'other' END AS vessel_type, 'gfw' AS source FROM pos WHERE (us // 60000000) * 60000000 BETWEEN {T0_US} AND {T1_US}")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf)
    row = F.struct("mmsi", "lat", "lon", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("date"), F.lit(" ").alias("shipName"), F.when(F.col("event_id") % 4 == 0, "Tanker").otherwise("GEAR").alias("vesselType"))
    docs = p.groupBy(F.col("event_id") % 10).agg(F.to_json(F.struct(F.array(F.create_map(F.lit("presence"), F.collect_list(row))).alias("entries"))).alias("body"))
    d = readers.presence_positions(readers.presence_rows(docs), instant(T0), instant(T1))
    return d.select("mmsi", us("ts").alias("us"), r6("lon").alias("lon"), r6("lat").alias("lat"), "sog", "vessel_type", "source")


@query("a11_contacts_near_scene", f"WITH {POS} SELECT event_id FROM pos WHERE abs(us - {T0_US}) <= 36000000000")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return readers.contacts_near(positions(spark, sf), T0_US, 600).select("event_id")


@query("a13_scene_search", "SELECT o_orderkey AS scene_id, epoch_us(o_orderdate) AS us FROM orders WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN '1997-01-01' AND '1997-12-31' AND o_custkey % 100 <= 40 AND o_custkey % 100 + 10 >= 20 ORDER BY o_orderdate, o_orderkey LIMIT 50")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("o_custkey") % 100
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").cast("timestamp").alias("t"), w.alias("west"), (w + 10).alias("east"), F.lit(0).alias("south"), F.lit(1).alias("north"), F.col("o_orderstatus").alias("mode"))
    return readers.scene_search(c, 20, 0, 40, 1, instant("1997-01-01T00:00:00Z"), instant("1997-12-31T00:00:00Z"), mode="F").select("scene_id", us("t").alias("us"))


@query("a14_field_long_rows", "SELECT l_suppkey AS case_id, count(*) AS n, round(sum(u), 5) AS u FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_partkey % 10 AS y, 0.001::DOUBLE * min(l_quantity) OVER (PARTITION BY l_suppkey, l_linenumber, l_partkey % 10) AS u FROM lineitem) GROUP BY l_suppkey")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("case_id"), F.lit("current").alias("kind"), F.col("l_linenumber").alias("t_epoch"), (F.col("l_partkey") % 10 + 1e-7).alias("lat"), F.lit(1.0).alias("lon"), F.col("l_quantity").alias("u"), F.lit(0.0).alias("v"))
    return readers.field_table(rows).groupBy("case_id").agg(F.count("*").alias("n"), F.round(F.sum("u"), 5).alias("u"))


@query("a15_field_speed_check", "SELECT l_suppkey AS case_id, round(quantile_cont(sqrt(pow(l_quantity / 20, 2) + l_discount * l_discount), 0.99), 6) AS p99, quantile_cont(sqrt(pow(l_quantity / 20, 2) + l_discount * l_discount), 0.99) <= 2.5 AS plausible FROM lineitem GROUP BY l_suppkey")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.lit("current").alias("kind"), (F.col("l_quantity") / 20).alias("u"), F.col("l_discount").alias("v"))
    return readers.field_speed_check(f, 2.5).select("case_id", r6("p99_ms").alias("p99"), "plausible")


@query("a16_field_identity", "SELECT l_suppkey AS case_id, min(l_partkey) <= l_suppkey * 3 AND max(l_partkey) >= l_suppkey * 5 AS covers_box, min(l_linenumber) - 1 <= l_suppkey % 10 AND max(l_linenumber) + 1 >= l_suppkey % 10 AS covers_time FROM lineitem GROUP BY l_suppkey")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").alias("t_epoch"), F.col("l_partkey").alias("lon"), F.lit(0).alias("lat"))
    k = F.col("s_suppkey")
    cases = table(spark, sf, "supplier").select(k.alias("case_id"), (k % 10).alias("t0_epoch"), (k * 3).alias("west"), (k * 5).alias("east"), F.lit(0).alias("south"), F.lit(0).alias("north"))
    have = f.select("case_id").distinct()
    return readers.field_identity(f, cases.join(have, "case_id"), 1)


@query("a18_byte_scale", """WITH e AS (SELECT l_returnflag AS scene_id, quantile_cont(l_extendedprice, 0.02) AS a, quantile_cont(l_extendedprice, 0.98) AS z FROM lineitem GROUP BY 1)
SELECT scene_id, round_even(greatest(0, least(1, (l_extendedprice - a) / (z - a))) * 255, 0)::INTEGER AS byte, count(*) AS n FROM lineitem JOIN e ON l_returnflag = scene_id GROUP BY 1, 2""")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    px = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scene_id"), F.col("l_extendedprice").alias("db"))
    return readers.byte_scale(px).groupBy("scene_id", "byte").agg(F.count("*").alias("n"))


@query("a20_sharded_tiles", "SELECT count(*) AS n, (max(l_orderkey) - min(l_orderkey))::BIGINT AS span FROM lineitem")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    sinks.write_shards(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), path, 2000)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), (F.max("l_orderkey") - F.min("l_orderkey")).alias("span"))


@query("a21_json_documents", "SELECT n_nationkey AS case_id, '{\"name\":\"' || n_name || '\",\"region\":' || CASE WHEN n_regionkey = 0 THEN 'null' ELSE n_regionkey::VARCHAR END || '}' AS body FROM nation")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("case_id"), F.col("n_name").alias("name"), F.nullif("n_regionkey", F.lit(0)).alias("region"))
    return sinks.as_json(n)


@query("a22_stale_cases", "SELECT n_nationkey AS case_id FROM nation WHERE n_nationkey % 3 = 0")
def a22(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("case_id"), F.col("n_regionkey").alias("ident"))
    moved = n.withColumn("ident", F.when(F.col("case_id") % 3 == 0, -1).otherwise(F.col("ident")))
    return sinks.stale(n, moved, ["ident"])


@query("a23_reindex", """WITH old AS (SELECT n_nationkey AS case_id, (24 - n_nationkey)::BIGINT AS place FROM nation WHERE n_nationkey < 15), now AS (SELECT n_nationkey AS case_id FROM nation WHERE n_nationkey >= 10)
SELECT case_id, row_number() OVER (ORDER BY old.place IS NULL, old.place, case_id)::INTEGER AS place FROM now LEFT JOIN old USING (case_id)""")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("case_id"))
    return sinks.reindex(n.where("case_id < 15").withColumn("place", 24 - F.col("case_id")), n.where("case_id >= 10"))


@query("a25_missing_scenes", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.missing_scenes(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("b04_ship_classes", f"WITH {POS} SELECT vessel_type, count(*) AS n, CASE vessel_type WHEN 'tanker' THEN 1.0::DOUBLE WHEN 'cargo' THEN 1.0 WHEN 'fishing' THEN 0.4 WHEN 'passenger' THEN 0.2 ELSE 0.5 END AS prior FROM pos GROUP BY vessel_type")
def b04(spark: SparkSession, sf: str) -> DataFrame:
    return positions(spark, sf).groupBy("vessel_type").agg(F.count("*").alias("n")).withColumn("prior", score.type_prior(F.col("vessel_type")))


@query("b08_rounded_lines", f"WITH {POS} SELECT mmsi, count(*)::INTEGER AS n, round(arg_min(lon, us), 5) AS lon0, round(arg_max(lat, us), 5) AS lat1, round(sum(round_even(lon, 5)), 4) AS s FROM pos GROUP BY mmsi")
def b08(spark: SparkSession, sf: str) -> DataFrame:
    d = tracks.track_lines(positions(spark, sf))
    total = F.aggregate("line", F.lit(0.0), lambda t, x: t + x[0])
    return d.select("mmsi", F.size("line").alias("n"), F.col("line")[0][0].alias("lon0"), F.element_at(F.col("line"), -1)[1].alias("lat1"), F.round(total, 4).alias("s"))


@query("b09_label_features", "SELECT doc_id, (n_chars >= 1000)::INTEGER AS is_linear, CASE WHEN doc_id % 4 <> 0 THEN round((n_chars - 500.0::DOUBLE) / (doc_id % 4), 6) END AS snr FROM documents")
def b09(spark: SparkSession, sf: str) -> DataFrame:
    mad = F.nullif(F.col("doc_id") % 4, F.lit(0))
    return table(spark, sf, "documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("is_linear"), r6((F.col("n_chars") - 500.0) / mad).alias("snr"))


@query("b10_feature_vector", "SELECT doc_id, [round(ln(1 + n_chars), 6), (lang = 'en')::INTEGER::DOUBLE, round(sqrt(n_chars), 6)] AS x FROM documents")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array(r6(F.log1p("n_chars")), (F.col("lang") == "en").cast("double"), r6(F.sqrt("n_chars"))).alias("x"))


@query("b12_summary_text", "SELECT c_custkey, printf('%s: %d orders, top %.2f', c_name, count(o_orderkey), coalesce(max(o_totalprice), 0)) AS said FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def b12(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    c = table(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.select("c_custkey", F.format_string("%s: %d orders, top %.2f", "c_name", F.coalesce("n", F.lit(0)), F.coalesce("top", F.lit(0.0))).alias("said"))


@query("c01_box_and_window", f"WITH {POS} SELECT event_id FROM pos WHERE lon BETWEEN -94.5 AND -93.5 AND lat BETWEEN 28.5 AND 29.5 AND us >= {T0_US} AND us < {T1_US}")
def c01(spark: SparkSession, sf: str) -> DataFrame:
    return positions(spark, sf).where(ingest.in_box(-94.5, 28.5, -93.5, 29.5) & ingest.in_window(instant(T0), instant(T1))).select("event_id")


@query("c04_search_box", "SELECT s_suppkey AS case_id, round(-95 - 2 * k / (111.32 * greatest(cos(radians(28.5)), 0.01)), 6) AS west, round(28 - 2 * k / 111.32, 6) AS south, 1704844800000000 - 21600000000 AS start_us, 1705104000000000 + 21600000000 AS stop_us FROM (SELECT s_suppkey, (s_suppkey % 40 + 1)::DOUBLE AS k FROM supplier)")
def c04(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case_id"), F.lit(-95.0).alias("west"), F.lit(28.0).alias("south"), F.lit(-93.0).alias("east"), F.lit(29.0).alias("north"), (F.col("s_suppkey") % 40 + 1).cast("double").alias("radius_90_km"), instant(T0).alias("window_start"), instant(T1).alias("window_end"))
    return ingest.search_box(o).select("case_id", r6("west").alias("west"), r6("south").alias("south"), us("start").alias("start_us"), us("stop").alias("stop_us"))


@query("c07_overlapping_tracks", f"WITH {POS}, t AS (SELECT mmsi, min(us) AS a, max(us) AS b FROM pos GROUP BY mmsi) SELECT mmsi FROM t WHERE NOT (b < {T0_US} OR a > {T1_US})")
def c07(spark: SparkSession, sf: str) -> DataFrame:
    t = positions(spark, sf).groupBy("mmsi").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return t.where(tracks.overlaps(F.col("a"), F.col("b"), instant(T0), instant(T1))).select("mmsi")


IDENT = "CASE i % 9 WHEN 0 THEN '99' || lpad(i::VARCHAR, 7, '0') WHEN 1 THEN '98' || lpad(i::VARCHAR, 7, '0') WHEN 2 THEN '97' || lpad(i::VARCHAR, 7, '0') WHEN 3 THEN '111' || lpad(i::VARCHAR, 6, '0') WHEN 4 THEN '00' || lpad(i::VARCHAR, 7, '0') WHEN 5 THEN '0' || lpad((i + 10000000)::VARCHAR, 8, '0') WHEN 6 THEN '1' || i::VARCHAR WHEN 7 THEN '900' || lpad(i::VARCHAR, 6, '0') ELSE '366' || lpad(i::VARCHAR, 6, '0') END"


@query("c09_identity_classes", f"""SELECT problem, count(*) AS n FROM (SELECT CASE i % 9 WHEN 0 THEN 'aid to navigation' WHEN 1 THEN 'craft of a parent ship' WHEN 2 THEN 'distress transmitter' WHEN 3 THEN 'search and rescue aircraft' WHEN 4 THEN 'coast station'
 WHEN 5 THEN 'group of ships' WHEN 6 THEN 'not nine digits' WHEN 7 THEN 'no country code' END AS problem FROM (SELECT c_custkey AS i, {IDENT.replace('i %', 'c_custkey %').replace('i::', 'c_custkey::').replace('(i +', '(c_custkey +')} AS m FROM customer)) GROUP BY problem""")
def c09(spark: SparkSession, sf: str) -> DataFrame:
    sql = IDENT.replace("::VARCHAR", "")
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("i")).select(F.expr(sql).alias("m"))
    return m.select(S.identity_problem(F.col("m")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("c12_on_edge", f"WITH {POS}, b AS (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM pos) SELECT event_id FROM pos, b WHERE least(abs(lon - w), abs(lon - e), abs(lat - s), abs(lat - n)) <= 0.02")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf)
    box = p.agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    return p.crossJoin(F.broadcast(box)).where(score.on_edge(*(F.col(c) for c in ("lon", "lat", "w", "s", "e", "n")))).select("event_id")


@query("c15_finite_rows", "SELECT count(*) FILTER (WHERE x IS NULL) AS n_null, count(*) FILTER (WHERE x IS NOT NULL) AS n_kept FROM (SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS x FROM lineitem)")
def c15(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("x"))
    kept, bad = ingest.not_finite(d, ["x"])
    return bad.select(F.col("x").alias("n_null")).crossJoin(kept.agg(F.count("*").alias("n_kept")))


@query("c21_traceable_cases", "SELECT n_nationkey AS case_id FROM nation WHERE n_regionkey IN (1, 3)")
def c21(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("case_id"), F.when(F.col("n_regionkey") % 2 == 1, F.array(F.lit("detect"), F.lit("trace"))).otherwise(F.array(F.lit("detect"))).alias("acts"))
    return n.where(F.array_contains("acts", "trace")).select("case_id")


@query("e01_extract_summary", f"WITH {POS} SELECT count(*) AS n_rows, count(DISTINCT mmsi) AS n_vessels, min(us) AS first_us, max(us) AS last_us, round(min(lon), 6) AS west, round(max(lat), 6) AS north FROM pos")
def e01(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.extract_summary(positions(spark, sf)).select("n_rows", "n_vessels", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"), r6("west").alias("west"), r6("north").alias("north"))


@query("e02_vessels_by_type", f"WITH {POS} SELECT vessel_type, count(DISTINCT mmsi) AS n_vessels FROM pos GROUP BY vessel_type")
def e02(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.vessels_by_type(positions(spark, sf))


@query("e03_cargo_histogram", f"WITH {POS} SELECT coalesce(nullif(cargo_code, 0), -1) AS cargo_code, count(DISTINCT mmsi) AS n_vessels FROM pos WHERE type_code IN (31, 32, 52) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def e03(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.cargo_histogram(positions(spark, sf).withColumn("cargo_code", F.nullif("cargo_code", F.lit(0))))


@query("e04_track_attributes", f"WITH {POS} SELECT mmsi, count(*) AS n, count(*) FILTER (WHERE source = 'noaa') AS n_noaa, coalesce(max(name) FILTER (WHERE source = 'noaa'), max(name)) AS name, arg_max(vessel_type, us) AS vessel_type, max(type_code) AS type_code, CASE WHEN count(DISTINCT source) = 2 THEN 'mixed' WHEN max(source) = 'noaa' THEN 'noaa_dense' ELSE 'gfw_hourly' END AS regime FROM pos GROUP BY mmsi")
def e04(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.track_attributes(positions(spark, sf)).select("mmsi", "n", "n_noaa", "name", "vessel_type", "type_code", "regime")


@query("e08_underway_median", f"WITH {POS} SELECT mmsi, CASE WHEN count(*) FILTER (WHERE sog >= 2) >= 3 THEN round(median(sog) FILTER (WHERE sog >= 2), 6) END AS med FROM pos GROUP BY mmsi")
def e08(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.underway_median(positions(spark, sf)).select("mmsi", r6("underway_median").alias("med"))


@query("e13_funnel", f"""WITH {POS}, {GRID}, {sampled()}, v AS (SELECT mmsi, CASE WHEN count(*) FILTER (WHERE source = 'noaa') >= 40 OR (count(*) FILTER (WHERE source = 'gfw') > 20 AND count(*) >= 2) THEN NULL ELSE 'short track' END AS problem, bool_or(us BETWEEN {T0_US} AND {T1_US}) AS w, max(p) FILTER (WHERE us BETWEEN {T0_US} AND {T1_US}) AS p FROM smp GROUP BY mmsi)
SELECT count(*) FILTER (WHERE problem IS NULL) AS in_region, count(*) FILTER (WHERE problem IS NULL AND w) AS in_window, count(*) FILTER (WHERE problem IS NULL AND w AND p > 0.05) AS plausible, least(3, count(*) FILTER (WHERE problem IS NULL AND w AND p > 0.05)) AS scored, count(problem) AS dropped_short_track, 0::BIGINT AS dropped_non_vessel FROM v""")
def e13(spark: SparkSession, sf: str) -> DataFrame:
    p = G.sample(positions(spark, sf), grid(spark), HEAD)
    inside = F.col("ts").between(instant(T0), instant(T1))
    short = ~((F.count_if(F.col("source") == "noaa") >= 40) | ((F.count_if(F.col("source") == "gfw") > 20) & (F.count("*") >= 2)))
    v = p.groupBy("mmsi").agg(F.when(short, "short track").alias("problem"), F.bool_or(inside).alias("in_window"), F.max(F.when(inside, F.col("p"))).alias("grid_probability"))
    return score.funnel(v.withColumn("case_id", F.lit("c"))).drop("case_id").withColumn("scored", F.col("scored").cast("long"))


@query("e19_weighted_percentile", """WITH c AS (SELECT l_returnflag AS k, l_extendedprice AS x, l_quantity AS w, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING) AS cw, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS t FROM lineitem),
d AS (SELECT *, lag(cw) OVER (PARTITION BY k ORDER BY cw, x) AS c0, lag(x) OVER (PARTITION BY k ORDER BY cw, x) AS x0 FROM c)
SELECT k, round(arg_min(CASE WHEN c0 IS NULL THEN x ELSE x0 + (0.5 * t - c0) / (cw - c0) * (x - x0) END, cw) FILTER (WHERE cw >= 0.5 * t), 4) AS p50, round(arg_min(CASE WHEN c0 IS NULL THEN x ELSE x0 + (0.9 * t - c0) / (cw - c0) * (x - x0) END, cw) FILTER (WHERE cw >= 0.9 * t), 4) AS p90 FROM d GROUP BY k""")
def e19(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"))
    return G.weighted_percentile(d, ["k"], "x", "w", {"p50": 0.5, "p90": 0.9}).select("k", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))


@query("e25_robust_scale", "WITH m AS (SELECT l_shipdate, l_returnflag AS k, l_quantity AS x, median(l_quantity) OVER (PARTITION BY l_returnflag) AS med FROM lineitem) SELECT k, med, round(greatest(1.4826 * median(abs(x - med)), 1e-3), 6) AS mad FROM m GROUP BY k, med")
def e25(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("x"))
    return G.robust_scale(d, ["k"], "x").select("k", "med", r6("mad").alias("mad"))


@query("e27_confusion", "SELECT lang, count(*) FILTER (WHERE q AND p) AS tp, count(*) FILTER (WHERE NOT q AND p) AS fp, count(*) FILTER (WHERE q AND NOT p) AS fn, count(*) FILTER (WHERE NOT q AND NOT p) AS tn, round(2.0 * count(*) FILTER (WHERE q AND p) / (2 * count(*) FILTER (WHERE q AND p) + count(*) FILTER (WHERE q <> p)), 6) AS f1 FROM (SELECT lang, quality = 1 AS q, n_chars > 500 AS p FROM documents JOIN labels USING (doc_id)) GROUP BY lang")
def e27(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", F.col("quality").alias("label"), (F.col("n_chars") > 500).cast("int").alias("predicted"))
    return evaluate.confusion(d, ["lang"]).select("lang", "tp", "fp", "fn", "tn", r6("f1").alias("f1"))


@query("e28_class_rates", "SELECT lang, round(avg((quality = 1)::INTEGER), 6) AS rate, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def e28(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return evaluate.class_rates(d, "lang", "quality").select("lang", r6("rate").alias("rate"), "n")


@query("e29_overlaps", "SELECT l_returnflag AS k, round(sum(i) / sum(u), 6) AS pooled_iou, round(avg(i / u), 6) AS macro_iou, round(2 * sum(i) / sum(i + u), 6) AS dice, count(*) AS n FROM (SELECT l_returnflag, l_quantity AS i, l_quantity + l_linenumber AS u FROM lineitem) GROUP BY 1")
def e29(spark: SparkSession, sf: str) -> DataFrame:
    i, u = F.col("l_quantity"), F.col("l_quantity") + F.col("l_linenumber")
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), i.alias("inter"), u.alias("uni"), i.alias("pred"), u.alias("gt"))
    return evaluate.overlaps(d, ["k"]).select("k", r6("pooled_iou").alias("pooled_iou"), r6("macro_iou").alias("macro_iou"), r6("dice").alias("dice"), "n")


@query("e31_wilson", "WITH t AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (WHERE quality = 1)::DOUBLE AS h FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, round((h / n + 1.959963984540054 * 1.959963984540054 / (2 * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n) - 1.959963984540054 / (1 + 1.959963984540054 * 1.959963984540054 / n) * sqrt(h / n * (1 - h / n) / n + 1.959963984540054 * 1.959963984540054 / (4 * n * n)), 6) AS lo FROM t")
def e31(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("h"))
    return d.select("lang", r6(evaluate.wilson(F.col("h"), F.col("n"))[0]).alias("lo"))


@query("e32_trial_summary", "SELECT o_orderpriority AS k, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_abstained, round(count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_custkey % 5 = 0)::DOUBLE / count(*) FILTER (WHERE o_orderstatus <> 'P'), 6) AS top1, median(o_custkey % 5 + 1) FILTER (WHERE o_orderstatus <> 'P') AS median_rank FROM orders GROUP BY 1")
def e32(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 5 + 1).alias("rank"), (F.col("o_orderstatus") == "P").alias("abstained"))
    return evaluate.trial_summary(d, ["k"]).select("k", "n", "n_abstained", r6("top1").alias("top1"), "median_rank")


@query("e37_mass_share", "SELECT l_returnflag AS k, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1")
def e37(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.mass_share(table(spark, sf, "lineitem").withColumn("k", F.col("l_returnflag")), "k", "l_quantity").select("k", r6("share").alias("share"))


@query("e38_percentile_extent", f"WITH {POS} SELECT source, round(quantile_cont(lon, 0.02), 6) AS west, round(quantile_cont(lon, 0.98), 6) AS east FROM pos GROUP BY source")
def e38(spark: SparkSession, sf: str) -> DataFrame:
    return positions(spark, sf).groupBy("source").agg(r6(F.percentile("lon", 0.02)).alias("west"), r6(F.percentile("lon", 0.98)).alias("east"))


@query("e39_track_report", f"WITH {POS}, t AS (SELECT mmsi, count(*) AS n FROM pos GROUP BY mmsi) SELECT count(*) AS n_tracks, min(n) AS min_n, median(n) AS median_n, max(n) AS max_n, (SELECT mmsi FROM t ORDER BY n DESC, mmsi DESC LIMIT 1) AS longest FROM t")
def e39(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.track_report(tracks.track_attributes(positions(spark, sf)))


@query("e40_scene_split", "WITH s AS (SELECT l_orderkey AS scene_id, max((l_returnflag = 'R')::INTEGER) AS label FROM lineitem GROUP BY 1) SELECT label, count(*) AS n FROM s GROUP BY label")
def e40(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scene_id"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    split = evaluate.stratified_split(evaluate.scene_labels(d), "scene_id", "label")
    train, test = evaluate.split_rows(d, split, 0)
    both = evaluate.scene_labels(train).union(evaluate.scene_labels(test))
    return both.groupBy("label").agg(F.count("*").alias("n"))


@query("e41_complete_rows", "SELECT count(*) AS n, count(*) FILTER (WHERE l_linenumber = 2) AS n_dropped FROM lineitem")
def e41(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") != 2, F.col("l_tax")).alias("x"))
    return evaluate.complete_rows(d, ["x"])[1]


@query("g01_total_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY round(o_totalprice / 1000, 0) DESC, o_custkey DESC, o_orderkey)::INTEGER AS rank FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY round(o_totalprice / 1000, 0) DESC, o_custkey DESC, o_orderkey) <= 3")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc(F.round(F.col("o_totalprice") / 1000, 0)), F.desc("o_custkey"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_orderkey", "rank")


@query("h03_set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def h03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").select("o_custkey"))


@query("h04_set_intersection", "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7")
def h04(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_suppkey").intersect(li.where("l_linenumber = 7").select("l_suppkey"))


@query("h05_exclusion_cap", """WITH u AS (SELECT o_orderstatus AS case_id, o_orderkey::VARCHAR AS mmsi, (o_orderkey % 3)::INTEGER AS prio, o_totalprice AS ord FROM orders WHERE o_orderkey % 4 <> 0)
SELECT case_id, mmsi, row_number() OVER (PARTITION BY case_id ORDER BY prio, ord, mmsi)::INTEGER AS ord FROM u QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY prio, ord, mmsi) <= 3""")
def h05(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("case_id"), F.col("o_orderkey").cast("string").alias("mmsi"), F.col("o_totalprice").alias("ord"), F.when(F.col("o_orderkey") % 4 != 0, "why").alias("reason"), (F.col("o_orderkey") % 3).alias("p"))
    return score.exclusions(*(o.where(F.col("p") == k) for k in range(3))).select("case_id", "mmsi", "ord")


@query("i04_reason_text", f"WITH {POS} SELECT event_id, printf('%.0f kn at %.3f', sog, lon) || CASE WHEN sog >= 10 THEN '; fast' ELSE '' END AS said FROM pos WHERE abs(sog - floor(sog) - 0.5) > 1e-9")
def i04(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf).where(F.abs(F.col("sog") - F.floor("sog") - 0.5) > 1e-9)
    return p.select("event_id", F.concat_ws("; ", F.format_string("%.0f kn at %.3f", "sog", "lon"), F.when(F.col("sog") >= 10, "fast")).alias("said"))


@query("i05_iso_times", f"WITH {POS} SELECT event_id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') AS iso, (us // 1000000) * 1000000 AS back_us FROM pos")
def i05(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(spark, sf).select("event_id", S.iso_utc(F.col("ts")).alias("iso"))
    return p.select("event_id", "iso", us(S.parse_utc(F.col("iso"))).alias("back_us"))


@query("i12_modulo_and_half_even", "SELECT l_linenumber, count(*) AS n, round(sum(round_even(l_quantity / 2, 0)), 0) AS s, sum(((l_linenumber - 10) % 4 + 4) % 4)::BIGINT AS m FROM lineitem GROUP BY 1")
def i12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum(S.half_even(F.col("l_quantity") / 2)).alias("s"), F.sum(F.pmod(F.col("l_linenumber") - 10, F.lit(4))).cast("long").alias("m"))


@query("i19_json_fields", "SELECT event_id, (props->>'$.k')::INTEGER AS k, coalesce((props->>'$.missing')::INTEGER, -1) AS missing FROM events")
def i19(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("j", F.from_json("props", "k int, missing int"))
    return e.select("event_id", F.col("j.k").alias("k"), F.coalesce("j.missing", F.lit(-1)).alias("missing"))


@query("o02_best_threshold", """WITH s AS (SELECT n_chars::DOUBLE AS threshold, sum(quality)::DOUBLE AS p, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), c AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER () AS t FROM s WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
SELECT threshold, round(2 * tp / (k + t), 6) AS f1, round(tp / t, 6) AS recall FROM c ORDER BY 2 * tp / (k + t) DESC, threshold DESC LIMIT 1""")
def o02(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))
    return evaluate.best_threshold(d).select("threshold", r6("f1").alias("f1"), r6("recall").alias("recall"))


@query("o03_stratified_folds", "SELECT label, count(*) AS n, count(*) // 5 AS least FROM embeddings GROUP BY label")
def o03(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.stratified_split(table(spark, sf, "embeddings"), "vec_id", "label").groupBy("label", "fold").agg(F.count("*").alias("m"))
    return s.groupBy("label").agg(F.sum("m").alias("n"), F.min("m").alias("least"))
