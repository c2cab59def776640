"""Readers: position reports, gridded fields, pixel tables and JSON documents."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import parse_utc

RAW_REPORT = T.StructType([T.StructField(n, t) for n, t in (
    ("MMSI", T.StringType()), ("BaseDateTime", T.StringType()), ("LAT", T.DoubleType()), ("LON", T.DoubleType()), ("SOG", T.DoubleType()), ("COG", T.DoubleType()),
    ("Heading", T.DoubleType()), ("VesselName", T.StringType()), ("IMO", T.StringType()), ("CallSign", T.StringType()), ("VesselType", T.StringType()), ("Status", T.StringType()),
    ("Length", T.StringType()), ("Width", T.StringType()), ("Draft", T.StringType()), ("Cargo", T.StringType()), ("TransceiverClass", T.StringType()),
)])

POSITIONS = T.StructType([T.StructField(n, t) for n, t in (
    ("mmsi", T.StringType()), ("ts", T.TimestampType()), ("lon", T.DoubleType()), ("lat", T.DoubleType()), ("sog", T.DoubleType()), ("cog", T.DoubleType()), ("heading", T.DoubleType()),
    ("name", T.StringType()), ("type_code", T.IntegerType()), ("vessel_type", T.StringType()), ("cargo_code", T.IntegerType()), ("source", T.StringType()),
)])


#: First lines of files that are read at the same time.
HEADERS_AT_A_TIME = 16


def read_reports(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Daily CSV files, joined by column name, ids as text; bad lines stand in `_bad`.

    Years differ in their columns: each header that occurs is read with the columns it has. Headers
    are read by small jobs of one line, some at a time.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}

    def header(path: str) -> tuple[str, ...]:
        head = spark.read.text(path).limit(1).collect()
        return tuple(x.strip().strip('"') for x in head[0][0].lstrip("﻿").split(",")) if head else ()

    paths = list(paths)
    with ThreadPoolExecutor(HEADERS_AT_A_TIME) as pool:
        for p, names in zip(paths, pool.map(header, paths), strict=True):
            by_header.setdefault(names, []).append(p)
    known = {f.name: f for f in RAW_REPORT}
    out = None
    for names, files in by_header.items():
        schema = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names] + [T.StructField("_bad", T.StringType())])
        df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", True).csv(files)
        df = df.withColumn("_file", F.input_file_name())
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    for f in RAW_REPORT if out is not None else ():
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out if out is not None else spark.createDataFrame([], T.StructType([*RAW_REPORT, T.StructField("_bad", T.StringType()), T.StructField("_file", T.StringType())]))


def rejected(reports: DataFrame) -> DataFrame:
    """(file, n_bad, n_rows, n_located): lines that did not fit the schema, all lines, and those with a place.

    The parser looks only at columns that a query reads, so all typed ones are read here.
    """
    typed = [f.name for f in RAW_REPORT if isinstance(f.dataType, T.DoubleType)]
    measured = F.greatest(*(F.col(c).isNotNull().cast("int") for c in typed))
    located = F.col("LAT").isNotNull() & F.col("LON").isNotNull() & (measured == 1)
    return reports.groupBy("_file").agg(F.count_if(F.col("_bad").isNotNull()).alias("n_bad"), F.count("*").alias("n_rows"), F.count_if(located).alias("n_located"))


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def file_day(name: Column) -> Column:
    """The day in a daily file's name, as in ..._2024_01_05.csv."""
    part = lambda k: F.nullif(F.regexp_extract(name, r"(\d{4})_(\d{2})_(\d{2})", k), F.lit("")).cast("int")
    return F.make_date(part(1), part(2), part(3))


def file_day_check(reports: DataFrame) -> DataFrame:
    """For each file the day its name has, the day of its first report, and whether they agree."""
    days = reports.groupBy("_file").agg(F.to_date(F.min("BaseDateTime")).alias("first_day"))
    return days.withColumn("name_day", file_day(F.col("_file"))).withColumn("agrees", F.col("first_day") == F.col("name_day"))


def read_extracts(spark: SparkSession, paths: Iterable[str], default_source: str = "noaa") -> DataFrame:
    """Parquet extracts joined by name; rows without a recorded source take the default."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    source = F.coalesce("source", F.lit(default_source)) if has_column(df, "source") else F.lit(default_source)
    return df.withColumn("source", source)


def presence_rows(documents: DataFrame, json_col: str = "body") -> DataFrame:
    """Flatten hourly presence answers: entries are objects that map a dataset to its rows."""
    row = "struct<mmsi:string,lat:double,lon:double,date:string,shipName:string,vesselType:string>"
    parsed = documents.select(F.from_json(json_col, f"struct<entries:array<map<string,array<{row}>>>>").alias("j"))
    each = parsed.select(F.explode("j.entries").alias("e")).select(F.explode(F.map_values("e")).alias("rows"))
    return each.where("rows is not null").select(F.explode("rows").alias("r")).select("r.*")


# Presence classes and what they are called here.
PRESENCE_CLASS = {"TANKER": "tanker", "CARGO": "cargo", "FISHING": "fishing", "PASSENGER": "passenger"}


def presence_positions(rows: DataFrame, start, end) -> DataFrame:  # noqa: ANN001
    """Presence rows as positions: closed at both ends, without what the source does not publish."""
    kinds = F.create_map(*(F.lit(x) for kv in PRESENCE_CLASS.items() for x in kv))
    ts = F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm"))
    kept = rows.withColumn("ts", ts).where("mmsi is not null and lat is not null and lon is not null and ts is not null").where(F.col("ts").between(start, end))
    null = lambda t: F.lit(None).cast(t)
    return kept.select(
        "mmsi", "ts", "lon", "lat", null("double").alias("sog"), null("double").alias("cog"), null("double").alias("heading"), F.nullif(F.trim("shipName"), F.lit("")).alias("name"),
        null("int").alias("type_code"), F.coalesce(F.try_element_at(kinds, F.upper("vesselType")), F.lit("other")).alias("vessel_type"), null("int").alias("cargo_code"), F.lit("gfw").alias("source"),
    )


def contacts_near(contacts: DataFrame, scene_us: int, minutes: float = 10) -> DataFrame:
    """External radar contacts within some minutes of a scene."""
    return contacts.where(F.abs(F.unix_micros("ts") - scene_us) <= minutes * 60e6)


def field_table(rows: DataFrame, scale: float = 0.001) -> DataFrame:
    """Gridded vectors in long form: integers scaled, axes rounded, chunk borders once."""
    keys = ["case_id", "kind", "t_epoch", "lat", "lon"]
    out = rows.select("case_id", "kind", "t_epoch", F.bround("lat", 5).alias("lat"), F.bround("lon", 5).alias("lon"), (F.col("u") * scale).alias("u"), (F.col("v") * scale).alias("v"))
    return out.groupBy(*keys).agg(F.min("u").alias("u"), F.min("v").alias("v"))


def field_speed_check(field: DataFrame, limit: float = 3.0) -> DataFrame:
    """The 99th percentile of speed by case and kind, and whether it is possible."""
    p99 = F.percentile(F.hypot("u", "v"), 0.99)
    return field.groupBy("case_id", "kind").agg(p99.alias("p99_ms")).withColumn("plausible", F.col("p99_ms") <= limit)


def field_identity(field: DataFrame, cases: DataFrame, seconds: float = 60) -> DataFrame:
    """Cached fields against their cases (case_id, t0_epoch, west, south, east, north): time and box must cover."""
    span = field.groupBy("case_id").agg(F.min("t_epoch").alias("t_lo"), F.max("t_epoch").alias("t_hi"), F.min("lon").alias("x_lo"), F.max("lon").alias("x_hi"), F.min("lat").alias("y_lo"), F.max("lat").alias("y_hi"))
    joined = cases.join(span, "case_id", "left")
    covers = (F.col("x_lo") <= F.col("west")) & (F.col("x_hi") >= F.col("east")) & (F.col("y_lo") <= F.col("south")) & (F.col("y_hi") >= F.col("north"))
    near = (F.col("t0_epoch") >= F.col("t_lo") - seconds) & (F.col("t0_epoch") <= F.col("t_hi") + seconds)
    return joined.select("case_id", F.coalesce(covers, F.lit(False)).alias("covers_box"), F.coalesce(near, F.lit(False)).alias("covers_time"))


def pixels_from_bytes(pixels: DataFrame, low_db: float, high_db: float) -> DataFrame:
    """Undo an 8-bit clamp of decibels: value 0..255 becomes low_db..high_db."""
    return pixels.withColumn("db", F.lit(low_db) + F.col("value") / 255.0 * (high_db - low_db))


def box_drift(declared: DataFrame, found: DataFrame, limit: float = 1e-3) -> DataFrame:
    """Scenes whose raster's box differs from the declared one by more than the limit in degrees."""
    sides = ("west", "south", "east", "north")
    both = declared.join(found.select("scene_id", *(F.col(s).alias(f"{s}_f") for s in sides)), "scene_id")
    drift = F.greatest(*(F.abs(F.col(s) - F.col(f"{s}_f")) for s in sides))
    return both.select("scene_id", drift.alias("drift_deg"), (drift <= limit).alias("agrees"))


def byte_scale(pixels: DataFrame, value: str = "db", lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Scale decibels to 0..255 by scene, between two percentiles; null where there is no value or a scene has one only."""
    ends = pixels.groupBy("scene_id").agg(F.percentile(value, F.array(F.lit(lo), F.lit(hi))).alias("e"))
    a, z = F.col("e")[0], F.col("e")[1]
    share = F.when(F.col(value).isNotNull() & (z > a), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - a) / F.nullif(z - a, F.lit(0.0)))))
    return pixels.join(F.broadcast(ends), "scene_id").withColumn("byte", F.bround(share * 255).cast("int")).drop("e")


def scene_search(catalogue: DataFrame, west: float, south: float, east: float, north: float, start, end, limit: int = 50, **equal: str) -> DataFrame:  # noqa: ANN001
    """Scenes that meet a box and a span, with equal properties, by time."""
    met = catalogue.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south) & F.col("t").between(start, end))
    for name, value in equal.items():
        met = met.where(F.col(name) == value)
    return met.orderBy("t", "scene_id").limit(limit)


def first_pass(catalogue: DataFrame, incidents: DataFrame) -> DataFrame:
    """For each incident (case_id, t_incident) the first scene after it and how soon: green to 3 days, amber to 10.

    An incident with no scene, or with earlier ones only, stays with a null scene and is red.
    """
    scenes = catalogue.select(F.col("case_id").alias("of_case"), "t", "scene_id")
    after = incidents.join(scenes, (F.col("case_id") == F.col("of_case")) & (F.col("t") >= F.col("t_incident")), "left")
    best = after.groupBy("case_id", "t_incident").agg(F.min(F.when(F.col("t").isNotNull(), F.struct("t", "scene_id"))).alias("s"))
    days = (F.unix_micros("s.t") - F.unix_micros("t_incident")) / F.lit(86400e6)
    light = F.when(days <= 3, "green").when(days <= 10, "amber").otherwise("red")
    return best.select("case_id", F.col("s.scene_id").alias("scene_id"), days.alias("days"), light.alias("light"))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with a declared schema; NaN and Infinity are not JSON."""
    return spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", False).json(path)


def times_without_zone(df: DataFrame, column: str) -> DataFrame:
    """Rows whose time can't be placed: no zone, or no time at all."""
    return df.where(F.col(column).isNotNull() & parse_utc(F.col(column)).isNull())
