"""Sinks: Parquet extracts, sharded tiles, JSON documents and appended labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_extract(positions: DataFrame, path: str) -> None:
    """A position extract, clustered by vessel and in time order within it, so that scans prune."""
    positions.repartitionByRange("mmsi").sortWithinPartitions("mmsi", "ts").write.mode("overwrite").parquet(path)


def write_rows(spark: SparkSession, rows: list[tuple], schema, path: str) -> None:  # noqa: ANN001
    """A few driver-side rows as a typed table; no rows make an empty table with its schema."""
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)


def write_shards(tiles: DataFrame, path: str, most: int = 2000) -> None:
    """Tiles in files of a bounded number of rows."""
    tiles.write.mode("overwrite").option("maxRecordsPerFile", most).parquet(path)


def as_json(df: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, body): each row as a JSON object; null fields are kept, since null says 'not applicable'."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("body"))


def feature_collections(features: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, body): the GeoJSON of all of a key's features (id, ring, properties), ordered by id."""
    point = F.transform("ring", lambda p: F.array(F.bround(p["lon"], 5), F.bround(p["lat"], 5)))
    one = F.struct(F.lit("Feature").alias("type"), "id", "properties", F.struct(F.lit("Polygon").alias("type"), F.array(point).alias("coordinates")).alias("geometry"))
    every = features.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", one.alias("f")))).alias("fs"))
    return every.select(key, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda x: x["f"]).alias("features"))).alias("body"))


def missing_scenes(wanted: DataFrame, have: DataFrame, key: str = "scene_id") -> DataFrame:
    """Scenes that a label table doesn't have yet."""
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def backfill(wanted: DataFrame, have: DataFrame, extract, path: str, key: str = "scene_id") -> None:  # noqa: ANN001
    """Append the labels of missing scenes only."""
    extract(missing_scenes(wanted, have, key)).write.mode("append").parquet(path)


def reindex(previous: DataFrame, present: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, place): the old order without what has gone, then what is new by key. Broken down by distributed ranks."""
    old = previous.join(present.select(key).distinct(), key, "left_semi").select(key, F.lit(0).alias("new"), F.col("place").cast("long").alias("place"))
    new = present.select(key).distinct().join(previous.select(key), key, "left_anti").select(key, F.lit(1).alias("new"), F.lit(0).cast("long").alias("place"))
    from pyspark.sql import Window

    return old.union(new).withColumn("place", F.row_number().over(Window.orderBy("new", "place", key))).select(key, "place")


def stale(published: DataFrame, staged: DataFrame, identity: list[str], key: str = "case_id") -> DataFrame:
    """Cases whose staged tables carry another identity than the published meta."""
    return staged.select(key, *identity).distinct().join(published.select(key, *identity).distinct(), [key, *identity], "left_anti").select(key).distinct()
