"""Streaming forms of silences and source hours. An extension: the batch operators define the meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(positions: DataFrame, minutes: float = 30.0, late: str | None = None) -> DataFrame:
    """Runs of reports of a vessel without a silence longer than some minutes; works on batches and streams."""
    df = positions.withWatermark("ts", late) if late else positions
    s = df.groupBy("mmsi", F.session_window("ts", f"{int(minutes * 60)} seconds").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return s.select("mmsi", "first_ts", "last_ts", "n")


def hourly_counts(positions: DataFrame, late: str | None = None) -> DataFrame:
    """Reports by source and hour."""
    df = positions.withWatermark("ts", late) if late else positions
    return df.groupBy(F.window("ts", "1 hour").alias("w"), "source").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "source", "n")


def without_repeats(positions: DataFrame, late: str = "1 hour") -> DataFrame:
    """Streams only: drop reports of a vessel's instant that was seen within the watermark."""
    return positions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["mmsi", "ts"])
