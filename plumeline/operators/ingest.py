"""Cleaning of raw position reports into positions, with audits of what was kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import below_sentinel, blank_to_null, ship_class
from ..sources.readers import has_column

# From these on AIS says 'not available'.
NO_SOG, NO_COG, NO_HEADING = 102.0, 360.0, 511.0
KM_PER_DEG = 111.32


def search_box(origin: DataFrame, pad_hours: float = 6.0, least_km: float = 0.0) -> DataFrame:
    """Box and half-open window to search for a case: the origin's box padded by twice r90.

    origin: (case_id, west, south, east, north, radius_90_km, window_start, window_end). Degrees of
    longitude are widened by the cosine at the middle latitude, held at 0.01.
    """
    km = F.greatest(2 * F.col("radius_90_km"), F.lit(least_km))
    cos = F.greatest(F.cos(F.radians((F.col("south") + F.col("north")) / 2)), F.lit(0.01))
    pad = F.expr(f"make_dt_interval(0, 0, 0, {pad_hours * 3600})")
    return origin.select(
        "case_id", (F.col("west") - km / (KM_PER_DEG * cos)).alias("west"), (F.col("south") - km / KM_PER_DEG).alias("south"), (F.col("east") + km / (KM_PER_DEG * cos)).alias("east"),
        (F.col("north") + km / KM_PER_DEG).alias("north"), (F.col("window_start") - pad).alias("start"), (F.col("window_end") + pad).alias("stop"),
    )


def in_box(west: float, south: float, east: float, north: float, lon: str = "lon", lat: str = "lat") -> Column:
    """Inclusive on all sides."""
    return F.col(lon).between(west, east) & F.col(lat).between(south, north)


def in_window(start, stop, ts: str = "ts") -> Column:  # noqa: ANN001
    """Half open: the start belongs to the window, the stop to the next one."""
    return (F.col(ts) >= start) & (F.col(ts) < stop)


def normalise_reports(raw: DataFrame, source: str = "noaa") -> DataFrame:
    """Raw reports under their archive's names as positions; what can't be read is null."""
    number = lambda c: F.col(c).try_cast("double")
    code = F.col("VesselType").try_cast("double").cast("int")
    cargo = F.col("Cargo").try_cast("double").cast("int") if has_column(raw, "Cargo") else F.lit(None).cast("int")
    return raw.select(
        F.trim("MMSI").alias("mmsi"), F.try_to_timestamp("BaseDateTime").alias("ts"), number("LON").alias("lon"), number("LAT").alias("lat"),
        below_sentinel(number("SOG"), NO_SOG).alias("sog"), below_sentinel(number("COG"), NO_COG).alias("cog"), below_sentinel(number("Heading"), NO_HEADING).alias("heading"),
        blank_to_null(F.col("VesselName")).alias("name"), code.alias("type_code"), ship_class(code).alias("vessel_type"), cargo.alias("cargo_code"), F.lit(source).alias("source"),
    )


def distinct_positions(positions: DataFrame) -> DataFrame:
    """One row for each vessel and instant: of repeated ones the first by all other columns."""
    rest = [c for c in positions.columns if c not in ("mmsi", "ts")]
    first = F.min(F.struct(*(F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c) for c in rest)))
    return positions.groupBy("mmsi", "ts").agg(first.alias("r")).select("mmsi", "ts", *(F.col(f"r.{c}.v").alias(c) for c in rest))


def day_continuity(days: DataFrame, day: str = "day") -> DataFrame:
    """(day, before, step, problem) of a set of daily files: 0 days on is a duplicate, more than 1 a hole."""
    before = F.lag(day).over(Window.orderBy(day))
    step = F.datediff(day, before)
    return days.select(F.col(day).alias("day"), before.alias("before"), step.alias("step"), F.when(step == 0, "duplicate").when(step > 1, "hole").alias("problem"))


def extract_summary(positions: DataFrame) -> DataFrame:
    """Rows, vessels, span and extent of an extract; one row, zero and null where it is empty."""
    return positions.agg(
        F.count("*").alias("n_rows"), F.countDistinct("mmsi").alias("n_vessels"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"),
    )


def vessels_by_type(positions: DataFrame) -> DataFrame:
    return positions.groupBy("vessel_type").agg(F.countDistinct("mmsi").alias("n_vessels")).orderBy(F.desc("n_vessels"), "vessel_type")


def cargo_histogram(positions: DataFrame, codes: tuple[int, ...] = (31, 32, 52), top: int = 12) -> DataFrame:
    """What tugs and tows say they carry: distinct vessels by cargo code, -1 for none."""
    cargo = F.coalesce("cargo_code", F.lit(-1)).alias("cargo_code")
    return positions.where(F.col("type_code").isin(*codes)).groupBy(cargo).agg(F.countDistinct("mmsi").alias("n_vessels")).orderBy(F.desc("n_vessels"), "cargo_code").limit(top)


def not_finite(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns are all finite, and the count of others for each column."""
    bad = {c: F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(True)) for c in columns}
    any_bad = F.lit(False)
    for b in bad.values():
        any_bad = any_bad | b
    return df.where(~any_bad), df.agg(*(F.count_if(b).alias(c) for c, b in bad.items()))
