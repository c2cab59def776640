"""Vessel tracks in long form: source precedence, silences, interpolation and decimation.

Tracks stay rows keyed by vessel; arrays are made for output only. Windows are partitioned by vessel
and ordered by time, so a fleet of any size spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.scalars import identity_problem, minutes_between

# Minutes between two fixes across which a position may be interpolated.
DENSE_CEILING_MIN, HOURLY_CEILING_MIN = 30.0, 75.0
UNDERWAY_KNOTS = 2.0


def by_time() -> WindowSpec:
    return Window.partitionBy("mmsi").orderBy("ts")


def dense_wins(positions: DataFrame) -> DataFrame:
    """Drop hourly rows of vessel hours in which the dense source was heard; one shuffle by vessel and hour."""
    dense = F.max(F.when(F.col("source") == "noaa", 1).otherwise(0)).over(Window.partitionBy("mmsi", F.date_trunc("hour", "ts")))
    return positions.withColumn("_dense", dense).where((F.col("source") == "noaa") | (F.col("_dense") == 0)).drop("_dense")


def with_gaps(positions: DataFrame) -> DataFrame:
    """Each fix with the next of its vessel (next_*) and the minutes to it; null at a track's end."""
    ahead = [F.lead(c).over(by_time()).alias(f"next_{c}") for c in ("ts", "lon", "lat", "sog", "source") if c in positions.columns]
    return positions.select("*", *ahead).withColumn("gap_min", minutes_between(F.col("ts"), F.col("next_ts")))


def track_attributes(positions: DataFrame) -> DataFrame:
    """One row for each vessel: names prefer the dense source, types are the latest known."""
    dense = F.col("source") == "noaa"
    return positions.groupBy("mmsi").agg(
        F.count("*").alias("n"), F.count_if(dense).alias("n_noaa"), F.count_if(F.col("source") == "gfw").alias("n_gfw"),
        F.coalesce(F.max(F.when(dense, F.col("name"))), F.max("name")).alias("name"), F.max_by("vessel_type", F.when(F.col("vessel_type").isNotNull(), F.struct("ts", "vessel_type"))).alias("vessel_type"),
        F.max("type_code").alias("type_code"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
    ).withColumn("regime", source_label("n_noaa", "n_gfw"))


def source_label(n_noaa: str, n_gfw: str) -> Column:
    """What a track was heard by; null where no row says."""
    return F.when((F.col(n_noaa) > 0) & (F.col(n_gfw) > 0), "mixed").when(F.col(n_noaa) > 0, "noaa_dense").when(F.col(n_gfw) > 0, "gfw_hourly")


def usable_tracks(attributes: DataFrame, min_points: int = 10) -> DataFrame:
    """Tracks (mmsi, ..., problem): null where usable, else why not; each is counted, none derived."""
    short = ~((F.col("n_noaa") >= min_points) | ((F.col("n_gfw") > 0) & (F.col("n") >= 2)))
    return attributes.withColumn("problem", F.coalesce(identity_problem(F.col("mmsi")), F.when(short, "short track")))


def overlaps(start: Column, stop: Column, t0, t1) -> Column:  # noqa: ANN001
    """Closed spans that have an instant in common."""
    return ~((stop < t0) | (start > t1))


def silences_over(gapped: DataFrame, t0, t1) -> DataFrame:  # noqa: ANN001
    """Silences that overlap a window strictly: a silence that ends as the window begins does not."""
    return gapped.where((F.col("ts") < t1) & (F.col("next_ts") > t0))


def longest_silence(positions: DataFrame, t0, t1) -> DataFrame:  # noqa: ANN001
    """(mmsi, max_gap_min, window_gap_min): longest silence, and longest that overlaps the window; to a decimal, 0 for none."""
    inside = (F.col("ts") < t1) & (F.col("next_ts") > t0)
    longest = lambda gap: F.coalesce(F.bround(F.max(gap), 1), F.lit(0.0))
    return with_gaps(positions).groupBy("mmsi").agg(longest(F.col("gap_min")).alias("max_gap_min"), longest(F.when(inside, F.col("gap_min"))).alias("window_gap_min"))


def underway_median(positions: DataFrame, least: int = 3) -> DataFrame:
    """(mmsi, underway_median): median speed while under way, null for fewer than three such fixes."""
    moving = F.when(F.col("sog") >= UNDERWAY_KNOTS, F.col("sog"))
    return positions.groupBy("mmsi").agg(F.when(F.count(moving) >= least, F.median(moving)).alias("underway_median"))


def ceiling_min(caller: Column | float, dense: float = DENSE_CEILING_MIN, hourly: float = HOURLY_CEILING_MIN) -> Column:
    """Minutes that an interval may span: the caller's, and by its ends' sources; unlabelled ends add no bound."""
    caller = caller if isinstance(caller, Column) else F.lit(float(caller))
    both = (F.col("source") == "noaa") & (F.col("next_source") == "noaa")
    labelled = F.col("source").isNotNull() & F.col("next_source").isNotNull()
    return F.when(labelled, F.least(caller, F.when(both, dense).otherwise(hourly))).otherwise(caller)


def positions_at(positions: DataFrame, instants: DataFrame, max_gap_min: float = DENSE_CEILING_MIN, regimes: bool = True, dense: float = DENSE_CEILING_MIN, hourly: float = HOURLY_CEILING_MIN) -> DataFrame:
    """Positions (mmsi, at, lon, lat, exact) of vessels at instants (mmsi, at); rows only where there is one.

    A fix at the instant is the position; else the straight line between the fixes around it, if they
    are no further apart than the ceiling. Instants and fixes are merged in one ordered window by
    vessel, which costs a sort instead of comparing each instant with each interval.
    """
    fix = positions.select("mmsi", "ts", F.lit(None).cast("timestamp").alias("at"), F.struct("ts", "lon", "lat", "source").alias("fix"))
    ask = instants.select("mmsi", F.col("at").alias("ts"), "at", F.lit(None).cast(fix.schema["fix"].dataType).alias("fix"))
    order = Window.partitionBy("mmsi").orderBy("ts", F.col("at").isNotNull())
    back = F.last("fix", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("fix", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = fix.union(ask).select("mmsi", "at", back.alias("a"), ahead.alias("b")).where("at is not null and a is not null")
    span = minutes_between(F.col("a.ts"), F.col("b.ts"))
    exact = F.col("a.ts") == F.col("at")
    both = both.select("mmsi", "at", "a", "b", F.col("a.source").alias("source"), F.col("b.source").alias("next_source"))
    most = ceiling_min(max_gap_min, dense, hourly) if regimes else F.lit(float(max_gap_min))
    share = (F.unix_micros("at") - F.unix_micros("a.ts")) / F.nullif(F.unix_micros("b.ts") - F.unix_micros("a.ts"), F.lit(0))
    line = lambda c: F.when(exact, F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + share * (F.col(f"b.{c}") - F.col(f"a.{c}")))
    return both.where(exact | (span <= most)).select("mmsi", "at", line("lon").alias("lon"), line("lat").alias("lat"), exact.alias("exact"))


def walk_instants(spans: DataFrame, seconds: int = 60) -> DataFrame:
    """(mmsi, at): instants at a fixed cadence inside (mmsi, walk_from, walk_to), the first one step after walk_from."""
    step = F.expr(f"make_dt_interval(0, 0, 0, {seconds})")
    n = F.floor((F.unix_micros("walk_to") - F.unix_micros("walk_from")) / F.lit(seconds * 1e6))
    return spans.withColumn("n", n).where("n >= 1").select("mmsi", F.explode(F.sequence(F.col("walk_from") + step, F.col("walk_from") + F.make_dt_interval(secs=F.col("n") * float(seconds)), step)).alias("at"))


def nearest_fix(positions: DataFrame, instants: DataFrame) -> DataFrame:
    """(mmsi, at, ts, sog): the fix nearest in time to each instant, the earlier on a tie."""
    far = F.abs(F.unix_micros("ts") - F.unix_micros("at"))
    return positions.join(instants, "mmsi").groupBy("mmsi", "at").agg(F.min(F.struct(far.alias("far"), "ts", "sog")).alias("f")).select("mmsi", "at", "f.ts", "f.sog")


def last_outside(positions: DataFrame, approach: DataFrame, lon0: float, lat0: float, km: float) -> DataFrame:
    """(mmsi, ts, lon, lat, cog, source): last fix up to the approach (mmsi, at) that is at least km away from a point."""
    far = haversine_km("lon", "lat", lon0, lat0)
    kept = positions.join(approach, "mmsi").where((F.col("ts") <= F.col("at")) & (far >= km))
    return kept.groupBy("mmsi").agg(F.max(F.struct("ts", "lon", "lat", "cog", "source")).alias("f")).select("mmsi", "f.*")


def heard_inside(gaps: DataFrame, hourly: DataFrame) -> DataFrame:
    """(mmsi, heard): hourly rows strictly inside a silence (mmsi, gap_start, gap_end), vessels without any at 0."""
    rows = hourly.select(F.col("mmsi").alias("_m"), F.col("ts").alias("_t"))
    inside = (F.col("_m") == F.col("mmsi")) & (F.col("_t") > F.col("gap_start")) & (F.col("_t") < F.col("gap_end"))
    return gaps.join(rows, inside, "left").groupBy("mmsi").agg(F.count("_t").alias("heard"))


def decimate(positions: DataFrame, most: int = 500) -> DataFrame:
    """At most `most` fixes of each vessel, evenly by place, both ends kept."""
    order = Window.partitionBy("mmsi")
    df = positions.withColumn("_k", F.row_number().over(by_time()) - 1).withColumn("_n", F.count("*").over(order))
    # place k is kept if some j in 0..most-1 has round-half-even(j * (n-1) / (most-1)) = k
    j = F.floor(F.col("_k") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = F.lit(False)
    for d in (0, 1):
        hit = hit | (F.bround((j + d) * (F.col("_n") - 1) / F.lit(float(most - 1)), 0) == F.col("_k"))
    return df.where((F.col("_n") <= most) | hit).drop("_k", "_n")


def thin_by_cadence(positions: DataFrame, seconds: float) -> DataFrame:
    """Keep a fix if it is at least `seconds` after the last one kept; the first is kept.

    What is kept depends on what was kept before, which no window expresses. Fixes stream past in
    order of vessel and time, other columns breaking ties, and only the last kept instant is
    remembered, so a track of any length costs one batch. Fixes without a time are left out; those
    without a vessel are one track.
    """
    others = [c for c in positions.columns if c not in ("mmsi", "ts")]
    ordered = positions.where("ts is not null").select("mmsi", "ts", *others, F.unix_micros("ts").alias("_us"))
    ordered = ordered.repartition("mmsi").sortWithinPartitions("mmsi", "ts", *others)
    wait = max(int(-(-seconds * 1e6 // 1)), 0)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vessel, due = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            us = batch.column(batch.num_columns - 1).to_numpy()
            track = batch.column(0).dictionary_encode(null_encoding="encode")
            code = track.indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            kept = []
            for a, z in zip(starts, np.r_[starts[1:], len(us)], strict=True):
                name = track.dictionary[int(code[a])].as_py()
                at = a + np.searchsorted(us[a:z], due, "left") if due is not None and name == vessel else a
                while at < z:
                    kept.append(at)
                    due = int(us[at]) + wait
                    at = max(at + 1, a + np.searchsorted(us[a:z], due, "left"))
                vessel = name
            yield batch.take(pa.array(kept, pa.int64())).select(range(batch.num_columns - 1))

    return ordered.mapInArrow(thin, ordered.drop("_us").schema)


def clip_to_window(positions: DataFrame, t0, t1) -> DataFrame:  # noqa: ANN001
    """Fixes inside a closed window; of a vessel with fewer than two there, its first two fixes."""
    inside = F.col("ts").between(t0, t1)
    n = F.count_if(inside).over(Window.partitionBy("mmsi"))
    k = F.row_number().over(by_time())
    return positions.select("*", inside.alias("_in"), n.alias("_n"), k.alias("_k")).where(F.when(F.col("_n") >= 2, F.col("_in")).otherwise(F.col("_k") <= 2)).drop("_in", "_n", "_k")


def track_lines(positions: DataFrame) -> DataFrame:
    """(mmsi, line): fixes in time order as an array of [lon, lat] with five decimals."""
    fixes = F.array_sort(F.collect_list(F.struct("ts", "lon", "lat")))
    return positions.groupBy("mmsi").agg(F.transform(fixes, lambda p: F.array(F.bround(p["lon"], 5), F.bround(p["lat"], 5))).alias("line"))


def track_report(attributes: DataFrame) -> DataFrame:
    """One row: number and length of tracks, and the longest one's vessel."""
    return attributes.agg(F.count("*").alias("n_tracks"), F.min("n").alias("min_n"), F.median("n").alias("median_n"), F.max("n").alias("max_n"), F.max_by("mmsi", F.struct("n", "mmsi")).alias("longest"))
