"""The whole attribution of a case as one plan: positions and an origin in, ranked suspects out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import angle_between_deg, bearing_deg, haversine_km
from ..operators import grid as G
from ..operators import score, tracks


def suspects(positions: DataFrame, cells: DataFrame, head: dict, t0: Column, t1: Column, min_points: int = 10, with_gap: bool = True, walk_seconds: int | None = 60, gap_min: float = score.GAP_MIN, dense_min: float = tracks.DENSE_CEILING_MIN, hourly_min: float = tracks.HOURLY_CEILING_MIN) -> DataFrame:
    """(case_id, mmsi, score, weight_live, n_applicable, grid_probability, closest_km, rank).

    positions: one case's positions (mmsi, ts, lon, lat, sog, cog, source, vessel_type). head: the
    grid's box and shape with case_id, clon, clat, radius_90_km and method. Vessels are cut down by
    the cheap test of presence in the window before tracks are walked and scored.
    dense_min and hourly_min are the longest minutes between reports that a track is walked over.
    """
    inside = F.col("ts").between(t0, t1)
    attributes = tracks.track_attributes(positions.withColumn("name", F.lit(None).cast("string")).withColumn("type_code", F.lit(None).cast("int")))
    usable = tracks.usable_tracks(attributes, min_points).where("problem is null or problem = 'no country code'").where(F.col("n") >= min_points)
    usable = usable.where(tracks.overlaps(F.col("start_ts"), F.col("end_ts"), t0, t1))
    own = positions.join(usable.select("mmsi", "n_noaa", "n_gfw"), "mmsi")
    points = own.where(inside).select("mmsi", F.col("ts").alias("at"), "lon", "lat", F.lit(False).alias("walked"))
    if walk_seconds:
        spans = usable.select("mmsi", F.greatest("start_ts", t0).alias("walk_from"), F.least("end_ts", t1).alias("walk_to"))
        walked = tracks.positions_at(own, tracks.walk_instants(spans, walk_seconds), dense_min, dense=dense_min, hourly=hourly_min)
        points = points.union(walked.select("mmsi", "at", "lon", "lat", F.lit(True)))
    sampled = G.sample(points, cells, head).withColumn("case_id", F.lit(head["case_id"]))
    best = score.proximity(sampled).where(F.col("value") > score.PLAUSIBLE_MIN)
    facts = best.join(attributes.select("mmsi", "vessel_type", "n_noaa", "n_gfw"), "mmsi")
    out = tracks.last_outside(own, best.select("mmsi", "at"), head["clon"], head["clat"], head["radius_90_km"])
    off = angle_between_deg("cog", bearing_deg("lon", "lat", head["clon"], head["clat"]))
    out = out.select("mmsi", "cog", off.alias("off"), (F.col("source") == "gfw").alias("from_hourly"), F.lit(True).alias("outside"))
    slow = tracks.nearest_fix(own, best.select("mmsi", "at")).select("mmsi", "sog").join(tracks.underway_median(own), "mmsi")
    wide = facts.join(out, "mmsi", "left").join(slow, "mmsi", "left")
    hourly = score.hourly_only(F.col("n_noaa"), F.col("n_gfw"), F.lit("noaa_dense"))
    course, course_gated = score.trajectory(F.coalesce("outside", F.lit(False)), F.col("cog"), F.col("off"), F.coalesce("from_hourly", F.lit(False)))
    slowed, slow_gated = score.slowdown(hourly, F.col("sog"), F.col("underway_median"))
    parts = [
        ("proximity", F.col("value"), F.lit(False)), ("temporality", score.temporality(F.lit(head["method"]), F.col("at"), t0, t1), F.lit(False)), ("trajectory", course, course_gated),
        ("slowdown", slowed, slow_gated), ("type_prior", score.type_prior(F.col("vessel_type")), F.lit(False)), ("parity", F.lit(None).cast("double"), F.lit(False)),
    ]
    if with_gap:
        gapped = tracks.silences_over(tracks.with_gaps(own), t0, t1)
        big = gapped.groupBy("mmsi").agg(F.max_by(F.struct("gap_min", "ts", "next_ts", "sog", "next_sog", "lon", "lat", "source", "next_source"), F.struct("gap_min", (-F.unix_micros("ts")).alias("t"))).alias("g"))
        box = own.agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n_"))
        heard = tracks.heard_inside(big.select("mmsi", F.col("g.ts").alias("gap_start"), F.col("g.next_ts").alias("gap_end")), own.where("source = 'gfw'"))
        wide = wide.join(big, "mmsi", "left").join(heard, "mmsi", "left").crossJoin(F.broadcast(box))
        edge = score.on_edge(F.col("g.lon"), F.col("g.lat"), F.col("w"), F.col("s"), F.col("e"), F.col("n_"))
        bounded = F.coalesce((F.col("g.source") == "gfw") | (F.col("g.next_source") == "gfw"), F.lit(False))
        value, gated, _why = score.gap(hourly, F.col("g.gap_min"), F.col("g.sog"), F.col("g.next_sog"), bounded, F.coalesce(edge, F.lit(False)), F.coalesce("heard", F.lit(0)), gap_min)
        parts.append(("gap", value, gated))
    long = F.explode(F.array(*(F.struct(F.lit(name).alias("component"), value.alias("value"), gated.alias("source_gated")) for name, value, gated in parts)))
    components = wide.select("case_id", "mmsi", long.alias("c")).select("case_id", "mmsi", "c.*", F.lit("").alias("note"))
    peak_km = haversine_km("lon", "lat", head["clon"], head["clat"])
    return score.score_candidates(components, best.select("case_id", "mmsi", F.bround("value", 3).alias("grid_probability"), F.bround(peak_km, 2).alias("closest_km")))
