"""Contract checks: tables of a case to rows (case_id, rule, severity, place, detail), none when all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import likely_swapped, ring_area_km2

# What enumerated columns may hold.
ENUMS = {
    "case_type": ("spill", "lookalike", "nospill"), "provenance": ("satellite", "benchmark"), "ais_source": ("noaa_dense", "gfw_hourly"), "classification": ("oil", "lookalike"),
    "shape_class": ("linear", "blob"), "discharge_class": ("chronic", "acute", "unknown"), "time_window_method": ("bounded", "convergence", "age"), "age_weathering": ("fresh", "weathered", "unknown"),
    "source_type": ("vessel", "dark_vessel", "infrastructure", "natural_seep"), "level": ("high", "moderate", "low", "indicative"), "verdict": ("hit", "partial", "miss", "not_applicable"),
    "vessel_type": ("tanker", "cargo", "fishing", "passenger", "other"),
}
ACTS = ("detect", "trace", "attribute", "verify")


def violations(df: DataFrame, rules: list[tuple[str, Column, Column]], severity: str = "ERROR") -> DataFrame:
    """rules: (name, holds, place). A rule is broken where it is false; null can't be judged and passes."""
    said = F.array(*(F.when(~holds, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), place.cast("string").alias("place"))) for name, holds, place in rules))
    return df.select("case_id", F.explode(F.array_compact(said)).alias("v")).select("case_id", "v.*")


def one_of(column: str) -> Column:
    return F.col(column).isin(*ENUMS[column])


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts)


def check_meta(meta: DataFrame) -> DataFrame:
    """Required keys, enumerations, and acts that depend on one another."""
    here = F.col("case_id")
    needs = lambda a, b: ~F.array_contains("acts_available", a) | F.array_contains("acts_available", b)
    return violations(meta, [
        ("meta.t0", F.col("t0").isNotNull(), here), ("meta.case_type", F.coalesce(one_of("case_type"), F.lit(False)), F.col("case_type")), ("meta.provenance", F.coalesce(one_of("provenance"), F.lit(False)), F.col("provenance")),
        ("meta.acts", F.forall("acts_available", lambda a: a.isin(*ACTS)), F.array_join("acts_available", ",")), ("meta.trace_needs_detect", needs("trace", "detect"), here),
        ("meta.attribute_needs_trace", needs("attribute", "trace"), here), ("meta.ais_source", ~F.array_contains("acts_available", "attribute") | F.coalesce(one_of("ais_source"), F.lit(False)), F.col("ais_source")),
    ])


def check_bounds(bounds: DataFrame) -> DataFrame:
    here = F.col("case_id")
    return violations(bounds, [
        ("bounds.lon_order", F.col("west") < F.col("east"), here), ("bounds.lat_order", F.col("south") < F.col("north"), here), ("bounds.lon_range", F.col("west").between(-180, 180) & F.col("east").between(-180, 180), here),
        ("bounds.lat_range", F.col("south").between(-90, 90) & F.col("north").between(-90, 90), here), ("bounds.size", (F.col("width_px") > 0) & (F.col("height_px") > 0), here),
    ])


def check_detections(detections: DataFrame, bounds: DataFrame) -> DataFrame:
    """Ranges, enumerations, shape against elongation, area against the ring's, coordinates in the box or swapped."""
    d = detections.join(bounds.select("case_id", "west", "south", "east", "north"), "case_id").withColumn("ring_km2", ring_area_km2(F.col("ring")))
    here = F.col("id")
    corner = lambda p: (p["lon"], p["lat"], F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    return violations(d, [
        ("detections.classification", F.coalesce(one_of("classification"), F.lit(False)), here), ("detections.confidence", F.col("confidence").between(0, 1), here), ("detections.area", F.col("area_km2") > 0, here),
        ("detections.shape_class", F.coalesce(one_of("shape_class"), F.lit(False)), here), ("detections.discharge_class", F.col("discharge_class").isNull() | one_of("discharge_class"), here),
        ("detections.linear_is_long", (F.col("shape_class") != "linear") | (F.col("elongation") >= 2.5), here), ("detections.ring_area", F.col("area_km2").between(F.col("ring_km2") / 2, F.col("ring_km2") * 2), here),
        ("detections.inside", F.forall("ring", lambda p: p["lon"].between(F.col("west") - 0.01, F.col("east") + 0.01) & p["lat"].between(F.col("south") - 0.01, F.col("north") + 0.01)), here),
        ("detections.swapped", ~F.exists("ring", lambda p: likely_swapped(*corner(p))), here),
    ])


def check_contacts(ships: DataFrame) -> DataFrame:
    here = F.col("contact_id")
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return violations(ships, [("contacts.finite", fine("lon") & fine("lat"), here), ("contacts.px_area", F.col("px_area") > 0, here)])


def check_particles(particles: DataFrame, meta: DataFrame, minutes: float) -> DataFrame:
    """A constant number of particles, a span of 6 to 72 hours, and speeds that water can have."""
    from ..functions.geo import displacement_km

    n = particles.groupBy("case_id", "member", "step").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("step").alias("last"))
    n = meta.select("case_id").join(n, "case_id")
    hours = F.col("last") * minutes / 60.0
    counts = violations(n, [("particles.constant_number", F.col("lo") == F.col("hi"), F.col("hi")), ("particles.span", hours.between(6, 72), hours)])
    w = Window.partitionBy("case_id", "member", "pid").orderBy("step")
    hop = particles.withColumn("x0", F.lag("lon").over(w)).withColumn("y0", F.lag("lat").over(w)).withColumn("k", F.col("step") - F.lag("step").over(w)).where("x0 is not null")
    fast = hop.withColumn("ms", displacement_km("x0", "y0", "lon", "lat") * 1000 / (F.col("k") * minutes * 60)).groupBy("case_id").agg(F.max("ms").alias("ms"))
    return counts.union(violations(fast, [("particles.speed", F.col("ms") <= 3.0, F.bround("ms", 3))]))


def check_forward(impact: DataFrame, curve: DataFrame) -> DataFrame:
    """Radii in order, stranding that never falls, and landfall null exactly where nothing came ashore."""
    here = F.col("case_id")
    rules = violations(impact, [
        ("forward.radii", F.col("radius_90_km") >= F.col("radius_50_km"), here),
        ("forward.landfall_null", (F.col("stranded_fraction") > 0) == F.col("landfall_h").isNotNull(), here),
    ])
    before = F.lag("fraction").over(Window.partitionBy("case_id").orderBy("hour"))
    return rules.union(violations(curve.withColumn("before", before), [("forward.monotone", F.col("before").isNull() | (F.col("fraction") >= F.col("before")), F.col("hour"))]))


def check_origin(heads: DataFrame, cells: DataFrame) -> DataFrame:
    """Shape, sign and peak of the grid; order of window and radii; abstention beyond 40 km."""
    g = cells.groupBy("case_id").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    here = F.col("case_id")
    return violations(heads.join(g, "case_id", "left"), [
        ("origin.shape", F.coalesce("n", F.lit(0)) == F.col("rows") * F.col("cols"), here), ("origin.sign", F.col("lo") >= 0, here), ("origin.peak", F.abs(F.col("hi") - 1) <= 0.01, here), ("origin.window", F.col("window_start") < F.col("window_end"), here),
        ("origin.radii", F.col("radius_50_km") <= F.col("radius_90_km"), here), ("origin.abstain", F.col("abstain") == (F.col("radius_90_km") > 40), here), ("origin.method", F.coalesce(one_of("time_window_method"), F.lit(False)), here),
    ])


def check_posterior(post: DataFrame, bands: DataFrame) -> DataFrame:
    """An ascending grid, a sum of one, and a band and median inside the grid."""
    step = F.col("age_h") - F.lag("age_h").over(Window.partitionBy("case_id").orderBy("ord"))
    g = post.withColumn("step", step).groupBy("case_id").agg(F.sum("prob").alias("total"), F.min("step").alias("least"), F.min("age_h").alias("a"), F.max("age_h").alias("z"), F.min("prob").alias("lo"))
    here = F.col("case_id")
    return violations(g.join(bands, "case_id", "left"), [
        ("posterior.sum", F.abs(F.col("total") - 1) <= 1e-3, F.bround("total", 6)), ("posterior.ascending", F.col("least") > 0, here), ("posterior.sign", F.col("lo") >= 0, here),
        ("posterior.band", (F.col("lo_h") <= F.col("hi_h")) & (F.col("lo_h") >= 0) & (F.col("hi_h") <= F.col("z") + 0.25), here), ("posterior.median", F.col("median_h").between(F.col("a"), F.col("z")), here),
    ])


def check_tracks(lines: DataFrame) -> DataFrame:
    return violations(lines, [("vessels.points", F.size("line").between(2, 800), F.col("mmsi"))])


def check_suspects(suspects: DataFrame, funnels: DataFrame, tracks: DataFrame) -> DataFrame:
    """Scores and their order, ranks without holes, referential integrity, and a funnel that narrows."""
    w = Window.partitionBy("case_id").orderBy("rank")
    s = suspects.withColumn("before", F.lag("score").over(w)).withColumn("k", F.row_number().over(w))
    here = F.col("mmsi")
    ranks = violations(s, [("suspects.score_range", F.col("score").between(0, 1), here), ("suspects.sorted", F.col("before").isNull() | (F.col("before") >= F.col("score")), here), ("suspects.ranks", F.col("rank") == F.col("k"), here), ("suspects.live", F.col("weight_live").between(0, 1.0001), here)])
    lost = suspects.join(tracks.select("case_id", "mmsi").distinct(), ["case_id", "mmsi"], "left_anti").select("case_id", F.lit("suspects.track").alias("rule"), F.lit("ERROR").alias("severity"), F.col("mmsi").alias("place"))
    n = suspects.groupBy("case_id").agg(F.count("*").alias("n"))
    f = funnels.join(n, "case_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    narrow = (F.col("in_region") >= F.col("in_window")) & (F.col("in_window") >= F.col("plausible")) & (F.col("plausible") >= F.col("scored"))
    return together(ranks, lost, violations(f, [("suspects.funnel", narrow, F.col("case_id")), ("suspects.scored", F.col("scored") == F.col("n"), F.col("n"))]))


def check_verification(verification: DataFrame, suspects: DataFrame) -> DataFrame:
    """A verdict, a source, and no vessel claimed as ours that the ranking doesn't name."""
    rules = violations(verification, [("verification.verdict", F.coalesce(one_of("verdict"), F.lit(False)), F.col("verdict")), ("verification.source", F.coalesce(F.col("source_url").rlike("^https?://"), F.lit(False)), F.col("source_url"))])
    claimed = verification.select("case_id", F.explode("claimed_mmsi").alias("mmsi"))
    lost = claimed.join(suspects.select("case_id", "mmsi"), ["case_id", "mmsi"], "left_anti")
    return rules.union(lost.select("case_id", F.lit("verification.claimed").alias("rule"), F.lit("ERROR").alias("severity"), F.col("mmsi").alias("place")))


def check_index(index: DataFrame, meta: DataFrame) -> DataFrame:
    """Listed cases exist, once each, and there is one default, which is listed."""
    lost = index.join(meta.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("index.exists").alias("rule"), F.lit("ERROR").alias("severity"), F.lit(None).cast("string").alias("place"))
    n = index.groupBy("case_id").agg(F.count("*").alias("n"))
    one = index.agg(F.count_if("is_default").alias("n")).where("n <> 1").select(F.lit("").alias("case_id"), F.lit("index.default").alias("rule"), F.lit("ERROR").alias("severity"), F.col("n").cast("string").alias("place"))
    return together(lost, violations(n, [("index.once", F.col("n") == 1, F.col("n"))]), one)
