"""Scoring of candidate vessels against an origin: components, gates, ranking and confidence.

Components are long rows (case_id, mmsi, component, value, note, source_gated). A null value means
'not applicable' and never counts as zero. All cases run in one plan, keyed by case_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the six live components, before division by their sum of 0.85.
WEIGHTS = {"proximity": 0.30, "temporality": 0.15, "trajectory": 0.15, "gap": 0.15, "slowdown": 0.05, "type_prior": 0.05}
WEIGHT_SUM = 0.85
COMPONENTS = (*WEIGHTS, "parity")
TYPE_PRIOR = {"tanker": 1.0, "cargo": 1.0, "fishing": 0.4, "passenger": 0.2, "other": 0.5}
PLAUSIBLE_MIN, CONE_DEG, GAP_MIN, UNDERWAY, SLOWDOWN = 0.05, 60.0, 30.0, 2.0, 0.40
EDGE_DEG = 0.02
CLEAR, WEAK, SCORE_FLOOR, CROWDED, THIN = 0.10, 0.03, 0.25, 40, 0.40
TOP, MOST_EXCLUSIONS = 3, 3
CONSTANT_GATED = ("type_prior", "trajectory")
SOURCE_GATED = ("gap", "slowdown", "trajectory")


def weight(component: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for k, w in WEIGHTS.items() for x in (k, w / WEIGHT_SUM)))
    return F.coalesce(F.try_element_at(pairs, component), F.lit(0.0))


def hourly_only(n_noaa: Column, n_gfw: Column, case_source: Column) -> Column:
    """What the vessel's own rows say first; the case's source where they say nothing."""
    return F.when(n_noaa + n_gfw > 0, n_noaa == 0).otherwise(case_source == "gfw_hourly")


def type_prior(vessel_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in TYPE_PRIOR.items() for x in kv))
    return F.coalesce(F.try_element_at(table, vessel_type), F.lit(0.5))


def proximity(samples: DataFrame) -> DataFrame:
    """(case_id, mmsi, value, at, lon, lat): the largest grid value that a vessel touched, and where.

    samples: (case_id, mmsi, at, lon, lat, p, walked), reports before the walk between them. The
    first largest wins, reports first. A vessel that only touched zero has no row.
    """
    order = F.struct("p", (-F.col("walked").cast("int")).alias("w"), (-F.unix_micros("at")).alias("t"))
    best = samples.where("p > 0").groupBy("case_id", "mmsi").agg(F.max_by(F.struct("p", "at", "lon", "lat"), order).alias("b"))
    return best.select("case_id", "mmsi", F.col("b.p").alias("value"), "b.at", "b.lon", "b.lat")


def trajectory(outside: Column, cog: Column, off_deg: Column, from_hourly: Column) -> tuple[Column, Column]:
    """(value, source_gated): 1 within 60 degrees of the bearing to the origin, null without a fix outside or a course."""
    value = F.when(outside & cog.isNotNull(), F.when(off_deg <= CONE_DEG, 1.0).otherwise(0.0))
    return value, outside & cog.isNull() & from_hourly


def gap(hourly: Column, minutes: Column, sog_a: Column, sog_b: Column, bounded_by_hourly: Column, on_edge: Column, heard: Column, gap_min: float = GAP_MIN) -> tuple[Column, Column, Column]:
    """(value, source_gated, why): the exits of the silence test in their order; minutes null for no silence."""
    unknown = sog_a.isNull() | sog_b.isNull()
    moored = unknown | (sog_a < UNDERWAY) | (sog_b < UNDERWAY)
    why = (
        F.when(hourly, "hourly record only").when(minutes.isNull(), "continuous coverage").when(bounded_by_hourly & unknown, "bounded by an hourly row").when(moored, "not under way")
        .when(on_edge, "at the edge of the search box").when(heard > 0, "heard by the other source").when(minutes >= gap_min, "silence").otherwise("short silence")
    )
    value = F.when(why == "silence", 1.0).when(why.isin("continuous coverage", "short silence"), 0.0)
    return value, why.isin("hourly record only", "bounded by an hourly row", "heard by the other source"), why


def slowdown(hourly: Column, sog: Column, underway_median: Column) -> tuple[Column, Column]:
    """(value, source_gated): 1 if the speed at closest approach is at most 0.6 of the under-way median."""
    value = F.when(~hourly & sog.isNotNull() & underway_median.isNotNull(), F.when(sog <= underway_median * (1 - SLOWDOWN), 1.0).otherwise(0.0))
    return value, hourly


def temporality(method: Column, at: Column, t0: Column, t1: Column) -> Column:
    """Closeness to the middle of a measured window; a search bracket measures nothing."""
    half = F.greatest((F.unix_micros(t1) - F.unix_micros(t0)) / 2e6, F.lit(1.0))
    off = F.abs(F.unix_micros(at) - (F.unix_micros(t0) + F.unix_micros(t1)) / 2) / 1e6
    return F.when(method.isin("convergence", "age"), F.greatest(F.lit(0.0), 1 - off / half))


def on_edge(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Within 0.02 degrees of a side of the box that the extract itself spans."""
    return F.least(F.abs(lon - west), F.abs(lon - east), F.abs(lat - south), F.abs(lat - north)) <= EDGE_DEG


def weighted_scores(components: DataFrame) -> DataFrame:
    """(case_id, mmsi, score, weight_live, n_applicable): mean over what could be measured, its weights renormalised."""
    w = F.when(F.col("value").isNotNull(), weight(F.col("component")))
    total = F.sum(w * F.col("value")) / F.nullif(F.sum(w), F.lit(0.0))
    return components.groupBy("case_id", "mmsi").agg(
        F.bround(F.coalesce(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), 3).alias("score"),
        F.bround(F.coalesce(F.sum(w), F.lit(0.0)), 3).alias("weight_live"), F.count("value").alias("n_applicable"),
    )


def _gate(components: DataFrame, found: DataFrame, note: Column) -> DataFrame:
    """Null the components (case_id, component) that are found, and say what was measured."""
    of = found.groupBy(F.col("case_id").alias("_case")).agg(F.collect_set("component").alias("_gated"))
    joined = components.join(F.broadcast(of), F.col("case_id") == F.col("_case"), "left")  # a row for each case with a gate at most
    hit = F.coalesce(F.array_contains("_gated", F.col("component")), F.lit(False))
    return joined.withColumn("note", F.when(hit, note).otherwise(F.col("note"))).withColumn("value", F.when(~hit, F.col("value"))).select(*components.columns)


def gate_constants(components: DataFrame, names: tuple[str, ...] = CONSTANT_GATED) -> DataFrame:
    """A component with one value for all of two or more candidates of a case separates nobody."""
    found = components.where(F.col("component").isin(*names)).groupBy("case_id", "component").agg(
        F.count("*").alias("n"), F.count("value").alias("m"), F.min(F.bround("value", 6)).alias("lo"), F.max(F.bround("value", 6)).alias("hi")
    )
    found = found.where("n >= 2 and m = n and lo = hi").select("case_id", "component", F.lit(True).alias("gated"))
    return _gate(components, found, F.concat(F.lit("every candidate scores "), F.col("value").cast("string"), F.lit(" here, so it is not counted")))


def gate_sources(components: DataFrame, names: tuple[str, ...] = SOURCE_GATED) -> DataFrame:
    """A component that some candidates could not be tested on, for how they were observed, counts for none."""
    found = components.where(F.col("component").isin(*names)).groupBy("case_id", "component").agg(
        F.count("*").alias("n"), F.count("value").alias("m"), F.bool_or(F.col("value").isNull() & F.coalesce("source_gated", F.lit(False))).alias("by_source")
    )
    found = found.where("n >= 2 and m > 0 and m < n and by_source").select("case_id", "component", F.lit(True).alias("gated"))
    said = F.when(F.col("value").isNotNull(), F.concat(F.lit("measured "), F.col("value").cast("string"), F.lit(", not counted"))).otherwise("not measurable, not counted")
    return _gate(components, found, said)


def rank(scored: DataFrame) -> DataFrame:
    """Total order of a case's candidates: score, live weight, evidence, grid value, distance, identity."""
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), F.desc("weight_live"), F.desc("n_applicable"), F.desc("grid_probability"), F.asc_nulls_last("closest_km"), "mmsi")
    return scored.withColumn("rank", F.row_number().over(order))


def score_candidates(components: DataFrame, facts: DataFrame) -> DataFrame:
    """Gates, then scores, then ranks: facts (case_id, mmsi, grid_probability, closest_km) of plausible vessels."""
    gated = gate_sources(gate_constants(components))
    return rank(weighted_scores(gated).join(facts, ["case_id", "mmsi"]))


def confidence(ranked: DataFrame, components: DataFrame, top: int = TOP) -> DataFrame:
    """(case_id, level, separation, weight_live, basis): how well a finished ranking separates."""
    n = ranked.groupBy(F.col("case_id").alias("_case")).agg(F.count("*").alias("n"))
    second = ranked.where("rank = 2").select(F.col("case_id").alias("_second"), F.col("score").alias("s1"))
    first = ranked.where("rank = 1").join(second, F.col("case_id").eqNullSafe(F.col("_second")), "left").join(n, F.col("case_id").eqNullSafe(F.col("_case"))).drop("_second", "_case")
    named = components.join(ranked.where(F.col("rank") <= top).select("case_id", "mmsi"), ["case_id", "mmsi"])
    shared = named.groupBy("case_id", "component").agg(F.count("*").alias("n"), F.count("value").alias("m")).where("n = m")
    basis = shared.groupBy("case_id").agg(F.array_sort(F.collect_list("component")).alias("basis"))
    sep = (F.col("score") - F.col("s1")) / F.greatest(F.col("score"), F.lit(1e-9))
    level = (
        F.when(F.col("n") > CROWDED, "indicative")
        .when((F.col("sep") < WEAK) | (F.col("weight_live") < THIN) | (F.col("score") < SCORE_FLOOR), "low")
        .when(F.col("sep") < CLEAR, "moderate").otherwise("high")
    )
    out = first.withColumn("sep", sep).withColumn("level", level).join(basis, "case_id", "left")
    return out.select("case_id", "level", F.bround("sep", 4).alias("separation"), "weight_live", F.coalesce("basis", F.array().cast("array<string>")).alias("basis"))


def funnel(vessels: DataFrame, top: int = TOP) -> DataFrame:
    """Counts of a case's vessels by how far they came: (case_id, mmsi, problem, in_window, grid_probability)."""
    kept = F.col("problem").isNull()
    plausible = kept & F.col("in_window") & (F.coalesce("grid_probability", F.lit(0.0)) > PLAUSIBLE_MIN)
    return vessels.groupBy("case_id").agg(
        F.count_if(kept).alias("in_region"), F.count_if(kept & F.col("in_window")).alias("in_window"), F.count_if(plausible).alias("plausible"), F.least(F.count_if(plausible), F.lit(top)).alias("scored"),
        F.count_if(F.col("problem") == "short track").alias("dropped_short_track"), F.count_if(F.col("problem").isNotNull() & (F.col("problem") != "short track")).alias("dropped_non_vessel"),
    )


def abstention(cases: DataFrame) -> DataFrame:
    """(case_id, abstained, why): cases carry has_ais, n_rows, origin_abstain and plausible."""
    why = (
        F.when(~F.col("has_ais"), "no archive covers this region").when(F.col("n_rows") == 0, "searched and found empty")
        .when(F.col("origin_abstain"), "the origin is too diffuse").when(F.col("plausible") == 0, "no vessel entered the origin")
    )
    return cases.select("case_id", why.isNotNull().alias("abstained"), why.alias("why"))


def exclusion_reason(p: Column, trajectory_: Column, gap_: Column) -> Column:
    """Why a candidate can be ruled out, null where nothing says so."""
    return (
        F.when(trajectory_ == 0, "heading away from the origin").when((gap_ == 0) & (p < 0.3), F.format_string("peak grid probability %.2f, broadcast throughout", p))
        .when(p < 0.15, F.format_string("peak grid probability %.2f", p))
    )


def reasons(p: Column, gap_: Column, gap_minutes: Column, trajectory_: Column, vessel_type: Column, slowdown_: Column, truncated: Column) -> Column:
    """Up to four short statements of what was measured."""
    said = F.array_compact(F.array(
        F.when(p >= 0.6, "inside the likely origin during the window").when(p >= PLAUSIBLE_MIN, "at the edge of the origin during the window"),
        F.when(gap_ > 0, F.format_string("%.0f-minute silence over the window", gap_minutes)), F.when(trajectory_ > 0, F.concat(vessel_type, F.lit(" on a course to the origin"))),
        F.when(slowdown_ > 0, "slowed down at closest approach"), F.when(truncated, "track cut at the search boundary"),
    ))
    return F.when(F.size(said) == 0, F.array(F.lit("present during the window; nothing scored"))).otherwise(F.slice(said, 1, 4))


def exclusions(ranked_out: DataFrame, near_miss: DataFrame, silent: DataFrame, most: int = MOST_EXCLUSIONS) -> DataFrame:
    """The first few excluded vessels of a case: ranked out, then near misses, then silent ones, each in its order.

    Each input has (case_id, mmsi, ord, reason); rows without a reason are not listed.
    """
    every = None
    for k, df in enumerate((ranked_out, near_miss, silent)):
        part = df.where("reason is not null and reason <> ''").select("case_id", "mmsi", F.lit(k).alias("prio"), F.col("ord").cast("double").alias("ord"), "reason")
        every = part if every is None else every.union(part)
    k = F.row_number().over(Window.partitionBy("case_id").orderBy("prio", F.asc_nulls_last("ord"), "mmsi"))
    return every.withColumn("ord", k).where(F.col("ord") <= most).select("case_id", "ord", "mmsi", "reason")
