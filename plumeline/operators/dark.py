"""Radar contacts without a broadcast, and fixed structures, against the origin and the slick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_KNOT_HOUR, angle_between_deg, bearing_deg, haversine_km
from ..sources.staging import staged
from .nearest import nearest_vertex  # noqa: F401 - part of this module's interface

# Fixed values.
MATCH_KM, REACH_KNOTS, REACH_MIN, HEADROOM, LEAST_KNOTS, RELEVANT_KM, MOST_LISTED = 1.0, 25.0, 90.0, 1.5, 6.0, 5.0, 5
W_ORIGIN, W_TERMINUS, DECAY_KM, STRUCTURE_FLOOR, TERMINUS_SHARE = 0.6, 0.4, 2.0, 0.25, 0.75


def speed_bound(km: Column, hours: Column) -> Column:
    """Knots a vessel may go in the prism: half as fast again as its straight pace, 6 to 25; 25 where unknown."""
    pace = km / KM_PER_KNOT_HOUR / F.nullif(hours, F.lit(0.0))
    return F.when(pace.isNotNull(), F.least(F.lit(REACH_KNOTS), F.greatest(F.lit(LEAST_KNOTS), pace * HEADROOM))).otherwise(REACH_KNOTS)


def scene_fixes(positions: DataFrame, t0: Column, minutes: float = REACH_MIN) -> DataFrame:
    """(mmsi, a, b): a vessel's last fix up to the scene and first from it on, within reach in time, with its neighbours."""
    w = Window.partitionBy("mmsi").orderBy("ts")
    fix = F.struct("ts", "lon", "lat", F.lag("lon").over(w).alias("plon"), F.lag("lat").over(w).alias("plat"), F.lag("ts").over(w).alias("pts"), F.lead("lon").over(w).alias("nlon"), F.lead("lat").over(w).alias("nlat"), F.lead("ts").over(w).alias("nts"))
    near = positions.select("mmsi", "ts", fix.alias("f")).where(F.abs(F.unix_micros("ts") - F.unix_micros(t0)) <= minutes * 60e6)
    return near.groupBy("mmsi").agg(F.max(F.when(F.col("ts") <= t0, F.col("f"))).alias("a"), F.min(F.when(F.col("ts") >= t0, F.col("f"))).alias("b"))


def in_prism(lon: Column, lat: Column, t0: Column) -> Column:
    """Whether a contact lies where the vessel of (a, b) could have been at the scene; null with neither fix."""
    hours = lambda x, y: (F.unix_micros(y) - F.unix_micros(x)) / F.lit(3600e6)
    a, b = F.col("a"), F.col("b")
    two = a.isNotNull() & b.isNotNull() & (a["ts"] != b["ts"])
    span = hours(a["ts"], b["ts"])
    v = speed_bound(haversine_km(a["lon"], a["lat"], b["lon"], b["lat"]), span)
    both = haversine_km(a["lon"], a["lat"], lon, lat) + haversine_km(lon, lat, b["lon"], b["lat"]) <= v * KM_PER_KNOT_HOUR * span + 2 * MATCH_KM
    back = speed_bound(haversine_km(a["plon"], a["plat"], a["lon"], a["lat"]), hours(a["pts"], a["ts"]))
    ahead = speed_bound(haversine_km(b["lon"], b["lat"], b["nlon"], b["nlat"]), hours(b["ts"], b["nts"]))
    from_a = haversine_km(a["lon"], a["lat"], lon, lat) <= back * KM_PER_KNOT_HOUR * F.abs(hours(a["ts"], t0)) + MATCH_KM
    from_b = haversine_km(b["lon"], b["lat"], lon, lat) <= ahead * KM_PER_KNOT_HOUR * F.abs(hours(b["ts"], t0)) + MATCH_KM
    return F.when(two, both).when(a.isNotNull(), from_a).when(b.isNotNull(), from_b)


def match_contacts(contacts: DataFrame, placed: DataFrame, fixes: DataFrame, t0: Column, cell_deg: float = 1.0) -> DataFrame:
    """contacts (contact_id, lon, lat) with `matched`.

    placed: (mmsi, lon, lat) of vessels with a position at the scene; they match within 1 km and never
    fall through to the prism. Others match by their prism. Both joins are on cells of `cell_deg`
    degrees: a vessel is put in every cell that its reach touches, so that no pair is made between far
    things. Reach is bounded by 25 knots for 90 minutes. Contacts at one place are compared once.
    """
    key = lambda x, d: F.floor(x / d).cast("int")

    def cells(df: DataFrame, lon: Column, lat: Column, km: float) -> DataFrame:
        dy = km / 110.0
        dx = F.lit(km) / (110.0 * F.greatest(F.cos(F.radians(F.least(F.abs(lat) + dy, F.lit(89.0)))), F.lit(0.01)))
        return df.withColumn("cx", F.explode(F.sequence(key(lon - dx, cell_deg), key(lon + dx, cell_deg)))).withColumn("cy", F.explode(F.sequence(key(lat - dy, cell_deg), key(lat + dy, cell_deg))))

    place = ["lon", "lat"]
    at = contacts.select(*place).distinct().withColumn("cx", key(F.col("lon"), cell_deg)).withColumn("cy", key(F.col("lat"), cell_deg))
    near = cells(placed.select("mmsi", F.col("lon").alias("vlon"), F.col("lat").alias("vlat")), F.col("vlon"), F.col("vlat"), MATCH_KM)
    by_place = at.join(near, ["cx", "cy"]).where(haversine_km("lon", "lat", "vlon", "vlat") <= MATCH_KM).select(*place)
    rest = fixes.join(placed.select("mmsi"), "mmsi", "left_anti").where("a is not null or b is not null")
    rest = rest.repartition(rest.sparkSession.sparkContext.defaultParallelism, "mmsi")  # few bytes, much work: adaptive execution would put them in one task
    reach = cells(rest, F.coalesce(F.col("a.lon"), F.col("b.lon")), F.coalesce(F.col("a.lat"), F.col("b.lat")), REACH_KNOTS * KM_PER_KNOT_HOUR * 2 * REACH_MIN / 60 + 2 * MATCH_KM)
    by_prism = at.join(reach, ["cx", "cy"]).where(in_prism(F.col("lon"), F.col("lat"), t0)).select(*place)
    hit = by_place.union(by_prism).distinct()
    found = contacts.join(hit, place, "left_semi").select("contact_id").distinct().withColumn("matched", F.lit(True))
    return contacts.join(found, "contact_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def match_scene_contacts(contacts: DataFrame, placed: DataFrame, positions: DataFrame, minutes: float = REACH_MIN) -> DataFrame:
    """(contact_id, matched, n_vessels) of contacts (contact_id, lon, lat, t0) of any number of scenes, each at its own instant.

    placed: (mmsi, lon, lat, t0) of vessels with a position at a scene's instant; they match within 1 km
    and never by their prism at that instant. positions: (mmsi, ts, lon, lat). A vessel's track is laid out
    as stretches between neighbouring fixes; a stretch goes to the time buckets and cells that it can
    reach, its prism is found once for each instant there, and places of that instant are held against it. No scene meets all vessels.
    Of fixes at one instant the greatest by place counts. Contacts of one id are one; a null id is one
    too. What lacks a place, an instant or a vessel takes no part, but its contact is listed.
    """
    micros, cell = int(minutes * 60e6), 1.0
    bucket = lambda x: F.floor(x / F.lit(micros))
    column = lambda x: F.pmod(F.floor(x / cell), F.lit(int(360 / cell)))
    row = lambda y: F.floor(y / cell)
    code = lambda x, y: x * 1000 + y

    around = F.lit(int(360 / cell))

    def bounded(df: DataFrame, name: str, lon: Column, lat: Column, km: Column) -> DataFrame:
        """With the first and last cells within km; each step is a column, so that none is worked out again for each cell."""
        df = df.withColumn(f"{name}dy", km / 110.0)
        dy = F.col(f"{name}dy")
        df = df.withColumn(f"{name}dx", F.least(dy / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + dy, F.lit(89.9)))), F.lit(0.001)), F.lit(180.0)))
        dx = F.col(f"{name}dx")
        return df.withColumns({f"{name}x0": F.floor((lon - dx) / cell), f"{name}x1": F.floor((lon + dx) / cell), f"{name}y0": row(lat - dy), f"{name}y1": row(lat + dy)})

    def cells(name: str) -> Column:
        up = F.sequence(f"{name}y0", f"{name}y1")
        each = F.flatten(F.transform(F.sequence(f"{name}x0", f"{name}x1"), lambda x: F.transform(up, lambda y: code(F.pmod(x, around), y))))
        return F.coalesce(F.when(F.col(f"{name}dy").isNotNull(), F.array_distinct(each)), F.array().cast("array<bigint>"))

    place = ["lon", "lat", "t0"]
    own = contacts.where("lon is not null and lat is not null and t0 is not null").select("contact_id", *place).distinct()
    several = own.groupBy("contact_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("contact_id").alias("known"))
    shared = own.join(several, F.col("contact_id").eqNullSafe(F.col("known")), "left_semi").select(*place).distinct().withColumn("named", F.lit(True))
    at = own.select(*place).distinct().join(shared, place, "left").withColumns({"t": F.unix_micros("t0"), "named": F.coalesce("named", F.lit(False))})
    at = staged(at.withColumns({"cell": code(column(F.col("lon")), row(F.col("lat"))), "b_t": bucket(F.col("t"))}), "places")
    still = placed.where("mmsi is not null and t0 is not null").select("mmsi", F.col("lon").alias("vlon"), F.col("lat").alias("vlat"), F.unix_micros("t0").alias("t"))
    near = bounded(still, "v", F.col("vlon"), F.col("vlat"), F.lit(MATCH_KM)).withColumn("cell", F.explode(cells("v"))).select("mmsi", "vlon", "vlat", "t", "cell")
    by_place = at.join(near, ["t", "cell"]).where(haversine_km("lon", "lat", "vlon", "vlat") <= MATCH_KM).select(*place, "named", "mmsi").distinct()

    known = positions.where("mmsi is not null and ts is not null and lon is not null and lat is not null").select("mmsi", "ts", "lon", "lat")
    known = known.repartition(4 * known.sparkSession.sparkContext.defaultParallelism, "mmsi")  # few bytes, much work: adaptive execution would put them in few tasks
    fixes = known.groupBy("mmsi", "ts").agg(F.max(F.struct("lon", "lat")).alias("at")).select("mmsi", F.unix_micros("ts").alias("u"), "at.*")
    w = Window.partitionBy("mmsi").orderBy("u")
    track = fixes.withColumns({"nlon": F.lead("lon").over(w), "nlat": F.lead("lat").over(w), "nu": F.lead("u").over(w)})
    track = track.withColumn("ahead", speed_bound(haversine_km("lon", "lat", "nlon", "nlat"), (F.col("nu") - F.col("u")) / F.lit(3600e6)))
    track = track.withColumns({"back": F.coalesce(F.lag("ahead").over(w), F.lit(REACH_KNOTS)), "next_ahead": F.coalesce(F.lead("ahead").over(w), F.lit(REACH_KNOTS)), "first": F.lag("u").over(w).isNull()})
    # a stretch from a to b: the pace between them, that up to a and that from b on
    end = lambda name, u, lon, lat: [x.alias(f"{name}{k}") for k, x in (("", u), ("lon", lon), ("lat", lat))]
    u, lon, lat, none = F.col("u"), F.col("lon"), F.col("lat"), F.lit(None).cast("double")
    nothing = (F.lit(None).cast("long"), none, none)
    stretch = lambda a, b, v, back, ahead: F.struct(*end("a", *a), *end("b", *b), v.alias("v"), back.alias("back"), ahead.alias("ahead"))
    here, after = (u, lon, lat), (F.col("nu"), F.col("nlon"), F.col("nlat"))
    ways = F.array(stretch(here, here, none, F.col("back"), F.col("ahead")), stretch(here, after, F.col("ahead"), F.col("back"), F.col("next_ahead")), F.when(F.col("first"), stretch(nothing, here, none, none, F.col("ahead"))))
    s = track.select("mmsi", F.explode(F.filter(ways, lambda x: x.isNotNull())).alias("s")).select("mmsi", "s.*").withColumnsRenamed({"a": "ua", "b": "ub"})

    ua, ub, span = F.col("ua"), F.col("ub"), (F.col("ub") - F.col("ua")) / F.lit(3600e6)
    most = minutes / 60
    back, ahead = F.col("back") * KM_PER_KNOT_HOUR, F.col("ahead") * KM_PER_KNOT_HOUR
    alone = ua.isNull() | ub.isNull() | (span > most)
    both = F.when((span > 0) & (span <= 2 * most), F.col("v") * KM_PER_KNOT_HOUR * span + 2 * MATCH_KM)
    by_a = F.when(ua == ub, F.lit(MATCH_KM)).otherwise(F.greatest(both, F.when(alone & ua.isNotNull(), back * most + MATCH_KM)))
    by_b = F.when(alone & ub.isNotNull(), ahead * most + MATCH_KM)
    buckets = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.sequence(bucket(x), bucket(y)))
    empty = lambda x, kind: F.coalesce(x, F.array().cast(kind))
    since, until = buckets(ua, F.least(ua + micros, F.coalesce(ub, ua + micros))), buckets(F.greatest(ub - micros, F.coalesce(ua, ub - micros)), ub)
    timed = s.withColumn("b_t", F.explode(F.array_union(empty(since, "array<bigint>"), empty(until, "array<bigint>")))).join(F.broadcast(at.select("b_t").distinct()), "b_t", "left_semi")

    # what a vessel can reach at an instant is found once, then held against the instant's places
    t, from_a = F.col("t"), F.col("from_a")
    instants = staged(at.select("b_t", "cell", "t").distinct(), "instants")
    inside = F.when(ua == ub, t == ua).otherwise(F.coalesce(t > ua, F.lit(True)) & F.coalesce(t < ub, F.lit(True)))
    laid = bounded(bounded(timed.withColumns({"by_a": by_a, "by_b": by_b}), "of_a", F.col("alon"), F.col("alat"), F.col("by_a")), "of_b", F.col("blon"), F.col("blat"), F.col("by_b"))
    laid = laid.withColumn("cell", F.explode(F.array_union(cells("of_a"), cells("of_b")))).select("cell", "b_t", *s.columns)
    at_once = laid.join(instants, ["b_t", "cell"]).where(inside)
    at_once = at_once.withColumns({"from_a": F.coalesce(t - ua <= micros, F.lit(False)), "from_b": F.coalesce(ub - t <= micros, F.lit(False))}).where("from_a or from_b")
    two = from_a & F.col("from_b") & (ua != ub)
    km = F.when(two, F.col("v") * KM_PER_KNOT_HOUR * span + 2 * MATCH_KM).when(from_a, back * F.abs((t - ua) / F.lit(3600e6)) + MATCH_KM).otherwise(ahead * F.abs((t - ub) / F.lit(3600e6)) + MATCH_KM)
    end_at = lambda c: F.when(from_a, F.col(f"a{c}")).otherwise(F.col(f"b{c}")).alias(f"x{c}")
    reached = at_once.select("mmsi", "t", "cell", end_at("lon"), end_at("lat"), F.when(two, F.col("blon")).alias("ylon"), F.when(two, F.col("blat")).alias("ylat"), km.alias("km"))
    # no way leads past both ends of a stretch that is longer than the way; a hair is left for rounding
    reached = reached.where(F.col("ylon").isNull() | (haversine_km("xlon", "xlat", "ylon", "ylat") <= F.col("km") * (1 + 1e-9) + 1e-6))
    up = F.col("km") / 110.0
    reached = reached.join(still.select("mmsi", "t"), ["mmsi", "t"], "left_anti").withColumns({"up": up, "aside": up / F.greatest(F.cos(F.radians(F.least(F.abs("xlat") + up, F.lit(89.9)))), F.lit(0.001))})
    reached = staged(reached, "reached")  # the joins before and after it in one method would be too long to be compiled
    beside = (F.abs(F.col("lat") - F.col("xlat")) <= F.col("up")) & (F.abs(F.pmod(F.col("lon") - F.col("xlon") + 180, F.lit(360.0)) - 180) <= F.col("aside"))
    way = haversine_km("xlon", "xlat", "lon", "lat") + F.when(F.col("ylon").isNotNull(), haversine_km("lon", "lat", "ylon", "ylat")).otherwise(0.0)
    by_prism = at.join(reached, ["t", "cell"]).where(beside & (way <= F.col("km"))).select(*place, "named", "mmsi")
    # a vessel is at one stretch at an instant, so its pairs are told once; they are kept by name where a contact has several places and may have met it twice
    pairs = staged(by_place.union(by_prism).groupBy(*place, F.when(F.col("named"), F.col("mmsi")).alias("mmsi")).agg(F.count("*").alias("n")), "pairs")
    alone = own.join(several, F.col("contact_id").eqNullSafe(F.col("known")), "left_anti").join(pairs.groupBy(*place).agg(F.sum("n").alias("n")), place).select("contact_id", "n")
    again = own.join(several, F.col("contact_id").eqNullSafe(F.col("known")), "left_semi").join(pairs.where("mmsi is not null"), place).select("contact_id", "mmsi").distinct().groupBy("contact_id").agg(F.count("*").alias("n"))
    found = alone.union(again).select(F.col("contact_id").alias("known"), F.col("n").alias("n_vessels"))
    ids = contacts.select("contact_id").distinct()
    return ids.join(found, F.col("contact_id").eqNullSafe(F.col("known")), "left").select("contact_id", F.col("n_vessels").isNotNull().alias("matched"), F.coalesce("n_vessels", F.lit(0)).alias("n_vessels"))


def contact_scores(contacts: DataFrame, r90_km: Column) -> DataFrame:
    """Unmatched contacts that matter: (…, score, angular_deviation_deg), from p, near_km and the oil's centroid and axis."""
    radius = F.greatest(r90_km, F.lit(RELEVANT_KM))
    kept = contacts.where(~F.col("matched") & ((F.col("p") > 0) | (F.col("near_km") <= radius)))
    score = F.greatest("p", F.coalesce(1 - F.col("near_km") / radius, F.lit(0.0)))
    turn = angle_between_deg(F.pmod(bearing_deg("lon", "lat", "clon", "clat"), F.lit(180.0)), F.col("axis_deg"))
    return kept.withColumn("score", F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3)).withColumn("angular_deviation_deg", F.bround(F.least(turn, 180 - turn), 1))


def list_contacts(scored: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """The best few contacts of a case."""
    k = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "contact_id"))
    return scored.withColumn("place", k).where(F.col("place") <= most)


def own_contacts(ships: DataFrame, pixel_m: Column) -> DataFrame:
    """Contacts of our own detector; lengths are the side of their pixels' area."""
    return ships.select("case_id", "contact_id", "lon", "lat", F.bround(F.sqrt(F.nullif(F.col("px_area"), F.lit(0)).cast("double")) * pixel_m, 0).cast("int").alias("est_length_m"), F.lit(None).cast("string").alias("external"))


def external_contacts(contacts: DataFrame, label: str) -> DataFrame:
    return contacts.select("case_id", "contact_id", "lon", "lat", F.bround("length_m", 0).cast("int").alias("est_length_m"), F.lit(label).alias("external"))


def termini(vertices: DataFrame) -> DataFrame:
    """Outline vertices at least three quarters as far from the centroid as the farthest one."""
    d = haversine_km("vlon", "vlat", "clon", "clat")
    far = F.max(d).over(Window.partitionBy("case_id", "det_id"))
    return vertices.withColumn("d", d).withColumn("far", far).where(F.col("d") >= TERMINUS_SHARE * F.col("far")).drop("far")


def structure_scores(structures: DataFrame, floor: float = STRUCTURE_FLOOR) -> DataFrame:
    """Structures with p and near_km: (…, score), those from the floor up, best first."""
    score = F.bround(W_ORIGIN * F.col("p") + W_TERMINUS * F.coalesce(F.exp(-F.col("near_km") / DECAY_KM), F.lit(0.0)), 3)
    return structures.withColumn("score", score).where(F.col("score") >= floor).orderBy(F.desc("score"), "name")
