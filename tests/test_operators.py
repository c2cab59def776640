"""Hand-computed cases of the library's operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.functions import geo, scalars
from plumeline.operators import age, compare, dark, drift, evaluate, image, ingest, posterior, score, slick, synth, tracks, validate
from plumeline.operators import grid as G

TRACK = "mmsi string, ts timestamp, lon double, lat double, sog double, cog double, source string"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def fixes(spark, rows, mmsi="366000001"):
    df = spark.createDataFrame([(mmsi, t, float(x), 28.0, s, 90.0, src) for t, x, s, src in rows], TRACK.replace("ts timestamp", "ts string"))
    return df.withColumn("ts", F.to_timestamp("ts"))


def at(spark, text, mmsi="366000001"):
    return spark.createDataFrame([(mmsi, text)], "mmsi string, at string").withColumn("at", F.to_timestamp("at"))


def test_geometry(spark):
    r = one(spark, geo.haversine_km(0.0, 0.0, 0.0, 1.0), *(geo.bearing_deg(0.0, 0.0, *p) for p in ((0.0, 1.0), (1.0, 0.0), (0.0, -1.0), (-1.0, 0.0))), geo.angle_between_deg(355.0, 5.0), geo.wrap_lon(190.0), geo.segment_km(0.0, 0.0, 1.0, 1.0, 1.0, 1.0)[1])
    assert r[0] == pytest.approx(111.195, abs=0.01)
    assert [round(x, 6) for x in r[1:5]] == [0, 90, 180, 270]
    assert r[5] == 10 and r[6] == -170 and r[7] == 0


def test_sentinels_and_classes(spark):
    raw = spark.createDataFrame([("001234567", "2024-01-01T00:00:00", 28.0, -94.0, 102.3, 360.0, 511.0, "  ", "80"), ("366000001", "2024-01-01T00:00:01", 28.0, -94.0, 102.2, 359.9, 510.0, "A", "x")], "MMSI string, BaseDateTime string, LAT double, LON double, SOG double, COG double, Heading double, VesselName string, VesselType string")
    a, b = ingest.normalise_reports(raw).orderBy("mmsi").collect()
    assert (a.mmsi, a.sog, a.cog, a.heading, a.name, a.vessel_type, a.cargo_code) == ("001234567", None, None, None, None, "tanker", None)
    assert (b.sog, b.cog, b.heading, b.vessel_type) == (None, 359.9, 510.0, "other")
    codes = spark.createDataFrame([(c,) for c in (79, 80, 89, 90, 69, 70, 30, 31, None)], "c int").select(scalars.ship_class(F.col("c"))).collect()
    assert [r[0] for r in codes] == ["cargo", "tanker", "tanker", "other", "passenger", "cargo", "fishing", "other", "other"]


def test_identity_order(spark):
    m = spark.createDataFrame([(x,) for x in ("992345678", "982345678", "972345678", "111234567", "001234567", "012345678", "12345678", "100234567", "366000001", None)], "m string")
    assert [r[0] for r in m.select(scalars.identity_problem(F.col("m"))).collect()] == ["aid to navigation", "craft of a parent ship", "distress transmitter", "search and rescue aircraft", "coast station", "group of ships", "not nine digits", "no country code", None, "not nine digits"]


def test_times_need_a_zone(spark):
    t = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("2024-01-01T02:00:00+02:00",), ("soon",)], "t string")
    assert [r[0] for r in t.select(scalars.iso_utc(scalars.parse_utc(F.col("t")))).collect()] == ["2024-01-01T00:00:00Z", None, "2024-01-01T00:00:00Z", None]


def test_half_open_window_and_box(spark):
    p = fixes(spark, [("2024-01-01 00:00:00", -94, 1.0, "noaa"), ("2024-01-01 01:00:00", -93, 1.0, "noaa")])
    lo, hi = F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.to_timestamp(F.lit("2024-01-01 01:00:00"))
    assert p.where(ingest.in_window(lo, hi)).count() == 1
    assert p.where(ingest.in_box(-94, 28, -93, 28)).count() == 2


def test_day_continuity(spark):
    d = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-02",), ("2024-01-05",)], "day string").select(F.to_date("day").alias("day"))
    assert sorted(str(r.problem) for r in ingest.day_continuity(d).collect()) == ["None", "None", "duplicate", "hole"]


@pytest.mark.parametrize(("when", "lon"), [("2024-01-01 00:15:00", -93.5), ("2024-01-01 00:00:00", -94.0), ("2024-01-01 00:30:00", -93.0), ("2024-01-01 01:00:00", None), ("2023-12-31 00:00:00", None), ("2024-01-03 00:00:00", None)])
def test_position_at(spark, when, lon):
    p = fixes(spark, [("2024-01-01 00:00:00", -94, 1.0, "noaa"), ("2024-01-01 00:30:00", -93, 1.0, "noaa"), ("2024-01-01 02:00:00", -92, 1.0, "noaa")])
    got = tracks.positions_at(p, at(spark, when)).collect()
    assert [r.lon for r in got] == ([] if lon is None else [pytest.approx(lon)])


def test_hourly_ceiling(spark):
    p = fixes(spark, [("2024-01-01 00:00:00", -94, None, "gfw"), ("2024-01-01 01:00:00", -93, None, "noaa")])
    assert tracks.positions_at(p, at(spark, "2024-01-01 00:30:00"), max_gap_min=75).count() == 1
    assert tracks.positions_at(p, at(spark, "2024-01-01 00:30:00"), max_gap_min=30).count() == 0


def test_silence_overlaps_strictly(spark):
    p = fixes(spark, [("2024-01-01 00:00:00", -94, 5.0, "noaa"), ("2024-01-01 01:00:00", -93, 5.0, "noaa"), ("2024-01-01 01:10:00", -93, 5.0, "noaa")])
    w = lambda a, b: tracks.longest_silence(p, F.to_timestamp(F.lit(a)), F.to_timestamp(F.lit(b))).first().window_gap_min
    assert w("2024-01-01 00:30:00", "2024-01-01 00:40:00") == 60
    assert w("2024-01-01 01:00:00", "2024-01-01 01:05:00") == 10
    p = fixes(spark, [("2024-01-01 00:00:00", -94, 5.0, "noaa"), ("2024-01-01 00:20:20", -93, 5.0, "noaa")])
    assert w("2024-01-01 00:00:00", "2024-01-01 00:10:00") == 20.3


def test_dense_wins_by_hour(spark):
    p = fixes(spark, [("2024-01-01 00:10:00", -94, 5.0, "noaa"), ("2024-01-01 00:40:00", -93, None, "gfw"), ("2024-01-01 01:40:00", -93, None, "gfw")])
    assert [r.source for r in tracks.dense_wins(p).orderBy("ts").collect()] == ["noaa", "gfw"]


def test_thinning_depends_on_what_was_kept(spark):
    p = fixes(spark, [(f"2024-01-01 00:00:{s:02d}", -94, 1.0, "noaa") for s in (0, 4, 9, 10, 12, 19, 20)])
    assert [r.ts.second for r in tracks.thin_by_cadence(p, 10).orderBy("ts").collect()] == [0, 10, 20]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_thinning_equals_a_walk_over_each_track(spark, batch):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(60)]), k) for k in range(300)]
    p = spark.createDataFrame(rows, "mmsi string, s int, k int").select("mmsi", F.timestamp_seconds("s").alias("ts"), "k")
    want = set()
    for m in ("a", "b", "c", None):
        last = None
        for s, k in sorted((s, k) for n, s, k in rows if n == m and s is not None):
            if last is None or s - last >= 7.5:
                want.add((m, k))
                last = s
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [(r.mmsi, r.k) for r in tracks.thin_by_cadence(p, 7.5).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(want) and set(got) == want


def test_strata_are_dealt_in_turn(spark):
    rows = [(k, None if k % 50 == 0 else "few" if k % 9 == 0 else "many") for k in range(3000)]
    split = evaluate.stratified_split(spark.createDataFrame(rows, "u long, s string"), "u", "s", folds=7)
    assert split.count() == split.select("u").distinct().count() == 3000
    sizes = split.groupBy("s").agg(F.countDistinct("fold").alias("folds"), F.count("*").alias("n")).join(split.groupBy("s", "fold").count().groupBy("s").agg((F.max("count") - F.min("count")).alias("apart")).withColumnRenamed("s", "z"), F.col("s").eqNullSafe(F.col("z")))
    assert [(r.folds, r.apart <= 1) for r in sizes.collect()] == [(7, True)] * 3


HEAD = {"west": -95.0, "south": 29.0, "east": -94.0, "north": 30.0, "rows": 3, "cols": 3}


def test_grid_row_zero_is_north(spark):
    cells = spark.createDataFrame([(r, c, (r * 3 + c) / 10) for r in range(3) for c in range(3)], "r int, c int, p double")
    pts = spark.createDataFrame([(-95.0, 30.0), (-94.0, 29.0), (-94.5, 29.5), (-96.0, 29.5)], "lon double, lat double")
    assert sorted(r.p for r in G.sample(pts, cells, HEAD).collect()) == [0.0, 0.0, 0.4, 0.8]
    top = G.peak(cells, HEAD).first()
    assert (top.r, top.c, top.lon, top.lat) == (2, 2, -94.0, 29.0)


def test_blur_keeps_mass_inside(spark):
    w = G.blur(spark.createDataFrame([(20, 20, 1.0)], "r int, c int, w double"), 1.5, 40, 40)
    assert w.agg(F.sum("w")).first()[0] == pytest.approx(1)


def test_scores_ignore_nulls_on_both_sides(spark):
    rows = [("c", "1", "proximity", 0.617), ("c", "1", "trajectory", 0.088), ("c", "1", "gap", 1.0), ("c", "1", "slowdown", 0.0), ("c", "1", "type_prior", None), ("c", "2", "parity", None)]
    s = {r.mmsi: r for r in score.weighted_scores(spark.createDataFrame(rows, "case_id string, mmsi string, component string, value double")).collect()}
    assert s["1"].score == 0.536 and s["1"].weight_live == 0.765 and s["1"].n_applicable == 4
    assert (s["2"].score, s["2"].weight_live, s["2"].n_applicable) == (0, 0, 0)
    assert sum(score.WEIGHTS.values()) == pytest.approx(score.WEIGHT_SUM)


def test_gates(spark):
    rows = [("c", m, "type_prior", 1.0, False, "") for m in "ab"] + [("c", "a", "gap", 0.0, False, ""), ("c", "b", "gap", None, True, ""), ("d", "a", "type_prior", 1.0, False, "")]
    c = spark.createDataFrame(rows, "case_id string, mmsi string, component string, value double, source_gated boolean, note string")
    got = {(r.case_id, r.mmsi, r.component): r.value for r in score.gate_sources(score.gate_constants(c)).collect()}
    assert got == {("c", "a", "type_prior"): None, ("c", "b", "type_prior"): None, ("c", "a", "gap"): None, ("c", "b", "gap"): None, ("d", "a", "type_prior"): 1.0}


def test_gap_exits_in_order(spark):
    rows = [(True, 90.0, 5.0, 5.0, False, False, 0), (False, None, None, None, False, False, 0), (False, 90.0, None, 5.0, True, False, 0), (False, 90.0, 1.0, 5.0, False, True, 0), (False, 90.0, 5.0, 5.0, False, True, 1), (False, 90.0, 5.0, 5.0, False, False, 1), (False, 90.0, 5.0, 5.0, False, False, 0), (False, 29.9, 5.0, 5.0, False, False, 0)]
    d = spark.createDataFrame(rows, "h boolean, m double, a double, b double, bh boolean, e boolean, n int")
    value, gated, why = score.gap(*(F.col(c) for c in ("h", "m", "a", "b", "bh", "e", "n")))
    got = d.select(value, gated, why).collect()
    assert [r[2] for r in got] == ["hourly record only", "continuous coverage", "bounded by an hourly row", "not under way", "at the edge of the search box", "heard by the other source", "silence", "short silence"]
    assert [r[0] for r in got] == [None, 0.0, None, None, None, None, 1.0, 0.0]
    assert [r[1] for r in got] == [True, False, True, False, False, True, False, False]


def test_ranking_is_total(spark):
    rows = [("c", m, 0.5, 0.5, 3, 0.5, 1.0) for m in ("3", "1", "2")] + [("c", "0", 0.5, 0.5, 3, 0.5, None)]
    r = score.rank(spark.createDataFrame(rows, "case_id string, mmsi string, score double, weight_live double, n_applicable int, grid_probability double, closest_km double"))
    assert [x.mmsi for x in r.orderBy("rank").collect()] == ["1", "2", "3", "0"]


def test_prism(spark):
    p = fixes(spark, [("2024-01-01 00:00:00", -94.0, 10.0, "noaa"), ("2024-01-01 01:00:00", -93.8, 10.0, "noaa")])
    t0 = F.to_timestamp(F.lit("2024-01-01 00:30:00"))
    contacts = spark.createDataFrame([(1, -93.9, 28.0), (2, -93.9, 28.5), (3, -94.005, 28.0)], "contact_id int, lon double, lat double")
    none = p.where("false").select("mmsi", "lon", "lat")
    got = {r.contact_id: r.matched for r in dark.match_contacts(contacts, none, dark.scene_fixes(p, t0), t0).collect()}
    assert got == {1: True, 2: False, 3: True}
    placed = spark.createDataFrame([("366000001", -93.5, 28.0)], "mmsi string, lon double, lat double")
    got = {r.contact_id: r.matched for r in dark.match_contacts(contacts, placed, dark.scene_fixes(p, t0), t0).collect()}
    assert not any(got.values()), "a placed vessel never falls through to the prism"


def test_posterior_closed_forms(spark):
    g = posterior.age_grid(spark)
    prior = posterior.log_prior(g)
    assert prior.agg(F.sum(F.exp("lp"))).first()[0] == pytest.approx(1)
    flat = g.select(F.lit("c").alias("k"), "age_h", F.lit(0.0).alias("ll"), F.lit(1.0).alias("weight"))
    post = posterior.fuse(flat, prior, ["k"])
    assert posterior.information_gain(post, prior, ["k"]).first().gain_nats == pytest.approx(0, abs=1e-9)
    assert posterior.summarise(post, prior, ["k"]).first().status == "none"
    spike = g.select(F.lit("c").alias("k"), "age_h", F.when(F.col("age_h") == 5, 0.0).otherwise(-1e9).alias("ll"), F.lit(1.0).alias("weight"))
    s = posterior.summarise(posterior.fuse(spike, prior, ["k"]), prior, ["k"]).first()
    assert (s.lo_h, s.hi_h, s.mode_h, s.multimodal, s.status) == (4.875, 5.125, 5.0, False, "ok")
    assert posterior.fuse(flat.withColumn("weight", F.lit(0.0)), prior, ["k"]).count() == 0


def test_censored_samples_widen(spark):
    s = spark.createDataFrame([("c", 4.0, None), ("c", 5.0, None), ("c", None, "old")], "k string, sample_h double, censored string")
    ll = {r.age_h: r.ll for r in posterior.kde_log_age(s, posterior.age_grid(spark), ["k"], old_bound=48.0).collect()}
    assert ll[4.5] > ll[60.0] > ll[20.0]


def test_bands(spark):
    b = spark.createDataFrame([("a", 7.0, 18.0), ("a", 9.0, 15.0), ("b", 2.0, 5.0), ("b", 20.0, 30.0), ("c", 1.0, 2.0), ("c", None, None)], "k string, lo_h double, hi_h double")
    assert {r.k: (r.lo_h, r.hi_h, r.how) for r in posterior.combine_bands(b, ["k"]).collect()} == {"a": (9, 15, "combined"), "b": (2, 30, "disagreement"), "c": (1, 2, "single")}


def test_fay_grows_with_the_fourth_root(spark):
    r = one(spark, *(age.fay_radius_km(F.lit(h), F.lit(100.0), F.lit(1.3), F.lit(900.0)) for h in (16.0, 1.0)))
    assert r[0] / r[1] == pytest.approx(2)


def run(current, wind, hours, dt=900.0, lon=-94.0, lat=28.5, share=0.03):
    move = lambda x, y, t: drift.velocity(x, y, t, current, wind, share)
    n = int(hours * 3600 / abs(dt)) + 1
    return drift.integrate(np.array([lon]), np.array([lat]), 0.0, dt, n, move)


def km(a, b, c, d):
    return math.hypot((c - a) * 111.32 * math.cos(math.radians((b + d) / 2)), (d - b) * 111.32)


def test_known_answer_drift():
    still = drift.constant_field(0, 0)
    xs, ys, _ = run(drift.constant_field(0.5, 0), still, 10)
    assert km(-94, 28.5, xs[-1][0], ys[-1][0]) == pytest.approx(18, rel=0.02)
    xs, ys, _ = run(still, drift.constant_field(10, 0), 10)
    assert km(-94, 28.5, xs[-1][0], ys[-1][0]) == pytest.approx(10.8, rel=0.02)
    vortex = drift.vortex_field(-94.3, 28.0, 1.0, 0.5)
    fx, fy, _ = run(vortex, still, 24)
    bx, by, _ = run(vortex, still, 24, dt=-900.0, lon=fx[-1][0], lat=fy[-1][0])
    assert km(-94, 28.5, bx[-1][0], by[-1][0]) < 0.5


def test_stranding_is_sticky():
    land = lambda x, y: x > -93.9
    move = lambda x, y, t: (np.full(len(x), 1.0), np.zeros(len(x)))
    xs, _, ashore = drift.integrate(np.array([-94.0]), np.array([28.5]), 0.0, 900.0, 60, move, land)
    k = int(np.argmax(ashore[:, 0]))
    assert ashore[k:, 0].all() and np.all(xs[k:, 0] == xs[k - 1, 0]) and xs[-1, 0] <= -93.9


def test_shear_preserves_area():
    move = lambda x, y, t: drift.shear_field(5e-5, 28.5)(x, y, t)
    a = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    xs, ys, _ = drift.integrate(-94 + 0.01 * np.cos(a), 28.5 + 0.01 * np.sin(a), 0.0, 900.0, 41, move)
    area = lambda x, y: abs(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))
    assert area(xs[-1], ys[-1]) == pytest.approx(area(xs[0], ys[0]), rel=0.01)


def test_members_cover_strata(spark):
    d = drift.member_draws(spark, 50).toPandas()
    lo, hi = drift.WIND_RANGE
    assert sorted(((d.wind_share - lo) / (hi - lo) * 50).astype(int)) == list(range(50))
    assert d.current_scale.mean() == pytest.approx(1, abs=0.02) and d.current_scale.std() == pytest.approx(0.15, abs=0.02)


def test_land_corners_average_the_wet():
    import pandas as pd

    rows = pd.DataFrame([(t, y, x, None if (x, y) == (1.0, 1.0) else 1.0, 0.0) for t in (0.0, 1.0) for y in (0.0, 1.0) for x in (0.0, 1.0)], columns=["t_epoch", "lat", "lon", "u", "v"])
    u, _ = drift.Gridded(rows)(np.array([0.9, -5.0]), np.array([0.9, -5.0]), 0.5)
    assert u.tolist() == [1.0, 1.0]


def test_fewest_groups():
    assert sorted(slick.fewest_groups(4, lambda m: m in (0b0111, 0b0011))) == [0b0111, 0b1000]
    assert sorted(slick.fewest_groups(3, lambda m: False)) == [1, 2, 4]


def test_dark_region_is_found(spark):
    px = synth.radar_scene(spark, "s", 96, 96, slick=(48, 40, 5.0, 18.0, 0.0))
    r = image.dark_regions(px, 0.01, 0.3, 500.0, 80, (21, 41)).collect()
    truth = px.agg(F.sum("gt")).first()[0]
    assert len(r) == 1 and abs(r[0].area_px - truth) < 0.25 * truth and r[0].contrast_db < -5 and r[0].elongation > 2.5


def test_contacts_merge_and_size(spark):
    px = synth.radar_scene(spark, "s", 64, 64, ships=((20, 20), (20, 24), (50, 50)))
    r = image.bright_contacts(px).orderBy("r").collect()
    assert len(r) == 2 and sum(x.px_area for x in r) == 27


def test_components_and_distance():
    m = np.zeros((6, 6), bool)
    m[0, 0] = m[1, 1] = m[4, 4] = m[4, 5] = True
    assert image.label_components(m).max() == 2 and image.label_components(m, diagonal=False).max() == 3
    rows, cols = np.nonzero(m)
    want = np.array([[np.hypot(rows - r, cols - c).min() for c in range(6)] for r in range(6)])
    assert np.allclose(image.distance_to(m), want)


def test_loose_particle_match_is_an_error(spark):
    a = spark.createDataFrame([("c", 1, -94.0, 28.0)], "case_id string, pid int, lon double, lat double")
    with pytest.raises(Exception, match="same set"):
        compare.match_particles(a, a.withColumn("lon", F.col("lon") + 1)).collect()


def test_particles_match_as_over_all_pairs(spark):
    rng = np.random.default_rng(3)
    lon, lat = -94 + rng.integers(0, 12, 60) * 4e-6, 28 + rng.integers(0, 12, 60) * 4e-6
    x = [("c", k, float(lon[k]), float(lat[k])) for k in range(60)]
    y = [("c", 100 + k, float(lon[k] + rng.normal() * 1e-6), float(lat[k])) for k in rng.permutation(60).tolist()]
    wide = 111320 * math.cos(math.radians(float(np.mean([r[3] for r in x + y]))))
    pairs = sorted((math.hypot((p[2] - q[2]) * wide, (p[3] - q[3]) * 111320), i, j) for i, p in enumerate(x) for j, q in enumerate(y))
    want = {}
    for _, i, j in pairs:
        if i not in want and j not in want.values():
            want[i] = j
    schema = "case_id string, pid int, lon double, lat double"
    a, b = spark.createDataFrame(x, schema).coalesce(1), spark.createDataFrame(y, schema).coalesce(1)
    got = compare.match_particles(a, b, limit_m=50.0).collect()
    assert {r.pid: r.pid2 for r in got} == {x[i][1]: y[j][1] for i, j in want.items()}
    near = max(r.residual_m for r in got)
    assert len(compare.match_particles(a, b, limit_m=near + 1e-6).collect()) == 60
    with pytest.raises(Exception, match="same set"):
        compare.match_particles(a, b, limit_m=near - 1e-6).collect()


@pytest.mark.parametrize(("column", "value", "rule"), [("west", -90.0, "bounds.lon_order"), ("south", 31.0, "bounds.lat_order"), ("east", 181.0, "bounds.lon_range"), ("north", 91.0, "bounds.lat_range"), ("width_px", 0, "bounds.size"), (None, None, None)])
def test_bound_mutations(spark, column, value, rule):
    b = spark.createDataFrame([("c", -95.0, 28.0, -93.0, 30.0, 10, 10)], "case_id string, west double, south double, east double, north double, width_px int, height_px int")
    got = {r.rule for r in validate.check_bounds(b.withColumn(column, F.lit(value)) if column else b).collect()}
    assert (rule in got) if rule else not got


def test_streaming_equals_batch(spark, tmp_path):
    from plumeline.streaming import gaps

    p = fixes(spark, [(f"2024-01-01 {h:02d}:{m:02d}:00", -94, 1.0, "noaa") for h, m in ((0, 0), (0, 20), (1, 30), (1, 40), (5, 0))]).select("mmsi", "ts", "source")
    p.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    q = gaps.sessions(stream, 30, late="10 minutes").writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda d: sorted((r.first_ts, r.last_ts, r.n) for r in d.collect())
    assert rows(spark.table("sessions")) == rows(gaps.sessions(p, 30)) and spark.table("sessions").count() == 3


def test_library_stands_without_the_llm_folders(tmp_path):
    """A copy without them still imports and registers the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/plumeline", tmp_path / "plumeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_running_totals_over_parts(spark):
    df = spark.range(1, 2001).select(((F.col("id") * 7919) % 2003).cast("double").alias("s"), F.lit(1).alias("n"))
    got = sorted((r.s, r.k) for r in evaluate.running_totals(df, "s", {"k": "n"}, parts=32).collect())
    values = sorted((s for s, _ in got), reverse=True)
    assert got == sorted((s, k + 1) for k, s in enumerate(values))
    perfect = df.withColumn("label", (F.col("s") > 1000).cast("int"))
    best = evaluate.best_threshold(perfect, "s").first()
    assert best.f1 == 1 and best.threshold > 1000


def test_outline_closes(spark):
    from plumeline.operators import curves

    mask = np.zeros((8, 8), bool)
    mask[2:5, 3:7] = True
    ring = curves.trace_outline(mask)
    assert sorted(map(tuple, ring.tolist())) == [(2, 3), (2, 7), (5, 3), (5, 7)]
    assert len(curves.trace_outline(np.zeros((3, 3), bool))) == 0


def test_track_width_and_contrast(spark):
    from plumeline.operators import curves

    px = synth.radar_scene(spark, "s", 80, 140, slick=(40, 70, 5.0, 50.0, 0.0))
    p = curves.width_profile(px.where("gt = 1").select(F.col("scene_id").alias("case_id"), "r", "c"), 10.0).first()
    assert p.aspect > 8 and 60 <= p.width_tail_m <= 110 and p.length_m > 700
    c = curves.centre_edge_contrast(px).first()
    assert c.centre_db == pytest.approx(-8, abs=0.5) and c.sea_db == pytest.approx(-18, abs=0.5)
    assert curves.centre_edge_contrast(px.withColumn("gt", F.lit(0))).first().centre_db is None


def test_dispersion_lengthens_and_gives_ages(spark):
    from plumeline.operators import curves

    seeds = spark.range(300).select(F.lit("c").alias("case_id"), F.col("id").cast("int").alias("pid"), (-94 + 0.001 * F.cos("id")).alias("lon"), (28.5 + 0.001 * F.sin("id")).alias("lat"))
    m = spark.createDataFrame([(0, 0.03, 1.0, 2.0), (1, 0.03, 1.0, 4.0)], "member int, wind_share double, current_scale double, k_m2s double")
    c = curves.dispersion_curves(seeds, m, drift.constant_field(0.1, 0), drift.constant_field(0, 0), [1.0, 4.0, 16.0], 15.0)
    rows = {(r.member, r.hours): r.length_km for r in c.collect()}
    for member, k in ((0, 2.0), (1, 4.0)):
        assert rows[member, 16.0] == pytest.approx(4 * math.sqrt(2 * k * 16 * 3600) / 1000, rel=0.2)
    ages = {r.member: r.age_h for r in curves.length_ages(c, 1.2).collect()}
    assert ages[1] < ages[0]


def test_stride_must_divide_the_span(spark):
    from plumeline.operators import curves

    p = spark.range(10).select(F.lit("c").alias("case_id"), F.col("id").alias("step"))
    assert curves.every_nth_frame(p, 3).count() == 4
    with pytest.raises(Exception, match="divide"):
        curves.every_nth_frame(p, 4).collect()


def test_first_pass_keeps_incidents_with_earlier_scenes_only(spark):
    from plumeline.sources.readers import first_pass

    scenes = spark.sql("select * from values ('a', 's1', timestamp'2024-01-01'), ('b', 's2', timestamp'2024-01-01'), ('b', 's3', timestamp'2024-01-05') as t(case_id, scene_id, t)")
    incidents = spark.sql("select case_id, timestamp'2024-01-03' as t_incident from values ('a'), ('b'), ('c') as t(case_id)")
    assert {r.case_id: (r.scene_id, r.light) for r in first_pass(scenes, incidents).collect()} == {"a": (None, "red"), "b": ("s3", "green"), "c": (None, "red")}


def test_rate_limit_counts_accepted_hits_only(spark):
    from plumeline.operators.records import limited

    times = {"a": [0, 1, 2, 3, 4, 5, 59, 60, 61, 62, 100], "b": [0, 61, 61, 61, 61, 61, 61]}
    want = {}
    for who, ts in times.items():
        passed = []
        for k, t in enumerate(ts):
            ok = sum(t - p <= 60 for p in passed) < 5
            passed += [t] * ok
            want[who, k] = ok
    rows = [(who, k, float(t)) for who, ts in times.items() for k, t in enumerate(ts)]
    got = limited(spark.createDataFrame(rows, "client string, k int, at_s double").orderBy("k")).collect()
    assert sum(r.accepted for r in got) == sum(want.values()) and {(r.client, r.at_s) for r in got if not r.accepted} == {(w, float(times[w][k])) for (w, k), ok in want.items() if not ok}


def test_ellipse_of_seven():
    from plumeline.operators.records import ellipse

    width = {dy: sum(a == dy for a, _ in ellipse(7)) for dy in range(-3, 4)}
    assert width == {-3: 1, -2: 5, -1: 7, 0: 7, 1: 7, 2: 5, 3: 1}


def test_placeholders_at_any_depth(spark):
    from plumeline.operators.records import placeholders

    doc = '{"a": {"b": [1, {"c": "TODO, prose"}]}, "_status": "TODO", "d": [["x", "TODO"]]}'
    assert {r.path for r in placeholders(spark.createDataFrame([(1, doc), (2, None)], "case_id int, body string")).collect()} == {"a.b[1].c", "d[0][1]"}


def test_ring_and_closing_by_brute_force():
    rng = np.random.default_rng(3)
    mask = rng.random((30, 26)) < 0.04
    on = list(zip(*np.nonzero(mask), strict=True))
    steps = np.array([[min(abs(r - a) + abs(c - b) for a, b in on) for c in range(26)] for r in range(30)])
    assert np.array_equal(image.steps_to(mask), steps)
    k = image.ellipse(7)
    at = lambda m, r, c, other: m[r, c] if 0 <= r < 30 and 0 <= c < 26 else other
    wide = np.array([[any(at(mask, r + a, c + b, False) for a, b in k) for c in range(26)] for r in range(30)])
    want = np.array([[all(at(wide, r + a, c + b, True) for a, b in k) for c in range(26)] for r in range(30)])
    assert np.array_equal(image.closed(mask, 7), want)


def test_dark_region_by_hand():
    """A strip 6 dB below an even sea: its pixels, contrast and box; a short speck is left out, a long thin streak kept."""
    db = np.full((160, 200), -10.0)
    db[60:70, 40:140] = -16.0
    db[120:122, 50:140] = -16.0
    db[20:24, 20:24] = -16.0
    r = image.regions_of("s", db, 1e-4, 0.05, 500.0, 80, (41,))
    big = r[r.area_px > 500].iloc[0]
    assert len(r) == 2 and abs(big.area_px - 1000) <= 60 and big.contrast_db == -6.0 and (abs(big.r - 64.5) < 1 and abs(big.c - 89.5) < 1)
    assert len(image.regions_of("s", db, 1e-4, 0.05, 0.05, 80, (41,))) == 1
