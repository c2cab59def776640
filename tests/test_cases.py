"""Many cases in one plan against the plan of one case, and against brute force."""

from pyspark.sql import functions as F

from plumeline.plans import attribution
from plumeline.plans import cases as C
from plumeline.queries import cases as Q
from plumeline.queries.registry import positions
from plumeline.sources.staging import shared_folder


def test_extracts_equal_an_exact_test_of_all_pairs(spark, sf_dir):
    cases = Q.case_table(spark, sf_dir)
    got = C.extracts(positions(spark, sf_dir), cases, pad_hours=30.0, least_km=50.0)
    box = C.ingest.search_box(cases, 30.0, 50.0).collect()
    rows = positions(spark, sf_dir).collect()
    want = sorted((b.case_id, p.event_id) for b in box for p in rows if b.west <= p.lon <= b.east and b.south <= p.lat <= b.north and b.start <= p.ts < b.stop)
    assert sorted((r.case_id, r.event_id) for r in got.collect()) == want and want


def test_each_case_equals_its_own_plan(spark, sf_dir):
    cases = Q.case_table(spark, sf_dir)
    got = C.suspects(positions(spark, sf_dir), cases, Q.case_grids(cases), **Q.WIDE).collect()
    met = C.extracts(positions(spark, sf_dir), cases, pad_hours=Q.WIDE["pad_hours"]).cache()
    wanted = 0
    for case in cases.where("case_id < 3").collect():
        head = {c: case[c] for c in ("case_id", "west", "south", "east", "north", "rows", "cols", "clon", "clat", "radius_90_km", "method")}
        cells = Q.case_grids(cases).where(F.col("case_id") == case.case_id).drop("case_id")
        t0, t1 = (F.lit(case[c]) for c in ("window_start", "window_end"))
        other = {k: v for k, v in Q.WIDE.items() if k != "pad_hours"}
        alone = attribution.suspects(met.where(F.col("case_id") == case.case_id).drop("case_id"), cells, head, t0, t1, **other).collect()
        key = lambda r: (r["rank"], r.mmsi, r.score, r.weight_live, r.n_applicable, r.grid_probability, r.closest_km)
        assert sorted(map(key, alone)) == sorted(key(r) for r in got if r.case_id == case.case_id)
        wanted += len(alone)
    assert wanted > 0


def test_no_cases_null_ids_and_places_without_reports(spark, sf_dir):
    cases = Q.case_table(spark, sf_dir)
    far = cases.where("case_id = 1").withColumns({"west": F.lit(10.0), "east": F.lit(11.0), "clon": F.lit(10.5)})
    null = cases.where("case_id = 2").withColumn("case_id", F.lit(None).cast("long"))
    lost = positions(spark, sf_dir).withColumn("lon", F.lit(None).cast("double"))
    assert C.suspects(positions(spark, sf_dir), far.union(null), Q.case_grids(cases), **Q.WIDE).count() == 0
    assert C.suspects(positions(spark, sf_dir), cases.where("false"), Q.case_grids(cases), **Q.WIDE).count() == 0
    assert C.suspects(lost, cases, Q.case_grids(cases), **Q.WIDE).count() == 0


def test_positions_meet_cases_by_equal_cells(spark, sf_dir):
    """No product of positions and cases in the plan."""
    met = C.extracts(positions(spark, sf_dir), Q.case_table(spark, sf_dir))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_shared_folder_stays_the_same(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_few_cases_are_held_against_vessels_without_extracts(spark, sf_dir, monkeypatch):
    """The same rows as by extracts, and no extract is written; whole vessels in small calls, walks in small parts."""
    from plumeline.plans import passes

    cases, names = Q.case_table(spark, sf_dir).where("case_id < 6"), []
    odd = cases.where("case_id = 1").withColumns({"case_id": F.lit(77).cast("long"), "clon": F.lit(None).cast("double")})
    cases = cases.union(odd)
    p = positions(spark, sf_dir).withColumns({"sog": F.when(F.col("event_id") % 4 > 0, F.col("sog")), "cog": F.when(F.col("event_id") % 5 > 0, F.col("cog")), "source": F.when(F.col("event_id") % 7 > 0, F.col("source")), "vessel_type": F.when(F.col("event_id") % 3 > 0, F.col("vessel_type"))})
    monkeypatch.setattr(C, "staged", lambda df, name, held=C.staged: (names.append(name), held(df, name))[1])
    run = lambda: sorted(C.suspects(p, cases, Q.case_grids(cases), **Q.WIDE).collect(), key=str)
    monkeypatch.setattr(passes, "BATCH", 50)
    monkeypatch.setattr(passes, "INSTANTS", 7)
    few = run()
    assert few and "fixes" not in names and "passes" in names
    monkeypatch.setattr(passes, "MOST_CASES", 2)
    assert run() == few and "fixes" in names
