"""The whole attribution plan, and queries that read all rows of their tables."""

import re
from pathlib import Path

from pyspark.sql import functions as F

import plumeline.queries as registered
from plumeline.plans import attribution
from plumeline.queries import QUERIES
from plumeline.queries.registry import HEAD, T0, T1, grid, instant


def test_no_query_keeps_a_part_of_the_ids():
    """No query reads less by a remainder or a prefix of ids; a06 reads both halves."""
    ids = "l_orderkey|o_orderkey|event_id|s_suppkey|p_partkey|c_custkey|doc_id|page_id|vec_id|conv_id"
    part = re.compile(rf'where\([^)]*\b({ids})"?\)?\s*(%\s*\d+\s*==?\s*\d+|<\s*\d+)')
    found = {m.group(0) for f in Path(registered.__file__).parent.glob("*.py") for m in part.finditer(f.read_text())}
    assert found == {'where("event_id % 2 = 0', 'where("event_id % 2 = 1'}


def test_track_ages_of_every_supplier(spark, sf_dir):
    got = {r.case_id for r in QUERIES["l14_track_width_age"](spark, sf_dir).collect()}
    assert got == {str(r.s_suppkey) for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect()}


def test_suspects_are_walked_and_their_silences_scored(spark):
    """Of three vessels one crosses the origin between two reports, one is silent beside it for 50 minutes."""
    head = {**HEAD, "case_id": "c", "clon": -94.0, "clat": 29.0, "radius_90_km": 40.0, "method": "age"}
    rows = [("366000001", m, -94.0 + (m - 112.5) * 0.022, 29.0, 50.0) for m in (*range(70, 101, 5), *range(125, 156, 5))]
    rows += [("366000002", 5 * k, -94.02 + k * 0.0005, 29.01, 8.0) for k in range(60) if not 20 <= k < 29]
    rows += [("366000003", 5 * k, -94.9 + k % 2 * 1.8, 28.2 + k % 2 * 1.6, 8.0) for k in range(20)]
    p = spark.createDataFrame(rows, "mmsi string, m int, lon double, lat double, sog double")
    p = p.select("mmsi", (instant(T0) + F.make_interval(mins=F.col("m") + 1440)).alias("ts"), "lon", "lat", "sog", F.lit(90.0).alias("cog"), F.lit("noaa").alias("source"), F.when(F.col("mmsi") == "366000001", "fishing").otherwise("cargo").alias("vessel_type"))
    tight = grid(spark).withColumn("p", F.pow("p", F.lit(16)))
    run = lambda **k: {r.mmsi: r for r in attribution.suspects(p, tight, head, instant(T0), instant(T1), **k).collect()}
    short, whole = run(with_gap=False, walk_seconds=None), run()
    assert set(short) == {"366000002"} and {"366000001", "366000002"} <= set(whole)
    assert whole["366000001"].grid_probability > 0.9
    assert whole["366000002"].n_applicable == short["366000002"].n_applicable + 1


def test_flagship_of_the_whole_plan(spark, sf_dir):
    """Walks and silences give other suspects than reports alone."""
    got = {r.mmsi for r in QUERIES["flagship_suspects_whole"](spark, sf_dir).collect()}
    assert got and got != {r.mmsi for r in QUERIES["flagship_suspects"](spark, sf_dir).collect()}
