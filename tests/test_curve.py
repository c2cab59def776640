"""Extracts along the curve: whole results, and files and row groups left closed."""

import random

import pytest

from plumeline.sources import curve

SCHEMA = "mmsi string, ts long, lon double, lat double, curve_zone string"


def scan(df):
    """(files, rows) that the scan of a plan without shuffles took in; the plan must have run."""
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value(), leaf.metrics().apply("numOutputRows").value()


def test_ranges_cover_just_the_cells_of_a_box():
    draw = random.Random(3)
    extent = (0.0, 0.0, float(1 << curve.BITS), float(1 << curve.BITS))
    for most in (1, 8, 64, 4096):
        for _ in range(20):
            x, y = draw.randint(0, 60000), draw.randint(0, 60000)
            w, h = draw.randint(0, 40), draw.randint(0, 40)
            got = curve.ranges_of_box(x, y, x + w, y + h, extent, most)
            want = {sum(((a >> i & 1) << 2 * i) | ((b >> i & 1) << 2 * i + 1) for i in range(16)) for a in range(x, x + w + 1) for b in range(y, y + h + 1)}
            assert len(got) <= max(most, 4) and all(any(a <= k <= z for a, z in got) for k in want)
            assert all(z + 1 < a for (_, z), (a, _) in zip(got, got[1:], strict=False))
            if most == 4096:
                assert sum(z - a + 1 for a, z in got) == len(want)
    assert curve.ranges_of_box(5, 9, 6, 8, extent) == [] == curve.ranges_of_box(float("nan"), 0, 1, 1, extent)


def test_boxes_equal_the_plain_filter_and_leave_files_closed(spark, tmp_path):
    draw = random.Random(8)
    rows = [(str(i % 40), i, draw.uniform(-180, 180), draw.uniform(-90, 90), "own") for i in range(6000)]
    rows += [("hot", i, 10.0, 10.0, "own") for i in range(3000)]
    rows += [("odd", 1, None, 1.0, "own"), ("odd", 2, 1.0, None, "own"), ("odd", 3, float("nan"), 1.0, "own"), ("odd", 4, 200.0, 95.0, "own"), (None, None, 180.0, 90.0, "own"), ("edge", 5, -180.0, -90.0, "own")]
    df, path = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "x")
    curve.write_by_place(df, path, zone_bits=6)
    n_files = len(spark.read.parquet(path).inputFiles())
    assert spark.read.parquet(path).count() == len(rows)
    boxes = {"small": [(9.0, 9.0, 12.0, 12.0)], "two": [(-30.0, -10.0, -20.0, 5.0), (-25.0, 0.0, -10.0, 20.0)], "date line": [(170.0, -20.0, -175.0, 10.0)], "point": [(10.0, 10.0, 10.0, 10.0)], "corner": [(150.0, 80.0, 200.0, 95.0)], "all": [(-180.0, -90.0, 200.0, 95.0)]}
    for name, some in boxes.items():
        got = curve.read_boxes(spark, path, some)
        def hit(lon, lat, some=some):
            return lon is not None and lat is not None and any((w <= lon <= e if w <= e else lon >= w or lon <= e) and s <= lat <= n for w, s, e, n in some)
        key = lambda r: tuple(str(v) for v in r)
        want = sorted(((m, t, x, y) for m, t, x, y, _ in rows if hit(x, y)), key=key)
        assert sorted((tuple(r) for r in got.collect()), key=key) == want, name
        n = scan(got)[0]
        assert name == "all" or n < n_files / 3, (name, n, n_files)
        assert got.columns == ["mmsi", "ts", "lon", "lat"]
    small = curve.read_boxes(spark, path, boxes["small"])
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(curve_key" in plan and "PartitionFilters: [isnotnull(curve_zone" in plan
    assert curve.read_boxes(spark, path, []).count() == 0
    curve.write_by_place(df.where("false"), str(tmp_path / "none"))
    assert curve.read_boxes(spark, str(tmp_path / "none"), boxes["all"]).count() == 0
    with pytest.raises(ValueError, match="zone_bits"):
        curve.write_by_place(df, path, zone_bits=40)


def test_row_groups_of_a_folder_are_left_closed(spark, tmp_path):
    """All in one folder: only stretches of the curve let row groups be skipped."""
    draw = random.Random(2)
    path = str(tmp_path / "x")
    df = spark.createDataFrame([("v", i, draw.uniform(0, 1), draw.uniform(0, 1)) for i in range(20000)], "mmsi string, ts long, lon double, lat double")
    curve.write_by_place(df, path, extent=(0.0, 0.0, 1.0, 1.0), zone_bits=0, most_rows=500)
    got = curve.read_boxes(spark, path, [(0.1, 0.1, 0.2, 0.2)])
    n = len(got.collect())
    assert n == df.where("lon between 0.1 and 0.2 and lat between 0.1 and 0.2").count() and scan(got)[1] < 20000 / 5
