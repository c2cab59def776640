"""Steps that grow with their tables: plans without broadcasts of made rows, and bounded tasks."""

import re

import numpy as np
from pyspark.sql import functions as F

from plumeline.operators import curves, dark, image, masks, posterior as P
from plumeline.plans import cases as C
from plumeline.queries import cases as Q, scenes as S
from plumeline.sources import readers
from plumeline.streaming import spaced


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_are_never_broadcast(spark):
    cases = spark.range(40)
    frames = cases.select(F.col("id").alias("case_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long"))).alias("step"))
    bands = cases.select(F.col("id").alias("case_id"), F.lit(1.0).alias("hi_h"))
    for made in (curves.horizon_frames(frames, bands, 15.0), curves.every_nth_frame(frames, 3), curves.frame_at(frames, F.lit(1.0), 15.0)):
        assert "Generate" not in _broadcast_parts(plan(made))
    assert curves.horizon_frames(frames, bands, 15.0).count() == 40 * 5


def test_pixels_are_never_broadcast(spark):
    scenes = spark.range(3).select(F.col("id").alias("scene_id"), F.lit(40).alias("rows"), F.lit(40).alias("cols"))
    px = scenes.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("r")).select("scene_id", "r", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("c"), F.lit(-18.0).alias("db"))
    full = masks.raster(px, scenes)
    for made in (full, masks.local_means(full, scenes, 9, tile=16)):
        assert "Generate" not in _broadcast_parts(plan(made))
    assert masks.quantiles(full.select("scene_id", F.col("db").alias("v")), 0.5).count() == 3


def test_scenes_are_made_in_many_tasks_by_compiled_methods(spark, sf_dir, capsys):
    """One small file of suppliers is not one task of pixels, and no generated method is too long to be compiled."""
    sizes = S.sizes(spark, sf_dir)
    made = masks.raster(S.scenes(spark, sf_dir), sizes)
    assert plan(made).count("REPARTITION_BY_NUM") == 2
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        masks.raster(S.scenes(spark, sf_dir), sizes).explain(mode="codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    longest = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(longest) > 5 and max(longest) < 8000


def test_scenes_within_a_tile_are_prepared_in_one_pass(spark, sf_dir):
    made = masks.prepare(S.scenes(spark, sf_dir), S.sizes(spark, sf_dir), 0.01, window=9, tile=64)
    assert "MapInArrow" in plan(made) and "FlatMapGroups" not in plan(made) and "plumeline-staged" not in plan(made)


def test_windows_are_put_together_by_doubling():
    """Running extremes equal those of each window, with as many steps as the window's size has bits; the median of nine is picked, not sorted."""
    a = np.random.default_rng(4).normal(size=(7, 11))
    for size in (1, 2, 3, 5, 8, 13):
        calls = []
        got = image._sliding(a, size, 1, lambda x, y: (calls.append(1), np.maximum(x, y))[1])
        wide = np.pad(a, ((0, 0), (size // 2, size - 1 - size // 2)), mode="edge")
        assert np.array_equal(got, np.stack([wide[:, k : k + size].max(1) for k in range(11)], 1)) and len(calls) <= size.bit_length()
    wide = np.pad(a, 1, mode="edge")
    assert np.array_equal(image.median_filter(a, 3), [[np.median(wide[r : r + 3, c : c + 3]) for c in range(11)] for r in range(7)])


def test_byte_scale_sorts_no_pixels(spark):
    """Percentiles, a row a scene, go to the pixels: no scene's pixels are gathered in one task."""
    px = spark.createDataFrame([("a", float(v)) for v in range(101)] + [("a", None), ("b", None), ("c", 1.0), (None, 1.0)], "scene_id string, db double")
    made = readers.byte_scale(px)
    assert "SortMergeJoin" not in plan(made) and "BroadcastHashJoin" in plan(made)
    got = made.collect()
    assert {r.byte for r in got if r.scene_id == "a" and r.db == 50} == {128} and {r.byte for r in got if r.db is None or r.scene_id == "c"} == {None}
    assert len(got) == 104


def test_cases_that_agree_have_one_head(spark):
    cases = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 1.5), (4, None), (5, None)], "case_id long, west double")
    assert {r.case_id: r.head for r in C.alike(cases, ["west"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_samples_of_ages_are_never_broadcast(spark):
    t = spark.range(3).select(F.col("id").cast("string").alias("case_id"), F.lit(300.0).alias("width_tail_m"))
    s = curves.track_age_samples(t, 50).withColumn("censored", F.lit(None).cast("string"))
    g = P.age_grid(spark)
    post = P.fuse(P.kde_log_age(s, g, ["case_id"]).withColumn("weight", F.lit(1.0)), P.log_prior(g), ["case_id"])
    made = P.summarise(post, P.log_prior(g), ["case_id"])
    assert "Generate" not in _broadcast_parts(plan(made))
    assert made.count() == 3


def test_a_group_of_samples_meets_all_ages_in_one_row(spark):
    """No row for each sample and age; groups over several batches, repeated samples and groups without any of their own count right."""
    import math

    rows = [("a", 1.0 + k % 7, None) for k in range(50)] + [("b", 3.0, None), ("b", -1.0, None), ("c", None, "old"), ("a", None, "old"), (None, 2.0, None)]
    s = spark.createDataFrame(rows, "k string, sample_h double, censored string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        made = P.kde_log_age(s, P.age_grid(spark), ["k"], old_bound=48.0)
        assert "NestedLoop" not in plan(made)
        got = {(r.k, r.age_h): r.ll for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 4 * P.CELLS
    x = [math.log(1.0 + k % 7) for k in range(50)]
    mean = sum(x) / 50
    bw = max((sum((v - mean) ** 2 for v in x) / 50) ** 0.5 * 1.06 * 50**-0.2, 0.15)
    for age in (1.0, 5.5, 20.0):
        kernel = sum(math.exp(-0.5 * ((math.log(age) - v) / bw) ** 2) for v in x) / (bw * math.sqrt(2 * math.pi))
        assert abs(got["a", age] - math.log(kernel / 51)) < 1e-9 or math.log(kernel / 51) < max(v for (k, _), v in got.items() if k == "a") + math.log(P.FLOOR)
    assert abs(got["b", 3.0] - math.log(1 / (0.15 * math.sqrt(2 * math.pi)))) < 1e-9 and got["c", 50.0] > got["c", 10.0]


class _Held:
    """A state of one key, that counts what is put and the timers."""

    def __init__(self):
        self.map, self.value, self.timers, self.puts = {}, None, [], 0
        self.getValueState = self.getMapState = lambda *_: self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, k):  # noqa: N802
        return k in self.map

    def getValue(self, k):  # noqa: N802
        return self.map[k]

    def updateValue(self, k, v):  # noqa: N802
        self.map[k], self.puts = v, self.puts + 1

    def removeKey(self, k):  # noqa: N802
        del self.map[k]

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 400_500

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.timers[0]


def test_a_key_waits_in_one_value_with_one_timer():
    import pandas as pd

    held = _Held()
    each = spaced._Spaced(1, 2_000_000, 1000)
    each.init(held)
    list(each.handleInputRows(("k",), iter([pd.DataFrame({"us": [k * 1_000_000 for k in range(600)], "row": [{"n": k} for k in range(600)]})]), held))
    assert (held.timers, held.puts) == ([1000], 1)
    told = pd.concat(each.handleExpiredTimer(("k",), held, held))
    assert [r["n"] for r in told["row"]] == list(range(400)) and told["accepted"].sum() == 134
    assert held.timers[1] == 401_000  # the first that still waits


def test_contacts_of_one_place_are_compared_once(spark):
    when = F.to_timestamp(F.lit("2024-01-10T00:00:00Z"))
    contacts = spark.createDataFrame([(1, -94.0), (2, -94.0), (3, -94.0), (3, -93.99), (4, -60.0)], "contact_id long, lon double").select("*", F.lit(29.0).alias("lat"), when.alias("t0"))
    p = spark.createDataFrame([("a", -94.0), ("b", -93.99)], "mmsi string, lon double").select("mmsi", when.alias("ts"), "lon", F.lit(29.0).alias("lat"))
    got = dark.match_scene_contacts(contacts, p.where("false").select("mmsi", "lon", "lat", F.col("ts").alias("t0")), p)
    assert {r.contact_id: r.n_vessels for r in got.collect()} == {1: 2, 2: 2, 3: 2, 4: 0}
    assert "plumeline-staged/pairs" in plan(got)


def test_cases_that_differ_by_their_id_alone_share_one_search(spark, sf_dir, monkeypatch):
    one = Q.case_table(spark, sf_dir).where("case_id = 3")
    searched, whole = [], C.suspects
    monkeypatch.setattr(Q, "case_table", lambda *_: one.withColumn("case_id", F.explode(F.sequence(F.lit(3), F.lit(5)))))
    monkeypatch.setattr(C, "suspects", lambda p, cases, cells, **k: (searched.append(cases.count()), whole(p, cases, cells, **k))[1])
    rows = Q.suspects_of_cases(spark, sf_dir).collect()
    assert searched == [1]
    of = lambda k: sorted(r[1:] for r in rows if r.case_id == k)
    assert of(3) == of(4) == of(5)


def _broadcast_parts(text):
    """The subtrees below each broadcast exchange of a plan."""
    lines, out = text.splitlines(), []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = line.index("BroadcastExchange")
            for below in lines[k + 1 :]:
                if len(below) - len(below.lstrip(" :+-*")) <= depth:
                    break
                out.append(below)
    return "\n".join(out)
