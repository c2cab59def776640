"""Slicks from detections: which oil outlines are parts of one ribbon, merged features, and seeds.

The four ribbon measures are aggregates over vertices. The search for the coarsest grouping works on
subsets of a case's few outlines: it is a minimum cover by bit masks, one case a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
KM_PER_DEG = 111.32
MIN_ASPECT, MIN_COVERAGE, MAX_GAP, MAX_PERP = 6.0, 0.75, 0.10, 0.20
MOST_PARTS = 14


def outline_points(detections: DataFrame) -> DataFrame:
    """(case_id, det_id, part, k, lon, lat) of the outer rings of oil detections with parts, arrays of points."""
    oil = detections.where("classification = 'oil'")
    p = oil.select("case_id", "det_id", F.posexplode("parts").alias("part", "ring"))
    return p.select("case_id", "det_id", "part", F.posexplode("ring").alias("k", "p")).select("case_id", "det_id", "part", "k", "p.lon", "p.lat")


def best_feature(detections: DataFrame) -> DataFrame:
    """The oil detection of a case with the most confidence, the first id on a tie."""
    order = Window.partitionBy("case_id").orderBy(F.desc("confidence"), "det_id")
    return detections.where("classification = 'oil'").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def ribbon_measures(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, aspect, coverage, gap_share, perp_share, is_ribbon) of groups of outlines (keys, det_id, lon, lat).

    Points are put on the principal axis of their group; parts must be long and thin together, cover
    the axis, leave no long gap and lie on the line.
    """
    mid = points.groupBy(*keys).agg(F.avg("lat").alias("lat0"))
    xy = points.join(mid, keys).select(*keys, "det_id", (F.col("lon") * F.cos(F.radians("lat0")) * KM_PER_DEG).alias("x"), (F.col("lat") * KM_PER_DEG).alias("y"))
    axis = xy.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y")) / 2).alias("t"))
    on = xy.join(axis, keys).select(*keys, "det_id", ((F.col("x") - F.col("mx")) * F.cos("t") + (F.col("y") - F.col("my")) * F.sin("t")).alias("a"), ((F.col("y") - F.col("my")) * F.cos("t") - (F.col("x") - F.col("mx")) * F.sin("t")).alias("b"))
    whole = on.groupBy(*keys).agg((F.max("a") - F.min("a")).alias("length"), (F.max("b") - F.min("b")).alias("width"))
    part = on.groupBy(*keys, "det_id").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.avg("b").alias("perp"))
    part = part.withColumn("gap", F.lead("lo").over(Window.partitionBy(*keys).orderBy("lo", "det_id")) - F.col("hi"))
    m = part.groupBy(*keys).agg(F.count("*").alias("n_parts"), F.sum(F.col("hi") - F.col("lo")).alias("covered"), F.max("gap").alias("gap"), F.max(F.abs("perp")).alias("perp")).join(whole, keys)
    ratio = lambda a, b: F.col(a) / F.nullif(b, F.lit(0.0))
    m = m.select(*keys, "n_parts", ratio("length", "width").alias("aspect"), ratio("covered", "length").alias("coverage"), F.coalesce(ratio("gap", "length"), F.lit(0.0)).alias("gap_share"), ratio("perp", "width").alias("perp_share"))
    good = (F.col("aspect") >= MIN_ASPECT) & (F.col("coverage") >= MIN_COVERAGE) & (F.col("gap_share") <= MAX_GAP) & (F.col("perp_share") <= MAX_PERP)
    return m.withColumn("is_ribbon", F.coalesce(good, F.lit(False)))


def _is_ribbon(xy: list[np.ndarray]) -> bool:
    pts = np.vstack(xy)
    centre = pts.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((pts - centre).T))
    on = [(q - centre) @ axes[:, ::-1] for q in xy]
    every = np.vstack(on)
    length, width = np.ptp(every[:, 0]), np.ptp(every[:, 1])
    if not length or not width:
        return False
    spans = sorted((q[:, 0].min(), q[:, 0].max()) for q in on)
    gap = max((b[0] - a[1] for a, b in zip(spans, spans[1:], strict=False)), default=0.0)
    return bool(length / width >= MIN_ASPECT and sum(b - a for a, b in spans) / length >= MIN_COVERAGE and gap / length <= MAX_GAP and max(abs(q[:, 1].mean()) for q in on) / width <= MAX_PERP)


def fewest_groups(n: int, valid) -> list[int]:  # noqa: ANN001
    """Bit masks of the fewest valid groups that part n items; single items are always valid."""
    ok = {m for m in range(1, 1 << n) if m.bit_count() == 1 or valid(m)}
    best: list[tuple[int, list[int]]] = [(0, [])]
    for s in range(1, 1 << n):
        low = s & -s
        found = None
        sub = s
        while sub:
            if sub & low and sub in ok and (found is None or best[s ^ sub][0] + 1 < found[0]):
                found = (best[s ^ sub][0] + 1, [sub, *best[s ^ sub][1]])
            sub = (sub - 1) & s
        best.append(found)
    return best[-1][1]


def spill_groups(points: DataFrame) -> DataFrame:
    """(case_id, det_id, group_id): the coarsest parting of a case's outlines into ribbons and single slicks.

    A case with more outlines than MOST_PARTS is an error: its subsets can't be searched.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf["det_id"].unique())
        if len(ids) > MOST_PARTS:
            raise ValueError(f"{len(ids)} oil outlines in one case; at most {MOST_PARTS} can be grouped")
        wide = KM_PER_DEG * np.cos(np.radians(pdf["lat"].mean()))
        xy = [np.stack([q["lon"] * wide, q["lat"] * KM_PER_DEG], axis=1) for q in (pdf[pdf["det_id"] == i] for i in ids)]
        groups = fewest_groups(len(ids), lambda m: _is_ribbon([xy[k] for k in range(len(ids)) if m >> k & 1]))
        rows = [(pdf["case_id"].iloc[0], ids[k], g + 1) for g, m in enumerate(sorted(groups)) for k in range(len(ids)) if m >> k & 1]
        return pd.DataFrame(rows, columns=["case_id", "det_id", "group_id"])

    return points.groupBy("case_id").applyInPandas(one, "case_id string, det_id string, group_id int")


def merged_features(detections: DataFrame, groups: DataFrame) -> DataFrame:
    """One feature for each group, largest first: area summed, centroid weighted by it, class and name of its parts."""
    d = detections.join(groups, ["case_id", "det_id"])
    w = F.coalesce("area_km2", F.lit(0.0))
    one = F.when(F.count_if(F.col("discharge_class") == "chronic") > 0, "chronic").when(F.countDistinct("discharge_class") == 1, F.max("discharge_class")).otherwise("unknown")
    g = d.groupBy("case_id", "group_id").agg(
        F.sum(w).alias("area_km2"), (F.sum(F.col("lon") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("lon"), (F.sum(F.col("lat") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("lat"), one.alias("discharge_class"), F.max("confidence").alias("confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-w).alias("a"), "det_id"))), lambda x: x["det_id"]), "+").alias("id"), F.when(F.count("*") == 1, F.max("elongation")).alias("elongation"),
    )
    return g.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("area_km2"), "group_id")))


def seed_shape(discharge: Column, shape: Column) -> Column:
    """line for a source under way, point for a release at a point; where unknown, by the outline's shape."""
    return F.when(discharge == "chronic", "line").when(discharge == "acute", "point").when(shape == "linear", "line").otherwise("point")


def seed_particles(features: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(case_id, pid, lon, lat) along (case_id, kind, lon, lat, axis_deg, length_km), spread by hash."""
    p = features.withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = F.pmod(F.xxhash64("case_id", "pid", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)) - 0.5
    km = F.when(F.col("kind") == "line", u * F.col("length_km")).otherwise(0.0)
    return p.select("case_id", "pid", (F.col("lon") + km * F.sin(F.radians("axis_deg")) / (KM_PER_DEG * F.cos(F.radians("lat")))).alias("lon"), (F.col("lat") + km * F.cos(F.radians("axis_deg")) / KM_PER_DEG).alias("lat"))
