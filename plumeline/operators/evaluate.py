"""Evaluation: confusion, overlap, intervals, bootstraps, splits and injected trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, keys: list[str], truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """(keys, tp, fp, fn, tn, precision, recall, f1); null where a ratio has no cases."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    ratio = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    return c.select("*", ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", F.col("tp") + F.col("fn")).alias("recall"), (2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f1"))


def scene_recall(df: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Share of scenes with oil in which at least one region was found."""
    s = df.groupBy(scene).agg(F.max("label").alias("label"), F.max(F.col("label") * F.col("predicted")).alias("hit"))
    return s.where("label = 1").agg(F.avg(F.col("hit").cast("double")).alias("scene_recall"), F.count("*").alias("n_scenes"))


def class_rates(df: DataFrame, klass: str, correct: str) -> DataFrame:
    return df.groupBy(klass).agg(F.avg(F.col(correct).cast("double")).alias("rate"), F.count("*").alias("n"))


def overlaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled and mean overlap of scenes (keys, inter, uni, pred, gt), and the dice from pooled counts."""
    return df.groupBy(*keys).agg(
        (F.sum("inter") / F.nullif(F.sum("uni"), F.lit(0))).alias("pooled_iou"), F.avg(F.try_divide(F.col("inter").cast("double"), F.col("uni").cast("double"))).alias("macro_iou"),
        (2 * F.sum("inter") / F.nullif(F.sum(F.col("pred") + F.col("gt")), F.lit(0))).alias("dice"), F.count("*").alias("n"),
    )


def band(share: Column) -> Column:
    """Coverage band of a scene."""
    return F.when(share < 0.01, "<1%").when(share < 0.05, "1-5%").when(share < 0.2, "5-20%").otherwise(">=20%")


def mass_share(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, share) of a total; sums of groups before the window, which then has one row for each group."""
    s = df.groupBy(key).agg(F.sum(value).alias("v"))
    return s.select(key, (F.col("v") / F.nullif(F.sum("v").over(Window.partitionBy(F.lit(0))), F.lit(0))).alias("share"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Interval for a proportion; null without trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n.isNotNull(), F.greatest(mid - half, F.lit(0.0))), F.when(n.isNotNull(), F.least(mid + half, F.lit(1.0)))


def trial_summary(trials: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, abstained, top1, top3, median_rank, lo, hi) of trials (keys, rank, abstained); rates are of the answered."""
    live = ~F.col("abstained")
    s = trials.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("abstained").alias("n_abstained"), F.count_if(live & (F.col("rank") == 1)).alias("hits"), F.count_if(live & (F.col("rank") <= 3)).alias("hits3"), F.median(F.when(live, F.col("rank"))).alias("median_rank"))
    m = F.col("n") - F.col("n_abstained")
    lo, hi = wilson(F.col("hits"), m)
    return s.select(*keys, "n", "n_abstained", (F.col("hits") / F.nullif(m, F.lit(0))).alias("top1"), (F.col("hits3") / F.nullif(m, F.lit(0))).alias("top3"), "median_rank", lo.alias("lo"), hi.alias("hi"))


def bootstrap(df: DataFrame, unit: str, numerator: str, denominator: str, times: int = 2000, seed: int = 0) -> DataFrame:
    """(lo, hi): 95 % interval of a pooled ratio over resampled units; each unit's weight in a draw is Poisson by hash.

    Poisson weights need neither the number of units nor a join on drawn places, so draws are partial sums.
    """
    units = df.groupBy(unit).agg(F.sum(numerator).alias("a"), F.sum(denominator).alias("b"))
    u = F.pmod(F.xxhash64(unit, "draw", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # Cumulative Poisson probabilities for a mean of one, 0 to 6.
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712)
    k = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    drawn = units.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("k", k)
    ratio = drawn.groupBy("draw").agg((F.sum(F.col("k") * F.col("a")) / F.nullif(F.sum(F.col("k") * F.col("b")), F.lit(0))).alias("r"))
    return ratio.agg(F.percentile("r", 0.025).alias("lo"), F.percentile("r", 0.975).alias("hi"))


def running_totals(df: DataFrame, order: str, columns: dict[str, str], parts: int = 256) -> DataFrame:
    """df with running sums (name: column) from the largest value of `order` down, values being distinct.

    No task sorts everything: values are cut into parts at approximate quantiles, running sums are taken
    inside the parts, and the sums of the parts before, at most `parts` rows, are added.
    """
    edges = sorted(set(df.approxQuantile(order, [k / parts for k in range(1, parts)], 0.25 / parts)))
    part = sum((F.when(F.col(order) > e, 1).otherwise(0) for e in edges), F.lit(0)) if len(edges) < 16 else F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < F.col(order)))
    df = df.withColumn("_part", part)
    down = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("_part").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in columns.items()))
    before = sums.select("_part", *(F.coalesce(F.sum(f"_s_{n}").over(down), F.lit(0)).alias(f"_b_{n}") for n in columns))
    inside = Window.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(F.broadcast(before), "_part")
    for n, c in columns.items():
        out = out.withColumn(n, F.sum(c).over(inside) + F.col(f"_b_{n}"))
    return out.drop("_part", *(f"_b_{n}" for n in columns))


def best_threshold(df: DataFrame, score: str = "score", label: str = "label", least_recall: float = 0.0) -> DataFrame:
    """(threshold, f1, precision, recall): the cut with the best F1 among those that keep the recall.

    Scores are summed by value first; the running sum is over distinct scores.
    """
    s = df.groupBy(score).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    total = s.agg(F.sum("p").alias("total"))
    c = running_totals(s, score, {"tp": "p", "k": "n"}).crossJoin(F.broadcast(total)).where("total > 0")
    c = c.select(F.col(score).alias("threshold"), (2 * F.col("tp") / (F.col("k") + F.col("total"))).alias("f1"), (F.col("tp") / F.col("k")).alias("precision"), (F.col("tp") / F.col("total")).alias("recall"))
    return c.where(F.col("recall") >= least_recall).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def stratified_split(units: DataFrame, unit: str, stratum: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """(unit, stratum, fold): folds dealt in turn within each stratum in hash order, so that each has its share.

    A stratum may be most of the rows: ranks are taken in 4096 ranges of hashes, and the counts of
    the ranges before, 4096 rows for each stratum at most, are added.
    """
    cell = ["_stratum", "_range"]
    hashed = units.select(unit, stratum, F.col(stratum).alias("_stratum"), F.xxhash64(unit, F.lit(seed)).alias("_h")).withColumn("_range", F.shiftright("_h", 52))
    below = Window.partitionBy("_stratum").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = hashed.groupBy(*cell).agg(F.count("*").alias("_n")).select(F.col("_stratum").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"))
    ranked = hashed.withColumn("_k", F.row_number().over(Window.partitionBy(*cell).orderBy("_h", unit)) - 1)
    placed = ranked.join(before, F.col("_stratum").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    return placed.select(unit, stratum, F.pmod(F.col("_k") + F.col("_before"), F.lit(folds)).cast("int").alias("fold"))


def scene_labels(rows: DataFrame, scene: str = "scene_id") -> DataFrame:
    return rows.groupBy(scene).agg(F.max("label").alias("label"))


def split_rows(rows: DataFrame, split: DataFrame, fold: int, scene: str = "scene_id") -> tuple[DataFrame, DataFrame]:
    """Training and test rows by scene; no scene is in both."""
    test = split.where(F.col("fold") == fold).select(scene)
    return rows.join(test, scene, "left_anti"), rows.join(test, scene, "left_semi")


def complete_rows(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without a null in the columns, and how many there were and were dropped."""
    null = F.greatest(*(F.col(c).isNull() for c in columns)) if len(columns) > 1 else F.col(columns[0]).isNull()
    return df.dropna(subset=columns), df.agg(F.count("*").alias("n"), F.count_if(null).alias("n_dropped"))


#: What `ablations` leaves out.
ABLATED = ("none", "proximity", "temporality", "trajectory", "gap", "slowdown", "type_prior")


def ablations(components: DataFrame) -> DataFrame:
    """components once whole and once without each component, keyed by `without`."""
    names = F.array(*(F.lit(x) for x in ABLATED))
    return components.withColumn("without", F.explode(names)).where(F.col("component") != F.col("without"))


def ablation_totals(components: DataFrame, value: Column) -> DataFrame:
    """(without, n, total): the candidates and the sum of value of each of the `ablations`, from one row a candidate instead of one for each ablation."""
    c = F.col("component")
    every = components.where(c.isNotNull()).groupBy("case_id", "mmsi").agg(
        F.count("*").alias("_n"), *(F.count_if(c == x).alias(f"_n_{x}") for x in ABLATED[1:]), F.sum(value).alias("_s"), *(F.sum(F.when(c == x, value)).alias(f"_s_{x}") for x in ABLATED[1:]), F.count(value).alias("_m"), *(F.count(F.when(c == x, value)).alias(f"_m_{x}") for x in ABLATED[1:]),
    )
    known = F.col("case_id").isNotNull() & F.col("mmsi").isNotNull()
    left = lambda k, x: F.col(f"_{k}") - F.coalesce(f"_{k}_{x}", F.lit(0)) if x != "none" else F.col(f"_{k}")
    figures = [F.struct(F.lit(x).alias("without"), F.sum(left("n", x)).alias("rows"), F.count_if(known & (left("n", x) > 0)).alias("n"), F.sum(F.when(left("m", x) > 0, left("s", x))).alias("total")) for x in ABLATED]
    return every.agg(F.array(*figures).alias("f")).select(F.inline("f")).where("rows > 0").drop("rows")


def region_model(trees: int = 300, label: str = "label", features: str = "features", weight: str = "w"):  # noqa: ANN201
    """A random forest over region features, classes weighted by their rarity."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(labelCol=label, featuresCol=features, weightCol=weight, numTrees=trees, maxDepth=10, seed=0)


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight w such that classes weigh alike."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    w = n.crossJoin(F.broadcast(total)).select(label, (F.col("t") / (F.col("k") * F.col("n"))).alias("w"))
    return df.join(w, label)
