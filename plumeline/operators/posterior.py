"""Age posteriors on a fixed grid of 288 quarter hours, as rows (keys, age_h, value)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
STEP_H, CELLS = 0.25, 288
MASS, FLOOR, LEAST_GAIN = 0.80, 1e-4, 0.10


def age_grid(spark: SparkSession) -> DataFrame:
    return spark.range(1, CELLS + 1).select((F.col("id") * STEP_H).alias("age_h"))


def _lse(value: str, keys: list[str]):  # noqa: ANN202
    """log of the sum of exponentials over a group, safe against overflow."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    top = F.max(value).over(w)
    return top + F.log(F.sum(F.exp(F.col(value) - top)).over(w))


def log_prior(grid: DataFrame) -> DataFrame:
    """(age_h, lp): uniform in the logarithm of age."""
    return grid.withColumn("lp", -F.log("age_h")).withColumn("lp", F.col("lp") - _lse("lp", []))


def floored(ll: DataFrame, keys: list[str]) -> DataFrame:
    """No age is ruled out: log likelihoods are at least the largest plus log of the floor."""
    return ll.withColumn("ll", F.greatest("ll", F.max("ll").over(Window.partitionBy(*keys)) + math.log(FLOOR)))


def alike_samples(own: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ls, m): distinct values of (keys, ls) and how often they occur, as a row of arrays for each group of a batch."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.select(*keys).schema)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).group_by([*keys, "ls"]).aggregate([([], "count_all")])
            t = t.group_by(keys).aggregate([("ls", "list"), ("count_all", "list")]) if keys else t
            yield from t.select([*keys, "ls_list", "count_all_list"]).rename_columns([*keys, "ls", "m"]).to_batches()

    return own.mapInArrow(gathered, f"{fields}, ls array<double>, m array<bigint>")


def kernel_sums(rows: DataFrame, ages: list[float], keys: list[str], facts: list[str]) -> DataFrame:
    """(keys, age_h, kernel, facts): each row's arrays (ls, m) under Gaussians of width bw, at every age; zero without samples."""
    lg = np.log(np.array(ages))
    kept = rows.select(*keys, *facts, "ls", "m", "bw")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*keys, *facts).schema)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ls, m = b["ls"], b["m"]
            x, times, first, width = ls.flatten().to_numpy(), m.flatten().to_numpy().astype(float), np.append(0, np.cumsum(pc.list_value_length(ls).fill_null(0).to_numpy(zero_copy_only=False))), b["bw"].to_numpy()
            out = np.zeros((b.num_rows, len(lg)))
            for k in range(b.num_rows):
                for at in range(first[k], first[k + 1], 512):
                    to = min(at + 512, first[k + 1])
                    z = np.subtract.outer(lg, x[at:to])
                    z /= width[k]
                    np.multiply(z, z, out=z)
                    z *= -0.5
                    out[k] += np.exp(z, out=z) @ times[at:to]
            out /= (width * math.sqrt(2 * math.pi))[:, None]
            again = pa.array(np.repeat(np.arange(b.num_rows), len(lg)))
            rest = [b[c].take(again) for c in (*keys, *facts)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.tile(ages, b.num_rows)), pa.array(out.ravel())], [*keys, *facts, "age_h", "kernel"])

    return kept.mapInArrow(summed, f"{fields}, age_h double, kernel double")


def kde_log_age(samples: DataFrame, grid: DataFrame, keys: list[str], young_bound: float | None = None, old_bound: float | None = None) -> DataFrame:
    """(keys, age_h, ll): a Gaussian density estimate in the logarithm of age.

    samples: (keys, sample_h, censored), censored being null, 'young' or 'old' for runs that only
    bound the age; those add an even slab beyond their bound. Ages not above zero are dropped. The
    bandwidth is 1.06 sd n^-0.2, at least 0.15. Equal samples of a batch count together, a group's of
    a batch are one row, and each row is summed over all ages in one call.
    """
    told = F.col("censored").isNull() & (F.col("sample_h") > 0)
    ls = F.when(told, F.log("sample_h"))
    bw = F.greatest(F.coalesce(F.stddev_pop(ls), F.lit(0.0)) * 1.06 * F.pow(F.greatest(F.count(ls), F.lit(1)).cast("double"), F.lit(-0.2)), F.lit(0.15))
    counts = samples.where("censored is not null or sample_h > 0").groupBy(*keys).agg(bw.alias("bw"), F.count("*").alias("n"), F.count_if(F.col("censored") == "young").alias("n_young"), F.count_if(F.col("censored") == "old").alias("n_old"))
    alike = alike_samples(samples.where(told).select(*keys, ls.alias("ls")), keys)
    alike = alike.repartition(4 * samples.sparkSession.sparkContext.defaultParallelism, *keys)  # few bytes, much work: adaptive execution would put them in one task
    lg = F.log("age_h")
    wide = grid.withColumn("lg", lg)
    order = Window.orderBy("age_h")
    before, after = F.lag("lg").over(order), F.lead("lg").over(order)
    # gradient with unequal spacing reduces to these for the identity in the index
    wide = wide.withColumn("width", (F.coalesce(after, F.col("lg")) - F.coalesce(before, F.col("lg"))) / F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0))
    low = F.lit(young_bound) if young_bound is not None else F.lit(None).cast("double")
    high = F.lit(old_bound) if old_bound is not None else F.lit(None).cast("double")
    wide = wide.withColumn("in_young", F.coalesce(F.col("age_h") <= low, F.lit(False)).cast("double")).withColumn("in_old", F.coalesce(F.col("age_h") >= high, F.lit(False)).cast("double"))
    slab = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(F.col(c) * F.col("width")).over(Window.partitionBy(F.lit(0))), F.lit(0.0)), F.lit(0.0))
    wide = wide.withColumn("s_young", slab("in_young")).withColumn("s_old", slab("in_old"))
    facts = ["n", "n_young", "n_old"]
    # a group's partial sums are few; by its keys alone they need no further shuffle
    sums = kernel_sums(counts.hint("merge").join(alike, keys, "left"), [r.age_h for r in grid.select("age_h").collect()], keys, facts).repartition(*keys)
    each = sums.groupBy(*keys, "age_h").agg(F.sum("kernel").alias("kernel"), *(F.first(c).alias(c) for c in facts)).join(F.broadcast(wide), "age_h")
    kernel = F.coalesce(F.col("kernel"), F.lit(0.0))
    dens = (kernel + F.col("n_young") * F.col("s_young") + F.col("n_old") * F.col("s_old")) / F.col("n")
    out = each.select(*keys, "age_h", F.when(dens > 0, F.log(dens)).alias("ll"))
    return floored(out.withColumn("ll", F.coalesce("ll", F.lit(-1e300))), keys)


def interpolate_likelihood(candidates: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, age_h, ll) from a few (keys, hours, lik): linear in likelihood over the logarithm of age, ends held."""
    w = Window.partitionBy(*keys).orderBy("hours")
    c = candidates.withColumn("lik", F.greatest("lik", F.lit(0.0)))
    c = c.select(*keys, "hours", "lik", F.lead("hours").over(w).alias("h2"), F.lead("lik").over(w).alias("l2"), F.lag("hours").over(w).alias("h0"))
    g = grid.crossJoin(c)
    at = F.col("age_h")
    inside = (at >= F.col("hours")) & (at < F.col("h2"))
    first, last = F.col("h0").isNull() & (at < F.col("hours")), F.col("h2").isNull() & (at >= F.col("hours"))
    share = (F.log(at) - F.log("hours")) / F.nullif(F.log("h2") - F.log("hours"), F.lit(0.0))
    v = F.when(inside, F.col("lik") + share * (F.col("l2") - F.col("lik"))).otherwise(F.col("lik"))
    got = g.where(inside | first | last).select(*keys, "age_h", F.when(v > 0, F.log(v)).otherwise(-1e300).alias("ll"))
    return floored(got, keys)


def mix_models(lls: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """(keys, age_h, ll): log of the mean of models of one observable, each scaled to a largest value of one."""
    top = F.max("ll").over(Window.partitionBy(*keys, model))
    n = F.size(F.collect_set(model).over(Window.partitionBy(*keys)))
    t = lls.select(*keys, "age_h", (F.col("ll") - top - F.log(n.cast("double"))).alias("t"))
    m = t.groupBy(*keys, "age_h").agg(F.max("t").alias("m"))
    return t.join(m, [*keys, "age_h"]).groupBy(*keys, "age_h").agg((F.first("m") + F.log(F.sum(F.exp(F.col("t") - F.col("m"))))).alias("ll"))


def fuse(terms: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, age_h, p): prior times the terms (keys, age_h, ll, weight); groups without a term have no answer."""
    evidence = terms.where("weight > 0 and ll is not null").groupBy(*keys, "age_h").agg(F.sum(F.col("weight") * F.col("ll")).alias("e"))
    lp = evidence.join(F.broadcast(prior), "age_h").withColumn("lp", F.col("lp") + F.col("e"))
    return lp.withColumn("p", F.exp(F.col("lp") - _lse("lp", keys))).select(*keys, "age_h", "p")


def average(posteriors: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """(keys, age_h, p): weighted mean over hypotheses."""
    s = posteriors.groupBy(*keys, "age_h").agg((F.sum(F.col("p") * F.col(weight)) / F.sum(weight)).alias("p"))
    return s.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*keys)))


def with_cdf(post: DataFrame, keys: list[str]) -> DataFrame:
    return post.withColumn("cdf", F.sum("p").over(Window.partitionBy(*keys).orderBy("age_h").rowsBetween(Window.unboundedPreceding, 0)))


def hpd(post: DataFrame, keys: list[str], mass: float = MASS) -> DataFrame:
    """(keys, lo_h, hi_h, multimodal): the densest ages that hold the mass; the cell that crosses it belongs to them."""
    order = Window.partitionBy(*keys).orderBy(F.desc("p"), F.desc("age_h")).rowsBetween(Window.unboundedPreceding, 0)
    chosen = post.withColumn("cum", F.sum("p").over(order)).where(F.col("cum") - F.col("p") < mass)
    step = F.col("age_h") - F.lag("age_h").over(Window.partitionBy(*keys).orderBy("age_h"))
    return chosen.withColumn("step", step).groupBy(*keys).agg(
        F.greatest(F.min("age_h") - STEP_H / 2, F.lit(0.0)).alias("lo_h"), F.least(F.max("age_h") + STEP_H / 2, F.lit(CELLS * STEP_H)).alias("hi_h"),
        F.coalesce(F.bool_or(F.col("step") > STEP_H * 1.5), F.lit(False)).alias("multimodal"),
    )


def quantile(post: DataFrame, keys: list[str], q: float, name: str = "quantile_h") -> DataFrame:
    """(keys, name): where the running sum reaches q, by linear interpolation; the first age if it does at once."""
    c = with_cdf(post, keys)
    w = Window.partitionBy(*keys).orderBy("age_h")
    c = c.withColumn("c0", F.lag("cdf").over(w)).withColumn("a0", F.lag("age_h").over(w))
    v = F.when(F.col("c0").isNull(), F.col("age_h")).otherwise(F.col("a0") + (F.lit(q) - F.col("c0")) / F.nullif(F.col("cdf") - F.col("c0"), F.lit(0.0)) * (F.col("age_h") - F.col("a0")))
    return c.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("cdf") >= q, F.struct("age_h", v.alias("v"))))["v"], F.max("age_h")).alias(name))


def information_gain(post: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gain_nats): divergence of the posterior from the prior."""
    term = F.when(F.col("p") > 0, F.col("p") * (F.log("p") - F.col("lp"))).otherwise(0.0)
    return post.join(F.broadcast(prior), "age_h").groupBy(*keys).agg(F.sum(term).alias("gain_nats"))


def pit(post: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pit): the running sum at a known age (keys, truth_h), linear between grid ages, ends held."""
    c = with_cdf(post, keys)
    w = Window.partitionBy(*keys).orderBy("age_h")
    c = c.withColumn("a1", F.lead("age_h").over(w)).withColumn("c1", F.lead("cdf").over(w)).withColumn("a0", F.lag("age_h").over(w))
    j = c.join(truths, keys)
    t = F.col("truth_h")
    inside = (t >= F.col("age_h")) & (t < F.col("a1"))
    at_end = (F.col("a0").isNull() & (t < F.col("age_h"))) | (F.col("a1").isNull() & (t >= F.col("age_h")))
    v = F.when(inside, F.col("cdf") + (t - F.col("age_h")) / (F.col("a1") - F.col("age_h")) * (F.col("c1") - F.col("cdf"))).otherwise(F.col("cdf"))
    return j.where(inside | at_end).select(*keys, v.alias("pit"))


def summarise(post: DataFrame, prior: DataFrame, keys: list[str], least_gain: float = LEAST_GAIN) -> DataFrame:
    """Band, median, mode and gain by group, in one pass over it; status 'none' where the evidence barely moved the prior. The parts are those of hpd, quantile and information_gain."""
    by_age, by_p = Window.partitionBy(*keys).orderBy("age_h"), Window.partitionBy(*keys).orderBy(F.desc("p"), F.desc("age_h"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    c = post.join(F.broadcast(prior), "age_h", "left").withColumn("dense", F.sum("p").over(upto(by_p)) - F.col("p") < MASS)
    held = F.when(F.col("dense"), F.col("age_h"))
    c = c.withColumns({"cdf": F.sum("p").over(upto(by_age)), "held": held, "before": F.last(held, ignorenulls=True).over(by_age.rowsBetween(Window.unboundedPreceding, -1))})
    c = c.withColumns({"c0": F.lag("cdf").over(by_age), "a0": F.lag("age_h").over(by_age)})
    middle = F.when(F.col("c0").isNull(), F.col("age_h")).otherwise(F.col("a0") + (F.lit(0.5) - F.col("c0")) / F.nullif(F.col("cdf") - F.col("c0"), F.lit(0.0)) * (F.col("age_h") - F.col("a0")))
    term = F.when(F.col("lp").isNotNull(), F.when(F.col("p") > 0, F.col("p") * (F.log("p") - F.col("lp"))).otherwise(0.0))
    out = c.groupBy(*keys).agg(
        F.greatest(F.min("held") - STEP_H / 2, F.lit(0.0)).alias("lo_h"), F.least(F.max("held") + STEP_H / 2, F.lit(CELLS * STEP_H)).alias("hi_h"),
        F.coalesce(F.bool_or(F.when(F.col("dense"), F.col("age_h") - F.col("before") > STEP_H * 1.5)), F.lit(False)).alias("multimodal"),
        F.coalesce(F.min(F.when(F.col("cdf") >= 0.5, F.struct("age_h", middle.alias("v"))))["v"], F.max("age_h")).alias("median_h"),
        F.max_by("age_h", F.struct("p", (-F.col("age_h")).alias("a"))).alias("mode_h"), F.sum(term).alias("gain_nats"), F.count("held").alias("n_held"), F.count("lp").alias("n_lp"),
    ).where("n_held > 0 and n_lp > 0").drop("n_held", "n_lp")
    return out.withColumn("status", F.when(F.col("gain_nats") < least_gain, "none").otherwise("ok"))


def combine_bands(bands: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo_h, hi_h, how): the overlap of all bands, or, where there is none, their union as a disagreement."""
    a = bands.where("lo_h is not null and hi_h is not null").groupBy(*keys).agg(F.max("lo_h").alias("l"), F.min("hi_h").alias("h"), F.min("lo_h").alias("ul"), F.max("hi_h").alias("uh"), F.count("*").alias("n"))
    meet = F.col("l") < F.col("h")
    how = F.when(F.col("n") == 1, "single").when(meet, "combined").otherwise("disagreement")
    return a.select(*keys, F.when(meet, F.col("l")).otherwise(F.col("ul")).alias("lo_h"), F.when(meet, F.col("h")).otherwise(F.col("uh")).alias("hi_h"), how.alias("how"))
