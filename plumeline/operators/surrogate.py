"""Quantiles of a slick's age by boosted trees on histograms of Spark aggregates, and the likelihood made of them.

The models of all quantiles, with all fields and with each field left out, grow in the same passes: a
pass counts rows by model, node, feature and bin, the driver picks splits from these counts (as many as
models, nodes, features and bins, whatever the rows), and a last pass of the tree takes the quantile of
the residuals in each leaf. Counts are integers, so splits don't depend on how rows are parted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import posterior

# Fixed values.
QUANTILES = (0.1, 0.5, 0.9)
Z90 = 1.2815515655446004
LEAST_SD = 0.1

ACCURACY = 10_000  # leaves of up to half as many rows have exact quantiles, others a rank within a ten-thousandth
NONE = -1


@dataclass(frozen=True)
class Surrogate:
    """Trees of every model; ``models`` holds (quantile, the code of the field left out or -1)."""

    fields: list[str]
    models: list[tuple[float, int]]
    edges: list[list[float]]
    base: np.ndarray  # model
    feature: np.ndarray  # tree, model, node
    cut: np.ndarray  # tree, model, node: bins up to it go left
    value: np.ndarray  # tree, model, leaf

    def to_json(self) -> str:
        return json.dumps({"fields": self.fields, "models": self.models, "edges": self.edges} | {k: getattr(self, k).tolist() for k in ("base", "feature", "cut", "value")})

    @staticmethod
    def from_json(text: str) -> Surrogate:
        d = json.loads(text)
        return Surrogate(d["fields"], [(float(q), int(c)) for q, c in d["models"]], d["edges"], np.array(d["base"]), np.array(d["feature"], np.int64), np.array(d["cut"], np.int64), np.array(d["value"], float))

    def save(self, spark, path: str) -> None:  # noqa: ANN001
        spark.createDataFrame([(self.to_json(),)], "body string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> Surrogate:  # noqa: ANN001
        return Surrogate.from_json(spark.read.parquet(path).first()["body"])


def features(slicks: DataFrame) -> DataFrame:
    """slicks with x: logs of length, width, their ratio and area, chronic, acute, current, wind, log of strain.

    Reads length_km, width_km, area_km2, discharge_class, current, wind and strain. x is null unless length
    and width lie above zero; an area that is null or zero is length times width.
    """
    length, width = F.col("length_km").cast("double"), F.col("width_km").cast("double")
    area = F.coalesce(F.nullif(F.col("area_km2").cast("double"), F.lit(0.0)), length * width)
    kind = [F.coalesce(F.col("discharge_class") == k, F.lit(False)).cast("double") for k in ("chronic", "acute")]
    x = F.array(F.log(length), F.log(width), F.log(length / width), F.log(F.greatest(area, F.lit(1e-4))), *kind, F.col("current").cast("double"), F.col("wind").cast("double"), F.log(F.greatest(F.col("strain").cast("double"), F.lit(1e-9))))
    return slicks.withColumn("x", F.when((length > 0) & (width > 0) & ~F.isnan(length) & ~F.isnan(width), x))


def _columns(x: str, k: int) -> list[Column]:
    """The k numbers of x; NaN is null, and so are all where x has another length."""
    return [F.when(F.size(x) == k, F.nanvl(F.col(x)[j].cast("double"), F.lit(None).cast("double"))).alias(f"x{j}") for j in range(k)]


def _binned(columns: list[np.ndarray], edges: list[list[float]]) -> np.ndarray:
    """Bin 0 for what is missing, else one more than the number of edges below the value."""
    out = np.zeros((len(columns[0]), len(edges)), np.uint8)
    for j, (v, e) in enumerate(zip(columns, edges, strict=True)):
        out[:, j] = np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(e, float), v, "left"))
    return out


def _leaf(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """(row, model): the node at a depth of one tree of each model."""
    rows, models = np.arange(len(bins))[:, None], np.arange(len(feature))[None, :]
    at = np.zeros((len(bins), len(feature)), np.int64)
    for d in range(depth):
        node = at + (1 << d) - 1
        at = 2 * at + (bins[rows, feature[models, node]] > cut[models, node])
    return at


def _boosted(p: np.ndarray, bins: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """p with the trees' values added in their order."""
    models = np.arange(p.shape[1])[None, :]
    for feature, cut, value in trees:
        p = p + value[models, _leaf(bins, feature, cut, int(math.log2(value.shape[1])))]
    return p


def _rows(batch: pa.RecordBatch, k: int, models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    code, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, k)
    return code, y, bins, np.frombuffer(b"".join(batch.column(3).to_pylist()), float).reshape(-1, models)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _counting(left: np.ndarray, k: int, width: int, trees: list, feature: np.ndarray, cut: np.ndarray, depth: int) -> Task:  # noqa: PLR0913
    """A task's rows by model, node, feature and bin, and how many of them lie below their prediction."""
    nodes, models = 1 << depth, len(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = nodes * k * width
        n, below = np.zeros((models, size), np.int64), np.zeros((models, size), np.int64)
        for batch in batches:
            code, y, bins, p = _rows(batch, k, models)
            p, at = _boosted(p, bins, trees), _leaf(bins, feature, cut, depth)
            for m in range(models):
                use = code != left[m]
                key = (at[use, m, None] * k + np.arange(k)) * width + bins[use]
                n[m] += np.bincount(key.ravel(), minlength=size)
                below[m] += np.bincount(key[y[use] < p[use, m]].ravel(), minlength=size)
        key = np.flatnonzero(n.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.ravel()[key]), pa.array(below.ravel()[key])], ["key", "n", "below"])

    return run


def _remainders(left: np.ndarray, k: int, trees: list, feature: np.ndarray, cut: np.ndarray, depth: int) -> Task:  # noqa: PLR0913
    """(key, v): what each row is away from its prediction, by model and leaf."""
    leaves, models = 1 << depth, len(left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, y, bins, p = _rows(batch, k, models)
            p, at = _boosted(p, bins, trees), _leaf(bins, feature, cut, depth)
            for m in range(models):
                use = code != left[m]
                yield pa.RecordBatch.from_arrays([pa.array(m * leaves + at[use, m]), pa.array(y[use] - p[use, m])], ["key", "v"])

    return run


def _splits(n: np.ndarray, below: np.ndarray, quantiles: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, cut) of each (model, node) from counts (model, node, feature, bin).

    The gain is that of squared sums of the pinball loss's slopes; the first feature and the least bin win
    ties. A node without a gain sends all rows left.
    """
    models, nodes, k, width = n.shape
    q = quantiles[:, None, None, None]
    nl, bl = n.cumsum(3), below.cumsum(3)
    n0, b0 = nl[:, :, :1, -1:], bl[:, :, :1, -1:]
    nr, br = n0 - nl, b0 - bl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (q * nl - bl) ** 2 / nl + (q * nr - br) ** 2 / nr - (q * n0 - b0) ** 2 / n0
    gain = np.where((nl >= max(least, 1)) & (nr >= max(least, 1)), gain, 0.0).reshape(models, nodes, k * width)
    best = gain.argmax(2)
    real = np.take_along_axis(gain, best[:, :, None], 2)[:, :, 0] > 1e-9
    return np.where(real, best // width, 0), np.where(real, best % width, width)


def fit(twins: DataFrame, *, x: str = "x", y: str = "y", field: str = "field", quantiles: tuple[float, ...] = QUANTILES, leave_out: bool = True, rounds: int = 200, rate: float = 0.05, levels: int = 3, least: int = 8, bins: int = 64, most_fields: int = 64, every: int = 20) -> Surrogate:  # noqa: PLR0913
    """Boosted trees for each quantile of y, over all twins and over those of all fields but one.

    A row without a finite y, without a field or without x trains nothing; a missing number of x is below all
    cuts. Features are cut at up to ``bins`` - 1 quantiles of theirs. Predictions are written anew after
    ``every`` rounds and otherwise made from the trees, so a lost executor costs a read. No rows give no
    trees, whose predictions are null. More fields than ``most_fields`` are an error, as models grow with them.
    """
    if not 2 <= bins <= 255:
        raise ValueError("bins must lie between 2 and 255")
    good = twins.select(F.col(field).cast("string").alias("field"), F.col(y).cast("double").alias("y"), F.col(x).alias("x")).where("field is not null and x is not null and y is not null and not isnan(y) and abs(y) < double('inf')")
    k = good.agg(F.max(F.size("x"))).first()[0] or 0
    if not k:
        return Surrogate([], [(q, NONE) for q in quantiles], [], np.full(len(quantiles), np.nan), *(np.zeros((0, len(quantiles), 1), int) for _ in range(2)), np.zeros((0, len(quantiles), 1)))
    good = good.where(F.size("x") == k).select("field", "y", *_columns("x", k))
    names = [r[0] for r in good.select("field").distinct().limit(most_fields + 1).collect()] if leave_out else []
    if len(names) > most_fields:
        raise ValueError(f"more than {most_fields} fields")
    names.sort()
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    found = good.agg(*(F.percentile_approx(f"x{j}", shares, ACCURACY).alias(f"x{j}") for j in range(k))).first()
    edges = [sorted(set(v or [])) for v in found]
    width = bins + 1
    models = [(q, c) for c in [NONE, *range(len(names))] for q in quantiles]
    left = np.array([c if c != NONE else -2 for _, c in models])
    qs = np.array([q for q, _ in models])
    codes = F.create_map(*(F.lit(v) for i, s in enumerate(names) for v in (s, i))) if names else None
    coded = good.select((codes[F.col("field")] if names else F.lit(0)).cast("int").alias("f"), "y", *(f"x{j}" for j in range(k)))
    size = len(models)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _binned([batch.column(2 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(k)], edges)
            zero = np.zeros(size).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in made], pa.binary()), pa.array([zero] * len(made), pa.binary())], ["f", "y", "b", "p"])

    schema = "f int, y double, b binary, p binary"
    state = staged(coded.mapInArrow(start, schema), "surrogate")

    def quantile_of(trees: list, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        of = F.percentile_approx("v", F.array(*(F.lit(q) for q in quantiles)), ACCURACY)
        got = state.mapInArrow(_remainders(left, k, trees, feature, cut, depth), "key long, v double").groupBy("key").agg(of.alias("v")).collect()
        out = np.zeros(size << depth)
        for r in got:
            out[r["key"]] = r["v"][quantiles.index(models[r["key"] >> depth][0])]
        return out.reshape(size, 1 << depth)

    none = np.zeros((size, 1), np.int64)
    base = quantile_of([], none, none, 0)
    trees, pending = [], [(none, none, base)]
    for r in range(rounds):
        feature, cut = np.zeros((size, (1 << levels) - 1), np.int64), np.full((size, (1 << levels) - 1), width)
        for d in range(levels):
            got = state.mapInArrow(_counting(left, k, width, pending, feature, cut, d), "key long, n long, below long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("below").alias("below")).toPandas()
            n, below = np.zeros((2, (size << d) * k * width), np.int64)
            n[got["key"]], below[got["key"]] = got["n"], got["below"]
            shape = (size, 1 << d, k, width)
            at = slice((1 << d) - 1, (2 << d) - 1)
            feature[:, at], cut[:, at] = _splits(n.reshape(shape), below.reshape(shape), qs, least)
        tree = (feature, cut, rate * quantile_of(pending, feature, cut, levels))
        trees.append(tree)
        pending = [*pending, tree]
        if len(pending) >= every and r + 1 < rounds:
            state = staged(state.mapInArrow(_advance(k, size, pending), schema), "surrogate")
            pending = []
    stacked = [np.stack([t[i] for t in trees]) if trees else np.zeros((0, size, 1)) for i in range(3)]
    return Surrogate(names, models, edges, base[:, 0], stacked[0].astype(int), stacked[1].astype(int), stacked[2])


def _advance(k: int, models: int, trees: list) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, bins, p = _rows(batch, k, models)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in _boosted(p, bins, trees)], pa.binary())], ["f", "y", "b", "p"])

    return run


def predict(df: DataFrame, model: Surrogate, *, x: str = "x", field: str | None = None, name: str = "q") -> DataFrame:
    """df with an array of the quantiles, in the model's order; null where x is null or has another length.

    With ``field`` each row is judged by the models that never saw its field; a field that no model left out
    (or null, which trains nothing) is judged by the models over all. A column of the name is replaced.
    """
    k, trees = len(model.edges), list(zip(model.feature, model.cut, model.value, strict=True))
    if not k:
        return df.withColumn(name, F.lit(None).cast("array<double>"))
    of = {c: np.array([i for i, m in enumerate(model.models) if m[1] == c]) for c in {c for _, c in model.models}}
    edges, base, each = model.edges, model.base, len(of[NONE])

    def quantiles(code: pd.Series, *columns: pd.Series) -> pd.Series:
        bins = _binned([c.to_numpy(float) for c in columns], edges)
        out = np.zeros((len(bins), each))
        c = code.to_numpy()
        for one in np.unique(c):
            m, rows = of[int(one)], c == one
            out[rows] = _boosted(np.tile(base[m], (int(rows.sum()), 1)), bins[rows], [(f[m], t[m], v[m]) for f, t, v in trees])
        return pd.Series(list(out))

    codes = F.create_map(*(F.lit(v) for i, s in enumerate(model.fields) for v in (s, i))) if field and model.fields else None
    code = F.coalesce(codes[F.col(field).cast("string")], F.lit(NONE)) if codes is not None else F.lit(NONE)
    made = F.pandas_udf(quantiles, "array<double>")(code.cast("int"), *_columns(x, k))
    return df.withColumn(name, F.when(F.size(x) == k, made))


def log_likelihood(judged: DataFrame, grid: DataFrame, keys: list[str], name: str = "q") -> DataFrame:
    """(keys, age_h, ll): a log-normal with the quantiles 0.1, 0.5 and 0.9 of log age, without the prior it holds; rows without quantiles have none."""
    q = F.col(name)
    sd = F.greatest((F.greatest(q[0], q[2]) - F.least(q[0], q[2])) / (2 * Z90), F.lit(LEAST_SD))
    rows = judged.where(q.isNotNull()).select(*keys, q[1].alias("_m"), sd.alias("_sd")).crossJoin(F.broadcast(posterior.log_prior(grid)))  # 288 ages
    z = (F.log("age_h") - F.col("_m")) / F.col("_sd")
    return posterior.floored(rows.select(*keys, "age_h", (-0.5 * z * z - F.col("lp")).alias("ll")), keys)


def evaluate(judged: DataFrame, grid: DataFrame, keys: list[str], field: str = "field", y: str = "y", name: str = "q") -> DataFrame:
    """(field, n, coverage, log_score, log2_error, prior_log_score) of rows judged by models that left their field out.

    Coverage is the share of ages inside the densest 0.8, the error a median, scores are means of log
    probability at the grid's nearest age (the younger of two). Keys must be unique; rows without y or quantiles are left out.
    """
    rows = judged.where(F.col(name).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(field).alias("field"), F.col(y).alias("y"), F.col(name).alias("q"))
    step = posterior.STEP_H
    truth = rows.withColumn("t", F.exp("y")).withColumn("age_h", F.least(F.greatest(F.ceil(F.col("t") / step - 0.5), F.lit(1)), F.lit(posterior.CELLS)) * F.lit(step))
    prior = posterior.log_prior(grid)
    post = posterior.fuse(log_likelihood(rows, grid, keys, "q").withColumn("weight", F.lit(1.0)), prior, keys)
    at = truth.join(post, [*keys, "age_h"]).join(F.broadcast(prior), "age_h").join(posterior.hpd(post, keys), keys)
    low = F.lit(1e-12)
    return at.groupBy("field").agg(
        F.count("*").alias("n"), F.avg(F.col("t").between(F.col("lo_h"), F.col("hi_h")).cast("double")).alias("coverage"), F.avg(F.log(F.greatest("p", low))).alias("log_score"),
        F.percentile(F.abs(F.col("q")[1] - F.col("y")) / math.log(2), 0.5).alias("log2_error"), F.avg("lp").alias("prior_log_score"),
    )
