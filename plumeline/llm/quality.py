"""Quality scores of texts from a regularised quadratic discriminant over document statistics.

Each class has a Gaussian over transformed statistics; its covariance shrinks towards the pooled one
and towards a multiple of the identity. A score is the posterior of class 1, from the difference of
Mahalanobis log densities under Cholesky factors that are computed once and sent with the task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import fold_column, pick, pieces, text_bytes

PIECE_BYTES = 2_000_000
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
DIGIT = bytes(range(48, 58))
SPACE = b" \t\n\x0b\x0c\r"
STOPS = b".,;:?'\"-()"
#: Marks that running prose hardly has.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in STOPS)
#: The least score that counts as class 1.
THRESHOLD = 0.3
STATISTICS = (
    "words", "mean_word", "sd_word", "upper", "digit", "stops", "marks", "exclaims", "pipes", "distinct",
    "top_word", "repeats", "line_length", "line_repeats", "short_words", "marked_words", "entropy", "compression", "bigram_distinct",
)
D = len(STATISTICS)


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of one text, in the order of STATISTICS; null counts as empty."""
    text = text or b""
    size = len(text)
    left = lambda drop: size - len(text.translate(None, drop))
    w = text.split()
    n = len(w)
    lengths = np.fromiter(map(len, w), np.float64, n)
    low = text.lower().split()
    counts = Counter(low)
    upper, lower, digit, stops, marks = left(UPPER), left(LOWER), left(DIGIT), left(STOPS), left(MARKS)
    solid = max(size - left(SPACE), 1)
    lines = [x for x in text.split(b"\n") if x]
    rest = text.translate(None, LOWER + UPPER + DIGIT + SPACE)
    ends = sum(1 for x in w if x[-1] in MARKS)
    shares = np.fromiter(counts.values(), np.float64, len(counts)) / max(n, 1)
    share = lambda a, b: float(np.sqrt(a / max(b, 1)))
    return [
        float(np.log1p(n)),
        float(np.log1p(lengths.mean())) if n else 0.0,
        float(np.log1p(lengths.std())) if n else 0.0,
        share(upper, upper + lower),
        share(digit, solid),
        share(stops, solid),
        share(marks, solid),
        share(rest.count(b"!"), n),
        share(rest.count(b"|"), n),
        float(len(counts) / n) if n else 1.0,
        share(max(counts.values(), default=0), n),
        share(sum(map(eq, low, low[1:])), n),
        float(np.log1p(size / max(len(lines), 1))),
        share(len(lines) - len(set(lines)), len(lines)),
        share(int((lengths <= 3).sum()), n),
        share(ends, n),
        float(-(shares * np.log(shares)).sum() / np.log(n)) if n > 1 else 1.0,
        float(np.log(len(zstandard.compress(text, 1)) / size)) if size else 0.0,
        float(len(set(zip(low, low[1:], strict=False))) / (n - 1)) if n > 1 else 1.0,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for docs with columns doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_bytes(batch.column(1)), PIECE_BYTES):
                x = [statistics(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Discriminant:
    """Means, cached Cholesky factors, log determinants and log priors of the two classes."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row of x."""
        dens = []
        for k in range(2):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            dens.append(self.log_prior[k] - 0.5 * (np.einsum("ij,ij->j", z, z) + self.log_det[k]))
        return 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -500, 500)))


def fit(count: np.ndarray, total: np.ndarray, square: np.ndarray, pooled: float, identity: float) -> Discriminant:
    """A discriminant from each class's count, sum and sum of outer products.

    pooled, identity: shares of the pooled covariance and of its mean variance in a class's own. A
    class without rows takes the other's Gaussian, so that scores are the prior; without any rows
    scores are one half.
    """
    n = np.maximum(count, 1)
    mean = total / n[:, None]
    scatter = square - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    every = scatter[count > 0].sum(axis=0) / max(count.sum(), 1)
    every += 1e-6 * np.eye(D)
    factor, log_det = [], []
    for k in range(2):
        own = (1 - pooled) * scatter[k] / n[k] + pooled * every if count[k] else every
        own = (1 - identity) * own + identity * np.diag(np.diag(every))
        c = np.linalg.cholesky(own)
        factor.append(c)
        log_det.append(2 * np.log(np.diag(c)).sum())
    if count.min() == 0:
        k = int(np.argmax(count))
        mean, factor, log_det = mean[[k, k]], [factor[k]] * 2, [log_det[k]] * 2
    prior = np.log((count + 1) / (count.sum() + 2))
    return Discriminant(mean, np.stack(factor), np.array(log_det), prior)


def class_sums(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and outer products of x for label 0 and 1; sums are made where the rows are.

    Only 2 x (1 + D + D x D) numbers come to the driver, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + D + D * D))
        for b in batches:
            x = np.array(b.column(0).flatten()).reshape(-1, D)
            y = np.array(b.column(1))
            for k in range(2):
                own = x[y == k]
                sums[k] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        k, at = np.divmod(np.arange(sums.size), sums.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(sums.ravel())], ["k", "at", "v"])

    rows = labelled.select("x", "label").mapInArrow(run, "k long, at long, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + D + D * D))
    for r in rows:
        sums[r.k, r.at] = r.v
    return sums[:, 0], sums[:, 1 : 1 + D], sums[:, 1 + D :].reshape(2, D, D)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id", folds: int = 5, held_out: int = 0, pooled: float = 0.3, identity: float = 0.02, threshold: float = THRESHOLD, carry: str | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, held_out, score, predicted), and the column `carry` with the text if named.

    Learns from all labelled rows whose id has not the crc32 remainder `held_out` modulo `folds`;
    labels other than 0 and 1 are ignored, repeated labels count each. score is the posterior of
    label 1, predicted is 1 from `threshold` up. A null text counts as empty and is scored like any
    other; a null id finds no label. Without labels every score is one half. Inputs of a score are
    the statistics of the text and nothing else. With `carry` texts are read a second time to be scored
    on their way, as storing them with their statistics would take their size on disk.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    named = {"doc_id": id_col, "text": text_col} | ({"carried": carry} if carry else {})
    seen = scratch.write(document_statistics(pick(docs, doc_id=id_col, text=text_col)), "statistics")
    known = pick(labels, doc_id=label_id_col, label=label_col).where("label in (0, 1)")
    train = known.where(fold_column(F.col("doc_id"), folds) != held_out).select("doc_id", F.col("label").cast("int").alias("label"))
    model = fit(*class_sums(seen.join(train, "doc_id")), pooled, identity)

    @F.pandas_udf("double")
    def posterior(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_list())) if len(x) else np.zeros(0))

    @F.pandas_udf("double")
    def text_posterior(texts: pd.Series) -> pd.Series:
        x = [statistics(None if t is None else t.encode()) for t in texts]
        return pd.Series(model.score(np.array(x).reshape(-1, D)))

    more = ["carried", "text"] if carry else []
    rows, score = (pick(docs, **named), text_posterior("text")) if carry else (seen, posterior("x"))
    out = rows.select("doc_id", (fold_column(F.col("doc_id"), folds) == held_out).alias("held_out"), score.alias("score"), *more)
    out = out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)
    return out.withColumnRenamed("carried", carry) if carry else out
