"""Maximum inner product search with score-aware (anisotropic) four-bit product quantisation.

The codebooks minimise a loss that weighs the part of a residual parallel to its vector more than the
orthogonal part, since the parallel part is what changes the large inner products. A vector has one
four-bit code for every two dimensions, two to a byte. A search sums table entries over the bytes,
takes the best of each block by that score, and reranks them by the exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import pick

#: Vectors that the codebooks are fitted on, the first by a hash of their ids; all vectors are indexed.
SAMPLE = 8192
BLOCK = 8192
#: Vectors of each block that are reranked for a query, and all that tie with the last of them.
RERANK = 128
#: Queries of a block, which a task holds while vectors pass by.
QUERIES = 8192
#: Groups that blocks are dealt to at least, if there are so many blocks, and blocks of a group.
GROUPS, GROUP_BLOCKS = 64, 1024
CODES = 16


@dataclass
class Quantiser:
    """books: (dimensions / 2, 16, 2); ratio: how much more the parallel residual counts, less one."""

    books: np.ndarray
    ratio: float

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (n, parts) by coordinate descent on the anisotropic loss."""
        parts = self.books.shape[0]
        sub = _halves(x, parts)
        norm = np.maximum((x * x).sum(axis=1), 1e-300)
        dist = ((sub[:, :, None, :] - self.books[None]) ** 2).sum(axis=3)
        along = (sub * sub).sum(axis=2)[:, :, None] - np.einsum("nmd,mkd->nmk", sub, self.books)
        codes = dist.argmin(axis=2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(rounds):
            for m in range(parts):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (dist[:, m] + self.ratio / norm[:, None] * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[rows, m, codes[:, m]]
        return codes

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(bytes, 256) sums of a query's products with the two codes of a byte."""
        t = np.einsum("md,mkd->mk", _halves(q[None], self.books.shape[0])[0], self.books)
        if len(t) % 2:
            t = np.vstack([t, np.zeros((1, CODES))])
        return (t[0::2, :, None] + t[1::2, None, :]).reshape(-1, CODES * CODES)


def _halves(x: np.ndarray, parts: int) -> np.ndarray:
    wide = np.zeros((len(x), 2 * parts))
    wide[:, : x.shape[1]] = x
    return wide.reshape(len(x), parts, 2)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte, by byte: (bytes, n)."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), codes.dtype)])
    return np.ascontiguousarray((codes[:, 0::2] * CODES + codes[:, 1::2]).astype(np.uint8).T)


def fit_quantiser(x: np.ndarray, threshold: float = 0.2, rounds: int = 4, seed: int = 7) -> Quantiser:
    """Codebooks for vectors like x; inner products above `threshold` of the norms are the ones that matter."""
    d = x.shape[1]
    parts = -(-d // 2)
    sub = _halves(x, parts)
    rng = np.random.default_rng(seed)
    books = np.stack([sub[rng.integers(0, len(x), CODES), m] for m in range(parts)])
    books += rng.normal(scale=1e-9, size=books.shape)
    for _ in range(6):  # plain k-means to begin with
        near = ((sub[:, :, None, :] - books[None]) ** 2).sum(axis=3).argmin(axis=2)
        for m in range(parts):
            n = np.bincount(near[:, m], minlength=CODES)
            mean = np.stack([np.bincount(near[:, m], sub[:, m, k], CODES) for k in range(2)], axis=1) / np.maximum(n, 1)[:, None]
            books[m] = np.where(n[:, None] > 0, mean, books[m])
    ratio = max((d - 1) * threshold**2 / (1 - threshold**2) - 1, 0.0)
    out = Quantiser(books, ratio)
    weight = ratio / np.maximum((x * x).sum(axis=1), 1e-300)
    for _ in range(rounds):
        codes = out.encode(x, 1)
        for m in range(parts):
            chosen = np.take_along_axis(out.books, codes.T[:, :, None], 1).transpose(1, 0, 2)
            along = ((sub - chosen) * sub).sum(axis=2)
            rest = along.sum(axis=1) - along[:, m]
            s, c = sub[:, m], codes[:, m]
            by = lambda v: np.bincount(c, v, CODES)  # noqa: E731, B023
            left = np.zeros((CODES, 2, 2))
            for i in range(2):
                for j in range(2):
                    left[:, i, j] = by((i == j) + weight * s[:, i] * s[:, j])
            goal = rest + (s * s).sum(axis=1)
            right = np.stack([by(s[:, i] * (1 + weight * goal)) for i in range(2)], axis=1)
            used = by(np.ones(len(x))) > 0
            out.books[m][used] = np.linalg.solve(left[used] + 1e-12 * np.eye(2), right[used][:, :, None])[:, :, 0]
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


def search_block(z: Quantiser, packed: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_id: int, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of a block's best vectors for one query, itself left out.

    All vectors that tie with the last one to be reranked are reranked too, so that copies are told
    apart by their ids and not by their places.
    """
    if len(ids) > rerank + 1:
        score = np.zeros(len(ids))
        for table, code in zip(z.tables(q), packed, strict=True):
            score += table.take(code)
        at = len(ids) - rerank - 1
        some = np.flatnonzero(score >= np.partition(score, at)[at])
    else:
        some = np.arange(len(ids))
    some = some[ids[some] != q_id]
    exact = (x[some] * q).sum(axis=1)
    top = _best(exact, ids[some], k)
    return ids[some][top], exact[top]


def _cells(blocks: DataFrame, asked: DataFrame, groups: int, n_asked: int) -> DataFrame:
    """Rows of data and of queries dealt to cells (c, g): each group of blocks meets each block of queries once.

    Of the queries a cell gets its block `c` first; its vectors follow.
    """
    data = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("c"), F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"), F.lit(1).cast("byte").alias("kind"), "ids", "codes", "x")
    queries = asked.select("c", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(0).cast("byte").alias("kind"), "ids", F.lit(None).cast("binary").alias("codes"), "x")
    return data.union(queries).repartition("c", "g").sortWithinPartitions("c", "g", "kind")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, rerank: int = RERANK, threshold: float = 0.2, queries_at_a_time: int = QUERIES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k best of all other rows by inner product.

    Queries are the rows whose id is divisible by `every`. Vectors that are null or zero, or hold a
    null or non-finite component, take no part, nor do rows with a null id or with another number of
    components than most rows have. Scores are double-precision products of the original vectors,
    ties go to the smaller id. Equal vectors are rows of their own; of rows with the query's own id
    none is an answer to it, and a repeated id is searched for once per row but ranked together.
    Other columns are left out. Without vectors there are no rows. Recall is that of the block-wise
    reranking: blocks of up to `rerank` vectors are searched exactly.

    Vectors stand in blocks of `block`, queries in blocks of about `queries_at_a_time`; both are
    rows of tables, paired in cells, and a cell keeps only the k best of each of its queries. The
    driver sees the sample that the codebooks are fitted on, and numbers of blocks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    v = pick(vectors, vec_id=id_col, x=vector_col)
    single = v.schema["x"].dataType.simpleString() == "array<float>"
    kind = np.dtype(np.float32 if single else np.float64)
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast(f"array<{'float' if single else 'double'}>").alias("x")).where("vec_id is not null and size(x) > 0")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.where(~bad & F.exists("x", lambda c: c != 0))
    out = "query_id long, vec_id long, score double"
    usual = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    none = lambda: spark.createDataFrame([], f"{out}, rank int").select("query_id", "rank", "vec_id", "score")
    if usual is None:
        return none()
    d = int(usual["d"])
    v = v.where(F.size("x") == d)
    queries = v.where(F.col("vec_id") % every == 0)
    n_asked = -(-queries.count() // queries_at_a_time)
    if not n_asked:
        return none()
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toPandas()["x"].tolist()
    z = fit_quantiser(np.array(sample, np.float64), threshold)
    sent = spark.sparkContext.broadcast((z.books, z.ratio))
    flat = lambda column: column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
    whole = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = Quantiser(*sent.value)
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                x = flat(part.column(1))
                yield pa.RecordBatch.from_arrays([whole(part.column(0).to_numpy()), whole(pack_codes(z.encode(x.astype(np.float64)))), whole(x)], ["ids", "codes", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = pa.array([TaskContext.get().partitionId()], pa.int32())
        for b in batches:
            yield pa.RecordBatch.from_arrays([c, whole(b.column(0).to_numpy()), whole(flat(b.column(1)))], ["c", "ids", "x"])

    blocks = v.mapInArrow(index, "ids binary, codes binary, x binary").withColumn("block", F.monotonically_increasing_id())
    blocks = scratch.write(blocks, "blocks", "uncompressed")
    asked = scratch.write(queries.repartition(n_asked).mapInArrow(pack, "c int, ids binary, x binary"), "queries", "uncompressed")
    n_blocks = blocks.count()
    groups = max(1, min(n_blocks, max(GROUPS, -(-n_blocks // GROUP_BLOCKS))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = Quantiser(*sent.value)
        cell, asks, best = None, [], []

        def told() -> Iterator[pa.RecordBatch]:
            n = [len(ids) for ids, _ in best]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _ in asks], n), pa.int64()), pa.array(np.concatenate([ids for ids, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                here = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if here != cell:
                    yield from told()
                    cell, asks, best = here, [], []
                ids = np.frombuffer(b.column(3)[i].as_py(), np.int64)
                x = np.frombuffer(b.column(5)[i].as_py(), kind).reshape(-1, d).astype(np.float64)
                if b.column(2)[i].as_py() == 0:
                    asks += zip(ids.tolist(), x, strict=True)
                    best += [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
                    continue
                packed = np.frombuffer(b.column(4)[i].as_py(), np.uint8).reshape(-1, len(ids)).astype(np.intp)
                for j, (q_id, q) in enumerate(asks):
                    found, score = search_block(z, packed, x, ids, q, q_id, k, rerank)
                    found, score = np.r_[best[j][0], found], np.r_[best[j][1], score]
                    top = _best(score, found, k)
                    best[j] = found[top], score[top]
        yield from told()

    near = _cells(blocks, asked, groups, n_asked).mapInArrow(search, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
