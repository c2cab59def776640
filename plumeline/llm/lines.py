"""Line dedup: lines that stand in many documents go from all of them.

Line keys are 128-bit hashes. Documents come in batches; a batch's keys, counted once per document,
are merge-anti-joined with the runs of keys already known to be frequent, and the rest is added as a
sorted run. Runs are levelled: when a level has FANOUT runs they are merged into one run of the next
level, and keys whose sum reaches the limit move to the settled runs. A last merge settles all.

Runs are tables bucketed and sorted by key in one number of buckets, taken from the size of the
texts, as are the keys of the batches: after these are dealt to buckets once, counting, anti-joins and
merges, always of two runs, shuffle nothing; Spark sorts a bucket again before it merges. Settled runs
are levelled too, so that a batch meets a few of them. Runs outlive the session: `LineRuns.state` is all
that a later one needs to add its own batches.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from .scratch import Scratch
from .text import pick, pieces, text_bytes

PIECE_BYTES = 2_000_000
FANOUT = 3
#: Bytes of text for each bucket of keys, where that makes more buckets than there are shuffle partitions.
BUCKET_BYTES = 512_000_000
#: Settled keys that may be sent to every executor (16 bytes each); with more, keys are joined to documents.
BROADCAST_KEYS = 500_000


def line_keys(text: bytes | None, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text, and each line's hash, None if its key is shorter than `least` code points."""
    lines = (text or b"").split(b"\n")
    keys = [x.strip(b" \t\n\x0b\x0c\r").lower() for x in lines]
    long = (lambda k: len(k) >= 1) if least == 1 else (lambda k: len(k.decode("utf-8", "replace")) >= least)
    return lines, [xxh3_128_digest(k) if long(k) else None for k in keys]


class LineRuns:
    """Sorted runs (key, n) by level, and settled runs of the keys with at least `limit` documents."""

    def __init__(self, spark: SparkSession, root: str, limit: int, buckets: int, fanout: int = FANOUT) -> None:
        self.spark, self.root, self.limit, self.buckets, self.fanout = spark, root, limit, buckets, fanout
        self.prefix = f"plumeline_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []
        self.weights: list[int] = []  # compactions that a settled run holds
        self.made = 0

    def state(self) -> dict:
        """What :meth:`resume` needs, as plain values."""
        return {"root": self.root, "limit": self.limit, "buckets": self.buckets, "fanout": self.fanout, "levels": self.levels, "settled": self.settled, "weights": self.weights, "made": self.made}

    @classmethod
    def resume(cls, spark: SparkSession, state: dict) -> LineRuns:
        """The runs that another session left under their root."""
        out = cls(spark, *(state[k] for k in ("root", "limit", "buckets", "fanout")))
        out.levels, out.settled, out.weights, out.made = [list(x) for x in state["levels"]], list(state["settled"]), list(state["weights"]), state["made"]
        runs = {n: "key binary, n bigint" for level in out.levels for n in level} | dict.fromkeys(out.settled, "key binary")
        for name, columns in runs.items():
            spark.sql(f"CREATE TABLE {out.prefix}_{name} ({columns}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {out.buckets} BUCKETS LOCATION '{out.root}/{name}'")
        return out

    def write(self, df: DataFrame, name: str | None = None) -> str:
        """A run of df, which is dealt by key already or is dealt here."""
        self.made += 1
        name = name or f"run{self.made}"
        df.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", f"{self.root}/{name}").saveAsTable(f"{self.prefix}_{name}")
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{name}")

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, batch: DataFrame) -> None:
        """batch: (key, n), a key any number of times; n counts documents."""
        counts = batch.groupBy("key").agg(F.sum("n").alias("n"))
        for known in self.settled:
            counts = counts.join(self.read(known).hint("merge"), "key", "left_anti")
        self.levels[0].append(self.write(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one: bucket by bucket, by one join, which keeps the buckets where a union or a chain of joins would not."""
        counts = "n" in self.read(a).columns
        both = self.read(a).withColumnRenamed("n", "n0").join(self.read(b).withColumnRenamed("n", "n1").hint("merge"), "key", "full")
        return both.select("key", (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n")) if counts else both.select("key")

    def _replace(self, a: str, b: str) -> str:
        name = self.write(self.merged(a, b))
        self.drop(a)
        self.drop(b)
        return name

    def _compact(self, level: int) -> None:
        names, self.levels[level] = self.levels[level], []
        while len(names) > 1:
            names = [*names[2:], self._replace(*names[:2])]
        self.settled.append(self.write(self.read(names[0]).where(F.col("n") >= self.limit).select("key")))
        self.weights.append(1)
        while len(self.weights) > 1 and self.weights[-2] <= self.weights[-1]:
            self.settled[-2:], self.weights[-2:] = [self._replace(*self.settled[-2:])], [sum(self.weights[-2:])]
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self.write(self.read(names[0]).where(F.col("n") < self.limit)))
        self.drop(names[0])

    def close(self) -> None:
        """Take the runs' names out of the session's catalog; their files stay for :meth:`resume`."""
        for name in (*(n for level in self.levels for n in level), *self.settled):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")

    def finish(self) -> DataFrame:
        """All keys with at least `limit` documents; more batches may follow."""
        left = [n for level in self.levels for n in level]
        if left:
            self.levels = [left]
            self._compact(0)
        keys = self.read(self.settled[0]) if self.settled else self.spark.createDataFrame([], "key binary")
        for more in self.settled[1:]:
            keys = keys.union(self.read(more))
        return keys


def _document_keys(docs: DataFrame, least: int, batches: int) -> DataFrame:
    """(batch, key, n): in how many documents of a piece of a batch a key stands."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in pieces(batch, text_bytes(batch.column(1)), PIECE_BYTES):
                seen: list[Counter] = [Counter() for _ in range(batches)]
                for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    seen[xxh64_intdigest(str(i)) % batches].update({k for k in line_keys(t, least)[1] if k is not None})
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.arange(batches, dtype=np.int32), [len(c) for c in seen])),
                    pa.array([k for c in seen for k in c], pa.binary()),
                    pa.array([n for c in seen for n in c.values()], pa.int64()),
                ], ["batch", "key", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "batch int, key binary, n long")


def _dropped(text: bytes | None, least: int, frequent) -> tuple[int, int, bytes]:  # noqa: ANN001
    lines, keys = line_keys(text, least)
    kept = [x for x, k in zip(lines, keys, strict=True) if k is None or not frequent(k)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _result(ids: pa.Array, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", batches: int = 6, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per row of docs: (doc_id, n_lines, n_dropped, kept).

    A line's key is the line without ASCII white space at its ends and with A-Z lowered. Keys of at
    least min_chars code points that stand in at least min_docs rows lose all their lines; the
    others stay as they are, joined by a line feed. A null or empty text is one empty line. Rows are
    counted, so repeated rows count each; ids may be null or repeat. If all lines go, kept is empty.
    Very long texts are taken whole.
    Settled keys go to the executors while there are at most `broadcast_keys`; beyond that, they are
    joined to the documents that have them. Other columns are left out.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    scratch = Scratch(docs.sparkSession, "lines")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    runs = LineRuns(docs.sparkSession, scratch.path("runs"), min_docs, buckets)
    keyed = _document_keys(docs, min_chars, batches).repartition(buckets, "key").groupBy("batch", "key").agg(F.sum("n").alias("n"))
    runs.write(keyed, "keys")
    for k in range(batches):
        runs.add(runs.read("keys").where(F.col("batch") == k).select("key", "n"))
    runs.drop("keys")
    frequent = scratch.write(runs.finish(), "settled")
    runs.close()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept string"
    if frequent.count() <= broadcast_keys:
        found = frozenset(bytes(r.key) for r in frequent.collect())
        sent = docs.sparkSession.sparkContext.broadcast(found)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            has = sent.value.__contains__
            for batch in it:
                for part in pieces(batch, text_bytes(batch.column(1)), PIECE_BYTES):
                    yield _result(part.column(0), [_dropped(t, min_chars, has) for t in part.column(1).cast(pa.binary()).to_pylist()])

        return docs.mapInArrow(run, schema)

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in pieces(batch, text_bytes(batch.column(1)), PIECE_BYTES):
                keys = [list({k for k in line_keys(t, min_chars)[1] if k is not None}) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))), pa.array([x for k in keys for x in k], pa.binary())], ["doc_id", "key"])

    def drop(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in pieces(batch, text_bytes(batch.column(1)), PIECE_BYTES):
                found = [frozenset(x or ()) for x in part.column(2).to_pylist()]
                yield _result(part.column(0), [_dropped(t, min_chars, f.__contains__) for t, f in zip(part.column(1).cast(pa.binary()).to_pylist(), found, strict=True)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = docs.mapInArrow(own, f"doc_id {kind}, key binary").join(frequent, "key", "left_semi")
    lists = pairs.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("key").alias("keys"))
    return docs.join(lists, docs.doc_id.eqNullSafe(lists.id), "left").select("doc_id", "text", "keys").mapInArrow(drop, schema)
