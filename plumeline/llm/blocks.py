"""Corpus-wide counts by exchanging sorted key arrays between blocks of documents and key buckets.

Counting each n-gram or window as a row of its own costs more than the work itself. Here documents
are packed into blocks, one written row each. A block asks about its distinct 64-bit keys: for each
bucket of the key space one row with a sorted, delta-coded array. A bucket merges the arrays of all
blocks and answers each with an array in the same order. Each block sends a key once, however often
it has it, so a hot key is at most one entry per block; buckets are even, as keys are hashes.

A block parts its keys among 2^FAN_BITS buckets at most. Where the corpus needs more, a team of blocks
gathers what it asks of one bucket into one sorted array, which is parted again, and answers come back
the same way. So a row always holds some hundred keys or more, and rows grow with the text and not
with the product of blocks and buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

BLOCK_BYTES = 8_000_000
#: Bytes of text for each bucket: at least the first, at most the second, which bounds a bucket's task.
BUCKET_BYTES = (4_000_000, 16_000_000)
#: Key bits by which a sender parts its keys at one hop, and senders that a team gathers at the next.
FAN_BITS, TEAM = 12, 4096


class Block:
    """The documents of one block: ids as an Arrow array, texts as bytes or None, and their fold."""

    def __init__(self, row: pa.RecordBatch | pa.Table) -> None:
        self.block = row.column("block")[0].as_py()
        self.fold = row.column("fold")[0].as_py()
        ids = row.column("ids")
        self.ids = (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        lens = np.frombuffer(row.column("lens")[0].as_py(), np.int64)
        body = zstandard.decompress(row.column("body")[0].as_py(), int(row.column("raw")[0].as_py())) if lens.max(initial=0) > 0 else b""
        ends = np.cumsum(np.maximum(lens, 0)).tolist()
        self.texts = [body[e - n : e] if n >= 0 else None for e, n in zip(ends, lens.tolist(), strict=True)]


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1))


def block_table(docs: DataFrame, scratch: Scratch, name: str, fold_of: Callable[[object], int] = lambda _: 0, most: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) packed into written rows of about `most` bytes of text.

    A block holds only documents of one fold, a number from 0 to 7 that fold_of gives to an id and
    that is the rest of `block` modulo 8. Columns: block, fold, ids, lens (bytes of each text, -1
    for null), raw, body (zstd).
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        open_: dict[int, tuple[list, list, list]] = {}
        full: dict[int, int] = {}

        def row(k: int) -> pa.RecordBatch:
            nonlocal made
            ids, lens, body = open_.pop(k)
            raw = b"".join(body)
            made += 1
            cols = [[((task << 32) + made) << 3 | k], [k], [ids], [np.array(lens, np.int64).tobytes()], [len(raw)], [zstandard.compress(raw, 3)]]
            kinds = [pa.int64(), pa.int32(), pa.list_(id_type), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["block", "fold", "ids", "lens", "raw", "body"])

        for batch in batches:
            id_type = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                k = fold_of(i)
                n = len(t) if t is not None else 0
                if k in open_ and full[k] + n > most:
                    yield row(k)
                if k not in open_:
                    open_[k], full[k] = ([], [], []), 0
                ids, lens, body = open_[k]
                ids.append(i)
                lens.append(-1 if t is None else n)
                if t:
                    body.append(t)
                full[k] += n + 64
        for k in list(open_):
            yield row(k)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scratch.write(docs.select("doc_id", "text").mapInArrow(pack, f"block long, fold int, ids array<{kind}>, lens binary, raw long, body binary"), name, "uncompressed")


def bucket_bits(blocks: DataFrame) -> int:
    """Leading key bits that number a bucket; from the written blocks' sizes, not their texts."""
    total = blocks.agg(F.sum("raw")).first()[0] or 0
    each = min(max(total / 2048, BUCKET_BYTES[0]), BUCKET_BYTES[1])
    return max(0, math.ceil(math.log2(max(1.0, total / each))))


def encode(a: np.ndarray) -> bytes:
    """Fixed-width values by byte planes, so that planes of zeros cost nothing."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1) if len(a) else b""


def decode(body: bytes, dtype: np.dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    if not body:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zstandard.decompress(body), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def distinct(keys: np.ndarray, vals: np.ndarray, same: str | None, add: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, their values, and for each entry the place of its key among them.

    Entries are alike if they agree in key and in the field `same`; the fields `add` are summed.
    """
    order = np.argsort(keys, kind="stable")
    k, v = keys[order], vals[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if same and np.any(~new[1:] & (v[same][1:] != v[same][:-1])):
        order = np.lexsort((vals[same], keys))
        k, v = keys[order], vals[order]
        new[1:] = (k[1:] != k[:-1]) | (v[same][1:] != v[same][:-1])
    at = np.flatnonzero(new)
    out = v[at]
    for f in add if len(at) else ():
        out[f] = np.add.reduceat(v[f], at)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return k[at], out, inverse


def _parted(keys: np.ndarray, vals: np.ndarray, sender: int, bucket: int, have: int, more: int) -> Iterator[pa.RecordBatch]:
    """Ascending keys that agree in their first `have` bits, a row for each value of the next `more`."""
    shift, mask = np.uint64(64 - have - more), np.uint64((1 << more) - 1)
    sub = ((keys >> shift) & mask).astype(np.int64) if have + more else np.zeros(len(keys), np.int64)
    edges = np.searchsorted(sub, np.arange((1 << more) + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        some = keys[edges[k] : edges[k + 1]]
        body = encode(np.diff(some, prepend=np.uint64(0)))
        yield pa.RecordBatch.from_arrays([pa.array([bucket << more | k], pa.int64()), pa.array([sender], pa.int64()), pa.array([body], pa.binary()), pa.array([encode(vals[edges[k] : edges[k + 1]])], pa.binary())], ["bucket", "sender", "keys", "vals"])


ASKED, TOLD_ROW = "bucket long, sender long, keys binary, vals binary", "sender long, bucket long, body binary, tally array<long>"


def exchange(blocks: DataFrame, ask: Callable[[Block], tuple[np.ndarray, np.ndarray]], answer: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list[int]]], kind: np.dtype, told: np.dtype, bits: int, scratch: Scratch, same: str | None = None, add: tuple[str, ...] = (), fan: int = FAN_BITS, team: int = TEAM) -> DataFrame:
    """Rows (block, bucket, body, tally) with the answers to each block, in the order of its keys.

    ask: a block's distinct keys, ascending, and a value of type `kind` for each; see `distinct` for
    `same` and `add`. answer: from all keys of a bucket, ascending and repeated, with their values, an
    answer of type `told` for each and figures of the bucket; those stand as `tally` in one of the
    bucket's rows, null in the others.
    """

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_block(batches):
            yield from _parted(*ask(b), b.block, 0, 0, min(bits, fan))

    def opened(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        each = [np.cumsum(decode(x, np.uint64), dtype=np.uint64) for x in t.column("keys").to_pylist()]
        return each, np.concatenate([decode(x, kind) for x in t.column("vals").to_pylist()])

    def rows(t: pa.Table, each: list[np.ndarray], back: np.ndarray, tally: list[int] | None) -> pa.Table:
        bodies = [encode(x) for x in np.split(back, np.cumsum([len(x) for x in each])[:-1])]
        tallies = pa.array([tally] + [None] * (len(bodies) - 1), pa.list_(pa.int64()))
        return pa.table([t.column("sender"), t.column("bucket"), pa.array(bodies, pa.binary()), tallies], ["sender", "bucket", "body", "tally"])

    def merge(t: pa.Table) -> pa.Table:
        each, vals = opened(t)
        keys = np.concatenate(each)
        order = np.argsort(keys, kind="stable")
        out, tally = answer(keys[order], vals[order])
        back = np.empty_like(out)
        back[order] = out
        return rows(t, each, back, tally)

    def resolve(asked: DataFrame, have: int, senders: int) -> DataFrame:
        """Answers to rows whose bucket is the first `have` bits; at most `senders` ask a bucket."""
        if have >= bits:
            return asked.groupBy("bucket").applyInArrow(merge, TOLD_ROW)
        more, teams = min(fan, bits - have), -(-senders // team)
        asked = scratch.write(asked.withColumn("team", F.pmod(F.xxhash64("sender"), F.lit(teams))), f"asked{have}")

        def gather(t: pa.Table) -> pa.Table:
            each, vals = opened(t)
            keys, vals, _ = distinct(np.concatenate(each), vals, same, add)
            bucket = t.column("bucket")[0].as_py()
            return pa.Table.from_batches(list(_parted(keys, vals, t.column("team")[0].as_py() << have | bucket, bucket, have, more)))

        def scatter(t: pa.Table, answers: pa.Table) -> pa.Table:
            each, vals = opened(t)
            _, _, place = distinct(np.concatenate(each), vals, same, add)
            answers = answers.sort_by("bucket")
            got = np.concatenate([decode(x, told) for x in answers.column("body").to_pylist()])
            tallies = [x for x in answers.column("tally").to_pylist() if x]
            return rows(t, each, got[place], [sum(x) for x in zip(*tallies, strict=True)] or None)

        answers = resolve(asked.groupBy("team", "bucket").applyInArrow(gather, ASKED), have + more, teams)
        answers = answers.withColumns({"of": F.shiftright("sender", have), "under": F.col("sender").bitwiseAND(F.lit((1 << have) - 1))})
        return asked.groupBy("team", "bucket").cogroup(answers.groupBy("of", "under")).applyInArrow(scatter, TOLD_ROW)

    asked = blocks.mapInArrow(requests, ASKED)
    hops = min(bits, fan)
    return resolve(asked, hops, blocks.count() if hops < bits else 0).withColumnRenamed("sender", "block")


def with_answers(blocks: DataFrame, answers: DataFrame, dtype: np.dtype, use: Callable[[Block, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows that `use` makes of each block and the answers to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.sort_by("bucket").column("body").to_pylist()
        got = np.concatenate([decode(x, dtype) for x in told]) if told else np.zeros(0, dtype)
        return pa.Table.from_batches(list(use(Block(left), got)))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
