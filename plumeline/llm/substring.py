"""Substring removal: passages of a fixed number of words that occur more than once.

Each window of words has a Rabin-Karp hash, the polynomial of its words' hashes in an odd base
modulo 2^64, read off prefix sums. Spark counts windows over the whole corpus (see `blocks`);
windows that start more than once mark their words, and marked words merge into maximal spans.
A second polynomial in another base adds 24 bits: equal windows are equal in 88 bits, so that among
10^13 different windows a sixth of a pair is expected to be taken for equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_digest

from .blocks import FAN_BITS, TEAM, Block, block_table, bucket_bits, distinct, exchange, mix, with_answers
from .scratch import Scratch
from .text import pick

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
KIND = np.dtype([("check", "u4"), ("many", "u4")])
SCHEMA = "doc_id {}, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept string"


def window_hashes(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all windows of `width` consecutive entries of h."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.r_[np.uint64(0), np.cumsum(h * up, dtype=np.uint64)]
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def block_windows(texts: list[bytes | None], width: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, places of windows among all words, and the windows' hashes and checks."""
    split = [t.split() if t else [] for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    h = np.frombuffer(b"".join(xxh64_digest(x) for w in split for x in w), ">u8").astype(np.uint64)
    starts = np.cumsum(n) - n
    full = np.flatnonzero(n >= width)
    count = n[full] - width + 1
    at = np.repeat(starts[full] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    if not at.size:
        return split, at, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    key = window_hashes(h, width, BASES[0])[at]
    check = (window_hashes(mix(h), width, BASES[1])[at] >> np.uint64(40)).astype(np.uint32)
    return split, at, key, check


def _answer(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """1 for each window that occurs more than once in all blocks."""
    check = vals["check"]
    if np.any((keys[1:] == keys[:-1]) & (check[1:] != check[:-1])):
        order = np.lexsort((check, keys))
        out = np.empty(len(keys), np.uint8)
        out[order] = _runs(keys[order], check[order], vals["many"][order])
        return out, []
    return _runs(keys, check, vals["many"]), []


def _runs(keys: np.ndarray, check: np.ndarray, many: np.ndarray) -> np.ndarray:
    same = (keys[1:] == keys[:-1]) & (check[1:] == check[:-1])
    return (many > 1).astype(np.uint8) | np.r_[same, False].astype(np.uint8) | np.r_[False, same].astype(np.uint8)


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, fan: int = FAN_BITS, team: int = TEAM) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, n_removed, spans, kept).

    Each word covered by a window of `width` words that also starts elsewhere, in the same row or
    another, is removed; windows are judged on the input. spans are the maximal runs of removed
    words, stop excluded; kept has the other words joined by one space. Rows are told apart by
    place, so repeated ids and repeated rows remove each other's windows; a null id stays null. A
    null or empty text has no words, and an empty kept. Very long texts are taken whole. Other columns
    are left out. bits, fan and team size the exchange of counts (see `blocks`).
    """
    scratch = Scratch(docs.sparkSession, "substring")
    blocks = block_table(pick(docs, doc_id=id_col, text=text_col), scratch, "blocks")

    def entries(check: np.ndarray) -> np.ndarray:
        out = np.empty(len(check), KIND)
        out["check"], out["many"] = check, 1
        return out

    def ask(b: Block) -> tuple[np.ndarray, np.ndarray]:
        _, _, key, check = block_windows(b.texts, width)
        keys, vals, _ = distinct(key, entries(check), "check", ("many",))
        vals["many"] = np.minimum(vals["many"], 2)
        return keys, vals

    def use(b: Block, told: np.ndarray) -> Iterator[pa.RecordBatch]:
        split, at, key, check = block_windows(b.texts, width)
        n = np.array([len(w) for w in split], np.int64)
        total = int(n.sum())
        edge = np.zeros(total + 1, np.int64)
        hit = at[told[distinct(key, entries(check), "check", ())[2]] > 0] if at.size else at
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + width, -1)
        gone = np.cumsum(edge)[:total] > 0
        ends = np.cumsum(n)
        removed, spans, kept = [], [], []
        for w, lo, hi in zip(split, (ends - n).tolist(), ends.tolist(), strict=True):
            g = gone[lo:hi]
            turn = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8))).tolist()
            removed.append(int(g.sum()))
            spans.append([{"start": a, "stop": z} for a, z in zip(turn[::2], turn[1::2], strict=True)])
            ups = zip([0, *turn[1::2]], [*turn[::2], len(w)], strict=True)
            kept.append(b" ".join([x for a, z in ups for x in w[a:z]] if turn else w))
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.ids, pa.array(n), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    answers = exchange(blocks, ask, _answer, KIND, np.dtype(np.uint8), bucket_bits(blocks) if bits is None else bits, scratch, "check", ("many",), fan, team)
    return with_answers(blocks, answers, np.uint8, use, SCHEMA.format(docs.schema[id_col].dataType.simpleString()))
