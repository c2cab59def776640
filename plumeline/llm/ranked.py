"""Ranked lexical search: each item's best documents under integer BM25-like scores.

Documents are packed where they lie into written blocks of inverted lists, of the items' terms only.
A block answers an item by a hybrid of both ways of reading lists. Its short lists are read term at a
time, into one sorted list of summed accumulators with the greatest sum as its bound. This list then
takes part as one iterator among the long lists in a document-at-a-time pass over windows of
documents: lists whose bounds together stay below the least score that still counts are not read, only
looked up for candidates that can still reach it. A task keeps each item's best documents from block to
block, so later blocks skip more; the tasks' lists are ranked in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import decode, encode
from .scratch import Scratch
from .text import pick, pieces, text_bytes

#: Terms of the items that go to the executors at a time, which bounds that broadcast; more items take several passes.
TERMS = 300_000
#: A block ends at so many documents or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 2_000_000
#: Postings of an item's short lists that are summed beforehand, and documents of a window.
SHORT, SPAN = 8_192, 4_096
PIECE_BYTES = 1_000_000
LAST_ID = np.int64(2**63 - 1)
#: ASCII other than letters and digits parts terms; only A-Z are lowered.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
_BLOCK = "docs long, terms long, ids array<long>, lens binary, term binary, count binary, doc binary, tf binary"


def split_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, a list for each PIECE_BYTES of it."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term): the distinct terms of each item; rows that share an id are one item."""
    kind = items.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                terms = list({w for ws in split_terms(text or b"") for w in ws})
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(terms), batch.column(0).type), pa.array(terms, pa.binary())], ["item", "term"])

    return items.select("item", "text").mapInArrow(run, f"item {kind}, term binary").distinct()


def _postings(batch: pa.RecordBatch, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in each document, and (term, document, occurrences) of the numbered terms, ascending."""
    size, keys, counts = np.zeros(batch.num_rows, np.int64), [], []
    get, ids, owner = number.get, [], []

    def close() -> None:
        flat, docs = np.array(ids, np.int64), np.repeat(*np.array(owner, np.int64).reshape(-1, 2).T)
        k, n = np.unique((flat << 32 | docs)[flat >= 0], return_counts=True)
        keys.append(k)
        counts.append(n)
        ids.clear()
        owner.clear()

    for d, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
        for words in split_terms(text or b""):
            size[d] += len(words)
            ids.extend(map(get, words, repeat(-1)))
            owner.append((d, len(words)))
            if len(ids) > PIECE_BYTES:
                close()
    close()
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)
    return size, k >> 32, k & 0xFFFFFFFF, tf


def index_blocks(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """docs (doc_id, text) as blocks: how many documents have terms and how many terms, the ids and lengths of
    those with a numbered term, and each such term's documents and occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        ids, size, term, doc, tf = [], [], [], [], []
        have = np.zeros(2, np.int64)

        def row() -> pa.RecordBatch:
            i, n, t, d, f = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, size, term, doc, tf))
            order = np.lexsort((d, t))
            t, d, f = t[order], d[order], f[order]
            terms, count = np.unique(t, return_counts=True)
            used = np.unique(d)
            d = np.searchsorted(used, d)
            body = [np.diff(terms, prepend=0), count, np.diff(d, prepend=0), f]
            cols = [[int((n > 0).sum())], [int(n.sum())], [i[used]], [encode(n[used])], *([encode(x.astype(np.int32))] for x in body)]
            for x in (ids, size, term, doc, tf):
                x.clear()
            have[:] = 0
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["docs", "terms", "ids", "lens", "term", "count", "doc", "tf"])

        for batch in batches:
            for part in pieces(batch, text_bytes(batch.column(1)), PIECE_BYTES):
                n, t, d, f = _postings(part, number)
                ids.append(part.column(0).cast(pa.int64()).fill_null(int(LAST_ID)).to_numpy(zero_copy_only=False))
                size.append(n)
                term.append(t)
                doc.append(d + have[0])
                tf.append(f)
                have += (len(n), len(t))
                if have[0] >= BLOCK_DOCS or have[1] >= BLOCK_POSTINGS:
                    yield row()
        if have[0]:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, _BLOCK)


def _document_counts(blocks: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each numbered term stands; a row for each task and term is summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                df[np.cumsum(decode(t, np.int32))] += decode(c, np.int32)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    out = np.zeros(terms, np.int64)
    for r in blocks.select("term", "count").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Best:
    """The k highest (score, least id) of what was seen."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below it doesn't count any more; scores of zero never do."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.r_[self.score, score], np.r_[self.id, ids]
        if len(score) > self.k:
            cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[score >= cut], ids[score >= cut]
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def search_block(lists: list[tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray, best: Best) -> None:
    """Add a block's best documents. lists: ascending documents, their impacts and the greatest impact."""
    lists = sorted(lists, key=lambda x: len(x[0]))
    n = int(np.searchsorted(np.cumsum([len(x[0]) for x in lists]), SHORT, side="right"))
    if n > 1:  # short lists, term at a time
        docs, at = np.unique(np.concatenate([d for d, _, _ in lists[:n]]), return_inverse=True)
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, at, np.concatenate([w for _, w, _ in lists[:n]]))
        lists = [(docs, total, int(total.max())), *lists[n:]]
    lists.sort(key=lambda x: x[2])
    bound = np.cumsum([b for _, _, b in lists])
    for lo in range(0, len(ids), SPAN):  # long lists and the accumulators, document at a time
        hi = min(lo + SPAN, len(ids))
        idle = int(np.searchsorted(bound, best.least))  # these lists alone never reach the least score
        if idle == len(lists):
            return
        score = np.zeros(hi - lo, np.int64)
        for docs, impact, _ in lists[idle:]:
            a, z = np.searchsorted(docs, (lo, hi))
            score[docs[a:z] - lo] += impact[a:z]
        some = np.flatnonzero(score)
        for k in reversed(range(idle)):
            some = some[score[some] + bound[k] >= best.least]
            if not some.size:
                break
            docs, impact, _ = lists[k]
            at = np.minimum(np.searchsorted(docs, some + lo), len(docs) - 1)
            score[some] += np.where(docs[at] == some + lo, impact[at], 0)
        some = some[score[some] >= best.least]
        if some.size:
            best.add(score[some], ids[some + lo])


def _search(blocks: DataFrame, queries: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(q, doc_id, score): each task's best documents of every query."""
    shared = blocks.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shared.value
        best = [Best(k) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = row.column("ids").flatten().to_numpy(zero_copy_only=False)
                lens, term, count, doc, tf = (decode(row.column(c)[0].as_py(), np.int64 if c == "lens" else np.int32).astype(np.int64) for c in ("lens", "term", "count", "doc", "tf"))
                if not len(term):
                    continue
                term, doc = np.cumsum(term), np.cumsum(doc)
                m = 50 + 50 * lens * n_docs // n_terms
                impact = np.repeat(weight[term], count) * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                end = np.cumsum(count)
                top = np.maximum.reduceat(impact, end - count)
                for query, b in zip(queries, best, strict=True):
                    at = np.searchsorted(term, query)
                    at = at[(at < len(term)) & (term[np.minimum(at, len(term) - 1)] == query)]
                    lists = [(doc[end[j] - count[j] : end[j]], impact[end[j] - count[j] : end[j]], int(top[j])) for j in at.tolist() if top[j] > 0]
                    if lists:
                        search_block(lists, ids, b)
        for q, b in enumerate(best):
            if len(b.id):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.id), q)), pa.array(b.id), pa.array(b.score)], ["q", "doc_id", "score"])

    return blocks.mapInArrow(run, "q long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above zero, from rank 1.

    Terms are the runs of letters, digits and non-ASCII of the whole text, only A-Z lowered; null has none.
    With N the documents that have terms, L their terms, n one document's terms, df the documents of a term
    and tf its occurrences, a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), and an item's score sums
    w * ((10^9 tf) div (1000 tf + 20 m)) over its distinct terms, m = 50 + (50 n N) div L.

    Equal scores stand by ascending doc_id, which has an integer type; null ids stand last. Repeated rows are
    documents of their own; rows of one item id are one item, null is an item. Very long texts are taken in
    parts. Other columns are left out. The items' terms go to executors up to `terms` rows of (item, term) at
    a time, each pass a plan over all documents.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ranked")
    docs = pick(docs, doc_id=id_col, text=text_col)
    items = pick(items, item=item_col, text=item_text_col)
    kind = items.schema["item"].dataType
    wanted = scratch.write(item_terms(items), "terms")
    passes = -(-max(wanted.count(), 1) // terms)
    found = spark.createDataFrame([], f"item {kind.simpleString()}, doc_id long, score long")
    for p in range(passes):
        some = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p)
        rows = [(r.item, bytes(r.term)) for r in some.collect()]
        number = {t: j for j, t in enumerate(sorted({t for _, t in rows}))}
        of: dict[object, list[int]] = {}
        for i, t in rows:
            of.setdefault(i, []).append(number[t])
        names, queries = list(of), [np.array(sorted(x), np.int64) for x in of.values()]
        blocks = scratch.write(index_blocks(docs, number), f"blocks{p}", "uncompressed")
        n_docs, n_terms = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        if not n_docs or not names:
            continue
        df = _document_counts(blocks, len(number))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        named = spark.createDataFrame(list(enumerate(names)), f"q long, item {kind.simpleString()}")
        found = found.union(_search(blocks, queries, weight, n_docs, n_terms, k).join(F.broadcast(named), "q").select("item", "doc_id", "score"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", F.nullif("doc_id", F.lit(int(LAST_ID))).alias("doc_id"), "score")
