"""Benchmark decontamination: a prefix-filtered join of documents with the windows of benchmark items.

A window is matched whole, so a document that has it has each of its words: the prefix that a set
join needs is the single rarest one, by counts over all documents. The join on prefix words gives,
for each of their places in a document, the offset in the window and the window's length, which bound
where the window would start and end; the words there are joined to the windows themselves, which
verifies containment exactly. Windows have sets of items, each set told once. Results belong to texts, known by 96 bits of hashes, and come back to
rows by these: no table of documents is copied and no document travels for more than its hits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import pick, pieces, text_bytes

PIECE_BYTES = 2_000_000
#: Words whose counts a task holds before it passes them on.
HELD_WORDS = 300_000
#: Rows (a word, or a prefix word with an offset and a length) that may be sent to every executor; with
#: more, documents' distinct words are joined to them.
BROADCAST_ROWS = 300_000
#: A-Z to a-z, other ASCII but letters and digits to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
TEXT = ("t1", "t2")
#: A set of items, and a union of such sets.
SET, UNION = ("a", "b", "n"), ("ua", "ub", "un")

Index = dict[bytes, list[tuple[int, int]]]


def match_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def windows(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """All windows of `width` words; of fewer words, but not none, one window."""
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def within_bounds(words: list[bytes], index: Index) -> list[tuple[int, int]]:
    """Places (start, stop) where a window may stand: by the places of prefix words, offsets and lengths."""
    n = len(words)
    out = {(p - o, p - o + size) for p in [p for p, w in enumerate(words) if w in index] for o, size in index[words[p]] if o <= p and p - o + size <= n}
    return sorted(out)


def _benchmark_words(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(name, item, pos, n_item, word): words of each row of the benchmark; item tells rows apart."""
    items = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("name"), benchmark[text_col].cast("binary").alias("body"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [match_words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[w.decode("utf-8", "replace") for w in x] for x in words], pa.list_(pa.string()))], ["name", "words"])

    rows = items.mapInArrow(split, "name string, words array<string>").withColumn("item", F.monotonically_increasing_id())
    return rows.select("name", "item", F.size("words").alias("n_item"), F.posexplode("words").alias("pos", "word"))


def _word_counts(docs: DataFrame, vocabulary: DataFrame, most: int) -> DataFrame:
    """(word, n) over all documents for the words of the benchmark; words that no document has are missing."""
    known = None
    if vocabulary.count() <= most:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r.word.encode() for r in vocabulary.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        has = known.value.__contains__ if known else None
        for batch in batches:
            for part in pieces(batch, text_bytes(batch.column(0)), PIECE_BYTES):
                for t in part.column(0).cast(pa.binary()).to_pylist():
                    total.update(filter(has, match_words(t)) if has else match_words(t))
                    if len(total) > HELD_WORDS:
                        yield flush()
                        total.clear()
        yield flush()

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts if known else counts.join(vocabulary, "word", "left_semi")


def _owners(words: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """(window, prefix, offset, size, name): each item's distinct windows by their rarest word."""
    ranked = words.join(counts, "word", "left").select("name", "item", "pos", "n_item", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "pos").alias("w"))
    ahead = Window.partitionBy("item").orderBy("pos").rowsBetween(Window.currentRow, width - 1)
    each = ranked.withColumn("ws", F.collect_list("w").over(ahead)).where(f"pos = 0 or pos + {width} <= n_item")
    least = F.array_min("ws")
    text = F.array_join(F.transform("ws", lambda w: w["word"]), " ")
    return each.select(text.alias("window"), least["word"].alias("prefix"), (least["pos"] - F.col("pos")).alias("offset"), F.size("ws").alias("size"), "name").distinct()


def _known(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"t1": F.xxhash64("text"), "t2": F.hash("text")})


def _places(docs: DataFrame, owners: DataFrame, most: int) -> DataFrame:
    """(doc_id, t1, t2, n_words, places): for each document the windows that stand within bounds of a prefix word."""
    prefixes = owners.groupBy(F.col("prefix").alias("word")).agg(F.collect_set(F.struct("offset", "size")).alias("bounds"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, t1 long, t2 int, n_words long, places array<struct<start:int,stop:int,window:string>>"
    place = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("window", pa.string())]))
    sent = None
    if owners.select("prefix", "offset", "size").distinct().count() <= most:
        sent = docs.sparkSession.sparkContext.broadcast({r.word.encode(): [(b.offset, b.size) for b in r.bounds] for r in prefixes.collect()})
    else:
        def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, text_bytes(batch.column(2)), PIECE_BYTES):
                    own = [list(set(match_words(t))) for t in part.column(2).cast(pa.binary()).to_pylist()]
                    at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array([w for x in own for w in x], pa.binary()).cast(pa.string())], ["t1", "t2", "word"])

        pairs = docs.select("t1", "t2", "text").mapInArrow(distinct_words, "t1 long, t2 int, word string").distinct()
        lists = pairs.join(prefixes, "word").groupBy("t1", "t2").agg(F.collect_list(F.struct("word", "bounds")).alias("index"))
        docs = docs.join(lists, [*TEXT], "left").select("doc_id", "text", "t1", "t2", "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_bytes(batch.column(1)), PIECE_BYTES):
                rows = part.column(1).cast(pa.binary()).to_pylist()
                each = [sent.value] * len(rows) if sent else [{x["word"].encode(): [(b["offset"], b["size"]) for b in x["bounds"]] for x in r or ()} for r in part.column(4).to_pylist()]
                n, found = [], []
                for t, index in zip(rows, each, strict=True):
                    w = match_words(t)
                    n.append(len(w))
                    found.append([{"start": a, "stop": z, "window": b" ".join(w[a:z]).decode("utf-8", "replace")} for a, z in within_bounds(w, index)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(n, pa.int64()), pa.array(found, place)], ["doc_id", "t1", "t2", "n_words", "places"])

    return docs.mapInArrow(run, schema)


def _set_id(*parts: str) -> list:
    """A set known by 128 bits that don't depend on its order, and its size; rows are its distinct members."""
    return [F.bit_xor(F.xxhash64(*parts)).alias("a"), F.bit_xor(F.xxhash64(F.lit("set"), *parts)).alias("b"), F.count("*").alias("n")]


def _window_sets(owners: DataFrame) -> DataFrame:
    """(window, a, b, n): each window once, with the set of items that own it."""
    return owners.select("window", "name").distinct().groupBy("window").agg(*_set_id("name"))


def _marks(places: DataFrame, sets: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, spans) of the texts that have a window, and their sets (t1, t2, a, b, n), each once.

    A place meets its window's set of items, never the items themselves: a passage of many items in
    many documents makes a row for each document.
    """
    each = places.select(*TEXT, F.inline("places"))
    hits = each.join(F.broadcast(sets) if small else sets, "window").select(*TEXT, "start", "stop", *SET).distinct()
    order = Window.partitionBy(*TEXT).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.select(*TEXT, "start", "stop").distinct().withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("long"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*TEXT, "run").agg(F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"))
    spans = runs.groupBy(*TEXT).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return spans, hits.select(*TEXT, *SET).distinct()


def _unions(met: DataFrame, owners: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, ua, ub, un), the union of each text's sets, and (ua, ub, un, items) of each union once.

    One window stands for each set, and one text for each union, when their members are listed.
    """
    one = sets.groupBy(*SET).agg(F.min("window").alias("window"))
    names = one.join(owners.select("window", "name").distinct(), "window").select(*SET, "name")
    union = met.groupBy(*TEXT).agg(*_set_id(*SET)).toDF(*TEXT, *UNION)
    first = union.groupBy(*UNION).agg(F.min(F.struct(*TEXT)).alias("t")).select(*UNION, "t.*")
    items = first.join(met, [*TEXT]).join(names, [*SET]).groupBy(*UNION).agg(F.sort_array(F.collect_set("name")).alias("items"))
    return union, items


def _found(docs: DataFrame, benchmark: DataFrame, width: int, item_col: str, item_text_col: str, most: int) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    """Written places of documents (doc_id, text, t1, t2), owners of windows and their sets."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    words = scratch.write(_benchmark_words(benchmark, item_col, item_text_col), "words")
    owners = scratch.write(_owners(words, _word_counts(docs, words.select("word").distinct(), most), width), "owners")
    places = scratch.write(_places(docs, owners, most), "places")
    return places, owners, scratch.write(_window_sets(owners), "sets"), scratch


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, digest: bool = False) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, spans, items); with digest, (…, n_items, items_sha256) in place of items.

    spans are the maximal runs of words that lie in an occurrence of a window of an item, stop
    excluded; items are the ids, as text, of the items with occurring windows, sorted as text. Words
    are runs of digits, a-z and non-ASCII after A-Z is lowered. Null and empty texts have no words;
    an item without words has no window; an item with a null id is named by the empty text. Very
    long texts are searched whole. Items with equal windows are all named, repeated rows are found
    each. Ids may be null or repeat; other columns are left out. With an empty benchmark nothing is
    found. The benchmark stays a table of any size: only prefix words with their bounds, and only up
    to `broadcast_rows` of them, go to every executor; with more, documents' distinct words are
    joined to them.
    """
    docs = _known(pick(docs, doc_id=id_col, text=text_col))
    places, owners, sets, scratch = _found(docs, benchmark, width, item_col, item_text_col, broadcast_rows)
    spans, met = _marks(places, sets, sets.count() <= broadcast_rows)
    met = scratch.write(met, "met")
    union, items = _unions(met, owners, sets)
    if digest:
        items = items.select(*UNION, F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    found = places.join(spans.join(union, [*TEXT]), [*TEXT], "left").join(items, [*UNION], "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    named = [F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256")] if digest else [none("items", "array<string>")]
    return found.select("doc_id", "n_words", none("spans", "array<struct<start:bigint,stop:bigint>>"), *named)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no window of an item; see :func:`find_contamination`."""
    own = _known(pick(docs, text=text_col).withColumn("doc_id", F.lit(None).cast("string")).select("doc_id", "text"))
    places, _, sets, scratch = _found(own, benchmark, width, item_col, item_text_col, broadcast_rows)
    small = sets.count() <= broadcast_rows
    each = places.select(*TEXT, F.inline("places")).join(F.broadcast(sets) if small else sets, "window", "left_semi")
    marks = scratch.write(each.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct(), "marks")
    marks = F.broadcast(marks) if marks.count() <= broadcast_rows else marks
    return docs.join(marks, (F.xxhash64(docs[text_col]) == F.col("_t1")) & (F.hash(docs[text_col]) == F.col("_t2")), "left_anti")
