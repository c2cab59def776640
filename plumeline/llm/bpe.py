"""Byte-pair encoding and decoding with a published vocabulary, in batched numpy merge rounds.

The symbols of many words stand in one flat array. A round looks up all neighbouring pairs by binary
search over the sorted pair keys, takes each word's lowest rank, and merges all places of that pair
at once. Words that have no pair left leave the array. Each chunk between white space is encoded once
per cache, since no pre-token crosses white space.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .text import pick, pieces, text_bytes

PIECE_BYTES = 1_000_000
CACHE_CHUNKS = 300_000
NEVER = np.int64(1 << 40)
#: Separators that str.split parts at although they are no white space in Unicode.
CONTROL = regex.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"\s+")
MARKED = regex.compile("[<\0\1]")
#: Beyond these code points versions of Unicode differ in letters, case and composition.
LATER = regex.compile(r"[^\0-\u052f\u2010-\u2027\u2030-\u205e\u20ac\u2122]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tables of a word-level BPE vocabulary in the JSON format of the tokenizers library.

    Supported: NFC, white-space and lower-case normalisers; one Split by pattern, inverted and
    removed, followed by ByteLevel; BPE with an end-of-word suffix; added special tokens; no decoder.
    """

    @classmethod
    def of(cls, tables: dict) -> Vocabulary:
        """From the attributes of another, which travel as plain data."""
        out = cls.__new__(cls)
        out.__dict__.update(tables)
        return out

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, suffix = j["model"], j["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.letter_byte = {ord(c): b for b, c in enumerate(letters)}
        self.splitter = json.dumps(j | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []})
        self.pattern = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")


def merge_rounds(v: Vocabulary, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all merges, with the word of each. word: ascending; sym: initial symbols."""
    done_sym, done_word = [], []
    while sym.size:
        key = (sym[:-1] << 20) | sym[1:]
        at = np.minimum(np.searchsorted(v.key, key), len(v.key) - 1)
        rank = np.append(np.where((v.key[at] == key) & (word[:-1] == word[1:]), v.rank[at], NEVER), NEVER)
        new = np.r_[True, word[1:] != word[:-1]]
        starts, local = np.flatnonzero(new), np.cumsum(new) - 1
        low = np.minimum.reduceat(rank, starts)
        over = low[local] == NEVER
        done_sym.append(sym[over])
        done_word.append(word[over])
        hit = (rank == low[local]) & ~over
        places = np.flatnonzero(hit)
        if places.size > 1:  # in a run of overlapping places, every second one from the left
            first = np.r_[True, np.diff(places) != 1]
            begun = places[np.maximum.accumulate(np.where(first, np.arange(places.size), 0))]
            places = places[(places - begun) % 2 == 0]
        sym = sym.copy()
        sym[places] = v.made[at[places]]
        keep = ~over
        keep[places + 1] = False
        sym, word = sym[keep], word[keep]
    sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
    order = np.argsort(word, kind="stable")
    return sym[order], word[order]


class Encoder:
    """Encodes texts, remembering up to CACHE_CHUNKS chunks at a time."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.find = regex.compile(v.pattern).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        self.library: Tokenizer | None = None
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {s: k for k, s in enumerate(self.v.special)}
        self.flat = [np.array(list(self.v.special.values()), np.int64)]
        self.size = [np.ones(len(self.v.special), np.int64)]

    def chunks(self, text: str) -> list[str]:
        """Normalised chunks between white space; special tokens stand as themselves."""
        if self.parts is None or "<" not in text:
            return self._plain(text)
        out = []
        for k, part in enumerate(self.parts.split(text)):
            out += [part] if k % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if LATER.search(text):
            # the library's own normaliser and splitter; a chunk is then one pre-token in byte letters
            self.library = self.library or Tokenizer.from_str(self.v.splitter)
            return ["\1" + t for t, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        found = [c for c in SPACE.split(text) if c] if CONTROL.search(text) else text.split()
        # "\0" keeps a text's own chunk apart from a special token or a marked one of the same letters
        return ["\0" + c if c[0] in "<\0\1" else c for c in found] if MARKED.search(text) else found

    def _learn(self, new: list[str]) -> None:
        of_bytes = self.v.letter_byte
        tokens = [[bytes(of_bytes[ord(x)] for x in c[1:])] if c[0] == "\1" else [t.encode() for t in self.find(c[1:] if c[0] == "\0" else c)] for c in new]
        raw = [t for ts in tokens for t in ts]
        n = np.array([len(r) for r in raw], np.int64)
        body = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.v.inner[body]
        ends = np.cumsum(n) - 1
        sym[ends] = self.v.last[body[ends]]
        word = np.repeat(np.arange(len(raw)), n)
        sym, word = merge_rounds(self.v, sym[sym >= 0], word[sym >= 0])
        chunk_of = np.repeat(np.arange(len(new)), [len(ts) for ts in tokens])
        base = len(self.at)
        self.at.update(zip(new, range(base, base + len(new)), strict=True))
        self.flat.append(sym)
        self.size.append(np.bincount(chunk_of[word], minlength=len(new)) if sym.size else np.zeros(len(new), np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of each text's ids."""
        if len(self.at) > CACHE_CHUNKS:
            self._clear()
        split = [self.chunks(t) for t in texts]
        new = list(dict.fromkeys(c for cs in split for c in cs if c not in self.at))
        if new:
            self._learn(new)
            self.flat, self.size = [np.concatenate(self.flat)], [np.concatenate(self.size)]
        flat, size = self.flat[0], self.size[0]
        get = self.at.__getitem__
        idx = np.array([get(c) for cs in split for c in cs], np.int64)
        n = size[idx]
        total = np.r_[0, np.cumsum(n)]
        ids = flat[np.repeat((np.cumsum(size) - size)[idx] - total[:-1], n) + np.arange(total[-1])]
        return ids, np.diff(total[np.r_[0, np.cumsum([len(cs) for cs in split])]])


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    """Token strings joined by a space, as decoding without a decoder does; unknown ids are skipped."""
    names = v.names
    try:
        return " ".join([names[i] for i in ids])
    except (IndexError, TypeError):
        return " ".join(names[i] for i in ids if 0 <= i < len(names) and names[i] is not None)


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_tokens, ids, decoded).

    ids are little-endian unsigned 32-bit integers in a binary, decoded is made from them alone. The
    vocabulary file is read on the driver; its tables, whose size it bounds, go to the executors.
    Special tokens in a text get their own ids; none are added. A null text counts as empty: no ids
    and an empty text. Ids may be null or repeat; other columns are left out.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(vars(Vocabulary(vocabulary_path)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(tables.value)
        encoder = Encoder(v)
        for batch in batches:
            for part in pieces(batch, text_bytes(batch.column(1)), PIECE_BYTES):
                ids, n = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                each = np.split(ids.astype("<u4"), np.cumsum(n)[:-1])
                decoded = [decode_ids(v, x.tolist()) for x in each]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array([x.tobytes() for x in each], pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")
