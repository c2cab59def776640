"""Language-model scores of texts by deleted interpolation.

A bigram model mixes three maximum-likelihood estimates: of a token after the one before it, of the
token alone, and the uniform one over the vocabulary and one unknown token. The weights depend on
how frequent the context is, one set for each doubling. They are learned by expectation-maximisation:
a fold of the training texts is deleted from the counts, and its own counts are what the mixture of
the rest has to predict. Scores then use the counts of all training texts.

Counts of words and word pairs are exchanged between blocks of documents and buckets of keys (see
`blocks`): nothing that grows with the corpus comes to the driver or to every executor. The deleted
fold's tokens are counted by their exact estimates in a table, over which each round of the
expectation-maximisation is an aggregate: the driver sees three sums, and weights of a few classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .blocks import FAN_BITS, TEAM, Block, block_table, bucket_bits, exchange, mix, with_answers
from .scratch import Scratch
from .text import fold, pick

TRAIN, DELETED, HELD_OUT = 0, 1, 2
ASK = np.dtype([("c", "u8"), ("d", "u8"), ("word", "u1")])
TOLD = np.dtype([("c", "u8"), ("d", "u8")])
#: The token that ends a text, and stands before its first.
END = np.uint64(0x5851F42D4C957F2D)
PAIR = np.uint64(0x2545F4914F6CDD1D)
#: Context classes: never seen, then one for each power of two.
CLASSES = 32
#: Bytes of text in a block: a task holds several numbers for each of its tokens.
BLOCK_BYTES = 5_000_000
#: Rounds of expectation-maximisation.
ROUNDS = 20
SCHEMA = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _tokens(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of the block, hashes of its pairs, and the number of tokens of each text."""
    split = [t.lower().split() if t else [] for t in b.texts]
    n = np.array([len(w) + 1 for w in split], np.int64)
    h = np.full(int(n.sum()), END)
    ends = np.cumsum(n) - 1
    inner = np.ones(len(h), bool)
    inner[ends] = False
    h[inner] = np.frombuffer(b"".join(xxh64_digest(x) for w in split for x in w), ">u8").astype(np.uint64)
    before = np.r_[END, h[:-1]] if len(h) else h
    return h, mix(mix(before) * PAIR + h), n


def _ask(b: Block) -> tuple[np.ndarray, np.ndarray]:
    h, pair, _ = _tokens(b)
    u, nu = np.unique(h, return_counts=True)
    p, np_ = np.unique(pair, return_counts=True)
    keys = np.r_[u, p]
    order = np.argsort(keys)
    n = np.r_[nu, np_].astype(np.uint64)[order]
    vals = np.empty(len(keys), ASK)
    vals["c"], vals["d"] = n * (b.fold != HELD_OUT), n * (b.fold == DELETED)
    vals["word"] = order < len(u)
    return keys[order], vals


def _answer(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Training and deleted counts of each key; of the bucket: distinct words, tokens, deleted tokens."""
    first = np.r_[True, keys[1:] != keys[:-1]]
    at, run = np.flatnonzero(first), np.cumsum(first) - 1
    c, d = np.add.reduceat(vals["c"], at), np.add.reduceat(vals["d"], at)
    word = vals["word"][at] > 0
    out = np.empty(len(keys), TOLD)
    out["c"], out["d"] = c[run], d[run]
    return out, [int(np.count_nonzero(c[word])), int(c[word].sum()), int(d[word].sum())]


def _counts(b: Block, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Told figures of each token, its context and their pair, and the number of tokens of each text."""
    h, pair, n = _tokens(b)
    u, iu = np.unique(h, return_inverse=True)
    end = int(np.searchsorted(u, END))
    words = len(u)
    del h
    p, ip = np.unique(pair, return_inverse=True)
    back = np.empty_like(told)
    back[np.argsort(np.r_[u, p])] = told
    word = back[:words][iu]
    context = np.r_[back[end], word[:-1]] if len(word) else word
    return word, context, back[words:][ip], n


def context_class(c: np.ndarray) -> np.ndarray:
    """0 for a context that training never had, else 1 plus the whole part of its count's log2."""
    return np.where(c > 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(np.int64), CLASSES - 1), 0)


def _held(b: Block, told: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many of a deleted block's tokens have which counts of context, pair and word without the fold."""
    word, context, pair, _ = _counts(b, (told["c"] - told["d"]).astype(np.int64))
    counts = np.stack([context, pair, word])
    counts = counts[:, np.lexsort(counts)]
    at = np.flatnonzero(np.r_[True, np.any(counts[:, 1:] != counts[:, :-1], axis=0)]) if counts.size else np.zeros(0, np.int64)
    n = np.diff(np.r_[at, counts.shape[1]])
    yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in counts), pa.array(n, pa.int64())], ["context", "pair", "word", "n"])


def learn_weights(cells: DataFrame, tokens: int, vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (class, [pair, word, uniform]) that maximise the likelihood of the tokens of cells (context, pair, word, n).

    Each round is one aggregate over the cells. Classes without deleted tokens take the weights of
    all tokens together; without any tokens the weights are equal. A floor keeps every text possible.
    """
    c = F.col("context").cast("double")
    klass = F.when(c > 0, F.least(F.length(F.bin("context")), F.lit(CLASSES - 1))).otherwise(0).cast("int")
    p = [F.when(c > 0, F.col("pair") / c).otherwise(0.0), F.col("word") / F.lit(float(max(tokens, 1))), F.lit(1 / (vocabulary + 1))]
    rows = cells.select("n", F.array(*p).alias("p"), F.explode(F.array(klass, F.lit(CLASSES))).alias("k"))
    w = np.full((CLASSES + 1, 3), 1 / 3)
    for _ in range(rounds):
        now = F.array(*(F.lit(float(x)) for x in w.ravel()))
        part = [F.col("p")[i] * F.get(now, F.col("k") * 3 + i) for i in range(3)]
        sums = rows.select("k", "n", *(x.alias(f"s{i}") for i, x in enumerate(part)), (part[0] + part[1] + part[2]).alias("all")).groupBy("k")
        for r in sums.agg(*(F.sum(F.col("n") * F.col(f"s{i}") / F.col("all")) for i in range(3)), F.sum("n")).collect():
            share = np.maximum(np.array(r[1:4]) / r[4], 1e-6)
            w[r[0]] = share / share.sum()
    seen = {r.k for r in rows.select("k").distinct().collect()}
    out = np.stack([w[k] if k in seen else w[CLASSES] for k in range(CLASSES)])
    out[0] = [0, *(out[0, 1:] / out[0, 1:].sum())]
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, deleted: int = 3, bits: int | None = None, fan: int = FAN_BITS, team: int = TEAM) -> DataFrame:
    """One row per row of docs: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Texts whose id has crc32 remainder `held_out` modulo `folds` take no part in training; those
    with the remainder `deleted` are the deleted fold that the weights are learned on. Tokens are
    the words with A-Z lowered, then one end. base_score sums log10((c+1)/(N+V+1)) over a text's
    tokens, score the model's log10 probabilities; both are of the natural length, not per token.
    A null text is empty: one token, the end. A null id counts as empty text for the fold. Repeated
    rows count and are scored each. Without training texts all estimates are uniform. Very long texts
    are taken whole. Other columns are left out. bits, fan and team size the exchange of counts.
    """

    def fold_of(i: object) -> int:
        k = fold(i, folds)
        return HELD_OUT if k == held_out else DELETED if k == deleted else TRAIN

    scratch = Scratch(docs.sparkSession, "lm")
    blocks = block_table(pick(docs, doc_id=id_col, text=text_col), scratch, "blocks", fold_of, BLOCK_BYTES)
    answers = scratch.write(exchange(blocks, _ask, _answer, ASK, TOLD, bucket_bits(blocks) if bits is None else bits, scratch, None, ("c", "d"), fan, team), "answers")
    sums = answers.where("tally is not null").agg(*(F.coalesce(F.sum(F.col("tally")[k]), F.lit(0)) for k in range(3))).first()
    vocabulary, tokens, gone = int(sums[0]), int(sums[1]), int(sums[2])
    own = lambda df: df.where(F.pmod("block", F.lit(8)) == DELETED)
    cells = with_answers(own(blocks), own(answers), TOLD, _held, "context long, pair long, word long, n long")
    cells = scratch.write(cells.groupBy("context", "pair", "word").agg(F.sum("n").alias("n")), "cells")
    weights = learn_weights(cells, tokens - gone, vocabulary)

    def use(b: Block, told: np.ndarray) -> Iterator[pa.RecordBatch]:
        c, ctx, pair, n = _counts(b, told["c"].astype(np.float64))
        w = weights[context_class(ctx)]
        p = w[:, 0] * pair / np.maximum(ctx, 1) + w[:, 1] * c / max(tokens, 1) + w[:, 2] / (vocabulary + 1)
        at = np.cumsum(n) - n
        base = np.add.reduceat(np.log10((c + 1) / (tokens + vocabulary + 1)), at)
        score = np.add.reduceat(np.log10(p), at)
        known = np.add.reduceat((c > 0).astype(np.int64), at)
        same = lambda v, t: pa.array(np.full(len(n), v), t)
        yield pa.RecordBatch.from_arrays([b.ids, same(b.fold == HELD_OUT, pa.bool_()), pa.array(n), pa.array(known), same(tokens, pa.int64()), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_answers(blocks, answers, TOLD, use, SCHEMA.format(docs.schema[id_col].dataType.simpleString()))
