"""Token counts against the library, ranked search and the prefix trie against brute force."""

import binascii
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

from plumeline.llm import ranked, transducer, trie
from plumeline.llm.queries import rebuilt, vocabulary_path
from plumeline.llm.scratch import Scratch

MODEL = "piece_bpe_32k.model"
CLASH = "doc_id long, text string, item string, term string, q long, score double, docs long, piece string"
AWKWARD = [(None, "the cat sat"), (1, None), (2, ""), (3, " \n"), (4, "The CAT sat on the mat"), (4, "The CAT sat on the mat"), (5, "word " * 50_000), (6, "日本語 \U0001d4b3 ▁a </s><0x0A>\0"), (7, "x" * 30_001)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "i", "t", 1, 0.5, 3, "p") for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def machine():
    return transducer.Transducer(transducer.read_pieces(vocabulary_path(MODEL)))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(MODEL))


def test_counts_equal_the_library(machine, library, monkeypatch):
    draw = random.Random(7)
    known = [p for p in list(machine.rank)[:4000] if "▁" not in p]
    texts = ["", " ", "  a", "▁", "a" * 5000, " " * 3000, "aab" * 900, "=-" * 700]
    texts += ["".join(draw.choice("aeinrst éß\n日") for _ in range(draw.randrange(900))) for _ in range(40)]
    texts += ["".join(draw.choice(known) for _ in range(900)) for _ in range(4)]  # no place where the transducer starts again
    want = [len(library.encode(t)) for t in texts]
    assert machine.count(texts).tolist() == want
    monkeypatch.setattr(transducer, "WINDOW", 1024)
    assert machine.count(texts).tolist() == want
    monkeypatch.setattr(transducer, "MAX_STATES", 1000)
    n = len(machine.states)
    machine.trim()
    assert len(machine.states) < n
    assert machine.count(texts).tolist() == want


def test_maps_compose_over_open_chunks(machine):
    """Entering an open chunk in any state of its table gives what reading on from there gives."""
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(256 * 9))
    cls = machine.class_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int32)
    reset = np.zeros(len(cls), bool)
    reset[0] = True
    added, last = machine.window(cls, reset, 0)
    s = np.zeros(1, np.int64)
    for k, c in enumerate(cls):
        s, n = machine.advance(s, np.array([c]))
        assert n[0] == added[k]
    assert s[0] == last


def test_count_tokens_of_awkward_rows(spark, library):
    got = transducer.count_tokens(docs(spark, AWKWARD), vocabulary_path(MODEL))
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or ""))) for i, t in AWKWARD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert transducer.count_tokens(docs(spark, []), vocabulary_path(MODEL)).count() == 0


def test_registered_counts(spark, sf_dir, library):
    from plumeline.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op11_token_counts"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_search(rows, items, k):
    split = [(i, Counter(TERM.findall(lower(t)))) for i, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in split), sum(sum(c.values()) for _, c in split)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(TERM.findall(lower(t)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in split:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in d for _, d in split) + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(str(item), r, str(x[3]), -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"SHORT": 3, "SPAN": 4}, {"SHORT": 30, "SPAN": 7, "BLOCK_DOCS": 16}])
def test_search_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked, name, value)
    draw = random.Random(11)
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(400)]
    rows = AWKWARD[:-1] + [(100 + i, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 40)))) for i in range(150)]
    rows += [(300 - i, "Same w1 w2, w3 text") for i in range(40)] + [(299, "Same w1 w2, w3 text"), (None, "same W1 w2 w3 text")]
    items = [(1, "w1 w2 w3 same"), (2, None), (3, "absent wörter 日本語"), (None, "cat mat"), (4, "w5 w9-w1 w1"), (4, "sat on"), (5, " ".join(words))]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id long, term string")
    want = brute_search(rows, items, 9)
    for terms in (ranked.TERMS, 40):
        got = ranked.search(docs(spark, rows).repartition(3), table, k=9, terms=terms).collect()
        assert sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in got) == want
    assert ranked.search(docs(spark, []), table).count() == 0
    assert ranked.search(docs(spark, rows), table.where("false")).count() == 0


def test_a_long_text_is_split_in_parts(monkeypatch):
    text = ("Some words, und Wörter 12;" * 300).encode()
    whole = [w for ws in ranked.split_terms(text) for w in ws]
    monkeypatch.setattr(ranked, "PIECE_BYTES", 50)
    parts = list(ranked.split_terms(text))
    assert len(parts) > 50 and [w for ws in parts for w in ws] == whole == [w.encode() for w in TERM.findall(lower(text.decode()))]


def test_bounds_skip_documents():
    """Lists that cannot reach the least score are looked up, not read."""
    best = ranked.Best(2)
    long = (np.arange(10_000), np.ones(10_000, np.int64), 1)
    rare = (np.array([7, 9_000]), np.array([50, 60]), 60)
    ranked.search_block([long, rare], np.arange(10_000), best)
    assert best.score.tolist() == [61, 51] and best.id.tolist() == [9_000, 7] and best.least == 51


def brute_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in by.items()}
    made = {c: by.get(c - int(math.fmod(c, 100)), [])[: (h := binascii.crc32(str(c).encode()) % 6)] + x[h:] for c, x in by.items()}
    nodes = defaultdict(list)
    for c, x in made.items():
        for d in range(len(x) + 1):
            nodes[tuple(x[:d])].append(c)
    out = []
    for p, cs in nodes.items():
        sub = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in sub if len(q) == len(p) + 1]
        leaves = [q for q in sub if not any(len(z) > len(q) and z[: len(q)] == q for z in sub)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in sub if q)
        ends = hashlib.sha256(",".join(map(str, sorted(c for c in cs if len(made[c]) == len(p)))).encode()).hexdigest()
        out.append((min(cs), len(p), str(min(nodes[p[:-1]]) if p else None), len(cs), len(kids), len(leaves), saved, ends))
    return sorted(out)


TURNS = "conv_id long, turn long, role string, text string, node long, up string"


@pytest.mark.parametrize("run", [2, 4096])
def test_trie_equals_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(trie, "RUN", run)
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", None, "ü"])) for c in [*range(60), *range(100, 140), 205, -30, 1_000_000_007] for t in range(draw.randrange(0, 6))]
    rows += [(0, None, "system", "x"), (0, None, "system", "x"), (3, 2, "user", "a"), (None, 0, "user", "lost")] + [(600, t, "user", "deep" * (t % 3)) for t in range(70)] + [(699, 0, "user", "q")]
    table = spark.createDataFrame([(*r, 1, "u") for r in rows], TURNS)
    got = trie.prefix_trie(*rebuilt(table)).collect()
    assert sorted((r.conv_id, r.depth, str(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(*rebuilt(spark.createDataFrame([], TURNS))).count() == 0


def test_places_and_digests_over_parts(spark):
    """Places count on over the parts of one large key, and ids over the rows that they are joined to."""
    scratch = Scratch(spark, "parts")
    rows = spark.range(0, 5000, 1, 8).selectExpr("1L AS k", "id")
    got = [r.pos for r in trie.numbered(rows, "k", ["id"], scratch).orderBy("id").collect()]
    assert got == list(range(1, 5001))
    ends = spark.range(0, 3000, 1, 8).selectExpr("CASE WHEN id < 2900 THEN 1L ELSE id END AS node", "id AS conv")
    trie_blob = trie.BLOB_BYTES
    try:
        trie.BLOB_BYTES = 500
        found = {r.node: r.digest for r in trie._digests(ends, Scratch(spark, "digests")).collect()}
    finally:
        trie.BLOB_BYTES = trie_blob
    assert len(found) == 101 and found[1] == hashlib.sha256(",".join(map(str, range(2900))).encode()).hexdigest()
    assert found[2950] == hashlib.sha256(b"2950").hexdigest()


def test_subtree_sums_of_a_long_chain_and_a_star(spark):
    rows = [(0, None, 0, 1)] + [(i, i - 1, i, 1) for i in range(1, 200)] + [(1000 + i, 0, 1, 2) for i in range(50)]
    tree = spark.createDataFrame(rows, "node long, up long, depth long, w long")
    got = {r.node: r.w for r in trie.subtree_sums(tree, ["w"], Scratch(spark, "chain")).collect()}
    assert got == {0: 300} | {i: 200 - i for i in range(1, 200)} | {1000 + i: 2 for i in range(50)}
