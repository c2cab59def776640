"""Scores, classifier, BPE and decontamination: brute force, exact round trips and held-out accuracy."""

import binascii
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumeline.llm import bpe, decontaminate, lm, quality
from plumeline.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, label int, block long, word string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 9, 9, "x", 9) for i, t in rows], DOCS)


def crc(i, n):
    return binascii.crc32(b"" if i is None else str(i).encode()) % n


AWKWARD = [(None, "the cat sat"), (1, None), (2, ""), (3, " \n"), (4, "The CAT sat on the mat"), (4, "The CAT sat on the mat"), (5, "word " * 50_000)]


def test_lm_base_and_tokens(spark):
    rows = AWKWARD + [(10 + i, f"the cat number {i % 5} sat on mat {i}") for i in range(60)]
    got = lm.score_texts(docs(spark, rows)).collect()
    tokens = lambda t: [*(t or "").lower().split(), None]
    c = Counter(w for i, t in rows if crc(i, 7) != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), crc(i, 7) == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 10]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


CELLS = "context long, pair long, word long, n long"


def test_lm_mixture_is_a_distribution(spark):
    """For any context the probabilities of all words and one unknown sum to one."""
    counts = {("a", "b"): 3, ("a", "c"): 1, ("b", "a"): 4}
    unigram = {"a": 4, "b": 3, "c": 1}
    w = lm.learn_weights(spark.createDataFrame([], CELLS), 8, 3)[int(lm.context_class(np.array([4]))[0])]
    total = sum(w[0] * counts.get(("a", x), 0) / 4 + w[1] * unigram[x] / 8 + w[2] / 4 for x in unigram) + w[2] / 4
    assert total == pytest.approx(1)


def test_lm_em_raises_likelihood(spark):
    w = lm.learn_weights(spark.createDataFrame([(5, 4, 1, 90), (5, 0, 1, 10)], CELLS), 1000, 1000)
    assert w[3][0] > 0.7 and w[3].sum() == pytest.approx(1)
    assert w[0][0] == 0


def brute_lm(rows):
    """Scores by plain dictionaries: counts, expectation-maximisation on the deleted fold, mixture."""
    tokens = lambda t: [*(t or "").lower().split(), None]
    pairs = lambda t: list(zip([None, *tokens(t)], tokens(t), strict=False))
    count = lambda ok: tuple(Counter(x for i, t in rows if ok(crc(i, 7)) for x in of(t)) for of in (tokens, pairs))
    (word, pair), (word_left, pair_left) = count(lambda k: k != 2), count(lambda k: k not in (2, 3))
    n, v, left = sum(word.values()), len(word), sum(word_left.values())
    klass = lambda c: min(c.bit_length(), lm.CLASSES - 1)
    seen = [(klass(word_left[a]), pair_left[a, b] / max(word_left[a], 1), word_left[b] / max(left, 1), 1 / (v + 1)) for i, t in rows if crc(i, 7) == 3 for a, b in pairs(t)]
    weights = {}
    for k in (*range(lm.CLASSES), None):
        own, w = np.array([s[1:] for s in seen if k is None or s[0] == k]), np.full(3, 1 / 3)
        for _ in range(lm.ROUNDS if len(own) else 0):
            part = own * w
            w = np.maximum((part / part.sum(axis=1, keepdims=True)).mean(axis=0), 1e-6)
            w /= w.sum()
        weights[k] = w if len(own) else None
    weights = [weights[None] if w is None else w for w in weights.values()]
    weights[0] = np.array([0, *(weights[0][1:] / weights[0][1:].sum())])
    p = lambda a, b: weights[klass(word[a])] @ [pair[a, b] / max(word[a], 1), word[b] / max(n, 1), 1 / (v + 1)]
    return sorted((str(i), round(sum(math.log10(p(a, b)) for a, b in pairs(t)), 5)) for i, t in rows)


@pytest.mark.parametrize("sizes", [{}, {"bits": 5, "fan": 2, "team": 2}])
def test_lm_scores_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(6)
    rows = AWKWARD + [(10 + i, " ".join(f"w{min(int(rng.zipf(1.4)), 60)}" for _ in range(int(rng.integers(0, 40))))) for i in range(200)]
    got = lm.score_texts(docs(spark, rows).repartition(6), **sizes).collect()
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in got) == brute_lm(rows)


def test_lm_without_training(spark):
    only_held = [(i, "a b") for i in range(200) if crc(i, 7) == 2][:3]
    got = lm.score_texts(docs(spark, only_held)).collect()
    assert len(got) == 3 and all(r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert lm.score_texts(docs(spark, [])).count() == 0


def test_quality_held_out_accuracy(spark, sf_dir):
    d, lab = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet"), spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet")
    scored = quality.quality_scores(d, lab).join(lab, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.95
    assert np.mean([r.predicted for r in scored if r.quality == 1]) > 0.97


def test_quality_awkward(spark):
    rows = AWKWARD + [(10 + i, "plain prose about nothing much. " * (i % 7 + 1)) for i in range(40)] + [(100 + i, "SHOUT!! $$$ ### " * (i % 5 + 1)) for i in range(40)]
    lab = spark.createDataFrame([(10 + i, 1, 5) for i in range(40)] + [(100 + i, 0, 5) for i in range(40)] + [(None, 1, 5), (10, None, 5), (11, 7, 5)], "doc_id long, quality int, text int")
    got = quality.quality_scores(docs(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == (r.doc_id < 100) for r in got if r.doc_id and r.doc_id >= 10)
    none = quality.quality_scores(docs(spark, rows), lab.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    one = quality.quality_scores(docs(spark, rows), lab.where("quality = 1")).collect()
    assert len({round(r.score, 9) for r in one}) == 1 and one[0].score > 0.5
    assert quality.quality_scores(docs(spark, []), lab).count() == 0


ODD = ["Hello <|startoftext|> world's ΣΑΣ İstanbul", "a\x85b c\x1cd", "ﬁ Å I'LL don't 12 ½²", "<|endoftext|>x<|ENDOFTEXT|>", "\x00\x01 \x00<|x <a<|endoftext|", "日本語 テスト", "\U0001f600 a_b-c", "₝՘", "", "   ", "a" * 3000, "aaaa aaa ababab " * 20, "e<|endoftext|>́"]


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    rows = [*enumerate(ODD), (None, "x y"), (99, None)]
    got = {r.doc_id: r for r in bpe.encode_decode(docs(spark, rows), vocabulary_path()).collect()}
    for i, text in rows:
        e = t.encode(text or "", add_special_tokens=False)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == e.ids and got[i].n_tokens == len(e.ids)
        assert got[i].decoded == t.decode(e.ids, skip_special_tokens=False)
    assert bpe.encode_decode(docs(spark, []), vocabulary_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(text):
    from tokenizers import Tokenizer

    v = test_bpe_any_text.__dict__.setdefault("v", (bpe.Vocabulary(vocabulary_path()), Tokenizer.from_file(vocabulary_path())))
    ids, n = bpe.Encoder(v[0]).encode([text])
    assert ids.tolist() == v[1].encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids)]


def brute_hits(text, items, width):
    w = decontaminate.match_words(None if text is None else text.encode())
    hit, who = set(), set()
    for name, t in items:
        for win in decontaminate.windows(decontaminate.match_words(None if t is None else t.encode()), width):
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    who.add("" if name is None else str(name))
    return len(w), len(hit), sorted(who)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_ROWS, 0])
def test_decontamination(spark, most):
    item = "alpha beta gamma delta epsilon zeta"
    items = [(1, item), (2, "the the the the"), (3, "Short one"), (4, None), (5, " ... "), (None, "beta gamma delta"), (6, item), (10, "é É ø2 3x")]
    rows = AWKWARD + [(20, f"x {item.upper()} y"), (21, "alpha, beta; gamma! delta"), (22, "the " * 9), (23, "it is short one!"), (24, "é É ø2 3x"), (25, "beta gamma"), (20, item * 2)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.find_contamination(docs(spark, rows), bench, width=4, broadcast_rows=most).collect()
    want = sorted((str(i), *brute_hits(t, items, 4)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, sum(s.stop - s.start for s in r.spans), r["items"]) for r in got) == want
    assert decontaminate.find_contamination(docs(spark, []), bench).count() == 0
    clean = decontaminate.drop_contaminated(docs(spark, rows), bench, width=4, broadcast_rows=most)
    assert clean.columns == docs(spark, []).columns
    assert sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == sorted((str(i), str(t)) for i, t in rows if not brute_hits(t, items, 4)[1])
    assert all(not r["items"] for r in decontaminate.find_contamination(docs(spark, rows), bench.where("false")).collect())


def test_a_passage_of_many_items_in_many_documents(spark):
    """A place meets its window's set of items, not the items; digests equal those of the lists."""
    shared = "one passage that every item and every document has in it"
    items = [(i, f"{shared} item {i} of its own kind") for i in range(200)]
    rows = [(i, f"document {i} says {shared} and stops") for i in range(150)] + [(900, items[7][1]), (901, None)]
    own = decontaminate._known(docs(spark, rows).select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    places, owners, sets, _ = decontaminate._found(own, bench, 5, "item_id", "text", decontaminate.BROADCAST_ROWS)
    _, met = decontaminate._marks(places, sets, True)
    assert sets.select("a", "b", "n").distinct().count() == 201
    assert met.count() == 152  # the shared set once a document, and one item's own
    plain = {r.doc_id: (r.n_words, r.spans, r["items"]) for r in decontaminate.find_contamination(docs(spark, rows), bench, width=5).collect()}
    assert {k: (n, sum(s.stop - s.start for s in spans), names) for k, (n, spans, names) in plain.items()} == {k: brute_hits(t, items, 5) for k, t in rows}
    for r in decontaminate.find_contamination(docs(spark, rows), bench, width=5, digest=True).collect():
        n, spans, names = plain[r.doc_id]
        assert (r.n_words, r.spans, r.n_items, r.items_sha256) == (n, spans, len(names), hashlib.sha256(",".join(names).encode()).hexdigest())


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_ROWS, 50])
def test_a_benchmark_larger_than_the_documents(spark, most):
    rng = np.random.default_rng(4)
    word = lambda: f"w{int(rng.zipf(1.3)) % 400}"
    items = [(i, " ".join(word() for _ in range(int(rng.integers(0, 40))))) for i in range(300)]
    rows = [(i, " ".join(word() for _ in range(40)) + " " + items[i][1][20:80]) for i in range(60)]
    got = decontaminate.find_contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), width=5, broadcast_rows=most).collect()
    assert sorted((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), r["items"]) for r in got) == [(i, *brute_hits(t, items, 5)) for i, t in rows]
    assert any(r["items"] for r in got)


def test_discriminant_matches_direct_density():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(300, quality.D)), rng.normal(loc=0.5, scale=1.5, size=(200, quality.D))]
    m = quality.fit(np.array([300.0, 200.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), 0.3, 0.02)
    p = rng.normal(size=quality.D)
    dens = []
    every = sum(((a - a.mean(0)).T @ (a - a.mean(0))) for a in x) / 500 + 1e-6 * np.eye(quality.D)
    for k, a in enumerate(x):
        cov = 0.7 * np.cov(a.T, bias=True) + 0.3 * every
        cov = 0.98 * cov + 0.02 * np.diag(np.diag(every))
        d = p - a.mean(0)
        dens.append(np.log([301, 201][k] / 502) - 0.5 * (d @ np.linalg.solve(cov, d) + np.linalg.slogdet(cov)[1]))
    assert m.score(p[None])[0] == pytest.approx(1 / (1 + np.exp(dens[0] - dens[1])))
