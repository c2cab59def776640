"""Sharding, chat formatting and nearest neighbours."""

import hashlib
import pathlib
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from plumeline.llm import ann, chat, shards
from plumeline.llm.scratch import shared_folder


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, depth int, h int, shard string")


def check_shards(got, limit):
    by = {}
    for r in got:
        by.setdefault((r.shard, r.part), []).append(r)
    for own in by.values():
        assert sum(r.bytes for r in own) <= limit or len(own) == 1
    names = sorted({r.shard for r in got})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False)), "a shard's prefix covers no other"


@pytest.mark.parametrize("limit", [10, 300, 10**6])
def test_shards_fit(spark, limit):
    rows = [(i, "ä" * (i % 40)) for i in range(300)] + [(None, "abc"), (None, None), (7, "repeat"), (7, "repeat"), (999, "x" * 5000)]
    got = shards.assign_shards(docs(spark, rows), limit).collect()
    assert len(got) == len(rows)
    assert sorted(r.bytes for r in got) == sorted(len((t or "").encode()) for _, t in rows)
    check_shards(got, limit)
    if limit == 10**6:
        assert {r.shard for r in got} == {""}


def test_one_key_is_dealt_by_place(spark):
    got = shards.assign_shards(docs(spark, [(5, "y" * 30)] * 200 + [(6, "z")]), 100).collect()
    check_shards(got, 100)
    assert len({r.part for r in got if r.bytes == 30}) >= 60
    assert shards.assign_shards(docs(spark, []), 100).count() == 0


def test_shards_need_no_python(spark):
    plan = shards.assign_shards(docs(spark, [(i, "t") for i in range(5)]), 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_write_shards(spark, tmp_path):
    shards.write_shards(docs(spark, [(i, "t" * 9) for i in range(40)]).select("doc_id", "text"), str(tmp_path / "out"), 100)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_write_shards_writes_each_row_once(spark, tmp_path):
    """Of repeated ids, one too large for a shard, of null ids and of a column named like a folder's."""
    rows = [(5, "y" * 30 + str(i)) for i in range(200)] + [(6, "z")] * 3 + [(None, "abc"), (None, None)] + [(100 + i, "") for i in range(20)]
    shards.write_shards(docs(spark, rows), str(tmp_path / "out"), 100)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault((r.shard, r.part), []).append(len(r.text or ""))
    assert all(sum(n) <= 100 or len(n) == 1 for n in by.values())


def test_a_shallow_shard_below_the_even_spread(spark):
    """One huge text makes the even spread deep, though all others fit a shard of few bits."""
    rows = [(i, "t") for i in range(50)] + [(99, "x" * 300_000)]
    got = shards.assign_shards(docs(spark, rows), 100).collect()
    check_shards(got, 100)
    key = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    for r in got:
        fits = lambda d: sum(len(t) for i, t in rows if key(i) >> (60 - d) == key(r.doc_id) >> (60 - d)) <= 100  # noqa: B023, E731
        assert r.doc_id == 99 or r.depth == next(d for d in range(61) if fits(d))


def test_scratch_without_a_shared_folder():
    """A local session gets a temporary folder, a cluster an error."""
    code = "from pyspark.sql import SparkSession; from plumeline.llm.scratch import Scratch; s = SparkSession.builder.master('{}').config('spark.ui.enabled', 'false').getOrCreate(); print(Scratch(s, 't').write(s.range(3), 'x').count())"
    run = subprocess.run([sys.executable, "-c", code.format("local[1]")], capture_output=True, text=True, cwd=pathlib.Path(__file__).parents[2], timeout=240)
    assert run.stdout.strip() == "3"
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf={}, sparkContext=context))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|turn|>", "a\\b"]), st.text(alphabet=st.sampled_from("ab\\<|>/[]INSTs turnext\nend")) | st.sampled_from(chat.CONTROLS)), max_size=6))
def test_template_is_reversible(turns):
    made, mask = chat.format_turns(turns)
    assert chat.parse_turns(made) == turns
    assert "".join(chat.unescape(made[a:z]) for a, z in mask) == "".join(t for r, t in turns if r == "assistant")
    for _, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def messages(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "tree string, id long, parent long, role string, text string, score double, pos int, leaf int")


def test_reply_trees(spark):
    rows = [("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "good", 5.0), ("a", 3, 1, "assistant", "bad", 1.0), ("a", 4, 2, "user", "more", None), ("a", 5, 3, "user", "why", 0.0),
            (None, 1, None, "user", None, 0.0), ("b", 1, 99, None, "orphan", 0.0), ("c", 1, 2, "user", "round", 0.0), ("c", 2, 1, "user", "and round", 0.0), ("a", 2, 1, "assistant", "good", 5.0), ("d", None, None, "user", "no id", 0.0)]
    made = chat.read_back(chat.format_trees(messages(spark, rows), "tree", "id", "parent", score_col="score", branches=2)).collect()
    got = {(r.tree, r.branch): [(t.role, t.text) for t in r.turns] for r in made}
    assert got == {("a", 1): [("user", "q"), ("assistant", "good"), ("user", "more")], ("a", 2): [("user", "q"), ("assistant", "bad"), ("user", "why")], (None, 1): [("user", "")], ("b", 1): [("", "orphan")]}
    assert {r.loss_text for r in made if r.tree == "a"} == {"good", "bad"}


def test_long_chain_and_ties(spark):
    rows = [("x", 0, "user", f"t{i}") for i in range(3)] + [("x", 0, "user", "t1")] + [("y", i, "assistant" if i % 2 else "user", f"m{i}") for i in range(130)] + [(None, 1, "user", "n")]
    c = spark.createDataFrame([(*r, 7) for r in rows], "conv_id string, turn long, role string, text string, node int")
    got = {r.tree: [t.text for t in r.turns] for r in chat.read_back(chat.format_trees(chat.chain(c), "conv_id", "node", "parent")).collect()}
    assert got == {"x": ["t0", "t1", "t1", "t2"], "y": [f"m{i}" for i in range(130)], None: ["n"]}
    assert chat.format_trees(chat.chain(c.where("false")), "conv_id", "node", "parent").count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], 1, "s") for i, x in rows], "vec_id long, embedding array<float>, rank int, score string")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    got = ann.nearest(vectors(spark, list(enumerate(x))), every=50, k=10, rerank=64).toPandas()
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    recall = np.mean([len(set(g.vec_id) & set(np.argsort(-s[q])[:10])) / 10 for q, g in got.groupby("query_id")])
    assert recall >= 0.95 and len(got) == 60 * 10
    assert np.allclose(got.score, [s[q, v] for q, v in zip(got.query_id, got.vec_id, strict=True)])


def test_recall_over_several_blocks_of_vectors_and_of_queries(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 24)).astype(np.float32)
    v = vectors(spark, list(enumerate(x))).repartition(3)
    got = ann.nearest(v, queries_at_a_time=30, block=300).toPandas()
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    recall = np.mean([len(set(g.vec_id) & set(np.argsort(-s[q])[:20])) / 20 for q, g in got.groupby("query_id")])
    assert recall >= 0.9 and len(got) == 200 * 20
    assert np.allclose(got.score, [s[q, w] for q, w in zip(got.query_id, got.vec_id, strict=True)])


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_registered_query(spark, sf):
    """As registered, against all inner products: at least 0.9 of the exact answers, and exact scores."""
    from plumeline.llm.queries import op10_nearest_neighbours

    sf_dir = f"/root/testdata/sf{sf}"
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ok = [e is not None and len(e) > 0 and np.isfinite(np.array(e, float)).all() and np.any(np.array(e, float)) for e in v.embedding]
    v = v[ok]
    ids, x = v.vec_id.to_numpy(), np.array(v.embedding.tolist(), np.float64)
    got = op10_nearest_neighbours(spark, sf_dir).toPandas()
    at = {i: k for k, i in enumerate(ids.tolist())}
    asked = [i for i in ids.tolist() if i % 20 == 0]
    hit = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        score = x @ x[at[q]]
        other = ids != q
        order = np.lexsort((ids[other], -score[other]))[:20]
        hit += len(set(ids[other][order]) & set(g.vec_id))
        assert np.allclose(g.score, score[[at[i] for i in g.vec_id]]) and list(g["rank"]) == list(range(1, len(g) + 1))
    assert set(got.query_id) == set(asked) and hit >= 0.9 * len(asked) * min(20, len(ids) - 1)


def test_ann_where_a_third_of_the_vectors_are_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    ids = rng.permutation(3000)
    x[::3] = 3 * x[0]
    got = ann.nearest(vectors(spark, list(zip(ids.tolist(), x, strict=True))), every=100, k=20, rerank=32).collect()
    copies = sorted(ids[::3].tolist())
    asked = [i for i in copies if i % 100 == 0]
    assert asked
    for q in asked:
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for i in copies if i != q][:20]


def test_ann_awkward(spark):
    rows = [(0, [1, 0]), (20, [1, 1]), (1, [2, 0]), (2, [2, 0]), (3, None), (4, [0, 0]), (5, [float("nan"), 1]), (6, [float("inf"), 1]), (7, [None, 1]), (None, [1, 1]), (8, []), (9, [1, 2, 3]), (0, [1, 0])]
    good = vectors(spark, [r for r in rows if r[1] is None or len(r[1]) != 3])
    got = ann.nearest(good, every=20, k=20).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r.rank)) if r.query_id == 20] == [(1, 2.0), (2, 2.0), (0, 1.0), (0, 1.0)]
    assert {r.vec_id for r in got if r.query_id == 0} == {1, 2, 20}
    assert ann.nearest(good.where("false")).count() == 0
    assert ann.nearest(good.where("vec_id in (1, 2)")).count() == 0


def test_anisotropic_loss_prefers_parallel_accuracy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    def parallel(z):
        c = z.encode(x)
        back = np.take_along_axis(z.books, c.T[:, :, None], 1).transpose(1, 0, 2).reshape(len(x), -1)
        return np.mean(((x - back) * x).sum(axis=1) ** 2)
    assert parallel(ann.fit_quantiser(x, 0.4)) < parallel(ann.fit_quantiser(x, 0.0))
