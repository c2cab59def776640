"""Near-duplicate, line and substring dedup against brute force, with awkward rows."""

import json
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumeline.llm import blocks, lines, simhash, substring

SCHEMA = "doc_id long, text string, fp long, rep string, key string, block int, node long, body string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", "k", 2, 3, "b") for i, t in rows], SCHEMA)


def awkward():
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word7 ", "changed ")
    rows = [(1, base), (2, near), (3, base), (3, base), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "ONE  two"), (None, base), (9, LONG), (10, "ä ö Ü"), (11, "A\nA \n a\nb")]
    return rows + [(100 + i, f"{base} tail{i} {'x ' * i}") for i in range(12)]


def brute_fp(text, size=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if linked(i, j) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("size", [1, 3, 5])
def test_fingerprints_of_texts_in_parts(monkeypatch, size):
    """Where a text is cut changes nothing: words longer than a part, white space alone, fewer words than a shingle."""
    texts = [LONG[:9000], "a " * 700, " \n" * 300, "w" * 500 + " b c", "one two", " x", "", None]
    whole = [b"".join(simhash.shingle_digests(t and t.encode(), size, 42)) for t in texts]
    sets = [simhash._shingles(t and t.encode(), size) for t in texts]
    salts = np.array([3, 5], np.uint64)
    marks, least = simhash.set_fingerprints(sets), [simhash._least(x, salts).tolist() for x in sets if len(x)]
    monkeypatch.setattr(simhash, "PART_BYTES", 50)
    assert [b"".join(simhash.shingle_digests(t and t.encode(), size, 42)) for t in texts] == whole
    assert simhash.fingerprints([t and t.encode() for t in texts], size).tolist() == [brute_fp(t, size) for t in texts]
    assert simhash.set_fingerprints(sets).tolist() == marks.tolist()
    assert [simhash._least(x, salts).tolist() for x in sets if len(x)] == least


@pytest.mark.parametrize("shard_rows", [8192, 2])
def test_simhash_components(spark, shard_rows):
    rows = awkward()
    got = simhash.near_duplicates(table(spark, rows), shard_rows=shard_rows).collect()
    fps = [brute_fp(t) for _, t in rows]
    group = roots(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted((-1 if i is None else i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fps, group, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_bk_forest_loses_nothing():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for b in base]))
    forest = simhash.BKForest(fp, np.zeros(len(fp), np.int64))
    found = {(int(a), int(b)) for q, n in forest.search(fp, forest.root, 3) for a, b in zip(q, n, strict=True)}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)}


@pytest.mark.parametrize(("shard_rows", "broadcast_rows"), [(1024, 10**6), (2, 0)])
def test_similar_groups(spark, shard_rows, broadcast_rows):
    base = [f"v{i}" for i in range(90)]
    grown = [(500 + k, " ".join(base[: 60 + k])) for k in range(30)]
    rows = [r for r in awkward() if r[0] is not None] + grown + [(2, " ".join(base) + " more")]
    got = simhash.similar_groups(table(spark, rows), shard_rows=shard_rows, broadcast_rows=broadcast_rows).collect()
    sets = [set(simhash._shingles(None if t is None else t.encode(), 5).tolist()) for _, t in rows]
    same = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    group = roots(len(rows), lambda i, j: same(sets[i], sets[j]))
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, i), i)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, least[g]) for (i, _), g in zip(rows, group, strict=True))


def test_similar_texts_of_null_ids_link(spark):
    base = " ".join(f"word{i}" for i in range(120))
    got = simhash.similar_groups(table(spark, [(None, base), (None, base + " end"), (4, base + " end here")])).collect()
    assert [r.component_id for r in got] == [4, 4, 4]


@pytest.mark.parametrize(("shared", "a", "b"), [(4, 0, 1), (12, 1, 2), (40, 4, 6)])
def test_short_pairs_are_found(spark, shared, a, b):
    """Pairs of a similarity of 0.8: at most one of 15,000 has no shard in common."""
    rows = []
    for k in range(300):
        line = " ".join(f"p{k}w{i}" for i in range(shared + 4))
        rows += [(2 * k, line + "".join(f" a{k}x{i}" for i in range(a))), (2 * k + 1, line + "".join(f" b{k}x{i}" for i in range(b)))]
    got = simhash.similar_groups(table(spark, rows)).collect()
    assert sum(r.component_id == r.doc_id - r.doc_id % 2 for r in got) >= 599


def test_similar_groups_with_a_line_repeated_hundreds_of_times(spark):
    rows = []
    for k in range(12):
        own = " ".join(f"d{k}w{i}" for i in range(1000))
        line = " ".join(f"d{k}again{i}" for i in range(12))
        rows += [(2 * k, f"{own}\n{line}"), (2 * k + 1, own + f"\n{line}" * 300)]
    got = simhash.similar_groups(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i - i % 2) for i in range(24)]


@pytest.mark.parametrize("keys", [lines.BROADCAST_KEYS, 0])
def test_lines(spark, keys):
    rows = awkward() + [(200 + i, f"  Common LINE\t\nown {i}\n\ncommon line") for i in range(4)] + [(300, "common line")] * 2
    got = lines.drop_frequent_lines(table(spark, rows), min_docs=3, broadcast_keys=keys).collect()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    want = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if seen[key(x)] < 3]
        want.append((str(i), len(own), len(own) - len(kept), "\n".join(kept)))
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in got) == sorted(want)


def batch(spark, k):
    return spark.createDataFrame([(bytearray(b"a"), 1), (bytearray(b"b"), 1 if k % 2 else 0), (bytearray([k]), 1)], "key binary, n long")


def test_line_runs_settle_across_batches_and_sessions(spark, tmp_path):
    runs = lines.LineRuns(spark, str(tmp_path), limit=5, buckets=3, fanout=2)
    for k in range(4):
        runs.add(batch(spark, k))
    later = lines.LineRuns.resume(spark.newSession(), json.loads(json.dumps(runs.state())))
    for k in range(4, 7):
        later.add(batch(later.spark, k))
    assert sorted(bytes(r.key) for r in later.finish().collect()) == [b"a"]


def test_runs_are_joined_and_merged_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Every plan of a compaction at the fan-out that is used, of counts and of settled keys."""
    plans, merged = [], lines.LineRuns.merged

    def seen(self, a, b):
        out = merged(self, a, b)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(lines.LineRuns, "merged", seen)
    runs = lines.LineRuns(spark, str(tmp_path), limit=2, buckets=3)
    for k in range(10):
        runs.add(batch(spark, k))
    frequent = {bytes(r.key) for r in runs.finish().collect()}
    want = {}
    for k in range(10):
        for r in batch(spark, k).groupBy("key").agg(F.sum("n").alias("n")).collect():
            want[bytes(r.key)] = want.get(bytes(r.key), 0) + r.n
    assert frequent == {key for key, n in want.items() if n >= 2}
    assert len(plans) >= 7 and len(runs.settled) <= 2 and not any("Exchange" in p for p in plans)
    a, b = runs.settled[0], runs.settled[-1]
    assert "Exchange" not in runs.read(a).join(runs.read(b).hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_runs_stays_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    rows = spark.createDataFrame([(i, "common\nown " + str(i)) for i in range(30)], "doc_id long, text string")
    assert {r.kept for r in lines.drop_frequent_lines(rows).collect()} == {f"own {i}" for i in range(30)}
    assert {t.name for t in spark.catalog.listTables()} <= before


@pytest.mark.parametrize("sizes", [{}, {"bits": 6, "fan": 2, "team": 2}])
def test_substring(spark, sizes):
    width = 5
    rows = [(i, t) for i, t in awkward() if i != 9] + [(400, "p q r s t u p q r s t"), (401, "z " * 12)]
    got = substring.remove_repeats(table(spark, rows).repartition(5), width=width, **sizes).collect()
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    want = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        want.append((str(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_very_long_text(spark):
    got = substring.remove_repeats(table(spark, [(1, LONG), (2, LONG + " end")]), width=35).collect()
    assert {(r.doc_id, r.n_words, r.n_removed) for r in got} == {(1, 60_000, 60_000), (2, 60_001, 60_000)}


def test_check_bits_part_equal_keys():
    keys = np.array([5, 5, 5, 9], np.uint64)
    vals = np.zeros(4, substring.KIND)
    vals["check"], vals["many"] = [1, 2, 1, 0], 1
    assert substring._answer(keys, vals)[0].tolist() == [1, 0, 1, 0]
    u, v, place = blocks.distinct(keys, vals, "check", ("many",))
    assert u.tolist() == [5, 5, 9] and v["many"].tolist() == [2, 1, 1] and place.tolist() == [0, 1, 0, 2]


def test_rows_of_an_exchange_grow_with_the_keys():
    """A sender's rows are bounded by the fan, whatever the number of buckets."""
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64))
    vals = np.zeros(5000, substring.KIND)
    rows = list(blocks._parted(keys, vals, 1, 0, 0, 4))
    assert len(rows) == 16
    own = np.cumsum(blocks.decode(rows[3].column("keys")[0].as_py(), np.uint64), dtype=np.uint64)
    assert np.all(own >> np.uint64(60) == 3) and len(list(blocks._parted(own, vals[: len(own)], 2, 3, 4, 4))) == 16


@pytest.mark.parametrize("run", [simhash.near_duplicates, simhash.similar_groups, lines.drop_frequent_lines, substring.remove_repeats])
def test_empty_table(spark, run):
    assert run(table(spark, [])).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    from plumeline.llm.components import components
    from plumeline.llm.scratch import Scratch

    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (5, 4)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, 31)} | {(100 + i, 100) for i in range(1, 40)}


def test_simhash_reads_whole_texts(spark):
    a = LONG + " " + " ".join(f"q{i}" for i in range(60_000))
    assert simhash.simhash(table(spark, [(1, a), (2, LONG)])).agg(F.countDistinct("fp")).first()[0] == 2
