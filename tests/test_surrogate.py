"""Boosted quantiles against a small booster that looks at every cut."""

import bisect
import math
import random

import pytest

from plumeline.operators import posterior, surrogate

TWINS = "id long, field string, x array<double>, y double, q string"


def ranked(values, q):
    return sorted(values)[max(math.ceil(q * len(values)) - 1, 0)]


def brute(rows, q, rounds, rate, levels, least):
    """Cuts at every distinct value, in order of features, then values; None lies below all."""
    low = lambda v: -math.inf if v is None else v
    p = [ranked([y for _, y in rows], q)] * len(rows)
    base, trees = p[0], []

    def grow(ids, depth):
        def slope(part):
            return q * len(part) - sum(rows[i][1] < p[i] for i in part)

        best = (1e-9, None)
        for j in range(len(rows[0][0])):
            for v in sorted({low(rows[i][0][j]) for i in ids}):
                a, b = [i for i in ids if low(rows[i][0][j]) <= v], [i for i in ids if low(rows[i][0][j]) > v]
                if min(len(a), len(b)) >= least:
                    g = slope(a) ** 2 / len(a) + slope(b) ** 2 / len(b) - slope(ids) ** 2 / len(ids)
                    if g > best[0] * (1 + 1e-12):
                        best = (g, (j, v, a, b))
        if depth == levels or best[1] is None:
            return rate * ranked([rows[i][1] - p[i] for i in ids], q)
        j, v, a, b = best[1]
        return j, v, grow(a, depth + 1), grow(b, depth + 1)

    def walk(t, x):
        while isinstance(t, tuple):
            t = t[2] if low(x[t[0]]) <= t[1] else t[3]
        return t

    for _ in range(rounds):
        t = grow(list(range(len(rows))), 0)
        trees.append(t)
        p = [a + walk(t, x) for a, (x, _) in zip(p, rows, strict=True)]

    def of(x):
        s = base
        for t in trees:
            s += walk(t, x)
        return s

    return of


def drawn(n, seed=4):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        x = [draw.randint(0, 12) / 4, None if i % 11 == 0 else float(draw.randint(0, 9)), float(i % 3 == 0)]
        out.append((i, "abc"[i % 3], x, x[0] + 0.3 * (x[1] or 0) * x[2] + draw.gauss(0, 0.4), "kept"))
    return out


def test_equals_the_small_booster_for_each_left_out_field(spark):
    rows = drawn(120)
    odd = [(500, None, [1.0, 1.0, 1.0], 99.0, ""), (501, "a", None, 99.0, ""), (502, "a", [1.0, 1.0, 1.0], None, ""), (503, "a", [1.0, 1.0, 1.0], float("nan"), ""), (504, "b", [1.0], 99.0, "")]
    df = spark.createDataFrame(rows + odd, TWINS).repartition(5)
    model = surrogate.fit(df, rounds=6, rate=0.3, every=3, bins=40)
    again = surrogate.Surrogate.from_json(model.to_json())
    held = {r.id: r for r in surrogate.predict(df, again, field="field", name="h").collect()}
    every = {r.id: r for r in surrogate.predict(df, model, name="h").collect()}
    assert model.fields == ["a", "b", "c"] and len(held) == 125 and all(held[i].q == "kept" for i in range(120))
    for k, q in enumerate(surrogate.QUANTILES):
        whole = brute([(x, y) for _, _, x, y, _ in rows], q, 6, 0.3, 3, 8)
        assert all(every[i].h[k] == pytest.approx(whole(x), abs=1e-9) for i, _, x, _, _ in rows)
        for f in "abc":
            part = brute([(x, y) for _, g, x, y, _ in rows if g != f], q, 6, 0.3, 3, 8)
            assert all(held[i].h[k] == pytest.approx(part(x), abs=1e-9) for i, g, x, _, _ in rows if g == f)
    assert held[500].h == every[500].h and held[501].h is None and held[504].h is None and held[502].h is not None


def test_parting_changes_nothing_and_bounds_hold(spark, tmp_path):
    df = spark.createDataFrame(drawn(150, 9), TWINS)
    one, many = surrogate.fit(df.coalesce(1), rounds=3), surrogate.fit(df.repartition(7), rounds=3, every=2)
    assert one.to_json() == many.to_json()
    one.save(spark, str(tmp_path / "model"))
    assert surrogate.Surrogate.load(spark, str(tmp_path / "model")).to_json() == one.to_json()
    empty = surrogate.fit(df.where("false"))
    assert [r.q for r in surrogate.predict(df.limit(2), empty).collect()] == [None, None]
    with pytest.raises(ValueError, match="more than 2 fields"):
        surrogate.fit(df, most_fields=2)


def test_features_and_likelihood(spark):
    s = spark.createDataFrame([(1, 4.0, 2.0, None, "acute", 0.1, 5.0, 0.0), (2, 0.0, 2.0, 1.0, None, 0.1, 5.0, 0.0), (3, 1.0, None, 1.0, None, 0.1, 5.0, 0.0)], "id long, length_km double, width_km double, area_km2 double, discharge_class string, current double, wind double, strain double")
    got = {r.id: r.x for r in surrogate.features(s).collect()}
    assert got[1] == pytest.approx([math.log(4), math.log(2), math.log(2), math.log(8), 0, 1, 0.1, 5, math.log(1e-9)]) and got[2] is None and got[3] is None
    grid = posterior.age_grid(spark)
    judged = spark.createDataFrame([(1, "a", math.log(10.1), [1.0, math.log(10.0), 3.0]), (2, "a", math.log(40.0), [2.0, 2.0, 2.0]), (3, "b", 1.0, None)], "id long, field string, y double, q array<double>")
    ll = {(r.id, r.age_h): r.ll for r in surrogate.log_likelihood(judged, grid, ["id"]).collect()}
    ages = [0.25 * i for i in range(1, 289)]
    lse = math.log(sum(1 / a for a in ages))
    want = [-0.5 * ((math.log(a) - math.log(10.0)) / (2 / 2 / surrogate.Z90)) ** 2 + math.log(a) + lse for a in ages]
    want = [max(w, max(want) + math.log(1e-4)) for w in want]
    assert len(ll) == 576 and [ll[1, a] for a in ages] == pytest.approx(want)
    (r,) = surrogate.evaluate(judged, grid, ["id"]).collect()
    assert (r.field, r.n, r.coverage) == ("a", 2, 0.5) and r.log2_error == pytest.approx(((math.log(1.01)) + math.log(40) - 2) / 2 / math.log(2))
    assert bisect.bisect(ages, 10.1) and r.prior_log_score == pytest.approx((-math.log(10.0) - math.log(40.0)) / 2 - lse)
