"""Clusterings in Spark rounds against plain versions; the spanning forest in rounds against the one in a task."""

from __future__ import annotations

import numpy as np
import pytest

from panelwright.operators import network as N
from panelwright.operators import points as P
from tests.reference import adjusted_rand, lloyd, ward_naive

F2 = ["a", "b"]
MIDDLE = np.array([[0.0, 1.0], [8.0, 3.0], [2.0, 12.0], [11.0, 9.0]])


def blobs(year, n=60, spread=0.5):
    truth = np.arange(n) % 4
    return truth, MIDDLE[truth] + np.random.default_rng(year).normal(0, spread, (n, 2))


def rows(year, x):
    return [(year, i, float(p), float(q)) for i, (p, q) in enumerate(x)]


@pytest.fixture(scope="module")
def two_years(spark):
    made = {year: blobs(year) for year in (1, 2)}
    df = spark.createDataFrame([r for year, (_, x) in made.items() for r in rows(year, x)], "year long, id long, a double, b double").repartition(5)
    return made, P.prepared(df, F2)


def by_year(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.year, r.id)):
        out.setdefault(r.year, []).append(r.label)
    return out


METHODS = {
    "kmeans": lambda p: P.by_centres(p, P.kmeans_centres(p, 4, 6)),
    "ward": lambda p: P.ward_labels(p, 4),
    "ward_kmeans": lambda p: P.by_centres(p, P.ward_kmeans_centres(p, 4)),
    "gmm_diag": lambda p: P.mixture(p, 4, 3),
}


@pytest.mark.parametrize("name", METHODS)
def test_methods_find_blobs(two_years, name):
    made, p = two_years
    got = by_year(METHODS[name](p))
    for year, (truth, _) in made.items():
        assert adjusted_rand(truth, got[year]) == 1
        assert list(dict.fromkeys(got[year])) == [0, 1, 2, 3]


def test_ward_is_exact_on_few_points(spark):
    x = np.random.default_rng(7).normal(size=(40, 2))
    p = P.prepared(spark.createDataFrame(rows(1, x), "year long, id long, a double, b double"), F2)
    heights, four = ward_naive(x)
    assert P.ward_heights(p, 40)[1][::-1] == pytest.approx(sorted(heights))
    got = by_year(P.ward_labels(p, 4))[1]
    assert {frozenset(g) for g in four} == {frozenset(i for i in range(40) if got[i] == k) for k in range(4)}
    start = np.array([x[sorted(g)].mean(0) for g in four])
    assert adjusted_rand(lloyd(x, start), by_year(P.by_centres(p, P.ward_kmeans_centres(p, 4)))[1]) == 1


@pytest.mark.parametrize("kind", ["noise", "repeats"])
def test_ward_in_rounds_is_the_plain_tree(spark, monkeypatch, kind):
    """Without structure, above every bound: 1,025 points, the last 200 clusters in a task, chunks of 200 points."""
    from panelwright.operators import neighbours as B
    from panelwright.operators.cluster import cut, ward_tree

    monkeypatch.setattr(B, "CHUNK", 200)
    x = np.random.default_rng(7).normal(size=(1025, 2))
    if kind == "repeats":
        x[300:] = x[np.random.default_rng(8).integers(0, 300, 725)]
    p = P.prepared(spark.createDataFrame(rows(1, x), "year long, id long, a double, b double").repartition(7), F2)
    plain = ward_tree(x)
    assert P.ward_heights(p, 250, 200)[1] == pytest.approx(plain[::-1][:250, 2])
    if kind == "noise":
        got = by_year(P.ward_labels(p, 6, 200))[1]
        assert got == cut(plain, len(x), 6).tolist()
        starts = P.ward_starts(p, [2, 6])
        for k in (2, 6):
            want = cut(plain, len(x), k)
            assert sorted(map(tuple, starts[1, k].round(9))) == sorted(tuple(x[want == i].mean(0).round(9)) for i in range(k))


def test_ward_in_boxes_is_the_plain_tree_without_searches(spark, monkeypatch):
    """Five features, several boxes, two years of which one fits a task: the plain tree of each, and no round looks for neighbours across boxes."""
    from panelwright.operators import neighbours as B
    from panelwright.operators.cluster import ward_tree

    monkeypatch.setattr(B, "search", lambda *a, **k: pytest.fail("searched"))
    x = np.random.default_rng(9).normal(size=(1500, 5))
    points = spark.createDataFrame([(y, i, v.tolist(), 1.0) for y, n in ((1, 1500), (2, 300)) for i, v in enumerate(x[:n])], "year long, id long, x array<double>, m double")
    got = B.merges(points, 5, 600).toPandas()
    for year, n in ((1, 1500), (2, 300)):
        assert sorted(got[got.year == year].height) == pytest.approx(sorted(ward_tree(x[:n])[:, 2]))


def test_partitions_do_not_change_starts(spark):
    _, x = blobs(4, 100)
    df = spark.createDataFrame(rows(1, np.vstack([x, x[:30]])), "year long, id long, a double, b double")
    a, b = (P.draw(P.prepared(df.repartition(n), F2), 3, 6, step) for n, step in ((1, 2), (9, 2)))
    assert all((a[k] == b[k]).all() for k in a) and set(a) == set(b) == {(1, m) for m in range(3)}
    assert all(len(np.unique(c, axis=0)) == 6 for c in a.values())


def test_nulls_repeats_and_empty(spark):
    schema = "year long, id long, a double, b double"
    few = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 5.0, 5.0), (1, 3, None, 1.0), (1, None, 1.0, 1.0), (None, 4, 1.0, 1.0)], schema)
    for name, method in METHODS.items():
        got = sorted(tuple(r) for r in method(P.prepared(few, F2)).collect())
        assert got == [(1, 1, 0), (1, 1, 0), (1, 2, 1)], name
        assert method(P.prepared(few.limit(0), F2)).count() == 0
    assert P.ward_heights(P.prepared(few.limit(0), F2)) == {}


def test_bootstrap(two_years):
    _, p = two_years
    got = P.bootstrap(p, 4, 12).collect()
    assert sorted((r.year, r.b) for r in got) == [(y, b) for y in (1, 2) for b in range(12)]
    for r in got:
        assert r.n == P.resampled(np.arange(60), r.b, 42).sum() and r.ari == pytest.approx(1)
    held = [P.resampled(np.arange(10_000), b, 42).mean() for b in range(5)]
    assert all(abs(h - (1 - np.exp(-1))) < 0.02 for h in held)


def test_bootstrap_agreement(spark):
    """Noise: agreements below 1, equal to those of labels fitted to the resample alone."""
    x = np.random.default_rng(5).normal(size=(90, 2))
    p = P.prepared(spark.createDataFrame(rows(1, x), "year long, id long, a double, b double"), F2)
    whole = by_year(P.by_centres(p, P.ward_kmeans_centres(p, 3)))[1]
    for r in P.bootstrap(p, 3, 4).collect():
        held = np.flatnonzero(P.resampled(np.arange(90), r.b, 42))
        part = P.prepared(spark.createDataFrame([(1, int(i), *map(float, x[i])) for i in held], "year long, id long, a double, b double"), F2)
        alone = by_year(P.by_centres(part, P.ward_kmeans_centres(part, 3)))[1]
        assert r.ari == pytest.approx(adjusted_rand([whole[i] for i in held], alone))


@pytest.mark.parametrize("method", ["kmeans", "ward_kmeans"])
def test_pooled_rows_that_lack_a_feature(spark, method):
    truth, x = blobs(6, 120, 0.3)
    data = [(2000 + i % 3, i, float(a), None if i % 3 == 0 else float(b), float(a + b), None) for i, (a, b) in enumerate(x)]
    data.append((2001, 500, None, None, None, None))
    df = spark.createDataFrame(data, "year long, id long, a double, b double, c double, never double")
    got = {r.id: r.label for r in P.fit_pooled(df, ["a", "b", "c", "never"], 4, method).collect()}
    assert len(got) == 121 and got.pop(500) is None
    assert adjusted_rand(truth, [got[i] for i in range(120)]) == 1
    with pytest.raises(ValueError):
        P.fit_pooled(df.filter("id = 500"), ["a", "b"], 2, method)


def test_forest_in_rounds(spark):
    r = np.random.default_rng(3)
    edges = [(y, i, j, float(r.integers(1, 9))) for y in (1, 2) for i in range(40) for j in range(i) if r.random() < 0.3]  # many ties
    edges += [(1, 100, 101, 1.0), (2, 7, 7, 0.0), (2, 200, 201, None)]
    df = spark.createDataFrame(edges, "year long, src long, dst long, distance double")
    want = sorted(tuple(x) for x in N.spanning_forest(df).collect())
    got = sorted(tuple(x) for x in N.spanning_forest(df, task_edges=20).collect())
    assert got == want and len(want) == 39 * 2 + 1
    assert N.spanning_forest(df.limit(0)).count() == 0


def test_grid(spark):
    x = np.random.default_rng(8).normal(size=(70, 2)) * [1, 3]
    p = P.prepared(spark.createDataFrame(rows(1, x), "year long, id long, a double, b double").repartition(3), F2)
    got = {(m, k): (n, wcss, ch) for m, k, _, n, wcss, ch in P.grid(p, range(2, 6), 4)}
    assert set(got) == {(m, k) for m in ("kmeans", "ward_kmeans") for k in range(2, 6)}
    for k in range(2, 6):
        drawn = [lloyd(x, c[:k]) for c in P.draw(p, 4, 5).values()]
        cost = lambda l: sum(((x[l == i] - x[l == i].mean(0)) ** 2).sum() for i in set(l.tolist()))
        least = min(map(cost, drawn))
        whole = ((x - x.mean(0)) ** 2).sum()
        assert got["kmeans", k] == (70, pytest.approx(least), pytest.approx((whole - least) / (k - 1) / (least / (70 - k))))
        start = by_year(P.ward_labels(p, k))[1]
        assert got["ward_kmeans", k][1] == pytest.approx(cost(lloyd(x, np.array([x[np.array(start) == i].mean(0) for i in range(k)]))))


@pytest.mark.parametrize("mode", ["per_year", "pooled"])
def test_partition_is_ordered(spark, mode):
    data = [r for year in (1, 2) for r in rows(year, blobs(year)[1])]
    got = P.partition(spark.createDataFrame(data, "year long, id long, a double, b double"), F2, "a", "ward_kmeans", 4, mode).collect()
    assert len(got) == 120
    by_value = np.argsort(np.argsort(-MIDDLE[:, 0]))
    assert all(r.label == by_value[r.id % 4] and r.code == f"K{r.label + 1}" for r in got)
