"""The network of a sample against plain Python: neighbours, spanning forest and weights from the pairs of a year."""

from __future__ import annotations

import math
import statistics

import pytest

from panelwright import registry

DATA = "/root/testdata/sf0.001"


def test_default_network(spark):
    q = registry.queries()
    pairs = {}
    for r in q["network_pairs"](spark, DATA).collect():
        pairs.setdefault(r.year, {})[r.src, r.dst] = r.distance
    got = {}
    for r in q["network_default"](spark, DATA).collect():
        got.setdefault(r.year, {})[r.src, r.dst] = r
    assert set(got) == set(pairs)
    for year, p in pairs.items():
        nodes = {x for pair in p for x in pair}
        width = statistics.median(d for d in p.values() if d > 0)
        near = set()
        for n in nodes:
            mine = sorted((d, b if a == n else a) for (a, b), d in p.items() if n in (a, b))[:5]
            near |= {(min(n, m), max(n, m)) for _, m in mine}
        group, tree, weight = {n: {n} for n in nodes}, set(), 0.0
        for (a, b), d in sorted(p.items(), key=lambda x: (x[1], x[0])):
            if group[a] is not group[b]:
                tree.add((a, b))
                weight += d
                both = group[a] | group[b]
                for n in both:
                    group[n] = both
        edges = got[year]
        assert sum(e.distance for e in edges.values() if e.tree) == pytest.approx(weight, abs=1e-3)
        assert len([e for e in edges.values() if e.tree]) == len(tree)
        assert len(near - {k for k, e in edges.items() if e.near}) <= 0.02 * len(near)  # distances are rounded here, so ties may fall otherwise
        for k, e in edges.items():
            assert e.near or e.tree
            assert e.weight == pytest.approx(math.exp(-(p[k] ** 2) / (2 * width**2)), abs=1e-4)


def test_missing_pairwise(spark):
    from panelwright.operators.network import usable

    rows = [(1, 1, 1.0, None), (1, 2, 2.0, 5.0), (1, 3, None, 4.0), (2, 1, 1.0, None), (2, 2, 3.0, None), (2, 3, 4.0, 1.0), (3, 1, None, None)]
    df = spark.createDataFrame(rows, "year long, id long, a double, b double")
    assert sorted(tuple(r) for r in usable(df, ["a", "b"]).collect()) == [(1, 2, 2.0, 5.0), (2, 1, 1.0, None), (2, 2, 3.0, None), (2, 3, 4.0, None)]
    assert usable(df, ["a", "b"], missing="pairwise").count() == len(rows)
    assert usable(df.limit(0), ["a", "b"]).count() == 0
