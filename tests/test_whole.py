"""Queries over all rows, against plain Python."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest

from panelwright import registry

DATA = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_collapse_reads_every_order(spark):
    groups = defaultdict(list)
    for r in table(spark, "lineitem").collect():
        groups[r.l_suppkey, r.l_shipdate.year, r.l_returnflag].append((r.l_orderkey * 10 + r.l_linenumber, r.l_extendedprice, r.l_quantity))
    got = registry.queries()["collapse_all_sources"](spark, DATA).collect()
    assert len(got) == len(groups)
    for r in got:
        rows = sorted(groups[r.k, r.year, r.f])
        one = len({v for _, v, _ in rows}) == 1
        rules = {"A": sum(v for _, v, _ in rows), "N": sum(v * w for _, v, w in rows) / sum(w for *_, w in rows), "R": rows[-1][1]}
        assert r.value == pytest.approx(rows[0][1] if one else rules[r.f], abs=1e-3)
        assert r.flag == ("" if one else "duplicate_codes" if r.f == "R" else "merged_sources")


def test_every_pair_of_places_has_a_distance(spark):
    def place(k):
        return math.radians(k * 37 % 140 - 70), math.radians(k * 91 % 360 - 180)

    ids = [r.s_suppkey for r in table(spark, "supplier").collect()]
    got = {(r.src, r.dst): r.km for r in registry.queries()["haversine_all_pairs"](spark, DATA).collect()}
    assert sorted(got) == sorted((a, b) for a in ids for b in ids if a < b)
    for (a, b), km in got.items():
        (p, x), (q, y) = place(a), place(b)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2
        assert km == pytest.approx(2 * 6371 * math.asin(math.sqrt(min(1, h))), abs=1e-3)


def test_every_entity_is_checked_for_constancy(spark):
    years = defaultdict(lambda: defaultdict(int))
    for r in table(spark, "orders").collect():
        years[r.o_custkey][r.o_orderdate.year] += 1
    want = {(k, len(n), next(iter(n.values()))) for k, n in years.items() if len(set(n.values())) == 1}
    assert {(r.id, r.n_years, r.usual) for r in registry.queries()["constant_all_entities"](spark, DATA).collect()} == want


def test_every_entity_has_a_side(spark):
    got = registry.queries()["boundary_all_events"](spark, DATA).collect()
    region = {r.c_custkey: r.c_nationkey for r in table(spark, "customer").collect()}
    assert {r.region for r in got} == set(region.values()) and len(got) == len(set(region.values()))
    for r in got:
        for side, rest in ((r.priced, 0), (r.plain, 1)):
            assert [int(x) for x in (side or "").split(",") if x] == sorted(k for k, v in region.items() if v == r.region and k % 2 == rest)


def test_bootstrap_covers_every_year(spark):
    years = {r.label % 2 for r in table(spark, "embeddings").select("label").distinct().collect()}
    got = registry.queries()["bootstrap_ari"](spark, DATA).collect()
    assert sorted((r.year, r.b) for r in got) == [(y, b) for y in sorted(years) for b in range(50)]
    assert all(-1 <= r.ari <= 1 and r.n > 0 for r in got)
