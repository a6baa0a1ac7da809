"""Every registered query of the library against its SQL; those without SQL against invariants."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as entry
from panelwright import registry
from tests.oracle import compare
from tests.reference import adjusted_rand

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    got, want = compare(spark, registry.queries(), registry.oracle_sql(), name, DATA)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_forest_spans(spark):
    q = registry.queries()
    forest = q["mst_forest"](spark, DATA).collect()
    pairs = q["pairwise_l1"](spark, DATA).toPandas()
    for year, p in pairs.groupby("year"):
        nodes = sorted(set(p.src) | set(p.dst))
        own = [r for r in forest if r.year == year]
        assert len(own) == len(nodes) - 1
        at = {x: i for i, x in enumerate(nodes)}
        d = np.full((len(nodes), len(nodes)), np.inf)
        for s, t, x in zip(p.src, p.dst, p.distance):
            d[at[s], at[t]] = d[at[t], at[s]] = x
        best, inside, total = d[0].copy(), np.zeros(len(nodes), bool), 0.0
        inside[0] = True
        for _ in range(len(nodes) - 1):
            j = int(np.where(inside, np.inf, best).argmin())
            total += best[j]
            inside[j] = True
            best = np.minimum(best, d[j])
        assert sum(r.distance for r in own) == pytest.approx(total)


@pytest.mark.parametrize("name", ["kefrin_like"])
def test_methods_recover_blobs(name):
    from panelwright.operators import cluster as C

    r = np.random.default_rng(12)
    truth = np.arange(100) // 25
    x = np.array([[0.0, 1.0], [9.0, 2.0], [1.0, 11.0], [10.0, 9.0]])[truth] + r.normal(0, 0.6, (100, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    w = np.where(d <= np.sort(d, 1)[:, 9:10], 1 / (1 + d), 0.0)
    w = np.maximum(w, w.T)
    np.fill_diagonal(w, 0)
    got = C.fit(x, w, name, 4)
    assert adjusted_rand(truth, got) > 0.9
    assert (got == C.fit(x, w, name, 4)).all()


def test_numbers_by_first_appearance():
    from panelwright.operators import cluster as C

    assert C.relabel(np.array([9, 4, 9, 7, 4, 1])).tolist() == [0, 1, 0, 2, 1, 3]
    assert C.available("nosuch") == (False, "no such method here")


def test_trajectories_and_periods(spark):
    from pyspark.sql import functions as F

    from panelwright.functions import text as T

    rows = [([4, 4, 4, 4], "stable"), ([5, 3, 3], "up"), ([0, 2, 2], "down"), ([2, 0, 5], "mixed"), ([7, None, 6], "up"), ([None, 1, None], "no data"), ([], "no data")]
    df = spark.createDataFrame(rows, "l array<bigint>, want string").withColumn("got", T.trajectory(F.col("l")))
    assert all(r.got == r.want for r in df.collect())
    years = spark.createDataFrame([(1995, 2000), (1990, 1999), (1990, 1996)], "a long, b long")
    got = {(r.a, r.b): r.p for r in years.withColumn("p", T.default_periods(F.col("a"), F.col("b"), 3)).collect()}
    assert got == {(1995, 2000): [1995, 1998, 2000], (1990, 1999): [1990, 1994, 1999], (1990, 1996): [1990, 1993, 1996]}


def test_prices_by_hand(spark):
    from panelwright.operators import prices as X

    idx = spark.createDataFrame([("p", 2005, 102.0), ("p", 2006, 25.0), ("p", 2007, 97.0), ("p", 2008, 108.0), ("q", 2007, 101.0), ("q", 2008, 99.0), ("q", 2009, 125.0)], "k string, year long, idx double")
    got = {(r.k, r.year): r.level for r in X.chain(idx, ["k"]).collect()}
    assert got == pytest.approx({("p", 2006): 1, ("p", 2007): 0.97, ("p", 2008): 1.0476, ("q", 2006): 1, ("q", 2007): 1.01, ("q", 2008): 0.9999, ("q", 2009): 1.249875})
    dec = spark.createDataFrame([("r", 2007, 109.0), ("r", 2008, 94.0)], "k string, year long, idx double")
    mid = {r.year: r.level for r in X.mid_year(X.chain(dec, ["k"]), ["k"]).collect()}
    assert mid == pytest.approx({2007: 1.09**0.5, 2008: 1.09 * 0.94**0.5})


def test_codes_by_hand(spark):
    from pyspark.sql import functions as F

    from panelwright.functions import text as T

    rows = [("12-345-678-901", "12345678"), ("904.12.3", "00904123"), ("a 31415926", "31415926"), ("123456789", "123456789")]
    assert all(r.got == r.w for r in spark.createDataFrame(rows, "c string, w string").withColumn("got", T.norm_code(F.col("c"))).collect())
    totals = [("41200000", True), ("41234000", False), ("41234567", True), ("41210001", True)]
    assert all(r.got == r.w for r in spark.createDataFrame(totals, "c string, w boolean").withColumn("got", T.is_summary_code(F.col("c"))).collect())
