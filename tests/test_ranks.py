"""Rank correlations against pandas; rules of geographic distances by hand."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from panelwright.operators import network as N
from panelwright.operators import ranks as K


@pytest.fixture(scope="module")
def frame():
    r = np.random.default_rng(4)
    x = r.integers(0, 40, 600).astype(float)
    f = pd.DataFrame({"a": x, "b": x**3 + r.integers(0, 2, 600), "c": -x + r.normal(0, 9, 600), "d": r.normal(size=600), "flat": 1.0, "few": x})
    for c, share in (("a", 0.1), ("b", 0.3), ("c", 0.05)):
        f.loc[r.random(600) < share, c] = np.nan
    f.loc[50:, "few"] = np.nan
    return f


def test_pairs_against_pandas(spark, frame):
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in frame)).repartition(5)
    want = frame.corr(method="spearman", min_periods=100)
    got = {(r.a, r.b): (r.n, r.rho) for r in K.spearman_pairs(df, list(frame), 100).collect()}
    assert set(got) == {(a, b) for i, a in enumerate(frame) for b in list(frame)[i + 1 :] if "few" not in (a, b)}
    for (a, b), (n, rho) in got.items():
        assert n == (frame[a].notna() & frame[b].notna()).sum()
        assert (rho is None and "flat" in (a, b)) or rho == pytest.approx(want.at[a, b])
    strong = {(r.a, r.b) for r in K.strong_pairs(df, list(frame), 0.7, 100, lambda c: c).collect()}
    assert strong == {k for k, (_, rho) in got.items() if rho is not None and abs(rho) >= 0.7} and ("a", "b") in strong
    assert K.spearman_pairs(df.limit(0), ["a", "b"]).count() == 0


def test_value_ranks(spark):
    values = [("p", v) for v in (3.0, 1.0, 3.0, 2.0, 3.0)] + [("q", 5.0)]
    got = {(r.k, r.v): r.rank for r in K.value_ranks(spark.createDataFrame(values, "k string, v double"), ["k"], "v").collect()}
    assert got == {("p", 1.0): 1, ("p", 2.0): 2, ("p", 3.0): 4, ("q", 5.0): 1}


def test_missing_links(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    line = spark.createDataFrame([(1, 2, 10.0), (1, 3, 20.0), (1, 4, 40.0), (2, 3, 10.0), (2, 4, 30.0), (3, 4, 20.0)], "src long, dst long, km double")
    road = spark.createDataFrame([(2, 1, 12.0), (3, 1, 24.0), (2, 9, 1.0)], "src long, dst long, km double")
    beside = spark.createDataFrame([(3, 2)], "src long, dst long")
    run = lambda rule, tables: {(r.src, r.dst): r.distance for r in N.geographic(nodes, tables, line, rule, beside).collect()}
    assert run("adjacency", {"road": (road, 2.0)}) == {(1, 2): 0.5, (1, 3): 1.0, (1, 4): 1.0, (2, 3): 0.0, (2, 4): 1.0, (3, 4): 1.0}
    assert run("line", {"road": (road, 1.0)})[1, 4] == 1.0 and run("line", {"road": (road, 1.0)})[2, 3] == pytest.approx(0.25)
    assert run("exclude", {"road": (road, 1.0)}) == {(1, 2): 0.5, (1, 3): 1.0, (1, 4): None, (2, 3): None, (2, 4): None, (3, 4): None}
    assert run("exclude", {"adjacency": (beside, 1.0), "line": (line, 3.0)})[2, 3] == pytest.approx(0.75 * 0.25)
    with pytest.raises(ValueError):
        N.geographic(nodes, {"road": (road, 1.0)}, line, "adjacency")
    assert [r.id for r in N.unlinked(nodes, road).collect()] == [4]


def test_combine(spark):
    economic = spark.createDataFrame([(1, 1, 2, 2.0), (1, 1, 3, 4.0), (2, 1, 2, 0.0)], "year long, src long, dst long, distance double")
    geo = spark.createDataFrame([(1, 2, 0.5), (1, 3, None)], "src long, dst long, distance double")
    run = lambda g, alpha: {(r.year, r.src, r.dst): r.distance for r in N.combine(economic, g, alpha).collect()}
    assert run(geo, 0.6) == pytest.approx({(1, 1, 2): 0.5, (1, 1, 3): 1.0, (2, 1, 2): 0.2})
    assert run(geo, 1.0) == run(None, 0.3) == {(1, 1, 2): 2.0, (1, 1, 3): 4.0, (2, 1, 2): 0.0}
