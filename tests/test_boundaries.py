"""Boundary events worked off in levels against a plain pass in order of time."""

from __future__ import annotations

import random

import pytest

from panelwright.operators import boundaries as B

LONG, EVENTS = "id long, year long, indicator string, value double", "event string, kind string, year long, preds array<long>, succs array<long>"
RULES = [("pop", "sum", None), ("wage", "mean", "pop"), ("other", "last", None)]


def plain(long, events, codes):
    have = {(i, y, s): v for i, y, s, v in long}
    out = {}
    for name, kind, until, preds, succs in sorted(events, key=lambda e: (e[2], e[0])):
        new = {}
        if kind == "union":
            for y, s in {(y, s) for (i, y, s) in have if i in preds and y < until}:
                v = [have.get((p, y, s)) for p in sorted(set(preds))]
                w = [have.get((p, y, "pop")) for p in sorted(set(preds))]
                if None in v or s == "other":
                    continue
                if s == "pop":
                    new[succs[0], y, s] = sum(v)
                elif None not in w and sum(w) > 0:
                    new[succs[0], y, s] = sum(a * b for a, b in zip(v, w)) / sum(w)
        elif kind == "transfer":
            for succ in succs:
                same = [p for p in set(preds) if codes.get(p, set()) & codes.get(succ, set())]
                if len(same) == 1:
                    new |= {(succ, y, s): v for (i, y, s), v in have.items() if i == same[0] and y < until}
        for key, v in new.items():
            if key not in have:
                have[key] = v
                out[key] = (v, ("summed_predecessors:" if kind == "union" else "moved_predecessor:") + name)
    return out


def run(spark, long, events, codes):
    c = [(i, x) for i, xs in codes.items() for x in xs]
    got = B.extend_back(spark.createDataFrame(long, LONG), spark.createDataFrame(events, EVENTS), spark.createDataFrame(RULES, "indicator string, agg string, weight string"), spark.createDataFrame(c, "id long, code long"))
    return {(r.id, r.year, r.indicator): (r.value, r.flag) for r in got.collect()}


def check(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k][1] == want[k][1] and (got[k][0] == want[k][0] or got[k][0] == pytest.approx(want[k][0]))


def test_chain(spark):
    """A union whose successor is united again and then passed on; one predecessor is unknown in 2003."""
    long = [(i, y, s, float(i + y % 10) if s == "pop" else float(100 * i)) for i in (1, 2, 3) for y in (2001, 2002, 2003) for s in ("pop", "wage", "other") if (i, y) != (2, 2003)]
    events = [("u1", "union", 2004, [1, 2], [10]), ("u2", "union", 2005, [10, 3], [20]), ("t3", "transfer", 2006, [20, 99], [30]), ("x", "closure", 2001, [1], [2]), ("none", "union", 2010, [], [])]
    codes = {20: {7}, 99: {8}, 30: {7, 9}}
    got = run(spark, long, events, codes)
    check(got, plain(long, events, codes))
    assert got[10, 2001, "pop"] == (5.0, "summed_predecessors:u1") and got[20, 2001, "wage"][0] == pytest.approx((2 * 100 + 3 * 200 + 4 * 300) / 9)
    assert got[30, 2002, "pop"] == (got[20, 2002, "pop"][0], "moved_predecessor:t3") and not any(k[1] == 2003 or k[2] == "other" for k in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_events(spark, seed):
    r = random.Random(seed)
    long = [(i, y, s, None if r.random() < 0.05 else float(r.randrange(1, 9))) for i in range(25) for y in range(2000, 2006) for s in ("pop", "wage") if i < 14 and r.random() < 0.9]
    events = [(f"e{n}", r.choice(["union", "transfer"]), r.randrange(2001, 2008), r.sample(range(25), r.randrange(1, 4)), r.sample(range(25), r.randrange(1, 3))) for n in range(18)]
    codes = {i: {r.randrange(12), r.randrange(12)} for i in range(25)}
    check(run(spark, long, events, codes), plain(long, events, codes))


def test_empty(spark):
    assert run(spark, [], [], {}) == {}
