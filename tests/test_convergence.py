"""Convergence operators against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from panelwright import registry
from panelwright.operators import convergence as G

DATA = "/root/testdata/sf0.001"


def spend(spark):
    rows = {}
    for r in spark.read.parquet(f"{DATA}/orders.parquet").collect():
        rows[r.o_custkey, r.o_orderdate.year] = rows.get((r.o_custkey, r.o_orderdate.year), 0.0) + r.o_totalprice
    return rows


def test_beta_panel(spark):
    s = spend(spark)
    region = {r.c_custkey: r.c_nationkey for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()}
    obs = [(i, y, np.log(s[i, y - 1]), np.log(v / s[i, y - 1])) for (i, y), v in s.items() if (i, y - 1) in s]
    units, years = sorted({o[0] for o in obs}), sorted({o[1] for o in obs})
    # Ordinary least squares with a dummy for every entity and year.
    m = np.zeros((len(obs), 1 + len(units) + len(years) - 1))
    for k, (i, y, x, _) in enumerate(obs):
        m[k, 0] = x
        m[k, 1 + units.index(i)] = 1
        if y > years[0]:
            m[k, len(units) + years.index(y)] = 1
    y = np.array([o[3] for o in obs])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    x = m[:, 0] - m[:, 1:] @ np.linalg.lstsq(m[:, 1:], m[:, 0], rcond=None)[0]
    u = y - m @ beta
    sums = {}
    for k, o in enumerate(obs):
        sums[region[o[0]]] = sums.get(region[o[0]], 0.0) + x[k] * u[k]
    g = len(sums)
    se = np.sqrt(sum(v * v for v in sums.values()) * g / (g - 1)) / (x @ x)
    r = registry.queries()["beta_panel"](spark, DATA).first()
    assert (r.n, r.n_units, r.n_groups) == (len(obs), len(units), g)
    assert r.b == pytest.approx(beta[0], abs=2e-6) and r.se == pytest.approx(se, abs=2e-6)


def trend_by_definition(y, weight=400.0):
    """The trend minimises squared gaps plus weighted squared second differences: stacked least squares."""
    t = len(y)
    rows = np.zeros((t - 2, t))
    for i in range(t - 2):
        rows[i, i : i + 3] = 1, -2, 1
    return np.linalg.lstsq(np.vstack((np.eye(t), np.sqrt(weight) * rows)), np.concatenate((y, np.zeros(t - 2))), rcond=None)[0]


def test_log_t(spark):
    s = spend(spark)
    years = sorted({y for _, y in s})
    ids = [i for i in sorted({i for i, _ in s}) if all((i, y) in s for y in years)]
    x = np.array([trend_by_definition(np.log([s[i, y] for y in years])) for i in ids])
    h = ((x / x.mean(0) - 1) ** 2).mean(0)
    t = np.arange(1, len(years) + 1)
    keep = t > int(0.3 * len(years))
    y, z = np.log(h[0] / h[keep]) - 2 * np.log(np.log(t[keep])), np.log(t[keep])
    a = np.column_stack((np.ones(len(z)), z))
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    u = y - a @ beta
    inv, meat = np.linalg.inv(a.T @ a), np.zeros((2, 2))
    for i in range(len(u)):
        for j in range(len(u)):
            meat += (1.0, 0.5, 0.0)[min(abs(i - j), 2)] * u[i] * u[j] * np.outer(a[i], a[j])
    r = registry.queries()["log_t"](spark, DATA).first()
    assert r.n == len(ids) and r.points == keep.sum()
    assert r.b == pytest.approx(beta[1], abs=1e-4) and r.t == pytest.approx(beta[1] / np.sqrt((inv @ meat @ inv)[1, 1]), rel=1e-4)


def paths(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>").repartition(3)


def two_groups():
    r = np.random.default_rng(3)
    t = np.arange(12)
    near = lambda level, n: level + np.linspace(-0.4, 0.4, n)[:, None] * np.exp(-0.45 * t) + r.normal(0, 1e-4, (n, 12))
    return np.vstack((near(12.0, 8), near(7.0, 8), [12.0 - 0.5 * t]))


@pytest.mark.parametrize("local", [4096, 4])
def test_clubs_find_two_groups(spark, local):
    odd = spark.createDataFrame([(50, None), (51, [1.0] * 11 + [None])], "id long, x array<double>")
    got = {r.id: r.club for r in G.clubs(paths(spark, two_groups()).unionByName(odd), local=local).collect()}
    assert len({got[i] for i in range(8)}) == len({got[i] for i in range(8, 16)}) == 1 and got[0] != got[8] and min(got[0], got[8]) > 0
    assert got[50] == got[51] == -1 and len(got) == 19
    assert G.clubs(odd.limit(0), local=local).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_clubs_in_rounds_are_those_of_the_definition(spark, seed):
    """Each run and each unit is tested by itself here; in rounds nothing but the last two units comes to the driver."""
    r = np.random.default_rng(seed)
    centre = r.choice([9.0, 10.0, 12.0], 14)
    x = centre[:, None] + r.normal(0, 0.5, 14)[:, None] * np.exp(-0.3 * np.arange(9)) + r.normal(0, 0.01, (14, 9))
    trend = np.array([trend_by_definition(row) for row in x])

    def t_of(group):
        if len(group) < 3:
            return np.nan
        v = trend[group]
        return G.slope_test(((v / v.mean(0) - 1) ** 2).mean(0))["t"]

    want, left, number = dict.fromkeys(range(14), -1), sorted(range(14), key=lambda i: -x[i, -1]), 0
    while len(left) > 1:
        t = [t_of(left[: n + 1]) for n in range(len(left))]
        start = next((n for n, v in enumerate(t) if v > -1.65), None)
        if start is None:
            left.pop(0)
            continue
        stop = next((n for n in range(start, len(t)) if t[n] < -1.65), len(t))
        end = max(range(start, stop), key=lambda n: (t[n] if t[n] == t[n] else -np.inf, -n))
        core, rest = left[: end + 1], left[end + 1 :]
        number += 1
        club = core + [i for i in rest if t_of(core + [i]) > 0]
        want |= dict.fromkeys(club, number)
        left = [i for i in rest if i not in club]
    for local in (4096, 2):
        assert {r.id: r.club for r in G.clubs(paths(spark, x), local=local).collect()} == want


def test_clubs_of_regions(spark):
    got = registry.queries()["convergence_clubs"](spark, DATA).collect()
    assert len({r.region for r in got}) == len(got) and all(r.club == -1 or r.club > 0 for r in got)
    every = registry.queries()["entity_clubs"](spark, DATA).collect()
    assert len({r.id for r in every}) == len(every) > 10


def test_ward_heights(spark):
    """Merging by definition: the pair whose union raises the sum of squares least."""
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    got = {}
    for r in registry.queries()["ward_heights"](spark, DATA).collect():
        got.setdefault(r.year, {})[r.k] = r
    for year in sorted({r.label % 2 for r in rows}):
        x = np.array([[round(float(v), 6) for v in r.embedding[:5]] for r in sorted(rows, key=lambda r: r.vec_id) if r.label % 2 == year])
        n, mean = np.ones(len(x)), x.copy()
        heights = []
        while len(n) > 1:
            d2 = ((mean[:, None] - mean[None]) ** 2).sum(-1) * 2 * n[:, None] * n[None] / (n[:, None] + n[None])
            np.fill_diagonal(d2, np.inf)
            a, b = sorted(np.unravel_index(d2.argmin(), d2.shape))
            heights.append(np.sqrt(d2[a, b]))
            mean[a] = (n[a] * mean[a] + n[b] * mean[b]) / (n[a] + n[b])
            n[a] += n[b]
            n, mean = np.delete(n, b), np.delete(mean, b, 0)
        for k, r in got[year].items():
            assert r.height == pytest.approx(heights[-(k - 1)], abs=1e-4)


def test_match_years(spark):
    """Names go on by the assignment of types with the largest sum of Jaccard shares: tried one by one here."""
    from itertools import permutations

    rows = registry.queries()["match_years"](spark, DATA).collect()
    sets = {}
    for r in rows:
        sets.setdefault((r.year, r.label), set()).add(r.id)
    name = {(r.year, r.label): r.through for r in rows}
    years = sorted({y for y, _ in sets})
    for a, b in zip(years, years[1:]):
        left, right = sorted(l for y, l in sets if y == a), sorted(l for y, l in sets if y == b)
        share = lambda l, r: len(sets[a, l] & sets[b, r]) / (len(sets[a, l] | sets[b, r]))
        best = max(sum(share(l, r) for l, r in zip(left, p)) for p in permutations(right, len(left)))
        kept = [(l, r) for l in left for r in right if name[a, l] == name[b, r]]
        lost = [max(share(l, r) for r in right) for l in left if all(l != x for x, _ in kept)]
        assert sum(share(l, r) for l, r in kept) <= best + 1e-9
        assert sum(share(l, r) for l, r in kept) + 0.2 * len(lost) >= best - 1e-9
