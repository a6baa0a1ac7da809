"""Clustering of points, a model for each group, as Spark rounds over all rows.

Points are rows ``year, id, <features>``; a group is a year. A round reads the points once for all groups and models,
sums in each task what a model needs of its points, and adds the sums up by ``groupBy``. What comes to the driver is a row
for each year, model and cluster; no task or array holds a year. Points are written once, so that a lost executor costs a read.

Nulls: rows without an id or a year, or that lack a feature, are in no model and no result (but see :func:`fit_pooled`);
an empty table gives an empty result. Rows that are repeated count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators import neighbours as N
from panelwright.sources.work import written

#: Points of a model's centres by year and model.
Centres = dict[tuple[int, int], np.ndarray]


def prepared(points: DataFrame, features: list[str]) -> DataFrame:
    """``year, id, x``: the rows that have everything, as arrays of doubles."""
    whole = points.select("year", "id", *features).dropna()
    return written(whole.select(F.col("year").cast("long").alias("year"), F.col("id").cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x")), "points")


def uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) by id and salt, the same in every task."""
    z = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for s in salt:
            # The published finaliser of splitmix64.
            z = z + np.uint64(0x9E3779B97F4A7C15) * np.uint64(s % (1 << 32) + 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, a feature at a time: no array of points, centres and features."""
    out = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centres[None, :, j]) ** 2
    return out


def resampled(ids: np.ndarray, model: int, seed: int) -> np.ndarray:
    """Which ids a resample with replacement holds at least once: each independently with the chance 1 - 1/e (Poisson bootstrap)."""
    return uniform(ids, seed, model) < 1 - np.exp(-1)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for pdf in batches:
        for year, part in pdf.groupby("year"):
            yield int(year), part.id.to_numpy(), np.stack(part.x.to_numpy())


def draw(points: DataFrame, models: int, wanted: int, per_step: int = 1, seed: int = 42) -> Centres:
    """Starts by k-means++: each step adds points drawn in proportion to their squared distance from those drawn before.

    A point's key is an exponential number over its squared distance, and the smallest keys of all points win, which is that
    very draw without a look at the whole distribution. With ``per_step`` above 1 several are drawn at a time. A group
    with fewer distinct points gets all of them.
    """
    found: Centres = {}
    schema = "year long, model int, key double, x array<double>"
    while True:
        step = max((len(c) for c in found.values()), default=0)
        if step >= wanted:
            return found
        take = min(per_step, wanted - step)

        def keys(batches, found=found, step=step, take=take):
            for year, ids, x in _groups(batches):
                for m in range(models):
                    c = found.get((year, m))
                    weight = squares(x, c).min(1) if c is not None else np.ones(len(x))
                    at = np.flatnonzero(weight > 0)
                    if not len(at):
                        continue
                    key = -np.log(uniform(ids[at], seed, m, step)) / weight[at]
                    best = np.lexsort((ids[at], key))
                    best = best[np.sort(np.unique(x[at[best]], axis=0, return_index=True)[1])[:take]] if take > 1 else best[:1]
                    yield pd.DataFrame({"year": year, "model": m, "key": key[best], "x": list(x[at[best]])})

        # Equal points are one, with the smallest of their keys.
        once = points.mapInPandas(keys, schema).groupBy("year", "model", "x").agg(F.min("key").alias("key"))
        rank = F.row_number().over(W.partitionBy("year", "model").orderBy("key", "x"))  # at most ``take`` rows a task
        new: dict[tuple[int, int], list] = {}
        for r in once.withColumn("r", rank).filter(F.col("r") <= take).orderBy("year", "model", "r").collect():
            new.setdefault((r.year, r.model), []).append(r.x)
        if not new:
            return found
        found = found | {k: np.vstack([found[k], v]) if k in found else np.array(v) for k, v in new.items()}


_SUMS = "year long, model int, k int, n double, cost double, s array<double>, q array<double>"


def _summed(points: DataFrame, of: Callable[[int, int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray] | None], keys: list[tuple[int, int]], width: int) -> dict[tuple[int, int], tuple[np.ndarray, float, np.ndarray, np.ndarray]]:
    """For each year and model the clusters' weights, the whole cost, and the sums of their points and of the squares.

    ``of`` gives each point's weight in every cluster and its cost; ``width`` is the number of features."""
    by_year: dict[int, list[int]] = {}
    for year, m in keys:
        by_year.setdefault(year, []).append(m)

    def partial(batches):
        for year, ids, x in _groups(batches):
            out = []
            for m in by_year.get(year, []):
                r, cost = of(year, m, ids, x)
                n, s, q = r.sum(0), r.T @ x, r.T @ x**2
                out += [(year, m, k, n[k], float(cost.sum()) if k == 0 else 0.0, s[k], q[k]) for k in range(r.shape[1])]
            yield pd.DataFrame(out, columns=["year", "model", "k", "n", "cost", "s", "q"])

    if not keys:
        return {}
    add = lambda c: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(width)]).alias(c)
    got: dict = {}
    for r in sorted(points.mapInPandas(partial, _SUMS).groupBy("year", "model", "k").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), add("s"), add("q")).collect(), key=lambda r: r.k):
        got.setdefault((r.year, r.model), []).append(r)
    return {key: (np.array([r.n for r in v]), sum(r.cost for r in v), np.array([r.s for r in v]), np.array([r.q for r in v])) for key, v in got.items()}


def _width(centres: Centres) -> int:
    return next((c.shape[1] for c in centres.values()), 0)


def _nearest(centres: Centres, mask: Callable[[np.ndarray, int], np.ndarray] | None = None):
    def of(year, m, ids, x):
        d = squares(x, centres[year, m])
        r = np.eye(d.shape[1])[d.argmin(1)]
        cost = d.min(1)
        if mask is not None:
            held = mask(ids, m)
            r, cost = r * held[:, None], cost * held
        return r, cost

    return of


def lloyd(points: DataFrame, centres: Centres, rounds: int = 100, mask=None) -> tuple[Centres, dict[tuple[int, int], float]]:
    """The centres when they no longer move (or after ``rounds``), and the cost of each model. A cluster without points keeps its centre.

    ``mask`` says which ids a model is fitted to; all, without it."""
    centres, cost, moving = dict(centres), {}, list(centres)
    for _ in range(rounds):
        for key, (n, c, s, _q) in _summed(points, _nearest(centres, mask), moving, _width(centres)).items():
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres[key])
            cost[key] = c
            if np.allclose(new, centres[key]):
                moving.remove(key)
            centres[key] = new
        if not moving:
            break
    return centres, cost


def labelled(points: DataFrame, score: Callable[[int, np.ndarray], np.ndarray], name: str = "label") -> DataFrame:
    """``year, id, label``: the cluster of the least score, numbered by the smallest id of each."""

    def assign(batches):
        for year, ids, x in _groups(batches):
            yield pd.DataFrame({"year": year, "id": ids, "raw": score(year, x).argmin(1)})

    return numbered(points.mapInPandas(assign, "year long, id long, raw long"), name)


def numbered(raw: DataFrame, name: str = "label") -> DataFrame:
    """``year, id, label`` of ``year, id, raw``: from 0, in the order of the smallest id of each."""
    raw = written(raw, "labels")
    order = raw.groupBy("year", "raw").agg(F.min("id").alias("least"))  # a row a cluster
    numbers = order.select("year", "raw", (F.row_number().over(W.partitionBy("year").orderBy("least", "raw")) - 1).cast("long").alias(name))
    return raw.join(F.broadcast(numbers), ["year", "raw"]).select("year", "id", name)


def _best(cost: dict[tuple[int, int], float]) -> dict[int, int]:
    """The model of the least cost in each year, the first of equal ones."""
    best: dict[int, int] = {}
    for year, m in sorted(cost):
        if year not in best or cost[year, m] < cost[year, best[year]] - 1e-12:
            best[year] = m
    return best


def kmeans_centres(points: DataFrame, k: int, starts: int = 20, seed: int = 42) -> dict[int, np.ndarray]:
    """For each year the centres of the best of ``starts`` runs, each from its own k-means++ start."""
    centres, cost = lloyd(points, draw(points, starts, k, seed=seed))
    return {year: centres[year, m] for year, m in _best(cost).items()}


def _wide(points: DataFrame) -> int:
    first = points.select(F.size("x")).head(1)
    return first[0][0] if first else 0


def distinct(points: DataFrame) -> DataFrame:
    """``year, x, m, id``: each place once, with the number of its points and a name of its own, names in the order of the least ids; written."""
    once = points.groupBy("year", "x").agg(F.count("*").cast("double").alias("m"), F.min("id").alias("least"))
    parts = max(-(-once.count() // N.CHUNK), 1)
    placed = once.repartitionByRange(parts, "year", "least", "x").sortWithinPartitions("year", "least", "x")
    return written(placed.select("year", "x", "m", F.monotonically_increasing_id().alias("id")), "places")


def ward_tree_of(points: DataFrame, finish: int = N.FINISH) -> tuple[DataFrame, DataFrame]:
    """Ward's tree of each year's places, exact at any size (:func:`panelwright.operators.neighbours.merges`), and the places."""
    places = distinct(points)
    return written(N.merges(places, _wide(points), finish), "ward-tree"), places


def ward_labels(points: DataFrame, k: int, finish: int = N.FINISH) -> DataFrame:
    """``year, id, label``: Ward's ``k`` clusters, or one a place where a year has fewer, numbered by the smallest id of each."""
    tree, places = ward_tree_of(points, finish)
    of = places.join(N.cut(tree, places, k), ["year", "id"]).select("year", "x", F.col("root").alias("raw"))
    return numbered(points.join(of, ["year", "x"]).select("year", "id", "raw"))


def ward_heights(points: DataFrame, most: int = 10, finish: int = N.FINISH) -> dict[int, np.ndarray]:
    """For each year the heights of the last ``most`` merges of different places, the last first."""
    out: dict[int, list] = {}
    for r in N.highest(ward_tree_of(points, finish)[0], most).orderBy("year", "r").collect():
        out.setdefault(r.year, []).append(r.height)
    return {year: np.array(h) for year, h in out.items()}


def ward_starts(points: DataFrame, ks: list[int], finish: int = N.FINISH) -> dict[tuple[int, int], np.ndarray]:
    """For each year and number of clusters the means of Ward's clusters. The sums of the finest cut come to the driver; the last merges
    join them for the others. Years of fewer places have as many clusters."""
    tree, places = ward_tree_of(points, finish)
    groups = places.join(N.cut(tree, places, max(ks)), ["year", "id"])
    total = F.array(*[F.sum(F.col("m") * F.get("x", F.lit(j))) for j in range(_wide(points))])
    sums: dict[int, dict] = {}
    for r in groups.groupBy("year", "root").agg(F.sum("m").alias("n"), total.alias("s")).orderBy("year", "root").collect():
        sums.setdefault(r.year, {})[r.root] = (r.n, np.array(r.s))
    last: dict[int, list] = {}
    for r in N.highest(tree, max(ks) - 1).orderBy("year", F.desc("r")).collect():
        last.setdefault(r.year, []).append((r.id, r.up))
    out = {}
    for year, left in sums.items():
        now = dict(left)
        rest = iter(last.get(year, []))
        for k in range(len(left), 0, -1):
            means = np.array([s / n for n, s in now.values()])
            out |= {(year, want): means for want in ks if min(want, len(left)) == k}
            if (step := next(rest, None)) is not None:
                (n, a), (m, b) = now.pop(step[0]), now[step[1]]
                now[step[1]] = (n + m, a + b)
    return out


def ward_kmeans_centres(points: DataFrame, k: int) -> dict[int, np.ndarray]:
    """K-means from the centres of Ward's clusters."""
    centres, _ = lloyd(points, {(year, 0): c for (year, _), c in ward_starts(points, [k]).items()})
    return {year: c for (year, _), c in centres.items()}


def by_centres(points: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    return labelled(points, lambda year, x: squares(x, centres[year]))


def _log_parts(x: np.ndarray, p: np.ndarray, m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.log(p) - 0.5 * (np.log(2 * np.pi * v).sum(1) + ((x[:, None] - m) ** 2 / v).sum(-1))


def mixture(points: DataFrame, k: int, starts: int = 5, floor: float = 1e-5, rounds: int = 100, tolerance: float = 1e-6, seed: int = 42) -> DataFrame:
    """Labels of a mixture of normals with diagonal covariance, of the start with the highest likelihood.

    Each start takes the clusters of one k-means run; a round sums responsibilities, values and squares."""
    centres, _ = lloyd(points, draw(points, starts, k, seed=seed))
    state, last, width = {}, {}, _width(centres)

    def step(sums):
        for key, (n, _c, s, q) in sums.items():
            n = n + 1e-10
            mean = s / n[:, None]
            state[key] = (n / n.sum(), mean, np.maximum(q / n[:, None] - mean**2, 0) + floor)

    def of(year, m, ids, x):
        parts = _log_parts(x, *state[year, m])
        top = parts.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(parts - top).sum(1))
        return np.exp(parts - total[:, None]), -total

    step(_summed(points, _nearest(centres), list(centres), width))
    moving = list(state)
    for _ in range(rounds):
        sums = _summed(points, of, moving, width)
        for key, (n, c, _s, _q) in sums.items():
            if key in last and last[key] - c < tolerance * n.sum():
                moving.remove(key)
            last[key] = c
        step({key: v for key, v in sums.items() if key in moving})
        if not moving:
            break
    best = _best(last)
    return labelled(points, lambda year, x: -_log_parts(x, *state[year, best[year]]))


def bootstrap(points: DataFrame, k: int, resamples: int = 50, seed: int = 42) -> DataFrame:
    """``year, b, n, ari``: agreement of :func:`ward_kmeans_centres` of a resample's points (drawn with replacement, then distinct)
    with that of all points, over the resample. All resamples are fitted in the same rounds, each from its own Ward tree."""
    mask = lambda ids, b: resampled(ids, b, seed)
    base, _ = lloyd(points, {(year, 0): c for (year, _), c in ward_starts(points, [k]).items()})

    def drawn(batches):
        for pdf in batches:
            for b in range(resamples):
                part = pdf[mask(pdf.id.to_numpy(), b)]
                yield part.assign(year=part.year * resamples + b)

    # A resample of a year is a group of its own in one tree of all.
    begun = {divmod(group, resamples): c for (group, _), c in ward_starts(written(points.mapInPandas(drawn, points.schema), "resampled"), [k]).items()}
    centres, _ = lloyd(points, begun, mask=mask)

    def cells(batches):
        for year, ids, x in _groups(batches):
            whole = squares(x, base[year, 0]).argmin(1)
            for b in range(resamples):
                held = mask(ids, b)
                if held.any():
                    cell = pd.DataFrame({"p": whole[held], "q": squares(x[held], centres[year, b]).argmin(1)}).value_counts().reset_index(name="n")
                    yield cell.assign(year=year, b=b)[["year", "b", "p", "q", "n"]]

    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    c = points.mapInPandas(cells, "year long, b int, p long, q long, n long").groupBy("year", "b", "p", "q").agg(F.sum("n").alias("n"))
    c = c.withColumn("row", F.sum("n").over(W.partitionBy("year", "b", "p"))).withColumn("col", F.sum("n").over(W.partitionBy("year", "b", "q")))  # k rows each
    # A row's pairs are counted once, with its first cell.
    first = lambda by, other: F.row_number().over(W.partitionBy("year", "b", by).orderBy(other)) == 1
    c = c.withColumn("rows", F.when(first("p", "q"), two("row"))).withColumn("cols", F.when(first("q", "p"), two("col")))
    g = c.groupBy("year", "b").agg(F.sum("n").alias("n"), F.sum(two("n")).alias("same"), F.sum("rows").alias("rows"), F.sum("cols").alias("cols"))
    expected = F.coalesce(F.try_divide(F.col("rows") * F.col("cols"), two("n")), F.lit(0.0))
    top = (F.col("rows") + F.col("cols")) / 2 - expected
    return g.select("year", "b", "n", F.when(top == 0, 1.0).otherwise((F.col("same") - expected) / F.nullif(top, F.lit(0.0))).alias("ari"))


def fit_pooled(points: DataFrame, features: list[str], k: int, method: str = "kmeans") -> DataFrame:
    """``year, id, label`` of one model of all years. Features that no row has are left out; rows that lack another one are in no fit
    and go to the centre with the least mean squared difference over the features they have, the first of equal ones.

    Without a whole row there is nothing to fit: ValueError. A row without any of the features has a null label.
    """
    known = points.agg(*[F.count(c).alias(c) for c in features]).first()
    used = [c for c in features if known[c]]
    rows = written(points.select("year", "id", *[F.col(c).cast("double").alias(c) for c in used]), "pooled")
    whole = prepared(rows.withColumn("year", F.lit(0)), used) if used else None
    if whole is None or not whole.head(1):
        raise ValueError("no row has all features")
    fitted = kmeans_centres(whole, k) if method == "kmeans" else ward_kmeans_centres(whole, k)
    centres = fitted[0]

    def assign(batches):
        for pdf in batches:
            x = pdf[used].to_numpy(float)
            there = ~np.isnan(x)
            gap = np.where(there[:, None, :], (np.nan_to_num(x)[:, None, :] - centres[None]) ** 2, 0.0).sum(-1)
            raw = (gap / np.maximum(there.sum(1), 1)[:, None]).argmin(1).astype(float)
            raw[~there.any(1)] = np.nan
            yield pdf[["year", "id"]].assign(raw=pd.array(raw, "Float64").astype("Int64"))

    schema = f"year {rows.schema['year'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, raw long"
    raw = written(rows.mapInPandas(assign, schema), "pooled-labels")
    order = raw.filter("raw is not null").groupBy("raw").agg(F.min(F.struct("id", "year")).alias("least"))  # a row a cluster
    numbers = order.select("raw", (F.row_number().over(W.orderBy("least", "raw")) - 1).cast("long").alias("label"))
    return raw.join(F.broadcast(numbers), "raw", "left").select("year", "id", "label")


def fitted(points: DataFrame, method: str, k: int) -> DataFrame:
    """``year, id, label`` of prepared points by a method's name, a model for each year."""
    if method == "kmeans":
        return by_centres(points, kmeans_centres(points, k))
    if method == "ward_kmeans":
        return by_centres(points, ward_kmeans_centres(points, k))
    if method == "ward":
        return ward_labels(points, k)
    if method == "gmm_diag":
        return mixture(points, k)
    raise ValueError(method)


def partition(panel: DataFrame, features: list[str], value: str, method: str = "ward_kmeans", k: int = 5, mode: str = "per_year") -> DataFrame:
    """``year, id, label, code``: clusters of each year, or (``pooled``) of one model of all years, numbered by the median of
    ``value`` from the highest, in each year or over all; clusters without any value come last. ``code`` is K1 and so on.

    ``panel`` has one row a year and id."""
    if mode not in ("per_year", "pooled"):
        raise ValueError(mode)
    raw = fit_pooled(panel, features, k, method) if mode == "pooled" else fitted(prepared(panel, features), method, k)
    raw = written(raw.filter("label is not null").withColumnRenamed("label", "raw"), "partition")
    by = ["year"] if mode == "per_year" else []
    middle = raw.join(panel.select("year", "id", F.col(value).alias("value")), ["year", "id"], "left").groupBy(*by, "raw").agg(F.median("value").alias("m"))
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(F.desc_nulls_last("m"), "raw")  # a row a cluster
    order = middle.select(*by, "raw", (F.row_number().over(w) - 1).cast("long").alias("label"))
    return raw.join(F.broadcast(order), [*by, "raw"]).select("year", "id", "label", F.concat(F.lit("K"), (F.col("label") + 1).cast("string")).alias("code"))


def _grid(points: DataFrame, ks: range, starts: int, seed: int) -> dict[tuple[str, int, int], tuple]:
    """``n, wcss, calinski`` and the centres of each method, number of clusters and year."""
    drawn = draw(points, starts, max(ks), seed=seed)
    begun = {(year, k * (starts + 1) + m): c[:k] for (year, m), c in drawn.items() for k in ks if k <= len(c)}
    begun |= {(year, k * (starts + 1) + starts): c for (year, k), c in ward_starts(points, list(ks)).items() if k == len(c)}
    centres, _ = lloyd(points, begun)
    best: dict[tuple[str, int, int], tuple] = {}
    for (year, m), (n, _c, s, q) in _summed(points, _nearest(centres), list(centres), _width(centres)).items():
        k, start = divmod(m, starts + 1)
        live, total = n > 0, n.sum()
        inner = float((q[live] - s[live] ** 2 / n[live, None]).sum())
        outer = float((q.sum(0) - s.sum(0) ** 2 / total).sum()) - inner
        calinski = float(outer / (k - 1) / (inner / (total - k))) if k > 1 and total > k and inner > 0 else None
        key = ("ward_kmeans" if start == starts else "kmeans", k, year)
        if key not in best or inner < best[key][1]:
            best[key] = (int(total), inner, calinski, centres[year, m])
    return best


def grid(points: DataFrame, ks: range, starts: int = 5, seed: int = 42) -> list[tuple[str, int, int, int, float, float | None]]:
    """``method, k, year, n, wcss, calinski`` for k-means and Ward with k-means: all numbers of clusters and starts in the same rounds.

    The first k of a k-means++ draw are one of k, so the starts of all ``ks`` are the beginnings of ``starts`` draws; Ward's tree is
    cut at every k. Numbers of clusters beyond a year's distinct points have no row.
    """
    best = _grid(points, ks, starts, seed)
    return [(*key, *best[key][:3]) for key in sorted(best)]


def grid_labels(points: DataFrame, ks: range, starts: int = 5, seed: int = 42) -> DataFrame:
    """``method, k, year, id, label`` for k-means, Ward with k-means (the partitions of :func:`grid`, labels being places of their centres)
    and Ward (labels being the smallest id of each cluster's places): a row a point and partition, from one pass for all centres and one tree."""
    best = _grid(points, ks, starts, seed)
    cells: dict[int, list] = {}
    for (method, k, year), found in sorted(best.items()):
        cells.setdefault(year, []).append((method, k, found[3]))

    def assign(batches):
        for year, ids, x in _groups(batches):
            for method, k, c in cells.get(year, []):
                yield pd.DataFrame({"method": method, "k": k, "year": year, "id": ids, "label": squares(x, c).argmin(1)})

    by_centre = points.mapInPandas(assign, "method string, k long, year long, id long, label long")
    tree, places = ward_tree_of(points)
    enough = places.groupBy("year").agg(F.count("*").alias("places"))  # a row a year
    parts = [N.cut(tree, places, k).join(F.broadcast(enough.filter(F.col("places") >= k)), "year").select("year", F.col("id").alias("place"), F.lit(k).cast("long").alias("k"), F.col("root").alias("label")) for k in ks]
    at = points.join(places.select("year", "x", F.col("id").alias("place")), ["year", "x"]).select("year", "id", "place")
    by_tree = at.join(reduce(DataFrame.unionByName, parts), ["year", "place"]).select(F.lit("ward").alias("method"), "k", "year", "id", "label")
    return by_centre.unionByName(by_tree)
