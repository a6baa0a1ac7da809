"""Convergence of a panel: dispersion over time, growth on levels, relative paths and clubs.

Sums over entities are Spark aggregates; what comes to the driver has a size given by the number of years (for clubs, also a
bounded number of the last units).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.sources.work import written


def smoother(t: int, weight: float = 400.0) -> np.ndarray:
    """The matrix that turns ``t`` values into their trend: least squares with squared second differences weighted."""
    second = np.diff(np.eye(t), 2, axis=0)
    return np.linalg.inv(np.eye(t) + weight * second.T @ second)


def slope_test(h: np.ndarray, trim: float = 0.3) -> dict[str, float]:
    """``b``, its t value and ``points`` of log(h[0] / h[t]) - 2 log log t on log t, t counted from 1, for t above ``trim`` of all.

    Standard errors allow for one lag of autocorrelation (weight 1/2). Fewer than three usable points, or no spread, give nan.
    """
    n = len(h)
    t = np.arange(1, n + 1)[max(int(trim * n), 1) :]
    with np.errstate(divide="ignore", invalid="ignore"):
        y = np.log(h[0] / h[n - len(t) :]) - 2 * np.log(np.log(t))
    ok = np.isfinite(y)
    y, x = y[ok], np.column_stack((np.ones(ok.sum()), np.log(t[ok])))
    if len(y) < 3:
        return {"b": np.nan, "t": np.nan, "points": len(y)}
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    score = x * (y - x @ beta)[:, None]
    lag = score[1:].T @ score[:-1]
    cov = inverse @ (score.T @ score + 0.5 * (lag + lag.T)) @ inverse
    return {"b": float(beta[1]), "t": float(beta[1] / np.sqrt(cov[1, 1])) if cov[1, 1] > 0 else np.nan, "points": len(y)}


def log_t(panel: DataFrame, value: str, years: list[int], trim: float = 0.3) -> dict[str, float]:
    """The log t test of ``id, year, value`` (positive values): ``b``, ``t``, ``points`` and the number ``n`` of entities with all years.

    Null and non-positive values are missing, and so are their entities; several rows of an entity and year count with their mean.
    """
    known = panel.filter(F.col(value) > 0).groupBy("id").pivot("year", years).agg(F.avg(F.ln(value))).dropna()
    matrix = smoother(len(years))
    trend = [sum(F.col(str(y)) * float(w) for y, w in zip(years, row)) for row in matrix]
    paths = known.select(*[c.alias(f"x{i}") for i, c in enumerate(trend)])
    # The mean of (x / m - 1)^2 from the sums of x and x^2.
    sums = paths.agg(F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(years))], *[F.avg(F.col(f"x{i}") * F.col(f"x{i}")).alias(f"q{i}") for i in range(len(years))]).first()
    if sums.n < 3 or len(years) < 5:
        return {"b": np.nan, "t": np.nan, "points": 0, "n": sums.n}
    h = np.array([sums[f"q{i}"] / sums[f"m{i}"] ** 2 - 1 for i in range(len(years))])
    return slope_test(h, trim) | {"n": sums.n}


def t_values(h: np.ndarray, trim: float = 0.3) -> np.ndarray:
    """The t values of :func:`slope_test` for every row at once."""
    n = h.shape[1]
    t = np.arange(1, n + 1)[max(int(trim * n), 1) :]
    with np.errstate(divide="ignore", invalid="ignore"):
        y = np.log(h[:, :1] / h[:, n - len(t) :]) - 2 * np.log(np.log(t))
    out = np.full(len(h), np.nan)
    whole = np.isfinite(y).all(1)
    if len(t) >= 3 and whole.any():
        x = np.column_stack((np.ones(len(t)), np.log(t)))
        inverse = np.linalg.inv(x.T @ x)
        beta = y[whole] @ x @ inverse
        score = x[None] * (y[whole] - beta @ x.T)[:, :, None]
        lag = np.einsum("rti,rtj->rij", score[:, 1:], score[:, :-1])
        meat = np.einsum("rti,rtj->rij", score, score) + 0.5 * (lag + lag.transpose(0, 2, 1))
        var = (inverse @ meat @ inverse)[:, 1, 1]
        out[whole] = np.where(var > 0, beta[:, 1] / np.sqrt(np.where(var > 0, var, 1.0)), np.nan)
    for i in np.flatnonzero(~whole):
        out[i] = slope_test(h[i], trim)["t"]
    return out


def spread_tests(n: np.ndarray, s: np.ndarray, q: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The t values of groups from their numbers of paths, sums and sums of squares of paths less ``shift``; nan for fewer than three."""
    mean = s / n[:, None]
    h = np.maximum(q / n[:, None] - mean**2, 0) / (mean + shift) ** 2
    return np.where(n > 2, t_values(h), np.nan)


def core_end(t: np.ndarray, critical: float) -> int | None:
    """Of the t values of growing runs, the place of the highest between the first above ``critical`` and the next below it."""
    above = np.flatnonzero(t > critical)
    if not len(above):
        return None
    below = np.flatnonzero(t[above[0] :] < critical)
    end = above[0] + below[0] if len(below) else len(t)
    return int(above[0] + np.nanargmax(t[above[0] : end]))


def _few_clubs(x: np.ndarray, shift: np.ndarray, critical: float, number: int) -> np.ndarray:
    """The clubs of paths in order, numbered on from ``number``."""
    club, free = np.full(len(x), -1), np.arange(len(x))
    while len(free) > 1:
        v = x[free] - shift
        s, q = v.cumsum(0), (v**2).cumsum(0)
        end = core_end(spread_tests(np.arange(1, len(free) + 1), s, q, shift), critical)
        if end is None:
            free = free[1:]
            continue
        number += 1
        rest = v[end + 1 :]
        joins = spread_tests(np.full(len(rest), end + 2), s[end] + rest, q[end] + rest**2, shift) > 0
        club[free[: end + 1]] = number
        club[free[end + 1 :][joins]] = number
        free = free[end + 1 :][~joins]
    return club


def _runs(before: dict[int, tuple], shift: np.ndarray):
    """For a partition of units in order, the place and t value of the leading run that ends with each."""

    def run(pdf):
        pdf = pdf.sort_values(["last", "id"], ascending=[False, True])
        n, s, q = before[int(pdf.part.iat[0])]
        v = np.stack(pdf.x.to_numpy()) - shift
        place = n + np.arange(1, len(v) + 1)
        return pd.DataFrame({"id": pdf.id.to_numpy(), "place": place, "t": spread_tests(place, s + v.cumsum(0), q + (v**2).cumsum(0), shift)})

    return run


def clubs(units: DataFrame, critical: float = -1.65, local: int = 4096) -> DataFrame:
    """``id, club`` of paths ``id, x`` (logs by year, an array of one length): clubs from 1; -1 belongs to none.

    Units are taken by their last value, highest first, ties by id. A club's core is the leading run with the highest t value
    between the first run above ``critical`` and the next below it; every unit after it joins with which the core's t value is above 0.
    What is left goes through the same; a leading unit that starts no core belongs to no club. The spread of a run follows from running
    sums of its paths and their squares, so all leading runs are tested in one pass over range-partitioned units, and all units
    that may join in another. At most ``local`` units that are left come to the driver, a path each, for the same on arrays.
    Units with a null or a missing value belong to no club.
    """
    spark = units.sparkSession
    whole = units.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    first = whole.agg(F.max(F.size("x"))).first()[0]
    none = F.lit(-1).cast("long")
    if not first:
        return units.select("id", none.alias("club"))
    width, matrix = first, smoother(first)
    trend = F.array(*[sum((F.get("x", F.lit(i)) * float(w) for i, w in enumerate(row[1:], 1)), F.get("x", F.lit(0)) * float(row[0])) for row in matrix])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = F.get("x", F.lit(width - 1))
    dealt = whole.select("id", last.alias("last"), trend.alias("x")).repartitionByRange(parts, F.desc("last"), "id").withColumn("part", F.spark_partition_id())
    left = written(dealt, "club-units")
    total = lambda c: F.array(*[F.sum(c(i)) for i in range(width)])
    shift = np.array(left.agg(total(lambda i: F.get("x", F.lit(i)) / 1.0).alias("s"), F.count("*").alias("n")).select(F.transform("s", lambda v: v / F.col("n"))).first()[0])
    at = lambda i: F.get("x", F.lit(i)) - float(shift[i])
    sums = [F.count("*").alias("n"), total(at).alias("s"), total(lambda i: at(i) * at(i)).alias("q")]
    found, number = [], 0
    while True:
        pieces = left.groupBy("part").agg(*sums).orderBy("part").collect()  # a row a partition
        size = sum(r.n for r in pieces)
        if size <= max(local, 1):
            rows = left.orderBy(F.desc("last"), "id").collect() if size > 1 else []
            got = _few_clubs(np.array([r.x for r in rows]), shift, critical, number) if rows else []
            few = spark.createDataFrame([(r.id, int(c)) for r, c in zip(rows, got) if c > 0], f"id {units.schema['id'].dataType.simpleString()}, club long")
            found.append(few)
            break
        before, so_far = {}, (0, np.zeros(width), np.zeros(width))
        for r in pieces:
            before[r.part] = so_far
            so_far = (so_far[0] + r.n, so_far[1] + np.array(r.s), so_far[2] + np.array(r.q))

        tested = written(left.groupBy("part").applyInPandas(_runs(before, shift), f"id {units.schema['id'].dataType.simpleString()}, place long, t double"), "club-runs")
        t = F.when(~F.isnan("t"), F.col("t"))
        above = tested.agg(F.min(F.when(t > critical, F.col("place")))).first()[0]
        if above is None:
            left = written(left.join(tested.filter("place = 1").select("id"), "id", "left_anti"), "club-units")
            continue
        below = tested.filter(F.col("place") > above).agg(F.min(F.when(t < critical, F.col("place")))).first()[0]
        held = tested.filter((F.col("place") >= above) & (F.col("place") < (below or size + 1)))
        end = held.agg(F.max_by("place", F.struct(t, -F.col("place")))).first()[0]
        number += 1
        core = left.join(tested.filter(F.col("place") <= end).select("id"), "id", "left_semi")
        whole_core = core.agg(*sums).first()
        n, s, q = whole_core.n, np.array(whole_core.s), np.array(whole_core.q)

        def tries(batches, n=n, s=s, q=q):
            for pdf in batches:
                v = np.stack(pdf.x.to_numpy()) - shift if len(pdf) else np.zeros((0, width))
                yield pdf[["id"]].assign(joins=spread_tests(np.full(len(v), n + 1), s + v, q + v**2, shift) > 0)

        rest = left.join(tested.filter(F.col("place") > end).select("id"), "id", "left_semi")
        joins = written(rest.mapInPandas(tries, f"id {units.schema['id'].dataType.simpleString()}, joins boolean"), "club-joins")
        found.append(core.select("id", F.lit(number).cast("long").alias("club")).unionByName(joins.filter("joins").select("id", F.lit(number).cast("long").alias("club"))))
        left = written(rest.join(joins.filter("not joins").select("id"), "id", "left_semi"), "club-units")
    members = reduce(DataFrame.unionByName, found)
    return units.select("id").join(members, "id", "left").select("id", F.coalesce("club", none).alias("club"))


def beta_within(panel: DataFrame, years: list[int]) -> DataFrame:
    """``n, n_units, n_groups, b, se, speed`` of ``y`` on ``x`` with effects of ``id`` and ``year``, errors clustered by ``grp``.

    The effects of entities go out by their means. Those of the few years are partialled out of what is left by least
    squares, which on unbalanced panels is where alternating means would end; only sums by years come to the driver.
    Rows with null ``x`` or ``y`` are left out; a null group is one of its own.
    """
    own = W.partitionBy("id")
    p = panel.filter("x is not null and y is not null").select("id", "year", F.coalesce(F.col("grp").cast("string"), F.lit("\x00")).alias("grp"), "x", "y")
    columns = {"x": F.col("x"), "y": F.col("y")} | {f"d{t}": (F.col("year") == t).cast("double") for t in years[1:]}
    within = p.select("id", "grp", *[(c - F.avg(c).over(own)).alias(k) for k, c in columns.items()])
    names = list(columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = within.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]).first()
    s = np.array([[(sums[f"{a}_{b}"] if names.index(a) <= names.index(b) else sums[f"{b}_{a}"]) or 0.0 for b in names] for a in names])
    effects = np.linalg.pinv(s[2:, 2:]) @ s[2:, :2]

    def apart(k: int, name: str):
        return sum((F.col(d) * float(-effects[j, k]) for j, d in enumerate(names[2:])), F.col(name)).alias(name)

    clean = within.select("id", "grp", apart(0, "x"), apart(1, "y"))
    total = clean.agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("b"), F.count("*").alias("n"), F.count_distinct("id").alias("n_units"))
    by = clean.crossJoin(F.broadcast(total)).groupBy("grp", "xx", "b", "n", "n_units").agg(F.sum(F.col("x") * (F.col("y") - F.col("b") * F.col("x"))).alias("u"))  # one row of sums
    groups = F.count("*")
    out = by.groupBy("xx", "b", "n", "n_units").agg(groups.alias("n_groups"), (F.sum(F.col("u") * F.col("u")) * F.try_divide(groups, groups - 1)).alias("meat"))
    return out.select("n", "n_units", "n_groups", "b", (F.sqrt("meat") / F.col("xx")).alias("se"), F.when(F.col("b") > -1, -F.ln(1 + F.col("b"))).alias("speed"))
