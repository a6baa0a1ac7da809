"""Price levels from index series, deflators and real values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators.panel import last_run


def chain(index: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Levels of annual indices in per cent: 1 in the year before the first, then their running product.

    Only the last run of years with indices between 30 and 1000 counts; sentinels break a chain.
    """
    run = last_run(index.filter((F.col(idx) > 30) & (F.col(idx) < 1000)), keys)
    w = W.partitionBy(*keys).orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    levels = run.select(*keys, "year", F.product(F.col(idx) / 100).over(w).alias("level"))
    start = run.groupBy(*keys).agg((F.min("year") - 1).alias("year")).withColumn("level", F.lit(1.0))
    return levels.unionByName(start.select(*keys, "year", "level"))


def mid_year(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Annual levels of December-to-December chains: the geometric mean of the level and the one before."""
    w = W.partitionBy(*keys).orderBy("year")
    return levels.select(*keys, "year", F.sqrt(F.col("level") * F.lag("level").over(w)).alias("level")).filter("level is not null")


def annual_average(monthly: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Mean of the twelve running products of monthly indices, for complete years."""
    w = W.partitionBy(*keys).orderBy("year", "month").rowsBetween(W.unboundedPreceding, 0)
    m = monthly.select(*keys, "year", F.product(F.col(idx) / 100).over(w).alias("l"))
    return m.groupBy(*keys, "year").agg(F.avg("l").alias("level"), F.count("*").alias("n")).filter("n = 12").drop("n")


def extend(spine: DataFrame, keys: list[str], level: str, reference: str) -> DataFrame:
    """A level continued before and after its years at the growth of a reference; gaps within stay.

    Growth telescopes: the value is the last (first) level times the ratio of references.
    """
    w = W.partitionBy(*keys)
    known = F.col(level).isNotNull()
    lo, hi = F.min(F.when(known, F.col("year"))).over(w), F.max(F.when(known, F.col("year"))).over(w)
    first, last = F.struct(F.col(level).alias("l"), F.col(reference).alias("r")), F.struct(F.col(level).alias("l"), F.col(reference).alias("r"))
    at_lo, at_hi = F.min_by(F.when(known, first), F.when(known, F.col("year"))).over(w), F.max_by(F.when(known, last), F.when(known, F.col("year"))).over(w)
    s = spine.withColumn("__lo", lo).withColumn("__hi", hi).withColumn("__f", at_lo).withColumn("__l", at_hi)
    out = F.coalesce(
        F.col(level),
        F.when(F.col("year") > F.col("__hi"), F.try_divide(F.col("__l.l") * F.col(reference), F.col("__l.r"))),
        F.when(F.col("year") < F.col("__lo"), F.try_divide(F.col("__f.l") * F.col(reference), F.col("__f.r"))),
    )
    flag = F.when(known, "own").when(out.isNotNull(), "extended")
    return s.select(*keys, "year", out.alias("level"), flag.alias("flag"))


def factors(levels: DataFrame, keys: list[str], base_year: int) -> DataFrame:
    """``factor``: what turns a year's money into that of the base year."""
    base = F.max(F.when(F.col("year") == base_year, F.col("level"))).over(W.partitionBy(*keys))
    return levels.select(*keys, "year", F.try_divide(base, F.col("level")).alias("factor"))


def allocate(df: DataFrame, value: Column, weight: Column, by: list[str]) -> Column:
    """A group's value dealt out by the rows' shares of its weight."""
    return F.try_divide(value * weight, F.sum(weight).over(W.partitionBy(*by)))


def basket(rows: DataFrame, unit: str, marker: str, value: str, keys: list[str]) -> DataFrame:
    """``keys, basket_rel``: the cost of a fixed set relative to the country's (1), from the rows whose unit says so; values from 1000 % up and
    from 0 down are no costs. Rows with a null key, unit or value are left out."""
    kept = rows.filter(F.contains(unit, F.lit(marker))).dropna(subset=keys)
    return kept.select(*keys, (F.col(value) / 100).alias("basket_rel")).filter("basket_rel > 0 and basket_rel < 10")


def by_method(methods: dict[str, Callable[[], DataFrame]], chosen: list[str]) -> DataFrame:
    """The rows of the chosen methods one after the other, with the ``method`` of each; columns that a method lacks are null. ValueError for an unknown one."""
    if unknown := [m for m in chosen if m not in methods]:
        raise ValueError(f"no such method: {', '.join(unknown)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [methods[m]().withColumn("method", F.lit(m)) for m in chosen])
