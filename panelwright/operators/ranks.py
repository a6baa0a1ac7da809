"""Ranks, and rank correlations of many columns, with no column in one task.

A rank is a running count. The distinct values of all columns are range-partitioned by column and value, counted in each
partition, and the counts of the partitions before are added; ties share the mean of their ranks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.sources.work import written


def value_ranks(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, rank``: the mean rank from 1 of each distinct value within its keys, of rows without nulls; nan counts as the largest."""
    return _weighted_ranks(values.select(*keys, F.col(value).alias("v"), F.lit(1).cast("long").alias("m")), keys).withColumnRenamed("v", value)


def _weighted_ranks(values: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, v, rank`` of ``keys, v, m``, rows that stand for ``m`` each."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = written(values.groupBy(*keys, "v").agg(F.sum("m").alias("m")), "value-counts")
    dealt = written(counts.repartitionByRange(parts, *keys, "v").withColumn("part", F.spark_partition_id()), "dealt")
    pieces = dealt.groupBy(*keys, "part").agg(F.sum("m").alias("n"))
    zero = F.lit(0).cast("long")
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), zero)  # a row a partition
    within = F.coalesce(F.sum("m").over(W.partitionBy(*keys, "part").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), zero)
    j = dealt.withColumn("within", within).join(pieces.select(*keys, "part", before.alias("before")), [*keys, "part"])
    return j.select(*keys, "v", (F.col("before") + F.col("within") + (F.col("m") + 1) / 2).alias("rank"))


def spearman_pairs(rows: DataFrame, columns: list[str], least: int = 1) -> DataFrame:
    """``a, b, n, rho`` of each two columns over the rows that have both (null or nan is missing), ranked among those rows alone.

    Pairs of fewer than ``least`` rows are left out; ``rho`` is null where a column is constant.
    """
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), number[a].alias("x"), number[b].alias("y")) for i, a in enumerate(columns) for b in columns[i + 1 :]])
    long = rows.select(F.explode(pairs).alias("p")).select("p.*").filter("x is not null and y is not null")
    # Equal pairs of values are one row with their number.
    long = written(long.groupBy("a", "b", "x", "y").agg(F.count("*").alias("m")), "pairs")
    sides = long.select("a", "b", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("v")), F.struct(F.lit(1).alias("side"), F.col("y").alias("v")))).alias("s"), "m")
    ranks = written(_weighted_ranks(sides.select("a", "b", "s.*", "m"), ["a", "b", "side"]), "ranks")
    of = lambda i, name: ranks.filter(F.col("side") == i).select("a", "b", F.col("v").alias(name), F.col("rank").alias(f"r{name}"))
    j = long.join(of(0, "x"), ["a", "b", "x"]).join(of(1, "y"), ["a", "b", "y"])
    n, m = F.sum("m"), F.col("m")
    s = lambda c: F.sum(m * c)
    x, y = F.col("rx"), F.col("ry")
    g = j.groupBy("a", "b").agg(n.alias("n"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("xx"), s(y * y).alias("yy"), s(x * y).alias("xy")).filter(F.col("n") >= least)
    cov = F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")
    var = (F.col("xx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("yy") - F.col("sy") * F.col("sy") / F.col("n"))
    return g.select("a", "b", "n", F.when(var > 1e-12, cov / F.sqrt(var)).alias("rho"))


def strong_pairs(rows: DataFrame, columns: list[str], threshold: float = 0.8, least: int = 100, family: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """The pairs of :func:`spearman_pairs` with ``|rho|`` of at least ``threshold``, but for those of one ``family`` of codes."""
    p = spearman_pairs(rows, columns, least)
    return p.filter((F.abs("rho") >= threshold) & (family(F.col("a")) != family(F.col("b"))))
