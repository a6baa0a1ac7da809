"""Running sums over groups of any size: no group, and no whole table, is in one task.

The rows are range-partitioned by group and order, written, and summed by partition and group; the sums of the partitions before are
then added to the running sums within each partition. The window over partitions has a row for each partition that a group lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize


def running(rows: DataFrame, group: list[str], order: list[Column], value: str | None = None) -> DataFrame:
    """``rows`` with ``ordinal`` (from 0) and ``before`` (the sum of ``value`` over the rows before), both long, within each group.

    A null group is one of its own; null values count as 0. Rows that agree in group and order are put in any order, and may lie in
    several partitions, so that equal rows are no hot spot; where they are equal in every column the result is one and the same. An
    empty table gives an empty one. ``rows`` is read twice and must not have columns that start with ``__``.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc_nulls_first() for g in group] + order + [F.col("__tie")]
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    amount = F.coalesce(F.col(value).cast("long"), F.lit(0).cast("long")) if value else F.lit(0).cast("long")
    pieces = ranged.groupBy("__part", *group).agg(F.count("*").alias("__n"), F.sum(amount).alias("__v"))
    earlier = W.partitionBy(*group or [F.lit(0)]).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = pieces.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], *[F.coalesce(F.sum(c).over(earlier), zero).alias(f"{c}0") for c in ("__n", "__v")])
    within = W.partitionBy("__part", *group).orderBy(*order, "__tie").rowsBetween(W.unboundedPreceding, -1)
    own = ranged.withColumns({"__a": F.coalesce(F.count("*").over(within), zero), "__b": F.coalesce(F.sum(amount).over(within), zero)})
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return own.join(starts, same).select(*rows.columns, (F.col("__n0") + F.col("__a")).alias("ordinal"), (F.col("__v0") + F.col("__b")).alias("before"))
