"""Assembling a panel: keys, duplicates, gaps, sections, predecessors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.sources.work import written


def resolve(rows: DataFrame, versions: DataFrame, code: str, stable: str, year: str = "year", first_year: int = 2018) -> DataFrame:
    """``id_resolved`` and ``match`` for rows whose codes change over time.

    Stages: the version in force (half-open years), a code or a stable code that only one entity ever
    had, the entity of already resolved rows with the same stable code; else ``ambiguous`` or ``absent``.
    ``versions``: ``id, code, year_from, year_to``, one row per version.
    """
    v = versions.select(F.col("id").alias("__v"), F.col("code").alias("__c"), "year_from", "year_to")
    in_force = v.select("__v", "__c", F.col("year_from").alias("__f"), F.col("year_to").alias("__t"))
    y = F.greatest(F.col(year), F.lit(first_year))
    a = rows.join(in_force, (F.col(code) == F.col("__c")) & (F.col("__f") <= y) & (y < F.col("__t")), "left").drop("__c", "__f", "__t").withColumnRenamed("__v", "__by_year")
    held = v.groupBy("__c").agg(F.min("__v").alias("__one"), F.count_distinct("__v").alias("__n"))
    b = a.join(held.select(F.col("__c").alias(code), F.when(F.col("__n") == 1, F.col("__one")).alias("__by_code"), F.col("__n").alias("__n1")), code, "left")
    c = b.join(held.select(F.col("__c").alias(stable), F.when(F.col("__n") == 1, F.col("__one")).alias("__by_stable"), F.col("__n").alias("__n2")), stable, "left")
    c = written(c.withColumn("__now", F.coalesce("__by_year", "__by_code", "__by_stable")), "resolved")  # read for peers and for rows
    peers = c.filter("__now is not null").groupBy(stable).agg(F.when(F.count_distinct("__now") == 1, F.min("__now")).alias("__peer"))
    d = c.join(peers, stable, "left")
    match = (
        F.when(F.col("__by_year").isNotNull(), "by_year").when(F.col("__by_code").isNotNull(), "by_code").when(F.col("__by_stable").isNotNull(), "by_stable")
        .when(F.col("__peer").isNotNull(), "by_peer").when(F.greatest(F.coalesce("__n1", F.lit(0)), F.coalesce("__n2", F.lit(0))) > 1, "ambiguous").otherwise("absent")
    )
    return d.select(*rows.columns, F.coalesce("__now", "__peer").alias("id_resolved"), match.alias("match"))


def valid_in_year(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """The rows of entities with a version in force."""
    v = versions.select(F.col("id").alias("__v"), "year_from", "year_to")
    return rows.join(v, (rows["id"] == F.col("__v")) & (F.col("year_from") <= rows["year"]) & (rows["year"] < F.col("year_to")), "left_semi")


def prefer(df: DataFrame, keys: list[str], value: str, preference: str) -> DataFrame:
    """The best row of each key: known values first, then the lowest preference. Partial aggregates go before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(F.col(value).isNull(), F.col(preference)))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in others])


def fill_absent(first: DataFrame, *fallbacks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of later tables whose key no earlier one has."""
    out = first
    for f in fallbacks:
        out = out.unionByName(f.join(out.select(*keys), keys, "left_anti"))
    return out


def collapse(df: DataFrame, keys: list[str], value: str, weight: str, rule: Column, code: str, current: Column) -> DataFrame:
    """Several source rows of a key become one: ``value, flag``.

    One distinct value is taken as it is. Others follow ``rule``: ``sum``; ``mean``, weighted, null if a weight is
    missing or they come to nothing; ``pick``, the current code's row, else that of the newest code; else null.
    """
    picked = F.max_by(F.col(value), F.struct(current, F.col(code)))
    n = F.count_distinct(value)
    weighted = F.when((F.count(weight) == F.count(value)) & (F.sum(weight) > 0), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)))
    g = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(n.alias("__n"), F.sum(value).alias("__s"), weighted.alias("__w"), picked.alias("__p"), F.first(rule).alias("__r"), F.first(value).alias("__1"))
    one = F.col("__n") == 1
    out = F.when(one, F.col("__1")).when(F.col("__r") == "sum", F.col("__s")).when(F.col("__r") == "mean", F.col("__w")).when(F.col("__r") == "pick", F.col("__p"))
    flag = F.when(one, "").when(F.col("__r") == "pick", "duplicate_codes").otherwise("merged_sources")
    return g.select(*keys, out.alias("value"), flag.alias("flag"))


def predecessor_sum(long: DataFrame, events: DataFrame) -> DataFrame:
    """Values of merged entities before the event: the sum over all predecessors, only where each has one."""
    e = events.select("succ", "event_year", F.size("preds").alias("need"), F.explode("preds").alias("id"))
    j = long.join(e, "id").filter("year < event_year")
    return j.groupBy(F.col("succ").alias("id"), "year", "indicator").agg(F.count("value").alias("n"), F.max("need").alias("need"), F.sum("value").alias("value")).filter("n = need").select("id", "year", "indicator", "value")


def neighbour_spikes(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """``spike``: the value deviates by more than the threshold from both neighbours, to the same side."""
    w = W.partitionBy("id").orderBy("year")
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    up = (F.try_divide(F.col(value), before) - 1 > threshold) & (F.try_divide(F.col(value), after) - 1 > threshold)
    down = (F.try_divide(F.col(value), before) - 1 < -threshold) & (F.try_divide(F.col(value), after) - 1 < -threshold)
    return df.withColumn("spike", F.coalesce(up | down, F.lit(False)))


def last_run(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last run of consecutive years of each key."""
    w = W.partitionBy(*keys).orderBy("year")
    island = F.col("year") - F.row_number().over(w)
    return df.withColumn("__i", island).withColumn("__m", F.max("__i").over(W.partitionBy(*keys))).filter("__i = __m").drop("__i", "__m")


def top_level(rows: DataFrame, level: str, top: str, kind: str, lower: list[str]) -> DataFrame:
    """The rows of the top level, but for those of a lower kind, which are sums of incomplete parts. A null kind is none of these; a null level is no top."""
    return rows.filter((F.col(level) == top) & ~F.coalesce(F.col(kind).isin(lower), F.lit(False)))


def reject_invalid(long: DataFrame, positive: list[str], percent: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that are kept and, with a ``reason``, those that are not; no value is changed.

    Series that have to be positive are rejected at 0 and below, not where a value is missing; percentages outside of 0 to 100 and missing ones."""
    v, i = F.col("value"), F.col("indicator")
    low = i.isin(positive) & F.coalesce(v <= 0, F.lit(False))
    off = i.isin(percent) & ~F.coalesce(v.between(0, 100), F.lit(False))
    marked = long.withColumn("reason", F.when(low, "not positive").when(off, "not between 0 and 100"))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def coordinates(entities: DataFrame, centroids: DataFrame) -> DataFrame:
    """``entities`` (``id, lat, lon``) with missing coordinates from ``centroids`` (``id, lat, lon``), each by itself, ``coord_source`` (``directory``
    where the latitude is its own, else ``centroid``), ``lon360`` from 0 to 360, and ``has_centroid``."""
    c = centroids.select("id", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.lit(True).alias("__has"))
    j = entities.join(c, "id", "left").withColumn("coord_source", F.when(F.col("lat").isNotNull(), "directory").otherwise("centroid"))
    j = j.withColumns({"lat": F.coalesce("lat", "__lat"), "lon": F.coalesce("lon", "__lon"), "has_centroid": F.coalesce("__has", F.lit(False))}).drop("__lat", "__lon", "__has")
    return j.withColumn("lon360", F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon")))


def fill_both_ways(df: DataFrame, value: str, to: str) -> DataFrame:
    w = W.partitionBy("id").orderBy("year")
    ahead = F.last(value, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    back = F.first(value, True).over(w.rowsBetween(0, W.unboundedFollowing))
    return df.withColumn(to, F.coalesce(ahead, back))


def normalise(df: DataFrame, columns: list[str], method: str, by: list[str]) -> DataFrame:
    """Min-max or z-scores over the whole table or groups; constants become 0, missing stays missing.

    Over the whole table, statistics are one aggregate that is joined back as a single row."""
    stats = []
    for c in columns:
        lo, hi = (F.min(c), F.max(c) - F.min(c)) if method == "minmax" else (F.avg(c), F.stddev_pop(c))
        stats += [lo.alias(f"__lo_{c}"), hi.alias(f"__hi_{c}")]
    s = df.groupBy(*by).agg(*stats)
    j = df.join(F.broadcast(s), by) if by else df.crossJoin(F.broadcast(s))  # one row, or one a group of years
    scaled = [F.when(F.col(c).isNotNull(), F.when(F.abs(F.col(f"__hi_{c}")) < 1e-12, F.lit(0.0)).otherwise((F.col(c) - F.col(f"__lo_{c}")) / F.col(f"__hi_{c}"))).alias(c) for c in columns]
    return j.select(*[c for c in df.columns if c not in columns], *scaled)
