"""Earlier values of entities that come from others, event by event in order of time.

Events are rows ``event, kind, year, preds, succs``. A ``union`` gives its successor the sum or the weighted mean of all predecessors
before its year; a ``transfer`` gives a successor the values of the one predecessor that it shares a code with. An event sees what
earlier ones have derived, so events are a graph: one has to wait for an earlier one that writes what it reads or writes, or that
reads what it writes. The graph is worked off in levels, all events of a level at once, as joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.sources.work import written


def event_levels(events: DataFrame) -> list[DataFrame]:
    """The events in levels, each as the ids of its events: none waits for another of its own level or of a later one.

    Order is by year, then by event. A round takes all events that wait for none that is left, so there are as many rounds as the
    longest chain has events.
    """
    one = events.select("event", F.struct("year", "event").alias("at"), "preds", "succs")
    uses = one.select("event", "at", F.explode("preds").alias("id"), F.lit(False).alias("writes")).unionByName(one.select("event", "at", F.explode("succs").alias("id"), F.lit(True).alias("writes")))
    uses = written(uses.distinct(), "event-uses")
    later = uses.select(F.col("event").alias("waits"), F.col("at").alias("at2"), "id", F.col("writes").alias("writes2"))
    waits = written(uses.join(later, "id").filter("at < at2 and (writes or writes2)").select(F.col("event").alias("first"), "waits").distinct(), "event-waits")
    left, out = events.select("event"), []
    while True:
        ready = written(left.join(waits.select(F.col("waits").alias("event")).distinct(), "event", "left_anti"), "event-level")
        if not ready.head(1):
            return out
        out.append(ready)
        left = written(left.join(ready, "event", "left_anti"), "event-left")
        waits = written(waits.join(ready.withColumnRenamed("event", "first"), "first", "left_anti"), "event-waits")


def _sums(rows: DataFrame, events: DataFrame, rules: DataFrame) -> DataFrame:
    """Unions: only where every predecessor has a value, and for means a weight, of which the sum is above 0."""
    e = events.filter("kind = 'union'").select("event", "year", F.element_at("succs", 1).alias("succ"), F.array_distinct("preds").alias("preds"))
    e = e.select("event", F.col("year").alias("until"), "succ", F.size("preds").alias("need"), F.explode("preds").alias("id"))
    v = rows.join(e, "id").filter("year < until and value is not null").join(rules, "indicator")
    w = rows.select("id", "year", F.col("indicator").alias("weight"), F.col("value").alias("by"))
    g = v.join(w, ["id", "year", "weight"], "left").groupBy("event", "succ", "year", "indicator").agg(
        F.count("value").alias("n"), F.max("need").alias("need"), F.first("agg").alias("agg"), F.sum("value").alias("total"),
        F.count("by").alias("weights"), F.sum("by").alias("whole"), F.sum(F.col("value") * F.col("by")).alias("weighted"),
    ).filter("n = need")
    mean = F.when((F.col("weights") == F.col("need")) & (F.col("whole") > 0), F.try_divide("weighted", "whole"))
    g = g.withColumn("value", F.when(F.col("agg") == "sum", F.col("total")).when(F.col("agg") == "mean", mean)).filter("value is not null")
    return g.select(F.col("succ").alias("id"), "year", "indicator", "value", F.concat(F.lit("summed_predecessors:"), "event").alias("flag"))


def _moved(rows: DataFrame, events: DataFrame, codes: DataFrame) -> DataFrame:
    """Transfers: the successor's only predecessor with a code in common passes on its rows, null values included."""
    e = events.filter("kind = 'transfer'").select("event", F.col("year").alias("until"), F.explode("succs").alias("succ"), "preds").withColumn("id", F.explode(F.array_distinct("preds")))
    c = codes.select("id", "code").distinct()
    shared = e.join(c, "id").join(c.select(F.col("id").alias("succ"), "code"), ["succ", "code"]).select("event", "until", "succ", "id").distinct()
    alone = shared.groupBy("event", "until", "succ").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    moved = rows.join(alone, "id").filter("year < until")
    return moved.select(F.col("succ").alias("id"), "year", "indicator", "value", F.concat(F.lit("moved_predecessor:"), "event").alias("flag"))


def extend_back(long: DataFrame, events: DataFrame, rules: DataFrame, codes: DataFrame) -> DataFrame:
    """The rows ``id, year, indicator, value, flag`` that events add to a long panel ``id, year, indicator, value`` (unique keys).

    ``rules``: ``indicator, agg`` (``sum`` or ``mean``; others give nothing) and ``weight``, the indicator that means are weighted by;
    ``codes``: ``id, code``. A key that the panel or an earlier event has is never replaced. Events without predecessors or successors,
    and those of other kinds, add nothing.
    """
    events = written(events.select("event", "kind", "year", "preds", "succs"), "events")
    ids = events.select(F.explode(F.concat("preds", "succs")).alias("id")).distinct()
    rows = written(long.join(ids, "id", "left_semi").select("id", "year", "indicator", "value"), "event-rows")
    added = []
    for level in event_levels(events):
        now = events.join(level, "event", "left_semi")
        new = _sums(rows, now, rules).unionByName(_moved(rows, now, codes))
        new = written(new.join(rows, ["id", "year", "indicator"], "left_anti"), "event-added")
        added.append(new)
        rows = rows.unionByName(new.drop("flag"))
    empty = long.select("id", "year", "indicator", "value", F.lit("").alias("flag")).limit(0)
    return reduce(DataFrame.unionByName, added, empty)
