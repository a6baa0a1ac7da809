"""Mixing sources to target weights by weighted fair queueing.

Each source's documents, in a shuffled order and as often as they may be repeated, are a queue. A document's virtual finish time is
the words of its queue up to its end over the source's weight; the mix is all documents by finish time. All queues are served at once,
each at its weight, until the budget is used up or the queue is: the time at which that happens is the water level, and the words that
a source has been given by then are its target. A document that is in service at that time is taken in part, so every source comes
within a word of its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .running import running


def words(text: Column) -> Column:
    r"""The number of ``[^\x20\x09-\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(ident: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("-"))).cast("binary"))


def targets(sources: DataFrame, weights: Sequence[int], budget: tuple[int, int], repeats: int) -> DataFrame:
    """``source, source_size, weight, target, goal`` (the target's whole words) of ``source, source_size``, a row a source.

    Weights repeat over the sources by code point, null last. The budget is ``budget[0] / budget[1]`` of all sizes. A target is at most
    ``repeats`` times its source's size; what is above goes to the others by weight. Each round finds the sources above the level that
    the round before left, as sums over the table: the driver gets two numbers a round.
    """
    by = [F.col("source").isNull().cast("int"), F.col("source")]
    ranked = running(sources.select("source", "source_size"), [], by).drop("before")
    table = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = materialize(ranked.withColumn("weight", F.get(table, (F.col("ordinal") % len(weights)).cast("int"))).withColumn("most", F.col("source_size") * repeats), "sources")
    up, down = budget
    total, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    full, above = 0, F.lit(False)
    while weight:
        above = wide("weight") * F.lit(up * total - down * full).cast("decimal(19,0)") > wide("most") * F.lit(down * weight).cast("decimal(19,0)")
        now, left = weighed.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if (now, left) == (full, weight):
            break
        full, weight = now, left
    if not weight:  # every queue is used up
        above = F.lit(True)
    parts, rest = max(down * weight, 1), up * total - down * full
    shared = weighed.withColumn("share", F.col("weight") * F.lit(rest).cast("long"))
    target = F.when(above, F.col("most").cast("double")).otherwise(F.col("share").cast("double") / F.lit(float(parts)))
    goal = F.when(above, F.col("most")).otherwise(F.expr(f"share div {parts}L"))
    return shared.select("source", "source_size", "weight", target.alias("target"), goal.alias("goal"))


def mix(docs: DataFrame, weights: Sequence[int], budget: tuple[int, int] = (3, 2), repeats: int = 2, seed: int = 0, ident: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix: a row for each document and each time that its queue holds it (``lap``, from 0), with ``doc_id, source, size``, its
    ``source_size`` and ``target``, the document's ``ordinal`` in its source, its virtual ``finish``, the words ``taken`` and the
    ``position`` of the first of them in the mix, counted in words. Rows with ``taken`` above 0, by position, are the mix without gaps.

    A null source is one of its own; documents with a null or empty text have no words and are never taken. Repeated rows are documents
    of their own. Rows of the same id and size may take each other's place in the queue. Other columns are left out, whatever their names.
    """
    sized = materialize(docs.select(F.col(ident).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")), "sized")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, repeats)
    queue = running(sized.withColumn("key", shuffle_key(F.col("doc_id"), seed)), ["source"], [F.col("key"), F.col("doc_id"), F.col("size")], "size")
    named = goals.withColumnRenamed("source", "of")
    laps = queue.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    start = F.col("lap") * F.col("source_size") + F.col("before")
    served = laps.select(
        "doc_id", "source", "size", "source_size", "target", "ordinal", "lap", "key",
        ((start + F.col("size")).cast("double") / F.col("weight").cast("double")).alias("finish"),
        F.greatest(F.least(F.col("goal") - start, F.col("size")), F.lit(0)).cast("long").alias("taken"),
    ).withColumnRenamed("ordinal", "place")
    order = [F.col("finish"), F.col("source").isNull().cast("int"), F.col("source"), F.col("lap"), F.col("place")]
    mixed = running(served, [], order, "taken")
    return mixed.drop("key", "ordinal").withColumnsRenamed({"before": "position", "place": "ordinal"})


def mix_report(mixed: DataFrame) -> DataFrame:
    """A row for each document of :func:`mix`: ``doc_id, size, source_size, target, taken`` (over all laps) and the ``position`` of its
    first word in the mix, null if none is taken."""
    first = F.min(F.when(F.col("taken") > 0, F.col("position")))
    return mixed.groupBy("source", "ordinal", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"), first.alias("position")).drop("source", "ordinal")
