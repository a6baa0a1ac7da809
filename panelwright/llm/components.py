"""Connected components of an edge list, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; ``root`` is the smallest node it reaches.

    Each round points every node at the smallest of its neighbours, follows the pointers a few
    steps, and replaces the edges by those between different ends; each is written to the shared
    folder. Nothing but counts comes to the driver. Null ends and loops link nothing; an empty
    edge list gives an empty table.
    """
    with scratch(edges.sparkSession) as keep:
        live = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
        rounds = []
        while not live.isEmpty():
            both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
            to = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("r")), "pointers")
            for _ in range(2):
                up = to.select(F.col("a").alias("r"), F.col("r").alias("rr"))
                to = materialize(to.join(up, "r", "left").select("a", F.coalesce("rr", "r").alias("r")), "pointers")
            rounds.append(to)
            pa, pb = to.select("a", F.col("r").alias("x")), to.select(F.col("a").alias("b"), F.col("r").alias("y"))
            live = materialize(
                live.join(pa, "a").join(pb, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
                "edges",
            )
        if not rounds:
            return keep(live.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")
        out = rounds[0].select(F.col("a").alias("node"), F.col("r").alias("root"))
        for to in rounds[1:]:
            up = to.select(F.col("a").alias("root"), F.col("r").alias("rr"))
            out = out.join(up, "root", "left").select("node", F.coalesce("rr", "root").alias("root"))
        return keep(out, "components")
