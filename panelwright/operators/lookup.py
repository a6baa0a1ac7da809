"""Lookups by a part of a name through an index of character n-grams, and by a prefix.

A text that contains a part contains all grams of the part, so only texts with its rarest gram are tested: the join is on equal grams, and
its rows are those that have one, not all texts by all parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.sources.work import written


def _grams(name: str, size) -> F.Column:
    """The distinct substrings of ``size`` characters."""
    last = F.length(name) - size + 1
    return F.array_distinct(F.transform(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(F.col(name), i, F.lit(size))))


def candidates(texts: DataFrame, parts: DataFrame, keys: list[str], size: int = 3) -> DataFrame:
    """``keys, part, id``: the texts (``keys, id, name``) of the same keys that have the rarest gram of a part (``keys, part``).

    A part shorter than ``size`` is a gram of its own length, an empty one is in every text of its keys; nulls match nothing.
    """
    texts = texts.filter("name is not null").select(*keys, "id", "name")
    parts = parts.filter("part is not null").select(*keys, "part").distinct()
    sizes = [r.n for r in parts.select(F.least(F.length("part"), F.lit(size)).alias("n")).distinct().collect() if r.n]  # at most ``size`` numbers
    out = parts.filter("part = ''").join(texts, keys).select(*keys, "part", "id") if keys else parts.filter("part = ''").crossJoin(texts).select("part", "id")
    for n in sizes:
        index = written(texts.select(*keys, "id", F.explode(_grams("name", n)).alias("gram")), "grams")
        often = index.groupBy(*keys, "gram").agg(F.count("*").alias("often"))
        asked = parts.filter(F.least(F.length("part"), F.lit(size)) == n).select(*keys, "part", F.explode(_grams("part", n)).alias("gram"))
        # A gram that no text has leaves its part without candidates: it is the rarest of all.
        rare = asked.join(often, [*keys, "gram"], "left").groupBy(*keys, "part").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("gram"))
        out = out.unionByName(rare.join(index, [*keys, "gram"]).select(*keys, "part", "id"))
    return out


def containing(texts: DataFrame, parts: DataFrame, keys: list[str], size: int = 3) -> DataFrame:
    """``keys, part, id``: every text of the same keys that contains the part. Ids are unique within their keys."""
    found = candidates(texts, parts, keys, size).join(texts.select(*keys, "id", "name"), [*keys, "id"])
    return found.filter(F.contains("name", F.col("part"))).select(*keys, "part", "id")


def longest_prefix(texts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``id, prefix``: the longest of the prefixes that each text (``id, name``) begins with; texts without any are left out.

    Texts are cut at the lengths that prefixes have, which join by equality."""
    prefixes = prefixes.filter("prefix is not null").select("prefix").distinct()
    lengths = prefixes.select(F.length("prefix").alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("lengths"))  # as many numbers as the longest has characters
    cut = texts.filter("name is not null").crossJoin(F.broadcast(lengths)).select("id", "name", F.explode("lengths").alias("n")).filter(F.length("name") >= F.col("n"))
    found = cut.select("id", F.substr(F.col("name"), F.lit(1), F.col("n")).alias("prefix")).join(prefixes, "prefix")
    return found.groupBy("id").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
