"""Similarity networks: distances, weights, neighbours, spanning forests, components."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators import neighbours as B
from panelwright.operators import tiles
from panelwright.sources.work import written


def distance(features: list[str], metric: str = "l1", weights: dict[str, float] | None = None) -> Column:
    """The distance of the ends ``a_*`` and ``b_*``: weighted L1 or Euclid, renormalised over the features that both have; null without any."""
    wts = {f: (weights or {}).get(f, 1.0) for f in features}
    wts = {f: w for f, w in wts.items() if w}
    both = {f: F.col(f"a_{f}").isNotNull() & F.col(f"b_{f}").isNotNull() for f in wts}
    gap = {f: F.col(f"a_{f}") - F.col(f"b_{f}") for f in wts}
    diff = {f: F.abs(gap[f]) if metric == "l1" else gap[f] * gap[f] for f in wts}
    total = reduce(lambda x, y: x + y, [F.when(both[f], F.lit(w)).otherwise(0.0) for f, w in wts.items()])
    score = reduce(lambda x, y: x + y, [F.when(both[f], w * diff[f]).otherwise(0.0) for f, w in wts.items()])
    d = F.when(total > 0, score / F.nullif(total, F.lit(0.0)))
    return d if metric == "l1" else F.sqrt(d)


def between(features: list[str], metric: str = "l1", weights: dict[str, float] | None = None) -> tiles.Value:
    """:func:`distance` on the arrays of a tile, whose columns are the features; the same sums in the same order."""
    wts = [(i, (weights or {}).get(f, 1.0)) for i, f in enumerate(features) if (weights or {}).get(f, 1.0)]

    def value(_: int, a: tiles.End, b: tiles.End):
        score, total = None, 0.0
        for i, w in wts:
            (x, x_there), (y, y_there) = a[i], b[i]
            gap = x - y
            d = np.abs(gap, out=gap) if metric == "l1" else np.multiply(gap, gap, out=gap)
            d = d if w == 1 else np.multiply(d, w, out=d)
            if x_there is not None or y_there is not None:
                both = (True if x_there is None else x_there) & (True if y_there is None else y_there)
                d, w = np.where(both, d, 0.0), np.where(both, w, 0.0)
            score, total = d if score is None else np.add(score, d, out=score), total + w
        score /= total
        return score if metric == "l1" else np.sqrt(score, out=score), total > 0 if isinstance(total, np.ndarray) else None

    return value


def line_km(first: int) -> tiles.Value:
    """:func:`panelwright.functions.text.haversine_km` on the arrays of a tile, from whose column ``first`` on are latitude, longitude and the latitude's cosine, all known."""

    def value(_: int, a: tiles.End, b: tiles.End):
        (lat, lon, cos), (lat2, lon2, cos2) = ([v for v, _ in end[first : first + 3]] for end in (a, b))
        x, y = (np.sin(np.radians(v) / 2) for v in (lat2 - lat, lon2 - lon))
        h = x * x + cos * cos2 * (y * y)
        return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1.0, np.maximum(0.0, h)))), None

    return value


def pairs(nodes: DataFrame, features: list[str], metric: str = "l1", weights: dict[str, float] | None = None, digits: int | None = None, most: dict[int, float] | None = None, copies: bool = False) -> DataFrame:
    """``year, src, dst, distance`` for ``src < dst`` of a year: see :func:`distance`; to ``digits`` places, and up to ``most`` of the year. With ``copies`` many nodes are equal.

    A year's network is quadratic by definition; its pairs are worked out in tiles of two blocks, so a year is not one key.
    """
    return tiles.worked(tiles.laid(nodes, features, order=features if copies else ()), features, between(features, metric, weights), "distance", digits, most)


def weighed_pairs(nodes: DataFrame, features: list[str], widths: dict[int, float] | None = None, metric: str = "l1", digits: int = 6) -> DataFrame:
    """``year, src, dst, weight`` of all pairs, both distance and weight to ``digits`` places: gaussian by the ``widths`` of years (null in a year without one), or else 1 / (1 + distance)."""
    near = between(features, metric)

    def value(year: int, a: tiles.End, b: tiles.End):
        d, there = near(year, a, b)
        d = tiles.rounded(d, digits)
        if widths is None:
            return 1 / (1 + d), there
        s = widths.get(year)
        return (d, np.zeros(d.shape, bool)) if s is None else (np.exp(-(d * d) / (2 * s * s)), there)

    return tiles.worked(tiles.laid(nodes, features), features, value, "weight", digits)


def median(p: DataFrame, value: str, bins: int = 1 << 16) -> DataFrame:
    """``year, median`` of the positive values, exact: a count of each bin finds the bins of the middle values, whose values alone are sorted, equal ones once."""
    # Others are null rather than filtered: a filter would work the value out once more.
    v = p.select("year", F.when(F.col(value) > 0, F.col(value)).alias("v"))
    span = v.groupBy("year").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (bins - 1))).otherwise(0).cast("int")
    binned = v.join(F.broadcast(span), "year").select("year", "v", F.coalesce(at, F.lit(-1)).alias("bin"))  # a row a year
    counts = binned.groupBy("year", "bin").agg(F.count("v").alias("n")).filter("n > 0")
    upto = F.sum("n").over(W.partitionBy("year").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))  # at most ``bins`` rows a year
    ranked = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(W.partitionBy("year")))
    # Of the values in ascending order, counted from 0, those in the middle.
    first, last = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    middle = ranked.filter((F.col("upto") > first) & (F.col("upto") - F.col("n") <= last)).select("year", "bin", (F.col("upto") - F.col("n")).alias("before"), first.alias("first"), last.alias("last"))
    near = binned.join(F.broadcast(middle), ["year", "bin"])  # a row or two a year
    values = near.groupBy("year", "bin", "v").agg(F.count("v").alias("n"), *[F.first(c).alias(c) for c in ("before", "first", "last")])
    values = values.withColumn("upto", F.sum("n").over(W.partitionBy("year", "bin").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + F.col("before"))
    held = lambda c: F.min(F.when(F.col("upto") > F.col(c), F.col("v")))
    return values.groupBy("year").agg(((held("first") + held("last")) / 2).alias("median"))


def weigh(p: DataFrame, kind: str = "gaussian") -> DataFrame:
    """``weight``: gaussian with the year's median positive distance as its width, or 1 / (1 + distance)."""
    if kind == "inverse":
        return p.withColumn("weight", 1 / (1 + F.col("distance")))
    if kind != "gaussian":
        raise ValueError(kind)
    p = written(p, "pairs")  # read by each step of the median
    d, s = F.col("distance"), F.col("median")
    return p.join(F.broadcast(median(p, "distance")), "year").withColumn("weight", F.exp(-(d * d) / (2 * s * s))).drop("median")  # a row a year


def both_ways(p: DataFrame) -> DataFrame:
    swapped = {"src": "dst", "dst": "src"}
    return p.unionByName(p.select(*[F.col(swapped.get(c, c)).alias(c) for c in p.columns]))


def knn(p: DataFrame, k: int, mode: str = "symmetric") -> DataFrame:
    """``year, src, dst`` (``src < dst``) of the k nearest, ties by id, of either end or of both."""
    w = W.partitionBy("year", "src").orderBy("distance", "dst")
    near = both_ways(p.select("year", "src", "dst", "distance")).filter("distance is not null").withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    ends = near.groupBy("year", F.least("src", "dst").alias("s"), F.greatest("src", "dst").alias("d")).agg(F.count("*").alias("n"))
    return ends.filter(F.col("n") >= (1 if mode == "symmetric" else 2)).select("year", F.col("s").alias("src"), F.col("d").alias("dst"))


#: Edges of a year that one task may span.
TASK_EDGES = 1 << 20


def _kruskal(pdf):
    pdf = pdf.sort_values(["distance", "src", "dst"])
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for s, d in zip(pdf.a, pdf.b):
        a, b = find(s), find(d)
        keep.append(a != b)
        if a != b:
            root[a] = b
    return pdf[keep][["year", "src", "dst", "distance"]]


def spanning_forest(p: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Minimum spanning forest of each year, by ``(distance, src, dst)``; edges without a distance don't count.

    Rounds of Boruvka: each component takes its first edge, components that meet become one, and of the edges between
    two components the first stays. Components halve at least in a round. When no year has more than
    ``task_edges`` edges between components, a task a year takes the rest.
    """
    e = written(p.select("year", "src", "dst", "distance").filter("distance is not null and src <> dst").withColumns({"a": F.col("src"), "b": F.col("dst")}), "forest-edges")
    order, taken = F.struct("distance", "src", "dst"), []
    schema = e.select("year", "src", "dst", "distance").schema
    while True:
        most = e.groupBy("year").count().agg(F.max("count").alias("n")).first().n or 0
        if most <= task_edges:
            rest = e.groupBy("year").applyInPandas(_kruskal, schema)
            return reduce(DataFrame.unionByName, taken, rest)
        ends = e.select("year", F.explode(F.array("a", "b")).alias("c"), "a", "b", "distance", "src", "dst")
        picked = ends.groupBy("year", "c").agg(F.min_by(F.struct("a", "b", "src", "dst", "distance"), order).alias("m")).select("year", "m.*").distinct()
        picked = written(picked, "forest-picked")
        taken.append(picked.select("year", "src", "dst", "distance"))
        nodes = picked.select("year", F.explode(F.array("a", "b")).alias("id")).distinct()
        joined = components(picked.select("year", F.col("a").alias("src"), F.col("b").alias("dst")), nodes)
        for end in ("a", "b"):
            e = e.join(joined.select("year", F.col("id").alias(end), F.col("root").alias(f"{end}_root")), ["year", end])
        between = e.filter("a_root <> b_root").groupBy("year", F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        e = written(between.agg(F.min(order).alias("m")).select("year", "m.src", "m.dst", "m.distance", "a", "b"), "forest-edges")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``year, id, root``: the smallest id that each node reaches. Minima pass to neighbours and pointers are followed."""
    labels = written(nodes.select("year", "id", F.col("id").alias("root")), "labels")
    b = written(both_ways(edges.select("year", "src", "dst")), "edges")
    while True:
        near = b.join(labels.select("year", F.col("id").alias("dst"), "root"), ["year", "dst"]).groupBy("year", F.col("src").alias("id")).agg(F.min("root").alias("m"))
        step = written(labels.join(near, ["year", "id"], "left").select("year", "id", F.least("root", F.coalesce("m", "root")).alias("root")), "labels")
        up = step.select("year", F.col("id").alias("root"), F.col("root").alias("r2"))
        new = written(step.join(up, ["year", "root"]).select("year", "id", F.col("r2").alias("root")), "labels")
        moved = new.join(labels.withColumnRenamed("root", "was"), ["year", "id"]).filter("root <> was").limit(1).count()
        labels = new
        if not moved:
            return labels


def degree_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    d = nodes.select("year", "id").join(both_ways(edges.select("year", "src", "dst")).groupBy("year", F.col("src").alias("id")).agg(F.count("*").alias("k")), ["year", "id"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return d.groupBy("year").agg(F.count("*").alias("n"), (F.sum("k") / 2).cast("long").alias("m"), F.min("k").alias("k_min"), F.round(F.avg("k"), 6).alias("k_mean"), F.max("k").alias("k_max"), F.count_if(F.col("k") == 0).alias("isolated"))


def squared(x: list[Column], y: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [(p - q) * (p - q) for p, q in zip(x, y)])


def sample(panel: DataFrame, years: tuple[int, int], regions: list[int] | None = None, districts: list[str] | None = None, exclude_changed: bool = True) -> DataFrame:
    """The rows of a network's sample: valid ones of the years, of the regions or, without them, of the districts; without changed borders.

    ``panel`` has ``year, region, district`` and the booleans ``valid`` and ``changed``; null ones count as false.
    """
    rows = panel.filter(F.coalesce("valid", F.lit(False)) & F.col("year").between(*years))
    if regions:
        rows = rows.filter(F.col("region").isin(regions))
    elif districts:
        rows = rows.filter(F.col("district").isin(districts))
    return rows.filter(~F.coalesce("changed", F.lit(False))) if exclude_changed else rows


def winsor(df: DataFrame, columns: list[str], lower: float, upper: float, by: list[str]) -> DataFrame:
    """Values beyond the quantiles of their group become those quantiles; missing ones stay so."""
    cuts = df.groupBy(*by).agg(*[F.percentile(c, F.array(F.lit(lower), F.lit(upper))).alias(f"cut_{c}") for c in columns])
    j = df.join(F.broadcast(cuts), by)  # a row a group, of which there are as many as years
    held = [F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.get(f"cut_{c}", F.lit(0))), F.get(f"cut_{c}", F.lit(1)))).alias(c) for c in columns]
    return j.select(*[c for c in df.columns if c not in columns], *held)


def usable(nodes: DataFrame, features: list[str], threshold: float = 0.5, missing: str = "drop") -> DataFrame:
    """A feature that fewer than ``threshold`` of a year's nodes have is null for all of them, and so out of the year's distances
    with its weight. Nodes that lack another feature are left out (``drop``) or compared by what they have (``pairwise``).

    Years in which no feature is left have no nodes under ``drop``.
    """
    share = nodes.groupBy("year").agg(*[F.avg(F.col(f).isNotNull().cast("double")).alias(f"share_{f}") for f in features])
    j = nodes.join(F.broadcast(share), "year")  # a row a year
    there = {f: F.col(f"share_{f}") >= threshold for f in features}
    kept = j.select(*[F.when(there[c], F.col(c)).alias(c) if c in features else F.col(c) for c in nodes.columns], *[there[f].alias(f"there_{f}") for f in features])
    if missing == "drop":
        whole = reduce(lambda a, b: a & b, [~F.col(f"there_{f}") | F.col(f).isNotNull() for f in features])
        some = reduce(lambda a, b: a | b, [F.col(f"there_{f}") for f in features])
        kept = kept.filter(whole & some)
    return kept.select(*nodes.columns)


def gaussian(edges: DataFrame, widths: DataFrame) -> DataFrame:
    """``weight`` by the widths ``year, median``; null in a year without one, all of whose distances are 0 or missing."""
    d, s = F.col("distance"), F.col("median")
    return edges.join(F.broadcast(widths), "year", "left").withColumn("weight", F.exp(-(d * d) / (2 * s * s))).drop("median")  # a row a year


def weigh_edges(edges: DataFrame, nodes: DataFrame, features: dict[str, float] | list[str], metric: str = "l1", kind: str = "gaussian", digits: int | None = None) -> DataFrame:
    """:func:`weigh` for some of the pairs: the width of ``gaussian`` is the median over all of them, which is worked out without a table of them."""
    if kind != "gaussian":
        return weigh(edges, kind)
    return gaussian(edges, B.median_distance(nodes, features, metric, digits))


def build(nodes: DataFrame, features: dict[str, float], k: int = 5, mode: str = "symmetric", metric: str = "l1", kind: str = "gaussian") -> DataFrame:
    """``year, src, dst, distance, weight, near, tree``: the edges to the ``k`` nearest together with those of the spanning forest."""
    nodes = written(nodes.select("year", "id", *features), "nodes")
    found = B.lists(nodes, features, max(k, 8), metric)
    near, tree = B.joined(found.nearest(), k, mode).withColumn("near", F.lit(True)), B.spanning_forest(nodes, features, metric, near=found).withColumn("tree", F.lit(True))
    both = near.join(tree.withColumnRenamed("distance", "d2"), ["year", "src", "dst"], "full_outer")
    no = F.lit(False)
    edges = both.select("year", "src", "dst", F.coalesce("distance", "d2").alias("distance"), F.coalesce("near", no).alias("near"), F.coalesce("tree", no).alias("tree"))
    return weigh_edges(edges, nodes, features, metric, kind).select("year", "src", "dst", "distance", "weight", "near", "tree")


def geographic(nodes: DataFrame, tables: dict[str, tuple[DataFrame, float]], line: DataFrame, rule: str = "line", neighbours: DataFrame | None = None) -> DataFrame:
    """``src, dst, distance``: the weighted mean of several distances, each over its largest, for every pair ``src < dst`` of ``line``.

    ``tables``: for each kind ``src, dst, km`` in either direction, and its weight. A pair that a table lacks takes, by ``rule``, its
    ``line`` distance times the median ratio of the table's distances to lines (``line``), 0 if the two are ``neighbours`` (``src, dst``)
    and else the table's largest (``adjacency``), or is missing (``exclude``), and with it the mean. The kind ``adjacency`` is 0 for the
    pairs of its table and 1 for others. ``nodes`` (``id``) are those that count; other ends are left out.
    """
    ids = nodes.select("id").distinct()
    ends = line.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out, total = ends.select("src", "dst", F.col("km").alias("direct distance")), sum(w for _, w in tables.values())
    ordered = lambda t: t.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *[c for c in t.columns if c == "km"])
    if rule == "adjacency":
        if neighbours is None:
            raise ValueError("this rule needs a table of neighbours")
        out = out.join(ordered(neighbours.select("src", "dst")).distinct().withColumn("beside", F.lit(True)), ["src", "dst"], "left")
    for name, (table, _) in tables.items():
        if name == "adjacency":
            out = out.join(ordered(table.select("src", "dst")).distinct().withColumn(name, F.lit(0.0)), ["src", "dst"], "left").withColumn(name, F.coalesce(name, F.lit(1.0)))
        else:
            out = out.join(ordered(table).groupBy("src", "dst").agg(F.min("km").alias(name)), ["src", "dst"], "left")
    return blend(written(out, "geographic"), {name: w for name, (_, w) in tables.items()}, rule).select("src", "dst", "distance")


def blend(rows: DataFrame, weights: dict[str, float], rule: str = "line") -> DataFrame:
    """:func:`geographic` for pairs that carry their distances: ``rows`` with ``distance`` added.

    ``rows``: the line as ``direct distance``, a column of each kind in ``weights``, null where it lacks the pair (``adjacency``: 0 or 1),
    and under the rule ``adjacency`` the boolean ``beside``. Nothing of the pairs' number is joined or written: they are gone through once for
    the largest values, twice for a median where a kind lacks pairs, and once for the result.
    """
    d, total = F.col("direct distance"), sum(weights.values())
    lacks = {k: k != "adjacency" and rule != "exclude" for k in weights}
    stats = [e for k in weights for e in (F.max(k).alias(f"{k} top"), F.max(F.when(F.col(k).isNull(), d)).alias(f"{k} longest"), F.count_if(F.col(k).isNull()).alias(f"{k} missing"), F.count_if(F.col(k).isNull() & (~F.coalesce("beside", F.lit(False)) if "beside" in rows.columns else F.lit(True))).alias(f"{k} apart"))]
    top = rows.agg(*stats).first()
    mean = F.lit(0.0)
    for k, w in weights.items():
        v, most = F.col(k), top[f"{k} top"]
        if lacks[k] and top[f"{k} missing"]:
            if rule == "line":
                ratio = median(rows.select(F.lit(0).alias("year"), F.when(d > 0, v / d).alias("ratio")), "ratio").first()
                if ratio is not None and ratio["median"] is not None:
                    v = F.coalesce(v, d * F.lit(ratio["median"]))
                    most = max(x for x in (most, top[f"{k} longest"] * ratio["median"] if top[f"{k} longest"] is not None else None) if x is not None)
            else:
                v = F.coalesce(v, F.when(F.col("beside"), 0.0).otherwise(F.lit(most).cast("double")))
                most = 0.0 if most is None else most
        mean = mean + (v / F.lit(most) if most is not None and most > 0 else v) * (w / total)
    return rows.withColumn("distance", mean)


def unlinked(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """The ``id`` of nodes that a table of pairs ``src, dst, km`` links with no other node."""
    ids = nodes.select("id").distinct()
    t = table.filter("km is not null and src <> dst").select("src", "dst")
    t = t.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return ids.join(t.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")


def combine(economic: DataFrame, geo: DataFrame | None, alpha: float) -> DataFrame:
    """``year, src, dst, distance``: ``alpha`` times the economic distance over its year's largest, and the rest the geographic one.

    Without a geographic distance a pair has the economic one over the largest; with ``alpha`` of 1 or more, or without ``geo``, all have the
    economic one as it is. A largest of 0 divides nothing.
    """
    if geo is None or alpha >= 1:
        return economic.select("year", "src", "dst", "distance")
    rows = economic.select("year", "src", "dst", "distance").join(geo.select("src", "dst", F.col("distance").alias("geo")), ["src", "dst"], "left")
    return mixed(rows, alpha)


def mixed(rows: DataFrame, alpha: float) -> DataFrame:
    """:func:`combine` for pairs that carry both: ``year, src, dst, distance, geo``."""
    top = rows.groupBy("year").agg(F.max("distance").alias("top"))
    j = rows.join(F.broadcast(top), "year")  # a row a year
    e = F.when(F.col("top") > 0, F.col("distance") / F.nullif("top", F.lit(0.0))).otherwise(F.col("distance"))
    return j.select("year", "src", "dst", F.coalesce(alpha * e + (1 - alpha) * F.col("geo"), e).alias("distance"))
