"""All pairs in tiles: every pair once, in as many tasks as there are tiles; blends of distances as by joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelwright import registry
from panelwright.functions import text as T
from panelwright.operators import network as N
from panelwright.operators import tiles

DATA = "/root/testdata/sf0.001"


def test_every_pair_once_and_in_many_tasks(spark):
    rows = spark.range(1, 61).selectExpr("id", "id % 2 AS year", "cast(id AS double) AS x")
    p = tiles.pairs(rows, ["x"], ["year"], block=8)
    got = [(r.year, r.src, r.dst, r.a_x, r.b_x) for r in p.collect()]
    assert sorted(got) == [(y, a, b, float(a), float(b)) for y in (0, 1) for a in range(1, 61) for b in range(a + 1, 61) if a % 2 == b % 2 == y]
    assert p.rdd.getNumPartitions() == 2 * 4 * 4  # four blocks of 30 rows; before, one side was broadcast and the other's task did all


def test_pairs_are_not_written(spark, monkeypatch):
    """Only what grows with the rows is written; before, the pairs were."""
    q, names = registry.queries(), []
    for module in (N, tiles):
        whole = module.written
        monkeypatch.setattr(module, "written", lambda df, name, whole=whole: (names.append(name), whole(df, name))[1])
    for name in ("geo_distance_line", "geo_distance_adjacency", "geo_distance_exclude", "combined_missing", "combined_distance", "edge_gaussian", "threshold_graph"):
        q[name](spark, DATA)
    assert set(names) == {"ends"}


def test_median_of_equal_and_few_values(spark):
    rows = [(0, v) for v in (1.0, 2.0, 2.0, 2.0, 9.0, 0.0, -1.0)] + [(1, v) for v in (1.0, 4.0)] + [(2, 0.0)]
    got = {r.year: r.median for r in N.median(spark.createDataFrame(rows, "year long, v double"), "v").collect()}
    assert got == {0: 2.0, 1: 2.5}


def test_blocks_of_the_median_are_not_broadcast(spark):
    """Before, the blocks, each as often as there are tiles, went through the driver."""
    from panelwright.operators import neighbours as B

    nodes = spark.range(2000).selectExpr("0L AS year", "id", "cast(id * id % 1009 AS double) AS a")
    df = B.median_distance(nodes, ["a"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in line and "row#" in line and "column#" in line for line in plan.splitlines())
    v = sorted(i * i % 1009 for i in range(2000))
    gaps = sorted(y - x for i, x in enumerate(v) for y in v[i + 1 :] if y > x)
    assert df.first()["median"] == (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2


def test_silhouette_without_a_row_for_each_pair(spark):
    """Distances are summed in tiles; before, every pair of points was a row of a join."""
    plan = registry.queries()["silhouette"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_silhouette_of_flat_points(spark):
    from panelwright.operators import validity as V

    points = spark.createDataFrame([(0, i, 1.0) for i in range(4)], "year long, id long, x double")
    labels = points.selectExpr("year", "id", "0L AS model", "id % 2 AS label")
    assert [V.silhouettes(points, ["x"], labels, flat=f).first()["silhouette"] for f in (0.0, None)] == [0.0, None]


def test_shared_values_pair_by_pair(spark):
    """Equal rows, a null among them, stand together in groups of a few; every pair is there once, with the ends' other columns in order."""
    rows = [(i, None if i % 7 == 0 else float(i * i % 3), -i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y long")
    value = {"gap": F.abs(F.col("a_x") - F.col("b_x"))}
    for copies, block in ((3, 8), (64, 2048)):
        got = sorted((r.src, r.dst, r.a_y, r.b_y, r.gap) for r in tiles.shared(df, ["x"], value, ["y"], block, copies).collect())
        assert got == [(i, j, y, z, None if v is None or w is None else abs(v - w)) for i, v, y in rows for j, w, z in rows if i < j]


def test_lines_are_worked_out_once_for_equal_places(spark):
    """Before, each pair of places had its line worked out, however many rows stood at the same two places."""
    plan = registry.queries()["geo_distance_exclude"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(b_members") < plan.index("ASIN")
    assert plan.count("ASIN") == plan[plan.index("explode(a_members") :].count("ASIN")


def test_pairs_on_arrays_are_those_of_the_columns(spark):
    """The same numbers to the last bit, with holes, equal ids, a row without an id, and blocks that are not full; no pair is lost or doubled."""
    rng = np.random.default_rng(5)
    rows = [(y, int(i) if i >= 0 else None, *[None if rng.random() < 0.3 else float(v) for v in rng.normal(size=3)]) for y in (0, 3) for i in [-1, 7, 7, *rng.permutation(60)]]
    nodes, names, weights = spark.createDataFrame(rows, "year long, id long, f0 double, f1 double, f2 double").cache(), ["f0", "f1", "f2"], {"f0": 2.0, "f1": 1.0, "f2": 0.3}
    for metric, digits in (("l1", None), ("l1", 3), ("l2", 6)):
        want = tiles.pairs(nodes, names, ["year"]).select("year", "src", "dst", N.distance(names, metric, weights).alias("distance"))
        want = want if digits is None else want.withColumn("distance", T.rounded(F.col("distance"), digits))
        for order in ((), names):
            got = tiles.worked(tiles.laid(nodes, names, side=9, order=order), names, N.between(names, metric, weights), "distance", digits)
            assert got.count() == want.count() > 3000 and got.exceptAll(want).count() == 0
    top = tiles.largest(tiles.laid(nodes, names, side=9), names, {"d": (N.between(names, "l1", weights), 6)})
    assert top["d"] == {r.year: r.d for r in want.sparkSession.createDataFrame(N.pairs(nodes, names, "l1", weights, 6).groupBy("year").agg(F.max("distance").alias("d")).collect()).collect()}
    assert N.pairs(nodes.limit(0), names).count() == 0


def test_equal_values_are_side_by_side_in_a_task_of_few_ids(spark):
    """Before, distances came in the order of ids and took eight bytes each in a file."""
    nodes = spark.range(1500).selectExpr("0L AS year", "id", *[f"round(rand({k}), 2) AS x{k}" for k in range(3)])
    p = N.pairs(nodes, ["x0", "x1", "x2"], digits=6).withColumn("task", F.spark_partition_id()).toPandas()
    assert len(p) == 1500 * 1499 // 2 and p.task.nunique() == 6 * 7 // 2
    for _, t in p.groupby("task"):
        assert (t.distance.diff() != 0).sum() == t.distance.nunique() and t.src.nunique() <= 256 >= t.dst.nunique()
    plan = registry.queries()["pairwise_l1"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan


def test_equal_nodes_stand_in_one_block(spark):
    """Copies of a node make pairs of equal distance, which are in few tasks; before, each of these pairs was anywhere."""
    nodes = spark.range(1536).selectExpr("0L AS year", "id", "cast(id % 6 AS double) AS x0")
    p = N.pairs(nodes, ["x0"], digits=6, copies=True).withColumn("task", F.spark_partition_id()).toPandas()
    assert len(p) == 1536 * 1535 // 2 and (p.src < p.dst).all() and (p.distance == (p.src % 6 - p.dst % 6).abs()).all()
    assert p[p.distance == 5].task.nunique() == 1 and p[["src", "dst"]].drop_duplicates().shape[0] == len(p)


def test_threshold_hands_on_near_pairs_alone(spark):
    """Before, the weight of every pair was worked out, its distance several times over."""
    nodes = spark.range(300).selectExpr("0L AS year", "id", "round(rand(3), 4) AS x0")
    every, near = N.pairs(nodes, ["x0"], digits=6), N.pairs(nodes, ["x0"], digits=6, most={0: 0.125})
    assert near.count() == every.filter("distance <= 0.125").count() < every.count() == 300 * 299 / 2
    plan = registry.queries()["threshold_graph"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan


def test_a_year_of_equal_points_has_weights_without_a_value(spark):
    nodes = spark.createDataFrame([(0, i, 1.0) for i in range(3)], "year long, id long, x double")
    got = N.weigh_edges(N.pairs(nodes, ["x"], digits=6), nodes, ["x"], "l1", "gaussian", 6)
    assert [r.weight for r in got.collect()] == [None] * 3


def test_weights_on_arrays(spark):
    """As by columns; in a year of equal points null. Before, the weight of a pair was a join and a column expression on every row."""
    nodes = spark.createDataFrame([(y, i, (i * i % 11) * 0.137 * y) for y in (0, 1) for i in range(30)], "year long, id long, x double")
    p = N.pairs(nodes, ["x"], digits=6)
    want = T.rounded(F.col("weight"), 6).alias("weight")
    widths = {1: N.median(p, "distance").first()["median"]}
    for got, by in ((N.weighed_pairs(nodes, ["x"], widths), N.weigh_edges(p, nodes, ["x"], "l1", "gaussian", 6)), (N.weighed_pairs(nodes, ["x"]), N.weigh(p, "inverse"))):
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, by.select("year", "src", "dst", want).collect()), key=str)
    assert N.weighed_pairs(nodes, ["x"], widths).filter("weight is null").count() == 30 * 29 // 2
    plan = registry.queries()["edge_gaussian"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EXP(" not in plan
