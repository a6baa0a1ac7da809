"""Selection of rows, coordinates and methods by hand, nulls among them."""

from __future__ import annotations

import pytest

from panelwright.operators import panel as P
from panelwright.operators import prices as X


def test_top_level(spark):
    rows = spark.createDataFrame([(1, "top", "city"), (2, "top", "village"), (3, "top", None), (4, "low", "city"), (5, None, "city")], "id long, level string, kind string")
    assert sorted(r.id for r in P.top_level(rows, "level", "top", "kind", ["village"]).collect()) == [1, 3]


def test_reject_invalid(spark):
    rows = [(1, "money", 5.0), (2, "money", 0.0), (3, "money", -1.0), (4, "money", None), (5, "share", 0.0), (6, "share", 100.0), (7, "share", 100.1), (8, "share", None), (9, "other", -4.0), (10, "share", -0.1)]
    kept, gone = P.reject_invalid(spark.createDataFrame(rows, "id long, indicator string, value double"), ["money"], ["share"])
    assert sorted(r.id for r in kept.collect()) == [1, 4, 5, 6, 9]
    assert {r.id: r.reason for r in gone.collect()} == {2: "not positive", 3: "not positive", 7: "not between 0 and 100", 8: "not between 0 and 100", 10: "not between 0 and 100"}


def test_coordinates(spark):
    own = spark.createDataFrame([(1, 50.0, -170.0), (2, None, None), (3, None, 20.0), (4, None, None)], "id long, lat double, lon double")
    centre = spark.createDataFrame([(1, 1.0, 1.0), (2, 55.0, 30.0), (3, 56.0, 31.0)], "id long, lat double, lon double")
    got = {r.id: (r.lat, r.lon, r.coord_source, r.has_centroid, r.lon360) for r in P.coordinates(own, centre).collect()}
    assert got == {1: (50.0, -170.0, "directory", True, 190.0), 2: (55.0, 30.0, "centroid", True, 30.0), 3: (56.0, 20.0, "centroid", True, 20.0), 4: (None, None, "centroid", False, None)}


def test_basket_and_methods(spark):
    rows = spark.createDataFrame([(1, "% of mean", 90.0), (2, "money", 90.0), (3, "% of mean", 0.0), (4, "% of mean", 1000.0), (5, None, 50.0), (None, "% of mean", 50.0), (6, "% of mean", None)], "k long, unit string, v double")
    assert [tuple(r) for r in X.basket(rows, "unit", "of mean", "v", ["k"]).collect()] == [(1, 0.9)]
    one, two = spark.createDataFrame([(1, 2.0)], "id long, v double"), spark.createDataFrame([(1, 3.0, 0.5)], "id long, v double, share double")
    methods = {"a": lambda: one, "b": lambda: two}
    assert [(r.method, r.v, r.share) for r in X.by_method(methods, ["b", "a"]).collect()] == [("b", 3.0, 0.5), ("a", 2.0, None)]
    with pytest.raises(ValueError):
        X.by_method(methods, ["a", "c"])
