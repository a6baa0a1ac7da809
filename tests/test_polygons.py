"""Polygons against a pass over all pairs, known areas, and binary written in other ways."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import projection as P
from panelwright.operators import polygons as G


def wkb(parts, order="<", heights=False, multi=True):
    def polygon(rs):
        kind = 3 + (1000 if heights else 0)
        out = struct.pack(order + "BII", order == "<", kind, len(rs))
        for r in rs:
            out += struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + ("3d" if heights else "2d"), *p, *([7.0] if heights else [])) for p in r)
        return out

    return struct.pack(order + "BII", order == "<", 6, len(parts)) + b"".join(map(polygon, parts)) if multi else polygon(parts[0])


def box(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def frame(spark, rows):
    return spark.createDataFrame([(i, bytearray(g) if g is not None else None) for i, g in rows], "id long, geometry binary")


def star(r, x, y, size, corners):
    """A simple polygon around a point, its corners at rising angles."""
    angles = np.sort(r.uniform(0, 2 * math.pi, corners))
    radius = r.uniform(0.3, 1, corners) * size
    ring = [(x + a * math.cos(t), y + a * math.sin(t)) for a, t in zip(radius, angles)]
    return ring + ring[:1]


def apart(a, b):
    """The distance of two segments."""
    (p, q), (s, t) = np.array(a), np.array(b)
    side = lambda u, v, w: (v[0] - u[0]) * (w[1] - u[1]) - (v[1] - u[1]) * (w[0] - u[0])
    if side(s, t, p) * side(s, t, q) < 0 and side(p, q, s) * side(p, q, t) < 0:
        return 0.0

    def off(x, u, v):
        d = v - u
        k = 0.0 if not d.any() else min(1.0, max(0.0, float((x - u) @ d / (d @ d))))
        return float(np.hypot(*(x - u - k * d)))

    return min(off(p, s, t), off(q, s, t), off(s, p, q), off(t, p, q))


def covers(parts, p):
    odd = False
    for rs in parts:
        for r in rs:
            for (x1, y1), (x2, y2) in zip(r, r[1:]):
                odd ^= (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1)
    return odd


def all_pairs(shapes, tolerance):
    out = set()
    for a, pa in shapes.items():
        for b, pb in shapes.items():
            if a < b:
                sides = [[(r[k], r[k + 1]) for rs in p for r in rs for k in range(len(r) - 1)] for p in (pa, pb)]
                if any(covers(pb, rs[0][0]) for rs in pa) or any(covers(pa, rs[0][0]) for rs in pb) or any(apart(x, y) <= tolerance for x in sides[0] for y in sides[1]):
                    out.add((a, b))
    return out


def got(df):
    return {(r.src, r.dst) for r in df.collect()}


@pytest.mark.parametrize("cell, most", [(None, 4096), (3.0, 4096), (400.0, 5)])
def test_adjacency_of_all_pairs(spark, cell, most):
    r = np.random.default_rng(7)
    shapes = {}
    for i in range(70):
        x, y = r.uniform(-45, 45, 2)
        shapes[i] = [[star(r, x, y, r.choice([2.0, 6.0, 15.0]), 7)]]
    shapes[70] = [[box(-200, -200, 100), box(-190, -190, 80)]]  # a frame
    shapes[71] = [[box(-160, -160, 5)]]  # in its hole, far from its sides
    shapes[72] = [[box(-198, -198, 2)]]  # in the frame itself
    shapes[73] = [[box(-150.0, -150.0, 1)], [box(300, 300, 4)]]  # two parts
    shapes[74] = [[box(302, 302, 0.5)]]  # in the second part
    shapes[75] = [[box(-300, -300, 700), box(-250, -250, 600)]]  # a wide frame around them all
    want = all_pairs(shapes, 0.8)
    assert (70, 72) in want and (70, 71) not in want and (73, 74) in want and len(want) > 40
    df = frame(spark, [(i, wkb(p)) for i, p in shapes.items()])
    assert got(G.adjacency(df, 0.8, centre=None, cell=cell, most=most)) == want


def test_binary_of_other_writers(spark):
    plain, hole = box(0, 0, 4), box(1, 1, 2)
    rows = [
        (1, wkb([[plain, hole]], ">", multi=False)),
        (2, wkb([[plain, hole]], heights=True)),
        (3, struct.pack("<BIII", 1, 0x20000003, 4326, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<2d", *p) for p in plain[:4])),  # with a system of coordinates, not closed
        (4, None),
        (5, struct.pack("<BII", 1, 3, 0)),
        (6, struct.pack("<BI2d", 1, 1, 1.0, 2.0)),
        (7, struct.pack("<BII", 1, 7, 2) + struct.pack("<BI2d", 1, 1, 1.0, 2.0) + wkb([[plain]], multi=False)),
        (8, b""),
    ]
    found = {}
    for r in G.rings(frame(spark, rows)).collect():
        found[r.id, r.part, r.ring] = list(zip(r.xs, r.ys))
    assert found == {(1, 0, 0): plain, (1, 0, 1): hole, (2, 0, 0): plain, (2, 0, 1): hole, (3, 0, 0): plain, (7, 0, 0): plain}
    back = G.rings(G.binary(G.rings(frame(spark, rows))))
    assert {(r.id, r.part, r.ring): list(zip(r.xs, r.ys)) for r in back.collect()} == found


def test_projection(spark):
    places = [(60.0, 105.0), (41.5, 19.6), (77.7, 104.3), (66.1, 190.3), (-10.0, 30.0), (0.0, 105.0)]
    df = spark.createDataFrame(places, "lat double, lon double")
    x, y = P.forward(F.col("lat"), F.col("lon"))
    lat, lon = P.backward(F.col("x"), F.col("y"))
    for r in df.select("lat", "lon", x.alias("x"), y.alias("y")).select("lat", "lon", lat.alias("b"), lon.alias("l"), "x", "y").collect():
        assert r.b == pytest.approx(r.lat, abs=1e-7) and r.l % 360 == pytest.approx(r.lon, abs=1e-7)
        assert (math.hypot(r.x, r.y) < 1e-6) == (r.lat == 60.0)
    none = spark.createDataFrame([(None, 3.0), (3.0, None)], "a double, b double")
    for f in (P.forward, P.backward):
        for r in none.select(*f(F.col("a"), F.col("b"))).collect():
            assert None in tuple(r)
    assert none.filter("a is null").select(*P.backward(F.col("a"), F.col("b"))).first() == (None, None)


def area(south, north, degrees):
    """The ellipsoid's area between two parallels, by small steps."""
    e2, lat = P._E2, np.radians(np.linspace(south, north, 20001))
    strip = P.AXIS**2 * (1 - e2) * np.cos(lat) / (1 - e2 * np.sin(lat) ** 2) ** 2
    return math.radians(degrees) * float(((strip[1:] + strip[:-1]) / 2 * np.diff(lat)).sum())


def test_areas_and_the_meridian(spark):
    whole = box(179.9, 66.0, 0.2, 0.1)
    cut = [[box(179.9, 66.0, 0.1, 0.1)], [box(-180.0, 66.0, 0.1, 0.1)]]
    rows = [
        (1, wkb([[[(x if x <= 180 else x - 360, y) for x, y in whole]]])),
        (2, wkb(cut)),
        (3, wkb([[box(-179.9, 66.0, 0.1, 0.1)]])),  # east of them
        (4, wkb([[box(-179.7, 66.0, 0.1, 0.1)]])),  # a gap of four kilometres
        (5, wkb([[list(reversed(box(30.0, 50.0, 0.1))), box(30.02, 50.02, 0.02)]])),
        (6, wkb([[[(30.0, 50.0), (30.0, 50.0), (30.0, 50.0)]]])),
    ]
    df = frame(spark, rows)
    c = {r.id: r for r in G.centroids(df).collect()}
    assert c[1].area == pytest.approx(area(66.0, 66.1, 0.2), rel=1e-4)
    assert c[2].area == pytest.approx(c[1].area, rel=1e-4) and c[2].lon360 == pytest.approx(180.0, abs=1e-4) and abs(c[2].lon) == pytest.approx(180, abs=1e-4)
    assert c[3].lon == pytest.approx(-179.85, abs=1e-4) and c[3].lon360 == pytest.approx(180.15, abs=1e-4) and c[3].lat == pytest.approx(66.05, abs=1e-3)
    assert c[5].area == pytest.approx(area(50.0, 50.1, 0.1) - area(50.02, 50.04, 0.02), rel=1e-4)
    assert c[6].area == 0 and c[6].lat is None
    assert got(G.adjacency(df)) == {(1, 2), (1, 3), (2, 3), (5, 6)}
    assert (3, 4) in got(G.adjacency(df, 6000.0))


def test_odd_rows(spark):
    rows = [(1, wkb([[box(0, 0, 4)]])), (1, wkb([[box(0, 0, 4)]])), (2, wkb([[box(1, 1, 1)]])), (3, wkb([[box(0, 0, 4)]])), (None, wkb([[box(0, 0, 4)]])), (4, None)]
    df = frame(spark, rows).withColumns({"part": F.lit("x"), "n": F.lit(None), "x1": F.lit(1), "level": F.lit(2)})
    assert got(G.adjacency(df, 0.1, centre=None)) == {(1, 2), (1, 3), (2, 3)}
    assert got(G.adjacency(df, 0.0, centre=None)) == {(1, 2), (1, 3), (2, 3)}
    assert got(G.adjacency(df.limit(0), centre=None)) == set()
    assert G.centroids(df.limit(0)).count() == 0


def test_copies_are_unfolded(spark):
    """Equal geometries are worked on once; their ids are paired with each other and with all next to them. Before, each copy's edges met all others'."""
    shapes = {i: [[box(3 * (i % 4), 0, 2.9 if i % 4 else 2)]] for i in range(40)} | {90: [[box(100, 100, 1)]], 91: [[box(100.2, 100.2, 0.1)]]}
    df = frame(spark, [(i, wkb(p)) for i, p in shapes.items()] + [(95, struct.pack("<BII", 1, 3, 0)), (96, struct.pack("<BII", 1, 3, 0))])
    found = sorted((r.src, r.dst) for r in G.adjacency(df, 0.2, centre=None).collect())
    assert found == sorted(all_pairs(shapes, 0.2))


def test_segments_are_tested_on_arrays(spark):
    """Before, a column expression too long to be compiled tested each two pieces."""
    df = frame(spark, [(i, wkb([[box(i, 0, 1)]])) for i in range(4)])
    assert "MapInPandas" in G._close(G._pieces(G.edges(G.rings(df), None), 1.0), 0.1, 1.0, 4096)._jdf.queryExecution().executedPlan().toString()
