"""Polygons as well-known binary: rings, area and centroid, and which polygons touch or lie close to each other.

Rings are rows; all geometry after reading is done on rows of edges by column expressions. Neighbours are found by a join on cells of a
grid, never by all pairs of polygons.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import projection as P
from panelwright.sources.work import written

RINGS = "part int, ring int, xs array<double>, ys array<double>"
#: More pieces than this in a cell are dealt to several tasks.
CELL_PIECES = 4096
#: About how many ids of one geometry stand together.
COPIES = 64


def _parts(data: bytes, at: int = 0) -> tuple[list[list[np.ndarray]], int]:
    """The polygons of a geometry as lists of rings of points, and where it ends. Kinds without area have none."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 9 if code & 0x20000000 else 5
    kind = (code & 0xFFFF) % 1000
    width = 2 + max(((code & 0xFFFF) // 1000 + 1) // 2, bool(code & 0x80000000) + bool(code & 0x40000000))
    if kind == 1:
        return [], at + 8 * width
    (count,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if kind in (4, 5, 6, 7):
        out = []
        for _ in range(count):
            more, at = _parts(data, at)
            out += more
        return out, at
    if kind not in (2, 3):
        raise ValueError(f"geometry of kind {kind}")
    rings = []
    for _ in range(count if kind == 3 else 1):
        if kind == 3:
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4
        else:
            n = count
        rings.append(np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)[:, :2].astype(float))
        at += 8 * n * width
    return ([[r for r in rings if len(r)]] if kind == 3 and rings and len(rings[0]) else []), at


def rings(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """``id, part, ring, xs, ys``: the rings of the polygons in ``geometry``, ring 0 of a part being its outline; closed where they weren't.

    Either byte order, polygons, their collections, with heights or measures (left out). Null and empty geometries, points and lines have no
    row; binary that breaks off is an error. Repeated rows count once; of different geometries of one id, what an even number of them covers is outside. Columns other than ``id`` and ``geometry`` are not read.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, data in zip(b.id, b.geometry):
                if data is None or not len(data):
                    continue
                for p, part in enumerate(_parts(bytes(data))[0]):
                    for r, xy in enumerate(part):
                        xy = xy if (xy[0] == xy[-1]).all() else np.vstack([xy, xy[:1]])
                        out.append((i, p, r, xy[:, 0], xy[:, 1]))
            yield pd.DataFrame(out, columns=["id", "part", "ring", "xs", "ys"])

    rows = df.select("id", F.col(geometry).alias("geometry")).filter("id is not null and geometry is not null").distinct()
    return rows.mapInPandas(read, f"id {rows.schema['id'].dataType.simpleString()}, {RINGS}")


def binary(r: DataFrame) -> DataFrame:
    """``id, geometry``: rings (``id, part, ring, xs, ys``) as one collection of polygons each, least byte first."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for parts in b.parts:
                found: dict[int, list[bytes]] = {}
                for row in sorted(parts, key=lambda t: (t["part"], t["ring"])):
                    xy = np.column_stack([np.asarray(row["xs"], "<f8"), np.asarray(row["ys"], "<f8")])
                    found.setdefault(row["part"], []).append(struct.pack("<I", len(xy)) + xy.tobytes())
                out.append(struct.pack("<BII", 1, 6, len(found)) + b"".join(struct.pack("<BII", 1, 3, len(x)) + b"".join(x) for x in found.values()))
            yield pd.DataFrame({"id": b.id, "geometry": out})

    parts = r.groupBy("id").agg(F.collect_list(F.struct("part", "ring", "xs", "ys")).alias("parts"))  # the rings of one geometry, which is a value anyway
    return parts.mapInPandas(write, f"id {r.schema['id'].dataType.simpleString()}, geometry binary")


def shifted(r: DataFrame) -> DataFrame:
    """Rings with longitudes from 0 to 360: what lies west of 0 is moved, so polygons across the 180th meridian hang together.

    Parts that were cut there share a seam afterwards; area, centroid and neighbours are the same with it.
    """
    return r.withColumn("xs", F.transform("xs", lambda x: F.when(x < 0, x + 360).otherwise(x)))


def edges(r: DataFrame, centre: tuple[float, float] | None = P.CENTRE) -> DataFrame:
    """``id, part, ring, x1, y1, x2, y2``: the edges of rings, in metres of the equal-area projection around ``centre`` (as they are without one)."""
    n = F.greatest(F.size("xs") - 1, F.lit(0))
    ends = [f(c) for f in (lambda c: F.slice(c, F.lit(1), n), lambda c: F.slice(c, F.lit(2), n)) for c in ("xs", "ys")]
    e = r.select("id", "part", "ring", F.inline(F.arrays_zip(*[c.alias(a) for c, a in zip(ends, ("x1", "y1", "x2", "y2"))]))).toDF("id", "part", "ring", "x1", "y1", "x2", "y2")
    if centre is None:
        return e
    a, b = P.forward(F.col("y1"), F.col("x1"), centre), P.forward(F.col("y2"), F.col("x2"), centre)
    return e.select("id", "part", "ring", a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))


def centroids(df: DataFrame, geometry: str = "geometry", centre: tuple[float, float] = P.CENTRE) -> DataFrame:
    """``id, area, lat, lon, lon360``: square metres and the centroid, worked out in the equal-area projection.

    Holes are taken off whatever way a ring runs round. Parts must not overlap. Ids without a polygon have no row; without an area the centroid is null.
    """
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    own = edges(shifted(rings(df, geometry)), centre).groupBy("id", "part", "ring").agg(
        F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("mx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("my")
    )
    sign = F.signum("a") * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    whole = own.groupBy("id").agg(*[F.sum(sign * F.col(c)).alias(c) for c in ("a", "mx", "my")])
    flat = F.nullif(F.col("a"), F.lit(0.0))
    lat, lon = P.backward(F.col("mx") / flat / 3, F.col("my") / flat / 3, centre)
    return whole.select("id", (F.col("a") / 2).alias("area"), lat.alias("lat"), lon.alias("lon"), F.when(lon < 0, lon + 360).otherwise(lon).alias("lon360"))


def _off(px, py, s):
    """The squared distances of points from segments, on arrays."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    long = dx * dx + dy * dy
    t = np.clip(((px - s[0]) * dx + (py - s[1]) * dy) / np.where(long == 0, 1.0, long), 0.0, 1.0)
    u, v = px - s[0] - t * dx, py - s[1] - t * dy
    return u * u + v * v


def _near(a, b, tolerance: float) -> np.ndarray:
    """Whether two segments each cross or come as close as the tolerance, on arrays."""

    def side(p, q, s):
        return (s[2] - s[0]) * (q - s[1]) - (s[3] - s[1]) * (p - s[0])

    crosses = (side(a[0], a[1], b) * side(a[2], a[3], b) < 0) & (side(b[0], b[1], a) * side(b[2], b[3], a) < 0)
    off = np.minimum.reduce([_off(a[0], a[1], b), _off(a[2], a[3], b), _off(b[0], b[1], a), _off(b[2], b[3], a)])
    return crosses | (off <= tolerance * tolerance)


_ENDS = ("x1", "y1", "x2", "y2")


def _boxes_meet(tolerance: float) -> Column:
    """Whether the boxes of two segments are within the tolerance, with room for rounding."""
    room = sum((F.abs(f"{e}_{c}") for e in "ab" for c in ("x1", "y1")), F.lit(tolerance)) * 1e-9 + tolerance
    gap = lambda k, a, b: F.least(f"{a}_{k}1", f"{a}_{k}2") - F.greatest(f"{b}_{k}1", f"{b}_{k}2")
    return (gap("x", "a", "b") <= room) & (gap("x", "b", "a") <= room) & (gap("y", "a", "b") <= room) & (gap("y", "b", "a") <= room)


def _pieces(e: DataFrame, cell: float) -> DataFrame:
    """Edges cut into pieces no longer than a cell in either direction; the pieces of an edge share their ends exactly."""
    n = F.greatest(F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / cell), F.lit(1)).cast("int")
    cut = e.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def at(axis, i):
        return F.when(i == F.col("n"), F.col(f"{axis}2")).otherwise(F.col(f"{axis}1") + (F.col(f"{axis}2") - F.col(f"{axis}1")) * (i / F.col("n")))

    i = F.col("i")
    return cut.select("id", "part", "ring", at("x", i).alias("x1"), at("y", i).alias("y1"), at("x", i + 1).alias("x2"), at("y", i + 1).alias("y2"))


def _span(low: Column, high: Column, size: float | Column) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _close(pieces: DataFrame, tolerance: float, cell: float, most: int) -> DataFrame:
    """``a, b``: ids whose pieces come close, found in cells of the grid. The pieces of smaller ids reach out by the tolerance."""

    def cells(reach):
        low = {k: F.least(f"{k}1", f"{k}2") - reach for k in "xy"}
        high = {k: F.greatest(f"{k}1", f"{k}2") + reach for k in "xy"}
        p = pieces.select("id", "x1", "y1", "x2", "y2", F.explode(_span(low["x"], high["x"], cell)).alias("cx"), _span(low["y"], high["y"], cell).alias("ys"))
        return p.select("id", "x1", "y1", "x2", "y2", "cx", F.explode("ys").alias("cy"))

    a, b = cells(tolerance), cells(0.0)
    full = a.groupBy("cx", "cy").count().filter(F.col("count") > most).select("cx", "cy", F.ceil(F.col("count") / most).alias("rows"))
    a, b = a.join(full, ["cx", "cy"], "left"), b.join(full, ["cx", "cy"], "left")
    rows = F.coalesce("rows", F.lit(1))
    a = a.select("cx", "cy", F.pmod(F.xxhash64("id", "x1", "y1", "x2", "y2"), rows).alias("row"), F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    b = b.select("cx", "cy", F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("row"), F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    j = a.join(b, ["cx", "cy", "row"]).filter("a < b").filter(_boxes_meet(tolerance))

    # As a column expression this is too long a method for the JVM to compile, so each pair would be interpreted.
    def close(batches):
        for pdf in batches:
            one, other = ([pdf[f"{e}_{c}"].to_numpy() for c in _ENDS] for e in "ab")
            yield pdf.loc[_near(one, other, tolerance), ["a", "b"]].drop_duplicates()

    kind = pieces.schema["id"].dataType.simpleString()
    return j.select("a", "b", *[f"{e}_{c}" for e in "ab" for c in _ENDS]).mapInPandas(close, f"a {kind}, b {kind}").distinct()


def _inside(e: DataFrame, pieces: DataFrame, cell: float) -> DataFrame:
    """``a, b``: ids of which one has a part with its first vertex within a part of the other; holes are not within.

    A box is entered in the one, two or four cells of the grid whose cells are as wide as itself; a vertex is looked up in the grids of all widths.
    Edges are counted in the vertex's strip only.
    """
    widest = max(math.ceil(math.log2(4 * P.RADIUS / cell)), 0)
    first = e.filter("ring = 0").groupBy("id", "part").agg(F.min(F.struct("x1", "y1")).alias("v")).select(F.col("id").alias("inner"), F.col("part").alias("inner_part"), F.col("v.x1").alias("px"), F.col("v.y1").alias("py"))
    box = e.filter("ring = 0").groupBy("id", "part").agg(*[f(c).alias(f"{n}_{c}") for c in ("x1", "y1") for n, f in (("low", F.min), ("high", F.max))])
    extent = F.greatest(F.col("high_x1") - F.col("low_x1"), F.col("high_y1") - F.col("low_y1"))
    box = box.withColumn("level", F.least(F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(cell)) / cell)), F.lit(0)), F.lit(widest)).cast("int"))
    size = cell * F.pow(F.lit(2.0), F.col("level"))
    box = box.withColumn("cx", F.explode(_span(F.col("low_x1"), F.col("high_x1"), size))).withColumn("cy", F.explode(_span(F.col("low_y1"), F.col("high_y1"), size)))
    point = first.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(widest)))).withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})
    within = (F.col("inner") != F.col("id")) & F.col("px").between(F.col("low_x1"), F.col("high_x1")) & F.col("py").between(F.col("low_y1"), F.col("high_y1"))
    maybe = point.join(box, ["level", "cx", "cy"]).filter(within).select("id", "part", "inner", "inner_part", "px", "py", F.floor(F.col("py") / cell).alias("strip"))
    strips = pieces.withColumn("strip", F.explode(_span(F.least("y1", "y2"), F.greatest("y1", "y2"), cell))).select("id", "part", "strip", "x1", "y1", "x2", "y2")
    j = maybe.join(strips, ["id", "part", "strip"])
    left = (F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))
    left &= F.col("px") < F.col("x1") + (F.col("py") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    odd = j.filter(left).groupBy("id", "part", "inner", "inner_part").count().filter(F.col("count") % 2 == 1)
    return odd.select(F.least("id", "inner").alias("a"), F.greatest("id", "inner").alias("b")).distinct()


def adjacency(df: DataFrame, tolerance: float = 200.0, geometry: str = "geometry", centre: tuple[float, float] | None = P.CENTRE, cell: float | None = None, most: int = CELL_PIECES) -> DataFrame:
    """``src, dst`` for ``src < dst``: polygons at most ``tolerance`` apart, in metres of the projection; overlapping and nested ones are 0 apart.

    ``centre=None`` takes coordinates as plane ones, without moving longitudes. ``cell`` is the grid's width (four tolerances or, at least, a
    metre, and the mean extent of an edge); it changes the work, not the result. A cell of more than ``most`` pieces is dealt to several tasks. Ids without a polygon have no
    row, and a ring's direction doesn't matter. Equal geometries are one until the end: only their ids are paired.
    """
    df = written(df.select("id", F.col(geometry).alias("geometry")).filter(F.col("geometry").isNotNull()), "polygons")
    shapes = written(df.groupBy("geometry").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "polygon-shapes")
    alike = shapes.count() < df.count()
    r = rings(shapes.select(F.col("rep").alias("id"), "geometry") if alike else df)
    e = written(edges(r if centre is None else shifted(r), centre), "polygon-edges")
    if cell is None:
        extent = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
        cell = max(4 * tolerance, 1.0, e.agg(F.avg(extent).alias("mean")).first().mean or 0.0)
    pieces = _pieces(e, cell)
    both = _close(pieces, tolerance, cell, most).unionByName(_inside(e, pieces, cell))
    both = both.distinct()
    if not alike:
        return both.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    # A geometry is next to its own copies if it has an edge; a difference of infinite or missing ends is none.
    own = e.filter(sum((F.col(c) - F.col(c) for c in _ENDS), F.lit(0.0)) == 0).select(F.col("id").alias("a"), F.col("id").alias("b")).distinct()
    return _unfolded(both.unionByName(own), df.join(shapes, "geometry").select("id", "rep", "n"))


def _unfolded(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """``src, dst`` of all ids of geometries from pairs ``a, b`` of geometries (``rep``); about ``COPIES`` ids of one are a row, so many of one are no task's own."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / COPIES))
    members = written(ids.groupBy("rep", part.alias("part")).agg(F.collect_set("id").alias("ids")), "polygon-ids")
    side = lambda e: members.select(F.col("rep").alias(e), F.col("ids").alias(f"{e}_ids"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select((F.col("a") == F.col("b")).alias("same"), "b_ids", F.explode("a_ids").alias("a"))
    each = met.select("same", "a", F.explode("b_ids").alias("b")).filter("a < b or (a > b and not same)")
    return each.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
