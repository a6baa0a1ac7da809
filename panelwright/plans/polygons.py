"""Polygons of the customers' territories: a lattice with crooked corners, gaps, holes, nested ones, and the 180th meridian within it."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import projection as P
from panelwright.operators import polygons as G
from panelwright.plans.base import query

COLUMNS, STEP, WEST, SOUTH = 400, (0.4275, 0.09), 19.0, 41.0
TOLERANCE = 200.0

#: Of the customers, ids 6 and 8 over a multiple of 11 lie inside the one before, and that of 5 has a hole.
_PLACE = f"""place AS (
  SELECT id, base % {COLUMNS} AS i, (base // {COLUMNS}) % {COLUMNS} AS j, CAST(CASE WHEN id <> base THEN 0.3 WHEN id % 7 = 0 THEN 0.9 WHEN id % 7 = 3 THEN 0.999 ELSE 1 END AS DOUBLE) AS scale
  FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 IN (6, 8) THEN c_custkey - 1 ELSE c_custkey END AS base FROM customer)
), corner AS (
  SELECT id, scale, n, CAST({WEST} AS DOUBLE) + CAST({STEP[0]} AS DOUBLE) * (i + CAST(0.006 AS DOUBLE) * ((i * 37 + j * 91) % 100)) AS x, CAST({SOUTH} AS DOUBLE) + CAST({STEP[1]} AS DOUBLE) * (j + CAST(0.006 AS DOUBLE) * ((i * 53 + j * 29) % 100)) AS y
  FROM (SELECT id, scale, n, i + CASE WHEN n IN (1, 2) THEN 1 ELSE 0 END AS i, j + CASE WHEN n IN (2, 3) THEN 1 ELSE 0 END AS j FROM place, (SELECT unnest(range(0, 4)) AS n))
), middle AS (
  SELECT id, avg(x) AS mx, avg(y) AS my FROM corner GROUP BY id
), vertex AS (
  SELECT id, ring, n, mx + f * (x - mx) AS x, my + f * (y - my) AS y
  FROM (SELECT c.*, mx, my, ring, scale * CASE WHEN ring = 1 THEN CAST(0.5 AS DOUBLE) ELSE 1 END AS f FROM corner c JOIN middle USING (id), (SELECT unnest(range(0, 2)) AS ring) WHERE ring = 0 OR id % 11 = 5)
)"""

_S1, _C1, _SCALE, _L0 = P._centre(P.CENTRE)
#: The projection in SQL: ``plane`` has a row a vertex in metres, ``edge`` a row an edge.
_PLANE = _PLACE + f""", authalic AS (
  SELECT *, (1 - {P._E2!r}) * (s / (1 - {P._E2!r} * s * s) - ln((1 - {P._E!r} * s) / (1 + {P._E!r} * s)) / {2 * P._E!r}) / {P._QP!r} AS sb, radians(x) - {_L0!r} AS turn FROM (SELECT *, sin(radians(y)) AS s FROM vertex)
), plane AS (
  SELECT id, ring, n, b * {_SCALE!r} * sqrt(1 - sb * sb) * sin(turn) AS x, b / {_SCALE!r} * ({_C1!r} * sb - {_S1!r} * sqrt(1 - sb * sb) * cos(turn)) AS y
  FROM (SELECT *, {P.RADIUS!r} * sqrt(2 / (1 + {_S1!r} * sb + {_C1!r} * sqrt(1 - sb * sb) * cos(turn))) AS b FROM authalic)
), edge AS (
  SELECT a.id, a.ring, a.n, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM plane a JOIN plane b ON a.id = b.id AND a.ring = b.ring AND b.n = (a.n + 1) % 4
)"""


def territories(d):
    """``id, geometry``: the customers' polygons as well-known binary, longitudes from -180 to 180."""
    k, own = F.col("c_custkey"), F.col("id")
    base = F.when((k % 11).isin(6, 8), k - 1).otherwise(k)
    p = d.customer.select(k.alias("id"), base.alias("base"), F.floor(base / COLUMNS).alias("j"))
    scale = F.when(own != F.col("base"), 0.3).when(own % 7 == 0, 0.9).when(own % 7 == 3, 0.999).otherwise(1.0)
    steps = [(0, 0), (1, 0), (1, 1), (0, 1)]
    i, j = [F.col("base") % COLUMNS + a for a, _ in steps], [F.col("j") % COLUMNS + b for _, b in steps]
    x = [WEST + STEP[0] * (a + 0.006 * ((a * 37 + b * 91) % 100)) for a, b in zip(i, j)]
    y = [SOUTH + STEP[1] * (b + 0.006 * ((a * 53 + b * 29) % 100)) for a, b in zip(i, j)]
    p = p.select("id", scale.alias("scale"), F.array(*x).alias("x"), F.array(*y).alias("y"))
    p = p.withColumn("ring", F.explode(F.when(own % 11 == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    f = F.col("scale") * F.when(F.col("ring") == 1, 0.5).otherwise(1.0)

    def drawn(c):
        mean = sum((F.get(c, F.lit(n)) for n in range(1, 4)), F.get(c, F.lit(0))) / 4
        v = [mean + f * (F.get(c, F.lit(n % 4)) - mean) for n in range(5)]
        return F.array(*[F.when(q > 180, q - 360).otherwise(q) for q in v] if c == "x" else v)

    return G.binary(p.select("id", F.lit(0).alias("part"), "ring", drawn("x").alias("xs"), drawn("y").alias("ys")))


@query(f"WITH {_PLANE}" + f""", own AS (
  SELECT id, ring, sum(x1 * y2 - x2 * y1) AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM edge GROUP BY 1, 2
), whole AS (
  SELECT id, sum(f * a) AS a, sum(f * mx) / sum(f * a) / 3 / {_SCALE!r} AS u, sum(f * my) / sum(f * a) / 3 * {_SCALE!r} AS v FROM (SELECT *, sign(a) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS f FROM own) GROUP BY 1
), sphere AS (
  SELECT *, asin(cos(c) * {_S1!r} + v * sin(c) * {_C1!r} / rho) AS beta, degrees({_L0!r} + atan2(u * sin(c), rho * {_C1!r} * cos(c) - v * {_S1!r} * sin(c))) AS lon
  FROM (SELECT *, 2 * asin(rho / {2 * P.RADIUS!r}) AS c FROM (SELECT *, sqrt(u * u + v * v) AS rho FROM whole))
)
SELECT id, round(a / 2000000, 3) AS area_km2, round(degrees(beta + {P._E2 / 3 + 31 * P._E2**2 / 180 + 517 * P._E2**3 / 5040!r} * sin(2 * beta) + {23 * P._E2**2 / 360 + 251 * P._E2**3 / 3780!r} * sin(4 * beta) + {761 * P._E2**3 / 45360!r} * sin(6 * beta)), 6) AS lat,
  round(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END, 6) AS lon, round(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END, 6) AS lon360 FROM sphere""", views=False)
def polygon_centroids(d):
    """Area and centroid of every customer's polygon, in the equal-area projection."""
    return G.centroids(territories(d)).select("id", F.round(F.col("area") / 1e6, 3).alias("area_km2"), *[F.round(c, 6).alias(c) for c in ("lat", "lon", "lon360")])


def _dot(p, s):
    """The squared distance of the point ``p`` from the segment ``s``, in SQL."""
    t = f"greatest(0, least(1, (({p[0]} - {s[0]}) * ({s[2]} - {s[0]}) + ({p[1]} - {s[1]}) * ({s[3]} - {s[1]})) / (pow({s[2]} - {s[0]}, 2) + pow({s[3]} - {s[1]}, 2))))"
    return f"pow({p[0]} - {s[0]} - {t} * ({s[2]} - {s[0]}), 2) + pow({p[1]} - {s[1]} - {t} * ({s[3]} - {s[1]}), 2)"


_A, _B = ["a.x1", "a.y1", "a.x2", "a.y2"], ["b.x1", "b.y1", "b.x2", "b.y2"]


def _side(p, s):
    return f"(({s[2]} - {s[0]}) * ({p[1]} - {s[1]}) - ({s[3]} - {s[1]}) * ({p[0]} - {s[0]}))"


_ADJACENT = f""", box AS (
  SELECT id, min(x1) AS x, max(x1) AS xx, min(y1) AS y, max(y1) AS yy, arg_min(y1, (x1, y1)) AS py FROM edge WHERE ring = 0 GROUP BY 1
), near AS (
  SELECT a.id AS a, b.id AS b FROM box a JOIN box b ON a.id <> b.id AND a.x <= b.xx + {TOLERANCE} AND b.x <= a.xx + {TOLERANCE} AND a.y <= b.yy + {TOLERANCE} AND b.y <= a.yy + {TOLERANCE}
), touching AS (
  SELECT DISTINCT a.id AS src, b.id AS dst FROM near n JOIN edge a ON a.id = n.a JOIN edge b ON b.id = n.b
  WHERE n.a < n.b AND (({_side(_A[:2], _B)} * {_side(_A[2:], _B)} < 0 AND {_side(_B[:2], _A)} * {_side(_B[2:], _A)} < 0)
    OR least({_dot(_A[:2], _B)}, {_dot(_A[2:], _B)}, {_dot(_B[:2], _A)}, {_dot(_B[2:], _A)}) <= {TOLERANCE * TOLERANCE})
), nested AS (
  SELECT n.a, n.b FROM near n JOIN box p ON p.id = n.a JOIN edge e ON e.id = n.b
  WHERE (e.y1 > p.py) <> (e.y2 > p.py) AND p.x < e.x1 + (p.py - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) GROUP BY 1, 2 HAVING count(*) % 2 = 1
)
SELECT src, dst FROM touching UNION SELECT least(a, b), greatest(a, b) FROM nested"""


@query(f"WITH {_PLANE}" + _ADJACENT, views=False)
def polygon_adjacency(d):
    """Which customers' polygons are at most 200 metres apart, overlap or lie in each other."""
    return G.adjacency(territories(d), TOLERANCE)
