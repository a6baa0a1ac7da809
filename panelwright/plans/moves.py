"""Clusters over time, summary tables and convergence."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import text as T
from panelwright.operators import communities as M
from panelwright.operators import convergence as G
from panelwright.operators import neighbours as B
from panelwright.operators import network as N
from panelwright.operators import points as P
from panelwright.operators import ranks as K
from panelwright.operators import reports as R
from panelwright.plans.base import query
from panelwright.plans.graphs import X5
from panelwright.sources.work import written

_T = ", y AS (SELECT DISTINCT year FROM types), ny AS (SELECT year, lead(year) OVER (ORDER BY year) AS next FROM y), two AS (SELECT a.id, a.year AS y0, n.next AS y1, a.label AS f, b.label AS t FROM types a JOIN ny n USING (year) JOIN types b ON b.id = a.id AND b.year = n.next)"


def _two(d):
    t = d.types()
    years = t.select("year").distinct()  # a row a year
    nxt = years.select("year", F.lead("year").over(W.partitionBy(F.lit(1)).orderBy("year")).alias("y1"))
    b = t.select("id", F.col("year").alias("y1"), F.col("label").alias("t"))
    return t.join(F.broadcast(nxt), "year").join(b, ["id", "y1"]).select("id", F.col("year").alias("y0"), "y1", F.col("label").alias("f"), "t")


@query(_T + "SELECT y0, y1, f, t, count(*) AS n FROM two GROUP BY 1, 2, 3, 4")
def transitions(d):
    return _two(d).groupBy("y0", "y1", "f", "t").agg(F.count("*").alias("n"))


@query("""SELECT id, year, before, label FROM (SELECT id, year, label, lag(label) OVER w AS before, lag(year) OVER w AS y0 FROM types WINDOW w AS (PARTITION BY id ORDER BY year)) WHERE y0 = year - 1 AND before <> label""")
def migrants(d):
    w = W.partitionBy("id").orderBy("year")
    t = d.types().withColumn("before", F.lag("label").over(w)).withColumn("y0", F.lag("year").over(w))
    return t.filter("y0 = year - 1 AND before <> label").select("id", "year", "before", "label")


@query(_T + """, c AS (SELECT y0, y1, f, t, count(*) AS n FROM two GROUP BY 1, 2, 3, 4), s AS (SELECT year, label, count(*) AS n FROM types GROUP BY 1, 2)
 SELECT c.y0, c.y1, f, t, round(c.n / (a.n + b.n - c.n), 6) AS jaccard FROM c JOIN s a ON a.year = y0 AND a.label = f JOIN s b ON b.year = y1 AND b.label = t""")
def jaccard_matrix(d):
    s = d.types().groupBy("year", "label").agg(F.count("*").alias("m"))
    c = _two(d).groupBy("y0", "y1", "f", "t").agg(F.count("*").alias("n"))
    j = c.join(s.select(F.col("year").alias("y0"), F.col("label").alias("f"), F.col("m").alias("a")), ["y0", "f"]).join(s.select(F.col("year").alias("y1"), F.col("label").alias("t"), F.col("m").alias("b")), ["y1", "t"])
    return j.select("y0", "y1", "f", "t", F.round(F.col("n") / (F.col("a") + F.col("b") - F.col("n")), 6).alias("jaccard"))


@query(_T + """, c AS (SELECT y0, y1, f, t, count(*) AS n FROM two GROUP BY 1, 2, 3, 4), g AS (SELECT y0, y1, sum(n) AS n, sum(n * (n - 1) / 2) AS s, sum(CASE WHEN f = t THEN n ELSE 0 END) AS stay FROM c GROUP BY 1, 2),
 a AS (SELECT y0, y1, sum(n * (n - 1) / 2) AS r FROM (SELECT y0, y1, f, sum(n) AS n FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2), b AS (SELECT y0, y1, sum(n * (n - 1) / 2) AS q FROM (SELECT y0, y1, t, sum(n) AS n FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2)
 SELECT y0, y1, CAST(n AS BIGINT) AS n, round((s - r * q / (n * (n - 1) / 2)) / ((r + q) / 2 - r * q / (n * (n - 1) / 2)), 6) AS ari, round(1 - stay / n, 6) AS changed FROM g JOIN a USING (y0, y1) JOIN b USING (y0, y1)""")
def ari_years(d):
    c = _two(d).groupBy("y0", "y1", "f", "t").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    g = c.groupBy("y0", "y1").agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("s"), F.sum(F.when(F.col("f") == F.col("t"), F.col("n")).otherwise(0)).alias("stay"))
    side = lambda k, name: c.groupBy("y0", "y1", k).agg(F.sum("n").alias("n")).groupBy("y0", "y1").agg(F.sum(pairs(F.col("n"))).alias(name))
    j = g.join(side("f", "r"), ["y0", "y1"]).join(side("t", "q"), ["y0", "y1"])
    e = F.try_divide(F.col("r") * F.col("q"), pairs(F.col("n")))
    return j.select("y0", "y1", "n", F.round(F.try_divide(F.col("s") - e, (F.col("r") + F.col("q")) / 2 - e), 6).alias("ari"), F.round(1 - F.col("stay") / F.col("n"), 6).alias("changed"))


@query(None)
def match_years(d):
    """Types carried on from year to year by the assignment with the largest total Jaccard; below 0.2, a new type.

    Only the matrices of a few types a year come to the driver."""
    rows = jaccard_matrix(d).collect()
    years = sorted({r.y0 for r in rows} | {r.y1 for r in rows})
    labels = {y: sorted({r.f for r in rows if r.y0 == y} | {r.t for r in rows if r.y1 == y}) for y in years}
    value = {(r.y0, r.f, r.t): r.jaccard for r in rows}
    name = {(years[0], l): i for i, l in enumerate(labels[years[0]])}
    new = len(name)
    for y0, y1 in zip(years, years[1:]):
        left, right = labels[y0], labels[y1]
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for l in left:
            nxt = dict(best)
            for used, (total, chosen) in best.items():
                for j, r in enumerate(right):
                    if not used >> j & 1:
                        key, score = used | 1 << j, total + value.get((y0, l, r), 0.0)
                        if key not in nxt or score > nxt[key][0]:
                            nxt[key] = (score, (*chosen, (l, r)))
            best = nxt
        pairs = {r: l for l, r in max(best.values(), key=lambda v: v[0])[1] if value.get((y0, l, r), 0.0) >= 0.2}
        for r in right:
            if r in pairs:
                name[y1, r] = name[y0, pairs[r]]
            else:
                name[y1, r], new = new, new + 1
    table = d.spark.createDataFrame([(y, l, i) for (y, l), i in name.items()], "year long, label long, through long")
    return d.types().join(F.broadcast(table), ["year", "label"]).select("id", "year", "label", "through")  # a row a type and year


@query("""SELECT label, count(*) AS n, round(median(spend), 4) AS median_spend, CAST(row_number() OVER (ORDER BY median(spend) DESC, label) - 1 AS BIGINT) AS ordered FROM types JOIN wide USING (id, year) GROUP BY 1""")
def order_labels(d):
    g = d.types().join(d.wide(), ["id", "year"]).groupBy("label").agg(F.count("*").alias("n"), F.median("spend").alias("m"))
    return g.select("label", "n", F.round("m", 4).alias("median_spend"), (F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("m"), "label")) - 1).cast("long").alias("ordered"))  # a row a label


@query("""SELECT id, year, label, CAST(dense_rank() OVER (PARTITION BY year ORDER BY first) - 1 AS BIGINT) AS relabelled FROM (SELECT *, min(id) OVER (PARTITION BY year, label) AS first FROM types)""")
def relabel_first(d):
    t = d.types()
    f = t.groupBy("year", "label").agg(F.min("id").alias("first"))
    f = f.select("year", "label", (F.dense_rank().over(W.partitionBy("year").orderBy("first")) - 1).cast("long").alias("relabelled"))
    return t.join(F.broadcast(f), ["year", "label"]).select("id", "year", "label", "relabelled")  # a row a type and year


_P = ", p AS (SELECT id, max(CASE WHEN year = 1995 THEN label END) AS p0, max(CASE WHEN year = 1997 THEN label END) AS p1, max(CASE WHEN year = 2000 THEN label END) AS p2 FROM types GROUP BY 1), k AS (SELECT id, p0, p1, p2, list_filter([p0, p1, p2], lambda x: x IS NOT NULL) AS l FROM p), tr AS (SELECT id, p0, p1, p2, CASE WHEN len(l) < 2 THEN 'no data' WHEN len(l) = 2 THEN CASE WHEN l[2] = l[1] THEN 'stable' WHEN l[2] < l[1] THEN 'up' ELSE 'down' END WHEN l[1] = l[2] AND l[2] = l[3] THEN 'stable' WHEN l[2] <= l[1] AND l[3] <= l[2] THEN 'up' WHEN l[2] >= l[1] AND l[3] >= l[2] THEN 'down' ELSE 'mixed' END AS trajectory FROM k)"


def _periods(d):
    p = d.types().groupBy("id").agg(*[F.max(F.when(F.col("year") == y, F.col("label"))).alias(f"p{i}") for i, y in enumerate((1995, 1997, 2000))])
    return p.withColumn("trajectory", T.trajectory(F.array("p0", "p1", "p2")))


@query(_P + "SELECT * FROM tr")
def periods_trajectory(d):
    return _periods(d)


@query(_P + """SELECT coalesce(e.district, 'all') AS district, count(*) FILTER (trajectory = 'up') AS up, count(*) FILTER (trajectory = 'down') AS down, count(*) FILTER (trajectory = 'stable') AS stable, count(*) AS n FROM tr JOIN entities e USING (id) GROUP BY ROLLUP (e.district)""")
def trajectory_rollup(d):
    t = _periods(d).join(d.entities().select("id", "district"), "id")
    count = lambda v: F.count_if(F.col("trajectory") == v).alias(v)
    return t.rollup("district").agg(count("up"), count("down"), count("stable"), F.count("*").alias("n")).withColumn("district", F.coalesce("district", F.lit("all")))


@query(""", c AS (SELECT e.region, t.year, t.label, count(*) AS n FROM types t JOIN entities e USING (id) GROUP BY 1, 2, 3)
 SELECT region, year, label, round(n / sum_n, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY region, year) AS sum_n FROM c) QUALIFY row_number() OVER (PARTITION BY region, year ORDER BY n DESC, label) = 1""")
def dominant_cluster(d):
    c = d.types().join(d.entities().select("id", "region"), "id").groupBy("region", "year", "label").agg(F.count("*").alias("n"))
    g = c.groupBy("region", "year").agg(F.sum("n").alias("all"), F.max_by(F.struct("label", "n"), F.struct("n", -F.col("label"))).alias("b"))
    return g.select("region", "year", "b.label", F.round(F.col("b.n") / F.col("all"), 6).alias("share"))


_Z = ", z AS (SELECT label, " + ", ".join(f"(x{i} - avg(x{i}) OVER ()) / nullif(stddev_pop(x{i}) OVER (), 0) AS z{i}" for i in range(5)) + " FROM features), zm AS (SELECT label, " + ", ".join(f"round(avg(z{i}), 6) AS z{i}" for i in range(5)) + " FROM z GROUP BY 1)"


def _zmeans(d):
    from panelwright.operators.panel import normalise

    z = normalise(d.features().select("label", *X5), X5, "z", [])
    return z.groupBy("label").agg(*[F.round(F.avg(f"x{i}"), 6).alias(f"z{i}") for i in range(5)])


@query(_Z + "SELECT * FROM zm")
def zscore_profile(d):
    return _zmeans(d)


@query(_Z + """, u AS (SELECT label, 'z' || i AS feature, CASE i WHEN 0 THEN z0 WHEN 1 THEN z1 WHEN 2 THEN z2 WHEN 3 THEN z3 ELSE z4 END AS z FROM zm, range(5) r(i))
 SELECT label, feature, CASE WHEN z = max(z) OVER w AND z >= 0.5 THEN 'max' WHEN z = min(z) OVER w AND z <= -0.5 THEN 'min' WHEN z >= 0.5 THEN 'high' WHEN z <= -0.5 THEN 'low' ELSE 'mid' END AS category FROM u WINDOW w AS (PARTITION BY feature)""")
def category_rules(d):
    u = _zmeans(d).unpivot(["label"], [f"z{i}" for i in range(5)], "feature", "z")
    w = W.partitionBy("feature")
    z = F.col("z")
    c = F.when((z == F.max("z").over(w)) & (z >= 0.5), "max").when((z == F.min("z").over(w)) & (z <= -0.5), "min").when(z >= 0.5, "high").when(z <= -0.5, "low").otherwise("mid")
    return u.select("label", "feature", c.alias("category"))


@query("""SELECT year, label, count(*) AS n, round(median(spend), 4) AS median_spend, string_agg(CAST(id AS VARCHAR), ',' ORDER BY spend DESC, id) FILTER (rn <= 4) AS top FROM (SELECT *, row_number() OVER (PARTITION BY year, label ORDER BY spend DESC, id) AS rn FROM types JOIN wide USING (id, year)) GROUP BY 1, 2""")
def type_passport(d):
    t = d.types().join(d.wide(), ["id", "year"]).withColumn("rn", F.row_number().over(W.partitionBy("year", "label").orderBy(F.desc("spend"), "id")))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 4, F.struct("rn", "id")))), lambda x: x["id"].cast("string")), ",")
    return t.groupBy("year", "label").agg(F.count("*").alias("n"), F.round(F.median("spend"), 4).alias("median_spend"), top.alias("top"))


@query("SELECT e.region, w.year, round(100.0 * count(*) FILTER (n_orders > 1) / count(*), 4) AS coverage FROM wide w JOIN entities e USING (id) GROUP BY 1, 2")
def coverage_matrix(d):
    return d.wide().join(d.entities().select("id", "region"), "id").groupBy("region", "year").agg(F.round(100.0 * F.count_if(F.col("n_orders") > 1) / F.count("*"), 4).alias("coverage"))


@query("SELECT id, year, round(rank() OVER (PARTITION BY year ORDER BY n_orders DESC) + (count(*) OVER (PARTITION BY year, n_orders) - 1) / 2, 4) AS rank FROM wide")
def rank_average_ties(d):
    c = d.wide().groupBy("year", "n_orders").agg(F.count("*").alias("m"))
    ahead = F.coalesce(F.sum("m").over(W.partitionBy("year").orderBy(F.desc("n_orders")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    r = c.select("year", "n_orders", (ahead + 1 + (F.col("m") - 1) / 2).alias("rank"))  # ranks of values, not of rows
    return d.wide().join(r, ["year", "n_orders"]).select("id", "year", F.round("rank", 4).alias("rank"))


_RK = ", rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY x{i}) + (count(*) OVER (PARTITION BY x{i}) - 1) / 2 AS r{i}" for i in range(3)) + " FROM features)"


@query(_RK + "SELECT 'x0' AS a, 'x1' AS b, round(corr(r0, r1), 6) AS rho FROM rk UNION ALL SELECT 'x0', 'x2', round(corr(r0, r2), 6) FROM rk UNION ALL SELECT 'x1', 'x2', round(corr(r1, r2), 6) FROM rk")
def spearman_matrix(d):
    return K.spearman_pairs(d.features(3), ["x0", "x1", "x2"]).select("a", "b", F.round("rho", 6).alias("rho"))


#: Made columns: shares and quotients of one section that rise together, a mirrored one, and holes.
_MADE = {"share_A": "x0", "quotient_A": "CASE WHEN id % 5 <> 0 THEN exp(x0) END", "share_B": "CASE WHEN id % 3 <> 0 THEN -x0 * x0 * x0 END", "other": "x1 + x0 / 100", "seldom": "CASE WHEN id % 97 = 0 THEN x0 END"}
_STRONG = ", made AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in _MADE.items()) + " FROM features)" + "".join(
    f", q{i}{j} AS (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS r, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS s FROM made WHERE {a} IS NOT NULL AND {b} IS NOT NULL), p{i}{j} AS (SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr(r, s) AS rho FROM q{i}{j})"
    for i, a in enumerate(_MADE) for j, b in enumerate(_MADE) if i < j)
_FAMILY = "regexp_replace({}, '^(share|quotient)_', '')"


@query(_STRONG + " SELECT a, b, n, round(rho, 6) AS rho FROM (" + " UNION ALL ".join(f"SELECT * FROM p{i}{j}" for i in range(5) for j in range(i + 1, 5)) + f") WHERE n >= 50 AND abs(rho) >= 0.8 AND {_FAMILY.format('a')} <> {_FAMILY.format('b')}")
def strong_pairs(d):
    """Pairs of columns that say the same, but for those of one section in other scales."""
    rows = d.features(2).selectExpr(*[f"{sql} AS {name}" for name, sql in _MADE.items()])
    family = lambda c: F.regexp_replace(c, "^(share|quotient)_", "")
    return K.strong_pairs(rows, list(_MADE), 0.8, 50, family).select("a", "b", "n", F.round("rho", 6).alias("rho"))


@query("SELECT indicator, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value) / avg(value), 6) AS cv, count(*) AS n FROM long GROUP BY 1")
def dispersion_table(d):
    return d.long().groupBy("indicator").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.median("value"), 4).alias("median"), F.round(F.stddev_samp("value") / F.avg("value"), 6).alias("cv"), F.count("*").alias("n"))


@query("SELECT year, count(*) AS n, round(stddev_samp(ln(spend)), 6) AS sd_log, round(stddev_samp(spend) / avg(spend), 6) AS cv FROM wide WHERE spend > 0 GROUP BY 1")
def sigma_convergence(d):
    return d.wide().filter("spend > 0").groupBy("year").agg(F.count("*").alias("n"), F.round(F.stddev_samp(F.ln("spend")), 6).alias("sd_log"), F.round(F.stddev_samp("spend") / F.avg("spend"), 6).alias("cv"))


_B = ", g AS (SELECT ln(a.spend) AS x, (ln(b.spend) - ln(a.spend)) / 5 AS y FROM wide a JOIN wide b ON a.id = b.id AND a.year = 1995 AND b.year = 2000), s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM g)"


@query(_B + "SELECT n, round(b, 6) AS b, round(r2, 6) AS r2, round(sqrt(n / (n - 2) * (SELECT sum(pow(x - mx, 2) * pow(y - a - b * x, 2)) FROM g) / (sxx * sxx)), 6) AS se, round(CASE WHEN 1 + b * 5 > 0 THEN -ln(1 + b * 5) / 5 END, 6) AS speed, round(CASE WHEN 1 + b * 5 > 0 AND b < 0 THEN ln(2) / (-ln(1 + b * 5) / 5) END, 4) AS half_life FROM s")
def beta_absolute(d):
    w = d.wide()
    a, b = w.filter("year = 1995").select("id", F.ln("spend").alias("x")), w.filter("year = 2000").select("id", F.ln("spend").alias("z"))
    g = a.join(b, "id").select("x", ((F.col("z") - F.col("x")) / 5).alias("y"))
    s = g.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"), F.avg("x").alias("mx"), F.regr_sxx("y", "x").alias("sxx"))
    e = g.crossJoin(F.broadcast(s)).groupBy("n", "b", "a", "r2", "sxx").agg(F.sum(F.pow(F.col("x") - F.col("mx"), 2) * F.pow(F.col("y") - F.col("a") - F.col("b") * F.col("x"), 2)).alias("m"))  # one row
    se = F.sqrt(F.col("n") / (F.col("n") - 2) * F.col("m") / (F.col("sxx") * F.col("sxx")))
    left = 1 + F.col("b") * 5
    speed = F.when(left > 0, -F.ln(left) / 5)
    half = F.when(speed > 0, F.ln(F.lit(2.0)) / F.nullif(speed, F.lit(0.0)))  # years until half of a gap is gone
    return e.select("n", F.round("b", 6).alias("b"), F.round("r2", 6).alias("r2"), F.round(se, 6).alias("se"), F.round(speed, 6).alias("speed"), F.round(half, 4).alias("half_life"))


@query("""SELECT round(b, 6) AS slope, round(sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS se, n AS years FROM (SELECT regr_slope(s, year) AS b, regr_sxx(s, year) AS sxx, regr_syy(s, year) AS syy, regr_sxy(s, year) AS sxy, count(s) AS n
 FROM (SELECT year, stddev_samp(ln(spend)) AS s FROM wide WHERE spend > 0 GROUP BY 1))""".replace("FROM (SELECT regr", " FROM (SELECT regr"))
def sigma_trend(d):
    """Slope of the yearly spread of logs over time, with its standard error."""
    s = d.wide().filter("spend > 0").groupBy("year").agg(F.stddev_samp(F.ln("spend")).alias("s"))
    r = s.agg(F.regr_slope("s", "year").alias("b"), F.regr_sxx("s", "year").alias("sxx"), F.regr_syy("s", "year").alias("syy"), F.regr_sxy("s", "year").alias("sxy"), F.count("s").alias("years"))
    return r.select(F.round("b", 6).alias("slope"), F.round(F.sqrt((F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("years") - 2) / F.col("sxx")), 6).alias("se"), "years")


def _years(d):
    r = d.orders.agg(F.year(F.min("o_orderdate")).alias("a"), F.year(F.max("o_orderdate")).alias("b")).first()
    return list(range(r.a, r.b + 1)) if r.a is not None else []


@query(None)
def beta_panel(d):
    """Growth on the log level of the year before, with effects of entities and years, errors by region."""
    w = d.wide().filter("spend > 0").select("id", "year", F.ln("spend").alias("l"))
    before = w.select("id", (F.col("year") + 1).alias("year"), F.col("l").alias("x"))
    p = w.join(before, ["id", "year"]).join(d.entities().select("id", F.col("region").alias("grp")), "id").select("id", "year", "grp", "x", (F.col("l") - F.col("x")).alias("y"))
    return G.beta_within(p, _years(d)[1:]).select("n", "n_units", "n_groups", F.round("b", 6).alias("b"), F.round("se", 6).alias("se"), F.round("speed", 6).alias("speed"))


@query(None)
def log_t(d):
    """Relative convergence of log spend over all years of the table."""
    r = G.log_t(d.wide(), "spend", _years(d))
    return d.spark.createDataFrame([(round(r["b"], 6), round(r["t"], 6), r["points"], r["n"])], "b double, t double, points long, n long")


@query(None)
def convergence_clubs(d):
    """Clubs of regions by their mean spend."""
    years = _years(d)
    m = d.wide().filter("spend > 0").join(d.entities().select("id", "region"), "id").groupBy("region").pivot("year", years).agg(F.ln(F.avg("spend"))).dropna()
    return G.clubs(m.select(F.col("region").alias("id"), F.array(*[str(y) for y in years]).alias("x"))).withColumnRenamed("id", "region")


@query(None)
def entity_clubs(d):
    """Clubs of all entities that have spent in every year."""
    years = _years(d)
    m = d.wide().filter("spend > 0").groupBy("id").pivot("year", years).agg(F.first("spend")).dropna()
    return G.clubs(m.select("id", F.array(*[F.ln(str(y)) for y in years]).alias("x")))


def _sparse(d, k=7):
    """Edges to the ``k`` nearest with gaussian weights, and the nodes."""
    f = written(d.features().drop("label"), "nodes")
    e = N.weigh_edges(B.joined(B.nearest(f, X5, k), k), f, X5)
    return e.select("year", "src", "dst", "weight"), f.select("year", "id")


@query(None)
def leiden(d, k=4):
    return M.communities(*_sparse(d), k)


@query(None)
def spectral(d, k=4):
    return M.spectral(*_sparse(d), k)


@query(None)
def kefrin_like(d, k=4, starts=10):
    """Features and network rows together; the first centres are nodes, drawn by their features."""
    edges, _ = _sparse(d)
    p = P.prepared(d.features(), X5)
    drawn = [(y, m, i, c.tolist()) for (y, m), cs in P.draw(p, starts, k).items() for i, c in enumerate(cs)]
    table = F.broadcast(d.spark.createDataFrame(drawn, "year long, model long, label long, x array<double>"))  # k rows a year and start
    first = p.join(table, ["year", "x"]).groupBy("year", "model", "label").agg(F.min("id").alias("id"))
    return M.attributed(p, edges, first)


@query(None)
def kmeans(d, k=4, starts=20):
    p = P.prepared(d.features(), X5)
    return P.by_centres(p, P.kmeans_centres(p, k, starts))


@query(None)
def ward(d, k=4):
    return P.ward_labels(P.prepared(d.features(), X5), k)


@query(None)
def ward_kmeans(d, k=4):
    p = P.prepared(d.features(), X5)
    return P.by_centres(p, P.ward_kmeans_centres(p, k))


@query(None)
def gmm_diag(d, k=4, starts=5):
    return P.mixture(P.prepared(d.features(), X5), k, starts)


@query(None)
def pooled_fit(d, k=4):
    """One model of both years; every seventh row lacks a feature, as those of years before it was measured."""
    f = d.features().withColumn("x4", F.when(F.col("id") % 7 > 0, F.col("x4"))).withColumn("x5", F.lit(None).cast("double"))
    return P.fit_pooled(f, [*X5, "x5"], k, "ward_kmeans")


@query(None)
def cluster_grid(d, starts=5):
    """Costs and indices of two methods for 2 to 10 clusters in each year, with the place of each number of clusters in its method."""
    rows = P.grid(P.prepared(d.features(), X5), range(2, 11), starts)
    t = d.spark.createDataFrame(rows, "method string, k long, year long, n long, wcss double, calinski double")  # a row a cell
    return t.join(R.consensus(t, {"calinski": True}), ["method", "k"]).select("method", "k", "year", "n", F.round("wcss", 6).alias("wcss"), F.round("calinski", 6).alias("calinski"), "rank")


def _partition(mode):
    def run(d, k=4):
        return P.partition(d.features(), X5, "x0", "ward_kmeans", k, mode)

    run.__name__ = f"partition_{mode}"
    return query(None)(run)


partition_per_year, partition_pooled = map(_partition, ("per_year", "pooled"))


@query(None)
def bootstrap_ari(d, resamples=50):
    """Agreement of clusterings of each year's resampled entities with the whole year's: a row for each year and resample."""
    return P.bootstrap(P.prepared(d.features(), X5), 4, resamples).withColumn("ari", F.round("ari", 6))


@query(None)
def ward_heights(d):
    """The last merge heights of each year with their jumps and ratios: a row a number of clusters from 2 to 10."""
    rows = []
    for year, h in P.ward_heights(P.prepared(d.features(), X5)).items():
        for k in range(2, min(10, len(h)) + 1):
            high, low = float(h[k - 2]), float(h[k - 1])
            rows.append((year, k, round(high, 6), round(high - low, 6), round(high / low, 6) if low else None))
    return d.spark.createDataFrame(rows, "year long, k long, height double, jump double, ratio double")


@query("""SELECT d.y AS y0, d.e AS y1, CAST(list_distinct([round_even(d.y + i * (d.e - d.y) / 2.0, 0) FOR i IN [0, 1, 2]])[2] AS BIGINT) AS middle FROM (SELECT CAST(year(min(o_orderdate)) AS BIGINT) AS y, CAST(year(max(o_orderdate)) AS BIGINT) AS e FROM orders) d""")
def default_periods(d):
    y = d.orders.agg(F.year(F.min("o_orderdate")).cast("long").alias("y0"), F.year(F.max("o_orderdate")).cast("long").alias("y1"))
    return y.select("y0", "y1", F.element_at(T.default_periods(F.col("y0"), F.col("y1"), 3), 2).alias("middle"))


@query("""SELECT label, 'K' || CAST(label + 1 AS VARCHAR) AS code, count(*) AS n FROM types GROUP BY 1""")
def cluster_codes(d):
    return d.types().groupBy("label", T.cluster_code(F.col("label")).alias("code")).agg(F.count("*").alias("n"))


@query(_T + """, l AS (SELECT year, label FROM types GROUP BY 1, 2) SELECT n.year AS y0, n.next AS y1, (SELECT count(*) FROM l b WHERE b.year = n.next AND NOT EXISTS (SELECT 1 FROM l a WHERE a.year = n.year AND a.label = b.label)) AS appeared FROM ny n WHERE n.next IS NOT NULL""")
def new_types(d):
    l = d.types().groupBy("year").agg(F.collect_set("label").alias("l"))
    w = W.partitionBy(F.lit(1)).orderBy("year")  # a row a year
    return l.select(F.col("year").alias("y0"), F.lead("year").over(w).alias("y1"), F.size(F.array_except(F.lead("l").over(w), "l")).cast("long").alias("appeared")).filter("y1 is not null")


@query(""", own AS (SELECT t.year, t.label FROM types t WHERE (t.year + t.label) % 3 > 0 GROUP BY 1, 2), ys AS (SELECT year, lead(year) OVER (ORDER BY year) AS next FROM (SELECT DISTINCT year FROM own))
 SELECT y.year AS y0, y.next AS y1, (SELECT string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) FROM own b WHERE b.year = y.next AND NOT EXISTS (SELECT 1 FROM own a WHERE a.year = y.year AND a.label = b.label)) AS appeared,
  (SELECT string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) FROM own a WHERE a.year = y.year AND NOT EXISTS (SELECT 1 FROM own b WHERE b.year = y.next AND a.label = b.label)) AS vanished FROM ys y WHERE y.next IS NOT NULL""")
def type_changes(d):
    """The types that appear and those that vanish from one year to the next, when a third of them is missing in turn."""
    l = d.types().filter((F.col("year") + F.col("label")) % 3 > 0).groupBy("year").agg(F.collect_set("label").alias("l"))
    w = W.partitionBy(F.lit(1)).orderBy("year")  # a row a year
    text = lambda a: F.nullif(F.array_join(F.transform(F.array_sort(a), lambda x: x.cast("string")), ","), F.lit(""))
    two = l.select(F.col("year").alias("y0"), F.lead("year").over(w).alias("y1"), "l", F.lead("l").over(w).alias("m")).filter("y1 is not null")
    return two.select("y0", "y1", text(F.array_except("m", "l")).alias("appeared"), text(F.array_except("l", "m")).alias("vanished"))


@query("SELECT id, spend, year FROM wide ORDER BY abs(ln(spend / 100000)) DESC, id, year LIMIT 20")
def top_deviations(d):
    return d.wide().select("id", "spend", "year").orderBy(F.desc(F.abs(F.ln(F.col("spend") / 100000))), "id", "year").limit(20)


@query("SELECT t.year, e.district, t.label, count(*) AS n FROM types t JOIN entities e USING (id) GROUP BY 1, 2, 3")
def label_by_district(d):
    return d.types().join(d.entities().select("id", "district"), "id").groupBy("year", "district", "label").agg(F.count("*").alias("n"))


_CONSTANT = "SELECT id, count(*) AS n_years, mode(n_orders) AS usual FROM wide GROUP BY 1 HAVING count(DISTINCT n_orders) = 1"


@query(_CONSTANT)
def constant_entities(d):
    return _constant(d.wide())


@query(_CONSTANT)
def constant_all_entities(d):
    """An older name of :func:`constant_entities`."""
    return _constant(d.wide())


def _constant(w):
    return w.groupBy("id").agg(F.count("*").alias("n_years"), F.mode("n_orders").alias("usual"), F.count_distinct("n_orders").alias("k")).filter("k = 1").drop("k")
