"""Prices, real values, allocation of regional totals and indicators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators import panel as P
from panelwright.operators import prices as X
from panelwright.plans.base import query

_RUN = """, ok AS (SELECT flag, year, idx, year - row_number() OVER (PARTITION BY flag ORDER BY year) AS island FROM price_index WHERE idx > 30 AND idx < 1000),
 run AS (SELECT flag, year, idx FROM ok QUALIFY island = max(island) OVER (PARTITION BY flag)),
 levels AS (SELECT flag, year, product(idx / 100) OVER (PARTITION BY flag ORDER BY year) AS level FROM run UNION ALL SELECT flag, min(year) - 1, 1.0 FROM run GROUP BY 1)"""


def _levels(d):
    return X.chain(d.price_index(), ["flag"])


@query(_RUN + "SELECT flag, year, idx FROM run")
def islands_last_run(d):
    return P.last_run(d.price_index().filter("idx > 30 and idx < 1000"), ["flag"])


@query(_RUN + "SELECT flag, year, round(level, 6) AS level FROM levels")
def chain_index(d):
    return _levels(d).withColumn("level", F.round("level", 6))


@query(_RUN + "SELECT * FROM (SELECT flag, year, round(sqrt(level * lag(level) OVER (PARTITION BY flag ORDER BY year)), 6) AS level FROM levels) WHERE level IS NOT NULL")
def dec_dec_level(d):
    return X.mid_year(_levels(d), ["flag"]).withColumn("level", F.round("level", 6))


_MONTHLY = """, mp AS (SELECT l_returnflag AS flag, CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month, avg(l_extendedprice / l_quantity) AS p FROM lineitem GROUP BY 1, 2, 3),
 mi AS (SELECT flag, year, month, round(coalesce(100 * p / nullif(lag(p) OVER (PARTITION BY flag ORDER BY year, month), 0), 100), 6) AS idx FROM mp)"""


@query(_MONTHLY + """SELECT flag, year, round(avg(l), 6) AS level FROM (SELECT flag, year, product(idx / 100) OVER (PARTITION BY flag ORDER BY year, month) AS l FROM mi) GROUP BY 1, 2 HAVING count(*) = 12""")
def annual_avg_level(d):
    p = d.lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").cast("long").alias("year"), F.month("l_shipdate").cast("long").alias("month")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    lag = F.lag("p").over(W.partitionBy("flag").orderBy("year", "month"))
    m = p.withColumn("idx", F.round(F.coalesce(100 * F.try_divide(F.col("p"), lag), F.lit(100.0)), 6))
    return X.annual_average(m, ["flag"]).withColumn("level", F.round("level", 6))


_SPINE = _RUN + """, ref AS (SELECT year, avg(level) AS r FROM levels GROUP BY 1),
 spine AS (SELECT l.flag, l.year, CASE WHEN l.year BETWEEN 1997 AND 1999 THEN l.level END AS level, r FROM levels l JOIN ref USING (year)),
 k AS (SELECT flag, min(year) AS lo, max(year) AS hi, arg_min(level, year) AS l0, arg_min(r, year) AS r0, arg_max(level, year) AS l1, arg_max(r, year) AS r1 FROM spine WHERE level IS NOT NULL GROUP BY 1)"""


@query(_SPINE + """SELECT flag, year, round(CASE WHEN level IS NOT NULL THEN level WHEN year > hi THEN l1 * r / nullif(r1, 0) WHEN year < lo THEN l0 * r / nullif(r0, 0) END, 6) AS level,
 CASE WHEN level IS NOT NULL THEN 'own' ELSE 'extended' END AS flagged FROM spine JOIN k USING (flag)""")
def extend_levels(d):
    l = _levels(d)
    ref = l.groupBy("year").agg(F.avg("level").alias("r"))
    spine = l.withColumn("level", F.when(F.col("year").between(1997, 1999), F.col("level"))).join(ref, "year")
    out = X.extend(spine.withColumnRenamed("flag", "k"), ["k"], "level", "r")
    return out.select(F.col("k").alias("flag"), "year", F.round("level", 6).alias("level"), F.col("flag").alias("flagged"))


_FACTOR = _RUN + ", factors AS (SELECT flag, year, max(CASE WHEN year = 1998 THEN level END) OVER (PARTITION BY flag) / nullif(level, 0) AS factor FROM levels)"


@query(_FACTOR + "SELECT flag, year, round(factor, 6) AS factor FROM factors")
def deflator_factor(d):
    return X.factors(_levels(d), ["flag"], 1998).withColumn("factor", F.round("factor", 6))


@query(_FACTOR + """SELECT w.id, w.year, round(w.spend * f.factor, 2) AS real_spend FROM wide w LEFT JOIN factors f ON f.year = w.year AND f.flag = 'N'""")
def to_real_join(d):
    f = X.factors(_levels(d), ["flag"], 1998).filter("flag = 'N'").select("year", "factor")
    return d.wide().join(f, "year", "left").select("id", "year", F.round(F.col("spend") * F.col("factor"), 2).alias("real_spend"))


@query(""", g AS (SELECT region, year, total, lag(total) OVER (PARTITION BY region ORDER BY year) AS before FROM regional) SELECT year, round(sum(total) / nullif(sum(before * 1.02), 0), 6) AS deflator FROM g WHERE before IS NOT NULL GROUP BY 1""")
def regional_deflator(d):
    g = d.regional().withColumn("before", F.lag("total").over(W.partitionBy("region").orderBy("year"))).filter("before is not null")
    return g.groupBy("year").agg(F.round(F.try_divide(F.sum("total"), F.sum(F.col("before") * 1.02)), 6).alias("deflator"))


_BASE = ", b AS (SELECT w.*, e.region, e.district, r.total FROM wide w JOIN entities e USING (id) JOIN regional r ON r.region = e.region AND r.year = w.year)"


def _based(d):
    return d.wide().join(d.entities().select("id", "region", "district"), "id").join(d.regional(), ["region", "year"])


@query(_BASE + "SELECT id, year, region, round(total * spend / nullif(sum(spend) OVER (PARTITION BY region, year), 0), 2) AS gmp FROM b")
def gmp_basic(d):
    b = _based(d)
    return b.select("id", "year", "region", F.round(X.allocate(b, F.col("total"), F.col("spend"), ["region", "year"]), 2).alias("gmp"))


@query(_BASE + """, g AS (SELECT region, year, total, total * spend / nullif(sum(spend) OVER (PARTITION BY region, year), 0) AS gmp FROM b)
 SELECT round(max(abs(s / nullif(total, 0) - 1)), 9) AS worst, count(*) AS n FROM (SELECT region, year, any_value(total) AS total, sum(gmp) AS s FROM g GROUP BY 1, 2)""")
def gmp_conservation(d):
    b = _based(d)
    g = b.select("region", "year", "total", X.allocate(b, F.col("total"), F.col("spend"), ["region", "year"]).alias("gmp"))
    s = g.groupBy("region", "year").agg(F.first("total").alias("total"), F.sum("gmp").alias("s"))
    return s.agg(F.round(F.max(F.abs(F.try_divide(F.col("s"), F.col("total")) - 1)), 9).alias("worst"), F.count("*").alias("n"))


_SEC = """, e AS (SELECT id, region FROM entities), pay AS (SELECT w.id, w.year, e.region, w.spend AS w FROM wide w JOIN e USING (id)),
 x AS (SELECT s.id, s.year, s.section, CASE WHEN s.section = '5' THEN NULL ELSE s.value END AS x FROM sections s),
 gva AS (SELECT r.region, r.year, k.section, r.total * k.share AS gva FROM regional r, (VALUES ('1', 0.3), ('2', 0.2), ('3', 0.2), ('4', 0.2), ('5', 0.1)) k(section, share)),
 phi AS (SELECT region, year, sum(greatest(w - coalesce(s, 0), 0)) / nullif(sum(w), 0) AS phi, sum(w) AS sw FROM (SELECT p.*, (SELECT sum(x) FROM x WHERE x.id = p.id AND x.year = p.year) AS s FROM pay p) GROUP BY 1, 2),
 j AS (SELECT p.id, p.year, p.region, g.section, g.gva, coalesce(x.x, 0) AS x, p.w, f.phi, f.sw, sum(coalesce(x.x, 0)) OVER (PARTITION BY p.region, p.year, g.section) AS sx
  FROM pay p JOIN gva g ON g.region = p.region AND g.year = p.year JOIN phi f ON f.region = p.region AND f.year = p.year LEFT JOIN x ON x.id = p.id AND x.year = p.year AND x.section = g.section),
 v AS (SELECT *, CASE WHEN sx > 0 THEN (1 - phi) * gva * x / sx + phi * gva * w / sw ELSE gva * w / sw END AS v, CASE WHEN sx > 0 THEN phi * gva * w / sw ELSE gva * w / sw END AS imputed FROM j)"""


def _sectoral(d):
    pay = d.wide().join(d.entities().select("id", "region"), "id").select("id", "year", "region", F.col("spend").alias("w"))
    x = d.sections().withColumn("x", F.when(F.col("section") != "5", F.col("value"))).select("id", "year", "section", "x")
    known = x.groupBy("id", "year").agg(F.sum("x").alias("s"))
    phi = pay.join(known, ["id", "year"], "left").groupBy("region", "year").agg(
        F.try_divide(F.sum(F.greatest(F.col("w") - F.coalesce("s", F.lit(0.0)), F.lit(0.0))), F.sum("w")).alias("phi"), F.sum("w").alias("sw"))
    shares = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(v).alias("share")) for s, v in (("1", 0.3), ("2", 0.2), ("3", 0.2), ("4", 0.2), ("5", 0.1))])
    gva = d.regional().select("region", "year", "total", F.explode(shares).alias("k")).select("region", "year", "k.section", (F.col("total") * F.col("k.share")).alias("gva"))
    j = pay.join(gva, ["region", "year"]).join(phi, ["region", "year"]).join(x, ["id", "year", "section"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    j = j.withColumn("sx", F.sum("x").over(W.partitionBy("region", "year", "section")))
    whole = F.col("gva") * F.try_divide(F.col("w"), F.col("sw"))
    rest = F.col("phi") * whole
    return j.withColumn("v", F.when(F.col("sx") > 0, (1 - F.col("phi")) * F.col("gva") * F.try_divide(F.col("x"), F.col("sx")) + rest).otherwise(whole)).withColumn("imputed", F.when(F.col("sx") > 0, rest).otherwise(whole))


@query(_SEC + "SELECT id, year, region, round(sum(v), 2) AS gmp, round(sum(imputed) / nullif(sum(v), 0), 6) AS imputed_share FROM v GROUP BY 1, 2, 3")
def gmp_sectoral(d):
    return _sectoral(d).groupBy("id", "year", "region").agg(F.round(F.sum("v"), 2).alias("gmp"), F.round(F.try_divide(F.sum("imputed"), F.sum("v")), 6).alias("imputed_share"))


@query(_BASE + _SEC + """ SELECT id, year, region, round(total * spend / nullif(sum(spend) OVER (PARTITION BY region, year), 0), 2) AS gmp, NULL AS imputed_share, 'basic' AS method FROM b
 UNION ALL SELECT id, year, region, round(sum(v), 2), round(sum(imputed) / nullif(sum(v), 0), 6), 'sectoral' FROM v GROUP BY 1, 2, 3""")
def gmp_methods(d):
    """Both ways of allocation in one table, by the method's name."""
    return X.by_method({"basic": lambda: gmp_basic(d), "sectoral": lambda: gmp_sectoral(d)}, ["basic", "sectoral"])


@query("""SELECT o_orderkey AS id, o_totalprice / 20000 / 100 AS basket_rel FROM orders WHERE CASE o_orderkey % 3 WHEN 0 THEN 'per cent of the mean' WHEN 1 THEN 'money' END LIKE '%of the mean%' AND o_totalprice / 20000 / 100 > 0 AND o_totalprice / 20000 / 100 < 10""".replace("/ 20000 / 100", "/ 200 / 100"))
def basket_rows(d):
    """Relative costs among rows in several units, of which some have none."""
    unit = F.when(F.col("o_orderkey") % 3 == 0, "per cent of the mean").when(F.col("o_orderkey") % 3 == 1, "money")
    rows = d.orders.select(F.col("o_orderkey").alias("id"), unit.alias("unit"), (F.col("o_totalprice") / 200).alias("v"))
    return X.basket(rows, "unit", "of the mean", "v", ["id"])


@query(_SEC + "SELECT id, year, section, round(v, 2) AS value, round(v / nullif(sum(v) OVER (PARTITION BY id, year), 0), 6) AS share FROM v")
def gmp_structure(d):
    s = F.sum("v").over(W.partitionBy("id", "year"))
    return _sectoral(d).select("id", "year", "section", F.round("v", 2).alias("value"), F.round(F.try_divide(F.col("v"), s), 6).alias("share"))


@query("""SELECT id // 10 AS agglomeration, year, round(sum(spend), 4) AS spend FROM wide GROUP BY 1, 2 HAVING count(DISTINCT id) = 10""")
def agglomeration_having(d):
    g = d.wide().groupBy(F.floor(F.col("id") / 10).cast("long").alias("agglomeration"), "year").agg(F.count_distinct("id").alias("n"), F.round(F.sum("spend"), 4).alias("spend"))
    return g.filter("n = 10").drop("n")


@query("SELECT id, year, round(spend * 1000 / nullif(n_orders, 0), 4) AS per_order, round(n_orders / nullif(spend, 0) * 1e4, 6) AS per_10k FROM wide")
def per_capita(d):
    return d.wide().select("id", "year", F.round(F.try_divide(F.col("spend") * 1000, F.col("n_orders")), 4).alias("per_order"), F.round(F.try_divide(F.col("n_orders"), F.col("spend")) * 1e4, 6).alias("per_10k"))


@query("SELECT id, year, round(spend / nullif(lag(spend) OVER (PARTITION BY id ORDER BY year), 0) - 1, 6) AS growth FROM wide")
def growth_yoy(d):
    return d.wide().select("id", "year", F.round(F.try_divide(F.col("spend"), F.lag("spend").over(W.partitionBy("id").orderBy("year"))) - 1, 6).alias("growth"))


@query("""SELECT id, round(CASE WHEN max(year) > min(year) THEN pow(arg_max(spend, year) / arg_min(spend, year), 1.0 / (max(year) - min(year))) - 1 END, 6) AS cagr FROM wide GROUP BY 1""")
def cagr_window(d):
    t = F.max("year") - F.min("year")
    return d.wide().groupBy("id").agg(F.round(F.when(t > 0, F.pow(F.try_divide(F.max_by("spend", "year"), F.min_by("spend", "year")), F.try_divide(F.lit(1.0), t)) - 1), 6).alias("cagr"))


@query(""", h AS (SELECT id, year, CASE WHEN n_orders > 1 THEN spend END AS v FROM wide)
 SELECT id, year, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM h""")
def ffill_bfill(d):
    h = d.wide().select("id", "year", F.when(F.col("n_orders") > 1, F.col("spend")).alias("v"))
    return P.fill_both_ways(h, "v", "filled").select("id", "year", "filled")


@query(""", t AS (SELECT s.*, sum(value) OVER (PARTITION BY id, year) AS w FROM sections s), base AS (SELECT year, section, sum(value) AS bs FROM sections WHERE id % 2 = 0 GROUP BY 1, 2), bw AS (SELECT year, sum(value) AS bw FROM sections WHERE id % 2 = 0 GROUP BY 1)
 SELECT id, year, section, round((value / nullif(w, 0)) / nullif(bs / nullif(bw, 0), 0), 6) AS lq FROM t JOIN base USING (year, section) JOIN bw USING (year)""")
def location_quotient(d):
    s = d.sections()
    b = s.filter("id % 2 = 0")
    base = b.groupBy("year", "section").agg(F.sum("value").alias("bs")).join(b.groupBy("year").agg(F.sum("value").alias("bw")), "year")
    t = s.withColumn("w", F.sum("value").over(W.partitionBy("id", "year"))).join(F.broadcast(base), ["year", "section"])  # years times sections
    return t.select("id", "year", "section", F.round(F.try_divide(F.try_divide(F.col("value"), F.col("w")), F.try_divide(F.col("bs"), F.col("bw"))), 6).alias("lq"))


@query(""", s AS (SELECT id, year, value / nullif(sum(value) OVER (PARTITION BY id, year), 0) AS sh FROM sections) SELECT id, year, round(sum(sh * sh), 6) AS hhi, round(greatest(1 - sum(sh), 0), 6) AS unknown FROM s GROUP BY 1, 2""")
def hhi(d):
    s = d.sections().groupBy("id", "year").agg(F.sum("value").alias("w"), F.sum(F.col("value") * F.col("value")).alias("q"))
    return s.select("id", "year", F.round(F.try_divide(F.col("q"), F.col("w") * F.col("w")), 6).alias("hhi"), F.round(F.greatest(1 - F.try_divide(F.col("w"), F.col("w")), F.lit(0.0)), 6).alias("unknown"))
