"""The registry of indicators, real values, concentration, and payroll where it is not published."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import indicators as I
from panelwright.operators import prices as X
from panelwright.plans import money
from panelwright.plans.base import query

#: Made inputs of a territory and year, as SQL over ``wide`` (the same text serves Spark and the oracle).
_INPUTS = {
    "pop": "CASE WHEN id % 31 = 0 THEN NULL ELSE n_orders * 1000 + id % 97 END",
    "pop_working": "n_orders * 600 + id % 50",
    "pop_old": "n_orders * 200 + id % 13",
    "workers": "CASE WHEN id % 13 = 0 THEN NULL ELSE n_orders * 300 + id % 40 END",
    "wage": "spend / (n_orders * 9.8713)",
    "paid": "CASE WHEN id % 3 = 0 THEN NULL ELSE spend * 0.1437193 END",
    "shipped": "spend * 0.5123457",
    "invest": "spend * ((id + year) % 5) * 0.1034567",
    "invest_pc_nobudget": "spend * 0.0012346",
    "shipped_manuf": "CASE WHEN id % 5 = 0 THEN NULL ELSE spend * 0.2598763 END",
    "agri_output": "spend * (id % 3) * 0.9876543",
    "orgs_manuf": "id % 11",
    "budget_own_share": "(id % 10) / 10.0",
    "budget_rev": "spend * 0.1234567",
    "area_ha": "CASE WHEN year % 3 = 0 THEN (id % 50 + 1) * 100 END",
    "housing_pc_src": "(id % 30) / 10.0",
    "retail": "spend * 0.3312347",
    "living_space_pc": "20 + id % 9",
    "preschool_coverage": "40 + year % 20",
    "clinics": "id % 17",
    "births": "n_orders * 11",
    "deaths": "n_orders * 9 + id % 5",
    "spend_total": "spend * 0.0512347",
    "market_access": "CASE WHEN year = 1998 THEN spend * 0.0010247 END",
}
_MADE = ", made AS (SELECT id, year, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _INPUTS.items()) + " FROM wide)"
_PAY = ", terr AS (SELECT *, coalesce(paid, workers * wage * 12 / 1000) AS payroll, CASE WHEN paid IS NOT NULL THEN 'published' WHEN workers * wage IS NOT NULL THEN 'imputed' END AS payroll_source FROM made)"


def _territories(d):
    made = d.wide().select("id", "year", *[F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in _INPUTS.items()])
    imputed = F.col("workers") * F.col("wage") * 12 / 1000
    source = F.when(F.col("paid").isNotNull(), "published").when(imputed.isNotNull(), "imputed")
    return made.withColumn("payroll", F.coalesce("paid", imputed)).withColumn("payroll_source", source)


@query(_MADE + _PAY + "SELECT id, year, round(payroll, 4) AS payroll, payroll_source FROM terr")
def payroll_imputed(d):
    """Published payroll, or else workers times wage."""
    return _territories(d).select("id", "year", F.round("payroll", 4).alias("payroll"), "payroll_source")


_GMP = money._BASE + money._SEC + """,
 gb AS (SELECT id, year, total * spend / nullif(sum(spend) OVER (PARTITION BY region, year), 0) AS gmp_basic FROM b),
 gs AS (SELECT id, year, sum(v) AS gmp_sectoral, sum(imputed) / nullif(sum(v), 0) AS gmp_imputed_sectoral FROM v WHERE year <> 1996 GROUP BY 1, 2)"""


def _gmp(d):
    """Both allocations side by side; the sectoral one is taken to lack a year."""
    b = money._based(d)
    basic = b.select("id", "year", X.allocate(b, F.col("total"), F.col("spend"), ["region", "year"]).alias("gmp_basic"), F.lit(None).cast("double").alias("gmp_imputed_basic"))
    s = money._sectoral(d).filter("year <> 1996").groupBy("id", "year").agg(F.sum("v").alias("gmp_sectoral"), F.try_divide(F.sum("imputed"), F.sum("v")).alias("gmp_imputed_sectoral"))
    return basic.join(s, ["id", "year"], "full_outer")


_RATIOS = {
    "gmp_pc": "coalesce(gmp_sectoral, gmp_basic) * 1000 / nullif(pop, 0)", "wage": "wage", "payroll_pc": "payroll * 1000 / nullif(pop, 0)", "shipped_pc": "shipped * 1000 / nullif(pop, 0)",
    "invest_pc": "invest * 1000 / nullif(pop, 0)", "invest_pc_nobudget": "invest_pc_nobudget", "invest_share": "invest / nullif(coalesce(gmp_sectoral, gmp_basic), 0)",
    "manuf_shipped_pc": "shipped_manuf * 1000 / nullif(pop, 0)", "agri_output_pc": "agri_output * 1000 / nullif(pop, 0)", "manuf_orgs_per_10k": "orgs_manuf / nullif(pop, 0) * 10000",
    "employment_ratio": "workers / nullif(pop_working, 0)", "budget_own_share": "budget_own_share", "budget_rev_pc": "budget_rev * 1000 / nullif(pop, 0)", "pop": "pop",
    "pop_growth": "pop / nullif(lag(pop) OVER (PARTITION BY id ORDER BY year), 0) - 1",
    "pop_growth_window": "CASE WHEN max(CASE WHEN pop > 0 THEN year END) OVER k > min(CASE WHEN pop > 0 THEN year END) OVER k THEN pow(arg_max(pop, CASE WHEN pop > 0 THEN year END) OVER k / arg_min(pop, CASE WHEN pop > 0 THEN year END) OVER k, 1.0 / (max(CASE WHEN pop > 0 THEN year END) OVER k - min(CASE WHEN pop > 0 THEN year END) OVER k)) - 1 END",
    "density": "pop / nullif(coalesce(last_value(area_ha IGNORE NULLS) OVER (PARTITION BY id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(area_ha IGNORE NULLS) OVER (PARTITION BY id ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / 100, 0)",
    "housing_pc": "housing_pc_src", "retail_pc": "retail * 1000 / nullif(pop, 0)", "living_space_pc": "living_space_pc", "preschool_coverage": "preschool_coverage", "clinics_per_10k": "clinics / nullif(pop, 0) * 10000",
    "natural_growth": "(births - deaths) / nullif(pop, 0) * 1000", "old_age_share": "pop_old / nullif(pop, 0)", "spend_to_wage": "spend_total / nullif(wage, 0)", "market_access": "market_access", "gmp_imputed_share": "gmp_imputed_sectoral",
}


@query(_GMP + _MADE + _PAY + ", t AS (SELECT terr.*, gmp_basic, gmp_sectoral, gmp_imputed_sectoral FROM terr LEFT JOIN gb USING (id, year) LEFT JOIN gs USING (id, year)) SELECT id, year, " + ", ".join(f"round(CAST({v} AS DOUBLE), 4) AS {k}" for k, v in _RATIOS.items()) + ", CASE WHEN gmp_sectoral IS NOT NULL THEN 'sectoral' WHEN gmp_basic IS NOT NULL THEN 'basic' END AS gmp_method_used FROM t WINDOW k AS (PARTITION BY id)")
def indicators_wide(d):
    """Every indicator of a territory and year in one select."""
    t = _territories(d).join(_gmp(d), ["id", "year"], "left")
    out = I.evaluate(t, ["id", "year"], more={"gmp_method_used": I.method_used()})
    return out.select("id", "year", *[F.round(F.col(k).cast("double"), 4).alias(k) for k in _RATIOS], "gmp_method_used")


#: Workers of a section; those of section 5 are not published for every other territory.
_EMP = _MADE + """, emp AS (SELECT s.id, s.year, s.section, e.district, CASE WHEN s.section = '5' AND s.id % 2 = 0 THEN NULL ELSE s.value * m.workers / (sum(s.value) OVER (PARTITION BY s.id, s.year)) END AS emp, m.workers, s.value / (sum(s.value) OVER (PARTITION BY s.id, s.year)) AS spend_share
 FROM sections s JOIN made m USING (id, year) JOIN entities e USING (id))"""


def _employment(d):
    whole = F.sum("value").over(I.W.partitionBy("id", "year"))
    j = d.sections().withColumn("spend_share", F.try_divide(F.col("value"), whole)).join(_territories(d).select("id", "year", "workers"), ["id", "year"]).join(d.entities().select("id", "district"), "id")
    hidden = (F.col("section") == "5") & (F.col("id") % 2 == 0)
    return j.select("id", "year", "section", "district", F.when(~hidden, F.col("spend_share") * F.col("workers")).alias("emp"), "workers", "spend_share")


@query(_EMP + """, bd AS (SELECT district, year, section, sum(emp) / sum(workers) AS share_district FROM emp WHERE emp IS NOT NULL AND workers > 0 GROUP BY 1, 2, 3), bc AS (SELECT year, section, sum(emp) / sum(workers) AS share_country FROM emp WHERE emp IS NOT NULL AND workers > 0 GROUP BY 1, 2)
 SELECT id, year, section, round(emp / nullif(workers, 0), 6) AS emp_share, round(emp / nullif(workers, 0) / nullif(share_district, 0), 6) AS lq, round(emp / nullif(workers, 0) / nullif(share_country, 0), 6) AS lq_ru, round(spend_share, 6) AS spend_share
 FROM emp LEFT JOIN bd USING (district, year, section) LEFT JOIN bc USING (year, section)""")
def indicators_by_section(d):
    """Shares of workers, and against those of the district and of the country."""
    e = _employment(d)
    b = e.join(I.base_shares(e, ["district", "year"]).withColumnRenamed("share", "share_district"), ["district", "year", "section"], "left")
    b = b.join(I.base_shares(e, ["year"]).withColumnRenamed("share", "share_country"), ["year", "section"], "left").withColumn("gmp_share", F.lit(None).cast("double"))
    out = I.evaluate(b, ["id", "year", "section"], by_section=True)
    return out.select("id", "year", "section", *[F.round(c, 6).alias(c) for c in ("emp_share", "lq", "lq_ru", "spend_share")])


@query(_EMP + "SELECT id, year, round(sum(pow(emp / nullif(workers, 0), 2)), 6) AS hhi_emp, round(greatest(1 - sum(emp / nullif(workers, 0)), 0), 6) AS emp_share_unknown FROM emp GROUP BY 1, 2".replace("greatest(1 - sum(emp / nullif(workers, 0)), 0)", "CASE WHEN sum(emp / nullif(workers, 0)) IS NOT NULL THEN greatest(1 - sum(emp / nullif(workers, 0)), 0) ELSE 0 END"))
def employment_concentration(d):
    """Concentration of workers, and the share of those in sections that aren't published."""
    return I.concentration(_employment(d), ["id", "year"]).select("id", "year", F.round("hhi_emp", 6).alias("hhi_emp"), F.round("emp_share_unknown", 6).alias("emp_share_unknown"))


#: Deflators by return flag; region 3 has one of its own for consumer prices, and half of the regions a basket.
_FLAGS = {"cpi": "N", "grp": "N", "ppi_industry": "A", "ppi_manufacturing": "A", "ppi_agri": "R", "invest": "R"}
_DEFLATORS = money._FACTOR.replace("year = 1998", "year = {year}") + ", kinds(deflator, flag) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _FLAGS.items()) + """),
 fac AS (SELECT deflator, CAST(NULL AS BIGINT) AS region, year, factor FROM factors JOIN kinds USING (flag) UNION ALL SELECT 'cpi', 3, year, factor * 1.1 FROM factors WHERE flag = 'N')"""


def _factors(d, base_year):
    f = X.factors(money._levels(d), ["flag"], base_year)
    kinds = F.array(*[F.struct(F.lit(k).alias("deflator"), F.lit(v).alias("flag")) for k, v in _FLAGS.items()])
    country = f.withColumn("k", F.explode(kinds)).filter("k.flag = flag").select("k.deflator", F.lit(None).cast("long").alias("region"), "year", "factor")
    return country.unionByName(f.filter("flag = 'N'").select(F.lit("cpi").alias("deflator"), F.lit(3).cast("long").alias("region"), "year", (F.col("factor") * 1.1).alias("factor")))


_REAL = _DEFLATORS.format(year=1998) + _MADE + """, mon AS (SELECT id, year, region, unnest(['wage', 'invest_pc_nobudget', 'living_space_pc']) AS indicator, unnest([wage, invest_pc_nobudget, living_space_pc]) AS value FROM made JOIN entities USING (id)),
 kk(indicator, deflator) AS (VALUES ('wage', 'cpi'), ('invest_pc_nobudget', 'invest')), basket AS (SELECT DISTINCT region, year, 1 + (region % 7) / 20.0 AS relative FROM mon WHERE region % 2 = 0)
 SELECT m.id, m.year, m.region, m.indicator, m.value, round(CASE WHEN kk.deflator IS NULL THEN m.value ELSE m.value * coalesce(o.factor, n.factor) / coalesce(relative, 1) END, 4) AS real
 FROM mon m LEFT JOIN kk USING (indicator) LEFT JOIN fac o ON o.deflator = kk.deflator AND o.region = m.region AND o.year = m.year LEFT JOIN fac n ON n.deflator = kk.deflator AND n.region IS NULL AND n.year = m.year LEFT JOIN basket b ON b.region = m.region AND b.year = m.year"""


@query(_REAL)
def real_values(d):
    """Money of 1998, by the region's own deflator or the country's, and by the price of the region's basket; what isn't money stays."""
    t = _territories(d).join(d.entities().select("id", "region"), "id")
    long = t.select("id", "year", "region", "wage", "invest_pc_nobudget", "living_space_pc").unpivot(["id", "year", "region"], ["wage", "invest_pc_nobudget", "living_space_pc"], "indicator", "value")
    r = F.col("region")
    baskets = long.filter("region % 2 = 0").select("region", "year", (1 + (r % 7) / 20.0).alias("relative")).distinct()
    return I.to_real(long, _factors(d, 1998), baskets).select("id", "year", "region", "indicator", "value", F.round("real", 4).alias("real"))


@query(_DEFLATORS.format(year=1999) + "SELECT deflator, round(1 / factor, 6) AS unit FROM fac WHERE region IS NULL AND year = 1998")
def log_unit(d):
    """One unit of money of 1999 in that of 1998, for each deflator."""
    return I.log_units(_factors(d, 1999), 1999, 1998).select("deflator", F.round("unit", 6).alias("unit"))


@query("SELECT code, block, deflator, logged FROM (VALUES " + ", ".join(f"('{c}', '{b}', {'NULL' if f is None else repr(f)}, {str(g).upper()})" for c, b, f, g in [(f"emp_share_{s}", "economy", None, False) for s in "12345"] + [("wage", "economy", "cpi", True)]) + ") t(code, block, deflator, logged)", views=False)
def registry_rows(d):
    """Rows of the registry, those by section once for each section of the table: here, two of its codes."""
    sections = [r.section for r in d.sections().select("section").distinct().orderBy("section").collect()]  # a handful
    rows = [r for r in I.expand(sections) if r[0] == "wage" or r[0].startswith("emp_share")]
    return d.spark.createDataFrame(rows, "code string, block string, deflator string, logged boolean")
