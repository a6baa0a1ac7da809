"""The registry of indicators: each is one expression over a row of the panel, all are evaluated in one select."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Indicator:
    """``deflator``: what turns its money into that of a base year, if it is money; ``log``: whether its logarithm is compared."""

    code: str
    block: str
    value: Callable[[], Column]
    deflator: str | None = None
    log: bool = False
    by_section: bool = False


def per_head(column: str) -> Callable[[], Column]:
    """Thousands of money per person, in money."""
    return lambda: F.try_divide(F.col(column) * 1000, F.col("pop"))


def per_10k(column: str) -> Callable[[], Column]:
    return lambda: F.try_divide(F.col(column), F.col("pop")) * 1e4


def ratio(a: str, b: str) -> Callable[[], Column]:
    return lambda: F.try_divide(F.col(a), F.col(b))


def same(column: str) -> Callable[[], Column]:
    return lambda: F.col(column)


def chosen(kind: str, method: str | None = None) -> Callable[[], Column]:
    """The value of the sectoral allocation or else of the basic one; ``method`` forces one of them."""
    return lambda: F.col(f"{kind}_{method}") if method else F.coalesce(f"{kind}_sectoral", f"{kind}_basic")


def method_used(method: str | None = None) -> Column:
    if method:
        return F.when(F.col(f"gmp_{method}").isNotNull(), method)
    return F.when(F.col("gmp_sectoral").isNotNull(), "sectoral").when(F.col("gmp_basic").isNotNull(), "basic")


def growth() -> Column:
    """On the row before, whatever its year."""
    return F.try_divide(F.col("pop"), F.lag("pop").over(W.partitionBy("id").orderBy("year"))) - 1


def mean_growth() -> Column:
    """Per year between the first and the last known number of people; null if there is only one."""
    whole = W.partitionBy("id")
    at = F.when(F.col("pop") > 0, F.col("year"))
    years = F.max(at).over(whole) - F.min(at).over(whole)
    last, first = F.max_by("pop", at).over(whole), F.min_by("pop", at).over(whole)
    return F.when(years > 0, F.pow(F.try_divide(last, first), F.try_divide(F.lit(1.0), years)) - 1)


def density() -> Column:
    """People per square kilometre; an area in hectares that is missing is the last one known, or else the next."""
    w = W.partitionBy("id").orderBy("year")
    area = F.coalesce(F.last("area_ha", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first("area_ha", True).over(w.rowsBetween(0, W.unboundedFollowing)))
    return F.try_divide(F.col("pop"), area / 100)


#: Codes, blocks, deflators, and which indicators are compared by their logarithm.
REGISTRY = (
    Indicator("gmp_pc", "economy", lambda: F.try_divide(chosen("gmp")() * 1000, F.col("pop")), "grp", True),
    Indicator("wage", "economy", same("wage"), "cpi", True),
    Indicator("payroll_pc", "economy", per_head("payroll"), "cpi", True),
    Indicator("shipped_pc", "economy", per_head("shipped"), "ppi_industry", True),
    Indicator("invest_pc", "economy", per_head("invest"), "invest", True),
    Indicator("invest_pc_nobudget", "economy", same("invest_pc_nobudget"), "invest", True),
    Indicator("invest_share", "economy", lambda: F.try_divide(F.col("invest"), chosen("gmp")())),
    Indicator("manuf_shipped_pc", "economy", per_head("shipped_manuf"), "ppi_manufacturing", True),
    Indicator("agri_output_pc", "economy", per_head("agri_output"), "ppi_agri", True),
    Indicator("manuf_orgs_per_10k", "economy", per_10k("orgs_manuf"), None, True),
    Indicator("employment_ratio", "economy", ratio("workers", "pop_working")),
    Indicator("budget_own_share", "economy", same("budget_own_share")),
    Indicator("budget_rev_pc", "economy", per_head("budget_rev"), "cpi", True),
    Indicator("pop", "social", same("pop"), None, True),
    Indicator("pop_growth", "social", growth),
    Indicator("pop_growth_window", "social", mean_growth),
    Indicator("density", "social", density, None, True),
    Indicator("housing_pc", "social", same("housing_pc_src"), None, True),
    Indicator("retail_pc", "social", per_head("retail"), "cpi", True),
    Indicator("living_space_pc", "social", same("living_space_pc")),
    Indicator("preschool_coverage", "social", same("preschool_coverage")),
    Indicator("clinics_per_10k", "social", per_10k("clinics"), None, True),
    Indicator("natural_growth", "social", lambda: F.try_divide(F.col("births") - F.col("deaths"), F.col("pop")) * 1000),
    Indicator("old_age_share", "social", ratio("pop_old", "pop")),
    Indicator("spend_to_wage", "consumption", ratio("spend_total", "wage")),
    Indicator("market_access", "consumption", same("market_access")),
    Indicator("gmp_imputed_share", "quality", chosen("gmp_imputed")),
    Indicator("gmp_structure", "economy", same("gmp_share"), by_section=True),
    Indicator("emp_share", "economy", ratio("emp", "workers"), by_section=True),
    Indicator("lq", "economy", lambda: F.try_divide(F.try_divide(F.col("emp"), F.col("workers")), F.col("share_district")), None, True, True),
    Indicator("lq_ru", "economy", lambda: F.try_divide(F.try_divide(F.col("emp"), F.col("workers")), F.col("share_country")), None, True, True),
    Indicator("spend_share", "consumption", same("spend_share"), by_section=True),
)


def evaluate(panel: DataFrame, keys: list[str], by_section: bool = False, more: dict[str, Column] | None = None) -> DataFrame:
    """The keys and a column for each indicator; inputs that are missing make it null, as do denominators of 0."""
    values = [i.value().alias(i.code) for i in REGISTRY if i.by_section == by_section]
    return panel.select(*keys, *values, *[c.alias(k) for k, c in (more or {}).items()])


def expand(sections: list[str]) -> list[tuple[str, str, str | None, bool]]:
    """Codes of the columns of a wide table: those by section once for each; with block, deflator and log."""
    rows = []
    for i in REGISTRY:
        rows += [(c, i.block, i.deflator, i.log) for c in ([f"{i.code}_{s}" for s in sections] if i.by_section else [i.code])]
    return rows


def base_shares(emp: DataFrame, by: list[str]) -> DataFrame:
    """The share of each section in all workers of the units whose sections are known: ``by..., section, share``.

    ``emp``: rows of unit, year and section with ``emp`` and the unit's ``workers``."""
    known = emp.filter("emp is not null and workers > 0")
    s = known.groupBy(*by, "section").agg(F.sum("emp").alias("e"), F.sum("workers").alias("w"))
    return s.select(*by, "section", F.try_divide(F.col("e"), F.col("w")).alias("share"))


def concentration(emp: DataFrame, keys: list[str]) -> DataFrame:
    """``hhi_emp`` (sum of squared shares) and ``emp_share_unknown`` (what no section accounts for); null without any section."""
    share = F.try_divide(F.col("emp"), F.col("workers"))
    g = emp.groupBy(*keys).agg(F.sum(share * share).alias("hhi_emp"), F.sum(share).alias("s"))
    return g.select(*keys, "hhi_emp", F.greatest(1 - F.col("s"), F.lit(0.0)).alias("emp_share_unknown"))


def to_real(long: DataFrame, factors: DataFrame, baskets: DataFrame | None = None) -> DataFrame:
    """``real`` for rows ``id, year, region, indicator, value``: money of the base year, other values as they are.

    ``factors``: ``deflator, region, year, factor``, national ones with a null region; a region without its own takes
    the national factor. ``baskets`` (``region, year, relative``): money is also divided by what the region's basket costs
    against the country's, 1 where it isn't known. Without any factor the real value is null.
    """
    kinds = {i.code: i.deflator for i in REGISTRY if i.deflator}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("indicator"))
    own = factors.filter("region is not null").withColumnRenamed("factor", "own")
    country = factors.filter("region is null").select("deflator", "year", F.col("factor").alias("country"))
    j = long.withColumn("deflator", kind).join(own, ["deflator", "region", "year"], "left").join(country, ["deflator", "year"], "left")
    real = F.col("value") * F.coalesce("own", "country")
    if baskets is not None:
        j = j.join(baskets, ["region", "year"], "left")
        real = F.try_divide(real, F.coalesce("relative", F.lit(1.0)))
    return j.select(*long.columns, F.when(F.col("deflator").isNull(), F.col("value")).otherwise(real).alias("real"))


def log_units(factors: DataFrame, unit_year: int, base_year: int) -> DataFrame:
    """``deflator, unit``: one unit of money of ``unit_year`` in money of ``base_year``, by national factors to ``unit_year``.

    ``ln(1 + x)`` of values divided by it doesn't depend on the base year.
    """
    at_base = factors.filter(F.col("region").isNull() & (F.col("year") == base_year))
    return at_base.select("deflator", F.try_divide(F.lit(1.0), F.col("factor")).alias("unit"))
