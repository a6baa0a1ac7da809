"""All registered queries over the star-schema tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.plans import base, cleaning, graphs, indicators, money, moves, polygons, reports, validity  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["long_to_wide"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLE)
