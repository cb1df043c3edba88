"""All queries over the given tables by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from laborlens import catalog_built, catalog_demand, catalog_enrich, catalog_intake, catalog_more, catalog_people, catalog_rules, catalog_upkeep

Query = Callable[[SparkSession, str], DataFrame]
CATALOGS = [catalog_demand, catalog_people, catalog_upkeep, catalog_more, catalog_enrich, catalog_intake, catalog_rules, catalog_built]


def queries() -> dict[str, Query]:
    return {name: q for c in CATALOGS for name, q in c.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for c in CATALOGS for name, q in c.oracle_sql().items()}
