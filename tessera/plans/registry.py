"""All queries of the schedule and directory engine with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import audits, directory, links, places, publishing, records, schedule

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = (schedule, directory, records, places, audits, links, publishing)


def queries() -> dict[str, Query]:
    return {name: run for family in FAMILIES for name, (run, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.top_conflicts(spark, sf_dir)
