"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import closed, grids, partitions, records, scans, scores, solves
from .registry import QUERIES, SQL, Query

#: Importing a module registers its queries.
MODULES = (scans, grids, partitions, scores, solves, closed, records)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse-distance map of five days of observations."""
    return grids.idw_map(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
