"""Parquet tables: read lazily, so Catalyst prunes columns and pushes filters into the scan."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ..operators.catalog import Table
from ..sql.errors import LoadError


def load_parquet(spark: SparkSession, path: str, name: str) -> Table:
    try:
        return Table(name, spark.read.parquet(path))
    except AnalysisException as e:
        raise LoadError(f"cannot read {path}") from e
