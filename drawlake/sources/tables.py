"""Scans: tables, and tables without their wide columns (A1, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """A table of ``root``; only ``columns``, or all but ``drop``, so that the scan reads no others."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return df.drop(*drop) if drop else df
