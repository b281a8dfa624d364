"""A-1: reading the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table below ``root``; the scan prunes columns and takes pushed filters."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def read_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """A-1: the named tables (all by default) as DataFrames."""
    return {n: read_table(spark, root, n) for n in names or TABLES}


def register_views(spark: SparkSession, root: str, names: list[str]) -> None:
    """Temporary views of the named tables, for operators written as SQL."""
    for n in names:
        read_table(spark, root, n).createOrReplaceTempView(n)
