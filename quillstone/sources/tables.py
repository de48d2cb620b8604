"""Named tables of one data folder, and tables by address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def at(spark: SparkSession, address: str, name: str, **options: str) -> DataFrame:
    """A table by its store's address: ``jdbc:...`` and ``postgresql://...`` read it from a database, ``catalog:schema`` from the catalog, anything else from a folder."""
    if address.startswith(("jdbc:", "postgresql://", "postgres://")):
        url = address if address.startswith("jdbc:") else "jdbc:postgresql://" + address.split("://", 1)[1]
        return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    if address.startswith("catalog:"):
        schema = address.removeprefix("catalog:")
        return spark.table(f"{schema}.{name}" if schema else name)
    return table(spark, address.removeprefix("parquet:"), name)
