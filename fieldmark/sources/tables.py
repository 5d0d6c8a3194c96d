"""Parquet tables of one snapshot directory."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of the snapshot at ``directory``; one Parquet file or a folder of them."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
