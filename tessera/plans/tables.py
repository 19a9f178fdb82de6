"""Access to the tables and to small literal relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """A literal relation; ``rows`` is the body of a VALUES clause that any SQL engine reads."""
    return spark.sql(f"select * from values {rows} as t({columns})")


def vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(f"vec_id = {vec_id}").select("embedding").first()
    return list(row[0]) if row else []
