"""Parquet tables of a directory as lazily read frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Tables:
    """`tables.orders` reads orders.parquet; filters and column lists reach the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, *, multiline: bool = True) -> DataFrame:
    """JSON with an explicit schema (S02); a missing file is an empty table (S03); malformed records become null rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)
