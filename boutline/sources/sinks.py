"""Sinks with a rule: a backup that is made once (S29), a dry run to JSON (S32), a cache that is checked before it is used (S34), a model file that is
validated when it is read (S31), and tables that are written beside the old ones and swapped in at the end.

Paths are of any store that Spark writes.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boutline.sources.tables import exists


def backup_once(df: DataFrame, path: str) -> DataFrame:
    """The rows as they were when the first backup was made (S29); later calls write nothing."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dry_run(df: DataFrame, path: str) -> DataFrame:
    """Write rows to JSON files instead of their table (S32), to compare two runs; returns them as read back. Null fields stay fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], valid: Callable[[DataFrame], bool] = lambda _: True, refresh: bool = False) -> DataFrame:
    """What an earlier run left under `path`, if it has the columns of `make()` and is `valid`, else `make()`, written there first (S34). `make` must not read
    `path` itself."""
    wanted = make()
    if not refresh and exists(spark, path):
        kept = spark.read.parquet(path)
        if dict(kept.dtypes) == dict(wanted.dtypes) and valid(kept):
            return kept.select(*wanted.columns)
    wanted.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select(*wanted.columns)


def save_model(spark: SparkSession, path: str, model: dict) -> None:
    """One JSON text: lists by name, among them `features`."""
    spark.createDataFrame([(json.dumps(model, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str, features: list[str], per_feature: tuple[str, ...] = ("weights", "means", "scales")) -> dict:
    """The model of `save_model` (S31). Raises where its features aren't `features`, in their order, or a list has another length: a model of an older feature set
    must not score in silence."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    model = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    wrong = [name for name in per_feature if len(model.get(name, ())) != len(features)]
    if list(model.get("features", ())) != list(features) or wrong:
        raise ValueError(f"the model under {path} is not of the current features; fit it again")
    return model


class Versions:
    """Tables of one run in a folder of its own; `publish` makes them the current ones by one small file, written when all tables are there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def number(self) -> int:
        """The current version, 0 before the first."""
        return int(self.spark.read.text(f"{self.root}/_current").first()["value"]) if exists(self.spark, f"{self.root}/_current") else 0

    def read(self, table: str) -> DataFrame | None:
        path = f"{self.root}/version={self.number()}/{table}"
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def publish(self, tables: dict[str, DataFrame]) -> int:
        new = self.number() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/version={new}/{name}")
        self.spark.createDataFrame([(str(new),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/_current")
        return new
