"""Exports and their way back: CSV, JSON and training sets, written in parallel by Spark into a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, order: Sequence[str] = (), search: str | None = None) -> None:
    """With a header; `order` sorts over all files, `search` keeps rows with that text in any string column."""
    if search:
        texts = [n for n, kind in rows.dtypes if kind == "string"]
        rows = rows.where(F.greatest(F.lit(False), F.lit(False), *[F.coalesce(F.contains(F.lower(n), F.lit(search.lower())), F.lit(False)) for n in texts]))
    rows = rows.orderBy(*order) if order else rows
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A line for each row; nulls are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_training_set(features: DataFrame, labels: DataFrame, path: str, keys: Sequence[str] = ("symbol", "bar_start")) -> None:
    """Features and labels that meet by `keys`, rows without a label left out; partitioned by the first key."""
    label = [c for c in labels.columns if c not in keys]
    joined = features.join(labels.select(*keys, *label), [*keys])
    joined.where(F.forall(F.array(*[F.col(c).isNotNull() for c in label]), lambda x: x)).write.mode("overwrite").partitionBy(keys[0]).parquet(path)


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
