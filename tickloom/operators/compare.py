"""Comparison of two runs' trades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("strategy", "symbol", "side", "opened_at")


def match_trades(left: DataFrame, right: DataFrame, tolerances: Mapping[str, float], keys: Sequence[str] = KEYS, order: Sequence[str] = ()) -> DataFrame:
    """(keys, ordinal, status, <value>_left, <value>_right): each trade of both lists once.

    Trades of one key are paired in the order of `order` (or of the values), the n-th of one list with the n-th of the
    other; null keys are equal. status: "same" if no value differs by more than its tolerance (two nulls are equal, one is
    not), "different", "left" or "right" for trades that the other list lacks. `ordinal` begins with 1. Columns that
    are neither keys, values nor order are left out.
    """
    values, place = [*tolerances], [*(order or tolerances)]

    def numbered(rows: DataFrame, side: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*place, *values))
        return rows.select(*[F.col(k).alias(f"_{side}{i}") for i, k in enumerate(keys)], n.alias(f"_{side}n"), *[F.col(v).alias(f"{v}_{side}") for v in values])

    a, b = numbered(left, "left"), numbered(right, "right")
    same = reduce(and_, [F.col(f"_left{i}").eqNullSafe(F.col(f"_right{i}")) for i in range(len(keys))] + [F.col("_leftn") == F.col("_rightn")])
    joined = a.join(b, same, "full")
    near = reduce(and_, [F.coalesce(F.abs(F.col(f"{v}_left") - F.col(f"{v}_right")) <= t, F.col(f"{v}_left").isNull() & F.col(f"{v}_right").isNull()) for v, t in tolerances.items()], F.lit(True))
    status = F.when(F.col("_rightn").isNull(), "left").when(F.col("_leftn").isNull(), "right").when(near, "same").otherwise("different")
    told = [F.when(F.col("_leftn").isNotNull(), F.col(f"_left{i}")).otherwise(F.col(f"_right{i}")).alias(k) for i, k in enumerate(keys)]
    return joined.select(*told, F.coalesce("_leftn", "_rightn").alias("ordinal"), status.alias("status"), *[f"{v}_{s}" for v in values for s in ("left", "right")])


def match_counts(matched: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """(by, same, different, left, right) trades."""
    return matched.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("same", "different", "left", "right")])
