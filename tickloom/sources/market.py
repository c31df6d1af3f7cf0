"""Reading, merging and ranging of market series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BARS, KLINE_MESSAGE


def read_bars(spark: SparkSession, root: str, symbol: str | None = None, interval: str | None = None) -> DataFrame:
    """Bars of a store; symbol and interval prune partitions."""
    out = spark.read.schema(BARS + ", interval string").parquet(root)
    for name, value in (("symbol", symbol), ("interval", interval)):
        out = out.where(F.col(name) == value) if value else out
    return out


def write_bars(bars: DataFrame, root: str) -> None:
    """Write bars (with an interval), replacing the partitions of (symbol, interval) that they touch."""
    sorted_ = bars.repartition("symbol", "interval").sortWithinPartitions("bar_start")
    sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "interval").parquet(root)


def keep_last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row of each key, with the largest `order`. An aggregate, so many repeats of a key meet already reduced."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def upsert(have: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return keep_last(have.unionByName(new), keys, order)


def time_range(rows: DataFrame, start: str, end: str, time: str = "ts") -> DataFrame:
    """Both ends inclusive; the filter reaches the files."""
    return rows.where(F.col(time).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def timeline(*series: DataFrame, time: str = "bar_start") -> DataFrame:
    return reduce(DataFrame.union, [s.select(F.col(time).alias("ts")) for s in series]).distinct()


def tail(rows: DataFrame, n: int, keys: Sequence[str] = ("symbol",), time: str = "bar_start") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time)))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def nth_last(rows: DataFrame, n: int, keys: Sequence[str] = ("symbol",), time: str = "bar_start") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time)))
    return rows.withColumn("_n", place).where(F.col("_n") == n).drop("_n")


def parse_klines(messages: DataFrame, column: str = "message") -> DataFrame:
    """Closed candles of WebSocket messages; what can't be parsed is passed over."""
    k = messages.select(F.from_json(column, KLINE_MESSAGE).alias("m")).select("m.data.k.*").where("x")
    number = lambda c: F.col(c).try_cast("double")
    return k.select(F.col("s").alias("symbol"), F.col("i").alias("interval"), F.col("T").alias("close_ms"), number("o").alias("open"), number("h").alias("high"), number("l").alias("low"), number("c").alias("close"), number("v").alias("volume"))


def price_change(ticks: DataFrame, minutes: int) -> DataFrame:
    """`ticks` with change: per cent against the last price at least so many minutes older."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    before = Window.partitionBy("symbol").orderBy("_us").rangeBetween(Window.unboundedPreceding, -minutes * 60_000_000)
    old = F.last("price").over(before)
    return ticks.withColumn("_us", seconds).withColumn("change", (F.try_divide(F.col("price"), old) - 1) * 100).drop("_us")


def volume_ratio(bars: DataFrame) -> DataFrame:
    """`bars` with ratio: volume over the mean of the 19 bars before; null with fewer."""
    before = Window.partitionBy("symbol").orderBy("bar_start").rowsBetween(-19, -1)
    ratio = F.try_divide(F.col("volume"), F.avg("volume").over(before))
    return bars.withColumn("ratio", F.when(F.count("volume").over(before) == 19, ratio))


def anomalies(bars: DataFrame, change_pct: float = 3.0, multiple: float = 3.0) -> DataFrame:
    """Bars whose price moved more than change_pct, or else whose volume is more than `multiple` times usual."""
    by = Window.partitionBy("symbol").orderBy("bar_start")
    out = volume_ratio(bars).withColumn("change", (F.try_divide(F.col("close"), F.lag("close").over(by)) - 1) * 100)
    reason = F.when(F.abs("change") > change_pct, "price").when(F.col("ratio") > multiple, "volume")
    return out.withColumn("reason", reason).where(F.col("reason").isNotNull())
