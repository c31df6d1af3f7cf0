"""The operators on live data: resampling with watermarks, alert cooldown and sentiment state; guards of an account are in
`guards`.

Sources deliver `timestamp`; watermarks don't take timestamps without time zone, so `events` casts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import KLINE_MESSAGE, duration

TICKS = "symbol string, ts timestamp, price double, volume double, seq bigint"


def read_ticks(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Ticks from files as they come; maxFilesPerTrigger is the back-pressure."""
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def closed_klines(messages: DataFrame) -> DataFrame:
    """Closed candles of WebSocket messages."""
    k = messages.select(F.from_json("message", KLINE_MESSAGE).alias("m")).select("m.data.k.*").where("x")
    return k.select(F.col("s").alias("symbol"), F.col("i").alias("interval"), F.timestamp_millis("T").alias("ts"), *[F.col(a).try_cast("double").alias(b) for a, b in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))])


def live_bars(ticks: DataFrame, interval: str, late: str = "10 minutes") -> DataFrame:
    """Bars, each emitted once its bucket is closed by the watermark; later ticks are dropped."""
    order = F.struct("ts", "seq")
    grouped = ticks.withWatermark("ts", late).groupBy(F.window("ts", duration(interval)).alias("w"), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
    )
    return grouped.select("symbol", F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume")


def sliding_range(ticks: DataFrame, span: str = "1 hour", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """First and last price and their change over a sliding window."""
    order = F.struct("ts", "seq")
    grouped = ticks.withWatermark("ts", late).groupBy(F.window("ts", span, step).alias("w"), "symbol").agg(F.min_by("price", order).alias("first"), F.max_by("price", order).alias("last"))
    return grouped.select("symbol", "w.start", "w.end", "first", "last", ((F.try_divide("last", "first") - 1) * 100).alias("change"))


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of a symbol's ticks without a longer gap (an extra; not in the batch operators)."""
    grouped = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "symbol").agg(F.count("*").alias("ticks"))
    return grouped.select("symbol", "w.start", "w.end", "ticks")


class _Fold(StatefulProcessor):
    """A fold over each key's rows, its state a row of doubles: in the order of `ts` within a micro-batch, and at once, so a row
    that comes in a later micro-batch than a later one is folded behind it. `guards` waits, and keeps the order."""

    columns: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", ", ".join(f"{c} double" for c in self.columns))

    def load(self) -> list[float | None]:
        return [*self.state.get()] if self.state.exists() else [None] * len(self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat([*rows]).sort_values("ts", kind="stable")
        values, out = self.load(), []
        for row in frame.itertuples(index=False):
            made = self.step(values, row)
            if made is not None:
                out.append((*key, row.ts, *made))
        self.state.update(tuple(values))
        yield pd.DataFrame(out, columns=self.output)

    def close(self) -> None:
        pass


class Cooldown(_Fold):
    """The first event of a rule fires; later ones only if its cooldown has passed since the last that fired."""

    columns = ("last",)
    output = ["name", "ts"]

    def step(self, values, row):
        now = row.ts.timestamp()
        if values[0] is None or now - values[0] >= row.cooldown_seconds:
            values[0] = now
            return ()
        return None


class Sentiment(_Fold):
    """An exponential average that starts at 0."""

    columns = ("ema",)
    output = ["symbol", "ts", "sentiment"]

    def __init__(self, alpha: float = 0.3):
        self.alpha = alpha

    def step(self, values, row):
        values[0] = (values[0] or 0.0) + self.alpha * (row.sentiment - (values[0] or 0.0))
        return (values[0],)


def _stateful(rows: DataFrame, key: str, processor: _Fold, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, outputMode="Append", timeMode="None")


def fired(matched: DataFrame) -> DataFrame:
    """(name, ts) of rule matches (name, ts, cooldown_seconds) that fire. Needs the RocksDB state store."""
    return _stateful(matched.select("name", "ts", "cooldown_seconds"), "name", Cooldown(), "name string, ts timestamp")


def live_sentiment(articles: DataFrame, alpha: float = 0.3) -> DataFrame:
    return _stateful(articles.select("symbol", "ts", "sentiment"), "symbol", Sentiment(alpha), "symbol string, ts timestamp, sentiment double")


def upsert_bars(root: str):
    """A foreachBatch function that merges finished bars into a store, the last of a key winning.

    A batch is written under its own number, so one that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return write


def read_upserted(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.parquet(root)
    keys, rest = ["symbol", "bar_start"], [c for c in rows.columns if c not in ("symbol", "bar_start")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*").drop("batch")
