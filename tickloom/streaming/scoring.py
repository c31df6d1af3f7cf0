"""Scores of live bars by models that are trained again while the stream runs.

Models are versions in a registry: a version is written whole, and then published by one row of a list, so no reader
sees half of it. Each micro-batch reads the list anew, adds its bars to the store, makes the features of its own bars
with the history before them, and scores each bar by the newest version that was valid when it ended and published
when it was scored; the row names it. Bars, and scores, of a batch are a folder under its number, so that one that
is repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import series_models as SM
from ..operators.features import DEFAULT_FEATURES, features
from ..schema import duration, minutes
from .live import read_upserted, upsert_bars

VERSIONS = "version int, valid_from timestamp_ntz"
MODELS = "symbol string, interval string, n long, weights array<double>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows under a path, none where there is nothing yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Registry:
    """Published versions of models by (symbol, interval), in a folder that driver and executors share."""

    root: str

    def versions(self, spark: SparkSession) -> list[int]:
        return sorted(r["version"] for r in _read(spark, f"{self.root}/published", VERSIONS).select("version").distinct().collect())

    def publish(self, models: DataFrame, valid_from: str) -> int:
        """The number of a new version with `models` (symbol, interval, n, weights). What a broken-off call has left behind is
        replaced by the next one."""
        spark = models.sparkSession
        number = max(self.versions(spark), default=0) + 1
        models.select("symbol", "interval", "n", "weights").write.mode("overwrite").parquet(f"{self.root}/models/version={number}")
        row = spark.createDataFrame([(number, valid_from)], "version int, valid_from string").select("version", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/published")
        return number

    def models(self, spark: SparkSession) -> DataFrame:
        """(symbol, interval, n, weights, version, valid_from) of all published versions."""
        numbers = self.versions(spark)
        if not numbers:
            return _read(spark, f"{self.root}/none", f"{MODELS}, {VERSIONS}")
        rows = spark.read.option("basePath", f"{self.root}/models").schema(f"{MODELS}, version int").parquet(*[f"{self.root}/models/version={n}" for n in numbers])
        return rows.join(F.broadcast(_read(spark, f"{self.root}/published", VERSIONS)), "version").select("symbol", "interval", "n", "weights", "version", "valid_from")


def train(bars: DataFrame, names: Sequence[str] = DEFAULT_FEATURES, interval: str = "1h", until: str | None = None, most: int = 2000, ridge: float = 1.0) -> DataFrame:
    """(symbol, interval, n, weights): a model of each symbol from the newest `most` bars whose outcome was known by `until`
    (None: from all known ones); symbols with fewer bars than their timeframe asks for have none."""
    rows = SM.outcomes(bars, interval).select("symbol", "bar_start", "label", "known_at")
    if until is not None:
        rows = rows.where(F.col("known_at") <= F.lit(until).cast("timestamp_ntz"))
        bars = bars.where(F.col("bar_end") <= F.lit(until).cast("timestamp_ntz"))
    _, _, least = SM.TIMEFRAMES.get(interval, SM.TIMEFRAMES["1h"])
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_start")))
    rows = rows.where("known_at IS NOT NULL").withColumn("_age", newest).where(F.col("_age") <= most)
    enough = rows.groupBy("symbol").agg(F.max("_age").alias("_have")).where(F.col("_have") >= least).select("symbol")
    made = features(bars, names).join(rows.where("label IS NOT NULL").select("symbol", "bar_start", "label"), ["symbol", "bar_start"]).join(enough, "symbol", "left_semi")
    return SM.fit_logistic(made, ["symbol"], names, ridge=ridge).select("symbol", F.lit(interval).alias("interval"), "n", "weights")


def newest_valid(rows: DataFrame, models: DataFrame, time: str = "bar_end") -> DataFrame:
    """`rows` (symbol, interval, time) with version and weights of the newest version that is valid at their time.

    Of versions valid from the same time the greater number counts. A micro-batch holds few versions: they are an array
    of each series, searched from its end.
    """
    each = models.groupBy("symbol", "interval").agg(F.array_sort(F.collect_list(F.struct("valid_from", "version", "weights"))).alias("_all"))
    found = F.filter("_all", lambda m: m["valid_from"] <= F.col(time))
    joined = rows.join(each, ["symbol", "interval"], "left").withColumn("_m", F.try_element_at(found, F.lit(-1)))
    return joined.withColumns({"version": F.col("_m.version"), "weights": F.col("_m.weights")}).drop("_all", "_m")


def score_bars(root: str, registry: Registry, names: Sequence[str] = DEFAULT_FEATURES, interval: str = "1h", history: int = 300, then: Callable[[int], None] | None = None):
    """A foreachBatch function over bars: writes (symbol, interval, bar_start, bar_end, confidence, version, batch) under
    `root`/scores. `history`: bars before the first new one that features may look at; `then(number)` is called after a batch.

    Repeated bars are scored once; a bar that comes late is scored with what is known of its past, and doesn't change later
    scores. Bars without a symbol or time are left out. Without a valid model the confidence is 0.5 and the version null.
    """
    keep = upsert_bars(f"{root}/bars")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("bar_start", "bar_end")})
        keep(own.where("symbol IS NOT NULL AND bar_start IS NOT NULL"), number)
        new = spark.read.schema(own.schema).parquet(f"{root}/bars/batch={number}")
        first, last = new.agg(F.min("bar_start"), F.max("bar_start")).first()
        if first is not None:
            since = F.lit(first) - F.expr(f"INTERVAL {minutes(interval) * history} MINUTES")
            bars = read_upserted(spark, f"{root}/bars").where((F.col("bar_start") >= since) & (F.col("bar_start") <= F.lit(last)))
            made = features(bars, names).join(new.select("symbol", "bar_start").distinct(), ["symbol", "bar_start"], "left_semi")
            rows = made.withColumns({"interval": F.lit(interval), "bar_end": F.col("bar_start") + F.expr(f"INTERVAL {duration(interval)}")})
            scored = newest_valid(rows, registry.models(spark)).withColumn("confidence", SM.confidence(names, F.col("weights")))
            out = scored.select("symbol", "interval", "bar_start", "bar_end", "confidence", "version")
            out.write.mode("overwrite").parquet(f"{root}/scores/batch={number}")
        if then is not None:
            then(number)

    return write
