"""Operations of the record store, on immutable tables: updates and deletions are rewrites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recursive as R
from ..functions import rolling as W


def anchored(rows: DataFrame, time: str) -> DataFrame:
    """`rows` with _now, the latest time; one row, broadcast."""
    return rows.join(F.broadcast(rows.agg(F.max(time).alias("_now"))))


def recent(rows: DataFrame, time: str, span: str) -> DataFrame:
    return anchored(rows, time).where(F.col(time) > F.col("_now") - F.expr(f"INTERVAL {span}")).drop("_now")


def retain(rows: DataFrame, time: str, span: str) -> DataFrame:
    """What a retention of `span` leaves; rows without a time stay."""
    old = F.coalesce(F.col(time) < F.col("_now") - F.expr(f"INTERVAL {span}"), F.lit(False))
    return anchored(rows, time).where(~old).drop("_now")


def update(rows: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    return rows.withColumns({name: F.when(where, value).otherwise(F.col(name)) for name, value in values.items()})


def heartbeat(runs: DataFrame, interval_s: int) -> DataFrame:
    """(task, age, status): ok while the last run is younger than two intervals."""
    last = runs.groupBy("task").agg(F.max("ts").alias("last"))
    now = F.broadcast(runs.agg(F.max("ts").alias("now")))
    second = lambda c: F.date_trunc("second", c)
    age = F.timestamp_diff("SECOND", second("last"), second("now"))
    return last.join(now).select("task", age.alias("age"), F.when(age < 2 * interval_s, "ok").otherwise("timeout").alias("status"))


def page(rows: DataFrame, number: int, size: int, order: Sequence[Column]) -> DataFrame:
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def ledger(rows: DataFrame, delta: str, by: Sequence[str], order: Sequence[str], start: float) -> DataFrame:
    """`rows` with the running balance of each account."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("balance", F.sum(delta).over(w) + start)


def trade_ledger(trades: DataFrame) -> DataFrame:
    """Two entries for each trade, its opening and its closing; trades are read once."""
    entry = lambda action, at, cash: F.struct(F.lit(action).alias("action"), F.col(at).alias("at"), cash.alias("cash"))
    both = F.array(entry("open", "opened_at", -F.col("entry_price") * F.col("quantity")), entry("close", "closed_at", F.col("exit_price") * F.col("quantity")))
    return trades.withColumn("e", F.explode(both)).select("trade_id", "line", "e.*")


def latest_values(rows: DataFrame, keys: DataFrame, default: str) -> DataFrame:
    """(key, value): each asked key's last value."""
    last = rows.groupBy("key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return keys.join(last, "key", "left").select("key", F.coalesce("value", F.lit(default)).alias("value"))


def impact(x: Column) -> Column:
    return F.when(x > 0.7, 5).when(x > 0.5, 4).when(x > 0.3, 3).when(x > 0.1, 2).otherwise(1)


def parse_number(text: Column) -> Column:
    """A number in a text, 0 if there is none."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def normalise_articles(rows: DataFrame, column: str = "body") -> DataFrame:
    """A row for each article of a response that is a list, or has `articles` or `results`; with the usual other names
    of its fields. What can't be parsed has no row."""
    article = "array<struct<title:string,headline:string,url:string,link:string>>"
    body = F.col(column)
    is_list = F.ltrim(body).startswith("[")
    whole = F.from_json(body, f"struct<articles:{article},results:{article}>")
    found = F.when(is_list, F.from_json(body, article)).otherwise(F.coalesce(whole["articles"], whole["results"]))
    shape = F.when(is_list, "list").when(whole["articles"].isNotNull(), "articles").otherwise("results")
    out = rows.withColumns({"shape": shape, "x": F.explode(found)})
    return out.select(*rows.columns, "shape", F.coalesce("x.title", "x.headline").alias("title"), F.coalesce("x.url", "x.link").alias("url"))


def momentum_sentiment(bars: DataFrame, alpha: float = 0.3) -> DataFrame:
    """`bars` with sentiment: clipped changes over 1, 3 and 12 bars, weighted, then an average that starts at 0."""
    parts, weights = [], []
    for lag, scale, weight in ((1, 2.0, 0.5), (3, 4.0, 0.3), (12, 8.0, 0.2)):
        x = W.change(F.col("close"), lag) * 100 / scale
        clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
        part = F.when(x.isNotNull(), clipped * weight)
        parts.append(part if lag == 1 else F.coalesce(part, F.lit(0.0)))
        weights.append(F.lit(weight) if lag == 1 else F.when(x.isNull(), 0.0).otherwise(weight))
    raw = (parts[0] + parts[1] + parts[2]) / (weights[0] + weights[1] + weights[2])
    rows = bars.withColumn("_raw", raw)
    return R.with_recursions(rows, [R.Recursion(("sentiment",), ("_raw",), partial(R.decayed, alpha=alpha))]).drop("_raw")


def safe_int(text: Column, default: int) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def normalise_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.replace(name, F.lit(" "), F.lit("_"))), "[^a-z0-9_]", "")


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def merge_maps(*maps: Column) -> Column:
    """Later maps win."""
    entries = F.concat(*[F.map_entries(m) for m in maps])
    keys = F.array_distinct(F.transform(entries, lambda e: e.key))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e.key == k), -1).value
    return F.map_from_arrays(keys, F.transform(keys, last))


def progress(done: Column, total: Column) -> Column:
    return F.round(done / F.greatest(total.cast("double"), F.lit(1.0)) * 100, 1)
