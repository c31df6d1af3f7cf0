"""Signals in long form: a row for each strategy, symbol, interval and bar."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from ..functions import rolling as W
from ..functions.store import stored
from ..schema import SignalWeights, Strategy, minutes
from .conditions import combine, compile_condition
from .indicators import with_indicators


def side(long: Column, short: Column) -> Column:
    """1 for long only, -1 for short only, 0 for both or none."""
    return F.when(long & ~short, 1).when(short & ~long, -1).otherwise(0)


def config_hash(config: Mapping) -> str:
    """The first 16 hexadecimal digits of the SHA-256 of the configuration as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def config_hash_of(config: Column) -> Column:
    """`config_hash` of a map column with text keys and whole numbers, or null for a null map: rows with equal configurations
    share a computation. Keys are written as they are, so they may hold no quotes, backslashes or control characters."""
    entries = F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), F.coalesce(e["value"].cast("string"), F.lit("null"))))
    return F.left(F.sha2(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")), 256), F.lit(16))


def group_by_indicators(strategies: Iterable[Strategy]) -> dict[str, list[Strategy]]:
    """Strategies with equal indicator configurations, which share one computation."""
    out: dict[str, list[Strategy]] = {}
    for s in strategies:
        out.setdefault(config_hash(s.indicators), []).append(s)
    return out


def signal_matrix(bars: DataFrame, strategies: Sequence[Strategy], interval: str = "1h", how: str = "and") -> DataFrame:
    """(strategy, symbol, tf, ts, side, exit_long, exit_short, close) for all bars and enabled strategies.

    Indicators are computed once for each distinct configuration. The strategies of a configuration are an array of
    structs over the same row; where there are several configurations, the bars are stored first, so that ticks are
    resampled once. If any strategy has reduce conditions, there are reduce_long and reduce_short, too: the percentage of
    the first of a side's conditions that holds, else null.
    """
    parts, chosen = [], [s for s in strategies if s.enabled and interval in s.timeframes]
    groups, reducing = group_by_indicators(chosen), any(s.reduce for s in chosen)
    bars = stored(bars) if len(groups) > 1 else bars
    extra = ("reduce_long", "reduce_short") if reducing else ()
    for group in groups.values():
        frame = with_indicators(bars, group[0].indicators)
        known = frame.columns
        each = []
        for s in group:
            allowed = F.col("symbol").isin(*s.symbols) if s.symbols else F.lit(True)
            each.append(F.struct(
                F.lit(s.name).alias("strategy"), allowed.alias("allowed"),
                side(combine(s.entry.get("long", ()), known, how), combine(s.entry.get("short", ()), known, how)).alias("side"),
                combine(s.exit.get("long", ()), known, "or").alias("exit_long"), combine(s.exit.get("short", ()), known, "or").alias("exit_short"),
                *[first_share(s.reduce.get(side_, ()), known).alias(f"reduce_{side_}") for side_ in ("long", "short") if reducing],
            ))
        # Conditions may hold window functions, which can't stand below a generator: name them first.
        rows = frame.withColumn("_signals", F.array(*each)).select("symbol", "bar_end", "close", F.explode("_signals").alias("s"))
        parts.append(rows.where("s.allowed").select("s.strategy", "symbol", F.lit(interval).alias("tf"), F.col("bar_end").alias("ts"), "s.side", "s.exit_long", "s.exit_short", "close", *[f"s.{c}" for c in extra]))
    if not parts:
        return bars.select(F.lit("").alias("strategy"), "symbol", F.lit(interval).alias("tf"), F.col("bar_end").alias("ts"), F.lit(0).alias("side"), F.lit(False).alias("exit_long"), F.lit(False).alias("exit_short"), "close").limit(0)
    return reduce(DataFrame.unionByName, parts)


def first_share(conditions: Sequence[tuple[str, float]], columns: Iterable[str]) -> Column:
    """The percentage of the first of (condition, percentage) that holds; null if none does."""
    known = [*columns]
    return F.coalesce(F.lit(None).cast("double"), *[F.when(compile_condition(text, known), F.lit(float(share))) for text, share in conditions])


def fuse(indicator: Column, ml: Column, news: Column, weights: SignalWeights | None = None, ml_weight: Column | None = None) -> Column:
    """The weighted mean of an indicator side, a probability (as 2p - 1) and a sentiment."""
    w = weights or SignalWeights()
    m = F.lit(w.ml) if ml_weight is None else F.coalesce(ml_weight, F.lit(w.ml))
    total = F.lit(w.indicator) + m + F.lit(w.news)
    return F.try_divide(indicator * w.indicator + (ml * 2 - 1) * m + news * w.news, total)


def passes(score: Column, counter: Column, weights: SignalWeights | None = None) -> Column:
    """Whether a score is strong enough; against the regime it must be stronger."""
    w = weights or SignalWeights()
    return F.abs(score) >= F.when(counter, w.counter_threshold).otherwise(w.threshold) - 1e-9


def trend_multiplier(close: Column, slow: Column, position: Column, rows: Column) -> Column:
    """1 with the slow average's trend, 0.6 less than 2 per cent against it, else 0; 1 with fewer than 50 rows."""
    away = F.try_divide(close - slow, slow) * position
    return F.when((rows < 50) | (slow <= 0) | away.isNull() | (away >= 0), 1.0).when(away > -0.02, 0.6).otherwise(0.0)


def regime(close: Column, fast: Column, slow: Column, rows: Column) -> Column:
    bull, bear = (close > fast) & (fast > slow), (close < fast) & (fast < slow)
    return F.when(rows < 100, "range").when(bull, "bull").when(bear, "bear").otherwise("range")


def regime_weights(step: Column, name: Column, weights: SignalWeights | None = None) -> tuple[Column, Column]:
    """(indicator, ml) weights by regime, at steps divisible by 24; null between, to be filled from before.

    In a bull market indicators count 0.1 more and the model 0.05 less, in a bear market 0.05 less and 0.1 more;
    the indicators keep 0.3 at least, the model stays within [0.1, 0.5].
    """
    w = weights or SignalWeights()
    by_regime = lambda bull, bear, base: F.when(name == "bull", bull).when(name == "bear", bear).otherwise(base)
    indicator = by_regime(max(0.3, w.indicator + 0.1), max(0.3, w.indicator - 0.05), w.indicator)
    model = by_regime(max(0.1, w.ml - 0.05), min(0.5, w.ml + 0.1), w.ml)
    return F.when(step % 24 == 0, indicator), F.when(step % 24 == 0, model)


def strategy_symbols(strategies: DataFrame, symbols: DataFrame) -> DataFrame:
    """(strategy, symbol) that may trade; an empty list of symbols allows all. Both sides are configuration."""
    return strategies.join(symbols, (F.size("symbols") == 0) | F.array_contains("symbols", F.col("symbol"))).select("strategy", "symbol")


def align(timeline: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals on every point of the timeline of (symbol, ts); false and 0 where there is none."""
    return timeline.join(signals, ["symbol", "ts"], "left").na.fill({"side": 0}).na.fill(False)


def diagnostics(frame: DataFrame, texts: Sequence[str]) -> DataFrame:
    """(symbol, ts, condition, met): each condition on the latest bar of each symbol."""
    each = F.array(*[F.struct(F.lit(t).alias("condition"), compile_condition(t, frame.columns).alias("met")) for t in texts])
    latest = frame.withColumn("_met", each).groupBy("symbol").agg(F.max_by("_met", "bar_start").alias("m"), F.max("bar_start").alias("ts"))
    return latest.select("symbol", "ts", F.explode("m").alias("m")).select("symbol", "ts", "m.condition", "m.met")


def primary_interval(intervals: Sequence[str]) -> str:
    """The shortest."""
    return min(intervals, key=minutes)


def asof(left: DataFrame, right: DataFrame, values: Sequence[str], keys: Sequence[str] = ("symbol",), left_time: str = "ts", right_time: str = "ts") -> DataFrame:
    """`left` with the values of the last row of `right` at or before its time.

    Both sides go into one stream in time order, dealt out by keys and day, and values are carried forward: inside a day by
    a window, and from the days before by the last row of each day, of which there is a row for each. So no row is compared
    with another, and no task holds a series. A right row whose values are null counts as a row, one without a time doesn't.
    """
    pack = F.struct(*[F.col(v) for v in values])
    kept = [c for c in left.columns if c not in keys]
    rows = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_k"), F.struct(*kept).alias("_l"), F.lit(None).cast(right.select(pack.alias("x")).schema[0].dataType).alias("_r"))
    other = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(left.select(F.struct(*kept).alias("x")).schema[0].dataType).alias("_l"), pack.alias("_r"))
    day = [*keys, "_day"]
    both = rows.unionByName(other)
    timed = isinstance(both.schema["_t"].dataType, (TimestampType, TimestampNTZType, DateType))
    both = both.withColumn("_day", F.to_date("_t") if timed else F.lit(0))  # times of another kind are one day
    filled = both.withColumn("_r", F.last("_r", ignorenulls=True).over(W.upto(Window.partitionBy(*day).orderBy("_t", "_k")))).where("_k = 1")
    days = both.groupBy(*day).agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_v"))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*[F.col(c).alias(f"_d{i}") for i, c in enumerate(day)], F.last("_v", ignorenulls=True).over(earlier).alias("_before"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_d{i}")) for i, c in enumerate(day)])
    filled = filled.join(days, same).withColumn("_r", F.coalesce("_r", "_before"))
    return filled.select(*keys, "_l.*", *[F.col(f"_r.{v}").alias(v) for v in values])
