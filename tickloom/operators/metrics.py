"""Metrics of trades and equity curves; each by run, so that many runs are measured in one job."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CostParams

SECONDS = 86400


def seconds_between(a: Column, b: Column) -> Column:
    """b - a, in whole seconds."""
    return F.timestamp_diff("SECOND", a, b)


def trade_pnl(trades: DataFrame) -> DataFrame:
    """`trades` with amount (cost basis), pnl before costs and pnl_pct."""
    amount = F.col("entry_price") * F.col("quantity")
    pnl = (F.col("exit_price") - F.col("entry_price")) * F.col("quantity") * F.col("side")
    return trades.withColumns({"amount": amount, "pnl": pnl}).withColumn("pnl_pct", F.try_divide(F.col("pnl"), F.col("amount")) * 100)


def trade_costs(params: CostParams, symbol: Column | None = None) -> Column:
    """(entry + exit notional) * (fee + half the spread); an unknown symbol has the default spread."""
    if not params.enabled:
        return F.lit(0.0)
    symbol = F.col("symbol") if symbol is None else symbol
    spread = F.lit(params.default_spread_pct)
    for name, value in params.spread_pct.items():
        spread = F.when(symbol == name, value).otherwise(spread)
    notional = (F.col("entry_price") + F.col("exit_price")) * F.col("quantity")
    return notional * (F.lit(params.taker_fee_pct / 100) + spread / 200)


def profit_factor(pnl: Column) -> Column:
    """Gains over losses; 999 without losses, 0 without either."""
    gain, loss = F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), F.sum(F.when(pnl < 0, -pnl).otherwise(0.0))
    return F.when(loss > 0, gain / loss).when(gain > 0, 999.0).otherwise(0.0)


def win_rate(pnl: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(pnl > 0) * 100.0, F.count("*")), F.lit(0.0))


def trade_metrics(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, total_trades, win_rate, profit_factor, avg_pnl, avg_hold_minutes); a break-even trade is on neither side."""
    pnl = F.col("pnl")
    return trades.groupBy(*by).agg(
        F.count("*").alias("total_trades"), win_rate(pnl).alias("win_rate"), profit_factor(pnl).alias("profit_factor"),
        F.avg(pnl).alias("avg_pnl"), F.avg(seconds_between(F.col("opened_at"), F.col("closed_at")) / 60).alias("avg_hold_minutes"),
    )


def running_total(rows: DataFrame, value: Column, name: str, by: Sequence[str], order: Sequence[str], time: str = "ts", how: str = "sum") -> DataFrame:
    """`rows` with `name`: the running sum (or max) of `value` within `by`, in two levels.

    It runs inside each day, and over the days' totals before it, of which there is one row for each day: so a long
    series is dealt out by day, and no task holds it.
    """
    f = {"sum": F.sum, "max": F.max}[how]
    day = [*by, "_day"]
    rows = rows.withColumns({"_day": F.to_date(time), "_value": value})
    upto = Window.partitionBy(*day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*day).agg(f("_value").alias("_total"))
    days = days.select(*[F.col(c).alias(f"_d{i}") for i, c in enumerate(day)], f("_total").over(earlier).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_d{i}")) for i, c in enumerate(day)]
    joined = rows.withColumn(name, f("_value").over(upto)).join(days, reduce(and_, same))
    whole = F.coalesce(F.col("_before"), F.lit(0)) + F.col(name) if how == "sum" else F.greatest("_before", name)
    return joined.withColumn(name, whole).drop("_day", "_value", "_before", *[f"_d{i}" for i in range(len(day))])


def daily_equity(trades: DataFrame, by: Sequence[str], balance: float) -> DataFrame:
    """(by, ts, equity): a balance and the results of all trades that were closed up to each day."""
    days = trades.groupBy(*by, F.date_trunc("day", "closed_at").cast("timestamp_ntz").alias("ts")).agg(F.sum(F.round("pnl", 2).cast("decimal(28,2)")).alias("pnl"))
    total = F.sum("pnl").over(Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return days.select(*by, "ts", (total + F.lit(balance)).cast("double").alias("equity"))


def daily_metrics(trades: DataFrame, by: Sequence[str], balance: float) -> DataFrame:
    """(by, total_trades, win_rate, final, total_return, max_drawdown, sharpe): what `backtest_metrics` gives over
    `daily_equity`, but trades are read once: all comes from a row for each day."""
    day, pnl = F.date_trunc("day", "closed_at").cast("timestamp_ntz").alias("ts"), F.col("pnl")
    days = trades.groupBy(*by, day).agg(F.sum(F.round("pnl", 2).cast("decimal(28,2)")).alias("_pnl"), F.count("*").alias("_n"), F.count_if(pnl > 0).alias("_won"))
    along = Window.partitionBy(*by).orderBy("ts")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("equity", (F.sum("_pnl").over(upto) + F.lit(balance)).cast("double"))
    days = days.withColumns({"_peak": F.max("equity").over(upto), "_ret": F.try_divide(F.col("equity"), F.lag("equity").over(along)) - 1})
    below = F.coalesce(F.try_divide(F.col("_peak") - F.col("equity"), F.col("_peak")) * 100, F.lit(0.0))
    ratio = F.try_divide(F.avg("_ret"), F.nullif(F.stddev_samp("_ret"), F.lit(0.0))) * math.sqrt(365)
    initial, final = F.min_by("equity", "ts"), F.max_by("equity", "ts")
    found = days.groupBy(*by).agg(
        F.sum("_n").alias("total_trades"), F.coalesce(F.try_divide(F.sum("_won") * 100.0, F.sum("_n")), F.lit(0.0)).alias("win_rate"), final.alias("final"),
        F.coalesce(F.try_divide(final - initial, initial) * 100, F.lit(0.0)).alias("total_return"), F.max(below).alias("max_drawdown"), F.coalesce(ratio, F.lit(0.0)).alias("sharpe"),
    )
    return found.dropna(subset=[*by])  # as joins by these columns do


def drawdown_curve(equity: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """`equity` with peak and drawdown in per cent of the peak so far."""
    peaks = running_total(equity, F.col("equity"), "peak", by, order, how="max")
    return peaks.withColumn("drawdown", F.coalesce(F.try_divide(F.col("peak") - F.col("equity"), F.col("peak")) * 100, F.lit(0.0)))


def daily_returns(equity: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """(by, day, equity, ret): the last equity of each day and its change from the day before."""
    days = equity.groupBy(*by, F.to_date("ts").alias("day")).agg(F.max_by("equity", F.struct(*order)).alias("equity"))
    before = F.lag("equity").over(Window.partitionBy(*by).orderBy("day"))
    return days.withColumn("ret", F.try_divide(F.col("equity"), before) - 1)


def sharpe(equity: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """(by, sharpe): daily mean over deviation, a year of 365 days; 0 with fewer than two returns or no spread."""
    ratio = F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))) * math.sqrt(365)
    return daily_returns(equity, by, order).groupBy(*by).agg(F.coalesce(ratio, F.lit(0.0)).alias("sharpe"))


def annualised(total_pct: Column, days: Column) -> Column:
    """((1 + r) ** (365 / days) - 1) * 100; -100 if all is lost."""
    r = total_pct / 100
    return F.when(r > -1, (F.pow(1 + r, F.lit(365.0) / F.greatest(days, F.lit(1))) - 1) * 100).otherwise(-100.0)


def equity_metrics(equity: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """(by, initial, final, total_return, annualised_return, max_drawdown, days)."""
    key = F.struct(*order)
    days = F.greatest(F.floor(seconds_between(F.min("ts"), F.max("ts")) / SECONDS), F.lit(1))
    ends = drawdown_curve(equity, by, order).groupBy(*by).agg(F.min_by("equity", key).alias("initial"), F.max_by("equity", key).alias("final"), F.max("drawdown").alias("max_drawdown"), days.alias("days"))
    total = F.coalesce(F.try_divide(F.col("final") - F.col("initial"), F.col("initial")) * 100, F.lit(0.0))
    return ends.withColumn("total_return", total).withColumn("annualised_return", annualised(F.col("total_return"), F.col("days")))


def backtest_metrics(trades: DataFrame, equity: DataFrame, by: Sequence[str] = ("run_id",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """All metrics of each run in one row; a run without trades has total_trades 0."""
    none = {c: 0.0 for c in ("win_rate", "profit_factor", "avg_pnl", "avg_hold_minutes")} | {"total_trades": 0}
    if not by:
        parts = [equity_metrics(equity, by, order), sharpe(equity, by, order), trade_metrics(trades, by)]
        return parts[0].join(parts[1]).join(parts[2]).na.fill(none)
    return equity_metrics(equity, by, order).join(sharpe(equity, by, order), [*by]).join(trade_metrics(trades, by), [*by], "left").na.fill(none)


def monthly_returns(equity: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """(by, month, ret): the sum of the steps' changes in per cent, by the later point's month."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    months = equity.groupBy(*by, month).agg(F.max_by("equity", F.struct(*order)).alias("last"))
    months = months.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate([*by, "month"])], F.lag("last").over(Window.partitionBy(*by).orderBy("month")).alias("_start"))
    rows = equity.withColumn("month", month).withColumn("_lag", F.lag("equity").over(Window.partitionBy(*by, "month").orderBy(*order)))
    rows = rows.join(months, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate([*by, "month"])]))
    before = F.coalesce("_lag", "_start")  # the month's first step comes from the month before
    steps = rows.withColumn("ret", F.try_divide(F.col("equity") - before, before) * 100)
    return steps.groupBy(*by, "month").agg(F.coalesce(F.sum("ret"), F.lit(0.0)).alias("ret"))


def pnl_distribution(trades: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """(bucket, trades): counts of equal-width buckets; 0 and bins + 1 lie outside."""
    return trades.groupBy(F.width_bucket("pnl", F.lit(low), F.lit(high), F.lit(bins)).alias("bucket")).agg(F.count("*").alias("trades"))


def per_matrix(trades: DataFrame, by: Sequence[str] = ("strategy", "symbol")) -> DataFrame:
    """Counters of each cell; here a trade without gain is losing."""
    return trades.groupBy(*by).agg(
        F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("winning"), F.count_if(F.col("pnl") <= 0).alias("losing"),
        F.sum("pnl").alias("total_pnl"), F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)).alias("gross_profit"),
        F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0)).alias("gross_loss"),
        F.count_if(F.col("side") == 1).alias("long_trades"), F.count_if(F.col("side") == -1).alias("short_trades"),
    )


# The rational approximation of erfc by Abramowitz and Stegun, 7.1.26 (errors below 1.5e-7).
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERFC_P = 0.3275911


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, to 7 digits."""
    x = z / math.sqrt(2)
    t = F.lit(1.0) / (x * ERFC_P + 1)
    series = F.lit(0.0)
    for a in reversed(ERFC):
        series = (series + a) * t
    return series * F.exp(-x * x) * 0.5


def deflated_sharpe(sr: Column, trials: Column, days: float = 365.0, variance: float = 1.0) -> Column:
    """SR less the maximum to be expected of `trials` runs without skill (Bailey and Lopez de Prado, 2014); 0 if SR
    isn't positive or there was one trial."""
    expected = math.sqrt(variance / days) * F.sqrt(F.log(F.greatest(trials, F.lit(1)).cast("double")) * 2)
    return F.when((sr > 0) & (trials > 1), sr - expected).otherwise(0.0)


def deflated_p_value(dsr: Column, days: float = 365.0, variance: float = 1.0) -> Column:
    return normal_tail(F.greatest(dsr, F.lit(0.0)) / math.sqrt(variance / days))


def trade_count_penalty(trades: Column) -> Column:
    """20 below 5 trades, 5 below 15, and 0.02 for each trade above 500."""
    return F.when(trades < 5, 20.0).when(trades < 15, 5.0).when(trades > 500, (trades - 500) * 0.02).otherwise(0.0)


def capped_profit_factor(gain: Column, loss: Column) -> Column:
    """100 at most, 100 without losses, 0.1 without either."""
    return F.when(loss > 0, F.least(gain / loss, F.lit(100.0))).when(gain > 0, 100.0).otherwise(0.1)


def fitness(trades: Column, winning: Column, gain: Column, loss: Column, pnl: Column, longs: Column, complexity: Column, balance: float = 10_000.0, weights: tuple[float, float, float, float] = (0.15, 5.0, 50.0, 10.0)) -> Column:
    """A strategy's fitness from its cells' sums; weights of win rate, profit factor, return and one-sidedness."""
    win, pf, roc, one_sided = weights
    rate = winning * 100.0 / F.greatest(trades, F.lit(1))
    lean = F.when(trades > 0, F.abs(F.try_divide(longs.cast("double"), trades) - 0.5) * 2).otherwise(1.0)
    score = rate * win + F.greatest(capped_profit_factor(gain, loss), F.lit(0.1)) * pf + pnl / max(balance, 1.0) * roc - lean * one_sided
    deep = F.when(pnl < -50, F.abs(pnl) * 0.3).otherwise(0.0)
    return score - trade_count_penalty(trades) - deep - complexity


def fitness_single(sharpe: Column, win: Column, pf: Column, max_drawdown: Column, trades: Column, total_return: Column, complexity: Column) -> Column:
    """Fitness of a run from its own metrics."""
    score = F.greatest(sharpe, F.lit(-5.0)) * 2 + win * 0.15 + F.greatest(F.least(pf, F.lit(100.0)), F.lit(0.1)) * 5 - max_drawdown * 0.3
    deep = F.when(total_return < -5, F.abs(total_return) * 0.5).otherwise(0.0)
    return score - trade_count_penalty(trades) - deep - complexity


def complexity_penalty(conditions: Column, indicators: Column, parameters: Column) -> Column:
    return conditions * 0.8 + indicators * 1.2 + parameters * 0.3


def average_rank(c: Column, by: Sequence[str]) -> Column:
    """Ranks in which ties share their mean."""
    w = Window.partitionBy(*by).orderBy(c)
    ties = Window.partitionBy(*by, c)
    return F.rank().over(w) + (F.count("*").over(ties) - 1) / 2


def pearson(x: Column, y: Column) -> Column:
    """As an aggregate; null where a side is constant."""
    return F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))
