"""Sizing, limits and the circuit breaker as columns."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RiskParams


def position_size(balance: Column, price: Column, core: Column, p: RiskParams) -> tuple[Column, Column]:
    """(quantity, risk): a share of the capital pool, at least 1 per cent of it, within the hard limit."""
    pool = balance * F.when(core, p.core_share).otherwise(p.satellite_share)
    risk = F.least(pool * (max(p.position_pct, p.min_position_pct) / 100), balance * (p.max_position_pct / 100))
    return F.when(price > 0, F.try_divide(risk, price)).otherwise(0.0), risk


def stop_loss(entry: Column, side: Column, p: RiskParams) -> Column:
    return entry * (1 - side * (max(p.stop_pct, p.min_stop_pct) / 100))


def take_profits(entry: Column, side: Column, p: RiskParams) -> Column:
    return F.array(*[entry * (1 + side * (x / 100)) for x in p.take_profit_pct])


def risk_based(quantity: Column, balance: Column, price: Column, distance: float = 0.02, share: float = 0.01) -> Column:
    """The smaller of a quantity and what loses `share` of the balance over `distance` of the price."""
    at_risk = F.try_divide(balance * share, price * distance)
    return F.when(at_risk > 0, F.least(quantity, at_risk)).otherwise(quantity)


def check(orders: DataFrame, p: RiskParams) -> DataFrame:
    """`orders` with approved, reason, quantity, stop and leverage; the first limit that is hit gives the reason.

    Needs: tripped, exposure (value of open positions), balance, price, core, side, leverage, same_symbol, open_trades.
    """
    quantity, _ = position_size(F.col("balance"), F.col("price"), F.col("core"), p)
    exposure = F.when(F.col("balance") > 0, F.try_divide(F.col("exposure") * 100, F.col("balance"))).otherwise(0.0)
    reason = (
        F.when(F.col("tripped"), "circuit breaker").when(exposure >= p.max_exposure_pct, "exposure").when(quantity <= 0, "size")
        .when(F.col("same_symbol"), "same symbol").when(F.col("open_trades") >= p.max_open_trades, "open trades")
    )
    ok = reason.isNull()
    return orders.withColumns({
        "approved": ok, "reason": F.coalesce(reason, F.lit("")), "quantity": F.when(ok, quantity),
        "stop": F.when(ok, stop_loss(F.col("price"), F.col("side"), p)), "adjusted_leverage": F.when(ok, F.least("leverage", F.lit(p.max_leverage))),
    })


def account_curve(trades: DataFrame, by: tuple[str, ...], order: tuple[str, ...], balance: float = 0.0, at: str = "closed_at") -> DataFrame:
    """`trades` with equity (the balance and all results so far), drawdown and weekly_drawdown (per cent below the peak since
    the day, or the week, began; a period's peak begins with the equity that it starts from), daily_pnl (the day's results so
    far) and losses_in_row (since the last trade without loss). Results count to 2 decimals, a missing one as 0.

    It goes in two levels: inside each day of an account, and over the accounts' days, of which a row each is made. So no
    task holds an account's trades, and rows are shuffled by account and day only.
    """
    day, c = [*by, "_day"], F.col
    rows = _inside(trades, by, order, at)
    days = rows.groupBy(*day).agg(F.sum("_pnl").alias("_total"), F.max("_sum").alias("_most"), F.count("*").alias("_all"), F.max("_won").alias("_last"))
    return _joined(rows, _carried(days, by, balance), by).drop("_day", "_pnl", "_n", "_sum", "_top", "_won")


def _inside(trades: DataFrame, by: tuple[str, ...], order: tuple[str, ...], at: str) -> DataFrame:
    """`trades` with what a day's trades tell of themselves: _day, _pnl, _n (place), _sum and _top (results so far, and their
    highest), _won (place of the last trade without loss)."""
    rows = trades.withColumns({"_day": F.to_date(at), "_pnl": F.coalesce(F.round("pnl", 2), F.lit(0.0)).cast("decimal(28,2)")})
    inside = Window.partitionBy(*by, "_day").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n": F.row_number().over(inside), "_sum": F.sum("_pnl").over(upto)})
    return rows.withColumns({"_top": F.max("_sum").over(upto), "_won": F.max(F.when(F.col("_pnl") >= 0, F.col("_n"))).over(upto)})


def _carried(days: DataFrame, by: tuple[str, ...], balance: float) -> DataFrame:
    """`days` (_total, _most, _all, _last of each) with what the days before leave: _start (equity), _losses in a row, and
    _peak of the week before the day."""
    c = F.col
    along = Window.partitionBy(*by).orderBy("_day")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({
        "_start": F.coalesce(F.sum("_total").over(before), F.lit(0)) + F.lit(balance).cast("decimal(28,2)"), "_tail": c("_all") - F.coalesce("_last", F.lit(0)),
        # Days without any trade but losses go on with the day before them.
        "_block": F.count("_last").over(along.rowsBetween(Window.unboundedPreceding, 0)), "_week": F.date_trunc("week", "_day"),
    })
    lost = F.sum("_tail").over(Window.partitionBy(*by, "_block").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0))
    week = Window.partitionBy(*by, "_week").orderBy("_day")
    return days.withColumn("_lost", lost).withColumns({
        "_losses": F.coalesce(F.lag("_lost").over(along), F.lit(0)),
        "_peak": F.greatest(F.first("_start").over(week), F.max(c("_start") + c("_most")).over(week.rowsBetween(Window.unboundedPreceding, -1))),
    })


def _same(by: list[str]) -> Column:
    """The columns `by` are equal to _k0, _k1 and so on, null to null."""
    return reduce(and_, [F.col(x).eqNullSafe(F.col(f"_k{i}")) for i, x in enumerate(by)], F.lit(True))


def _joined(rows: DataFrame, days: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """`rows` (`_inside`) with the columns of the curve, by their days (`_carried`)."""
    c, day = F.col, [*by, "_day"]
    joined = rows.join(days.select(*[c(x).alias(f"_k{i}") for i, x in enumerate(day)], "_start", "_losses", "_peak"), _same(day))
    equity, day_peak = c("_start") + c("_sum"), F.greatest(c("_start"), c("_start") + c("_top"))
    below = lambda peak: F.when(peak > 0, (peak.cast("double") - equity.cast("double")) / peak.cast("double") * 100).otherwise(0.0)
    joined = joined.withColumns({
        "equity": equity.cast("double"), "drawdown": below(day_peak), "weekly_drawdown": below(F.greatest("_peak", day_peak)), "daily_pnl": c("_sum").cast("double"),
        "losses_in_row": (c("_n") - F.coalesce("_won", F.lit(0)) + F.when(c("_won").isNull(), c("_losses")).otherwise(0)).cast("long"),
    })
    return joined.drop("_start", "_losses", "_peak", *[f"_k{i}" for i in range(len(day))])


def streaks(trades: DataFrame, by: tuple[str, ...], order: tuple[str, ...], at: str = "closed_at") -> DataFrame:
    """`trades` with losses_in_row (`account_curve`)."""
    return account_curve(trades, by, order, at=at).select(*trades.columns, "losses_in_row")


def daily_pnl(trades: DataFrame, by: tuple[str, ...], order: tuple[str, ...], at: str = "closed_at") -> DataFrame:
    """`trades` with daily_pnl: the day's running sum of results to 2 decimals."""
    w = Window.partitionBy(*by, F.to_date(at)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("daily_pnl", F.sum(F.round("pnl", 2)).over(w))


def drawdowns(trades: DataFrame, by: tuple[str, ...], order: tuple[str, ...], balance: float, at: str = "closed_at") -> DataFrame:
    """`trades` with equity, drawdown and weekly_drawdown (`account_curve`)."""
    return account_curve(trades, by, order, balance, at).select(*trades.columns, "equity", "drawdown", "weekly_drawdown")


def _reason(columns: list[str], p: RiskParams) -> Column:
    """The first limit that a row of a curve with these columns breaks."""
    weekly = F.col("weekly_drawdown") > p.max_weekly_drawdown if "weekly_drawdown" in columns else F.lit(False)
    return (
        F.when(F.col("drawdown") > p.max_daily_drawdown, "drawdown").when(weekly, "weekly drawdown")
        .when(F.col("daily_pnl") <= -p.max_daily_loss, "daily loss").when(F.col("losses_in_row") >= p.max_consecutive_losses, "consecutive losses")
    )


def breaker(curve: DataFrame, p: RiskParams, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """`curve` with tripped and trip_reason: latched from the first row on that breaks a limit.

    Needs: drawdown (per cent of the peak), daily_pnl, losses_in_row; weekly_drawdown counts if it is there. The first such
    row of each account is an aggregate, and joined back; rows of equal order trip together.
    """
    reason = _reason(curve.columns, p)
    place = F.struct(*[F.col(c) for c in order])
    first = curve.withColumn("_reason", reason).where(F.col("_reason").isNotNull()).groupBy(*by).agg(F.min(F.struct(place.alias("at"), F.col("_reason").alias("reason"))).alias("_first"))
    first = first.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_first")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)] or [F.lit(True)]
    joined = curve.join(first, reduce(and_, same), "left")
    tripped = F.coalesce(place >= F.col("_first.at"), F.lit(False))
    return joined.withColumn("tripped", tripped).withColumn("trip_reason", F.when(F.col("tripped"), F.col("_first.reason")).otherwise("")).drop("_first", *[f"_k{i}" for i in range(len(by))])


def first_trips(trades: DataFrame, p: RiskParams, by: tuple[str, ...], order: tuple[str, ...], balance: float = 0.0, at: str = "closed_at") -> DataFrame:
    """(by, blocked, reason, tripped_at): the first trip of each account, and the number of its trades from there on; 0, ""
    and null if there is none. It is what `breaker` tells of `account_curve`; `order` begins with `at`.

    Trades are read and dealt by day once, and few of them are kept: in a day whose highest result so far stands, only a
    new lowest one can be the first to break a limit on equity, whatever the day starts with; the limit on losses in a row is
    met first where it is reached. With each day's first and last trade these are stored.
    """
    from ..functions.store import stored

    c, day, place = F.col, [*by, "_day"], F.struct(*[F.col(x) for x in order])
    rows = _inside(trades.select(*by, *order, "pnl"), by, order, at)
    inside = Window.partitionBy(*day).orderBy(*order)
    high = F.greatest("_top", F.lit(0).cast("decimal(28,2)"))
    # Highest results don't fall, so that the largest of these pairs has the highest one and the lowest result since.
    lowest = F.struct(high.alias("high"), (-c("_sum")).alias("depth"))
    rows = rows.withColumns({
        "_rank": F.rank().over(inside), "_final": F.lead("_n").over(inside).isNull(),
        "_new": F.coalesce(lowest > F.max(lowest).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)),
    })
    limit = p.max_consecutive_losses
    reached = (c("_n") - F.coalesce("_won", F.lit(0)) == limit) | (c("_won").isNull() & (c("_n") <= limit))
    kept = stored(rows.where(c("_new") | c("_final") | (c("_n") == 1) | reached).drop("pnl", "_pnl", "_new"))
    last = lambda x: F.max(F.when(c("_final"), c(x)))
    days = kept.groupBy(*day).agg(last("_sum").alias("_total"), last("_top").alias("_most"), last("_n").alias("_all"), last("_won").alias("_last"), F.min(at).alias("_least"))
    days = _carried(days, by, balance)
    curve = _joined(kept, days, by)
    broken = curve.withColumn("_reason", _reason(curve.columns, p)).where(c("_reason").isNotNull())
    first = broken.groupBy(*by).agg(F.min(F.struct(place.alias("at"), c("_reason").alias("reason"), c("_day").alias("day"), c("_rank").alias("rank"))).alias("_first"))
    joined = days.join(first.select(*[c(x).alias(f"_k{i}") for i, x in enumerate(by)], "_first"), _same(by), "left")
    on, after = c("_day").eqNullSafe(c("_first.day")), (c("_day") > c("_first.day")) | (c("_first.day").isNull() & c("_day").isNotNull())
    blocked = F.when(c("_first").isNull(), 0).when(on, c("_all") - c("_first.rank") + 1).when(after, c("_all")).otherwise(0)
    start = F.when(c("_first").isNotNull(), F.when(on, c(f"_first.at.{at}")).when(after, c("_least")))
    return joined.groupBy(*by).agg(F.sum(blocked).cast("long").alias("blocked"), F.coalesce(F.max("_first.reason"), F.lit("")).alias("reason"), F.min(start).alias("tripped_at"))


#: What a tripped breaker does with open positions; anything else counts as the first.
ACTIONS = ("block_only", "tighten_stops", "close_all", "close_worst")


def breaker_action(positions: DataFrame, action: str, key: str = "position_id", tighten_pct: float = 2.0) -> DataFrame:
    """Open positions (key, entry, last, quantity, side, stop) with `close` and their new `stop`.

    block_only leaves them as they are, tighten_stops puts each stop 2 per cent behind the price (to 2 decimals), close_all
    closes all and close_worst the one with the least unrealised result; ties go to the smaller key.
    """
    price = F.coalesce("last", "entry")
    if action == "tighten_stops":
        return positions.withColumn("close", F.lit(False)).withColumn("stop", F.round(price * (1 - F.col("side") * (tighten_pct / 100)), 2))
    if action == "close_worst":
        pnl = unrealised(F.col("entry"), F.col("last"), F.col("quantity"), F.col("side"))
        worst = positions.agg(F.min_by(key, F.struct(pnl, key)).alias("_worst"))  # one row
        return positions.join(F.broadcast(worst)).withColumn("close", F.coalesce(F.col(key) == F.col("_worst"), F.lit(False))).drop("_worst")
    return positions.withColumn("close", F.lit(action == "close_all"))


def trailing_stop(entry: Column, best: Column, side: Column, pct: float) -> Column:
    """A stop behind the best price so far, never worse than one behind the entry."""
    far = F.when(side == 1, F.greatest(best, entry)).otherwise(F.least(best, entry))
    return far * (1 - side * (pct / 100))


def unrealised(entry: Column, last: Column, quantity: Column, side: Column) -> Column:
    return (F.coalesce(last, entry) - entry) * quantity * side


def live_trailing_stop(stop: Column, last: Column, side: Column, pct: float) -> Column:
    """The stop of an open position after a price: `pct` per cent behind it (1 at least, to 2 decimals), if that is
    better than the one that stands."""
    new = F.round(last * (1 - side * (max(pct, 1.0) / 100)), 2)
    better = stop.isNull() | ((side == 1) & (new > stop)) | ((side == -1) & (new < stop))
    return F.when(last.isNotNull() & better, new).otherwise(stop)
