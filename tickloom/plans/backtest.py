"""Queries over trades, equity, risk and strategy search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import risk as K
from ..operators import search as G
from ..operators import simulate as X
from ..schema import CostParams, RiskParams
from ..sources.domain import Tables
from .indicators import matrix
from .market import r
from .registry import query

RISK = RiskParams()
EQUITY_ORDER = ("ts", "event_id")

#: Trades with pnl, in SQL.
PNL = "p AS (SELECT *, entry_price * quantity AS amount, (exit_price - entry_price) * quantity * side AS pnl FROM trades)\n"


def priced(t: Tables) -> DataFrame:
    return M.trade_pnl(t.trades)


@query("trade_pnl", PNL + "SELECT trade_id, line, round(amount, 4) AS amount, round(pnl, 4) AS pnl, round(pnl / nullif(amount, 0) * 100, 6) AS pnl_pct FROM p")
def trade_pnl(t: Tables) -> DataFrame:
    return priced(t).select("trade_id", "line", r("amount", 4).alias("amount"), r("pnl", 4).alias("pnl"), r("pnl_pct").alias("pnl_pct"))


@query("trade_costs", "SELECT trade_id, line, round((entry_price + exit_price) * quantity * (0.0004::DOUBLE + CASE symbol WHEN 'Brand#11' THEN 0.01::DOUBLE WHEN 'Brand#12' THEN 0.02::DOUBLE ELSE 0.03::DOUBLE END / 200), 9) AS cost FROM trades")
def trade_costs(t: Tables) -> DataFrame:
    costs = CostParams(spread_pct={"Brand#11": 0.01, "Brand#12": 0.02})
    return t.trades.select("trade_id", "line", r(M.trade_costs(costs), 9).alias("cost"))


_TRADE_METRICS = """SELECT strategy, count(*) AS total_trades, round(count(*) FILTER (pnl > 0) * 100.0::DOUBLE / count(*), 6) AS win_rate,
  round(CASE WHEN sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) > 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) WHEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) > 0 THEN 999 ELSE 0 END, 6) AS profit_factor,
  round(avg(pnl), 4) AS avg_pnl, round(avg(date_diff('second', opened_at, closed_at) / 60.0::DOUBLE), 4) AS avg_hold_minutes FROM p GROUP BY strategy"""


@query("win_rate_profit_factor", PNL + f"SELECT strategy, total_trades, win_rate, profit_factor FROM ({_TRADE_METRICS})")
def win_rate_profit_factor(t: Tables) -> DataFrame:
    return M.trade_metrics(priced(t), ["strategy"]).select("strategy", "total_trades", r("win_rate").alias("win_rate"), r("profit_factor").alias("profit_factor"))


@query("avg_hold_minutes", PNL + f"SELECT strategy, avg_pnl, avg_hold_minutes FROM ({_TRADE_METRICS})")
def avg_hold_minutes(t: Tables) -> DataFrame:
    return M.trade_metrics(priced(t), ["strategy"]).select("strategy", r("avg_pnl", 4).alias("avg_pnl"), r("avg_hold_minutes", 4).alias("avg_hold_minutes"))


_CURVE = "c AS (SELECT *, max(equity) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM equity), d AS (SELECT *, (peak - equity) / peak * 100 AS drawdown FROM c)"
_ENDS = _CURVE + """,
e AS (SELECT first(equity ORDER BY ts, event_id) AS i, last(equity ORDER BY ts, event_id) AS f, max(drawdown) AS dd, greatest(date_diff('second', min(ts), max(ts)) // 86400, 1) AS days FROM d),
y AS (SELECT CAST(ts AS DATE) AS day, last(equity ORDER BY ts, event_id) AS equity FROM equity GROUP BY 1),
x AS (SELECT *, equity / lag(equity) OVER (ORDER BY day) - 1 AS ret FROM y),
h AS (SELECT coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365), 0) AS sharpe FROM x)
"""  # fmt: skip

query("drawdown_curve", _CURVE + "\nSELECT event_id, ts, equity, peak, round(drawdown, 6) AS drawdown FROM d")(
    lambda t: M.drawdown_curve(t.equity, (), EQUITY_ORDER).select("event_id", "ts", "equity", "peak", r("drawdown").alias("drawdown"))
)
query("max_drawdown", _ENDS + "SELECT round(dd, 6) AS max_drawdown FROM e")(lambda t: M.equity_metrics(t.equity, (), EQUITY_ORDER).select(r("max_drawdown").alias("max_drawdown")))
query("annualized_return", _ENDS + "SELECT round((f - i) / i * 100, 6) AS total_return, round((pow(1 + (f - i) / i, 365.0 / days) - 1) * 100, 5) AS annualised_return, CAST(days AS BIGINT) AS days FROM e")(
    lambda t: M.equity_metrics(t.equity, (), EQUITY_ORDER).select(r("total_return").alias("total_return"), r("annualised_return", 5).alias("annualised_return"), F.col("days").cast("long").alias("days"))
)
query("sharpe_daily", _ENDS + "SELECT round(sharpe, 6) AS sharpe FROM h")(lambda t: M.sharpe(t.equity, (), EQUITY_ORDER).select(r("sharpe").alias("sharpe")))
query("monthly_returns", "a AS (SELECT ts, equity, lag(equity) OVER (ORDER BY ts, event_id) AS b FROM equity)\nSELECT strftime(ts, '%Y-%m') AS month, round(coalesce(sum((equity - b) / nullif(b, 0) * 100), 0), 6) AS ret FROM a GROUP BY 1")(
    lambda t: M.monthly_returns(t.equity, (), EQUITY_ORDER).select("month", r("ret").alias("ret"))
)
_METRICS = PNL.strip() + ",\n" + _ENDS + ", m AS (" + _TRADE_METRICS.replace("SELECT strategy, ", "SELECT ").replace(" GROUP BY strategy", "") + ")\n"
_ALL = "SELECT round((f - i) / i * 100, 6) AS total_return, round(dd, 6) AS max_drawdown, round(sharpe, 6) AS sharpe, total_trades, win_rate, profit_factor FROM e, h, m"


def _metrics(t: Tables) -> DataFrame:
    found = M.backtest_metrics(priced(t), t.equity, (), EQUITY_ORDER)
    return found.select(*[r(c).alias(c) for c in ("total_return", "max_drawdown", "sharpe")], "total_trades", *[r(c).alias(c) for c in ("win_rate", "profit_factor")])


query("backtest_metrics", _METRICS + _ALL)(_metrics)
query("report_json", _METRICS + "SELECT '{\"trades\":' || total_trades || ',\"positive\":' || CASE WHEN total_return > 0 THEN 'true' ELSE 'false' END || '}' AS report FROM (" + _ALL + ")")(
    lambda t: _metrics(t).select(F.to_json(F.struct(F.col("total_trades").alias("trades"), (F.col("total_return") > 0).alias("positive"))).alias("report"))
)


@query("pnl_distribution", PNL + "SELECT CASE WHEN pnl < -100000 THEN 0 WHEN pnl >= 100000 THEN 21 ELSE CAST(floor((pnl + 100000) / 10000) AS BIGINT) + 1 END AS bucket, count(*) AS trades FROM p GROUP BY 1")
def pnl_distribution(t: Tables) -> DataFrame:
    return M.pnl_distribution(priced(t), -100_000, 100_000, 20).select(F.col("bucket").cast("long").alias("bucket"), "trades")


_CELLS = PNL.strip() + """,
m AS (SELECT strategy, symbol, count(*) AS trades, count(*) FILTER (pnl > 0) AS winning, count(*) FILTER (pnl <= 0) AS losing, sum(pnl) AS total_pnl, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gross_profit,
  sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) AS gross_loss, count(*) FILTER (side = 1) AS long_trades, count(*) FILTER (side = -1) AS short_trades FROM p GROUP BY ALL),
u AS (SELECT strategy, CAST(sum(trades) AS BIGINT) AS trades, CAST(sum(winning) AS BIGINT) AS winning, sum(total_pnl) AS pnl, sum(gross_profit) AS gain, sum(gross_loss) AS loss, CAST(sum(long_trades) AS BIGINT) AS longs FROM m GROUP BY strategy)
"""  # fmt: skip


def cells(t: Tables) -> DataFrame:
    return M.per_matrix(priced(t))


def rollup(t: Tables) -> DataFrame:
    return cells(t).groupBy("strategy").agg(F.sum("trades").alias("trades"), F.sum("winning").alias("winning"), F.sum("total_pnl").alias("pnl"), F.sum("gross_profit").alias("gain"), F.sum("gross_loss").alias("loss"), F.sum("long_trades").alias("longs"))


query("per_matrix", _CELLS + "SELECT strategy, symbol, trades, winning, losing, long_trades, short_trades, round(total_pnl, 3) AS total_pnl FROM m")(
    lambda t: cells(t).select("strategy", "symbol", "trades", "winning", "losing", "long_trades", "short_trades", r("total_pnl", 3).alias("total_pnl"))
)
query("strategy_rollup", _CELLS + "SELECT strategy, trades, winning, longs, round(pnl, 2) AS pnl, round(gain, 2) AS gain, round(loss, 2) AS loss FROM u")(
    lambda t: rollup(t).select("strategy", "trades", "winning", "longs", *[r(c, 2).alias(c) for c in ("pnl", "gain", "loss")])
)
_PENALTY = "CASE WHEN trades < 5 THEN 20 WHEN trades < 15 THEN 5 WHEN trades > 500 THEN (trades - 500) * 0.02::DOUBLE ELSE 0 END"


@query("ga_fitness", _CELLS + f"""SELECT strategy, round(winning * 100.0::DOUBLE / greatest(trades, 1) * 0.15::DOUBLE + greatest(CASE WHEN loss > 0 THEN least(gain / loss, 100) WHEN gain > 0 THEN 100 ELSE 0.1 END, 0.1) * 5 + pnl / 10000 * 50
  - CASE WHEN trades > 0 THEN abs(CAST(longs AS DOUBLE) / trades - 0.5) * 2 ELSE 1 END * 10 - ({_PENALTY}) - CASE WHEN pnl < -50 THEN abs(pnl) * 0.3::DOUBLE ELSE 0 END - 4.0, 2) AS fitness FROM u""")  # fmt: skip
def ga_fitness(t: Tables) -> DataFrame:
    c = F.col
    return rollup(t).select("strategy", r(M.fitness(c("trades"), c("winning"), c("gain"), c("loss"), c("pnl"), c("longs"), F.lit(4.0)), 2).alias("fitness"))


_SINGLE = _METRICS + f"SELECT round(greatest(sharpe, -5) * 2 + win_rate * 0.15::DOUBLE + greatest(least(profit_factor, 100), 0.1) * 5 - max_drawdown * 0.3::DOUBLE - ({_PENALTY.replace('trades', 'total_trades')}) - CASE WHEN total_return < -5 THEN abs(total_return) * 0.5 ELSE 0 END - 2.5, 4) AS fitness FROM ({_ALL})"


@query("ga_fitness_single", _SINGLE)
def ga_fitness_single(t: Tables) -> DataFrame:
    c = F.col
    return _metrics(t).select(r(M.fitness_single(c("sharpe"), c("win_rate"), c("profit_factor"), c("max_drawdown"), c("total_trades"), c("total_return"), F.lit(2.5)), 4).alias("fitness"))


@query("complexity_penalty", "SELECT p_partkey, round(p_size % 5 * 0.8::DOUBLE + p_size % 4 * 1.2::DOUBLE + p_size % 7 * 0.3::DOUBLE, 6) AS penalty FROM part")
def complexity_penalty(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select("p_partkey", r(M.complexity_penalty(s % 5, s % 4, s % 7)).alias("penalty"))


@query("deflated_sharpe", "SELECT s_suppkey, round(CASE WHEN s_acctbal > 0 THEN s_acctbal / 5000 - sqrt(1 / 365.0::DOUBLE) * sqrt(2 * ln(100.0::DOUBLE)) ELSE 0 END, 6) AS dsr FROM supplier")
def deflated_sharpe(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", r(M.deflated_sharpe(F.col("s_acctbal") / 5000, F.lit(100))).alias("dsr"))


_T = "(1.0::DOUBLE / (1 + 0.3275911::DOUBLE * x))"
_TAIL = "0.0::DOUBLE"
for _a in reversed(M.ERFC):
    _TAIL = f"(({_TAIL} + {_a}::DOUBLE) * {_T})"


@query("deflated_sharpe_p_value", f"""d AS (SELECT s_suppkey, greatest(CASE WHEN s_acctbal > 0 THEN s_acctbal / 5000 - sqrt(1 / 365.0::DOUBLE) * sqrt(2 * ln(100.0::DOUBLE)) ELSE 0 END, 0) / sqrt(1 / 365.0::DOUBLE) / sqrt(2.0::DOUBLE) AS x FROM supplier)
SELECT s_suppkey, round({_TAIL} * exp(-x * x) * 0.5, 6) AS p_value FROM d""")  # fmt: skip
def deflated_sharpe_p_value(t: Tables) -> DataFrame:
    dsr = M.deflated_sharpe(F.col("s_acctbal") / 5000, F.lit(100))
    return t.supplier.select("s_suppkey", r(M.deflated_p_value(dsr)).alias("p_value"))


#: Walk-forward results: a run is a nation, a window one of its suppliers.
_WINDOWS = "w AS (SELECT s_nationkey AS run, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS window_, s_acctbal / 5000 AS train_sharpe, s_acctbal % 700 / 500 AS val_sharpe FROM supplier)\n"


def _windows(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return t.supplier.select(F.col("s_nationkey").alias("run"), n.alias("window"), (F.col("s_acctbal") / 5000).alias("train_sharpe"), (F.col("s_acctbal") % 700 / 500).alias("val_sharpe"))


@query("wf_report", _WINDOWS + """SELECT run, count(*) AS windows, round(avg(val_sharpe), 6) AS mean_val, round(coalesce(stddev_samp(val_sharpe), 0), 6) AS std_val, round(min(val_sharpe), 6) AS min_val, round(max(val_sharpe), 6) AS max_val,
  round(coalesce(avg(val_sharpe) / nullif(stddev_samp(val_sharpe), 0), 0), 6) AS efficiency, round(count(*) FILTER (val_sharpe > 0) * 100.0::DOUBLE / count(*), 6) AS positive_pct,
  round(CASE WHEN count(*) >= 3 THEN coalesce(covar_samp(train_sharpe, val_sharpe) / nullif(stddev_samp(train_sharpe) * stddev_samp(val_sharpe), 0), 0) ELSE 0 END, 6)::DOUBLE AS correlation,
  CAST(arg_max(window_, (val_sharpe, -window_)) AS INTEGER) AS best_window FROM w GROUP BY run""")  # fmt: skip
def wf_report(t: Tables) -> DataFrame:
    found = G.walk_forward_report(_windows(t), ["run"])
    return found.select("run", "windows", *[r(c).alias(c) for c in ("mean_val", "std_val", "min_val", "max_val", "efficiency", "positive_pct", "correlation")], "best_window")


@query("calibration_stage2", _WINDOWS.rstrip() + """,
e AS (SELECT run, avg(val_sharpe) / nullif(stddev_samp(val_sharpe), 0) AS efficiency FROM w GROUP BY run),
b AS (SELECT run, efficiency FROM e WHERE efficiency > 0 ORDER BY round(efficiency, 9) DESC, run LIMIT 1)
SELECT CAST(coalesce((SELECT run FROM b), 1) AS INTEGER) AS rank, round(coalesce((SELECT efficiency FROM b), 0), 6)::DOUBLE AS efficiency, (SELECT count(*) FROM b) > 0 AS chosen""")  # fmt: skip
def calibration_stage2(t: Tables) -> DataFrame:
    """The choice among combinations of weights, here nations, by their walk-forward windows."""
    from ..operators.campaign import choose

    return choose(_windows(t).withColumn("rank", F.col("run").cast("int"))).withColumn("efficiency", r("efficiency"))


#: A fixed grid of weights, as large as the calibration's: 8 x 6 x 8 x 7 combinations.
_GRID = (("wr", [0.05 * i for i in range(1, 9)]), ("pf", [1.0 * i for i in range(1, 7)]), ("roc", [10.0 * i for i in range(1, 9)]), ("bal", [2.0 * i for i in range(7)]))
_SCORES = PNL.strip() + """,
k AS (SELECT symbol, count(*) FILTER (pnl > 0) * 100.0::DOUBLE / count(*) AS a, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END), 0) AS b, sum(pnl) / 1000000 AS c,
  -abs(count(*) FILTER (side = 1) / CAST(count(*) AS DOUBLE) - 0.5) * 2 AS d, avg(pnl) FILTER (line > 3) AS y FROM p GROUP BY symbol),
g AS (SELECT wr, pf, roc, bal FROM (SELECT unnest([0.05::DOUBLE * x FOR x IN range(1, 9)]) AS wr), (SELECT unnest([1.0::DOUBLE * x FOR x IN range(1, 7)]) AS pf), (SELECT unnest([10.0::DOUBLE * x FOR x IN range(1, 9)]) AS roc), (SELECT unnest([2.0::DOUBLE * x FOR x IN range(0, 7)]) AS bal)),
s AS (SELECT g.*, y, round(wr * round(a, 6) + pf * round(b, 6) + roc * round(c, 6) + bal * round(d, 6), 9) AS x FROM k CROSS JOIN g),
q AS (SELECT wr, pf, roc, bal, rank() OVER (PARTITION BY wr, pf, roc, bal ORDER BY x) + (count(*) OVER (PARTITION BY wr, pf, roc, bal, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY wr, pf, roc, bal ORDER BY y) + (count(*) OVER (PARTITION BY wr, pf, roc, bal, y) - 1) / 2.0::DOUBLE AS ry FROM s),
o AS (SELECT wr, pf, roc, bal, coalesce(covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0), 0) AS rho FROM q GROUP BY ALL)
SELECT round(wr, 6) AS wr, pf, roc, bal, round(rho, 6) AS rho FROM o ORDER BY round(rho, 9) DESC, wr, pf, roc, bal LIMIT 5"""  # fmt: skip


@query("spearman_grid_top5", _SCORES)
def spearman_grid_top5(t: Tables) -> DataFrame:
    pnl, c = F.col("pnl"), F.col
    k = priced(t).groupBy("symbol").agg(
        r(M.win_rate(pnl)).alias("a"), r(F.try_divide(F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), F.sum(F.when(pnl < 0, -pnl).otherwise(0.0)))).alias("b"), r(F.sum("pnl") / 1_000_000).alias("c"),
        r(-F.abs(F.count_if(c("side") == 1) / F.count("*") - 0.5) * 2).alias("d"), F.avg(F.when(c("line") > 3, pnl)).alias("y"),
    )
    grid = t.spark.range(1)
    for name, values in _GRID:
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    found = G.calibrate(k, grid.drop("id"), {"wr": "a", "pf": "b", "roc": "c", "bal": "d"}, "y")
    return found.select(r("wr").alias("wr"), "pf", "roc", "bal", r("rho").alias("rho"))


#: The fitness of each strategy and symbol: the population of a search.
_FITNESS = _CELLS.rstrip() + f""",
fit AS (SELECT strategy, symbol, round(winning * 100.0::DOUBLE / greatest(trades, 1) * 0.15::DOUBLE + greatest(CASE WHEN gross_loss > 0 THEN least(gross_profit / gross_loss, 100) WHEN gross_profit > 0 THEN 100 ELSE 0.1 END, 0.1) * 5 + total_pnl / 10000000 * 50
  - CASE WHEN trades > 0 THEN abs(CAST(long_trades AS DOUBLE) / trades - 0.5) * 2 ELSE 1 END * 10 - ({_PENALTY}) - CASE WHEN total_pnl < -50 THEN abs(total_pnl) * 0.3::DOUBLE ELSE 0 END - 4.0, 6) AS fitness FROM m)
"""  # fmt: skip


def _population(t: Tables) -> DataFrame:
    c = F.col
    score = M.fitness(c("trades"), c("winning"), c("gross_profit"), c("gross_loss"), c("total_pnl"), c("long_trades"), F.lit(4.0), balance=10_000_000)
    return cells(t).select("strategy", "symbol", r(score).alias("fitness"))


@query("population_diversity", _FITNESS + "SELECT round(avg(s), 4) AS mean, round(stddev_pop(s) / (abs(avg(s)) + 1e-9::DOUBLE), 4) AS diversity FROM (SELECT CASE WHEN fitness > -900 THEN fitness END AS s FROM fit)")
def population_diversity(t: Tables) -> DataFrame:
    return G.population_stats(_population(t), F.col("fitness")).select(r("mean", 4).alias("mean"), r("diversity", 4).alias("diversity"))


@query("parameter_sensitivity", _FITNESS + "SELECT strategy, round(least(stddev_pop(fitness) / greatest(abs(max(fitness)), 1), 1), 4) AS sensitivity FROM fit GROUP BY strategy")
def parameter_sensitivity(t: Tables) -> DataFrame:
    return G.parameter_sensitivity(_population(t), "fitness", "fitness", ["strategy"]).select("strategy", r("sensitivity", 4).alias("sensitivity"))


@query("fitness_top_k", _FITNESS + "SELECT strategy, symbol, round(fitness, 3) AS fitness FROM fit ORDER BY fitness DESC, strategy, symbol LIMIT 8")
def fitness_top_k(t: Tables) -> DataFrame:
    return _population(t).orderBy(F.desc("fitness"), "strategy", "symbol").limit(8).select("strategy", "symbol", r("fitness", 3).alias("fitness"))


query("matrix_negative_cells", _CELLS + "SELECT strategy, symbol, round(total_pnl, 3) AS total_pnl FROM m WHERE total_pnl < -5")(lambda t: cells(t).where("total_pnl < -5").select("strategy", "symbol", r("total_pnl", 3).alias("total_pnl")))
query("matrix_gap_symbols", _CELLS + "SELECT symbol, arg_max(strategy, (total_pnl, strategy)) AS best, round(max(total_pnl), 3) AS pnl FROM m GROUP BY symbol HAVING max(total_pnl) < 400000")(
    lambda t: cells(t).groupBy("symbol").agg(F.max_by("strategy", F.struct("total_pnl", "strategy")).alias("best"), r(F.max("total_pnl"), 3).alias("pnl"), F.max("total_pnl").alias("m")).where("m < 400000").drop("m")
)
query("strategy_positive_share", _CELLS + "SELECT strategy, round(count(*) FILTER (total_pnl > 0) / CAST(count(*) AS DOUBLE), 6) AS share FROM m GROUP BY strategy")(
    lambda t: cells(t).groupBy("strategy").agg(r(F.count_if(F.col("total_pnl") > 0) / F.count("*")).alias("share"))
)
#: Metrics of each strategy, from 10 million and the days' results.
_RULES = PNL.strip() + """,
q0 AS (SELECT strategy, CAST(closed_at AS DATE) AS day, sum(CAST(round(pnl, 2) AS DECIMAL(28,2))) AS pnl FROM p GROUP BY ALL),
q1 AS (SELECT strategy, day, CAST(10000000 + sum(pnl) OVER (PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS equity FROM q0),
q2 AS (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak, equity / nullif(lag(equity) OVER (PARTITION BY strategy ORDER BY day), 0) - 1 AS ret FROM q1),
q3 AS (SELECT strategy, coalesce(max((peak - equity) / nullif(peak, 0) * 100), 0) AS max_drawdown, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365), 0) AS sharpe FROM q2 GROUP BY strategy),
q AS (SELECT q3.*, total_trades, win_rate FROM q3 JOIN (SELECT strategy, count(*) AS total_trades, count(*) FILTER (pnl > 0) * 100.0::DOUBLE / count(*) AS win_rate FROM p GROUP BY strategy) USING (strategy))
"""  # fmt: skip


def _strategy_metrics(t: Tables) -> DataFrame:
    return M.daily_metrics(priced(t), ("strategy",), 10_000_000)


query("strategy_metrics", _RULES + "SELECT strategy, round(max_drawdown, 4) AS max_drawdown, round(sharpe, 4) AS sharpe, total_trades, round(win_rate, 4) AS win_rate FROM q")(
    lambda t: _strategy_metrics(t).select("strategy", r("max_drawdown", 4).alias("max_drawdown"), r("sharpe", 4).alias("sharpe"), "total_trades", r("win_rate", 4).alias("win_rate"))
)
query("retirement_candidates", _RULES + "SELECT strategy, total_trades FROM q WHERE total_trades = 0 OR sharpe < -1 OR win_rate < 30 OR max_drawdown > 30")(
    lambda t: _strategy_metrics(t).where(G.retire()).select("strategy", "total_trades")
)
query("deploy_gate", _RULES + "SELECT strategy FROM q WHERE sharpe > 0.5 AND win_rate > 45")(lambda t: _strategy_metrics(t).where(G.deployable()).select("strategy"))
query("closed_trades_export", "SELECT trade_id, line, symbol, side, round(exit_price, 9) AS exit_price, opened_at FROM trades WHERE closed_at > opened_at")(
    lambda t: t.trades.where("closed_at > opened_at").select("trade_id", "line", "symbol", "side", r("exit_price", 9).alias("exit_price"), "opened_at")
)

# --- sizing and limits --------------------------------------------------------------------------------------

_ORDERS = "SELECT o_orderkey, c_acctbal AS balance, o_totalprice / 100 AS price, o_orderkey % 2 = 0 AS core, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS side FROM orders JOIN customer ON o_custkey = c_custkey"


def _orders(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", F.col("c_acctbal").alias("balance"), (F.col("o_totalprice") / 100).alias("price"), (F.col("o_orderkey") % 2 == 0).alias("core"), F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1).alias("side"))


_SIZE = "least(balance * CASE WHEN core THEN 0.7 ELSE 0.3 END::DOUBLE * 0.05::DOUBLE, balance * 0.1::DOUBLE)"
query("position_size", f"o AS ({_ORDERS})\nSELECT o_orderkey, round({_SIZE} / nullif(price, 0), 6) AS quantity, round({_SIZE}, 6) AS risk FROM o")(
    lambda t: (lambda q: _orders(t).select("o_orderkey", r(q[0]).alias("quantity"), r(q[1]).alias("risk")))(K.position_size(F.col("balance"), F.col("price"), F.col("core"), RISK))
)
query("stop_take_levels", f"o AS ({_ORDERS})\nSELECT o_orderkey, round(price * (1 - side * 0.02::DOUBLE), 9) AS stop, round(price * (1 + side * 0.03::DOUBLE), 9) AS tp1, round(price * (1 + side * 0.1::DOUBLE), 9) AS tp3 FROM o")(
    lambda t: (lambda tp: _orders(t).select("o_orderkey", r(K.stop_loss(F.col("price"), F.col("side"), RISK), 9).alias("stop"), r(tp[0], 9).alias("tp1"), r(tp[2], 9).alias("tp3")))(K.take_profits(F.col("price"), F.col("side"), RISK))
)
query("risk_based_qty", f"o AS ({_ORDERS})\nSELECT o_orderkey, round(CASE WHEN balance * 0.01::DOUBLE / (price * 0.02::DOUBLE) > 0 THEN least({_SIZE} / price, balance * 0.01::DOUBLE / (price * 0.02::DOUBLE)) ELSE {_SIZE} / price END, 6) AS quantity FROM o")(
    lambda t: _orders(t).select("o_orderkey", r(K.risk_based(K.position_size(F.col("balance"), F.col("price"), F.col("core"), RISK)[0], F.col("balance"), F.col("price"))).alias("quantity"))
)
query("manual_order_sizing", f"o AS ({_ORDERS})\nSELECT o_orderkey, round(least({_SIZE} / nullif(price, 0), 50 / nullif(price, 0)), 6) AS quantity FROM o WHERE balance > 0")(
    lambda t: _orders(t).where("balance > 0").select("o_orderkey", r(F.least(K.position_size(F.col("balance"), F.col("price"), F.col("core"), RISK)[0], F.try_divide(F.lit(50.0), F.col("price")))).alias("quantity"))
)
query("risk_param_clamp", "SELECT s_suppkey, round(greatest(s_acctbal / 1000, 1), 6) AS size_pct, round(greatest(s_acctbal / 5000, 0.5), 6) AS stop_pct, greatest(CAST(floor(s_acctbal / 2000) AS BIGINT), 1) AS leverage FROM supplier")(
    lambda t: t.supplier.select("s_suppkey", r(F.greatest(F.col("s_acctbal") / 1000, F.lit(1.0))).alias("size_pct"), r(F.greatest(F.col("s_acctbal") / 5000, F.lit(0.5))).alias("stop_pct"), F.greatest(F.floor(F.col("s_acctbal") / 2000), F.lit(1)).alias("leverage"))
)


@query("risk_check", f"""o AS ({_ORDERS}), x AS (SELECT *, o_orderkey % 97 = 0 AS tripped, price * 0.5::DOUBLE AS exposure, o_orderkey % 11 = 0 AS same_symbol, o_orderkey % 10 AS open_trades FROM o),
c AS (SELECT *, CASE WHEN tripped THEN 'circuit breaker' WHEN CASE WHEN balance > 0 THEN exposure * 100 / balance ELSE 0 END >= 80 THEN 'exposure' WHEN CASE WHEN price > 0 THEN {_SIZE} / price ELSE 0 END <= 0 THEN 'size' WHEN same_symbol THEN 'same symbol' WHEN open_trades >= 8 THEN 'open trades' ELSE '' END AS reason FROM x)
SELECT o_orderkey, reason = '' AS approved, reason, round(CASE WHEN reason = '' THEN {_SIZE} / price END, 6) AS quantity, round(CASE WHEN reason = '' THEN price * (1 - side * 0.02::DOUBLE) END, 9) AS stop FROM c""")  # fmt: skip
def risk_check(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _orders(t).withColumns({"tripped": k % 97 == 0, "exposure": F.col("price") * 0.5, "same_symbol": k % 11 == 0, "open_trades": k % 10, "leverage": F.lit(2.0)})
    return K.check(rows, RISK).select("o_orderkey", "approved", "reason", r("quantity").alias("quantity"), r("stop", 9).alias("stop"))


_STREAK = PNL.strip() + """,
l AS (SELECT *, CASE WHEN round(pnl, 2) < 0 THEN 1 ELSE 0 END AS loss FROM p),
n AS (SELECT *, sum(1 - loss) OVER (PARTITION BY strategy ORDER BY closed_at, trade_id, line, part_id, quantity, exit_price ROWS UNBOUNDED PRECEDING) AS run FROM l),
s AS (SELECT *, CAST(sum(loss) OVER (PARTITION BY strategy, run ORDER BY closed_at, trade_id, line, part_id, quantity, exit_price ROWS UNBOUNDED PRECEDING) AS BIGINT) AS losses_in_row,
  sum(round(pnl, 2)) OVER (PARTITION BY strategy, CAST(closed_at AS DATE) ORDER BY closed_at, trade_id, line, part_id, quantity, exit_price ROWS UNBOUNDED PRECEDING) AS daily_pnl FROM n)
"""  # fmt: skip
BY, ORDER = ("strategy",), ("closed_at", "trade_id", "line", "part_id", "quantity", "exit_price")
query("consecutive_losses", _STREAK + "SELECT strategy, trade_id, line, losses_in_row FROM s")(lambda t: K.streaks(priced(t), BY, ORDER).select("strategy", "trade_id", "line", "losses_in_row"))
query("daily_pnl_running", _STREAK + "SELECT strategy, trade_id, line, round(daily_pnl, 2) AS daily_pnl FROM s")(lambda t: K.daily_pnl(priced(t), BY, ORDER).select("strategy", "trade_id", "line", r("daily_pnl", 2).alias("daily_pnl")))

_BY_TRADE = "closed_at, trade_id, line, part_id, quantity, exit_price"
_TRIPS = _STREAK.rstrip() + f""",
x0 AS (SELECT *, CAST(10000000 + sum(CAST(round(pnl, 2) AS DECIMAL(28,2))) OVER (PARTITION BY strategy ORDER BY {_BY_TRADE} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS equity FROM s),
x1 AS (SELECT *, equity - round(pnl, 2) AS before FROM x0),
x2 AS (SELECT *, greatest(max(equity) OVER d, first_value(before) OVER d) AS day_peak, greatest(max(equity) OVER w, first_value(before) OVER w) AS week_peak FROM x1
  WINDOW d AS (PARTITION BY strategy, CAST(closed_at AS DATE) ORDER BY {_BY_TRADE} ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY strategy, date_trunc('week', closed_at) ORDER BY {_BY_TRADE} ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, CASE WHEN (day_peak - equity) / day_peak * 100 > 4 THEN 'drawdown' WHEN (week_peak - equity) / week_peak * 100 > 6 THEN 'weekly drawdown' WHEN daily_pnl <= -500000 THEN 'daily loss' WHEN losses_in_row >= 12 THEN 'consecutive losses' END AS reason FROM x2),
g AS (SELECT *, coalesce(first_value(reason IGNORE NULLS) OVER (PARTITION BY strategy ORDER BY {_BY_TRADE} ROWS UNBOUNDED PRECEDING), '') AS trip_reason FROM c)
"""  # fmt: skip


def _trips(t: Tables) -> DataFrame:
    return K.first_trips(priced(t), RiskParams(max_daily_drawdown=4, max_weekly_drawdown=6, max_daily_loss=500_000, max_consecutive_losses=12), BY, ORDER, 10_000_000)


query("circuit_breaker_trips", _TRIPS + "SELECT strategy, count(*) FILTER (trip_reason <> '') AS blocked, max(trip_reason) AS reason, min(closed_at) FILTER (trip_reason <> '') AS tripped_at FROM g GROUP BY strategy")(
    lambda t: _trips(t).select("strategy", "blocked", "reason", "tripped_at")
)
_HELD = """l AS (SELECT symbol, arg_max(price, (ts, seq)) AS price FROM ticks GROUP BY symbol),
h AS (SELECT e.event_id AS position_id, e.event_type AS symbol, e.value AS entry, l.price AS last, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity, CASE WHEN e.event_id % 2 = 0 THEN 1 ELSE -1 END AS side, e.value / 2 AS stop FROM events e LEFT JOIN l ON e.event_type = l.symbol),
u AS (SELECT *, (coalesce(last, entry) - entry) * quantity * side AS upnl FROM h)
"""  # fmt: skip


@query("breaker_action", _HELD + """SELECT action, symbol, CAST(count(*) FILTER (action = 'close_all' OR action = 'close_worst' AND position_id = (SELECT arg_min(position_id, (upnl, position_id)) FROM u)) AS BIGINT) AS closed,
  round(max(CASE WHEN action = 'tighten_stops' THEN round(coalesce(last, entry) * (1 - side * 0.02::DOUBLE), 2) ELSE stop END), 4) AS highest_stop
FROM u CROSS JOIN (SELECT unnest(['block_only', 'tighten_stops', 'close_all', 'close_worst']) AS action) GROUP BY ALL""")  # fmt: skip
def breaker_action(t: Tables) -> DataFrame:
    last = t.ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "seq")).alias("last"))
    held = t.events.select(
        F.col("event_id").alias("position_id"), F.col("event_type").alias("symbol"), F.col("value").alias("entry"), F.get_json_object("props", "$.k").cast("double").alias("quantity"),
        F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("side"), (F.col("value") / 2).alias("stop"),
    ).join(last, "symbol", "left")
    done = [K.breaker_action(held, a).groupBy("symbol").agg(F.count_if("close").alias("closed"), r(F.max("stop"), 4).alias("highest_stop")).select(F.lit(a).alias("action"), "symbol", "closed", "highest_stop") for a in K.ACTIONS]
    return reduce(DataFrame.unionByName, done)


query("live_trailing_stop", _HELD + "SELECT position_id, round(CASE WHEN last IS NOT NULL AND (stop IS NULL OR side = 1 AND round(last * 0.985::DOUBLE, 2) > stop OR side = -1 AND round(last * 1.015::DOUBLE, 2) < stop) THEN round(last * (1 - side * 0.015::DOUBLE), 2) ELSE stop END, 6) AS stop FROM h")(
    lambda t: t.events.join(t.ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "seq")).alias("last")), F.col("event_type") == F.col("symbol"), "left")
    .select(F.col("event_id").alias("position_id"), r(K.live_trailing_stop(F.col("value") / 2, F.col("last"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1), 1.5)).alias("stop"))
)
query("max_hold_exit", "SELECT trade_id, line, date_diff('second', opened_at, closed_at) / 3600.0::DOUBLE >= 720 AS expired FROM trades")(
    lambda t: t.trades.select("trade_id", "line", (M.seconds_between(F.col("opened_at"), F.col("closed_at")) / 3600 >= 720).alias("expired"))
)
query("partial_close", "SELECT trade_id, line, CASE WHEN q < 10 / entry_price THEN 0 ELSE round(q, 6) END AS remaining, round((quantity - CASE WHEN q < 10 / entry_price THEN 0 ELSE q END) * entry_price, 4) AS released FROM (SELECT *, quantity * (1 - 0.25::DOUBLE * (line % 4)) AS q FROM trades)")(
    lambda t: (lambda q: t.trades.withColumn("q", q).withColumn("left", F.when(F.col("q") < F.lit(10.0) / F.col("entry_price"), 0.0).otherwise(F.col("q"))).select("trade_id", "line", r("left").alias("remaining"), r((F.col("quantity") - F.col("left")) * F.col("entry_price"), 4).alias("released")))(F.col("quantity") * (1 - F.lit(0.25) * (F.col("line") % 4)))
)
query("trailing_stop_path", """
b AS (SELECT symbol, bar_start, close, first_value(close) OVER (PARTITION BY symbol, CAST(bar_start AS DATE) ORDER BY bar_start ROWS UNBOUNDED PRECEDING) AS entry, max(close) OVER (PARTITION BY symbol, CAST(bar_start AS DATE) ORDER BY bar_start ROWS UNBOUNDED PRECEDING) AS best FROM bars_1h)
SELECT symbol, bar_start, round(greatest(best, entry) * (1 - 1 * 0.015::DOUBLE), 6) AS stop FROM b""")(  # fmt: skip
    lambda t: (lambda w: t.bars("1h").withColumns({"entry": F.first("close").over(w), "best": F.max("close").over(w)}).select("symbol", "bar_start", r(K.trailing_stop(F.col("entry"), F.col("best"), F.lit(1), 1.5)).alias("stop")))(
        Window.partitionBy("symbol", F.to_date("bar_start")).orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
    )
)


# --- simulation ---------------------------------------------------------------------------------------------


def simulated(t: Tables) -> DataFrame:
    return X.simulate(matrix(t).withColumn("run_id", F.col("strategy")))


@query("simulate_trades")
def simulate_trades(t: Tables) -> DataFrame:
    return X.trades(simulated(t)).select("run_id", "symbol", "side", r("entry_price", 4).alias("entry_price"), r("exit_price", 4).alias("exit_price"), r("pnl", 4).alias("pnl"), "exit_reason", "opened_at", "closed_at")


@query("simulate_equity")
def simulate_equity(t: Tables) -> DataFrame:
    return X.equity(simulated(t))


@query("simulate_metrics")
def simulate_metrics(t: Tables) -> DataFrame:
    from ..functions.store import stored

    done = stored(simulated(t))
    return M.backtest_metrics(X.trades(done), X.equity(done))


# --- comparison of runs -------------------------------------------------------------------------------------


def _other_run(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The trades, by the month that they were opened in, and those of a second run, which lacks some, repeats some and differs in some."""
    own = t.trades.select("strategy", "symbol", "side", F.date_trunc("month", "opened_at").cast("timestamp_ntz").alias("opened_at"), "trade_id", "line", "entry_price", "quantity")
    other = own.where(F.col("trade_id") % 7 != 0).withColumn("entry_price", F.when(F.col("trade_id") % 5 == 0, F.col("entry_price") + 3).otherwise(F.col("entry_price") + 1))
    return own, other.unionByName(other.where(F.col("trade_id") % 11 == 0))


@query("trade_matching", """a AS (SELECT strategy, symbol, side, CAST(date_trunc('month', opened_at) AS TIMESTAMP) AS opened_at, trade_id, line, entry_price, quantity FROM trades),
o AS (SELECT * REPLACE (entry_price + CASE WHEN trade_id % 5 = 0 THEN 3 ELSE 1 END AS entry_price) FROM a WHERE trade_id % 7 <> 0),
b AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE trade_id % 11 = 0),
x AS (SELECT *, row_number() OVER (PARTITION BY strategy, symbol, side, opened_at ORDER BY trade_id, line, entry_price, quantity) AS n FROM a),
y AS (SELECT *, row_number() OVER (PARTITION BY strategy, symbol, side, opened_at ORDER BY trade_id, line, entry_price, quantity) AS n FROM b)
SELECT strategy, symbol, side, opened_at, CAST(n AS INTEGER) AS ordinal, CASE WHEN y.quantity IS NULL THEN 'left' WHEN x.quantity IS NULL THEN 'right' WHEN abs(x.entry_price - y.entry_price) <= 2 AND abs(x.quantity - y.quantity) <= 0.5 THEN 'same' ELSE 'different' END AS status,
  round(x.entry_price, 4) AS entry_left, round(y.entry_price, 4) AS entry_right FROM x FULL JOIN y USING (strategy, symbol, side, opened_at, n)""")  # fmt: skip
def trade_matching(t: Tables) -> DataFrame:
    from ..operators.compare import match_trades

    own, other = _other_run(t)
    found = match_trades(own, other, {"entry_price": 2.0, "quantity": 0.5}, order=("trade_id", "line"))
    return found.select("strategy", "symbol", "side", "opened_at", "ordinal", "status", r("entry_price_left", 4).alias("entry_left"), r("entry_price_right", 4).alias("entry_right"))
