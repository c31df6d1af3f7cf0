"""Queries over indicators, conditions and signals, on hourly bars."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import recursive as R
from ..functions import rolling as W
from ..operators import conditions as C
from ..operators import indicators as I
from ..operators import signals as S
from ..schema import Strategy
from ..sources.domain import Tables
from . import sqlparts as Q
from .market import r
from .registry import query

KEY = ("symbol", "bar_start")


def shown(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*KEY, *[r(n, digits).alias(n) for n in names])


def _indicator(name: str, config: dict, columns: tuple[str, ...], sql: str) -> None:
    query(name, sql)(lambda t: shown(I.with_indicators(t.bars("1h"), config), *columns))


def _recursive(body: str, table: str, columns: str) -> str:
    return f"RECURSIVE {body}\nSELECT s.symbol, s.bar_start, {columns} FROM s LEFT JOIN {table} USING (symbol, n)"


_indicator("ind_rsi", {"rsi": {"period": 14}}, ("rsi",), _recursive(Q.RSI, "rsi", "round(rsi, 6) AS rsi"))
_indicator("ind_macd", {"macd": {}}, ("macd", "macd_signal", "macd_histogram"), _recursive(Q.BASE + ",\n" + Q.MACD, "macd", "round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(macd_histogram, 6) AS macd_histogram"))
_indicator("ind_atr", {"atr": {"period": 14}}, ("atr",), _recursive(Q.BASE + ",\n" + Q.ATR, "atr", "round(atr.e, 6) AS atr"))
_indicator("ind_atr_ratio", {"atr": {"period": 14}}, ("atr_ratio",), _recursive(Q.BASE + ",\n" + Q.ATR, "atr", "round(atr.e / nullif(close, 0), 6) AS atr_ratio"))
_indicator("ind_adx", {"adx": {"period": 14}}, ("adx",), _recursive(Q.BASE + ",\n" + Q.ADX, "adx", "round(adx.e, 6) AS adx"))
_indicator("ind_ema", {"ema": {"period": 30}}, ("ema_30",), _recursive(Q.BASE + ",\n" + Q.ema("e", "s", "close", 30), "e", "round(e.e, 6) AS ema_30"))

_TWO_EMAS = Q.BASE + ",\n" + Q.ema("a", "s", "close", 9) + ",\n" + Q.ema("b", "s", "close", 21)
query("ind_ema_defaults", f"RECURSIVE {_TWO_EMAS}\nSELECT s.symbol, s.bar_start, round(a.e, 6) AS ema_fast, round(b.e, 6) AS ema_slow FROM s LEFT JOIN a USING (symbol, n) LEFT JOIN b USING (symbol, n)")(
    lambda t: shown(I.with_indicators(t.bars("1h"), {}), "ema_fast", "ema_slow")
)
_MEAN, _DEV = Q.rolling("avg", "close", 20), Q.rolling("stddev_pop", "close", 20)
_indicator("ind_bollinger", {"bollinger": {"period": 20, "std": 2}}, ("bollinger_upper", "bollinger_middle", "bollinger_lower", "bollinger_width"), f"""
SELECT symbol, bar_start, round(m + 2 * d, 6) AS bollinger_upper, round(m, 6) AS bollinger_middle, round(m - 2 * d, 6) AS bollinger_lower, round(4 * d / nullif(m, 0), 6) AS bollinger_width
FROM (SELECT symbol, bar_start, {_MEAN} AS m, {_DEV} AS d FROM bars_1h)""")  # fmt: skip
_indicator("ind_bollinger_3", {"bollinger": {"period": 20, "stddev": 3}}, ("bollinger_upper", "bollinger_lower", "bollinger_width"), f"""
SELECT symbol, bar_start, round(m + 3 * d, 6) AS bollinger_upper, round(m - 3 * d, 6) AS bollinger_lower, round(6 * d / nullif(m, 0), 6) AS bollinger_width
FROM (SELECT symbol, bar_start, {_MEAN} AS m, {_DEV} AS d FROM bars_1h)""")  # fmt: skip
_indicator("ind_ema_fast_slow", {"ema": {"fast_period": 12, "slow_period": 26}}, ("ema_fast", "ema_slow"), "RECURSIVE " + Q.BASE + ",\n" + Q.ema("a", "s", "close", 12) + ",\n" + Q.ema("b", "s", "close", 26) + "\nSELECT s.symbol, s.bar_start, round(a.e, 6) AS ema_fast, round(b.e, 6) AS ema_slow FROM s LEFT JOIN a USING (symbol, n) LEFT JOIN b USING (symbol, n)")
_PERIODS = (10, 20, 50)
_indicator("ind_ema_periods", {"ema": {"periods": [*_PERIODS]}}, tuple(f"ema_{k}" for k in _PERIODS), "RECURSIVE " + Q.BASE + "".join(",\n" + Q.ema(f"e{k}", "s", "close", k) for k in _PERIODS) + "\nSELECT s.symbol, s.bar_start, " + ", ".join(f"round(e{k}.e, 6) AS ema_{k}" for k in _PERIODS) + " FROM s " + " ".join(f"LEFT JOIN e{k} USING (symbol, n)" for k in _PERIODS))
_indicator("ind_bb_width_sma", {"bollinger": {"period": 20}}, ("bollinger_width_sma",), f"""
b AS (SELECT symbol, bar_start, 4 * {_DEV} / nullif({_MEAN}, 0) AS width FROM bars_1h)
SELECT symbol, bar_start, round({Q.rolling("avg", "width", 20)}, 6) AS bollinger_width_sma FROM b""")  # fmt: skip
_indicator("ind_sma", {"sma": {"period": 10}}, ("sma_10", "sma"), f"SELECT symbol, bar_start, round({Q.rolling('avg', 'close', 10)}, 6) AS sma_10, round({Q.rolling('avg', 'close', 10)}, 6) AS sma FROM bars_1h")
_indicator("ind_stoch", {"stochastic": {"period": 14}}, ("stoch_k", "stoch_d"), f"""
a AS (SELECT symbol, bar_start, 100 * (close - {Q.rolling("min", "low", 14)}) / nullif({Q.rolling("max", "high", 14)} - {Q.rolling("min", "low", 14)}, 0) AS fast FROM bars_1h),
k AS (SELECT symbol, bar_start, {Q.rolling("avg", "fast", 3)} AS k FROM a)
SELECT symbol, bar_start, round(k, 6) AS stoch_k, round({Q.rolling("avg", "k", 3)}, 6) AS stoch_d FROM k""")  # fmt: skip
_indicator("ind_obv", {"obv": {}}, ("obv", "obv_sma"), f"""
a AS (SELECT symbol, bar_start, coalesce(sign(close - lag(close) OVER w), 1) * volume AS v FROM bars_1h {Q.W}),
o AS (SELECT symbol, bar_start, sum(v) OVER (PARTITION BY symbol ORDER BY bar_start ROWS UNBOUNDED PRECEDING) AS obv FROM a)
SELECT symbol, bar_start, round(obv, 6) AS obv, round({Q.rolling("avg", "obv", 20)}, 6) AS obv_sma FROM o""")  # fmt: skip
_indicator("ind_cci", {"cci": {"period": 14}}, ("cci",), f"""
a AS (SELECT symbol, bar_start, (high + low + close) / 3 AS tp FROM bars_1h),
b AS (SELECT *, {Q.rolling("avg", "tp", 14)} AS m, list(tp) OVER (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS l FROM a)
SELECT symbol, bar_start, round((tp - m) / nullif(0.015::DOUBLE * list_sum(list_transform(l, lambda x: abs(x - m))) / 14, 0), 6) AS cci FROM b""")  # fmt: skip
_indicator("ind_volume_ratio", {}, ("volume_sma", "volume_ratio"), f"SELECT symbol, bar_start, round({Q.rolling('avg', 'volume', 20)}, 6) AS volume_sma, round(volume / nullif({Q.rolling('avg', 'volume', 20)}, 0), 6) AS volume_ratio FROM bars_1h")
_indicator("ind_momentum_24", {}, ("price_momentum_24h",), f"SELECT symbol, bar_start, round(close / nullif(lag(close, 24) OVER w, 0) - 1, 6) AS price_momentum_24h FROM bars_1h {Q.W}")

# --- conditions ---------------------------------------------------------------------------------------------

SETUP = {"sma": {"period": 10}, "bollinger": {"period": 20}, "stochastic": {"period": 14}}
#: One row for each bar with the finite-frame indicators, in SQL.
FRAME = f"""
f0 AS (SELECT *, {Q.rolling("avg", "close", 10)} AS sma, {_MEAN} AS bollinger_middle, {_DEV} AS d, {Q.rolling("avg", "volume", 20)} AS volume_sma,
  100 * (close - {Q.rolling("min", "low", 14)}) / nullif({Q.rolling("max", "high", 14)} - {Q.rolling("min", "low", 14)}, 0) AS fast FROM bars_1h),
f AS MATERIALIZED (SELECT *, bollinger_middle - 2 * d AS bollinger_lower, bollinger_middle + 2 * d AS bollinger_upper, {Q.rolling("avg", "fast", 3)} AS stoch_k, volume / nullif(volume_sma, 0) AS volume_ratio FROM f0)
"""


def frame(t: Tables) -> DataFrame:
    return I.with_indicators(t.bars("1h"), SETUP)


def _condition(name: str, text: str, sql: str) -> None:
    query(name, f"{FRAME}SELECT symbol, bar_start, coalesce({sql}, false) AS met FROM f")(lambda t: (lambda f: f.select(*KEY, C.compile_condition(text, f.columns).alias("met")))(frame(t)))


_condition("condition_simple", "close < bollinger_middle", "close < bollinger_middle")
_condition("condition_and_or", "(stoch_k < 30 and close < sma) or volume_ratio > 1.5", "(stoch_k < 30 AND close < sma) OR volume_ratio > 1.5")
_condition("condition_unknown_false", "nonexistent_column > 50", "false")
_condition("condition_sma_fn", "close > sma(close, 5) * 1.01", f"close > ({Q.rolling('avg', 'close', 5)}) * 1.01::DOUBLE")

POOL = ("close > sma", "close < sma", "stoch_k < 20", "stoch_k > 80", "close < bollinger_lower", "close > bollinger_upper", "volume_ratio > 1.2", "volume_ratio < 0.8 and close > sma", "adx > 25")
_POOL_SQL = " UNION ALL ".join(f"SELECT '{p}' AS condition, CAST(count(*) FILTER ({'false' if 'adx' in p else p}) AS BIGINT) AS bars FROM f" for p in POOL)


@query("condition_pool_counts", FRAME + _POOL_SQL)
def condition_pool_counts(t: Tables) -> DataFrame:
    f = frame(t)
    named = f.select(*[C.compile_condition(p, f.columns).alias(f"c{i}") for i, p in enumerate(POOL)])
    counted = named.agg(*[F.count_if(F.col(f"c{i}")).alias(f"c{i}") for i in range(len(POOL))])
    each = F.array(*[F.struct(F.lit(p).alias("condition"), F.col(f"c{i}").alias("bars")) for i, p in enumerate(POOL)])
    return counted.select(F.explode(each).alias("x")).select("x.*")


#: All indicators that the published predicates name.
EVERY = {"rsi": {"period": 14}, "macd": {}, "bollinger": {"period": 20}, "adx": {"period": 14}, "atr": {"period": 14}, "stoch": {"period": 14}, "cci": {"period": 14}, "obv": {}, "sma": {"period": 10}}
#: One row for each bar with all of them, in SQL.
_EVERY = "RECURSIVE " + Q.RSI + ",\n" + ",\n".join([Q.MACD, Q.ATR, Q.ADX, Q.ema("fast9", "s", "close", 9), Q.ema("slow21", "s", "close", 21)]) + f""",
g0 AS MATERIALIZED (SELECT s.*, rsi, macd_histogram, atr.e / nullif(close, 0) AS atr_ratio, adx.e AS adx, fast9.e AS ema_fast, slow21.e AS ema_slow, (high + low + close) / 3 AS tp, {Q.rolling("avg", "close", 10)} AS sma, {_MEAN} AS bollinger_middle, {_DEV} AS d,
  volume / nullif({Q.rolling("avg", "volume", 20)}, 0) AS volume_ratio, 100 * (close - {Q.rolling("min", "low", 14)}) / nullif({Q.rolling("max", "high", 14)} - {Q.rolling("min", "low", 14)}, 0) AS fast_k, coalesce(sign(close - pc), 1) * volume AS v
  FROM s LEFT JOIN rsi USING (symbol, n) LEFT JOIN macd USING (symbol, n) LEFT JOIN atr USING (symbol, n) LEFT JOIN adx USING (symbol, n) LEFT JOIN fast9 USING (symbol, n) LEFT JOIN slow21 USING (symbol, n)),
g1 AS (SELECT *, bollinger_middle - 2 * d AS bollinger_lower, bollinger_middle + 2 * d AS bollinger_upper, {Q.rolling("avg", "fast_k", 3)} AS stoch_k, sum(v) OVER (PARTITION BY symbol ORDER BY bar_start ROWS UNBOUNDED PRECEDING) AS obv,
  {Q.rolling("avg", "tp", 14)} AS m, list(tp) OVER (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS l FROM g0),
g AS MATERIALIZED (SELECT *, {Q.rolling("avg", "stoch_k", 3)} AS stoch_d, {Q.rolling("avg", "obv", 20)} AS obv_sma, (tp - m) / nullif(0.015::DOUBLE * list_sum(list_transform(l, lambda x: abs(x - m))) / 14, 0) AS cci FROM g1)
"""  # fmt: skip
_VOCABULARY = [(f"{kind}_{side}", text) for kind, pool in (("entry", C.ENTRY_POOL), ("exit", C.EXIT_POOL)) for side, texts in pool.items() for text in texts]


@query("predicate_vocabulary", _EVERY + " UNION ALL ".join(f"SELECT '{slot}' AS slot, '{text}' AS condition, CAST(count(*) FILTER ({text}) AS BIGINT) AS bars FROM g" for slot, text in _VOCABULARY))
def predicate_vocabulary(t: Tables) -> DataFrame:
    f = I.with_indicators(t.bars("1h"), EVERY)
    met = f.select(*[C.compile_condition(text, f.columns).alias(f"c{i}") for i, (_, text) in enumerate(_VOCABULARY)])
    counted = met.agg(*[F.count_if(F.col(f"c{i}")).alias(f"c{i}") for i in range(len(_VOCABULARY))])
    each = F.array(*[F.struct(F.lit(slot).alias("slot"), F.lit(text).alias("condition"), F.col(f"c{i}").alias("bars")) for i, (slot, text) in enumerate(_VOCABULARY)])
    return counted.select(F.explode(each).alias("x")).select("x.*")


LONG, SHORT = ("close < sma", "stoch_k < 50"), ("close > sma", "stoch_k > 50")
STRATEGIES = (
    Strategy("reversal", SETUP, {"long": LONG, "short": SHORT}, {"long": ("close > bollinger_middle", "stoch_k > 80"), "short": ("close < bollinger_middle", "stoch_k < 20")}),
    Strategy("breakout", SETUP, {"long": ("close > bollinger_upper",), "short": ("close < bollinger_lower",)}, {"long": ("close < sma",), "short": ("close > sma",)}, symbols=("click", "view")),
)
_SIGNALS = FRAME + """,
e AS (SELECT symbol, bar_start, bar_end, close, coalesce(close < sma AND stoch_k < 50, false) AS l, coalesce(close > sma AND stoch_k > 50, false) AS s,
  coalesce(close > bollinger_middle, false) OR coalesce(stoch_k > 80, false) AS xl, coalesce(close < bollinger_middle, false) OR coalesce(stoch_k < 20, false) AS xs,
  coalesce(close > bollinger_upper, false) AS bl, coalesce(close < bollinger_lower, false) AS bs, coalesce(close < sma, false) AS bxl, coalesce(close > sma, false) AS bxs FROM f),
m AS (SELECT 'reversal' AS strategy, symbol, '1h' AS tf, bar_end AS ts, CAST(CASE WHEN l AND NOT s THEN 1 WHEN s AND NOT l THEN -1 ELSE 0 END AS INTEGER) AS side, xl AS exit_long, xs AS exit_short, close FROM e
  UNION ALL SELECT 'breakout', symbol, '1h', bar_end, CAST(CASE WHEN bl AND NOT bs THEN 1 WHEN bs AND NOT bl THEN -1 ELSE 0 END AS INTEGER), bxl, bxs, close FROM e WHERE symbol IN ('click', 'view'))
"""  # fmt: skip


def matrix(t: Tables) -> DataFrame:
    return S.signal_matrix(t.bars("1h"), STRATEGIES)


query("signal_matrix", _SIGNALS + "SELECT * FROM m")(matrix)
query("entry_and_signals", _SIGNALS + "SELECT symbol, bar_start, l AS long, s AS short FROM e")(
    lambda t: (lambda f: f.select(*KEY, C.combine(LONG, f.columns).alias("long"), C.combine(SHORT, f.columns).alias("short")))(frame(t))
)
query("exit_or_signals", _SIGNALS + "SELECT symbol, bar_start, xl AS exit_long, xs AS exit_short FROM e")(
    lambda t: (lambda f: f.select(*KEY, C.combine(STRATEGIES[0].exit["long"], f.columns, "or").alias("exit_long"), C.combine(STRATEGIES[0].exit["short"], f.columns, "or").alias("exit_short")))(frame(t))
)
query("signal_side", _SIGNALS + "SELECT strategy, symbol, ts, side FROM m WHERE side <> 0")(lambda t: matrix(t).where("side <> 0").select("strategy", "symbol", "ts", "side"))
query("signal_totals", _SIGNALS + "SELECT strategy, CAST(count(*) AS BIGINT) AS bars, CAST(count(*) FILTER (side = 1) AS BIGINT) AS longs, CAST(count(*) FILTER (side = -1) AS BIGINT) AS shorts, CAST(count(*) FILTER (exit_long) AS BIGINT) AS exits FROM m GROUP BY strategy")(
    lambda t: matrix(t).groupBy("strategy").agg(F.count("*").alias("bars"), F.count_if(F.col("side") == 1).alias("longs"), F.count_if(F.col("side") == -1).alias("shorts"), F.count_if("exit_long").alias("exits"))
)


@query("signal_lookup_default", _SIGNALS + """, q AS (SELECT s.strategy, t.symbol, date_trunc('hour', t.ts) AS ts, t.seq FROM ticks t CROSS JOIN (SELECT unnest(['reversal', 'breakout', 'missing']) AS strategy) s)
SELECT q.strategy, q.symbol, q.seq, CAST(coalesce(m.side, 0) AS INTEGER) AS side, coalesce(m.exit_long, false) AS exit_long FROM q LEFT JOIN m USING (strategy, symbol, ts)""")  # fmt: skip
def signal_lookup_default(t: Tables) -> DataFrame:
    asked = t.ticks.select("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "seq")
    asked = asked.withColumn("strategy", F.explode(F.array(*map(F.lit, ("reversal", "breakout", "missing")))))
    found = asked.join(matrix(t).select("strategy", "symbol", "ts", "side", "exit_long"), ["strategy", "symbol", "ts"], "left")
    return found.select("strategy", "symbol", "seq", F.coalesce("side", F.lit(0)).alias("side"), F.coalesce("exit_long", F.lit(False)).alias("exit_long"))


@query("stale_signal_purge", _SIGNALS + "SELECT strategy, symbol, ts, side FROM m WHERE strategy <> 'breakout'")
def stale_signal_purge(t: Tables) -> DataFrame:
    gone = t.spark.createDataFrame([("breakout",)], "strategy string")
    return matrix(t).join(gone, "strategy", "left_anti").select("strategy", "symbol", "ts", "side")


@query("condition_diagnostics", FRAME + "SELECT symbol, max(bar_end) - INTERVAL 1 hour AS ts, c AS condition, arg_max(met, bar_start) AS met FROM (" + " UNION ALL ".join(f"SELECT symbol, bar_start, bar_end, '{p}' AS c, coalesce({'false' if 'adx' in p else p}, false) AS met FROM f" for p in POOL) + ") GROUP BY symbol, c")
def condition_diagnostics(t: Tables) -> DataFrame:
    return S.diagnostics(frame(t), POOL)


@query("indicator_snapshot", FRAME + "SELECT symbol, max(bar_start) AS bar_start, round(arg_max(sma, bar_start), 6) AS sma, round(arg_max(stoch_k, bar_start), 6) AS stoch_k, round(arg_max(bollinger_lower, bar_start), 6) AS bollinger_lower FROM f GROUP BY symbol")
def indicator_snapshot(t: Tables) -> DataFrame:
    names = ("sma", "stoch_k", "bollinger_lower")
    latest = frame(t).groupBy("symbol").agg(F.max("bar_start").alias("bar_start"), F.max_by(F.struct(*names), "bar_start").alias("s"))
    return latest.select("symbol", "bar_start", *[r(f"s.{n}").alias(n) for n in names])


# --- fusion, trend, regime ----------------------------------------------------------------------------------

_FUSION = _SIGNALS + """, k AS (SELECT m.*, row_number() OVER (PARTITION BY strategy, symbol ORDER BY ts) AS i FROM m),
u AS (SELECT *, (0.5::DOUBLE * side + 0.3::DOUBLE * (2 * ((i % 10) / 10.0::DOUBLE) - 1) + 0.2::DOUBLE * ((i % 7) / 7.0::DOUBLE)) / (0.5::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE) AS score FROM k)
"""  # fmt: skip


def _fused(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("strategy", "symbol").orderBy("ts"))
    rows = matrix(t).withColumn("i", i)
    return rows.withColumn("score", S.fuse(F.col("side"), (F.col("i") % 10) / F.lit(10.0), (F.col("i") % 7) / F.lit(7.0)))


query("signal_fusion", _FUSION + "SELECT strategy, symbol, ts, round(score, 6) AS score FROM u")(lambda t: _fused(t).select("strategy", "symbol", "ts", r("score").alias("score")))
query("signal_threshold", _FUSION + "SELECT strategy, symbol, ts, round(score, 6) AS score FROM u WHERE abs(score) >= CASE WHEN i % 2 = 0 THEN 0.65 ELSE 0.5 END - 1e-9")(
    lambda t: _fused(t).where(S.passes(F.col("score"), F.col("i") % 2 == 0)).select("strategy", "symbol", "ts", r("score").alias("score"))
)


@query("htf_trend_multiplier", "RECURSIVE " + Q.BASE + ",\n" + Q.ewm("e", "s", "close", 50) + """,
p AS (SELECT s.symbol, s.bar_start, s.n, (s.close - e.e) / nullif(e.e, 0) AS dev, e.e FROM s JOIN e USING (symbol, n))
SELECT symbol, bar_start, CASE WHEN n + 1 < 50 OR e <= 0 OR dev >= 0 THEN 1.0 WHEN dev > -0.02 THEN 0.6 ELSE 0.0 END::DOUBLE AS long, CASE WHEN n + 1 < 50 OR e <= 0 OR dev <= 0 THEN 1.0 WHEN dev < 0.02 THEN 0.6 ELSE 0.0 END::DOUBLE AS short FROM p""")  # fmt: skip
def htf_trend_multiplier(t: Tables) -> DataFrame:
    rows = R.with_recursions(t.bars("1h"), [R.Recursion(("slow",), ("close",), partial(R.ewm, span=50), R.ewm_program("close", 50))])
    n = F.row_number().over(W.ordered())
    both = [S.trend_multiplier(F.col("close"), F.col("slow"), F.lit(x), n).alias(name) for name, x in (("long", 1), ("short", -1))]
    return rows.select(*KEY, *both)


_REGIME = "RECURSIVE " + Q.BASE + ",\n" + Q.ewm("a", "s", "close", 20) + ",\n" + Q.ewm("b", "s", "close", 50) + """,
g AS (SELECT s.symbol, s.bar_start, s.n, CASE WHEN n + 1 < 100 THEN 'range' WHEN close > a.e AND a.e > b.e THEN 'bull' WHEN close < a.e AND a.e < b.e THEN 'bear' ELSE 'range' END AS regime FROM s JOIN a USING (symbol, n) JOIN b USING (symbol, n))
"""  # fmt: skip


def _regimes(t: Tables) -> DataFrame:
    rows = R.with_recursions(t.bars("1h"), [R.Recursion((f"e{n}",), ("close",), partial(R.ewm, span=n), R.ewm_program("close", n)) for n in (20, 50)])
    n = F.row_number().over(W.ordered())
    return rows.select(*KEY, (n - 1).alias("n"), S.regime(F.col("close"), F.col("e20"), F.col("e50"), n).alias("regime"))


query("market_regime", _REGIME + "SELECT symbol, bar_start, regime FROM g")(lambda t: _regimes(t).select(*KEY, "regime"))


@query("regime_weights", _REGIME + """, w AS (SELECT *, CASE WHEN n % 24 = 0 THEN CASE regime WHEN 'bull' THEN 0.6 WHEN 'bear' THEN 0.45 ELSE 0.5 END END AS i, CASE WHEN n % 24 = 0 THEN CASE regime WHEN 'bull' THEN 0.25 WHEN 'bear' THEN 0.4 ELSE 0.3 END END AS m FROM g)
SELECT symbol, bar_start, round(last_value(i IGNORE NULLS) OVER w2, 6)::DOUBLE AS indicator_weight, round(last_value(m IGNORE NULLS) OVER w2, 6)::DOUBLE AS ml_weight FROM w WINDOW w2 AS (PARTITION BY symbol ORDER BY bar_start ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def regime_weights(t: Tables) -> DataFrame:
    i, m = S.regime_weights(F.col("n"), F.col("regime"))
    rows = _regimes(t).withColumns({"i": i, "m": m})
    return rows.select(*KEY, r(W.forward_fill(F.col("i"))).alias("indicator_weight"), r(W.forward_fill(F.col("m"))).alias("ml_weight"))


@query("strategy_symbol_matrix", "SELECT s.name AS strategy, t.symbol FROM (SELECT 'reversal' AS name, [] AS symbols UNION ALL SELECT 'breakout', ['click', 'view']) s JOIN (SELECT DISTINCT event_type AS symbol FROM events) t ON len(s.symbols) = 0 OR list_contains(s.symbols, t.symbol)")
def strategy_symbol_matrix(t: Tables) -> DataFrame:
    strategies = t.spark.createDataFrame([(s.name, [*s.symbols]) for s in STRATEGIES], "strategy string, symbols array<string>")
    return S.strategy_symbols(strategies, t.events.select(F.col("event_type").alias("symbol")).distinct())


@query("strategy_catalog", "SELECT * FROM (VALUES ('reversal', true, 0, 1), ('breakout', true, 2, 1)) v(name, enabled, n_symbols, n_timeframes)")
def strategy_catalog(t: Tables) -> DataFrame:
    rows = [(s.name, s.enabled, [*s.symbols], [*s.timeframes]) for s in STRATEGIES]
    made = t.spark.createDataFrame(rows, "name string, enabled boolean, symbols array<string>, timeframes array<string>")
    return made.select("name", "enabled", F.size("symbols").alias("n_symbols"), F.size("timeframes").alias("n_timeframes"))


@query("config_hash", """c AS (SELECT p_partkey, '{"fast": ' || p_size % 6 || ', "period": ' || p_size % 4 || CASE WHEN p_partkey % 2 = 0 THEN ', "slow": ' || (20 + p_size % 3) ELSE '' END || '}' AS text FROM part)
SELECT left(sha256(text), 16) AS hash, count(*) AS strategies, min(p_partkey) AS first FROM c GROUP BY text""")  # fmt: skip
def config_hash(t: Tables) -> DataFrame:
    """Strategies, here parts, by their indicators' configuration: those of one hash share a computation."""
    size, entry = F.col("p_size"), lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("int").alias("value"))
    slow = F.when(F.col("p_partkey") % 2 == 0, F.array(entry("slow", 20 + size % 3))).otherwise(F.array().cast("array<struct<key:string,value:int>>"))
    config = F.map_from_entries(F.concat(F.array(entry("period", size % 4), entry("fast", size % 6)), slow))
    return t.part.groupBy(S.config_hash_of(config).alias("hash")).agg(F.count("*").alias("strategies"), F.min("p_partkey").alias("first"))


@query("primary_timeframe", "SELECT '1h' AS primary_tf")
def primary_timeframe(t: Tables) -> DataFrame:
    from ..schema import MINUTES

    rows = t.spark.createDataFrame([(x, MINUTES[x]) for x in ("4h", "1d", "1h")], "tf string, minutes int")
    return rows.agg(F.min_by("tf", "minutes").alias("primary_tf"))
