"""Queries over ticks and bars: scans, upserts, resampling, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import resample as RS
from ..operators import signals as S
from ..sources import market as M
from ..sources.domain import Tables
from .registry import query

D = "CAST({} AS DOUBLE)"


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


BAR_OUT = ("symbol", "bar_start", "open", "high", "low", "close", "volume")

for _name in ("5m", "15m", "1h", "4h", "1d"):
    query(f"ohlcv_resample_{_name}", f"SELECT symbol, bar_start, open, high, low, close, volume FROM bars_{_name}")(lambda t, n=_name: t.bars(n).select(*BAR_OUT))

query("ohlcv_coarsen_4h", "SELECT symbol, bar_start, open, high, low, close, volume FROM bars_4h")(lambda t: RS.coarsen(t.bars("1h"), "4h").select(*BAR_OUT))


@query("scan_bars", "SELECT bar_start, open, high, low, close, volume FROM bars_1h WHERE symbol = 'click'")
def scan_bars(t: Tables) -> DataFrame:
    return t.bars("1h").where(F.col("symbol") == "click").select("bar_start", "open", "high", "low", "close", "volume")


@query("candle_upsert", """
u AS (SELECT symbol, ts, price, seq FROM ticks UNION ALL SELECT symbol, ts, price + 1, seq + 1000000000 FROM ticks WHERE seq % 7 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS n FROM u)
SELECT symbol, ts, price FROM k WHERE n = 1""")  # fmt: skip
def candle_upsert(t: Tables) -> DataFrame:
    have = t.ticks.select("symbol", "ts", "price", "seq")
    new = have.where(F.col("seq") % 7 == 0).select("symbol", "ts", (F.col("price") + 1).alias("price"), (F.col("seq") + 1_000_000_000).alias("seq"))
    return M.upsert(have, new, ("symbol", "ts"), "seq").select("symbol", "ts", "price")


@query("feeder_range_scan", "SELECT symbol, ts, price FROM ticks WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def feeder_range_scan(t: Tables) -> DataFrame:
    return M.time_range(t.ticks, "2024-01-05", "2024-01-12").select("symbol", "ts", "price")


@query("unified_timeline", "SELECT DISTINCT bar_start AS ts FROM bars_1h UNION SELECT bar_start FROM bars_4h")
def unified_timeline(t: Tables) -> DataFrame:
    return M.timeline(t.bars("1h"), t.bars("4h"))


@query("tail_n_per_series", "SELECT symbol, bar_start, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_start DESC) AS n FROM bars_1h) WHERE n <= 50")
def tail_n_per_series(t: Tables) -> DataFrame:
    return M.tail(t.bars("1h"), 50).select("symbol", "bar_start", "close")


@query("second_last_bar", "SELECT symbol, bar_start, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_start DESC) AS n FROM bars_1h) WHERE n = 2")
def second_last_bar(t: Tables) -> DataFrame:
    return M.nth_last(t.bars("1h"), 2).select("symbol", "bar_start", "close")


@query("json_kline_parse", "SELECT event_type AS symbol, CAST(epoch_us(ts) // 1000 AS BIGINT) AS close_ms, value AS close, round(value + 1, 6) AS high, round(value - 1, 6) AS low FROM events WHERE event_id % 3 = 0")
def json_kline_parse(t: Tables) -> DataFrame:
    text = lambda c: c.cast("string")
    k = F.struct(
        F.col("event_type").alias("s"), F.lit("1m").alias("i"), text(F.col("value")).alias("c"), (F.col("event_id") % 3 == 0).alias("x"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("T"), text(F.col("value")).alias("o"), text(F.col("value") + 1).alias("h"), text(F.col("value") - 1).alias("l"), F.lit("1").alias("v"),
    )
    messages = t.events.select(F.to_json(F.struct(F.lit("kline").alias("stream"), F.struct(F.lit("kline").alias("e"), k.alias("k")).alias("data"))).alias("message"))
    return M.parse_klines(messages).select("symbol", "close_ms", "close", r("high").alias("high"), r("low").alias("low"))


@query("kline_dedup", """
u AS (SELECT symbol, ts, price, volume, seq FROM ticks UNION ALL SELECT symbol, ts, price, volume, seq FROM ticks WHERE seq % 5 = 0)
SELECT symbol, ts, max(price) AS price FROM u GROUP BY symbol, ts""")  # fmt: skip
def kline_dedup(t: Tables) -> DataFrame:
    have = t.ticks
    return M.keep_last(have.unionByName(have.where(F.col("seq") % 5 == 0)), ("symbol", "ts"), "seq").select("symbol", "ts", "price")


@query("kline_api_shape", "SELECT symbol, CAST(epoch(bar_start) AS BIGINT) AS time, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume FROM bars_1h")
def kline_api_shape(t: Tables) -> DataFrame:
    seconds = F.unix_seconds(F.col("bar_start").cast("timestamp"))
    return t.bars("1h").select("symbol", seconds.alias("time"), *[r(c, 4).alias(c) for c in ("open", "high", "low", "close", "volume")])


@query("epoch_ms_to_ts", "SELECT event_id, make_timestamp_ms(CAST(epoch_us(ts) // 1000 AS BIGINT)) AS at FROM events")
def epoch_ms_to_ts(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", F.timestamp_millis(ms).cast("timestamp_ntz").alias("at"))


# --- joins --------------------------------------------------------------------------------------------------


@query("asof_slice", """
g AS (SELECT DISTINCT date_trunc('hour', ts) + INTERVAL 30 minutes AS ts FROM events),
p AS (SELECT s.symbol, g.ts FROM g CROSS JOIN (SELECT DISTINCT symbol FROM ticks) s)
SELECT p.symbol, p.ts, k.price FROM p ASOF LEFT JOIN ticks k ON p.symbol = k.symbol AND p.ts >= k.ts""")  # fmt: skip
def asof_slice(t: Tables) -> DataFrame:
    hours = t.events.select((F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 30 MINUTES")).alias("ts")).distinct()
    symbols = t.ticks.select("symbol").distinct()
    return S.asof(hours.join(symbols), t.ticks.select("symbol", "ts", "price"), ["price"]).select("symbol", "ts", "price")


@query("asof_htf_join", "SELECT b.symbol, b.bar_end, b.close, h.close AS htf_close FROM bars_1h b ASOF LEFT JOIN bars_4h h ON b.symbol = h.symbol AND b.bar_end >= h.bar_end")
def asof_htf_join(t: Tables) -> DataFrame:
    low = t.bars("1h").select("symbol", "bar_end", "close")
    high = t.bars("4h").select("symbol", F.col("bar_end").alias("ts"), F.col("close").alias("htf_close"))
    return S.asof(low, high, ["htf_close"], left_time="bar_end").select("symbol", "bar_end", "close", "htf_close")


@query("signal_price_join", "SELECT t.symbol, t.ts, b.close FROM ticks t JOIN bars_1h b ON t.symbol = b.symbol AND date_trunc('hour', t.ts) = b.bar_start")
def signal_price_join(t: Tables) -> DataFrame:
    asked = t.ticks.withColumn("bar_start", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return asked.join(t.bars("1h").select("symbol", "bar_start", "close"), ["symbol", "bar_start"]).select("symbol", "ts", "close")


@query("signal_align_left_join", """
tl AS (SELECT DISTINCT bar_start AS ts FROM bars_1h), s AS (SELECT DISTINCT symbol FROM bars_1h),
g AS (SELECT symbol, bar_start AS ts, CASE WHEN close > open THEN 1 ELSE -1 END AS side, close < open AS exit_long FROM bars_1h)
SELECT s.symbol, tl.ts, CAST(coalesce(g.side, 0) AS INTEGER) AS side, coalesce(g.exit_long, false) AS exit_long FROM tl CROSS JOIN s LEFT JOIN g ON g.symbol = s.symbol AND g.ts = tl.ts""")  # fmt: skip
def signal_align_left_join(t: Tables) -> DataFrame:
    bars = t.bars("1h")
    signals = bars.select("symbol", F.col("bar_start").alias("ts"), F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("side"), (F.col("close") < F.col("open")).alias("exit_long"))
    times = bars.select(F.col("bar_start").alias("ts")).distinct().join(bars.select("symbol").distinct())
    return S.align(times, signals).select("symbol", "ts", "side", "exit_long")


@query("fk_join", "SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def fk_join(t: Tables) -> DataFrame:
    counted = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    named = counted.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("n_name", "r_name").agg(F.sum("n").alias("customers"))


@query("coverage_gap_anti_join", """
p AS (SELECT DISTINCT symbol, bar_start FROM bars_1h),
g AS (SELECT s.symbol, h.bar_start FROM (SELECT DISTINCT symbol FROM p) s CROSS JOIN (SELECT DISTINCT bar_start FROM p) h)
SELECT g.symbol, g.bar_start FROM g ANTI JOIN p USING (symbol, bar_start)""")  # fmt: skip
def coverage_gap_anti_join(t: Tables) -> DataFrame:
    have = t.bars("1h").select("symbol", "bar_start")
    grid = have.select("bar_start").distinct().join(have.select("symbol").distinct())
    return grid.join(have, ["symbol", "bar_start"], "left_anti").select("symbol", "bar_start")


# --- prices and volumes over time ---------------------------------------------------------------------------


@query("price_change_pct", """
SELECT a.symbol, a.ts, round((a.price / nullif(b.price, 0) - 1) * 100, 6) AS change
FROM ticks a ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 60 minutes AS due, price FROM ticks) b ON a.symbol = b.symbol AND a.ts >= b.due""")  # fmt: skip
def price_change_pct(t: Tables) -> DataFrame:
    return M.price_change(t.ticks, 60).select("symbol", "ts", r("change").alias("change"))


@query("volume_ratio_prev19", """
SELECT symbol, bar_start, CASE WHEN n = 19 THEN round(volume / nullif(m, 0), 6) END AS ratio FROM (
  SELECT symbol, bar_start, volume, avg(volume) OVER w AS m, count(volume) OVER w AS n FROM bars_1h
  WINDOW w AS (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING))""")  # fmt: skip
def volume_ratio_prev19(t: Tables) -> DataFrame:
    return M.volume_ratio(t.bars("1h")).select("symbol", "bar_start", r("ratio").alias("ratio"))


@query("anomaly_events", """
v AS (SELECT symbol, bar_start, bar_end, close, volume, avg(volume) OVER w AS m, count(volume) OVER w AS n FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY bar_start), 0) - 1) * 100 AS change FROM v)
SELECT symbol, bar_start, CASE WHEN abs(change) > 150 THEN 'price' ELSE 'volume' END AS reason FROM c
WHERE abs(change) > 150 OR (n = 19 AND volume / nullif(m, 0) > 2)""")  # fmt: skip
def anomaly_events(t: Tables) -> DataFrame:
    return M.anomalies(t.bars("1h"), 150, 2).select("symbol", "bar_start", "reason")


@query("latest_state", "SELECT symbol, max(ts) AS ts, arg_max(price, (ts, seq)) AS price FROM ticks GROUP BY symbol")
def latest_state(t: Tables) -> DataFrame:
    return t.ticks.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("price", F.struct("ts", "seq")).alias("price"))


@query("time_diff_units", """
SELECT event_id, CAST(date_diff('second', p, ts) AS BIGINT) AS seconds, round(date_diff('second', p, ts) / 3600.0, 6) AS hours,
  CAST(date_diff('second', p, ts) // 86400 AS BIGINT) AS days, strftime(ts, '%Y-%m') AS month, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday
FROM (SELECT event_id, date_trunc('second', ts) AS ts, TIMESTAMP '2024-01-01' AS p FROM events)""")  # fmt: skip
def time_diff_units(t: Tables) -> DataFrame:
    at = F.date_trunc("second", "ts").cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), at)
    return t.events.select(
        "event_id", seconds.alias("seconds"), r(seconds / 3600.0).alias("hours"), F.floor(seconds / 86400).alias("days"),
        F.date_format(at, "yyyy-MM").alias("month"), F.hour(at).alias("hour"), F.weekday(at).alias("weekday"),
    )


@query("month_windows", """
SELECT CAST(s AS TIMESTAMP) AS train_start, CAST(s + INTERVAL 6 months AS TIMESTAMP) AS train_end, CAST(s + INTERVAL 6 months AS TIMESTAMP) AS val_start, CAST(s + INTERVAL 7 months AS TIMESTAMP) AS val_end
FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 month)) AS s)
WHERE s + INTERVAL 7 months <= (SELECT date_trunc('month', max(o_orderdate)) FROM orders)""")  # fmt: skip
def month_windows(t: Tables) -> DataFrame:
    from ..operators.search import walk_forward_windows

    ends = t.orders.agg(F.date_trunc("month", F.min("o_orderdate")).cast("timestamp_ntz").alias("start"), F.date_trunc("month", F.max("o_orderdate")).cast("timestamp_ntz").alias("end"))
    return walk_forward_windows(ends, 6, 1, 1)


@query("unrealized_pnl", """
l AS (SELECT symbol, arg_max(price, (ts, seq)) AS price FROM ticks GROUP BY symbol),
p AS (SELECT event_id, event_type AS symbol, value AS entry, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side FROM events)
SELECT p.event_id, round((coalesce(l.price, p.entry) - p.entry) * p.quantity * p.side, 6) + 0 AS upnl FROM p LEFT JOIN l USING (symbol)""")  # fmt: skip
def unrealized_pnl(t: Tables) -> DataFrame:
    return _positions(t).select("event_id", r("upnl").alias("upnl"))


def _positions(t: Tables) -> DataFrame:
    from ..operators.risk import unrealised

    prices = t.ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "seq")).alias("last"))
    side = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    held = t.events.select("event_id", F.col("event_type").alias("symbol"), F.col("value").alias("entry"), F.get_json_object("props", "$.k").cast("double").alias("quantity"), side.alias("side"))
    return held.join(prices, "symbol", "left").withColumn("upnl", unrealised(F.col("entry"), F.col("last"), F.col("quantity"), F.col("side")))


_POSITIONS = """
l AS (SELECT symbol, arg_max(price, (ts, seq)) AS price FROM ticks GROUP BY symbol),
p AS (SELECT event_id, event_type AS symbol, value AS entry, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side FROM events),
u AS (SELECT p.*, (coalesce(l.price, p.entry) - p.entry) * p.quantity * p.side AS upnl FROM p LEFT JOIN l USING (symbol))
"""


@query("emergency_stop", _POSITIONS + "SELECT event_id, symbol FROM u WHERE upnl / nullif(entry * quantity, 0) * 100 <= -5")
def emergency_stop(t: Tables) -> DataFrame:
    pct = F.try_divide(F.col("upnl"), F.col("entry") * F.col("quantity")) * 100
    return _positions(t).where(pct <= -5).select("event_id", "symbol")


@query("close_worst", _POSITIONS + "SELECT symbol, arg_min(event_id, (upnl, event_id)) AS event_id, round(min(upnl), 6) + 0 AS upnl FROM u GROUP BY symbol")
def close_worst(t: Tables) -> DataFrame:
    return _positions(t).groupBy("symbol").agg(F.min_by("event_id", F.struct("upnl", "event_id")).alias("event_id"), r(F.min("upnl")).alias("upnl"))


@query("portfolio_exposure", _POSITIONS + "SELECT symbol, round(sum(entry * quantity), 6) AS invested, round(sum(entry * quantity) / 1000, 6) AS exposure_pct, round(sum(upnl), 6) + 0 AS upnl FROM u GROUP BY symbol")
def portfolio_exposure(t: Tables) -> DataFrame:
    invested = F.sum(F.col("entry") * F.col("quantity"))
    return _positions(t).groupBy("symbol").agg(r(invested).alias("invested"), r(invested / 100_000 * 100).alias("exposure_pct"), r(F.sum("upnl")).alias("upnl"))


@query("portfolio_context", _POSITIONS + "SELECT string_agg(symbol || ':' || n, ', ' ORDER BY symbol) AS context FROM (SELECT symbol, count(*) AS n FROM u GROUP BY symbol)")
def portfolio_context(t: Tables) -> DataFrame:
    each = _positions(t).groupBy("symbol").agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.concat("symbol", F.lit(":"), F.col("n").cast("string"))))
    return each.agg(F.concat_ws(", ", lines).alias("context"))


@query("open_positions", "SELECT event_type AS symbol, max(event_id) AS event_id, arg_max(value, event_id) AS entry FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 GROUP BY event_type")
def open_positions(t: Tables) -> DataFrame:
    held = t.events.where(F.get_json_object("props", "$.k").cast("int") % 2 == 0)
    return held.groupBy(F.col("event_type").alias("symbol")).agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("entry"))


@query("signals_union", "SELECT symbol, bar_start, '1h' AS tf, close FROM bars_1h UNION ALL SELECT symbol, bar_start, '4h', close FROM bars_4h")
def signals_union(t: Tables) -> DataFrame:
    part = lambda n: t.bars(n).select("symbol", "bar_start", F.lit(n).alias("tf"), "close")
    return part("1h").unionByName(part("4h"))


@query("seq_windows", """
b AS (SELECT symbol, bar_start, list(close) OVER w AS c, list(volume) OVER w AS v FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT symbol, bar_start, CAST(len(c) AS INTEGER) AS n, round(c[1], 3) AS first_close, round(c[8], 3) AS last_close, round(list_sum(v), 3) AS volume FROM b WHERE len(c) = 8""")  # fmt: skip
def seq_windows(t: Tables) -> DataFrame:
    from ..operators.features import sequences

    seq = sequences(t.bars("1h"), ("close", "volume"), 8, "close")
    total = F.aggregate("seq", F.lit(0.0), lambda a, x: a + x[1].cast("double"))
    near = lambda c: r(F.round(c.cast("double"), 3), 3)
    return seq.select("symbol", "bar_start", F.size("seq").alias("n"), near(F.col("seq")[0][0]).alias("first_close"), near(F.col("seq")[7][0]).alias("last_close"), near(total).alias("volume"))
