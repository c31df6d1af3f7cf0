"""Pieces of SQL for recursive smoothing, by recursive common table expressions over row numbers."""

from __future__ import annotations

BASE = "s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_start) - 1 AS n, lag(close) OVER (PARTITION BY symbol ORDER BY bar_start) AS pc, lag(high) OVER (PARTITION BY symbol ORDER BY bar_start) AS ph, lag(low) OVER (PARTITION BY symbol ORDER BY bar_start) AS pl FROM bars_1h)"


def smooth(name: str, source: str, value: str, n: int, alpha: str, start: int = 0) -> str:
    """name(symbol, n, e): the mean of rows start..start+n-1 at the last of them, then e + alpha * (x - e)."""
    at = start + n - 1
    return f"""{name}_x AS MATERIALIZED (SELECT symbol, n, CAST({value} AS DOUBLE) AS x FROM {source}),
{name}(symbol, n, e) AS (
  SELECT symbol, CAST({at} AS BIGINT), avg(x) FROM {name}_x WHERE n BETWEEN {start} AND {at} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT r.symbol, r.n + 1, r.e + {alpha} * (x.x - r.e) FROM {name} r JOIN {name}_x x ON x.symbol = r.symbol AND x.n = r.n + 1)"""


def ema(name: str, source: str, value: str, n: int, start: int = 0) -> str:
    return smooth(name, source, value, n, f"(2.0::DOUBLE / {n + 1})", start)


def wilder(name: str, source: str, value: str, n: int, start: int = 0) -> str:
    return smooth(name, source, value, n, f"(1.0::DOUBLE / {n})", start)


def ewm(name: str, source: str, value: str, span: int) -> str:
    return smooth(name, source, value, 1, f"(2.0::DOUBLE / {span + 1})")


RSI = ",\n".join([
    BASE,
    wilder("up", "s", "greatest(close - pc, 0)", 14, 1), wilder("dn", "s", "greatest(pc - close, 0)", 14, 1),
    "rsi AS (SELECT up.symbol, up.n, CASE WHEN up.e + dn.e = 0 THEN 0 ELSE 100 * up.e / (up.e + dn.e) END AS rsi FROM up JOIN dn USING (symbol, n))",
])
MACD = ",\n".join([
    ema("fast", "s", "close", 12, 14), ema("slow", "s", "close", 26),
    "line AS MATERIALIZED (SELECT symbol, n, fast.e - slow.e AS macd FROM fast JOIN slow USING (symbol, n))",
    ema("sig", "line", "macd", 9, 25),
    "macd AS (SELECT line.symbol, line.n, macd, sig.e AS macd_signal, macd - sig.e AS macd_histogram FROM line LEFT JOIN sig USING (symbol, n))",
])
TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
ATR = wilder("atr", "s", TR, 14, 1)
ADX = ",\n".join([
    wilder("tr", "s", TR, 14, 1),
    wilder("pdm", "s", "CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END", 14, 1),
    wilder("mdm", "s", "CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END", 14, 1),
    """dx AS MATERIALIZED (SELECT symbol, n, CASE WHEN p + m = 0 THEN 0 ELSE 100 * abs(p - m) / (p + m) END AS dx FROM (
  SELECT tr.symbol, tr.n, pdm.e / nullif(tr.e, 0) AS p, mdm.e / nullif(tr.e, 0) AS m FROM tr JOIN pdm USING (symbol, n) JOIN mdm USING (symbol, n)))""",
    wilder("adx", "dx", "dx", 14, 14),
])
W = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_start)"


def rolling(f: str, x: str, n: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {f}({x}) OVER {frame} END"
