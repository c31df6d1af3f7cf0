"""Queries over features, labels and sequence preparation, on hourly bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as W
from ..operators import features as X
from ..sources.domain import Tables
from . import sqlparts as Q
from .indicators import KEY, _DEV, _MEAN, shown
from .market import r
from .registry import query

EPS = "1e-9::DOUBLE"


def _features(name: str, columns: tuple[str, ...], sql: str) -> None:
    query(name, sql)(lambda t: shown(X.raw_features(t.bars("1h")), *columns))


def _out(columns: tuple[str, ...], table: str) -> str:
    return f"SELECT symbol, bar_start, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in columns)} FROM {table}"


_RET = f"c AS (SELECT *, {', '.join(f'close / nullif(lag(close, {k}) OVER w, 0) - 1 AS ret_{k}' for k in (1, 5, 10, 20))} FROM bars_1h {Q.W})"
_features("feat_returns", ("ret_1", "ret_5", "ret_10", "ret_20"), f"{_RET}\n" + _out(("ret_1", "ret_5", "ret_10", "ret_20"), "c"))
_features("feat_momentum", ("acceleration_5", "momentum_ratio"), f"{_RET}, d AS (SELECT *, ret_1 - lag(ret_5, 5) OVER w AS acceleration_5, (abs(ret_5) + {EPS}) / (abs(ret_20) + {EPS}) AS momentum_ratio FROM c {Q.W})\n" + _out(("acceleration_5", "momentum_ratio"), "d"))
_VOL = f"{_RET}, d AS (SELECT *, {', '.join(f'{Q.rolling("stddev_samp", "ret_1", n)} AS vol_{n}' for n in (5, 10, 20))} FROM c), v AS (SELECT *, (vol_5 + {EPS}) / (vol_20 + {EPS}) AS vol_regime FROM d)\n"
_features("feat_volatility", ("vol_5", "vol_10", "vol_20", "vol_regime"), _VOL + _out(("vol_5", "vol_10", "vol_20", "vol_regime"), "v"))
_VOLUME = ("volume_ratio", "vol_chg_5", "vol_chg_20", "vol_trend")
_features("feat_volume", _VOLUME, f"d AS (SELECT *, volume / ({Q.rolling('avg', 'volume', 20)} + {EPS}) AS volume_ratio, volume / nullif(lag(volume, 5) OVER w, 0) - 1 AS vol_chg_5, volume / nullif(lag(volume, 20) OVER w, 0) - 1 AS vol_chg_20, ({Q.rolling('avg', 'volume', 5)} + {EPS}) / ({Q.rolling('avg', 'volume', 20)} + {EPS}) AS vol_trend FROM bars_1h {Q.W})\n" + _out(_VOLUME, "d"))
_PRICE = ("pos_20", "ema20_dist", "ema50_dist")
_features("feat_price_position", _PRICE, "RECURSIVE " + Q.BASE + ",\n" + Q.ewm("a", "s", "close", 20) + ",\n" + Q.ewm("b", "s", "close", 50) + f""",
d AS (SELECT s.*, a.e AS ea, b.e AS eb, (close - {Q.rolling("min", "close", 20)}) / ({Q.rolling("max", "close", 20)} - {Q.rolling("min", "close", 20)} + {EPS}) AS pos_20 FROM s JOIN a USING (symbol, n) JOIN b USING (symbol, n)),
v AS (SELECT *, (close - ea) / (ea + {EPS}) AS ema20_dist, (close - eb) / (eb + {EPS}) AS ema50_dist FROM d)
""" + _out(_PRICE, "v"))  # fmt: skip
_features("feat_bollinger", ("bb_position", "bb_width_ratio"), f"""
d AS (SELECT *, {_MEAN} AS m, {_DEV} AS sd FROM bars_1h), e AS (SELECT *, 4 * sd / nullif(m, 0) AS width FROM d),
v AS (SELECT *, (close - (m - 2 * sd)) / ((m + 2 * sd) - (m - 2 * sd) + {EPS}) AS bb_position, (width + {EPS}) / ({Q.rolling("avg", "width", 20)} + {EPS}) AS bb_width_ratio FROM e)
""" + _out(("bb_position", "bb_width_ratio"), "v"))  # fmt: skip
_DELTA = ("rsi", "rsi_momentum", "macd_histogram", "macd_accel")
_features("feat_indicator_delta", _DELTA, "RECURSIVE " + Q.RSI + ",\n" + Q.MACD + """,
d AS (SELECT s.symbol, s.bar_start, rsi, macd_histogram FROM s LEFT JOIN rsi USING (symbol, n) LEFT JOIN macd USING (symbol, n)),
v AS (SELECT *, rsi - lag(rsi, 5) OVER w AS rsi_momentum, macd_histogram - lag(macd_histogram, 3) OVER w AS macd_accel FROM d """ + Q.W + ")\n" + _out(_DELTA, "v"))  # fmt: skip
_features("feat_microstructure", ("close_position", "high_low_range"), f"v AS (SELECT *, (close - low) / (high - low + {EPS}) AS close_position, (high - low) / (close + {EPS}) AS high_low_range FROM bars_1h)\n" + _out(("close_position", "high_low_range"), "v"))
_features("feat_consecutive_dir", ("consecutive_dir",), f"""
a AS (SELECT symbol, bar_start, sign(close - lag(close) OVER w) AS dir FROM bars_1h {Q.W}),
b AS (SELECT *, CASE WHEN dir <> lag(dir) OVER w THEN 1 ELSE 0 END AS flip FROM a {Q.W}),
c AS (SELECT *, sum(flip) OVER (PARTITION BY symbol ORDER BY bar_start ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT symbol, bar_start, CAST(row_number() OVER (PARTITION BY symbol, run ORDER BY bar_start) - 1 AS DOUBLE) AS consecutive_dir FROM c""")  # fmt: skip
_features("feat_moments", ("ret_skew_20", "ret_kurt_20"), f"{_RET}, v AS (SELECT *, {Q.rolling('skewness', 'ret_1', 20)} AS ret_skew_20, {Q.rolling('kurtosis', 'ret_1', 20)} AS ret_kurt_20 FROM c)\n" + _out(("ret_skew_20", "ret_kurt_20"), "v"))
_TIME = ("hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos")
_features("feat_cyclical_time", _TIME, "v AS (SELECT *, sin(2 * pi() * hour(bar_start) / 24) AS hour_sin, cos(2 * pi() * hour(bar_start) / 24) AS hour_cos, sin(2 * pi() * (isodow(bar_start) - 1) / 7) AS day_of_week_sin, cos(2 * pi() * (isodow(bar_start) - 1) / 7) AS day_of_week_cos FROM bars_1h)\n" + _out(_TIME, "v"))
_FRAME20 = "(PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_features("feat_rolling_corr", ("volume_price_corr_20",), f"""
a AS (SELECT symbol, bar_start, sign(close - lag(close) OVER w) AS x, sign(volume - lag(volume) OVER w) AS y FROM bars_1h {Q.W}),
v AS (SELECT *, CASE WHEN count(x + y) OVER {_FRAME20} = 20 THEN covar_samp(x, y) OVER {_FRAME20} / nullif(stddev_samp(x) OVER {_FRAME20} * stddev_samp(y) OVER {_FRAME20}, 0) END AS c FROM a)
SELECT symbol, bar_start, round(coalesce(c, 0), 6) + 0 AS volume_price_corr_20 FROM v""")  # fmt: skip
_features("feat_trend_quality", ("adx_trend_strength", "ema_slope_20"), "RECURSIVE " + Q.BASE + ",\n" + Q.ADX + ",\n" + Q.ewm("a", "s", "close", 20) + f""",
d AS (SELECT s.symbol, s.bar_start, adx.e / 100 AS adx_trend_strength, a.e AS ea FROM s LEFT JOIN adx USING (symbol, n) JOIN a USING (symbol, n)),
v AS (SELECT *, (ea - lag(ea, 5) OVER w) / (lag(ea, 5) OVER w + {EPS}) AS ema_slope_20 FROM d {Q.W})
""" + _out(("adx_trend_strength", "ema_slope_20"), "v"))  # fmt: skip


@query("feature_select_ffill", f"""{_RET}, v AS (SELECT *, last_value(CASE WHEN bar_start IS NOT NULL AND hour(bar_start) % 3 > 0 THEN ret_5 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_start ROWS UNBOUNDED PRECEDING) AS f FROM c)
SELECT symbol, bar_start, round(coalesce(f, 0), 6) + 0 AS ret_5 FROM v""")  # fmt: skip
def feature_select_ffill(t: Tables) -> DataFrame:
    rows = t.bars("1h").withColumn("ret_5", W.change(F.col("close"), 5))
    rows = rows.withColumn("ret_5", F.when(F.hour("bar_start") % 3 > 0, F.col("ret_5")).when(F.col("ret_5").isNotNull(), float("inf")))
    return X.clean(rows, ("ret_5", "missing_column")).select(*KEY, r("ret_5").alias("ret_5"))


# --- labels -------------------------------------------------------------------------------------------------


def _label(name: str, made: Callable[[], Column], column: str, sql: str) -> None:
    query(name, f"a AS (SELECT *, lead(close, 4) OVER w / nullif(close, 0) - 1 AS fr FROM bars_1h {Q.W})\nSELECT symbol, bar_start, {sql} AS {column} FROM a")(lambda t: t.bars("1h").select(*KEY, made().alias(column)))


_label("label_three_class", X.three_class, "label", "CASE WHEN fr > 0.01 THEN 'up' WHEN fr < -0.01 THEN 'down' WHEN fr IS NOT NULL THEN 'hold' END")
_label("label_binary", X.binary, "label", "CAST(CASE WHEN fr >= 0.005 THEN 1 WHEN fr <= -0.005 THEN 0 END AS INTEGER)")
_label("label_regression", lambda: F.round(X.forward_return(4), 6), "label", "round(fr, 6) + 0")

_BARRIER = """
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_start) AS i, count(*) OVER (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS ahead FROM bars_1h),
h AS (SELECT a.symbol, a.i, min(b.i) AS j FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i + 1 AND a.i + 24 WHERE b.high >= a.close * (1 + 0.5::DOUBLE) OR b.low <= a.close * (1 - 0.5::DOUBLE) GROUP BY ALL),
l AS (SELECT n.symbol, n.bar_start, CAST(CASE WHEN n.ahead < 24 OR h.j IS NULL THEN NULL WHEN b.high >= n.close * (1 + 0.5::DOUBLE) THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM n LEFT JOIN h USING (symbol, i) LEFT JOIN n b ON b.symbol = n.symbol AND b.i = h.j)
"""
query("triple_barrier", _BARRIER + "SELECT symbol, bar_start, label FROM l")(lambda t: t.bars("1h").select(*KEY, X.triple_barrier(24, 0.5, 0.5).alias("label")))


@query("triple_barrier_onehot", _BARRIER + "SELECT symbol, bar_start, CAST(label = 1 AS INTEGER) AS up, CAST(label = 0 AS INTEGER) AS down FROM l WHERE label IS NOT NULL")
def triple_barrier_onehot(t: Tables) -> DataFrame:
    rows = t.bars("1h").withColumn("label", X.triple_barrier(24, 0.5, 0.5)).where("label IS NOT NULL")
    return rows.select(*KEY, (F.col("label") == 1).cast("int").alias("up"), (F.col("label") == 0).cast("int").alias("down"))


@query("feature_label_join", f"{_RET}, a AS (SELECT symbol, bar_start, lead(close, 4) OVER w / nullif(close, 0) - 1 AS fr FROM bars_1h {Q.W})\nSELECT symbol, bar_start, round(ret_5, 6) AS ret_5, CAST(CASE WHEN fr >= 0.005 THEN 1 ELSE 0 END AS INTEGER) AS label FROM c JOIN a USING (symbol, bar_start) WHERE ret_5 IS NOT NULL AND (fr >= 0.005 OR fr <= -0.005)")
def feature_label_join(t: Tables) -> DataFrame:
    bars = t.bars("1h")
    features = bars.select(*KEY, W.change(F.col("close"), 5).alias("ret_5")).na.drop()
    labels = bars.select(*KEY, X.binary().alias("label")).na.drop()
    return features.join(labels, [*KEY]).select(*KEY, r("ret_5").alias("ret_5"), "label")


@query("expanding_zscore", """
a AS (SELECT symbol, bar_start, close, avg(close) OVER w AS m, round(stddev_pop(close) OVER w, 9) AS d FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY bar_start ROWS UNBOUNDED PRECEDING))
SELECT symbol, bar_start, round(coalesce((close - m) / nullif(d, 0), 0), 5) + 0 AS z FROM a""")  # fmt: skip
def expanding_zscore(t: Tables) -> DataFrame:
    return t.bars("1h").select(*KEY, r(X.expanding_zscore(F.col("close")), 5).alias("z"))


@query("temporal_split", "SELECT symbol, bar_start, row_number() OVER (PARTITION BY symbol ORDER BY bar_start) <= floor(count(*) OVER (PARTITION BY symbol) * 0.8::DOUBLE) AS train FROM bars_1h")
def temporal_split(t: Tables) -> DataFrame:
    return t.bars("1h").select(*KEY, X.temporal_split().alias("train"))


@query("class_weight", f"a AS (SELECT symbol, lead(close, 4) OVER w / nullif(close, 0) - 1 AS fr FROM bars_1h {Q.W})\nSELECT symbol, round(greatest(1.0::DOUBLE, count(*) FILTER (fr <= -0.005) / nullif(CAST(count(*) FILTER (fr >= 0.005) AS DOUBLE), 0)), 6) AS weight FROM a GROUP BY symbol")
def class_weight(t: Tables) -> DataFrame:
    rows = t.bars("1h").select("symbol", X.binary().alias("y"))
    ratio = F.try_divide(F.count_if(F.col("y") == 0).cast("double"), F.count_if(F.col("y") == 1))
    return rows.groupBy("symbol").agg(r(F.greatest(F.lit(1.0), ratio)).alias("weight"))


# --- heads and sequences ------------------------------------------------------------------------------------

_EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)\n"


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("patch_windows", _EMB + "SELECT vec_id, CAST((len(v) - 16) // 8 + 1 AS INTEGER) AS n, round(list_sum(v[9:24]), 6) AS second_sum FROM e")
def patch_windows(t: Tables) -> DataFrame:
    p = X.patches(F.col("v"))
    return _vectors(t).select("vec_id", F.size(p).alias("n"), r(F.aggregate(p[1], F.lit(0.0), lambda a, x: a + x)).alias("second_sum"))


@query("softmax_direction", _EMB + """, x AS (SELECT vec_id, list_transform(v[1:3], lambda x: exp(x - list_max(v[1:3]))) AS e FROM e),
p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM x)
SELECT vec_id, CASE list_position(p, list_max(p)) WHEN 1 THEN 'down' WHEN 2 THEN 'hold' ELSE 'up' END AS direction, round(list_max(p), 6) AS confidence FROM p""".replace(_EMB, ""))  # fmt: skip
def softmax_direction(t: Tables) -> DataFrame:
    p = F.col("p")
    rows = _vectors(t).select("vec_id", X.softmax(F.slice("v", 1, 3)).alias("p"))
    names = F.array(*map(F.lit, ("down", "hold", "up")))
    return rows.select("vec_id", F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")).alias("direction"), r(F.array_max(p)).alias("confidence"))


@query("pinball_loss", _EMB + "SELECT label, round(avg(greatest((v[1] - v[2]) * 0.9, (v[1] - v[2]) * (0.9::DOUBLE - 1))), 6) AS loss FROM e GROUP BY label")
def pinball_loss(t: Tables) -> DataFrame:
    return _vectors(t).groupBy("label").agg(r(F.avg(X.pinball(F.col("v")[0], F.col("v")[1], 0.9))).alias("loss"))


@query("quantile_confidence", _EMB + ", q AS (SELECT vec_id, list_sort(v[1:3]) AS q FROM e)\nSELECT vec_id, round(greatest(0, least(1, 2 * (1 / (1 + exp(-abs(q[2]) / (q[3] - q[1] + 1e-6::DOUBLE))) - 0.5))), 6) AS confidence FROM q")
def quantile_confidence(t: Tables) -> DataFrame:
    rows = _vectors(t).select("vec_id", F.array_sort(F.slice("v", 1, 3)).alias("q"))
    return rows.select("vec_id", r(X.quantile_confidence(F.col("q")[0], F.col("q")[1], F.col("q")[2])).alias("confidence"))


@query("ml_neutral_band", _EMB + "SELECT vec_id, round(CASE WHEN 0.5 + v[1] > 0.38 AND 0.5 + v[1] < 0.62 THEN 0.5 ELSE 0.5 + v[1] END, 6) AS p FROM e")
def ml_neutral_band(t: Tables) -> DataFrame:
    return _vectors(t).select("vec_id", r(X.neutral_band(F.col("v")[0] + 0.5)).alias("p"))


@query("direction_to_confidence", _EMB + "SELECT vec_id, round(CASE WHEN v[1] > 0.1 THEN abs(v[2]) WHEN v[1] < -0.1 THEN 1 - abs(v[2]) ELSE 0.5 END, 6) AS p FROM e")
def direction_to_confidence(t: Tables) -> DataFrame:
    v = F.col("v")
    direction = F.when(v[0] > 0.1, "up").when(v[0] < -0.1, "down").otherwise("hold")
    return _vectors(t).select("vec_id", r(X.direction_to_confidence(direction, F.abs(v[1]))).alias("p"))


@query("classification_metrics", """
p AS (SELECT quality AS y, toxic AS x FROM labels), k AS (SELECT unnest([0, 1]) AS c),
m AS (SELECT c, count(*) FILTER (y = c) AS support, 2.0::DOUBLE * count(*) FILTER (y = c AND x = c) / nullif(count(*) FILTER (y = c) + count(*) FILTER (x = c), 0) AS f1 FROM k CROSS JOIN p GROUP BY c)
SELECT round((SELECT avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) FROM p), 6)::DOUBLE AS accuracy, round(sum(coalesce(f1, 0) * support) / sum(support), 6)::DOUBLE AS weighted_f1 FROM m""")  # fmt: skip
def classification_metrics(t: Tables) -> DataFrame:
    from ..operators.ml import classification_metrics as measured

    return measured(t.labels.select(F.col("quality").alias("y"), F.col("toxic").alias("p"))).select(r("accuracy").alias("accuracy"), r("weighted_f1").alias("weighted_f1"))


@query("regression_metrics", _EMB + "SELECT round(avg((v[1] - v[2]) * (v[1] - v[2])), 6) AS mse, round(avg(abs(v[1] - v[2])), 6) AS mae FROM e")
def regression_metrics(t: Tables) -> DataFrame:
    from ..operators.ml import regression_metrics as measured

    return measured(_vectors(t).select(F.col("v")[0].alias("y"), F.col("v")[1].alias("p"))).select(r("mse").alias("mse"), r("mae").alias("mae"))


@query("ml_directional_accuracy", f"""
a AS (SELECT symbol, close, lead(close, 4) OVER w / nullif(close, 0) - 1 AS fr, lag(close) OVER w AS pc FROM bars_1h {Q.W})
SELECT symbol, CAST(count(*) FILTER (abs(fr) >= 0.005) AS BIGINT) AS moves, round(count(*) FILTER (abs(fr) >= 0.005 AND (close > pc) = (fr > 0)) / nullif(CAST(count(*) FILTER (abs(fr) >= 0.005) AS DOUBLE), 0), 6) AS accuracy FROM a WHERE pc IS NOT NULL GROUP BY symbol""")  # fmt: skip
def ml_directional_accuracy(t: Tables) -> DataFrame:
    from ..operators.ml import directional_accuracy

    before = F.lag("close").over(W.ordered())
    rows = t.bars("1h").select("symbol", X.forward_return(4).alias("y"), (F.col("close") > before).alias("up"), before.alias("b")).where("b IS NOT NULL")
    moves, share = directional_accuracy(F.col("up"), F.col("y"), 0.005)
    return rows.groupBy("symbol").agg(moves.alias("moves"), r(share).alias("accuracy"))
