"""Machine-learning features and labels as window columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recursive as R
from ..functions import rolling as W
from .indicators import with_indicators

EPS = 1e-9
#: Indicators that features read.
BASE = {"rsi": {"period": 14}, "macd": {}, "bollinger": {"period": 20}, "adx": {"period": 14}}

# The features of a model's vector, in their published order; the second list extends the first.
DEFAULT_FEATURES = (
    "ret_1", "ret_5", "ret_10", "ret_20", "acceleration_5", "momentum_ratio", "vol_5", "vol_10", "vol_20", "vol_regime",
    "volume_ratio", "vol_chg_5", "vol_chg_20", "vol_trend", "pos_20", "ema20_dist", "ema50_dist", "bb_position",
    "bb_width_ratio", "rsi", "macd_histogram", "bollinger_width", "adx", "rsi_momentum", "macd_accel", "close_position",
    "high_low_range", "consecutive_dir", "ret_skew_20", "ret_kurt_20",
)
FEATURES = (
    *DEFAULT_FEATURES, "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "volume_price_corr_20",
    "adx_trend_strength", "ema_slope_20",
)


def sign(c: Column) -> Column:
    return F.signum(c)


def raw_features(bars: DataFrame, time: str = "bar_start") -> DataFrame:
    """`bars` with the 37 features, null where they are not defined."""
    recursions = [R.Recursion((f"_ewm{n}",), ("close",), partial(R.ewm, span=n), R.ewm_program("close", n)) for n in (20, 50)]
    out = R.with_recursions(with_indicators(bars, BASE), recursions)
    by, c, v, lag = W.ordered(), F.col("close"), F.col("volume"), lambda x, n: F.lag(x, n).over(W.ordered())
    high, low = F.col("high"), F.col("low")
    ratio = lambda a, b: (a + EPS) / (b + EPS)
    out = out.withColumns({f"ret_{k}": W.change(c, k) for k in (1, 5, 10, 20)} | {"_dir": sign(c - lag(c, 1)), "_vdir": sign(v - lag(v, 1))})
    r = F.col("ret_1")
    lo, hi = W.lowest(c, 20), W.highest(c, 20)
    angle = lambda x, n: x * (2 * 3.141592653589793 / n)
    flip = F.when(F.col("_dir") != F.lag("_dir").over(by), 1).otherwise(0)
    out = out.withColumns({
        "acceleration_5": r - lag(F.col("ret_5"), 5),
        "momentum_ratio": ratio(F.abs("ret_5"), F.abs("ret_20")),
        **{f"vol_{n}": W.std(r, n) for n in (5, 10, 20)},
        "vol_chg_5": W.change(v, 5), "vol_chg_20": W.change(v, 20), "vol_trend": ratio(W.mean(v, 5), W.mean(v, 20)),
        "volume_ratio": v / (W.mean(v, 20) + EPS),
        "pos_20": (c - lo) / (hi - lo + EPS),
        "ema20_dist": (c - F.col("_ewm20")) / (F.col("_ewm20") + EPS), "ema50_dist": (c - F.col("_ewm50")) / (F.col("_ewm50") + EPS),
        "bb_position": (c - F.col("bollinger_lower")) / (F.col("bollinger_upper") - F.col("bollinger_lower") + EPS),
        "bb_width_ratio": ratio(F.col("bollinger_width"), W.mean(F.col("bollinger_width"), 20)),
        "rsi_momentum": F.col("rsi") - lag(F.col("rsi"), 5), "macd_accel": F.col("macd_histogram") - lag(F.col("macd_histogram"), 3),
        "close_position": (c - low) / (high - low + EPS), "high_low_range": (high - low) / (c + EPS),
        "_run": F.sum(flip).over(W.upto()),
        "ret_skew_20": W.skew(r, 20), "ret_kurt_20": W.kurt(r, 20),
        "hour_sin": F.sin(angle(F.hour(time), 24)), "hour_cos": F.cos(angle(F.hour(time), 24)),
        "day_of_week_sin": F.sin(angle(F.weekday(time), 7)), "day_of_week_cos": F.cos(angle(F.weekday(time), 7)),
        "volume_price_corr_20": F.coalesce(W.corr(F.col("_dir"), F.col("_vdir"), 20), F.lit(0.0)),
        "adx_trend_strength": F.col("adx") / 100,
        "ema_slope_20": (F.col("_ewm20") - lag(F.col("_ewm20"), 5)) / (lag(F.col("_ewm20"), 5) + EPS),
    })
    run = Window.partitionBy("symbol", "_run").orderBy(time)
    out = out.withColumns({"vol_regime": ratio(F.col("vol_5"), F.col("vol_20")), "consecutive_dir": (F.row_number().over(run) - 1).cast("double")})
    return out.drop("_ewm20", "_ewm50", "_dir", "_vdir", "_run")


def clean(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Of the named columns those that are there; infinite and missing values filled from before, else 0."""
    have = [n for n in names if n in df.columns]
    finite = lambda n: F.when(~F.isnan(n) & (F.abs(F.col(n)) != float("inf")), F.col(n))
    df = df.withColumns({n: finite(n) for n in have})
    return df.withColumns({n: F.coalesce(W.forward_fill(F.col(n)), F.lit(0.0)) for n in have})


def features(bars: DataFrame, names: Sequence[str] = DEFAULT_FEATURES) -> DataFrame:
    """(symbol, bar_start, close, features) without gaps."""
    out = clean(raw_features(bars), names)
    return out.select("symbol", "bar_start", "close", *[n for n in names if n in out.columns and n != "close"])


# --- labels -------------------------------------------------------------------------------------------------


def forward_return(n: int) -> Column:
    return F.try_divide(F.lead("close", n).over(W.ordered()), F.col("close")) - 1


def three_class(n: int = 4, threshold: float = 0.01) -> Column:
    r = forward_return(n)
    return F.when(r > threshold, "up").when(r < -threshold, "down").when(r.isNotNull(), "hold")


def binary(n: int = 4, threshold: float = 0.005) -> Column:
    r = forward_return(n)
    return F.when(r >= threshold, 1).when(r <= -threshold, 0)


def triple_barrier(n: int = 24, upper: float = 0.02, lower: float = 0.02, timeout: int | None = None) -> Column:
    """1 if a high within n bars reaches the upper barrier first, 0 if a low reaches the lower one; of both in one bar
    the upper counts. `timeout` (or null) if neither; null without n bars ahead."""
    ahead = W.ordered().rowsBetween(1, n)
    path = F.collect_list(F.struct("high", "low")).over(ahead)
    top, bottom = F.col("close") * (1 + upper), F.col("close") * (1 - lower)
    hits = F.filter(path, lambda b: (b.high >= top) | (b.low <= bottom))
    first = F.get(hits, F.lit(0))
    late = F.lit(timeout).cast("int") if timeout is not None else F.lit(None).cast("int")
    return F.when(F.size(path) == n, F.when(F.size(hits) == 0, late).when(first.high >= top, 1).otherwise(0))


def sequences(df: DataFrame, names: Sequence[str], length: int, label: str) -> DataFrame:
    """(symbol, bar_start, seq, label): the `length` rows before each row, each an array of the named columns."""
    before = W.ordered().rowsBetween(-length, -1)
    seq = F.collect_list(F.array(*[F.col(n).cast("float") for n in names])).over(before)
    return df.withColumn("seq", seq).where(F.size("seq") == length).select("symbol", "bar_start", "seq", label)


def expanding_zscore(c: Column, inclusive: bool = True) -> Column:
    """Against mean and population deviation of all rows so far (with or without this one); 0 where constant."""
    w = W.ordered().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.coalesce(F.try_divide(c - F.avg(c).over(w), F.nullif(F.round(F.stddev_pop(c).over(w), 9), F.lit(0.0))), F.lit(0.0))


def temporal_split(share: float = 0.8) -> Column:
    """True for the first `share` of each series."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    return F.row_number().over(W.ordered()) <= F.floor(n * share)


def patches(c: Column, size: int = 16, stride: int = 8) -> Column:
    """Overlapping slices of an array."""
    starts = F.sequence(F.lit(1), F.size(c) - size + 1, F.lit(stride))
    return F.when(F.size(c) >= size, F.transform(starts, lambda i: F.slice(c, i, size)))


def softmax(c: Column) -> Column:
    top = F.array_max(c)
    e = F.transform(c, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def pinball(y: Column, predicted: Column, q: float) -> Column:
    return F.greatest((y - predicted) * q, (y - predicted) * (q - 1))


def quantile_confidence(low: Column, middle: Column, high: Column) -> Column:
    """2 * sigmoid(|middle| / (high - low)) - 1, within [0, 1]."""
    s = 1 / (1 + F.exp(-F.abs(middle) / (high - low + 1e-6)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - 0.5) * 2))


def neutral_band(p: Column, low: float = 0.38, high: float = 0.62) -> Column:
    return F.when((p > low) & (p < high), 0.5).otherwise(p)


def direction_to_confidence(direction: Column, confidence: Column) -> Column:
    return F.when(direction == "up", confidence).when(direction == "down", 1 - confidence).otherwise(0.5)
