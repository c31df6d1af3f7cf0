"""Queries over models by series: schedules, models of each day, scores by the model of their time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as W
from ..operators import features as X
from ..operators import heads as H
from ..operators import series_models as SM
from ..sources.domain import Tables
from . import sqlparts as Q
from .market import r
from .registry import query

_OUTCOME = f"""
o AS (SELECT symbol, bar_start, bar_end, close, close / nullif(lag(close, 5) OVER w, 0) - 1 AS ret_5, lead(close, 4) OVER w / nullif(close, 0) - 1 AS forward, lead(bar_end, 4) OVER w AS known_at FROM bars_1h {Q.W})
"""
_DAILY = _OUTCOME.rstrip() + """,
d AS (SELECT symbol, CAST(known_at AS DATE) AS day, count(*) AS n, sum(ret_5) AS x, sum(forward) AS y, sum(ret_5 * ret_5) AS xx, sum(ret_5 * forward) AS xy FROM o WHERE ret_5 IS NOT NULL AND forward IS NOT NULL GROUP BY ALL),
u AS (SELECT symbol, day, sum(n) OVER s AS n, sum(x) OVER s AS x, sum(y) OVER s AS y, sum(xx) OVER s AS xx, sum(xy) OVER s AS xy FROM d WINDOW s AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING)),
m AS (SELECT symbol, CAST(day + 1 AS TIMESTAMP) AS valid_from, CAST(n AS BIGINT) AS n, (n * xy - x * y) / (n * xx - x * x) AS slope, (y - (n * xy - x * y) / (n * xx - x * x) * x) / n AS start FROM u WHERE n >= 30)
"""


@query("outcomes_known", _OUTCOME + "SELECT symbol, bar_start, CAST(CASE WHEN forward >= 0.005 THEN 1 WHEN forward <= -0.005 THEN 0 END AS INTEGER) AS label, known_at FROM o")
def outcomes_known(t: Tables) -> DataFrame:
    return SM.outcomes(t.bars("1h")).select("symbol", "bar_start", "label", "known_at")


def _rows(t: Tables) -> DataFrame:
    return SM.outcomes(t.bars("1h")).withColumn("ret_5", W.change(F.col("close"), 5))


@query("series_models_daily", _DAILY + "SELECT symbol, valid_from, n, round(start, 6) + 0 AS start, round(slope, 5) + 0 AS slope FROM m")
def series_models_daily(t: Tables) -> DataFrame:
    models = SM.daily_models(_rows(t), ["symbol"], ["ret_5"])
    return models.select("symbol", "valid_from", "n", r(F.col("weights")[0]).alias("start"), r(F.col("weights")[1], 5).alias("slope"))


@query("online_scores", _DAILY + "SELECT o.symbol, o.bar_start, m.valid_from AS model_from, round(m.start + m.slope * coalesce(o.ret_5, 0), 5) + 0 AS predicted FROM o ASOF LEFT JOIN m ON o.symbol = m.symbol AND o.bar_end >= m.valid_from")
def online_scores(t: Tables) -> DataFrame:
    rows = _rows(t)
    scored = SM.with_models(rows, SM.daily_models(rows, ["symbol"], ["ret_5"]), ["symbol"])
    return scored.select("symbol", "bar_start", "model_from", r(SM.linear(["ret_5"], F.col("weights")), 5).alias("predicted"))


_SCHEDULE = """
s AS (SELECT ts, row_number() OVER (ORDER BY ts) AS step FROM (SELECT DISTINCT bar_start AS ts FROM bars_1h)),
k AS (SELECT DISTINCT symbol AS model FROM bars_1h), c AS (SELECT count(*) AS n, greatest(1, greatest({every}, count(*)) // count(*)) AS stagger FROM k),
t AS (SELECT model, row_number() OVER (ORDER BY model) - 1 AS turn FROM k)
SELECT ts, step, model FROM s CROSS JOIN c JOIN t ON turn = (step // stagger) % n WHERE step % stagger = 0"""
query("retrain_schedule", _SCHEDULE.format(every=100))(
    lambda t: SM.retrain_schedule(t.bars("1h").select(F.col("bar_start").alias("ts")), t.ticks.select(F.col("symbol").alias("model")))
)


@query("models_overdue", _DAILY + """, z AS (SELECT CAST(CAST(max(bar_end) AS DATE) - 3 AS TIMESTAMP) AS now FROM bars_1h),
e AS (SELECT symbol, max(valid_from) AS newest FROM m WHERE valid_from <= (SELECT now FROM z) AND hash_of(symbol) GROUP BY symbol)
SELECT symbol, newest FROM (SELECT DISTINCT symbol FROM bars_1h) LEFT JOIN e USING (symbol), z WHERE newest IS NULL OR newest <= now - INTERVAL 1 DAY""".replace("hash_of(symbol)", "length(symbol) % 2 = 0"))  # fmt: skip
def models_overdue(t: Tables) -> DataFrame:
    """Three days before the end, where only symbols with names of even length have been trained."""
    rows = _rows(t)
    now = rows.agg(F.date_sub(F.to_date(F.max("bar_end")), 3).cast("string")).first()[0]
    trained = SM.daily_models(rows, ["symbol"], ["ret_5"]).where((F.col("valid_from") <= F.lit(now).cast("timestamp_ntz")) & (F.length("symbol") % 2 == 0))
    return SM.overdue(rows, trained, ["symbol"], now)


@query("patch_head_direction")
def patch_head_direction(t: Tables) -> DataFrame:
    """A head over the last 32 bars, trained on which barrier comes first, and its direction on all bars that have as many before them."""
    names = ("ret_1", "close_position", "high_low_range")
    rows = X.clean(X.raw_features(t.bars("1h")), names).withColumn("label", X.triple_barrier(24, 0.5, 0.5, timeout=H.NEITHER))
    rows = X.sequences(rows, names, 32, "label")
    head = H.train(rows, 32, len(names), rounds=8, rate=0.05)
    if head is None:
        return rows.select("symbol", "bar_start", F.lit(0).alias("direction"), F.lit(0.0).alias("confidence")).limit(0)
    return H.directed(H.predict(rows, head), head).select("symbol", "bar_start", "direction", r("confidence", 4).alias("confidence"))
