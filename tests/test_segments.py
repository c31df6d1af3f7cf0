"""Averages in segments are those of whole series."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import recursive as R
from tickloom.functions import segments as S
from tickloom.operators import indicators as I

T = dt.datetime(2024, 1, 1)
CONFIGS = {"rsi": {"period": 14}, "macd": {}, "adx": {"period": 14}, "atr": {"period": 7}, "ema": {"periods": [1, 10, 200]}}
NAMES = ("rsi", "macd", "macd_signal", "macd_histogram", "adx", "atr", "ema_1", "ema_10", "ema_200", "ema_fast", "ema_slow")


def plain(x, n, alpha, start=0):
    """The average row by row."""
    out, at = [math.nan] * len(x), start + n - 1
    if len(x) > at:
        e = sum(x[start : at + 1]) / n
        out[at] = e
        for i in range(at + 1, len(x)):
            e += alpha * (x[i] - e)
            out[i] = e
    return out


@pytest.mark.parametrize("n, alpha, start", [(3, 0.5, 0), (14, 1 / 14, 1), (1, 1.0, 0), (26, 2 / 27, 5), (200, 2 / 201, 0), (1, 2 / 51, 0), (2, 2 / 3, 3)])
def test_blocks_of_an_average_are_the_average(n, alpha, start):
    x = np.random.default_rng(n).normal(100, 30, 9000)
    assert R.smooth(x, n, alpha, start) == pytest.approx(plain(x.tolist(), n, alpha, start), rel=1e-11, nan_ok=True)
    missing = x.copy()
    missing[500] = np.nan
    got = R.smooth(missing, n, alpha, start)
    assert got[:500] == pytest.approx(plain(x.tolist(), n, alpha, start)[:500], nan_ok=True) and np.isnan(got[500:]).all()
    for cut in (1, 7, 4000):  # segments, each alone, and their maps composed
        s = S.Smooth(n, alpha, start)
        parts = [x[i : i + cut] for i in range(0, 8000, cut)][:40]
        rows, place = np.array([len(p) for p in parts]), np.cumsum([0, *(len(p) for p in parts)])[:-1]
        b, sums, counts = (np.array(v, float)[:, None] for v in zip(*[S._share(s, p, int(a)) for p, a in zip(parts, place, strict=True)], strict=True))
        seeds, carries = S._composed([s], rows, place, b, sums, counts)
        got = np.concatenate([S.averaged(s, p, int(a), seeds[i, 0], carries[i, 0]) for i, (p, a) in enumerate(zip(parts, place, strict=True))])
        assert got == pytest.approx(plain(x[: len(got)].tolist(), n, alpha, start), rel=1e-10, nan_ok=True)


def test_missing_values_change_nothing_where_decayed():
    rng, e, want = random.Random(3), 0.0, []
    x = [None if rng.random() < 0.3 else rng.gauss(0, 1) for _ in range(700)]
    for v in x:
        e += 0.3 * (v - e) if v is not None else 0.0
        want.append(e)
    assert R.decayed(np.array([math.nan if v is None else v for v in x]), 0.3) == pytest.approx(want)
    assert R.decayed(np.array([math.nan] * 3), 0.3).tolist() == [0, 0, 0] and R.decayed(np.zeros(0), 0.3).tolist() == []


def series(spark):
    """Ten weeks by the hour with gaps of days, a short series, one of a single row, one with a missing price, one without a name."""
    rng, rows = random.Random(8), []
    for name, n in (("long", 1700), ("short", 20), ("one", 1), ("hole", 400), (None, 300)):
        close = 100.0
        for i in range(n):
            if name == "long" and 300 <= i < 700:
                continue
            close *= math.exp(rng.gauss(0, 0.01))
            c = None if name == "hole" and i == 250 else close
            rows.append((name, T + dt.timedelta(hours=i), close * 1.01, close * 0.99, c, rng.uniform(1, 9)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, bar_start timestamp_ntz, high double, low double, close double, volume double").withColumns({"open": F.col("close"), "rsi": F.lit("mine"), "_rows": F.lit(1)})


def test_indicators_of_a_dealt_series_are_those_of_the_whole(spark):
    rows = series(spark)
    plan = I.plan_indicators(CONFIGS).recursions
    whole = [R.Recursion(r.outputs, r.inputs, r.f) for r in plan]
    key = lambda r: (str(r.symbol), r.bar_start)
    want = sorted(R.with_recursions(rows, whole).collect(), key=key)
    got = sorted(R.with_recursions(rows, plan).collect(), key=key)
    assert len(got) == len(want) == 1300 + 20 + 1 + 400 + 300 and {*NAMES} <= {*got[0].asDict()} and got[0]._rows == 1
    for a, b in zip(got, want, strict=True):
        for name in NAMES:
            assert (a[name] is None) == (b[name] is None) and (a[name] is None or a[name] == pytest.approx(b[name], rel=1e-9, abs=1e-9)), (name, a, b)
    assert R.with_recursions(rows.limit(0), plan).count() == 0


def test_one_series_is_many_tasks(spark):
    """The weeks of one symbol lie in several partitions, each with a part of it only."""
    rows = series(spark).where("symbol = 'long'")
    made = R.with_recursions(rows, I.plan_indicators({"rsi": {}}).recursions)
    weeks = made.select(F.spark_partition_id().alias("p"), F.date_trunc("week", "bar_start").alias("w")).groupBy("w").agg(F.count_distinct("p").alias("parts"), F.min("p").alias("p")).collect()
    assert all(r.parts == 1 for r in weeks) and len(weeks) >= 8
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "symbol#" in plan and plan.count("FlatMapCoGroupsInArrow") == 2


def test_asof_by_day_is_asof(spark):
    """Against a search in each series: days without rows on either side, equal times, nulls in values, times and keys."""
    from tickloom.operators.signals import asof

    rng = random.Random(6)
    at = lambda: T + dt.timedelta(minutes=15 * rng.randint(0, 96 * 20))
    times = {s: sorted({at() for _ in range(25)}) for s in ("a", "b", None)}
    right = [(s, t, None if rng.random() < 0.2 else rng.random()) for s, own in times.items() for t in own]
    left = [(rng.choice(("a", "b", "c", None)), rng.choice((at(), at(), T)), i) for i in range(300)] + [("a", times["a"][3], 900), ("a", None, 901)]
    rows = spark.createDataFrame(left, "symbol string, ts timestamp_ntz, n int").withColumn("_day", F.lit("mine"))
    other = spark.createDataFrame([*right, ("a", None, 9.0)], "symbol string, at timestamp_ntz, v double")
    got = {r.n: r.v for r in asof(rows, other, ["v"], right_time="at").collect()}
    want = {}
    for s, t, n in left:
        before = [(u, v) for x, u, v in right if x == s and t is not None and u <= t]
        want[n] = max(before, key=lambda x: x[0])[1] if before else None
    assert got == want and asof(rows.limit(0), other, ["v"], right_time="at").count() == 0
