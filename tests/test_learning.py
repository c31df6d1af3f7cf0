"""Models by series, their schedule, and scores of a stream whose models change."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import series_models as SM
from tickloom.operators.features import features
from tickloom.streaming import scoring as P

DAY = dt.datetime(2024, 1, 1)
NAMES = ("ret_1", "ret_5", "pos_20", "rsi", "high_low_range")


def bars(spark, n=400, symbols=("a", "b"), seed=1):
    rng, rows = random.Random(seed), []
    for k, s in enumerate(symbols):
        close = 100.0
        for i in range(n):
            before, close = close, close * math.exp(rng.gauss(0, 0.01) + 0.004 * math.sin(i / (9 + k)))
            start = DAY + dt.timedelta(hours=i)
            rows.append((s, start, start + dt.timedelta(hours=1), before, max(before, close) * 1.002, min(before, close) * 0.998, close, rng.uniform(1, 9)))
    return spark.createDataFrame(rows, "symbol string, bar_start timestamp_ntz, bar_end timestamp_ntz, open double, high double, low double, close double, volume double")


def newton_alone(x, y, ridge=1.0):
    """One group's logistic model by plain Newton on standardised columns."""
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)
    z, w = np.column_stack([np.ones(len(x)), (x - mean) / scale]), np.zeros(x.shape[1] + 1)
    hold = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(z @ w)))
        w = w - np.linalg.solve((z.T * (p * (1 - p))) @ z + hold + 1e-9 * np.eye(len(w)), z.T @ (p - y) + hold @ w)
    return np.append(w[0] - w[1:] / scale @ mean, w[1:] / scale)


def test_models_of_groups_are_those_of_each_alone(spark):
    """Groups of very unequal size, one of a single class, one with a constant column."""
    rng, rows = np.random.default_rng(3), []
    for key, n in (("big", 6000), ("small", 40), ("flat", 60), ("one class", 30)):
        x = rng.normal(3, 2, (n, 3)) * [1, 100, 0.01]
        if key == "flat":
            x[:, 1] = 7.0
        y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 3)))).astype(int) if key != "one class" else np.ones(n, int)
        rows += [(key, *map(float, v), int(t)) for v, t in zip(x, y, strict=True)]
    awkward = [(None, 1.0, 1.0, 1.0, 1), ("big", None, 1.0, 1.0, 1), ("big", 1.0, float("nan"), 1.0, 0), ("big", 1.0, 1.0, float("inf"), 0), ("big", 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + awkward, "k string, f1 double, f2 double, f3 double, label int").withColumns({"x": F.lit("mine"), "w": F.lit(1)})
    got = {r.k: r for r in SM.fit_logistic(df, ["k"], ["f1", "f2", "f3"], rounds=60).collect()}
    assert {k: r.n for k, r in got.items()} == {"big": 6000, "small": 40, "flat": 60, "one class": 30}
    for key in ("big", "small", "flat"):
        own = np.array([r[1:] for r in rows if r[0] == key])
        assert got[key].weights == pytest.approx(newton_alone(own[:, :3], own[:, 3]), rel=1e-5, abs=1e-7)
    assert all(map(math.isfinite, got["one class"].weights))
    assert {r.k for r in SM.fit_logistic(df, ["k"], ["f1"], least=50).collect()} == {"big", "flat"}
    assert SM.fit_logistic(df.limit(0), ["k"], ["f1"]).collect() == []


def test_gradient_and_curvature_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    z, y, w, h = rng.normal(size=(30, 3)), rng.integers(0, 2, 30), rng.normal(size=3), 1e-5
    s = SM.newton_sums(z, y, w)
    for i in range(3):
        e = np.eye(3)[i] * h
        up, down = SM.newton_sums(z, y, w + e), SM.newton_sums(z, y, w - e)
        assert (up[0] - down[0]) / (2 * h) == pytest.approx(s[1 + i], rel=1e-5)
        assert (up[1:4] - down[1:4]) / (2 * h) == pytest.approx(s[4:].reshape(3, 3)[i], rel=1e-4, abs=1e-6)


def test_daily_models_are_least_squares_of_all_days_before(spark):
    rng = np.random.default_rng(5)
    rows = [(k, DAY + dt.timedelta(hours=7 * i), *map(float, rng.normal(size=2)), float(rng.normal())) for k in "ab" for i in range(80)]
    rows += [("a", None, 1.0, 1.0, 1.0), ("a", DAY, None, 1.0, 1.0), (None, DAY, 1.0, 1.0, 1.0), ("c", DAY, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, known_at timestamp_ntz, u double, v double, forward double")
    got = SM.daily_models(df, ["symbol"], ["u", "v"], least=10).collect()
    assert {r.symbol for r in got} == {"a", "b"} and len({(r.symbol, r.valid_from) for r in got}) == len(got) > 20
    for r in got:
        own = np.array([x[2:] for x in rows if x[0] == r.symbol and None not in x and x[1] < r.valid_from])
        want = np.linalg.lstsq(np.column_stack([np.ones(len(own)), own[:, :2]]), own[:, 2], rcond=None)[0]
        assert r.n == len(own) and r.weights == pytest.approx(want, rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("n", [1, 3, 7])
def test_models_take_turns(spark, n):
    """As a loop over steps: every stagger-th step trains the next model."""
    times = [DAY + dt.timedelta(hours=5 * i) for i in range(90)]
    steps = spark.createDataFrame([(t,) for t in [*times, *times[:9], None]], "ts timestamp_ntz")
    models = spark.createDataFrame([(f"m{i}",) for i in range(n)] + [("m0",), (None,)], "model string")
    got = sorted((r.step, r.ts, r.model) for r in SM.retrain_schedule(steps, models, every=5).collect())
    stagger = max(1, max(5, n) // n)
    assert got == [(s, times[s - 1], f"m{(s // stagger) % n}") for s in range(1, 91) if s % stagger == 0]
    assert SM.retrain_schedule(steps, models.limit(0)).collect() == []


def score_alone(x, weights):
    if weights is None:
        return 0.5
    p = round(1 / (1 + math.exp(-(weights[0] + sum(a * (b or 0.0) for a, b in zip(weights[1:], x, strict=True))))), 4)
    return 0.5 if 0.38 < p < 0.62 else p


def test_scores_follow_the_model_of_their_time(spark, tmp_path):
    """Bars come in files, some late, some twice. Models change between two micro-batches of one run, and between two runs:
    each row names the version that was valid and published, and has the score that batch scoring gives by it."""
    rows = bars(spark)
    schema = rows.schema
    path, root, registry = str(tmp_path / "in"), str(tmp_path / "out"), P.Registry(str(tmp_path / "models"))
    hours = [(0, 250), (250, 320), (300, 360), (360, 400)]  # 300 to 320 come twice
    for a, b in hours[:3]:
        rows.where(F.col("bar_start").between(DAY + dt.timedelta(hours=a), DAY + dt.timedelta(hours=b - 1))).coalesce(1).write.mode("append").parquet(path)
    valid = [DAY + dt.timedelta(hours=h) for h in (120, 310, 330)]
    fit = [P.train(rows, NAMES, until=str(v)) for v in valid]
    assert registry.publish(fit[0], str(valid[0])) == 1
    assert [r.n for r in fit[0].collect()] == [r.n for r in registry.models(spark).collect()]
    fit[1].write.parquet(f"{registry.root}/models/version=2")  # a call that broke off before it was published

    def then(number):
        if number == 1 and len(registry.versions(spark)) == 1:
            assert registry.publish(fit[1], str(valid[1])) == 2

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        query = stream.writeStream.foreachBatch(P.score_bars(root, registry, NAMES, then=then)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.awaitTermination(600)

    go()
    registry.publish(fit[2], str(valid[2]))
    rows.where(F.col("bar_start") >= DAY + dt.timedelta(hours=360)).coalesce(1).write.mode("append").parquet(path)
    go()
    got = spark.read.parquet(f"{root}/scores").collect()
    known = {(r.version, r.symbol): r.weights for r in registry.models(spark).collect()}
    x = {(r.symbol, r.bar_start): [r[n] for n in NAMES] for r in features(rows, NAMES).collect()}
    assert len(got) == 2 * (400 + 20) and {r.batch for r in got} == {0, 1, 2, 3}
    for r in got:
        published = [1, 1, 2, 3][r.batch]
        version = max((v for v in range(1, published + 1) if valid[v - 1] <= r.bar_end), default=None)
        assert r.version == version
        assert r.confidence == pytest.approx(score_alone(x[r.symbol, r.bar_start], known.get((version, r.symbol))), abs=2e-4)
    assert {r.version for r in got} == {None, 1, 2, 3} and any(r.confidence != 0.5 for r in got)


def test_awkward_bars_are_scored(spark, tmp_path):
    """Nulls in keys are left out, a null price and a symbol without model are scored; a repeated batch replaces itself."""
    rows = bars(spark, 30, ("a",))
    odd = spark.createDataFrame([(None, DAY, DAY, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", None, DAY, 1.0, 1.0, 1.0, 1.0, 1.0), ("z", DAY, None, None, None, None, None, None)], rows.schema)
    write = P.score_bars(str(tmp_path), P.Registry(str(tmp_path / "none")), NAMES)
    for _ in range(2):
        write(rows.unionByName(odd), 0)
    write(rows.limit(0), 1)
    got = spark.read.parquet(str(tmp_path / "scores")).collect()
    assert len(got) == 31 and {(r.confidence, r.version) for r in got} == {(0.5, None)}


def test_models_valid_by_day(spark):
    rows = bars(spark, 100, ("a",))
    models = spark.createDataFrame([("a", DAY + dt.timedelta(days=1), [1.0]), ("a", DAY + dt.timedelta(days=3), [3.0]), ("b", DAY, [9.0])], "symbol string, valid_from timestamp_ntz, weights array<double>")
    got = {r.bar_end: r.weights for r in SM.with_models(rows, models, ["symbol"]).collect()}
    assert len(got) == 100
    for t, w in got.items():
        assert w == (None if t < DAY + dt.timedelta(days=1) else [1.0] if t < DAY + dt.timedelta(days=3) else [3.0])
