"""Small fixtures with results worked out by hand, and properties."""

from __future__ import annotations

import datetime as dt
import math
import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tickloom.functions import recursive as R
from tickloom.operators import alerts as A
from tickloom.operators import conditions as C
from tickloom.operators import features as X
from tickloom.operators import indicators as I
from tickloom.operators import metrics as M
from tickloom.operators import risk as K
from tickloom.operators import search as G
from tickloom.operators import signals as S
from tickloom.operators import simulate as Z
from tickloom.operators import store as T
from tickloom.schema import CostParams, RiskParams, Strategy

DAY = dt.datetime(2024, 1, 1)


def bars(spark, close, symbol="BTC", spread=1.0):
    rows = [(symbol, DAY + dt.timedelta(hours=i), DAY + dt.timedelta(hours=i + 1), float(c), float(c) + spread, float(c) - spread, float(c), 100.0 + i % 7) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, bar_start timestamp_ntz, bar_end timestamp_ntz, open double, high double, low double, close double, volume double")


def curve(spark, values):
    return spark.createDataFrame([(DAY + dt.timedelta(hours=i), float(v)) for i, v in enumerate(values)], "ts timestamp_ntz, equity double")


def trades(spark, pnl):
    return spark.createDataFrame([(float(p), DAY, DAY + dt.timedelta(minutes=90)) for p in pnl], "pnl double, opened_at timestamp_ntz, closed_at timestamp_ntz")


def one(df):
    return df.collect()[0]


def test_metrics(spark):
    got = one(M.trade_metrics(trades(spark, [100, -50, 200])))
    assert (got.total_trades, got.profit_factor, got.avg_hold_minutes) == (3, 6.0, 90.0)
    ends = one(M.equity_metrics(spark.createDataFrame([(DAY, 10000.0), (DAY + dt.timedelta(days=1), 10250.0)], "ts timestamp_ntz, equity double")))
    assert ends.total_return == pytest.approx(2.5) and ends.days == 1
    assert one(M.trade_metrics(trades(spark, [10, -10, 10, -10]))).win_rate == 50.0
    assert one(M.trade_metrics(trades(spark, [5]))).profit_factor == 999.0
    none = one(M.backtest_metrics(trades(spark, []), curve(spark, [1, 1]), ()))
    assert none.total_trades == 0 and none.win_rate == 0


@pytest.mark.parametrize(("values", "want"), [([10000, 9500, 9800, 9000], [0, 5, 2, 10]), ([10000, 11000, 10500], [0, 0, 4.5454545])])
def test_drawdown(spark, values, want):
    assert [r.drawdown for r in M.drawdown_curve(curve(spark, values)).orderBy("ts").collect()] == pytest.approx(want)


def test_monthly(spark):
    at = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 20), dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 20)]
    rows = spark.createDataFrame([*zip(at, [10000.0, 10100.0, 10200.0, 10098.0], strict=True)], "ts timestamp_ntz, equity double")
    got = {r.month: round(r.ret, 2) for r in M.monthly_returns(rows).collect()}
    assert got == {"2024-01": 1.0, "2024-02": -0.01}


def test_costs(spark):
    row = spark.createDataFrame([("BTC", 50000.0, 51000.0, 0.01), ("?", 50000.0, 51000.0, 0.01)], "symbol string, entry_price double, exit_price double, quantity double")
    got = [r.c for r in row.select(M.trade_costs(CostParams(spread_pct={"BTC": 0.01})).alias("c")).collect()]
    assert got[0] == pytest.approx(0.4545) and got[1] == pytest.approx(1010 * (0.0004 + 0.00015))
    assert one(row.select(M.trade_costs(CostParams(enabled=False)).alias("c"))).c == 0


def test_levels(spark):
    price, side = F.lit(50000.0), F.lit(1)
    got = one(spark.range(1).select(K.stop_loss(price, side, RiskParams()).alias("s"), K.take_profits(price, side, RiskParams())[0].alias("t")))
    assert got.s == pytest.approx(49000) and got.t == pytest.approx(51500)


def test_breaker(spark):
    rows = spark.createDataFrame([("a", 1, 0.0, 0.0, 0), ("a", 2, 6.0, 0.0, 0), ("a", 3, 0.0, 0.0, 0)], "account string, n int, drawdown double, daily_pnl double, losses_in_row int")
    got = K.breaker(rows, RiskParams(), ("account",), ("n",)).orderBy("n").collect()
    assert [r.tripped for r in got] == [False, True, True] and got[2].trip_reason == "drawdown"


def dealt(spark, n=400, seed=3):
    """Trades of three accounts, one of them without a name and one that loses all; with equal times and a day without loss."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), DAY + dt.timedelta(hours=rng.randint(0, 24 * 20)), i, rng.uniform(-130, 115)) for i in range(n)]
    rows += [("c", DAY + dt.timedelta(hours=7 * i), n + i, x) for i, x in enumerate([-900.0, -200.0, 50.0, 150.0, 120.0, -30.0, -60.0, 10.0])]
    return spark.createDataFrame([(*x, DAY) for x in rows], "account string, closed_at timestamp_ntz, seq long, pnl double, opened_at timestamp_ntz")


def joins(df, kind="Join"):
    return df._jdf.queryExecution().optimizedPlan().toString().count(kind)


def test_daily_metrics_read_trades_once(spark):
    """As all metrics over the daily equity, from one reading of the trades."""
    rows = dealt(spark)
    names = ["account", "total_trades", "win_rate", "final", "total_return", "max_drawdown", "sharpe"]
    got = M.daily_metrics(rows, ("account",), 1000.0)
    want = M.backtest_metrics(rows, M.daily_equity(rows, ("account",), 1000.0), ("account",))
    assert sorted(got.select(names).collect()) == sorted(want.select(names).collect())
    assert joins(got) == 0 and joins(want) > 0


@pytest.mark.parametrize(("balance", "limits"), [(5000.0, (4, 6, 420, 6)), (1000.0, (1e9, 1e9, 250, 100)), (1000.0, (1e9, 1e9, 1e9, 4)), (-20.0, (30, 5, 1e9, 100)), (-20.0, (7, 1e9, 1e9, 100)), (5000.0, (1e9, 1e9, 1e9, 100))])
def test_first_trips(spark, balance, limits):
    """As the breaker over the whole curve tells."""
    p, by, order = RiskParams(max_daily_drawdown=limits[0], max_weekly_drawdown=limits[1], max_daily_loss=limits[2], max_consecutive_losses=limits[3]), ("account",), ("closed_at", "seq")
    rows = dealt(spark, 250)
    whole = K.breaker(K.account_curve(rows, by, order, balance), p, by, order)
    want = whole.groupBy("account").agg(F.count_if("tripped").alias("blocked"), F.max("trip_reason").alias("reason"), F.min(F.when(F.col("tripped"), F.col("closed_at"))).alias("tripped_at"))
    assert sorted(map(repr, K.first_trips(rows, p, by, order, balance).collect())) == sorted(map(repr, want.collect()))


def test_impact(spark):
    rows = spark.createDataFrame([(x,) for x in (0.8, 0.6, 0.4, 0.2, 0.05)], "x double")
    assert [r.i for r in rows.select(T.impact(F.col("x")).alias("i")).collect()] == [5, 4, 3, 2, 1]


def test_walk_forward(spark):
    ends = spark.createDataFrame([(dt.datetime(2025, 1, 1), dt.datetime(2026, 1, 1))], "start timestamp_ntz, end timestamp_ntz")
    got = G.walk_forward_windows(ends, 6, 1, 1).orderBy("train_start").collect()
    assert len(got) == 6 and all(r.train_end == r.val_start for r in got)
    short = spark.createDataFrame([(dt.datetime(2025, 1, 1), dt.datetime(2025, 3, 1))], "start timestamp_ntz, end timestamp_ntz")
    assert G.walk_forward_windows(short, 6, 1, 1).count() == 0
    w = spark.createDataFrame([(1, 1.0, 0.8), (2, 1.0, -0.3), (3, 2.0, 1.1)], "window int, train_sharpe double, val_sharpe double")
    r = one(G.walk_forward_report(w))
    assert r.mean_val == pytest.approx(0.53333, abs=1e-4) and r.positive_pct == pytest.approx(66.667, abs=1e-2) and r.best_window == 3
    single = one(G.walk_forward_report(w.where("window = 1")))
    assert (single.std_val, single.efficiency, single.correlation) == (0, 0, 0)


def test_spearman(spark):
    rows = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(6)] + [("b", float(i), float(-i)) for i in range(6)], "k string, x double, y double")
    got = {r.k: r.rho for r in G.spearman(rows, "x", "y", ["k"]).collect()}
    assert got["a"] == pytest.approx(1) and got["b"] == pytest.approx(-1)


def test_deflated_sharpe(spark):
    got = one(spark.range(1).select(M.deflated_sharpe(F.lit(-1.0), F.lit(100)).alias("d"), M.deflated_p_value(F.lit(0.0)).alias("p")))
    assert got.d == 0 and got.p == pytest.approx(0.5)


def test_labels(spark):
    got = bars(spark, [100 + 0.5 * i for i in range(100)]).withColumns({"y": X.binary(4, 0.005), "c": X.three_class(4, 0.01)}).orderBy("bar_start").collect()
    assert got[0].y == 1 and got[-1].y is None and got[0].c == "up" and got[-1].c is None


def test_triple_barrier(spark):
    close = [100, 101, 103, 90, 90, 90]
    got = bars(spark, close, spread=0.0).withColumn("y", X.triple_barrier(3, 0.02, 0.02)).orderBy("bar_start").collect()
    assert [r.y for r in got] == [1, 0 if 103 < 101 * 1.02 else 0, 0, None, None, None]


def test_recursions():
    x = np.arange(1.0, 8.0)
    assert R.ema(x, 3).tolist()[2:] == [2.0, 3.0, 4.0, 5.0, 6.0] and np.isnan(R.ema(x, 3)[:2]).all()
    assert R.rsi(np.array([1.0, 2, 3, 4, 5]), 3)[3] == 100
    assert R.rsi(np.ones(6), 3)[4] == 0
    assert R.atr(x + 1, x - 1, x, 2)[2] == pytest.approx(2)
    assert np.isnan(R.adx(x + 1, x - 1, x, 2)[:3]).all() and R.adx(x + 1, x - 1, x, 2)[3] == pytest.approx(100)
    line, signal, histogram = R.macd(np.arange(60.0), 12, 26, 9)
    assert np.isnan(line[:25]).all() and line[25] == pytest.approx(7) and histogram[40] == pytest.approx(0)
    assert R.ema(np.zeros(0), 3).tolist() == []


def test_prefix_invariance(spark):
    rng = np.random.default_rng(42)
    close = 50000 + np.cumsum(rng.normal(0, 100, 120))
    config = {"rsi": {}, "macd": {}, "bollinger": {}, "adx": {}, "stochastic": {}, "obv": {}, "cci": {}, "atr": {}, "sma": {"period": 5}}
    full, part = (I.with_indicators(bars(spark, close[:n], spread=50.0), config).orderBy("bar_start").collect() for n in (120, 90))
    for a, b in zip(full[:90], part, strict=True):
        assert a == b
    assert all(0 <= r.rsi <= 100 for r in full if r.rsi is not None)
    assert full[-1].adx is not None and full[0].sma is None


def test_unknown_configuration_is_passed_over(spark):
    assert "sma" not in I.with_indicators(bars(spark, [1, 2]), {"sma": 5, "what": {"period": 3}}).columns


@pytest.mark.parametrize("text", ["nonexistent > 50", "close >", "__import__('os')", "close.real > 1", "close > 'a'", "lambda: 1", ""])
def test_invalid_conditions_never_signal(spark, text):
    df = bars(spark, [1, 2, 3])
    assert df.where(C.compile_condition(text, df.columns)).count() == 0
    assert text in C.problems([text], df.columns)


def test_conditions(spark):
    df = bars(spark, [1, 2, 3, 4])
    count = lambda t: df.withColumn("met", C.compile_condition(t, df.columns)).where("met").count()
    assert count("1 < close < 4") == 2 and count("not close > 1") == 1 and count("close / 0 > 1") == 0 and count("close > sma(close, 2)") == 3
    assert C.sanitise(["adx > 20", "close > 1"], df.columns, "close > 0") == ["close > 1"]
    assert C.sanitise(["adx > 20"], df.columns, "close > 0") == ["close > 0"]


def test_conflict_gives_no_trade(spark):
    s = Strategy("s", {}, {"long": ("close > 0",), "short": ("close > 2",)})
    got = S.signal_matrix(bars(spark, [1, 2, 3]), [s]).orderBy("ts").collect()
    assert [r.side for r in got] == [1, 1, 0]
    assert S.signal_matrix(bars(spark, [1]), []).count() == 0


def test_asof_keeps_the_last_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5)], "symbol string, ts int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 6, 3.0)], "symbol string, ts int, v double")
    got = {(r.symbol, r.ts): r.v for r in S.asof(left, right, ["v"]).collect()}
    assert got == {("a", 5): 2.0, ("a", 1): None, ("b", 5): None}


def test_falling_market_stops_a_long(spark):
    close = np.linspace(50000, 40000, 50)
    rows = [{"strategy": "s", "symbol": "BTC", "tf": "1h", "ts": DAY + dt.timedelta(hours=i), "side": 1 if i == 5 else 0, "exit_long": False, "exit_short": False, "close": float(c)} for i, c in enumerate(close)]
    fold = Z.run_fold(rows, Z.Fold("r", 10000.0, RiskParams(), CostParams(), 8, 1.5, None))
    assert [t["exit_reason"] for t in fold.trades] == ["stop_loss"]
    # The trailing stop is set behind the best price after the entry bar, and acts from the next bar on.
    assert fold.trades[0]["exit_price"] < close[5]
    poor = Z.run_fold(rows, Z.Fold("r", 0.0, RiskParams(), CostParams(), 8, 1.5, None))
    assert not poor.trades and len(poor.curve) == 50


def test_simulation_conserves_money(spark):
    rng = random.Random(1)
    rows = [Row(run_id=run, strategy=s, symbol="X", tf="1h", ts=DAY + dt.timedelta(hours=i), side=rng.choice([-1, 0, 1]), exit_long=rng.random() < 0.2, exit_short=rng.random() < 0.2, close=100 + rng.random()) for run in "ab" for s in "pq" for i in range(60)]
    done = Z.simulate(spark.createDataFrame(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))).persist()
    for run in "ab":
        pnl = sum(t.pnl for t in Z.trades(done).where(F.col("run_id") == run).collect())
        last = Z.equity(done).where(F.col("run_id") == run).orderBy(F.desc("ts")).first()
        assert pnl != 0 and last.equity == pytest.approx(10000 + pnl, abs=20)


def test_cooldown(spark):
    times = F.array(*[F.lit(float(x)) for x in (0, 100, 299, 300, 450, 601)])
    assert one(spark.range(1).select(A.cooldown(times, F.lit(300)).alias("f"))).f == [0, 300, 601]


def test_rules_of_config_shape(spark):
    events = spark.createDataFrame([("alert", {"type": "stop"}), ("alert", {}), ("other", {"type": "stop"})], "type string, data map<string,string>")
    rules = spark.createDataFrame([("r", "alert", {"type": "stop"}, "critical", 60.0, True, "")], A.RULE)
    assert A.match(events, rules).count() == 1


def test_evolution_finds_the_optimum():
    def make(rng):
        return G.Chromosome((G.Gene("sma.period", rng.randint(2, 60), 2, 60, whole=True), G.Gene("mode", rng.choice("ab"), choices=("a", "b"))), (("entry.long", ("close > sma",)),))

    score = lambda people: [-abs(float(p.genes[0].value) - 33) + (p.genes[1].value == "b") for p in people]
    best, history = G.evolve(make, score, G.SearchParams(population=30, generations=20, seed=3))
    assert best.genes[0].value == 33 and best.genes[1].value == "b" and history == sorted(history)
    s = best.decode("champion")
    assert s.indicators == {"sma": {"period": 33}} and s.entry == {"long": ("close > sma",)} and best.size() == (1, 1, 1)  # a choice is no number
    assert all(2 <= g.value <= 60 for g in G.mutate(best, random.Random(0), 1.0, {}).genes[:1])


def test_articles_and_maps(spark):
    got = one(spark.range(1).select(T.merge_maps(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))).alias("m"))).m
    assert got == {"a": "2", "b": "3"}
    bad = spark.createDataFrame([("nonsense",), ("[]",), ('{"x": 1}',)], "body string")
    assert T.normalise_articles(bad).count() == 0


def test_gbt(spark):
    from tickloom.operators import ml

    rows = spark.createDataFrame([(float(i % 10), float(i % 3), 1 if i % 10 > 5 else 0) for i in range(200)], "a double, b double, label int")
    model = ml.train_gbt(rows, ["a", "b"], trees=5)
    got = ml.predict(model, rows).select("label", "confidence").collect()
    assert sum((r.confidence > 0.5) == (r.label == 1) for r in got) > 190
    assert ml.importances(model, ["a", "b"])["a"] > 0.9


def test_softmax_and_quantiles(spark):
    got = one(spark.range(1).select(X.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s"), X.quantile_confidence(F.lit(-1.0), F.lit(0.0), F.lit(1.0)).alias("q"), F.size(X.patches(F.sequence(F.lit(1), F.lit(64)))).alias("n")))
    assert got.s == [0.5, 0.5] and got.q == 0 and got.n == 7
    assert math.isclose(sum(got.s), 1)


def test_rolling_frames_need_all_values(spark):
    from tickloom.functions import rolling as W

    rows = bars(spark, [1, 2, 3, 4]).withColumn("close", F.when(F.col("close") != 2, F.col("close")))
    got = rows.withColumn("m", W.mean(F.col("close"), 2)).orderBy("bar_start").collect()
    assert [r.m for r in got] == [None, None, None, 3.5]


def test_registered_indicator(spark):
    def double(plan, cfg):
        plan.stages[0]["double_close"] = F.col("close") * 2

    I.register_indicator("double", double)
    assert one(I.with_indicators(bars(spark, [3]), {"double": {}})).double_close == 6
    del I.KINDS["double"]


def test_several_recursions_share_a_pass(spark):
    out = R.with_recursions(bars(spark, range(10)), [R.Recursion(("a",), ("close",), partial(R.ewm, span=3)), R.Recursion(("b",), ("a",), partial(R.ewm, span=3))])
    assert out.orderBy("bar_start").collect()[0].b == 0


def test_indicator_configurations_as_users_write_them(spark):
    times = [DAY + dt.timedelta(hours=i) for i in range(80)]
    rows = [("x", t, t, 1.0 + i % 7, 2.0 + i % 7, 0.5 + i % 7, 1.0 + i % 5, 10.0) for i, t in enumerate(times)]
    bars = spark.createDataFrame(rows, "symbol string, bar_start timestamp_ntz, bar_end timestamp_ntz, open double, high double, low double, close double, volume double")
    wide = I.with_indicators(bars, {"bollinger": {"period": 20, "stddev": 3.0}}).orderBy("bar_start").collect()[-1]
    narrow = I.with_indicators(bars, {"bollinger": {"period": 20, "stddev": ""}}).orderBy("bar_start").collect()[-1]
    assert wide.bollinger_upper - wide.bollinger_middle == pytest.approx(1.5 * (narrow.bollinger_upper - narrow.bollinger_middle))
    both = I.plan_indicators({"ema": {"fast_period": 9, "slow_period": 21, "source": "close"}})
    assert {"ema_fast", "ema_slow"} <= both.columns() and "ema_14" not in both.columns()
    assert {"ema_9", "ema_21", "ema_50"} <= I.plan_indicators({"ema": {"periods": [9, 21, 50]}}).columns()
    fast = I.with_indicators(bars, {"ema": {"fast_period": 12, "period": 30}}).orderBy("bar_start").collect()[-1]
    alone = I.with_indicators(bars, {"ema": {"periods": [12, 30]}}).orderBy("bar_start").collect()[-1]
    assert (fast.ema_fast, fast.ema_slow) == (alone.ema_12, alone.ema_30)


# --- simulation against an independent account ---------------------------------------------------------------


def account(rows, strategies, balance=10_000.0, most=8):
    """Trades of one run, position by position on a plain ledger; rows: dicts in time order."""
    cash, held, out = balance, [], []
    own = {s.name: s for s in strategies}
    for ts in sorted({r["ts"] for r in rows}):
        now = sorted((r for r in rows if r["ts"] == ts), key=lambda r: (r["strategy"], r["symbol"], r["tf"]))
        at = {(r["strategy"], r["symbol"], r["tf"]): r for r in now}
        for h in list(held):
            r, s = at.get(h["id"]), own[h["id"][0]]
            if r is None:
                continue
            x, d, word, price = r["close"], h["side"], None, r["close"]
            h["seen"] = x
            take = [(lv, p) for lv, p in h["goals"] if (x >= lv if d > 0 else x <= lv)]
            if (x <= h["stop"]) if d > 0 else (x >= h["stop"]):
                word, price = "stop_loss", h["stop"]
            elif take:
                word, price = f"tp_{int(take[0][1])}pct", take[0][0]
            else:
                h["best"] = max(h["best"], x) if d > 0 else min(h["best"], x)
                trail = 1.5 if s.trailing_pct is None else s.trailing_pct
                if trail:
                    h["stop"] = h["best"] * (1 - d * trail / 100)
                if s.max_hold_hours and ts - h["since"] >= dt.timedelta(hours=s.max_hold_hours):
                    word = "max_hold"
                elif s.use_indicator_exits and r["exit_long" if d > 0 else "exit_short"]:
                    word = "indicator"
            part = 1.0
            if word is None and (pct := r["reduce_long" if d > 0 else "reduce_short"]) and h["cuts"] < 4:
                word, part = "reduce", pct / 100 if h["paid"] * (1 - pct / 100) >= 10 else 1.0
            if word:
                q, paid = h["q"] * part, h["paid"] * part
                cost = (h["entry"] + price) * q * (0.0004 + 0.00015)
                pnl = (price - h["entry"]) * q * d - cost
                cash += paid + pnl
                out.append((h["id"][0], h["id"][1], d, price, q, pnl, word, h["since"], ts))
                h["q"], h["paid"], h["cuts"] = h["q"] - q, h["paid"] - paid, h["cuts"] + 1
                if part == 1.0:
                    held.remove(h)
        for r in now:
            key, s, d, x = (r["strategy"], r["symbol"], r["tf"]), own[r["strategy"]], r["side"], r["close"]
            if not d or any(h["id"][:2] == key[:2] for h in held):
                continue
            if len(held) >= most:
                break
            q = min(min(cash * 0.3 * 0.05, cash * 0.1) / x, cash * 0.01 / (x * 0.02))
            if q <= 0 or q * x > cash * 0.95:
                continue
            cash -= q * x
            stop = 2.0 if s.stop_pct is None else s.stop_pct
            held.append({"id": key, "side": d, "q": q, "entry": x, "paid": q * x, "stop": x * (1 - d * max(stop, 0.5) / 100), "goals": [(x * (1 + d * p / 100), p) for p in (3.0, 5.0, 10.0)], "best": x, "since": ts, "seen": x, "cuts": 0})
    for h in held:
        cost = (h["entry"] + h["seen"]) * h["q"] * (0.0004 + 0.00015)
        out.append((h["id"][0], h["id"][1], h["side"], h["seen"], h["q"], (h["seen"] - h["entry"]) * h["q"] * h["side"] - cost, "end_of_backtest", h["since"], ts))
    return out


def test_simulation_is_the_accounts(spark):
    rng = random.Random(11)
    strategies = [Strategy("a"), Strategy("b", stop_pct=1.0, trailing_pct=0.0, max_hold_hours=6.0), Strategy("c", trailing_pct=3.0, use_indicator_exits=False), Strategy("d", max_hold_hours=0.0, trailing_pct=0.0, stop_pct=50.0)]
    rows = []
    for run in ("one", "two"):
        price = {x: 100.0 for x in "xyz"}
        for i in range(120):
            for x in "xyz":
                price[x] *= 1 + rng.gauss(0, 0.012)
                for s in "abcd":
                    if rng.random() < 0.9:
                        rows.append({"run_id": run, "strategy": s, "symbol": x, "tf": "1h", "ts": DAY + dt.timedelta(hours=i), "side": rng.choice([0, 0, 0, 1, -1]), "exit_long": rng.random() < 0.05, "exit_short": rng.random() < 0.05, "close": price[x], "reduce_long": rng.choice([None, None, None, 25.0, 60.0]), "reduce_short": rng.choice([None, None, None, 50.0, 99.0])})
    signals = spark.createDataFrame(rows, "run_id string, strategy string, symbol string, tf string, ts timestamp_ntz, side int, exit_long boolean, exit_short boolean, close double, reduce_long double, reduce_short double")
    got = {}
    for r in Z.trades(Z.simulate(signals, strategies=strategies)).collect():
        got.setdefault(r.run_id, []).append((r.strategy, r.symbol, r.side, r.exit_price, r.quantity, r.pnl, r.exit_reason, r.opened_at, r.closed_at))
    for run in ("one", "two"):
        want = account([r for r in rows if r["run_id"] == run], strategies)
        key = lambda t: (t[8], t[7], t[0], t[1], t[6], -t[4])
        assert len(want) > 60 and {w[6] for w in want} >= {"stop_loss", "tp_3pct", "max_hold", "indicator", "reduce", "end_of_backtest"}
        for a, b in zip(sorted(got[run], key=key), sorted(want, key=key), strict=True):
            assert a[:3] == b[:3] and a[6:] == b[6:] and a[3:6] == pytest.approx(b[3:6])


# --- search on bars -----------------------------------------------------------------------------------------


def test_genes_of_a_strategy_and_back():
    s = Strategy("s", {"rsi": {"period": 10}, "bollinger": {"period": 30, "stddev": 2.5}, "obv": {}}, {"long": ("rsi < 30",), "short": ()}, {"long": ("rsi > 65",), "short": ()}, symbols=("x",))
    back = G.encode(s).decode("s")
    assert (back.indicators["rsi"], back.indicators["bollinger"], back.entry, back.exit, back.symbols) == ({"period": 10}, {"period": 30, "stddev": 2.5}, s.entry, s.exit, s.symbols) and "obv" in back.indicators
    rng = random.Random(0)
    for _ in range(30):
        made = G.random_chromosome(rng).decode("r")
        known = {"close", "volume", *I.plan_indicators(made.indicators).columns()}
        texts = [t for own in (made.entry, made.exit) for side in own.values() for t in side]
        assert texts and not C.problems(texts, known)


def test_search_and_walk_forward_on_bars(spark, tmp_path):
    rng = random.Random(1)
    close = [100.0]
    for _ in range(24 * 75):
        close.append(close[-1] * (1 + rng.gauss(0, 0.01)))
    rows = bars(spark, close)
    params = G.SearchParams(population=3, generations=2, elites=1, immigrants=1, seed=3)
    champion, history = G.evolve(G.random_chromosome, G.scorer(rows), params, G.POOLS)
    assert len(history) == 2 and history[1] >= history[0] and all(h > -1000 for h in history)
    assert champion.decode("x").entry
    ends = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1))], "start timestamp_ntz, end timestamp_ntz")
    windows = G.walk_forward_windows(ends, 1, 1, 1)
    state, calls = str(tmp_path / "state"), []

    def make(r):
        calls.append(1)
        return G.random_chromosome(r)

    one_ = G.SearchParams(population=2, generations=1, elites=1, immigrants=0, seed=4)
    first = G.walk_forward(rows, windows, make, state, one_, G.POOLS).collect()
    assert len(first) == windows.count() == 1 and first[0].champion and calls
    calls.clear()
    again = G.walk_forward(rows, windows, make, state, one_, G.POOLS)
    assert again.collect() == first and not calls  # finished windows are not searched again
    assert G.walk_forward_report(again).first().windows == 1


def test_strategy_files(tmp_path):
    from tickloom.sources.strategies import StrategyFolder, file_name

    folder = StrategyFolder(tmp_path / "s")
    assert folder.names() == [] and folder.load_all() == []
    s = Strategy("My Plan/2", {"rsi": {"period": 14}}, {"long": ("rsi < 35",), "short": ()}, {"long": ("rsi > 60",)}, {"long": (("rsi > 55", 30.0),)}, ("1h", "4h"), ("x",), stop_pct=1.5, use_indicator_exits=False, mode="trend")
    folder.save(s)
    folder.save(Strategy("测试 b", mode="range"))
    assert folder.names() == ["my_plan_2", "测试_b"] and folder.load("my plan 2") == s and len(folder.load_all()) == 2
    assert file_name("A  b/c!?d") == "a_b_c_d"
    assert folder.delete("My Plan/2") and not folder.delete("My Plan/2") and folder.names() == ["测试_b"]
    with pytest.raises(FileNotFoundError):
        folder.load("nothing")


def test_exports_and_back(spark, tmp_path):
    from tickloom.sources import files as E

    rows = spark.createDataFrame([(2, 'a "b", c'), (1, None), (3, "Zed")], "id int, text string")
    E.write_csv(rows, str(tmp_path / "csv"), ["id"])
    assert E.read_csv(spark, str(tmp_path / "csv"), "id int, text string").orderBy("id").collect() == rows.orderBy("id").collect()
    E.write_csv(rows, str(tmp_path / "found"), search="zE")
    assert [r.id for r in E.read_csv(spark, str(tmp_path / "found"), "id int, text string").collect()] == [3]
    E.write_json(rows, str(tmp_path / "json"))
    assert E.read_json(spark, str(tmp_path / "json"), "id int, text string").orderBy("id").collect() == rows.orderBy("id").collect()
    b = bars(spark, range(1, 40))
    E.write_training_set(b.select("symbol", "bar_start", "close"), b.select("symbol", "bar_start", X.binary().alias("label")), str(tmp_path / "train"))
    assert E.read_training_set(spark, str(tmp_path / "train")).where("label IS NULL").count() == 0


def test_bursts_fire_as_one_by_one(spark):
    rng = random.Random(2)
    times = sorted(rng.uniform(0, 20_000) for _ in range(300))
    want, last = [], None
    for t in times:
        if last is None or round(t, 6) - last >= 90:
            last = round(t, 6)
            want.append(last)
    rows = spark.createDataFrame([("r", DAY + dt.timedelta(seconds=round(t, 6)), 90.0) for t in times], "name string, ts timestamp_ntz, cooldown_seconds double")
    got = sorted((r.ts - DAY).total_seconds() for r in A.fired(rows).collect())
    assert got == pytest.approx(want)
    assert A.fired(rows.limit(0)).count() == 0


def test_drawdowns_and_actions(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = spark.createDataFrame([("s", 1, 100.0, at(1, 1)), ("s", 2, -60.0, at(1, 2)), ("s", 3, -20.0, at(2, 1)), ("s", 4, 10.0, at(9, 1))], "strategy string, n int, pnl double, closed_at timestamp_ntz")
    got = K.drawdowns(rows, ("strategy",), ("closed_at", "n"), 1000.0).orderBy("n").collect()
    assert [r.equity for r in got] == [1100, 1040, 1020, 1030]
    assert [r.drawdown for r in got] == pytest.approx([0, 60 / 11, 20 / 10.4, 0]) and [r.weekly_drawdown for r in got] == pytest.approx([0, 60 / 11, 80 / 11, 0])
    held = spark.createDataFrame([(1, 100.0, 90.0, 1.0, 1, 80.0), (2, 100.0, None, 1.0, -1, 120.0), (3, 100.0, 110.0, 2.0, -1, 120.0)], "position_id int, entry double, last double, quantity double, side int, stop double")
    act = lambda a: [(r.close, r.stop) for r in K.breaker_action(held, a).orderBy("position_id").collect()]
    assert act("block_only") == [(False, 80), (False, 120), (False, 120)] and [c for c, _ in act("close_all")] == [True] * 3
    assert act("close_worst") == [(False, 80), (False, 120), (True, 120)] and act("tighten_stops") == [(False, 88.2), (False, 102), (False, 112.2)]
    assert K.breaker_action(held.limit(0), "close_worst").count() == 0


def test_segments_of_a_series_are_the_series(spark):
    rng, close = random.Random(12), {"a": [100.0], "b": [5.0]}
    for name in close:
        for _ in range(9000 if name == "a" else 50):
            close[name].append(close[name][-1] * (1 + rng.gauss(0, 0.01)))
    rows = bars(spark, close["a"], "a").unionByName(bars(spark, close["b"], "b"))
    configs = {"rsi": {"period": 14}, "macd": {}, "bollinger": {"period": 20}, "adx": {"period": 14}, "atr": {}, "stoch": {}, "cci": {}, "obv": {}, "ema": {"periods": [10, 30]}}
    key = lambda r: (r.symbol, r.bar_start)
    want = sorted(I.with_indicators(rows, configs).collect(), key=key)
    got = sorted(I.with_indicators(rows, configs, segment=3200).select(*want[0].asDict()).collect(), key=key)
    assert len(got) == len(want) == 9052
    for a, b in zip(got, want, strict=True):
        assert [x is None for x in a] == [x is None for x in b]
        assert [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)], rel=1e-9, abs=1e-9)
    with pytest.raises(ValueError, match="rows or more"):
        I.with_indicators(rows, configs, segment=100)
