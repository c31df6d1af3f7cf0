"""Guards of a stream equal folds over all rows in time order, for shuffled arrivals, over several days and across restarts."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import risk as K
from tickloom.schema import RiskParams
from tickloom.streaming import guards as G

T = dt.datetime(2024, 1, 5, 20, tzinfo=dt.timezone.utc)  # a Friday evening
LATE = "2 hours"


@pytest.fixture()
def state(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def arrivals(rows, rng, most=5000):
    """Rows in an order in which none comes more than `most` seconds late, by event time, and in files."""
    rows = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, most))
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]


def run(spark, make, files, schema, tmp_path, end):
    """What the stream gives, stopped and started again between files, with a last row that lets all time pass."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for group in [*files, [end]]:
        spark.createDataFrame(group, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        query = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(600)
    return [r for r in spark.read.parquet(out).collect() if r[0] != "end"]


def folded(guard, rows, until):
    """The guard's rule over all rows at once: (key, time, ...) from rows of (key, ts, seq, values)."""
    out, micros = [], lambda t: round(t.timestamp() * 1_000_000)
    for key in sorted({r[0] for r in rows if r[0] is not None}):
        own = sorted((micros(r[1]), -1 if r[2] is None else r[2], json.dumps(r[3])) for r in rows if r[0] == key and r[1] is not None)
        out += [(key, dt.datetime.fromtimestamp(o[0] / 1e6, dt.timezone.utc), *o[1:]) for o in G.fold(guard, guard.start(), own, micros(until))]
    return sorted(out, key=str)


def seen(rows):
    return sorted([(r[0], r[1].replace(tzinfo=dt.timezone.utc), *r[2:]) for r in rows], key=str)


def test_emergencies_by_symbol(state, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), T + dt.timedelta(seconds=rng.randint(0, 9000)), i, "x") for i in range(300)] + [("a", T, None, "null"), ("a", T, None, None)]
    end = ("end", T + dt.timedelta(days=9), 0, "end")
    schema = "symbol string, ts timestamp, seq long, reason string"
    odd = [(None, T, 1, "no key"), ("a", None, 1, "no time")]
    got = run(state, lambda s: G.emergencies(s, late=LATE), [[*g, *odd] for g in arrivals(rows, rng)], schema, tmp_path, end)
    last, want = {}, []
    for symbol, t, i, reason in sorted(rows, key=lambda r: (r[1], -1 if r[2] is None else r[2], str(r[3] is not None), str(r[3]))):
        if symbol not in last or (t - last[symbol]).total_seconds() >= 300:
            last[symbol] = t
            want.append((symbol, t))
    assert sorted(r[:2] for r in seen(got)) == sorted(want) and len(want) > 50


def account(rows, p, balance):
    """Trips and resets by plain bookkeeping, written apart from the guard."""
    out = []
    for key in {r[0] for r in rows}:
        equity, losses, tripped, day, peaks, today = balance, 0, False, None, {}, 0.0
        events = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for _, t, _, kind, pnl in events:
            if day is not None and kind != "release" and t.date() > day:
                out.append((key, dt.datetime.combine(day + dt.timedelta(1), dt.time(), dt.timezone.utc), "daily reset", round(equity, 2)))
                if (day + dt.timedelta(1)).weekday() == 0:
                    out.append((*out[-1][:2], "weekly reset", round(equity, 2)))
            if kind == "release":
                tripped, losses = False, 0
                continue
            if t.date() != day:
                if day is None or t.isocalendar()[:2] != day.isocalendar()[:2]:
                    peaks["week"] = equity
                day, today, peaks["day"] = t.date(), 0.0, equity
            equity, today, losses = round(equity + round(pnl, 2), 2), round(today + round(pnl, 2), 2), losses + 1 if round(pnl, 2) < 0 else 0
            peaks = {k: max(v, equity) for k, v in peaks.items()}
            fall = {k: (v - equity) / v * 100 for k, v in peaks.items()}
            reason = next((n for n, hit in (("drawdown", fall["day"] > p.max_daily_drawdown), ("weekly drawdown", fall["week"] > p.max_weekly_drawdown), ("daily loss", today <= -p.max_daily_loss), ("consecutive losses", losses >= p.max_consecutive_losses)) if hit), None)
            if reason and not tripped:
                tripped = True
                out.append((key, t, f"trip: {reason}", equity))
        out.append((key, dt.datetime.combine(day + dt.timedelta(1), dt.time(), dt.timezone.utc), "daily reset", round(equity, 2)))
        if (day + dt.timedelta(1)).weekday() == 0:
            out.append((*out[-1][:2], "weekly reset", round(equity, 2)))
    return sorted(out, key=str)


def test_breaker_over_days_and_weeks(state, tmp_path):
    """Equal to the account kept by hand, and, without releases, to the batch breaker's first trip."""
    rng, p = random.Random(7), RiskParams(max_daily_drawdown=4, max_weekly_drawdown=6, max_daily_loss=420, max_consecutive_losses=6)
    rows = [(rng.choice("abcd"), T + dt.timedelta(seconds=rng.randint(0, 12 * 86400), microseconds=rng.randint(0, 999_999)), i, "trade", rng.uniform(-130, 110)) for i in range(900)]
    rows += [(k, dt.datetime(2024, 1, 8, tzinfo=dt.timezone.utc), 1000, "trade", -50.0) for k in "ab"]  # a row at a Monday's very begin
    releases = [(k, T + dt.timedelta(days=d, hours=3), 2000 + d, "release", None) for k in "ab" for d in (2, 5, 8)]
    schema, end = "account string, ts timestamp, seq long, kind string, pnl double", ("end", T + dt.timedelta(days=40), 0, "trade", 0.0)
    got = run(state, lambda s: G.breaker_events(s, p, 10_000.0, LATE), arrivals(rows + releases, rng), schema, tmp_path, end)
    got = [(a, t, e, round(q, 2)) for a, t, e, q in seen(got)]
    assert got == account(rows + releases, p, 10_000.0)
    assert len({e for _, _, e, _ in got}) >= 4
    trades = state.createDataFrame([(a, t.replace(tzinfo=None), i, pnl) for a, t, i, _, pnl in rows], "account string, closed_at timestamp_ntz, seq long, pnl double")
    by, order = ("account",), ("closed_at", "seq")
    batch = K.breaker(K.drawdowns(K.daily_pnl(K.streaks(trades, by, order), by, order), by, order, 10_000.0), p, by, order)
    first = batch.where("tripped").groupBy("account").agg(F.min("closed_at"), F.max("trip_reason")).collect()
    alone = folded(G.BreakerGuard(p, 10_000.0), [(a, t, i, {"kind": k, "pnl": x}) for a, t, i, k, x in rows], end[1])
    assert sorted((a, t.replace(tzinfo=None), e) for a, t, e, _ in alone if e.startswith("trip")) == sorted((a, t, f"trip: {e}") for a, t, e in first)


def test_sweeps_close_what_the_price_has_reached(state, tmp_path):
    rng, rows, i = random.Random(3), [], 0
    at = lambda: T + dt.timedelta(seconds=rng.uniform(0, 8000))
    for symbol in "ab":
        for _ in range(250):
            i += 1
            rows.append((symbol, at(), i, "price", None, None, None, None, 100 + rng.uniform(-8, 8)))
        for k in range(40):
            i, side, t = i + 1, rng.choice((1, -1)), at()
            rows.append((symbol, t, i, "open", f"{symbol}{k}", side, 100.0, rng.choice((None, 100 - side * rng.uniform(1, 9))), None))
            if rng.random() < 0.3:
                i += 1
                rows.append((symbol, t + dt.timedelta(seconds=rng.uniform(0, 60)), i, "close", f"{symbol}{k}", None, None, None, None))
    rows += [("a", T, None, "open", None, 1, 1.0, 1.0, 1.0), ("a", T, None, "open", "zero", None, 0.0, None, None), ("b", T, None, None, None, None, None, None, None), ("a", T, None, "price", None, None, None, None, None)]
    schema, end = "symbol string, ts timestamp, seq long, kind string, position_id string, side int, entry double, stop double, price double", ("end", T + dt.timedelta(hours=9), 0, "price", None, None, None, None, 1.0)
    got = seen(run(state, lambda s: G.sweeps(s, 15, late=LATE), arrivals(rows, rng), schema, tmp_path, end))
    want, limit = [], RiskParams().emergency_pct
    for symbol in "ab":  # every 15 seconds, over all rows that came before
        own, held, price, k = sorted((r for r in rows if r[0] == symbol), key=lambda r: (r[1], r[2] or -1)), {}, None, 0
        t = T
        while t < end[1]:
            while k < len(own) and own[k][1] < t:
                _, _, _, kind, pid, side, entry, stop, value = own[k]
                if kind == "open" and pid and entry:
                    held[pid] = (side, entry, stop)
                elif kind == "close":
                    held.pop(pid, None)
                elif kind == "price" and value is not None:
                    price = value
                k += 1
            for pid, (side, entry, stop) in [*held.items()]:
                hit = stop is not None and (price - stop) * side <= 0 if price else False
                if price and (hit or (price / entry - 1) * 100 * side <= limit):
                    want.append((symbol, t, pid, price, "stop" if hit else "emergency"))
                    del held[pid]
            t += dt.timedelta(seconds=15)
    assert got == sorted(want, key=str) and {w[4] for w in want} == {"stop", "emergency"}


def test_no_symbol_is_held_twice(state, tmp_path):
    """Random signals, confirmations that come in time, late or never, partial updates and closes, of two accounts."""
    rng, rows, i, fields = random.Random(9), [], 0, ("symbol", "kind", "side", "quantity", "entry", "stop", "closed")
    for _ in range(260):
        account, symbol, t = rng.choice(("x", "y")), rng.choice("abcd"), T + dt.timedelta(seconds=rng.uniform(0, 9000))
        i += 1
        rows.append((account, t, i, symbol, "signal", None, None, None, None, None))
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            i += 1
            t += dt.timedelta(seconds=rng.choice((1, 20, 59.9, 60, 61, 300)))
            rows.append((account, t, i, symbol, "update", rng.choice((1, -1, None)), rng.choice((None, 2.0, 5.0)), rng.choice((None, 100.0)), rng.choice((None, 97.5)), rng.random() < 0.4 or None))
    rows += [("x", T, None, None, "signal", None, None, None, None, None), ("x", T, None, "a", None, None, None, None, None, None)]
    schema, end = "account string, ts timestamp, seq long, symbol string, kind string, side int, quantity double, entry double, stop double, closed boolean", ("end", T + dt.timedelta(days=1), 0, "a", "signal", None, None, None, None, None)
    got = seen(run(state, lambda s: G.reservations(s, 60, RiskParams(max_open_trades=3), LATE), arrivals(rows, rng), schema, tmp_path, end))
    plain = [(r[0], r[1], r[2], dict(zip(fields, r[3:], strict=True))) for r in rows]
    assert got == folded(G.ReservationGuard(60, 3), plain, end[1])
    assert {e for *_, e, _, _ in got} == {"claimed", "rejected", "expired", "held", "closed"} and any(r == "late" for *_, r, _ in got)
    for account in "xy":  # what was answered, replayed: at most one claim or position of a symbol at a time, at most 3 open
        claimed, held = {}, {}
        events = sorted(((t, n, s, e, r, p) for n, (a, t, s, e, r, p) in enumerate(got) if a == account), key=lambda x: (x[0], x[3] != "expired"))
        for t, _, symbol, event, reason, position in events:
            if event == "claimed":
                assert symbol not in claimed and symbol not in held and len(held) < 3
                claimed[symbol] = t
            elif event == "expired":
                assert (t - claimed.pop(symbol)).total_seconds() == 60
            elif event == "held":
                assert (reason == "late") == (symbol not in claimed and symbol not in held)
                claimed.pop(symbol, None)
                now = json.loads(position)
                assert held.get(symbol, {}).keys() <= now.keys()
                held[symbol] = now
            elif event == "closed":
                assert (claimed.pop(symbol, None) is not None and position is None) if reason else json.loads(position) == held.pop(symbol)
            elif event == "rejected":
                assert reason in ("position open", "claimed", "open trades")


def test_late_rows_are_dropped(state, tmp_path):
    """A row that comes later than the delay isn't folded; what came in time isn't changed by it."""
    files = [[("a", T, 1, "first")], [("a", T + dt.timedelta(hours=3), 2, "second")], [("a", T + dt.timedelta(hours=4), 3, "third")], [("a", T + dt.timedelta(minutes=30), 4, "late")]]
    got = run(state, lambda s: G.emergencies(s, late="10 minutes"), files, "symbol string, ts timestamp, seq long, reason string", tmp_path, ("end", T + dt.timedelta(days=1), 0, "end"))
    assert sorted(r[2] for r in got) == ["first", "second", "third"]
