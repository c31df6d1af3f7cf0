"""Guards of an account on live data, in the order of event time: cooldowns, the circuit breaker with its daily and weekly
resets, and the sweep over open positions.

Rows may come in any order within the watermark's delay. They wait in state until the watermark has passed their time,
and are then folded in the order of (ts, seq), together with the guard's own timers; at equal times a timer goes first. So
the result doesn't depend on the order of arrival, on micro-batches or on restarts. Rows that come later than the delay are
dropped, as in all windows with a watermark; rows without a key or time are left out. Days and weeks are those of UTC.

Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import RiskParams

SECOND = 1_000_000
DAY = 86_400 * SECOND
#: Days from a Monday to the first day of the epoch, a Thursday.
TO_MONDAY = 3


class Guard:
    """A fold over rows in time order, with a state of plain values and one timer of its own, state["next"] in microseconds."""

    def start(self) -> dict:
        return {}

    def row(self, state: dict, at: int, row: dict) -> Iterable[tuple]:
        """Outputs (microseconds, ...) of a row."""
        return ()

    def timer(self, state: dict, at: int) -> Iterable[tuple]:
        """Outputs of the timer, which is over and may be set anew."""
        return ()


def fold(guard: Guard, state: dict, rows: list[tuple[int, int, str]], until: int) -> Iterator[tuple]:
    """Outputs of sorted rows (microseconds, seq, JSON), all up to `until`, and of the timers up to it."""
    waiting = iter([*rows, None])
    row = next(waiting)
    while row is not None or state.get("next") is not None:
        due = state.get("next")
        if due is not None and due <= (until if row is None else min(row[0], until)):
            state["next"] = None
            yield from guard.timer(state, due)
        elif row is None:
            return
        else:
            yield from guard.row(state, row[0], json.loads(row[2]))
            row = next(waiting)


class _Ordered(StatefulProcessor):
    """Runs a guard. `grain`: microseconds to which the timers that wake it up for rows are rounded up."""

    def __init__(self, guard: Guard, output: list[str], grain: int):
        self.guard, self.output, self.grain = guard, output, grain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, seq bigint, row string")
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for frame in rows for r in zip(frame["us"].tolist(), frame["seq"].tolist(), frame["row"].tolist(), strict=True)]
        self.waiting.appendList([(int(us), int(seq), row) for us, seq, row in new])
        for us in {-(-int(us) // self.grain) * self.grain for us, _, _ in new}:
            self.handle.registerTimer(-(-us // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = [(int(r[0]), int(r[1]), r[2]) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted(r for r in held if r[0] <= until)
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.guard.start()
        out = [*fold(self.guard, state, ready, until)]
        if ready:
            left = [r for r in held if r[0] > until]
            self.waiting.put(left) if left else self.waiting.clear()
        self.state.update((json.dumps(state),))
        if state.get("next") is not None:
            self.handle.registerTimer(-(-state["next"] // 1000))
        yield pd.DataFrame([(*key, *o) for o in out], columns=self.output)

    def close(self) -> None:
        pass


def guarded(rows: DataFrame, key: str, columns: list[str], guard: Guard, output: str, late: str = "10 minutes", grain: int = SECOND) -> DataFrame:
    """(key, ts, ...) that `guard` gives for a stream of (key, ts, seq, columns); `output` is the DDL of what follows ts.

    Rows of the same ts go by seq (a null one first) and then by their values; repeated rows count each.
    """
    own = rows.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    row = F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    own = own.select(F.col(key).cast("string").alias(key), "ts", F.unix_micros("ts").alias("us"), F.coalesce(F.col("seq").cast("long"), F.lit(-1).cast("long")).alias("seq"), row.alias("row"))
    names = [c.strip().split(" ")[0] for c in output.split(",")]
    made = own.groupBy(key).transformWithStateInPandas(_Ordered(guard, [key, "us", *names], grain), f"{key} string, us bigint, {output}", outputMode="Append", timeMode="EventTime")
    return made.select(key, F.timestamp_micros("us").alias("ts"), *names)


# --- cooldowns ----------------------------------------------------------------------------------------------


class CooldownGuard(Guard):
    """The first row fires, and later ones if `seconds` (or their own cooldown) have passed since the last that fired."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def row(self, state, at, row):
        own = row.get("cooldown_seconds")
        if state.get("last") is None or at - state["last"] >= (self.seconds if own is None else own) * SECOND:
            state["last"] = at
            yield (at, row["reason"])


def emergencies(anomalies: DataFrame, seconds: float = 300, late: str = "10 minutes") -> DataFrame:
    """(symbol, ts, reason) of the anomalies (symbol, ts, seq, reason) that fire: one in five minutes for each symbol."""
    return guarded(anomalies, "symbol", ["reason"], CooldownGuard(seconds), "reason string", late)


def throttled(alerts: DataFrame, key: str = "source", seconds: float = 300, late: str = "10 minutes") -> DataFrame:
    """(key, ts, reason) of the alerts (key, ts, seq, reason, cooldown_seconds) that are passed on; a null cooldown is `seconds`."""
    return guarded(alerts, key, ["reason", "cooldown_seconds"], CooldownGuard(seconds), "reason string", late)


# --- circuit breaker ----------------------------------------------------------------------------------------


class BreakerGuard(Guard):
    """The rules of `risk.drawdowns` and `risk.breaker`: equity is the balance and all results so far, each to 2 decimals; the
    peaks of a day and a week begin with the equity that they start from; the first broken limit trips it until it is
    released. At the end of a day, and of a week, with results a reset is reported."""

    def __init__(self, params: RiskParams, balance: float):
        self.p, self.balance = params, balance

    def start(self):
        return {"cents": 0, "day": None, "losses": 0, "tripped": ""}

    def _equity(self, state) -> float:
        return self.balance + state["cents"] / 100

    def _enter(self, state, at) -> None:
        day = at // DAY
        if state["day"] != day:
            week = (day + TO_MONDAY) // 7
            if state["day"] is None or (state["day"] + TO_MONDAY) // 7 != week:
                state["week_peak"] = self._equity(state)
            state |= {"day": day, "day_peak": self._equity(state), "day_cents": 0, "next": (day + 1) * DAY}

    def row(self, state, at, row):
        if row["kind"] == "release":
            state |= {"tripped": "", "losses": 0}
            return
        self._enter(state, at)
        cents = round(round(row["pnl"] or 0.0, 2) * 100)
        state["cents"] += cents
        state["day_cents"] += cents
        state["losses"] = state["losses"] + 1 if cents < 0 else 0
        equity = self._equity(state)
        for peak in ("day_peak", "week_peak"):
            state[peak] = max(state[peak], equity)
        below = lambda peak: (peak - equity) / peak * 100 if peak > 0 else 0.0
        reason = (
            "drawdown" if below(state["day_peak"]) > self.p.max_daily_drawdown
            else "weekly drawdown" if below(state["week_peak"]) > self.p.max_weekly_drawdown
            else "daily loss" if state["day_cents"] / 100 <= -self.p.max_daily_loss
            else "consecutive losses" if state["losses"] >= self.p.max_consecutive_losses else ""
        )
        if reason and not state["tripped"]:
            state["tripped"] = reason
            yield (at, f"trip: {reason}", equity)

    def timer(self, state, at):
        yield (at, "daily reset", self._equity(state))
        if (at // DAY + TO_MONDAY) % 7 == 0:
            yield (at, "weekly reset", self._equity(state))


def breaker_events(results: DataFrame, params: RiskParams | None = None, balance: float = 10_000.0, late: str = "10 minutes") -> DataFrame:
    """(account, ts, event, equity) of a stream of (account, ts, seq, kind, pnl): trips, daily and weekly resets.

    A row's kind is "release", which ends a trip and the count of losses, or anything else for a closed trade; a null pnl is 0.
    """
    return guarded(results, "account", ["kind", "pnl"], BreakerGuard(params or RiskParams(), balance), "event string, equity double", late)


# --- sweep over open positions ------------------------------------------------------------------------------


class SweepGuard(Guard):
    """Every `every` seconds, while a symbol has open positions, each is closed whose stop the last price has reached, or whose
    loss in per cent is `emergency_pct` or worse. Times of sweeps are multiples of `every`."""

    def __init__(self, every: int, emergency_pct: float):
        self.every, self.emergency = every * SECOND, emergency_pct

    def start(self):
        return {"price": None, "open": {}}

    def row(self, state, at, row):
        if row["kind"] == "open" and row["position_id"] is not None and row["entry"]:
            state["open"][str(row["position_id"])] = [row["side"] or 1, row["entry"], row["stop"]]
            if state.get("next") is None:
                state["next"] = (at // self.every + 1) * self.every
        elif row["kind"] == "close":
            state["open"].pop(str(row["position_id"]), None)
        elif row["kind"] == "price" and row["price"] is not None:
            state["price"] = row["price"]
        return ()

    def timer(self, state, at):
        price = state["price"]
        for position, (side, entry, stop) in sorted(state["open"].items()):
            if price is None:
                break
            hit = stop is not None and (price - stop) * side <= 0
            if hit or (price - entry) / entry * 100 * side <= self.emergency:
                del state["open"][position]
                yield (at, position, price, "stop" if hit else "emergency")
        state["next"] = at + self.every if state["open"] else None


def sweeps(events: DataFrame, every: int = 15, params: RiskParams | None = None, late: str = "10 minutes") -> DataFrame:
    """(symbol, ts, position_id, price, reason) of positions that a sweep closes, from a stream of (symbol, ts, seq, kind,
    position_id, side, entry, stop, price) with the kinds open, close and price; other kinds are passed over."""
    p = params or RiskParams()
    return guarded(events, "symbol", ["kind", "position_id", "side", "entry", "stop", "price"], SweepGuard(every, p.emergency_pct), "position_id string, price double, reason string", late, every * SECOND)


# --- reservation of symbols ---------------------------------------------------------------------------------


class ReservationGuard(Guard):
    """Who may hold a symbol in an account. A signal claims its symbol, if nothing is open or claimed there and fewer than
    `most` positions are open; the claim ends with the next update of the position, or after `seconds`. Updates are merged
    into what is known of the position, fields that they leave out (or give as null) staying as they are; one that says
    closed ends it. An update of a symbol that was never claimed, or whose claim has ended, opens it: the account has it.
    """

    def __init__(self, seconds: float, most: int):
        self.wait, self.most = round(seconds * SECOND), most

    def start(self):
        return {"claimed": {}, "open": {}}

    def _set(self, state) -> None:
        state["next"] = min(state["claimed"].values(), default=None)

    def row(self, state, at, row):
        symbol = row["symbol"]
        if symbol is None:
            return
        if row["kind"] == "signal":
            reason = (
                "position open" if symbol in state["open"] else "claimed" if symbol in state["claimed"]
                else "open trades" if len(state["open"]) >= self.most else None
            )
            if reason is None:
                state["claimed"][symbol] = at + self.wait
            yield (at, symbol, "rejected" if reason else "claimed", reason, None)
        elif row["kind"] == "update":
            late = symbol not in state["claimed"] and symbol not in state["open"]
            claim = state["claimed"].pop(symbol, None)
            if row["closed"]:
                held = state["open"].pop(symbol, None)
                if held is not None:
                    yield (at, symbol, "closed", None, json.dumps(held, sort_keys=True))
                elif claim is not None:
                    yield (at, symbol, "closed", "never open", None)
            else:
                new = {k: row[k] for k in ("side", "quantity", "entry", "stop") if row[k] is not None}
                state["open"][symbol] = state["open"].get(symbol, {}) | new
                yield (at, symbol, "held", "late" if late else None, json.dumps(state["open"][symbol], sort_keys=True))
        self._set(state)

    def timer(self, state, at):
        for symbol in sorted(s for s, until in state["claimed"].items() if until <= at):
            del state["claimed"][symbol]
            yield (at, symbol, "expired", None, None)
        self._set(state)


def reservations(events: DataFrame, seconds: float = 60, params: RiskParams | None = None, late: str = "10 minutes") -> DataFrame:
    """(account, ts, symbol, event, reason, position) of a stream of (account, ts, seq, symbol, kind, side, quantity, entry, stop,
    closed): what each signal was answered, what each update made of the position (JSON), and claims that expired."""
    p = params or RiskParams()
    columns = ["symbol", "kind", "side", "quantity", "entry", "stop", "closed"]
    return guarded(events, "account", columns, ReservationGuard(seconds, p.max_open_trades), "symbol string, event string, reason string, position string", late)
