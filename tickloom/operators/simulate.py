"""Trade simulation: a fold over time for each run, runs side by side.

A run (a set of strategies that share one balance) is a group; its bars and signals come as one time-ordered table.
At each time, positions are looked at in the order of their opening: stop, take profits, trailing stop, holding time,
indicator exit, partial reduction; then entries in the order of (strategy, symbol, interval). Positions left at the end
are closed. A strategy's own stop, trailing stop, holding time and choice of exits go before the run's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import EQUITY, TRADES, CostParams, RiskParams, Strategy

#: A position is reduced so often at most, and closed where less than this would be left.
MOST_REDUCTIONS, LEAST_REST = 4, 10.0
#: Both results in one schema: a row is a trade or a point of the equity curve.
OUT = "kind string, " + TRADES + ", ts timestamp_ntz, equity double, balance double, invested double"


@dataclass
class Position:
    strategy: str
    symbol: str
    tf: str
    side: int
    quantity: float
    entry: float
    amount: float
    stop: float
    targets: list[tuple[float, float]]
    best: float
    opened: Any
    last: float
    reduced: int = 0


class Fold:
    """The state of one run."""

    def __init__(self, run: str, balance: float, risk: RiskParams, costs: CostParams, max_positions: int, trailing_pct: float, max_hold_hours: float | None, strategies: Mapping[str, Strategy] | None = None):
        self.run, self.balance, self.risk, self.costs = run, balance, risk, costs
        self.max_positions, self.trailing, self.max_hold = max_positions, trailing_pct, max_hold_hours
        self.strategies, self.plain = strategies or {}, Strategy("")
        self.open: dict[tuple[str, str], Position] = {}
        self.trades: list[dict] = []
        self.curve: list[dict] = []

    def _own(self, strategy: str, name: str, default: float | None) -> float | None:
        """A strategy's own parameter, or the run's."""
        value = getattr(self.strategies.get(strategy, self.plain), name)
        return default if value is None else value

    def _cost(self, p: Position, price: float) -> float:
        if not self.costs.enabled:
            return 0.0
        spread = self.costs.spread_pct.get(p.symbol, self.costs.default_spread_pct)
        return (p.entry + price) * p.quantity * (self.costs.taker_fee_pct / 100 + spread / 200)

    def close(self, key: tuple[str, str], price: float, ts: Any, reason: str) -> None:
        self._settle(self.open.pop(key), price, ts, reason)

    def _settle(self, p: Position, price: float, ts: Any, reason: str) -> None:
        cost = self._cost(p, price)
        pnl = (price - p.entry) * p.quantity * p.side - cost
        self.balance += p.amount + pnl
        self.trades.append({
            "run_id": self.run, "strategy": p.strategy, "symbol": p.symbol, "side": p.side, "entry_price": p.entry, "exit_price": price,
            "quantity": p.quantity, "amount": p.amount, "cost": cost, "pnl": pnl, "pnl_pct": pnl / p.amount * 100 if p.amount else 0.0,
            "exit_reason": reason, "opened_at": p.opened, "closed_at": ts,
        })

    def reduce(self, key: tuple[str, str], price: float, ts: Any, pct: float) -> None:
        """Sell a share of a position, with its share of the cost basis; all of it if too little would be left."""
        p = self.open[key]
        if p.reduced >= MOST_REDUCTIONS or pct <= 0:
            return
        share = min(pct, 100.0) / 100
        if p.amount * (1 - share) < LEAST_REST:
            self.close(key, price, ts, "reduce")
            return
        self._settle(replace(p, quantity=p.quantity * share, amount=p.amount * share), price, ts, "reduce")
        p.quantity, p.amount, p.reduced = p.quantity * (1 - share), p.amount * (1 - share), p.reduced + 1

    def exits(self, ts: Any, rows: dict[tuple[str, str, str], dict]) -> None:
        for key, p in [*self.open.items()]:
            row = rows.get((p.strategy, p.symbol, p.tf))
            if row is None:
                continue
            price = p.last = row["close"]
            ahead = lambda level, p=p, price=price: (price - level) * p.side
            if ahead(p.stop) <= 0:
                self.close(key, p.stop, ts, "stop_loss")
                continue
            hit = next(((level, pct) for level, pct in p.targets if ahead(level) >= 0), None)
            if hit:
                self.close(key, hit[0], ts, f"tp_{int(hit[1])}pct")
                continue
            p.best = max(p.best, price) if p.side == 1 else min(p.best, price)
            if trailing := self._own(p.strategy, "trailing_pct", self.trailing):
                p.stop = p.best * (1 - p.side * trailing / 100)
            side, hold = "long" if p.side == 1 else "short", self._own(p.strategy, "max_hold_hours", self.max_hold)
            if hold and (ts - p.opened).total_seconds() / 3600 >= hold:
                self.close(key, price, ts, "max_hold")
            elif row[f"exit_{side}"] and self._own(p.strategy, "use_indicator_exits", True):
                self.close(key, price, ts, "indicator")
            elif pct := row.get(f"reduce_{side}"):
                self.reduce(key, price, ts, pct)

    def entries(self, ts: Any, rows: dict[tuple[str, str, str], dict]) -> None:
        r = self.risk
        for (strategy, symbol, tf), row in rows.items():
            side, price, key = row["side"], row["close"], (strategy, symbol)
            if not side or key in self.open:
                continue
            if len(self.open) >= self.max_positions:
                break
            if not price or price <= 0:
                continue
            risk = min(self.balance * r.satellite_share * max(r.position_pct, r.min_position_pct) / 100, self.balance * r.max_position_pct / 100)
            quantity = min(risk / price, self.balance * 0.01 / (price * 0.02))
            amount = quantity * price
            if quantity <= 0 or amount > self.balance * 0.95:
                continue
            self.balance -= amount
            stop = price * (1 - side * max(self._own(strategy, "stop_pct", r.stop_pct), r.min_stop_pct) / 100)
            targets = [(price * (1 + side * x / 100), x) for x in r.take_profit_pct]
            self.open[key] = Position(strategy, symbol, tf, side, quantity, price, amount, stop, targets, price, ts, price)

    def step(self, ts: Any, rows: dict[tuple[str, str, str], dict]) -> None:
        self.exits(ts, rows)
        self.entries(ts, rows)
        invested = sum(p.amount for p in self.open.values())
        self.curve.append({"run_id": self.run, "ts": ts, "equity": round(self.balance + invested, 2), "balance": round(self.balance, 2), "invested": round(invested, 2)})

    def finish(self, ts: Any) -> None:
        for key, p in [*self.open.items()]:
            self.close(key, p.last, ts, "end_of_backtest")


def run_fold(rows: list[dict], fold: Fold) -> Fold:
    """rows: signal rows of one run, by time, then strategy, symbol and interval."""
    i, ts = 0, None
    while i < len(rows):
        ts, now = rows[i]["ts"], {}
        while i < len(rows) and rows[i]["ts"] == ts:
            now[rows[i]["strategy"], rows[i]["symbol"], rows[i]["tf"]] = rows[i]
            i += 1
        fold.step(ts, now)
    if ts is not None:
        fold.finish(ts)
    return fold


def simulate(signals: DataFrame, balance: float = 10_000.0, risk: RiskParams | None = None, costs: CostParams | None = None, max_positions: int = 8, trailing_pct: float = 1.5, max_hold_hours: float | None = None, strategies: Sequence[Strategy] = ()) -> DataFrame:
    """Trades and equity of all runs; see `trades` and `equity`.

    signals: (run_id, strategy, symbol, tf, ts, side, exit_long, exit_short, close), and reduce_long and reduce_short if
    there are any. `strategies` give their own risk parameters, by name; 0 switches a trailing stop or a holding time
    off. A run must fit an executor.
    """
    risk, costs = risk or RiskParams(), costs or CostParams()
    schema = signals.sparkSession.createDataFrame([], OUT).schema
    arrow = to_arrow_schema(schema)
    order, own = [(c, "ascending") for c in ("ts", "strategy", "symbol", "tf")], {s.name: s for s in strategies}

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fold = run_fold(table.sort_by(order).to_pylist(), Fold(key[0].as_py(), balance, risk, costs, max_positions, trailing_pct, max_hold_hours, own))
        rows = [{"kind": "trade"} | t for t in fold.trades] + [{"kind": "equity"} | e for e in fold.curve]
        return pa.Table.from_pylist(rows, schema=arrow)

    columns = ["run_id", "strategy", "symbol", "tf", "ts", "side", "exit_long", "exit_short", "close", *[c for c in ("reduce_long", "reduce_short") if c in signals.columns]]
    return signals.select(columns).groupBy("run_id").applyInArrow(run, schema)


def trades(result: DataFrame) -> DataFrame:
    return result.where(F.col("kind") == "trade").select(*[c.split()[0] for c in TRADES.split(", ")])


def equity(result: DataFrame) -> DataFrame:
    return result.where(F.col("kind") == "equity").select(*[c.split()[0] for c in EQUITY.split(", ")])
