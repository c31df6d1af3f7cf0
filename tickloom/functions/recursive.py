"""Recursive smoothing, for what window frames can't express.

All recursions that a plan needs on a series are computed together. Those that are averages (with a program) go in
segments of a week, so that a series is dealt out to many tasks (`segments`); others take a series in one pass, which must
fit an executor. Missing values come in and go out as null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .segments import Program, Smooth, path, with_programs


def smooth(x: np.ndarray, n: int, alpha: float, start: int = 0) -> np.ndarray:
    """The mean of x[start : start + n] at its last row, then e + alpha * (x - e); NaN before."""
    out = np.full(len(x), np.nan)
    at = start + n - 1
    if len(x) <= at or n < 1:
        return out
    out[at] = x[start : at + 1].sum() / n
    out[at + 1 :] = path(x[at + 1 :], alpha, out[at])
    return out


def ema(x: np.ndarray, n: int, start: int = 0) -> np.ndarray:
    return smooth(x, n, 2 / (n + 1), start)


def wilder(x: np.ndarray, n: int, start: int = 0) -> np.ndarray:
    return smooth(x, n, 1 / n, start)


def ewm(x: np.ndarray, span: float) -> np.ndarray:
    """Seeded with the first value, alpha = 2 / (span + 1)."""
    return smooth(x, 1, 2 / (span + 1))


def decayed(x: np.ndarray, alpha: float) -> np.ndarray:
    """Starts at 0 before the first value; a missing value changes nothing."""
    there = ~np.isnan(x)
    values = np.append(0.0, path(x[there], alpha, 0.0))
    return values[np.cumsum(there)]


def differences(x: np.ndarray) -> np.ndarray:
    return np.append(np.nan, np.diff(x)) if len(x) else x


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    d = differences(close)
    up, down = wilder(np.maximum(d, 0), n, 1), wilder(np.maximum(-d, 0), n, 1)
    total = up + down
    return np.where(total == 0, 0.0, 100 * up / np.where(total == 0, 1, total))


def macd(close: np.ndarray, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, signal and histogram; both averages begin at the slow one's first row."""
    line = ema(close, fast, slow - fast) - ema(close, slow)
    line[: slow - 1] = np.nan
    mean = ema(line, signal, slow - 1)
    return line, mean, line - mean


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.append(np.nan, close[:-1]) if len(close) else close
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    return wilder(true_range(high, low, close), n, 1)


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    up, down = differences(high), -differences(low)
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    tr, p, m = (wilder(x, n, 1) for x in (true_range(high, low, close), plus, minus))
    with np.errstate(invalid="ignore", divide="ignore"):
        p, m = p / tr, m / tr
        dx = np.where(p + m == 0, 0.0, 100 * np.abs(p - m) / (p + m))
    return wilder(dx, n, n)


# --- the same as programs: what is averaged, and how ---------------------------------------------------------


def _stepped(columns: dict[str, np.ndarray], before: dict[str, float], name: str) -> np.ndarray:
    """A column one row earlier."""
    x = columns[name]
    return np.append(before[name], x[:-1]) if len(x) else x


def _ranges(columns: dict[str, np.ndarray], before: dict[str, float]) -> np.ndarray:
    high, low, close = columns["high"], columns["low"], _stepped(columns, before, "close")
    return np.maximum(high - low, np.maximum(np.abs(high - close), np.abs(low - close)))


def ema_program(source: str, n: int) -> Program:
    return Program(lambda c, b: [c[source]], (Smooth(n, 2 / (n + 1)),), lambda a, s, place: [a[0]])


def ewm_program(source: str, span: float) -> Program:
    return Program(lambda c, b: [c[source]], (Smooth(1, 2 / (span + 1)),), lambda a, s, place: [a[0]])


def rsi_program(source: str, n: int) -> Program:
    def first(c, b):
        d = c[source] - _stepped(c, b, source)
        return [np.maximum(d, 0), np.maximum(-d, 0)]

    def result(a, s, place):
        total = a[0] + a[1]
        return [np.where(total == 0, 0.0, 100 * a[0] / np.where(total == 0, 1, total))]

    return Program(first, (Smooth(n, 1 / n, 1),) * 2, result)


def macd_program(source: str, fast: int, slow: int, signal: int) -> Program:
    def line(a, place):
        return [np.where(place < slow - 1, np.nan, a[0] - a[1])]

    def result(a, s, place):
        (own,) = line(a, place)
        return [own, s[0], own - s[0]]

    smooths = Smooth(fast, 2 / (fast + 1), slow - fast), Smooth(slow, 2 / (slow + 1))
    return Program(lambda c, b: [c[source], c[source]], smooths, result, line, (Smooth(signal, 2 / (signal + 1), slow - 1),))


def atr_program(n: int) -> Program:
    return Program(lambda c, b: [_ranges(c, b)], (Smooth(n, 1 / n, 1),), lambda a, s, place: [a[0]])


def adx_program(n: int) -> Program:
    def first(c, b):
        up, down = c["high"] - _stepped(c, b, "high"), _stepped(c, b, "low") - c["low"]
        return [_ranges(c, b), np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)]

    def strength(a, place):
        with np.errstate(invalid="ignore", divide="ignore"):
            p, m = a[1] / a[0], a[2] / a[0]
            return [np.where(p + m == 0, 0.0, 100 * np.abs(p - m) / (p + m))]

    return Program(first, (Smooth(n, 1 / n, 1),) * 3, lambda a, s, place: [s[0]], strength, (Smooth(n, 1 / n, n),))


@dataclass(frozen=True)
class Recursion:
    """outputs = f(*inputs) over a series in time order; `program`: the same in segments, if it is there."""

    outputs: tuple[str, ...]
    inputs: tuple[str, ...]
    f: Callable[..., np.ndarray | tuple[np.ndarray, ...]]
    program: Program | None = None


def with_recursions(df: DataFrame, recursions: Sequence[Recursion], keys: Sequence[str] = ("symbol",), time: Sequence[str] = ("bar_start",)) -> DataFrame:
    """`df` and the outputs, each series computed in the order of `time`."""
    dealt = [r for r in recursions if r.program is not None] if len(time) == 1 else []
    if dealt:
        df = with_programs(df, [(r.outputs, r.inputs, r.program) for r in dealt], keys, time[0])
    recursions = [r for r in recursions if r not in dealt]
    if not recursions:
        return df
    names = [o for r in recursions for o in r.outputs]
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(o, T.DoubleType()) for o in names])
    kept = [f.name for f in schema.fields if f.name not in names]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(t, "ascending") for t in time])
        columns: dict[str, np.ndarray] = {}
        for r in recursions:
            values = [columns[c] if c in columns else pc.fill_null(table.column(c).cast(pa.float64()), float("nan")).to_numpy() for c in r.inputs]
            made = r.f(*values)
            columns |= dict(zip(r.outputs, made if isinstance(made, tuple) else (made,), strict=True))
        out = table.select(kept)
        for name in names:
            out = out.append_column(name, pa.array(columns[name], pa.float64(), mask=np.isnan(columns[name])))
        return out

    return df.groupBy(*keys).applyInArrow(run, schema)
