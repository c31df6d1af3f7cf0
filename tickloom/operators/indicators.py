"""Technical indicators from a declarative configuration.

`with_indicators` adds the columns of all configured indicators: recursions in one pass over each series, window
frames in one sort. Warm-up rows are null. `register_indicator` adds kinds of one's own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import recursive as R
from ..functions import rolling as W
from .metrics import running_total

BAR_COLUMNS = ("open", "high", "low", "close", "volume")


@dataclass
class Plan:
    """What a set of indicators needs: recursions first, then window columns stage by stage."""

    recursions: list[R.Recursion] = field(default_factory=list)
    stages: list[dict[str, Column]] = field(default_factory=lambda: [{}, {}, {}])

    def columns(self) -> set[str]:
        return {o for r in self.recursions for o in r.outputs} | {c for s in self.stages for c in s}


def as_int(value: Any, default: int) -> int:
    """A configuration value as a whole number, or the default."""
    try:
        return int(float(value))
    except (TypeError, ValueError):
        return default


def as_number(value: Any, default: float) -> float:
    """A configuration value as a number, or the default."""
    try:
        return float(value)
    except (TypeError, ValueError):
        return default


def _period(cfg: Mapping, default: int = 14, key: str = "period") -> int:
    return max(1, as_int(cfg.get(key), default))


def _key(cfg: Mapping, *names: str) -> str:
    """The first of several names of a parameter that is there (else the first)."""
    return next((n for n in names if cfg.get(n) not in (None, "", 0)), names[0])


def _source(cfg: Mapping) -> str:
    return cfg.get("source") if cfg.get("source") in BAR_COLUMNS else "close"


def _rsi(plan: Plan, cfg: Mapping) -> None:
    plan.recursions.append(R.Recursion(("rsi",), (_source(cfg),), partial(R.rsi, n=_period(cfg)), R.rsi_program(_source(cfg), _period(cfg))))


def _macd(plan: Plan, cfg: Mapping) -> None:
    fast, slow, signal = (_period(cfg, n, _key(cfg, k, f"{k}_period")) for k, n in (("fast", 12), ("slow", 26), ("signal", 9)))
    own = {"fast": min(fast, slow), "slow": slow, "signal": signal}
    plan.recursions.append(R.Recursion(("macd", "macd_signal", "macd_histogram"), (_source(cfg),), partial(R.macd, **own), R.macd_program(_source(cfg), **own)))


def _bollinger(plan: Plan, cfg: Mapping) -> None:
    n, k, x = _period(cfg, 20), as_number(cfg.get(_key(cfg, "stddev", "std", "std_dev")), 2.0), F.col(_source(cfg))
    middle, spread = W.mean(x, n), W.std_pop(x, n) * k
    plan.stages[0] |= {
        "bollinger_upper": middle + spread, "bollinger_middle": middle, "bollinger_lower": middle - spread,
        "bollinger_width": F.try_divide(spread * 2, middle),
    }


def _ema(plan: Plan, cfg: Mapping) -> None:
    """{fast_period, slow_period}: ema_fast and ema_slow, the slow one from `period` if it is missing (21 if that is the
    default); or {periods: [...]}: one for each; or {period}. `fast` and `slow` are other names of the first two."""
    source, period = _source(cfg), _period(cfg)
    add = lambda name, n: plan.recursions.append(R.Recursion((name,), (source,), partial(R.ema, n=n), R.ema_program(source, n)))
    fast, slow = _key(cfg, "fast_period", "fast"), _key(cfg, "slow_period", "slow")
    if cfg.get(fast) or cfg.get(slow):
        add("ema_fast", _period(cfg, 9, fast))
        add("ema_slow", _period(cfg, period if period != 14 else 21, slow))
    elif isinstance(cfg.get("periods"), (list, tuple)) and cfg["periods"]:
        for n in cfg["periods"]:
            add(f"ema_{n}", max(1, as_int(n, 20)))
    else:
        add(f"ema_{period}", period)


def _sma(plan: Plan, cfg: Mapping) -> None:
    mean = W.mean(F.col(_source(cfg)), _period(cfg))
    plan.stages[0] |= {f"sma_{_period(cfg)}": mean, "sma": mean}


def _atr(plan: Plan, cfg: Mapping) -> None:
    plan.recursions.append(R.Recursion(("atr",), ("high", "low", "close"), partial(R.atr, n=_period(cfg)), R.atr_program(_period(cfg))))


def _adx(plan: Plan, cfg: Mapping) -> None:
    plan.recursions.append(R.Recursion(("adx",), ("high", "low", "close"), partial(R.adx, n=_period(cfg)), R.adx_program(_period(cfg))))


def _stochastic(plan: Plan, cfg: Mapping) -> None:
    n = _period(cfg, _period(cfg), "k_period")
    smooth = _period(cfg, 3, "d_period")
    low, high = W.lowest(F.col("low"), n), W.highest(F.col("high"), n)
    plan.stages[0]["_fast_k"] = F.try_divide((F.col("close") - low) * 100, high - low)
    plan.stages[1]["stoch_k"] = W.mean(F.col("_fast_k"), 3)
    plan.stages[2]["stoch_d"] = W.mean(F.col("stoch_k"), smooth)


def _obv(plan: Plan, cfg: Mapping) -> None:
    step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(W.ordered())), F.lit(1.0)) * F.col("volume")
    plan.stages[0]["_obv_step"] = step
    plan.stages[1]["obv"] = F.sum("_obv_step").over(W.upto())
    plan.stages[2]["obv_sma"] = W.mean(F.col("obv"), 20)


def _cci(plan: Plan, cfg: Mapping) -> None:
    n = _period(cfg)
    plan.stages[0]["_typical"] = (F.col("high") + F.col("low") + F.col("close")) / 3
    frame = F.collect_list("_typical").over(W.last(n))
    mean = W.mean(F.col("_typical"), n)
    away = F.aggregate(frame, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    plan.stages[1]["cci"] = F.try_divide(F.col("_typical") - mean, away * 0.015)


KINDS: dict[str, Callable[[Plan, Mapping], None]] = {
    "rsi": _rsi, "macd": _macd, "bollinger": _bollinger, "bollinger_bands": _bollinger, "ema": _ema, "sma": _sma,
    "atr": _atr, "adx": _adx, "stochastic": _stochastic, "stoch": _stochastic, "obv": _obv, "cci": _cci,
}


def register_indicator(kind: str, add: Callable[[Plan, Mapping], None]) -> None:
    """Make `kind` known; `add` puts recursions and window columns into a plan."""
    KINDS[kind] = add


def plan_indicators(configs: Mapping[str, Any]) -> Plan:
    """The plan of a configuration {name: {type, period, ...}}; entries that are no mapping are passed over.

    Beside the configured columns every plan has volume_sma, volume_ratio, ema_fast and ema_slow (9 and 21 bars if
    not configured) and price_momentum_24h (24 bars), and where their sources are there bollinger_width_sma and
    atr_ratio.
    """
    plan = Plan()
    for name, cfg in configs.items():
        if isinstance(cfg, Mapping):
            kind = KINDS.get(str(cfg.get("type", name)).lower())
            if kind:
                kind(plan, cfg)
    have = plan.columns()
    for name, n in (("ema_fast", 9), ("ema_slow", 21)):
        if name not in have:
            plan.recursions.append(R.Recursion((name,), ("close",), partial(R.ema, n=n), R.ema_program("close", n)))
    volume = F.col("volume")
    plan.stages[0] |= {"volume_sma": W.mean(volume, 20), "price_momentum_24h": W.change(F.col("close"), 24)}
    plan.stages[1]["volume_ratio"] = F.try_divide(volume, F.col("volume_sma"))
    if "bollinger_width" in have:
        plan.stages[1]["bollinger_width_sma"] = W.mean(F.col("bollinger_width"), 20)
    if "atr" in have:
        plan.stages[0]["atr_ratio"] = F.try_divide(F.col("atr"), F.col("close"))
    unique = {r.outputs: r for r in plan.recursions}
    plan.recursions = [*unique.values()]
    return plan


def with_indicators(bars: DataFrame, configs: Mapping[str, Any], segment: int | None = None) -> DataFrame:
    """`bars` with the configured indicator columns.

    A series is computed by one task, unless `segment` says after how many rows it is to be cut (`in_segments`).
    """
    if segment:
        whole = {k: c for k, c in configs.items() if isinstance(c, Mapping) and str(c.get("type", k)).lower() in CUMULATIVE}
        rest = {k: c for k, c in configs.items() if k not in whole}
        out = in_segments(bars, lambda rows: with_indicators(rows, rest), segment, halo(plan_indicators(rest)))
        return with_indicators(out, whole) if whole else out
    plan = plan_indicators(configs)
    out = R.with_recursions(bars, plan.recursions)
    for stage in plan.stages:
        if stage:
            out = out.withColumns(stage)
    return out.drop("_fast_k", "_obv_step", "_typical")


#: Kinds that add up a whole series: they can't be computed from a part of it.
CUMULATIVE = ("obv",)


def halo(plan: Plan) -> int:
    """Rows before a segment after which it doesn't matter where its averages began.

    What an average keeps of its start falls below a double's last digit in less than 40 times its period, also where
    averages are averaged again; window frames reach back by fewer rows.
    """
    periods = [sum(getattr(r.f, "keywords", {}).values()) for r in plan.recursions]
    return 60 * max([1, *periods]) + 200


def in_segments(bars: DataFrame, compute: Callable[[DataFrame], DataFrame], size: int, before: int, by: str = "symbol", time: str = "bar_start") -> DataFrame:
    """compute(bars), each series cut into segments of `size` rows that are computed side by side.

    A segment is a series of its own, with the `before` rows ahead of it, which are left out of the result. Rows are
    numbered by counts of days, so no task holds a series. compute: a function of frames and averages along `time`
    within `by`, that keeps all columns and needs no more than `before` rows.
    """
    if size < before:
        raise ValueError(f"segments must have {before} rows or more")
    place = running_total(bars, F.lit(1), "_place", (by,), (time,), time).withColumn("_place", F.col("_place") - 1)
    own = F.floor(F.col("_place") / size)
    ahead = F.col("_place") % size >= size - before
    rows = place.withColumn("_own", own).withColumn("_segment", F.explode(F.when(ahead, F.array(own, own + 1)).otherwise(F.array(own))))
    rows = rows.withColumns({"_series": F.col(by), by: F.concat_ws("\0", by, "_segment")})
    done = compute(rows.drop("_place")).where("_segment = _own")
    return done.withColumn(by, F.col("_series")).drop("_series", "_segment", "_own")
