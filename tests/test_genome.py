"""Genes of whole strategies: bounds and steps, switching off, crossing by name, and back."""

from __future__ import annotations

import random
from dataclasses import replace

from tickloom.operators import conditions as C
from tickloom.operators import indicators as I
from tickloom.operators import search as G
from tickloom.schema import Strategy


def legal(c):
    for g in c.genes:
        if g.choices:
            assert g.value in g.choices or g.name == "timeframes" and {*g.value.split(",")} <= {*G.TIMEFRAMES} or g.name == "mode"
        else:
            assert g.low <= g.value <= g.high and (not g.step or abs((g.value - g.low) / g.step - round((g.value - g.low) / g.step)) < 1e-6 or g.value == g.high), g
    names = [g.name for g in c.genes]
    assert len(names) == len({*names})
    s = c.decode("x")
    assert s.indicators and s.timeframes and {*s.timeframes} <= {*G.TIMEFRAMES}
    known = {"close", "volume", *I.plan_indicators(s.indicators).columns()}
    texts = [t for own in (s.entry, s.exit) for side in own.values() for t in side]
    assert texts
    return s, C.problems(texts, known)


def test_random_strategies_mutations_and_crosses_are_legal(spark):
    rng = random.Random(4)
    people = [G.random_chromosome(rng) for _ in range(60)]
    for c in people:
        assert not legal(c)[1]
    seen = set()
    for _ in range(300):
        a, b = rng.sample(people, 2)
        child = G.mutate(G.cross(a, b, rng, G.POOLS), rng, 0.5, G.POOLS)
        s, _ = legal(child)
        seen |= {s.mode} | {g.name for g in child.genes if g.name.endswith(".on") and not g.value}
        kinds = {g.name.partition(".")[0] for g in child.genes}
        assert kinds <= {g.name.partition(".")[0] for g in (*a.genes, *b.genes)}
        for k in kinds - {"model", "mode", "timeframes"}:  # an indicator comes with all its numbers
            assert {n for n in G.GENES if n.startswith(f"{k}.")} <= {g.name for g in child.genes}
    assert {*G.MODES} <= seen and any(x.endswith(".on") for x in seen)


def test_a_strategy_and_back():
    s = Strategy("s", {"macd": {"fast": 8, "slow": 30, "signal": 7}, "obv": {}}, {"long": ("macd_histogram > 0",), "short": ()}, {"long": ("obv < obv_sma",), "short": ()}, mode="scalp", timeframes=("5m", "4h"), ml_weight=0.25, ml_threshold=0.7)
    c = G.encode(s)
    assert c.decode("s") == s and c.size() == (2, 2, 5)
    bare = G.encode(replace(s, ml_weight=None, ml_threshold=None)).decode("s")
    assert (bare.ml_weight, bare.ml_threshold) == (0.0, 0.6)


def test_an_indicator_that_is_off_takes_its_conditions_along(spark):
    s = Strategy("s", {"rsi": {"period": 10}, "cci": {"period": 20}}, {"long": ("rsi < 30", "cci < -100"), "short": ("cci > 100",)}, {"long": ("close > ema_fast",), "short": ()})
    off = lambda c, *kinds: replace(c, genes=tuple(replace(g, value=0) if g.name in {f"{k}.on" for k in kinds} else g for g in c.genes))
    one = off(G.encode(s), "cci").decode("s")
    assert one.indicators == {"rsi": {"period": 10}} and one.entry == {"long": ("rsi < 30",), "short": ("close < ema_fast",)} and one.exit["short"] == ()
    none = off(G.encode(s), "cci", "rsi")
    assert none.decode("s").indicators == {"rsi": {"period": 10}} and none.size()[1] == 0


def test_numbers_move_by_steps():
    rng, g = random.Random(1), G.gene("bollinger.stddev", 2.0)
    for _ in range(200):
        new = g.mutate(rng)
        assert new.value != g.value and 1.0 <= new.value <= 3.5 and (new.value * 4) % 1 == 0
        g = new
    switch = G.Gene("x.on", 1, 0, 1, whole=True, step=1)
    assert switch.mutate(rng).value == 0 and switch.mutate(rng).mutate(rng).value == 1
    assert G.Gene("x", 0.5, 0, 1).mutate(rng).value != 0.5
