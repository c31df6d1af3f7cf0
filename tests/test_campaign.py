"""Searches of all windows and weights together are those of each alone; a campaign that broke off goes on."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_learning import bars
from tickloom.operators import campaign as C
from tickloom.operators import search as G

COMBINATIONS = [(0.15, 5.0, 50.0, 10.0), (0.4, 1.0, 80.0, 0.0)]
PARAMS = G.SearchParams(population=3, generations=2, elites=1, immigrants=1, seed=3)


@pytest.fixture(scope="module")
def table(spark):
    return bars(spark, 24 * 92, ("a",)).cache()


def windows(spark):
    ends = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 4, 1))], "start timestamp_ntz, end timestamp_ntz")
    return G.walk_forward_windows(ends, 1, 1, 1)


def alone(spark, table, span, weights):
    """One search, each individual evaluated in a call of its own."""

    def one(person, start, end):
        found = C.evaluate_runs(table, [C.Run(person.decode("r"), start, end)])
        c, i, p = person.size()
        ask = spark.createDataFrame([("x", "r", *weights, c * 0.8 + i * 1.2 + p * 0.3)], "ask string, run_id string, win double, pf double, roc double, bal double, complexity double")
        return C.scores(found, ask).first().fitness, found.first()

    champion, history = G.evolve(G.random_chromosome, lambda people: [one(p, span.train_start, span.train_end)[0] for p in people], PARAMS, G.POOLS)
    train, val = one(champion, span.train_start, span.train_end)[1], one(champion, span.val_start, span.val_end)[1]
    zero = lambda r, n: 0.0 if r is None else r[n]
    return (C.genome(champion), max(history), zero(train, "sharpe"), zero(val, "sharpe"), zero(val, "win_rate"), zero(val, "total_return"))


def test_together_as_alone_and_after_a_break(spark, table, tmp_path, monkeypatch):
    spans, state = windows(spark).orderBy("train_start").collect(), str(tmp_path / "state")
    assert len(spans) == 2
    jobs, real = [], C.evaluate_runs

    def counted(rows, runs, *more):
        jobs.append(len(runs))
        if len(jobs) == 2:
            raise RuntimeError("broken off")
        return real(rows, runs, *more)

    monkeypatch.setattr(C, "evaluate_runs", counted)
    go = lambda: C.campaign(table, windows(spark), G.random_chromosome, state, COMBINATIONS, PARAMS, G.POOLS)
    with pytest.raises(RuntimeError, match="broken off"):
        go()
    got = go().orderBy("rank", "window").collect()
    first = jobs[:]
    assert first[0] == 2 * 3  # the first generation of both weights is the same: three individuals on two windows
    assert len(first) == 4 and go().orderBy("rank", "window").collect() == got and jobs == first  # nothing is evaluated again
    monkeypatch.setattr(C, "evaluate_runs", real)
    assert [(r.rank, r.window) for r in got] == [(1, 0), (1, 1), (2, 0), (2, 1)]
    for r in (got[0], got[3]):
        name, fitness, *values = alone(spark, table, spans[r.window], COMBINATIONS[r.rank - 1])
        assert r.fitness == pytest.approx(fitness) and [r.train_sharpe, r.val_sharpe, r.val_win_rate, r.val_total_return] == pytest.approx(values)
    report = spark.createDataFrame(got)
    want = {k: [r.val_sharpe for r in got if r.rank == k] for k in (1, 2)}
    chosen = C.choose(report).first()
    mean = {k: sum(v) / 2 / (abs(v[0] - v[1]) / 2**0.5) if v[0] != v[1] else 0.0 for k, v in want.items()}
    best = max(mean, key=lambda k: (mean[k], -k))
    assert chosen.rank == (best if mean[best] > 0 else 1)


def test_choice_of_weights(spark):
    rows = [(1, 0, 1.0, 0.1), (1, 1, 1.0, 0.3), (2, 0, 1.0, 0.5), (2, 1, 1.0, 0.7), (3, 0, 0.0, 0.5), (3, 1, 0.0, 0.7), (4, 0, 1.0, 9.0), (5, 0, 1.0, -1.0), (5, 1, 1.0, -3.0)]
    report = spark.createDataFrame(rows, "rank int, window int, train_sharpe double, val_sharpe double")
    found = C.choose(report).first()
    assert (found.rank, found.chosen) == (2, True) and found.efficiency == pytest.approx(0.6 / 0.1414213562)
    assert tuple(C.choose(report.where("rank >= 4")).first()) == (1, 0.0, False) and C.choose(report.limit(0)).first().rank == 1


def test_weights_are_kept(spark, tmp_path):
    path = str(tmp_path / "w")
    assert C.load_weights(spark, path) == C.USUAL
    for weights in ((1.0, 2.0, 3.0, 4.0), (0.5, 0.25, 0.0, 1.0)):
        C.save_weights(spark, path, weights, 0.4, 1.5)
        assert C.load_weights(spark, path) == weights


def test_no_windows_and_no_bars(spark, table, tmp_path):
    none = C.campaign(table, windows(spark).limit(0), G.random_chromosome, str(tmp_path / "a"), params=PARAMS)
    assert none.count() == 0
    empty = C.campaign(table.limit(0), windows(spark).limit(1), G.random_chromosome, str(tmp_path / "b"), params=PARAMS, pools=G.POOLS).first()
    assert (empty.train_sharpe, empty.val_sharpe, empty.fitness) == (0.0, 0.0, C.MISSING)


def test_runs_cut_signals_not_indicators(spark, table):
    """A run's first bars have indicators of the bars before it, and runs of one strategy share its signals."""
    s = G.random_chromosome(random.Random(5)).decode("x")
    half = dt.datetime(2024, 2, 1)
    runs = [C.Run(C.replace(s, name=n), a, b) for n, a, b in (("all", dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)), ("late", half, dt.datetime(2025, 1, 1)), ("none", dt.datetime(2030, 1, 1), dt.datetime(2031, 1, 1)))]
    got = {r.run_id: r for r in C.evaluate_runs(table, runs).collect()}
    assert set(got) == {"all", "late"} and got["all"].total_trades >= got["late"].total_trades >= 0
    assert table.where(F.col("bar_start") >= half).count() > 0
