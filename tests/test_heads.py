"""Heads over sequences: gradients against finite differences, training that learns, predictions of awkward rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import heads as H


def shape(kind):
    head = H.Head(10, 2, kind, size=4, stride=3, width=3, mean=(0.5, -1.0), scale=(2.0, 0.5))
    return head, head.begin(1)


@pytest.mark.parametrize("kind", ["softmax", "quantile"])
def test_gradients_are_finite_differences(kind):
    rng = np.random.default_rng(3)
    head, w = shape(kind)
    x, y = rng.normal(size=(7, 10, 2)), rng.integers(0, 3, 7) if kind == "softmax" else rng.normal(size=7) * 3
    got = H.loss_and_gradient(head, w, x, y)
    assert got[0] == 7 and len(got) == 2 + len(w)
    for i in range(len(w)):
        e = np.zeros_like(w)
        e[i] = 1e-6
        slope = (H.loss_and_gradient(head, w + e, x, y)[1] - H.loss_and_gradient(head, w - e, x, y)[1]) / 2e-6
        assert slope == pytest.approx(got[2 + i], rel=1e-4, abs=1e-6)


def test_sums_over_parts_are_those_of_all_rows():
    rng = np.random.default_rng(4)
    head, w = shape("softmax")
    x, y = rng.normal(size=(9, 10, 2)), rng.integers(0, 3, 9)
    parts = H.loss_and_gradient(head, w, x[:4], y[:4]) + H.loss_and_gradient(head, w, x[4:], y[4:])
    assert parts == pytest.approx(H.loss_and_gradient(head, w, x, y))


def sequences(spark, n=1200, seed=2):
    """Sequences whose last steps rise, fall or stay; the number is their slope, with noise."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        slope = rng.choice([-1.0, 1.0, 0.0])
        walk = np.cumsum(rng.normal(0, 0.3, 12) + np.where(np.arange(12) > 5, slope, 0))
        rows.append((i, [[float(a), float(rng.normal(100, 5))] for a in walk], {-1.0: 0, 1.0: 1, 0.0: 2}[slope], float(slope + rng.normal(0, 0.2))))
    return spark.createDataFrame(rows, "id int, seq array<array<double>>, label int, move double")


AWKWARD = [(-1, None, 1, 1.0), (-2, [], 1, 1.0), (-3, [[1.0, 2.0]] * 11, 1, 1.0), (-4, [[1.0]] * 12, 1, 1.0), (-5, [[1.0, None]] * 12, 0, 0.0), (-6, [[float("nan"), 1.0]] * 12, 0, 0.0), (-7, [None] * 12, 0, 0.0), (-8, [[1.0, 2.0]] * 12, None, None), (-9, [[1.0, 2.0]] * 12, 7, float("inf"))]


def test_classes_are_learnt(spark):
    rows = sequences(spark)
    odd = spark.createDataFrame(AWKWARD, rows.schema)
    mixed = rows.where("id < 900").unionByName(odd).withColumns({"x": F.lit("mine"), "p": F.lit(1), "outputs": F.lit("mine")})
    head = H.train(mixed, 12, 2, size=6, stride=3, width=8, rounds=40, rate=0.05)
    assert head.losses[0] == pytest.approx(np.log(3), abs=0.4) and head.losses[-1] < 0.4 * head.losses[0]
    got = H.directed(H.predict(rows.where("id >= 900").unionByName(odd).withColumns({"outputs": F.lit("mine"), "p": F.lit(1)}), head), head).collect()
    tested = [r for r in got if r.id >= 0]
    assert np.mean([int(np.argmax(r.outputs)) == r.label for r in tested]) > 0.85
    for r in tested:
        assert sum(r.outputs) == pytest.approx(1) and r.confidence == max(r.outputs[:2]) and r.direction == np.sign(r.outputs[1] - r.outputs[0])
    assert {r.id for r in got if r.outputs is None} == {-1, -2, -3, -4, -5, -6, -7} and len(got) == 300 + len(AWKWARD)
    again = H.train(rows.where("id < 900"), 12, 2, size=6, stride=3, width=8, rounds=2, rate=0.05)  # awkward rows change nothing but by -8 and -9, which have no label
    assert again.losses == pytest.approx(head.losses[:2])


def test_quantiles_are_learnt(spark):
    rows = sequences(spark, 800, 5)
    head = H.train(rows, 12, 2, label="move", kind="quantile", size=6, stride=3, width=8, rounds=60, rate=0.05)
    assert head.losses[-1] < 0.5 * head.losses[0]
    done = H.directed(H.predict(rows, head), head)
    found = {r.quantile: r for r in H.pinball_by_quantile(done, "move").collect()}
    assert found[0.1].below < 0.3 < found[0.5].below < 0.75 < found[0.9].below
    assert all(list(r.outputs) == sorted(r.outputs) and 0 <= r.confidence <= 1 for r in done.collect())
    assert np.mean([l for l in (r.loss for r in found.values())]) == pytest.approx(head.losses[-1], rel=0.3)


def test_nothing_to_learn_from(spark):
    rows = sequences(spark, 3)
    assert H.train(rows.limit(0), 12, 2) is None and H.train(spark.createDataFrame(AWKWARD, rows.schema), 12, 2) is None
