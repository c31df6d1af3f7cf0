"""Many small models as rows of a table: one for each series (or strategy and symbol), fitted side by side.

`fit_logistic` is Newton's method over all groups at once. Rows are packed once into blocks of one group each, a large
group into many; a round adds up each block's gradient and curvature in Arrow partials, sums them by group in the
JVM, and makes every group's step. So a group of any size is dealt out, and the number of jobs follows the rounds only.

`daily_models` are least squares that grow with the data: the sums that they need are additive, so each day's are made
once, and a model of all days before a day is a running sum over days.

`retrain_schedule` says which model is due at which step: round robin, one model a turn.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import rolling as W
from ..functions.store import stored
from .features import neutral_band
from .metrics import running_total

# Bars ahead, threshold and least number of candles of a model by its timeframe.
TIMEFRAMES = {
    "1m": (20, 0.003, 300), "3m": (15, 0.004, 200), "5m": (12, 0.005, 200), "15m": (8, 0.005, 150), "30m": (6, 0.005, 120),
    "1h": (4, 0.005, 100), "2h": (4, 0.006, 80), "4h": (4, 0.008, 60), "6h": (4, 0.010, 50), "8h": (4, 0.012, 40),
    "12h": (4, 0.015, 30), "1d": (4, 0.020, 25), "3d": (4, 0.030, 20), "1w": (4, 0.050, 15),
}
#: Bytes of a model table that a join may broadcast; a larger one is shuffled.
BROADCAST = 32 << 20
#: Parts that a group's rows are dealt into, and rows of a block.
PARTS, BLOCK = 32, 4096


def outcomes(bars: DataFrame, interval: str = "1h") -> DataFrame:
    """`bars` with label (1 rise, 0 fall, null between or unknown), forward (the return) and known_at (when it is known:
    the end of the last bar that it looks at), by the timeframe's parameters; those of an hour for an unknown one."""
    ahead, threshold, _ = TIMEFRAMES.get(interval, TIMEFRAMES["1h"])
    forward = F.try_divide(F.lead("close", ahead).over(W.ordered()), F.col("close")) - 1
    rows = bars.withColumns({"forward": forward, "known_at": F.lead("bar_end", ahead).over(W.ordered())})
    return rows.withColumn("label", F.when(F.col("forward") >= threshold, 1).when(F.col("forward") <= -threshold, 0))


def _plus(rows: DataFrame, more: str) -> StructType:
    return StructType([*rows.schema.fields, *StructType.fromDDL(more).fields])


def _small(models: DataFrame, width: int) -> DataFrame:
    """Marked for broadcast if its rows are few enough; `models` is a stored table."""
    return F.broadcast(models) if models.count() * (64 + 8 * width) <= BROADCAST else models


# --- Newton's method ----------------------------------------------------------------------------------------


def _packed(by: Sequence[str], d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = pa.Table.from_batches([batch.select([*by])]).to_pandas()
            cuts = np.flatnonzero(np.append(True, (keys.values[1:] != keys.values[:-1]).any(axis=1))).tolist()
            cuts = sorted({*cuts, *range(0, n, BLOCK)})
            x = np.column_stack([np.asarray(batch.column(f"_x{i}"), float) for i in range(d)]) if d else np.zeros((n, 0))
            y = np.asarray(batch.column("_y"), float)
            ends = [*cuts[1:], n]
            heads = batch.select([*by]).take(pa.array(cuts, pa.int64()))
            made = [pa.array([a[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary()) for a in (x, y)]
            yield pa.RecordBatch.from_arrays([*heads.columns, *made], [*by, "x", "y"])

    return run


def _blocks(rows: DataFrame, by: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """(by, x, y): packed rows, each block of one group; rows without a key, a label or a finite feature value are left out."""
    value = lambda c: F.col(c).cast("double")
    finite = [value(c).isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) < float("inf")) for c in (*features, label)]
    whole = reduce(and_, [*finite, *(F.col(c).isNotNull() for c in by)])
    own = rows.where(whole).select(*by, *[value(c).alias(f"_x{i}") for i, c in enumerate(features)], value(label).alias("_y"))
    part = F.pmod(F.xxhash64(*[f"_x{i}" for i in range(len(features))], "_y"), F.lit(PARTS))
    schema = _plus(own.select(*by), "x binary, y binary")
    return stored(own.withColumn("_part", part).repartition(*by, "_part").drop("_part").sortWithinPartitions(*by).mapInArrow(_packed(by, len(features)), schema))


def _arrays(batch: pa.RecordBatch, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
        y = np.frombuffer(y, float)
        yield np.frombuffer(x, float).reshape(len(y), d), y


def _summed(blocks: DataFrame, by: Sequence[str], stat, extra: Sequence[str] = ()) -> DataFrame:
    """(by, s): the sums over each group's blocks of what `stat(batch)` gives, an array for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.asarray(s, float) for s in stat(batch)]
            size = np.cumsum([0, *map(len, made)])
            flat = np.concatenate(made) if made else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.select([*by]).columns, lists], [*by, "s"])

    schema = _plus(blocks.select(*by), "s array<double>")
    each = blocks.select(*by, "x", "y", *extra).mapInArrow(run, schema)
    sums = each.select(*by, F.posexplode("s").alias("i", "v")).groupBy(*by, "i").agg(F.sum("v").alias("v"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("s"))


def _moments(d: int):
    return lambda batch: [np.concatenate([[len(y)], x.sum(axis=0), (x * x).sum(axis=0)]) for x, y in _arrays(batch, d)]


def _standard(x: np.ndarray, s: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a leading 1, standardised by their group's moments; means and scales (1 for a constant)."""
    mean = s[1 : d + 1] / s[0]
    spread = np.sqrt(np.maximum(s[d + 1 : 2 * d + 1] / s[0] - mean**2, 0))
    scale = np.where(spread > 1e-12 * np.maximum(1, np.abs(mean)), spread, 1.0)
    return np.column_stack([np.ones(len(x)), (x - mean) / scale]), mean, scale


def newton_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature (row by row) of the logistic loss, summed over rows."""
    t = z @ w
    p = 1 / (1 + np.exp(-t))
    loss = np.logaddexp(0, t) - y * t
    return np.concatenate([[loss.sum()], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])


def _rounds(d: int):
    def stat(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        state = zip(batch.column("moments").to_pylist(), batch.column("w").to_pylist(), strict=True)
        for (x, y), (moments, w) in zip(_arrays(batch, d), state, strict=True):
            yield newton_sums(_standard(x, np.array(moments), d)[0], y, np.array(w))

    return stat


def _stepped(by: Sequence[str], d: int, ridge: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, moved = [], []
            for s, w in zip(batch.column("s").to_pylist(), batch.column("w").to_pylist(), strict=True):
                w, s = np.array(w), np.array(s)
                hold = np.append(0.0, np.full(d, ridge)) + 1e-9
                step = np.linalg.solve(s[d + 2 :].reshape(d + 1, d + 1) + np.diag(hold), s[1 : d + 2] + hold * w)
                step *= min(1.0, 5 / max(np.abs(step).max(), 1e-300))  # far steps of separable groups are cut
                rows.append((w - step).tolist())
                moved.append(float(np.abs(step).max()))
            yield pa.RecordBatch.from_arrays([*batch.select([*by, "moments"]).columns, pa.array(rows, pa.list_(pa.float64())), pa.array(moved)], [*by, "moments", "w", "moved"])

    return run


def _finished(by: Sequence[str], d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, counts = [], []
            for s, w in zip(batch.column("moments").to_pylist(), batch.column("w").to_pylist(), strict=True):
                _, mean, scale = _standard(np.zeros((0, d)), np.array(s), d)
                raw = np.array(w)[1:] / scale
                weights.append([w[0] - float(raw @ mean), *raw.tolist()])
                counts.append(int(s[0]))
            yield pa.RecordBatch.from_arrays([*batch.select([*by]).columns, pa.array(counts, pa.int64()), pa.array(weights, pa.list_(pa.float64()))], [*by, "n", "weights"])

    return run


def fit_logistic(rows: DataFrame, by: Sequence[str], features: Sequence[str], label: str = "label", least: int = 1, ridge: float = 1.0, rounds: int = 25, close: float = 1e-9) -> DataFrame:
    """(by, n, weights): a logistic model of each group with `least` rows or more; weights are the constant and one for
    each feature, in the features' own units.

    Rows without a key or label, or with a feature that is null or not finite, take no part. `ridge` holds the
    standardised weights (not the constant) near 0, so that groups of one class have a model too. It ends when no weight of
    any group moves by more than `close`.
    """
    d, by = len(features), [*by]
    blocks = _blocks(rows, by, features, label)
    moments = _summed(blocks, by, _moments(d)).where(F.col("s")[0] >= least)
    state = stored(moments.select(*by, F.col("s").alias("moments"), F.array(*[F.lit(0.0)] * (d + 1)).alias("w"), F.lit(None).cast("double").alias("moved")))
    kept = _plus(state.select(*by, "moments", "w"), "moved double")
    for _ in range(rounds):
        sums = _summed(blocks.join(_small(state, 4 * d), by), by, _rounds(d), ("moments", "w"))
        state = stored(state.drop("moved").join(sums, by).mapInArrow(_stepped(by, d, ridge), kept))
        if (state.agg(F.max("moved")).first()[0] or 0.0) <= close:
            break
    return state.mapInArrow(_finished(by, d), _plus(state.select(*by), "n long, weights array<double>"))


# --- least squares by day -----------------------------------------------------------------------------------


def daily_models(rows: DataFrame, by: Sequence[str], features: Sequence[str], label: str = "forward", known_at: str = "known_at", least: int = 30, ridge: float = 0.0) -> DataFrame:
    """(by, valid_from, n, weights): for each day on which something became known, least squares over all rows known until
    its end, valid from the next day on. Days with fewer than `least` rows so far, and singular sums, have no model.

    Rows with a null among features, label and known_at take no part.
    """
    by, names = [*by], [*features]
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in names], F.col(label).cast("double")]
    products = {(i, j): f"_{i}_{j}" for i in range(len(columns)) for j in range(i, len(columns))}
    whole = reduce(and_, [F.col(c).isNotNull() for c in (*by, *names, label, known_at)])
    days = rows.where(whole).groupBy(*by, F.to_date(known_at).alias("_day")).agg(*[F.sum(columns[i] * columns[j]).alias(n) for (i, j), n in products.items()])
    upto = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    total = days.select(*by, "_day", *[F.sum(n).over(upto).alias(n) for n in products.values()])
    d = len(names) + 1

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {k: np.asarray(batch.column(n), float) for k, n in products.items()}
            a = np.array([[s[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]).transpose(2, 0, 1)
            b = np.array([s[i, d] for i in range(d)]).T
            a = a + np.diag([0.0] + [ridge] * (d - 1))
            good = np.linalg.matrix_rank(a, tol=None) == d if len(a) else np.zeros(0, bool)
            at = pa.array(np.flatnonzero(good), pa.int64())
            w = np.linalg.solve(a[good], b[good][:, :, None])[:, :, 0]
            kept = batch.select([*by, "_day"]).take(at)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(s[0, 0][good].astype(np.int64)), pa.array(w.tolist(), pa.list_(pa.float64()))], [*by, "_day", "n", "weights"])

    schema = _plus(total.select(*by, "_day"), "n long, weights array<double>")
    made = total.where(F.col("_0_0") >= least).mapInArrow(solve, schema)
    return made.select(*by, F.date_add("_day", 1).cast("timestamp_ntz").alias("valid_from"), "n", "weights")


# --- scores -------------------------------------------------------------------------------------------------


def linear(features: Sequence[str], weights: Column) -> Column:
    """The constant and the weighted features; a null feature counts as 0, null weights give null."""
    return reduce(lambda s, x: s + F.coalesce(F.col(x[1]).cast("double"), F.lit(0.0)) * F.get(weights, F.lit(x[0] + 1)), enumerate(features), F.get(weights, F.lit(0)))


def confidence(features: Sequence[str], weights: Column, digits: int = 4) -> Column:
    """The probability of a rise, rounded, the neutral band taken as 0.5; 0.5 without a model."""
    p = 1 / (1 + F.exp(-linear(features, weights)))
    return F.coalesce(neutral_band(F.round(p, digits)), F.lit(0.5))


def with_models(rows: DataFrame, models: DataFrame, by: Sequence[str], time: str = "bar_end") -> DataFrame:
    """`rows` with model_from and weights of the newest model valid at their time (null before the first one).

    Models are valid from a day's begin on: which one holds is found once for each group and day, and rows meet it by
    group and day, so no task holds a series.
    """
    by = [*by]
    at = lambda c: F.to_date(c)
    days = rows.select(*by, at(time).alias("_day")).distinct()
    both = days.select(*by, "_day", F.lit(1).alias("_asked"), F.lit(None).cast("timestamp_ntz").alias("model_from"), F.lit(None).cast("array<double>").alias("weights"))
    known = models.select(*by, at("valid_from").alias("_day"), F.lit(0).alias("_asked"), F.col("valid_from").alias("model_from"), "weights")
    upto = Window.partitionBy(*by).orderBy("_day", "_asked", "model_from").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_asked") == 0, F.struct("model_from", "weights")), ignorenulls=True).over(upto)
    held = both.unionByName(known).withColumn("_m", last).where("_asked = 1").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate((*by, "_day"))], "_m.*")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate((*by, "_day"))]
    return rows.withColumn("_day", at(time)).join(held, reduce(and_, same), "left").drop("_day", *[f"_k{i}" for i in range(len(by) + 1)])


# --- schedule -----------------------------------------------------------------------------------------------


def retrain_schedule(steps: DataFrame, models: DataFrame, key: str = "model", every: int = 100, time: str = "ts") -> DataFrame:
    """(time, step, model): the model that is due at each step; a turn comes every `every` steps at most, or as many as there
    are models, and models take turns in the order of their names.

    `steps` (time) are numbered from 1, in two levels by day; repeated times are one. `models` is configuration: a row
    for each strategy and symbol. No models or steps give no rows.
    """
    n = models.where(F.col(key).isNotNull()).select(key).distinct()
    count = n.count()
    if not count:
        return steps.select(time, F.lit(0).cast("long").alias("step"), F.lit(None).cast(models.schema[key].dataType).alias(key)).limit(0)
    stagger = max(1, max(every, count) // count)
    turns = n.select(key, (F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias("_turn"))
    numbered = running_total(steps.select(time).where(F.col(time).isNotNull()).distinct(), F.lit(1).cast("long"), "step", (), (time,), time=time)
    due = numbered.where(F.col("step") % stagger == 0).withColumn("_turn", F.expr(f"(step div {stagger}) % {count}"))
    return due.join(turns, "_turn").select(time, "step", key)


def overdue(series: DataFrame, models: DataFrame, by: Sequence[str], now: str, every: str = "INTERVAL '1' DAY") -> DataFrame:
    """(by, newest): the series whose newest model is older than `every` at the time `now`, or that have none."""
    newest = models.groupBy(*by).agg(F.max("valid_from").alias("newest"))
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(every)
    return series.select(*by).distinct().join(newest, [*by], "left").where(F.col("newest").isNull() | (F.col("newest") <= limit))
