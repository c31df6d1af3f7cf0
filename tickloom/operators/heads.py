"""Small neural heads over sequences, trained in Spark: patches are embedded, averaged and read out, by softmax over three
classes or as quantiles with the pinball loss.

A sequence of steps is cut into overlapping patches; each is flattened, projected to `width` numbers with a place
vector of its own added, and goes through tanh; the mean over patches gives three outputs by a linear layer.

Training is full-batch Adam: rows are packed once; a step adds up loss and gradient over all of a task's rows with
numpy, one row a task, sums them by parameter in the JVM, and brings as many numbers to the driver as the model has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.store import stored
from .features import quantile_confidence

QUANTILES = (0.1, 0.5, 0.9)
#: Classes in the order of the outputs: the lower barrier first, the upper one first, neither.
DOWN, UP, NEITHER = 0, 1, 2
BLOCK = 1024


@dataclass(frozen=True)
class Head:
    """A model: its shape, what it standardises steps by, its parameters, and the loss before each step of its training."""

    steps: int
    features: int
    kind: str = "softmax"  # or "quantile"
    size: int = 16
    stride: int = 8
    width: int = 16
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    losses: tuple[float, ...] = ()

    @property
    def starts(self) -> range:
        return range(0, self.steps - self.size + 1, self.stride)

    def cuts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Projection, place vectors (with the constant), read-out and its constant, as views of `w`."""
        flat, places = self.size * self.features, len(self.starts)
        shapes = ((flat, self.width), (places, self.width), (self.width, 3), (3,))
        out, at = [], 0
        for s in shapes:
            n = int(np.prod(s))
            out.append(w[at : at + n].reshape(s))
            at += n
        return tuple(out)

    def begin(self, seed: int) -> np.ndarray:
        flat, places = self.size * self.features, len(self.starts)
        w = np.zeros(flat * self.width + places * self.width + 3 * self.width + 3)
        rng = np.random.default_rng(seed)
        project, place, read, _ = self.cuts(w)
        project[:] = rng.uniform(-1, 1, project.shape) * (6 / (flat + self.width)) ** 0.5
        place[:] = rng.normal(0, 0.02, place.shape)
        read[:] = rng.uniform(-1, 1, read.shape) * (6 / (self.width + 3)) ** 0.5
        return w

    def patches(self, x: np.ndarray) -> np.ndarray:
        """(rows, patches, size * features) of (rows, steps, features), standardised."""
        x = (x - np.array(self.mean)) / np.array(self.scale)
        return np.stack([x[:, i : i + self.size].reshape(len(x), -1) for i in self.starts], axis=1)

    def outputs(self, x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        project, place, read, level = self.cuts(self.weights if w is None else w)
        return np.tanh(self.patches(x) @ project + place).mean(axis=1) @ read + level


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(head: Head, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows, loss and gradient, summed over rows: cross entropy of classes y, or the pinball loss of numbers y over QUANTILES."""
    project, place, read, level = head.cuts(w)
    p = head.patches(x)
    h = np.tanh(p @ project + place)
    pooled = h.mean(axis=1)
    z = pooled @ read + level
    if head.kind == "softmax":
        prob, at = softmax(z), y.astype(int)
        loss = -np.log(np.maximum(prob[np.arange(len(y)), at], 1e-300)).sum()
        dz = prob - np.eye(3)[at]
    else:
        q, error = np.array(QUANTILES), y[:, None] - z
        loss = np.maximum(q * error, (q - 1) * error).mean(axis=1).sum()
        dz = np.where(error > 0, -q, 1 - q) / 3
    dh = (dz @ read.T)[:, None, :] / h.shape[1] * (1 - h * h)
    parts = np.einsum("npf,npw->fw", p, dh), dh.sum(axis=0), pooled.T @ dz, dz.sum(axis=0)
    return np.concatenate([[len(y), loss], *(a.ravel() for a in parts)])


def _usable(seq: Column, steps: int, features: int) -> Column:
    bad = F.exists(seq, lambda s: s.isNull() | (F.size(s) != features) | F.exists(s, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return F.coalesce((F.size(seq) == steps) & ~bad, F.lit(False))


def _tensor(column: pa.Array, steps: int, features: int) -> np.ndarray:
    return pc.list_flatten(pc.list_flatten(column)).to_numpy(zero_copy_only=False).astype(float).reshape(-1, steps, features)


def _pack(steps: int, features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _tensor(batch.column(0), steps, features), np.asarray(batch.column(1), float)
            cuts = [*range(0, len(y), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i : i + BLOCK].tobytes() for i in cuts], pa.binary()) for a in (x, y)], ["x", "y"])

    return run


def _total(blocks: DataFrame, stat, steps: int, features: int) -> np.ndarray:
    """The sum over all blocks of what `stat(x, y)` gives, an array of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = np.frombuffer(y, float)
                made = stat(np.frombuffer(x, float).reshape(len(y), steps, features), y)
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    sums = blocks.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([v for _, v in sorted((r["i"], r["v"]) for r in sums.collect())])


def train(rows: DataFrame, steps: int, features: int, label: str = "label", seq: str = "seq", kind: str = "softmax", size: int = 16, stride: int = 8, width: int = 16, rounds: int = 60, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Head | None:
    """A head from rows with `seq` (steps arrays of `features` numbers) and a label: a class 0, 1 or 2, or for "quantile" a
    number. None without any usable row.

    Rows without a label, or with a sequence that is null, of another shape or holds null or a non-finite number, take
    no part; so do classes other than these three. Repeated rows count each. `decay` pulls the parameters towards 0.
    """
    x, y = F.col(seq).cast("array<array<double>>"), F.col(label).cast("double")
    told = y.isin(0.0, 1.0, 2.0) if kind == "softmax" else y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))
    own = rows.where(F.coalesce(told, F.lit(False))).select(x.alias("x"), y.alias("y")).where(_usable(F.col("x"), steps, features))
    blocks = stored(own.mapInArrow(_pack(steps, features), "x binary, y binary"))
    moments = _total(blocks, lambda x, y: np.concatenate([[x.shape[0] * steps], x.sum(axis=(0, 1)), (x * x).sum(axis=(0, 1))]), steps, features)
    if not len(moments):
        return None
    mean = moments[1 : 1 + features] / moments[0]
    spread = np.sqrt(np.maximum(moments[1 + features :] / moments[0] - mean**2, 0))
    scale = np.where(spread > 1e-12 * np.maximum(1, np.abs(mean)), spread, 1.0)
    head = Head(steps, features, kind, size, stride, width, tuple(mean.tolist()), tuple(scale.tolist()))
    w = head.begin(seed)
    m, v, losses = np.zeros_like(w), np.zeros_like(w), []
    for t in range(1, rounds + 1):
        s = _total(blocks, lambda x, y, w=w: loss_and_gradient(head, w, x, y), steps, features)
        losses.append(float(s[1] / s[0]))
        g = s[2:] / s[0] + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return replace(head, weights=w, losses=tuple(losses))


def predict(rows: DataFrame, head: Head, seq: str = "seq") -> DataFrame:
    """`rows` with `outputs`: three probabilities (down, up, neither), or three quantiles in ascending order; null where the
    sequence isn't usable. A column of that name is replaced."""
    kept = [c for c in rows.columns if c != "outputs"]
    x = F.col(f"`{seq}`").cast("array<array<double>>")
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("p"), F.when(_usable(x, head.steps, head.features), x).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.asarray(batch.column(1).is_valid())
            out = np.full((len(good), 3), np.nan)
            if good.any():
                z = head.outputs(_tensor(batch.column(1).filter(pa.array(good)), head.steps, head.features))
                out[good] = softmax(z) if head.kind == "softmax" else np.sort(z, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(good) + 1, 3), pa.int32()), pa.array(out.ravel()), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["p", "outputs"])

    schema = StructType([own.schema["p"], *StructType.fromDDL("outputs array<double>").fields])
    return own.mapInArrow(run, schema).select("p.*", "outputs")


def directed(rows: DataFrame, head: Head) -> DataFrame:
    """`rows` of `predict` with direction (1, -1, 0) and confidence: of classes the likelier of up and down and its
    probability; of quantiles the sign of the middle one, and how far it is from 0 for their spread."""
    o = F.col("outputs")
    if head.kind == "softmax":
        direction = F.signum(o[UP] - o[DOWN])
        return rows.withColumns({"direction": direction.cast("int"), "confidence": F.greatest(o[UP], o[DOWN])})
    return rows.withColumns({"direction": F.signum(o[1]).cast("int"), "confidence": quantile_confidence(o[0], o[1], o[2])})


def pinball_by_quantile(rows: DataFrame, label: str, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """(quantile, loss, below): the mean pinball loss of each output against `label`, and the share of labels at or below it."""
    y, o = F.col(label).cast("double"), F.col("outputs")
    each = F.array(*[F.struct(F.lit(q).alias("quantile"), F.greatest((y - o[i]) * q, (y - o[i]) * (q - 1)).alias("loss"), (y <= o[i]).cast("double").alias("below")) for i, q in enumerate(quantiles)])
    return rows.where(y.isNotNull() & o.isNotNull()).select(F.explode(each).alias("e")).groupBy("e.quantile").agg(F.avg("e.loss").alias("loss"), F.avg("e.below").alias("below"))
