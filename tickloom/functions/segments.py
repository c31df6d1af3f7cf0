"""Recursive averages of long series in segments: a series is dealt out by weeks, and no task holds it.

An average e + alpha * (x - e) is an affine map of the average before: over a segment it is q ** rows * e + b, with q =
1 - alpha and b what the segment gives from 0. So segments are gone through alone, and give b, and their share of the
mean that the average begins with; their maps are composed along each series, a row a segment; and then each segment is
gone through once more, from what it begins with. An average of an average (a second stage) does so again, over the first
one's results. The rows are exchanged once a stage: both passes read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Arrays = list[np.ndarray]


@dataclass(frozen=True)
class Smooth:
    """The mean of n values from row `start` on, at the last of them; then e + alpha * (x - e)."""

    n: int
    alpha: float
    start: int = 0

    @property
    def at(self) -> int:
        return self.start + self.n - 1


@dataclass(frozen=True)
class Program:
    """What is averaged: `first(columns, before)` gives the inputs of `smooths`, from a segment's rows and the values of the row
    before it (NaN at the start); `second(averages, place)` those of `more`; `result(averages, second averages, place)` the outputs.
    place: numbers of the rows in their series, from 0."""

    first: Callable[[dict[str, np.ndarray], dict[str, float]], Arrays]
    smooths: tuple[Smooth, ...]
    result: Callable[[Arrays, Arrays, np.ndarray], Arrays]
    second: Callable[[Arrays, np.ndarray], Arrays] | None = None
    more: tuple[Smooth, ...] = ()


def path(x: np.ndarray, alpha: float, e: float) -> np.ndarray:
    """e + alpha * (x - e) along x, from e on: block by block, each a sum of inputs scaled by powers of 1 - alpha."""
    q, out = 1 - alpha, np.empty(len(x))
    if q <= 1e-12:  # each value itself, but missing from the first missing one on
        return np.where(np.logical_or.accumulate(np.isnan(x)) | np.isnan(e), np.nan, x)
    size = max(1, min(4096, int(18 / -np.log(q)))) if q < 1 else 4096  # powers stay below 1e8
    up = q ** -np.arange(1.0, size + 1)
    down = q ** np.arange(1.0, size + 1)
    for i in range(0, len(x), size):
        part = x[i : i + size]
        k = len(part)
        out[i : i + k] = down[:k] * (e + alpha * np.cumsum(part * up[:k]))
        e = out[i + k - 1]
    return out


def averaged(s: Smooth, x: np.ndarray, place: int, seed: float, carry: float) -> np.ndarray:
    """The average on a segment whose first row has this place: NaN before the row that it begins at."""
    out, at = np.full(len(x), np.nan), s.at - place
    if at < 0:
        return path(x, s.alpha, carry)
    if at < len(x):
        out[at] = seed
        out[at + 1 :] = path(x[at + 1 :], s.alpha, seed)
    return out


def _share(s: Smooth, x: np.ndarray, place: int) -> tuple[float, float, int]:
    """(b, sum, count): what a segment gives from 0 after the row that the average begins at, and its part of the first mean."""
    at = s.at - place
    rest = x if at < 0 else x[at + 1 :]
    own = x[max(0, s.start - place) : max(0, at + 1)]
    return (float(path(rest, s.alpha, 0.0)[-1]) if len(rest) else 0.0), float(own.sum()), len(own)


def _composed(smooths: Sequence[Smooth], rows: np.ndarray, place: np.ndarray, b: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, carries) of each smooth at the begin of each segment of one series, the segments in order."""
    seeds, carries = np.full((len(rows), len(smooths)), np.nan), np.full((len(rows), len(smooths)), np.nan)
    for k, s in enumerate(smooths):
        seed = sums[:, k].sum() / s.n if counts[:, k].sum() == s.n else np.nan
        seeds[:, k], e, q = seed, np.nan, 1 - s.alpha
        for i in range(len(rows)):
            carries[i, k] = e
            begins = s.at - place[i]
            if 0 <= begins < rows[i]:
                e = q ** (rows[i] - begins - 1) * seed + b[i, k]
            elif begins < 0:
                e = q ** rows[i] * e + b[i, k]
    return seeds, carries


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(table.column(name).cast(pa.float64()), float("nan")).to_numpy()


def _lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, width)


def with_programs(df: DataFrame, programs: Sequence[tuple[Sequence[str], Sequence[str], Program]], keys: Sequence[str], time: str) -> DataFrame:
    """`df` with the outputs of (outputs, inputs, program), each a double column; columns of these names are replaced.

    Rows are a series by `keys`, in the order of `time`, those without a time last. Missing values go in as NaN: an average is
    missing from there on. Missing results are null.
    """
    keys, names = [*keys], [o for out, _, _ in programs for o in out]
    inputs = [*dict.fromkeys(c for _, ins, _ in programs for c in ins)]
    kept = [c for c in df.columns if c not in names]
    smooths = [s for _, _, p in programs for s in p.smooths]
    more = [s for _, _, p in programs for s in p.more]
    segment = [*keys, "_stretch"]
    renamed = [f"_k{i}" for i in range(len(segment))]
    along = Window.partitionBy(*keys).orderBy(F.col("_stretch").asc_nulls_last())
    rows = df.withColumn("_stretch", F.date_trunc("week", F.col(time)).cast("timestamp_ntz"))
    last = F.max_by(F.struct(*[F.col(c).cast("double").alias(c) for c in inputs]), F.col(time))
    heads = rows.groupBy(*segment).agg(F.count("*").alias("_rows"), last.alias("_last"))
    heads = heads.withColumns({"_place": F.sum("_rows").over(along) - F.col("_rows"), "_before": F.lag("_last").over(along)})
    heads = heads.select(*segment, "_place", "_before")

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by([(time, "ascending")])

    def first(table: pa.Table, head: pa.Table) -> tuple[list[Arrays], int]:
        before = head.column("_before")[0].as_py() or {}
        before = {c: np.nan if before.get(c) is None else before[c] for c in inputs}
        columns = {c: _numbers(table, c) for c in inputs}
        return [p.first({c: columns[c] for c in ins}, before) for _, ins, p in programs], head.column("_place")[0].as_py()

    def told(head: pa.Table, n: int, place: int, wanted: Sequence[Smooth], xs: Arrays) -> pa.Table:
        b, sums, counts = zip(*[_share(s, x, place) for s, x in zip(wanted, xs, strict=True)], strict=True)
        lists = [pa.array([list(map(float, v))], pa.list_(pa.float64())) for v in (b, sums, counts)]
        return pa.table([*[head.column(c) for c in (renamed if renamed[0] in head.column_names else segment)], pa.array([n], pa.int64()), pa.array([place], pa.int64()), *lists], names=[*segment, "_rows", "_place", "_b", "_sums", "_counts"])

    def summary(key: tuple, table: pa.Table, head: pa.Table) -> pa.Table:
        xs, place = first(ordered(table), head)
        return told(head, table.num_rows, place, smooths, [x for own in xs for x in own])

    def compose(wanted: Sequence[Smooth]):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by([("_place", "ascending")])
            size = len(wanted)
            n, place = (table.column(c).to_numpy() for c in ("_rows", "_place"))
            seeds, carries = _composed(wanted, n, place, *[_lists(table.column(c), size) for c in ("_b", "_sums", "_counts")])
            lists = [pa.array(a.tolist(), pa.list_(pa.float64())) for a in (seeds, carries)]
            return pa.table([*[table.column(c) for c in segment], *lists], names=[*segment, "_seeds", "_carries"])

        return run

    def begun(xs: Arrays, wanted: Sequence[Smooth], place: int, begin: pa.Table) -> Arrays:
        seeds, carries = (begin.column(c)[0].as_py() for c in ("_seeds", "_carries"))
        return [averaged(s, x, place, seed, carry) for s, x, seed, carry in zip(wanted, xs, seeds, carries, strict=True)]

    def grouped(flat: Arrays, sizes: Sequence[int]) -> list[Arrays]:
        ends = np.cumsum([0, *sizes])
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def finished(table: pa.Table, ones: list[Arrays], twos: list[Arrays], place: np.ndarray) -> pa.Table:
        out = table.select(kept)
        for (outs, _, p), a, b in zip(programs, ones, twos, strict=True):
            for name, values in zip(outs, p.result(a, b, place), strict=True):
                out = out.append_column(name, pa.array(values, pa.float64(), mask=np.isnan(values)))
        return out

    one = [len(p.smooths) for _, _, p in programs]

    def final_first(key: tuple, table: pa.Table, begin: pa.Table) -> pa.Table:
        table = ordered(table)
        xs, place = first(table, begin)
        averages = begun([x for own in xs for x in own], smooths, place, begin)
        places = place + np.arange(table.num_rows)
        if not more:
            return finished(table, grouped(averages, one), [[] for _ in programs], places)
        out = table.select([*kept, "_stretch"]).append_column("_place", pa.array(places, pa.int64()))
        for k, a in enumerate(averages):
            out = out.append_column(f"_average{k}", pa.array(a))
        return out

    def second(table: pa.Table) -> tuple[list[Arrays], Arrays, np.ndarray]:
        place = table.column("_place").to_numpy()
        ones = grouped([table.column(f"_average{k}").to_numpy() for k in range(len(smooths))], one)
        return ones, [x for (_, _, p), a in zip(programs, ones, strict=True) if p.second for x in p.second(a, place)], place

    def summary_second(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("_place", "ascending")])
        _, xs, place = second(table)
        return told(table.slice(0, 1), table.num_rows, int(place[0]), more, xs)

    def final_second(key: tuple, table: pa.Table, begin: pa.Table) -> pa.Table:
        table = table.sort_by([("_place", "ascending")])
        ones, xs, place = second(table)
        return finished(table, ones, grouped(begun(xs, more, int(place[0]), begin), [len(p.more) for _, _, p in programs]), place)

    field = {f.name: f for f in rows.schema.fields}
    key_fields = [field[c] for c in segment]
    listed = lambda *cs: [T.StructField(c, T.ArrayType(T.DoubleType())) for c in cs]
    told_schema = T.StructType([*key_fields, T.StructField("_rows", T.LongType()), T.StructField("_place", T.LongType()), *listed("_b", "_sums", "_counts")])
    begin_schema = T.StructType([*key_fields, *listed("_seeds", "_carries")])
    done = T.StructType([*[field[c] for c in kept], *[T.StructField(o, T.DoubleType()) for o in names]])

    def cogrouped(left: DataFrame, right: DataFrame, f, schema: T.StructType) -> DataFrame:
        own = right.select(*[F.col(c).alias(k) for c, k in zip(segment, renamed, strict=True)], *[c for c in right.columns if c not in segment])
        return left.groupBy(*segment).cogroup(own.groupBy(*renamed)).applyInArrow(f, schema)

    def begins(told_: DataFrame, wanted: Sequence[Smooth]) -> DataFrame:
        return told_.groupBy(*keys).applyInArrow(compose(wanted), begin_schema)

    begin = begins(cogrouped(rows, heads, summary, told_schema), smooths)
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in segment]
    both = heads.alias("h").join(begin.alias("b"), same).select("h.*", "b._seeds", "b._carries")  # a row a segment
    if not more:
        return cogrouped(rows, both, final_first, done)
    middle = T.StructType([*[field[c] for c in kept], field["_stretch"], T.StructField("_place", T.LongType()), *[T.StructField(f"_average{k}", T.DoubleType()) for k in range(len(smooths))]])
    rows = cogrouped(rows, both, final_first, middle)
    begin = begins(rows.groupBy(*segment).applyInArrow(summary_second, told_schema), more)
    return cogrouped(rows, begin, final_second, done)
