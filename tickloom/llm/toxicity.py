"""Operator 6: toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic texts (P) and a sample of all texts (U), labelled or not,
by the risk

    prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

where the second part, the risk on the negatives hidden in U, can't be negative; where it is, the step goes the other
way. Features are words and the beginnings of longer words, lower-cased in ASCII, each at three levels of count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import kernels as K
from .runtime import quoted, small_batches

#: Bounds of the training sample, in documents; taken in the order of a hash of the id.
MOST_TOXIC, MOST_UNLABELLED = 4000, 8000
#: Features that the classifier keeps, by the distance of their frequencies in P and U: so many for each document of P,
#: and so many at most.
FEATURES_EACH, MOST_FEATURES = 8, 3000
#: Shrinkage of the weights, over the size of P.
DECAY = 0.06
#: Beginnings of words, in bytes.
PREFIXES = range(4, 13)
LEVELS = (1, 2, 4)
#: Text bytes whose features are counted at once.
CHUNK = 1 << 20
THRESHOLD = 0.3

# Word bytes: ASCII letters and everything beyond ASCII.
_BREAK = np.ones(256, bool)
_BREAK[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, the distinct word that each belongs to, the distinct word of each token, first token of each text)."""
    low = _LOWER[data]
    starts, ends, first = K.spans(low, off, _BREAK)
    words, where, index = np.unique(K.span_hash(low, starts, ends), return_index=True, return_inverse=True)
    s, e = starts[where], ends[where]
    hashes, of = [words], [np.arange(len(words))]
    for n in PREFIXES:
        longer = np.flatnonzero(e - s > n)
        hashes.append(K.mix64(K.span_hash(low, s[longer], s[longer] + n) + K.U64(n)))
        of.append(longer)
    return np.concatenate(hashes), np.concatenate(of), index, first


def counted(data: np.ndarray, off: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of each text's features, and words of each text.

    With sorted `known` hashes, a feature is a place among these and others are passed over; else it is its hash.
    """
    hashes, of, index, first = features(data, off)
    n_words = np.diff(first)
    if known is not None:
        at = np.searchsorted(known, hashes)
        at[at == len(known)] = 0
        hit = (known[at] == hashes) if len(known) else np.zeros(len(hashes), bool)
        values, of = at[hit].astype(np.uint64), of[hit]
    else:
        values = hashes
    order = np.argsort(of, kind="stable")
    values, of = values[order], of[order]
    n_distinct = int(index.max()) + 1 if len(index) else 0
    size = np.bincount(of, minlength=n_distinct)
    begin = np.cumsum(size) - size
    use = np.flatnonzero(size[index]) if n_distinct else np.zeros(0, int)
    token = index[use]
    text = np.repeat(np.arange(len(off) - 1), n_words)[use]
    value = values[K.ragged(begin[token], size[token])]
    text = np.repeat(text, size[token])
    if not len(value):
        return text, value, np.zeros(0, np.int64), n_words
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.append(True, (text[1:] != text[:-1]) | (value[1:] != value[:-1]))
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(new))), n_words


@dataclass
class Model:
    """known: sorted feature hashes; weights: one for each feature and level; then the length's, and the bias."""

    known: np.ndarray
    weights: np.ndarray
    length: float
    bias: float

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        text, value, count, n_words = counted(data, off, self.known)
        raw = sum((np.bincount(text, weights=self.weights[level, value.astype(int)] * (count >= least), minlength=len(off) - 1) for level, least in enumerate(LEVELS)), np.zeros(len(off) - 1))
        return 1 / (1 + np.exp(-np.clip(raw + self.length * np.log1p(n_words) + self.bias, -30, 30)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def nnpu(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n_cols: int, toxic: np.ndarray, prior: float, steps: int = 200, rate: float = 0.08, decay: float = 0.0) -> np.ndarray:
    """Weights of a linear classifier with the logistic loss, by Adam on all rows at once; toxic: P, else U."""
    n = len(toxic)
    w, m, v = np.zeros(n_cols), np.zeros(n_cols), np.zeros(n_cols)
    w[-1] = np.log(prior / (1 - prior))
    share_p, share_u = toxic / max(1, toxic.sum()), ~toxic / max(1, (~toxic).sum())
    for step in range(1, steps + 1):
        f = np.bincount(rows, weights=w[cols] * values, minlength=n)
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        soft = np.logaddexp(0, f)  # loss of f as a negative
        hidden = share_u @ soft - prior * (share_p @ soft)
        back = (share_u - prior * share_p) * p
        each = prior * share_p * (p - 1) + back if hidden >= 0 else -back
        g = np.bincount(cols, weights=each[rows] * values, minlength=n_cols)
        g[:-2] += decay * w[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def document_frequencies(texts: DataFrame, known: np.ndarray) -> tuple[int, dict[int, int]]:
    """(number of texts, number of texts that have each known feature), over all rows; the driver gets one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for i, j, data, off in K.chunks(batch.column(0), CHUNK):
                seen += np.bincount(counted(data, off, known)[1].astype(np.int64), minlength=len(known))
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.append(known.view(np.int64), 0)), pa.array(np.append(np.zeros(len(known), bool), True)), pa.array(np.append(seen, n))], names=["feature", "total", "n"])

    found = texts.mapInArrow(K.lean(run), "feature long, total boolean, n long").groupBy("feature", "total").agg(F.sum("n").alias("n")).collect()
    return sum(r["n"] for r in found if r["total"]), {r["feature"]: r["n"] for r in found if not r["total"]}


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model | None:
    """A model from the rows outside the held-out fold; None if none of them is confirmed toxic.

    The rows are sorted, so that the same data give the same model. The class prior is the share of toxic rows among
    the labelled ones, or what the best features' frequencies in all documents leave room for, if that is less.
    The driver takes MOST_TOXIC + MOST_UNLABELLED rows of counts of MOST_FEATURES features at most, and two sums.
    Feature frequencies are counted in Spark. Null labels and ids are passed over. Of rows that share an id one is taken, so
    that no repeated id makes the sample larger; ids of labels and documents have one type.
    """
    small_batches(docs.sparkSession)
    known_labels = labels.where(~held_out(quoted(key)) & quoted(key).isNotNull() & quoted(toxic).isNotNull()).groupBy(quoted(key).alias("id")).agg(F.max(quoted(toxic)).alias("y"))
    n, n_toxic = known_labels.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("y") == 1, 1)), F.lit(0))).first()
    if not n_toxic:
        return None
    prior = min(max(n_toxic / n, 1e-3), 0.5)
    draw = F.xxhash64("id")
    p = [r["id"] for r in known_labels.where("y = 1").select("id").orderBy(draw, "id").limit(MOST_TOXIC).collect()]
    ids = docs.select(quoted(key).alias("id")).where(~held_out(F.col("id")) & F.col("id").isNotNull()).distinct()
    u = [r["id"] for r in ids.orderBy(draw, "id").limit(MOST_UNLABELLED).collect()]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(i, 1) for i in p] + [(i, 0) for i in u], StructType([StructField("id", docs.schema[key].dataType), StructField("kind", IntegerType())]))
    sample = docs.select(quoted(key).alias("id"), quoted(text).alias("text")).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("kind", "id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("kind", "t.text")  # one row of an id

    def count(known: np.ndarray | None, levels: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, off in K.chunks(batch.column(1), CHUNK):
                    kind = batch.column(0).slice(i, j - i)
                    at, value, times, n_words = counted(data, off, known)
                    if not levels:
                        yield pa.RecordBatch.from_arrays([kind.take(pa.array(at)), pa.array(value.view(np.int64))], names=["kind", "feature"])
                        continue
                    end = np.searchsorted(at, np.arange(j - i + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([kind, pa.array(n_words, pa.int64()), *[pa.ListArray.from_arrays(pa.array(end), pa.array(x.astype(np.int32))) for x in (value, times)]], names=["kind", "n_words", "features", "counts"])

        return run

    seen = sample.mapInArrow(K.lean(count(None, False)), "kind int, feature long").groupBy("feature").agg(F.sum("kind").alias("p"), F.sum(1 - F.col("kind")).alias("u"))
    share_p, share_u = (F.col("p") + 0.5 * prior) / len(p), (F.col("u") + 0.5) / max(1, len(u))
    spread = F.sqrt(share_p / len(p) + share_u / max(1, len(u)))
    n_features = min(MOST_FEATURES, FEATURES_EACH * len(p))
    best = seen.where("p >= 2").orderBy(F.desc(F.abs(share_p - share_u) / spread), "feature").limit(n_features)
    picked = best.select("feature", "p", "u").collect()
    known = np.sort(np.array([r["feature"] for r in picked], np.int64).view(np.uint64))
    # A share s of P and t of all documents have a feature; t is at least prior * s, so t / s bounds the prior from above.
    often = {r["feature"]: r["p"] for r in picked if r["p"] >= max(10, len(p) / 20)}
    if often:
        outside = docs.where(~held_out(quoted(key))).select(quoted(text).alias("text"))
        n_docs, in_docs = document_frequencies(outside, np.sort(np.array([*often], np.int64).view(np.uint64)))
        bounds = [(n + 2 * n**0.5 + 1) / max(1, n_docs) * len(p) / often[f] for f, n in in_docs.items()]
        prior = max(min([prior, *bounds]), 1e-3)
    table = sample.mapInArrow(K.lean(count(known, True)), "kind int, n_words long, features array<int>, counts array<int>").orderBy("kind", "n_words", "features", "counts").toArrow()
    if not table.num_rows:
        return None
    kind = table.column("kind").to_numpy()
    lists = table.column("features").combine_chunks()
    size = np.diff(np.asarray(lists.offsets))
    feature, times = lists.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy()
    row, k = np.repeat(np.arange(len(kind)), size), len(known)
    rows, cols, values = [], [], []
    for level, least in enumerate(LEVELS):
        on = times >= least
        rows.append(row[on])
        cols.append(level * k + feature[on])
        values.append(np.ones(int(on.sum())))
    every = np.arange(len(kind))
    rows += [every, every]
    cols += [np.full(len(kind), len(LEVELS) * k), np.full(len(kind), len(LEVELS) * k + 1)]
    values += [np.log1p(table.column("n_words").to_numpy()), np.ones(len(kind))]
    w = nnpu(np.concatenate(rows), np.concatenate(cols), np.concatenate(values), len(LEVELS) * k + 2, kind == 1, prior, decay=DECAY / len(p))
    return Model(known, w[:-2].reshape(len(LEVELS), k), float(w[-2]), float(w[-1]))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with a column `score` (a column of that name is replaced); without a model all scores are 0.

    Null and empty texts are scored as texts without words. Rows stay where they are.
    """
    kept = [c for c in docs.columns if c != "score"]
    small_batches(docs.sparkSession)
    if model is None:
        return docs.select(*map(quoted, kept), F.lit(0.0).alias("score"))
    schema = docs.select(*map(quoted, kept)).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            for i, j, data, off in K.chunks(batch.column(at), CHUNK):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(model.score(data, off))], names=schema.names)

    return docs.select(*map(quoted, kept)).mapInArrow(K.lean(run), schema)
