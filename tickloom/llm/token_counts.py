"""Operator 3: exact token counts for every context limit.

Documents are aggregated by their encoded length; the histogram has a row for each distinct length. Suffix sums over
it answer how many documents and tokens a limit touches: with C(L) documents and S(L) tokens at lengths above L, the
total is S(0), a truncated total is total - S(L) + L * C(L), and a quantile is the smallest length with few enough
documents above it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import quoted, stored
from .token_files import library_encoder

#: Lengths are summed in ranges of this many before the suffix sums, so that no task sees all distinct lengths.
RANGE = 128


def token_lengths(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """(n_tokens) of each document, by the tokenizers library, without special tokens. A null text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        for batch in batches:
            for _, _, data, off in K.chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(encoder.chunk(data, off)[1]), pa.int64())], names=["n_tokens"])

    return docs.select(quoted(text)).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): partial counts are made where the documents are, so a common length is no hot spot.

    It is stored, for what follows reads it several times and encoding is the dear part.
    """
    return stored(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """(n_tokens, n_docs, docs_above, tokens_above, truncated_total): the totals for a context limit of n_tokens.

    Sums run inside ranges of RANGE lengths, and over the ranges (one row each) behind them. Null lengths are
    dropped; an empty histogram stays empty.
    """
    bucket = F.floor(F.col("n_tokens") / RANGE)
    rows = histogram.where(F.col("n_tokens").isNotNull()).withColumn("bucket", bucket).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    ranges = rows.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    ranges = ranges.select("bucket", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_behind"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_behind"), F.sum("t").over(total).alias("total"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    above = rows.select("*", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("d"), F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("t")).join(ranges, "bucket")
    docs_above, tokens_above = F.col("d") + F.col("docs_behind"), F.col("t") + F.col("tokens_behind")
    return above.select(
        "n_tokens", "n_docs", docs_above.alias("docs_above"), tokens_above.alias("tokens_above"),
        (F.col("total") - tokens_above + F.col("n_tokens") * docs_above).alias("truncated_total"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, docs_above, tokens_above, truncated_total) of given limits, also between or beyond the lengths.

    Lengths over a limit L are those from the first length above it on: their sums are the suffix sums with it.
    """
    limits = [*dict.fromkeys(map(int, limits))]
    picked = [F.sum(F.when(F.col("n_tokens") > x, F.col(c)).otherwise(0)).alias(f"{c}_{i}") for i, x in enumerate(limits) for c in ("n_docs", "tokens")]
    one = sums.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).agg(F.sum("tokens").alias("total"), *picked)
    each = F.array(*[F.struct(F.lit(x).cast("long").alias("context_limit"), F.coalesce(F.col(f"n_docs_{i}"), F.lit(0)).alias("docs_above"), F.coalesce(F.col(f"tokens_{i}"), F.lit(0)).alias("tokens_above")) for i, x in enumerate(limits)])
    rows = one.select("total", F.explode(each).alias("x")).select("total", "x.*")
    return rows.select("context_limit", "docs_above", "tokens_above", (F.coalesce("total", F.lit(0)) - F.col("tokens_above") + F.col("context_limit") * F.col("docs_above")).alias("truncated_total"))


def quantiles(sums: DataFrame, at: Sequence[float]) -> DataFrame:
    """(q, n_tokens): the smallest length that at least a share q of the documents doesn't exceed."""
    docs = F.col("n_docs") + F.col("docs_above")
    n = sums.agg(F.max(docs).alias("n"))
    picks = [F.min(F.when(F.col("n") - F.col("docs_above") >= F.lit(float(q)) * F.col("n"), F.col("n_tokens"))) for q in at]
    rows = sums.join(F.broadcast(n)).agg(F.array(*[F.struct(F.lit(float(q)).alias("q"), p.alias("n_tokens")) for q, p in zip(at, picks, strict=True)]).alias("x"))
    return rows.select(F.explode("x").alias("x")).select("x.*").where(F.col("n_tokens").isNotNull())
