"""The corpus pipeline: five stages from raw documents to token ids, each written as Parquet and read by the next.

All stages take any number of rows, also none, and other columns than those of `documents`, which they leave out. A null
text counts as empty, a null source is one of its own. Repeated rows are documents of their own until near duplicates go.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import bpe, line_dedup, mixing, near_dup, queries, toxicity
from tickloom.llm.runtime import release, stored, tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks as toxic go. Without toxic examples all stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in three documents or more stay in one of them. No document goes; n_chars follows the text, and a
    null text becomes an empty one."""
    found = line_dedup.line_dedup(docs.select(*COLUMNS))
    return found.select("p.doc_id", F.col("kept_text").alias("text"), "p.lang", "p.source", F.length("kept_text").cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least id (of a class without any id, one of
    its texts). Texts without words are one class."""
    return near_dup.first_of_classes(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes its first word: 0, 1 or 2 times, and then whole.

    So documents stay whole: the words of a source come near its target, by the documents that a block's border cuts.
    A document of which no copy begins in the mixture goes, and with it those without words. Rows with one id, text and
    source share the times that they were taken together, none more than once more than another.
    """
    totals = mixing.mix(docs).totals().where("times > 0").groupBy(F.col("id").alias("i"), F.col("tie").alias("t"), F.col("source").alias("s")).agg(F.sum("times").alias("times"))
    # Shares are made without texts. Rows that are equal in all are one row of their table, and are made one where they are.
    told = docs.select(F.col("doc_id").alias("i2"), F.xxhash64("text").alias("t2"), F.col("source").alias("s2"), F.col("lang").alias("l2"), F.col("n_chars").alias("n2"))
    told = told.groupBy(*told.columns).agg(F.count("*").alias("rows"))
    alike = Window.partitionBy("i2", "t2", "s2")
    before = F.sum("rows").over(alike.orderBy("l2", "n2").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    told = told.withColumns({"before": before, "all": F.sum("rows").over(alike)})
    each, more = F.floor(F.col("times") / F.col("all")), F.col("times") % F.col("all")
    copies = each * F.col("rows") + F.greatest(F.lit(0), F.least(F.col("rows"), more - F.col("before")))
    shares = told.join(totals, _same({"i2": "i", "t2": "t", "s2": "s"})).select("i2", "t2", "s2", "l2", "n2", "rows", copies.cast("int").alias("copies")).where("copies > 0")
    own = docs.select(*COLUMNS, F.xxhash64("text").alias("tie")).join(shares, _same({"doc_id": "i2", "tie": "t2", "source": "s2", "lang": "l2", "n_chars": "n2"})).select(*COLUMNS, "rows", "copies")
    taken = own.where("rows = 1").unionByName(own.where("rows > 1").dropDuplicates([*COLUMNS]))
    return taken.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def _same(names: dict[str, str]) -> Column:
    """Columns that are equal, null to null."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()])


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids): each document's token ids, with digests of them and of the
    text decoded from them."""
    return bpe.round_trip(docs, queries.tokenizer("byte_bpe_multi_50k.tiktoken"), ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encode_stage),
]

#: The stages of learning, near duplicates and BPE have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage has written for itself, and its input, go once its result stands."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        before = {*tables()} - {*done}
        docs = stored(stage(spark, docs, sf_dir))
        own = [t for t in tables() if t not in before]
        release(spark, own[:-1])
        done = own[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
