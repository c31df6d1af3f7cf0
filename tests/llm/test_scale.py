"""What grows, what breaks off, and what repeats: copies of small tables, index calls that fail, ids that repeat."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA
from tests.llm.test_operators import brute_lines, lines_of, texts
from tickloom.llm import line_dedup, toxicity


def test_copies_of_the_exact_table_are_linear(spark):
    """Hot keys times parts would grow with the square of the postings; keys meet those parts that hold them."""
    seen = []
    for n in (2000, 4000, 8000):
        parts = n // 250
        rows = spark.range(n).select(F.pmod("id", F.lit(n // 4)).alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("tie"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
        rows = rows.unionByName(rows.withColumn("k1", F.lit(-1).cast("long")))  # one key in all documents
        hot = rows.groupBy("k1", "k2").agg(F.max("doc_id").alias("keeper"))
        assert line_dedup.confirmed(rows, hot).count() == 2 * n
        copies = rows.select("k1", "k2", "part").distinct().count()
        assert copies <= n + parts  # a copy for each posting at most, and for each part of the common key
        seen.append(hot.count() * parts / copies)
    assert seen[2] > 1.5 * seen[1] > 1.5 * seen[0] > 1.5  # what a copy for each part and key would cost


@pytest.mark.parametrize("fails", range(4))
def test_an_index_call_that_breaks_off_can_be_repeated(spark, monkeypatch, fails):
    """Each of the writes of a call, the commit among them, fails once; then the call is made again."""
    line = "this line stands in several documents"
    docs = spark.createDataFrame([(i, f"{line}\nown line {i} of this document, long enough", "en", "s", 1) for i in range(6)], SCHEMA)
    index = line_dedup.LineIndex(spark)
    index.insert(docs.where("doc_id < 2"))
    before, written, real = index.committed(), [], DataFrameWriter.parquet

    def parquet(self, path, *more, **options):
        if path.startswith(index.path):
            written.append(path)
            if len(written) == fails + 1:
                raise OSError("lost")
        return real(self, path, *more, **options)

    for call, rest in ((lambda: index.insert(docs), docs), (lambda: index.delete(docs.where("doc_id in (4, 5)").select("doc_id")), docs.where("doc_id < 4"))):
        written.clear()
        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
        with pytest.raises(OSError, match="lost"):
            call()
        monkeypatch.setattr(DataFrameWriter, "parquet", real)
        assert index.committed() == before
        again = line_dedup.LineIndex(spark, index.path)  # as after a restart
        index = again
        call()
        before = index.committed()
        assert lines_of(index.apply(rest)) == brute_lines(texts(rest))
        assert index.counts().agg(F.max("refs")).first()[0] == rest.count()


def test_repeated_ids_make_no_larger_sample(spark, monkeypatch):
    """One id 30,000 times: the driver's table holds a row for each chosen id."""
    bad, good = "awful nasty vile words here again and again", "the river runs past the quiet village and the mill"
    rows = [(i, bad if i % 4 == 0 else good) for i in range(1, 401)] + [(1, good)] * 30_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 401)], "doc_id long, toxic int")
    taken, real = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: taken.append(real(self)) or taken[-1])
    model = toxicity.train(docs, labels)
    monkeypatch.setattr(type(docs), "toArrow", real)
    assert sum(t.num_rows for t in taken) <= 2 * 400
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id > 300"), model).collect()}
    assert min(s for i, s in got.items() if i % 4 == 0) > max(s for i, s in got.items() if i % 4)


def test_ids_that_are_no_numbers(spark):
    bad, good = "awful nasty vile words here again and again", "the river runs past the quiet village and the mill"
    docs = spark.createDataFrame([(f"d{i}", bad if i % 4 == 0 else good) for i in range(200)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 4 == 0)) for i in range(200)], "doc_id string, toxic int")
    assert toxicity.train(docs, labels) is not None


def test_lean_workers_give_memory_back():
    """What a batch's work has freed goes back to the system, though small pieces of it are still in use."""
    import re

    from tickloom.llm import kernels as K

    def held() -> float:
        with open("/proc/self/smaps_rollup") as f:
            return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) / 1024

    kept, most = [], []

    def run(batches):
        for batch in batches:
            many = [np.ones(8000) for _ in range(3000)]  # 190 MB in pieces of 64 KB
            kept.extend(many[::100])
            most.append(held())
            del many
            yield batch

    assert list(K.lean(run)(iter([1, 2]))) == [1, 2]
    assert held() < max(most) - 150
