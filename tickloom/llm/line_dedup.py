"""Operator 8: line dedup that can be taken back.

A line's key is the line without white space at its ends and with A-Z lowered; keys are told apart by 128-bit
hashes. Exact reference counts tell in how many documents a key stands; sharded cuckoo filters hold the keys whose
count has reached the threshold. Postings (key, document) meet the filters shard by shard, and only those that may be
hot go on to the exact table, which confirms them and names the document that keeps the line.

`LineIndex` keeps postings, counts and filters between calls. An insertion or deletion of documents changes the counts
by the difference, puts keys that reach the threshold into the stored filters and takes out those that fall below it, so
a deleted document's lines stop counting and their copies elsewhere come back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .cuckoo import CuckooFilter
from .runtime import payload, quoted, release, shared_path, shuffle_partitions, stored, text_bytes

STRIP = bytes([0x20, *range(0x09, 0x0E)])
#: Keys of one filter shard (2.7 MB), and postings that meet it in one task.
SHARD_KEYS, PROBED = 1 << 20, 1 << 21
#: Postings of one part of the exact table, and the least number of parts: so many tasks may share a common line.
EXACT, LEAST_PARTS = 1 << 17, 16
#: Text bytes whose lines are cut at once.
CHUNK = 1 << 20
KEY = ["k1", "k2"]


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """The 128-bit key of each line; None for keys of fewer than `least` code points."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(STRIP).lower()
        if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def tie(text: Column) -> Column:
    """Tells documents of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def postings(docs: DataFrame, least: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, doc_id, tie), once for each key and document row; `tie` stands for the row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, off in K.chunks(batch.column(1), CHUNK):
                keys, at, body, cuts = [], [], data.tobytes(), off.tolist()
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), first):
                    own = {*line_keys(body[a:b], least)} - {None}
                    keys += own
                    at += [i] * len(own)
                both, rows = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2), pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column(0).take(rows), batch.column(2).take(rows)], names=[*KEY, "doc_id", "tie"])

    rows = docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text"), tie(quoted(text)).alias("tie"))
    return rows.mapInArrow(K.lean(run), "k1 long, k2 long, doc_id long, tie long")


def reference_counts(rows: DataFrame, least_docs: int = 1) -> DataFrame:
    """(k1, k2, refs, keeper) of keys in at least `least_docs` documents, the keeper being the largest id.

    Distinct pairs are dealt out by key and document, and counted before they meet by key, so that a line in a third
    of all documents costs one row for each task.
    """
    pairs = rows.select(*KEY, "doc_id").dropDuplicates()
    return pairs.groupBy(*KEY).agg(F.count("*").alias("refs"), F.max("doc_id").alias("keeper")).where(F.col("refs") >= least_docs)


def shard(n_shards: int) -> Column:
    return F.pmod("k2", F.lit(n_shards)).cast("int")


def update_filters(filters: DataFrame, changes: DataFrame, n_shards: int) -> DataFrame:
    """(shard, filter) after `changes` (k1, k2, up: true for a key to put in, false for one to take out) to `filters`.

    A shard without a filter gets one with room for its keys, or for SHARD_KEYS of them if there are fewer.
    """

    def run(key: tuple[pa.Scalar, ...], old: pa.Table, new: pa.Table) -> pa.Table:
        f = CuckooFilter.from_bytes(old.column("filter")[0].as_py()) if old.num_rows else CuckooFilter.for_keys(max(SHARD_KEYS, new.num_rows))
        keys, up = new.column("k1").to_numpy().view(np.uint64), new.column("up").to_numpy(zero_copy_only=False)
        f.delete(keys[~up])
        f.insert(keys[up])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([f.to_bytes()], pa.binary())})

    told = changes.select(shard(n_shards).alias("shard"), "k1", "up")
    return filters.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(run, "shard int, filter binary")


def build_filters(hot: DataFrame, n_shards: int) -> DataFrame:
    """(shard, filter): a cuckoo filter of the keys of each shard."""
    none = hot.sparkSession.createDataFrame([], "shard int, filter binary")
    return update_filters(none, hot.select(*KEY, F.lit(True).alias("up")), n_shards)


def probe(rows: DataFrame, filters: DataFrame, n_shards: int, n_rows: int) -> DataFrame:
    """The postings whose key may be in its shard's filter.

    Postings are dealt by shard and, inside a shard, by document, so that no common line makes a task large; a
    filter, which is small, goes to all parts of its shard.
    """
    parts = max(1, math.ceil(n_rows / n_shards / PROBED))

    def run(key: tuple[pa.Scalar, ...], told: pa.Table, own: pa.Table) -> pa.Table:
        told = told.select([*KEY, "doc_id", "tie"])
        if not told.num_rows or not own.num_rows:
            return told.slice(0, 0)
        f = CuckooFilter.from_bytes(own.column("filter")[0].as_py())
        return told.filter(pa.array(f.contains(told.column("k1").to_numpy().view(np.uint64))))

    told = rows.select(*KEY, "doc_id", "tie", shard(n_shards).alias("shard"), F.pmod(F.xxhash64("doc_id", "tie"), F.lit(parts)).cast("int").alias("part"))
    own = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return told.groupBy("shard", "part").cogroup(own.groupBy("shard", "part")).applyInArrow(run, "k1 long, k2 long, doc_id long, tie long")


def _cut(schema_names: list[str], least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in K.chunks(batch.column(1), CHUNK):
                n_lines, n_dropped, kept, text, cuts = [], [], [], data.tobytes(), off.tolist()
                for a, b, drop in zip(cuts[:-1], cuts[1:], batch.column(2).slice(i, j - i).to_pylist(), strict=True):
                    body = text[a:b]
                    lines = body.split(b"\n")
                    n_lines.append(len(lines))
                    if drop:
                        gone = {pack("<qq", *k) for k in drop}
                        lines = [line for line, k in zip(lines, line_keys(body, least), strict=True) if k not in gone]
                    n_dropped.append(n_lines[-1] - len(lines))
                    kept.append(b"\n".join(lines) if drop else body)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=schema_names)

    return run


def apply_drops(docs: DataFrame, drops: DataFrame, least: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` as a struct `p`, with n_lines (before), n_dropped and kept_text; drops: (k1, k2, doc_id, tie).

    A row's drops are at most its own lines: rows of one id with different texts have lists of their own. Rows and
    drops meet by a 64-bit hash of both; should two documents share it, they share their lists, which matters only if
    one keeps a line that the other loses.
    """
    parts = shuffle_partitions(docs.sparkSession, text_bytes(docs, text))
    each = drops.groupBy(F.xxhash64("doc_id", "tie").alias("of")).agg(F.collect_set(F.array(*KEY)).alias("drops")).repartition(parts, "of")
    rows = docs.select(payload(docs).alias("p"), quoted(text).alias("text"), F.xxhash64(quoted(key).cast("long"), tie(quoted(text))).alias("row")).repartition(parts, "row")
    joined = rows.join(each, F.col("row") == F.col("of"), "left").select("p", "text", "drops")
    schema = docs.select(payload(docs).alias("p")).withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long"), "kept_text": F.lit("")}).schema
    return joined.mapInArrow(K.lean(_cut(schema.names, least)), schema)


def shards_for(n_keys: int) -> int:
    return max(1, -(-n_keys // SHARD_KEYS))


def find_drops(rows: DataFrame, hot: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
    """(k1, k2, doc_id, tie) that lose their line: the key is hot, and this document isn't its keeper.

    rows: stored postings; hot: (k1, k2, keeper); filters: of the hot keys, and perhaps more. What passes the filters
    is confirmed by the exact table. A hot key's postings are many: they are dealt out by document as well, and its one
    row in the table goes to those parts that hold one of them.
    """
    n = rows.count()
    parts = max(LEAST_PARTS, math.ceil(n / EXACT))
    maybe = stored(probe(rows, filters, n_shards, n).withColumn("part", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(parts))))
    return confirmed(maybe, hot).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select(*KEY, "doc_id", "tie")


def confirmed(maybe: DataFrame, hot: DataFrame) -> DataFrame:
    """`maybe` (k1, k2, part ...) with the keeper of its key, of the keys that are hot."""
    held = maybe.select(*KEY, "part").distinct()  # no more rows than postings, and for each part one
    exact = held.join(hot.select(*KEY, "keeper"), [*KEY])
    return maybe.join(exact, [*KEY, "part"])


def line_dedup(docs: DataFrame, least_docs: int = 3, least: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` as a struct `p`, with n_lines, n_dropped and kept_text.

    Lines end at \\n; a null or empty text is one empty line. Keys of `least` code points or more in `least_docs`
    documents or more lose all their lines except in the largest id. Documents without an id count as one, below all
    others; rows of one id are one document. Columns of any names may come along. The order of rows is not kept.
    """
    rows = stored(postings(docs, least, key, text))
    hot = stored(reference_counts(rows, least_docs))
    n_shards = shards_for(hot.count())
    return apply_drops(docs, find_drops(rows, hot, build_filters(hot, n_shards), n_shards), least, key, text)


class LineIndex:
    """Incremental state in a folder, all of it Spark tables: `ledger`, postings with +1 where they came and -1 where
    they went; `counts`, changes of the reference counts; and `filters`, all anew after each change.

    Each call writes a version of all three, and then one row to `commits`, which makes it count; readers see committed
    versions only. So a call that broke off has changed nothing, can be repeated, and is then written over.

    A document is known by its id; rows of one id are one document, and a null id is one, too. All calls can be
    repeated: an insertion that is there already, and a deletion of what isn't, change nothing. A document that is
    inserted with another text replaces the one before. Null and empty texts have no postings. An index without any
    document drops no line.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, least_docs: int = 3, least: int = 20):
        self.spark, self.path, self.least_docs, self.least = spark, path or shared_path(spark), least_docs, least

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def committed(self) -> tuple[int, int]:
        """The last version that counts (0 before the first) and its number of shards."""
        last = self._read("commits", "version long, n_shards int").agg(F.max(F.struct("version", "n_shards"))).first()[0]
        return (0, 1) if last is None else (last["version"], last["n_shards"])

    def ledger(self) -> DataFrame:
        rows = self._read("ledger", "k1 long, k2 long, doc_id long, tie long, change int, version long")
        return rows.where(F.col("version") <= self.committed()[0]).drop("version")

    def alive(self) -> DataFrame:
        """(k1, k2, doc_id, tie) of documents that are in."""
        return _alive(self.ledger())

    def counts(self) -> DataFrame:
        """(k1, k2, refs): documents that hold a key, of keys that any holds."""
        rows = self._read("counts", "k1 long, k2 long, change long, version long").where(F.col("version") <= self.committed()[0])
        return rows.groupBy(*KEY).agg(F.sum("change").alias("refs")).where("refs > 0")

    def filters(self) -> tuple[DataFrame, int]:
        """The filters (shard, filter) of the keys in `least_docs` documents or more, and the number of shards."""
        version, n_shards = self.committed()
        rows = self._read("filters", "shard int, filter binary, version long")
        return rows.where(F.col("version") == version).select("shard", "filter"), n_shards

    def _change(self, came: DataFrame, went: DataFrame) -> None:
        """Write postings that came and that went. The counts' change is a document's, whatever texts it has."""
        changes = stored(came.withColumn("change", F.lit(1)).unionByName(went.withColumn("change", F.lit(-1))).select(*KEY, "doc_id", "tie", "change"))
        if changes.isEmpty():
            return
        touched = changes.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("doc_id").alias("d")).distinct()
        same = (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")) & F.col("doc_id").eqNullSafe(F.col("d"))
        before = stored(self.ledger().join(touched, same, "left_semi"))
        holders = lambda rows, x: _alive(rows).select(*KEY, "doc_id").distinct().withColumn("x", F.lit(x))
        both = holders(before.unionByName(changes), 1).unionByName(holders(before, -1))
        delta = stored(both.groupBy(*KEY).agg(F.sum("x").alias("change")).where("change <> 0"))
        old = self.counts().join(delta.select(*KEY), KEY, "left_semi")
        was = F.coalesce("refs", F.lit(0))
        crossing = delta.join(old, KEY, "left").select(*KEY, was.alias("was"), (was + F.col("change")).alias("is"))
        crossing = stored(crossing.where((F.col("was") >= self.least_docs) != (F.col("is") >= self.least_docs)))
        version, n_shards = self.committed()
        own, _ = self.filters()
        up = F.col("is") >= self.least_docs
        hot = self.counts().where(F.col("refs") >= self.least_docs).select(*KEY)
        gain, loss = crossing.agg(F.count_if(up), F.count_if(~up)).first()
        needed = shards_for(hot.count() + gain - loss)
        if needed > n_shards:  # too full: all anew, in twice as many shards at least
            n_shards = max(needed, 2 * n_shards)
            made = build_filters(hot.join(crossing.where(~up), KEY, "left_anti").unionByName(crossing.where(up).select(*KEY)), n_shards)
        else:
            made = update_filters(own, crossing.select(*KEY, up.alias("up")), n_shards)
        version += 1
        for name, rows in (("ledger", changes), ("counts", delta), ("filters", made)):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")
        self._commit(version, n_shards)
        release(self.spark, [f"{self.path}/filters/version={version - 2}"])  # readers may still hold the last one

    def _commit(self, version: int, n_shards: int) -> None:
        self.spark.createDataFrame([(version, n_shards)], "version long, n_shards int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _of(self, ids: DataFrame) -> DataFrame:
        """Postings of the documents that have these ids."""
        wanted = ids.select(F.col("doc_id").cast("long").alias("wanted")).distinct()
        return self.alive().join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")

    def insert(self, docs: DataFrame) -> None:
        """Documents (doc_id, text); one that is in with another text is replaced."""
        new, held = stored(postings(docs, self.least).distinct()), stored(self._of(docs))
        self._change(_without(new, held), _without(held, new))

    def delete(self, ids: DataFrame) -> None:
        """ids: (doc_id); documents that aren't in change nothing."""
        held = stored(self._of(ids))
        self._change(held.limit(0), held)

    def apply(self, docs: DataFrame) -> DataFrame:
        """As `line_dedup`, for documents that are in, by the state as it is now."""
        filters, n_shards = self.filters()
        hot = self.counts().where(F.col("refs") >= self.least_docs).select(*KEY)
        keepers = self.alive().join(hot, KEY, "left_semi").groupBy(*KEY).agg(F.max("doc_id").alias("keeper"))
        return apply_drops(docs, find_drops(stored(postings(docs, self.least)), stored(keepers), filters, n_shards), self.least)


def _alive(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*KEY, "doc_id", "tie").agg(F.sum("change").alias("n")).where("n > 0").drop("n")


def _without(some: DataFrame, others: DataFrame) -> DataFrame:
    """Postings of `some` that aren't in `others`."""
    named = others.withColumnsRenamed({c: f"o_{c}" for c in others.columns})
    same = (F.col("k1") == F.col("o_k1")) & (F.col("k2") == F.col("o_k2")) & F.col("doc_id").eqNullSafe(F.col("o_doc_id")) & (F.col("tie") == F.col("o_tie"))
    return some.join(named, same, "left_anti")
