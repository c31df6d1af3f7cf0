"""Operator 5: near-duplicate classes by DartMinHash.

Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked; classes are the
connected components. Exact copies are one node from the start. Plan:

1. Each text gets a DartMinHash signature of 125 coordinates, in 25 bands of 5; a pair at 0.8 shares no band with a
   chance of 5 in 100,000.
2. In every band's bucket each node is compared with a hub, exactly, by its shingle set; so the work is linear in
   the bucket. A bucket is dealt into parts, each with a hub of its own, and those are compared with the bucket's:
   no task holds a bucket, however many near copies there are. Links give components.
3. What a hub can't show is looked for in the buckets that still hold several components: there all pairs across
   components are compared, in tiles of bounded size, and a tile gives back a spanning forest only. So a link between
   different texts that share a bucket is lost only if their signatures agree in less than HOPE of the coordinates,
   which at 0.8 has a chance of 1 in 1,000,000,000; and no group is written out as pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .dart_minhash import signatures
from .runtime import payload, quoted, small_batches, stored

SHINGLE, BANDS, ROWS = 5, 25, 5
SIMILARITY = 0.8
#: Members of a bucket on each side of a tile.
TILE = 512
#: Nodes for each part that a bucket is dealt into, and the least number of parts.
PART, PARTS = 1 << 20, 16
#: Signatures that agree in less than this share are not compared exactly: 6 standard errors below 0.8.
HOPE = 0.58
#: Text bytes whose shingles are made at once.
CHUNK = 1 << 20


def node(text: Column) -> list[Column]:
    """(a, b): 128 bits of hash that stand for a text; all texts without words are the same, null among them."""
    body = F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit(""))
    return [F.xxhash64(body).alias("a"), F.xxhash64(F.lit("node"), body).alias("b")]


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, their counts, first of each text).

    Shingles are k consecutive words, unchanged. A text of fewer words has one shingle of all of them; one without
    words has none.
    """
    starts, ends, first = K.spans(data, off)
    words = K.span_hash(data, starts, ends)
    at, n = K.windows(words, first, k)
    hashes, text = K.rabin_karp(words, at, k), np.repeat(np.arange(len(n)), n)
    short = np.flatnonzero((n == 0) & (np.diff(first) > 0))
    if len(short):
        own = []
        for i in short:
            h = K.U64(0x1234_5678_9ABC_DEF1)
            for w in words[first[i] : first[i + 1]]:
                h = K.mix64(np.array([h ^ w]))[0]
            own.append(h)
        hashes, text = np.append(hashes, np.array(own, np.uint64)), np.append(text, short)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    at = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])))
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(text[at], np.arange(len(off)))


def sign(docs: DataFrame, key: str, text: str, weights: str) -> DataFrame:
    """(a, b, doc_id, bands, marks): band keys of each text, and its signature at 16 bits a coordinate."""
    schema = docs.select(quoted(key).alias("doc_id")).withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long"), "bands": F.lit(None).cast("array<bigint>"), "marks": F.lit(None).cast("binary")}).select("a", "b", "doc_id", "bands", "marks").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in K.chunks(batch.column(3), CHUNK):
                hashes, count, first = shingles(data, off)
                weight = count.astype(float) if weights == "count" else np.ones(len(count))
                sig = signatures(hashes, weight, first, BANDS * ROWS)
                parts = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
                band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
                for r in range(ROWS):
                    band = K.mix64(band * K.U64(0x9E3779B97F4A7C15) + parts[:, :, r])
                full = np.diff(first) > 0
                to = np.append(0, np.cumsum(np.where(full, BANDS, 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(to), pa.array(band[full].ravel().view(np.int64)))
                marks = sig.astype(np.uint16).tobytes()
                size = 2 * BANDS * ROWS
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:3], lists, pa.array([marks[x * size : (x + 1) * size] for x in range(j - i)], pa.binary())], names=schema.names)

    return docs.select(*node(quoted(text)), quoted(key).alias("doc_id"), quoted(text).alias("t")).mapInArrow(K.lean(run), schema)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(a, b, set) from (a, b, text): sorted 64-bit shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in K.chunks(batch.column(2), CHUNK):
                hashes, _, first = shingles(data, off)
                rows = K.binary_array(hashes.view(np.uint8), 8 * first)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:2], rows], names=["a", "b", "set"])

    return texts.mapInArrow(K.lean(run), "a long, b long, set binary")


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if len(x) > len(y):
        x, y = y, x
    both = int(K.member(x, y).sum())
    return both / (len(x) + len(y) - both)


def linked(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    return min(len(x), len(y)) >= least * max(len(x), len(y)) and jaccard(x, y) >= least


def verify(pairs: DataFrame, least: float) -> DataFrame:
    """(xa, xb, ya, yb) of the pairs (xa, xb, xset, ya, yb, yset) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (K.binary_column(batch.column(i)).to_pylist() for i in (2, 5))
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(one, two, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1, 3, 4)], names=["xa", "xb", "ya", "yb"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("xa", "xb", "xset", "ya", "yb", "yset").mapInArrow(K.lean(run), "xa long, xb long, ya long, yb long")


def components(links: DataFrame) -> DataFrame:
    """(a, b, ca, cb): each node of a link and the least node of its component.

    Small-star and large-star steps in turn (Kiveris and others, 2014), each stored; the number of rounds grows with
    the logarithm of the longest path, and no step sends a row to the driver.
    """
    pair = lambda x, y: F.struct(F.col(f"{x}a").alias("a"), F.col(f"{x}b").alias("b"))
    n = links.count()
    edges = stored(links.select(pair("x", 0).alias("u"), pair("y", 0).alias("v")).where("u != v").distinct(), rows=n)
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour to the least one around.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: the smaller neighbours and the node itself to the least of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, rows=2 * n)  # no more edges than nodes, but for the first rounds
        # It is over when every node has one least neighbour, which has none below it: the edges don't change then.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = edges.groupBy("u").agg(F.min("v").alias("m"))
    roots = edges.select(F.col("v").alias("u")).distinct().join(own.select("u"), "u", "left_anti").withColumn("m", F.col("u"))
    return own.unionByName(roots).select("u.a", "u.b", F.col("m.a").alias("ca"), F.col("m.b").alias("cb"))


def _tile(least: float) -> Callable:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False)
        a, b, c = (table.column(x).to_numpy() for x in ("a", "b", "comp"))
        marks = np.frombuffer(b"".join(K.binary_column(table.column("marks")).to_pylist()), np.uint16).reshape(len(a), BANDS * ROWS)
        sets = [np.frombuffer(x, np.uint64) for x in K.binary_column(table.column("set")).to_pylist()]
        top = {int(x): int(x) for x in c}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        out = []
        right = np.flatnonzero(~left)
        for i in np.flatnonzero(left):
            others = right[c[right] != c[i]]
            if not len(others):
                continue
            hope = others[(marks[others] == marks[i]).mean(1) >= HOPE]
            for j in hope:
                x, y = find(int(c[i])), find(int(c[j]))
                if x != y and linked(sets[i], sets[j], least):
                    top[x] = y
                    out.append((a[i], b[i], a[j], b[j]))
        return pa.table([pa.array([int(r[k]) for r in out], pa.int64()) for k in range(4)], names=["xa", "xb", "ya", "yb"])

    return run


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text", weights: str = "set") -> DataFrame:
    """(doc_id, a, b, ca, cb, class_id, class_size): each row's text node, and its class by node and by its least id.

    Texts without words (null among them) are one class; a text of fewer than five words is one shingle. Repeated
    rows are exact copies. A row without an id belongs to a class but doesn't name it; a class of such rows alone
    has a null class_id. With weights="count" the signature weighs a shingle by its occurrences; links are decided by
    the sets in either case. The order of rows is not kept.
    """
    small_batches(docs.sparkSession)
    signed = stored(sign(docs, key, text, weights))
    nodes = signed.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.max("bands").alias("bands"), F.max("marks").alias("marks"), F.count("*").alias("n"))
    nodes = stored(nodes)
    n_parts = max(PARTS, nodes.count() // PART)
    part = F.pmod(F.xxhash64("a", "b"), F.lit(n_parts)).cast("int")
    me = F.struct("a", "b")
    buckets = nodes.select("a", "b", part.alias("part"), F.explode("bands").alias("band"))
    own = buckets.select("band", me.alias("me"), F.min(me).over(Window.partitionBy("band", "part")).alias("hub"))
    own = stored(own.where("me <> hub").select("band", "me", "hub").unionByName(own.where("me = hub").select("band", "me", F.min("me").over(Window.partitionBy("band")).alias("hub")).where("me <> hub")))
    pairs = stored(own.select(F.col("hub.a").alias("xa"), F.col("hub.b").alias("xb"), F.col("me.a").alias("ya"), F.col("me.b").alias("yb")).distinct())
    # Texts of the nodes in question, one row each: the join is on the node and the id that it got first.
    asked = pairs.select(F.col("xa").alias("a"), F.col("xb").alias("b")).unionByName(pairs.select(F.col("ya").alias("a"), F.col("yb").alias("b"))).distinct()
    asked = stored(nodes.drop("n").withColumnRenamed("doc_id", "rep").join(asked, ["a", "b"]))
    rows = docs.select(*node(quoted(text)), quoted(key).alias("rep"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    same_id = F.col("d.rep").eqNullSafe(F.col("q.rep"))
    texts = rows.alias("d").join(asked.alias("q"), (F.col("d.a") == F.col("q.a")) & (F.col("d.b") == F.col("q.b")) & same_id).select("d.a", "d.b", "d.text")
    sets = stored(shingle_sets(texts).dropDuplicates(["a", "b"]))
    with_x = pairs.join(sets.select(F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("set").alias("xset")), ["xa", "xb"])
    with_both = with_x.join(sets.select(F.col("a").alias("ya"), F.col("b").alias("yb"), F.col("set").alias("yset")), ["ya", "yb"])
    links = stored(verify(with_both, similarity))
    classes = components(links)

    # Buckets with several components: all pairs across them, but for those in the bucket's largest component. A bucket
    # of two is done. Only nodes that met another one can be in such a bucket.
    none = [F.coalesce(F.col("ca"), F.col("a")).alias("ca"), F.coalesce(F.col("cb"), F.col("b")).alias("cb")]
    held = asked.join(classes, ["a", "b"], "left").select("a", "b", F.xxhash64(*none).alias("comp"), part.alias("part"), F.explode("bands").alias("band"))
    held = stored(held)
    sizes = held.groupBy("band", "comp").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("major"), F.sum("n").alias("all"), F.count("*").alias("n_comp")).where("n_comp > 1 AND all > 2")
    open_ = stored(open_.select("band", F.col("major.comp").alias("major"), (F.col("all") - F.col("major.n")).alias("minor"), "all"))
    tiles_left, tiles_right = F.ceil(F.col("minor") / TILE).cast("int"), F.ceil(F.col("all") / TILE).cast("int")
    each = open_.join(held.select("band", "part").distinct(), "band")  # a row for each part, so that members don't meet by band alone
    members = held.join(each, ["band", "part"]).withColumns({"nl": tiles_left, "nr": tiles_right})
    slot = lambda n: F.pmod(F.xxhash64("a", "b"), n).cast("int")
    right = members.withColumns({"tr": slot(F.col("nr")), "tl": F.explode(F.sequence(F.lit(0), F.col("nl") - 1)), "left": F.lit(False)})
    left = members.where("comp != major").withColumns({"tl": slot(F.col("nl")), "tr": F.explode(F.sequence(F.lit(0), F.col("nr") - 1)), "left": F.lit(True)})
    columns = ["band", "tl", "tr", "left", "a", "b", "comp"]
    tiled = left.select(columns).unionByName(right.select(columns)).join(nodes.select("a", "b", "marks"), ["a", "b"]).join(sets, ["a", "b"])
    more = tiled.groupBy("band", "tl", "tr").applyInArrow(_tile(similarity), "xa long, xb long, ya long, yb long")
    more = stored(more)
    if more.limit(1).count():
        classes = components(links.unionByName(more))

    # Heads of classes of several texts, a row for each part with members, so that no large class meets at one place; then all rows.
    own = nodes.select("a", "b", F.col("doc_id").alias("least"), "n")
    members = own.join(classes, ["a", "b"]).withColumn("part", part)
    heads = members.groupBy("ca", "cb").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    heads = members.select("ca", "cb", "part").distinct().join(heads, ["ca", "cb"])  # where it has members
    named = members.join(heads, ["ca", "cb", "part"]).select("a", "b", "ca", "cb", "class_id", "class_size")
    alone = F.col("ca").isNull()
    each = own.join(named, ["a", "b"], "left").select("a", "b", *none, F.when(alone, F.col("least")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("n")).otherwise(F.col("class_size")).alias("class_size"))
    return signed.select("doc_id", "a", "b").join(each, ["a", "b"]).select("doc_id", "a", "b", "ca", "cb", "class_id", "class_size")


def first_of_classes(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stand for their class: one row of each, with the least id. Columns are kept."""
    found = near_duplicates(docs, similarity, key, text)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("ca", "cb", "class_id").agg(F.min(F.struct("a", "b")).alias("n"))
    keep = stored(keep.select("class_id", "n.a", "n.b"))
    rows = docs.select(payload(docs).alias("p"), quoted(key).alias("id"), *node(quoted(text)))
    on = (F.col("r.a") == F.col("k.a")) & (F.col("r.b") == F.col("k.b")) & F.col("r.id").eqNullSafe(F.col("k.class_id"))
    found = rows.alias("r").join(keep.alias("k"), on).select("r.p", F.col("r.a").alias("a"), F.col("r.b").alias("b"))
    return found.dropDuplicates(["a", "b"]).select("p.*")
