"""Operator 2: removal of word windows that repeat.

Every window of k consecutive words gets a Rabin-Karp hash; Spark counts the hashes; words that lie in a window seen
more than once go, and neighbouring windows merge into maximal removal intervals.

Plan. Documents are dealt into groups of bounded size by a hash of the row. Each group lists its windows' hashes,
once each, in buckets (one row for a group and bucket, packed), so that a passage in a third of all documents costs
one entry for each group. A bucket counts its hashes and tells each group which of its own repeat. The groups are
then read once more (Spark reuses their exchange) and cut. Two windows are taken as equal if their 64-bit hashes
and, by an independent hash, their buckets are equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import GROUP_BYTES, payload, quoted, shuffle_partitions, text_bytes

#: Bytes of hashes that one bucket should hold.
BUCKET_BYTES = 8 << 20


def _windows(data: np.ndarray, off: np.ndarray, k: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = K.spans(data, off)
    words = K.span_hash(data, starts, ends)
    at, _ = K.windows(words, first, k)
    other = K.rabin_karp(K.span_hash(data, starts, ends, seed=1), at, k, K.BASE_B)  # of other hashes of the words
    return K.rabin_karp(words, at, k), (other >> K.U64(20)) % K.U64(n_buckets)


def _list_windows(k: int, n_buckets: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [_windows(data, off, k, n_buckets) for _, _, data, off in K.chunks(table.column("text"))]
        hashes = np.concatenate([h for h, _ in found] or [np.zeros(0, np.uint64)])
        bucket = np.concatenate([b for _, b in found] or [np.zeros(0, np.uint64)])
        order = np.argsort(bucket.astype(np.uint16 if n_buckets <= 1 << 16 else np.uint64), kind="stable")
        hashes, bucket = hashes[order], bucket[order]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, int)
        rows: dict[str, list] = {"bucket": [], "once": [], "many": []}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = np.sort(hashes[a:b])
            new = np.append(True, own[1:] != own[:-1])
            again = np.zeros(len(own), bool)
            again[:-1] = ~new[1:]
            rows["bucket"].append(int(bucket[a]))
            rows["once"].append(own[new & ~again].tobytes())
            rows["many"].append(own[new & again].tobytes())
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "g": pa.array([key[0].as_py()] * len(rows["bucket"]), pa.int32()), "once": pa.array(rows["once"], pa.binary()), "many": pa.array(rows["many"], pa.binary())})

    return run


def _repeated(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    parts = [[np.frombuffer(x, np.uint64) for x in K.binary_column(table.column(c)).to_pylist()] for c in ("once", "many")]
    seen = np.sort(np.concatenate([*parts[0], *parts[1]]))
    more = np.concatenate([seen[1:][seen[1:] == seen[:-1]], *parts[1]])
    more = np.unique(more)
    out = [np.concatenate([once[K.member(once, more)], many]) for once, many in zip(*parts, strict=True)]
    keep = [i for i, x in enumerate(out) if len(x)]
    return pa.table({"g": table.column("g").combine_chunks().take(pa.array(keep, pa.int64())), "hashes": pa.array([out[i].tobytes() for i in keep], pa.binary())})


def _cut(k: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, flags: pa.Table) -> pa.Table:
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in K.binary_column(flags.column("hashes")).to_pylist())]))
        out = []
        for i, j, data, off in K.chunks(docs.column("text")):
            starts, ends, first = K.spans(data, off)
            words = K.span_hash(data, starts, ends)
            at, _ = K.windows(words, first, k)
            hit = at[K.member(K.rabin_karp(words, at, k), known)]
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + k, -1)
            gone = np.cumsum(edge)[:-1] > 0
            out.append(_rows(docs.slice(i, j - i), data, off, starts, ends, first, gone))
        return pa.concat_tables(out) if out else docs.slice(0, 0).select(["p"]).append_column("n_words", pa.array([], pa.int64()))

    return run


def _rows(docs: pa.Table, data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> pa.Table:
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    # Intervals of removed words, as word numbers in the document: maximal runs inside one document.
    head = np.zeros(len(gone) + 1, bool)
    head[first] = True
    begin = gone & (np.append(True, ~gone[:-1])[: len(gone)] | head[:-1])
    end = gone & (np.append(~gone[1:], True)[: len(gone)] | head[1:])
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    in_doc = np.searchsorted(a, first)
    bounds = np.empty(2 * len(a), np.int64)
    base = first[doc[a]] if len(a) else a
    bounds[0::2], bounds[1::2] = a - base, b - base
    # Kept words joined by one space: the byte behind a word is white space unless the text ends there.
    keep = ~gone
    at = np.flatnonzero(keep)
    more = np.append(doc[at[1:]] == doc[at[:-1]], False)[: len(at)]
    mask = np.zeros(len(data) + 1, np.int8)
    np.add.at(mask, starts[at], 1)
    np.add.at(mask, ends[at], -1)
    inside = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    text = data.copy()
    blanks = ends[at[more]]
    text[blanks] = 0x20
    inside[blanks] = True
    size = np.append(0, np.cumsum(inside))[off]
    return pa.table({
        "p": docs.column("p"), "n_words": pa.array(np.diff(first), pa.int64()),
        "n_removed": pa.array(np.append(0, np.cumsum(gone))[first[1:]] - np.append(0, np.cumsum(gone))[first[:-1]], pa.int64()),
        "removed": pa.ListArray.from_arrays(pa.array(2 * in_doc, pa.int32()), pa.array(bounds, pa.int64())),
        "kept_text": K.binary_array(text[inside], size, pa.string()),
    })


def substring_dedup(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` as a struct `p`, with n_words, n_removed, removed (begin, end, begin, end ...: word numbers, the ends
    exclusive) and kept_text, the kept words joined by one space.

    A null or empty text has no words. A text of fewer words than `window` has no window. Repeated rows repeat each
    other's windows, so they lose them all, as the same passage twice in one text does. Columns of any names may
    come along. The order of rows is not kept.
    """
    total = text_bytes(docs, text)
    n_groups = max(1, math.ceil(total / GROUP_BYTES))
    n_buckets = max(16, math.ceil(total * 1.5 / BUCKET_BYTES))  # a window begins every 5 or 6 bytes
    parts = shuffle_partitions(docs.sparkSession, total, GROUP_BYTES * 2)
    bucket_parts = shuffle_partitions(docs.sparkSession, math.ceil(total * 1.5), BUCKET_BYTES * 2)
    body = F.coalesce(quoted(text), F.lit(""))
    # By id and text together, so that copies under different ids spread over all groups. Groups and buckets are dealt
    # out by their numbers: by a hash, some tasks would get several times as many as others.
    group = F.pmod(F.xxhash64(body, quoted(key)), F.lit(n_groups)).cast("int")
    rows = docs.select(payload(docs).alias("p"), body.alias("text"), group.alias("g")).repartitionById(parts, "g")
    listed = rows.groupBy("g").applyInArrow(_list_windows(window, n_buckets), "bucket int, g int, once binary, many binary")
    flags = listed.repartitionById(bucket_parts, "bucket").groupBy("bucket").applyInArrow(_repeated, "g int, hashes binary")
    schema = docs.select(payload(docs).alias("p")).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "removed": F.lit(None).cast("array<bigint>"), "kept_text": F.lit("")}).schema
    return rows.groupBy("g").cogroup(flags.repartitionById(parts, "g").groupBy("g")).applyInArrow(_cut(window), schema)
