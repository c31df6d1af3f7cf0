"""Operator 7: token ids in ORC files.

Each document is encoded by a vocabulary of the tokenizers library, its end id is appended, and the rows are
written as ORC in ascending id order. ORC encodes the id lists by integer run lengths, keeps minima and maxima for
each stripe and row group, and Bloom filters on the document ids; a reader takes stripes in parallel, and a filter on
`doc_id` skips whole files, stripes and row groups from their metadata.

The order is by ascending document id, nulls first; rows with equal ids are ordered by the text's hash.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import PieceEncoder
from .runtime import quoted, shuffle_partitions, text_bytes

STRIPE_BYTES = 16 << 20
FORMAT = {"compression": "zstd", "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": "2000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
COLUMNS = "doc_id long, part int, part_end long, token_ids array<int>"


class AddedEncoder(PieceEncoder):
    """A PieceEncoder that first cuts each text at the added tokens of a vocabulary, which stand for one id each.

    Of several that begin at one place the longest counts. `added`: token bytes to id.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], classes: np.ndarray, added: dict[bytes, int]):
        super().__init__(encode, classes)
        self.added = added
        self.pattern = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def _found(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of each added token; none reaches from one text into the next."""
        out, at, view = [], 0, memoryview(np.ascontiguousarray(data))
        while self.pattern and (m := self.pattern.search(view, at)):
            border = int(off[np.searchsorted(off, m.start(), "right")])
            if m.end() > border and not (m := self.pattern.search(view, m.start(), border)):
                at = border
                continue
            at = m.end()
            out.append((m.start(), at, self.added[bytes(m.group())]))
        return out

    def chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self._found(data, off)
        if not found:
            return super().chunk(data, off)
        start, end, token = (np.array(x, np.int64) for x in zip(*found, strict=True))
        cuts = np.unique(np.concatenate([off, start, end]))
        ids, to = super().chunk(data, cuts)
        size, one = np.diff(to), np.zeros(len(cuts) - 1, bool)
        one[np.searchsorted(cuts, start)] = True
        whole = np.append(0, np.cumsum(np.where(one, 1, size)))
        out = np.empty(whole[-1], ids.dtype)
        out[whole[:-1][one]] = token
        out[K.ragged(whole[:-1][~one], size[~one])] = ids[np.repeat(~one, size)]
        return out, whole[np.searchsorted(cuts, off)]


@lru_cache(maxsize=1)
def library_classes() -> np.ndarray:
    """The classes of all code points as the tokenizers library's patterns see them: its own tables, of its own version."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    def members(pattern: str) -> str:
        find, step = Split(Regex(f"{pattern}+"), "removed", invert=True).pre_tokenize_str, 8192
        return "".join(s for i in range(0, len(K.CODE_POINTS), step) for s, _ in find(K.CODE_POINTS[i : i + step]))

    return K.class_table(members(r"\p{L}"), members(r"\p{N}"), members(r"\s"))


@lru_cache(maxsize=2)
def library_encoder(path: str) -> PieceEncoder:
    """A worker's encoder by the tokenizers library, which sees each distinct piece once.

    The library first cuts a text at the file's added tokens. Its byte-level pre-tokenizer cuts what is between them
    just as `kernels.pieces` does, and a piece by itself is not cut again, so its ids are those that it has inside any
    text. So the library gets all new pieces in one call, as words that are cut already; a token of this kind of
    vocabulary has a character for each byte, which tells where a piece's ids end. Other kinds of vocabularies, and added
    tokens that take white space along, stand as single words or match normalised text, are refused.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    kind = json.loads(tokenizer.to_str())
    cutting = kind["pre_tokenizer"] or {}
    if kind["normalizer"] or kind["model"].get("type") != "BPE" or kind["model"].get("byte_fallback") or cutting.get("type") != "ByteLevel" or cutting.get("add_prefix_space") or not cutting.get("use_regex"):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    added = tokenizer.get_added_tokens_decoder()
    if odd := [t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word]:
        raise ValueError(f"added tokens with such options aren't supported: {odd}")
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    n_bytes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        n_bytes[i] = len(token)

    def encode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        body = data.tobytes()
        words = [body[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        (done,) = tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(done.ids, np.int32)
        upto = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))
        return ids, np.diff(np.searchsorted(np.cumsum(n_bytes[ids]), upto) + 1, prepend=0)

    return AddedEncoder(encode, library_classes(), {t.content.encode(): i for i, t in added.items() if t.content})


def encoded(rows: DataFrame, vocabulary: str, end_id: int | None) -> DataFrame:
    """(doc_id, part, part_end, token_ids) from (doc_id, text): the ids of each text, the end id last.

    A part is a partition; part_end counts its ids up to and with this row's. A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = library_encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, data, off in K.chunks(batch.column(1)):
                ids, to = encoder.chunk(data, off)
                if end_id is not None:
                    ids, to = np.insert(ids, to[1:], end_id), to + np.arange(len(to))
                lists = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(done + to[1:]), lists], names=["doc_id", "part", "part_end", "token_ids"])
                done += int(to[-1])

    return rows.select("doc_id", "text").mapInArrow(run, COLUMNS)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> None:
    """Write all documents; file names ascend with the ids in them.

    The texts are dealt out by ranges of (id, hash of the text), so that rows of one id may lie in several files and
    no id makes a file too large. Spark's sampling for the ranges sends a bounded number of keys to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).alias("text"), F.xxhash64(quoted(text)).alias("tie"))
    n = shuffle_partitions(spark, text_bytes(rows))
    ranged = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    encoded(ranged, vocabulary, end_id).write.format("orc").options(**FORMAT).save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, token_ids) of written files; filters on doc_id prune stripes."""
    return spark.read.schema(COLUMNS).format("orc").load(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; `start` counts the ids before it.

    A document's place inside its part is stored beside it; the sum over the parts before (a row for each file) is
    read from that column alone.
    """
    schema = "doc_id long, part int, part_end long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            off = np.asarray(lists.offsets, np.int64)
            ids = np.asarray(lists.flatten(), np.int32)
            packed = memoryview(ids.astype("<u4").tobytes())
            at = (4 * (off - off[0])).tolist()
            crc = [zlib.crc32(packed[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "part_end", "n_tokens", "ids_crc32"])

    tokens = read_tokens(spark, path)
    rows = tokens.select("doc_id", "part", "part_end", "token_ids").mapInArrow(run, schema)
    parts = tokens.groupBy("part").agg(F.max("part_end").alias("in_part"))
    before = F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_part")
    return rows.join(parts.select("part", before.alias("before")), "part").select("doc_id", (F.col("before") + F.col("part_end") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
