"""Operator 4: byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string, BPE yields one encoding, and that encoding is determined by its last token. So
it is enough to store for each prefix its last token: the token t that ends there such that t may follow the last
token of the prefix before t, where two tokens may meet if and only if BPE leaves their joined bytes as just these
two. Appending bytes extends the table without touching it; an edit restarts at the edited byte and stops when the
new entries meet the old ones again.

Texts are cut into the matches of the pre-tokenizer pattern by numpy (`kernels.pieces`); each distinct match is
encoded once per worker and then looked up by its 64-bit hash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import kernels as K
from .runtime import quoted

#: Distinct pieces that a worker remembers. It bounds memory only.
REMEMBERED = 600_000
#: The same for the prefix tables, beside the trie and the pairs; and the text bytes that are encoded at once. A worker
#: that stays for later stages then holds little.
PREFIX_REMEMBERED, PREFIX_CHUNK = 300_000, 2 << 20
#: Pieces of so many bytes at most are encoded many at a time.
SIDE_BY_SIDE = 32
#: Pairs of tokens whose meeting is remembered.
PAIRS = 400_000
_TOKEN = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids one after the other, and the length of each list."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), size


class HashTable:
    """Numbers by 64-bit keys, open addressing in numpy: all lookups of a batch go side by side."""

    def __init__(self, room: int):
        self.mask = (1 << max(4, (2 * room - 1).bit_length())) - 1  # at least twice as many places as entries
        self.key, self.value = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        self.room, self.n = room, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        at = (K.mix64(keys) & K.U64(self.mask)).astype(np.int64)
        out = self.value[at]
        todo = np.flatnonzero((out >= 0) & (self.key[at] != keys))
        while len(todo):  # on to the next place
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.value[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.key[at[todo]] != keys[todo])]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys. There must be room."""
        self.n += len(keys)
        at, todo = (K.mix64(keys) & K.U64(self.mask)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.value[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)  # of several that want one place, one gets it
            got = free[first]
            self.key[at[got]], self.value[at[got]] = keys[got], values[got]
            todo = todo[(self.value[at[todo]] < 0) | (self.key[at[todo]] != keys[todo])]
            at[todo] = (at[todo] + 1) & self.mask


class PrefixTable:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytearray(), []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact at any cut: earlier entries never change."""
        n = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        for end in range(n + 1, len(self.data) + 1):
            self.last[end - 1] = self._last(end)

    def _last(self, end: int) -> int:
        bpe, data, last = self.bpe, self.data, self.last
        for size in range(min(end, bpe.longest), 0, -1):
            t = bpe.ranks.get(bytes(data[end - size : end]))
            if t is not None and (size == end or bpe.may_meet(last[end - size - 1], t)):
                return t
        raise ValueError(f"no token ends at byte {end}: the vocabulary lacks a single byte")

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes start..end; returns how many entries were computed.

        Behind the edit an entry depends on the `longest` bytes and entries before it, so once that many in a row
        equal the old ones, all further ones do.
        """
        old_last, shift = self.last[end:], start + len(new)
        self.data[start:end] = new
        self.last = self.last[:start] + [-1] * len(new) + old_last
        same = 0
        for k in range(start + 1, len(self.data) + 1):
            was = self.last[k - 1]
            self.last[k - 1] = self._last(k)
            same = same + 1 if k > shift and was == self.last[k - 1] else 0
            if same >= self.bpe.longest:
                return k - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        """Walk back from the end."""
        out, end = [], len(self.data)
        while end:
            out.append(t := self.last[end - 1])
            end -= len(self.bpe.token[t])
        return out[::-1]


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self._size[i] = len(t)
        self.ends: dict = {}  # from the last byte of each token back to its first; at _TOKEN its id
        for t, i in ranks.items():
            node = self.ends
            for byte in reversed(t):
                node = node.setdefault(byte, {})
            node[_TOKEN] = i
        self._meet: dict[int, bool] = {}
        self._tokens, self._pairs = HashTable(len(ranks)), HashTable(PAIRS)
        tokens, ids = [*ranks], np.fromiter(ranks.values(), np.int32, len(ranks))
        ends = np.cumsum([*map(len, tokens)])
        self._tokens.add(K.span_hash(np.frombuffer(b"".join(tokens), np.uint8), ends - [*map(len, tokens)], ends), ids)
        self._parts: dict[int, tuple[int, int] | None] = {}

    def merge(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """Textbook BPE: join the neighbours of lowest rank, the leftmost first, until none is left below `below`."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose join makes t; None for a single byte."""
        if t not in self._parts:
            left = self.merge(self.token[t], self.ranks[self.token[t]])
            self._parts[t] = (left[0], left[1]) if len(left) == 2 else None
        return self._parts[t]

    def may_meet(self, a: int, b: int) -> bool:
        """Whether BPE leaves the joined bytes of a and b as these two tokens.

        It does unless a join crosses the border before its neighbours are used up. At the border stand a part x on
        the right edge of a and a part y on the left edge of b; going back in time, the younger of the two is undone
        first. A crossing join of x and y comes first if its rank is below that of the join that uses up x, and
        not above that of the join that uses up y (of equal joins the left one goes first).
        """
        key = a << 32 | b
        known = self._meet.get(key)
        if known is not None:
            return known
        if len(self._meet) >= PAIRS:
            self._meet.clear()
        x, y, until_x, until_y = a, b, 1 << 60, 1 << 60
        ranks, token, ok = self.ranks, self.token, True
        while True:
            crossing = ranks.get(token[x] + token[y])
            if crossing is not None and crossing < until_x and crossing <= until_y:
                ok = False
                break
            in_x, in_y = self.parts(x), self.parts(y)
            if in_x is None and in_y is None:
                break
            if in_y is None or in_x is not None and x > y:
                x, until_x = in_x[1], x
            else:
                y, until_y = in_y[0], y
        self._meet[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """As PrefixTable(piece).ids(), with the candidates found by walking back through a trie of token ends."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        root, meet, may_meet, last = self.ends, self._meet.get, self.may_meet, []
        for end in range(len(piece)):
            node, ending, at = root, [], end
            while at >= 0 and (node := node.get(piece[at])) is not None:
                if (t := node.get(_TOKEN)) is not None:
                    ending.append((at, t))
                at -= 1
            for start, t in reversed(ending):
                if not start:
                    break
                ok = meet(key := last[start - 1] << 32 | t)
                if ok or ok is None and may_meet(key >> 32, t):
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            last.append(t)
        out, end, token = [], len(piece), self.token
        while end:
            out.append(t := last[end - 1])
            end -= len(token[t])
        return out[::-1]

    def _meets(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """may_meet for many pairs; those not remembered are worked out once each."""
        key = a.astype(np.uint64) << K.U64(32) | b.astype(np.uint64)
        out = self._pairs.find(key)
        if len(fresh := np.flatnonzero(out < 0)):
            new, index = np.unique(key[fresh], return_inverse=True)
            ok = np.fromiter((self.may_meet(k >> 32, k & 0xFFFF_FFFF) for k in new.tolist()), np.int32, len(new))
            out[fresh] = ok[index]
            if self._pairs.n + len(new) > PAIRS:
                self._pairs = HashTable(max(PAIRS, len(new)))
            self._pairs.add(new, ok)
        return out > 0

    def encode_many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and their numbers.

        The prefixes of all pieces grow together, byte by byte: at each end the longest token goes first, and the pieces
        that have found their last token leave. Pieces of more than SIDE_BY_SIDE bytes go through one at a time.
        """
        order = np.argsort(starts - ends, kind="stable")
        alone = int(np.searchsorted(starts[order] - ends[order], -SIDE_BY_SIDE))
        found = {i: self.encode_piece(data[starts[i] : ends[i]].tobytes()) for i in order[:alone].tolist()}
        order = order[alone:]
        start, size = starts[order], (ends - starts)[order]
        words = K.eights(data)
        whole = self._tokens.find(K.span_hash(data, start, start + size, words=words))
        rest = np.flatnonzero(whole < 0)
        at, length = start[rest], size[rest]
        width = int(length[0]) if len(rest) else 0
        last = np.full((len(rest), width), -1, np.int32)
        for end in range(1, width + 1):
            todo = np.arange(int(np.searchsorted(-length, -end, side="right")))
            for n in range(min(end, self.longest), 0, -1):
                token = self._tokens.find(K.span_hash(data, at[todo] + (end - n), at[todo] + end, words=words))
                hit = np.flatnonzero(token >= 0)
                if n < end and len(hit):
                    hit = hit[self._meets(last[todo[hit], end - n - 1], token[hit])]
                last[todo[hit], end - 1] = token[hit]
                todo = np.delete(todo, hit)
                if not len(todo):
                    break
            if len(todo):
                raise ValueError("the vocabulary lacks a single byte")
        # Walk back from all ends together.
        n_ids, back = np.ones(len(order), np.int64), []
        going, place = np.arange(len(rest)), length.copy()
        while len(going):
            token = last[going, place[going] - 1]
            back.append((going, token))
            place[going] -= self._size[token]
            going = going[place[going] > 0]
        n_ids[rest] = np.bincount(np.concatenate([g for g, _ in back]), minlength=len(rest)) if back else 0
        sizes = np.zeros(len(starts), np.int64)
        sizes[order] = n_ids
        for i, ids in found.items():
            sizes[i] = len(ids)
        to = np.append(0, np.cumsum(sizes))
        out = np.zeros(int(to[-1]), np.int32)
        out[to[order[whole >= 0]]] = whole[whole >= 0]
        for k, (going, token) in enumerate(back):
            out[to[order[rest[going]] + 1] - 1 - k] = token
        for i, ids in found.items():
            out[to[i] : to[i + 1]] = ids
        return out, sizes


class PieceTable:
    """Token ids of remembered pieces, found by their 64-bit hashes."""

    def __init__(self, room: int):
        self.place, self.room = HashTable(room), room
        self.hash, self.begin, self.size = np.zeros(room, np.uint64), np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.again, self.pool, self.n, self.used = np.zeros(room, bool), np.zeros(1 << 16, np.int32), 0, 0

    def add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New distinct hashes, with their ids one after the other. There must be room."""
        new = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        self.place.add(hashes, new)
        self.hash[new], self.size[new] = hashes, size
        self.begin[new] = self.used + np.cumsum(size) - size
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(hashes), self.used + len(ids)

    def ids(self, entries: np.ndarray) -> np.ndarray:
        return self.pool[K.ragged(self.begin[entries], self.size[entries].astype(np.int64))]


class PieceEncoder:
    """Token ids of whole texts, each distinct piece encoded once while it is remembered.

    `encode` gives the ids of pieces (bytes, starts, ends), one after the other, and the number of each piece's ids. When the memory is full,
    pieces stay that were met again since the last time, up to half of it, and others are forgotten.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], classes: np.ndarray, remembered: int = REMEMBERED):
        self.encode, self.classes, self.table = encode, classes, PieceTable(remembered)

    def _make_room(self, n: int) -> None:
        old = self.table
        kept = np.flatnonzero(old.again[: old.n])[: old.room // 2]
        self.table = PieceTable(max(old.room, len(kept) + n))  # more only for a text with so many pieces of its own
        self.table.add(old.hash[kept], old.ids(kept), old.size[kept])

    def chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        starts, first = K.pieces(data, off, self.classes)
        ends = np.append(starts[1:], len(data))
        hashes = K.span_hash(data, starts, ends)
        entry = self.table.place.find(hashes)
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            new, where, index = np.unique(hashes[fresh], return_index=True, return_inverse=True)
            self.table.again[entry[entry >= 0]] = True
            if self.table.n + len(new) > self.table.room:
                self._make_room(len(np.unique(hashes)))
                entry = self.table.place.find(hashes)
                fresh = np.flatnonzero(entry < 0)
                new, where, index = np.unique(hashes[fresh], return_index=True, return_inverse=True)
            at, base = fresh[where], self.table.n
            self.table.add(new, *self.encode(data, starts[at], ends[at]))
            entry[fresh] = base + index
        size = self.table.size[entry].astype(np.int64)
        return self.table.ids(entry), np.append(0, np.cumsum(size))[first]


@lru_cache(maxsize=1)
def pattern_classes() -> np.ndarray:
    """The classes of all code points as the tiktoken library's patterns see them: its own tables, of its own version.

    An encoding drops what its pattern doesn't match, so one of single bytes gives back the members of a class.
    """
    import tiktoken

    def members(pattern: str) -> str:
        one = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        return bytes(one.encode_ordinary(K.CODE_POINTS)).decode()

    return K.class_table(members(r"\p{L}"), members(r"\p{N}"), members(r"\s"))


@lru_cache(maxsize=2)
def prefix_encoder(path: str) -> tuple[PieceEncoder, np.ndarray, np.ndarray]:
    """A worker's encoder, and the bytes of all tokens with their offsets."""
    ranks = load_ranks(path)
    bpe = PrefixBPE(ranks)
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    encoder = PieceEncoder(bpe.encode_many, pattern_classes(), PREFIX_REMEMBERED)
    return encoder, np.frombuffer(b"".join(tokens), np.uint8), np.append(0, np.cumsum([*map(len, tokens)]))


def decode_ids(ids: np.ndarray, off: np.ndarray, pool: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the tokens, and each text's offsets in them."""
    size = at[ids + 1] - at[ids]
    return pool[K.ragged(at[ids], size)], np.append(0, np.cumsum(size))[off]


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """`docs` with `token_ids` (array<int>) beside its columns, which are kept; a column of that name is replaced.

    A null text counts as empty and has no ids. Rows stay where they are: there is no shuffle.
    """
    kept = [c for c in docs.columns if c != "token_ids"]
    schema = docs.select(*map(quoted, kept)).withColumn("token_ids", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(vocabulary)[0]
        for batch in batches:
            at = batch.schema.names.index(text)
            for i, j, data, off in K.chunks(batch.column(at), PREFIX_CHUNK):
                ids, to = encoder.chunk(data, off)
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids, pa.int32()))], [*kept, "token_ids"])

    return docs.select(*map(quoted, kept)).mapInArrow(K.lean(run), schema)


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row: digests of the ids and of the text decoded from them;
    with `ids` the ids themselves, too (token_ids).

    A null text counts as empty. Repeated rows give repeated results; other columns are not read. The ids are
    digested where they are made.
    """
    schema = docs.select(quoted(key)).withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema
    if ids:
        schema = schema.add("token_ids", ArrayType(IntegerType()))
    wanted = ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pool, at = prefix_encoder(vocabulary)
        for batch in batches:
            for i, j, data, off in K.chunks(batch.column(1), PREFIX_CHUNK):
                ids, to = encoder.chunk(data, off)
                back, end = decode_ids(ids, to, pool, at)
                packed, back = memoryview(ids.astype("<u4").tobytes()), memoryview(back.tobytes())
                digests = [[hashlib.sha256(m[a:b]).hexdigest() for a, b in zip(p[:-1], p[1:], strict=True)] for m, p in ((packed, (4 * to).tolist()), (back, end.tolist()))]
                lists = [pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids, pa.int32()))] if wanted else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(to), pa.int64()), *map(pa.array, digests), *lists], names=schema.names)

    return docs.select(quoted(key), quoted(text)).mapInArrow(K.lean(run), schema)
