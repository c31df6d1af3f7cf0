"""Vectorised text kernels over Arrow string buffers.

They work on UTF-8 bytes with numpy, without a Python object for each word, and take texts in chunks of a few
MB (a longer text is a chunk of its own), so that memory stays bounded by the longest text.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 4 << 20
U64 = np.uint64

#: ASCII white space of the word and line contracts: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Spans longer than this are hashed by BLAKE2b, one by one.
LONG_SPAN = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASE_A, BASE_B = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB

#: The low 0..8 bytes of a word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd, so it has an inverse."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U64))
        have = _POWERS[base] = (both[0], both[1])
        if size > 8 * CHUNK:
            del _POWERS[base]
    return have


def binary_column(column) -> pa.Array:
    """A string column as large_binary without nulls (a null text is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):  # no chunk at all
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    out = column.cast(pa.large_binary())
    return pc.fill_null(out, b"") if out.null_count else out


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column."""
    arr = binary_column(column)
    _, off, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Return memory that is freed but still held to the system: Arrow's, and the C library's where that is glibc."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, which gives memory back after each batch and at its end: workers stay for later stages."""

    def each(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch
            give_back()

    def made(batches: Iterator) -> Iterator:
        yield from run(each(batches))
        give_back()

    return made


def chunks(column, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about `most` bytes."""
    data, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words: start and end bytes of all, and for each text the index of its first word (and the count at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    edge = np.empty(n + 1, bool)  # a boundary before byte i
    edge[0] = edge[n] = True
    np.not_equal(word[1:], word[:-1], out=edge[1:n])
    edge |= cut
    at = np.flatnonzero(edge)
    inside = word[at[:-1]]
    starts, ends = at[:-1][inside], at[1:][inside]
    return starts, ends, np.searchsorted(starts, off)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as a number; zeros follow the last byte. It is a view of one copy."""
    return np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))


def _keys(seed: int) -> np.ndarray:
    """Three keys of a seed, the last two odd."""
    return mix64(U64(0x9E3779B97F4A7C15) * (np.arange(1, 4, dtype=U64) + U64(3 * seed))) | np.array([0, 1, 1], U64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, words: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes at a time; another seed gives an independent one.

    The bytes go through a mixer that the seed keys, and the length is mixed in last: spans that collide under one seed
    differ under another, and spans of one length up to 8 bytes never collide. `words`: eights(data), where it is at hand.
    """
    if not len(starts):
        return np.zeros(0, U64)
    if words is None:
        words = eights(data)
    size = ends - starts
    first, step, length = _keys(seed)
    out = mix64((words[starts] & _LOW[np.minimum(size, 8)]) ^ first)
    more, at = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(more):
        left = size[more] - at
        out[more] = mix64(out[more] * step ^ (words[starts[more] + at] & _LOW[np.minimum(left, 8)]))
        more, at = more[left > 8], at + 8
    out = mix64(out + size.astype(U64) * length)
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(4, "little")).digest(), "little")
    return out


def windows(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of all windows of k words that lie in one text, and the count of windows of each text."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    return ragged(first[:-1], n), n


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] of them), start[1], ..."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(total)


def rabin_karp(words: np.ndarray, at: np.ndarray, k: int, base: int = BASE_A) -> np.ndarray:
    """Rabin-Karp hashes of the k words from each of `at`, rolled as differences of prefix sums."""
    if not len(at):
        return np.zeros(0, U64)
    up, down = _powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix64((total[at + k] - total[at]) * down[at])


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def binary_array(data: np.ndarray, off: np.ndarray, kind=pa.binary()) -> pa.Array:
    """Consecutive slices of a byte array as an Arrow array."""
    off_type = np.int64 if pa.types.is_large_binary(kind) or pa.types.is_large_string(kind) else np.int32
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, off_type)), pa.py_buffer(np.ascontiguousarray(data))])


# --- pieces of the byte-level BPE pre-tokenizer -------------------------------------------------------------

_LETTER, _NUMBER, _OTHER, _BLANK, _WHITE = 1, 2, 3, 4, 5
#: Every code point that a text can hold.
CODE_POINTS = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def class_table(letters: str, numbers: str, white: str) -> np.ndarray:
    """The class of each code point, from the members of the classes."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for members, kind in ((letters, _LETTER), (numbers, _NUMBER), (white, _WHITE)):
        out[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    out[0x20] = _BLANK
    return out


def pieces(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes of all matches of the byte-level BPE pattern, and for each text the index of its first match.

    The matches tile each text, so a match ends where the next begins. The pattern's alternatives are told from
    the class of each code point and its neighbours: runs of letters, of digits and of other marks, each with one
    blank before it; white space, whose last code point stands alone before a visible one; and contractions.
    `table`: the class of each code point (`class_table`), as the library that is to be matched sees it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    wide = np.flatnonzero(lead >= 0x80)
    cls = table[lead]
    if len(wide):
        pos, b0 = at[wide], lead[wide].astype(np.int64)
        more = [data[np.minimum(pos + i, n - 1)].astype(np.int64) & 0x3F for i in (1, 2, 3)]
        cp = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | more[0], np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | more[0] << 6 | more[1], (b0 & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
        cls[wide] = table[np.minimum(cp, 0x10FFFF)]
    m = len(at)
    head = np.zeros(m + 1, bool)  # a text begins here
    head[np.searchsorted(at, off)] = True
    white = cls >= _BLANK
    was = np.empty(m, np.uint8)
    was[0], was[1:] = 0, cls[:-1]
    was[head[:m]] = 0
    visible_next = np.zeros(m, bool)
    visible_next[:-1] = ~white[1:] & ~head[1:m]
    cut = np.where(white, (was < _BLANK) | visible_next, (was != cls) & (was != _BLANK))
    cut[head[:m]] = True
    quotes = np.flatnonzero((lead == 0x27) & cut)
    if len(quotes):
        def at_(i: np.ndarray, step: int) -> np.ndarray:
            j = i + step
            ok = j < m
            j = np.minimum(j, m - 1)
            inside = ok.copy()
            for s in range(1, step + 1):
                inside &= ~head[np.minimum(i + s, m)]
            return np.where(inside, lead[j], 0)

        a, b = at_(quotes, 1), at_(quotes, 2)
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        longer = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        for which, size in ((short, 2), (longer, 3)):
            q = quotes[which]
            cut[q + 1] = False
            after = q + size
            cut[after[after < m]] = True
    starts = at[cut]
    return starts, np.searchsorted(starts, off)
