"""Operator 10: media columns in baseline JPEG.

A payload is stored losslessly as an image in which every block of 8 x 8 samples has one value: the block's DC
coefficient, quantised by 8, is that value less 128 exactly, and its AC coefficients are zero. Blocks stand in rows
of 64 with a restart marker after each row, so that a scan can be decoded with all rows of many images side by side.

The reader takes baseline images in general, grey ones and colour ones with any sampling of the chroma: it parses the
markers, Huffman-decodes the scan by the tables that it finds, and rebuilds the DC-only luminance thumbnail: one sample
for each luminance block. Features are the dimensions and two hashes of the thumbnail.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from struct import pack, unpack_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import quoted

ROW = 64
#: Rows of blocks in one image: 65,535 samples is the format's limit. A longer payload is a chain of images.
MOST_ROWS = 8191
QUANT = 8
#: Coded bytes that are decoded side by side.
SIDE_BY_SIDE = 2 << 20

# Fixed values of the standard: the luminance DC code lengths (count of codes of 1..16 bits, then the categories).
DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
# One AC code of one bit: end of block.
AC_BITS = [1] + [0] * 15
AC_VALUES = [0]


def huffman(bits: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(value, code, length) of a canonical table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((values[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xDB, bytes([0, *[QUANT] * 64])),
        _segment(0xC0, pack(">BHHB", 8, 8 * rows, 8 * ROW, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00, *DC_BITS, *DC_VALUES])),
        _segment(0xC4, bytes([0x10, *AC_BITS, *AC_VALUES])),
        _segment(0xDD, pack(">H", ROW)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


_DC_CODE = np.zeros(12, np.int64)
_DC_LEN = np.zeros(12, np.int64)
for _v, _c, _n in huffman(DC_BITS, DC_VALUES):
    _DC_CODE[_v], _DC_LEN[_v] = _c, _n
_AC_CODE, _AC_LEN = huffman(AC_BITS, AC_VALUES)[0][1:]
_CATEGORY = np.array([int(x).bit_length() for x in range(256)])


def encode_rows(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes (stuffed, padded by ones) of each row of 64 samples, and the offsets of the rows."""
    value = payload.reshape(-1, ROW).astype(np.int64)
    diff = np.diff(value, axis=1, prepend=128)
    size = _CATEGORY[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    code = ((_DC_CODE[size] << size | extra) << _AC_LEN) | _AC_CODE
    length = _DC_LEN[size] + size + _AC_LEN
    ends = np.cumsum(length, axis=1)
    n_bytes = -(-ends[:, -1] // 8)
    base = np.append(0, np.cumsum(n_bytes))
    at = (8 * base[:-1])[:, None] + ends - length  # first bit of each code
    # A code has 19 bits at most, so it touches four bytes; codes don't overlap, so bits add up.
    word = code << (32 - length - (at & 7))
    out = np.zeros(int(base[-1]) + 4, np.int64)
    for k in range(4):
        out += np.bincount((at >> 3).ravel() + k, weights=((word >> (24 - 8 * k)) & 0xFF).ravel(), minlength=len(out))[: len(out)].astype(np.int64)
    out = out[: base[-1]].astype(np.uint8)
    pad = 8 * n_bytes - ends[:, -1]
    out[base[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    stuff = out == 0xFF
    grown = np.arange(len(out)) + np.cumsum(stuff) - stuff
    full = np.zeros(len(out) + int(stuff.sum()), np.uint8)
    full[grown] = out
    return full, base + np.append(0, np.cumsum(stuff))[base]


def encode_payloads(payload: np.ndarray, off: np.ndarray) -> list[bytes]:
    """A JPEG (or a chain of them) of each payload; sizes are positive multiples of 64."""
    parts, at = [], [np.zeros(1, np.int64)]
    for lo in range(0, len(payload), ROW * MOST_ROWS):  # rows are coded by themselves, so a long text goes piece by piece
        bits, ends = encode_rows(payload[lo : lo + ROW * MOST_ROWS])
        parts.append(bits.tobytes())
        at.append(at[-1][-1] + ends[1:])
    coded, at = b"".join(parts), np.concatenate(at)
    out = []
    for a, b in zip((off[:-1] // ROW).tolist(), (off[1:] // ROW).tolist(), strict=True):
        images = []
        for lo in range(a, b, MOST_ROWS):
            hi = min(lo + MOST_ROWS, b)
            parts = [_head(hi - lo)]
            for r in range(lo, hi):
                parts.append(coded[at[r] : at[r + 1]])
                parts.append(bytes([0xFF, 0xD0 + (r - lo) % 8]) if r + 1 < hi else b"\xff\xd9")
            images.append(b"".join(parts))
        out.append(b"".join(images))
    return out


class Header:
    """What the markers before a scan say."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.width = self.height = self.interval = 0
        self.quant: dict[int, list[int]] = {}
        self.tables: dict[int, list[tuple[int, int, int]]] = {}
        at += 2
        while True:
            mark, kind, size = unpack_from(">BBH", data, at)
            body = data[at + 4 : at + 2 + size]
            if mark != 0xFF:
                raise ValueError("no marker where one must be")
            at += 2 + size
            if kind == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("baseline has 8-bit quantisation tables")
                    self.quant[body[0]], body = [*body[1:65]], body[65:]
            elif kind == 0xC4:
                while body:
                    bits = [*body[1:17]]
                    self.tables[body[0]] = huffman(bits, [*body[17 : 17 + sum(bits)]])
                    body = body[17 + sum(bits) :]
            elif kind == 0xC0:
                precision, self.height, self.width, n = unpack_from(">BHHB", body)
                if precision != 8:
                    raise ValueError("baseline has 8-bit samples")
                self.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif kind == 0xDD:
                (self.interval,) = unpack_from(">H", body)
            elif kind == 0xDA:
                self._begin(body, at)
                return

    def _begin(self, body: bytes, at: int) -> None:
        """The scan: its components, and the block pattern of a unit (several blocks where components are interleaved)."""
        told = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
        if [c for c, _ in told] != [*self.parts]:
            raise ValueError("only scans of all components together are read")
        self.scan = at
        self.coding = tuple((tuple(self.tables[t >> 4]), tuple(self.tables[0x10 | t & 15]), self.quant[self.parts[c][2]][0]) for c, t in told)
        size = [self.parts[c][:2] for c, _ in told]
        if len(size) == 1:  # blocks of a single component follow each other row by row, whatever its sampling says
            size = [(1, 1)]
        self.wide, self.high = size[0]
        if (self.wide, self.high) != (max(h for h, _ in size), max(v for _, v in size)):
            raise ValueError("luminance must have the finest sampling")
        self.pattern = tuple(i for i, (h, v) in enumerate(size) for _ in range(h * v))
        self.columns, self.rows = -(-self.width // (8 * self.wide)), -(-self.height // (8 * self.high))  # of units

    def key(self) -> tuple:
        """Images of one key are decoded together."""
        return self.coding, self.pattern, self.interval or self.columns * self.rows

    def luminance(self, samples: np.ndarray) -> np.ndarray:
        """The luminance blocks' samples row by row, from all blocks in the order of the scan."""
        own = samples.reshape(self.rows, self.columns, len(self.pattern))[:, :, : self.wide * self.high]
        grid = own.reshape(self.rows, self.columns, self.high, self.wide).transpose(0, 2, 1, 3).reshape(self.rows * self.high, self.columns * self.wide)
        return grid[: -(-self.height // 8), : -(-self.width // 8)]


def _lookup(table: tuple[tuple[int, int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Value and code length for each 16-bit prefix; length 0 where no code fits."""
    value, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for v, code, n in table:
        value[code << (16 - n) : (code + 1) << (16 - n)] = v
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return value, length


def decode_segments(data: np.ndarray, at: np.ndarray, n_blocks: np.ndarray, coding: tuple, pattern: tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray]:
    """DC samples of all restart segments, block by block for all segments at once.

    data: unstuffed bytes; segment i begins at byte at[i] and has n_blocks[i] blocks, whose components follow `pattern`
    again and again; coding: (DC table, AC table, DC quantiser) of each component. Returns samples and offsets.
    """
    looked = [(_lookup(dc), _lookup(ac), quant) for dc, ac, quant in coding]
    words = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    window = words[:-3] << K.U64(24) | words[1:-2] << K.U64(16) | words[2:-1] << K.U64(8) | words[3:]
    window = window.astype(np.int64)
    order = np.argsort(-n_blocks, kind="stable")
    off = np.append(0, np.cumsum(n_blocks))
    out = np.zeros(int(off[-1]), np.uint8)
    bit, left = 8 * at[order].astype(np.int64), n_blocks[order]
    base, values = off[:-1][order], np.zeros((len(coding), len(order)), np.int64)
    last = len(window) - 1

    def peek(n: int) -> np.ndarray:
        """The next 16 bits of the first n segments."""
        b = bit[:n]
        return (window[np.minimum(b >> 3, last)] >> (16 - (b & 7))) & 0xFFFF

    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # segments with more than k blocks
        part = pattern[k % len(pattern)]
        ((dc, dc_len), (ac, ac_len), quant), value = looked[part], values[part]
        bits = peek(n)
        size, length = dc[bits], dc_len[bits]
        if not length.all():
            raise ValueError("no DC code fits")
        bit[:n] += length
        extra = peek(n) >> (16 - size)
        value[:n] += np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        bit[:n] += size
        place = np.ones(n, np.int64)
        open_ = np.arange(n)
        while len(open_):  # AC codes are passed over: a thumbnail needs none
            bits = (window[np.minimum(bit[open_] >> 3, last)] >> (16 - (bit[open_] & 7))) & 0xFFFF
            run, length = ac[bits], ac_len[bits]
            if not length.all():
                raise ValueError("no AC code fits")
            bit[open_] += length + (run & 15)
            place[open_] = np.where(run == 0, 64, place[open_] + np.where(run == 0xF0, 16, (run >> 4) + 1))
            open_ = open_[place[open_] < 64]
        out[base[:n] + k] = np.clip(128 + (value[:n] * quant + 4) // 8, 0, 255)
    return out, off


def _slices(segments: list[tuple[int, bytes, int]]) -> Iterator[list[tuple[int, bytes, int]]]:
    """Runs of segments of about SIDE_BY_SIDE coded bytes: these are decoded together."""
    run, size = [], 0
    for s in segments:
        run.append(s)
        size += len(s[1])
        if size >= SIDE_BY_SIDE:
            yield run
            run, size = [], 0
    if run:
        yield run


def thumbnails(images: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(width, height, samples) of each media value; a chain's images stand below each other."""
    parsed: list[tuple[int, Header, int, int]] = []
    groups: dict[tuple, list[tuple[int, bytes, int]]] = {}
    for i, data in enumerate(images):
        at = 0
        while at < len(data):
            head = Header(data, at)
            end = data.find(b"\xff\xd9", head.scan)  # coded bytes never look like a marker
            if end < 0:
                raise ValueError("no end of image")
            body = np.frombuffer(data, np.uint8, end + 2 - head.scan, head.scan)
            marks = np.flatnonzero(body[:-1] == 0xFF)
            kind = body[marks + 1]
            stops = marks[(kind >= 0xD0) & (kind <= 0xD9)] + head.scan
            n, key = head.columns * head.rows, head.key()
            starts = [head.scan, *(stops[:-1] + 2).tolist()]
            for s, (a, b) in enumerate(zip(starts, stops.tolist(), strict=True)):
                groups.setdefault(key, []).append((len(parsed), data[a:b].replace(b"\xff\x00", b"\xff"), min(key[2], n - s * key[2]) * len(head.pattern)))
            parsed.append((i, head, n, 0))
            at = end + 2
    samples: list[list[bytes]] = [[] for _ in parsed]
    for key, every in groups.items():
        for segments in _slices(every):
            coded = np.frombuffer(b"".join(s for _, s, _ in segments), np.uint8)
            at = np.append(0, np.cumsum([len(s) for _, s, _ in segments]))[:-1]
            out, off = decode_segments(coded, at, np.array([n for *_, n in segments]), *key[:2])
            out = out.tobytes()
            for (image, _, _), a, b in zip(segments, off[:-1].tolist(), off[1:].tolist(), strict=True):
                samples[image].append(out[a:b])
    result: list[list] = [[0, 0, []] for _ in images]
    for (i, head, _, _), own in zip(parsed, samples, strict=True):
        result[i][0] = head.width
        result[i][1] += head.height
        result[i][2].append(b"".join(own) if head.pattern == (0,) else head.luminance(np.frombuffer(b"".join(own), np.uint8)).tobytes())
    return [(w, h, b"".join(own)) for w, h, own in result]


def feature(width: int, height: int, samples: bytes) -> str:
    """Dimensions, an average hash and a difference hash (8 x 8 cells each) of a thumbnail."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, -(-width // 8))
    total = np.zeros((rows.shape[0] + 1, rows.shape[1] + 1), np.int64)
    total[1:, 1:] = rows.cumsum(0, dtype=np.int64).cumsum(1)

    def cells(high: int, wide: int) -> np.ndarray:
        """Means of cells; with fewer rows than cells, cells overlap."""
        r0, c0 = np.arange(high) * rows.shape[0] // high, np.arange(wide) * rows.shape[1] // wide
        r1 = np.maximum(r0 + 1, (np.arange(high) + 1) * rows.shape[0] // high)
        c1 = np.maximum(c0 + 1, (np.arange(wide) + 1) * rows.shape[1] // wide)
        area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
        return (total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]) / area

    mean, wide = cells(8, 8), cells(8, 9)
    hashes = [np.packbits(x.ravel()).tobytes().hex() for x in (mean >= mean.mean(), wide[:, 1:] >= wide[:, :-1])]
    return f"{width}x{height}:{hashes[0]}:{hashes[1]}"


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text with zero bytes behind it, up to a positive multiple of 64."""
    size = np.diff(off)
    full = np.maximum(ROW, -(-size // ROW) * ROW)
    to = np.append(0, np.cumsum(full))
    out = np.zeros(int(to[-1]), np.uint8)
    out[K.ragged(to[:-1], size)] = data
    return out, to


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text as JPEG. A null text is empty; an empty one is 64 zero bytes."""
    schema = docs.select(quoted(key)).withColumns({"n_bytes": F.lit(0).cast("long"), "media": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in K.chunks(batch.column(1), 1 << 20):
                media = encode_payloads(*padded(data, off))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off), pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    return docs.select(quoted(key), quoted(text)).mapInArrow(run, schema)


def from_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """`media` with width, height, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature."""
    schema = media.select(quoted(key), "n_bytes").withColumns({c: F.lit(0).cast("long") for c in ("width", "height", "payload_bytes")}).withColumns({"payload_sha256": F.lit(""), "tail_crc32": F.lit(0).cast("long"), "media_bytes": F.lit(0).cast("long"), "media_sha256": F.lit(""), "feature": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in K.chunks(batch.column(2), 1 << 20):
                body, at = data.tobytes(), off.tolist()
                images = [body[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                rows = [
                    (w, h, len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(w, h, s))
                    for m, (w, h, s) in zip(images, thumbnails(images), strict=True)
                ]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *columns], names=schema.names)

    arrow = [*pa.schema([("k", pa.int64()), ("n", pa.int64()), *[(c, pa.int64()) for c in ("w", "h", "b")], ("s", pa.string()), ("t", pa.int64()), ("m", pa.int64()), ("x", pa.string()), ("f", pa.string())])]
    return media.select(quoted(key), "n_bytes", "media").mapInArrow(run, schema)
