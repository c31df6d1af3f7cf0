"""Operator 13: allow and block rules for URLs, in sorted digest arrays.

A rule is a host and the beginning of a path. It fits URLs of its host and of all subdomains whose path begins with
the rule's; of several the longest wins (in code points; of equally long ones the longer host), and where none fits the
verdict is `default`. Rules are kept as an array of sorted 64-bit xxhash digests with the full strings beside it: a batch
of keys is looked up by one vectorised binary search, and each hit is confirmed by its string, along all equal digests.

A URL is not looked up under every beginning of its path: one array tells which of its host's suffixes have rules, and
how long their paths are; only beginnings of these lengths go to the other one.

Plan. Parts of the rules of at most PART bytes are packed one by one into files of the shared folder, and go to the
executors by SparkContext.addFile; workers memory-map them, so that all of a machine share one copy in the page cache.
URLs are judged where they are read: nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import payload, quoted, shared_file

#: Bytes of rules in one array; more rules make more arrays, which are all looked at.
PART = 32 << 20
VERDICTS = ("allow", "block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class DigestArray:
    """Strings by their sorted 64-bit digests, each with a number. Its parts are views of one buffer, such as a memory map."""

    def __init__(self, buffer: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh64_intdigest):
        n = int(buffer[:8].view(np.int64)[0])
        cuts = np.cumsum([8, 8 * n, 8 * (n + 1), 8 * n])
        self.digests, self.starts, self.numbers = (buffer[a:b].view(t) for a, b, t in zip(cuts[:-1], cuts[1:], (np.uint64, np.int64, np.int64), strict=True))
        self.text, self.digest = buffer[cuts[-1] :], digest

    @staticmethod
    def packed(items: dict[bytes, int], digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> bytes:
        order = sorted((digest(s), s) for s in items)
        head = np.array([len(order)], np.int64), np.array([d for d, _ in order], np.uint64)
        starts = np.cumsum([0, *(len(s) for _, s in order)], dtype=np.int64)
        text = b"".join(s for _, s in order)
        return b"".join(x.tobytes() for x in (*head, starts, np.array([items[s] for _, s in order], np.int64))) + text + bytes(-len(text) % 8)

    def find(self, keys: Sequence[bytes]) -> np.ndarray:
        """The place of each key, -1 where it isn't held."""
        out = np.full(len(keys), -1, np.int64)
        own = np.fromiter(map(self.digest, keys), np.uint64, len(keys))
        at, left = np.searchsorted(self.digests, own), np.arange(len(keys))
        while len(left):
            inside = at[left] < len(self.digests)
            left = left[inside]
            left = left[self.digests[at[left]] == own[left]]
            same = np.array([self.string(at[i]) == keys[i] for i in left], bool)
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
        return out

    def string(self, i: int) -> bytes:
        return self.text[self.starts[i] : self.starts[i + 1]].tobytes()


def _rule_key(host: bytes, path: bytes) -> bytes:
    return host + b"\0" + path


class RuleArray:
    """Rules of one part: hosts that have some, the lengths of their paths, and the rules with their verdicts."""

    def __init__(self, buffer: np.ndarray):
        head = buffer[:24].view(np.int64)
        cuts = 24 + np.cumsum([0, *head])
        self.hosts, self.rules = DigestArray(buffer[cuts[0] : cuts[1]]), DigestArray(buffer[cuts[1] : cuts[2]])
        lengths = buffer[cuts[2] : cuts[3]].view(np.int64)
        self.ends, self.lengths = lengths[: len(self.hosts.digests) + 1], lengths[len(self.hosts.digests) + 1 :]
        self.longest = int(np.diff(self.hosts.starts).max(initial=0))

    @staticmethod
    def packed(rules: dict[tuple[str, str], str]) -> bytes:
        by_host: dict[bytes, set[int]] = {}
        for host, path in rules:
            by_host.setdefault(host.encode(), set()).add(len(path.encode()))
        hosts = {host: i for i, host in enumerate(by_host)}
        keys = {_rule_key(host.encode(), path.encode()): 2 * (len(host) + len(path)) + VERDICTS.index(verdict) for (host, path), verdict in rules.items()}
        ends = np.cumsum([0, *(len(x) for x in by_host.values())], dtype=np.int64)
        lengths = np.array([n for x in by_host.values() for n in sorted(x)], np.int64)
        parts = DigestArray.packed(hosts), DigestArray.packed(keys), ends.tobytes() + lengths.tobytes()
        return np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(parts)

    def match(self, hosts: Sequence[bytes], paths: Sequence[bytes]) -> list[tuple[int, int, str, str] | None]:
        """(length, length of the host, rule, verdict) of the longest rule that fits, of each host and path."""
        of_host = self._suffixes(hosts)
        keys, of = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for suffix, lengths in of_host[host]:
                fit = [n for n in lengths if n <= len(path)]
                keys += [_rule_key(suffix, path[:n]) for n in fit]
                of += [i] * len(fit)
        best: list[tuple[int, int, str, str] | None] = [None] * len(hosts)
        for k, at in enumerate(self.rules.find(keys).tolist()):
            if at >= 0:
                number, (host, _, path) = int(self.rules.numbers[at]), keys[k].partition(b"\0")
                rule = (number >> 1, len(host), (host + path).decode(), VERDICTS[number & 1])
                if best[of[k]] is None or rule[:2] > best[of[k]][:2]:
                    best[of[k]] = rule
        return best

    def _suffixes(self, hosts: Sequence[bytes]) -> dict[bytes, list[tuple[bytes, list[int]]]]:
        """For each different host its suffixes that have rules, with the lengths of their paths."""
        out: dict[bytes, list] = {h: [] for h in hosts}
        found = [(h, h[at:]) for h in out for at in self._labels(h)]
        for (host, suffix), i in zip(found, self.hosts.find([s for _, s in found]).tolist(), strict=True):
            if i >= 0:
                k = int(self.hosts.numbers[i])
                out[host].append((suffix, self.lengths[self.ends[k] : self.ends[k + 1]].tolist()))
        return out

    def _labels(self, host: bytes) -> Iterator[int]:
        """Where labels of a host begin, none so far from its end that no rule's host is as long."""
        least = len(host) - self.longest
        if least <= 0:
            yield 0
        at = len(host)
        while (at := host.rfind(b".", max(least - 1, 0), at)) >= 0:
            yield at + 1


_MAPPED: dict[str, RuleArray] = {}


def _mapped(name: str) -> RuleArray:
    if name not in _MAPPED:
        _MAPPED[name] = RuleArray(np.memmap(SparkFiles.get(name), np.uint8, "r"))
    return _MAPPED[name]


def publish(rules: DataFrame, part: int = PART) -> list[str]:
    """The names of the files that hold `rules` (host, path, verdict), which all executors have from now on.

    Hosts are lower-cased from A to Z. A null path is empty. Of one rule with both verdicts the block counts; a rule
    without a host, or with another verdict, is an error. The driver holds one part at a time.
    """
    spark = rules.sparkSession
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    own = rules.select(host.alias("host"), path.alias("path"), "verdict")
    wrong = ~F.coalesce((F.col("host") != "") & F.col("verdict").isin(*VERDICTS), F.lit(False))
    own = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict"), F.max(wrong).alias("wrong"))
    size, bad = own.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.max("wrong")).first()
    if bad:
        raise ValueError("a rule has no host, or a verdict that is neither allow nor block")
    n = math.ceil((size or 0) / part)
    names = []
    for i in range(n):
        rows = own.where(F.pmod(F.xxhash64("host", "path"), F.lit(n)) == i).toArrow() if n > 1 else own.toArrow()
        held = {(h, p): v for h, p, v in zip(*(rows.column(c).to_pylist() for c in ("host", "path", "verdict")), strict=True)}
        name, place = shared_file(spark, RuleArray.packed(held))
        spark.sparkContext.addFile(place)
        names.append(name)
    return names


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, lower-cased from A to Z; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to the next ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, names: Sequence[str], url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` as a struct `p`, with host, path, rule (host and path of the rule that wins, or null) and verdict.

    `names`: what `publish` has returned; without any, and for URLs that no rule fits, the verdict is `default`. Null
    URLs and those without :// have an empty host and path. Columns of any names may come along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [_mapped(n) for n in names]
        for batch in batches:
            hosts, paths = (batch.column(i).cast(pa.binary()).to_pylist() for i in (1, 2))
            best = [None] * len(hosts)
            for array in arrays:
                best = [max(filter(None, pair), default=None, key=lambda r: r[:2]) for pair in zip(best, array.match(hosts, paths), strict=True)]
            rule = pa.array([b and b[2] for b in best], pa.string())
            verdict = pa.array([b[3] if b else default for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], ["p", "host", "path", "rule", "verdict"])

    rows = pages.select(payload(pages).alias("p"), host_of(quoted(url)).alias("host"), path_of(quoted(url)).alias("path"))
    schema = rows.withColumns({c: F.lit(None).cast("string") for c in ("rule", "verdict")}).schema
    return rows.mapInArrow(run, schema)


def url_filter(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """`judged` by `rules`: a table, or a list, of (host, path, verdict)."""
    spark: SparkSession = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([*rules], "host string, path string, verdict string")
    return judged(pages, publish(rules), url, default)
