"""Candles from a service that gives them page by page, as Spark data sources.

`spark.dataSource.register(PagedCandles)` makes `spark.read.format("paged_candles")` and `spark.readStream` known. The
service is a client, named by the option `client` as "module:factory"; the factory gets all options, and what it gives has
`page(symbol, interval, end_ms, limit)`: at most `limit` raw candles (RAW_KLINE, a list each) that open before `end_ms`, in
ascending order, the latest ones. Requests are made by tasks, a page each; so the client must be importable there.

A batch reads `count` candles of each symbol back from `end`: pages are cut by time, so they are known beforehand and read
side by side, and a page that begins before the first candle is empty. What an interval lacks makes no difference: candles
are missing then, not doubled.

A stream asks for the latest candles of each symbol and takes all but the one that is still open. Its offset is the end
of the last closed candle of each symbol, so each closed candle comes once, also after a restart; the first time it begins
`count` candles back.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schema import minutes

CANDLES = "symbol string, interval string, open_ms long, close_ms long, open double, high double, low double, close double, volume double"
LIMIT = 1000


class Client(Protocol):
    def page(self, symbol: str, interval: str, end_ms: int, limit: int) -> Sequence[Sequence[Any]]: ...


class RecordedPages:
    """A client over recorded candles: the option `path` names a file of JSON lines (symbol, interval, candles). What it has
    recorded up to `now_ms`, where that option is set, is all that there is."""

    def __init__(self, options: Mapping[str, str]):
        self.now, self.candles = int(options.get("now_ms", 1 << 62)), {}
        with open(options["path"], encoding="utf-8") as f:
            for line in map(json.loads, f):
                self.candles.setdefault((line["symbol"], line["interval"]), []).extend(line["candles"])
        for key, own in self.candles.items():  # as a service has them: one of each time, the last one that was recorded
            self.candles[key] = sorted({k[0]: k for k in own if len(k) > 6}.values(), key=lambda k: k[0])

    def page(self, symbol: str, interval: str, end_ms: int, limit: int) -> list[list[Any]]:
        return [k for k in self.candles.get((symbol, interval), []) if k[0] < min(end_ms, self.now)][-limit:]


def client_of(options: Mapping[str, str]) -> Client:
    module, _, name = options.get("client", "tickloom.sources.pages:RecordedPages").partition(":")
    return getattr(importlib.import_module(module), name)(options)


def number(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def rows_of(symbol: str, interval: str, candles: Sequence[Sequence[Any]], first: int, end: int) -> Iterator[tuple]:
    """Rows of the candles that open in [first, end); of repeated times the last; prices that aren't numbers are null, and what
    has no times is passed over."""
    kept = {int(k[0]): k for k in candles if len(k) > 6 and isinstance(k[0], (int, float)) and first <= k[0] < end and isinstance(k[6], (int, float))}
    for at in sorted(kept):
        k = kept[at]
        yield (symbol, interval, at, int(k[6]), *[number(x) for x in k[1:6]])


@dataclass
class Page(InputPartition):
    """Candles of a symbol that open in [first, end), which are `limit` at most."""

    symbol: str
    interval: str
    first: int
    end: int
    limit: int

    def __post_init__(self):
        super().__init__(None)


class _Options:
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)
        self.symbols = [s for s in (x.strip() for x in options["symbols"].split(",")) if s]
        self.interval, self.limit = options.get("interval", "1h"), int(options.get("limit", LIMIT))
        self.count, self.step = int(options.get("count", self.limit)), minutes(options.get("interval", "1h")) * 60_000

    def pages(self, symbol: str, first: int, end: int) -> list[Page]:
        """[first, end) in pages of `limit` intervals, from its end backwards."""
        span, out = self.step * self.limit, []
        while end > first:
            out.append(Page(symbol, self.interval, max(first, end - span), end, self.limit))
            end -= span
        return out

    def read(self, page: Page) -> Iterator[tuple]:
        found = client_of(self.options).page(page.symbol, page.interval, page.end, page.limit)
        yield from rows_of(page.symbol, page.interval, found, page.first, page.end)


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.o = _Options(options)

    def partitions(self) -> list[Page]:
        """Pages back from `end` (exclusive; the end of the latest candle, if it isn't set)."""
        out, client = [], client_of(self.o.options)
        for symbol in self.o.symbols:
            end = int(self.o.options["end_ms"]) if "end_ms" in self.o.options else self._latest(client, symbol)
            out += self.o.pages(symbol, end - self.o.count * self.o.step, end) if end is not None else []
        return out or [Page("", self.o.interval, 0, 0, 1)]

    def _latest(self, client: Client, symbol: str) -> int | None:
        last = client.page(symbol, self.o.interval, 1 << 62, 1)
        return int(last[-1][0]) + self.o.step if last else None

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.o.read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        self.o = _Options(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {s: None for s in self.o.symbols}

    def latestOffset(self) -> dict:  # noqa: N802
        """For each symbol the opening time of its latest candle: what opens before it is closed."""
        client, out = client_of(self.o.options), {}
        for s in self.o.symbols:
            last = client.page(s, self.o.interval, 1 << 62, 1)
            out[s] = int(last[-1][0]) if last else None
        return out

    def partitions(self, start: dict, end: dict) -> list[Page]:
        out = []
        for s in self.o.symbols:
            to = end.get(s)
            if to is not None:
                since = start.get(s)
                out += self.o.pages(s, to - self.o.count * self.o.step if since is None else since, to)
        return out or [Page("", self.o.interval, 0, 0, 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.o.read(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedCandles(DataSource):
    """Options: symbols (separated by commas), interval, count, limit, end_ms, client and the client's own."""

    @classmethod
    def name(cls) -> str:
        return "paged_candles"

    def schema(self) -> str:
        return CANDLES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:  # noqa: N802
        return _StreamReader(self.options)
