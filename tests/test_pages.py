"""Candles read page by page: all, once, whatever the size of pages; a stream over restarts; the bar store on disk."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tickloom.sources import market as M
from tickloom.sources import pages as P
from tickloom.streaming import live as L

HOUR = 3_600_000


@pytest.fixture()
def recorded(spark, tmp_path):
    """50 hourly candles of two symbols, with gaps, one repeated and some odd; symbol c has none."""
    rng, path = random.Random(1), tmp_path / "pages.jsonl"
    with open(path, "w") as f:
        for s in "ab":
            own = [[i * HOUR, "1.5", str(2 + i), "1", "1.25", "9", (i + 1) * HOUR - 1] for i in range(50) if not (s == "b" and 20 <= i < 27)]
            own[3][4] = "no number"
            own.append([7 * HOUR, "7", "7", "7", "7", "7", 8 * HOUR - 1])
            own.append([9 * HOUR, "1"])  # a broken one
            head = own[:45]
            rng.shuffle(head)
            own[:45] = head
            f.write(json.dumps({"symbol": s, "interval": "1h", "candles": own}) + "\n")
    spark.dataSource.register(P.PagedCandles)
    return str(path)


def want(symbol, first, end):
    hours = [i for i in range(first, end) if 0 <= i < 50 and not (symbol == "b" and 20 <= i < 27)]
    return [(symbol, i * HOUR, None if i == 3 else 7.0 if i == 7 else 1.25) for i in hours]


def got(df):
    return sorted((r.symbol, r.open_ms, r.close) for r in df.collect())


def test_odd_candles():
    """Repeated times, prices that are no numbers, too few fields, times that are none, and times outside."""
    k = lambda at, close: [at, "1", "2", "0.5", close, "9", 99]
    rows = [k(5, "1"), k(5, "2"), k(7, None), [8, "1"], k("x", "1"), k(4, "1"), k(10, "1"), [6, 1, 2, 3, 4, 5, None], []]
    assert [(r[2], r[7]) for r in P.rows_of("s", "1h", rows, 5, 10)] == [(5, 2.0), (7, None)]


@pytest.mark.parametrize("limit, count", [(1000, 500), (7, 50), (1, 4), (10, 23)])
def test_pages_give_each_candle_once(spark, recorded, limit, count):
    read = spark.read.format("paged_candles").options(symbols="a, b,c,", interval="1h", limit=limit, count=count, path=recorded)
    rows = read.load()
    assert got(rows) == sorted([*want("a", 50 - count, 50), *want("b", 50 - count, 50)])
    assert rows.rdd.getNumPartitions() == 2 * -(-count // limit)
    early = read.option("end_ms", 30 * HOUR).load()
    assert got(early) == sorted([*want("a", 30 - count, 30), *want("b", 30 - count, 30)], key=lambda r: r[:2])


def test_no_symbols_and_no_candles(spark, recorded):
    for symbols in ("", "c", "c,d"):
        assert spark.read.format("paged_candles").options(symbols=symbols, path=recorded).load().count() == 0


def test_a_stream_gives_each_closed_candle_once(spark, recorded, tmp_path):
    """The service goes on between runs; each run begins where the one before has ended."""
    out = str(tmp_path / "out")
    for now in (5, 5, 23, 24, 47):
        options = dict(symbols="a,b,c", interval="1h", limit=4, count=10, path=recorded, now_ms=(now + 1) * HOUR)  # the candle of hour `now` is open
        stream = spark.readStream.format("paged_candles").options(**options).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
        rows = got(spark.read.parquet(out))
        last_b = now if not 20 <= now < 27 else 19  # b has no candle of these hours: its latest one is still open for it
        assert rows == sorted([*want("a", -5, now), *want("b", -5, last_b)])


def test_stores_prune_and_replace_partitions(spark, tmp_path):
    root, t = str(tmp_path / "bars"), dt.datetime(2024, 1, 1)
    make = lambda symbol, interval, n, close: spark.createDataFrame([(symbol, t + dt.timedelta(hours=i), t + dt.timedelta(hours=i + 1), 1.0, 2.0, 0.5, close, 3.0, interval) for i in range(n)], M.BARS + ", interval string")
    M.write_bars(make("a", "1h", 5, 1.0).unionByName(make("a", "4h", 3, 1.0)).unionByName(make("b", "1h", 4, 1.0)), root)
    M.write_bars(make("a", "1h", 2, 9.0), root)  # replaces one partition, the others stay
    assert M.read_bars(spark, root).groupBy("symbol", "interval").agg(F.count("*").alias("n"), F.max("close").alias("c")).orderBy("symbol", "interval").collect() == [("a", "1h", 2, 9.0), ("a", "4h", 3, 1.0), ("b", "1h", 4, 1.0)]
    one = M.read_bars(spark, root, "b", "1h")
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert one.count() == 4 and "= b" in filters and "= 1h" in filters  # other folders aren't read


def test_closed_candles_of_messages(spark, tmp_path):
    """As batch parsing, on a stream, with messages that can't be parsed."""
    k = lambda x, c: json.dumps({"stream": "a@kline_1h", "data": {"e": "kline", "k": {"s": "A", "i": "1h", "c": c, "x": x, "T": 1000, "o": "1", "h": "2", "l": "0.5", "v": "x"}}})
    path, rows = str(tmp_path / "m"), [(k(True, "1.5"),), (k(False, "9"),), (None,), ("{",), ("{}",), (json.dumps({"stream": "x", "data": None}),), (k(True, None),)]
    df = spark.createDataFrame(rows, "message string")
    df.coalesce(1).write.parquet(path)
    query = L.closed_klines(spark.readStream.schema("message string").parquet(path)).writeStream.format("memory").queryName("closed").trigger(availableNow=True).start()
    query.awaitTermination(200)
    live = sorted((r.symbol, r.interval, r.close is not None, r.volume) for r in spark.table("closed").collect())
    assert live == sorted((r.symbol, r.interval, r.close is not None, r.volume) for r in M.parse_klines(df).collect()) == [("A", "1h", False, None), ("A", "1h", True, None)]
