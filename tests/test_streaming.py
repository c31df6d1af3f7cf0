"""Live operators give what the batch operators give."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators.resample import resample
from tickloom.sources.domain import Tables
from tickloom.streaming import live as L

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ticks(spark, tmp_path_factory):
    """Three files in time order, and one tick far ahead that closes all buckets."""
    path = str(tmp_path_factory.mktemp("ticks"))
    rows = Tables(spark, ROOT).ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    cut = [r.ts for r in rows.select("ts").orderBy("ts").collect()]
    for i in range(3):
        lo, hi = cut[i * len(cut) // 3], cut[min((i + 1) * len(cut) // 3, len(cut) - 1)]
        last = i == 2
        rows.where((F.col("ts") >= lo) & ((F.col("ts") <= hi) if last else (F.col("ts") < hi))).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("end", dt.datetime(2030, 1, 1), 1.0, 1.0, 0)], L.TICKS).coalesce(1).write.mode("append").parquet(path)
    return path


def run(df, name, spark, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    query.awaitTermination(300)
    return spark.table(name)


def test_live_bars(spark, ticks, tmp_path):
    got = run(L.live_bars(L.read_ticks(spark, ticks), "1h"), "bars", spark, tmp_path)
    want = resample(Tables(spark, ROOT).ticks, "1h")
    key = lambda df: sorted((r.symbol, r.bar_start, r.open, r.high, r.low, r.close, round(r.volume, 6)) for r in df.select("symbol", F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "open", "high", "low", "close", "volume").collect() if r.symbol != "end")
    assert key(got) == key(want)


def test_late_ticks_are_dropped(spark, tmp_path):
    path = str(tmp_path / "late")
    t = dt.datetime(2024, 1, 1, 10)
    for rows in ([("a", t, 1.0, 1.0, 1)], [("a", t + dt.timedelta(hours=5), 2.0, 1.0, 2)], [("a", t, 9.0, 1.0, 3)], [("a", t + dt.timedelta(hours=9), 2.0, 1.0, 4)]):
        spark.createDataFrame(rows, L.TICKS).coalesce(1).write.mode("append").parquet(path)
    got = run(L.live_bars(L.read_ticks(spark, path, 1), "1h"), "late_bars", spark, tmp_path).orderBy("bar_start").collect()
    assert got[0].bar_start == t and got[0].high in (1.0, 9.0)


def test_sliding_and_sessions(spark, ticks, tmp_path):
    assert run(L.sliding_range(L.read_ticks(spark, ticks)), "sliding", spark, tmp_path).count() > 0
    got = run(L.sessions(L.read_ticks(spark, ticks)), "sessions", spark, tmp_path)
    assert got.where("symbol <> 'end'").agg(F.sum("ticks")).first()[0] == Tables(spark, ROOT).ticks.count()


def test_upserted_bars(spark, tmp_path):
    root = str(tmp_path / "store")
    write = L.upsert_bars(root)
    rows = lambda *x: spark.createDataFrame([*x], "symbol string, bar_start int, close double")
    write(rows(("a", 1, 1.0), ("a", 2, 2.0)), 0)
    write(rows(("a", 2, 3.0)), 1)
    write(rows(("a", 2, 3.0)), 1)
    assert sorted((r.bar_start, r.close) for r in L.read_upserted(spark, root).collect()) == [(1, 1.0), (2, 3.0)]


def _stateful(spark, df, name, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run(df, name, spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_cooldown_state(spark, tmp_path):
    path, t = str(tmp_path / "m"), dt.datetime(2024, 1, 1)
    for seconds in ((0, 100), (299, 300), (450, 601)):
        spark.createDataFrame([("r", t + dt.timedelta(seconds=s), 300.0) for s in seconds], "name string, ts timestamp, cooldown_seconds double").coalesce(1).write.mode("append").parquet(path)
    rows = spark.readStream.schema("name string, ts timestamp, cooldown_seconds double").option("maxFilesPerTrigger", 1).parquet(path)
    got = _stateful(spark, L.fired(rows), "fired", tmp_path)
    assert sorted((r.ts - t).total_seconds() for r in got.collect()) == [0, 300, 601]


def test_sentiment_state(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    path2, schema2 = str(tmp_path / "s"), "symbol string, ts timestamp, sentiment double"
    spark.createDataFrame([("x", t, 1.0), ("x", t + dt.timedelta(hours=1), 0.0)], schema2).coalesce(1).write.parquet(path2)
    got = _stateful(spark, L.live_sentiment(spark.readStream.schema(schema2).parquet(path2)), "sentiments", tmp_path)
    assert sorted(r.sentiment for r in got.collect()) == pytest.approx([0.21, 0.3])
