"""Bars kept by a stream, typed events and their sinks, and the comparison of runs, against brute force."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tickloom.operators import alerts as A
from tickloom.operators import compare as M
from tickloom.operators import signals as S
from tickloom.streaming import bus as B
from tickloom.streaming.barstore import BarStore

T = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, bar_start timestamp_ntz, close double, volume double"


def batches(n, seed=1):
    rng = random.Random(seed)
    return [[(rng.choice("abc"), T + dt.timedelta(hours=rng.randint(0, 30)), float(rng.randint(1, 99)), None if rng.random() < 0.1 else 1.0) for _ in range(rng.randint(0, 6))] for _ in range(n)]


def merged(all_, replacing=()):
    out = {}
    for n, rows in enumerate(all_):
        if n in replacing:
            for s in {r[0] for r in rows}:
                out = {k: v for k, v in out.items() if k[0] != s}
        best = {}
        for s, t, *rest in rows:
            best[s, t] = max(best.get((s, t), rest), rest, key=lambda v: [(x is not None, x) for x in v])
        out |= best
    return sorted((*k, *v) for k, v in out.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("symbol", "bar_start", "close", "volume").collect())


def test_bars_are_those_of_the_last_batch_at_bounded_cost(spark, tmp_path):
    store, all_ = BarStore(str(tmp_path / "s"), SCHEMA), batches(30)
    assert store.read(spark).count() == 0 and not store.compact(spark)
    keep = store.keeper(every=8)
    for n, rows in enumerate(all_):
        df = spark.createDataFrame(rows, SCHEMA)
        keep(df.unionByName(spark.createDataFrame([(None, T, 1.0, 1.0), ("a", None, 1.0, 1.0)], SCHEMA)).withColumn("extra", F.lit(1)), n)
        assert len(store.folders(spark)) < 8
    assert rows_of(store.read(spark)) == merged(all_)
    keep(spark.createDataFrame(all_[-1], SCHEMA), 29)  # the last batch once more, as after a failure
    assert rows_of(store.read(spark)) == merged(all_)
    assert len([p for p in (tmp_path / "s" / "batches").iterdir() if p.name.startswith("batch=")]) <= 16 + 6
    assert len([p for p in (tmp_path / "s" / "bases").iterdir() if p.name.startswith("version=")]) <= 2


@pytest.mark.parametrize("fails", [0, 1])
def test_a_compaction_that_is_killed_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, fails):
    """The base, or the commit, can't be written; batches go on; the next compaction takes them all."""
    store, all_ = BarStore(str(tmp_path / "s"), SCHEMA), batches(9, 3)
    for n, rows in enumerate(all_[:6]):
        store.write(spark.createDataFrame(rows, SCHEMA), n)
        if n == 2:
            assert store.compact(spark)
    written, real = [], DataFrameWriter.parquet

    def parquet(self, path, *more, **options):
        written.append(path)
        if len(written) == fails + 1:
            raise OSError("killed")
        return real(self, path, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    with pytest.raises(OSError, match="killed"):
        store.compact(spark)
    monkeypatch.setattr(DataFrameWriter, "parquet", real)
    assert rows_of(store.read(spark)) == merged(all_[:6]) and store.committed(spark) == (1, 2)
    for n, rows in enumerate(all_[6:], 6):
        store.write(spark.createDataFrame(rows, SCHEMA), n)
    assert store.compact(spark) and store.committed(spark) == (2, 8) and store.folders(spark) == []
    assert rows_of(store.read(spark)) == merged(all_)


def test_a_batch_can_replace_series(spark, tmp_path):
    store, all_ = BarStore(str(tmp_path / "s"), SCHEMA), batches(8, 7)
    for n, rows in enumerate(all_):
        store.write(spark.createDataFrame(rows, SCHEMA), n, replaces=n in (2, 5))
        assert rows_of(store.read(spark)) == merged(all_[: n + 1], (2, 5))
        if n in (3, 6):
            store.compact(spark)
            assert rows_of(store.read(spark)) == merged(all_[: n + 1], (2, 5))


# --- events -------------------------------------------------------------------------------------------------

EVENTS = [
    ("market.tick", '{"symbol": "a", "price": 1.5, "more": [1]}', None), ("market.tick", '{"symbol": "a", "price": "2"}', None), ("market.tick", '{"symbol": "a", "price": "x"}', "price"),
    ("market.tick", '{"price": 1}', "symbol"), ("market.tick", '{"symbol": null, "price": 1}', "symbol"), ("market.tick", "{", "json"), ("market.tick", "[]", "object"), ("market.tick", "3", "object"), ("market.tick", "null", "object"),
    ("system.shutdown", None, None), ("system.shutdown", "  ", None), ("ai.suggestion", '{"content": "é 漢"}', None), ("unknown", "{}", "type"), (None, "{}", "type"), ("", None, "type"),
    ("risk.breach", '{"event_type": "trip", "detail": "a loss", "level": "critical"}', None), ("position.update", '{"symbol": "b", "closed": true, "quantity": 2}', None),
    ("alert.trigger", '{"type": "signal_rejected", "message": "' + "m" * 300 + '"}', None), ("alert.trigger", '{"type": "signal_rejected", "message": ""}', None),
]


def events(spark):
    return spark.createDataFrame([(T + dt.timedelta(seconds=i), k, p, w) for i, (k, p, w) in enumerate(EVENTS)], "ts timestamp, type string, payload string, want string")


def test_what_is_wrong_with_events(spark):
    assert len(B.TYPES) == 17 == len(B.FIELDS) and set(B.TYPES) == set(B.FIELDS)
    got = B.typed(events(spark)).collect()
    assert [(r.type, r.payload, r.problem) for r in got if r.problem != r.want] == []
    for kind in B.TYPES:  # every type has a view, and takes an event with all its fields
        value = {"string": "s", "double": 1.5, "int": 3, "boolean": True}
        body = {n: value[k.rstrip("!")] for n, k in B.FIELDS[kind].items()}
        rows = B.typed(spark.createDataFrame([(T, kind, json.dumps(body))], "ts timestamp, type string, payload string"))
        assert B.view(rows, kind).first().asDict() == {"ts": T} | body
    seen = B.view(B.typed(events(spark)), "market.tick").collect()
    assert [(r.symbol, r.price, r.volume) for r in seen] == [("a", 1.5, None), ("a", 2.0, None)]


def test_sinks_of_a_stream(spark, tmp_path):
    """Subscribers of one type, of some and of all; a batch that fails halfway and is repeated doubles nothing."""
    path, out, n = str(tmp_path / "in"), str(tmp_path / "out"), len(EVENTS)
    for i in range(2):
        events(spark).drop("want").where(F.second("ts") % 2 == i).coalesce(1).write.mode("append").parquet(path)
    subscribers = {"ticks": ["market.tick"], "account": ["risk.breach", "position.update"], "all": None, "none": []}
    write, failed = B.fan_out(out, subscribers), []

    def once(batch, number):
        write(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise OSError("lost after the sinks were written")

    for _ in range(2):
        stream = spark.readStream.schema("ts timestamp, type string, payload string").option("maxFilesPerTrigger", 1).parquet(path)
        query = stream.writeStream.foreachBatch(once).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(300)
        except Exception as e:  # noqa: BLE001  the failed batch, as a StreamingQueryException
            assert "lost after" in str(e)
    good = sorted((str(k), str(p)) for k, p, w in EVENTS if w is None)
    read = lambda name: sorted((str(r.type), str(r.payload)) for r in spark.read.parquet(f"{out}/{name}").collect())
    assert failed and read("all") == good and read("ticks") == [g for g in good if g[0] == "market.tick"]
    assert read("account") == [g for g in good if g[0] in ("risk.breach", "position.update")] and read("none") == []
    assert sorted(r.problem for r in spark.read.parquet(f"{out}/rejects").collect()) == sorted(w for _, _, w in EVENTS if w) and n == len(good) + 10


def test_alerts_of_rules_are_kept(spark, tmp_path):
    """Rules written as JSON and read again; messages coalesced and cut; a repeated batch replaces itself."""
    from tickloom.sources.files import read_json, write_json

    rules = [("rejected", "alert.trigger", {"type": "signal_rejected"}, "warning", 300.0, True, "d"), ("breach", "*", {"level": "critical"}, "critical", 0.0, True, None), ("off", "*", {}, "info", 0.0, False, "")]
    write_json(spark.createDataFrame(rules, A.RULE), str(tmp_path / "rules"))
    loaded = read_json(spark, str(tmp_path / "rules"), A.RULE)
    assert sorted(map(repr, loaded.collect())) == sorted(map(repr, spark.createDataFrame(rules, A.RULE).collect()))
    keep = B.keep_alerts(str(tmp_path / "alerts"), loaded)
    for _ in range(2):
        keep(events(spark), 0)
    got = sorted((r.name, r.level, r.type, r.message, r.symbol) for r in spark.read.parquet(str(tmp_path / "alerts")).collect())
    assert got == [("breach", "critical", "risk.breach", "a loss", ""), ("rejected", "warning", "alert.trigger", "m" * 200, ""), ("rejected", "warning", "alert.trigger", "rejected", "")]


# --- comparison ---------------------------------------------------------------------------------------------


def test_trades_of_two_runs(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.choice("ab"), rng.choice(("x", None)), rng.choice((1, -1)), T + dt.timedelta(days=rng.randint(0, 2)), rng.choice((100.0, 101.0, 105.0, None))) for _ in range(n)]
    left, right, schema = make(80), make(60), "strategy string, symbol string, side int, opened_at timestamp_ntz, entry_price double"
    left += left[:5]  # repeated rows
    df = lambda rows: spark.createDataFrame(rows, schema).withColumn("ordinal", F.lit("mine"))
    got = M.match_trades(df(left), df(right), {"entry_price": 2.0}).collect()
    want = []
    for key in {r[:4] for r in (*left, *right)}:
        a, b = (sorted((r[4] for r in rows if r[:4] == key), key=lambda x: (x is not None, x or 0)) for rows in (left, right))
        for n in range(max(len(a), len(b))):
            if n >= len(b):
                status = "left"
            elif n >= len(a):
                status = "right"
            else:
                x, y = a[n], b[n]
                status = "same" if x is y is None or None not in (x, y) and abs(x - y) <= 2 else "different"
            want.append((*key, n + 1, status, a[n] if n < len(a) else None, b[n] if n < len(b) else None))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    counts = {r.strategy: tuple(r)[1:] for r in M.match_counts(spark.createDataFrame(got)).collect()}
    assert counts == {s: tuple(sum(1 for w in want if w[0] == s and w[5] == x) for x in ("same", "different", "left", "right")) for s in "ab"}
    assert M.match_trades(df(left).limit(0), df(right).limit(0), {"entry_price": 2.0}).count() == 0


def test_hash_of_configurations(spark):
    configs = [{"period": 14, "fast": 3}, {"fast": 3, "period": 14}, {}, {"a": None}, None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(configs)], "i int, c map<string,int>")
    got = [r.h for r in rows.orderBy("i").select(S.config_hash_of(F.col("c")).alias("h")).collect()]
    assert got == [None if c is None else S.config_hash(c) for c in configs] and got[0] == got[1]


def test_priority(spark):
    rows = spark.createDataFrame([("critical",), ("info",), ("warning",), ("other",), (None,)], "level string")
    assert [r.p for r in rows.select(A.priority("level").alias("p")).collect()] == [3, 1, 2, 0, 0]
