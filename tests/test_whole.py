"""Queries that take every row of their input, against SQL of this file, which leaves out none."""

from __future__ import annotations

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tickloom.plans import indicators, market  # noqa: F401
from tickloom.plans.registry import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"
UPNL = """WITH l AS (SELECT event_type AS symbol, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY event_type),
p AS (SELECT event_id, event_type AS symbol, value AS entry, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side FROM events),
u AS (SELECT p.*, (coalesce(l.price, p.entry) - p.entry) * p.quantity * p.side AS upnl FROM p LEFT JOIN l USING (symbol))
"""
POSITIONS = {
    "unrealized_pnl": "SELECT event_id, upnl FROM u",
    "emergency_stop": "SELECT event_id, symbol FROM u WHERE upnl / nullif(entry * quantity, 0) * 100 <= -5",
    "close_worst": "SELECT symbol, arg_min(event_id, (upnl, event_id)) AS event_id, min(upnl) AS upnl FROM u GROUP BY symbol",
    "portfolio_exposure": "SELECT symbol, sum(entry * quantity) AS invested, sum(entry * quantity) / 1000 AS exposure_pct, sum(upnl) AS upnl FROM u GROUP BY symbol",
    "portfolio_context": "SELECT string_agg(symbol || ':' || n, ', ' ORDER BY symbol) AS context FROM (SELECT symbol, count(*) AS n FROM u GROUP BY symbol)",
}


def same(spark, name, sql):
    """Equal rows; numbers to 6 digits behind the point, as the queries round them."""
    got = QUERIES[name](spark, ROOT)
    done = connect(ROOT).execute(sql)
    assert got.columns == [d[0] for d in done.description]
    key = lambda row: [str(x) for x in row if not isinstance(x, float)]
    found, want = sorted(map(tuple, got.collect()), key=key), sorted(done.fetchall(), key=key)
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, rel=1e-12, abs=1e-6) if isinstance(y, float) else y)


@pytest.mark.parametrize("name", POSITIONS)
def test_every_event_is_a_position(spark, name):
    same(spark, name, UPNL + POSITIONS[name])


@pytest.mark.parametrize("name, cut", [("signal_price_join", " WHERE t.seq % 10 = 0"), ("signal_lookup_default", " WHERE t.seq % 25 = 0")])
def test_every_tick_is_looked_up(spark, name, cut):
    """The registered SQL without its cut of the ticks, if it has it."""
    whole = ORACLES[name].replace(cut, "")
    names, rows = rows_of(QUERIES[name](spark, ROOT))
    assert (names, rows) == rows_of_sql(connect(ROOT), whole)
    assert len(rows) == {"signal_price_join": 1, "signal_lookup_default": 3}[name] * spark.read.parquet(f"{ROOT}/events.parquet").count()
