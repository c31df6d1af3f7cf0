"""Queries over the operational store: alerts, articles, ledgers, pages, and scalar functions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import recursive as R
from ..operators import alerts as A
from ..operators import store as S
from ..sources.domain import Tables
from . import sqlparts as Q
from .market import r
from .registry import query

LEVELS = ("critical", "warning", "info", "debug")
#: Alerts: an event's type is the symbol, its level follows from props.
_ALERTS = """a AS (SELECT event_id AS id, ts AS created_at, event_type AS type, CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS level,
  'user ' || user_id || ' did ' || event_type AS message, 'S' || user_id % 5 AS symbol FROM events)
"""  # fmt: skip


def alerts(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 3
    return t.events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("type"),
        F.when(k == 0, "critical").when(k == 1, "warning").otherwise("info").alias("level"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type")).alias("message"),
        F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("symbol"),
    )


query("alerts_filtered", _ALERTS + "SELECT id, created_at, type, level, message, symbol FROM a WHERE level = 'critical' AND (type ILIKE '%CLI%' OR type ILIKE '%view%') AND (message ILIKE '%user 1%' OR symbol ILIKE '%user 1%') ORDER BY created_at DESC, id DESC LIMIT 50")(
    lambda t: A.filtered(alerts(t), "critical", "CLI, view", "user 1")
)
query("alert_counts", _ALERTS + "SELECT l.level, coalesce(n, 0) AS n FROM (SELECT unnest(['critical', 'warning', 'info', 'debug']) AS level) l LEFT JOIN (SELECT level, count(*) AS n FROM a GROUP BY level) USING (level)")(lambda t: A.counts(alerts(t), LEVELS))
query("recent_top_n", _ALERTS + "SELECT id, created_at, message FROM a ORDER BY created_at DESC, id DESC LIMIT 30")(lambda t: alerts(t).orderBy(F.desc("created_at"), F.desc("id")).limit(30).select("id", "created_at", "message"))
query("recent_window_count", _ALERTS + "SELECT level, count(*) AS n FROM a WHERE created_at > (SELECT max(created_at) FROM a) - INTERVAL 1 day GROUP BY level")(
    lambda t: S.recent(alerts(t), "created_at", "1 day").groupBy("level").agg(F.count("*").alias("n"))
)
query("retention_cleanup", _ALERTS + "SELECT id, level FROM a WHERE created_at >= (SELECT max(created_at) FROM a) - INTERVAL 7 days")(lambda t: S.retain(alerts(t), "created_at", "7 days").select("id", "level"))
query("status_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")(
    lambda t: t.orders.where((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")
)
query("flag_update_rewrite", _ALERTS + "SELECT id, level, id % 10 = 0 AS acknowledged, CASE WHEN id % 10 = 0 THEN 'done' ELSE message END AS message FROM a")(
    lambda t: S.update(alerts(t).withColumn("acknowledged", F.lit(False)), F.col("id") % 10 == 0, {"acknowledged": F.lit(True), "message": F.lit("done")}).select("id", "level", "acknowledged", "message")
)
query("ai_heartbeat", """g AS (SELECT event_type AS task, max(ts) AS last FROM events GROUP BY event_type), n AS (SELECT max(ts) AS now FROM events)
SELECT task, CAST(date_diff('second', date_trunc('second', last), date_trunc('second', now)) AS BIGINT) AS age, CASE WHEN date_diff('second', date_trunc('second', last), date_trunc('second', now)) < 2 * 300 THEN 'ok' ELSE 'timeout' END AS status FROM g, n""")(  # fmt: skip
    lambda t: S.heartbeat(t.events.select(F.col("event_type").alias("task"), "ts"), 300)
)
query("paginate", _ALERTS + "SELECT id, created_at FROM a ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")(lambda t: S.page(alerts(t), 3, 20, [F.desc("created_at"), F.desc("id")]).select("id", "created_at"))
query("page_count", _ALERTS + "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM a")(lambda t: S.page_count(alerts(t), 20))
#: What comes first in a list by priority.
_PRIORITY = "CASE level WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
query("priority_sort", _ALERTS + f"SELECT id, level, {_PRIORITY} AS priority, created_at FROM a ORDER BY priority DESC, created_at DESC, id DESC LIMIT 100")(
    lambda t: alerts(t).withColumn("priority", A.priority("level")).orderBy(F.desc("priority"), F.desc("created_at"), F.desc("id")).limit(100).select("id", "level", "priority", "created_at")
)

_RULES = [
    ("breach", "click", {"level": "critical"}, "critical", 300.0, True, ""),
    ("any info", "*", {"level": "info"}, "info", 0.0, True, ""),
    ("off", "view", {}, "warning", 0.0, False, ""),
    ("purchases", "purchase", {}, "warning", 600.0, True, ""),
]


def _matched(t: Tables) -> DataFrame:
    rows = alerts(t).withColumn("data", F.create_map(F.lit("level"), F.col("level")))
    return A.match(rows.drop("level"), t.spark.createDataFrame(_RULES, A.RULE))


_MATCH = _ALERTS + ", m AS (SELECT id, created_at, CASE WHEN type = 'click' AND level = 'critical' THEN 'breach' END AS x, CASE WHEN level = 'info' THEN 'any info' END AS y, CASE WHEN type = 'purchase' THEN 'purchases' END AS z FROM a), f AS (SELECT id, created_at, unnest([x, y, z]) AS name FROM m)\n"
query("alert_rule_match", _MATCH + "SELECT id, name FROM f WHERE name IS NOT NULL")(lambda t: _matched(t).select("id", "name"))


@query("alert_cooldown", "RECURSIVE " + _MATCH.strip() + """,
b AS (SELECT epoch_us(created_at) / 1000000 AS s, row_number() OVER (ORDER BY created_at, id) AS i FROM f WHERE name = 'breach'),
g AS (SELECT i, s, true AS fires, s AS last FROM b WHERE i = 1 UNION ALL SELECT b.i, b.s, b.s - g.last >= 300, CASE WHEN b.s - g.last >= 300 THEN b.s ELSE g.last END FROM g JOIN b ON b.i = g.i + 1)
SELECT 'breach' AS name, count(*) FILTER (fires) AS fired FROM g""")  # fmt: skip
def alert_cooldown(t: Tables) -> DataFrame:
    rows = _matched(t).where("name = 'breach'").select("name", F.col("created_at").alias("ts"), "cooldown_seconds")
    return A.fired(rows).groupBy("name").agg(F.count("*").alias("fired"))


query("alert_message", _ALERTS + "SELECT id, left(coalesce(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE message END, ''), nullif(symbol, ''), 'rule'), 200) AS message FROM a")(
    lambda t: alerts(t).select("id", A.message(F.when(F.col("id") % 3 == 0, "").otherwise(F.col("message")), F.col("symbol"), F.lit("rule")).alias("message"))
)

# --- ledgers ------------------------------------------------------------------------------------------------

query("balance_ledger", "SELECT user_id, event_id, round(10000 + sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS balance FROM events")(
    lambda t: S.ledger(t.events, "value", ("user_id",), ("ts", "event_id"), 10_000).select("user_id", "event_id", r("balance", 4).alias("balance"))
)
query("trade_ledger", "SELECT trade_id, line, 'open' AS action, opened_at AS at, round(-entry_price * quantity, 4) AS cash FROM trades UNION ALL SELECT trade_id, line, 'close', closed_at, round(exit_price * quantity, 4) FROM trades")(
    lambda t: S.trade_ledger(t.trades).select("trade_id", "line", "action", "at", r("cash", 4).alias("cash"))
)
query("trade_group_state", "SELECT l_orderkey AS trade_group, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 4) AS remaining, CASE WHEN bool_and(l_linestatus = 'F') THEN 'closed' ELSE 'open' END AS status FROM lineitem GROUP BY l_orderkey")(
    lambda t: t.lineitem.groupBy(F.col("l_orderkey").alias("trade_group")).agg(r(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)), 4).alias("remaining"), F.when(F.bool_and(F.col("l_linestatus") == "F"), "closed").otherwise("open").alias("status"))
)
query("kv_latest", "SELECT k.key, coalesce(v.value, 'none') AS value FROM (SELECT DISTINCT event_type AS key FROM events UNION ALL SELECT 'missing') k LEFT JOIN (SELECT event_type AS key, arg_max(props, (ts, event_id)) AS value FROM events GROUP BY event_type) v USING (key)")(
    lambda t: S.latest_values(t.events.select(F.col("event_type").alias("key"), F.col("props").alias("value"), "ts", "event_id"), t.events.select(F.col("event_type").alias("key")).distinct().unionByName(t.spark.createDataFrame([("missing",)], "key string")), "none")
)

# --- news and sentiment -------------------------------------------------------------------------------------

query("impact_bucket", "SELECT event_id, CASE WHEN x > 0.7 THEN 5 WHEN x > 0.5 THEN 4 WHEN x > 0.3 THEN 3 WHEN x > 0.1 THEN 2 ELSE 1 END AS impact FROM (SELECT event_id, abs(value) / 100 AS x FROM events)")(
    lambda t: t.events.select("event_id", S.impact(F.abs("value") / 100).alias("impact"))
)
query("sentiment_parse", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(value / 1000, 6) ELSE 0.0 END::DOUBLE AS sentiment FROM events")(
    lambda t: t.events.select("event_id", r(S.parse_number(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.round(F.col("value") / 1000, 6).cast("string"))).otherwise("not a number"))).alias("sentiment"))
)
query("json_articles_normalize", "SELECT page_id, 'page ' || page_id AS title, url, CASE page_id % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'articles' ELSE 'results' END AS shape FROM pages")(
    lambda t: S.normalise_articles(_articles(t)).select("page_id", "title", "url", "shape")
)


def _articles(t: Tables) -> DataFrame:
    i, title = F.col("page_id"), F.concat(F.lit("page "), F.col("page_id").cast("string"))
    one = F.struct(title.alias("title"), F.col("url").alias("url"))
    other = F.struct(title.alias("headline"), F.col("url").alias("link"))
    text = F.when(i % 3 == 0, F.to_json(F.array(one))).when(i % 3 == 1, F.to_json(F.struct(F.array(other).alias("articles")))).otherwise(F.to_json(F.struct(F.array(one).alias("results"))))
    return t.pages.select("page_id", text.alias("body"))


query("sentiment_ema", "RECURSIVE a AS (SELECT source AS symbol, doc_id, CAST(quality - toxic AS DOUBLE) AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents JOIN labels USING (doc_id)), g AS (SELECT symbol, doc_id, n, 0.3::DOUBLE * x AS e FROM a WHERE n = 1 UNION ALL SELECT a.symbol, a.doc_id, a.n, g.e + 0.3::DOUBLE * (a.x - g.e) FROM g JOIN a ON a.symbol = g.symbol AND a.n = g.n + 1)\nSELECT symbol, doc_id, round(e, 6) + 0 AS sentiment FROM g")(
    lambda t: R.with_recursions(
        t.documents.join(t.labels, "doc_id").select(F.col("source").alias("symbol"), "doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("x")),
        [R.Recursion(("e",), ("x",), partial(R.decayed, alpha=0.3))], time=("doc_id",),
    ).select("symbol", "doc_id", r("e").alias("sentiment"))
)

_MOMENTUM = "RECURSIVE " + Q.BASE + """,
c AS (SELECT symbol, bar_start, n, (close / nullif(lag(close, 1) OVER w, 0) - 1) * 100 AS a, (close / nullif(lag(close, 3) OVER w, 0) - 1) * 100 AS b, (close / nullif(lag(close, 12) OVER w, 0) - 1) * 100 AS d FROM s WINDOW w AS (PARTITION BY symbol ORDER BY bar_start)),
m AS (SELECT symbol, bar_start, n, (CASE WHEN a IS NOT NULL THEN greatest(-1, least(1, a / 2)) * 0.5 END + CASE WHEN b IS NULL THEN 0 ELSE greatest(-1, least(1, b / 4)) * 0.3::DOUBLE END + CASE WHEN d IS NULL THEN 0 ELSE greatest(-1, least(1, d / 8)) * 0.2::DOUBLE END) / (0.5 + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN d IS NULL THEN 0 ELSE 0.2 END)::DOUBLE AS x FROM c),
g AS (SELECT symbol, bar_start, n, CASE WHEN x IS NULL THEN 0 ELSE 0.3::DOUBLE * x END AS e FROM m WHERE n = 0 UNION ALL SELECT m.symbol, m.bar_start, m.n, g.e + 0.3::DOUBLE * (coalesce(m.x, g.e) - g.e) FROM g JOIN m ON m.symbol = g.symbol AND m.n = g.n + 1)
SELECT symbol, bar_start, round(e, 6) + 0 AS sentiment FROM g"""  # fmt: skip
query("momentum_sentiment", _MOMENTUM)(lambda t: S.momentum_sentiment(t.bars("1h")).select("symbol", "bar_start", r("sentiment").alias("sentiment")))

# --- scalars, arrays, maps ----------------------------------------------------------------------------------

query("safe_cast", "SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 4 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS INTEGER), 14) AS period FROM events")(
    lambda t: t.events.select("event_id", S.safe_int(F.when(F.col("event_id") % 4 == 0, "x").otherwise(F.col("user_id").cast("string")), 14).alias("period"))
)
query("string_normalize", "SELECT c_custkey, regexp_replace(lower(replace(c_name, ' ', '_')), '[^a-z0-9_]', '', 'g') AS name FROM customer")(lambda t: t.customer.select("c_custkey", S.normalise_name(F.col("c_name")).alias("name")))
query("csv_param_split", "SELECT p_partkey, list_filter(list_transform(string_split(p_type || ' , ' || p_brand || ',', ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM part")(
    lambda t: t.part.select("p_partkey", S.split_list(F.concat("p_type", F.lit(" , "), "p_brand", F.lit(","))).alias("parts"))
)
query("split_key", "SELECT trade_id, line, split_part(strategy || '|' || symbol, '|', 1) AS strategy, split_part(strategy || '|' || symbol, '|', 2) AS symbol FROM trades")(
    lambda t: (lambda k: t.trades.select("trade_id", "line", F.split_part(k, F.lit("|"), F.lit(1)).alias("strategy"), F.split_part(k, F.lit("|"), F.lit(2)).alias("symbol")))(F.concat("strategy", F.lit("|"), "symbol"))
)
query("map_merge", "SELECT event_id, user_id AS a, event_type AS b, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(
    lambda t: (lambda m: t.events.select("event_id", m["a"].cast("long").alias("a"), m["b"].alias("b"), m["k"].cast("long").alias("k")))(
        S.merge_maps(F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.col("event_type")), F.create_map(F.lit("a"), F.col("user_id").cast("string")), F.from_json("props", "map<string,string>"))
    )
)
query("symbol_except", "SELECT c_nationkey, list_sort(list_distinct(list(c_mktsegment) FILTER (c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_acctbal < -990)))) AS kept FROM customer GROUP BY c_nationkey HAVING count(*) FILTER (c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_acctbal < -990)) > 0")(
    lambda t: t.customer.join(t.customer.where("c_acctbal < -990").select("c_mktsegment").distinct(), "c_mktsegment", "left_anti").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("kept"))
)
query("condition_array_union", "SELECT p_partkey, list_sort(list_distinct([p_brand, p_type, p_brand, 'close > sma'])) AS conditions FROM part")(
    lambda t: t.part.select("p_partkey", F.array_sort(F.array_union(F.array("p_brand", "p_type"), F.array(F.col("p_brand"), F.lit("close > sma")))).alias("conditions"))
)
query("progress_pct", "SELECT o_orderkey, round(o_custkey / greatest(CAST(o_orderkey % 5000 AS DOUBLE), 1) * 100, 1) AS pct FROM orders")(lambda t: t.orders.select("o_orderkey", S.progress(F.col("o_custkey"), F.col("o_orderkey") % 5000).alias("pct")))


@query("table_schema")
def table_schema(t: Tables) -> DataFrame:
    rows = [(name, f.name, f.dataType.simpleString()) for name in ("events", "orders", "lineitem") for f in getattr(t, name).schema.fields]
    return t.spark.createDataFrame(rows, "table_name string, column_name string, type string")


# --- typed events -------------------------------------------------------------------------------------------

#: Events of the bus: the table's as signals, predictions, ticks and some that can't be taken.
_BUS = """e AS (SELECT event_id AS id, ts, CASE event_id % 5 WHEN 0 THEN 'market.tick' WHEN 1 THEN 'ml.prediction' WHEN 2 THEN 'strategy.signal' WHEN 3 THEN 'no.type' ELSE 'position.update' END AS type,
  CASE event_id % 7 WHEN 0 THEN 'not json' WHEN 1 THEN '[1, 2]' WHEN 2 THEN NULL ELSE CAST(json_object('symbol', event_type, 'price', value, 'confidence', CASE WHEN event_id % 11 = 0 THEN NULL ELSE 0.25 END, 'side', CASE WHEN event_id % 2 = 0 THEN 'long' END) AS VARCHAR) END AS payload FROM events),
b AS (SELECT *, json_valid(payload) AS ok, CASE WHEN json_valid(payload) THEN payload END AS j FROM e),
p AS (SELECT *, CASE WHEN type = 'no.type' THEN 'type' WHEN payload IS NOT NULL AND NOT ok THEN 'json' WHEN payload IS NOT NULL AND json_type(j) <> 'OBJECT' THEN 'object'
  WHEN payload IS NULL OR j ->> 'symbol' IS NULL THEN 'symbol' WHEN type = 'market.tick' AND j ->> 'price' IS NULL THEN 'price' WHEN type = 'ml.prediction' AND j ->> 'confidence' IS NULL THEN 'confidence' WHEN type = 'strategy.signal' AND j ->> 'side' IS NULL THEN 'side' END AS problem FROM b)
"""  # fmt: skip


def _bus(t: Tables) -> DataFrame:
    from ..streaming.bus import typed

    i, names = F.col("event_id"), ("market.tick", "ml.prediction", "strategy.signal", "no.type", "position.update")
    body = F.to_json(F.struct(F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.when(i % 11 != 0, 0.25).alias("confidence"), F.when(i % 2 == 0, "long").alias("side")))
    payload = F.when(i % 7 == 0, "not json").when(i % 7 == 1, "[1, 2]").when(i % 7 != 2, body)
    kind = F.get(F.array(*map(F.lit, names)), (i % 5).cast("int"))
    return typed(t.events.select(i.alias("id"), "ts", kind.alias("type"), payload.alias("payload")))


query("event_problems", _BUS + "SELECT id, type, problem FROM p")(lambda t: _bus(t).select("id", "type", "problem"))


@query("event_view", _BUS + "SELECT ts, j ->> 'symbol' AS symbol, round(CAST(j ->> 'price' AS DOUBLE), 6) AS price FROM p WHERE problem IS NULL AND type = 'market.tick'")
def event_view(t: Tables) -> DataFrame:
    from ..streaming.bus import view

    return view(_bus(t), "market.tick").select("ts", "symbol", r("price").alias("price"))
