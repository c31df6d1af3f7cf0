"""One stream of typed events, and what subscribes to it.

An event is a time, a type and a payload in JSON. `typed` parses the payload once, as VARIANT, and says what is wrong
with those that can't be taken; a view has a type's fields as columns. `fan_out` hands each micro-batch to several
sinks: subscribers of one type, of several or of all, and the rejects; a sink's folder for a batch has the batch's number, so
that one repeated after a failure replaces itself. Back-pressure is the source's limit of files or rows per trigger.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import alerts as A

# The types of events.
TYPES = (
    "market.tick", "market.kline", "strategy.signal", "ml.prediction", "news.update", "news.alert", "risk.check", "risk.breach",
    "order.request", "order.update", "position.update", "position.exit", "position.reduce", "alert.trigger", "ai.suggestion",
    "ai.market_state", "system.shutdown",
)
#: Fields that a type's view has; those with a mark must be there, with a value of that kind.
FIELDS: dict[str, dict[str, str]] = {
    "market.tick": {"symbol": "string!", "price": "double!", "volume": "double"},
    "market.kline": {"symbol": "string!", "interval": "string!", "close": "double", "volume": "double"},
    "strategy.signal": {"symbol": "string!", "side": "string!", "price": "double", "strategy": "string"},
    "ml.prediction": {"symbol": "string!", "interval": "string", "confidence": "double!"},
    "news.update": {"symbol": "string", "title": "string", "sentiment": "double", "impact_level": "int"},
    "news.alert": {"symbol": "string", "reason": "string", "message": "string"},
    "risk.check": {"symbol": "string!", "approved": "boolean", "reason": "string"},
    "risk.breach": {"event_type": "string!", "level": "string", "detail": "string"},
    "order.request": {"symbol": "string!", "side": "string!", "quantity": "double!", "price": "double"},
    "order.update": {"order_id": "string", "symbol": "string!", "status": "string!"},
    "position.update": {"symbol": "string!", "side": "string", "quantity": "double", "pnl": "double", "closed": "boolean"},
    "position.exit": {"symbol": "string!", "reason": "string"},
    "position.reduce": {"symbol": "string!", "pct": "double!"},
    "alert.trigger": {"type": "string", "level": "string", "message": "string", "symbol": "string"},
    "ai.suggestion": {"type": "string", "content": "string"},
    "ai.market_state": {"state": "string", "confidence": "double"},
    "system.shutdown": {},
}
LONGEST = 200


def _field(payload: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(payload, f"$.{name}", kind.rstrip("!"))


def typed(events: DataFrame) -> DataFrame:
    """`events` (ts, type, payload: string) with data (VARIANT) and problem: null for a good one, else the first of "type", "json",
    "object" (a payload that is none; a null or empty one counts as an empty object) or the name of a field that is missing.

    A field that must be there is missing if it is absent, null, or no value of its kind.
    """
    text = F.coalesce(F.nullif(F.trim("payload"), F.lit("")), F.lit("{}"))
    rows = events.withColumn("data", F.try_parse_json(text))
    required = {t: [(n, k) for n, k in fields.items() if k.endswith("!")] for t, fields in FIELDS.items()}
    missing = F.lit(None).cast("string")
    for name, fields in required.items():
        own = F.coalesce(*[F.when(_field(F.col("data"), n, k).isNull(), n) for n, k in fields]) if fields else F.lit(None).cast("string")
        missing = F.when(F.col("type") == name, own).otherwise(missing)
    kind = F.schema_of_variant("data")
    known = F.coalesce(F.col("type").isin(*TYPES), F.lit(False))
    return rows.withColumn("problem", F.when(~known, "type").when(F.col("data").isNull(), "json").when(~F.startswith(kind, F.lit("OBJECT")), "object").otherwise(missing))


def view(rows: DataFrame, kind: str) -> DataFrame:
    """(ts, fields ...) of the good events of a type; a value of another kind is null."""
    return rows.where(F.col("problem").isNull() & (F.col("type") == kind)).select("ts", *[_field(F.col("data"), n, k).alias(n) for n, k in FIELDS[kind].items()])


def fan_out(root: str, subscribers: Mapping[str, Sequence[str] | None]):
    """A foreachBatch function over events (ts, type, payload).

    `subscribers`: the types of each, None for all; each has a folder `root`/<name>/batch=<number> of (ts, type, payload), and
    bad events are in `root`/rejects with their problem. An event that nobody subscribes to is in none. The batch is parsed
    once, for all.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = typed(batch).drop("data").persist()
        try:
            good = rows.where("problem IS NULL").select("ts", "type", "payload")
            for name, types in subscribers.items():
                own = good if types is None else good.where(F.col("type").isin(*types))
                own.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
            rows.where("problem IS NOT NULL").select("ts", "type", "payload", "problem").write.mode("overwrite").parquet(f"{root}/rejects/batch={number}")
        finally:
            rows.unpersist()

    return write


def matched_alerts(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(ts, name, level, type, message, symbol, cooldown_seconds) of the good events of `typed` that meet a rule (`alerts.RULE`).

    The message is the event's message, else its detail, else the rule's name, cut to 200 characters.
    """
    text = lambda n: F.try_variant_get("data", f"$.{n}", "string")
    names = [n for n in dict.fromkeys(n for fields in FIELDS.values() for n in fields)]
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), text(n).alias("value")) for n in names]), lambda e: e["value"].isNotNull())
    own = rows.where("problem IS NULL").select("ts", "type", F.map_from_entries(entries).alias("data"), text("message").alias("_message"), text("detail").alias("_detail"), text("symbol").alias("symbol"))
    said = F.left(F.coalesce(F.nullif("_message", F.lit("")), F.nullif("_detail", F.lit("")), F.col("name")), F.lit(LONGEST))
    return A.match(own, rules).select("ts", "name", "level", "type", said.alias("message"), F.coalesce("symbol", F.lit("")).alias("symbol"), "cooldown_seconds")


def keep_alerts(root: str, rules: DataFrame):
    """A foreachBatch function over events that keeps the alerts of all rules under `root`, by batch."""

    def write(batch: DataFrame, number: int) -> None:
        matched_alerts(typed(batch), rules).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return write
