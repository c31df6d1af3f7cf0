"""Alert rules: matching, cooldown and messages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE = "name string, event_type string, condition map<string,string>, level string, cooldown_seconds double, enabled boolean, description string"


#: Levels from the least to the greatest priority; others come before them all.
LEVELS = ("info", "warning", "critical")


def priority(level: Column | str) -> Column:
    """3 for critical alerts, 2 for warnings, 1 for information, 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.col(level) if isinstance(level, str) else level).cast("int"), F.lit(0))


def match(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events (type, data map, ...) with each enabled rule of their type (or of any) all whose fields they have.

    Rules are configuration: a handful of rows, which Spark broadcasts by their size.
    """
    r = rules.where("enabled").select("name", F.col("event_type").alias("rule_type"), "condition", "level", "cooldown_seconds")
    fits = (F.col("rule_type") == "*") | (F.col("rule_type") == F.col("type"))
    fields = F.forall(F.map_entries("condition"), lambda e: F.coalesce(F.col("data")[e.key] == e.value, F.lit(False)))
    return events.join(r, fits & fields)


def cooldown(times: Column, seconds: Column) -> Column:
    """Of an ascending array of times (seconds) those that fire: each at least `seconds` after the last that fired."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("fired"))
    step = lambda a, t: F.when(a.last.isNull() | (t - a.last >= seconds), F.struct(t.alias("last"), F.array_append(a.fired, t).alias("fired"))).otherwise(a)
    return F.aggregate(times, start, step, lambda a: a.fired)


def fired(matched: DataFrame) -> DataFrame:
    """(name, ts) of the matches (name, ts, cooldown_seconds) that fire.

    After a pause of at least the cooldown a match fires whatever was before, so a rule's matches fall apart into bursts
    that don't depend on each other. A burst is gone through with one search for each match that fires, over its times
    as numbers; matches of one microsecond count as one.
    """
    by = Window.partitionBy("name").orderBy("_us")
    rows = matched.groupBy("name", F.unix_micros(F.col("ts").cast("timestamp")).alias("_us")).agg(F.first("cooldown_seconds").alias("c"))
    begins = F.coalesce(F.col("_us") - F.lag("_us").over(by) >= F.col("c") * 1e6, F.lit(True))
    bursts = rows.withColumn("_burst", F.sum(begins.cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        times, pause = np.sort(table.column("_us").to_numpy()), float(table.column("c")[0].as_py()) * 1e6
        at, out = 0, []
        while at < len(times):
            out.append(int(times[at]))
            at = max(at + 1, int(np.searchsorted(times, times[at] + pause)))
        return pa.table({"name": pa.array([key[0].as_py()] * len(out), pa.string()), "_us": pa.array(out, pa.int64())})

    found = bursts.groupBy("name", "_burst").applyInArrow(run, "name string, _us long")
    return found.select("name", F.timestamp_micros("_us").cast("timestamp_ntz").alias("ts"))


def message(text: Column, detail: Column, rule: Column) -> Column:
    """The first of them that isn't empty, 200 characters at most."""
    return F.left(F.coalesce(F.nullif(text, F.lit("")), F.nullif(detail, F.lit("")), rule), F.lit(200))


def counts(alerts: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(level, n) of all given levels, 0 where there is none."""
    every = alerts.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    return every.join(alerts.groupBy("level").agg(F.count("*").alias("n")), "level", "left").na.fill(0, ["n"])


def filtered(alerts: DataFrame, level: str | None = None, kinds: str | None = None, search: str | None = None, limit: int = 50) -> DataFrame:
    """The latest alerts of a level, of kinds (separated by commas) and with a text in message or symbol."""
    out = alerts
    if level:
        out = out.where(F.col("level") == level)
    if kinds:
        any_of = F.lit(False)
        for k in filter(None, map(str.strip, kinds.split(","))):
            any_of = any_of | F.col("type").ilike(f"%{k}%")
        out = out.where(any_of)
    if search:
        out = out.where(F.col("message").ilike(f"%{search}%") | F.col("symbol").ilike(f"%{search}%"))
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
