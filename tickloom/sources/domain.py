"""The engine's domain tables as views of the star-schema test tables.

ticks come from events, bars from ticks, trades from line items, and equity from a running sum over events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import running_total
from ..operators.resample import resample


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @property
    def ticks(self) -> DataFrame:
        """(symbol, ts, price, volume, seq)."""
        volume = F.get_json_object("props", "$.k").cast("double")
        return self.events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), volume.alias("volume"), F.col("event_id").alias("seq"))

    def bars(self, interval: str = "1h") -> DataFrame:
        return resample(self.ticks, interval)

    @property
    def trades(self) -> DataFrame:
        """Closed trades: (trade_id, line, part_id, strategy, symbol, side, entry_price, exit_price, quantity, opened_at,
        closed_at)."""
        # What depends on a line alone is made before the joins, so that their shuffles carry little of it.
        lines = self.lineitem.select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate", F.concat("l_returnflag", "l_linestatus").alias("strategy"),
            F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(-1).alias("side"), F.try_divide("l_extendedprice", "l_quantity").alias("exit_price"),
        )
        dated = lines.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumns({"opened_at": F.least("o_orderdate", "l_shipdate"), "closed_at": F.greatest("o_orderdate", "l_shipdate")})
        return dated.join(self.part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("trade_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"), "strategy",
            F.col("p_brand").alias("symbol"), "side", F.col("p_retailprice").alias("entry_price"), "exit_price", F.col("l_quantity").alias("quantity"), "opened_at", "closed_at",
        )

    @property
    def equity(self) -> DataFrame:
        """(event_id, ts, equity): 100,000 and a running sum of each event's value over its type's mean.

        Changes are decimals of 6 digits, so that sums don't depend on their order and can be made day by day.
        """
        mean = self.events.groupBy("event_type").agg(F.avg("value").alias("mean"))
        change = self.events.join(mean, "event_type").select("event_id", "ts", F.round(F.col("value") - F.col("mean"), 6).cast("decimal(28,6)").alias("change"))
        total = running_total(change, F.col("change"), "total", (), ("ts", "event_id"))
        return total.select("event_id", "ts", F.round(F.col("total") + 100000, 3).cast("double").alias("equity"))


#: The same views in SQL, for the oracles.
SQL = {
    "ticks": "SELECT event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_id AS seq FROM events",
    "trades": """SELECT l_orderkey AS trade_id, l_linenumber AS line, l_partkey AS part_id, l_returnflag || l_linestatus AS strategy, p_brand AS symbol,
        CAST(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS INTEGER) AS side, p_retailprice AS entry_price,
        l_extendedprice / nullif(l_quantity, 0) AS exit_price, l_quantity AS quantity,
        least(o_orderdate, l_shipdate) AS opened_at, greatest(o_orderdate, l_shipdate) AS closed_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "equity": """SELECT event_id, ts, CAST(round(100000 + sum(change) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS DOUBLE) AS equity
        FROM (SELECT event_id, ts, CAST(round(value - avg(value) OVER (PARTITION BY event_type), 6) AS DECIMAL(28,6)) AS change FROM events)""",
}


def bars_sql(minutes: int) -> str:
    return f"""SELECT symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS bar_start,
        time_bucket(INTERVAL '{minutes} minutes', ts) + INTERVAL '{minutes} minutes' AS bar_end,
        first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close,
        sum(volume) AS volume FROM ticks GROUP BY ALL"""
