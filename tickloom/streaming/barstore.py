"""Bars that a stream keeps up to date, at a bounded cost of reading.

Each micro-batch is a folder under its number; reading merges them, the last one of a key winning. Compaction writes what
they say together as one base, sorted by symbol and time, and then commits it by one row that names the base and the last
batch in it; readers take the last committed base and the batches after it. So a compaction that is broken off changes
nothing, and a batch that is repeated after a failure replaces itself. A batch may also replace whole series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "version int, upto long"


@dataclass(frozen=True)
class BarStore:
    """`root`: a folder that driver and executors share; `schema`: the DDL of the rows; `keys`: what tells them apart, the
    first being the series."""

    root: str
    schema: str
    keys: Sequence[str] = ("symbol", "bar_start")

    def _rows(self, spark: SparkSession, path: str, schema: str) -> DataFrame | None:
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def committed(self, spark: SparkSession) -> tuple[int, int]:
        """The last base (0 for none) and the last batch in it (-1 for none)."""
        rows = self._rows(spark, f"{self.root}/commits", COMMIT)
        last = rows.agg(F.max(F.struct("version", "upto"))).first()[0] if rows is not None else None
        return (0, -1) if last is None else (last["version"], last["upto"])

    def write(self, batch: DataFrame, number: int, replaces: bool = False) -> None:
        """Keep `batch` as batch `number`; also as a function of foreachBatch. Rows without a key are left out. With `replaces`
        the series that it holds are what it says: their rows of earlier batches don't count any more."""
        names = [f.strip().split(" ")[0] for f in self.schema.split(",")]
        rows = batch.dropna(subset=[*self.keys]).select(*names, F.lit(replaces).alias("_replaces"))
        rows.write.mode("overwrite").parquet(f"{self.root}/batches/batch={number}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows as they are now: of each key the one of the last batch; of repeats inside a batch the greatest row."""
        return self._merged(spark, *self.committed(spark), None)

    def folders(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches that `read` looks at beside the base."""
        rows = self._rows(spark, f"{self.root}/batches", f"{self.schema}, _replaces boolean, batch long")
        upto = self.committed(spark)[1]
        return [] if rows is None else sorted(r["batch"] for r in rows.where(F.col("batch") > upto).select("batch").distinct().collect())

    def _merged(self, spark: SparkSession, version: int, after: int, last: int | None) -> DataFrame:
        base = self._rows(spark, f"{self.root}/bases/version={version}", self.schema) if version else None
        rows = self._rows(spark, f"{self.root}/batches", f"{self.schema}, _replaces boolean, batch long")
        if rows is None:
            return base if base is not None else spark.createDataFrame([], self.schema)
        rows = rows.where(F.col("batch") > after)  # prunes folders
        rows = rows.where(F.col("batch") <= last) if last is not None else rows
        if base is not None:
            rows = rows.unionByName(base.withColumns({"_replaces": F.lit(False), "batch": F.lit(-1).cast("long")}))
        series, rest = self.keys[0], [c for c in rows.columns if c not in (*self.keys, "_replaces", "batch")]
        # Batches that replace a series are counted over the series' batches, of which there are few.
        since = rows.where("_replaces").groupBy(F.col(series).alias("_series")).agg(F.max("batch").alias("_since"))
        kept = rows.join(since, F.col(series) == F.col("_series"), "left").where(F.col("_since").isNull() | (F.col("batch") >= F.col("_since")))
        best = F.max(F.struct("batch", *rest)).alias("r")
        return kept.groupBy(*self.keys).agg(best).select(*self.keys, *[F.col(f"r.{c}").alias(c) for c in rest])

    def compact(self, spark: SparkSession) -> bool:
        """Make a new base of the last one and all batches so far, and take away what the base before it was made of. False if
        there is no batch to take in."""
        version, after = self.committed(spark)
        new = self.folders(spark)
        if not new:
            return False
        merged = self._merged(spark, version, after, new[-1])
        path = f"{self.root}/bases/version={version + 1}"
        merged.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(path)
        self._commit(spark, version + 1, new[-1])
        # Readers may still hold the last base and its batches: what that one was made of is gone through by nobody.
        gone = [f"{self.root}/bases/version={version - 1}"] if version > 1 else []
        gone += [f"{self.root}/batches/batch={n}" for n in self._older(spark, after)]
        for place in gone:
            p = spark._jvm.org.apache.hadoop.fs.Path(place)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        return True

    def _older(self, spark: SparkSession, upto: int) -> list[int]:
        rows = self._rows(spark, f"{self.root}/batches", f"{self.schema}, _replaces boolean, batch long")
        return [] if rows is None else [r["batch"] for r in rows.where(F.col("batch") <= upto).select("batch").distinct().collect()]

    def _commit(self, spark: SparkSession, version: int, upto: int) -> None:
        spark.createDataFrame([(version, upto)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def keeper(self, every: int = 100):
        """A foreachBatch function that keeps each batch, and compacts after every so many."""

        def keep(batch: DataFrame, number: int) -> None:
            self.write(batch, number)
            if (number + 1) % every == 0:
                self.compact(batch.sparkSession)

        return keep
