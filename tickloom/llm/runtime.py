"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python group should hold.
GROUP_BYTES = 8 << 20


#: Bytes of the Arrow batches that Python workers of text operators are sent: several of one are held at a time.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches have BATCH_BYTES at most (one row may have more)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Tables that `stored` has written and nobody has released.
_TABLES: list[str] = []


#: Whether Spark deletes a write's shuffle files when it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a small table in one file.
FILE_ROWS, LEAST_FILES = 1 << 18, 6


def stored(df: DataFrame, fmt: str = "parquet", rows: int | None = None, **options) -> DataFrame:
    """Cut the lineage: write `df` as a table in the shared folder and read it back. It stays until it is released; the shuffle
    files of its making, which nothing needs any more, go at once.

    `rows`: about how many rows it has, where that is known: then it has a file for each FILE_ROWS, LEAST_FILES at least,
    instead of one for each of the session's shuffle partitions.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    _TABLES.append(path)
    schema = df.schema
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, math.ceil(rows / FILE_ROWS)))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.format(fmt).options(**options).save(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(schema).format(fmt).load(path)


def tables() -> list[str]:
    """The paths of stored tables, in the order of their writing."""
    return [*_TABLES]


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete stored tables that no result needs any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _TABLES:
            _TABLES.remove(path)


def shared_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession, total_bytes: int, each: int = 32 << 20) -> int:
    """A partition for each `each` bytes, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / each))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one aggregate, with one long for the driver."""
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def payload(docs: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """Columns of `docs` (None: all) as one struct, so that none can clash with an operator's own."""
    return F.struct(*[quoted(c) for c in (docs.columns if columns is None else columns)])


def shared_file(spark: SparkSession, data: bytes) -> tuple[str, str]:
    """(name, path) of a new file of the shared folder with these bytes. It stays until it is released."""
    path = shared_path(spark)
    _TABLES.append(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i : i + (1 << 20)]))
    out.close()
    return path.rpartition("/")[2], path
