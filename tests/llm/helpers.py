"""Small documents with every awkward case."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, marks of other scripts."""
    long_line = " ".join(f"w{i % 7919}" for i in range(40_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, "   \n\t ", "en", None, 6), (4, "one", "en", "b", 3), (5, "one", "en", "b", 3),
        (6, long_line, "de", "b", len(long_line)), (7, f"x {passage} y", "en", "c", 1), (8, f"{passage}\nz", None, None, 1), (8, f"{passage}\nz", None, None, 1),
        (None, "a line that is long enough for dedup\nother", "en", "c", 1), (9, "  A Line that is long enough for DEDUP \nmore", "en", "c", 1),
        (10, "a line that is long enough for dedup\r\nétude 漢字 🙂 don't 'tis   12³!?", "fr", "d", 1), (11, "a line that is long enough for dedup\na line that is long enough for dedup", "en", "d", 2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark, names):
    """The awkward rows with extra columns of the operator's own names."""
    from pyspark.sql import functions as F

    df = awkward(spark)
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit("mine"))
    return df


def words(text):
    return WORD.findall(text or "")
