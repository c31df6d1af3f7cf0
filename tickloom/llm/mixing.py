"""Operator 9: mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and cut, as one line of words, into blocks of equal size. Slot i of
the schedule draws the source in whose share of the cumulative weights the golden-ratio point frac(i * phi) falls;
the r-th slot of a source takes its block r, and from the first again when all are used. So every stretch of the
schedule holds the sources in proportion, and slots and blocks can be joined. Everything is DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import quoted, stored

#: Slots that the schedule aims at for each source; the block size follows from the words to take.
SLOTS_EACH = 4096
#: Smallest and largest block, in words: with more words there are more slots.
LEAST_BLOCK, MOST_BLOCK = 16, 1 << 20
#: Slots that are ranked together.
STRETCH = 1 << 12
#: Points are 62-bit integers, exact at any i; the step is the golden ratio's fraction of the range.
BITS = 62
STEP = (isqrt(5 << 2 * BITS) - (1 << BITS)) // 2
#: The range is cut into this many cells, by which slots and shares are joined.
CELL_BITS = 16
#: Documents of a bin of a source's line, about; bins are named by leading hexadecimal digits of the shuffle key.
BIN = 1 << 14


def word_count(text: Column) -> Column:
    """Runs of bytes other than 0x20 and 0x09-0x0D; 0 for null."""
    words = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")
    return F.coalesce(F.size(F.filter(words, lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(lane, source, source_size, target) from (lane, source, source_size), a row for each source, null among them.

    Sources in order of code points, null last, weigh `weights`, repeating. They share `share` of all words; where a
    target would be above `most` times its source it stops there and the rest is shared again. That is a level of
    water: each target is min(most * size, level * weight), and going through sources by size / weight the level
    follows from the first one that isn't filled. The rows are as many as the sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.array(*[F.lit(float(w)) for w in weights])[(F.row_number().over(order) - 1) % len(weights)]
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumns({
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "all": F.sum("source_size").over(every) * F.lit(float(share)),
    })
    level = (F.col("all") - F.col("full")) / F.col("open")
    rows = rows.withColumn("level", F.when(F.col("cap") >= level * F.col("weight"), level)).withColumn("level", F.max("level").over(every))
    return rows.select("lane", "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def shuffled_line(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(id, tie, source, lane, size, at): each document's first word on its source's line.

    A lane stands for a source, null among them. The order is by md5 of the id, then the id, then the text's hash.
    Sizes are summed in bins of the leading digits of the md5, then over a source's bins, so that no task holds a
    source. (Rows of one id are in one bin.) The rows without texts are stored, for texts are dear to read and bins
    follow the number of rows.
    """
    lane = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.select(quoted(key).alias("id"), F.xxhash64(quoted(text)).alias("tie"), quoted(source).alias("source"), word_count(quoted(text)).alias("size")).withColumn("lane", lane)
    rows = stored(rows.withColumn("draw", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))))
    digits = max(1, math.ceil(math.log(max(1, rows.count() / BIN), 16)))
    rows = rows.withColumn("bin", F.substring("draw", 1, digits))
    bins = rows.groupBy("lane", "bin").agg(F.sum("size").alias("in_bin"))
    before = F.sum("in_bin").over(Window.partitionBy("lane").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bin")
    inside = F.sum("size").over(Window.partitionBy("lane", "bin").orderBy("draw", "id", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    lined = rows.withColumn("inside", inside).join(bins.select("lane", "bin", before.alias("before")), ["lane", "bin"])
    return lined.select("id", "tie", "source", "lane", "size", (F.col("before") + F.col("inside")).alias("at"))


def points(slot: Column) -> Column:
    """slot * STEP modulo 2**62, in 31-bit halves, so that no product overflows."""
    half = (1 << 31) - 1
    a, b = F.shiftright(slot, 31), slot.bitwiseAND(F.lit(half))
    middle = (a * F.lit(STEP & half) + b * F.lit(STEP >> 31)).bitwiseAND(F.lit(half))
    return (F.shiftleft(middle, 31) + b * F.lit(STEP & half)).bitwiseAND(F.lit((1 << BITS) - 1))


def schedule(plan: DataFrame, n_slots: int) -> DataFrame:
    """(slot, lane, r): the source that each of n_slots slots draws, and the slot's rank from 0 among its source's.

    plan: (lane, target). A slot finds its source by a join on the cell of its point, and by the exact bounds where
    sources share a cell. Ranks are taken inside stretches of slots, and a source's stretches are summed before them.
    """
    every, order = Window.partitionBy(), Window.orderBy("lane")
    shares = plan.where("target >= 1").select("lane", (F.sum("target").over(order) / F.sum("target").over(every)).alias("upto"), (F.row_number().over(order) == F.count("*").over(every)).alias("last"))
    high = F.when(F.col("last"), F.lit(1 << BITS)).otherwise((F.col("upto") * F.lit(float(1 << BITS))).cast("long"))
    shares = shares.withColumn("high", high).withColumn("low", F.lag("high", 1, 0).over(order))
    cell = BITS - CELL_BITS
    shares = shares.select("lane", "low", "high", F.explode(F.sequence(F.shiftright("low", cell), F.shiftright(F.col("high") - 1, cell))).alias("cell"))
    slots = plan.sparkSession.range(n_slots).select(F.col("id").alias("slot"), points(F.col("id")).alias("point"))
    slots = slots.withColumn("cell", F.shiftright("point", cell))
    drawn = slots.join(shares, "cell").where("point >= low and point < high").select("slot", "lane", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    counts = drawn.groupBy("lane", "stretch").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("lane").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    inside = F.row_number().over(Window.partitionBy("lane", "stretch").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).join(counts.select("lane", "stretch", before.alias("before")), ["lane", "stretch"])
    return ranked.select("slot", "lane", (F.col("before") + F.col("inside")).alias("r"))


class Mixture:
    """What `mix` has planned; `slots`, `spans` and `totals` are DataFrames."""

    def __init__(self, lined: DataFrame, plan: DataFrame, block: int, n_slots: int):
        self.lined, self.plan, self.block, self.n_slots = lined, plan, block, n_slots

    def slots(self) -> DataFrame:
        """(slot, lane, epoch, block, words): the first `words` words of a source's block, taken in the epoch-th round.

        A source whose slots are used up before its target is reached (the sequence misses a share by a few slots)
        has the missing ones behind all others; one with a few slots more leaves them unused. The last is cut short.
        """
        drawn = stored(schedule(self.plan, self.n_slots))
        own = drawn.groupBy("lane").agg(F.count("*").alias("own"))
        late = self.plan.join(own, "lane", "left").where(F.col("need") > F.coalesce("own", F.lit(0)))
        late = late.select("lane", F.explode(F.sequence(F.coalesce("own", F.lit(0).cast("long")), F.col("need") - 1)).alias("r"))
        late = late.select((F.lit(self.n_slots) + F.col("r")).alias("slot"), "lane", "r")
        rows = drawn.unionByName(late).join(self.plan, "lane").where("r < need")
        epoch, block = F.floor(F.col("r") / F.col("n_blocks")), F.col("r") % F.col("n_blocks")
        begin = epoch * F.col("source_size") + block * self.block
        words = F.least(F.lit(self.block).cast("long"), F.col("source_size") - block * self.block, F.col("take") - begin)
        return rows.select("slot", "lane", epoch.alias("epoch"), block.alias("block"), words.alias("words"))

    def spans(self) -> DataFrame:
        """(id, tie, source, lane, size, at, slot, epoch, begin, end): words begin..end of a document at a slot.

        A document that isn't taken has a row with null slot. A document lies in one block or in a few neighbours.
        """
        first = F.floor(F.col("at") / self.block)
        last = F.floor((F.col("at") + F.greatest(F.col("size"), F.lit(1)) - 1) / self.block)
        pieces = self.lined.withColumn("block", F.explode(F.sequence(first, last)))
        base = F.col("block") * self.block
        begin, end = F.greatest(F.col("at"), base) - F.col("at"), F.least(F.col("at") + F.col("size"), base + F.col("words")) - F.col("at")
        joined = pieces.join(self.slots(), ["lane", "block"], "left").withColumns({"begin": begin, "end": end})
        none = F.col("slot").isNull() | (F.col("end") <= F.col("begin"))
        return joined.select("id", "tie", "source", "lane", "size", "at", *[F.when(~none, F.col(c)).alias(c) for c in ("slot", "epoch", "begin", "end")])

    def totals(self) -> DataFrame:
        """(id, tie, source, size, source_size, target, taken, times) of every document; times: how often its first
        word is taken."""
        taken = F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0)).alias("taken")
        times = F.count(F.when(F.col("begin") == 0, 1)).alias("times")
        rows = self.spans().groupBy("id", "tie", "source", "lane", "size", "at").agg(taken, times)
        return rows.join(self.plan.select("lane", "source_size", "target"), "lane").select("id", "tie", "source", "size", "source_size", "target", "taken", "times")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, key: str = "doc_id", text: str = "text", source: str = "source") -> Mixture:
    """Plan the mixture of all documents.

    Each source's taken words are the whole part of its target; each word is taken `most` times at most, so no
    document exceeds `most` times its size. Null and empty texts have size 0 and are never taken. A null source is
    one of its own. Rows of one id are separate documents. All depends on ids, texts and sources only, so reruns
    agree. The driver reads two sums.
    """
    lined = stored(shuffled_line(docs, key, text, source))
    sizes = lined.groupBy("lane", "source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most).withColumn("take", F.floor("target"))
    words, n = lined.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_distinct("lane")).first()
    block = min(MOST_BLOCK, max(LEAST_BLOCK, int(words * share) // (SLOTS_EACH * max(1, n))))
    n_blocks = F.ceil(F.col("source_size") / F.lit(block))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0)
    need = rounds * n_blocks + F.ceil((F.col("take") - rounds * F.col("source_size")) / F.lit(block))
    plan = stored(plan.withColumns({"n_blocks": n_blocks, "need": need.cast("long")}))
    return Mixture(lined, plan, block, int(plan.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]))
