"""Operator 12: spelling variants by anagram hashing.

A word's anagram key is the sum of a power of each of its letters, so it doesn't depend on their order. Words that
differ by one added, removed or exchanged letter have keys that differ by that letter's value, or by two letters'. Such
keys are joined where they meet: each word goes under its own key and, once for each different letter, under the
key without that letter. A word meets those with a letter more or less under the shorter one's key, and those with
another letter in one place under the key that both have without it. Then the order of letters is verified, for the
words that met: what is left of a word without that letter must be the other word, or be the same in both with the
gap in the same place.

Plan. Words are counted (the only pass over texts) and written once, in the order of count and code points, with ascending
numbers; a word's best neighbour is then the one with the least number. Integer keys are counted before any
string is made. Neighbours are never written as pairs: words with the same remainder and gap stand together in a
window, and each takes from it how many others there are, and the least number among them. A gap has as many words as
there are letters. Roots are found by doubling steps; counts grow tenfold with each, so there are few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import quoted, stored

LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: The power of anagram keys.
POWER = 5
#: Remainders longer than this are compared by their SHA-256.
LONG = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_LETTERS) -> DataFrame:
    """(id, run) of all maximal runs of letters, A to Z lower-cased, with at least `least` of them. A null text has none."""
    found = F.regexp_extract_all(quoted(text), F.lit("[A-Za-zÀ-ÿ]{%d,}" % least), F.lit(0))
    rows = docs.select(quoted(key).alias("id"), F.explode(found).alias("run"))
    return rows.withColumn("run", F.translate("run", UPPER, LOWER))


def misspelt(found: DataFrame, each: int) -> DataFrame:
    """`found` (id, run), where of about every `each`-th run one letter is left out: of those whose crc32, with the id before
    it (nothing for a null one), is a multiple of `each`."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    rows = found.withColumns({"h": h, "at": (h % F.length("run")).cast("int")})
    cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    return rows.select("id", F.when(F.col("h") % each == 0, cut).otherwise(F.col("run")).alias("run"))


def counted(found: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the runs with at least `least` letters and `least_count` occurrences."""
    words = found.where(F.length("run") >= least).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return words.where(F.col("n") >= least_count)


def _value(letter: Column) -> Column:
    """A letter's power: of its number, from a = 1 on, with those of the second block behind z."""
    code = F.ascii(letter).cast("long")
    number = F.when(code < 192, code - 96).otherwise(code - 165)
    power = number
    for _ in range(POWER - 1):
        power = power * number
    return power


def _letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda x: x != "")


def _meetings(words: DataFrame) -> DataFrame:
    """(wid, word, key, letter): each word under its own anagram key (letter null) and under those without one letter, for
    the keys under which several words meet."""
    letters = _letters(F.col("word"))
    total = F.aggregate(letters, F.lit(0).cast("long"), lambda s, x: s + _value(x))
    own = words.select("wid", "word", total.alias("total"))
    under = F.array_append(
        F.transform(F.array_distinct(letters), lambda x: F.struct((F.col("total") - _value(x)).alias("key"), x.alias("letter"))),
        F.struct(F.col("total").alias("key"), F.lit(None).cast("string").alias("letter")),
    )
    rows = own.select("wid", "word", F.inline(under))
    shared = rows.groupBy("key").agg(F.count("*").alias("words")).where("words > 1").select("key")
    return rows.join(shared, "key", "left_semi")


def _gaps(met: DataFrame) -> DataFrame:
    """(wid, gap, rest, whole): what is left of a word without its letter, with the place of the gap, to be met by words with
    another letter there; and without a place (gap -1), to be met by the word that is the rest (whole)."""
    letters = _letters(F.col("word"))
    short = lambda rest: F.when(F.length(rest) <= LONG, rest).otherwise(F.sha2(rest, 256))
    rest = lambda i: short(F.concat(F.substring("word", F.lit(1), i), F.substring(F.col("word"), i + 2, F.length("word"))))
    places = F.filter(F.transform(F.col("letters"), lambda x, i: F.struct(i.alias("at"), (x == F.col("letter")).alias("here"), ((i > 0) & (F.get("letters", i - 1) == x)).alias("again"))), lambda x: x["here"])
    # Leaving out any of equal neighbours gives the same rest: the first stands for all.
    gaps = F.flatten(F.transform(places, lambda x: F.transform(
        F.when(x["again"], F.array(x["at"])).otherwise(F.array(x["at"], F.lit(-1))), lambda g: F.struct(g.alias("gap"), rest(x["at"]).alias("rest")))))
    minus = met.where(F.col("letter").isNotNull()).withColumn("letters", letters).select("wid", F.inline(gaps), F.lit(False).alias("whole"))
    whole = met.where(F.col("letter").isNull()).select("wid", F.lit(-1).alias("gap"), short(F.col("word")).alias("rest"), F.lit(True).alias("whole"))
    return minus.unionByName(whole)


def neighbours(words: DataFrame) -> DataFrame:
    """(wid, n_near, best): of each of `words` (wid, word: distinct) that has any, the number of words that are one insertion,
    removal or replacement away, and the least wid of them."""
    rows = _gaps(_meetings(words))
    same = Window.partitionBy("gap", "rest")
    ordered = same.orderBy("wid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "all": F.count("*").over(ordered), "first": F.min("wid").over(ordered), "second": F.nth_value("wid", 2).over(ordered),
        "shorter": F.max(F.when(F.col("whole"), F.col("wid"))).over(ordered), "longer": F.min(F.when(~F.col("whole"), F.col("wid"))).over(ordered),
    })
    gap = F.col("gap") >= 0
    near = F.when(gap | F.col("whole"), F.col("all") - 1).when(F.col("shorter").isNotNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    best = F.when(gap, F.when(F.col("wid") == F.col("first"), F.col("second")).otherwise(F.col("first"))).when(F.col("whole"), F.col("longer")).otherwise(F.col("shorter"))
    return rows.select("wid", near.alias("near"), best.alias("best")).where("near > 0").groupBy("wid").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of `words` (word, n; distinct, of letters a to z and those from U+00C0 to U+00FF).

    form: the near word with the largest n (of equals the first by code points), if it has `times` times the word's n or
    more, else null; root: the last of the forms' forms, the word itself if there is none. Rows without a word are left out;
    no words give no rows.
    """
    ordered = words.where(F.col("word").isNotNull()).select("word", "n").orderBy(F.col("n").desc(), "word")
    own = stored(ordered.withColumn("wid", F.monotonically_increasing_id()))
    near = neighbours(own)
    held = own.select(F.col("wid").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    linked = own.join(near, "wid", "left").join(held, "best", "left").withColumn("likelier", F.coalesce(F.col("best_n") >= F.col("n") * times, F.lit(False)))
    linked = stored(linked.select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("likelier"), F.col("best")).alias("up"),
        F.when(F.col("likelier"), F.col("best_word")).alias("form"), F.when(F.col("likelier"), F.col("best_n")).alias("form_n")))
    least, most = own.agg(F.min("n"), F.max("n")).first()
    up = linked.where(F.col("up").isNotNull()).select("wid", F.col("up").alias("root"))
    depth = math.floor(math.log(most / least, times)) + 1 if most else 0
    for _ in range(math.ceil(math.log2(depth)) if depth > 1 else 0):
        further = up.select(F.col("wid").alias("root"), F.col("root").alias("further"))
        up = stored(up.join(further, "root", "left").select("wid", F.coalesce("further", "root").alias("root")))
    roots = up.join(own.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root").select("wid", "root_word")
    return linked.join(roots, "wid", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
