"""Centroids, spelling variants and URL filters against brute force, on awkward rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, clashing, empty
from tickloom.llm import centroids as C
from tickloom.llm import spelling as S
from tickloom.llm import url_filter as U

# --- centroids ----------------------------------------------------------------------------------------------


def brute_means(rows, k=8, rounds=10, dims=4, seed=3):
    """(id, cluster, distance, cluster inertia, inertia, digest) of each kept row, by Python's integers."""
    kept = [(i, [C.whole(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [[v for _, v in kept if near(v)[1] == j] for j in range(len(centres))]
        centres = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(own, centres, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    by = Counter()
    for _, d, j in found:
        by[j] += d
    most, digest = C.MOST_LONG, [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, j, min(d, most), min(by[j], most), min(sum(by.values()), most), digest[j]) for i, d, j in found], key=str)


def means(spark, rows, extra=(), **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in extra:
        df = df.withColumn(c, F.lit("mine"))
    found = C.labelled(df, C.k_means(df, dims=4, **how), dims=4).select("p.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted([tuple(r) for r in found.collect()], key=str)


def test_means_of_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 5, 0.3) for _ in range(4)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 2.0, 3.0]), (62, [1.0, float("nan"), 2.0, 3.0]), (63, [float("inf"), 0.0, 0.0, 0.0]), (64, [1.0, 2.0]), (65, [])]
    rows += [(None, [0.5, -0.5, 0.25, 0.0])] * 2 + [(3, [9.0, 9.0, 9.0, 9.0]), rows[7], rows[7], (66, [-0.0, 0.0, -1e-9, 1e-300])]
    assert means(spark, rows, extra=("p", "cluster", "v", "distance")) == brute_means(rows)
    beyond = [*rows, (70, [5e5, -3e5, 1.0, 2.0]), (71, [1e9, 1.0, 0.0, -1e9]), (72, [1e300, -1e308, 1.7e308, 0.0]), (73, [3e9, 1e10, -4e8, 0.1])]
    assert means(spark, beyond) == brute_means(beyond)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.0, 0.0, 0.0, 1.0]), (1, [0.0, 0.0, 0.0, 1.0]), (2, [5.0, 0.0, 0.0, 0.0])]
    assert means(spark, rows) == brute_means(rows)
    assert means(spark, []) == [] and means(spark, [(1, None), (2, [1.0])]) == []


@pytest.mark.parametrize("size", [1.0, 1e5, 1e7, 1e12, 1e200])
def test_distances_are_exact_at_every_size(size):
    """Distances and nearest of ties, by products, longs and Python's integers."""
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(0, size, (40, 4)), rng.normal(0, 1, (5, 4)), [[0.0] * 4]])
    centres = [[C.whole(float(x)) for x in rows[j]] for j in (3, 3, 7, 41)] + [[0] * 4]
    near, far = C.assign(rows, centres)
    for x, j, d in zip(rows, near.tolist(), far, strict=True):
        v = [C.whole(float(a)) for a in x]
        assert (int(d), j) == min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))


def test_sums_beyond_doubles_are_exact():
    rows = np.array([[2.0**43, 1.0], [2.0**43 + 2.0**-9, -1.0], [1e300, 0.5], [-1e300, 0.5]])
    sums, counts = C._sums(rows, np.array([0, 0, 1, 1]), 3, C.SCALE)
    assert sums.tolist() == [[2**54 + 2, 0], [0, 1024], [0, 0]] and counts.tolist() == [2, 2, 0]


# --- spelling variants --------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, times=10):
    out, form = [], {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
        out.append([w, form[w], None, n, len(near), counts[best] if form[w] else None])
    for row in out:
        root = row[0]
        while form[root]:
            root = form[root]
        row[2] = root
    return sorted(map(tuple, out))


def brute_words(rows, each=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % each == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def variants(spark, counts, **how):
    df = spark.createDataFrame([*counts.items()], "word string, n long")
    return sorted(tuple(r) for r in S.spelling_variants(df, **how).collect())


def test_variants_of_dense_words(spark):
    """Few letters, so that words have many neighbours, equal runs of letters and anagrams; chains of forms; long words."""
    rng = random.Random(2)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(3, 7))) for _ in range(500)}
    counts = {w: rng.choice((1, 2, 2, 3, 20, 25, 30, 300, 3500)) for w in words}
    counts |= {"chain" + "x" * i: 10**i * 2 for i in range(5)}
    long = "".join(rng.choice("abcdeé") for _ in range(300))
    counts |= {long: 500, long[:70] + long[71:]: 3, long[:70] + "z" + long[71:]: 2, long[1:] + long[0]: 7, "x" * 150: 9, "x" * 151: 100}
    assert variants(spark, counts) == brute_variants(counts)
    assert variants(spark, counts, times=2) == brute_variants(counts, 2)


def test_letters_of_all_words_and_anagrams(spark):
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    counts = {f"word{a}ing": 5 + i for i, a in enumerate(letters)} | {"wording": 900, "gnidrow": 4000, "woringd": 60, "ordwing": 3}
    got = variants(spark, counts)
    assert got == brute_variants(counts) and [r[4] for r in got if r[0] == "wording"] == [90]


def test_words_of_awkward_texts(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    rows += [(i, f"Spelling spelling Étudiant étudiants naïveté×÷ straße_mixed42letters {'speling ' * (i % 3)}") for i in range(200)] + [(None, "spelling " * 40), (7, "q" * 50_000)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("mine"), "run": F.lit("mine"), "id": F.lit(1)})
    for each in (31, 3):
        found = S.counted(S.misspelt(S.runs(df), each))
        assert {r.word: r.n for r in found.collect()} == brute_words(rows, each)
        assert sorted(tuple(r) for r in S.spelling_variants(found).collect()) == brute_variants(brute_words(rows, each))


def test_no_words(spark):
    assert variants(spark, {}) == [] and S.counted(S.runs(empty(spark))).count() == 0
    assert sorted(tuple(r) for r in S.spelling_variants(S.counted(S.runs(empty(spark)))).collect()) == []
    some = spark.createDataFrame([(None, 5), ("lonely", 2)], "word string, n long")
    assert [tuple(r) for r in S.spelling_variants(some).collect()] == [("lonely", None, "lonely", 2, 0, None)]


# --- URL filters --------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme/de/1", "http://", "https://example.org", "http://example.org/", "http://Example.ORG/es/1?x=/de/", "http://a.b.example.org/en/12#/es/",
    "http://notexample.org/es/1", "http://example.org.evil.com/de/1", "ftp://x.com/fr/", "http://x.com/fr", "//x.com/de/", "a://b://c.com/de/", "http://x.com?/de/", "http://ÄB.com/de/é",
    "http://x.com:80/de/1", "http://user@com/de/", "http://.com/de/", "http://com/de/x\ny", "http://x.org\n/es/", "http://" + "a." * 20_000 + "example.org/es/1", "http://x.com/de/" + "y" * 50_000,
]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "/de/é", "allow")]


def brute_url(url, rules, default="allow"):
    scheme, mark, rest = (url or "").partition("://")
    host = re.match("[^/?#]*", rest)[0] if mark else ""
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return (host, path, best and best[0] + best[1], best[2] if best else default)


def verdicts(spark, urls, rules, **how):
    df = spark.createDataFrame([*enumerate(urls)], "page_id long, url string").withColumns({c: F.lit("mine") for c in ("host", "p", "rule", "verdict")})
    rows = U.url_filter(df, rules, **how).select("p.page_id", "host", "path", "rule", "verdict").collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def test_verdicts_of_awkward_urls(spark):
    assert verdicts(spark, URLS + URLS, RULES) == [brute_url(u, RULES) for u in URLS + URLS]
    assert verdicts(spark, URLS, [], default="block") == [brute_url(u, [], "block") for u in URLS]
    assert verdicts(spark, [], RULES) == []


def test_many_rules_in_many_parts(spark):
    rng = random.Random(4)
    name = lambda n: ".".join(rng.choice(("a", "b", "org", "x-y")) for _ in range(rng.randint(1, n)))
    rules = [(name(3), rng.choice(("", "/", "/" + rng.choice("abc") * rng.randint(0, 3), "/a/b")), rng.choice(U.VERDICTS)) for _ in range(300)]
    urls = [f"http://{name(5)}{rng.choice(('', '/', '/a/b/c', '/aa', '/bbb?x', '/ccc#y'))}" for _ in range(400)]
    df = spark.createDataFrame(rules + rules[:20], "host string, path string, verdict string")
    names = U.publish(df, part=1500)
    assert len(names) > 3
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    got = sorted(U.judged(pages, names).select("p.page_id", "host", "path", "rule", "verdict").collect())
    assert [tuple(r)[1:] for r in got] == [brute_url(u, rules) for u in urls]


def test_wrong_rules_are_errors(spark):
    for rule in (("", "/", "allow"), (None, "/", "allow"), ("org", "/", "maybe"), ("org", "/", None)):
        with pytest.raises(ValueError, match="rule"):
            U.url_filter(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), [rule])


def test_collisions_are_told_by_their_strings():
    """With digests of two bits nearly all keys collide, and each is found at its own place."""
    weak = lambda s: zlib.crc32(s) % 4
    items = {f"key{i}".encode(): i for i in range(60)} | {b"": 99}
    array = U.DigestArray(np.frombuffer(U.DigestArray.packed(items, weak), np.uint8), weak)
    keys = [*items, b"key60", b"key", b"other"]
    found = array.find(keys)
    assert [int(array.numbers[i]) for i in found[: len(items)]] == [*items.values()] and found[len(items) :].tolist() == [-1] * 3
    assert U.DigestArray(np.frombuffer(U.DigestArray.packed({}), np.uint8)).find([b"a"]).tolist() == [-1]


def test_clashing_columns(spark):
    rows = clashing(spark, ("p", "host", "path", "rule", "verdict")).withColumn("url", F.col("text"))
    assert U.url_filter(rows, RULES).count() == rows.count()
