"""Operators against brute force, on awkward rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, awkward, clashing, empty, words
from tickloom.llm import bpe, jpeg, line_dedup, mixing, near_dup, substring_dedup, token_counts, token_files, top_k, toxicity
from tickloom.llm import kernels as K
from tickloom.llm.cuckoo import CuckooFilter
from tickloom.llm.dart_minhash import signatures

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- kernels ------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    t = ["", "a b", "\x0ba\x0c", "x" * 1000 + " y", "a b", "漢 字"]
    data, off = K.buffers(pa.array(t))
    starts, ends, first = K.spans(data, off)
    got = [data[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)]
    assert got == [w for x in t for w in words(x)]
    hashes = K.span_hash(data, starts, ends)
    by_word = defaultdict(set)
    for w, h in zip(got, hashes.tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({min(v) for v in by_word.values()}) == len(by_word)
    assert first.tolist() == [0, 0, 2, 3, 5, 7, 9]


def _unmix(h):
    """The number that mix64 makes `h` of."""
    h ^= h >> 31 ^ h >> 62
    h = h * pow(0x94D049BB133111EB, -1, 1 << 64) % (1 << 64)
    h ^= h >> 27 ^ h >> 54
    h = h * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) % (1 << 64)
    return h ^ h >> 30 ^ h >> 60


def test_words_that_collide_under_one_seed_differ_under_another():
    """For words of 7 bytes, the word of 8 bytes with the same hash under seed 0 is found by inverting the mixer."""
    first, _, length = map(int, K._keys(0))
    for i in range(200):
        short = b"%07d" % i
        a = int(K.mix64(np.array([int.from_bytes(short, "little") ^ first], np.uint64))[0])
        other = (_unmix((a - length) % (1 << 64)) ^ first).to_bytes(8, "little")
        data, off = np.frombuffer(short + other, np.uint8), np.array([0, 7, 15])
        for seed in (0, 1, 2):
            x, y = K.span_hash(data, off[:-1], off[1:], seed).tolist()
            assert (x == y) == (seed == 0)


def test_no_word_goes_for_a_collision(spark):
    """Two texts that differ in one word keep all words, also where the words' plain mixing would collide."""
    for a, b in (("B\uc22d.\u0672", "-p>$u_{b"), ("a" * 7, "a" * 7 + "\0"), ("x" * 8, "x" * 9)):
        rows = [(i, " ".join([f"w{j}" for j in range(34)] + [last])) for i, last in enumerate((a, b))]
        got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert [r.n_removed for r in got] == [0, 0]


def test_chunks_cover_all_rows():
    a = pa.array(["aa", None, "b" * 50, "", "c"])
    assert [(i, j) for i, j, _, _ in K.chunks(a, 10)] == [(0, 2), (2, 3), (3, 5)] or sum(j - i for i, j, _, _ in K.chunks(a, 10)) == 5
    assert b"".join(d.tobytes() for _, _, d, _ in K.chunks(a, 10)) == b"aa" + b"b" * 50 + b"c"
    assert [*K.chunks(pa.array([], pa.string()))] == []
    sliced = pa.array(["x", "yy", "zzz"]).slice(1, 1)
    assert K.buffers(sliced)[0].tobytes() == b"yy"


def test_rabin_karp_tells_windows_apart():
    w = K.mix64(np.arange(1, 50, dtype=np.uint64))
    w = np.concatenate([w, w])
    at, n = K.windows(w, np.array([0, len(w)]), 5)
    h = K.rabin_karp(w, at, 5)
    assert n.tolist() == [len(w) - 4] and len(set(h.tolist())) == 49 and (h[:45] == h[49:94]).all()


# --- operator 1 ---------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) if i % 9 else 0.5 for _ in range(8)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (350, []), (400, [1e6] * 3), (7, [2.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in top_k.top_k(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in [(i, v) for i, v in good if i % 50 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in good if j != q))[:5]
        assert got[q] == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert top_k.top_k(df.limit(0)).count() == 0


def brute_top(ids, rows, query_id, query, k):
    exact = [(-sum(int(a) * int(b) for a, b in zip(query, row, strict=True)), int(i)) for i, row in zip(ids, rows, strict=True) if i != query_id]
    return [(i, -s) for s, i in sorted(exact)[:k]]


def test_top_k_of_many_tiles_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(top_k, "TILE", 40)
    rng = random.Random(9)
    rows = [(i, [float(rng.choice([0, 0, 0, 1, 2, -1])) for _ in range(12)]) for i in range(300)] + [(77, [1.0] * 12)] * 90 + [(77, [2.0] * 12)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in top_k.top_k(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids, matrix = [i for i, _ in rows], [[int(256 * x) for x in v] for _, v in rows]
    assert dict(got) == {q: brute_top(ids, matrix, q, matrix[ids.index(q)], 5) for q in range(0, 300, 50)}


def test_bounds_hold_where_terms_cancel():
    """Components near 2**27, whose products add up beyond what doubles hold and cancel; and beyond 64 bits."""
    rng = np.random.default_rng(4)
    for scale, trials in ((1 << 27, 60), (1 << 50, 10)):
        for _ in range(trials):
            rows = rng.integers(-3, 4, (40, 8)) + scale * rng.integers(-1, 2, (40, 1)) * np.array([1, -1] * 4)
            query = rng.integers(-3, 4, 8) + scale * np.ones(8, np.int64)
            ids = np.arange(40)
            index = top_k.BlockIndex(ids, rows, 2)
            found, score = index.search(3, query, index.bounds(query[None])[0], 5, index.magnitude(query[None]))
            assert [*zip(found.tolist(), score.tolist(), strict=True)] == brute_top(ids, rows, 3, query, 5)


def test_blocks_are_skipped():
    """Sparse vectors of few topics: most blocks are left out; a threshold from elsewhere leaves out more."""
    rng = np.random.default_rng(5)
    topic = rng.integers(0, 32, 4096)
    rows = np.zeros((4096, 128), np.int64)
    for t in range(4):
        rows[np.arange(4096), 4 * topic + t] = rng.integers(100, 256, 4096)
    ids = np.arange(4096)
    index = top_k.BlockIndex(ids, rows, 16)
    for q in range(0, 4096, 64):
        bound = index.bounds(rows[q][None])[0]
        found, score = index.search(q, rows[q], bound, 5, index.magnitude(rows[q][None]))
        assert [*zip(found.tolist(), score.tolist(), strict=True)] == brute_top(ids, rows, q, rows[q], 5)
    assert index.skipped > 0.9 * (index.seen + index.skipped)
    without = index.seen
    for q in range(0, 4096, 64):
        best = brute_top(ids, rows, q, rows[q], 5)[-1][1]
        index.search(q, rows[q], index.bounds(rows[q][None])[0], 5, index.magnitude(rows[q][None]), best)
    assert index.seen - without <= without


# --- operator 2 ---------------------------------------------------------------------------------------------


def brute_windows(rows, k):
    count = Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("k", [3, 35])
def test_substring_dedup(spark, k):
    df = clashing(spark, ["g", "p", "n_words", "kept_text", "bucket"])
    got = substring_dedup.substring_dedup(df, k)
    assert sorted(map(repr, ((r.d, r.n_words, r.n_removed, r.kept_text) for r in got.select(F.col("p.doc_id").alias("d"), "n_words", "n_removed", "kept_text").collect()))) == sorted(map(repr, brute_windows(texts(df), k)))
    for r in got.collect():
        pairs = [*zip(r.removed[::2], r.removed[1::2], strict=True)]
        assert sum(b - a for a, b in pairs) == r.n_removed and all(b < c for (_, b), (c, _) in zip(pairs, pairs[1:], strict=False))
    assert substring_dedup.substring_dedup(empty(spark), k).count() == 0


# --- operator 3 ---------------------------------------------------------------------------------------------


def test_token_counts(spark, library):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    df = awkward(spark)
    want = sorted(len(t.encode(x or "", add_special_tokens=False).ids) for _, x in texts(df))
    lengths = token_counts.token_lengths(df, JSON)
    assert sorted(r.n_tokens for r in lengths.collect()) == want
    sums = token_counts.suffix_sums(token_counts.length_histogram(lengths))
    for r in sums.collect():
        above = [x for x in want if x > r.n_tokens]
        assert (r.n_docs, r.docs_above, r.tokens_above, r.truncated_total) == (want.count(r.n_tokens), len(above), sum(above), sum(min(x, r.n_tokens) for x in want))
    for r in token_counts.at_limits(sums, [0, 2, 100, 10**9]).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in want) and r.docs_above == sum(x > r.context_limit for x in want)
    for r in token_counts.quantiles(sums, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == next(x for x in want if sum(y <= x for y in want) >= r.q * len(want))
    none = token_counts.suffix_sums(token_counts.length_histogram(token_counts.token_lengths(empty(spark), JSON)))
    assert none.count() == 0 and token_counts.at_limits(none, [5]).first().truncated_total == 0 and token_counts.quantiles(none, [0.5]).count() == 0


# --- operator 4 ---------------------------------------------------------------------------------------------


def test_encoding_is_the_librarys(library):
    rng = random.Random(1)
    alphabet = "'  ''stredlvm aAbßé漢字١२3 \n\n\r\t　!?.🙂 '"
    sample = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 500, "🙂" * 50, "ab" * 300]
    encoder, pool, at = bpe.prefix_encoder(MULTI)
    for i, j, data, off in K.chunks(pa.array(sample), 5000):
        ids, to = encoder.chunk(data, off)
        back, end = bpe.decode_ids(ids, to, pool, at)
        for k in range(i, j):
            assert ids[to[k - i] : to[k - i + 1]].tolist() == library.encode_ordinary(sample[k])
            assert back[end[k - i] : end[k - i + 1]].tobytes() == sample[k].encode()


def test_every_code_point_is_cut_as_the_libraries_cut(library):
    """All code points beside letters, digits, marks, blanks and themselves, against both libraries."""
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(JSON)
    assert (bpe.pattern_classes() == token_files.library_classes()).all()
    mine = bpe.prefix_encoder(MULTI)[0], token_files.library_encoder(JSON)
    step, n = 64, 0
    for lo in range(0, len(K.CODE_POINTS), step):
        block = K.CODE_POINTS[lo : lo + step]
        text = "".join(f"a{c} {c}{c} 1{c}2.{c}b '{c}s\n{c} " for c in block) if lo < 0x32400 or lo >= 0xE0000 - 0x800 and lo < 0xE0200 else block
        data, off = K.buffers(pa.array([text]))
        assert mine[0].chunk(data, off)[0].tolist() == library.encode_ordinary(text), hex(lo)
        if lo < 0x3400 or lo % 7 == 0:  # the classes are the same, and this library is slow
            assert mine[1].chunk(data, off)[0].tolist() == hf.encode(text, add_special_tokens=False).ids, hex(lo)
        n += len(block)
    assert n == 0x110000 - 0x800


def test_many_pieces_at_once_as_one_by_one():
    model = bpe.PrefixBPE(bpe.load_ranks(MULTI))
    rng = random.Random(7)
    letters = "therington é漢🙂ß "
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))).encode() for _ in range(500)] + [b"a" * 200, b" ", b"the"]
    size = np.array([*map(len, pieces)])
    ends = np.cumsum(size)
    ids, n = model.encode_many(np.frombuffer(b"".join(pieces), np.uint8), ends - size, ends)
    want = [model.merge(p) for p in pieces]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [*map(len, want)] and want == [bpe.PrefixTable(model, p).ids() for p in pieces]


def test_hash_table():
    keys = K.mix64(np.arange(1, 5001, dtype=np.uint64)) & K.U64(0xFFFF_FFFF_0000_0000)  # hard on the low bits
    table = bpe.HashTable(5000)
    table.add(keys[:3000], np.arange(3000))
    table.add(keys[3000:], np.arange(3000, 5000))
    assert table.find(keys).tolist() == [*range(5000)] and (table.find(keys + K.U64(1)) == -1).all()


def test_appends_and_edits():
    model = bpe.PrefixBPE(bpe.load_ranks(MULTI))
    rng = random.Random(2)
    letters = b"theringandtion "
    for _ in range(60):
        data = bytes(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        table = bpe.PrefixTable(model)
        cut = rng.randint(0, len(data))
        table.append(data[:cut])
        table.append(data[cut:])
        assert table.ids() == model.merge(data) and b"".join(model.token[t] for t in table.ids()) == data
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        new = bytes(rng.choice(letters) for _ in range(rng.randint(0, 5)))
        done = table.edit(a, b, new)
        assert table.ids() == model.merge(data[:a] + new + data[b:]) and done <= len(data) + len(new) - (b - a) - a
    long = bpe.PrefixTable(model, b"the ring and the nation " * 200)
    assert long.edit(100, 101, b"x") < 400


def test_encoder_forgets_and_goes_on(library):
    model = bpe.PrefixBPE(bpe.load_ranks(MULTI))
    small = bpe.PieceEncoder(model.encode_many, bpe.pattern_classes(), remembered=10)
    for text in ("one two three four five six seven", "eight nine ten eleven twelve one two"):
        data, off = K.buffers(pa.array([text]))
        assert small.chunk(data, off)[0].tolist() == library.encode_ordinary(text)


def test_round_trip(spark, library):
    df = clashing(spark, ["token_ids", "n_tokens"])
    got = sorted(map(repr, bpe.round_trip(df, MULTI).collect()))
    want = []
    for d, t in texts(df):
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert sorted(f"Row(doc_id={d!r}, n_tokens={n}, ids_sha256={a!r}, decoded_sha256={b!r})" for d, n, a, b in want) == got
    ids = {(r.doc_id, r.text): r.token_ids for r in bpe.encode(df, MULTI).collect()}
    assert all(v == library.encode_ordinary(t or "") for (_, t), v in ids.items())
    assert bpe.round_trip(empty(spark), MULTI).count() == 0


# --- operator 5 ---------------------------------------------------------------------------------------------


def brute_classes(rows, least=0.8):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    top = [*range(len(rows))]

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (a == b) or (a or b) and len(a & b) >= least * len(a | b):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(((min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for _ in g), key=repr)


def families(spark):
    """Originals with exact copies, close copies, a chain of them, and copies that are not close enough."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, i = [], 0
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(200)]
        for edits in [0, 0, 1, 2, 3, 5, 8, 12, 20, 40]:
            w = [*base]
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((i, " ".join(w), "en", f"s{family % 3}", 1))
            i += 1
        chain = [*base]
        for _ in range(10):
            for _ in range(3):
                chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
            rows.append((i, " ".join(chain), "en", "c", 1))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def test_near_duplicates(spark):
    df = families(spark)
    got = near_dup.near_duplicates(df)
    assert sorted(((r.class_id, r.class_size) for r in got.collect()), key=repr) == brute_classes(texts(df))
    kept = near_dup.first_of_classes(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in brute_classes(texts(df))})


def test_near_duplicates_of_awkward_rows(spark):
    df = clashing(spark, ["a", "b", "bands", "marks", "class_id", "p"])
    key = lambda x: repr(x)
    assert sorted(((r.class_id, r.class_size) for r in near_dup.near_duplicates(df).collect()), key=key) == sorted(brute_classes(texts(df)), key=key)
    assert near_dup.first_of_classes(df).count() == len({r.class_id for r in near_dup.near_duplicates(df).collect()})
    assert near_dup.near_duplicates(empty(spark)).count() == 0 and near_dup.first_of_classes(empty(spark)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    x = K.mix64(np.arange(1, 301, dtype=np.uint64))
    w1 = rng.uniform(0.2, 5, 300)
    w2 = w1 * rng.choice([1.0, 0.5, 2.0], 300)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    got = signatures(np.concatenate([x, x]), np.concatenate([w1, w2]), np.array([0, 300, 600]), 2000)
    assert abs((got[0] == got[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 2000)
    ones = signatures(np.concatenate([x, x[:240]]), np.ones(540), np.array([0, 300, 540]), 2000)
    assert abs((ones[0] == ones[1]).mean() - 0.8) < 0.04
    alone = signatures(x[:1], np.ones(1), np.array([0, 1, 1]), 64)
    assert (alone[1] == 0).all() and len(set(alone[0].tolist())) > 32
    # A set's signature doesn't depend on what else is in the batch.
    assert (signatures(x[:240], np.ones(240), np.array([0, 240]), 2000)[0] == ones[1]).all()


# --- operator 6 ---------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    plain, bad = [f"word{i}" for i in range(300)], ["awful", "nasty", "vile"]
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "s", 1))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, "awful nasty vile", "en", "s", 1), (5000, None, None, None, None), (5001, "", "en", "s", 0)], SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score(docs.withColumn("score", F.lit("mine")), model).select("doc_id", "score", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    held = [r for r in got if r.h and r.doc_id is not None and r.doc_id < 1200]
    assert len(held) > 200 and all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    right = sum((r.score >= toxicity.THRESHOLD) == (r.doc_id % 6 == 0) for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert {r.score < 0.3 for r in got if r.doc_id in (5000, 5001)} == {True}
    again = toxicity.score(docs, toxicity.train(docs, marks)).select("doc_id", "score").collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in got)


def test_toxicity_without_examples(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(awkward(spark), none) is None
    assert toxicity.score(awkward(spark), None).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(empty(spark), None).count() == 0


def test_risk_is_kept_non_negative():
    """With far more features than rows the plain estimator's negative part would fall below zero."""
    n = 60
    rows, cols = np.arange(n), np.arange(n)
    toxic = np.arange(n) < 10
    w = toxicity.nnpu(np.append(rows, rows), np.append(cols, np.full(n, n + 1)), np.ones(2 * n), n + 2, toxic, 0.3, steps=300, decay=0.0)
    f = w[:n] + w[-1]
    hidden = np.logaddexp(0, f[~toxic]).mean() - 0.3 * np.logaddexp(0, f[toxic]).mean()
    assert hidden > -0.3 and f[toxic].min() > f[~toxic].max()


# --- operator 7 ---------------------------------------------------------------------------------------------


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    df = clashing(spark, ["part", "token_ids", "tie"])
    path = str(tmp_path / "tokens")
    token_files.write_tokens(df, path, JSON)
    rows = texts(df)
    ids = {(d, x): [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in rows}
    got = token_files.token_index(spark, path).orderBy(F.asc_nulls_first("doc_id"), "start").collect()
    at = 0
    for r in got:
        assert r.start == at and any(d == r.doc_id and len(v) == r.n_tokens and zlib.crc32(np.array(v, "<u4").tobytes()) == r.ids_crc32 for (d, _), v in ids.items())
        at += r.n_tokens
    assert len(got) == len(rows) and at == sum(len(ids[x]) for x in rows)
    assert token_files.read_tokens(spark, path).where("doc_id = 6").first().token_ids == ids[6, dict(rows)[6]]
    none = str(tmp_path / "none")
    token_files.write_tokens(empty(spark), none, JSON)
    assert token_files.token_index(spark, none).count() == 0


def test_added_tokens_are_the_librarys(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    end = "<|endoftext|>"
    assert t.encode(f"abc {end} def", add_special_tokens=False).ids == [39305, 220, 50256, 825]
    rng = random.Random(3)
    parts = [end, end, "<|endof", "text|>", "<|", " ", "  \n", "a b", "'s", "é漢", "<|endoftext", "don't"]
    sample = [f"abc {end} def", end, end * 3, "", f"{end} ", "<|endof", "text|> x", None, *("".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(400))]
    df = spark.createDataFrame([*enumerate(sample)], "doc_id long, text string")
    want = [t.encode(x or "", add_special_tokens=False).ids for x in sample]
    token_files.write_tokens(df, str(tmp_path / "tokens"), JSON, end_id=None)
    assert [r.token_ids for r in token_files.read_tokens(spark, str(tmp_path / "tokens")).orderBy("doc_id").collect()] == want
    assert sorted(r.n_tokens for r in token_counts.token_lengths(df, JSON).collect()) == sorted(map(len, want))


def test_longest_added_token_counts():
    encoder = token_files.AddedEncoder(lambda data, a, b: (data[K.ragged(a, b - a)].astype(np.int32), b - a), token_files.library_classes(), {b"<a>": 1000, b"<a><b>": 1001})
    data, off = K.buffers(pa.array(["x<a><b>y<a>", "<a>", "<b>", "", "<a><", "b><a>"]))
    ids, to = encoder.chunk(data, off)
    want = [[120, 1001, 121, 1000], [1000], [60, 98, 62], [], [1000, 60], [98, 62, 1000]]
    assert [ids[a:b].tolist() for a, b in zip(to[:-1], to[1:], strict=True)] == want


# --- operator 8 ---------------------------------------------------------------------------------------------


def brute_lines(rows, least_docs=3, least=20):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(d)
    keeper = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


def lines_of(df):
    return sorted(map(repr, ((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.select("p.doc_id", "n_lines", "n_dropped", "kept_text").collect())))


@pytest.mark.parametrize("shard_keys, probed", [(1 << 20, 1 << 21), (2, 3)])
def test_line_dedup(spark, shard_keys, probed, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(line_dedup, "PROBED", probed)
    line, other = "this line stands in several documents", "that line is in four of them, a little one"
    more = [(i, f"{line}\n{other if i % 2 else i}\n{i} {line}", "en", "s", 1) for i in range(20, 28)] + [(None, f"x\n{line}\n{i}", "en", "s", 1) for i in range(4)]
    df = clashing(spark, ["k1", "drops", "p", "id", "kept_text", "of", "tie"])
    df = df.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    assert lines_of(line_dedup.line_dedup(df)) == brute_lines(texts(df))
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_index_is_reversible(spark):
    line = "this line stands in several documents"
    docs = spark.createDataFrame([(i, f"{line}\nown line {i}", "en", "s", 1) for i in range(4)], SCHEMA)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    hot = lambda: index.counts().where("refs >= 3").count()
    index = line_dedup.LineIndex(spark)
    # Nothing is in yet: deletions and questions are possible.
    index.delete(ids(1))
    assert lines_of(index.apply(docs)) == sorted(map(repr, ((r.doc_id, 2, 0, r.text) for r in docs.collect())))
    assert index.alive().count() == 0 == index.counts().count()
    index.insert(docs.limit(0))
    index.insert(docs)
    assert lines_of(index.apply(docs)) == brute_lines(texts(docs)) and hot() == 1
    # Once more, and once more deleted: a document is in or it isn't.
    index.insert(docs)
    assert index.counts().agg(F.max("refs")).first()[0] == 4
    index.delete(ids(3, 99))
    index.delete(ids(3))
    rest = docs.where("doc_id < 3")
    assert lines_of(index.apply(rest)) == brute_lines(texts(rest)) and index.alive().where("doc_id = 3").count() == 0
    index.delete(ids(0))
    rest = docs.where("doc_id in (1, 2)")
    assert all(r.n_dropped == 0 for r in index.apply(rest).collect()) and hot() == 0
    (stored_filter,) = index.filters()[0].collect()
    f = CuckooFilter.from_bytes(bytes(stored_filter["filter"]))
    assert not f.table.any() and not f.stash  # the key left the stored filter again
    # Another text under the same id replaces the one before; a new object on the same folder goes on.
    index = line_dedup.LineIndex(spark, index.path)
    index.insert(spark.createDataFrame([(3, f"  {line.upper()}  \nnew", "en", "s", 1), (1, "nothing of it", "en", "s", 1), (5, line, "en", "s", 1)], SCHEMA))
    now = spark.createDataFrame([(1, "nothing of it", "en", "s", 1), (2, f"{line}\nown line 2", "en", "s", 1), (3, f"  {line.upper()}  \nnew", "en", "s", 1), (5, line, "en", "s", 1)], SCHEMA)
    assert lines_of(index.apply(now)) == brute_lines(texts(now)) and hot() == 1


def test_line_index_grows_its_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    lines = [f"line number {i} of a text that repeats" for i in range(15)]
    docs = spark.createDataFrame([(i, "\n".join(lines[: 5 * i + 5]), "en", "s", 1) for i in range(3)] + [(i, "\n".join(lines), "en", "s", 1) for i in (7, 8)], SCHEMA)
    index = line_dedup.LineIndex(spark)
    for i in (0, 1, 7, 8, 2):
        index.insert(docs.where(F.col("doc_id") == i))
    assert index.filters()[1] >= 4 and lines_of(index.apply(docs)) == brute_lines(texts(docs))
    index.delete(spark.createDataFrame([(8,)], "doc_id long"))
    rest = docs.where("doc_id <> 8")
    assert lines_of(index.apply(rest)) == brute_lines(texts(rest))


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    f = CuckooFilter.for_keys(len(keys))
    f.insert(keys)
    assert f.contains(keys).all()
    others = rng.integers(2**63, 2**64 - 1, 50_000, dtype=np.uint64)
    assert f.contains(others).mean() < 0.001
    again = CuckooFilter.from_bytes(f.to_bytes())
    again.delete(keys[:5000])
    assert again.contains(keys[5000:]).all() and again.contains(keys[:5000]).mean() < 0.01
    tiny = CuckooFilter(1)
    tiny.insert(keys[:20])
    assert tiny.contains(keys[:20]).all() and CuckooFilter.from_bytes(tiny.to_bytes()).contains(keys[:20]).all()
    tiny.delete(keys[:20])
    assert not tiny.table.any() and not tiny.stash


# --- operator 9 ---------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full, out = share * sum(sizes.values()), set(), {}
    while True:
        opened = [s for s in order if s not in full]
        total = sum(w[s] for s in opened)
        out = {s: most * sizes[s] if s in full else left * w[s] / total for s in order}
        over = [s for s in opened if out[s] > most * sizes[s]]
        if not over:
            return out
        for s in over:
            full.add(s)
            left -= most * sizes[s]


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 300))), "en", rng.choice(["a", "a", "a", "b", "ç", None, "Z"]), 1) for i in range(400)]
    rows += [(400, None, "en", "empty", 0), (401, "x", "en", "tiny", 1), (401, "x", "en", "tiny", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("lane", F.lit("mine"))
    mixture = mixing.mix(df)
    got = mixture.totals().collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    again = mixing.mix(df.repartition(7)).totals().collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    # Any stretch of the schedule holds the sources in proportion, but for a few slots.
    slots = sorted((r.slot, r.lane) for r in mixture.slots().collect() if r.slot < mixture.n_slots)
    assert len({s for s, _ in slots}) == len(slots)
    half = [lane for _, lane in slots[: len(slots) // 2]]
    for lane, n in Counter(lane for _, lane in slots).items():
        assert abs(half.count(lane) - n / 2) <= 6
    assert mixing.mix(empty(spark)).totals().count() == 0


def test_points_are_exact(spark):
    n = [0, 1, 2, 12345, (1 << 31) - 1, 1 << 31, (1 << 40) + 7]
    got = spark.createDataFrame([(x,) for x in n], "slot long").select(mixing.points(F.col("slot")).alias("p")).collect()
    assert [r.p for r in got] == [x * mixing.STEP % (1 << mixing.BITS) for x in n]


# --- operator 10 --------------------------------------------------------------------------------------------


def test_jpeg(spark):
    df = clashing(spark, ["media", "n_bytes"])
    got = {(r.doc_id, r.n_bytes): r for r in jpeg.from_media(jpeg.to_media(df)).collect()}
    media = {r.doc_id: r.media for r in jpeg.to_media(df).collect()}
    for d, t in texts(df):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = got[d, len(data)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), sha(payload), zlib.crc32(payload[-64:]))
        if d != 8:
            assert (r.media_bytes, r.media_sha256) == (len(media[d]), sha(bytes(media[d])))
    assert got[4, 3].feature == got[5, 3].feature
    assert jpeg.from_media(jpeg.to_media(empty(spark))).count() == 0


def test_jpeg_of_all_bytes_and_chains():
    rng = np.random.default_rng(2)
    for n in (64, 6400, 64 * (jpeg.MOST_ROWS + 3)):
        payload = rng.integers(0, 256, n).astype(np.uint8)
        (image,) = jpeg.encode_payloads(payload, np.array([0, n]))
        ((width, height, samples),) = jpeg.thumbnails([image])
        assert samples == payload.tobytes() and (width, height) == (512, n // 8)


def test_jpeg_markers_and_other_tables():
    with pytest.raises(ValueError, match="start"):
        jpeg.thumbnails([b"nonsense"])
    payload = np.arange(64, dtype=np.uint8)
    (image,) = jpeg.encode_payloads(payload, np.array([0, 64]))
    progressive = image.replace(b"\xff\xc0", b"\xff\xc2", 1)
    with pytest.raises(ValueError, match="baseline"):
        jpeg.thumbnails([progressive])
    commented = image[:2] + b"\xff\xfe\x00\x06abcd" + image[2:]
    assert jpeg.thumbnails([commented])[0][2] == payload.tobytes()


def test_decoder_passes_over_ac_codes():
    """A scan with AC coefficients and without restarts, by tables of its own."""
    dc = tuple(jpeg.huffman([0, 2] + [0] * 14, [0, 3]))
    ac = tuple(jpeg.huffman([0, 3] + [0] * 14, [0x00, 0x12, 0xF0]))
    code = {("d", v): f"{c:0{n}b}" for v, c, n in dc} | {("a", v): f"{c:0{n}b}" for v, c, n in ac}
    bits = code["d", 3] + "101" + code["a", 0x12] + "10" + code["a", 0xF0] + code["a", 0x00] + code["d", 0] + code["a", 0x00] + code["d", 3] + "010" + code["a", 0x00]
    bits += "1" * (-len(bits) % 8)
    data = np.frombuffer(int(bits, 2).to_bytes(len(bits) // 8, "big"), np.uint8)
    samples, _ = jpeg.decode_segments(data, np.array([0]), np.array([3]), ((dc, ac, 8),))
    assert samples.tolist() == [133, 133, 128]


def colour_image(luma, chroma, width, height, restart):
    """A 4:2:0 image bit by bit: luma and two chroma planes of block values 0..255, quantised by 8."""
    dc, ac = jpeg.huffman(jpeg.DC_BITS, jpeg.DC_VALUES), jpeg.huffman(jpeg.AC_BITS, jpeg.AC_VALUES)
    code = {v: f"{c:0{n}b}" for v, c, n in dc}
    end = f"{ac[0][1]:0{ac[0][2]}b}"
    rows, columns = -(-height // 16), -(-width // 16)
    body, bits, before = b"", "", [0, 0, 0]
    for unit in range(rows * columns):
        if unit and restart and unit % restart == 0:
            bits += "1" * (-len(bits) % 8)
            body += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            bits, before = "", [0, 0, 0]
        y, x = divmod(unit, columns)
        for part, value in [(0, luma[2 * y + b][2 * x + a]) for b in (0, 1) for a in (0, 1)] + [(1, chroma[0][y][x]), (2, chroma[1][y][x])]:
            diff = value - 128 - before[part]
            before[part] = value - 128
            size = abs(diff).bit_length()
            bits += code[size] + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "") + end
    bits += "1" * (-len(bits) % 8)
    body += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = lambda kind, data: bytes([0xFF, kind]) + (len(data) + 2).to_bytes(2, "big") + data
    head = b"\xff\xd8" + seg(0xDB, bytes([0, *[8] * 64])) + seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += seg(0xC4, bytes([0x00, *jpeg.DC_BITS, *jpeg.DC_VALUES])) + seg(0xC4, bytes([0x10, *jpeg.AC_BITS, *jpeg.AC_VALUES])) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"")
    return head + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + body + b"\xff\xd9"


@pytest.mark.parametrize(("width", "height", "restart"), [(40, 24, 0), (64, 48, 3), (9, 70, 1)])
def test_jpeg_luminance_of_colour_images(width, height, restart):
    rng = random.Random(width)
    rows, columns = -(-height // 16), -(-width // 16)
    plane = lambda r, c: [[rng.randrange(256) for _ in range(c)] for _ in range(r)]
    luma, chroma = plane(2 * rows, 2 * columns), (plane(rows, columns), plane(rows, columns))
    ((w, h, samples),) = jpeg.thumbnails([colour_image(luma, chroma, width, height, restart)])
    assert (w, h) == (width, height)
    assert samples == bytes(v for row in luma[: -(-height // 8)] for v in row[: -(-width // 8)])
    assert jpeg.feature(w, h, samples).startswith(f"{width}x{height}:")


def test_jpeg_read_bit_by_bit():
    """The writer's images by a decoder of its own: one bit after the other, as the standard's flow charts go."""
    rng = np.random.default_rng(7)
    payload = np.concatenate([rng.integers(0, 256, 640), np.zeros(64), np.full(64, 255)]).astype(np.uint8)
    (image,) = jpeg.encode_payloads(payload, np.array([0, len(payload)]))
    dc = {f"{c:0{n}b}": v for v, c, n in jpeg.huffman(jpeg.DC_BITS, jpeg.DC_VALUES)}
    scan = image[image.index(b"\xff\xda") :]
    scan = scan[2 + int.from_bytes(scan[2:4], "big") : -2]
    out = []
    for i, part in enumerate(re.split(rb"\xff[\xd0-\xd7]", scan)):
        bits, at, value = "".join(f"{b:08b}" for b in part.replace(b"\xff\0", b"\xff")), 0, 0
        for _ in range(64):
            n = next(n for n in range(1, 17) if bits[at : at + n] in dc)
            size = dc[bits[at : at + n]]
            extra = bits[at + n : at + n + size]
            value += 0 if not size else int(extra, 2) if extra[0] == "1" else int(extra, 2) - (1 << size) + 1
            out.append(value + 128)
            at += n + size
            assert bits[at] == "0"  # end of block
            at += 1
        assert set(bits[at:]) <= {"1"} and len(bits) - at < 8
    assert bytes(out) == payload.tobytes()


# --- what the registered queries add ------------------------------------------------------------------------


def test_orc_footers_prune(spark, tmp_path):
    """Written files carry Bloom filters and statistics of doc_id, and a filter on an id reads one file's stripe."""
    from pyarrow import orc

    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text number "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "tokens")
    token_files.write_tokens(df, path, JSON)
    files = sorted((tmp_path / "tokens").glob("part-*.orc"))
    assert len(files) >= 2
    before = -1
    for f in files:
        held = orc.ORCFile(str(f))
        ids = held.read(columns=["doc_id"]).column("doc_id").to_pylist()
        assert ids == sorted(ids) and ids[0] > before and held.row_index_stride == 2000 and held.nstripes >= 1
        before = ids[-1]
    plan = token_files.read_tokens(spark, path).where("doc_id = 77")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in plan
    reader = spark._jvm.org.apache.orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(files[0])), spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    stripe = reader.getStripes().get(0)
    footer = reader.rows().readStripeFooter(stripe)
    kinds = [str(s.getKind()) for s in footer.getStreamsList() if s.getColumn() == 1]
    assert "BLOOM_FILTER_UTF8" in kinds and "ROW_INDEX" in kinds
    statistics = reader.getStripeStatistics().get(0).getColumnStatistics()[1]
    assert statistics.getMinimum() == 0 and statistics.getMaximum() == orc.ORCFile(str(files[0])).read(columns=["doc_id"]).column("doc_id").to_pylist()[-1]
    encodings = [str(footer.getColumns(i).getKind()) for i in range(footer.getColumnsCount())]
    assert "DIRECT_V2" in encodings  # run lengths of integers


def test_risk_is_the_definitions():
    """Gradient of the corrected risk by differences of its definition, at a random point, on both sides of zero."""
    rng = np.random.default_rng(3)
    n, m = 40, 6
    x = rng.normal(size=(n, m))
    toxic = np.arange(n) < 12
    soft = lambda z: np.log1p(np.exp(-z))

    def parts(w, prior):
        f = x @ w
        return prior * soft(f[toxic]).mean(), soft(-f[~toxic]).mean() - prior * soft(-f[toxic]).mean()

    rows, cols = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    for prior in (0.05, 0.9):
        start = np.zeros(m)
        start[-1] = np.log(prior / (1 - prior))
        positive, hidden = parts(start, prior)
        target = (lambda w: sum(parts(w, prior))) if hidden >= 0 else (lambda w: -parts(w, prior)[1])
        gradient = np.array([(target(start + h) - target(start - h)) / 2e-6 for h in np.eye(m) * 1e-6])
        moved = toxicity.nnpu(rows, cols, x.ravel(), m, toxic, prior, steps=1, rate=0.01)
        assert np.allclose(np.sign(start - moved), np.sign(gradient)) and np.allclose(np.abs(start - moved), 0.01, atol=1e-5)


ROOT = "/root/testdata/sf0.001"


def test_registered_queries_are_brute_force(spark, library):
    """op3, op4, op5, op7 and op10 as registered, on the whole small table."""
    from tokenizers import Tokenizer

    from tickloom.llm import queries

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect())
    t, found = Tokenizer.from_file(JSON), queries.queries()
    ids = {d: t.encode(x, add_special_tokens=False).ids for d, x in docs}
    lengths = Counter(map(len, ids.values()))
    for r in found["op3_token_counts"](spark, ROOT).collect():
        above = [n for n in map(len, ids.values()) if n > r.n_tokens]
        cut = sum(min(len(x), r.n_tokens) for x in ids.values())
        assert (r.n_docs, r.docs_above, r.tokens_above, r.truncated_total) == (lengths.pop(r.n_tokens), len(above), sum(above), cut)
    assert not lengths
    for r in found["op4_byte_bpe"](spark, ROOT).collect():
        text = dict(docs)[r.doc_id]
        assert (r.ids_sha256, r.decoded_sha256) == (sha(np.array(library.encode_ordinary(text), "<u4").tobytes()), sha(text.encode()))
    classes = dict(brute_classes_by_id(docs))
    assert {r.doc_id: (r.class_id, r.class_size) for r in found["op5_near_duplicates"](spark, ROOT).collect()} == classes
    at = 0
    for r in found["op7_token_files"](spark, ROOT).orderBy("doc_id").collect():
        own = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    for r in found["op10_jpeg"](spark, ROOT).collect():
        data = dict(docs)[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]))
    for r in found["op6_toxicity"](spark, ROOT).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


def brute_classes_by_id(rows, least=0.8):
    """(id, (least id of the class, size)) of each row, by plain sets."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    top = [*range(len(rows))]

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a or b) and min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return [(d, (min(g), len(g))) for g in groups.values() for d in g]
