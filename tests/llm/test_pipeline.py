"""The pipeline, stage by stage, against brute force on what each stage got."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import cache

import corpus_pipeline as P
import duckdb
import numpy as np
from tests.llm.helpers import SCHEMA, clashing, empty
from tests.llm.test_operators import brute_classes, brute_lines, library, texts  # noqa: F401
from tickloom.llm import kernels as K
from tickloom.llm import mixing, toxicity
from tickloom.llm.queries import OP9_SQL
from tickloom.llm.runtime import stored

ROOT = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        before, docs = docs, stored(stage(spark, docs, ROOT))
        seen[name] = (before, docs)
        if name != P.STAGES[-1][0]:
            assert docs.columns == [*P.COLUMNS] and docs.dtypes == before.dtypes
    a, b = seen["toxicity"]
    assert {r.doc_id for r in b.collect()} <= {r.doc_id for r in a.collect()} and b.count() >= 0.8 * a.count()
    a, b = seen["line_dedup"]
    want = sorted(eval(x)[0:4:3] for x in brute_lines(texts(a)))
    assert sorted((r.doc_id, r.text) for r in b.collect()) == want and all(r.n_chars == len(r.text) for r in b.collect())
    a, b = seen["near_dedup"]
    assert sorted(r.doc_id for r in b.collect()) == sorted({c for c, _ in brute_classes(texts(a))})
    a, b = seen["mixing"]
    times = {r.id: r.times for r in mixing.mix(a).totals().collect()}
    assert Counter(r.doc_id for r in b.collect()) == Counter({k: v for k, v in times.items() if v}) and max(times.values()) <= 2
    a, b = seen["byte_bpe"]
    assert sorted((r.doc_id, r.decoded_sha256) for r in b.collect()) == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in a.collect())


def test_run_gives_the_last_stages_rows(spark):
    got = P.run(spark, ROOT)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"] and got.count() > 0


def test_empty_documents(spark):
    docs = empty(spark)
    for _, stage in P.STAGES:
        docs = stored(stage(spark, docs, ROOT))
    assert docs.count() == 0


def test_stages_on_awkward_rows(spark):
    docs = clashing(spark, ["id", "tie", "score", "p", "times", "rows", "copies"])
    for name, stage in P.STAGES:
        got = stage(spark, docs, ROOT).collect()
        assert len(got) > 0 and (name == "mixing" or name == "near_dedup" or len(got) == docs.count())


def test_equal_rows_share_what_they_were_taken(spark):
    """Two equal rows of 100 words and one of the same id and text that differs elsewhere."""
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (1, text, "de", "a", 1)] + [(i, " ".join(f"x{j}" for j in range(i)), "en", "b" if i % 3 else "c", 1) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    times = Counter()
    for r in mixing.mix(docs).totals().collect():
        times[r.id] += r.times
    got = Counter((r.doc_id, r.lang) for r in P.mixing_stage(spark, docs, ROOT).collect())
    by_id = Counter()
    for (i, _), n in got.items():
        by_id[i] += n
    assert by_id == Counter({k: v for k, v in times.items() if v})
    base = times[1] // 3
    assert base <= got[1, "de"] <= base + 1 and 2 * base <= got[1, "en"] <= 2 * base + 2


def test_toxicity_stage_drops_what_scores_high(spark):
    """Scores by plain loops from the model's weights; and most of what is labelled toxic goes."""
    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")
    model = toxicity.train(docs, labels)
    place = {int(h): i for i, h in enumerate(model.known)}

    @cache
    def places(word):
        spans = lambda b: K.span_hash(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))
        own = [spans(word), *(K.mix64(spans(word[:n]) + K.U64(n)) for n in toxicity.PREFIXES if len(word) > n)]
        return [place[int(h[0])] for h in own if int(h[0]) in place]

    high = set()
    for d, text in texts(docs):
        found = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())]
        count = Counter(i for w in found for i in places(w))
        raw = model.bias + model.length * math.log1p(len(found)) + sum(model.weights[level, i] for i, n in count.items() for level, least in enumerate(toxicity.LEVELS) if n >= least)
        if 1 / (1 + math.exp(-max(-30, min(30, raw)))) >= toxicity.THRESHOLD:
            high.add(d)
    gone = {d for d, _ in texts(docs)} - {r.doc_id for r in P.toxicity_stage(spark, docs, ROOT).collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert gone == high and len(gone & toxic) >= 0.7 * len(toxic)


def test_mixing_stage_takes_words_as_the_sql(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    first = OP9_SQL[: OP9_SQL.rindex("SELECT doc_id")] + "SELECT doc_id, CAST(take // source_size + CASE WHEN upto - size < take % source_size THEN 1 ELSE 0 END AS INTEGER) FROM f WHERE size > 0"
    want = {k: v for k, v in con.execute(first).fetchall() if v}
    assert Counter(r.doc_id for r in P.mixing_stage(spark, docs, ROOT).collect()) == want


def test_encode_stage_has_the_librarys_ids(spark, library):  # noqa: F811
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    want = sorted((r.doc_id, hashlib.sha256(np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest()) for r in docs.collect())
    got = P.encode_stage(spark, docs, ROOT).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in got) == want
    assert all(hashlib.sha256(np.array(r.token_ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 and len(r.token_ids) == r.n_tokens for r in got)
