"""The registered queries of the corpus operators: thin digests over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, jpeg, line_dedup, mixing, near_dup, spelling, substring_dedup, token_counts, token_files, top_k, toxicity, url_filter
from .runtime import shared_path


#: One of so many runs of letters is misspelt in op12, and the rules of op13.
MISSPELT = 31
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.substring_dedup(docs)
    return found.select("p.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return token_counts.suffix_sums(token_counts.length_histogram(lengths))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs).select("doc_id", "class_id", "class_size")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"))
    return token_files.token_index(spark, path)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.line_dedup(docs)
    return found.select("p.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = mixing.mix(table(spark, sf_dir, "documents")).totals()
    return totals.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jpeg.from_media(jpeg.to_media(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = centroids.labelled(vectors, centroids.k_means(vectors), columns=["vec_id"])
    return found.select("p.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.misspelt(spelling.runs(table(spark, sf_dir, "documents")), MISSPELT)
    return spelling.spelling_variants(spelling.counted(found))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, RULES).select("p.page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_top_k, op2_substring_dedup, op3_token_counts, op4_byte_bpe, op5_near_duplicates, op6_toxicity, op7_token_files, op8_line_dedup, op9_mixing, op10_jpeg, op11_centroids, op12_spelling_variants, op13_url_filter)
    return {f.__name__: f for f in found}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
n AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)),
r AS (SELECT h FROM n GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM n SEMI JOIN r USING (h)),
d AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id),
k AS (
  SELECT doc_id, words, coalesce(gone, []) AS gone,
         list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept
  FROM w LEFT JOIN d USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""

OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
h AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, h.keeper IS NOT NULL AND h.keeper <> l.doc_id AS gone FROM l LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
c AS (
  SELECT *,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS filled,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE) AS remaining,
    (sum(source_size) OVER ()) * 1.5::DOUBLE AS total FROM w),
v AS (SELECT *, max(CASE WHEN cap >= (total - filled) / remaining * weight THEN (total - filled) / remaining END) OVER () AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM v),
o AS (
  SELECT doc_id, source, size,
         CAST(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM d),
f AS (SELECT doc_id, size, upto, source_size, target, CAST(floor(target) AS BIGINT) AS take
      FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE size * (take // source_size) + least(upto, take % source_size) - least(upto - size, take % source_size) END AS taken
FROM f
"""



def _op11_sql() -> str:
    rounds = [f"""
a{i} AS MATERIALIZED (
  SELECT pos, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.pos, m.c, CAST(list_sum(list_transform(list_zip(v.q, m.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, m{i} m)
  GROUP BY pos)""" + ("" if i == centroids.ROUNDS else f""",
s{i} AS (
  SELECT c, j, floor_of(s, n) AS f FROM (
    SELECT c, j, CAST(sum(x) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n FROM (SELECT a.c, unnest(q) AS x, unnest(range(1, {centroids.DIMS + 1})) AS j FROM v JOIN a{i} a USING (pos)) GROUP BY c, j)),
m{i + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(g.q, m.q) AS q FROM m{i} m LEFT JOIN (SELECT c, list(f ORDER BY j) AS q FROM s{i} GROUP BY c) g USING (c))""").replace("floor_of(s, n)", "(s - ((s % n) + n) % n) // n") for i in range(centroids.ROUNDS + 1)]  # fmt: skip
    last = centroids.ROUNDS
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS pos, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (
    SELECT q, sha256('{centroids.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, q LIMIT {centroids.K})),
{",".join(rounds)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM v JOIN a{last} a USING (pos) JOIN m{last} m ON a.c = m.c
"""


# The table of crc32 is made from its polynomial; a word's remainders without one letter tell which words are near.
OP12_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
o AS MATERIALIZED (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents) GROUP BY 1, 2),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(b)), lambda i: CAST(('0x' || substr(hex(b), 2 * i + 1, 2)) AS BIGINT))),
                                 lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM (SELECT run, n, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS b FROM o), t),
w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS other, b.n FROM d a JOIN d b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS best, max(n) AS best_n FROM p GROUP BY word),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)
"""

OP13_SQL = r"""
WITH r (host, path, verdict) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + r"""),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS pos FROM pages),
m AS (
  SELECT u.pos, arg_max({'rule': r.host || r.path, 'verdict': r.verdict}, (length(r.host || r.path), length(r.host))) AS b
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.pos)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (pos)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op8_line_dedup": OP8_SQL, "op9_mixing": OP9_SQL, "op11_centroids": _op11_sql(),
        "op12_spelling_variants": OP12_SQL, "op13_url_filter": OP13_SQL,
    }
