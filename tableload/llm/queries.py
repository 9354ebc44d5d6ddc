"""The operators over the given tables, with the SQL that gives the same result where SQL can express it."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableload.llm import (
    bpe,
    collocations,
    grammar,
    jaccard,
    language_model,
    neighbours,
    packing,
    quality,
    secrets,
    token_counts,
    topk,
    toxicity,
    vector_codes,
)
from tableload.workspace import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language_model_scores(spark, sf_dir):
    return language_model.scores(table(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_grammar_files(spark, sf_dir):
    path = scratch_path(spark, "llm-id-files")
    grammar.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return grammar.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_ngram_jaccard_join,
            op2_secret_scans,
            op3_token_counts,
            op4_language_model_scores,
            op5_bpe_round_trip,
            op6_packing,
            op7_nearest_neighbours,
            op8_quality,
            op9_toxicity,
            op10_exact_top_k,
            op11_grammar_files,
            op12_collocations,
            op13_vector_codes,
        )
    }


UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
WORDS = f"list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

SHINGLE_COMPONENTS = f"""
WITH RECURSIVE worded AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
  FROM worded),
shingles AS (SELECT * FROM (SELECT doc_id, hash(unnest(s)) AS h FROM sets) QUALIFY count(*) OVER (PARTITION BY h) > 1),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * i >= 75 * (len(x.s) + len(y.s) - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.seen)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.seen) AS component_id
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


IMPACT_TOP = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


PHRASES = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
runs AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM worded, (VALUES (1), (2), (3), (4), (5)) AS lengths(m)),
counted AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
longer AS (
  SELECT DISTINCT c.lang, array_to_string(string_split(c.phrase, ' ')[i : i + k - 1], ' ') AS phrase, c.f
  FROM counted c, (VALUES (2), (3), (4)) AS sizes(k), generate_series(1, 4) AS starts(i)
  WHERE k < c.m AND i + k - 1 <= c.m),
kept AS (
  SELECT * FROM counted c WHERE m > 1
    AND NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.f >= 100 * c.f)),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS tail
  FROM kept, generate_series(1, 4) AS cuts(k) WHERE k < m),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, s.n,
    CAST((CAST(1000 AS HUGEINT) * c.a * s.n) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head
    JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail JOIN sizes s ON s.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM weakest
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Assignment and update once per round, then a last assignment."""
    square = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (
  SELECT vec_id, label, CAST(k AS INTEGER) AS part, v[1 + k * (len(v) // {parts}) : (k + 1) * (len(v) // {parts})] AS v
  FROM kept, range({parts}) AS cuts(k))""",
        f"""first_ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries})""",
        """book0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN first_ids USING (vec_id))""",
    ]
    for k in range(rounds + 1):
        ctes.append(f"""near{k} AS MATERIALIZED (
  SELECT p.vec_id, p.part, any_value(p.v) AS v, any_value(p.label) AS label,
    min(CAST({square} AS HUGEINT) * {entries} + c.entry) AS best
  FROM parts p JOIN book{k} c ON c.part = p.part GROUP BY p.vec_id, p.part)""")
        if k < rounds:
            ctes.append(f"""moved{k} AS (
  SELECT part, entry, list(CAST(floor_sum AS BIGINT) ORDER BY place) AS v FROM (
    SELECT part, best % {entries} AS entry, place,
      (sum(v[place]) - ((sum(v[place]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
    FROM near{k}, range(1, 65) AS places(place) WHERE place <= len(v) GROUP BY ALL) GROUP BY part, entry)""")
            ctes.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN moved{k} m ON m.part = b.part AND m.entry = b.entry)""")
    last = f"near{rounds}"
    ctes.append(f"""coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', CAST(best % {entries} AS INTEGER))), '' ORDER BY part) AS code,
    CAST(sum(best // {entries}) AS BIGINT) AS error FROM {last} GROUP BY vec_id)""")
    ctes.append(f"""sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label)""")
    ctes.append(f"""said AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})""")
    return "WITH " + ",\n".join(ctes) + """
SELECT c.vec_id, c.code, c.error, s.label_error, b.codebooks_sha256
FROM coded c JOIN sums s ON s.label IS NOT DISTINCT FROM c.label, said b"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": SHINGLE_COMPONENTS,
        "op10_exact_top_k": IMPACT_TOP,
        "op12_collocations": PHRASES,
        "op13_vector_codes": _codes_sql(),
    }
