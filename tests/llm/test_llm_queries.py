"""The registered queries over the given tables: against SQL where there is some, else whole and of the right shape."""

import os
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_llm_jaccard import all_pairs
from test_llm_packing import whole

import corpus_pipeline
from tableload.llm import packing, quality, queries, secrets, token_counts, toxicity

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

COLUMNS = {
    "op1_ngram_jaccard_join": "doc_id n_shingles component_id",
    "op2_secret_scans": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op4_language_model_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5_bpe_round_trip": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_nearest_neighbours": "query_id rank vec_id score",
    "op8_quality": "doc_id held_out score predicted",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_exact_top_k": "query_id rank vec_id score",
    "op11_grammar_files": "doc_id start n_tokens ids_crc32",
    "op12_collocations": "lang rank phrase a l r n score",
    "op13_vector_codes": "vec_id code error label_error codebooks_sha256",
}


def test_every_operator_is_registered():
    assert list(queries.queries()) == list(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, name):
    found = queries.queries()[name](spark, SF_DIR)
    wanted = COLUMNS[name].split()
    assert found.columns[: len(wanted)] == wanted
    rows = found.collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    if "doc_id" in wanted:
        ids = [r.doc_id for r in rows]
        assert set(ids) == {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "op6_packing" or len(ids) == docs.count()


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        files = path / "*.parquet" if path.is_dir() else path
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    wanted = connection.execute(queries.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    found = queries.queries()[name](spark, SF_DIR)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(names).collect())) == sorted(map(tuple, wanted.fetchall()))


def test_id_files_against_the_library(spark):
    tokenizer = token_counts.library_tokenizer(queries.public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    start, wanted = 0, []
    for r in docs:
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        wanted.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op11_grammar_files(spark, SF_DIR).collect())) == wanted


def test_packed_documents_are_whole(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    whole(queries.op6_packing(spark, SF_DIR).collect(), texts)


def test_pipeline_against_plain_stages(spark):
    """Each stage on its own input, checked by what it must keep; the last one token by token."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "secrets", "packing"]

    civil = stages["toxicity"](spark, docs, SF_DIR)
    classifier = toxicity.fit(docs, labels)
    kept = [r for r in docs.collect() if classifier.scores([r.text or ""])[0] < 0.5]
    assert sorted(civil.collect()) == sorted(kept) and civil.schema == docs.schema

    good = stages["quality"](spark, civil, SF_DIR)
    weights, intercept = quality.fit(civil, labels)
    kept = [r for r in kept if quality.score(r.text or "", weights, intercept) >= 0.5]
    assert sorted(good.collect()) == sorted(kept)

    single = stages["near_duplicates"](spark, good, SF_DIR)
    components = all_pairs([(r.doc_id, r.text) for r in kept])
    kept = [r for r in kept if components[r.doc_id][1] == r.doc_id]
    assert sorted(single.collect()) == sorted(kept) and single.schema.names == docs.schema.names

    clean = stages["secrets"](spark, single, SF_DIR)
    after = {r.doc_id: r for r in clean.collect()}
    assert set(after) == {r.doc_id for r in kept}
    assert not any(secrets.base_spans(r.text)[0] for r in after.values())
    for r in kept:
        if not secrets.base_spans(r.text)[0] and "[secret]" not in after[r.doc_id].text:
            assert after[r.doc_id] == r

    pieces = stages["packing"](spark, clean, SF_DIR).collect()
    whole(pieces, [(i, r.text) for i, r in after.items()])
    run = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, pieces))


def test_one_row_of_each_component(spark):
    """Rows that share an id are told apart, repeated rows and null ids leave one, texts without words stay."""
    a, b, c, d, e = (" ".join(f"{name}{k}" for k in range(12)) for name in "abcde")
    rows = [(5, a), (5, b), (3, b), (None, b), (4, c), (4, c), (4, c), (4, c.upper()), (None, d), (None, d), (9, d), (None, e), (7, ""), (7, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(4)
    kept = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF_DIR).collect()]
    of_c = [t for i, t in kept if i == 4]
    assert len(of_c) == 1 and of_c[0].lower() == c
    wanted = [(5, a), (3, b), (9, d), (None, e), (7, ""), (7, ""), (8, None)]
    assert sorted((k for k in kept if k[0] != 4), key=str) == sorted(wanted, key=str)


def test_packing_is_repeatable(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    a = packing.pack(docs, queries.public_tokenizers.path("byte_bpe_50k.json")).collect()
    b = packing.pack(docs.repartition(7), queries.public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_held_out_documents_of_the_language_model(spark):
    rows = queries.op4_language_model_scores(spark, SF_DIR).collect()
    totals = defaultdict(float)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        totals[r.held_out, "base"] += r.base_score
        totals[r.held_out, "model"] += r.score
    assert totals[True, "model"] > totals[True, "base"] and totals[False, "model"] > totals[False, "base"]
