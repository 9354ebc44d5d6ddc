import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from edge_texts import SCHEMA, edge_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tableload.llm import grammar, rows, word_ids
from tableload.llm.token_counts import library_tokenizer
from tableload.workspace import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def library_ids(text):
    return library_tokenizer(VOCABULARY).encode(text or "", add_special_tokens=False).ids


ODD = ["it's we'll I'M don't", "ÀÉÎ ÿ ß × ÷ µ ª", "a\tb\r\nc\x0bd\x85e\xa0f", "12 345 x9y", "é ́x İ Σας ΣΑΣ", "\x01 \x02a", "<|endoftext|>a<|startoftext|>", "汉字かな 😀", "", "   ", "\n\n", "ſ K"]


def test_word_ids_equal_the_library(monkeypatch):
    texts = [r[1] or "" for r in edge_rows()] + ODD + [prose(k, 300) for k in range(5)]
    wanted = [library_ids(t) for t in texts]
    encoder = word_ids.WordIds(VOCABULARY)
    assert [i.tolist() for i in encoder.encode(texts)] == wanted == [i.tolist() for i in encoder.encode(texts)]
    monkeypatch.setattr(word_ids, "CACHED", 50)
    monkeypatch.setattr(word_ids, "STRETCH", 100)
    small = word_ids.WordIds(VOCABULARY)
    assert [i.tolist() for i in small.encode(texts)] == wanted and len(small.known) <= 50
    assert [small.encode_long(t).tolist() for t in texts] == wanted
    assert small.encode([]) == []


def test_a_word_is_looked_up_once_per_batch():
    class Counted(word_ids.Known):
        asked = 0

        def __getitem__(self, token):
            self.asked += 1
            return super().__getitem__(token)

    encoder = word_ids.WordIds(VOCABULARY)
    encoder.known = Counted()
    texts = ["it is\nwhat it is", "is it"] * 500
    assert [i.tolist() for i in encoder.encode(texts)] == [library_ids(t) for t in texts[:2]] * 500
    assert encoder.known.asked == 3
    texts = pa.array(["x", *texts, "", "y"]).slice(1, len(texts) + 1)
    assert [i.tolist() for i in encoder.encode(texts)] == [library_ids(t) for t in texts.to_pylist()]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="no vocabulary"):
        word_ids.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def shard_of(documents, least):
    symbols = np.array([x for d in documents for x in d], np.uint32)
    ends = np.zeros(len(symbols), bool)
    ends[np.cumsum([len(d) for d in documents]) - 1] = True
    short, ends, rules = grammar.compress(symbols, ends, 100, least)
    return grammar.Shard(short, rules, grammar.expansion_lengths(rules, 100), 100), ends


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=8), st.integers(2, 4))
def test_pairs_counted_again_are_all_that_may_be_frequent(documents, least):
    """Each pass counts no more places than the one before has left, and finds what a count of all places finds."""
    symbols = np.array([x for d in documents for x in d], np.uint32)
    ends = np.zeros(len(symbols), bool)
    ends[np.cumsum([len(d) for d in documents]) - 1] = True
    counted, passes = grammar.frequent_pairs, []

    def recorded(symbols, at, least):
        found = counted(symbols, at, least)
        passes.append((symbols.copy(), len(at), [x.tolist() for x in found[:2]]))
        return found

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(grammar, "frequent_pairs", recorded)
        _, _, rules = grammar.compress(symbols, ends, 100, least)
    for now, places, found in passes:
        assert places < len(now)
        pairs = Counter()
        # where documents end among the symbols of a pass follows from how many symbols the documents have
        for d in runs_of(now, documents, rules):
            pairs.update((a << 32) + b for a, b in zip(d, d[1:], strict=False))
        assert dict(zip(*found, strict=True)) == {p: n for p, n in pairs.items() if n >= least}


def runs_of(symbols, documents, rules):
    """The symbols of each document."""
    lengths, at = grammar.expansion_lengths(rules, 100), 0
    for d in documents:
        left, run = len(d), []
        while left:
            run.append(int(symbols[at]))
            left -= 1 if symbols[at] < 100 else int(lengths[symbols[at] - 100])
            at += 1
        yield run


def test_rare_pairs_are_not_counted_again():
    rng = np.random.default_rng(1)
    symbols = np.concatenate([rng.permutation(100_000), np.tile([1, 2, 3, 4], 500)]).astype(np.uint32)
    counted, places = grammar.frequent_pairs, []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(grammar, "frequent_pairs", lambda s, at, least: places.append(len(at)) or counted(s, at, least))
        grammar.compress(symbols, np.arange(len(symbols)) == len(symbols) - 1, 100_000)
    assert places[0] == len(symbols) - 1 and max(places[1:]) < 10_000


def test_few_rare_pairs_are_taken_for_frequent_ones():
    symbols = np.random.default_rng(2).integers(0, 40_000, 2_000_000).astype(np.uint32)
    pairs, _, at, of = grammar.frequent_pairs(symbols, np.arange(len(symbols) - 1), grammar.LEAST)
    assert not len(pairs) and len(at) == len(of) < 10_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=40), min_size=1, max_size=8), st.integers(2, 4))
def test_grammars_expand_to_the_documents(documents, least):
    shard, ends = shard_of(documents, least)
    assert shard.expand(shard.symbols).tolist() == [x for d in documents for x in d]
    bounds = np.flatnonzero(ends) + 1
    assert len(bounds) == len(documents)
    for document, begin, end in zip(documents, [0, *bounds], bounds, strict=False):
        for start in range(0, len(document), 7):
            assert shard.part(begin, end, start, 5).tolist() == document[start : start + 5]
        assert shard.part(begin, end, len(document), 5).tolist() == []
    # nothing is left to replace, and every rule names earlier symbols
    pairs = [p for b, e in zip([0, *bounds], bounds, strict=False) for p in zip(shard.symbols[b:e], shard.symbols[b + 1 : e], strict=False)]
    apart = {p: n for p in set(pairs) if (n := pairs.count(p)) >= least and p[0] != p[1]}
    assert not apart
    assert all(a < 100 + k and b < 100 + k for k, (a, b) in enumerate(shard.rules.tolist()))


def test_repeats_become_short():
    shard, _ = shard_of([[1, 2, 3, 4, 5, 6, 7, 8] * 50] * 20, 4)
    assert len(shard.symbols) + 3 * len(shard.rules) < 400


def written_and_read(spark, docs, **options):
    path = scratch_path(spark, "ids")
    grammar.write_ids(docs, path, VOCABULARY, **options)
    return path, grammar.read_ids(spark, path).collect()


def test_slices_by_the_bytes_of_texts():
    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "text": ["aa", None, "é", "x" * 20, "", "abc", "ab"]})
    parts = list(rows.slices_by_size([batch, batch.slice(0, 0)], 1, 5))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5, 6]]
    assert [p.column(0).to_pylist() for p in rows.slices_by_size([batch.slice(2)], 1, 100)] == [[2, 3, 4, 5, 6]]


@pytest.mark.parametrize("shard_tokens", [50, 1 << 20])
def test_files_hold_every_document_in_order(spark, edge, shard_tokens):
    _, rows = written_and_read(spark, edge.repartition(3), shard_tokens=shard_tokens)
    wanted = sorted(((r[0], library_ids(r[1]) + [1]) for r in edge_rows()), key=lambda x: (x[0] is not None, x[0] or 0))
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [i for i, _ in wanted]
    assert [r.n_tokens for r in rows] == [len(ids) for _, ids in wanted]
    assert [r.start for r in rows] == np.cumsum([0] + [len(ids) for _, ids in wanted])[:-1].tolist()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == [ids for _, ids in wanted]


def test_ranges_of_documents(spark, edge):
    path, _ = written_and_read(spark, edge, shard_tokens=2_000)
    asked = [(5, 1_000, 700), (6, 0, 3), (1, 2, 100), (3, 0, 9), (99, 0, 1)]
    found = grammar.read_ranges(spark, path, spark.createDataFrame(asked, "doc_id long, begin long, length long")).collect()
    wanted = [(i, b, (library_ids(r[1]) + [1])[b : b + n]) for i, b, n in asked for r in edge_rows() if r[0] == i]
    assert sorted((r.doc_id, r.begin, np.frombuffer(r.ids, "<u4").tolist()) for r in found) == sorted(wanted)


def test_no_documents(spark, nothing):
    assert written_and_read(spark, nothing)[1] == []


def test_equal_rows_are_kept_apart(spark):
    text = prose(3, 50)
    docs = spark.createDataFrame([(7, text)] * 300 + [(8, "x")], "doc_id long, text string").repartition(5)
    _, rows = written_and_read(spark, docs, shard_tokens=1_000)
    ids = np.array(library_ids(text) + [1], "<u4")
    assert sorted(r.start for r in rows if r.doc_id == 7) == [k * len(ids) for k in range(300)]
    assert {zlib.crc32(r.ids) for r in rows if r.doc_id == 7} == {zlib.crc32(ids.tobytes())}
