"""The language model against counts made in plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from edge_texts import prose

from tableload.llm import language_model as lm


def part(i):
    crc = 2 if i is None else zlib.crc32(str(i).encode())
    return 0 if crc % 10 == 0 else 1 if crc % 50 == 1 else 2


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def plain_scores(rows, weights_of):
    """doc -> the contract's columns, from plain dictionaries; weights_of(context count) gives the three weights."""
    train = [tokens(t) for i, t in rows if part(i) != 0]
    one = Counter(w for ws in train for w in ws)
    two = Counter(p for ws in train for p in zip(["begin", *ws], ws))
    n, types = sum(one.values()), len(one)
    out = []
    for i, text in rows:
        ws = tokens(text)
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (types + 1))) for w in ws)
        score = 0.0
        for before, w in zip(["begin", *ws], ws):
            context = len(train) if before == "begin" else one[before]
            a, b, c = weights_of(context)
            score += math.log10(a * (two[before, w] / context if context else 0) + b * one[w] / max(1, n) + c / (types + 1))
        out.append((i, part(i) == 0, len(ws), sum(one[w] > 0 for w in ws), n, base, score))
    return out


@pytest.mark.parametrize("chunk_bytes", [10**9, 4000])
def test_scores_follow_from_plain_counts(spark, chunk_bytes, monkeypatch):
    rows = [(k, prose(k % 40, 3 + k % 90)) for k in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    learned = []
    learn = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: learned.append(learn(*a)) or learned[-1])
    found = {r.doc_id: tuple(r) for r in lm.scores(frame, chunk_bytes=chunk_bytes).collect()}
    weights = learned[0]
    for row in plain_scores(rows, lambda c: weights[int(lm.context_bucket(np.array([c]))[0])]):
        assert found[row[0]][:5] == row[:5]
        assert found[row[0]][5:] == pytest.approx(row[5:], rel=1e-9)


def test_weights_raise_the_held_out_likelihood():
    rng = np.random.default_rng(1)

    class Cell:
        def __init__(self, bucket, bigram, unigram, n):
            self.bucket, self.bigram, self.unigram, self.n = bucket, bigram, unigram, n

    cells = [Cell(int(rng.integers(1, 4)), int(rng.integers(-1, 30)), int(rng.integers(20, 60)), int(rng.integers(1, 50))) for _ in range(300)]

    def likelihood(w):
        v = lambda s: 0.0 if s < 0 else 2.0 ** (-s / lm.STEPS)
        return sum(c.n * math.log(w[c.bucket] @ [v(c.bigram), v(c.unigram), 1 / 1001]) for c in cells)

    few, many = lm.learn_weights(cells, 1000, 1), lm.learn_weights(cells, 1000, 60)
    assert np.allclose(many.sum(axis=1), 1) and (many[1:] > 0).all()
    assert likelihood(many) > likelihood(few) > likelihood(np.tile([0.3, 0.5, 0.2], (lm.CONTEXT_BUCKETS + 1, 1)))


def test_keys_survive_squeezing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 1000):
        keys = np.unique(rng.integers(0, 2**56, n, dtype=np.uint64))
        assert (lm.unsqueeze(lm.squeeze(keys)) == keys).all()
        counts = rng.integers(0, 10 ** (n % 7 + 1), n)
        assert (lm.unsmall(lm.small(counts)) == counts).all()


def test_places_survive_packing():
    rng = np.random.default_rng(3)
    places = [(rng.integers(0, 99, n), rng.integers(0, 99, n)) for n in (3, 1, 7)]
    for (a, b), (c, d) in zip(places, lm.unpack_places(lm.pack_places(places)), strict=True):
        assert (a == c).all() and (b == d).all()


def test_edge_cases(edge, nothing):
    rows = [tuple(r) for r in lm.scores(edge).collect()]
    assert len(rows) == edge.count()
    plain = plain_scores([(r.doc_id, r.text) for r in edge.collect()], lambda c: (0, 0.9, 0.1))
    key = lambda r: (r[0] or -1, r[2])
    for found, wanted in zip(sorted(rows, key=key), sorted(plain, key=key), strict=True):
        assert found[:5] == wanted[:5] and found[5] == pytest.approx(wanted[5]) and found[6] < 0
    assert lm.scores(nothing).count() == 0


def test_a_table_with_held_out_texts_only(spark):
    held = [k for k in range(100) if part(k) == 0][:2]
    rows = lm.scores(spark.createDataFrame([(k, "a b") for k in held], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows] == [(3, 0, 0, 0.0)] * 2
