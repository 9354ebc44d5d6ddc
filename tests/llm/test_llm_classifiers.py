"""Quality and toxicity: held-out accuracy on made texts, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from edge_texts import prose

from tableload.llm import quality, toxicity

LANGUAGES = {"xx": ("grubfil", "zothmar"), "yy": ("ñandor", "plexify")}


def made(n):
    """doc_id, text, lang, quality, toxic: shouting and repeating texts are bad, texts with a rude word are toxic."""
    out = []
    for k in range(n):
        rng = random.Random(k)
        lang = "xx" if k % 3 else "yy"
        words = prose(k, rng.randint(20, 200)).split()
        words = [w + ("ane" if lang == "xx" else "oso") for w in words]
        toxic, good = k % 6 == 0, k % 5 != 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(LANGUAGES[lang]) + rng.choice(["", "a", "es"])
        if not good:
            words = [w.upper() + "!!" for w in words] if k % 2 else [w for w in words[:8] for _ in range(9)]
        out.append((k, " ".join(words), lang, int(good), int(toxic)))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = made(900)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").cache()
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows], "doc_id long, quality int, toxic int").cache()
    return docs, labels, rows


def test_quality_of_held_out_texts(corpus):
    docs, labels, rows = corpus
    found = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(found) == len(rows)
    right = [found[i].predicted == good for i, _, _, good, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(right) > 0.97
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_toxicity_of_held_out_texts(corpus):
    docs, labels, rows = corpus
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(found[i].predicted, toxic) for i, _, _, _, toxic in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert np.mean([p for p, t in held if t]) > 0.85
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_held_out_labels_teach_nothing(spark, corpus):
    docs, labels, _ = corpus
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    scores = lambda l: sorted((r.doc_id, r.score) for r in quality.quality(docs, l).collect())  # noqa: E731, E741
    assert scores(labels) == scores(flipped)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a.table == b.table).all() and (a.thresholds == b.thresholds).all()


def test_sample_is_bounded(corpus):
    docs, labels, _ = corpus
    from tableload.llm.samples import labelled

    assert labelled(docs, labels, "quality", 50, 3, 1, ["lang"]).count() == 50


def test_a_repeated_example_moves_towards_its_label():
    text = "some words to learn from"
    weights, intercept = quality.train([(*quality.features(text), 1)] * 30)
    assert quality.score(text, weights, intercept) > 0.9
    weights, intercept = quality.train([])
    assert quality.score(text, weights, intercept) == 0.5


def test_threshold_parts_the_labels():
    assert toxicity.best_threshold(np.array([1.0, 2, 3, 9, 10]), np.array([0, 0, 0, 1, 1])) == 6.0
    assert toxicity.best_threshold(np.array([1.0, 1.0, 1.0]), np.array([0, 1, 0])) > 1.0


def test_thresholds_use_all_labels_outside_training(corpus, monkeypatch):
    """With a small sample the rarer language still has a threshold from all of its labelled documents."""
    docs, labels, rows = corpus
    calls, plain = [], toxicity.best_threshold
    monkeypatch.setattr(toxicity, "best_threshold", lambda m, t, n: calls.append((int((t * n).sum()), int(n.sum()))) or plain(m, t, n))
    toxicity.fit(docs, labels, train_rows=150)
    free = [(lang, toxic) for i, _, lang, _, toxic in rows if zlib.crc32(str(i).encode()) % 5]
    assert len(free) - 150 <= calls[0][1] < len(free)
    assert len(calls) == 2 and calls[1][0] == calls[0][0] > 90  # all toxic texts are of one language
    counts = np.array([1, 4, 2, 5])
    some = np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1])
    assert plain(*some, counts) == plain(*(np.repeat(x, counts) for x in some)) == 1.5


def test_rare_languages_share_a_column(monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_LANGUAGES", 2)
    classifier = toxicity.Classifier()
    assert len(classifier.learn_languages(["a b", "a c", "d e", "f g"], ["x", "x", "y", "z"])) == 2
    assert classifier.language(toxicity.Texts(["a b", "d e", "f g"])).tolist() == [0, 1, 1]


def test_maximum_over_the_whole_text():
    """A word counts the same wherever it stands in a long text."""
    classifier = toxicity.Classifier()
    words = ["word"] * 5000
    first, last = ["odd", *words], [*words, "odd"]
    outputs = classifier.outputs(toxicity.Texts([" ".join(first), " ".join(last)]))
    kernels_of_one = classifier.responses(toxicity.Texts([" ".join(first), " ".join(last)]))[0]
    pooled = np.maximum.reduceat(kernels_of_one, [0, 5003], axis=0)
    assert np.allclose(pooled[0], pooled[1]) and np.isfinite(outputs).all()


def test_batches_do_not_change_scores(corpus):
    docs, labels, rows = corpus
    classifier = toxicity.fit(docs, labels)
    texts = [r[1] for r in rows[:40]] + ["", "x"]
    assert np.allclose(classifier.scores(texts), [classifier.scores([t])[0] for t in texts], atol=1e-5)


def test_edge_cases(edge, nothing, edge_labels):
    for operator in (quality.quality, toxicity.toxicity):
        rows = operator(edge, edge_labels).collect()
        assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
        assert operator(nothing, edge_labels).count() == 0
        assert operator(edge, edge_labels.limit(0)).count() == edge.count()
    for keep in (quality.keep_good, toxicity.keep_civil):
        kept = keep(edge, edge_labels)
        assert kept.columns == edge.columns and kept.count() <= edge.count()
    assert toxicity.keep_civil(edge, edge_labels.limit(0)).count() == edge.count()
