"""Toxicity by a convolutional text classifier trained in numpy (operator 9).

A word is embedded as the sum of hashed vectors: two for the word itself, under two hash functions, so that two words
rarely share both, and one each for its first four and five letters, so that inflected words share what they begin with.
Filters one, two and three words wide run over the text; the maximum of each over the whole text feeds a logistic output.
Training is by Adagrad on small batches of labelled documents; the gradient of a maximum reaches only the words under it,
so one dimension of the embedding starts at how much more often a word's documents are positive than chance has it.

The output is calibrated by language: on all labelled documents that are neither held out nor trained on, whose outputs
are counted in fine steps, each language gets the threshold that parts its labels best, and the score is the logistic of the output above that threshold, so 0.5 is every language's threshold.
The language is read from the text by a naive Bayes table over hashed words; the column is only what that table was
fitted to and is no input.

The classifier is fitted on a bounded sample of labelled documents; every text is scored whole, where it lies, with nothing shuffled.
Defined cases: a null or empty text has no word and gets the score of padding; without labelled documents, or with
labels of one kind only, every score is that kind's (0 without any); a label other than 0 or 1 is not learned from, nor
are ids twice; a null language counts as the language with the empty name.
"""

from __future__ import annotations

import pickle
import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableload.llm.rows import keep_texts, map_texts, ship, written
from tableload.llm.samples import fitted, labelled

BITS, WIDTH, FILTERS, SPANS = 18, 12, 8, (1, 2, 3)
#: Labelled documents that are fitted on at most, passes of the training over them, and its batches.
TRAIN_ROWS, PASSES, BATCH = 8_000, 3, 16
MODULUS, HELD_OUT = 5, 0
#: One in so many documents of the sample is not trained on, for the thresholds.
ASIDE = 4
RATE, POSITIVE_WEIGHT, SHRINK = 0.1, 3.0, 1e-4
#: Languages told apart at most; beyond, the rarest of the sample are one together.
LANGUAGE_BITS, MOST_LANGUAGES = 14, 64
#: Outputs are counted in so many steps per unit, between -LARGEST and LARGEST.
STEPS, LARGEST = 64, 35
#: Labelled ids that are sent to the documents, at most: some 50 MB.
SENT_IDS = 1_000_000
#: Positive and negative documents a language needs among those not trained on for a threshold of its own.
LEAST_CASES = 5

_TO_SPACE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
PAD = b""


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


def buckets(word: bytes) -> tuple[int, int, int, int]:
    """Where a word's four vectors are; the last one is the plain hash of the word, which also finds its language."""
    letters = word.decode("utf-8", "surrogatepass")
    mask = (1 << BITS) - 1
    a = xxhash.xxh3_64_intdigest(word)
    b = xxhash.xxh3_64_intdigest(b"4" + letters[:4].encode("utf-8", "surrogatepass"))
    c = xxhash.xxh3_64_intdigest(b"5" + letters[:5].encode("utf-8", "surrogatepass"))
    return a & mask, (a >> 32) & mask, b & mask, c & mask


class Texts:
    """Some texts as numbers of distinct words, one after the other, each followed by padding."""

    def __init__(self, texts: list[str]):
        number: dict[bytes, int] = defaultdict(lambda: len(number))
        number[PAD]
        gap = [0] * (max(SPANS) - 1)
        flat, self.starts, self.ends = [], [], []
        for text in texts:
            self.starts.append(len(flat))
            flat += [number[w] for w in tokens(text)] or [0]
            self.ends.append(len(flat))  # a filter that starts at the last word reaches into the padding only
            flat += gap
        self.ids = np.array([*flat, *gap], np.int32)
        self.length = len(flat)
        self.places = np.array([buckets(w) for w in number], np.int64)


class Classifier:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((1 << BITS, WIDTH)) * 0.05).astype(np.float32)
        self.kernels = [(rng.standard_normal((n, WIDTH, FILTERS)) * 0.3).astype(np.float32) for n in SPANS]
        self.offsets = [np.zeros(FILTERS, np.float32) for _ in SPANS]
        self.out = (rng.standard_normal(FILTERS * len(SPANS)) * 0.3).astype(np.float32)
        self.bias = np.float32(0)
        self.languages = np.zeros((1 << LANGUAGE_BITS, 1), np.float32)
        self.thresholds = np.zeros(1, np.float32)
        self.constant: float | None = None

    def responses(self, texts: Texts) -> list[np.ndarray]:
        """Per span, every filter at every position."""
        words = self.table[texts.places].sum(axis=1)
        words[0] = 0
        out = []
        for kernel, offset, n in zip(self.kernels, self.offsets, SPANS, strict=True):
            total = np.broadcast_to(offset, (texts.length, FILTERS)).copy()
            for k in range(n):
                total += (words @ kernel[k])[texts.ids[k : k + texts.length]]
            out.append(total)
        return out

    def outputs(self, texts: Texts) -> np.ndarray:
        bounds = [place for pair in zip(texts.starts, texts.ends, strict=True) for place in pair]
        pooled = [np.maximum.reduceat(r, bounds, axis=0)[::2] for r in self.responses(texts)]
        return np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.bias

    def language(self, texts: Texts) -> np.ndarray:
        """The likeliest language of each text."""
        likely = self.languages[texts.places[:, 0] & ((1 << LANGUAGE_BITS) - 1)]
        likely[0] = 0
        return np.add.reduceat(likely[texts.ids[: texts.length]], texts.starts, axis=0).argmax(axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.empty(0)
        numbered = Texts(texts)
        margin = self.outputs(numbered) - self.thresholds[self.language(numbered)]
        return 1 / (1 + np.exp(-np.clip(margin.astype(float), -35, 35)))

    def start_from(self, texts: list[str], labels: np.ndarray) -> None:
        """Set the first dimension to each bucket's excess of positive documents, in standard errors, and let half of
        the filters of every span begin with it."""
        seen = np.zeros((2, 1 << BITS))
        for text, label in zip(texts, labels, strict=True):
            seen[label, np.unique(Texts([text]).places[1:])] += 1
        expected = seen.sum(axis=0) * labels.mean()
        excess = (seen[1] - expected) / np.sqrt(expected + 1)
        self.table[:, 0] = np.clip(excess, -4, 4) / 4
        for kernel in self.kernels:
            kernel[:, 0, : FILTERS // 2] += 1

    def train(self, texts: list[str], labels: np.ndarray, passes: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        squares = [np.full_like(p, 1e-2) for p in (self.table, *self.kernels, *self.offsets, self.out)]
        bias_square = 1e-2
        order: list[int] = []
        for _ in range(-(-passes * len(texts) // BATCH)):
            if len(order) < BATCH:
                order = [*order, *rng.permutation(len(texts))]
            some, order = order[:BATCH], order[BATCH:]
            batch = Texts([texts[k] for k in some])
            label = labels[some].astype(np.float32)
            responses = self.responses(batch)
            spans = list(zip(batch.starts, batch.ends, strict=True))
            where = [np.stack([a + r[a:b].argmax(axis=0) for a, b in spans]) for r in responses]
            raw = [np.take_along_axis(r, w, axis=0) for r, w in zip(responses, where, strict=True)]
            pooled = np.concatenate([np.maximum(x, 0) for x in raw], axis=1)
            margin = pooled @ self.out + self.bias
            error = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - label) * np.where(label > 0, POSITIVE_WEIGHT, 1) / len(some)
            back = error[:, None] * self.out * (pooled > 0)
            gradients = [pooled.T @ error + SHRINK * self.out]
            words = self.table[batch.places].sum(axis=1)
            words[0] = 0
            rows, steps, kernels, offsets = [], [], [], []
            for s, n in enumerate(SPANS):
                own = back[:, s * FILTERS : (s + 1) * FILTERS]
                grad = np.zeros_like(self.kernels[s])
                for k in range(n):
                    under = batch.ids[where[s] + k]
                    grad[k] = np.einsum("bf,bfd->df", own, words[under])
                    rows.append(under.ravel())
                    steps.append((own[:, :, None] * self.kernels[s][k].T[None]).reshape(-1, WIDTH))
                kernels.append(grad + SHRINK * self.kernels[s])
                offsets.append(own.sum(axis=0))
            for p, square, grad in zip([*self.kernels, *self.offsets, self.out], squares[1:], [*kernels, *offsets, *gradients], strict=True):
                square += grad**2
                p -= RATE * grad / np.sqrt(square)
            bias_square += float(error.sum()) ** 2
            self.bias -= np.float32(RATE * error.sum() / np.sqrt(bias_square))
            self._train_table(batch, np.concatenate(rows), np.concatenate(steps), squares[0])

    def _train_table(self, batch: Texts, rows: np.ndarray, steps: np.ndarray, square: np.ndarray) -> None:
        some = np.flatnonzero(rows)  # padding is no word
        place, inverse = np.unique(batch.places[rows[some]].ravel(), return_inverse=True)
        grad = np.zeros((len(place), WIDTH), np.float32)
        np.add.at(grad, inverse, np.repeat(steps[some], batch.places.shape[1], axis=0))
        square[place] += grad**2
        self.table[place] -= RATE * grad / np.sqrt(square[place])

    def learn_languages(self, texts: list[str], languages: list[str]) -> list[str]:
        """Fit the table of words by language; the languages in the order of its columns."""
        names = sorted(set(languages), key=lambda n: (-languages.count(n), n))
        column = {name: min(k, MOST_LANGUAGES - 1) for k, name in enumerate(names)}
        names = names[:MOST_LANGUAGES]
        counts = np.ones((1 << LANGUAGE_BITS, len(names)))
        for text, language in zip(texts, languages, strict=True):
            at = [xxhash.xxh3_64_intdigest(w) & ((1 << LANGUAGE_BITS) - 1) for w in tokens(text)]
            np.add.at(counts[:, column[language]], at, 1)
        self.languages = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        return names

    def placed(self, texts: list[str]) -> list[tuple[int, int]]:
        """Language and step of the output of each text."""
        numbered = Texts(texts)
        step = np.floor(np.clip(self.outputs(numbered).astype(float), -LARGEST, LARGEST) * STEPS)
        return list(zip(self.language(numbered).tolist(), step.astype(int).tolist(), strict=True))

    def calibrate(self, own: np.ndarray, margins: np.ndarray, labels: np.ndarray, counts: np.ndarray, languages: int) -> None:
        """Set the thresholds from the documents counted by language, output and label."""
        common = best_threshold(margins, labels, counts)
        self.thresholds = np.full(languages, common, np.float32)
        for k in range(languages):
            some = own == k
            if min((counts * labels)[some].sum(), (counts * (1 - labels))[some].sum()) >= LEAST_CASES:
                self.thresholds[k] = best_threshold(margins[some], labels[some], counts[some])


def best_threshold(margins: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The middle of the widest gap among the thresholds with the fewest errors."""
    order = np.argsort(margins, kind="stable")
    margins, labels = margins[order].astype(float), labels[order]
    counts = np.ones(len(labels), np.int64) if counts is None else counts[order]
    wrong, right = counts * labels, counts * (1 - labels)
    # errors when all from place k on are called positive
    errors = np.concatenate([[0], np.cumsum(wrong)]) + right.sum() - np.concatenate([[0], np.cumsum(right)])
    edges = np.concatenate([[margins[0] - 1], margins, [margins[-1] + 1]])
    gaps = edges[1:] - edges[:-1]
    k = max(np.flatnonzero((errors == errors[gaps > 0].min()) & (gaps > 0)), key=lambda k: gaps[k])
    return float((edges[k] + edges[k + 1]) / 2)


def not_trained_on(docs: DataFrame, labels: DataFrame, label: str, found: Classifier, trained: DataFrame) -> np.ndarray:
    """``language, step, label, n``: the labelled documents neither held out nor trained on, as rows of counts.

    The labelled ids are sent to the documents where there are no more than ``SENT_IDS``, so that only their texts are
    scored; else all are scored where they lie, and ids and steps meet the labels. The rows are bounded by the steps.
    """
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % MODULUS  # null for a null id
    wanted = labels.where(F.col(label).isin(0, 1) & (left != HELD_OUT)).groupBy("doc_id")
    wanted = wanted.agg(F.min(F.col(label).cast("int")).alias("label"))
    wanted = written(wanted.join(F.broadcast(trained), "doc_id", "left_anti"), "labels-to-place")
    texts = docs.where(left != HELD_OUT)
    if wanted.count() <= SENT_IDS:
        texts = texts.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi")
    return counted(texts, wanted, found)


def counted(texts: DataFrame, wanted: DataFrame, found: Classifier) -> np.ndarray:
    """``language, step, label, n`` of the texts whose ids have a label in ``wanted``."""
    model = texts.sparkSession.sparkContext.broadcast(found)
    placed = map_texts(texts, lambda: model.value.placed, "language int, step int")
    placed = placed.groupBy("doc_id").agg(F.min(F.struct("step", "language")).alias("at")).select("doc_id", "at.*")
    rows = placed.join(wanted, "doc_id").groupBy("language", "step", "label").agg(F.count("*").alias("n")).collect()
    model.destroy()
    return np.array(sorted(map(tuple, rows)), np.int64).reshape(-1, 4)


def learned(rows: pa.Table, passes: int) -> tuple[bytes, pa.Array]:
    """A classifier without thresholds, and the ids of the documents it was trained on."""
    found, ids = Classifier(), rows.column("doc_id").combine_chunks()
    wanted = rows.column("label").to_numpy().astype(np.int64)
    if wanted.min() == wanted.max():
        found.constant = float(wanted[0])
        return pickle.dumps((found, 1)), ids
    texts = [t or "" for t in rows.column("text").to_pylist()]
    names = found.learn_languages(texts, [n or "" for n in rows.column("lang").to_pylist()])
    aside = np.array([xxhash.xxh3_64_intdigest(str(i).encode()) % ASIDE == 0 for i in ids.to_pylist()])
    if min(wanted[~aside].sum(), (1 - wanted[~aside]).sum(), wanted[aside].sum(), (1 - wanted[aside]).sum()) < LEAST_CASES:
        aside[:] = False
    seen = [t for t, a in zip(texts, aside, strict=True) if not a]
    found.start_from(seen, wanted[~aside])
    found.train(seen, wanted[~aside], passes)
    return pickle.dumps((found, len(names))), ids.filter(pa.array(~aside))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS, passes: int = PASSES) -> Classifier:
    """A classifier from at most ``train_rows`` labelled documents, with thresholds from all others; none is held out."""
    ship(docs.sparkSession)
    sample = written(labelled(docs, labels, label, train_rows, MODULUS, HELD_OUT, ["lang"]), "labelled-texts")
    model, trained = fitted(sample, lambda rows: learned(rows, passes))
    if not model:
        found = Classifier()
        found.constant = 0.0
        return found
    found, languages = pickle.loads(model)
    if found.constant is not None:
        return found
    placed = not_trained_on(docs, labels, label, found, trained)
    positive = placed[placed[:, 2] == 1, 3].sum()
    if min(positive, placed[:, 3].sum() - positive) < LEAST_CASES:  # too few others: those trained on
        used = sample.join(F.broadcast(trained), "doc_id", "left_semi")
        placed = counted(used, used.select("doc_id", "label"), found)
    own, step, kind, n = placed.T
    found.calibrate(own, (step + 0.5) / STEPS, kind, n, languages)
    return found


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; held out are ids of remainder 0 modulo 5."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows=train_rows))

    def make():
        classifier = model.value
        return lambda texts: [(float(s), int(s >= 0.5)) for s in classifier.scores(texts)]

    scored = map_texts(docs, make, "score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % MODULUS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_civil(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they are."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows=train_rows))

    def make():
        classifier = model.value
        return lambda texts: (classifier.scores(texts) < 0.5).tolist()

    return keep_texts(docs, make)
