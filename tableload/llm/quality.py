"""Quality by a hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates (operator 8).

Features of a text are hashed n-grams over two readings of its words: the words themselves, lower-cased, and their forms
(capitals, digits, the marks around them, length, whether the word before was the same). Each weighs its share of the
text's n-grams, to the power of one half, so that long and short texts compare. Training takes one example at a time with
per-coordinate rates and an L1 penalty, which keeps the weights sparse; scoring is a sparse dot product.

The fit uses a bounded sample of labelled documents; every text is scored whole, where it lies, with nothing shuffled.

Defined cases: a null or empty text, or one without words, has no features and is scored by the intercept; without any
labelled documents the score is 0.5; a label other than 0 or 1 is not learned from, nor are ids twice; labels, language,
source and id are no inputs of a score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableload.llm.rows import hashes, keep_texts, map_texts, mix, ngrams, ship, slices, words
from tableload.llm.samples import fitted, labelled

BITS = 20
#: Labelled documents that the weights are fitted on at most, and passes over them.
TRAIN_ROWS, PASSES = 8_000, 4
MODULUS, HELD_OUT = 3, 1
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.3, 0.5
#: Word forms that are cached per Python worker.
CACHED = 200_000

_MARKS = re.compile(rb"^([!-/:-@\[-`{-~]*)(.*?)([!-/:-@\[-`{-~]*)$", re.S)
_forms: dict[bytes, int] = {}


def form(word: bytes) -> int:
    """A hash of how a word is written: marks before and after it, capitals, digits and length."""
    before, body, after = _MARKS.match(word).groups()
    letters = body.decode("utf-8", "replace")
    case = "u" if letters.isupper() and len(letters) > 1 else "t" if letters[:1].isupper() else "l" if letters.islower() else "m"
    kind = "" if not letters else "n" if letters.isdigit() else "d" if any(c.isdigit() for c in letters) else case
    size = min(4, len(letters).bit_length())
    return xxhash.xxh3_64_intdigest(b"%s\x20%s%d\x20%s" % (before[:8], kind.encode(), size, after[:8]))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of a text's n-grams, and their values."""
    raw = text.encode("utf-8", "surrogatepass").split()
    if not raw:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    if len(_forms) > CACHED:
        _forms.clear()
    shapes = np.empty(len(raw), np.uint64)
    for k, word in enumerate(raw):
        found = _forms.get(word)
        if found is None:
            found = form(word)
            if len(word) <= 64:
                _forms[word] = found
        shapes[k] = found
    plain = hashes(words(text))
    same = np.concatenate([[False], plain[1:] == plain[:-1]])
    shapes = mix(shapes + same.astype(np.uint64))
    found = [plain, ngrams(plain, 2), mix(shapes ^ np.uint64(7)), ngrams(shapes, 2), ngrams(shapes, 3)]
    index, value = [], []
    for k, grams in enumerate(found):
        bucket, count = np.unique((mix(grams + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        index.append(bucket)
        value.append(np.sqrt(count / len(raw)))
    bucket, at = np.unique(np.concatenate(index), return_inverse=True)
    return bucket, np.bincount(at, np.concatenate(value)).astype(np.float32)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and intercept by follow-the-regularised-leader, proximal, with logistic loss."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0

    def leader(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    intercept = 0.0
    for turn in range(passes):
        for k in np.random.default_rng(turn).permutation(len(examples)):
            index, value, label = examples[k]
            weight = leader(z[index], n[index])
            margin = float(weight @ value) + intercept
            slope = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - label
            step = slope * value
            grown = n[index] + step**2
            z[index] += step - (np.sqrt(grown) - np.sqrt(n[index])) / ALPHA * weight
            n[index] = grown
            z0 += slope - (np.sqrt(n0 + slope**2) - np.sqrt(n0)) / ALPHA * intercept
            n0 += slope**2
            intercept = -z0 / ((BETA + np.sqrt(n0)) / ALPHA)
    return leader(z, n).astype(np.float32), float(intercept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, passes: int = PASSES):
    """Weights and intercept from at most ``train_rows`` labelled documents, none of them held out."""
    ship(docs.sparkSession)
    sample = labelled(docs, labels, label, train_rows, MODULUS, HELD_OUT, []).select("doc_id", "label", "text")

    def run(batches):
        for part in slices(batches):
            found = [features(t or "") for t in part.column(2).to_pylist()]
            index = pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary())
            value = pa.array([v.tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), index, value], names=["doc_id", "label", "i", "v"])

    kind = sample.schema["doc_id"].dataType.simpleString()

    def learn(rows: pa.Table) -> tuple[bytes, pa.Array]:
        examples = [
            (np.frombuffer(i.as_buffer(), "<i4"), np.frombuffer(v.as_buffer(), np.float32), label)
            for i, v, label in zip(rows.column("i"), rows.column("v"), rows.column("label").to_pylist(), strict=True)
        ]
        weights, intercept = train(examples, passes)
        return weights.tobytes() + np.float64(intercept).tobytes(), rows.column("doc_id").combine_chunks()

    model, _ = fitted(sample.mapInArrow(run, f"doc_id {kind}, label int, i binary, v binary"), learn)
    if not model:
        return train([], passes)
    return np.frombuffer(model, np.float32, 1 << BITS), float(np.frombuffer(model[-8:], np.float64)[0])


def score(text: str, weights: np.ndarray, intercept: float) -> float:
    index, value = features(text)
    margin = float(weights[index] @ value) + intercept
    return float(1 / (1 + np.exp(-np.clip(margin, -35, 35))))


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; held out are ids of remainder 1 modulo 3."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows=train_rows))

    def make():
        weights, intercept = model.value

        def work(texts):
            found = [score(t, weights, intercept) for t in texts]
            return [(s, int(s >= 0.5)) for s in found]

        return work

    scored = map_texts(docs, make, "score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % MODULUS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose score is ``least`` or more, all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows=train_rows))

    def make():
        weights, intercept = model.value
        return lambda texts: [score(t, weights, intercept) >= least for t in texts]

    return keep_texts(docs, make)
