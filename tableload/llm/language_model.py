"""Deleted interpolation: a bigram language model counted over the whole corpus, and the score of every text (operator 4).

The probability of a word after its context mixes the bigram's, the word's and the uniform maximum-likelihood estimates;
the three weights depend on a bucket of the context's frequency and are learned by expectation-maximisation on the counts
of documents deleted from the fit. Then the deleted part joins the counts.

Documents travel once at most: a task cuts its own into chunks, kept as a table bucketed by chunk. Each chunk sends its
distinct n-grams, hashed, sorted and divided by hash range, to the tasks that add the counts of their range up, and these
send every chunk the totals of its own n-grams, in the same order, without the keys. The chunks meet their totals where
they lie. For the weights, the deleted documents of a chunk go along as places among its n-grams, so no text is read
again for them. No table of counts is ever whole in one place, and a frequent n-gram is one row per chunk.

Defined cases: a null text is the empty text, whose only token is the end; a null id belongs to the training part, as its
remainder is null and so not 0; a context that no training text has leaves the bigram no weight; with no training tokens
at all the distribution is uniform over the one unknown word; an empty table gives an empty result. N-grams are told
apart by 56-bit hashes.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableload.llm.rows import SLICE, hashes, mix, ship, two_columns, words, written
from tableload.workspace import scratch_path

#: Text bytes of a chunk, and hash ranges per chunk: a task of the counting adds up about as much as half a chunk has.
CHUNK_BYTES, RANGES_PER_CHUNK = 6_000_000, 2
MODULUS, HELD_OUT = 10, 0
#: Documents of this remainder are deleted from the fit to learn the weights; all of them, a fiftieth of the corpus.
DELETED_MODULUS, DELETED = 50, 1
#: Buckets of the context's count (powers of four), and steps per octave of the estimates that EM sees.
CONTEXT_BUCKETS, STEPS = 10, 4
KEY_BITS = 56
END = hashes([b"\x20end"])[0]
BEGIN = hashes([b"\x20begin"])[0]

CHUNK = "chunk string, payload binary"


# --- Chunks and their n-grams ---------------------------------------------------------------------------------------


def chunks(source: DataFrame, chunk_bytes: int) -> DataFrame:
    """One row per chunk: some documents of one task (``doc_id, text, part``) as a compressed Arrow stream."""

    def run(batches):
        task = TaskContext.get().partitionId()
        held, size, n = [], 0, 0

        def packed():
            nonlocal held, size, n
            sink = io.BytesIO()
            options = pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as stream:
                for batch in held:
                    stream.write_batch(batch)
            row = pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{n}"]), pa.array([sink.getvalue()], pa.binary())], names=["chunk", "payload"]
            )
            held, size, n = [], 0, n + 1
            return row

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                held.append(batch.slice(start, SLICE))
                size += held[-1].get_total_buffer_size() * held[-1].num_rows // max(1, batch.num_rows)
                if size >= chunk_bytes:
                    yield packed()
        if held:
            yield packed()

    return source.mapInArrow(run, CHUNK)


def documents_of(payload: bytes):
    """``(doc_id, text, part)`` of each document of a chunk."""
    with pa.ipc.open_stream(payload) as stream:
        for batch in stream:
            yield from zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)


def keys_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a text's tokens, the end included, and of the bigrams that end in them; the lowest bit tells the two apart."""
    h = hashes(words(text or ""))
    tokens = np.append(h, END)
    contexts = np.insert(h, 0, BEGIN)
    with np.errstate(over="ignore"):
        pairs = mix(mix(contexts + np.uint64(1)) + tokens)
    low, shift = np.uint64(1), np.uint64(64 - KEY_BITS)
    return mix(tokens) >> shift & ~low, pairs >> shift | low


def chunk_keys(documents: list) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sorted distinct keys of a chunk, and for each document where its tokens and bigrams are among them."""
    per_doc = [keys_of(text) for _, text, _ in documents]
    flat = np.concatenate([k for pair in per_doc for k in pair]) if per_doc else np.empty(0, np.uint64)
    distinct, inverse = np.unique(flat, return_inverse=True)
    out, start = [], 0
    for tokens, pairs in per_doc:
        middle, end = start + len(tokens), start + len(tokens) + len(pairs)
        out.append((inverse[start:middle], inverse[middle:end]))
        start = end
    return distinct, out


def squeeze(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as differences, of as many bytes each as the largest needs."""
    steps = np.diff(sorted_keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + planes.tobytes()


def unsqueeze(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(planes), 8), np.uint8)
    steps[:, :width] = planes
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    """Counts in the smallest unsigned type that holds them all."""
    counts = counts.astype(np.uint64)
    kind = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def unsmall(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def pack_places(places: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Where the tokens and the bigrams of some documents are among the keys of their chunk."""
    lengths = [len(tokens) for tokens, _ in places]
    return np.concatenate([[len(lengths)], lengths, *(t for t, _ in places), *(p for _, p in places)]).astype("<i4").tobytes()


def unpack_places(raw: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    found = np.frombuffer(raw, "<i4")
    lengths, flat = found[1 : 1 + found[0]], found[1 + found[0] :]
    tokens, pairs = flat[: len(flat) // 2], flat[len(flat) // 2 :]
    cuts = np.cumsum(lengths)[:-1]
    return list(zip(np.split(tokens, cuts), np.split(pairs, cuts), strict=True))


def range_bounds(ranges: int) -> np.ndarray:
    """First key of each hash range but the first."""
    return np.array([(k << KEY_BITS) // ranges for k in range(1, ranges)], np.uint64)


# --- Counting -------------------------------------------------------------------------------------------------------


def sent_keys(table: DataFrame, ranges: int) -> DataFrame:
    """``range, chunk, keys, fit, deleted``: a chunk's distinct keys of one hash range and its counts in both parts.

    One more row, of a range beyond the others, has the places of the chunk's deleted documents for keys.
    """

    def run(batches):
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                documents = list(documents_of(payload))
                distinct, places = chunk_keys(documents)
                counted = {}
                for part in (1, 2):
                    at = [p for (_, _, own), pair in zip(documents, places, strict=True) if own == part for p in pair]
                    counted[part] = np.bincount(np.concatenate(at), minlength=len(distinct)) if at else np.zeros(len(distinct))
                cuts = np.concatenate([[0], np.searchsorted(distinct, range_bounds(ranges)), [len(distinct)]])
                rows = [
                    (k, squeeze(distinct[a:b]), small(counted[2][a:b]), small(counted[1][a:b]))
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                    if b > a
                ]
                deleted = [pair for (_, _, own), pair in zip(documents, places, strict=True) if own == 1]
                if deleted:
                    rows.append((ranges + zlib.crc32(chunk.encode()) % ranges, pack_places(deleted), b"", b""))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int32()),
                        pa.array([chunk] * len(rows), pa.string()),
                        *(pa.array(c, pa.binary()) for c in columns[1:]),
                    ],
                    names=["range", "chunk", "keys", "fit", "deleted"],
                )

    return table.select("chunk", "payload").mapInArrow(run, "range int, chunk string, keys binary, fit binary, deleted binary")


def totals(sent: DataFrame, ranges: int) -> DataFrame:
    """``chunk, range, fit, deleted``: what all chunks counted for the keys that this chunk sent, in its order.

    ``types, tokens`` and ``fit_tokens``, on one row per range: distinct training tokens, and occurrences of them.
    """

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["range"].iloc[0] >= ranges:  # places, which are passed on as they are
            out = rows[["chunk", "range", "keys", "deleted"]].rename(columns={"keys": "fit"})
            return out.assign(types=0, tokens=0, fit_tokens=0)
        keys = [unsqueeze(k) for k in rows["keys"]]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        fit = np.bincount(inverse, np.concatenate([unsmall(c) for c in rows["fit"]])).astype(np.int64)
        deleted = np.bincount(inverse, np.concatenate([unsmall(c) for c in rows["deleted"]])).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        token = distinct & np.uint64(1) == 0
        out = pd.DataFrame({"chunk": rows["chunk"], "range": rows["range"]})
        out["fit"] = [small(fit[inverse[e - len(k) : e]]) for e, k in zip(ends, keys, strict=True)]
        out["deleted"] = [small(deleted[inverse[e - len(k) : e]]) for e, k in zip(ends, keys, strict=True)]
        first = np.arange(len(rows)) == 0
        both = fit + deleted
        out["types"] = np.where(first, int((both[token] > 0).sum()), 0)
        out["tokens"] = np.where(first, int(both[token].sum()), 0)
        out["fit_tokens"] = np.where(first, int(fit[token].sum()), 0)
        return out

    return (
        sent.repartition(ranges, "range")
        .groupBy("range")
        .applyInPandas(add, "chunk string, range int, fit binary, deleted binary, types long, tokens long, fit_tokens long")
    )


def parts_of(summed: DataFrame, buckets: int) -> DataFrame:
    """``chunk, parts``: the totals of a chunk by range, and the places of its deleted documents.

    Dealt to as many partitions as the table of chunks has buckets, so the chunks stay where they lie.
    """
    parts = F.sort_array(F.collect_list(F.struct("range", "fit", "deleted"))).alias("parts")
    return summed.repartition(buckets, "chunk").groupBy("chunk").agg(parts)


def met(table: DataFrame, summed: DataFrame, buckets: int, ranges: int, use, schema: str) -> DataFrame:
    """``use(documents, places, counts)`` for every chunk and its totals, whose rows it returns as a batch."""
    joined = table.join(parts_of(summed, buckets), "chunk").select("payload", "parts")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                documents = list(documents_of(batch.column(0)[k].as_py()))
                _, places = chunk_keys(documents)
                parts = [p for p in batch.column(1)[k].as_py() if p["range"] < ranges]
                yield use(documents, places, np.concatenate([unsmall(p["fit"]) + unsmall(p["deleted"]) for p in parts]))

    return joined.mapInArrow(run, schema)


# --- Weights --------------------------------------------------------------------------------------------------------


def context_counts(tokens: np.ndarray, counts: np.ndarray, texts: int) -> np.ndarray:
    """How often the context of each token was counted: the token before, or the begin, which every text has once."""
    return np.concatenate([[texts], counts[tokens[:-1]]])


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket per power of four."""
    return np.where(count > 0, np.minimum(1 + np.log2(np.maximum(count, 1)) // 2, CONTEXT_BUCKETS), 0).astype(np.int64)


def held_out_counts(summed: DataFrame, buckets: int, ranges: int, fit_tokens: int) -> list:
    """How often deleted tokens had a bucket of context and estimates: ``bucket, bigram, unigram, n``.

    The estimates are rounded to steps of a quarter octave, so this is a table of bounded size over all deleted tokens.
    """
    names = ["bucket", "bigram", "unigram", "n"]

    def run(batches):
        for batch in batches:
            for parts in batch.column(0):
                parts = parts.as_py()
                fit = np.concatenate([unsmall(p["fit"]) for p in parts if p["range"] < ranges])
                found = [np.empty((3, 0), np.int64)]
                for part in parts:
                    for tokens, pairs in unpack_places(part["fit"]) if part["range"] >= ranges else []:
                        contexts = context_counts(tokens, fit, int(fit[tokens[-1]]))
                        bigram = np.where(contexts > 0, fit[pairs] / np.maximum(contexts, 1), 0)
                        unigram = fit[tokens] / max(1, fit_tokens)
                        found.append(np.stack([context_bucket(contexts), step(bigram), step(unigram)]))
                cells, n = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cells), pa.array(n, pa.int64())], names=names)

    rows = parts_of(summed, buckets).select("parts").mapInArrow(run, "bucket long, bigram long, unigram long, n long")
    return rows.groupBy(*names[:3]).agg(F.sum("n").alias("n")).collect()


def step(estimate: np.ndarray) -> np.ndarray:
    """-1 for 0, else the number of steps below 1."""
    return np.where(estimate > 0, np.rint(-STEPS * np.log2(np.maximum(estimate, 1e-300))), -1).astype(np.int64)


def learn_weights(rows: list, types: int, rounds: int = 60) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimate by bucket of the context's count."""
    weights = np.tile(np.array([0.3, 0.5, 0.2]), (CONTEXT_BUCKETS + 1, 1))
    value = lambda s: np.where(s < 0, 0.0, 2.0 ** (-np.maximum(s, 0) / STEPS))
    if rows:
        cells = np.array([[r.bucket, r.bigram, r.unigram, r.n] for r in rows], np.int64)
        bucket, n = cells[:, 0], cells[:, 3].astype(float)
        estimates = np.stack([value(cells[:, 1]), value(cells[:, 2]), np.full(len(cells), 1 / (types + 1))], axis=1)
        for _ in range(rounds):
            share = weights[bucket] * estimates
            share *= (n / share.sum(axis=1))[:, None]
            sums = np.zeros_like(weights)
            np.add.at(sums, bucket, share)
            sums += 0.01 * weights  # a bucket that no deleted token has keeps its start
            weights = sums / sums.sum(axis=1, keepdims=True)
    if not types:
        weights[:] = [0, 0, 1]
    # the bigram has no estimate after an unseen context
    rest = weights[0, 1:].sum()
    weights[0] = [0, weights[0, 1] / rest, weights[0, 2] / rest]
    return weights


# --- Scores ---------------------------------------------------------------------------------------------------------


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    Texts whose id has a crc32 (as text) divisible by ten are held out: nothing is learned from them. Those with a
    remainder of one modulo fifty are the deleted part. ``base_score`` is a smoothed unigram score, ``score`` the model's, both log10.
    """
    spark = docs.sparkSession
    ship(spark)
    source = two_columns(docs, id_col, text_col)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    part = F.when(crc % MODULUS == HELD_OUT, 0).when(crc % DELETED_MODULUS == DELETED, 1).otherwise(2)
    source = source.withColumn("part", part)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(1, -(-size // chunk_bytes))
    buckets, name = min(expected, 50_000), f"llm_chunks_{uuid.uuid4().hex}"
    chunked = chunks(source, chunk_bytes).write.bucketBy(buckets, "chunk")
    chunked.option("path", scratch_path(spark, "llm-chunks")).option("compression", "uncompressed").saveAsTable(name)
    try:
        return _scores_of(spark.table(name), source.schema["doc_id"].dataType.simpleString(), buckets, expected)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _scores_of(table: DataFrame, kind: str, buckets: int, expected: int) -> DataFrame:
    ranges = RANGES_PER_CHUNK * expected
    summed = written(totals(sent_keys(table, ranges), ranges), "totals")
    state = summed.agg(F.sum("types"), F.sum("tokens"), F.sum("fit_tokens")).first()
    types, tokens_all, fit_tokens = (int(x or 0) for x in state)
    weights = learn_weights(held_out_counts(summed, buckets, ranges, fit_tokens), types)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def use(documents, places, counts):
        rows = []
        for (doc_id, _, part), (tokens, pairs) in zip(documents, places, strict=True):
            c = counts[tokens]
            contexts = context_counts(tokens, counts, int(counts[tokens[-1]]))
            w = weights[context_bucket(contexts)]
            p = w[:, 0] * counts[pairs] / np.maximum(contexts, 1) + w[:, 1] * c / max(1, tokens_all) + w[:, 2] / (types + 1)
            base = np.log10((c + 0.1) / (tokens_all + 0.1 * (types + 1))).sum()
            rows.append((doc_id, part == 0, len(tokens), int((c > 0).sum()), tokens_all, float(base), float(np.log10(p).sum())))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kinds = [to_arrow_type(_parse_datatype_string(kind)), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
    fields = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return written(met(table, summed, buckets, ranges, use, f"doc_id {kind}, {fields}"), "scores")
