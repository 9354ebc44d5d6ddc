"""Mixture-controlled packing of documents into windows (operator 6).

Deficit round-robin over one queue of documents per source: every round gives each source its target share of a window,
a source is served while its deficit pays for a turn, and what it gets is taken off. Deficits carry over from window to
window. Documents are dealt to shards by hash and each shard packs its own; all tokens of a shard are packed, so the
deficits it ends with follow from its token counts alone, and each shard starts from the exact sum of those before it.

Token ids are computed once, by a library that gives those of the tokenizers library (the tests hold it to that) in a
fraction of the time, and kept, compressed, in the scratch folder; one shuffle brings them to their shards.

Defined cases: a null text is the empty text, whose only token is the end id; a null source counts as the source with the
empty name; repeated rows and ids are packed as separate documents; an empty table gives no pieces. Documents longer than
a window are cut, and every token lies in exactly one piece.
"""

from __future__ import annotations

import math
import zlib
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableload.llm.bpe import PRE_TOKEN, ByteBpe
from tableload.llm.rows import ship, slices, written

WINDOW = 1024
#: Tokens of one turn: a source is served when its deficit pays for as many, or for the rest of its document.
TURN = 256
#: Expected tokens of a shard, which one task packs.
SHARD_TOKENS = 2_000_000
#: Shards that one task runs through for the deficits before them.
SHARD_BLOCK = 4_096
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(vocabulary: str) -> tiktoken.Encoding:
    """An encoder of the vocabulary file, one per Python worker: in byte-level BPE an id is also the rank of its merge."""
    if vocabulary not in _encoders:
        known = ByteBpe(vocabulary)
        ranks = {b: i for i, b in enumerate(known.bytes_of) if b and b.decode("utf-8", "replace") not in known.special}
        _encoders[vocabulary] = tiktoken.Encoding(
            vocabulary, pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=known.special
        )
    return _encoders[vocabulary]


def ids_of(vocabulary: str, text: str) -> np.ndarray:
    """Ids of a whole text, special strings in it included, as unsigned 32-bit integers."""
    return encoder(vocabulary).encode_to_numpy(text, allowed_special="all", disallowed_special=())


def tokenized(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, source_col: str, end_id: int) -> DataFrame:
    """``doc_id, source, n, ids`` with the end id appended; ids are compressed little-endian unsigned 32-bit integers."""
    ship(docs.sparkSession)
    source = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        codec = pa.Codec("zstd", 1)
        for part in slices(batches):
            ids = [ids_of(vocabulary, t or "").astype("<u4").tobytes() + end for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([codec.compress(i, asbytes=True) for i in ids], pa.binary()),
                ],
                names=["doc_id", "source", "n", "ids"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, source string, n long, ids binary")


def pack(
    docs: DataFrame,
    vocabulary: str,
    targets: dict[str, float] | None = None,
    window: int = WINDOW,
    turn: int = TURN,
    end_id: int = 0,
    shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source``.

    ``targets`` are token weights by source; by default each source's share of all tokens. Sources that are not named
    weigh as much as the least named one. When a shard runs out of a source, the others share its part. Only the last
    sequence of a shard needs padding.
    """
    spark = docs.sparkSession
    encoded = written(tokenized(docs, vocabulary, id_col, text_col, source_col, end_id), "token-ids")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    dealt = encoded.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", F.crc32("ids")), F.lit(shards)))
    carry = carried(dealt, targets)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(_key, rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(rows, starts, window, turn)

    ship(spark)
    # as many partitions as shards, so that no task gathers many of them
    parts = max(1, min(shards, 100_000))
    return (
        dealt.repartition(parts, "shard")
        .groupBy("shard")
        .cogroup(carry.repartition(parts, "shard").groupBy("shard"))
        .applyInPandas(run, f"doc_id {kind}, {PIECES}, source string")
    )


def carried(dealt: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """``shard, source, weight, deficit``: what each source is owed by all shards before, in tokens; one row per source
    of a shard. ``weight`` is the source's share among all sources."""
    counts = dealt.groupBy("shard", "source").agg(F.sum("n").alias("n"))
    counts = written(counts, "shard-tokens")
    by_source = counts.groupBy("source").agg(F.sum("n").alias("source_n"))
    if targets is None:
        by_source = by_source.withColumn("weight", F.col("source_n").cast("double"))
    else:
        pairs = [F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))]
        known = F.create_map(*pairs)[F.col("source")]
        by_source = by_source.withColumn("weight", F.coalesce(known, F.lit(float(min(targets.values())))))
    whole = by_source.agg(F.sum("weight")).first()[0] or 1.0
    shares = by_source.select("source", (F.col("weight") / F.lit(whole)).alias("weight"))
    before = earlier(counts.groupBy("shard").agg(F.sum("n").alias("n")), [], "before")
    own = earlier(counts, ["source"], "own")
    deficit = (F.col("weight") * F.col("before") - F.col("own")).alias("deficit")
    return own.join(before, "shard").join(shares, "source").select("shard", "source", "weight", deficit)


def earlier(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``shard``, the keys, and under ``name`` the sum of ``n`` over all earlier shards of the same keys.

    Sums within blocks of shards, and over the blocks before: no task sees more than a block, or a row per block.
    """
    blocked = counts.withColumn("block", F.floor(F.col("shard") / SHARD_BLOCK))
    until = (Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "block").orderBy("shard").rowsBetween(*until)
    blocks = blocked.groupBy(*keys, "block").agg(F.sum("n").alias("block_n"))
    over = Window.partitionBy(*keys).orderBy("block").rowsBetween(*until)
    blocks = blocks.withColumn("blocks_before", F.sum("block_n").over(over)).drop("block_n")
    total = F.coalesce(F.sum("n").over(within), F.lit(0)) + F.coalesce("blocks_before", F.lit(0))
    return blocked.join(blocks, [*keys, "block"]).select("shard", *keys, total.alias(name))


def pack_shard(rows: pd.DataFrame, starts: pd.DataFrame, window: int, turn: int) -> pd.DataFrame:
    """The pieces of one shard, its windows filled in turn."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    if rows.empty:
        return pd.DataFrame({n: [] for n in names})
    rows = rows.sort_values(["doc_id", "n"], kind="stable")
    weight = dict(zip(starts["source"], starts["weight"], strict=True))
    deficit = dict(zip(starts["source"], starts["deficit"], strict=True))
    queues: dict[str, deque[int]] = {}
    for k, source in enumerate(rows["source"]):
        queues.setdefault(source, deque()).append(k)
    ids, totals, doc_ids = rows["ids"].tolist(), rows["n"].tolist(), rows["doc_id"].tolist()
    done = [0] * len(rows)  # tokens of each document that are packed
    base = int(rows["shard"].iloc[0]) << 32
    pieces: list[tuple] = []
    active, sequence, filled = sorted(queues), 0, 0
    heads: dict[str, bytes] = {}  # the ids of the document that a source is at

    def need(source: str) -> int:
        head = queues[source][0]
        return min(turn, totals[head] - done[head])

    needs = {s: need(s) for s in active}
    pay: dict[str, float] = {}
    while active:
        if len(pay) != len(active):
            share = sum(weight[s] for s in active) or 1.0
            pay = {s: max(weight[s] / share * window, 1e-6) for s in active}
        # as many rounds at once as it takes until a source can be served
        rounds = max(1, min(math.ceil((needs[s] - deficit[s]) / p) for s, p in pay.items()))
        for source in active:
            owed = deficit[source] + rounds * pay[source]
            queue = queues[source]
            while queue and owed >= needs[source]:
                head = queue[0]
                start, total = done[head], totals[head]
                if source not in heads:
                    heads[source] = pa.decompress(ids[head], 4 * total, codec="zstd", asbytes=True)
                length = min(total - start, max(needs[source], int(owed)), window - filled)
                crc = zlib.crc32(heads[source][4 * start : 4 * (start + length)])
                pieces.append((doc_ids[head], start, length, crc, total, base + sequence, filled, source))
                owed -= length
                filled += length
                done[head] = start + length
                if filled == window:
                    sequence, filled = sequence + 1, 0
                if start + length == total:
                    queue.popleft()
                    del heads[source]
                if queue:
                    needs[source] = need(source)
            deficit[source] = owed
        active = [s for s in active if queues[s]]
    return pd.DataFrame(pieces, columns=names)
