"""Token ids as grammar-compressed shards with random access (operator 11).

Documents are dealt by range of their id and sorted; each task writes the ids of its documents as shards of consecutive
documents. A shard is compressed by Re-Pair: its most frequent pairs of neighbouring symbols become new symbols, again
and again, until no pair is frequent. Pairs that share no symbol in opposite places cannot overlap, so all of these are
replaced in one pass, the frequent ones first. No pair reaches across documents, so a document is a run of symbols.

A file of ids is a Parquet table with one row per shard: the ids, symbols and tokens of its documents, the symbols, the
rules (two symbols each) and how many tokens each rule expands to. With these lengths a reader skips to any token of any
document and expands only the symbols it asks for. Where a shard begins within its task is written with it; the totals of
the tasks before, one number per task, are added when the files are read.

Defined cases: a null text is the empty text, whose only id is the end id; a null document id comes first; rows with one id
come in an order of their text's hash, equal rows next to each other; a document longer than a shard has a shard of its
own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableload.llm.rows import ship, slices, slices_by_size, written
from tableload.llm.word_ids import word_ids

#: Tokens of a shard as expected, bytes of text that one task sorts, and tasks at most (their totals are broadcast).
SHARD_TOKENS, TASK_BYTES, MOST_TASKS = 1 << 20, 24 << 20, 20_000
#: Bytes of text that a task encodes at a time, so that a pre-token frequent among them is looked up once.
ENCODED = 4 << 20
#: How often a pair must occur in a shard to become a rule, which itself takes the place of three symbols.
LEAST = 16
_HASH_BITS = 19

Pairs = np.ndarray


def frequent_pairs(symbols: np.ndarray, at: np.ndarray, least: int) -> tuple[Pairs, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of neighbours that occur ``least`` times at some places, their counts, and where pairs that may be
    frequent lie.

    Pairs are counted by hash first, so only those in a bucket that is full enough are sorted.
    """
    left, right = symbols[at], symbols[at + 1]
    low = (left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))
    bucket = (low >> np.uint32(32 - _HASH_BITS)).astype(np.int64)
    # places, as numpy takes by places faster than by flags
    full = np.flatnonzero((np.bincount(bucket, minlength=1 << _HASH_BITS) >= least)[bucket])
    at, pairs = at[full], (left[full].astype(np.uint64) << np.uint64(32)) | right[full]
    ordered = np.sort(pairs)
    first = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] + np.uint64(1)))
    count = np.diff(first, append=len(ordered))
    often = count >= least
    return ordered[first[often]], count[often], at, pairs


def compatible(pairs: Pairs, count: np.ndarray) -> Pairs:
    """Of the pairs, the most frequent first, those whose occurrences overlap with no other's; sorted."""
    left, right, taken = set(), set(), []
    for pair in pairs[np.lexsort((pairs, -count))].tolist():
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if a in right or b in left or (a == b and (a in left or b in right)):
            continue
        left.add(a)
        right.add(b)
        taken.append(pair)
    return np.array(sorted(taken), np.uint64)


def compress(symbols: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST):
    """Symbols after Re-Pair, where documents end among them, and the rules of the symbols from ``first`` on.

    A pair that is rare stays so, as a pass only takes occurrences away: after the first pass only the places of pairs
    that were not rare, and those beside a new symbol, are counted again.
    """
    symbols, ends, rules = symbols.astype(np.uint32), ends.copy(), [np.empty((0, 2), np.uint32)]
    free, places = first, np.flatnonzero(~ends[:-1])
    while len(places):
        pairs, count, at, of = frequent_pairs(symbols, places, least)
        if not len(pairs):
            break
        counted = np.zeros(len(symbols), bool)
        counted[at] = True
        taken = compatible(pairs, count)
        begins, follows = np.zeros((2, free), bool)
        begins[(taken >> np.uint64(32)).astype(np.int64)] = True
        follows[(taken & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
        may = np.flatnonzero(begins[symbols[at]])
        at, of = at[may], of[may]
        may = np.flatnonzero(follows[symbols[at + 1]])
        at, of = at[may], of[may]
        rule = np.minimum(np.searchsorted(taken, of), len(taken) - 1)
        hit = np.flatnonzero(taken[rule] == of)
        at, rule = at[hit], rule[hit]
        # only a pair of equal symbols overlaps with itself: in a run of these every other place counts
        again = np.diff(at, prepend=-2) == 1
        if again.any():
            run = np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
            other = (np.arange(len(at)) - run) % 2 == 0
            at, rule = at[other], rule[other]
        symbols[at] = free + rule
        ends[at] = ends[at + 1]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        counted[at] = True
        counted[np.maximum(at - 1, 0)] = True
        counted[at + 1] = False
        stays = np.flatnonzero(stays)
        symbols, ends, counted = symbols[stays], ends[stays], counted[stays]
        rules.append(np.stack([taken >> np.uint64(32), taken & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        free += len(taken)
        places = np.flatnonzero(counted[:-1] & ~ends[:-1])
    return symbols, ends, np.concatenate(rules)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Tokens that each rule stands for; a rule names earlier symbols only."""
    lengths = np.zeros(len(rules), np.int64)
    known = 0
    while known < len(rules):
        # the rules up to the first that names one not known yet
        late = np.flatnonzero(rules[known:].max(axis=1) >= first + known)
        until = known + (int(late[0]) if len(late) else len(rules) - known)
        some = rules[known:until].astype(np.int64) - first
        lengths[known:until] = np.where(some < 0, 1, lengths[np.maximum(some, 0)]).sum(axis=1)
        known = until
    return lengths


@dataclass
class Shard:
    """The symbols of consecutive documents, with the rules of those from ``first`` on."""

    symbols: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    first: int

    def tokens_of(self, symbols: np.ndarray) -> np.ndarray:
        """How many tokens each symbol stands for."""
        rule = symbols.astype(np.int64) - self.first
        return np.where(rule < 0, 1, self.lengths[np.maximum(rule, 0)]) if len(self.lengths) else np.ones(len(symbols), np.int64)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The tokens of some symbols, the rules of one depth at a time."""
        sizes = self.tokens_of(symbols)
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        places = ends - sizes
        while len(symbols):
            plain = symbols < self.first
            out[places[plain]] = symbols[plain]
            places, pair = places[~plain], self.rules[symbols[~plain] - np.uint32(self.first)]
            left, right = pair[:, 0], pair[:, 1]
            places = np.concatenate([places, places + self.tokens_of(left)])
            symbols = np.concatenate([left, right])
        return out

    def part(self, begin: int, end: int, start: int, length: int) -> np.ndarray:
        """Tokens ``start`` to ``start + length`` of the document whose symbols are ``begin`` to ``end``."""
        symbols = self.symbols[begin:end]
        until = np.cumsum(self.tokens_of(symbols))
        a, b = np.searchsorted(until, start, "right"), np.searchsorted(until, start + length, "left") + 1
        skipped = int(until[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - skipped : start - skipped + length]


def _packed(values: np.ndarray) -> bytes:
    raw = values.astype("<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint32)
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), "<u4")


def _shard(row: dict) -> Shard:
    rules = _unpacked(row["rules"]).reshape(-1, 2)
    return Shard(_unpacked(row["symbols"]), rules, _unpacked(row["lengths"]).astype(np.int64), row["first_rule"])


SHARD_FIELDS = (
    "task int, shard int, begin long, n_tokens long, first_rule int, doc_tokens array<long>, doc_symbols array<long>, "
    "symbols binary, rules binary, lengths binary"
)


def write_ids(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 1,
    shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the ids of every whole text, ``end_id`` after each, as grammar-compressed shards in ascending id order."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(MOST_TASKS, 1 + size // TASK_BYTES)
    # A frequent id is split by text, and equal rows, whichever is which, by where they lie.
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = source.repartitionByRange(tasks, *order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType
    fields = f"{SHARD_FIELDS}, doc_ids array<{kind.simpleString()}>"

    def run(batches):
        encoder, task = word_ids(vocabulary), TaskContext.get().partitionId()
        names = [f.split(" ")[0] for f in fields.replace(", ", "\n").split("\n")]
        doc_ids, ids, held, begin, shard = [], [], 0, 0, 0

        def close():
            tokens = np.concatenate(ids)
            sizes = np.array([len(i) for i in ids])
            ends = np.zeros(len(tokens), bool)
            ends[np.cumsum(sizes) - 1] = True
            symbols, ends, rules = compress(tokens, ends, encoder.size)
            runs = np.diff(np.flatnonzero(ends), prepend=-1)
            row = [task, shard, begin, len(tokens), encoder.size, sizes, runs, _packed(symbols), _packed(rules)]
            row += [_packed(expansion_lengths(rules, encoder.size)), pa.concat_arrays(doc_ids)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 2]
            types += [pa.binary()] * 3 + [pa.list_(doc_ids[0].type)]
            arrays = [pa.array([v.to_pylist() if isinstance(v, pa.Array) else v], t) for v, t in zip(row, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for part in slices_by_size(batches, 1, ENCODED):
            texts = part.column(1).fill_null("")
            long = pc.max(pc.binary_length(texts)).as_py() > 1 << 20
            found = [encoder.encode_long(t) for t in texts.to_pylist()] if long else encoder.encode(texts)
            for k, own in enumerate(found):
                doc_ids.append(part.column(0).slice(k, 1))
                ids.append(np.append(own, np.uint32(end_id)))
                held += len(own) + 1
                if held >= shard_tokens:
                    yield close()
                    begin, shard = begin + held, shard + 1
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield close()

    ordered.mapInArrow(run, fields).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in files of ``write_ids``: ``start`` counts the ids of all
    documents before, ``ids`` are little-endian unsigned 32-bit integers."""
    ship(spark)
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    tasks = shards.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    # one row per task of the writer, of which there are MOST_TASKS at most
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(tasks.select("task", before.alias("task_begin")))
    located = shards.join(starts, "task").withColumn("begin", F.col("begin") + F.col("task_begin")).drop("task_begin")
    names = ["begin", "first_rule", "doc_tokens", "symbols", "rules", "lengths", "doc_ids"]

    def run(batches):
        for batch in slices(batches, 1):
            row = {n: batch.column(n)[0].as_py() for n in names if n != "doc_ids"}
            shard, sizes = _shard(row), np.array(row["doc_tokens"])
            raw, ends = shard.expand(shard.symbols).astype("<u4").tobytes(), np.cumsum(sizes)
            for a in range(0, len(sizes), 1024):
                b = min(a + 1024, len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[0].values.slice(a, b - a),
                        pa.array(row["begin"] + ends[a:b] - sizes[a:b]),
                        pa.array(sizes[a:b]),
                        pa.array([raw[4 * (e - n) : 4 * e] for e, n in zip(ends[a:b].tolist(), sizes[a:b].tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return located.select(*names).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """``doc_id, begin, length, ids`` of the token ranges asked for: ``ranges`` has ``doc_id, begin, length``.

    Only the symbols that a range lies in are expanded. A range beyond the document's end is cut; every document with the
    id answers.
    """
    ship(spark)
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    of = F.sequence(F.lit(0), F.size("doc_ids") - 1)
    places = shards.select("task", "shard", F.explode(F.arrays_zip("doc_ids", of.alias("place"))).alias("d"))
    places = places.select("task", "shard", F.col("d.doc_ids").alias("doc_id"), F.col("d.place").alias("place"))
    asked = places.join(ranges.select("doc_id", "begin", "length"), "doc_id")

    def run(_key, held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held):
            row = held.iloc[0]
            shard, ends = _shard(row), np.cumsum(row["doc_symbols"])
            for w in wanted.itertuples():
                begin = int(ends[w.place - 1]) if w.place else 0
                found = shard.part(begin, int(ends[w.place]), w.begin, w.length)
                out.append((w.doc_id, w.begin, len(found), found.astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "begin", "length", "ids"])

    asked = written(asked, "asked-ranges")
    needed = asked.select("task", "shard").distinct()
    held = shards.select("task", "shard", "first_rule", "doc_symbols", "symbols", "rules", "lengths")
    held = held.join(needed, ["task", "shard"], "left_semi")
    grouped = held.groupBy("task", "shard").cogroup(asked.groupBy("task", "shard"))
    return grouped.applyInPandas(run, f"doc_id {kind}, begin long, length long, ids binary")
