"""Phrase collocations by an FM-index per shard of documents (operator 12).

Texts are cut into pieces at punctuation and line ends, pieces into words; a shard is the word ids of consecutive
documents with a separator between pieces. Its FM-index over words is bidirectional: the Burrows-Wheeler transforms of
the shard and of its mirror image, both sorted to the depth of the longest phrase. A phrase is an interval of either
transform, kept in step: a backward step of all intervals at once is one gather of the transform in the order of its
symbols, in which the runs of one interval are the intervals of its extensions; the smaller symbols before a run shift the
interval of the mirror image. So every phrase of a shard comes with its count and with the only word to its left or
right, if there is just one: it lies in a longer phrase only if that one has the same total. Counts are summed over shards.

What is rare as a whole is left out in rounds, each a sum over shards: pairs of words that are rarer than a phrase must be
cut the text, and longer phrases are only looked for where both of their parts with one word less are frequent. So none
that is frequent is lost. In these rounds phrases are named by 64-bit hashes; a shard that learns which of its phrases are
frequent also learns their totals, and one shard of each says its text. Only the longest phrases are summed under their
text. Shards stay where they are written, in a table bucketed by shard.

Defined cases: a null text has no words; a null language is ``und``; equal rows count each; languages without a phrase
that is frequent have no rows; pieces without words separate nothing; a text of any length lies in one shard; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableload.llm.rows import hashes, mix, ship, slices, written
from tableload.workspace import scratch_path

#: Words in the longest phrase, occurrences of a phrase at least, and phrases a language keeps.
LONGEST, LEAST, TOP = 5, 100, 2_000
#: Numbers for shards per bucket, which deal them evenly, and how far the next shard of a task lies, as a share of all buckets.
WAVES, STRIDE = 16, 0.618
#: Words of a shard as expected, and bytes of a word with what parts it from the next.
SHARD_WORDS, WORD_BYTES = 2_500_000, 6
UNKNOWN = "und"

# A-Z in lower case; marks and line ends cut pieces, a tab parts words as a space does.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_CUT = b"\n"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str) -> list[bytes]:
    """The words of a text in lower case, and a line end after each piece; empty ones stand for repeated spaces."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).replace(_CUT, b" \n ").split(b" ")


class Index:
    """Word ids with a separator (0) between pieces, as Burrows-Wheeler transform sorted to ``depth`` words."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n, size = len(symbols), int(symbols.max(initial=0)) + 1
        rank, known = symbols.astype(np.int64), 1
        while known < depth:
            # ranks of the first ``known`` words, joined with those of the words after them as far as they are asked for
            step = min(known, depth - known)
            pair = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -step)
            known += step
            rank = np.unique(pair, return_inverse=True)[1] if known < depth else pair
        order = np.argsort(rank, kind="stable")
        del rank
        self.bwt = symbols[order - 1] if n else symbols
        #: transform rows in the order of their symbols: row ``by_symbol[j]`` is followed backward by row ``j``
        self.by_symbol = np.argsort(self.bwt, kind="stable").astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])

    @cached_property
    def changes(self) -> np.ndarray:
        """How often the symbol changes before a row, to see whether an interval has just one."""
        return np.concatenate([[0], np.cumsum(self.bwt[1:] != self.bwt[:-1])])

    def only(self, low: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The one word before all occurrences of each interval; 0 where there are several, or a separator."""
        same = self.changes[low + count - 1] == self.changes[low]
        return np.where(same, self.bwt[low], 0)


class Phrases:
    """Phrases of one length: their words and their intervals in a transform and its mirror image."""

    def __init__(self, words: np.ndarray, low: np.ndarray, mirrored: np.ndarray, count: np.ndarray):
        self.words, self.low, self.mirrored, self.count = words, low, mirrored, count

    def some(self, which: np.ndarray) -> Phrases:
        return Phrases(self.words[which], self.low[which], self.mirrored[which], self.count[which])


def single_words(index: Index) -> Phrases:
    words = np.flatnonzero(np.diff(index.starts))
    words = words[words > 0]
    low, count = index.starts[words], np.diff(index.starts)[words]
    return Phrases(words[:, None].astype(np.int32), low, low, count)


def extended(index: Index, phrases: Phrases) -> Phrases:
    """All extensions of the phrases by one word to the left, with both intervals."""
    interval = np.full(len(index.bwt), -1, np.int32)
    ids = np.repeat(np.arange(len(phrases.low), dtype=np.int32), phrases.count)
    ends = np.cumsum(phrases.count)
    interval[np.arange(len(ids)) + np.repeat(phrases.low - (ends - phrases.count), phrases.count)] = ids
    of = interval[index.by_symbol]
    symbol = index.bwt[index.by_symbol]
    at = np.flatnonzero(of >= 0)
    of, symbol = of[at], symbol[at]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1])])) if len(at) else at
    count = np.diff(first, append=len(at))
    parent, word, low = of[first], symbol[first], at[first]
    # runs come by word, so within a parent the runs before have the smaller words
    by_parent = np.argsort(parent, kind="stable")
    before = np.cumsum(count[by_parent]) - count[by_parent]
    parents = parent[by_parent]
    begins = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]])) if len(parents) else parents
    smaller = np.empty(len(parent), np.int64)
    smaller[by_parent] = before - np.repeat(before[begins], np.diff(begins, append=len(parents)))
    kept = word > 0
    parent, word, low, count, smaller = parent[kept], word[kept], low[kept], count[kept], smaller[kept]
    words = np.concatenate([word[:, None].astype(np.int32), phrases.words[parent]], axis=1)
    return Phrases(words, low, phrases.mirrored[parent] + smaller, count)


def separated(symbols: np.ndarray) -> np.ndarray:
    """Word ids with one separator where several are, and one at the end."""
    symbols = np.append(symbols, 0).astype(np.int32)
    return symbols[np.concatenate([symbols[:-1] + symbols[1:] > 0, [True]])]


# Shards -----------------------------------------------------------------------------------------------------------------


class Dictionary(dict):
    """Ids of words in the order they are met; 0 is the separator, 1 what stands between repeated spaces."""

    def __missing__(self, word: bytes) -> int:
        index = self[word] = len(self)
        return index


def _compress(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _decompress(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def even_ids(spark: SparkSession, buckets: int) -> np.ndarray:
    """``WAVES`` whole numbers per bucket, which Spark's hash deals to it: one row per number, one column per bucket.

    Shards are few and large, so a hash of just any numbers would deal several to one task and none to others.
    """
    tried = WAVES * 4
    while True:
        bucket = F.pmod(F.hash(F.col("id")), F.lit(buckets)).alias("bucket")
        ids = spark.range(tried * buckets).select("id", bucket).groupBy("bucket").agg(F.collect_list("id").alias("ids"))
        rows = ids.select("bucket", F.slice(F.array_sort("ids"), 1, WAVES).alias("ids")).collect()
        if len(rows) == buckets and min(len(r.ids) for r in rows) == WAVES:
            return np.array([r.ids for r in sorted(rows)], np.int64).T
        tried *= 2


def shards(docs: DataFrame, shard_words: int, text_col: str, lang_col: str, ids: np.ndarray) -> DataFrame:
    """``shard, symbols, words``: ids of words and separators, and the distinct words, each after its language (escaped) and
    a tab; ``langs, sizes``: the languages of the shard and their words. A shard's number is one of ``ids``, by which the
    n-th shards of all tasks lie in different buckets; beyond these it is any other."""
    source = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )

    dealt = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        held: dict[str, tuple[Dictionary, list[np.ndarray]]] = {}
        size = 0

        def close():
            nonlocal number
            symbols, words, sizes, base = [], [], [], 0
            for lang, (known, found) in held.items():
                ids = np.concatenate(found)
                ids = ids[ids != 1]
                sizes.append(int(np.count_nonzero(ids)))
                # ids of all languages in a row, those of a language from ``base`` on; 0 and 1 are no words
                symbols.append(np.where(ids > 0, ids - 1 + base, 0).astype("<u4"))
                before = lang.encode("unicode_escape") + b"\t"
                words += [before + w for w in list(known)[2:]]
                base += len(known) - 2
            buckets = dealt.value.shape[1]
            name = -1 - (task << 32 | number)
            if number < WAVES and task < buckets:
                name = int(dealt.value[number, (task + int(number * STRIDE * buckets)) % buckets])
            row = [name, _compress(np.concatenate(symbols).tobytes()), _compress(b"\n".join(words)), list(held), sizes]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["shard", "symbols", "words", "langs", "sizes"])

        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                known, found = held.setdefault(lang, (Dictionary({_CUT: 0, b"": 1}), []))
                tokens = pieces(text)
                found.append(np.fromiter(chain(map(known.__getitem__, tokens), (0,)), np.int32, len(tokens) + 1))
                size += len(tokens)
            if size >= shard_words:
                yield close()
                held, size = {}, 0
        if held:
            yield close()

    fields = "shard long, symbols binary, words binary, langs array<string>, sizes array<long>"
    return source.mapInArrow(run, fields)


def _opened(symbols: bytes, words: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Ids (0 separates, word ``k`` is ``k + 1``) and the words, each after its language and a tab."""
    named = _decompress(words)
    return np.frombuffer(_decompress(symbols), "<u4").astype(np.int64), named.split(b"\n") if named else []


def _keys(words: list[bytes]) -> np.ndarray:
    """64-bit names of words, each with its language before it."""
    return hashes(words)


def word_counts(found: DataFrame) -> DataFrame:
    """``word, n``: every distinct word of a shard by its 64-bit name, and its occurrences there."""

    def run(batches):
        for batch in slices(batches, 1):
            symbols, words = _opened(batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            count = np.bincount(symbols, minlength=len(words) + 1)[1:]
            yield from _batches(["word", "n"], [_keys(words).view(np.int64), count])

    return found.select("symbols", "words").mapInArrow(run, "word long, n long")


def _batches(names: list[str], columns: list[np.ndarray], rows: int = 100_000):
    for a in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + rows], pa.int64()) for c in columns], names=names)


def names_of(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit names of phrases of equal length, one per row of word numbers, from the names of words."""
    with np.errstate(over="ignore"):
        found = keys[words[:, 0]].copy()
        for k in range(1, words.shape[1]):
            found = mix(found + _STEP) + keys[words[:, k]]
    return mix(found).view(np.int64)


def often(counts: DataFrame, least: int) -> DataFrame:
    """``shard, key, total, says`` of the rows whose ``n``, summed over all shards with the key, is ``least`` or more;
    ``says`` holds for one shard of each key.

    One shuffle by key: a shard has a key once, so a group is no larger than the number of shards.
    """
    same = Window.partitionBy("key")
    found = counts.withColumn("total", F.sum("n").over(same)).withColumn("says", F.col("shard") == F.min("shard").over(same))
    return found.where(F.col("total") >= least).select("shard", "key", "total", "says")


def pair_counts(found: DataFrame) -> DataFrame:
    """``shard, key, n``: the pairs of neighbouring words in a shard."""

    def run(batches):
        for batch in slices(batches, 1):
            symbols, words = _opened(batch.column(1)[0].as_py(), batch.column(2)[0].as_py())
            index = Index(separated(symbols), 2)
            pairs = extended(index, single_words(index))
            shard = np.full(len(pairs.count), batch.column(0)[0].as_py())
            yield from _batches(["shard", "key", "n"], [shard, names_of(_keys(words), pairs.words - 1), pairs.count])

    return found.mapInArrow(run, "shard long, key long, n long")


def only_pairs(symbols: np.ndarray, keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The text of frequent pairs: a separator between words that are none, and for words in none."""
    both = (symbols[:-1] > 0) & (symbols[1:] > 0)
    at = np.flatnonzero(both)
    named = names_of(keys, np.stack([symbols[at] - 1, symbols[at + 1] - 1], axis=1))
    joined = np.zeros(len(symbols) + 1, bool)  # whether a word and the one before it are a frequent pair
    joined[at[within(named, frequent)] + 1] = True
    text = np.where(joined[:-1] | joined[1:], symbols, 0)
    cut = np.flatnonzero((text[:-1] > 0) & (text[1:] > 0) & ~joined[1:-1]) + 1
    return separated(np.insert(text, cut, 0))


def within(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ``some``."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


class Flags:
    """The frequent phrases of a shard by their names, with their totals, and whether the shard says them."""

    def __init__(self, rows: pa.Table):
        keys, total, says = (rows.column(c).to_numpy() for c in ("key", "total", "says"))
        order = np.argsort(keys)
        self.keys, self.total, self.says = keys[order], total[order], says.astype(bool)[order]

    def at(self, keys: np.ndarray) -> np.ndarray:
        """Where some keys, all of them frequent, are."""
        return np.searchsorted(self.keys, keys)


def grown(index: Index, phrases: Phrases, keys: np.ndarray, flags: Flags) -> Phrases:
    """The extensions, by a word to the left, of frequent phrases that end in a frequent one and begin with one."""
    found = extended(index, phrases)
    size = found.words.shape[1]
    return found if size < 3 else found.some(within(names_of(keys, found.words[:, : size - 1] - 1), flags.keys))


def frequent_ones(phrases: Phrases, keys: np.ndarray, flags: Flags) -> tuple[Phrases, np.ndarray]:
    """Those phrases that are frequent as a whole, and where they are among the flags."""
    named = names_of(keys, phrases.words - 1)
    which = within(named, flags.keys)
    return phrases.some(which), flags.at(named[which])


def longer_counts(found: DataFrame, flags: DataFrame, size: int) -> DataFrame:
    """``shard, key, n``: the phrases of ``size`` words in a shard of which both parts with one word less are frequent."""

    def run(shard, held: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if held.num_rows:
            symbols, words = _opened(*(held.column(c)[0].as_py() for c in ("symbols", "words")))
            keys, flags = _keys(words), Flags(rows)
            index = Index(only_pairs(symbols, keys, flags.keys), size)
            phrases = single_words(index)
            for k in range(2, size + 1):
                phrases = grown(index, phrases, keys, flags)
                if k < size:
                    phrases, _ = frequent_ones(phrases, keys, flags)
            out = [np.full(len(phrases.count), shard[0].as_py()), names_of(keys, phrases.words - 1), phrases.count]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["shard", "key", "n"])

    return found.groupBy("shard").cogroup(flags.groupBy("shard")).applyInArrow(run, "shard long, key long, n long")


def phrase_counts(found: DataFrame, flags: DataFrame, longest: int) -> DataFrame:
    """``lang, phrase, size, n``, the name of a single word, and the only word on either side, if there is one.

    Phrases shorter than ``longest`` come from the shard that says them, with their totals, and with their words; those of
    full length from every shard.
    """
    fields = "lang string, phrase string, size int, n long, word long, left string, right string"
    names = [f.split(" ")[0] for f in fields.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(_shard, held: pa.Table, rows: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in names]

        def say(of: np.ndarray, count: np.ndarray, word: list, left: np.ndarray, right: np.ndarray) -> None:
            texts = [[words[k] for k in w] for w in (of - 1).tolist()]
            columns[0] += [w[0].split(b"\t", 1)[0].decode("unicode_escape") for w in texts]
            columns[1] += [_said(*w) for w in texts]
            columns[2] += [of.shape[1]] * len(texts)
            columns[3] += count.tolist()
            columns[4] += word
            for column, side in ((columns[5], left), (columns[6], right)):
                column += [_said(words[k - 1]) if k else None for k in side.tolist()]

        if held.num_rows:
            symbols, words = _opened(*(held.column(c)[0].as_py() for c in ("symbols", "words")))
            keys, flags = _keys(words), Flags(rows)
            text = only_pairs(symbols, keys, flags.keys)
            forward, mirror = Index(text, longest), Index(text[::-1], longest)
            phrases, used = single_words(forward), np.zeros(0, np.int32)
            for size in range(2, longest + 1):
                phrases = grown(forward, phrases, keys, flags)
                told, total = phrases, phrases.count
                if size < longest:
                    phrases, at = frequent_ones(phrases, keys, flags)
                    told, total = phrases.some(flags.says[at]), flags.total[at][flags.says[at]]
                if not len(phrases.count):
                    break
                left, right = forward.only(told.low, told.count), mirror.only(told.mirrored, told.count)
                say(told.words, total, [None] * len(total), left, right)
                used = np.union1d(used, told.words)
            none = np.zeros(len(used), np.int64)
            say(used[:, None], none, keys.view(np.int64)[used - 1].tolist(), none, none)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return found.groupBy("shard").cogroup(flags.groupBy("shard")).applyInArrow(run, fields)


def _said(*words: bytes) -> str:
    """Words of a shard's dictionary without their languages, as text."""
    return b" ".join([w.split(b"\t", 1)[1] for w in words]).decode("utf-8", "replace")


def _alone(side: str) -> Column:
    """The only word on a side in all shards, null if there is none."""
    same = (F.count(side) == F.count(F.lit(1))) & (F.min(side) == F.max(side))
    return F.when(same, F.min(side)).alias(side)


def outside_longer(phrases: DataFrame) -> DataFrame:
    """Without the phrases that a longer one by a word to the left or right, of the same total, contains."""
    longer = phrases.select("lang", F.col("phrase").alias("longer"), F.col("n").alias("total"))
    sides = [F.concat_ws(" ", "left", "phrase"), F.concat_ws(" ", "phrase", "right")]
    sides = [F.when(F.col(c).isNotNull(), s) for c, s in zip(("left", "right"), sides, strict=True)]
    asked = phrases.select("lang", "phrase", "n", F.explode(F.array_compact(F.array(*sides))).alias("longer"))
    inside = asked.join(longer, ["lang", "longer"]).where(F.col("n") == F.col("total")).select("lang", "phrase").distinct()
    return phrases.join(inside, ["lang", "phrase"], "left_anti")


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of two to ``longest`` words that stick together most.

    ``a`` are a phrase's occurrences, ``n`` all words of its language, and ``l`` and ``r`` those of its two parts at the cut
    that gives the lowest ``score``, ``floor(1000 a n / (l r))``. Phrases that occur within a longer one only are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    # twice as many buckets as shards are expected, as the last one of a task is smaller
    buckets, name = int(min(50_000, 2 * (1 + size // (WORD_BYTES * shard_words)))), f"llm_phrases_{uuid.uuid4().hex}"
    kept = shards(docs, shard_words, text_col, lang_col, even_ids(spark, buckets)).write.bucketBy(buckets, "shard")
    kept.option("path", scratch_path(spark, "llm-phrases")).option("compression", "uncompressed").saveAsTable(name)
    try:
        return _collocations_of(spark.table(name), buckets, longest, least, top)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _collocations_of(table: DataFrame, buckets: int, longest: int, least: int, top: int) -> DataFrame:
    found = table.select("shard", "symbols", "words")
    of = table.select(F.explode(F.arrays_zip("langs", "sizes")).alias("of"))
    sizes = of.groupBy(F.col("of.langs").alias("lang")).agg(F.sum("of.sizes").alias("words"))
    sizes = written(sizes, "language-sizes")
    flags = written(often(pair_counts(found), least), "frequent-pairs")
    for size in range(3, longest):
        more = often(longer_counts(found, flags.repartition(buckets, "shard"), size), least)
        flags = flags.unionByName(written(more, "frequent-phrases"))
    by_shard = phrase_counts(found, flags.repartition(buckets, "shard"), longest)
    summed = by_shard.groupBy("lang", "phrase", "size").agg(
        F.sum("n").alias("n"), F.max("word").alias("word"), _alone("left"), _alone("right")
    )
    summed = written(summed.where((F.col("size") == 1) | (F.col("n") >= least)), "phrases")
    # a single word also occurs where no frequent pair does, so its count is that of all its occurrences
    words = summed.where("size = 1").select("lang", "phrase", "word")
    totals = word_counts(found).groupBy("word").agg(F.sum("n").alias("n"))
    singles = written(words.join(totals, "word").select("lang", "phrase", "n"), "single-words")
    longer = summed.where("size > 1").drop("word")
    counted = longer.select("lang", "phrase", "n").unionByName(singles)
    return ranked(outside_longer(longer), counted, sizes, top)


def ranked(kept: DataFrame, counted: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """The first phrases of each language by score, each scored at its weakest cut."""
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "size", cut)
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cut)"))
    cuts = cuts.withColumn("tail", F.expr("substring_index(phrase, ' ', cut - size)"))
    heads = counted.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = counted.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(sizes.withColumnRenamed("words", "n"), "lang")
    score = F.expr("(cast(a * 1000 as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = scored.withColumn("score", score)
    weakest = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(weakest).select("lang", "phrase", "a", "n", "best.score", "best.l", "best.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    place = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return place.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
