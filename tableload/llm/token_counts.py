"""Token counts by a two-tier lookup (operator 3).

Tier one is a compact table of how many tokens each frequent pre-token has, fitted on a bounded sample of documents and
broadcast; tier two is a cache per Python worker, filled by encoding what tier one lacks with the tokenizers library.
A pre-token here is what stands between spaces and line feeds: the vocabulary drops white space and none of its tokens
or special strings spans any, so the counts of a text's pre-tokens add up to its own. Nothing is shuffled.

Defined cases: a null text is the empty text, with 0 bytes and 0 tokens; special strings inside a text count as the one
token the library makes of them; repeated rows and ids stay separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableload.llm.rows import map_texts, ship, two_columns

#: Documents the table is fitted on at most, and its entries at most: 12 bytes each.
SAMPLE_DOCS = 4_000
TABLE_ENTRIES = 65_536
#: Pre-tokens per worker cache, and the longest that is cached (characters).
CACHED = 300_000
CACHED_CHARS = 64

_open: dict[str, object] = {}


def library_tokenizer(path: str):
    """The library's tokenizer, one per Python worker and file, without truncation and padding."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _open[path] = tokenizer
    return _open[path]


def pre_tokens(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class Counts(dict):
    """Token counts by pre-token; what is missing is looked up in the table, then encoded."""

    def __init__(self, tokenizer, keys: np.ndarray, lengths: np.ndarray):
        self.tokenizer, self.keys, self.lengths = tokenizer, keys, lengths

    def __missing__(self, token: str) -> int:
        key = np.uint64(xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")))
        at = int(np.searchsorted(self.keys, key))
        if at < len(self.keys) and self.keys[at] == key:
            count = int(self.lengths[at])
        else:
            count = len(self.tokenizer.encode(token, add_special_tokens=False))
        if len(token) <= CACHED_CHARS:
            self[token] = count
        return count


def frequent_lengths(docs: DataFrame, vocabulary: str, sample_docs: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the most frequent pre-tokens of a sample, and their token counts."""
    total = docs.count()
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    share = min(1.0, sample_docs / total)
    scale = 1 << 30
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(share * scale) + 1)

    def count(batches):
        import pyarrow as pa

        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                seen.update(t for t in pre_tokens(text or "") if len(t) <= CACHED_CHARS)
                if len(seen) > 4 * entries:
                    seen = Counter(dict(seen.most_common(2 * entries)))
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["token", "n"]
        )

    found = drawn.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = [r.token for r in found.orderBy(F.desc("n"), "token").limit(entries).collect()]
    tokenizer = library_tokenizer(vocabulary)
    keys = np.array([xxhash.xxh3_64_intdigest(t.encode()) for t in top], np.uint64)
    lengths = np.array([len(e) for e in tokenizer.encode_batch_fast(top, add_special_tokens=False)], np.uint32)
    order = np.argsort(keys)
    return keys[order], lengths[order]


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = SAMPLE_DOCS,
    entries: int = TABLE_ENTRIES,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, as the library's vocabulary file counts them.

    The table's fit changes only how fast counts are found, never the counts.
    """
    spark = docs.sparkSession
    ship(spark)
    source = two_columns(docs, id_col, text_col)
    table = spark.sparkContext.broadcast(frequent_lengths(source, vocabulary, sample_docs, entries))

    def make():
        tokenizer = library_tokenizer(vocabulary)
        name = f"counts:{vocabulary}"
        if name not in _open or len(_open[name]) > CACHED:
            _open[name] = Counts(tokenizer, *table.value)

        def work(texts):
            counts = _open[name]
            if len(counts) > CACHED:
                counts.clear()
            out = []
            for text in texts:
                n = sum(map(counts.__getitem__, pre_tokens(text)))
                out.append((len(text.encode("utf-8", "surrogatepass")), n, n > limit))
            return out

        return work

    return map_texts(source, make, "n_bytes long, n_tokens long, over_limit boolean")
