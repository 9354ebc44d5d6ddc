"""Exact top-k inner products by an impact-ordered, score-at-a-time index (operator 10).

Each component x of a vector becomes the integer floor(scale * x). A block of vectors is indexed by impact: segment s
holds the postings whose magnitude has its highest bit at level s, so segments fall by powers of two. Queries take the
segments in descending impact and add up partial scores; after each segment, what is still missing from a vector's score
is at most the query's length times the length of the vector's postings that are left (Cauchy-Schwarz). A vector whose
partial score plus that bound is below the k-th best proven score can't be a member: when no more vectors than a few per
query are left, or no segment, these are rescored exactly. Nothing is left out without that proof.

With dense vectors nearly every posting list names every vector of the block, so a segment is stored as a dense matrix
of its impacts, and a whole block of queries is scored by one product.

Blocks of queries meet groups of index blocks, one task each, in which the best of all blocks so far bound the next; a
task returns k rows per query. Defined cases: vectors that are null or empty, or hold null or non-finite components, take
no part, nor do those of another length than the most frequent one (the smaller if two are); zero vectors do; equal
scores rank the smaller id first; repeated vectors are separate candidates; a query with fewer than k candidates returns
them all; an empty table gives an empty result. Rows that share a query's id count as its own and are no candidates.
Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableload.llm.neighbours import usable
from tableload.llm.rows import ship, written

SCALE = 64
#: Queries of a block, vectors of an index block, and vectors of a group, as expected.
QUERY_ROWS, INDEX_ROWS, GROUP_ROWS = 512, 4_096, 131_072
#: Candidates left per query at which they are rescored instead of reading on.
FEW = 64


def whole_type(bits: int):
    """The type whose arithmetic is exact for whole numbers of so many bits."""
    return np.float32 if bits <= 23 else np.float64 if bits <= 52 else np.int64


class ImpactIndex:
    """Segments of a block of integer vectors in descending impact, and the length of what each leaves."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        magnitude = np.abs(values)
        self.top = int(magnitude.max(initial=0)).bit_length()
        self.segments, self.left = [], []
        for level in range(self.top, 0, -1):
            inside = magnitude >> (level - 1) == 1
            if level <= 3 or len(self.segments) == 8:
                break
            if inside.any():
                self.segments.append(np.where(inside, values, 0))
                magnitude = np.where(inside, 0, magnitude)
                self.left.append(np.sqrt((magnitude.astype(float) ** 2).sum(axis=1)))
        if magnitude.any() or not self.segments:  # the lowest impacts, together
            self.segments.append(np.where(magnitude > 0, values, 0))
            self.left.append(np.zeros(len(values)))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, best: list, k: int) -> list:
        """``best``: for each query its ids and scores so far, best first; the same with this block's members."""
        bits = int(np.abs(queries).max(initial=0)).bit_length() + self.top + queries.shape[1].bit_length()
        kind = whole_type(bits)
        asked = queries.astype(kind)
        # a little more than the true lengths, so that rounding never breaks the proof
        length = np.sqrt((queries.astype(float) ** 2).sum(axis=1)) * (1 + 1e-6) + 1e-6
        proven = np.array([s[k - 1] if len(s) >= k else -np.inf for _, s in best], float)
        partial = np.zeros((len(queries), len(self.ids)), kind)
        alive = query_ids[:, None] != self.ids
        for segment, left in zip(self.segments, self.left, strict=True):
            partial += asked @ segment.T.astype(kind)
            slack = np.outer(length, left)
            if len(self.ids) >= k:
                floor = np.where(alive, partial - slack, -np.inf)
                proven = np.maximum(proven, np.partition(floor, len(self.ids) - k, axis=1)[:, len(self.ids) - k])
            alive &= partial + slack >= proven[:, None]
            if alive.sum() <= FEW * len(queries):
                break
        out = []
        for q, (ids, scores) in enumerate(best):
            members = np.flatnonzero(alive[q])
            ids = np.concatenate([ids, self.ids[members]])
            scores = np.concatenate([scores, self.values[members] @ queries[q]])
            order = np.lexsort((ids, -scores))[:k]
            out.append((ids[order], scores[order]))
        return out


def packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``part, ids, values``: the vectors in parts of about ``size``, by hash, each one row; and the number of parts."""
    parts = max(1, -(-rows.count() // size))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.array(frame["vector"].tolist(), np.int64)
        least = np.min_scalar_type(-int(np.abs(values).max(initial=0)) - 1)
        return pd.DataFrame(
            {
                "part": frame["part"].iloc[:1],
                "ids": [frame["vec_id"].to_numpy("<i8").tobytes()],
                "kind": [least.str],
                "values": [values.astype(least).tobytes()],
            }
        )

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(pack, "part long, ids binary, kind string, values binary"), parts


def unpacked(ids: bytes, kind: str, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, "<i8")
    return found, np.frombuffer(values, kind).astype(np.int64).reshape(len(found), -1)


def top_k(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_rows: int = QUERY_ROWS,
    index_rows: int = INDEX_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col, zero_takes_part=True)
    impact = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = written(rows.select("vec_id", impact.alias("vector")), "impacts")
    index, parts = packed(rows, index_rows)
    asked, blocks = packed(rows.where(F.pmod("vec_id", F.lit(every)) == 0), query_rows)
    pieces = max(1, parts * index_rows // group_rows)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = asked.withColumnRenamed("part", "block").withColumn("piece", each(pieces))
    index = written(index, "impact-blocks").withColumn("piece", F.pmod("part", F.lit(pieces))).withColumn("block", each(blocks))

    def search(_key, queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in queries.itertuples(index=False):
            query_ids, vectors = unpacked(row.ids, row.kind, row.values)
            best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in query_ids]
            for part in held.itertuples(index=False):
                best = ImpactIndex(*unpacked(part.ids, part.kind, part.values)).search(query_ids, vectors, best, k)
            out += [(q, i, s) for q, (ids, scores) in zip(query_ids, best, strict=True) for i, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["block", "piece"]
    found = asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
