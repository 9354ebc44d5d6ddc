"""Nearest neighbours by low-dimensional stable projections and kd-trees (operator 7).

Vectors are projected on a few Gaussian directions. A Gaussian is 2-stable: the squared distance of two projections, over
the squared distance of the vectors, has a chi-square law with as many degrees of freedom as there are directions. A
query takes projected neighbours in increasing distance and verifies each by its exact distance. It stops when any vector
within the k-th best distance d would, with the asked-for confidence, have been projected nearer than what comes next,
that is when r^2 >= d^2 * quantile.

Of equal vectors only the k + 1 smallest ids are searched, as ties go to the smaller id and a query leaves out one id, its
own. Each distinct vector that is asked for is searched once, and its answer given back to all ids that ask for it.

The projected space is divided by a kd-tree whose top is fitted on a bounded sample; every row is dealt to its cell, and
each cell has a kd-tree of its own below. A query first searches its own cell, which bounds d, and then only the cells
whose box is nearer than the stopping radius. Cells are counted: one that holds more than twice the rows expected is dealt
into parts by a hash, each with a kd-tree of its own, and one that many queries need into blocks of queries; every block
meets every part. So a group is bounded however the vectors lie and however many there are.

Defined cases: vectors that are null or zero, or hold null or non-finite components, take no part; nor do those of
another length than the most frequent one (the smaller if two are), as no distance is defined; equal distances rank the
smaller id first; repeated vectors are separate candidates; a query with fewer than k candidates returns them all; an
empty table gives an empty result. Rows that share a query's id count as its own and are no candidates;
where several rows with one id ask, each brings its candidates, and the k nearest of all are the answer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableload.llm.rows import ship, written

DIMENSIONS, CONFIDENCE = 8, 0.98
#: Rows the top of the tree is fitted on at most, vectors of a cell as expected, and of a leaf below it.
SAMPLE_ROWS, CELL_ROWS, LEAF_ROWS = 50_000, 8_000, 64
MAX_CELLS = 8_192
#: Queries that one task answers from a part of a cell, as expected.
QUERY_ROWS = 8_000
#: Ids that ask for one vector from which its answer may be broadcast, and vectors whose answers are, at most.
OFTEN, HOT_VECTORS = 1_000, 1_000
SEED = 20_240


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero_takes_part: bool = False) -> DataFrame:
    """``vec_id, vector`` (doubles) of the vectors that take part."""
    cast = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = cast.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(finite)
    if not zero_takes_part:
        kept = kept.where(F.exists("vector", lambda x: x != 0))
    length = kept.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    return kept.where(F.size("vector") == (length.length if length else 0))


def chi_square_quantile(confidence: float, freedom: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom."""

    def below(x: float) -> float:
        term, total = 1.0, 0.0
        for k in range(freedom // 2):
            total += term
            term *= (x / 2) / (k + 1)
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < confidence:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < confidence else (low, middle)
    return high


class Tree:
    """The top of the kd-tree: a complete tree of splits; node k has children 2k + 1 and 2k + 2."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, nodes = depth, (1 << depth) - 1
        self.axis, self.value = np.zeros(nodes, np.int64), np.zeros(nodes)
        held = {0: points}
        for node in range(nodes):
            some = held.pop(node)
            if len(some):
                self.axis[node] = int(np.argmax(some.max(axis=0) - some.min(axis=0)))
                self.value[node] = float(np.median(some[:, self.axis[node]]))
            right = some[:, self.axis[node]] > self.value[node]
            held[2 * node + 1], held[2 * node + 2] = some[~right], some[right]
        self.low = np.full((1 << depth, points.shape[1]), -np.inf)
        self.high = np.full((1 << depth, points.shape[1]), np.inf)
        for cell in range(1 << depth):
            node = cell + nodes
            while node:
                parent = (node - 1) // 2
                a, v = self.axis[parent], self.value[parent]
                if node == 2 * parent + 2:
                    self.low[cell, a] = max(self.low[cell, a], v)
                else:
                    self.high[cell, a] = min(self.high[cell, a], v)
                node = parent

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - ((1 << self.depth) - 1)

    def near(self, point: np.ndarray, squared: float) -> np.ndarray:
        """Cells whose box is within a squared projected distance."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero((gap**2).sum(axis=1) <= squared)


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """The leaves of a kd-tree over all points, as index arrays."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        some = todo.pop()
        spread = np.ptp(points[some], axis=0) if len(some) else np.zeros(1)
        if len(some) <= LEAF_ROWS or not spread.any():
            out.append(some)
            continue
        order = some[np.argsort(points[some, int(np.argmax(spread))], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def best_of(ids: np.ndarray, times: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The nearest rows in order, up to the ``k + 1``-th distinct id, and whether there are so many: whichever one id is
    then left out, the ``k`` nearest others are among them. Of rows with one id, no more than ``k`` are ever needed."""
    order = np.lexsort((ids, scores))
    _, first = np.unique(ids[order], return_index=True)
    full = len(first) > k
    if full:
        order = order[: np.partition(first, k)[k] + 1]
    if len(order) > k + 1:
        by_id = np.argsort(ids[order], kind="stable")
        same = ids[order][by_id]
        late = np.zeros(len(order), bool)
        late[by_id[k:]] = same[k:] == same[:-k]
        order = order[~late]
    return ids[order], times[order], scores[order], full


def search_cell(
    held: pd.DataFrame, vectors: np.ndarray, points: np.ndarray, queries: pd.DataFrame, directions: np.ndarray, k: int, quantile: float
) -> list[tuple[int, int, int, float]]:
    """``(query, vec_id, times, score)`` of the best of this part of a cell for each query, as far as they were verified."""
    ids, times = held["vec_id"].to_numpy(), held["times"].to_numpy()
    found = leaves(points)
    low = np.array([points[x].min(axis=0) for x in found])
    high = np.array([points[x].max(axis=0) for x in found])
    out = []
    for number, vector, bound in zip(queries["query"], queries["vector"], queries["bound"], strict=True):
        query = np.asarray(vector, float)
        at = query @ directions
        gap = (np.maximum(np.maximum(low - at, at - high), 0) ** 2).sum(axis=1)
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        worst = bound
        for leaf in np.argsort(gap, kind="stable"):
            if gap[leaf] > quantile * worst**2:
                break
            some = found[leaf]
            some = some[((points[some] - at) ** 2).sum(axis=1) <= quantile * worst**2]
            if not len(some):
                continue
            distance = np.sqrt(((vectors[some] - query) ** 2).sum(axis=1))
            joined = [np.concatenate(x) for x in zip(best, (ids[some], times[some], distance), strict=True)]
            *best, full = best_of(*joined, k)
            if full:
                worst = min(worst, best[2][-1])
        out += [(number, int(i), int(n), float(d)) for i, n, d in zip(*best, strict=True)]
    return out


def fewest_copies(rows: DataFrame, k: int) -> DataFrame:
    """``vec_id, times, vector``: of equal vectors the ``k + 1`` smallest ids, each with how often it has the vector, ``k``
    at most. No query can have more of them among its nearest. Tasks reduce their rows before both shuffles."""
    each = rows.groupBy("vector", "vec_id").agg(F.least(F.count("*"), F.lit(k).cast("long")).alias("times"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    return each.withColumn("place", place).where(F.col("place") <= k + 1).select("vec_id", "times", "vector")


def pieces(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``cell`` and into how many pieces of about ``size`` its rows are dealt; one row per cell, so it can be broadcast."""
    return F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count("*") / size).alias(name)))


def meet(queries: DataFrame, held: DataFrame, part_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Queries and vectors with the keys ``cell, part, block`` under which each query meets each vector of its cell once:
    a cell with too many vectors is dealt into parts, one that too many queries ask into blocks of them."""
    parts, blocks = pieces(held, part_rows, "parts"), pieces(queries, query_rows, "blocks")
    dealt = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries, held = (x.join(parts, "cell").join(blocks, "cell") for x in (queries, held))
    queries = queries.withColumn("block", dealt("blocks", "query")).withColumn("part", each("parts"))
    held = held.withColumn("part", dealt("parts", "vec_id", "vector")).withColumn("block", each("blocks"))
    return queries.drop("parts", "blocks"), held.drop("parts", "blocks")


def nearest(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimensions: int = DIMENSIONS,
    confidence: float = CONFIDENCE,
    sample_rows: int = SAMPLE_ROWS,
    cell_rows: int = CELL_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col)
    total = rows.agg(F.approx_count_distinct(F.xxhash64("vector"))).first()[0]
    share = int(min(1.0, sample_rows / max(1, total)) * (1 << 30)) + 1
    sample = rows.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < share).select("vector").distinct().limit(2 * sample_rows)
    sample = sample.toPandas()
    points = np.array(sample["vector"].tolist(), float) if len(sample) else np.empty((0, 1))
    width = points.shape[1]
    directions = np.random.default_rng(SEED).standard_normal((width, dimensions))
    depth = max(0, math.ceil(math.log2(max(1, min(total / cell_rows, MAX_CELLS)))))
    tree = Tree(points @ directions, depth)
    shared = spark.sparkContext.broadcast((tree, directions))
    quantile = chi_square_quantile(confidence, dimensions)

    def deal(frames):
        tree, directions = shared.value
        for frame in frames:
            if len(frame):
                frame["cell"] = tree.cells(np.array(frame["vector"].tolist(), float) @ directions)
                yield frame

    dealt = fewest_copies(rows, k).mapInPandas(deal, "vec_id long, times long, vector array<double>, cell long")
    dealt = written(dealt, "vectors")
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vector", "vec_id").agg(F.count("*").alias("n"))
    asking = written(asking.select(F.col("vec_id").alias("query_id"), "n", "vector"), "asking")
    # each distinct vector is searched once; its number is stored, so it stays the same
    asked = asking.groupBy("vector").agg(F.count("*").alias("askers")).withColumn("query", F.monotonically_increasing_id())
    asked = asked.select("query", "askers", "vector")
    asked = written(asked.mapInPandas(deal, "query long, askers long, vector array<double>, cell long"), "asked")

    def search(_key, queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or held.empty:
            return pd.DataFrame({"query": [], "vec_id": [], "times": [], "score": []})
        _, directions = shared.value
        matrix = np.array(held["vector"].tolist(), float)
        got = search_cell(held, matrix, matrix @ directions, queries, directions, k, quantile)
        return pd.DataFrame(got, columns=["query", "vec_id", "times", "score"])

    def found(queries: DataFrame) -> DataFrame:
        queries, held = meet(queries.select("query", "vector", "cell", "bound"), dealt, 2 * cell_rows, query_rows)
        keys = ["cell", "part", "block"]
        answer = "query long, vec_id long, times long, score double"
        return queries.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, answer)

    here = written(found(asked.withColumn("bound", F.lit(float("inf")))), "own-cell")
    nearer = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    bounds = here.groupBy("query", "vec_id").agg(F.min("score").alias("score")).withColumn("place", nearer)
    bounds = bounds.where(F.col("place") == k + 1).select("query", F.col("score").alias("bound"))
    bound = asked.join(bounds, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def spread(frames):
        tree, directions = shared.value
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                cells = tree.near(np.asarray(row.vector, float) @ directions, quantile * row.bound**2)
                out += [(row.query, int(c), row.bound) for c in cells if c != row.cell]
            yield pd.DataFrame(out, columns=["query", "cell", "bound"])

    further = bound.select("query", "vector", "cell", "bound").mapInPandas(spread, "query long, cell long, bound double")
    further = written(further, "further-cells").join(asked.select("query", "vector"), "query")
    # the rows of the k + 1 nearest ids, however many rows these have
    first = F.min("score").over(Window.partitionBy("query", "vec_id"))
    place = F.dense_rank().over(Window.partitionBy("query").orderBy("first", "vec_id"))
    best = here.unionByName(found(further)).withColumn("first", first).withColumn("place", place).where(F.col("place") <= k + 1)
    best = best.groupBy("query").agg(F.collect_list(F.struct("vec_id", "times", "score")).alias("best"))
    best = written(asked.join(best, "query").select("vector", "askers", "best"), "answers")
    # vectors that very many ids ask for, HOT_VECTORS at most, give their answers away by a broadcast
    often = F.col("askers") > max(OFTEN, asking.count() // HOT_VECTORS)
    hot = F.broadcast(best.where(often))
    rest = asking.join(hot.select("vector"), "vector", "left_anti").join(best.where(~often), "vector")
    given = asking.join(hot, "vector").unionByName(rest)
    given = given.select("query_id", "n", F.inline("best")).where("vec_id <> query_id")
    times = F.least(F.col("times") * F.col("n"), F.lit(k).cast("long"))
    given = given.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    given = given.select("query_id", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= k)
    return given.select("query_id", "rank", "vec_id", "score")
