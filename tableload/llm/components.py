"""Connected components of a link table by alternating large-star and small-star steps.

Before each step every task replaces the links it reads by one per class, to the smallest class it is connected with by
these links alone. So paths that lie in one task take no step, and few steps are needed, each of which is several jobs.
Links that are few enough for one contraction take none: the jobs of a step weigh more than these links do, and most on the
driver, which holds the plans, threads and shuffles of each.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableload.llm.rows import long_schema, written

#: Links that a task contracts at a time, and that are contracted in one task at most.
RUN = 500_000


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``class, root`` for every class that has a link to another: root is the smallest class of its component.

    Each step is two joins over the links and is written to the scratch folder; about log of the longest path many steps
    are needed, and none for ``RUN`` links or fewer. No neighbour list is gathered, so a class with very many links is no larger task than its rows are.
    """
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = _contracted(links)
    while True:
        if edges.count() <= RUN:
            edges = written(edges.repartition(1).mapInArrow(_contract, long_schema("u v")), "contracted")
            break
        stars = written(_small_star(_large_star(edges)), "stars")
        # when a step changes nothing, all components are stars
        if _state(stars) == _state(edges):
            break
        edges = _contracted(stars)
    return edges.select(F.col("u").alias("class"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """An order-free digest of the table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _contracted(edges: DataFrame) -> DataFrame:
    return written(edges.mapInArrow(_contract, long_schema("u v")).distinct(), "edges")


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every class of the links that is not the smallest of its component, and that smallest one."""
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # roots are linked to the smallest root beside them, which is never larger, and then all classes to their root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
    other = root != np.arange(len(names))
    return names[other], names[root[other]]


def _contract(batches: Iterable[pa.RecordBatch]):
    held, size = [], 0

    def close():
        pairs = contracted(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], names=["u", "v"])

    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in (0, 1)])
        size += batch.num_rows
        if size >= RUN:
            yield close()
            held, size = [], 0
    if held:
        yield close()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a class to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each class and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()
