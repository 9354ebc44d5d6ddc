"""Product-quantised vector codes by a lexicographic trie over distinct parts (operator 13).

Components become integers, ``floor(scale * x)``, and every vector is cut into consecutive parts, each position with a
codebook of its own. Equal parts of a position are one, with a count. The distinct parts in lexicographic order are the
leaves of a trie whose edges are components: parts with a common beginning share a path. A traversal carries, per node,
the squared distances of its prefix to all entries, so each common prefix is added up once; at a leaf the smallest is the
part's entry, and its components go, weighted by the count, into that entry's sum.

Distinct parts are dealt by range, so a task holds whole subtrees; they are kept as packed blocks of consecutive leaves,
which a round walks one after the other (depth first by block, all nodes of one depth of a block at once). A round brings
to the driver one sum per entry and component, as many as the codebooks have numbers, whatever the table holds.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no part; nor do those of another
length than the most frequent one (the smaller if two are), as no entry is as long. A length that the number of parts does
not divide gives the first parts one component more. Fewer rows than entries give smaller codebooks. Null ids are kept and
come after all others; rows that share an id are separate rows, and those with smaller components come first. Rows without
a label have one label error together. Components of 32,768 or more, whose squares leave 64 bits, are refused. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableload.llm.rows import ship, slices, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Leaves of one block, and expected blocks of one task.
LEAVES, BLOCKS = 8_192, 16
#: Absolute components from which squared distances no longer fit 64 bits.
TOO_LARGE = 32_768

Codebooks = list[np.ndarray]


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, cells``: the vectors that take part, their components as integers."""
    cast = vectors.select(
        F.col(f"`{id_col}`").alias("vec_id"),
        F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = cast.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(finite)
    refused = F.raise_error(F.lit(f"vector components of {TOO_LARGE} or more cannot be coded")).cast("long")
    cell = lambda x: F.when(F.abs(x) < TOO_LARGE, F.floor(x * scale)).otherwise(refused)
    whole = written(kept.select("vec_id", "label", F.transform("vector", cell).alias("cells")), "whole-vectors")
    sizes = whole.groupBy(F.size("cells").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return whole.where(F.size("cells") == (sizes.length if sizes else 0))


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """Where each part begins and ends."""
    ends = np.cumsum([length // parts + (k < length % parts) for k in range(parts)])
    return [(int(e) - length // parts - (k < length % parts), int(e)) for k, e in enumerate(ends)]


def prefix_distances(leaves: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of sorted distinct rows to every entry, by their trie.

    A node of depth k is a run of leaves with the same first k + 1 components; it adds one component's distances to
    those its parent has accumulated.
    """
    begins = np.zeros(len(leaves), bool)
    begins[:1] = True
    parent = np.zeros(len(leaves), np.int64)
    distances = np.zeros((1, len(entries)), np.int64)
    for k in range(leaves.shape[1]):
        begins[1:] |= leaves[1:, k] != leaves[:-1, k]
        first = np.flatnonzero(begins)
        distances = distances[parent[first]] + (leaves[first, k][:, None] - entries[:, k]) ** 2
        parent = np.cumsum(begins) - 1
    return distances


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, the lower index on a tie; rows in any order."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    fresh = np.ones(len(parts), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    found = prefix_distances(ordered[fresh], entries)
    best = found.argmin(axis=1)
    leaf = np.empty(len(parts), np.int64)
    leaf[order] = np.cumsum(fresh) - 1
    return best[leaf], found[np.arange(len(best)), best][leaf]


def packed_parts(whole: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """``position, leaves, counts``: blocks of consecutive distinct parts with how often each occurs, as a table."""
    each = F.array(*[F.slice("cells", a + 1, b - a) for a, b in spans])
    counted = whole.select(F.posexplode(each).alias("position", "part")).groupBy("position", "part").count()
    distinct = written(counted, "distinct-parts")
    tasks = min(20_000, 1 + distinct.count() // (LEAVES * BLOCKS))
    ordered = distinct.repartitionByRange(tasks, "position", "part").sortWithinPartitions("position", "part")

    def pack(batches):
        for batch in batches:
            for block in slices([batch], LEAVES):
                position = block.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(position)) + 1), block.num_rows]
                for a, b in zip(edges, edges[1:], strict=False):
                    if a < b:
                        some = block.slice(a, b - a)
                        leaves = some.column(1).flatten().to_numpy().astype("<i8").tobytes()
                        counts = some.column(2).to_numpy().astype("<i8").tobytes()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([int(position[a])], pa.int32()), pa.array([leaves]), pa.array([counts])],
                            names=["position", "leaves", "counts"],
                        )

    return written(ordered.mapInArrow(pack, "position int, leaves binary, counts binary"), "part-blocks")


def one_round(blocks: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Every part to its nearest entry, then every entry to the floor of its parts' mean; unused entries stay."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(codebooks)

    def add(batches):
        books = sent.value
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for position, leaves, counts in rows:
                book, total = books[position], sums[position]
                leaves = np.frombuffer(leaves, "<i8").reshape(-1, book.shape[1])
                counts = np.frombuffer(counts, "<i8")
                best = prefix_distances(leaves, book).argmin(axis=1)
                np.add.at(total[:, 0], best, counts)
                np.add.at(total[:, 1:], best, leaves * counts[:, None])
        for position, total in enumerate(sums):
            entry, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(entry), position, np.int32)),
                    pa.array(entry.astype(np.int32)),
                    pa.array(at.astype(np.int32)),
                    pa.array(total[entry, at]),
                ],
                names=["position", "entry", "at", "value"],
            )

    partial = blocks.mapInArrow(add, "position int, entry int, at int, value long")
    found = partial.groupBy("position", "entry", "at").agg(F.sum("value").alias("value")).collect()
    sent.destroy()
    totals = {(r.position, r.entry, r.at): r.value for r in found}
    after = [b.copy() for b in codebooks]
    for position, book in enumerate(after):
        for entry in range(len(book)):
            count = totals.get((position, entry, 0), 0)
            if count:
                book[entry] = [totals.get((position, entry, k + 1), 0) // count for k in range(book.shape[1])]
    return after


def first_codebooks(whole: DataFrame, spans: list[tuple[int, int]], entries: int) -> Codebooks:
    """The parts of the rows with the smallest ids."""
    rows = whole.orderBy(F.col("vec_id").asc_nulls_last(), "cells").select("cells").limit(entries).collect()
    cells = np.array([r.cells for r in rows], np.int64)
    return [np.ascontiguousarray(cells[:, a:b]) for a, b in spans]


def digest(codebooks: Codebooks) -> str:
    """SHA-256 of all components as decimal text, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in codebooks for x in b.ravel().tolist()).encode()).hexdigest()


def learn(whole: DataFrame, spans: list[tuple[int, int]], entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks after all rounds over every row of ``whole``."""
    codebooks = first_codebooks(whole, spans, entries)
    blocks = packed_parts(whole, spans)
    for _ in range(rounds):
        codebooks = one_round(blocks, codebooks)
    return codebooks


def vector_codes(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every vector that takes part.

    ``code`` has the index of each part's entry as two hex digits; ``error`` is the squared distance of the coded vector,
    and ``label_error`` the sum of these over the rows of a label.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    spark = vectors.sparkSession
    ship(spark)
    whole = whole_vectors(vectors, scale, id_col, vector_col, label_col)
    some = whole.select(F.size("cells").alias("length")).first()
    spans = cuts(some.length if some else parts, parts)
    codebooks = learn(whole, spans, entries, rounds) if some else []
    kind, label_kind = (whole.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    sent = spark.sparkContext.broadcast(codebooks)

    def code(batches):
        for batch in slices(batches, LEAVES):
            cells = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            found = [nearest_entries(cells[:, a:b], book) for (a, b), book in zip(spans, sent.value, strict=True)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            texts = [row.tobytes().hex() for row in codes]
            error = sum(distance for _, distance in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    coded = whole.mapInArrow(code, f"vec_id {kind}, label {label_kind}, code string, error long")
    coded = written(coded, "vector-codes")
    # Plain joined tables: adaptive execution sends few labels to the rows, and splits a frequent label otherwise.
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, coded["label"].eqNullSafe(sums["_label"]))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
