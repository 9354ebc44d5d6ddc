"""N-gram Jaccard self-join by parity sketches (operator 1).

A document's shingles are hashed to positions of a bit sketch and XORed in: a position is set when an odd number of
shingles fell on it. Every shingle that two documents don't share flips one bit at most, so the Hamming distance of their
sketches is at most the size of their symmetric difference. At a similarity of 3/4 that is at most (a + b) / 7 for sets of
a and b shingles (100 i >= 75 u gives i >= 3 (a + b) / 7).

Sizes are banded in powers of four. In band j a sketch has P = 2 * 4^j blocks, more than that bound, so by the pigeonhole
principle at least P - (a + b) / 7 blocks of two linked documents are equal. Each document is in the band of its size, and
also in the next one when a partner of it can lie there. The blocks are taken in one common order, those frequent in a
sample last and empty ones at the very end: two sets of P block signatures that share P - d of them also share one among
their first d + 1, so a document gives away only as many. That is exact whatever the order; the order only keeps
passages that many documents share out of the join. Sketches are kept as the list of their set positions (a block has
2^32), and folded to a few bits per shingle where their Hamming distance is computed.

Documents with equal sets are one class and join as one. Within a block signature only neighbours in class order are
compared at first; what they link becomes connected. Classes that share a signature and are still not connected are then
compared in blocks of bounded size, by the sketches: each block gives as many pairs as would connect what may be linked,
these are verified exactly, and what they link becomes connected. After such a round all pairs that are still in
different components are compared. So the components are exact, and a group of near copies is joined by a few pairs each.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; with fewer than
five words the whole sequence is the one shingle; repeated rows and ids are separate documents of the same class; a null
id is never the smallest of a component unless all its ids are null; an empty table gives an empty result. Shingles and
sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableload.llm.components import components
from tableload.llm.rows import hashes, long_schema, map_texts, mix, ngrams, ship, slices, two_columns, words, written

SHINGLE = 5
#: A band holds sizes from BAND ** j up to BAND ** (j + 1) - 1, its sketches have BLOCKS * BAND ** j blocks.
BAND, BLOCKS = 4, 2
#: Documents that the order of blocks is fitted on at most, in how many of them a block counts as frequent, and how many
#: frequent blocks are kept at most (8 bytes each). They change the order, never the result.
SAMPLE_DOCS, FREQUENT, ORDERED = 32_768, 4, 200_000
#: Class ids that may be broadcast (8 bytes each) to pick documents; beyond, the documents are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Classes of a signature compared with each other by one task.
BLOCK = 1_000
#: Rounds in which a block gives a forest of pairs, before all pairs that are left are compared.
FOREST_ROUNDS = 1
#: Classes that a task remembers at most to give their signatures away once; forgetting them repeats rows, no more.
SEEN = 1_000_000
EMPTY_BLOCK = np.uint64(0x6A09E667F3BCC909)


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``n``-word shingles."""
    h = hashes(words(text))
    if not len(h):
        return h
    return np.unique(ngrams(h, min(n, len(h))))


def set_hash(found: np.ndarray) -> int:
    """One 64-bit hash of a whole set, its size included, as a signed integer."""
    with np.errstate(over="ignore"):
        parts = np.array([mix(found).sum(), len(found), np.bitwise_xor.reduce(mix(found ^ EMPTY_BLOCK))], np.uint64)
    return int(ngrams(parts, 3).astype(np.int64)[0])


def folded_sketch(found: np.ndarray) -> bytes:
    """A parity sketch of at least four bits per shingle, a power of two of them."""
    bits = 64 << max(0, int(4 * len(found) - 1).bit_length() - 6)
    odd = np.bincount((mix(found) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, one per row, folded to a length that divides theirs."""
    if sketches.shape[1] == words:
        return sketches
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def folded_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two folded sketches, the longer folded on to the shorter one's length."""
    return int(folded_distances(pa.array([a]), pa.array([b]))[0])


def folded_distances(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Hamming distances of pairs of folded sketches, the longer folded on to the shorter one's length."""
    left, right = (pc.binary_length(x).to_numpy(zero_copy_only=False) // 8 for x in (a, b))
    out = np.empty(len(left), np.int64)
    # sketches of one length at a time, as rows of a matrix
    lengths = left.astype(np.int64) << 32 | right
    for both in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == both)
        width = min(both >> 32, both & 0xFFFFFFFF)
        x, y = (folded(np.frombuffer(b"".join(s.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1), width) for s in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def bands(size: int) -> list[tuple[int, int]]:
    """(band, most shingles that a partner in this band may differ by) for each band that a set of ``size`` joins in."""
    own = 0
    while BAND ** (own + 1) <= size:
        own += 1
    top = BAND ** (own + 1)
    largest = 4 * size // 3
    out = [(own, (size + min(largest, top - 1)) // 7)]
    if largest >= top:
        out.append((own + 1, (size + largest) // 7))
    return out


def block_signatures(found: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the band's non-empty sketch blocks, and the numbers of these blocks."""
    blocks = BLOCKS * BAND**band
    block_bits = blocks.bit_length() - 1
    x = mix(found ^ mix(np.array([band + 1], np.uint64)))
    block = x >> np.uint64(64 - block_bits)
    position = np.sort((block << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF)))
    if len(position) > 1 and (position[1:] == position[:-1]).any():
        position, times = np.unique(position, return_counts=True)
        position = position[times % 2 == 1]
    if not len(position):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    block = (position >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    value = np.bitwise_xor.reduceat(mix(position), first)
    return mix(value ^ np.uint64(band + 1)), block[first]


def join_signatures(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The signatures that a set gives away, in all its bands."""
    out = []
    for band, differ in bands(len(found)):
        signature, block = block_signatures(found, band)
        order = mix(signature) >> np.uint64(1)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, signature), len(frequent) - 1)
            order |= (frequent[at] == signature).astype(np.uint64) << np.uint64(63)
        if differ + 1 < len(signature):
            out.append(signature[np.argpartition(order, differ)[: differ + 1]])
            continue
        out.append(signature)
        short = differ + 1 - len(signature)
        if short > 0:  # empty blocks come last, by a fixed order of their own
            empty = np.setdiff1d(np.arange(BLOCKS * BAND**band), block).astype(np.uint64)
            empty = mix(empty + EMPTY_BLOCK + np.uint64(band << 40))
            out.append(np.sort(empty)[:short])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sets(docs: DataFrame, frequent: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, class, sketch, signatures``: the class is a hash of the set, null without shingles; the
    signatures that a class gives away are with the first document of it that a task meets."""
    order = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        seen: set[int] = set()

        def work(texts):
            out = []
            if len(seen) > SEEN:
                seen.clear()
            for text in texts:
                found = shingles(text)
                if not len(found):
                    out.append((0, None, None, None))
                    continue
                own, given = set_hash(found), None
                if own not in seen:
                    seen.add(own)
                    given = join_signatures(found, order.value).tobytes()
                out.append((len(found), own, folded_sketch(found), given))
            return out

        return work

    return map_texts(docs, make, "n_shingles long, class long, sketch binary, signatures binary", id_col, text_col)


def frequent_signatures(source: DataFrame, total: int, sample_docs: int) -> np.ndarray:
    """Sorted block signatures that are frequent in a bounded sample of documents."""
    scale = 1 << 30
    share = int(min(1.0, sample_docs / max(1, total)) * scale) + 1
    drawn = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share)

    def run(batches):
        for part in slices(batches):
            some = [np.empty(0, np.uint64)]
            for text in part.column(1).to_pylist():
                found = shingles(text or "")
                if len(found):
                    some += [block_signatures(found, band)[0] for band, _ in bands(len(found))]
            signatures = np.concatenate(some).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signatures)], names=["signature"])

    counted = drawn.mapInArrow(run, "signature long").groupBy("signature").agg(F.count("*").alias("n"))
    top = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "signature").limit(ORDERED)
    # as an Arrow column, since so many rows as Python objects weigh on a driver
    return np.sort(top.select("signature").toArrow().column(0).to_numpy().view(np.uint64))


def given_away(found: DataFrame) -> DataFrame:
    """``signature, y``: the signatures that each class gives away, once per task that held documents of it."""

    def run(batches):
        for part in slices(batches):
            given = [np.frombuffer(g, np.int64) for g in part.column(1).to_pylist()]
            owners = np.repeat(part.column(0).to_numpy(), [len(g) for g in given])
            signatures = np.concatenate(given) if given else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signatures), pa.array(owners)], names=["signature", "y"])

    return found.where(F.col("signatures").isNotNull()).select("class", "signatures").mapInArrow(run, long_schema("signature y"))


def neighbours(found: DataFrame) -> DataFrame:
    """``signature, x, y``: classes that follow each other, by class, among those that gave the signature away."""
    given = given_away(found)
    same = Window.partitionBy("signature").orderBy("y")
    return given.withColumn("x", F.lag("y").over(same)).where("x <> y").select("signature", "x", "y")


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``x, y`` whose sizes and folded sketches allow a link."""
    side = lambda name: classes.select(
        F.col("class").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col("sketch").alias(f"s{name}")
    )
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    both = both.where("3 * greatest(nx, ny) <= 4 * least(nx, ny)")

    def run(batches):
        for part in slices(batches, 4096):
            nx, ny = part.column(4).to_numpy(), part.column(5).to_numpy()
            yield part.select([0, 1]).filter(pa.array(7 * folded_distances(part.column(2), part.column(3)) <= nx + ny))

    return both.select("x", "y", "sx", "sy", "nx", "ny").mapInArrow(run, long_schema("x y"))


def verified(pairs: DataFrame, source: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sets are linked, by their exact intersection.

    The sets are computed again from one document of each class in question, so only those travel.
    """
    asked = pairs.select(F.explode(F.array("x", "y")).alias("class")).distinct()
    asked = written(asked.join(classes.select("class", "doc_id"), "class"), "asked")
    picked = asked.select(F.col("doc_id").alias("picked")).distinct()
    if asked.count() <= BROADCAST_IDS:
        picked = F.broadcast(picked)
    chosen = source.join(picked, F.col("doc_id").eqNullSafe(F.col("picked")), "left_semi")

    def run(batches):
        for part in slices(batches):
            found = [f for f in (shingles(t or "") for t in part.column(1).to_pylist()) if len(f)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_hash(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())],
                names=["class", "members"],
            )

    members = chosen.mapInArrow(run, "class long, members binary").join(asked.select("class"), "class", "left_semi")
    members = members.dropDuplicates(["class"])
    side = lambda name: members.select(F.col("class").alias(name), F.col("members").alias(f"m{name}"))
    members = written(members, "members")

    def test(batches):
        for part in slices(batches, 1024):
            linked = []
            for mx, my in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(mx, np.uint64), np.frombuffer(my, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * shared >= 75 * (len(a) + len(b) - shared))
            yield part.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "mx", "my")
    return both.mapInArrow(test, long_schema("x y"))


def groups_of(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first ``keys`` columns, which are whole numbers; rows come sorted by these."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        changes = np.zeros(table.num_rows - 1, bool)
        for k in range(keys):
            changes |= np.diff(table.column(k).to_numpy()) != 0
        edges = [0, *(np.flatnonzero(changes) + 1).tolist()]
        for start, end in zip(edges, edges[1:], strict=False):
            yield table.slice(start, end - start)
        held = table.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held


def may_be_linked(
    size: np.ndarray, root: np.ndarray, own: np.ndarray, sketches: list[bytes], first: int, second: int, forest: bool
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, one of block ``first`` and one of ``second``, in different components, whose sketches allow a link.

    With ``forest`` a pair that may be linked counts as linked from then on, so that each component of the rows is given
    by as many pairs as connect it, and only rows that are still apart are compared.
    """
    root, out = root.copy(), []
    left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
    words = np.array([len(x) // 8 for x in sketches])
    held = {w: np.frombuffer(b"".join([sketches[k] for k in np.flatnonzero(words == w)]), np.uint64).reshape(-1, w) for w in set(words.tolist())}
    row = np.empty(len(words), np.int64)
    for w in held:
        row[words == w] = np.arange((words == w).sum())
    for width in np.unique(words[left]).tolist():
        # linked sets differ in size by a third at most, so their sketches by one fold
        for other in {width // 2, width, 2 * width} & set(words[right].tolist()):
            some, pool = left[words[left] == width], right[words[right] == other]
            a, b = folded(held[width][row[some]], min(width, other)), folded(held[other][row[pool]], min(width, other))
            for k, mine in zip(some.tolist(), a, strict=True):
                at = np.flatnonzero((root[pool] != root[k]) & (3 * np.maximum(size[pool], size[k]) <= 4 * np.minimum(size[pool], size[k])))
                if not len(at):
                    continue
                distance = np.bitwise_count(b[at] ^ mine).sum(axis=1, dtype=np.int64)
                at = pool[at[7 * distance <= size[pool[at]] + size[k]]]
                if forest and len(at):
                    roots, one = np.unique(root[at], return_index=True)
                    at = at[one]
                    root[np.isin(root, roots)] = root[k]
                out.append((np.full(len(at), k), at))
    return out


def shared_signatures(chain: DataFrame) -> DataFrame:
    """``signature, class``: the signatures that three classes or more gave away, and these classes.

    ``chain`` has two rows or more for such a signature; of one with two classes, the one pair was compared before.
    """
    many = chain.groupBy("signature").agg(F.count("*").alias("links")).where("links >= 2").select("signature")
    both = F.explode(F.array("x", "y")).alias("class")
    return chain.join(many, "signature", "left_semi").select("signature", both).distinct()


def unconnected(shared: DataFrame, roots: DataFrame, classes: DataFrame, forest: bool) -> DataFrame:
    """Pairs of classes that gave away the same signature, lie in different components and may be linked: all of them, or
    with ``forest`` as many as would connect those of a block."""
    given = shared.join(roots, "class", "left").select("signature", "class", F.coalesce("root", "class").alias("root"))
    given = written(given, "given")
    # signatures of one component are done, and of those with the same classes one is enough
    groups = given.groupBy("signature").agg(
        F.min("root").alias("least"),
        F.max("root").alias("most"),
        F.count("*").alias("size"),
        F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("who"),
    )
    groups = groups.where("least <> most").groupBy("size", "who").agg(F.min("signature").alias("signature"))
    groups = written(groups.select("signature", F.ceil(F.col("size") / BLOCK).alias("blocks")), "open-groups")
    spread = (
        given.join(groups, "signature")
        .join(classes.select("class", "n_shingles", "sketch"), "class")
        .withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("first", F.least("own", "other"))
        .withColumn("second", F.greatest("own", "other"))
    )
    keys = ["signature", "first", "second"]
    ordered = spread.select(*keys, "class", "root", "own", "n_shingles", "sketch")
    ordered = ordered.repartition(*keys).sortWithinPartitions(*keys, "class")

    def compare(batches):
        for rows in groups_of(batches, 3):
            who, root, own, size = (rows.column(k).to_numpy() for k in range(3, 7))
            first, second = (rows.column(k)[0].as_py() for k in (1, 2))
            found = may_be_linked(size, root, own, rows.column(7).to_pylist(), first, second, forest)
            if found:
                a, b = who[np.concatenate([a for a, _ in found])], who[np.concatenate([b for _, b in found])]
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["x", "y"])

    return ordered.mapInArrow(compare, long_schema("x y")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the smallest id reachable over links, the row's own included."""
    spark = docs.sparkSession
    ship(spark)
    source = two_columns(docs, id_col, text_col)
    found = written(sets(source, frequent_signatures(source, source.count(), sample_docs)), "sets")
    classes = found.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    classes = written(classes, "classes")
    chain = written(neighbours(found), "chain")
    tried = written(near(chain.select("x", "y").distinct(), classes), "tried")
    links = written(verified(tried, source, classes), "links")
    roots = components(links, "x", "y")
    # once for all rounds, as every exchange of a plan weighs on the driver
    shared = written(shared_signatures(chain), "shared")
    for forest in [True] * FOREST_ROUNDS + [False]:
        rest = unconnected(shared, roots, classes, forest).join(tried, ["x", "y"], "left_anti")
        rest = written(rest, "tried-later")
        if not rest.limit(1).count():
            continue
        more = written(verified(rest, source, classes), "links-later")
        tried = tried.unionByName(rest)
        if more.limit(1).count():
            links = links.unionByName(more)
            roots = components(links, "x", "y")
    named = classes.select("class", F.col("doc_id").alias("least")).join(
        roots.withColumnRenamed("class", "member"), F.col("class") == F.col("member"), "left"
    )
    named = named.select("class", "least", F.coalesce("root", "class").alias("root"))
    named = written(named, "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("class", "component_id")
    return found.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
