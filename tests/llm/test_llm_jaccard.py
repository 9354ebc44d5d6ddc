"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tableload.llm import components, jaccard


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def all_pairs(rows):
    """doc_id -> (set size, smallest id reachable)."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            shared = len(x & y)
            if x and y and 100 * shared >= 75 * (len(x) + len(y) - shared):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, docs=120):
    """Copies, near copies on both sides of the limit, chains, shared passages and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    passage = [word() for _ in range(25)]
    made = [[word() for _ in range(rng.choice([1, 3, 5, 6, 8, 20, 60, 150]))] for _ in range(docs // 3)]
    while len(made) < docs:
        base = list(rng.choice(made))
        kind = rng.random()
        if kind < 0.6:  # some words changed, so that the similarity lies around the limit
            for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, len(base) // 35)])):
                base[rng.randrange(len(base))] = word()
        elif kind < 0.8:
            base = base[: max(1, int(len(base) * rng.uniform(0.7, 1)))]
        else:
            base = passage + [word() for _ in range(rng.choice([2, 5, 10, 40]))]
        made.append(base)
    return [(k, " ".join(w)) for k, w in enumerate(made)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "FREQUENT", 2 + seed)
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame).collect()}
    assert found == all_pairs(rows)


def test_shuffled_pick_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rows = corpus(7, 60)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame).collect()}
    assert found == all_pairs(rows)


def test_linked_sets_always_share_a_signature():
    """Over sizes, similarities just above the limit, and any order of the blocks."""
    rng = np.random.default_rng(4)
    for trial in range(400):
        a = int(rng.integers(1, 400))
        pool = rng.integers(0, 2**63, 3 * a, dtype=np.uint64)
        best = None
        for extra in range(a):  # the largest difference that is still linked, split at random between the sides
            left = int(rng.integers(0, extra + 1))
            x, y = pool[: a - left], np.concatenate([pool[left : a - left], pool[a : a + extra - left]])
            x, y = np.unique(x), np.unique(y)
            shared = len(np.intersect1d(x, y))
            if len(x) and len(y) and 100 * shared >= 75 * (len(x) + len(y) - shared):
                best = x, y
        if best is None:
            continue
        x, y = best
        frequent = np.sort(rng.permutation(np.concatenate([jaccard.block_signatures(x, b)[0] for b, _ in jaccard.bands(len(x))]))[: trial % 50])
        assert len(np.intersect1d(jaccard.join_signatures(x, frequent), jaccard.join_signatures(y, frequent)))
        assert 7 * jaccard.folded_distance(jaccard.folded_sketch(x), jaccard.folded_sketch(y)) <= len(x) + len(y)


def test_sketch_distance_is_at_most_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(100):
        x = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64))
        y = np.unique(rng.permutation(np.concatenate([x[: len(x) // 2], rng.integers(0, 2**63, int(rng.integers(1, 200)), dtype=np.uint64)])))
        assert jaccard.folded_distance(jaccard.folded_sketch(x), jaccard.folded_sketch(y)) <= len(np.setxor1d(x, y))


def test_edge_cases(edge, nothing):
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(edge).collect()]
    assert len(rows) == edge.count()
    assert rows.count((1, 5, 1)) == 2 and (2**40, 5, 1) in rows
    assert (2, 0, 2) in rows and (3, 0, 3) in rows and (4, 0, 4) in rows
    assert (7, 1, 7) in rows and (8, 1, 7) in rows
    assert (None, 4, None) in rows
    assert {c for i, _, c in rows if i in (5, 6)} == {5}
    assert jaccard.near_duplicates(nothing).count() == 0


def test_a_large_group_is_linear(spark):
    """A thousand near copies: the compared pairs stay near their number."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(1000):
        words = list(base)
        words[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    source = jaccard.two_columns(frame, "doc_id", "text")
    pairs = jaccard.neighbours(jaccard.sets(source, np.empty(0, np.uint64))).select("x", "y").distinct().count()
    assert pairs < 30_000
    assert {r.component_id for r in jaccard.near_duplicates(frame).collect()} == {0}


def test_copies_give_signatures_away_once_per_task(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(k, text if k % 3 == 0 else f"{k} {text[k % 50 :]}") for k in range(600)]
    source = jaccard.two_columns(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    given = jaccard.given_away(jaccard.sets(source, np.empty(0, np.uint64)))
    assert max(r["count"] for r in given.groupBy("signature", "y").count().collect()) <= 3


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(3, 3)]
    found = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b")
    roots = {r["class"]: r.root for r in found.collect()}
    assert {roots.get(k, k) for k in range(100, 141)} == {100}
    assert {roots.get(k, k) for k in [7, *range(200, 260)]} == {7}


def test_a_long_chain_takes_few_steps(spark, monkeypatch):
    """Tasks contract their links first, so that the steps, each of them several jobs, don't grow with the chain."""
    written, steps = components.written, []
    monkeypatch.setattr(components, "written", lambda df, label: steps.append(label) or written(df, label))
    links = [(k, k + 1) for k in range(3_000)] + [(5_000, 5_000)]
    random.Random(1).shuffle(links)
    found = components.components(spark.createDataFrame(links, "a long, b long").repartition(3), "a", "b")
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(1, 3_001)]
    assert steps.count("stars") <= 4


def test_few_links_take_no_step(spark, monkeypatch):
    """What a step costs is the driver's memory, not the links; beyond ``RUN`` links there are steps as before."""
    written, steps = components.written, []
    monkeypatch.setattr(components, "written", lambda df, label: steps.append(label) or written(df, label))
    links = spark.createDataFrame([(k, k + 3) for k in range(90)], "a long, b long").repartition(5)
    for run in (90, 3):
        monkeypatch.setattr(components, "RUN", run)
        steps.clear()
        found = components.components(links, "a", "b")
        assert sorted(map(tuple, found.collect())) == [(k, k % 3) for k in range(3, 93)]
        assert ("stars" in steps) == (run == 3)


@pytest.mark.parametrize("run", [3, 10_000])
def test_contracted_links_connect_the_same(spark, run, monkeypatch):
    monkeypatch.setattr(components, "RUN", run)
    rng = random.Random(run)
    links = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)]
    root = {x: x for link in links for x in link}
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    u, v = components.contracted(*np.array(links).T)
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {x: r for x, r in root.items() if x != r}
    batches = [pa.RecordBatch.from_pylist([{"u": a, "v": b} for a, b in links[k : k + 7]]) for k in range(0, len(links), 7)]
    kept = [(r["u"], r["v"]) for b in components._contract(batches) for r in b.to_pylist()]
    found = components.components(spark.createDataFrame(kept, "a long, b long"), "a", "b")
    assert dict(map(tuple, found.collect())) == {x: r for x, r in root.items() if x != r}


def test_sketches_are_compared_as_matrices():
    rng = np.random.default_rng(2)
    sketches = [rng.integers(0, 2**63, 1 << int(rng.integers(0, 5)), dtype=np.uint64) for _ in range(80)]
    wanted = []
    for x, y in zip(sketches[:40], sketches[40:], strict=True):
        width = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(z.reshape(-1, width), axis=0) for z in (x, y))
        wanted.append(int(np.bitwise_count(x ^ y).sum()))
    a, b = (pa.array([x.tobytes() for x in some]) for some in (sketches[:40], sketches[40:]))
    assert jaccard.folded_distances(a, b).tolist() == wanted
    assert jaccard.folded_distances(a.slice(7, 20), b.slice(7, 20)).tolist() == wanted[7:27]
    assert jaccard.folded_distances(a.slice(0, 0), b.slice(0, 0)).tolist() == []


def test_blocks_give_a_forest_of_what_may_be_linked():
    """As many pairs as connect the rows, whose ends may be linked; without ``forest`` all such pairs."""
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 2**63, 300).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([base[k % 4][: 300 - k % 9], rng.integers(0, 2**63, k % 7).astype(np.uint64)])) for k in range(240)]
    sketches, size = [jaccard.folded_sketch(s) for s in sets], np.array([len(s) for s in sets])
    own, root = np.arange(240) % 2, np.arange(240)
    root[:8] = 0  # connected before
    pairs = lambda forest: {
        (min(a, b), max(a, b))
        for first, second in ((0, 0), (0, 1), (1, 1))
        for x, y in jaccard.may_be_linked(size, root, own, sketches, first, second, forest)
        for a, b in zip(x.tolist(), y.tolist(), strict=True)
    }
    every, few = pairs(False), pairs(True)
    wanted = {
        (a, b)
        for a in range(240)
        for b in range(a + 1, 240)
        if root[a] != root[b]
        and 3 * max(size[a], size[b]) <= 4 * min(size[a], size[b])
        and 7 * jaccard.folded_distance(sketches[a], sketches[b]) <= size[a] + size[b]
    }
    assert every == wanted and few <= every and len(few) < 3 * 240 < len(every)

    def parts(links):
        of = list(root)
        for a, b in links:
            of = [of[b] if x == of[a] else x for x in of]
        return len(set(of))

    assert parts(few) == parts(every)


def test_groups_of_rows_over_batches():
    rows = [(k // 7, k // 3, k) for k in range(100)]
    table = pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["a", "b", "c"])
    for size in (1, 5, 100):
        groups = list(jaccard.groups_of(table.to_batches(max_chunksize=size), 2))
        assert [g.column(2).to_pylist() for g in groups] == [
            [r[2] for r in rows if r[:2] == key] for key in sorted({r[:2] for r in rows})
        ]
    assert list(jaccard.groups_of([], 2)) == []


def test_near_copies_that_are_partly_linked(spark):
    """Two thousand copies in which every fifth word or so changed, neighbours rarely linked: a few pairs each."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(2000):
        words = list(base)
        at = rng.randrange(120)
        for j in range(rng.randint(1, 14)):
            words[(at + j) % 120] = f"x{k % 40}-{j}"
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    emitted = []
    verified = jaccard.verified
    jaccard.verified = lambda pairs, *rest: emitted.append(pairs.count()) or verified(pairs, *rest)
    try:
        found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame).collect()}
    finally:
        jaccard.verified = verified
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in rows[:300]}
    for i in range(0, 300, 7):
        for j in range(300):
            if i != j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                assert found[i] == found[j]
    assert sum(emitted[1:]) < 20 * len(rows)


def test_rounds_share_the_signatures_of_many_classes(spark, monkeypatch):
    """They are read off the chain once: every exchange of a plan costs the driver memory, also where data is small."""
    written, plans = jaccard.written, []
    monkeypatch.setattr(jaccard, "written", lambda df, label: plans.append((label, df)) or written(df, label))
    rows = corpus(5)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [label for label, df in plans if any("llm-chain" in f for f in df.inputFiles())] == ["tried", "shared"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == all_pairs(rows)
