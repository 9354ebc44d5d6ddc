import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tableload.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<double>, label string, code string, part string"


def by_hand(rows, parts, entries, rounds, scale):
    """Plain loops over Python integers."""
    whole = [(i, [int(np.floor(x * scale)) for x in e], label) for i, e, label in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    sizes = Counter(len(e) for _, e, _ in whole)
    length = min(sizes, key=lambda n: (-sizes[n], n)) if sizes else 0
    whole = [r for r in whole if len(r[1]) == length]
    each = [length // parts + (k < length % parts) for k in range(parts)]
    spans = [(sum(each[:k]), sum(each[: k + 1])) for k in range(parts)]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in spans]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for (a, b), book in zip(spans, books, strict=True):
            held = {}
            for _, e, _ in whole:
                held.setdefault(nearest(e[a:b], book)[1], []).append(e[a:b])
            for k, some in held.items():
                book[k] = [sum(column) // len(some) for column in zip(*some, strict=True)]
    out, labels = [], Counter()
    for i, e, label in whole:
        found = [nearest(e[a:b], book) for (a, b), book in zip(spans, books, strict=True)]
        error = sum(d for d, _ in found)
        labels[label] += error
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), error))
    said = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, code, error, labels[label], said) for i, label, code, error in out), key=str)


def vectors(seed, n, length):
    rng = random.Random(seed)
    value = lambda: rng.choice([rng.gauss(0, 0.2), round(rng.gauss(0, 0.2), 1), 0.25, -0.25])
    rows = [(k, [value() for _ in range(length)], rng.choice(["a", "b", None])) for k in range(n)]
    return rows + [(k, rows[3][1], "c") for k in range(n, n + n // 3)]


ODD = [
    (500, None, "a"),
    (501, [], "a"),
    (502, [0.1] * 15 + [None], "a"),
    (503, [0.1] * 15 + [float("nan")], None),
    (504, [0.1] * 15 + [float("inf")], "b"),
    (505, [0.1] * 3, "b"),
    (None, [0.5] * 16, "b"),
    (2, [-0.5] * 16, "b"),
    (2, [-0.5] * 16, "b"),
    (506, [0.0] * 16, None),
    (507, [32_767.9] * 16, "far"),
]


def coded(spark, rows, **options):
    data = [(*r, "clash", "clash") for r in rows]
    found = v.vector_codes(spark.createDataFrame(data, SCHEMA).repartition(3), **options)
    return sorted(map(tuple, found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize(
    "rows, parts, entries, rounds",
    [(vectors(1, 90, 16) + ODD, 8, 16, 6), (vectors(2, 60, 10), 4, 5, 3), (vectors(3, 6, 16), 8, 16, 6), (vectors(4, 30, 8), 1, 3, 0)],
    ids=["odd rows", "uneven parts", "few rows", "no rounds"],
)
def test_codes_equal_those_by_hand(spark, rows, parts, entries, rounds):
    found = coded(spark, rows, parts=parts, entries=entries, rounds=rounds)
    assert found == by_hand(rows, parts, entries, rounds, 4096)


def test_what_cannot_be_coded(spark):
    assert coded(spark, []) == [] and coded(spark, ODD[:5]) == []
    with pytest.raises(Exception, match="cannot be coded"):
        coded(spark, [(1, [1e6] * 16, "a")])
    with pytest.raises(ValueError, match="hex digits"):
        coded(spark, [], entries=257)


def test_prefixes_are_added_up_once():
    rng = np.random.default_rng(5)
    leaves = np.unique(rng.integers(-2, 3, (400, 6)), axis=0)
    entries = rng.integers(-3, 4, (7, 6))
    wanted = ((leaves[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (v.prefix_distances(leaves, entries) == wanted).all()
    shuffled = leaves[rng.permutation(len(leaves))][rng.integers(0, len(leaves), 900)]
    index, distance = v.nearest_entries(shuffled, entries)
    plain = ((shuffled[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
