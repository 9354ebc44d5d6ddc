"""Nearest neighbours and exact top-k against brute force."""

import numpy as np
import pytest

from tableload.llm import neighbours, topk


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, cell int")


def clustered(seed, n, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    return [(k, (centres[k % 12] + 0.6 * rng.standard_normal(width)).astype(np.float32).tolist()) for k in range(n)]


def test_recall_and_exact_scores(spark):
    rows = clustered(1, 3000)
    matrix = np.array([v for _, v in rows], float)
    found = {}
    for r in neighbours.nearest(frame_of(spark, rows).repartition(3), every=50, cell_rows=400).collect():
        found.setdefault(r.query_id, []).append(r)
    recalls = []
    for q in range(0, 3000, 50):
        distance = np.sqrt(((matrix - matrix[q]) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((np.arange(3000), distance)) if k != q][:10]
        got = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        assert all(r.score == pytest.approx(distance[r.vec_id], rel=1e-12) and r.vec_id != q for r in got)
        recalls.append(len({r.vec_id for r in got} & set(best)) / 10)
    assert np.mean(recalls) >= 0.9


def test_a_third_of_copies_and_a_dense_spot(spark, monkeypatch):
    """Copies are reduced before they are dealt, and no group of vectors or queries grows with a crowd in one place."""
    tables, groups = {}, []
    written, meet = neighbours.written, neighbours.meet
    monkeypatch.setattr(neighbours, "written", lambda df, label: tables.setdefault(label, written(df, label)))
    monkeypatch.setattr(neighbours, "meet", lambda *a: groups.append(meet(*a)) or groups[-1])
    rows = [(k, v) for k, v in clustered(5, 600)]
    rows += [(600 + k, [1.0 + k * 1e-6] * 24) for k in range(600)]  # distinct, but in one cell
    rows += [(1200 + k, [0.5] * 24) for k in range(600)]
    options = dict(every=10, cell_rows=50, sample_rows=64, query_rows=8)
    found = {}
    for r in neighbours.nearest(frame_of(spark, rows).repartition(5), **options).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 1800, 10)) and all(len(v) == 10 for v in found.values())
    copies = range(1200, 1800)
    for q in range(1200, 1800, 10):
        assert sorted(found[q]) == [(n + 1, k, 0.0) for n, k in enumerate([k for k in copies if k != q][:10])]
    assert tables["vectors"].count() == 1200 + 11 and tables["asked"].count() == 120 + 1
    for queries, held in groups:
        assert max(r["count"] for r in held.groupBy("cell", "part", "block").count().collect()) <= 2 * 50 * 1.5
        assert max(r["count"] for r in queries.groupBy("cell", "part", "block").count().collect()) <= 8 * 3


def test_repeated_ids_and_answers_by_broadcast(spark, monkeypatch):
    """Against all pairs of rows: ids with several vectors, rows repeated more than k times, and askers of one vector."""
    monkeypatch.setattr(neighbours, "OFTEN", 2)
    rng = np.random.default_rng(8)
    spots = rng.integers(-3, 4, (9, 3)).astype(float) + 0.5
    rows = [(int(i), spots[j].tolist()) for i, j in zip(rng.integers(0, 40, 300), rng.integers(0, 9, 300), strict=True)]
    rows += [(0, spots[0].tolist())] * 15
    found = {}
    for r in neighbours.nearest(frame_of(spark, rows), k=4, every=5, confidence=0.999999).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in {i for i, _ in rows if i % 5 == 0}:
        pairs = [(float(np.linalg.norm(np.subtract(v, w))), j) for i, v in rows if i == q for j, w in rows if j != q]
        assert sorted(found[q]) == [(n + 1, j, pytest.approx(d)) for n, (d, j) in enumerate(sorted(pairs)[:4])]


def test_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert neighbours.chi_square_quantile(0.99, 2) == pytest.approx(9.2103, abs=1e-3)


def test_tree_cells_hold_their_points():
    points = np.random.default_rng(3).standard_normal((500, 4))
    tree = neighbours.Tree(points, 4)
    cells = tree.cells(points)
    for p, c in zip(points, cells):
        assert (tree.low[c] <= p).all() and (p <= tree.high[c]).all() and c in tree.near(p, 0.0)


ODD = [
    (0, [1.0, 0.0]),
    (100, [1.0, 0.0]),
    (1, [1.0, 0.0]),
    (2, [0.0, 1.0]),
    (3, None),
    (4, [0.0, 0.0]),
    (5, [float("nan"), 1.0]),
    (6, [float("inf"), 1.0]),
    (7, [None, 1.0]),
    (8, [1.0, 2.0, 3.0]),
    (9, []),
    (None, [1.0, 1.0]),
    (2, [0.0, 1.0]),
]


def test_odd_vectors(spark):
    found = {}
    for r in neighbours.nearest(frame_of(spark, ODD)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    root = pytest.approx(2**0.5)
    assert {q: sorted(v) for q, v in found.items()} == {
        0: [(1, 1, 0.0), (2, 100, 0.0), (3, 2, root), (4, 2, root)],
        100: [(1, 0, 0.0), (2, 1, 0.0), (3, 2, root), (4, 2, root)],
    }
    found = {}
    for r in topk.top_k(frame_of(spark, ODD)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(v) for q, v in found.items()} == {
        0: [(1, 1, 4096), (2, 100, 4096), (3, 2, 0), (4, 2, 0), (5, 4, 0)],
        100: [(1, 0, 4096), (2, 1, 4096), (3, 2, 0), (4, 2, 0), (5, 4, 0)],
    }


def test_empty_tables(spark):
    assert neighbours.nearest(frame_of(spark, [])).count() == 0
    assert topk.top_k(frame_of(spark, [])).count() == 0
    assert topk.top_k(frame_of(spark, [(0, [1.0])])).count() == 0
    assert neighbours.nearest(frame_of(spark, [(0, [1.0])])).count() == 0


@pytest.mark.parametrize("factor", [1.0, 3000.0, 2.0**31])
def test_top_k_is_exact(spark, factor):
    rows = [(k, [x * factor for x in v]) for k, v in clustered(2, 900)]
    rows += [(900 + k, v) for k, (_, v) in enumerate(rows[:60])]  # ties
    whole = np.floor(64 * np.array([np.float32(v) for _, v in rows], float)).astype(object)
    whole = np.array([[int(x) for x in v] for v in whole], object)
    options = dict(query_rows=10, index_rows=100, group_rows=300)
    found = {}
    for r in topk.top_k(frame_of(spark, rows), every=60, **options).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 960, 60):
        scores = whole @ whole[q]
        best = sorted((k for k in range(960) if k != q), key=lambda k: (-scores[k], k))[:20]
        if factor < 1e9:
            assert sorted(found[q]) == [(n + 1, k, scores[k]) for n, k in enumerate(best)]
        else:
            assert len(found[q]) == 20


def test_segments_add_up():
    values = np.random.default_rng(1).integers(-90, 90, (50, 16))
    index = topk.ImpactIndex(np.arange(50), values)
    assert (sum(index.segments) == values).all() and len(index.segments) > 2
    for k, left in enumerate(index.left):
        rest = values - sum(index.segments[: k + 1])
        assert np.allclose(left, np.sqrt((rest**2).sum(axis=1)))
