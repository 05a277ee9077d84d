import numpy as np
import pytest

from salesmart.llm import embeddings as e

DDL = "vec_id long, embedding array<float>, label int"


def rows_of(rng, n=400, dim=16, clusters=25, labels=3, noise=0.2):
    centres = rng.standard_normal((clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + noise * rng.standard_normal((n, dim))
    return [(k, [float(v) for v in np.float32(row)], int(k % labels)) for k, row in enumerate(x)]


def brute(rows):
    links = {}
    for i, x, a in rows:
        links[i] = {
            j for j, y, b in rows
            if i != j and a == b and np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= e.THRESHOLD
        }
    return links


def check(found, rows, least=0.9):
    want = brute(rows)
    got = {r.vec_id: r for r in found}
    assert len(found) == len(rows)
    # None below the threshold, and nearly all above it.
    assert all(got[i].n_links <= len(want[i]) for i in want)
    assert sum(r.n_links for r in found) >= least * sum(map(len, want.values()))
    return want, got


def test_against_brute_force(spark):
    rows = rows_of(np.random.default_rng(1))
    want, got = check(e.near_duplicates(spark.createDataFrame(rows, DDL)).collect(), rows, 1.0)
    for i, near in want.items():
        assert all(got[i].component_id == got[j].component_id for j in near)
        assert got[i].kept == (got[i].component_id == i)


@pytest.mark.parametrize("noise", [0.2, 0.02])
def test_recall_where_nodes_are_split_between_tasks(spark, noise):
    """Also with dense clusters larger than a subtree, which are compared in chunks."""
    rows = rows_of(np.random.default_rng(2), n=500, clusters=4, labels=1, noise=noise)
    frame = spark.createDataFrame(rows, DDL)
    check(e.near_duplicates(frame, trees=4, subtree=60).collect(), rows)


def test_trees_are_added_where_vectors_hardly_spread(spark, monkeypatch):
    """Vectors of a mean cosine of about 0.8, of which one tree misses many links."""
    monkeypatch.setattr(e, "LEAF", 20)
    rng = np.random.default_rng(5)
    x = rng.standard_normal(32) + 0.5 * rng.standard_normal((1000, 32))
    x = np.concatenate([x, x + 0.4 * rng.standard_normal(x.shape)])
    rows = [(k, [float(v) for v in np.float32(row)], 1) for k, row in enumerate(x)]
    frame = spark.createDataFrame(rows, DDL)
    u = e._unit(np.float32(x).astype(np.float64))
    want = (u @ u.T >= e.THRESHOLD).sum() - len(u)
    classes = frame.selectExpr("vec_id AS id", "label", "embedding", "1L AS n")
    assert 2 * e.pairs(classes, trees=1).count() < 0.9 * want
    got = e.near_duplicates(frame, trees=1).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * want <= got <= want


def test_leaves_overlap_and_cover(monkeypatch):
    monkeypatch.setattr(e, "LEAF", 50)
    u = e._unit(np.random.default_rng(3).standard_normal((1000, 32)))
    found = list(e.leaves(u, np.random.default_rng(4), 0.93))
    assert set(np.concatenate(found)) == set(range(1000))
    assert sum(map(len, found)) > 1500 and max(map(len, found)) <= 50


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2),
        (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, None], 1),
        (8, [nan, 0.0], 1), (9, [inf, 0.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1),
        (None, [1.0, 0.0], 1), (None, None, None), (1, [1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS node", "2 AS id", "3 AS k")
    found = e.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    for r in found:
        linked = r.vec_id in (0, 1, 2)
        if r.vec_id is not None:
            assert (r.n_links, r.component_id) == ((4, 0) if linked else (0, r.vec_id))
            assert r.kept == (r.component_id == r.vec_id)
    nulls = sorted((r.n_links, r.component_id is None) for r in found if r.vec_id is None)
    assert nulls == [(0, True), (4, False)]
    assert e.near_duplicates(frame.limit(0)).count() == 0
