"""Sparse solves by joins of cells: fill, tree and heights against brute force, solutions against numpy."""

import numpy as np
import pytest

from gramforge.operators import sparse
from gramforge.plans.frame import NOT_DEFINITE, REPLICATED, DenseWarning, matrix


def frame(spark, a, sharding="row_sharded", kind="double"):
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    return matrix(spark.createDataFrame(cells, f"i long, j long, v {kind}"), *a.shape, sharding)


def definite(seed, n, cells):
    g = np.random.default_rng(seed)
    a = np.zeros((n, n))
    for i, j in g.integers(0, n, (cells, 2)):
        a[i, j] = a[j, i] = g.normal()
    return a + np.diag(np.abs(a).sum(axis=1) + 1)


def brute_fill(a):
    """Elimination column after column on the pattern."""
    there = np.tril(a != 0, -1)
    for k in range(len(a)):
        below = np.flatnonzero(there[:, k])
        for x, j in enumerate(below):
            there[below[x + 1 :], j] = True
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(there), strict=True)}


@pytest.mark.parametrize("seed, n, cells", [(1, 10, 11), (2, 6, 14), (3, 5, 0)])
def test_fill_tree_and_solution(spark, seed, n, cells):
    a = definite(seed, n, cells)
    fill = brute_fill(a)
    upper = frame(spark, np.triu(a))
    found = sparse.symbolic_fill(upper).persist()
    assert {tuple(r) for r in found.collect()} == fill
    parents = {j: min(i for i, k in fill if k == j) for j in {j for _, j in fill}}
    assert dict(map(tuple, sparse.elimination_tree(found).collect())) == parents
    want = [0] * n
    for j in range(n):
        if j in parents:
            want[parents[j]] = max(want[parents[j]], want[j] + 1)
    level, top = sparse.heights(sparse.elimination_tree(found), n, sparse._Store(spark, "t"))
    assert dict(map(tuple, level.collect())) == dict(enumerate(want)) and top == max(want) + 1
    b = np.zeros((n, 2))
    b[:, 0], b[2, 1] = np.arange(n) + 1, 5
    x = np.full((n, 2), np.nan)
    for r in sparse.sparse_solve(upper, frame(spark, b, REPLICATED), check_symmetric=False).collect():
        assert r.status == 0 and np.isnan(x[r.i, r.j])
        x[r.i, r.j] = r.v
    assert np.allclose(x, np.linalg.solve(a, b))


def test_odd_matrices(spark, monkeypatch):
    one = frame(spark, np.ones((4, 1)), REPLICATED)
    a = definite(5, 4, 3)
    for change in ((2, 2, 0.0), (2, 2, -5.0), (1, 1, np.nan)):
        bad = a.copy()
        bad[change[0], change[1]] = change[2]
        got = sparse.sparse_solve(frame(spark, bad), one).collect()
        assert len(got) == 4 and {(r.status, np.isnan(r.v)) for r in got} == {(NOT_DEFINITE, True)}
    # a cell that stands twice counts as its sum; single precision stays
    twice = frame(spark, np.eye(4), kind="float")
    twice = twice.with_cells(twice.cells.unionByName(twice.cells))
    x = sparse.sparse_solve(twice, frame(spark, np.ones((4, 1)), REPLICATED, "float"))
    assert np.allclose([r.v for r in x.collect()], 0.5) and dict(x.dtypes)["v"] == "float"
    with pytest.raises(ValueError, match="not symmetric"):
        sparse.sparse_solve(frame(spark, np.triu(a) + np.diag([1.0] * 4) + np.eye(4, k=1)), one, check_symmetric=True)
    monkeypatch.setattr(sparse, "MANY_HEIGHTS", 1)
    with pytest.warns(DenseWarning, match="heights"):
        sparse.sparse_solve(frame(spark, np.eye(4) * 3 + np.eye(4, k=1)), one)
