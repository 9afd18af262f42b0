"""Tiles that stay where they are: plans without a shuffle, tiles without cells, the inverse's products, failed minors, symmetry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramforge.operators import eigen, tiled
from gramforge.plans.frame import NOT_DEFINITE, REPLICATED, matrix


def frame(spark, a, sharding="row_sharded"):
    complex_ = np.iscomplexobj(a)
    cells = [(int(i), int(j), (float(a[i, j].real), float(a[i, j].imag)) if complex_ else float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    return matrix(spark.createDataFrame(cells, f"i long, j long, v {'struct<re:double,im:double>' if complex_ else 'double'}"), *a.shape, sharding)


def dense(df, n, m):
    x = np.full((n, m), np.nan + 0j)
    for r in df.collect():
        assert np.isnan(x[r.i, r.j])
        x[r.i, r.j] = complex(r.v["re"], r.v["im"]) if isinstance(r.v, tuple) else r.v
    return x


def definite(n, complex_=False):
    g = np.random.default_rng(n)
    a = g.standard_normal((n, n)) + (1j * g.standard_normal((n, n)) if complex_ else 0)
    a = a @ a.conj().T
    return (a + a.conj().T) / 2 + np.eye(n)


def test_steps_shuffle_nothing(spark, monkeypatch):
    """What is written in each step: no exchange in its plan, and one task for each bucket at most."""
    plans = []
    real = tiled.Placed.put

    def put(self, tiles, kind, dealt=True):
        if dealt:
            with self.whole_buckets():
                plans.append(tiles._jdf.queryExecution().executedPlan().toString())
        real(self, tiles, kind, dealt)

    monkeypatch.setattr(tiled.Placed, "put", put)
    a, b = definite(23), np.ones((23, 2))
    x = tiled.chol_solve(frame(spark, a), frame(spark, b, REPLICATED), 5)
    assert np.allclose(dense(x, 23, 2), np.linalg.solve(a, b))
    assert len(plans) == 10 and all("Exchange" not in p and "Bucketed: true" in p for p in plans)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gramforge_solve")]


def test_tiles_without_cells_are_not_made(spark, monkeypatch):
    """A block diagonal matrix has no tile of U beside its blocks, and one right-hand side no solution in most of them."""
    kept = []
    real = tiled.Placed.remove
    monkeypatch.setattr(tiled.Placed, "remove", lambda self: (kept.append(self.read().groupBy("kind").count().collect()), real(self)))
    a = np.kron(np.eye(4), definite(3))
    b = np.zeros((12, 1))
    b[4] = 1
    x = tiled.chol_solve(frame(spark, a), frame(spark, b, REPLICATED), 3)
    assert np.allclose(dense(x, 12, 1), np.linalg.solve(a, b))
    assert {r["kind"]: r["count"] for r in kept[0]} == {tiled.Placed.A: 5, tiled.Placed.U: 1, tiled.Placed.X: 1}


@pytest.mark.parametrize("n, tile, complex_", [(11, 3, False), (30, 3, True), (5, 7, False)])
def test_inverse_from_the_factor(spark, n, tile, complex_):
    a = definite(n, complex_)
    full = tiled.spd_inverse(frame(spark, np.triu(a)), tile)
    assert np.allclose(dense(full, n, n), np.linalg.inv(a))
    upper = tiled.spd_inverse(frame(spark, np.triu(a)), tile, "upper")
    assert upper.count() == n * (n + 1) // 2 and upper.filter("j < i").count() == 0


def test_products_of_the_inverse(spark):
    """nb (nb + 1) (nb + 2) / 6 products of tiles, where a solve with n right-hand sides takes nb^3 and more."""
    nb, tile = 10, 2
    v = np.triu(np.random.default_rng(1).standard_normal((nb * tile, nb * tile)))
    rows = [(i, j, np.ascontiguousarray(v[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]).tobytes()) for i in range(nb) for j in range(i, nb)]
    tiles = spark.createDataFrame(rows, tiled.SCHEMA)
    out = tiled.upper_square(tiles, nb, tile, np.dtype("<f8"))
    got = np.zeros_like(v)
    for r in out.collect():
        got[r.bi * tile : (r.bi + 1) * tile, r.bj * tile : (r.bj + 1) * tile] = np.frombuffer(r.data).reshape(tile, tile)
    want = v @ v.T
    keep = np.kron(np.triu(np.ones((nb, nb))), np.ones((tile, tile))) > 0
    assert np.allclose(got[keep], want[keep]) and not got[~keep].any()
    # every pair of tiles of one block column meets once
    pairs = tiles.alias("l").join(tiles.alias("r"), F.expr("l.bj = r.bj and l.bi <= r.bi")).count()
    assert pairs == nb * (nb + 1) * (nb + 2) // 6


@pytest.mark.parametrize("tile", [2, 5, 16])
@pytest.mark.parametrize("bad", [0, 4, 8])
def test_failed_minor(spark, tile, bad):
    a = definite(9)
    a[bad, bad] -= 1000
    first = next(k for k in range(1, 10) if np.linalg.eigvalsh(a[:k, :k])[0] <= 0)
    x = tiled.chol_solve(frame(spark, a), frame(spark, np.ones((9, 1)), REPLICATED), tile, failed_minor=True).collect()
    assert {(r.status, r.failed_minor, np.isnan(r.v)) for r in x} == {(NOT_DEFINITE, first, True)} and len(x) == 9


def test_failed_minor_of_others(spark):
    a = definite(4)
    good = tiled.spd_inverse(frame(spark, a), 3, failed_minor=True).collect()
    assert {(r.status, r.failed_minor) for r in good} == {(0, None)}
    a[2, 2] = np.nan
    assert {r.failed_minor for r in tiled.spd_inverse(frame(spark, a), 3, "upper", failed_minor=True).collect()} == {3}


@pytest.mark.parametrize("complex_", [False, True])
def test_asymmetric_cells(spark, complex_):
    a = definite(9, complex_)
    a[np.abs(a) < 0.5] = 0
    assert tiled.asymmetric_cells(frame(spark, a), 4).count() == 0
    tiled.check_symmetry(frame(spark, a))
    changed = a.copy()
    changed[7, 2] += 1
    changed[3, 8] = 0 if changed[3, 8] else 2
    if complex_:
        changed[5, 5] += 1j
    want = {(2, 7), (3, 8)} | ({(5, 5)} if complex_ else set())
    m = frame(spark, changed)
    assert {tuple(r) for r in tiled.asymmetric_cells(m, 4).collect()} == want
    for run in (lambda: tiled.chol_solve(m, frame(spark, changed[:, :1], REPLICATED), 4, check_symmetric=True), lambda: tiled.spd_inverse(m, 4, check_symmetric=True), lambda: eigen.sym_eigen(m, check_symmetric=True)):
        with pytest.raises(ValueError, match=r"not symmetric: \d places differ, the first is \(2, 7\)"):
            run()
    # a cell that stands twice on one side counts as its sum, a zero as no cell, either zero as one
    if not complex_:
        rows = [(0, 1, 1.0), (0, 1, 2.0), (1, 0, 3.0), (2, 0, 0.0), (1, 2, -0.0), (2, 2, 5.0)]
        assert tiled.asymmetric_cells(matrix(spark.createDataFrame(rows, "i long, j long, v double"), 3)).count() == 0
