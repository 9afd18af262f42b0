"""Products: one meaning by cells, by tiles and by a broadcast vector."""

import numpy as np
import pytest

from gramforge.operators import cells as C
from gramforge.operators import tiled, vectors
from gramforge.plans.frame import matrix

KIND = {"float32": "float", "float64": "double", "complex64": "struct<re:float,im:float>", "complex128": "struct<re:double,im:double>"}


def frame(spark, cells, rows, cols, dtype="float64"):
    made = [(int(i), int(j), (float(np.real(v)), float(np.imag(v))) if dtype.startswith("complex") else float(np.real(v))) for i, j, v in cells]
    return matrix(spark.createDataFrame(made, f"i long, j long, v {KIND[dtype]}"), rows, cols)


def brute(a, b):
    """Sums over pairs of cells, as text of rounded numbers."""
    one = lambda cells: {k: sum(v for i, j, v in cells if (i, j) == k) for k in {(i, j) for i, j, _ in cells}}
    out = {}
    for (i, k), x in one(a).items():
        for (l, j), y in one(b).items():
            if k == l:
                out[i, j] = out.get((i, j), 0) + x * y
    return out


def found(m):
    rows = m.cells.collect()
    assert len({(r.i, r.j) for r in rows}) == len(rows)
    return {(r.i, r.j): complex(r.v["re"], r.v["im"]) if isinstance(r.v, tuple) else r.v for r in rows}


def same(got, want, tolerance=1e-9):
    assert set(got) == set(want)
    for k, v in want.items():
        assert np.isclose(complex(got[k]), complex(v), rtol=tolerance, atol=tolerance, equal_nan=True) or not np.isfinite(v) and not np.isfinite(got[k])


@pytest.mark.parametrize("dtype", ["float64", "complex128", "float32", "complex64"])
@pytest.mark.parametrize("way", ["cells", "tiles", "vector", "joined"])
def test_one_meaning(spark, monkeypatch, way, dtype):
    """Sparse cells with repeats, NaN, infinity and explicit zeros; edges that aren't whole tiles."""
    g = np.random.default_rng(1)
    number = lambda: complex(g.normal(), g.normal()) if dtype.startswith("complex") else float(g.normal())
    a = [(int(g.integers(9)), int(g.integers(7)), number()) for _ in range(25)] + [(0, 0, float("nan")), (1, 1, float("inf")), (2, 3, 0.0), (2, 3, 0.0)]
    b = [(int(g.integers(7)), int(g.integers(5)), number()) for _ in range(14)] + [(6, 4, float("nan")), (3, 2, 0.0)]
    x, y = frame(spark, a, 9, 7, dtype), frame(spark, b, 7, 5, dtype)
    if way == "tiles":
        got = tiled.tile_product(x, y, 4)
    elif way == "cells":
        got = C.matmul(x, y)
    else:
        if way == "joined":
            monkeypatch.setattr(vectors, "VECTOR_BYTES", 0)
        got = vectors.matvec(x, y)
    assert got.dtype == dtype and (got.rows, got.cols) == (9, 5)
    same(found(got), brute(a, b), 1e-4 if dtype in ("float32", "complex64") else 1e-9)


def test_both_sides_of_the_switch(spark, monkeypatch):
    """The same cells on both sides; the way is chosen by counted cells, not by the shapes."""
    ways = []
    real = tiled.tile_product
    monkeypatch.setattr(tiled, "tile_product", lambda *x: ways.append(x[2]) or real(*x))
    monkeypatch.setattr(tiled, "TILE", 8)
    g = np.random.default_rng(2)
    a = [(i, j, float(g.normal())) for i in range(12) for j in range(12)] + [(3, 3, float("nan")), (4, 4, 1.0)]
    x = frame(spark, a, 12, 12)
    want = found(C.matmul(x, x))
    assert not ways
    monkeypatch.setattr(C, "MOST_PRODUCTS", 100)
    same(found(C.matmul(x, x)), want)
    assert ways == [8]
    # a diagonal matrix of many rows stays a diagonal one, and goes by cells where tiles would be nearly empty
    d = C.diag(spark, 3000, C.F.col("i").cast("double"))
    assert C.matmul(d, d).cells.count() == 3000 and ways == [8, 8]
    monkeypatch.setattr(tiled, "TILE", 64)
    assert C.matmul(d, d).cells.count() == 3000 and ways == [8, 8]


def test_repeated_cells_are_summed_everywhere(spark):
    twice = frame(spark, [(i, i, 1.0) for i in range(5)] * 2, 5, 5)
    one = matrix(C.eye(spark, 5).cells.filter("i = 0").unionByName(C.eye(spark, 5).cells.filter("i > 0").withColumn("j", C.F.lit(0).cast("long"))), 5, 1, "replicated")
    assert np.allclose([r.v for r in tiled.chol_solve(twice, one, 2).collect()], 0.5)


@pytest.mark.parametrize("passes", ["one", "many", "joined"])
def test_no_pairs_of_tiles(spark, monkeypatch, passes):
    """Tiles of the left side are dealt out once and meet a broadcast right side, in one pass or in several; rows of the product are summed
    where it is made. Sparse cells with NaN and edges; an inner dimension narrower than a tile."""
    monkeypatch.setattr(tiled, "PANEL_BYTES", {"one": 1 << 20, "many": 3 * 4 * 8, "joined": 0}[passes])
    g = np.random.default_rng(6)
    a = [(i, j, float(g.normal())) for i in range(11) for j in range(3) if g.random() < 0.8] + [(10, 1, float("nan"))]
    b = [(j, i, float(g.normal())) for i in range(9) for j in range(3) if g.random() < 0.8]
    x, y = frame(spark, a, 11, 3), frame(spark, b, 3, 9)
    want = brute(a, b)
    product = tiled.tile_product(x, y, 4)
    same(found(product), want)
    plan = product.cells._jdf.queryExecution().executedPlan().toString()
    assert ("Join" in plan) == (passes == "joined")
    rows = {r.i: r for r in tiled.product_rows(x, y, 4).collect()}
    assert set(rows) == {i for i, _ in want}
    for i, r in rows.items():
        v = np.array([want[k] for k in want if k[0] == i])
        assert r.cells == len(v) and np.allclose([r.total, r.squares], [v.sum(), (v * v).sum()], equal_nan=True)


def test_tasks_grow_with_products(spark, monkeypatch):
    """Where many cells meet, join and sums have a task for each TASK_PRODUCTS of them, not the session's number."""
    g = np.random.default_rng(8)
    a = [(int(g.integers(30)), int(g.integers(6)), float(g.normal())) for _ in range(60)]
    x, y = frame(spark, a, 30, 6), frame(spark, [(j, i, v) for i, j, v in a], 6, 30)
    monkeypatch.setattr(C, "MOST_PRODUCTS", 10)
    monkeypatch.setattr(C, "SPARSE", 0)
    monkeypatch.setattr(C, "TASK_PRODUCTS", 50)
    product = C.matmul(x, y)
    plan = product.cells._jdf.queryExecution().executedPlan().toString()
    tasks = int(C._products(x, y) / 50) + 1
    assert tasks > 4 and plan.count(f", {tasks}), REPARTITION_BY_NUM") == 3 and "Broadcast" not in plan
    same(found(product), brute(a, [(j, i, v) for i, j, v in a]))
