"""Matrices that fall apart: rows alone, small components and large ones, which stand between one another."""

import pathlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramforge.functions import layout
from gramforge.operators import apart, eigen, tiled
from gramforge.operators import cells as C
from gramforge.plans.frame import NOT_DEFINITE, REPLICATED, matrix

PARTS = [[3], [0, 5, 6], [8], [1, 2, 4, 7, 9, 12], [10, 13], [11]]


@pytest.fixture
def pieces(monkeypatch):
    monkeypatch.setattr(apart, "SPLIT", 0)
    monkeypatch.setattr(apart, "SMALL", 3)


def frame(spark, a, sharding="row_sharded"):
    complex_ = np.iscomplexobj(a)
    cells = [(int(i), int(j), (float(a[i, j].real), float(a[i, j].imag)) if complex_ else float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    return matrix(spark.createDataFrame(cells, f"i long, j long, v {'struct<re:double,im:double>' if complex_ else 'double'}"), *a.shape, sharding)


def made(complex_=False):
    g = np.random.default_rng(4)
    a = np.zeros((14, 14), complex if complex_ else float)
    for rows in PARTS:
        x = g.standard_normal((len(rows),) * 2) + (1j * g.standard_normal((len(rows),) * 2) if complex_ else 0)
        a[np.ix_(rows, rows)] = x @ x.conj().T + np.eye(len(rows))
    return (a + a.conj().T) / 2


def dense(df, n, m):
    x = np.full((n, m), np.nan + 0j)
    for r in df.collect():
        assert np.isnan(x[r.i, r.j]) and r.status == 0
        x[r.i, r.j] = complex(r.v["re"], r.v["im"]) if isinstance(r.v, tuple) else r.v
    return x


@pytest.mark.parametrize("complex_", [False, True])
def test_solves_and_inverses(spark, pieces, complex_):
    a = made(complex_)
    found = apart.split(frame(spark, a))
    assert found.large == (1,) and sorted(r.i for r in found.alone.collect()) == [3, 8, 11]
    b = np.random.default_rng(5).standard_normal((14, 3)) * (1 + 1j if complex_ else 1)
    b[[0, 3, 9]] = 0
    assert np.allclose(dense(tiled.chol_solve(frame(spark, np.triu(a)), frame(spark, b, REPLICATED), 2), 14, 3), np.linalg.solve(a, b))
    want = np.linalg.inv(a)
    assert np.allclose(dense(tiled.spd_inverse(frame(spark, np.triu(a)), 4), 14, 14), want)
    upper = tiled.spd_inverse(frame(spark, a), 4, "upper")
    assert upper.count() == 14 * 15 // 2 and all(np.isclose(complex(r.v["re"], r.v["im"]) if complex_ else r.v, want[r.i, r.j]) for r in upper.collect())


@pytest.mark.parametrize("bad", [0, 6, 8, 12, 13])
def test_failed_minor(spark, pieces, bad):
    a = made()
    a[bad, bad] -= 1000
    a[13, 13] -= 1000  # a later one
    first = next(k for k in range(1, 15) if np.linalg.eigvalsh(a[:k, :k])[0] <= 0)
    x = tiled.chol_solve(frame(spark, a), frame(spark, np.ones((14, 1)), REPLICATED), 2, failed_minor=True).collect()
    assert {(r.status, r.failed_minor, np.isnan(r.v)) for r in x} == {(NOT_DEFINITE, first, True)} and len(x) == 14
    assert {(r.status, r.failed_minor) for r in tiled.spd_inverse(frame(spark, a), 2, "upper", failed_minor=True).collect()} == {(NOT_DEFINITE, first)}


@pytest.mark.parametrize("complex_", [False, True])
def test_eigenpairs(spark, pieces, complex_):
    a = made(complex_)
    want = np.linalg.eigvalsh(a)
    values = eigen.sym_eigen(frame(spark, np.triu(a)), False).orderBy("k").collect()
    assert [r.k for r in values] == list(range(14)) and np.allclose([r["lambda"] for r in values], want)
    rows = eigen.sym_eigen(frame(spark, a), True, 2).orderBy("k").collect()
    v = np.array([[complex(x["re"], x["im"]) if complex_ else x for x in r.vec] for r in rows]).T
    assert np.allclose([r["lambda"] for r in rows], want) and {r.status for r in rows} == {0}
    assert np.allclose(a @ v, v * want) and np.allclose(v.conj().T @ v, np.eye(14))
    lead = v[(np.abs(v) > 1e-9).argmax(axis=0), np.arange(14)]
    assert (lead.real > 0).all() and np.allclose(lead.imag, 0)


def test_no_tiles_of_a_diagonal_matrix(spark, monkeypatch):
    """Thousands of rows without a neighbour take no tile, no band and no panel."""

    def none(*_, **__):
        raise AssertionError("made a tile")

    for module, name in ((tiled, "to_tiles"), (eigen.banded, "to_tiles"), (eigen, "_panels")):
        monkeypatch.setattr(module, name, none)
    n = 3000
    a = C.diag(spark, n, F.col("i") + 1.0)
    one = matrix(C.diag(spark, n, F.lit(1.0)).cells.withColumn("j", F.lit(0).cast("long")), n, 1, REPLICATED)
    assert tiled.chol_solve(a, one, 400).filter("v = 1D / (i + 1) and status = 0").count() == n
    assert eigen.sym_eigen(a, False, 400).filter("lambda = k + 1 and status = 0").count() == n
    assert tiled.spd_inverse(a, 400).agg(F.count("*"), F.sum((F.col("i") == F.col("j")).cast("long")), F.max("v")).first()[:] == (n * n, n, 1.0)
    vec = eigen.sym_eigen(a, True, 400).filter("lambda = k + 1 and size(vec) = 3000 and vec[k] = 1 and array_position(vec, 1D) = k + 1")
    assert vec.count() == n


def test_wide_tiles_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(tiled, "TILE_BYTES", 8 * 25)
    widths = []
    real = tiled._factored
    monkeypatch.setattr(tiled, "_factored", lambda a, tile, *x: widths.append(tile) or real(a, tile, *x))
    a = made()
    assert np.allclose(dense(tiled.spd_inverse(frame(spark, a), 14), 14, 14), np.linalg.inv(a)) and widths == [5]


def test_ties_of_single_precision(spark, tmp_path):
    """1/800 and 1/20000 are ties of four digits, which their single precision isn't as a double."""
    from gramforge import catalogue

    spark.range(20_001).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.i: r.v for r in catalogue.solve_f32(spark, str(tmp_path)).filter("i in (31, 799, 19999)").collect()}
    assert got == {31: 0.0313, 799: 0.0013, 19999: 0.0001}


def test_cells_without_an_inverse_are_dealt_out(spark, monkeypatch):
    """n^2 NaN take as many tasks as they need, not the session's cores alone."""
    monkeypatch.setattr(tiled, "TASK_CELLS", 100)
    a = C.diag(spark, 60, F.col("i") - 1.0)
    for part, cells in (("full", 3600), ("upper", 1830)):
        bad = tiled.spd_inverse(a, 20, part)
        assert bad.rdd.getNumPartitions() == 37
        assert bad.filter(F.isnan("v") & (F.col("status") == NOT_DEFINITE)).select("i", "j").distinct().count() == bad.count() == cells


def test_rounding_once_a_pair_and_not_of_zeros(spark, tmp_path):
    """Rows of one eigenpair share its rounded value; zeros aren't rounded, and what is rounded is as it was."""
    from gramforge import catalogue

    spark.range(12).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    pairs = catalogue.eigen_diag(spark, str(tmp_path))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    above, generated, _ = plan.partition("Generate posexplode")
    assert generated and above.count("round(") == 1 and "round(lambda" not in above
    assert {tuple(r) for r in pairs.select("k", "i", "lambda", "x", "status").collect()} == {(k, i, k + 1.0, float(k == i), 0) for k in range(12) for i in range(12)}
    numbers = spark.createDataFrame([(x,) for x in (0.0, -0.0, 1 / 3, -1e-7, 5e-7, float("nan"), float("inf"), None)], "x double")
    for digits in (4, 6):
        got = numbers.select(catalogue._rounded(F.col("x"), digits).alias("a"), (F.round("x", digits) + F.lit(0.0)).alias("b")).collect()
        assert [str(r.a) for r in got] == [str(r.b) for r in got]


def test_zeros_are_generated_by_short_runs(spark, monkeypatch):
    """No array of zeros' places is as long as a row, whatever the borders of the runs; a task has 2^22 cells, about."""
    n = 60_000
    assert n * n / apart.Apart(C.diag(spark, n, F.col("i") + 1.0), None, None, ()).tasks(n) <= 1 << 22
    monkeypatch.setattr(layout, "SPAN", 4)
    monkeypatch.setattr(apart, "SPLIT", 0)
    spans = [(low, size, low, low + size - 1) for low in (0, 3, 1 << 40) for size in range(14)]
    got = layout.each_place(spark.createDataFrame(spans, "a long, size long, low long, high long"), "j").collect()
    assert sorted(map(tuple, got)) == [(low, size, j) for low, size, _, high in spans for j in range(low, high + 1)]
    linked = made()
    for a, rows, upper in ((C.diag(spark, 60, F.col("i") + 1.0), 60, False), (C.diag(spark, 60, F.col("i") - 1.0), 60, True), (frame(spark, linked), 14, False), (frame(spark, linked), 14, True)):
        x = tiled.spd_inverse(a, 20, "upper" if upper else "full")
        steps = re.findall(r"explode\(sequence\([^,]*, [^,]*, (\w+)", x._jdf.queryExecution().optimizedPlan().toString())
        assert steps and set(steps) == {"Some"}
        assert sorted(tuple(r) for r in x.select("i", "j").collect()) == [(i, j) for i in range(rows) for j in range(i if upper else 0, rows)]


@pytest.mark.parametrize("rows, cols, tasks", [(1, 1, 3), (7, 13, 1), (13, 7, 5), (9, 8, 40), (5, 3, 2), (6, 0, 2)])
def test_places_by_blocks(spark, monkeypatch, rows, cols, tasks):
    """Each place once, whatever the borders of the blocks, with and without the lower triangle and what is left out."""
    monkeypatch.setattr(layout, "WIDE", 4)
    monkeypatch.setattr(layout, "BLOCKS", 3)
    runs = layout.block_runs(spark, rows, cols, tasks)
    places = lambda df: sorted(map(tuple, df.select("i", "j").collect()))
    every = [(i, j) for i in range(rows) for j in range(cols)]
    assert places(layout.run_places(runs, cols, "j")) == every
    assert places(layout.run_places(runs, cols, "j", True)) == [(i, j) for i, j in every if j >= i]
    but = runs.withColumn("but", F.when(F.col("i") % 2 == 0, F.array(F.lit(1), F.lit(3))))
    assert places(layout.run_places(but, cols, "j", but="but")) == [(i, j) for i, j in every if i % 2 or j % 4 not in (1, 3)]


def bytes_a_row(df, path):
    df.write.parquet(path)
    return sum(p.stat().st_size for p in pathlib.Path(path).glob("*.parquet")) / df.sparkSession.read.parquet(path).count()


def test_stored_nan_are_small(spark, tmp_path):
    """Files keep n^2 places as dictionaries and repeats, not the number of each one's column (4 bytes a row)."""
    bad = tiled.spd_inverse(C.diag(spark, 1500, F.col("i") - 1.0), 400)
    assert bytes_a_row(bad.select("i", "j", F.isnan("v").alias("is_nan"), "status"), str(tmp_path / "x")) < 0.5


def suppliers(spark, n, path):
    spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(f"{path}/supplier.parquet")
    return str(path)


@pytest.mark.parametrize("complex_", [False, True])
def test_zeros_of_an_inverse_by_blocks(spark, pieces, monkeypatch, complex_):
    """Components lie across the borders of the blocks."""
    monkeypatch.setattr(layout, "WIDE", 4)
    a = made(complex_)
    want = np.linalg.inv(a)
    assert np.allclose(dense(tiled.spd_inverse(frame(spark, np.triu(a)), 4), 14, 14), want)
    upper = tiled.spd_inverse(frame(spark, a), 4, "upper").collect()
    assert sorted((r.i, r.j) for r in upper) == [(i, j) for i in range(14) for j in range(i, 14)]
    assert all(np.isclose(complex(r.v["re"], r.v["im"]) if complex_ else r.v, want[r.i, r.j]) for r in upper)


def test_stored_inverse_is_small(spark, tmp_path):
    from gramforge import catalogue

    assert bytes_a_row(catalogue.inverse_diag(spark, suppliers(spark, 1500, tmp_path)), str(tmp_path / "x")) < 0.5


def test_stored_inverse_of_single_precision_is_small(spark, tmp_path):
    from gramforge import catalogue

    assert bytes_a_row(catalogue.inverse_f32(spark, suppliers(spark, 1500, tmp_path)), str(tmp_path / "x")) < 0.5


@pytest.mark.parametrize("complex_", [False, True])
def test_cells_of_eigenvectors_by_blocks(spark, pieces, monkeypatch, complex_):
    """The cells are those of the vectors, zeros and all; a value is rounded once a pair."""
    monkeypatch.setattr(layout, "WIDE", 4)
    a = made(complex_)
    rows = eigen.eigen_cells(frame(spark, np.triu(a)), 2, lambda lam: F.round(lam, 3)).collect()
    assert sorted((r.k, r.i) for r in rows) == [(k, i) for k in range(14) for i in range(14)] and {r.status for r in rows} == {0}
    want, v = np.linalg.eigvalsh(a), np.zeros((14, 14), complex)
    for r in rows:
        assert np.isclose(r["lambda"], round(want[r.k], 3), atol=1e-12)
        v[r.i, r.k] = complex(r.x["re"], r.x["im"]) if complex_ else r.x
    assert np.allclose(a @ v, v * want) and np.allclose(v.conj().T @ v, np.eye(14))


def test_stored_eigenvectors_are_small(spark, tmp_path):
    from gramforge import catalogue

    assert bytes_a_row(catalogue.eigen_diag(spark, suppliers(spark, 1500, tmp_path)), str(tmp_path / "x")) < 0.5
