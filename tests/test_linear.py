"""The linear-algebra operators against closed forms, numpy and the DuckDB oracles."""

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gramforge import catalogue
from gramforge.operators import cells as C
from gramforge.operators import eigen, layouts, tiled
from gramforge.plans import frame
from gramforge.sources import tables
from gramforge.streaming.gram import streaming_gram

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    found = catalogue.QUERIES[name](spark, SF)
    got = sorted(map(tuple, found.select(*sorted(found.columns)).collect()), key=str)
    want = con.sql(catalogue.ORACLES[name])
    order = sorted(want.columns)
    rows = sorted(con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in order)} from ({catalogue.ORACLES[name]})").fetchall(), key=str)
    assert order == sorted(found.columns) and got == rows


@pytest.mark.parametrize("dtype", ["float64", "complex128"])
def test_solve_and_eigen_against_numpy(spark, dtype):
    g = np.random.default_rng(3)
    a = g.standard_normal((7, 7)) + (1j * g.standard_normal((7, 7)) if dtype == "complex128" else 0)
    a = a @ a.conj().T + np.eye(7)
    cell = (lambda v: (float(v.real), float(v.imag))) if dtype == "complex128" else (lambda v: float(v))
    kind = "struct<re:double,im:double>" if dtype == "complex128" else "double"
    frame_a = frame.matrix(spark.createDataFrame([(i, j, cell(a[i, j])) for i in range(7) for j in range(7)], f"i long, j long, v {kind}"), 7)
    b = np.arange(14.0).reshape(7, 2)
    frame_b = frame.matrix(spark.createDataFrame([(i, j, cell(b[i, j] + 0j if dtype == "complex128" else b[i, j])) for i in range(7) for j in range(2)], f"i long, j long, v {kind}"), 7, 2, frame.REPLICATED)
    number = (lambda v: complex(v["re"], v["im"])) if dtype == "complex128" else float
    x = np.zeros((7, 2), complex)
    for r in tiled.chol_solve(frame_a, frame_b, 3).collect():
        assert r["status"] == 0
        x[r["i"], r["j"]] = number(r["v"])
    assert np.allclose(x, np.linalg.solve(a, b))
    rows = eigen.sym_eigen(frame_a, True, 2).orderBy("k").collect()
    lam, v = np.array([r["lambda"] for r in rows]), np.array([[number(z) for z in r["vec"]] for r in rows]).T
    assert np.allclose(lam, np.linalg.eigvalsh(a)) and np.allclose(a @ v, v * lam, atol=1e-7)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 6), st.integers(1, 9), st.integers(1, 11))
def test_cyclic_map_is_a_bijection(spark, shards, tile, shard):
    n = shards * shard
    rows = layouts.cyclic_map(spark, n, tile, shards).collect()
    pad = -shard % tile if tile < shard else 0
    assert len({r.dst for r in rows}) == n and max(r.dst for r in rows) < shards * (shard + pad)
    # dealt one after another, as a sequential counter would
    filled = [0] * shards
    for r in sorted(rows, key=lambda r: r.col):
        device = r.col // min(tile, shard) % shards
        assert r.device == device and r.dst == device * (shard + pad) + filled[device] and r.src == r.col + pad * (r.col // shard)
        filled[device] += 1


def _dense(df, n, m):
    x = np.zeros((n, m), complex)
    for r in df.collect():
        x[r["i"], r["j"]] = complex(r["v"]["re"], r["v"]["im"]) if isinstance(r["v"], tuple) else r["v"]
    return x


def _matrix(spark, a, dtype, **more):
    single, complex_ = dtype in ("float32", "complex64"), dtype.startswith("complex")
    real = "float" if single else "double"
    kind = f"struct<re:{real},im:{real}>" if complex_ else real
    cell = (lambda v: (float(v.real), float(v.imag))) if complex_ else (lambda v: float(v.real))
    rows = [(i, j, cell(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return frame.matrix(spark.createDataFrame(rows, f"i long, j long, v {kind}"), *a.shape, **more)


@pytest.mark.parametrize("dtype", ["float32", "float64", "complex64", "complex128"])
@pytest.mark.parametrize("n, tile", [(2, 1), (4, 3), (6, 5), (10, 2)])
def test_solve_inverse_eigen_grid(spark, n, tile, dtype):
    g = np.random.default_rng(n * tile)
    a = g.standard_normal((n, n)) + (1j * g.standard_normal((n, n)) if dtype.startswith("complex") else 0)
    a = a @ a.conj().T / n + np.eye(n)
    b = g.standard_normal((n, 3)) + 0j
    near = dict(rtol=1e-3, atol=1e-3) if dtype in ("float32", "complex64") else dict(rtol=1e-9, atol=1e-9)
    left = _matrix(spark, np.triu(a), dtype)  # what stands below the diagonal is not read
    x = tiled.chol_solve(left, _matrix(spark, b, dtype, sharding=frame.REPLICATED), tile)
    assert dict(x.dtypes)["v"] == dict(left.cells.dtypes)["v"] and np.allclose(_dense(x, n, 3), np.linalg.solve(a, b), **near)
    assert np.allclose(_dense(tiled.spd_inverse(left, tile), n, n), np.linalg.inv(a), **near)
    values = [r["lambda"] for r in eigen.sym_eigen(left, False, tile).orderBy("k").collect()]
    assert np.allclose(values, np.linalg.eigvalsh(a), **near)


def test_panels_beyond_the_bound_are_joined(spark, monkeypatch):
    monkeypatch.setattr(tiled, "PANEL_BYTES", 0)
    g = np.random.default_rng(8)
    a = g.standard_normal((11, 11))
    a, b = a @ a.T + np.eye(11), g.standard_normal((11, 2))
    x = tiled.chol_solve(_matrix(spark, a, "float64"), _matrix(spark, b, "float64", sharding=frame.REPLICATED), 3)
    assert np.allclose(_dense(x, 11, 2), np.linalg.solve(a, b))
    monkeypatch.setattr(eigen, "PANEL_BYTES", 11 * 8 * 2)  # blocks of two columns, two rounds a job
    monkeypatch.setattr(eigen, "ROUNDS", 2)
    rows = eigen.sym_eigen(_matrix(spark, a, "float64"), True, 5).orderBy("k").collect()
    v = np.array([r["vec"] for r in rows]).T
    assert np.allclose([r["lambda"] for r in rows], np.linalg.eigvalsh(a)) and np.allclose(v.T @ v, np.eye(11))


def test_eigen_not_converged(spark, monkeypatch):
    monkeypatch.setattr(eigen, "MOST_SWEEPS", 1)
    g = np.random.default_rng(2).standard_normal((9, 9))
    rows = eigen.sym_eigen(_matrix(spark, g + g.T, "float64"), True, 2).collect()
    assert {r["status"] for r in rows} == {frame.NOT_CONVERGED} and all(np.isnan(r["lambda"]) and np.isnan(r["vec"]).all() for r in rows)


def test_narrow_tiles_warn(spark, monkeypatch):
    monkeypatch.setattr(tiled, "MANY_ROWS", 1)
    with pytest.warns(frame.DenseWarning, match="block rows"):
        x = tiled.chol_solve(C.eye(spark, 4), frame.matrix(C.eye(spark, 4).cells, 4, 4, frame.REPLICATED), 3)
    assert np.allclose(_dense(x, 4, 4), np.eye(4))


def test_products_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_PRODUCTS", 0)
    g = np.random.default_rng(6)
    a, b = g.standard_normal((5, 7)) + 0j, g.standard_normal((7, 3)) + 1j
    assert np.allclose(_dense(C.matmul(_matrix(spark, a, "complex128"), _matrix(spark, b, "complex128")).cells, 5, 3), a @ b)
    c = C.matmul(C.conjugated(_matrix(spark, b, "complex128")), _matrix(spark, b[:3, :].T, "complex128"))
    assert np.allclose(_dense(c.cells, 7, 3), b.conj() @ b[:3, :].T)


def test_timing_files(spark, tmp_path):
    for d, n, t, runs in [(1, 64, 128, [3.0, 1.0, 2.0]), (2, 64, 128, []), (1, 64, 16, [9.0])]:
        folder = tmp_path / "a100" / "float64" / f"ndev_{d}"
        folder.mkdir(parents=True, exist_ok=True)
        np.save(folder / f"N_{n}_T_A_{t}.npy", np.array(runs))
    np.save(tmp_path / "a100" / "float64" / "ndev_1" / "N_64_chosolve.npy", np.array([4.0, 6.0]))
    got = tables.bench_medians(tables.read_timings(spark, str(tmp_path)), 128).collect()
    assert sorted((r.gpu, r.dtype, r.ndev, r.tile or 0, r.n, r.median_s, r.runs) for r in got) == [("a100", "float64", 1, 0, 64, 5.0, 2), ("a100", "float64", 1, 128, 64, 2.0, 3)]


def test_streaming_gram(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((20, 3))
    spark.createDataFrame([(r.tolist(),) for r in x], "e array<double>").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("e array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_gram(stream, "e", 3).writeStream.format("memory").queryName("gram").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.i, r.j): r.v for r in spark.table("gram").collect()}
    assert len(got) == 6 and all(np.isclose(v, (x.T @ x)[i, j]) for (i, j), v in got.items())


def test_checks(spark):
    a, b = C.eye(spark, 3), C.eye(spark, 3)
    good = frame.matrix(b.cells, 3, 1, frame.REPLICATED)
    wrong = frame.matrix(b.cells, 4, 1, frame.REPLICATED)
    # in order: A's sharding, b's, the shapes, the element types, the limits
    with pytest.raises(ValueError, match="A must be sharded"):
        tiled.chol_solve(frame.matrix(a.cells, 3, 3, frame.REPLICATED), wrong)
    with pytest.raises(ValueError, match="replicated"):
        tiled.chol_solve(a, frame.matrix(b.cells, 4, 1))
    with pytest.raises(AssertionError, match="same number"):
        tiled.chol_solve(a, wrong)
    with pytest.raises(AssertionError, match="square"):
        tiled.chol_solve(frame.matrix(a.cells, 2, 3), good)
    with pytest.raises(TypeError, match="element type"):
        tiled.chol_solve(a, frame.matrix(C.eye(spark, 3, dtype="float32").cells, 3, 1, frame.REPLICATED))
    with pytest.raises(ValueError, match="right-hand sides"):
        tiled.chol_solve(a, frame.matrix(b.cells, 3, 257, frame.REPLICATED), strict_limits=True)
    with pytest.raises(ValueError, match="A must be sharded"):
        tiled.spd_inverse(frame.matrix(a.cells, 3, 3, frame.REPLICATED))
    with pytest.raises(AssertionError, match="square"):
        tiled.spd_inverse(frame.matrix(a.cells, 2, 3))
    with pytest.raises(ValueError, match="part"):
        tiled.spd_inverse(a, part="lower")
    with pytest.raises(AssertionError, match="2D"):
        frame.MatrixFrame(a.cells.select("i", "v"), 3, 3)
    with pytest.raises(ValueError, match="1024|1500"):
        eigen.sym_eigen(a, tile=1500, strict_limits=True)
    with pytest.raises(ValueError, match="one column|a column"):
        eigen.sym_eigen(a, tile=0)
    with pytest.raises(TypeError):
        frame.matrix(a.cells.withColumn("v", F.lit(1)), 3)
    with pytest.raises(ValueError):
        layouts.cyclic_map(spark, 10, 0, 2)
    with pytest.raises(ValueError):
        layouts.ownership(spark, 2, 1, 3)
