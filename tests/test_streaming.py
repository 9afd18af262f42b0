"""Regression over a sliding window of a stream against numpy; updates and downdates of triangles."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramforge.streaming.regression import SlidingRegression, downdate, triangle


def test_updates_and_downdates():
    g = np.random.default_rng(1)
    a, b = g.standard_normal((30, 4)), g.standard_normal((7, 4))
    r = triangle(np.concatenate([triangle(a), triangle(b)]))
    assert np.allclose(r, triangle(np.concatenate([a, b])))
    assert np.allclose(downdate(r, triangle(b)), triangle(a))
    # no rank left: not by downdating
    assert downdate(triangle(b), triangle(b)) is None


START = datetime(2024, 1, 1)


@pytest.mark.parametrize("order", ["in order", "mixed"])
def test_sliding_window(spark, tmp_path, order):
    """Batches in order and out of it (late rows, gaps that empty the window), nulls, a batch without rows, a batch twice."""
    g = np.random.default_rng(3)
    rows = [(START + timedelta(hours=int(h)), float(g.normal()), float(g.normal())) for h in g.integers(0, 300, 120)] + [(START + timedelta(hours=900 + k), float(g.normal()), float(g.normal())) for k in range(12)]
    rows.sort()
    if order == "mixed":
        rows = [rows[k] for k in g.permutation(len(rows))]
    batches = [rows[:40], [], rows[40:90], [(None, 1.0, 1.0), (START, None, 1.0)], rows[90:]]
    shape = "ts timestamp, a double, b double"
    reg = SlidingRegression(str(tmp_path / "state"), "ts", [F.lit(1.0), F.col("a")], F.col("b"), timedelta(hours=100))
    seen = []
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, shape)
        reg.process(df, k)
        if k == 2:
            reg.process(df, k)
        seen += [r for r in batch if None not in r]
        top = max(r[0] for r in seen)
        own = np.array([(1.0, r[1], r[2]) for r in seen if r[0] > top - timedelta(hours=100)])
        got = reg.solution(spark, k).orderBy("i").collect()
        want = np.linalg.lstsq(own[:, :2], own[:, 2], rcond=None)[0]
        assert {r.rows for r in got} == {len(own)} and {r.status for r in got} == {0}
        assert np.allclose([r.v for r in got], want, atol=1e-8)


def test_window_without_rank(spark, tmp_path):
    reg = SlidingRegression(str(tmp_path / "state"), "ts", [F.lit(1.0), F.col("a")], F.col("b"), timedelta(hours=1))
    reg.process(spark.createDataFrame([], "ts timestamp, a double, b double"), 0)
    assert {(r.rows, r.status) for r in reg.solution(spark, 0).collect()} == {(0, 7)}
    reg.process(spark.createDataFrame([(START, 1.0, 2.0)], "ts timestamp, a double, b double"), 1)
    assert {(r.rows, r.status) for r in reg.solution(spark, 1).collect()} == {(1, 7)}
