"""Many small matrices at once: one group of rows is one matrix (its size is bounded by MOST), solved in one task.

Input is (group, i, j, v); j = -1 stands for a right-hand side, j = -2 for the next one and so on. Only the upper triangle
is read; cells that occur twice are summed. A group without a definite matrix (one of right-hand sides alone, say) has status 7 and NaN.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from gramforge.plans.frame import NOT_DEFINITE

MOST = 2048


def _number(c: str):
    """pandas hands NaN back as null."""
    return F.coalesce(c, F.lit(float("nan")))


def _dense(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    a = np.zeros((n, n))
    np.add.at(a, (i, j), v)
    return np.triu(a) + np.triu(a, 1).T


def _size(i: np.ndarray, j: np.ndarray) -> int:
    n = int(max(i.max(), j.max(), 0)) + 1
    if n > MOST:
        raise ValueError(f"a group's matrix is larger than {MOST}; use the tiled operators")
    return n


def _eigvals(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, int]:
    a = _dense(i, j, v, _size(i, j))
    if not np.isfinite(a).all():
        return np.full(len(a), np.nan), NOT_DEFINITE
    return np.linalg.eigvalsh(a), 0


def _solved(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, int]:
    """A column for each right-hand side."""
    own, n = j >= 0, _size(i, j)
    a = _dense(i[own], j[own], v[own], n)
    b = np.zeros((n, max(1, -int(j.min()))))
    np.add.at(b, (i[~own], -j[~own] - 1), v[~own])
    try:
        low = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        low = np.full_like(a, np.nan)
    if not np.isfinite(low).all():
        return np.full_like(b, np.nan), NOT_DEFINITE
    return np.linalg.solve(low.T, np.linalg.solve(low, b)), 0


def _inverse(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, int]:
    own, n = j >= 0, _size(i, j)
    k = np.arange(n)
    return _solved(np.concatenate([i[own], k]), np.concatenate([j[own], -k - 1]), np.concatenate([v[own], np.ones(n)]))


def _by_group(cells: DataFrame, group: str, work, columns: str, spread) -> DataFrame:
    kind = cells.schema[group].dataType.simpleString()

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out, status = work(*(g[c].to_numpy() for c in ("i", "j", "v")))
        table = spread(out)
        return pd.DataFrame({group: [key[0]] * len(next(iter(table.values()))), **table, "status": status})

    return cells.select(group, "i", "j", "v").groupBy(group).applyInPandas(run, f"`{group}` {kind}, {columns}, status int")


def _values(lam: np.ndarray) -> dict:
    return {"k": np.arange(len(lam)), "lambda": lam}


def _first_column(x: np.ndarray) -> dict:
    return {"i": np.arange(len(x)), "v": x[:, 0]}


def _cells(x: np.ndarray) -> dict:
    i, j = np.indices(x.shape)
    return {"i": i.reshape(-1), "j": j.reshape(-1), "v": x.reshape(-1)}


def eigvals_by_group(cells: DataFrame, group: str) -> DataFrame:
    """From (group, i, j, v) to (group, k, lambda, status) for each group's symmetric matrix."""
    return _by_group(cells, group, _eigvals, "k long, lambda double", _values).withColumn("lambda", _number("lambda"))


def solve_by_group(cells: DataFrame, group: str) -> DataFrame:
    """From (group, i, j, v) with j = -1 for the right-hand side to (group, i, v, status)."""
    return _by_group(cells, group, _solved, "i long, v double", _first_column).withColumn("v", _number("v"))


def solve_many_by_group(cells: DataFrame, group: str) -> DataFrame:
    """As solve_by_group for any number of right-hand sides (j = -1, -2, ...): (group, i, j, v, status), j from 0."""
    return _by_group(cells, group, _solved, "i long, j long, v double", _cells).withColumn("v", _number("v"))


def inverse_by_group(cells: DataFrame, group: str) -> DataFrame:
    """From (group, i, j, v) to (group, i, j, v, status): each group's inverse; right-hand sides are not looked at."""
    return _by_group(cells, group, _inverse, "i long, j long, v double", _cells).withColumn("v", _number("v"))


def _table_function(work, spread, columns: str):
    """A function of TABLE(t) PARTITION BY g, t having g BIGINT, i BIGINT, j BIGINT, v DOUBLE, over Arrow batches."""

    class Groups:
        def __init__(self) -> None:
            self.parts: list[pa.RecordBatch] = []

        def eval(self, rows: pa.RecordBatch):
            self.parts.append(rows)
            return iter(())

        def terminate(self):
            if self.parts:
                t = pa.Table.from_batches(self.parts)
                out, status = work(*(t.column(c).to_numpy() for c in ("i", "j", "v")))
                table = spread(out)
                n = len(next(iter(table.values())))
                yield pa.table({"g": pa.array([t.column("g")[0].as_py()] * n, pa.int64()), **{k: pa.array(x) for k, x in table.items()}, "status": pa.array([status] * n, pa.int32())})

    return arrow_udtf(Groups, returnType=f"g long, {columns}, status int")


def register_sql(spark: SparkSession) -> None:
    """SELECT * FROM f(TABLE(t) PARTITION BY g) for f in solve_groups, inverse_groups, eigvals_groups."""
    spark.udtf.register("solve_groups", _table_function(_solved, _first_column, "i long, v double"))
    spark.udtf.register("inverse_groups", _table_function(_inverse, _cells, "i long, j long, v double"))
    spark.udtf.register("eigvals_groups", _table_function(_eigvals, _values, "k long, lambda double"))
