"""MatrixFrame: a matrix as a DataFrame of cells (i, j, v) with what the plans need to know; argument checks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramforge.functions.dtypes import dtype_of

ROW_SHARDED, REPLICATED = "row_sharded", "replicated"
MOST_RHS, MOST_EIGEN_TILE = 256, 1024
NOT_DEFINITE, NOT_CONVERGED = 7, 8


class DenseWarning(UserWarning):
    """Something in the set-up that works but is not what the operators are meant for."""


@dataclass(frozen=True)
class MatrixFrame:
    """cells: i BIGINT, j BIGINT, v; a missing cell is 0. rows and cols are the logical shape."""

    cells: DataFrame
    rows: int
    cols: int
    sharding: str = ROW_SHARDED

    def __post_init__(self) -> None:
        kinds = dict(self.cells.dtypes)
        if set(kinds) != {"i", "j", "v"}:
            raise AssertionError("a matrix must be 2D: cells (i, j, v)")
        if kinds["i"] != "bigint" or kinds["j"] != "bigint":
            raise TypeError("i and j must be bigint")
        _ = self.dtype

    @property
    def dtype(self) -> str:
        return dtype_of(self.cells.schema["v"].dataType)

    @property
    def spark(self):
        return self.cells.sparkSession

    def with_cells(self, cells: DataFrame, rows: int | None = None, cols: int | None = None) -> MatrixFrame:
        return replace(self, cells=cells, rows=self.rows if rows is None else rows, cols=self.cols if cols is None else cols)


def matrix(cells: DataFrame, rows: int, cols: int | None = None, sharding: str = ROW_SHARDED) -> MatrixFrame:
    return MatrixFrame(cells.select("i", "j", "v"), rows, rows if cols is None else cols, sharding)


def from_rows(rows: DataFrame, n: int, row_col: str = "row") -> MatrixFrame:
    """From (i, row ARRAY)."""
    width = n
    return matrix(rows.select("i", F.posexplode(row_col).alias("p", "v")).select("i", F.col("p").cast("long").alias("j"), "v"), n, width)


def to_rows(m: MatrixFrame) -> DataFrame:
    """(i, row ARRAY) of every row, with zeros for missing cells (rows without any are all zeros)."""
    kind = m.cells.schema["v"].dataType
    zero = "cast(0 as " + kind.simpleString() + ")" if not isinstance(kind, T.StructType) else f"cast(named_struct('re',0,'im',0) as {kind.simpleString()})"
    places = m.spark.range(m.rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m.cols - 1).cast("long"))).alias("j"))
    full = places.join(m.cells, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.expr(zero)).alias("v"))
    # a row's numbers are one array, whatever gathers them
    return full.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("row"))


def check_solve(a: MatrixFrame, b: MatrixFrame, strict_limits: bool = False) -> None:
    """The order of the checks is part of the contract."""
    if a.sharding != ROW_SHARDED:
        raise ValueError("A must be sharded along the rows")
    if b.sharding != REPLICATED:
        raise ValueError("b must be replicated along all shards")
    if a.cols != b.rows:
        raise AssertionError("A and b must have the same number of columns.")
    if a.rows != a.cols:
        raise AssertionError("A must be square.")
    if a.dtype != b.dtype:
        raise TypeError(f"A and b must have one element type, not {a.dtype} and {b.dtype}")
    if strict_limits and b.cols > MOST_RHS:
        raise ValueError(f"more than {MOST_RHS} right-hand sides")


def check_square(a: MatrixFrame, tile: int, eigen: bool = False, strict_limits: bool = False) -> None:
    if a.sharding != ROW_SHARDED:
        raise ValueError("A must be sharded along the rows")
    if a.rows != a.cols:
        raise AssertionError("A must be square.")
    if a.rows < 1:
        raise ValueError("A must have a row at least")
    if tile < 1:
        raise ValueError("the tile must have a column at least")
    if eigen and strict_limits and tile > MOST_EIGEN_TILE:
        raise ValueError(f"tile {tile} is wider than {MOST_EIGEN_TILE}")
