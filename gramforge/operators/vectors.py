"""Products of a matrix with a narrow one (a vector, a block of them): one pass over the matrix, which isn't shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.functions.dtypes import is_complex, make, parts
from gramforge.operators import cells as C
from gramforge.plans.frame import MatrixFrame
from gramforge.sources.folders import ship_code

#: A narrow matrix of at most this size is collected and broadcast; a larger one is joined on the inner index.
VECTOR_BYTES = 32 << 20


def numbers(a: MatrixFrame, i: str, j: str, re: str, im: str) -> DataFrame:
    """The cells as (i, j, re, im), doubles."""
    x, y = parts(F.col("v"), a.dtype)
    return a.cells.select(F.col("i").alias(i), F.col("j").alias(j), x.cast("double").alias(re), y.cast("double").alias(im))


def row_sums(i: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct i, ascending, and the sum of the rows of values of each."""
    order = np.argsort(i, kind="stable")
    own = i[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
    return own[starts], np.add.reduceat(values[order], starts, axis=0) if len(starts) else values[:0]


def matvec(a: MatrixFrame, x: MatrixFrame) -> MatrixFrame:
    """a x for an x of few columns, with the meaning of matmul: cells that occur twice are summed, missing ones meet nothing.

    Where x has VECTOR_BYTES at most by its shape, each task multiplies the cells that it reads with all of x and sums them by
    row; the shuffle carries sums of rows alone. Beyond that the cells are joined with x on the inner index.
    """
    if a.cols != x.rows:
        raise AssertionError("the inner dimensions differ")
    complex_ = is_complex(a.dtype) or is_complex(x.dtype)
    if x.rows * x.cols * 16 > VECTOR_BYTES:
        return C.cell_product(a, x)
    spark = a.spark
    ship_code(spark)
    held = np.zeros((x.rows, x.cols), np.complex128 if complex_ else np.float64)
    there = np.zeros(held.shape, bool)
    got = numbers(x, "i", "j", "re", "im").groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).toArrow()
    at = got.column("i").to_numpy(), got.column("j").to_numpy()
    held[at] = got.column("re").to_numpy() + 1j * got.column("im").to_numpy() if complex_ else got.column("re").to_numpy()
    there[at] = True
    sent = spark.sparkContext.broadcast((held, None if there.all() else there))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, there = sent.value
        for batch in batches:
            i, j, re, im = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "k", "re", "im"))
            v = (re + 1j * im if complex_ else re)[:, None] * held[j]
            n = np.ones(v.shape, np.int64) if there is None else there[j].astype(np.int64)
            rows, sums = row_sums(i, np.where(n > 0, v, 0))
            _, met = row_sums(i, n)
            at, c = np.nonzero(met)
            out = sums[at, c]
            yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(c), pa.array(out.real), pa.array(out.imag if complex_ else np.zeros(len(out)))], names=["i", "j", "re", "im"])

    sums = numbers(a, "i", "k", "re", "im").mapInArrow(run, "i long, j long, re double, im double")
    dtype = a.dtype if is_complex(a.dtype) or not complex_ else x.dtype
    summed = sums.groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return a.with_cells(summed.select("i", "j", make(F.col("re"), F.col("im"), dtype).alias("v")), a.rows, x.cols)
