"""Solves with a sparse positive definite matrix, all as joins of cells.

The pattern of the factor L is a fixed point: what a column holds below its first entry, the column of that entry holds
as well (its parent in the elimination tree). Columns of one height in the tree don't depend on one another, so the
factorisation takes a job for each height: it divides these columns by their pivots and takes their products off the
rest, a join of a column's cells with each other (r.i <= l.i), summed by place. Right-hand sides are rows below the
matrix, so the forward sweep comes with it; the sweep back goes down the heights.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.functions.dtypes import NAMES, is_complex
from gramforge.operators.tiled import Tiles, check_symmetry
from gramforge.plans.frame import NOT_DEFINITE, DenseWarning, MatrixFrame, check_solve

#: A higher tree draws a warning: each height is a job or two.
MANY_HEIGHTS = 64


class _Store(Tiles):
    def kept(self, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.keep(df))


def _below(a: MatrixFrame) -> DataFrame:
    """The cells of the upper triangle, transposed; of one place summed."""
    return a.cells.filter("j >= i").groupBy(F.col("j").alias("i"), F.col("i").alias("j")).agg(F.sum(F.col("v").cast("double")).alias("v"))


def symbolic_fill(a: MatrixFrame, store: Tiles | None = None) -> DataFrame:
    """(i, j), i > j: the places below the diagonal where the factor of a matrix with cells where `a` has some (in its upper
    triangle, zeros included) can differ from 0."""
    own = _Store(a.spark, "fill") if store is None else store
    found = own.kept(_below(a).filter("i > j").select("i", "j"))
    new = found
    while not new.isEmpty():
        first = found.groupBy("j").agg(F.min("i").alias("p"))
        # a column whose first entry has changed hands on all of it, one with new entries only those
        changed = new.groupBy("j").agg(F.min("i").alias("n")).join(first, "j")
        all_of = found.join(changed.filter("n = p").select("j", "p"), "j")
        some_of = new.join(changed.filter("n > p").select("j", "p"), "j")
        passed = all_of.unionByName(some_of).filter("i > p").select("i", F.col("p").alias("j")).distinct()
        new = own.kept(passed.join(found, ["i", "j"], "left_anti"))
        found = own.kept(found.unionByName(new))
    return found


def elimination_tree(fill: DataFrame) -> DataFrame:
    """(j, parent) of every column that has one: the first place below its diagonal."""
    return fill.groupBy("j").agg(F.min("i").alias("parent"))


def heights(tree: DataFrame, n: int, store: Tiles) -> tuple[DataFrame, int]:
    """(j, height) of all columns: 0 without children, else one more than the highest child; and the number of heights."""
    tree = store.kept(tree)
    level = store.kept(tree.sparkSession.range(n).select(F.col("id").alias("j"), F.lit(0).alias("height")))
    top = 0
    while True:
        # columns whose children reached the last height
        raised = store.kept(tree.join(level.filter(F.col("height") == top), "j").select(F.col("parent").alias("j")).distinct().withColumn("next", F.lit(top + 1)))
        if raised.isEmpty():
            return level, top + 1
        level = store.kept(level.join(raised, "j", "left").select("j", F.coalesce("next", "height").alias("height")))
        top += 1


def sparse_solve(a: MatrixFrame, b: MatrixFrame, check_symmetric: bool = False) -> DataFrame:
    """A x = b: cells i, j, v and status, as chol_solve gives them (7 and NaN everywhere if A is not positive definite),
    without a tile or a dense matrix anywhere. Only the upper triangle of A is read; order the columns so that little is
    filled in. FLOAT and DOUBLE cells."""
    check_solve(a, b)
    if a.rows < 1:
        raise ValueError("A must have a row at least")
    if is_complex(a.dtype):
        raise TypeError("complex cells need the tiled solver")
    if check_symmetric:
        check_symmetry(a)
    spark, n, kind = a.spark, a.rows, NAMES[b.dtype]
    store = _Store(spark, "sparse")
    level, top = heights(elimination_tree(symbolic_fill(a, store)), n, store)
    if top > MANY_HEIGHTS:
        warnings.warn(f"the elimination tree has {top} heights, each a job or more; another order of the columns may make fewer", DenseWarning, stacklevel=2)
    # right-hand side c is row n + c
    sides = b.cells.groupBy((F.col("j") + n).alias("i"), F.col("i").alias("j")).agg(F.sum(F.col("v").cast("double")).alias("v"))
    rest = store.kept(_below(a).unionByName(sides).join(level, "j").select("i", "j", "v", "height"))
    columns: list[DataFrame] = []
    bad = not level.join(rest.filter("i = j").select("j"), "j", "left_anti").isEmpty()  # no pivot at all
    for h in range(top):
        if bad:
            break
        now = rest.filter(F.col("height") == h)
        pivot = now.filter("i = j").select("j", F.sqrt("v").alias("p"), ((F.col("v") > 0) & (F.col("v") < float("inf"))).alias("good"))
        bad = not pivot.filter("not good").isEmpty()
        if bad:
            break
        column = store.kept(now.join(pivot, "j").select("i", "j", F.when(F.col("i") == F.col("j"), F.col("p")).otherwise(F.col("v") / F.col("p")).alias("v")))
        columns.append(column)
        off = column.filter("i > j")
        l, r = off.alias("l"), off.filter(F.col("i") < n).alias("r")
        taken = l.join(r, F.expr("l.j = r.j and r.i <= l.i")).select(F.col("l.i").alias("i"), F.col("r.i").alias("j"), (-F.col("l.v") * F.col("r.v")).alias("v"))
        if h < top - 1:
            left = rest.filter(F.col("height") > h).select("i", "j", "v").unionByName(taken).groupBy("i", "j").agg(F.sum("v").alias("v"))
            rest = store.kept(left.join(level, "j").select("i", "j", "v", "height"))
    if bad:
        store.remove()
        nan = F.lit(float("nan")).cast(kind)
        places = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b.cols - 1).cast("long"))).alias("j"))
        return places.select("i", "j", nan.alias("v"), F.lit(NOT_DEFINITE).cast("int").alias("status"))
    x: DataFrame | None = None
    for column in reversed(columns):
        pivot = column.filter("i = j").select("j", F.col("v").alias("p"))
        y = column.filter(F.col("i") >= n).select("j", (F.col("i") - n).alias("c"), "v")
        if x is not None:
            inner = column.filter((F.col("i") > F.col("j")) & (F.col("i") < n)).alias("l").join(x.alias("x"), F.expr("l.i = x.j"))
            y = y.unionByName(inner.select(F.col("l.j").alias("j"), F.col("x.c").alias("c"), (-F.col("l.v") * F.col("x.v")).alias("v")))
        own = y.groupBy("j", "c").agg(F.sum("v").alias("v")).join(pivot, "j").select("j", "c", (F.col("v") / F.col("p")).alias("v"))
        x = store.kept(own if x is None else x.unionByName(own))
    places = spark.range(n).select(F.col("id").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b.cols - 1).cast("long"))).alias("c"))
    cells = places.join(x, ["j", "c"], "left").select(F.col("j").alias("i"), F.col("c").alias("j"), F.coalesce("v", F.lit(0.0)).cast(kind).alias("v"), F.lit(0).cast("int").alias("status"))
    result = _Store(spark, "sparse-solution").kept(cells)
    store.remove()
    return result
