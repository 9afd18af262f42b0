"""Matrix algebra as relational algebra on cells (i, j, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.functions.dtypes import conjugate, is_complex, make, parts
from gramforge.plans.frame import MatrixFrame, matrix

#: Products of cells up to which they are joined one by one, and places of a tile for each cell up to which tiles are dense.
MOST_PRODUCTS, SPARSE = 1 << 22, 16
#: Products of cells that one task joins and sums, about.
TASK_PRODUCTS = 1 << 21


def eye(spark: SparkSession, n: int, value: Column | float = 1.0, dtype: str = "float64") -> MatrixFrame:
    return diag(spark, n, F.lit(value) if not isinstance(value, Column) else value, dtype)


def diag(spark: SparkSession, n: int, value: Column, dtype: str = "float64") -> MatrixFrame:
    """A diagonal matrix; `value` may use the column i."""
    cells = spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j")).withColumn("v", make(value, F.lit(0.0), dtype))
    return matrix(cells, n)


def transpose(a: MatrixFrame) -> MatrixFrame:
    return a.with_cells(a.cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a.cols, a.rows)


def conjugated(a: MatrixFrame) -> MatrixFrame:
    return a.with_cells(a.cells.withColumn("v", conjugate(F.col("v"), a.dtype)))


def upper(a: MatrixFrame) -> MatrixFrame:
    return a.with_cells(a.cells.filter("j >= i"))


def symmetrize_upper(a: MatrixFrame) -> MatrixFrame:
    """The upper triangle mirrored (conjugated); what stands below the diagonal is not read. No shuffle."""
    top = a.cells.filter("j >= i")
    below = a.cells.filter("j > i").select(F.col("j").alias("i"), F.col("i").alias("j"), conjugate(F.col("v"), a.dtype).alias("v"))
    return a.with_cells(top.unionByName(below))


def scale(a: MatrixFrame, factor: Column | float) -> MatrixFrame:
    """Every cell times a factor, which may use i and j (a shard's own factor, say)."""
    re, im = parts(F.col("v"), a.dtype)
    f = factor if isinstance(factor, Column) else F.lit(factor)
    return a.with_cells(a.cells.withColumn("v", make(re * f, im * f, a.dtype)))


def add(a: MatrixFrame, b: MatrixFrame, sign: float = 1.0) -> MatrixFrame:
    if (a.rows, a.cols) != (b.rows, b.cols):
        raise AssertionError("the shapes differ")
    return _summed(a, a.cells.unionByName(scale(b, sign).cells), a.rows, a.cols)


def matmul(a: MatrixFrame, b: MatrixFrame) -> MatrixFrame:
    """a b: a join of cells on the inner index and a sum; beyond MOST_PRODUCTS counted products, and where the cells fill
    their tiles well enough, a join of tiles.

    Either way means the same: cells that occur twice count as their sum, a missing cell meets nothing (NaN spreads only
    over cells of the other matrix), and the result has the cells that there is a product for.
    """
    if a.cols != b.rows:
        raise AssertionError("the inner dimensions differ")
    if a.rows * a.cols * b.cols > MOST_PRODUCTS:
        from gramforge.operators.tiled import TILE, tile_product

        tile = min(TILE, max(a.rows, a.cols, b.cols))
        products = _products(a, b)
        if products > MOST_PRODUCTS and _fills_tiles(a, tile) and _fills_tiles(b, tile):
            return tile_product(a, b, tile)
        return cell_product(a, b, products)
    return cell_product(a, b)


def cell_product(a: MatrixFrame, b: MatrixFrame, products: float = 0.0) -> MatrixFrame:
    """a b by a join of cells, with partial sums before the shuffle. Where `products`, the pairs of cells that meet, are more
    than TASK_PRODUCTS for each of the session's shuffle partitions, join and sums get a task for each TASK_PRODUCTS, so
    that a task's memory doesn't grow with the matrices."""
    left = a.cells.select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.cells.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("y"))
    (xr, xi), (yr, yi) = parts(F.col("x"), a.dtype), parts(F.col("y"), b.dtype)
    double = lambda c: c.cast("double")
    xr, xi, yr, yi = double(xr), double(xi), double(yr), double(yi)
    wide = "complex128" if is_complex(a.dtype) or is_complex(b.dtype) else "float64"
    product = make(xr * yr - xi * yi, xr * yi + xi * yr, wide) if is_complex(wide) else xr * yr
    dtype = a.dtype if is_complex(a.dtype) or not is_complex(b.dtype) else b.dtype
    tasks = int(products / TASK_PRODUCTS) + 1
    if tasks <= int(a.spark.conf.get("spark.sql.shuffle.partitions")):
        return _summed(a, left.join(right, "k").select("i", "j", product.alias("v")), a.rows, b.cols, wide, dtype)
    made = left.repartition(tasks, "k").join(right.repartition(tasks, "k").hint("merge"), "k").select("i", "j", product.alias("v"))
    return _summed(a, made.repartition(tasks, "i", "j"), a.rows, b.cols, wide, dtype)


def _products(a: MatrixFrame, b: MatrixFrame) -> float:
    """How many pairs of cells meet, counted by the inner index."""
    of = lambda m, k, n: m.cells.groupBy(F.col(k).alias("k")).agg(F.count(F.lit(1)).cast("double").alias(n))
    return of(a, "j", "x").join(of(b, "i", "y"), "k").agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0.0


def _fills_tiles(a: MatrixFrame, tile: int) -> bool:
    got = a.cells.groupBy(F.expr(f"i div {tile}").alias("bi"), F.expr(f"j div {tile}").alias("bj")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    return got[0] * tile * tile <= SPARSE * (got[1] or 0)


def _summed(like: MatrixFrame, cells: DataFrame, rows: int, cols: int, found: str | None = None, dtype: str | None = None) -> MatrixFrame:
    """Cells of one place summed; `found` is their element type and `dtype` the result's, else both are like's."""
    re, im = parts(F.col("v"), found or like.dtype)
    summed = cells.groupBy("i", "j").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return like.with_cells(summed.select("i", "j", make(F.col("re"), F.col("im"), dtype or like.dtype).alias("v")), rows, cols)


def summary(a: MatrixFrame) -> DataFrame:
    """One row: trace and Frobenius norm (of the real parts' trace, for complex matrices)."""
    re, im = parts(F.col("v"), a.dtype)
    return a.cells.agg(F.sum(F.when(F.col("i") == F.col("j"), re)).alias("trace"), F.sqrt(F.sum(re * re + im * im)).alias("frobenius"))


def residual(a: MatrixFrame, x: MatrixFrame, b: MatrixFrame) -> MatrixFrame:
    """A x - b with A mirrored from its upper triangle."""
    return add(matmul(symmetrize_upper(a), x), b, -1.0)


def random_definite(spark: SparkSession, n: int, seed: int = 1234, ridge: float = 1e-5) -> MatrixFrame:
    """G G^T + ridge I for a G of normal numbers over sqrt(n); the same for a seed wherever it runs."""
    cells = spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), F.expr(f"id % {n}").alias("j"))
    uniform = lambda k: (F.pmod(F.xxhash64("i", "j", F.lit(seed + k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * 3.141592653589793 * uniform(1)) / F.sqrt(F.lit(float(n)))
    g = matrix(cells.select("i", "j", normal.alias("v")), n)
    return add(matmul(g, transpose(g)), eye(spark, n, ridge))
