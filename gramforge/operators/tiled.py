"""Cholesky solves and inverses over tiles that stay where they are.

A matrix is a set of square tiles (bi, bj, data) in a table bucketed by block column; the right-hand sides are tiles of
further block columns, so the forward sweep is part of the factorisation. Block rows of U are made one after another and
appended to the same table: row k is A's row k less the products of the rows above, which the task that holds a block column
gathers from its bucket, tile after tile, two of them in memory. So no step moves tiles that are stored already; what
moves is what all columns need of U (its block column k), broadcast where it has at most PANEL_BYTES. Beyond that it is
joined, and the step is dealt out again. The sweep back works the same way on U's block rows. A tile without a cell isn't
made, in A or in U, and counts as zero. Only the upper triangle of A is read. A tile that is not positive definite ends the
factorisation: status 7 and NaN everywhere.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.functions.dtypes import conjugate, is_complex, make, numpy_dtype, parts
from gramforge.functions.layout import block_runs, run_places
from gramforge.plans.frame import NOT_DEFINITE, DenseWarning, MatrixFrame, check_solve, check_square, matrix
from gramforge.sources.folders import remove_folder, shared_base, ship_code

TILE = 256
#: A block column of U (or row, on the way back) of at most this size is collected and broadcast; a larger one is joined.
PANEL_BYTES = 64 << 20
#: A tile is as wide as asked for, or as this holds.
TILE_BYTES = 32 << 20
#: Result tiles of a product that one group makes, along either side.
SUPER = 4
#: Passes over a product's left side, each with as much of the right one as a block column may have, below which none is joined.
MOST_PASSES = 64
#: More block rows than this draw a warning.
MANY_ROWS = 64
#: Cells of a dense result that one task generates, about. A Parquet writer holds them, encoded, to the task's end; of longer
#: tasks they outlive the young collections and fill the heap.
TASK_CELLS = 1 << 22
SCHEMA = "bi int, bj int, data binary"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder of spark.checkpoint.dir."""
    shared_base(df.sparkSession)
    return df.checkpoint()


class Tiles:
    """Stored block rows of one operator, in a folder that is removed when its result is stored."""

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        self.spark, self.root, self.n = spark, f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> str:
        self.n += 1
        path = f"{self.root}/{self.n:05d}"
        df.write.option("compression", "uncompressed").parquet(path)
        return path

    def read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def remove(self) -> None:
        remove_folder(self.spark, self.root)


class Placed:
    """The tiles of one run, (kind, bi, bj, data), as a table in the shared folder, bucketed by block column. A task reads
    the whole of its buckets, whatever was appended when, and appends to them; remove() drops table and files."""

    A, U, X, Y = range(4)  # the matrix with its right-hand sides, the factor, the solution, other right-hand sides
    SCAN = "spark.sql.sources.bucketing.autoBucketedScan.enabled"

    def __init__(self, spark: SparkSession, name: str, columns: int):
        ship_code(spark)
        key = uuid.uuid4().hex
        self.spark, self.root, self.table = spark, f"{shared_base(spark)}/{name}-{key}", f"gramforge_{name}_{key}"
        # four buckets a block column at most: few columns meet in one, and few tasks have none
        self.devices = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * columns)

    @contextmanager
    def whole_buckets(self):
        """Scans keep buckets together even where nothing above them in the plan asks for it."""
        before = self.spark.conf.get(self.SCAN)
        self.spark.conf.set(self.SCAN, "false")
        try:
            yield
        finally:
            self.spark.conf.set(self.SCAN, before)

    def put(self, tiles: DataFrame, kind: int, dealt: bool = True) -> None:
        rows = tiles.select(F.lit(kind).cast("int").alias("kind"), F.col("bi").cast("int").alias("bi"), F.col("bj").cast("int").alias("bj"), "data")
        if not dealt:
            rows = rows.repartition(self.devices, "bj")
        with self.whole_buckets():
            rows.write.format("parquet").option("compression", "uncompressed").option("path", f"{self.root}/tiles").bucketBy(self.devices, "bj").mode("append").saveAsTable(self.table)

    def read(self, where: Column | None = None) -> DataFrame:
        tiles = self.spark.table(self.table)
        return tiles if where is None else tiles.filter(where)

    def remove(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove_folder(self.spark, self.root)


def asymmetric_cells(a: MatrixFrame, tile: int = TILE) -> DataFrame:
    """i, j (i < j, or i = j of a complex diagonal) of places where A differs from its (conjugate) transpose; missing cells are
    0 and cells that occur twice count as their sum.

    One pass makes two sums for each pair of tiles, of hashes of (i, j, v) on one side of the diagonal and of (j, i, conj v)
    on the other, which don't depend on the order of cells. Only tiles whose sums differ are compared cell by cell.
    """
    re, im = parts(F.col("v"), a.dtype)
    below = F.col("i") > F.col("j")
    sign = F.when(below, -1.0).otherwise(1.0)
    # adding 0.0 makes one zero of both
    turned = a.cells.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), below.alias("below"), (re.cast("double") + 0.0).alias("re"), (im.cast("double") * sign + 0.0).alias("im"))
    turned = turned.filter("(re <> 0 or im <> 0) and (i < j or im <> 0)")
    turned = turned.withColumn("bi", F.expr(f"i div {tile}")).withColumn("bj", F.expr(f"j div {tile}"))
    mark = F.pmod(F.xxhash64("i", "j", "re", "im"), F.lit(1 << 40))
    side = lambda c: F.coalesce(F.sum(F.when(c, mark)), F.lit(0).cast("long"))
    odd = turned.groupBy("bi", "bj").agg(side(F.col("below")).alias("x"), side(~F.col("below")).alias("y")).filter("x <> y").select("bi", "bj")
    both = turned.join(odd, ["bi", "bj"], "left_semi").groupBy("i", "j").agg(*[F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0.0)).alias(f"{n}_{x}") for n, c in (("low", F.col("below")), ("up", ~F.col("below"))) for x in ("re", "im")])
    real = F.when(F.col("i") == F.col("j"), F.lit(True)).otherwise(F.col("low_re").eqNullSafe(F.col("up_re")))
    imaginary = F.col("low_im").eqNullSafe(F.col("up_im"))
    return both.filter(~(real & imaginary)).select("i", "j")


def check_symmetry(a: MatrixFrame) -> None:
    found = asymmetric_cells(a).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("i", "j")).alias("first")).first()
    if found["n"]:
        raise ValueError(f"A is not symmetric: {found['n']} places differ, the first is ({found['first']['i']}, {found['first']['j']})")


def to_tiles(a: MatrixFrame, tile: int, upper: bool, shift: int = 0, zeros: bool = True) -> DataFrame:
    """Dense tiles of all cells (of the upper triangle); block columns count from `shift`. Cells that occur twice are summed;
    tiles without a cell are made too unless `zeros` is false."""
    spark, dtype = a.spark, numpy_dtype(a.dtype)
    re, im = parts(F.col("v"), a.dtype)
    source = a.cells.filter("j >= i") if upper else a.cells
    coded = source.select(F.expr(f"cast(i div {tile} as int)").alias("bi"), F.expr(f"cast(j div {tile} as int)").alias("bj"), F.expr(f"cast((i % {tile}) * {tile} + j % {tile} as int)").alias("p"), re.cast("double").alias("re"), im.cast("double").alias("im"))

    def dense(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(tile * tile, np.complex128)
        np.add.at(out, group["p"].to_numpy(), group["re"].to_numpy() + 1j * group["im"].to_numpy())
        return pd.DataFrame({"bi": group["bi"].iloc[:1], "bj": group["bj"].iloc[:1], "data": [(out if dtype.kind == "c" else out.real).astype(dtype).tobytes()]})

    made = coded.groupBy("bi", "bj").applyInPandas(dense, SCHEMA)  # tile * tile cells at most
    if not zeros:
        return made.select("bi", (F.col("bj") + shift).alias("bj"), "data")
    return filled(made, -(-a.rows // tile), -(-a.cols // tile), tile, dtype, upper).select("bi", (F.col("bj") + shift).alias("bj"), "data")


def filled(tiles: DataFrame, nr: int, nc: int, tile: int, dtype: np.dtype, upper: bool = False) -> DataFrame:
    """nr x nc tiles (those on and above the diagonal), zeros where `tiles` has none."""
    places = tiles.sparkSession.range(nr).select(F.col("id").cast("int").alias("bi"), F.explode(F.expr(f"sequence({'cast(id as int)' if upper else '0'}, {nc - 1})")).alias("bj"))
    zero = F.lit(bytes(tile * tile * dtype.itemsize))
    return places.join(tiles, ["bi", "bj"], "left").select("bi", "bj", F.coalesce("data", zero).alias("data"))


def to_cells(tiles: DataFrame, like: MatrixFrame, tile: int, rows: int, cols: int, shift: int = 0) -> DataFrame:
    """All cells of the tiles within rows x cols, zeros too; of tiles with a mask only those that it marks."""
    dtype, complex_, masked = numpy_dtype(like.dtype), is_complex(like.dtype), "mask" in tiles.columns

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = batch.column("mask").to_pylist() if masked else [None] * batch.num_rows
            for bi, bj, data, mask in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), batch.column("data"), masks, strict=True):
                inside = np.s_[: max(0, rows - bi * tile), : max(0, cols - (bj - shift) * tile)]
                block = np.frombuffer(data.as_buffer(), dtype).reshape(tile, tile)[inside]
                i, j = np.nonzero(_places(mask, tile)[inside])
                flat = block[i, j]
                im = flat.imag.astype(float) if complex_ else np.zeros(len(flat))
                yield pa.RecordBatch.from_arrays([pa.array(i + bi * tile), pa.array(j + (bj - shift) * tile), pa.array(flat.real.astype(float)), pa.array(im)], names=["i", "j", "re", "im"])

    return tiles.mapInArrow(spread, "i long, j long, re double, im double").select("i", "j", make(F.col("re"), F.col("im"), like.dtype).alias("v"))


def _gathered(rows: DataFrame, panel: dict[int, np.ndarray] | None, last: np.ndarray, own: int, tile: int, dtype: np.dtype, forward: bool) -> DataFrame:
    """Block row `own` of the result, of rows whose block columns are whole within partitions: for each block column its tile of row `own` less the products of its other tiles
    with the panel's (or, without a panel, with the column `l`), solved with `last`, a diagonal tile of U."""
    held = rows.sparkSession.sparkContext.broadcast((panel, last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel, last = held.value
        turned = last.conj().T if forward else last
        at, total = None, None

        def made() -> pa.RecordBatch:
            out = np.linalg.solve(turned, total).astype(dtype)
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([at], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["bi", "bj", "data"])

        for batch in batches:
            others = batch.column("l") if panel is None else [None] * batch.num_rows
            for bi, bj, data, l in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), batch.column("data"), others, strict=True):
                if bj != at:
                    if at is not None and total.any():
                        yield made()
                    at, total = bj, np.zeros((tile, tile), dtype)
                x = np.frombuffer(data.as_buffer(), dtype).reshape(tile, tile)
                if bi == own:
                    total = total + x
                    continue
                p = panel.get(bi) if panel is not None else np.frombuffer(l.as_buffer(), dtype).reshape(tile, tile) if l.is_valid else None
                if p is None:
                    continue  # a tile without a cell
                total = total - (p.conj().T @ x if forward else p @ x)
        if at is not None and total.any():
            yield made()

    return rows.sortWithinPartitions("bj", "bi").mapInArrow(run, SCHEMA)


def _collected(tiles: DataFrame, key: str, tile: int, dtype: np.dtype) -> dict[int, np.ndarray]:
    return {r[0]: np.frombuffer(r[1], dtype).reshape(tile, tile) for r in tiles.select(key, "data").collect()}


def cholesky(a: np.ndarray) -> np.ndarray | None:
    whole = np.triu(a) + np.triu(a, 1).conj().T
    try:
        low = np.linalg.cholesky(whole)
    except np.linalg.LinAlgError:
        return None
    return low.conj().T if np.isfinite(low).all() else None


def bad_pivot(a: np.ndarray) -> int:
    """The first column whose pivot is not positive, column after column; the last one if rounding hides it."""
    whole = (np.triu(a) + np.triu(a, 1).conj().T).astype(np.result_type(a, np.float64))
    for k in range(len(whole)):
        pivot = whole[k, k].real
        if not (np.isfinite(pivot) and pivot > 0):
            return k
        row = whole[k, k + 1 :].copy()
        whole[k + 1 :, k + 1 :] -= np.outer(row.conj(), row) / pivot
    return len(whole) - 1


def factor(placed: Placed, nb: int, tile: int, dtype: np.dtype) -> list[np.ndarray] | int:
    """Adds the block rows of U right of the diagonal (and of U^-H b, in the further block columns) to the placed tiles;
    returns the diagonal tiles, or the order of the first leading minor that is not positive if A is not positive
    definite. One block column (or one tile) is on the driver at a time, and the diagonal tiles, which are as much as one
    block column."""
    kind, bi, bj = F.col("kind"), F.col("bi"), F.col("bj")
    diagonal: list[np.ndarray] = []
    for k in range(nb):
        own = (kind == Placed.A) & (bi == k)
        small = (k + 1) * tile * tile * dtype.itemsize <= PANEL_BYTES
        column = placed.read((bj == k) & (kind == Placed.U))
        square = np.zeros((tile, tile), dtype)
        panel: dict[int, np.ndarray] | None = {} if small else None
        if small:
            for r in placed.read((bj == k) & (own | (kind == Placed.U))).select("kind", "bi", "data").collect():
                x = np.frombuffer(r["data"], dtype).reshape(tile, tile)
                if r["kind"] == Placed.A:
                    square = square + x
                else:
                    panel[r["bi"]] = x
                    square = square - x.conj().T @ x
        else:
            for x in _collected(placed.read((bj == k) & own), "bi", tile, dtype).values():
                square = square + x
            for r in column.select("data").mapInArrow(lambda batches: _squares(batches, tile, dtype), "data binary").toLocalIterator():  # one tile a task
                square = square - np.frombuffer(r[0], dtype).reshape(tile, tile)
        top = cholesky(square)
        if top is None:
            return k * tile + bad_pivot(square) + 1
        diagonal.append(top)
        rest = placed.read((bj > k) & (own | (kind == Placed.U))).select("bi", "bj", "data")
        if not small:
            rest = rest.join(column.select("bi", F.col("data").alias("l")), "bi", "left").select("bi", "bj", "data", "l").repartition(placed.devices, "bj")
        placed.put(_gathered(rest, panel, top, k, tile, dtype, True), Placed.U)
    return diagonal


def _squares(batches: Iterator[pa.RecordBatch], tile: int, dtype: np.dtype) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for data in batch.column("data"):
            x = np.frombuffer(data.as_buffer(), dtype).reshape(tile, tile)
            total = x.conj().T @ x if total is None else total + x.conj().T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(dtype).tobytes()], pa.binary())], names=["data"])


def _back(placed: Placed, diagonal: list[np.ndarray], nb: int, tile: int, dtype: np.dtype, own: int) -> DataFrame:
    """Solves U x = y for the further block columns, y being placed tiles of kind `own`. The tiles that x has."""
    kind, bi, bj = F.col("kind"), F.col("bi"), F.col("bj")
    for k in reversed(range(nb)):
        right = placed.read((kind == Placed.U) & (bi == k) & (bj < nb))
        x = placed.read((bj >= nb) & ((kind == own) & (bi == k) | (kind == Placed.X))).select("bi", "bj", "data")
        if (nb - k) * diagonal[k].nbytes <= PANEL_BYTES:
            panel = _collected(right, "bj", tile, dtype) if k < nb - 1 else {}
        else:
            panel = None
            x = x.join(right.select(F.col("bj").alias("bi"), F.col("data").alias("l")), "bi", "left").select("bi", "bj", "data", "l").repartition(placed.devices, "bj")
        placed.put(_gathered(x, panel, diagonal[k], k, tile, dtype, False), Placed.X)
    return placed.read(kind == Placed.X).select("bi", "bj", "data")


def _padded(a: MatrixFrame, tile: int) -> MatrixFrame:
    """Ones on the diagonal beyond the matrix, up to whole tiles."""
    whole = -(-a.rows // tile) * tile
    extra = a.spark.range(a.rows, whole).select(F.col("id").alias("i"), F.col("id").alias("j"), make(F.lit(1.0), F.lit(0.0), a.dtype).alias("v"))
    return matrix(a.cells.unionByName(extra), whole)


def _factored(a: MatrixFrame, tile: int, placed: Placed, b: MatrixFrame | None = None) -> list[np.ndarray] | int:
    nb = -(-a.rows // tile)
    if nb > MANY_ROWS:
        warnings.warn(f"tiles of {tile} columns make {nb} block rows, each a job or more; wider tiles make fewer", DenseWarning, stacklevel=3)
    tiles = to_tiles(_padded(a, tile), tile, upper=True, zeros=False)
    if b is not None:
        tiles = tiles.unionByName(to_tiles(b.with_cells(b.cells, nb * tile, b.cols), tile, upper=False, shift=nb, zeros=False))
    placed.put(tiles, Placed.A, dealt=False)
    return factor(placed, nb, tile, numpy_dtype(a.dtype))


def _not_definite(like: MatrixFrame, rows: int, cols: int, minor: int, upper: bool, failed_minor: bool) -> DataFrame:
    nan = make(F.lit(float("nan")), F.lit(float("nan") if is_complex(like.dtype) else 0.0), like.dtype)
    tasks = max(like.spark.sparkContext.defaultParallelism, rows * cols // TASK_CELLS + 1)
    out = run_places(block_runs(like.spark, rows, cols, tasks), cols, "j", upper).select("i", "j", nan.alias("v"), F.lit(NOT_DEFINITE).cast("int").alias("status"))
    return out.withColumn("failed_minor", F.lit(minor).cast("long")) if failed_minor else out


def _solved(cells: DataFrame, failed_minor: bool) -> DataFrame:
    out = cells.withColumn("status", F.lit(0).cast("int"))
    return out.withColumn("failed_minor", F.lit(None).cast("long")) if failed_minor else out


def chol_solve(a: MatrixFrame, b: MatrixFrame, tile: int = TILE, strict_limits: bool = False, check_symmetric: bool = False, failed_minor: bool = False) -> DataFrame:
    """A x = b: cells i, j, v and status (0, or 7 and NaN in every cell if A is not positive definite).

    `check_symmetric` compares A with its transpose first (ValueError if they differ). `failed_minor` adds a column of that
    name: the order (from 1) of the first leading minor of A that is not positive, null where all are.
    """
    check_solve(a, b, strict_limits)
    check_square(a, tile)
    if check_symmetric:
        check_symmetry(a)
    from gramforge.operators import apart

    pieces = apart.split(a)
    made = solve_whole(a, b, tile) if pieces is None else apart.solve(pieces, b, tile)
    if isinstance(made, int):
        return _not_definite(b, b.rows, b.cols, made, False, failed_minor)
    return _solved(made, failed_minor)


def _bounded(a: MatrixFrame, tile: int) -> int:
    return max(1, min(tile, a.rows, int((TILE_BYTES / numpy_dtype(a.dtype).itemsize) ** 0.5)))


def solve_whole(a: MatrixFrame, b: MatrixFrame, tile: int) -> DataFrame | int:
    """The cells of A^-1 b by tiles, or the order of A's first leading minor that is not positive."""
    tile, dtype = _bounded(a, tile), numpy_dtype(a.dtype)
    nb = -(-a.rows // tile)
    placed = Placed(a.spark, "solve", nb - (-b.cols // tile))
    made = _factored(a, tile, placed, b)
    if isinstance(made, int):
        placed.remove()
        return made
    x = _back(placed, made, nb, tile, dtype, Placed.U).withColumn("bj", F.col("bj") - nb)
    x = cut(filled(x, nb, -(-b.cols // tile), tile, dtype))
    placed.remove()
    return to_cells(x, b, tile, b.rows, b.cols)


def spd_inverse(a: MatrixFrame, tile: int = TILE, part: str = "full", check_symmetric: bool = False, failed_minor: bool = False) -> DataFrame:
    """A^-1: cells i, j, v, status; part 'upper' gives the upper triangle alone. The options are those of chol_solve.

    The factor U is inverted tile by tile from the last block row up, which stays upper triangular; A^-1 is the upper
    half of U^-1 U^-H by tiles, mirrored for the full one.
    """
    if part not in ("full", "upper"):
        raise ValueError("part must be 'full' or 'upper'")
    check_square(a, tile)
    if check_symmetric:
        check_symmetry(a)
    from gramforge.operators import apart

    pieces, upper = apart.split(a), part == "upper"
    made = inverse_whole(a, tile, upper) if pieces is None else apart.inverse(pieces, tile, upper)
    if isinstance(made, int):
        return _not_definite(a, a.rows, a.rows, made, upper, failed_minor)
    return _solved(made, failed_minor)


def inverse_whole(a: MatrixFrame, tile: int, upper: bool) -> DataFrame | int:
    """The cells of A^-1 (of its upper triangle) by tiles, or the order of A's first leading minor that is not positive."""
    tile, dtype = _bounded(a, tile), numpy_dtype(a.dtype)
    nb = -(-a.rows // tile)
    placed = Placed(a.spark, "inverse", 2 * nb)
    made = _factored(a, tile, placed)
    if isinstance(made, int):
        placed.remove()
        return made
    one = np.eye(tile, dtype=dtype).tobytes()
    placed.put(a.spark.range(nb).select(F.col("id").alias("bi"), (F.col("id") + nb).alias("bj"), F.lit(one).alias("data")), Placed.Y, dealt=False)
    inverse = _back(placed, made, nb, tile, dtype, Placed.Y).select("bi", (F.col("bj") - nb).alias("bj"), "data")
    top = cut(filled(upper_square(inverse, nb, tile, dtype), nb, nb, tile, dtype, upper=True))
    placed.remove()
    cells = to_cells(top, a, tile, a.rows, a.rows).filter("j >= i")
    if upper:
        return cells
    return cells.unionByName(cells.filter("j > i").select(F.col("j").alias("i"), F.col("i").alias("j"), conjugate(F.col("v"), a.dtype).alias("v")))


def upper_square(tiles: DataFrame, nb: int, tile: int, dtype: np.dtype) -> DataFrame:
    """The upper tiles of V V^H for upper triangular tiles V: each tile of V goes to the SUPER x SUPER groups of result tiles
    that use it, where block columns come one after another; nb^3 / 6 products in all."""
    last = (nb - 1) // SUPER
    # tile (i, k) is a left factor of (i, j) and a right one of (j, i) for j from i, or up to i, and at most k
    left = tiles.select(F.expr(f"bi div {SUPER}").alias("si"), F.explode(F.expr(f"sequence(bi div {SUPER}, least(bj div {SUPER}, {last}))")).alias("sj"), F.col("bj").alias("k"), F.lit(0).alias("side"), F.col("bi").alias("at"), "data")
    right = tiles.select(F.explode(F.expr(f"sequence(cast(0 as bigint), bi div {SUPER})")).alias("si"), F.expr(f"bi div {SUPER}").alias("sj"), F.col("bj").alias("k"), F.lit(1).alias("side"), F.col("bi").alias("at"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, column, held = None, None, []
        sums: dict[tuple[int, int], np.ndarray] = {}

        def settle(at: int, x: np.ndarray) -> None:
            for i, l in held:
                if i <= at:
                    made = l @ x.conj().T
                    sums[i, at] = sums[i, at] + made if (i, at) in sums else made

        for batch in batches:
            for si, sj, k, side, at, data in zip(*(batch.column(c).to_pylist() for c in ("si", "sj", "k", "side", "at")), batch.column("data"), strict=True):
                if (si, sj) != group:
                    for (i, j), x in sums.items():
                        yield _tile(i, j, x, dtype)
                    sums.clear()
                    group, column = (si, sj), None
                if k != column:
                    column, held = k, []
                x = np.frombuffer(data.as_buffer(), dtype).reshape(tile, tile)
                if side == 0:
                    held.append((at, x))
                else:
                    settle(at, x)
        for (i, j), x in sums.items():
            yield _tile(i, j, x, dtype)

    return left.unionByName(right).repartition("si", "sj").sortWithinPartitions("si", "sj", "k", "side", "at").mapInArrow(run, SCHEMA)


def _tile(bi: int, bj: int, x: np.ndarray, dtype: np.dtype) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([x.astype(dtype).tobytes()], pa.binary())], names=["bi", "bj", "data"])


def held_tiles(a: MatrixFrame, tall: int, wide: int) -> DataFrame:
    """The tiles, `tall` rows of `wide` columns, that cells touch, cells that occur twice summed: data, and mask, bits of the
    places that have a cell (null: all of them)."""
    dtype = numpy_dtype(a.dtype)
    re, im = parts(F.col("v"), a.dtype)
    coded = a.cells.select(F.expr(f"cast(i div {tall} as int)").alias("bi"), F.expr(f"cast(j div {wide} as int)").alias("bj"), F.expr(f"cast((i % {tall}) * {wide} + j % {wide} as int)").alias("p"), re.cast("double").alias("re"), im.cast("double").alias("im"))

    def dense(group: pd.DataFrame) -> pd.DataFrame:
        out, there, p = np.zeros(tall * wide, np.complex128), np.zeros(tall * wide, bool), group["p"].to_numpy()
        np.add.at(out.real, p, group["re"].to_numpy(float))
        np.add.at(out.imag, p, group["im"].to_numpy(float))
        there[p] = True
        return pd.DataFrame({"bi": group["bi"].iloc[:1], "bj": group["bj"].iloc[:1], "data": [(out if dtype.kind == "c" else out.real).astype(dtype).tobytes()], "mask": [None if there.all() else np.packbits(there).tobytes()]})

    return coded.groupBy("bi", "bj").applyInPandas(dense, f"{SCHEMA}, mask binary")


def _places(mask: bytes | None, tall: int, wide: int | None = None) -> np.ndarray:
    shape = (tall, wide or tall)
    return np.ones(shape, bool) if mask is None else np.unpackbits(np.frombuffer(mask, np.uint8), count=shape[0] * shape[1]).astype(bool).reshape(shape)


def _met(x: np.ndarray, there: np.ndarray, y: np.ndarray, here: np.ndarray) -> np.ndarray:
    """x y over pairs of cells that are both there; what isn't finite meets no missing cell."""
    bad = ~(np.isfinite(x).all(axis=0) & np.isfinite(y).all(axis=1))
    if not bad.any():
        return x @ y
    x, y, odd = x.copy(), y.copy(), np.flatnonzero(bad)
    extra = np.zeros((len(x), y.shape[1]), np.result_type(x, y))
    for k in odd:
        extra += np.where(np.outer(there[:, k], here[k]), x[:, k, None] * y[k], 0)
    x[:, odd] = 0
    y[odd] = 0
    return x @ y + extra


class _Product:
    """a b by the tiles that cells touch, with the meaning of matmul. Tiles are `tile` wide, but no wider than the inner
    dimension on that side. b is broadcast, a run of block columns of PANEL_BYTES at most for each pass; the tiles of a are dealt out by
    block row once and don't move again, and no pair of tiles is made. Where a block column of b is larger, or b takes
    MOST_PASSES or more, pairs of tiles are joined on the inner block."""

    def __init__(self, a: MatrixFrame, b: MatrixFrame, tile: int):
        ship_code(a.spark)
        self.a, self.b, self.tile, self.inner = a, b, tile, max(1, min(tile, a.cols))
        self.like = a if is_complex(a.dtype) or not is_complex(b.dtype) else b
        self.dtype = numpy_dtype(self.like.dtype)
        self.x = held_tiles(a, tile, self.inner).select("bi", F.col("bj").alias("k"), F.col("data").alias("l"), F.col("mask").alias("ml"))
        self.y = held_tiles(b, self.inner, tile).select(F.col("bi").alias("k"), "bj", F.col("data").alias("r"), F.col("mask").alias("mr"))
        column = -(-a.cols // self.inner) * self.inner * tile * numpy_dtype(b.dtype).itemsize
        self.columns = PANEL_BYTES // column
        self.passes = -(--(-b.cols // tile) // self.columns) if self.columns else 0

    def made(self, put, schema: str) -> DataFrame:
        """What `put` (an iterator of (bi, bj, total, there), there None where every place has a cell) makes of the tiles."""
        tile, inner = self.tile, self.inner
        wide = np.result_type(self.dtype, np.float64)
        left, right = (numpy_dtype(m.dtype) for m in (self.a, self.b))

        def number(data: pa.Scalar, kind: np.dtype, *shape: int) -> np.ndarray:
            return np.frombuffer(data, kind).reshape(shape).astype(wide)

        def added(at: tuple | None, l: tuple, r: tuple) -> tuple[np.ndarray, np.ndarray | None]:
            (x, mx), (y, my) = l, r
            made = _met(x, _places(mx, tile, inner), y, _places(my, inner, tile))
            there = None if mx is None and my is None else _places(mx, tile, inner).astype(np.float32) @ _places(my, inner, tile).astype(np.float32) > 0
            if at is None:
                return made, there
            return at[0] + made, None if at[1] is None or there is None else at[1] | there

        if not 0 < self.passes < MOST_PASSES:

            def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
                at, total = None, None
                for batch in batches:
                    for bi, bj, l, ml, r, mr in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj")), batch.column("l"), batch.column("ml").to_pylist(), batch.column("r"), batch.column("mr").to_pylist(), strict=True):
                        if (bi, bj) != at:
                            if at is not None:
                                yield *at, *total
                            at, total = (bi, bj), None
                        total = added(total, (number(l.as_buffer(), left, tile, inner), ml), (number(r.as_buffer(), right, inner, tile), mr))
                if at is not None:
                    yield *at, *total

            pairs = self.x.join(self.y, "k").select("bi", "bj", "l", "ml", "r", "mr").repartition("bi", "bj").sortWithinPartitions("bi", "bj")
            return pairs.mapInArrow(lambda batches: put(joined(batches)), schema)
        rows = self.x.repartition(min(int(self.a.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.a.rows // tile)), "bi").sortWithinPartitions("bi", "k")
        # read once for each pass
        rows, y = (rows, self.y) if self.passes == 1 else (cut(rows), cut(self.y))
        out = None
        for n in range(self.passes):
            held: dict[int, dict[int, tuple]] = {}
            for r in y.filter(F.col("bj").between(n * self.columns, (n + 1) * self.columns - 1)).toLocalIterator():
                held.setdefault(r["bj"], {})[r["k"]] = (bytes(r["r"]), None if r["mr"] is None else bytes(r["mr"]))
            one = self._pass(rows, held, number, added, left, right, put, schema)
            out = one if out is None else out.unionByName(one)
        return out

    def _pass(self, rows: DataFrame, held: dict, number, added, left: np.dtype, right: np.dtype, put, schema: str) -> DataFrame:
        tile, inner = self.tile, self.inner
        sent = self.a.spark.sparkContext.broadcast(held)

        def against(bi: int, own: dict[int, tuple]) -> Iterator[tuple]:
            for bj, column in sent.value.items():
                total = None
                for k in sorted(own.keys() & column.keys()):
                    data, mask = column[k]
                    total = added(total, own[k], (number(data, right, inner, tile), mask))
                if total is not None:
                    yield bi, bj, *total

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            at, own = None, {}
            for batch in batches:
                for bi, k, l, ml in zip(*(batch.column(c).to_pylist() for c in ("bi", "k")), batch.column("l"), batch.column("ml").to_pylist(), strict=True):
                    if bi != at:
                        if at is not None:
                            yield from against(at, own)
                        at, own = bi, {}
                    own[k] = number(l.as_buffer(), left, tile, inner), ml
            if at is not None:
                yield from against(at, own)

        return rows.mapInArrow(lambda batches: put(found(batches)), schema)


def tile_product(a: MatrixFrame, b: MatrixFrame, tile: int = TILE) -> MatrixFrame:
    """a b by the tiles that cells touch; the meaning is that of matmul."""
    product = _Product(a, b, tile)
    dtype = product.dtype

    def put(tiles: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for bi, bj, total, there in tiles:
            mask = None if there is None or there.all() else np.packbits(there.reshape(-1)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), pa.array([total.astype(dtype).tobytes()], pa.binary()), pa.array([mask], pa.binary())], names=["bi", "bj", "data", "mask"])

    return a.with_cells(to_cells(product.made(put, f"{SCHEMA}, mask binary"), product.like, tile, a.rows, b.cols), a.rows, b.cols)


def product_rows(a: MatrixFrame, b: MatrixFrame, tile: int = TILE) -> DataFrame:
    """(i, cells, total, squares): how many cells row i of a b has, their sum and the sum of their squares, of real matrices.
    The product is made tile by tile, and a tile is summed by row where it is made."""
    if is_complex(a.dtype) or is_complex(b.dtype):
        raise TypeError("rows are summed of real matrices")
    product = _Product(a, b, tile)
    dtype = product.dtype

    def put(tiles: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None

        def made() -> pa.RecordBatch:
            own = np.flatnonzero(sums[0])
            return pa.RecordBatch.from_arrays([pa.array(own + at * tile), pa.array(sums[0][own].astype(np.int64)), pa.array(sums[1][own]), pa.array(sums[2][own])], names=["i", "cells", "total", "squares"])

        for bi, _, total, there in tiles:
            if bi != at:
                if at is not None:
                    yield made()
                at, sums = bi, np.zeros((3, tile))
            v = total.astype(dtype).astype(float)
            if there is not None:
                v = np.where(there, v, 0)
            sums += [np.full(tile, v.shape[1]) if there is None else there.sum(axis=1), v.sum(axis=1), np.einsum("ij,ij->i", v, v)]
        if at is not None:
            yield made()

    parts_ = product.made(put, "i long, cells long, total double, squares double")
    return parts_.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("cells", "total", "squares")])
