"""Matrices that fall apart into components (rows joined by cells beside the diagonal), each a matrix of its own.

Tasks reduce the cells that they read to a forest over the rows, and one more merges the forests: a number for each row is
what it holds. Rows without a neighbour are divided by column functions, a component of SMALL rows at most is a dense matrix of
one task, and larger ones are numbered anew and go by tiles. Between components everything is zero, so no tile is made and
nothing moves there; zeros that belong to a result are generated where it is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramforge.functions import layout
from gramforge.functions.dtypes import NAMES, REAL, is_complex, make, parts
from gramforge.operators.tiled import TASK_CELLS, bad_pivot, cholesky, cut, inverse_whole, solve_whole
from gramforge.plans.frame import MatrixFrame, matrix
from gramforge.sources.folders import ship_code

#: Matrices of at most so many rows are taken whole.
SPLIT = 1024
#: Rows of a component that is a dense matrix in one task.
SMALL = 512
CELLS = "i long, j long, re double, im double, minor long"


def _forest(edges: DataFrame, n: int, last: bool) -> DataFrame:
    """Edges (a, b) that join what the edges of a partition join: (row, least row of its component). With `last` also the
    number of rows, for every row of a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None
        for batch in batches:
            if not batch.num_rows:
                continue
            least = np.arange(n) if least is None else least
            u, v = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            while True:
                x, y = least[u], least[v]
                differ = x != y
                if not differ.any():
                    break
                u, v = u[differ], v[differ]
                np.minimum.at(least, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
                while not np.array_equal(up := least[least], least):
                    least = up
        if least is None:
            return
        size = np.bincount(least, minlength=n)[least]
        at = np.flatnonzero(size > 1 if last else least != np.arange(n))
        for k in range(0, len(at), 1 << 16):
            own = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(least[own]), pa.array(size[own])], names=["a", "b", "size"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long, size long")


@dataclass(frozen=True)
class Apart:
    """alone: (i, d), the rows without a neighbour and their diagonal; linked: (i, c, size), the other rows, c being the
    least row of the component; large: the c of components of more than SMALL rows."""

    a: MatrixFrame
    alone: DataFrame
    linked: DataFrame
    large: tuple[int, ...]

    def tasks(self, rows: float) -> int:
        """For a result of so many rows of n cells."""
        return max(int(self.a.spark.conf.get("spark.sql.shuffle.partitions")), int(rows * self.a.rows / TASK_CELLS) + 1)

    def runs(self) -> DataFrame:
        """All places as runs (i, low), some blocks of them a task."""
        return layout.block_runs(self.a.spark, self.a.rows, self.a.rows, self.tasks(self.a.rows))

    def beside(self, runs: DataFrame, name: str, upper: bool = False) -> DataFrame:
        """The columns of runs (c, low, others) that aren't of the component of c, its least row (which a row alone is of itself)."""
        step = lambda i: (F.col(i) - F.col("low")).cast("int")
        own = F.when(F.col("c").between(F.col("low"), F.col("low") + layout.WIDE - 1), F.array(step("c")))
        if self.linked.head(1):
            # a number for each row of A, WIDE in an array at most
            rows = self.linked.select("c", "i", (F.col("i") - F.col("i") % layout.WIDE).alias("low")).groupBy("c", "low").agg(F.collect_list(step("i")).alias("others"))
            runs = runs.join(F.broadcast(rows), ["c", "low"], "left")
            own = F.coalesce("others", own)
        return layout.run_places(runs.withColumn("but", own).drop("c", "others"), self.a.rows, name, upper, "but")

    def grouped(self, cells: DataFrame) -> DataFrame:
        """Cells (i, j, re, im, side) with the component of their row i, of the small ones."""
        return cells.join(self.linked.filter(F.col("size") <= SMALL), "i").select("c", "i", "j", "re", "im", "side")

    def numbered(self, c: int) -> tuple[MatrixFrame, DataFrame]:
        """A large component as a matrix, and its rows (i, p): p is the new number of row i."""
        # a component's row numbers, whatever its cells took
        at = cut(self.linked.filter(F.col("c") == c).select("i", (F.row_number().over(Window.orderBy("i")) - 1).cast("long").alias("p")))
        own = self.a.cells.filter("j >= i").join(at, "i").select(F.col("p").alias("x"), F.col("j").alias("i"), "v").join(at, "i")
        return matrix(own.select(F.col("x").alias("i"), F.col("p").alias("j"), "v"), at.count()), at


def split(a: MatrixFrame) -> Apart | None:
    """The components of a by its upper triangle; None if it is one, or small."""
    if a.rows <= SPLIT:
        return None
    ship_code(a.spark)
    re, im = parts(F.col("v"), a.dtype)
    edges = a.cells.filter("j > i").filter((re != 0) | (im != 0)).select(F.col("i").alias("a"), F.col("j").alias("b"))
    linked = cut(_forest(_forest(edges, a.rows, False).repartition(1), a.rows, True).select(F.col("a").alias("i"), F.col("b").alias("c"), "size"))
    if linked.agg(F.max("size")).first()[0] == a.rows:
        return None
    large = tuple(r[0] for r in linked.filter((F.col("i") == F.col("c")) & (F.col("size") > SMALL)).select("i").collect())
    diagonal = a.cells.filter("i = j").groupBy("i").agg(F.sum(re.cast("double")).alias("d"))
    rows = a.spark.range(a.rows).select(F.col("id").alias("i")).join(linked.select("i"), "i", "left_anti")
    alone = cut(rows.join(diagonal, "i", "left").select("i", F.coalesce("d", F.lit(0.0)).alias("d")))
    return Apart(a, alone, linked, large)


def _coded(a: MatrixFrame, side: int) -> DataFrame:
    re, im = parts(F.col("v"), a.dtype)
    return a.cells.select("i", "j", re.cast("double").alias("re"), im.cast("double").alias("im"), F.lit(side).alias("side"))


def _dense(g: pd.DataFrame, complex_: bool) -> tuple[np.ndarray, np.ndarray]:
    """A component's rows, ascending, and the upper triangle of its matrix."""
    own = g[g["side"] == 0]
    i, j = own["i"].to_numpy(), own["j"].to_numpy()
    rows = np.unique(np.concatenate([i, j]))
    out = np.zeros((len(rows), len(rows)), np.complex128 if complex_ else np.float64)
    np.add.at(out, (np.searchsorted(rows, i), np.searchsorted(rows, j)), own["re"].to_numpy(float) + 1j * own["im"].to_numpy(float) if complex_ else own["re"].to_numpy(float))
    return rows, out


def _number(name: str) -> Column:
    """pandas hands NaN back as null."""
    return F.coalesce(name, F.lit(float("nan"))).alias(name)


def _definite(apart: Apart, cells: DataFrame, inverse: bool) -> DataFrame:
    """CELLS of the solutions (or inverses) of the small components; one row with its order in A where a minor is bad."""
    complex_ = is_complex(apart.a.dtype)

    def work(g: pd.DataFrame) -> pd.DataFrame:
        rows, whole = _dense(g, complex_)
        top = cholesky(whole)
        if top is None:
            return pd.DataFrame({"i": [-1], "j": [-1], "re": [0.0], "im": [0.0], "minor": [int(rows[bad_pivot(whole)]) + 1]})
        if inverse:
            columns, right = rows, np.eye(len(rows), dtype=whole.dtype)
        else:
            own = g[g["side"] == 1]
            columns = np.unique(own["j"].to_numpy())
            right = np.zeros((len(rows), len(columns)), whole.dtype)
            np.add.at(right, (np.searchsorted(rows, own["i"].to_numpy()), np.searchsorted(columns, own["j"].to_numpy())), own["re"].to_numpy(float) + 1j * own["im"].to_numpy(float) if complex_ else own["re"].to_numpy(float))
        x = np.linalg.solve(top, np.linalg.solve(top.conj().T, right))
        return pd.DataFrame({"i": np.repeat(rows, len(columns)), "j": np.tile(columns, len(rows)), "re": x.real.reshape(-1), "im": x.imag.reshape(-1), "minor": 0})

    made = cut(apart.grouped(cells).groupBy("c").applyInPandas(work, CELLS))  # SMALL rows at most
    return made.select("i", "j", _number("re"), _number("im"), "minor")


def _first_minor(apart: Apart, small: DataFrame) -> list[int]:
    """The order of the first bad leading minor of A by what isn't a large component."""
    bad = apart.alone.filter(~((F.col("d") > 0) & (F.col("d") < float("inf")))).agg((F.min("i") + 1).alias("m"))
    return [r[0] for r in bad.unionByName(small.filter("minor > 0").agg(F.min("minor").alias("m"))).collect() if r[0] is not None]


def _at(rows: DataFrame, p: int) -> int:
    return rows.filter(F.col("p") == p).first()["i"]


def solve(apart: Apart, b: MatrixFrame, tile: int) -> DataFrame | int:
    """All cells of A^-1 b, or the order of A's first bad leading minor."""
    a, dtype = apart.a, b.dtype
    small = _definite(apart, _coded(a, 0).filter("j >= i").unionByName(_coded(b, 1)), False)
    minors, found = _first_minor(apart, small), []
    for c in apart.large:
        own, rows = apart.numbered(c)
        right = b.cells.join(rows, "i").select(F.col("p").alias("i"), "j", "v")
        made = solve_whole(own, b.with_cells(right, own.rows, b.cols), tile)
        if isinstance(made, int):
            minors.append(_at(rows, made - 1) + 1)
        else:
            found.append(made.withColumnRenamed("i", "p").join(rows, "p").select("i", "j", "v"))
    if minors:
        return min(minors)
    sides = _coded(b, 1).groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    found.append(sides.join(apart.alone, "i").select("i", "j", make(F.col("re") / F.col("d"), F.col("im") / F.col("d"), dtype).alias("v")))
    found.append(small.select("i", "j", make(F.col("re"), F.col("im"), dtype).alias("v")))
    x = found[0]
    for more in found[1:]:
        x = x.unionByName(more)
    places = a.spark.range(a.rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b.cols - 1).cast("long"))).alias("j"))
    return cut(places.join(x, ["i", "j"], "left").select("i", "j", F.coalesce("v", make(F.lit(0.0), F.lit(0.0), dtype)).alias("v")))


def inverse(apart: Apart, tile: int, upper: bool) -> DataFrame | int:
    """All cells of A^-1 (of its upper triangle), or the order of A's first bad leading minor. Zeros are generated block by
    block, beside what is stored."""
    a, n = apart.a, apart.a.rows
    zero = make(F.lit(0.0), F.lit(0.0), a.dtype).alias("v")
    small = _definite(apart, _coded(a, 0).filter("j >= i"), True)
    minors, found = _first_minor(apart, small), []
    for c in apart.large:
        own, rows = apart.numbered(c)
        made = inverse_whole(own, tile, upper)
        if isinstance(made, int):
            minors.append(_at(rows, made - 1) + 1)
        else:
            made = made.withColumnRenamed("i", "p").join(rows, "p").select(F.col("i").alias("x"), F.col("j").alias("p"), "v").join(rows, "p")
            found.append(made.select(F.col("x").alias("i"), F.col("i").alias("j"), "v"))
    if minors:
        return min(minors)
    cells = small.select("i", "j", make(F.col("re"), F.col("im"), a.dtype).alias("v"))
    cells = cells.unionByName(apart.alone.select("i", F.col("i").alias("j"), make(1 / F.col("d"), F.lit(0.0), a.dtype).alias("v")))
    for more in found:
        cells = cells.unionByName(more)
    if upper:
        cells = cells.filter("j >= i")
    runs = apart.runs().withColumn("c", F.col("i"))
    if apart.linked.head(1):
        runs = runs.drop("c").join(F.broadcast(apart.linked.select("i", "c")), "i", "left").withColumn("c", F.coalesce("c", "i"))  # two numbers for each row of A
    return cells.unionByName(apart.beside(runs, "j", upper).select("i", "j", zero))


def eigen(apart: Apart, vectors: bool, whole, value: Callable[[Column], Column] | None = None) -> DataFrame:
    """k, lambda (ascending) and, with vectors, vec of all components; `whole` finds (k, lambda, vec) of a large one. With
    `value`, a function of lambda, the vectors' cells k, i, lambda, x instead."""
    a, n, complex_ = apart.a, apart.a.rows, is_complex(apart.a.dtype)
    kind = "lambda double, at array<long>, re array<double>, im array<double>"

    def work(g: pd.DataFrame) -> pd.DataFrame:
        rows, top = _dense(g, complex_)
        full = np.triu(top) + np.triu(top, 1).conj().T
        if not vectors:
            lam = np.linalg.eigvalsh(full)
            return pd.DataFrame({"lambda": lam, "at": [rows[:1]] * len(lam), "re": [[0.0]] * len(lam), "im": [[0.0]] * len(lam)})
        lam, v = np.linalg.eigh(full)
        lead = v[(np.abs(v) > 1e-9).argmax(axis=0), np.arange(len(lam))]
        v = (v * (lead.conj() / np.abs(lead))).T
        return pd.DataFrame({"lambda": lam, "at": [rows] * len(lam), "re": list(v.real.copy()), "im": list(v.imag.copy())})

    one = lambda x: F.array(F.lit(x))
    found = apart.alone.select(F.col("d").alias("lambda"), F.array("i").alias("at"), one(1.0).alias("re"), one(0.0).alias("im"))
    small = apart.grouped(_coded(a, 0).filter("j >= i")).groupBy("c").applyInPandas(work, kind)  # SMALL rows at most
    found = found.unionByName(small)
    for c in apart.large:
        own, rows = apart.numbered(c)
        made = whole(own)
        if vectors and made.filter("status <> 0").head(1):
            return made.sparkSession.range(n).select(F.col("id").alias("k"), F.lit(None).cast("double").alias("lambda"))
        if vectors:
            re, im = (F.transform("vec", f) for f in (lambda v: parts(v, a.dtype)[0].cast("double"), lambda v: parts(v, a.dtype)[1].cast("double")))
            # one row: the component's row numbers, as long as each of its vectors
            at = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "i"))), lambda r: r["i"]).alias("at"))
            made = made.crossJoin(F.broadcast(at)).select(F.col("lambda").cast("double").alias("lambda"), "at", re.alias("re"), im.alias("im"))
        else:
            made = made.select(F.col("lambda").cast("double").alias("lambda"), F.array(F.lit(c).cast("long")).alias("at"), one(0.0).alias("re"), one(0.0).alias("im"))
        found = found.unionByName(made)
    stored = cut(found.withColumn("c", F.monotonically_increasing_id()))
    # n values, whatever the matrix took
    ranked = stored.select("lambda", "c").withColumn("k", F.row_number().over(Window.orderBy("lambda", "c")).cast("long") - 1)
    real = F.col("lambda").cast(NAMES[REAL[a.dtype]]).alias("lambda")
    if not vectors:
        return ranked.select("k", real)
    if value is not None:
        pairs = ranked.withColumn("lambda", value(real)).join(stored.drop("lambda"), "c")
        cells = pairs.select("k", "lambda", F.explode(F.arrays_zip("at", "re", "im")).alias("p")).select("k", F.col("p.at").alias("i"), "lambda", make(F.col("p.re"), F.col("p.im"), a.dtype).alias("x"))
        known = F.broadcast(pairs.select(F.col("k").alias("i"), "lambda", F.get("at", F.lit(0)).alias("c")))  # three numbers for each row of A
        zero = make(F.lit(0.0), F.lit(0.0), a.dtype).alias("x")
        return cells.unionByName(apart.beside(apart.runs().join(known, "i"), "j").select(F.col("i").alias("k"), F.col("j").alias("i"), "lambda", zero))
    stored = ranked.join(stored.drop("lambda"), "c").repartition(apart.tasks(n), "k")
    zeros = lambda c: F.array_repeat(make(F.lit(0.0), F.lit(0.0), a.dtype), c.cast("int"))
    last = F.element_at("at", -1)
    before = F.concat(F.array(F.lit(-1).cast("long")), F.slice("at", 1, F.size("at") - 1))
    piece = lambda t: F.concat(zeros(t["at"] - t["before"] - 1), F.array(make(t["re"], t["im"], a.dtype)))
    pieces = F.transform(F.arrays_zip("at", "before", "re", "im"), piece)
    return stored.withColumn("before", before).select("k", real, F.flatten(F.concat(pieces, F.array(zeros(n - 1 - last)))).alias("vec"))
