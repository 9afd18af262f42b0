"""Matrices from tables: Gram matrices, normal equations, covariances. Sums are partial before any shuffle."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.operators.vectors import row_sums
from gramforge.plans.frame import MatrixFrame, REPLICATED, matrix
from gramforge.sources.folders import ship_code


def vector_products(rows: DataFrame, vector: str, n: int) -> DataFrame:
    """Upper cells (i, j, v) of X^T X, one set for each task (or piece of a stream): products are summed where rows are
    read. Null vectors are left out, null elements are 0, vectors of another length are an error."""
    i, j = np.triu_indices(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            x = batch.column("x").drop_null()
            if any(size != n for size in pc.unique(pc.list_value_length(x)).to_pylist()):
                raise ValueError(f"vectors must have {n} elements")
            flat = pc.fill_null(x.flatten(), 0.0).to_numpy().reshape(-1, n)
            total += flat.T @ flat
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    return rows.select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, "i long, j long, v double")


def gram(rows: DataFrame, vector: str, n: int) -> MatrixFrame:
    """X^T X of an array column: the tasks' products summed, then mirrored."""
    top = vector_products(rows, vector, n).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return matrix(top.unionByName(top.filter("j > i").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")), n)


def label_sums(rows: DataFrame, vector: str, label: str, n: int, labels: int) -> MatrixFrame:
    """One right-hand side for each label 0..labels-1: the sum of its vectors, summed where rows are read. Rows without a
    vector or label are left out, null elements are 0, vectors of another length are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((labels, n)), np.zeros(labels, bool)
        for batch in batches:
            if any(size != n for size in pc.unique(pc.list_value_length(batch.column("x"))).to_pylist()):
                raise ValueError(f"vectors must have {n} elements")
            own, sums = row_sums(batch.column("l").to_numpy(), pc.fill_null(batch.column("x").flatten(), 0.0).to_numpy().reshape(-1, n))
            total[own] += sums
            met[own] = True
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(n), len(at))), pa.array(np.repeat(at, n)), pa.array(total[at].reshape(-1))], names=["i", "j", "v"])

    ship_code(rows.sparkSession)
    known = rows.select(F.col(label).cast("long").alias("l"), F.col(vector).cast("array<double>").alias("x")).filter(F.col("l").between(0, labels - 1) & F.col("x").isNotNull())
    sums = known.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return matrix(sums, n, labels, REPLICATED)


def normal_equations(rows: DataFrame, features: list[Column], target: Column) -> tuple[MatrixFrame, MatrixFrame]:
    """X^T X and X^T y of a few feature columns, in one aggregation without an exploded row."""
    n = len(features)
    aggs = [F.sum(features[i] * features[j]).alias(f"a_{i}_{j}") for i in range(n) for j in range(i, n)]
    sums = rows.agg(*aggs, *[F.sum(f * target).alias(f"b_{i}") for i, f in enumerate(features)])
    cell = lambda i, j, c: F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(c).alias("v"))
    a = sums.select(F.inline(F.array(*[cell(i, j, f"a_{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(n)])))
    b = sums.select(F.inline(F.array(*[cell(i, 0, f"b_{i}") for i in range(n)])))
    return matrix(a, n), matrix(b, n, 1, REPLICATED)


def covariance_by_group(rows: DataFrame, group: str, x: Column, y: Column) -> DataFrame:
    """Cells (group, i, j, v) of each group's population covariance of two columns."""
    stats = rows.groupBy(group).agg(F.var_pop(x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.var_pop(y).alias("yy"))
    cell = lambda i, j, c: F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(c).alias("v"))
    return stats.select(group, F.inline(F.array(cell(0, 0, "xx"), cell(0, 1, "xy"), cell(1, 0, "xy"), cell(1, 1, "yy"))))


def read_timings(spark: SparkSession, root: str) -> DataFrame:
    """(path, seconds): the numbers of all N_*.npy files under a folder, one row each; files without numbers give none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "N_*.npy").load(root).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                seconds = np.load(io.BytesIO(content), allow_pickle=False).astype(float).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(seconds), pa.string()), pa.array(seconds)], names=["path", "seconds"])

    return files.mapInArrow(run, "path string, seconds double")


def bench_medians(timings: DataFrame, least_tile: int = 0) -> DataFrame:
    """From (path, seconds), paths ending in <gpu>/<dtype>/ndev_<k>/N_<n>_T_A_<tile>.npy or N_<n>_chosolve.npy (a run
    without tiles: tile is null): gpu, dtype, ndev, tile, n, the median of the runs and their number. Other paths, and
    tiles narrower than least_tile, are left out."""
    pattern = r"([^/]+)/([^/]+)/ndev_(\d+)/N_(\d+)_(?:T_A_(\d+)|chosolve)\.npy$"
    part = lambda k: F.regexp_extract("path", pattern, k)
    tile = F.when(part(5) != "", part(5).cast("int"))
    parsed = timings.filter(F.col("path").rlike(pattern)).select(part(1).alias("gpu"), part(2).alias("dtype"), part(3).cast("int").alias("ndev"), tile.alias("tile"), part(4).cast("long").alias("n"), "seconds")
    kept = parsed.filter(F.col("tile").isNull() | (F.col("tile") >= least_tile))
    return kept.groupBy("gpu", "dtype", "ndev", "tile", "n").agg(F.median("seconds").alias("median_s"), F.count(F.lit(1)).alias("runs"))


def timing_lines(medians: DataFrame, by: str) -> DataFrame:
    """The medians as lines over n: for each gpu, dtype and the other one of (tile, ndev), a line for each value of `by`
    with its arrays ns and seconds by ascending n; runs without tiles have lines of their own."""
    if by not in ("tile", "ndev"):
        raise ValueError("by must be 'tile' or 'ndev'")
    points = F.array_sort(F.collect_list(F.struct("n", "median_s")))  # one number for each n that was timed
    lines = medians.groupBy("gpu", "dtype", "ndev", "tile").agg(points.alias("points"))
    label = F.coalesce(F.concat(F.lit(f"{by}="), F.col(by).cast("string")), F.lit("untiled"))
    other = "ndev" if by == "tile" else "tile"
    return lines.select("gpu", "dtype", other, label.alias("line"), F.transform("points", lambda p: p["n"]).alias("ns"), F.transform("points", lambda p: p["median_s"]).alias("seconds"))


def process_status(lines: DataFrame, expected: int) -> DataFrame:
    """From log lines (line), one row: ok and failed results, and how many of the processes 0..expected-1 said nothing.
    Results are lines MPTEST_RESULT {json with proc, name, status}, summaries MPTEST_SUMMARY {json with proc}; other
    lines, and those whose json can't be read, count for nothing."""
    kind = F.regexp_extract("line", r"^(MPTEST_RESULT|MPTEST_SUMMARY) ", 1)
    body = F.from_json(F.regexp_extract("line", r"^\S+ (.*)$", 1), "proc long, name string, status string")
    said = lines.select(kind.alias("kind"), body.alias("b")).filter("kind <> '' and b.proc is not null")
    result = lambda status: F.coalesce(F.sum(((F.col("kind") == "MPTEST_RESULT") & (F.col("b.status") == status)).cast("long")), F.lit(0).cast("long"))
    seen = F.count_distinct(F.when((F.col("b.proc") >= 0) & (F.col("b.proc") < expected), F.col("b.proc")))
    return said.agg(result("ok").alias("ok"), result("fail").alias("failed"), (F.lit(expected) - seen).cast("long").alias("silent"))
