"""Shared folders, code shipping, range buckets and null-safe column helpers for the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.sources.folders import shared_base

LOWEST = -(1 << 63)
MAX_BUCKETS = 65_536
#: Bytes of an Arrow batch on its way to a Python worker; the next text may go beyond it.
BATCH_BYTES = 8 << 20


def ship_code(spark: SparkSession) -> None:
    """Give executors this package (once a context), so that worker processes import it wherever they start, and keep
    batches of texts small, however long the texts are."""
    sc = spark.sparkContext
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if getattr(sc, "_gramforge_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="gramforge-"), "gramforge_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._gramforge_shipped = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one in local mode, else an error."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1, ..., which clash with no working column, and their names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored intermediate tables of one operator, removed together when its result is stored."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, shared_dir(spark, name), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        out = stored(df, name, f"{self.root}/{self.n:03d}-{name}")
        # Spark's cleaner removes the shuffle files of what is written once the driver has collected its garbage
        self.spark.sparkContext._jvm.System.gc()
        return out

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def task_count(df: DataFrame, text_col: str | None = None, task_bytes: int = 16 << 20) -> int:
    """Tasks for a shuffle that carries the texts: by their bytes, at least the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if text_col is None:
        return least
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, min(MAX_BUCKETS, max(least, total // task_bytes + 1)))


def constants(values: list[int]) -> Column:
    """A constant array of BIGINT, as one expression."""
    return F.expr(f"array({', '.join(f"bigint('{v}')" for v in values)})")


def bucket_of(first: str, second: str, bounds: list[tuple[int, int]]) -> Column:
    """How many of the ascending bounds are at most the pair of two columns, by binary search over a constant array."""
    if not bounds:
        return F.lit(0)
    steps = max(1, len(bounds).bit_length())
    key = F.struct(F.col(first).alias("a"), F.col(second).alias("b"))
    # one literal once Spark has folded it
    array = F.expr(f"array({', '.join(f"named_struct('a', bigint('{a}'), 'b', bigint('{b}'))" for a, b in bounds)})")

    def step(at: Column, half: Column) -> Column:
        nxt = (at + half).cast("int")
        return F.when(F.coalesce(F.get(array, nxt - 1) <= key, F.lit(False)), nxt).otherwise(at)

    halves = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    return F.aggregate(halves, F.lit(0), step)


def id_bounds(df: DataFrame, key: str, spread: str, buckets: int) -> tuple[Column, list[tuple[int, int]]]:
    """The bucket of a row, and the bounds (key, spread) of the buckets: quantiles of an integer key; a key that is several
    quantiles is cut by `spread`, a hash that rows of one key have. At most MAX_BUCKETS values reach the driver."""
    bounds: list[tuple[int, int]] = []
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        got = df.agg(F.percentile_approx(F.col(key), at, max(10_000, 20 * buckets)).alias("b")).first()[0]
        for v, times in sorted(Counter(got or []).items()):
            bounds += [(v, LOWEST + j * ((1 << 64) // times)) for j in range(times)]
    return bucket_of(key, spread, bounds), bounds
