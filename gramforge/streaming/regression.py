"""Least squares over a sliding window of a stream: a triangular factor as state, changed by rank-k updates and downdates.

The state is R of the window's rows [features, target] (R^T R is their Gram matrix, never formed). A micro-batch makes
the R of its own rows and that of the stored rows which leave the window, each by a tree: tasks factor what they read,
and what they hand on are triangles of the features' size. The driver stacks the triangles of what came under R
(update) and takes those of what left off it by hyperbolic rotations (downdate).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gramforge.plans.frame import NOT_DEFINITE
from gramforge.sources.folders import ship_code

STATE = "batch long, top timestamp, cut timestamp, rows long, downdated boolean, r array<double>"
ROWS = "ts timestamp, x array<double>"


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of some rows, square, with a diagonal that isn't negative; zeros where rows are fewer than columns."""
    n = rows.shape[1]
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, n))
    r = np.concatenate([r, np.zeros((n - len(r), n))])
    return r * np.where(np.diagonal(r) < 0, -1.0, 1.0)[:, None]


def downdate(r: np.ndarray, gone: np.ndarray) -> np.ndarray | None:
    """The R of what is left when rows of the triangle `gone` go, by hyperbolic rotations row by row; None where the
    window would lose its rank, or come so near to it that rounding decides."""
    r = r.copy()
    n = len(r)
    for row in gone:
        x = row.copy()
        for k in range(n):
            if x[k] == 0:
                continue
            left = r[k, k] ** 2 - x[k] ** 2
            if not left > 1e-8 * r[k, k] ** 2:
                return None
            d = np.sqrt(left)
            c, s = d / r[k, k], x[k] / r[k, k]
            r[k, k:] = (r[k, k:] - s * x[k:]) / c
            x[k:] = c * x[k:] - s * r[k, k:]
    return r


def _factor(rows: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """R of all rows x, and their number: triangles by task, then by pairs of tasks' hundreds, the last ones here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = np.zeros((0, n)), 0
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy().reshape(-1, n)
            weight = batch.column("n").to_numpy()
            count += int(weight.sum())
            held = triangle(np.concatenate([held, flat]))
        if count:
            # a triangle's rows; the count stands in the first
            yield pa.RecordBatch.from_arrays([pa.array(held.tolist(), pa.list_(pa.float64())), pa.array([count] + [0] * (n - 1), pa.int64())], names=["x", "n"])

    shape = "x array<double>, n long"
    parts = rows.select("x", F.lit(1).cast("long").alias("n")).mapInArrow(run, shape)
    # a hundred tasks' triangles at a time, so that few reach the driver
    got = parts.coalesce(max(1, -(-parts.rdd.getNumPartitions() // 100))).mapInArrow(run, shape).collect()
    made = np.array([r["x"] for r in got]).reshape(-1, n)
    return triangle(made), sum(r["n"] for r in got)


class SlidingRegression:
    """Regression of a target on features over the last `window` of event time, as far as the stream has come.

    Rows with a null among time, features and target are left out, late ones count if they are within the window still.
    State and rows of a batch are written under `folder` by its number and read again by the next one, so a batch that
    runs twice gives the same; rows that no window needs any more stay there until the folder goes.
    """

    def __init__(self, folder: str, ts: str, features: list[Column], target: Column, window: timedelta):
        self.folder, self.ts, self.window, self.n = folder, ts, window, len(features) + 1
        self.x = F.array(*[c.cast("double") for c in (*features, target)])

    def _rows(self, spark: SparkSession, before: int) -> DataFrame:
        """Stored rows of the batches before one; later ones are of a run that was broken off."""
        if not before:
            return spark.createDataFrame([], ROWS)
        return spark.read.schema(f"{ROWS}, batch long").parquet(f"{self.folder}/rows").filter(F.col("batch") < before).select("ts", "x")

    def state(self, spark: SparkSession, batch: int) -> dict | None:
        if batch < 0:
            return None
        return spark.read.schema(STATE).parquet(f"{self.folder}/state/batch={batch}").first().asDict()

    def process(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        ship_code(spark)
        last = self.state(spark, batch - 1)
        new = df.select(F.col(self.ts).cast("timestamp").alias("ts"), self.x.alias("x")).filter(F.col("ts").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
        if last and last["cut"] is not None:
            new = new.filter(F.col("ts") > F.lit(last["cut"]))
        # stored first: what the window keeps is read from here on
        new.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        came = spark.read.schema(ROWS).parquet(f"{self.folder}/rows/batch={batch}")
        top = max([t for t in (came.agg(F.max("ts")).first()[0], last["top"] if last else None) if t is not None], default=None)
        cut: datetime | None = top - self.window if top is not None else None
        r = np.array(last["r"]).reshape(self.n, self.n) if last else np.zeros((self.n, self.n))
        rows, downdated = (last["rows"] if last else 0), True
        if cut is not None:
            inside = F.col("ts") > F.lit(cut)
            added, n_added = _factor(came.filter(inside), self.n)
            r = triangle(np.concatenate([r, added]))
            left = self._rows(spark, batch).filter(~inside & (F.col("ts") > F.lit(last["cut"]))) if last and last["cut"] is not None else None
            gone, n_gone = _factor(left, self.n) if left is not None else (None, 0)
            rows += n_added - n_gone
            if n_gone:
                less = downdate(r, gone)
                downdated = less is not None
                # near a loss of rank the window's rows are factored anew
                r = less if downdated else _factor(self._rows(spark, batch).unionByName(came).filter(inside), self.n)[0]
        out = [(batch, top, cut, rows, downdated, [float(v) for v in r.reshape(-1)])]
        spark.createDataFrame(out, STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def solution(self, spark: SparkSession, batch: int) -> DataFrame:
        """The coefficients after a batch: i, v, rows, status (7 and NaN where the window's features lack full rank)."""
        state = self.state(spark, batch)
        r, n = np.array(state["r"]).reshape(self.n, self.n), self.n - 1
        size = np.abs(np.diagonal(r)[:n])
        if n and size.min() > 1e-12 * max(size.max(), 1e-300):
            x, status = np.linalg.solve(r[:n, :n], r[:n, n]), 0
        else:
            x, status = np.full(n, np.nan), NOT_DEFINITE
        return spark.createDataFrame([(i, float(v), state["rows"], status) for i, v in enumerate(x)], "i long, v double, rows long, status int")
