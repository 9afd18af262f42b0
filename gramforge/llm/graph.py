"""Connected components of an edge table by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gramforge.llm.runtime import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(v, c) for every end of an edge (a, b): c is the least vertex of v's component. Loops and repeats do no harm.

    `edges` is to be a stored table, since the first round reads it several times. A round is one job: its rows are
    counted and summed as they are stored, and a round that changes nothing is the last.
    """
    now, state = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b")))
        now, new = _kept(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), scratch)
        if new == state:
            return now.select(F.col("a").alias("v"), F.col("b").alias("c")).union(now.select(F.col("b").alias("v"), F.col("b").alias("c"))).distinct()
        state = new
    raise RuntimeError("components did not settle")


def _kept(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    seen = Observation()
    told = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    out = scratch.keep(told, "edges")
    return out, (seen.get["n"], seen.get["s"])
