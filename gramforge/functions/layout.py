"""Closed forms of the one-dimensional block-cyclic layout, as Column expressions, and spans of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places that one array holds, however long a span is.
SPAN = 1 << 12
#: Columns of a run of a block, and blocks that a task has, about.
WIDE, BLOCKS = 1 << 8, 16


def padding(shard_size: Column | int, tile: Column | int) -> Column:
    """Rows that fill a shard up to whole tiles; none if a tile is as wide as the shard or wider."""
    shard, t = _column(shard_size), _column(tile)
    return F.when(t >= shard, F.lit(0).cast("long")).otherwise(F.pmod(-shard, t)).cast("long")


def plain_padding(shard_size: Column | int, tile: Column | int) -> Column:
    return F.pmod(-_column(shard_size), _column(tile)).cast("long")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long"), b.cast("long"))


def cyclic_columns(col: Column, n: Column | int, tile: Column | int, shards: Column | int) -> dict[str, Column]:
    """src (place with the padding of earlier shards), dst, device, tile and local_off of column `col` of n."""
    n, t, d = _column(n), _column(tile), _column(shards)
    shard = div(n, d)
    pad = padding(shard, t)
    width = F.least(t, shard)
    number = div(col, width)
    device = (number % d).cast("int")
    local = div(number, d) * width + col % width
    return {"src": col + pad * div(col, shard), "dst": device * (shard + pad) + local, "device": device, "tile": number, "local_off": local}


def each_place(spans: DataFrame, name: str) -> DataFrame:
    """Spans (low, high, others): a row for each number from low to high, as column `name` beside the others. A span is cut
    into runs of SPAN numbers; whole runs share one constant array, so what a task holds and drops doesn't grow with it."""
    others = [c for c in spans.columns if c not in ("low", "high")]
    runs = spans.filter("low <= high").select(*others, "high", F.explode(F.sequence("low", "high", F.lit(SPAN).cast("long"))).alias("low"))
    rest = (F.col("high") - F.col("low")).cast("int")
    steps = F.when(F.col("high") - F.col("low") >= SPAN - 1, F.sequence(F.lit(0), F.lit(SPAN - 1))).otherwise(F.sequence(F.lit(0), rest))
    return runs.select(*others, "low", F.explode(steps).alias("step")).select(*others, (F.col("low") + F.col("step")).alias(name))


def block_runs(spark: SparkSession, rows: int, cols: int, tasks: int) -> DataFrame:
    """All places of rows x cols as runs (i, low): row i from column low on, WIDE columns or as many as are left. A task has
    blocks of rows that follow one another, each under the same run of columns, so it meets few numbers of either index, over
    and over: a file keeps them as a short dictionary and repeats. Of whole rows it would keep each column's number as it is."""
    high = max(1, rows * cols // (tasks * BLOCKS * max(1, min(WIDE, cols))))
    down, across = -(-rows // high), -(-cols // WIDE)
    blocks = spark.range(0, down * across, 1, tasks).select((F.col("id") % down * high).alias("top"), (div(F.col("id"), F.lit(down)) * WIDE).alias("low"))
    blocks = blocks.select("low", "top", F.least(F.col("top") + high, F.lit(rows)).alias("end")).select("low", "top", (F.col("end") - 1).alias("end"))
    return blocks.select(F.explode(F.sequence("top", "end", F.lit(1).cast("long"))).alias("i"), "low")


def run_places(runs: DataFrame, cols: int, name: str, upper: bool = False, but: str | None = None) -> DataFrame:
    """Runs of block_runs, beside other columns: a row for each column number, as column `name`. With `upper` those from i on;
    `but` names an array of the steps from low that are left out, null for none. Whole runs share one constant array."""
    others = [c for c in runs.columns if c not in ("low", but)]
    first = F.greatest(F.col("i") - F.col("low"), F.lit(0)).cast("int") if upper else F.lit(0)
    held = runs.select(*runs.columns, first.alias("first"), (F.least(F.lit(WIDE), cols - F.col("low")) - 1).cast("int").alias("last")).filter("first <= last")
    whole, some = (F.col("first") == 0) & (F.col("last") == WIDE - 1), F.sequence("first", "last")
    steps = F.when(whole if but is None else whole & F.col(but).isNull(), F.sequence(F.lit(0), F.lit(WIDE - 1)))
    if but is not None:
        steps = steps.when(F.col(but).isNotNull(), F.array_except(some, but))
    return held.select(*others, "low", F.explode(steps.otherwise(some)).alias("step")).select(*others, (F.col("low") + F.col("step")).alias(name))


def _column(x: Column | int) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")
