"""Mixing sources to target weights by Pfair scheduling [native].

Rows of a source are ranked and cut into blocks. A source of weight w gives its block k the window
[floor(k/w), ceil((k+1)/w)); earliest deadline first over released blocks fills one slot after another and keeps each
source within one block of w times the slots so far. Weights are units of 1/PERIOD, which is so fine that rounding them
moves no source by a thousandth of a block within a thousand million slots; the driver places each block (not each row),
and blocks grow with the table once there would be more than MOST_BLOCKS of them.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramforge.llm.runtime import positional

PERIOD = 1 << 40
BLOCK_ROWS = 64
#: Blocks that the driver places and that are sent to all tasks (some 25 MB), but for one more a source.
MOST_BLOCKS = 1 << 18
BUCKET_ROWS = 4096
#: Offsets of so many buckets are summed in one task, and then those sums.
BUCKETS_TOGETHER = 4096
MAX_SOURCES = 1000


def quantised(weights: dict, period: int = PERIOD) -> dict:
    """Weights as whole numbers that sum to the period (largest remainders, ties by name); none becomes 0."""
    total = float(sum(weights.values()))
    if not weights:
        return {}
    if len(weights) > period or total <= 0:
        raise ValueError("weights must be positive and not outnumber the slots of a period")
    order = sorted(weights, key=lambda s: (s is not None, str(s)))
    exact = {s: weights[s] / total * period for s in order}
    units = {s: max(1, int(exact[s])) for s in order}
    spare = period - sum(units.values())
    for s in sorted(order, key=lambda s: (-round(exact[s] - int(exact[s]), 9), order.index(s)))[: max(0, spare)]:
        units[s] += 1
    for _ in range(-spare):
        units[max(order, key=lambda s: units[s] - exact[s] if units[s] > 1 else -1.0)] -= 1
    return units


def period_schedule(units: dict, blocks: dict | None = None) -> list[tuple]:
    """(source, block, release, deadline, slot) of the sources' blocks (without them: of one period), earliest deadline first."""
    period = sum(units.values())
    order = sorted(units, key=lambda s: (s is not None, str(s)))
    waiting = sorted((k * period // units[s], -(-(k + 1) * period // units[s]), i, k) for i, s in enumerate(order) for k in range((blocks or units)[s]))
    ready: list[tuple] = []
    out, at, slot = [], 0, 0
    while ready or at < len(waiting):
        if not ready:
            slot = max(slot, waiting[at][0])
        while at < len(waiting) and waiting[at][0] <= slot:
            release, deadline, i, k = waiting[at]
            heapq.heappush(ready, (deadline, i, k, release))
            at += 1
        deadline, i, k, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block misses its deadline")
        out.append((order[i], k, release, deadline, slot))
        slot += 1
    return out


def tempered(counts: dict, power: float) -> dict:
    """Target weights: shares of the sources raised to a power below 1, so that small sources weigh more."""
    return {s: float(n) ** power for s, n in counts.items() if n > 0}


def mix(docs: DataFrame, weights: dict | None = None, power: float = 0.7, block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS, period: int = PERIOD, live_weight: float = 0.9, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs with `mix_block`, `mix_release`, `mix_deadline`, `mix_slot`, `mix_rank` (place in the block) and `mixed`.

    `mixed` is true up to the slot where sources of more than 1 - live_weight of the weight have run out; the mix holds
    its weights till there. Null sources are a source of their own, a source without a weight is not mixed (its
    mix_ columns are null); repeated rows are rows of their own; an empty table gives no rows; other columns may have any
    name. Rows are ranked by a hash of the id and the whole row, so that rows of one id spread and a retry ranks alike.
    Weights are exact to 1/PERIOD; a weight below that counts as 1/PERIOD. With live_weight=0 the mix goes on to the
    last row, whatever the weights of what is left. A block has block_rows rows, or as many more as leave at most
    most_blocks blocks and one a source: rows of a large table stay within one such larger block of their weights, and
    what the driver places and broadcasts doesn't grow with the table. Sources must be at most MAX_SOURCES (their counts reach the
    driver); more raise ValueError.
    """
    names = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_rank", "mixed"]
    base, columns_in = positional(docs)
    at_col = {n: F.col(c) for c, n in zip(base.columns, columns_in, strict=True)}
    whole = F.xxhash64(*[F.col(f.name) for f in base.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    base = base.withColumn("__s", F.coalesce(F.concat(F.lit("="), at_col[source_col].cast("string")), F.lit("null")))
    spark = docs.sparkSession
    found = base.groupBy("__s").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counts = {s: n for s, n in found}
    target = tempered(counts, power) if weights is None else {("null" if s is None else f"={s}"): w for s, w in weights.items() if w > 0}
    units = quantised({s: w for s, w in target.items() if s in counts}, period)
    block_rows = max(block_rows, -(-sum(counts[s] for s in units) // most_blocks))
    blocks = {s: -(-counts[s] // block_rows) for s in units}
    plan = period_schedule(units, blocks)
    # the deadline of a source's last block, and the first by which too much weight is gone
    gone = sorted((-(-blocks[s] * period // units[s]), units[s]) for s in units)
    horizon, lost = 0, 0
    for end, unit in gone:
        horizon, lost = end, lost + unit
        if lost > (1 - live_weight) * period:
            break
    columns = list(zip(*plan, strict=True)) if plan else [()] * 5
    table = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, [pa.string()] + [pa.int64()] * 4, strict=True)], names=["__s", "__block", "__r", "__d", "__slot"]))
    # ranks in two steps: within hash buckets of a source, then offsets of the buckets, so no source meets in one task
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    id64 = F.coalesce(at_col[id_col].cast("long"), F.lit(-(1 << 63)).cast("long"))
    bucketed = base.withColumn("__i", id64).withColumn("__w", whole).withColumn("__h", F.xxhash64("__i", "__w")).withColumn("__b", F.pmod("__h", F.lit(buckets)))
    each = bucketed.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__g", F.expr(f"__b div {BUCKETS_TOGETHER}"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda w: F.coalesce(F.sum("__n").over(w), F.lit(0).cast("long"))
    groups = each.groupBy("__s", "__g").agg(F.sum("__n").alias("__n")).withColumn("__o", upto(before("__s", "__g"))).drop("__n")
    offsets = each.withColumn("__p", upto(before("__s", "__g", "__b"))).join(groups, ["__s", "__g"]).select("__s", "__b", (F.col("__o") + F.col("__p")).alias("__before"))
    ranked = bucketed.withColumn("__rank", F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h", "__i", "__w")).cast("long") - 1).join(offsets, ["__s", "__b"])
    at = F.col("__before") + F.col("__rank")
    placed = ranked.withColumn("__block", F.when(F.col("__s").isin(list(units)), F.floor(at / block_rows).cast("long"))).withColumn("__in", at % block_rows)
    out = placed.join(F.broadcast(table), ["__s", "__block"], "left")
    kept = [F.col(c).alias(n) for c, n in zip([f"c{i}" for i in range(len(columns_in))], columns_in, strict=True) if n not in names]
    return out.select(*kept, F.col("__block").alias("mix_block"), F.col("__r").alias("mix_release"), F.col("__d").alias("mix_deadline"), F.col("__slot").alias("mix_slot"), F.when(F.col("__block").isNotNull(), F.col("__in")).alias("mix_rank"), F.coalesce(F.col("__slot") < F.lit(horizon), F.lit(False)).alias("mixed"))
