"""Block-cyclic layout of the columns of a matrix over logical shards, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.functions.layout import cyclic_columns, div, padding
from gramforge.plans.frame import MatrixFrame


def _check(n: int, tile: int, shards: int) -> None:
    if shards < 1 or tile < 1 or n // max(shards, 1) < 1:
        raise ValueError("tile, shards and the columns of a shard must be 1 at least")
    if n % shards:
        raise ValueError("the shards must divide the size")


def cyclic_map(spark: SparkSession, n: int, tile: int, shards: int) -> DataFrame:
    """col, src, dst, device, tile, local_off of every column."""
    _check(n, tile, shards)
    return spark.range(n).select(F.col("id").alias("col")).withColumns(cyclic_columns(F.col("col"), n, tile, shards)).select("col", "src", "dst", "device", "tile", "local_off")


def cyclic_layout(a: MatrixFrame, tile: int, shards: int, padded: bool = True, partitions: int | None = None) -> DataFrame:
    """The cells of a row-sharded matrix with its rows dealt round robin: i, j, v, dst, device, local_off; one shuffle by
    device. With padded=False dst counts without the padding of the shards."""
    _check(a.rows, tile, shards)
    c = cyclic_columns(F.col("i"), a.rows, tile, shards)
    dst = c["dst"] if padded else c["device"] * (a.rows // shards) + c["local_off"]
    out = a.cells.withColumns({"dst": dst, "device": c["device"], "local_off": c["local_off"]})
    return out.repartitionById(partitions or shards, F.col("device")).sortWithinPartitions("device", "local_off", "j")


def blocks_again(dealt: DataFrame, n: int, tile: int, shards: int) -> DataFrame:
    """Back from (device, local_off, j, v) to cells (i, j, v)."""
    shard = n // shards
    width = min(tile, shard)
    number = div(F.col("local_off"), F.lit(width)) * shards + F.col("device")
    return dealt.select((number * width + F.col("local_off") % width).cast("long").alias("i"), "j", "v")


def verify_cyclic(a: MatrixFrame, dealt: DataFrame, tile: int, shards: int) -> DataFrame:
    """One row: cells that are not where the map puts them (missing, extra or changed)."""
    c = cyclic_columns(F.col("i"), a.rows, tile, shards)
    want = a.cells.select(c["dst"].alias("dst"), "j", F.col("v").alias("w"))
    both = want.join(dealt.select("dst", "j", F.col("v").alias("g")), ["dst", "j"], "full")
    return both.agg(F.coalesce(F.sum((~F.col("w").eqNullSafe(F.col("g"))).cast("long")), F.lit(0).cast("long")).alias("mismatches"))


def padded_rows(spark: SparkSession, n: int, tile: int, shards: int) -> DataFrame:
    """The zero rows that padding adds: device, local_off."""
    _check(n, tile, shards)
    shard = n // shards
    rows = F.sequence(F.lit(shard).cast("long"), F.lit(shard).cast("long") + padding(shard, tile))
    return spark.range(shards).select(F.col("id").cast("int").alias("device"), F.explode(rows).alias("local_off")).filter(F.col("local_off") < F.lit(shard).cast("long") + padding(shard, tile))


def pad_rows(dealt: DataFrame, n: int, tile: int, shards: int) -> DataFrame:
    """Cells (device, local_off, j, v) with a zero cell for each column of the rows that fill a shard up to whole tiles."""
    shard = n // shards
    pad = 0 if tile >= shard else -shard % tile
    cells = dealt.select("device", "local_off", "j", "v")
    if not pad:
        return cells
    zeros = dealt.select("j").distinct().withColumn("device", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    zeros = zeros.withColumn("local_off", F.explode(F.sequence(F.lit(shard).cast("long"), F.lit(shard + pad - 1).cast("long"))))
    return cells.unionByName(zeros.select("device", "local_off", "j", F.lit(0.0).cast(dealt.schema["v"].dataType).alias("v")))


def unpad_rows(padded: DataFrame, n: int, shards: int) -> DataFrame:
    """The cells without a shard's rows beyond its size; all of them where nothing was padded."""
    return padded.filter(F.col("local_off") < n // shards)


def ownership(spark: SparkSession, n: int, tile: int, shards: int) -> DataFrame:
    """Who owns each place before and after: phase, pos, owner (-1: padding). Places count the padding of all shards, which
    is what fills them up to whole tiles: before, it stands after each shard, after, at the end of all. After counts
    tiles over all places."""
    if shards < 1 or tile < 1 or n // shards < 1:
        raise ValueError("tile, shards and the columns of a shard must be 1 at least")
    shard = n // shards
    pad = -shard % tile
    place = spark.range(shards * (shard + pad)).withColumnRenamed("id", "pos")
    own = F.when(F.col("pos") % (shard + pad) < shard, div(F.col("pos"), F.lit(shard + pad))).otherwise(-1)
    before = place.select(F.lit("before").alias("phase"), "pos", own.cast("int").alias("owner"))
    after = place.select(F.lit("after").alias("phase"), "pos", F.when(F.col("pos") >= shards * shard, -1).otherwise(div(F.col("pos"), F.lit(tile)) % shards).cast("int").alias("owner"))
    return before.unionByName(after)


def regather(owners: DataFrame, hosts: DataFrame) -> DataFrame:
    """Column shards over all devices gathered to each host: from (device, col) and (host, device) to host, device, col
    where each host's devices hold all columns, dealt evenly by ascending column."""
    size = owners.agg(F.count(F.lit(1)).alias("n"))
    local = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("k"))
    placed = hosts.withColumn("slot", F.expr("row_number() over (partition by host order by device) - 1")).join(local, "host").crossJoin(F.broadcast(size))
    # every host has a whole copy: that is what gathering means
    spans = placed.select("host", "device", F.floor(F.col("slot") * F.col("n") / F.col("k")).alias("lo"), F.floor((F.col("slot") + 1) * F.col("n") / F.col("k")).alias("hi")).filter("hi > lo")
    return spans.select("host", "device", F.explode(F.expr("sequence(lo, hi - 1)")).alias("col")).join(owners.select("col"), "col").select("host", "device", "col")
