"""Sharding by sampled splitters [native].

Records are ordered by (digest of the text, doc_id). A size-weighted sample of the digests gives quantile splitters;
ranges that turn out overfull (equal texts have one digest) are subdivided by splitters over (digest, doc_id). Exact
byte sums of the ranges then place the shard cuts, so the law `bytes` holds whatever the sample was: a shard's bytes
differ from the mean by less than the largest record. Law `rows` cuts the same order by counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramforge.llm.runtime import Scratch, bucket_of, constants, positional, stored

SAMPLES_PER_RANGE = 24
MAX_RANGES = 8192
RECORD_OVERHEAD = 16


def _keys(id_col: str, text_col: str) -> dict[str, Column]:
    text = F.col(text_col)
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return {
        "__digest": digest,
        "__key": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"),
        "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")),
        "__size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(RECORD_OVERHEAD).cast("long"),
        "__one": F.lit(1).cast("long"),
    }


def _splitters(keyed: DataFrame, weight: str, total: int, ranges: int) -> list[tuple[int, int]]:
    """Splitters (key, id): quantiles of a weighted sample, then of samples of (key, id) in ranges that are overfull."""
    wanted = ranges * SAMPLES_PER_RANGE
    chance = F.pmod(F.xxhash64("__key", "__id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = [r[0] for r in keyed.filter(chance < F.col(weight) * (wanted / max(total, 1))).select("__key").collect()]
    sample.sort()
    cuts = sorted({(sample[len(sample) * i // ranges], -(1 << 63)) for i in range(1, ranges)} if sample else set())
    share = max(1, total // ranges)
    for _ in range(2):
        sums = _range_sums(keyed, cuts, weight)
        over = {r: s for r, s in sums.items() if s > 2 * share}
        if not over:
            break
        inside = keyed.withColumn("__range", _range_of(cuts)).filter(F.col("__range").isin(list(over)))
        drawn = inside.filter(chance < F.col(weight) * (wanted / max(total, 1))).select("__range", "__key", "__id").distinct().collect()
        by: dict[int, list] = {}
        for r, k, i in drawn:
            by.setdefault(r, []).append((k, i))
        more = set(cuts)
        for r, own in by.items():
            own.sort()
            parts = -(-over[r] // share)
            more |= {own[len(own) * p // parts] for p in range(1, parts)}
        if len(more) == len(cuts):
            break
        cuts = sorted(more)
    return cuts


def _range_of(cuts: list[tuple[int, int]]) -> Column:
    return bucket_of("__key", "__id", cuts)


def _range_sums(keyed: DataFrame, cuts: list[tuple[int, int]], weight: str) -> dict[int, int]:
    return {r: s for r, s in keyed.groupBy(_range_of(cuts).alias("r")).agg(F.sum(weight)).collect()}


def assign_shards(docs: DataFrame, n_shards: int, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """docs with `size`, `shard` and `slot` (input columns of those names give way; others may have any name).

    Null texts count as no bytes plus the overhead; null ids sort first; repeated rows take neighbouring slots; an
    empty table gives no rows. At most MAX_RANGES * SAMPLES_PER_RANGE sampled keys and MAX_RANGES sums reach the driver.
    docs is read twice: once for keys and sizes, which go to the shared folder for the sample, the sums and the counts,
    and once to deal out its rows.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"law must be 'bytes' or 'rows', not {law!r}")
    spark = docs.sparkSession
    base, names = positional(docs)
    keys = _keys(*(base.columns[docs.columns.index(c)] for c in (id_col, text_col)))
    scratch = Scratch(spark, "shards")
    keyed = scratch.keep(base.select(*[c.alias(k) for k, c in keys.items()]), "keys")
    weight = "__size" if law == "bytes" else "__one"
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    ranges = min(MAX_RANGES, ranges or max(4 * n_shards, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = _splitters(keyed, weight, total, ranges)
    sums = _range_sums(keyed, cuts, weight)
    offsets, run = [], 0
    for r in range(len(cuts) + 1):
        offsets.append(run)
        run += sums.get(r, 0)
    before = F.element_at(constants(offsets), F.col("__range") + 1)
    inside = Window.partitionBy("__range").orderBy("__digest", "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = before + F.sum(weight).over(inside)
    # the middle of the record in bytes, its first row in counts: floor(place * shards / total)
    place = 2 * upto - F.col(weight) if law == "bytes" else 2 * upto - 2
    shard = F.expr(f"__place * {n_shards} div {max(2 * total, 1)}").cast("int")
    deal = lambda df: df.withColumn("__range", _range_of(cuts)).withColumn("__place", place).withColumn("__shard", F.least(shard, F.lit(n_shards - 1)))
    in_range = Window.partitionBy("__range", "__shard").orderBy("__digest", "__id")
    ranked = deal(base.withColumns(keys)).withColumn("__rank", F.row_number().over(in_range).cast("long"))
    earlier = Window.partitionBy("__shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row for a range and one for a cut; rows of one key and id have one size, so either reading gives these counts
    first = stored(deal(keyed).groupBy("__range", "__shard").agg(F.count(F.lit(1)).alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0).cast("long"))).drop("__n"), "shard-offsets")
    scratch.remove()
    out = ranked.join(F.broadcast(first), ["__range", "__shard"])
    kept = [F.col(c).alias(n) for c, n in zip(base.columns, names, strict=True) if n not in ("size", "shard", "slot")]
    return out.select(*kept, F.col("__size").alias("size"), F.col("__shard").alias("shard"), (F.col("__first") + F.col("__rank") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int, law: str = "bytes", tasks_per_shard: int = 1) -> None:
    """The shards as folders `shard=N` of Parquet files, rows in slot order within a file; odd rows as in assign_shards."""
    dealt = assign_shards(docs, n_shards, law)
    dealt.repartition(n_shards * tasks_per_shard, "shard", F.pmod("slot", F.lit(tasks_per_shard))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
