"""Filter interaction audit: every order of a few filters, by a trie of survivors.

Each row's verdicts are taken once and stored as a mask of the filters that it fails. The trie is walked depth first: a
node is the unordered set of filters applied so far, and holds the DataFrame of rows that survive them all, filtered
from its parent's and persisted while its subtree is walked. A set that was met in another order isn't walked again. At
every node one job counts what each filter not applied yet would remove from these survivors, which is the edge.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.llm.runtime import Scratch, positional, stored

MOST_FILTERS = 7
WHITE = r"[\x20\x09-\x0D]+"
#: Fixed by the contract: least words, least percent of distinct words, most percent of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
EDGE = "struct<k:int,removed:bigint,good_lost:bigint,toxic_lost:bigint>"


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions A to D on a text that isn't null."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    # a value that is used twice is bound by a transform of one element
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("all"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))[0]
    return {
        "A": sizes["all"] < LEAST_WORDS,
        "B": 100 * sizes["distinct"] < LEAST_DISTINCT * sizes["all"],
        "C": 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def verdicts(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, list[str]]:
    """(part, fails, good, toxic) of every row, and the filters' names by the bits of fails.

    The texts are read once. Condition E (a smaller id has the same text) needs the least id of each text that stands in
    several rows; a row without an id has no smaller one and is none. Ids with several labels are good (toxic) if one of
    the labels says so.
    """
    base, names = positional(docs)
    i, text, part = (F.col(base.columns[names.index(c)]) for c in (id_col, text_col, part_col))
    text = F.coalesce(text.cast("string"), F.lit(""))
    flags = text_failures(text)
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(flags.values())), F.lit(0))
    rows = scratch.keep(base.select(i.cast("long").alias("i"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), bits.cast("int").alias("fails")), "rows")
    # stored apart, so that joins with them can split a frequent text's (or id's) rows over tasks
    copies = scratch.keep(rows.groupBy("digest").agg(F.min("i").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "least"), "copies")
    known = labels.select(F.col(id_col).cast("long").alias("i"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    known = scratch.keep(known.filter("i is not null").groupBy("i").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")), "labels")
    copied = F.coalesce(F.col("i") > F.col("least"), F.lit(False))
    marked = rows.join(copies, "digest", "left").withColumn("fails", F.col("fails") + F.when(copied, 1 << len(flags)).otherwise(0)).select("i", "part", "fails")
    no = F.lit(False)
    out = marked.join(known, "i", "left").select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return scratch.keep(out, "verdicts"), [*flags, "E"]


def audit(rows: DataFrame, filters: list[str], scratch: Scratch) -> DataFrame:
    """From (part, fails, good, toxic) to one row for each part, order of all filters and step: filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley. Parts without a row left have zeros; no rows give
    none. The filters are few (MOST_FILTERS), since their orders are all reported."""
    n = len(filters)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {n}")
    spark = rows.sparkSession
    bit = lambda k: F.col("fails").bitwiseAND(F.lit(1 << k)) != 0
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    # a row that counts for nothing keeps each part in every count
    parts = scratch.keep(rows.select("part").distinct().select("part", F.lit(0).alias("fails"), F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(0).alias("one")), "parts")
    edges = f"{scratch.root}/edges"
    out = [F.struct(F.lit(k).alias("k"), count(bit(k)).alias("removed"), count(bit(k) & F.col("good")).alias("good_lost"), count(bit(k) & F.col("toxic")).alias("toxic_lost")) for k in range(n)]
    counts = [F.array(*out).alias("edges"), F.array(*[count(F.col("fails") == 1 << k) for k in range(n)]).alias("alone")]
    seen: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        left = [k for k in range(n) if not state >> k & 1]
        if not left:
            return
        # counts for all filters (none for those applied), so that every node has the same code
        survivors.withColumn("one", F.lit(1)).unionByName(parts).groupBy("part").agg(F.sum("one").alias("before"), *counts).write.parquet(f"{edges}/state={state}")
        for k in left:
            if state | 1 << k not in seen:
                after = survivors.filter(~bit(k)).persist(StorageLevel.MEMORY_AND_DISK)
                visit(state | 1 << k, after)
                after.unpersist()

    visit(0, rows)
    walked = spark.read.schema(f"part string, before bigint, edges array<{EDGE}>, alone array<bigint>, state int").parquet(edges)
    edge = walked.select("part", "state", "before", F.inline("edges")).filter(F.expr("state & shiftleft(1, k) = 0"))
    # of each filter: rows that fail it at all, and it alone, are known at the root; an edge lies on so many orders
    root = walked.filter("state = 0").select("part", F.inline(F.arrays_zip(F.col("edges.k").alias("k"), F.col("edges.removed").alias("failing"), F.col("alone").alias("unique_fails"))))
    on = F.element_at(F.create_map(*[F.lit(x) for s in range(n) for x in (s, factorial(s) * factorial(n - 1 - s))]), F.bit_count("state"))
    worth = edge.groupBy("part", "k").agg(F.sum(F.col("removed") * on).alias("shapley"))
    orders = []
    for order in permutations(range(n)):
        state = 0
        for step, k in enumerate(order):
            orders.append(("".join(filters[x] for x in order), step + 1, state, k))
            state |= 1 << k
    steps = spark.createDataFrame(orders, "filter_order string, step int, state int, k int")  # n * n! rows
    out = edge.join(F.broadcast(steps), ["state", "k"]).join(root, ["part", "k"]).join(worth, ["part", "k"])
    return out.select("part", "filter_order", "step", (F.col("before") - F.col("removed")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of the filters A to E over whole texts, by part.

    Null texts count as empty ones (and equal them in E), null parts are the empty string, a text of any length is taken
    whole, repeated rows count each (those of one id are no copies of each other), columns of any other name are left
    out, an empty table gives no rows. The result is stored; intermediates are removed.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    out = stored(audit(*verdicts(docs, labels, scratch, id_col, text_col, part_col), scratch), "audit")
    scratch.remove()
    return out
