"""Near duplicates by order MinHash with banded alignment.

Every text's five-word shingles, labelled by how often they occurred before, are hashed SKETCHES times; each time the
PICKS least labels, in text order, are one bucket key (texts that repeat shingles get such keys of their first
occurrences as well, since links are defined on distinct shingles). Equal texts are folded to one vertex. In each
bucket all texts are aligned with the one that has the most company in its buckets, which is the middle of a star of
copies; links join classes.

What one text a bucket leaves open, or what shares no key by chance, is then settled without loss: distinct shingles have
one order for all texts (common ones last), and two texts at the threshold share a shingle within the first
n - ceil(threshold * n) + 1 of each. Every pair of texts of different classes that meets in such a prefix is compared, as
rows of pairs where a shingle's texts make few of them and by blocks of its texts where they make many.

A pair is a link if an alignment of the two orders of distinct shingles matches M of them with M / (n1 + n2 - M) of at
least 0.8; a match further off the diagonal than such an alignment can have gaps is out of its band.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.llm.bytescan import Words, among, free_memory, mix64, shingle_hashes, slices
from gramforge.llm.graph import components
from gramforge.llm.runtime import LOWEST, Scratch, positional, ship_code, stored

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 20
PICKS = 3
#: About so many labels of a text lie under the limit within which a sketch looks for its least ones first.
DRAWN = 16
ORDERS_HELD = 1 << 20
#: A shingle whose texts make more than PAIR_ROWS pairs of different classes is compared by blocks of about BLOCK_TEXTS.
PAIR_ROWS = 4096
BLOCK_TEXTS = 256
BLOCK_COLUMNS = 4096
#: Rows of one or two numbers that are broadcast at most.
MOST_SENT = 1 << 20
#: Shingles met COMMON_LEAST times in one of COMMON_EVERY rows come last in the order; which they are changes no result.
COMMON_EVERY, COMMON_LEAST, COMMON_MOST = 16, 3, 100_000
#: Bits of a shingle that order it, and of the fixed-size filter of the shingles in which classes meet.
CODE_BITS, FILTER_BITS = 43, 1 << 25
_random = np.random.Generator(np.random.PCG64(11))
MULTIPLIERS = _random.integers(1, 1 << 63, size=SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ORDER_FACTORS = _random.integers(1, 1 << 63, size=PICKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OCCURRENCE = np.uint64(0x9E3779B97F4A7C15)


def occurrence_labels(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes with their occurrence number in the text mixed in, and which are first occurrences."""
    texts = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    key = mix64(shingles + texts * OCCURRENCE)
    ranked = np.sort(key)
    again = np.flatnonzero(among(np.unique(ranked[1:][ranked[1:] == ranked[:-1]]), key))
    seen = np.zeros(len(key), np.uint64)
    order = np.argsort(key[again], kind="stable")
    repeated = key[again][order]
    first = np.ones(len(again), bool)
    first[1:] = repeated[1:] != repeated[:-1]
    place = np.arange(len(again))
    seen[again[order]] = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
    return mix64(shingles + seen * OCCURRENCE), seen == 0


def order_sketches(labels: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SKETCHES keys for each text with shingles (rows of the others are to be left out)."""
    counts = np.diff(bounds)
    used = np.flatnonzero(counts)
    keys = np.zeros((len(counts), SKETCHES), np.uint64)
    if not len(used):
        return keys
    sizes = counts[used]
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(used)), sizes)
    most = np.iinfo(np.uint64).max
    limits = np.where(sizes <= DRAWN, most, (np.minimum(DRAWN / sizes, 0.999) * 2.0**64).astype(np.uint64))[owner]
    need = np.minimum(sizes, PICKS)
    for j in range(SKETCHES):
        v = labels * MULTIPLIERS[j]
        at = np.flatnonzero(v <= limits)
        few = np.flatnonzero(np.bincount(owner[at], minlength=len(used)) < need)
        if len(few):  # their least labels lie above the limit: all are looked at
            at = np.concatenate([at[~among(few, owner[at])], *(np.arange(starts[i], starts[i] + sizes[i]) for i in few)])
        at = at[np.lexsort((v[at], owner[at]))]
        own = owner[at]
        rank = np.arange(len(at)) - np.searchsorted(own, np.arange(len(used)))[own]
        least = rank < PICKS
        places = np.full((len(used), PICKS), len(labels), np.int64)
        places[own[least], rank[least]] = at[least]
        places.sort(axis=1)
        picked = np.where(places < len(labels), labels[np.minimum(places, len(labels) - 1)], np.uint64(0))
        keys[used, j] = mix64((picked * ORDER_FACTORS).sum(axis=1, dtype=np.uint64) + np.uint64(j))
    return keys


def prefix_size(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """How many of n ordered shingles must be looked at to meet any set of at least this similarity."""
    return np.maximum(n - np.ceil(similarity * np.asarray(n) - 1e-9).astype(np.int64) + 1, 0)


def ordered_prefixes(shingles: np.ndarray, bounds: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The prefixes of some texts end to end (codes of CODE_BITS, common ones with a bit above), the bounds of each, the
    distinct codes of each text, and bits that its codes set."""
    texts = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    code = (shingles >> np.uint64(64 - CODE_BITS)) | (among(common, shingles).astype(np.uint64) << np.uint64(CODE_BITS))
    # a slice has far fewer than 2^20 texts
    made = np.sort((texts << np.uint64(CODE_BITS + 1)) | code)
    made = made[np.concatenate([np.ones(min(1, len(made)), bool), made[1:] != made[:-1]])]
    owner = (made >> np.uint64(CODE_BITS + 1)).astype(np.int64)
    n = np.bincount(owner, minlength=len(bounds) - 1)
    place = np.arange(len(made)) - np.repeat(np.cumsum(n) - n, n)
    sizes = np.minimum(prefix_size(n, similarity), n)
    # a power of two of bits, twice the codes or more
    width = np.left_shift(64, np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64))
    first = np.cumsum(width) - width
    bits = np.zeros(int(width.sum()), bool)
    bits[first[owner] + (made & (width[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    ends = (np.concatenate([first, [len(bits)]]) // 8).astype(np.int32)
    held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.packbits(bits, bitorder="little").tobytes())])
    return made[place < sizes[owner]] & np.uint64((1 << (CODE_BITS + 1)) - 1), np.concatenate([[0], np.cumsum(sizes)]), n, held


def most_shared(a: bytes, na: int, b: bytes, nb: int) -> int:
    """A bound of the shingles that two texts share: each bit that one sets alone stands for a shingle of its own."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    for k in range((len(a) // len(b)).bit_length() - 1):
        half = 4 * len(a) >> k
        x = (x | x >> half) & ((1 << half) - 1)
    for k in range((len(b) // len(a)).bit_length() - 1):
        half = 4 * len(b) >> k
        y = (y | y >> half) & ((1 << half) - 1)
    both = x & y
    return min(na - (x ^ both).bit_count(), nb - (y ^ both).bit_count())


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _shingles(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    words = Words(texts)
    short = words.hash & np.uint64(0xFFFFFFFF)
    return (words, short, *shingle_hashes(mix64(short), words.bounds, SHINGLE))


def _common_shingles(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Shingles, ascending, that many of a part of the rows hold: the COMMON_MOST most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "t"):
            _, _, shingles, bounds = _shingles(piece.column("t"))
            _, first = occurrence_labels(shingles, bounds)
            made, times = np.unique(shingles[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), pa.array(times)], names=["h", "n"])

    part = docs.select(F.col(text_col).cast("string").alias("t"), F.col(id_col).cast("long").alias("k")).filter(F.pmod(F.xxhash64("t", "k"), F.lit(COMMON_EVERY)) == 0)
    counted = part.select("t").filter("t is not null").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    got = counted.filter(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "h").limit(COMMON_MOST).select("h").toArrow()
    return np.sort(got.column("h").to_numpy().view(np.uint64))


def sketched(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """k (id, null: least), v (128-bit digest of the text), n (distinct shingles), keys, prefix, bits, words (32-bit word hashes)."""
    ship_code(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "t"):
            words, short, shingles, bounds = _shingles(piece.column("t"))
            labels, first = occurrence_labels(shingles, bounds)
            upto = np.concatenate([[0], np.cumsum(first)])[bounds]
            counts, distinct = np.diff(bounds), np.diff(upto)
            keys = order_sketches(labels, bounds)
            again = np.flatnonzero(distinct < counts)
            if len(again):
                kept = first & np.repeat(distinct < counts, counts)
                more = order_sketches(labels[kept], np.concatenate([[0], np.cumsum(distinct[again])]))
                keys = np.insert(keys, again + 1, more, axis=0)
            times = np.where(distinct < counts, 2, 1)
            sizes = np.where(counts > 0, times * SKETCHES, 0)
            key_lists = _lists(sizes, keys[np.repeat(counts > 0, times)].reshape(-1))
            prefix, ends, n, bits = ordered_prefixes(shingles, bounds, held.value, similarity)
            bodies = pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer((words.bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(short.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([piece.column("k"), piece.column("v"), pa.array(n.astype(np.int32)), key_lists, _lists(np.diff(ends), prefix), bits, bodies], names=["k", "v", "n", "keys", "prefix", "bits", "words"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST).cast("long")).alias("k"), _digest(text_col).alias("v"), F.col(text_col).cast("string").alias("t")).filter("t is not null")
    return rows.mapInArrow(run, "k long, v binary, n int, keys array<long>, prefix array<long>, bits binary, words binary")


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


def shingle_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct shingles, ascending, and the place of each in the order of their first occurrences."""
    made, _ = shingle_hashes(mix64(words.astype(np.uint64)), np.array([0, len(words)]), SHINGLE)
    distinct, first = np.unique(made, return_index=True)
    place = np.empty(len(first), np.int64)
    place[np.argsort(first)] = np.arange(len(first))
    return distinct, place


def aligned_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> float:
    """M / (n1 + n2 - M) of the best banded alignment of two texts' shingle orders, 0 where it can't reach `least`.

    Shingles are distinct, so the best alignment is the longest run of matches that rises in both orders.
    """
    (x, place_x), (y, place_y) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    total = len(x) + len(y)
    if not total:
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = np.flatnonzero(y[at] == x)
    if len(both) < least * (total - len(both)):
        return 0.0
    at_x, at_y = place_x[both], place_y[at[both]]
    gaps = total - 2 * int(np.ceil(least / (1 + least) * total - 1e-9))
    at_y = at_y[np.argsort(at_x)]
    at_x.sort()
    at_y = at_y[np.abs(at_x - at_y) <= gaps]
    if len(at_y) and (np.diff(at_y) < 0).any():
        tails: list[int] = []
        for p in at_y.tolist():
            i = bisect_left(tails, p)
            tails[i : i + 1] = [p]
        m = len(tails)
    else:
        m = len(at_y)
    score = m / (total - m)
    return score if score >= least else 0.0


def _linked(ids: list[int], classes: list[int], blocks: list[int], orders: list[tuple], similarity: float) -> Iterator[tuple[int, int, float]]:
    """Links (a, b, score) between texts of different classes, and of different blocks if there are two, as far as one joins
    classes that these links have not joined. Shared shingles of all pairs are counted at once, those that reach the threshold are aligned."""
    n = np.array([len(o[0]) for o in orders])
    _, column, times = np.unique(np.concatenate([o[0] for o in orders]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(n)), n)
    used = times[column] > 1
    number = np.cumsum(times > 1) - 1
    owner, column = owner[used], number[column[used]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(n), len(n)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
        lo, hi = np.searchsorted(column, [begin, begin + BLOCK_COLUMNS])
        holds = np.zeros((len(n), BLOCK_COLUMNS), np.float32)
        holds[owner[lo:hi], column[lo:hi] - begin] = 1
        shared += holds @ holds.T
    c, b = np.array(classes), np.array(blocks)
    enough = (shared >= similarity / (1 + similarity) * (n[:, None] + n) - 1e-6) & (c[:, None] != c)
    if b.min() != b.max():
        enough &= b[:, None] != b
    joined = {x: x for x in classes}

    def top(x: int) -> int:
        while joined[x] != x:
            joined[x] = x = joined[joined[x]]
        return x

    for i, j in np.argwhere(np.triu(enough, 1)).tolist():
        x, y = top(classes[i]), top(classes[j])
        if x != y and (score := aligned_similarity(orders[i], orders[j], similarity)) >= similarity:
            joined[x] = y
            yield min(ids[i], ids[j]), max(ids[i], ids[j]), score


def _block_links(large: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(a, b, score): links within buckets (key, id, c, rows), each cut into blocks of texts; any two blocks meet once."""
    blocks = F.ceil(F.col("rows") / BLOCK_TEXTS)
    own = large.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), blocks)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = own.select("key", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "id", "c", "block").join(words.select("id", "words"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, group, at = Orders(), [], None

        def links() -> pa.RecordBatch:
            got = list(_linked(*map(list, zip(*group, strict=True)), similarity)) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "score"])

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("key", "lo", "hi", "id", "c", "block")]
            for key, lo, hi, i, c, block, body in zip(*columns, batch.column("words"), strict=True):
                if (key, lo, hi) != at:
                    if group:
                        yield links()
                    group, at = [], (key, lo, hi)
                group.append((i, c, block, orders.of(i, body.as_buffer())))
        if group:
            yield links()

    cols = ["key", "lo", "hi"]
    return met.repartition(*cols).sortWithinPartitions(*cols).select(*cols, "id", "c", "block", "words").mapInArrow(run, "a long, b long, score double")


class Orders:
    """Shingle orders of the texts met last: a text stands in many pairs. Held up to ORDERS_HELD shingles, then anew."""

    def __init__(self):
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.size = 0

    def of(self, vertex: int, words: bytes) -> tuple[np.ndarray, np.ndarray]:
        if vertex not in self.held:
            if self.size > ORDERS_HELD:
                self.held, self.size = {}, 0
            self.held[vertex] = shingle_order(np.frombuffer(words, "<u4"))
            self.size += len(self.held[vertex][0])
        return self.held[vertex]


def _sent(table: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, to be broadcast if it has at most MOST_SENT rows."""
    return F.broadcast(table) if table.count() <= MOST_SENT else table


def _of(sk: DataFrame, ids: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """(id, n, column) of the given vertices; the column passes a shuffle only if there are too many ids to send around."""
    ids = scratch.keep(ids.distinct(), "ids")
    return scratch.keep(sk.select(F.col("rid").alias("id"), "n", column).join(_sent(ids), "id"), column)


def _possible(pairs: DataFrame, sk: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs whose bits allow them to share enough shingles: no link is among the others, and texts are much longer."""
    bits = _of(sk, _ends(pairs), "bits", scratch)
    side = lambda x: bits.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sa", "na", "sb", "nb")]
            enough = [most_shared(sa, na, sb, nb) >= similarity / (1 + similarity) * (na + nb) - 1e-6 for sa, na, sb, nb in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(enough, pa.bool_()))

    return scratch.keep(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "na", "sb", "nb").mapInArrow(run, "a long, b long"), "possible")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))


def _verify(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(a, b, score) of the pairs."""
    body = lambda x: words.select(F.col("id").alias(x), F.col("words").alias(f"w{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders()
        for batch in batches:
            scores = [aligned_similarity(orders.of(a, x.as_buffer()), orders.of(b, y.as_buffer()), similarity) for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("wa"), batch.column("wb"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(scores, pa.float64())], names=["a", "b", "score"])

    return pairs.join(body("a"), "a").join(body("b"), "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long, score double")


def _hub_pairs(sk: DataFrame, vertices: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): each text of a bucket with the bucket's text that has the most company in its buckets."""
    members = sk.select(F.col("rid").alias("id"), "n", "keys").join(_sent(vertices.select("id")), "id").select("id", "n", F.explode(F.array_distinct("keys")).alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = scratch.keep(members.join(shared, "key"), "buckets")
    company = met.groupBy("id").agg(F.sum("size").alias("company"))
    met = scratch.keep(met.join(company, "id"), "weighed")
    hubs = met.groupBy("key").agg(F.max(F.struct("company", "id", "n")).alias("h"))
    alike = F.least("n", "h.n") >= F.lit(similarity - 1e-9) * F.greatest("n", "h.n")
    return met.join(hubs, "key").filter((F.col("id") != F.col("h.id")) & alike).select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")).distinct()


def _held_bits(keys: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits, whatever the number of keys: rows without their bit are in no key."""
    place = F.pmod("key", F.lit(FILTER_BITS)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for part, bits in parts:
        out[(part - 1) * 4096 : (part - 1) * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _meeting(sk: DataFrame, labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id, c, n, place): the prefix entries in whose shingle texts of several classes meet."""
    own = sk.filter("n > 0").select(F.col("rid").alias("id"), "n", "prefix").join(_sent(labelled.select("id", "c")), "id")
    several = scratch.keep(own.select("c", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key"), "several")
    held = sk.sparkSession.sparkContext.broadcast(_held_bits(several))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        for batch in batches:
            prefix = batch.column("prefix")
            keys = prefix.flatten().to_numpy()
            sizes = np.diff(prefix.offsets.to_numpy())
            bit = keys % FILTER_BITS
            at = np.flatnonzero((held.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = (np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[at]
            taken = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), *(batch.column(c).take(taken) for c in ("id", "c", "n")), pa.array(place.astype(np.int32))], names=["key", "id", "c", "n", "place"])

    return scratch.keep(own.select("id", "c", "n", "prefix").mapInArrow(run, "key long, id long, c long, n int, place int").join(several, "key"), "meeting")


def _settled(sk: DataFrame, labelled: DataFrame, tried: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b, score): links that join all classes (id, c) with a link between them that is not among the tried pairs."""
    members = _meeting(sk, labelled, scratch)
    each = members.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    sizes = each.groupBy("key").agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("square")).select("key", "rows", ((F.col("rows") * F.col("rows") - F.col("square")) / 2).alias("pairs"))
    members = scratch.keep(members.join(sizes, "key"), "sized")
    few, many = members.filter(F.col("pairs") <= PAIR_ROWS), members.filter(F.col("pairs") > PAIR_ROWS)
    side = lambda x: few.select("key", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"), F.col("place").alias(f"p{x}"))
    # a pair has to pass where its first common shingle stands: after it each has only so many left
    alike = F.least("na", "nb") >= F.lit(similarity - 1e-9) * F.greatest("na", "nb")
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - F.lit(1e-6)
    pairs = side("a").join(side("b"), "key").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike & left).select("a", "b").distinct()
    pairs = _possible(scratch.keep(pairs.join(tried, ["a", "b"], "left_anti"), "pairs"), sk, similarity, scratch)
    words = _of(sk, _ends(pairs).union(many.select("id")), "words", scratch)
    found = _verify(pairs, words, similarity).filter(F.col("score") >= similarity)
    return scratch.keep(found.union(_block_links(many, words, similarity)).groupBy("a", "b").agg(F.max("score").alias("score")), "found")


def text_classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches of all rows with a text (k, v, rid ...), (id, v, k, c): the class c of every distinct text v, and the
    verified links (a, b, score) between ids that made the classes."""
    sk = scratch.keep(sketched(docs, id_col, text_col, similarity).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    first = sk.groupBy("v").agg(F.min(F.struct("k", "rid")).alias("m"))
    vertices = scratch.keep(first.select(F.col("m.rid").alias("id"), "v", F.col("m.k").alias("k")), "vertices")
    pairs = scratch.keep(_hub_pairs(sk, vertices, similarity, scratch), "hub-pairs")
    words = _of(sk, _ends(pairs), "words", scratch)
    checked = scratch.keep(_verify(pairs, words, similarity), "checked")
    links = checked.filter(F.col("score") >= similarity)
    classes = components(links.select("a", "b"), scratch)
    labelled = scratch.keep(vertices.join(classes.withColumnRenamed("v", "id"), "id", "left").withColumn("c", F.coalesce("c", "id")), "labelled")
    found = _settled(sk, labelled, checked.select("a", "b"), similarity, scratch)
    of = lambda x: labelled.select(F.col("id").alias(x), F.col("c").alias(f"c{x}"))
    between = scratch.keep(found.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "between")
    moved = components(between, scratch).select(F.col("v").alias("c"), F.col("c").alias("to"))
    return sk, scratch.keep(labelled.join(moved, "c", "left").select("id", "v", "k", F.coalesce("to", "c").alias("c")), "classes"), links.union(found)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: the id, class_id (least id of the class), keep, n_links, linked_id and link_score.

    keep is true for the rows of a class's least id. n_links counts the other texts that the row's text has been aligned
    with at the threshold or above, as links of its class (which they hold together: one of k texts has k - 1 or more;
    pairs of a class that no key brings together are not counted); linked_id is the least id of the one with the best
    score, link_score that score. A text that is alone, or has only equal copies, has 0 links and nulls. Empty texts are equal texts. Null texts are compared with nothing:
    each is a class of its own under its own id. Texts without words are compared as wholes only. Ids that are null
    count as the least id. Where an id stands for several texts, classes can share a class_id. Texts of any length are
    taken whole, repeated rows are alike, other columns are left out, an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sk, classes, links = text_classes(docs, id_col, text_col, similarity, scratch)
    least = classes.groupBy("c").agg(F.min("k").alias("class_id"))
    ends = links.union(links.select("b", "a", "score")).join(classes.select(F.col("id").alias("b"), "k"), "b")
    best = F.max(F.struct("score", (-1 - F.col("k")).alias("least")))
    linked = ends.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"), best.alias("m")).select(F.col("a").alias("id"), "n_links", (-1 - F.col("m.least")).alias("linked_id"), F.col("m.score").alias("link_score"))
    known = classes.join(least, "c").join(linked, "id", "left").select("v", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "linked_id", "link_score")
    with_text = sk.select("k", "v").join(known, "v").select("k", "class_id", (F.col("k") == F.col("class_id")).alias("keep"), "n_links", "linked_id", "link_score")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST).cast("long"))
    without = docs.filter(F.col(text_col).isNull()).select(key.alias("k")).select("k", F.col("k").alias("class_id"), F.lit(True).alias("keep"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("linked_id"), F.lit(None).cast("double").alias("link_score"))
    back = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    out = stored(with_text.union(without).select(back("k").alias(id_col), back("class_id").alias("class_id"), "keep", "n_links", back("linked_id").alias("linked_id"), "link_score"), "classes")
    scratch.remove()
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: the one of the least id (of equal ids: of the least digest). Rows without a text
    all stay. Rows that repeat that id and its text are folded to one of them. Texts of any length are taken whole, other
    columns stay, an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "unique")
    base, names = positional(docs)
    id_col, text_col = (base.columns[names.index(c)] for c in (id_col, text_col))
    sk, classes, _ = text_classes(base, id_col, text_col, similarity, scratch)
    chosen = classes.groupBy("c").agg(F.min(F.struct("k", "v")).alias("m")).select("m.k", "m.v")
    times = sk.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    kept = stored(chosen.join(times, ["k", "v"]).select(F.col("k").alias("__kept_k"), F.col("v").alias("__kept_v"), F.col("n").alias("__kept_n")), "kept")
    scratch.remove()
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST).cast("long"))
    rows = base.filter(F.col(text_col).isNotNull()).join(kept, (key == F.col("__kept_k")) & (_digest(text_col) == F.col("__kept_v")))
    single = rows.filter("__kept_n = 1").select(*base.columns)
    repeated = rows.filter("__kept_n > 1").dropDuplicates(["__kept_k", "__kept_v"]).select(*base.columns)
    return single.union(repeated).union(base.filter(F.col(text_col).isNull())).toDF(*names)
