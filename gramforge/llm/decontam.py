"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Test items are split into words. Runs of three words of an item are seeds unless the corpus holds them far more often
than is usual for the item (counts over all documents); of every few successive runs the least counted is one in any
case, so each part of an item has a seed, however common. Runs of two words are seeds by the same rule, but two of them
have to meet on close diagonals: copies with every third word changed have no other. An item of one or two words is one
seed. Where a document holds seeds, the words around them are aligned with the item (match 2, mismatch and gap -1); the
score over twice the item's words is the share that survives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.bytescan import Words, among, shingle_hashes, slices
from gramforge.llm.runtime import ship_code

#: Words of a seed, and how many seeds of the size make a candidate together: weights that have to reach ENOUGH.
GRAMS, ENOUGH = {3: 2, 2: 1, 1: 2}, 2
SEED_EVERY = 3
#: A gram is rare up to this many times the item's median count, plus this many.
RARE_TIMES, RARE_PLUS = 4, 16
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: An item of one or two words removes rows only if it stands at most this many times in the corpus, or in this share of its rows.
SHORT_TIMES, SHORT_SHARE = 16, 1e-5
#: Test items that one pass over the documents takes (some 80 MB of seeds in a worker); more items take more passes.
BLOCK_BYTES = 8 << 20
#: Hits of some texts that are held at once; where there are more, items are taken in parts.
HITS_HELD = 1 << 20
#: Cells of a row of the alignments that are made side by side.
ALIGNED_CELLS = 1 << 18


class Items:
    """Some test items: words and, for each size of gram, its distinct grams and seeds (gram, item, place, weight)."""

    def __init__(self, ids: list, texts: list[str]):
        words = Words(pa.array(texts, pa.large_string()))
        self.ids, self.words, self.bounds = np.array(ids, np.int64), words.hash, words.bounds
        self.lengths = np.diff(self.bounds)
        self.grams: dict[int, tuple] = {}
        for size in GRAMS:
            grams, bounds = shingle_hashes(self.words, self.bounds, size)
            item = np.repeat(np.arange(len(self.lengths)), np.diff(bounds))
            # an item of fewer words has one seed, of as many words as it has
            used = (self.lengths >= size if size > 1 else self.lengths == 1)[item]
            place = np.arange(len(grams)) - np.repeat(bounds[:-1], np.diff(bounds))
            self.grams[size] = grams[used], item[used], place[used]
        self.distinct = {size: np.unique(g[0]) for size, g in self.grams.items()}
        self.seeds: dict[int, tuple] = {}
        #: How often an item of one or two words stands in the corpus (-1: longer), and the corpus's rows.
        self.times, self.rows = np.full(len(self.lengths), -1, np.int64), 0

    def rare(self, times: int, share: float) -> np.ndarray:
        """Which items are longer than two words, or stand in the corpus at most max(times, share of its rows) times."""
        return self.times <= max(times, share * self.rows)

    def choose(self, counts: dict[int, np.ndarray], rows: int = 0) -> None:
        """Seeds: an item's rare grams, and in each group of SEED_EVERY the least counted, the first of equals."""
        self.rows = rows
        for size, (grams, item, place) in self.grams.items():
            seen = counts[size][np.searchsorted(self.distinct[size], grams)] if len(grams) else np.zeros(0, np.int64)
            whole = (self.lengths[item] == size) & (size <= 2)
            self.times[item[whole]] = seen[whole]
            chosen = np.zeros(len(grams), bool)
            bounds = np.searchsorted(item, np.arange(len(self.lengths) + 1))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b > a:
                    chosen[a:b] = seen[a:b] <= RARE_TIMES * np.median(seen[a:b]) + RARE_PLUS
                    for s in range(a, b, SEED_EVERY):
                        chosen[s + int(np.argmin(seen[s : min(s + SEED_EVERY, b)]))] = True
            at = np.flatnonzero(chosen)
            at = at[np.argsort(grams[at], kind="stable")]
            weight = np.where(self.lengths[item[at]] <= size, ENOUGH, GRAMS[size])
            self.seeds[size] = grams[at], item[at].astype(np.int32), place[at].astype(np.int32), weight.astype(np.int8)
        # workers need the seeds alone
        self.grams, self.distinct = {}, {}


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair, all pairs side by side; rows of the table are computed at once, the gap
    along a row by a running maximum."""
    rows, cols = max(map(len, items)), max(map(len, passages))
    a = np.zeros((len(items), rows), np.uint64)
    b = np.ones((len(items), cols), np.uint64)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    slope = np.arange(cols, dtype=np.int32) * GAP
    above = np.zeros((len(items), cols + 1), np.int32)
    best = np.zeros(len(items), np.int32)
    for r in range(rows):
        score = np.where(b == a[:, r : r + 1], MATCH, MISMATCH).astype(np.int32)
        cell = np.maximum(np.maximum(above[:, :-1] + score, above[:, 1:] + GAP), 0)
        cell = np.maximum.accumulate(cell - slope, axis=1) + slope
        above[:, 1:] = cell
        best = np.maximum(best, cell.max(axis=1))
    return best


def _matches(words: Words, items: Items, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, last word + 1) of the best passage of each text and item that reaches it."""
    grams = {size: shingle_hashes(words.hash, words.bounds, size) for size, own in items.seeds.items() if len(own[0])}
    hit = {size: np.flatnonzero(among(items.seeds[size][0], made)) for size, (made, _) in grams.items()}
    held = 0
    for size, at in hit.items():
        seeds, found = items.seeds[size][0], grams[size][0][at]
        held += int((np.searchsorted(seeds, found, "right") - np.searchsorted(seeds, found, "left")).sum())
    parts = held // HITS_HELD + 1
    out = []
    for part in range(parts if held else 0):
        hits = []
        for size, at in hit.items():
            seeds, item, place, weight = items.seeds[size]
            if parts > 1:
                own = item % parts == part
                seeds, item, place, weight = seeds[own], item[own], place[own], weight[own]
            made, bounds = grams[size]
            left = np.searchsorted(seeds, made[at], "left")
            times = np.searchsorted(seeds, made[at], "right") - left
            where = np.repeat(at, times)
            seed = np.repeat(left - (np.cumsum(times) - times), times) + np.arange(times.sum())
            text = np.searchsorted(bounds, where, side="right") - 1
            hits.append((text, item[seed].astype(np.int64), where - bounds[text] - place[seed], weight[seed].astype(np.int64)))
        if sum(len(h[0]) for h in hits):
            out += _aligned(words, items, threshold, *(np.concatenate(c) for c in zip(*hits, strict=True)))
    return out


def _aligned(words: Words, items: Items, threshold: float, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """The best passages among all hits of some items, by alignment."""
    # hits of one item in one text whose diagonals lie close are one passage
    order = np.lexsort((diagonal, item, text))
    text, item, diagonal, weight = text[order], item[order], diagonal[order], weight[order]
    slack = items.lengths[item] // 4 + 4
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > slack[1:])
    group = np.flatnonzero(new)
    lows = diagonal[group]
    highs = diagonal[np.concatenate([group[1:], [len(text)]]) - 1]
    enough = np.add.reduceat(weight, group) >= ENOUGH
    group, lows, highs = group[enough], lows[enough], highs[enough]
    text, item, slack = text[group], item[group], slack[group]
    count = words.counts()[text]
    first = np.maximum(lows - slack, 0)
    last = np.minimum(highs + items.lengths[item] + slack, count)
    scores = np.zeros(len(group))
    order = np.argsort(last - first, kind="stable")[::-1]
    i = 0
    while i < len(order):
        own = order[i : i + max(1, ALIGNED_CELLS // int(last[order[i]] - first[order[i]] + 1))]
        i += len(own)
        a = [items.words[items.bounds[k] : items.bounds[k + 1]] for k in item[own]]
        b = [words.hash[words.bounds[t] + f : words.bounds[t] + z] for t, f, z in zip(text[own], first[own], last[own], strict=True)]
        scores[own] = smith_waterman(a, b) / (MATCH * items.lengths[item[own]])
    best: dict[tuple[int, int], tuple] = {}
    for t, k, s, f, z in zip(text.tolist(), item.tolist(), scores.tolist(), first.tolist(), last.tolist(), strict=True):
        if s >= threshold and s > best.get((t, k), (0, 0, -1.0))[2]:
            best[t, k] = (t, k, s, f, z)
    return list(best.values())


def item_blocks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> Iterator[Items]:
    """Items in blocks of about BLOCK_BYTES (their size is asked first), with seeds by counts over all of docs."""
    ship_code(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null and i is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = total // BLOCK_BYTES + 1
    for p in range(parts):
        got = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).collect()
        made = Items([r[0] for r in got], [r[1] for r in got])
        if not len(made.words):
            continue
        wanted = docs.sparkSession.sparkContext.broadcast(made.distinct)

        def count(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            seen = {size: np.zeros(len(g), np.int64) for size, g in wanted.value.items()}
            seen[0] = np.zeros(1, np.int64)  # rows
            for piece in slices(batches, "t"):
                seen[0] += piece.num_rows
                words = Words(piece.column("t"))
                for size, distinct in wanted.value.items():
                    if len(distinct):
                        grams, _ = shingle_hashes(words.hash, words.bounds, size)
                        seen[size] += np.bincount(np.searchsorted(distinct, grams[among(distinct, grams)]), minlength=len(distinct))
            for size, n in seen.items():
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), size, np.int32)), pa.array(used), pa.array(n[used])], names=["size", "g", "n"])

        # as many rows as the block's items have grams
        counted = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "size int, g long, n long").groupBy("size", "g").agg(F.sum("n").alias("n")).toArrow()
        counts = {size: np.zeros(len(g), np.int64) for size, g in made.distinct.items()}
        for size, own in counts.items():
            rows = counted.filter(pa.compute.equal(counted.column("size"), size))
            own[rows.column("g").to_numpy()] = rows.column("n").to_numpy()
        made.choose(counts, pa.compute.sum(counted.filter(pa.compute.equal(counted.column("size"), 0)).column("n")).as_py() or 0)
        yield made


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, score, word_start, word_end, item_times) for each document and item whose best passage reaches the
    threshold. item_times is how often an item of one or two words stands in all of docs (null: it has more), since such
    an item may be a common word: its matches are all reported, and this tells what they are worth.

    Null and empty texts hold no passage; null items and items without words are not looked for; repeated rows give
    repeated results; an item of one or two words is found where these stand side by side; texts of any length are
    taken whole; other columns are left out. Without items or rows there are no rows.
    """
    schema = f"`{id_col}` long, item_id long, score double, word_start long, word_end long, item_times long"
    out = None
    for items in item_blocks(docs, benchmark, id_col, text_col, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, "t"):
                found = _matches(Words(piece.column("t")), held.value, threshold)
                at = pa.array([f[0] for f in found], pa.int64())
                cells = [piece.column("i").take(at), pa.array(held.value.ids[[f[1] for f in found]] if found else [], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())]
                times = held.value.times[[f[1] for f in found]] if found else np.zeros(0, np.int64)
                cells.append(pa.array(times, mask=times < 0))
                yield pa.RecordBatch.from_arrays(cells, names=[id_col, "item_id", "score", "word_start", "word_end", "item_times"])

        one = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text", short_times: int = SHORT_TIMES, short_share: float = SHORT_SHARE) -> DataFrame:
    """docs without the rows that hold a passage of a test item; no shuffle of the texts. A match of an item of one or two
    words removes a row only where the item is rare: at most `short_times` times in docs, or `short_share` of its rows if
    that is more (`contaminated` reports the others). Null and empty texts stay,
    repeated rows are alike, other columns stay as they are; without items or rows nothing goes."""
    out = docs
    for items in item_blocks(docs, benchmark, id_col, text_col, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            rare = held.value.rare(short_times, short_share)
            for piece in slices(batches, text_col):
                keep = np.ones(piece.num_rows, bool)
                keep[[f[0] for f in _matches(Words(piece.column(text_col).cast(pa.string())), held.value, threshold) if rare[f[1]]]] = False
                yield piece.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
