"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of eight bytes with a stride of four run over the whole text, beside a channel that
tells whether four bytes repeat what stood up to LAGS bytes before. Rectified responses are averaged in overlapping
chunks, each filter keeps its largest chunk, and a logistic unit combines these into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramforge.llm.bytescan import byte_view, slices
from gramforge.llm.runtime import ship_code

EMBED, FILTERS, STEP, HOP, LAGS = 8, 24, 4, 32, 32
SLICE = 1 << 18
#: The fit's bounds: rows of each class, and code points of a row; of a longer row a piece at a hashed place is used.
FIT_ROWS, FIT_CHARS = 1000, 12_000
EPOCHS, BATCH, RATE = 8, 32, 0.01
#: Short pieces of good texts (which are good as well) join the fit, for texts of a few words.
PIECES, PIECE_CHARS = 400, 120


class Layout:
    """Texts laid out in whole steps (two at least), with the blocks of HOP steps of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        steps = np.maximum(-(-sizes // STEP), 2)
        self.first = np.concatenate([[0], np.cumsum(steps)])
        total = int(self.first[-1])
        data = np.zeros(total * STEP, np.uint8)
        shift = self.first[:-1] * STEP - offsets[:-1]
        data[np.arange(len(raw)) + np.repeat(shift, sizes)] = raw
        self.data = data.reshape(total, STEP)
        place = (np.arange(total) - np.repeat(self.first[:-1], steps)).astype(np.int32)
        grams = np.concatenate([data, np.zeros(4, np.uint8)])
        four = grams[: len(data)].astype(np.uint32)
        for k in (1, 2, 3):
            four |= grams[k : len(data) + k].astype(np.uint32) << np.uint32(8 * k)
        here = four[::STEP]
        again = np.zeros(total, bool)
        for d in range(1, LAGS + 1):
            skip = -(-d // STEP)
            if skip >= total:
                break
            before = four[skip * STEP - d :: STEP][: total - skip]
            again[skip:] |= (here[skip:] == before) & (place[skip:] >= skip)
        self.again = (again & (here != 0)).astype(np.float32)
        self.whole = np.ones(total, bool)  # windows of two steps of one text
        self.whole[self.first[1:] - 1] = False
        windows = steps - 1
        self.blocks = -(-windows // HOP)
        self.block_first = np.concatenate([[0], np.cumsum(self.blocks)])
        inner = np.arange(self.block_first[-1]) - np.repeat(self.block_first[:-1], self.blocks)
        self.block_start = np.repeat(self.first[:-1], self.blocks) + inner * HOP
        self.block_size = np.minimum(HOP, np.repeat(windows, self.blocks) - inner * HOP).astype(np.float32)
        last = inner == np.repeat(self.blocks, self.blocks) - 1
        self.paired = ~last  # a chunk is a block and the next one of its text
        self.alone = np.repeat(self.blocks, self.blocks) == 1


class Network:
    def __init__(self, seed: int = 1):
        g = np.random.Generator(np.random.PCG64(seed))
        make = lambda *shape, scale: (g.standard_normal(shape) * scale).astype(np.float32)
        inputs = STEP * EMBED + 1
        self.p = {"embed": make(256, EMBED, scale=0.5), "a": make(inputs, FILTERS, scale=0.15), "b": make(inputs, FILTERS, scale=0.15), "bias": np.zeros(FILTERS, np.float32), "out": make(FILTERS, scale=0.1), "prior": np.zeros(1, np.float32)}

    def forward(self, x: Layout) -> tuple:
        p = self.p
        rows = np.empty((len(x.data), STEP * EMBED + 1), np.float32)
        rows[:, :-1] = p["embed"][x.data].reshape(len(x.data), -1)
        rows[:, -1] = x.again * 4
        z = rows @ p["a"]
        z[:-1] += rows[1:] @ p["b"]
        z += p["bias"]
        np.maximum(z, 0, out=z)
        z[~x.whole] = 0
        sums = np.add.reduceat(z, x.block_start, axis=0)
        sizes = x.block_size.copy()
        two = np.flatnonzero(x.paired)
        chunk = sums.copy()
        chunk[two] += sums[two + 1]
        sizes[two] += x.block_size[two + 1]
        chunk /= sizes[:, None]
        chunk[~(x.paired | x.alone)] = -1  # the last block counts within the chunk before it
        top = np.maximum.reduceat(chunk, x.block_first[:-1], axis=0)
        logit = top @ p["out"] + p["prior"]
        return rows, z, chunk, sizes, top, 1 / (1 + np.exp(-logit.clip(-30, 30)))

    def gradients(self, x: Layout, target: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        rows, z, chunk, sizes, top, score = self.forward(x)
        d = ((score - target) * weight / len(target)).astype(np.float32)
        grads = {"out": top.T @ d, "prior": d.sum(keepdims=True)}
        owner = np.repeat(np.arange(len(x.blocks)), x.blocks)
        back = np.where(chunk == top[owner], (d[:, None] * p["out"])[owner], 0) / sizes[:, None]
        two = np.flatnonzero(x.paired)
        spread = back.copy()
        spread[two + 1] += back[two]
        counts = np.diff(np.concatenate([x.block_start, [len(z)]]))
        dz = np.repeat(spread, counts, axis=0)
        dz[(z <= 0) | ~x.whole[:, None]] = 0
        grads |= {"a": rows.T @ dz, "b": rows[1:].T @ dz[:-1], "bias": dz.sum(0)}
        dx = dz @ p["a"].T
        dx[1:] += dz[:-1] @ p["b"].T
        flat, dx = x.data.reshape(-1), dx[:, :-1].reshape(-1, EMBED)
        grads["embed"] = np.stack([np.bincount(flat, weights=dx[:, k], minlength=256) for k in range(EMBED)], axis=1)
        return grads

    def fit(self, texts: list[str], labels: list[int], seed: int = 2) -> Network:
        """Adam on weighted log loss; classes weigh alike. One class alone leaves its prior."""
        y = np.array(labels, np.float32)
        if not len(y) or y.min() == y.max():
            self.p["out"][:] = 0
            self.p["prior"][:] = 0 if not len(y) else (4 if y[0] else -4)
            return self
        g = np.random.Generator(np.random.PCG64(seed))
        texts, good = list(texts), np.flatnonzero(y == 1)
        for j in g.choice(good, PIECES):
            begin = int(g.integers(0, max(1, len(texts[j]) - 4)))
            texts.append(texts[j][begin : begin + int(g.integers(3, PIECE_CHARS))])
        y = np.concatenate([y, np.ones(PIECES, np.float32)])
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, most = 0, EPOCHS * -(-len(y) // BATCH)
        for _ in range(EPOCHS):
            order = g.permutation(len(y))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                layout = Layout(*byte_view(pa.array([texts[j] for j in own], pa.large_string())))
                t += 1
                rate = RATE * (1 - 0.9 * t / most)
                for k, d in self.gradients(layout, y[own], weight[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.99 * s[k] + 0.01 * d * d
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        raw, offsets = byte_view(texts)
        if len(raw) <= SLICE:
            return self.forward(Layout(raw, offsets))[-1].astype(np.float64)
        return np.array([self._long_score(raw[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)])

    def _long_score(self, raw: np.ndarray) -> float:
        """The score of one text by windows of SLICE bytes, of which the largest chunks are kept: equal to that of the
        whole, in bounded memory. A window has a block before it (for repeats) and two after (for its last chunk)."""
        size, per = HOP * STEP, max(1, SLICE // (HOP * STEP))
        blocks = -(-(max(-(-len(raw) // STEP), 2) - 1) // HOP)
        top = np.full(FILTERS, -1, np.float32)
        for b in range(0, blocks, per):
            lo, hi = max(b - 1, 0), min(b + per + 2, blocks)
            end = len(raw) if hi == blocks else hi * size + STEP
            chunk = self.forward(Layout(raw[lo * size : end], np.array([0, end - lo * size])))[2]
            top = np.maximum(top, chunk[b - lo : min(b + per, blocks) - lo].max(axis=0))
        logit = float(top @ self.p["out"] + self.p["prior"][0])
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, logit))))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Network:
    """A network fitted on at most `rows` labelled rows of each class, drawn by a hash of the id, not held out.

    Null ids and labels other than 0 and 1 are left out, as are null texts; of an id's several texts the least counts;
    an id with both labels is an example of both. Of texts beyond FIT_CHARS code points a piece of so many counts, at a place
    that a hash of the id gives. Without examples of both classes the network knows their prior alone.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).filter((F.col("y").isin(0, 1)) & ~held_out(F.col("i")) & F.col("i").isNotNull())
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null")
    draw = [F.xxhash64("i"), F.col("i")]
    begin = F.pmod(F.xxhash64("i"), F.greatest(F.char_length("t") - FIT_CHARS, F.lit(0)) + 1).cast("int") + 1
    drawn = 2 * rows
    while True:
        # 2 * drawn ids at most; more only where too many of them have no text
        picked = ids.filter("y = 0").distinct().orderBy(*draw).limit(drawn).union(ids.filter("y = 1").distinct().orderBy(*draw).limit(drawn)).withColumn("h", F.xxhash64("i"))
        taken = picked.groupBy("y").count().collect()
        pieces = texts.join(F.broadcast(picked), "i").select("i", "y", "h", F.substring("t", begin, F.lit(FIT_CHARS)).alias("t"))
        # one text for an id, however often it stands there
        first = Window.partitionBy("y").orderBy("h", "i")
        found = pieces.groupBy("i", "y", "h").agg(F.min("t").alias("t")).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= rows)
        got = sorted(found.select("i", "t", "y").collect())
        own = {y: sum(r["y"] == y for r in got) for y in (0, 1)}
        if all(r["count"] < drawn or own[r["y"]] >= rows for r in taken):
            return Network().fit([r[1] for r in got], [r[2] for r in got])
        drawn *= 8


def score_quality(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score and predicted of every row, by its whole text. Null texts score as empty ones, repeated rows alike;
    texts longer than SLICE bytes go by windows, with the same score; other columns are left out."""
    ship_code(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "t", SLICE):
            s = held.value.scores(piece.column("t"))
            yield pa.RecordBatch.from_arrays([piece.column("i"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"`{id_col}` long, score double, predicted int")


def keep_quality(docs: DataFrame, network: Network, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows that score below the threshold; nothing is shuffled. Null texts score as empty ones, repeated
    rows are alike, other columns stay as they are; an empty table gives no rows."""
    ship_code(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text_col, SLICE):
            yield piece.filter(pa.array(held.value.scores(piece.column(text_col).cast(pa.string())) >= threshold))

    return docs.mapInArrow(run, docs.schema)
