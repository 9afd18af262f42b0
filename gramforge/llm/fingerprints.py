"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes cuts a text where its low bits are zero; the test is strict below the normal chunk
length and loose above it (normalised chunking), with a least and a greatest length. A fingerprint is the set of the
digests of the chunks with their lengths, as hexadecimal text; what two sets share, weighted by length, over the
weight of the first is its containment in the second.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.bytescan import slices
from gramforge.llm.runtime import LOWEST, id_bounds, ship_code, task_count

LEAST, NORMAL, MOST = 16, 48, 255
STRICT, LOOSE = np.uint32(0x7F), np.uint32(0x1F)
WINDOW = 32
RECORD = 6
_random = np.random.Generator(np.random.PCG64(7))
GEAR = _random.integers(0, 1 << 32, size=256, dtype=np.uint32)
GEAR[0xFF] = 0  # never in UTF-8: fills the window before a text
DIGEST_TABLE = _random.integers(1, 1 << 63, size=256 * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chunk_ends(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """The ends of the chunks of each text raw[begins[i]:ends[i]]; WINDOW bytes 0xFF stand before each text."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[loose] & STRICT) == 0).tolist()
    low, high = np.searchsorted(loose, begins), np.searchsorted(loose, ends)
    cuts = (loose + 1).tolist()
    out = []
    for begin, end, a, b in zip(begins.tolist(), ends.tolist(), low.tolist(), high.tolist(), strict=True):
        own, start = [], begin
        for j in range(a, b):
            at = cuts[j]
            while at - start > MOST:
                start += MOST
                own.append(start)
            size = at - start
            if size >= LEAST and (size >= NORMAL or strict[j]):
                own.append(at)
                start = at
        while end - start > MOST:
            start += MOST
            own.append(start)
        if end > start:
            own.append(end)
        out.append(own)
    return out


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the ascending distinct records digest << 8 | length of its chunks."""
    gap = b"\xff" * WINDOW
    raw = np.frombuffer(gap + gap.join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = WINDOW + np.cumsum(sizes + WINDOW) - sizes - WINDOW
    ends = begins + sizes
    per_text = chunk_ends(raw, begins, ends)
    cuts = np.array([c for own in per_text for c in own], np.int64)
    counts = np.array([len(own) for own in per_text], np.int64)
    if not len(cuts):
        return [np.zeros(0, np.uint64) for _ in texts]
    starts = np.empty_like(cuts)
    starts[1:] = cuts[:-1]
    first = np.cumsum(counts) - counts
    starts[first[counts > 0]] = begins[counts > 0]
    lengths = cuts - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    used = raw[np.repeat(starts, lengths) + place]
    digest = np.add.reduceat(DIGEST_TABLE[(place << 8) | used], at)
    digest ^= digest >> np.uint64(29)
    digest *= np.uint64(0xBF58476D1CE4E5B9)
    records = ((digest >> np.uint64(24)) << np.uint64(8)) | lengths.astype(np.uint64)
    return [np.unique(records[f : f + c]) for f, c in zip(first.tolist(), counts.tolist(), strict=True)]


def as_text(records: np.ndarray) -> str:
    """Six bytes in hexadecimal for each record: five of the digest, one of the length."""
    return records.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - RECORD :].tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's weight that b has as well; of an empty a: 1 if b is empty, else 0."""
    if not len(a):
        return float(not len(b))
    weight = (a & np.uint64(0xFF)).astype(np.int64)
    if not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return float(weight[b[at] == a].sum() / weight.sum())


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and `fingerprint` of every row, without a shuffle. Null texts are empty and have an empty fingerprint."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "t"):
            made = fingerprints([(t or "").encode() for t in piece.column("t").to_pylist()])
            yield pa.RecordBatch.from_arrays([piece.column("i"), pa.array(map(as_text, made), pa.string())], names=[id_col, "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"`{id_col}` long, fingerprint string")


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (second half replaced by the next document's beginning).

    Rows follow one another by id, then a hash of the text (null ids first, null texts as empty), the first after the
    last; a single row is its own next; an empty table gives no rows. Texts of any length are taken whole, other columns
    are left out. Rows are dealt by id ranges, and the first row of a range also goes to the range before it.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST).cast("long")).alias("k"), F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    n = task_count(rows, "t")
    bucket, _ = id_bounds(rows, "k", "h", n)
    bucketed = rows.withColumn("b", bucket)
    firsts = sorted(bucketed.groupBy("b").agg(F.min(F.struct("k", "h")).alias("m")).select("b", "m.k", "m.h").collect())
    table = [(b, k, h, firsts[i - 1][0]) for i, (b, k, h) in enumerate(firsts)]
    # one row for a range
    first = F.broadcast(spark.createDataFrame(table, "b int, first_k long, first_h long, before int"))
    here, ahead = F.struct(F.col("b").alias("b"), F.lit(0).alias("ahead")), F.struct(F.col("before").alias("b"), F.lit(1).alias("ahead"))
    is_first = (F.col("k") == F.col("first_k")) & (F.col("h") == F.col("first_h"))
    dealt = bucketed.join(first, "b").select(F.inline(F.when(is_first, F.array(here, ahead)).otherwise(F.array(here))), "k", "h", "i", "t")
    ordered = dealt.repartitionById(n, F.col("b")).sortWithinPartitions("b", "ahead", "k", "h", "t")
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(ids: list, texts: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in zip(texts[:-1], texts[1:], strict=True)]
        own, changed = fingerprints([t.encode() for t in texts]), fingerprints([e.encode() for e in edited])
        cells = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), as_text(f), as_text(g), containment(f, g), containment(f, nxt)) for i, t, e, f, g, nxt in zip(ids, texts[:-1], edited, own[:-1], changed, own[1:], strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*cells, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, bucket = [], [], None
        for piece in slices(batches, "t"):
            new = zip(*(piece.column(c).to_pylist() for c in ("b", "ahead", "i", "t")), strict=True)
            for b, ahead, i, t in new:
                if b != bucket:
                    ids, texts, bucket = [], [], b
                if not ahead:
                    ids.append(i)
                    texts.append(t)
                elif ids:  # the row after this range: compares the last one
                    yield compared(ids, [*texts, t])
                    ids, texts = [], []
            if len(ids) > 1:
                yield compared(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]

    return ordered.mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
