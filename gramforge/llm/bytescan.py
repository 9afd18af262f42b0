"""Vectorised word hashing over the UTF-8 bytes of Arrow string columns.

A word is a run of ASCII letters and digits and of non-ASCII code points, in lower case. A hash of a word is a sum of
table values by place and byte (tabulation), so that no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
PLACES = 64
_random = np.random.Generator(np.random.PCG64(20240501))
PLACE_TABLE = _random.integers(1, 1 << 63, size=PLACES * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHINGLE_FACTORS = _random.integers(1, 1 << 63, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among some ascending values."""
    out = np.zeros(len(x), bool)
    if not len(sorted_values) or not len(x):
        return out
    # a table of their low bits leaves few of x to search for
    mask = x.dtype.type((1 << 22) - 1)
    table = np.zeros(1 << 22, bool)
    table[sorted_values & mask] = True
    at = np.flatnonzero(table[x & mask])
    out[at] = sorted_values[np.minimum(np.searchsorted(sorted_values, x[at]), len(sorted_values) - 1)] == x[at]
    return out


def free_memory() -> None:
    """Gives memory without use back to the system: workers are kept between tasks and count against their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one piece have about `limit` bytes; a longer text is a piece of its own."""
    free_memory()  # of tasks before
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    free_memory()


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offsets of each."""
    a = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    a = pa.concat_arrays([a])
    _, offsets, data = a.buffers()
    offs = np.frombuffer(offsets, np.int64, count=len(a) + 1, offset=8 * a.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Word hashes of some texts: `hash`, and `bounds` with the place of each text's first word."""

    def __init__(self, texts: pa.Array):
        raw, offs = byte_view(pc.utf8_lower(pc.fill_null(texts, "")))
        self.raw, self.offsets = raw, offs
        n = len(raw)
        inside = WORD_BYTE[raw]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.begin = np.flatnonzero(inside & (~before | first[:n]))
        after = np.empty(n, bool)
        after[n - 1 :] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.bounds = np.searchsorted(self.begin, offs)
        lengths = self.end - self.begin
        used = raw[inside]
        if len(lengths):
            at = np.cumsum(lengths) - lengths
            place = np.arange(len(used)) - np.repeat(at, lengths)
            values = PLACE_TABLE[((place & (PLACES - 1)) << 8) | used]
            if lengths.max() > PLACES:
                values = values * (2 * (place // PLACES).astype(np.uint64) + np.uint64(1))
            self.hash = mix64(np.add.reduceat(values, at))
        else:
            self.hash = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, and the bounds of each text's part; a text of 1 to k-1 words has one."""
    counts = np.diff(bounds)
    n = len(words)
    made = np.maximum(counts - k + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    if not n:
        return np.zeros(0, np.uint64), out_bounds
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += padded[j : j + n] * SHINGLE_FACTORS[j]
    start = np.repeat(bounds[:-1], made) + (np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], made))
    out = total[start]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[bounds[d] : bounds[d + 1]]
        out[out_bounds[d]] = (own * SHINGLE_FACTORS[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix64(out), out_bounds
