"""Token ids as Arrow IPC files of fixed-size lists, for zero-copy random access to equal-length sequences.

Documents are dealt to buckets by ascending id, one file each. A file has the columns `ids` (fixed-size list of the
narrowest unsigned type that holds the vocabulary) and `mask` (fixed-size list of booleans, false on the padding of the
last sequence); a second Arrow file beside it has doc_id, start and n_tokens of its documents. Files are uncompressed,
so that a memory-mapped sequence is a view.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramforge.llm.runtime import LOWEST, id_bounds, shared_dir, ship_code, task_count

SEQUENCE = 2048
SEQUENCES_PER_BATCH = 64
END_ID = 1
CACHE_WORDS = 600_000
PIECES_TOGETHER = 512
PIECE_BYTES = 9 << 20  # an Arrow batch
MANIFEST = "bucket int, path string, docs long, tokens long"

_cache: dict[str, dict[str, bytes]] = {}
_loaded: dict[str, object] = {}


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


class Encoder:
    """Whole texts to little-endian ids. The vocabulary drops white space and merges nothing across it, so texts are cut
    at blanks and line ends and each distinct piece is encoded by the library once while it stays in the cache."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.cache = _cache.setdefault(path, {})
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True

    def _taken_apart(self, words: list[str]) -> set[str]:
        """Those words of letters that are no longer letters alone once the library has normalised them."""
        if self.tokenizer.normalizer is None or not words:
            return set()
        made = self.tokenizer.normalizer.normalize_str(" ".join(words)).split(" ")
        if len(made) != len(words):
            return set(words)
        return {w for w, m in zip(words, made, strict=True) if not m.isalpha()}

    def _learn(self, new: set[str]) -> None:
        """Encodes pieces into the cache. A word that is letters only once the library has normalised it is one unit of
        the library's own split, whatever stands beside it, and so is one full stop or comma after it: such words are
        encoded together."""
        stems = {w: w[:-1] for w in new if w[-1:] in (".", ",") and w[:-1].isalpha()}
        plain = {w for w in new if w.isalpha()}
        apart = self._taken_apart([w for w in {*plain, *stems.values()} if not w.isascii()])
        if apart:
            stems = {w: stem for w, stem in stems.items() if stem not in apart}
            plain -= apart
        words = list({x for x in (*plain, *stems.values()) if x not in self.cache})
        other = [w for w in new if w not in stems and w not in plain]
        spoiled: set[str] = set()
        groups = [words[i : i + PIECES_TOGETHER] for i in range(0, len(words), PIECES_TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids)
            cuts = [0, *(np.flatnonzero(self.ends_word[ids]) + 1).tolist()]
            if len(cuts) != len(group) + 1:  # a letter that the library takes apart all the same
                spoiled.update(group)
                continue
            data, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            for w, start, cut in zip(group, cuts[:-1], cuts[1:], strict=True):
                self.cache[w] = data[start * size : cut * size]
        if spoiled:
            other += [*(plain & spoiled), *(w for w, stem in stems.items() if stem in spoiled)]
            stems = {w: stem for w, stem in stems.items() if stem not in spoiled}
        other += ["."] * ("." not in self.cache) + [","] * ("," not in self.cache)
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.cache[w] = np.array(e.ids, self.dtype).tobytes()
        for w, stem in stems.items():
            self.cache[w] = self.cache[stem] + self.cache[w[-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (null: empty), and how many each text has."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        pieces = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._learn({w for w in distinct if w not in self.cache})
        parts = [self.cache[w] for w in distinct]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(parts), self.dtype)
        each = sizes[at]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(starts[at] - upto[:-1], each) + np.arange(upto[-1])]
        bounds = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        return ids, np.diff(upto[bounds])


class _Writer:
    """One bucket's two files, written under names of this attempt and then moved, so that a retried task is harmless."""

    def __init__(self, folder: str, bucket: int, dtype: np.dtype, sequence: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.index_path = f"{root}/bucket-{bucket:06d}.arrow", f"{root}/bucket-{bucket:06d}.index.arrow"
        self.part = f".{uuid.uuid4().hex}"
        self.sequence, self.dtype = sequence, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sink = self.fs.open_output_stream(self.path + self.part)
        self.index_sink = self.fs.open_output_stream(self.index_path + self.part)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.index_out = pa.ipc.new_file(self.index_sink, self.index_schema)
        self.rest, self.docs, self.tokens, self.folder, self.bucket = np.zeros(0, dtype), 0, 0, folder, bucket

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, end_id: int) -> None:
        ends = np.cumsum(counts)
        counts = counts + 1
        starts = self.tokens + np.cumsum(counts) - counts
        self.index_out.write_batch(pa.record_batch([doc_ids.cast(pa.int64()), pa.array(starts), pa.array(counts)], schema=self.index_schema))
        self.docs += len(counts)
        self.tokens += int(counts.sum())
        self.rest = np.concatenate([self.rest, np.insert(ids, ends, end_id)])
        step = self.sequence * SEQUENCES_PER_BATCH
        at = 0
        while len(self.rest) - at >= step:
            self._put(self.rest[at : at + step], step)
            at += step
        self.rest = self.rest[at:].copy()

    def _put(self, values: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(values)) < real)
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(values), self.sequence), pa.FixedSizeListArray.from_arrays(mask, self.sequence)], schema=self.schema))

    def close(self) -> dict:
        if real := len(self.rest):
            self._put(np.concatenate([self.rest, np.zeros(-real % self.sequence, self.dtype)]), real)
        for x in (self.out, self.index_out, self.sink, self.index_sink):
            x.close()
        self.fs.move(self.path + self.part, self.path)
        self.fs.move(self.index_path + self.part, self.index_path)
        return {"bucket": [self.bucket], "path": [f"{self.folder}/bucket-{self.bucket:06d}"], "docs": [self.docs], "tokens": [self.tokens]}


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files under `folder` (a URI all executors share) and returns their manifest, kept there as Parquet.

    Null texts are empty (their ids are the end id alone), null ids sort first, rows of one id are in the order of a hash
    of their texts (and can fill several files), repeated rows are documents of their own, an empty table writes no
    file. Other columns are left out.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST).cast("long")).alias("k"), F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    n = task_count(rows, "t")
    bucket, _ = id_bounds(rows, "k", "h", n)
    sorted_rows = rows.withColumn("b", bucket).repartitionById(n, F.col("b")).sortWithinPartitions("b", "k", "h", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gramforge.llm.bytescan import slices

        encoder, out = Encoder(tokenizer_path), None
        for piece in slices(batches, "t", PIECE_BYTES):
            buckets = piece.column("b").to_numpy()
            for b in np.unique(buckets):
                at = np.flatnonzero(buckets == b)
                own = piece.slice(at[0], len(at))
                if out is None or out.bucket != b:
                    if out is not None:
                        yield pa.RecordBatch.from_pydict(out.close(), schema=shape)
                    out = _Writer(folder, int(b), encoder.dtype, sequence)
                out.add(own.column("i"), *encoder.encode(own.column("t")), end_id)
        if out is not None:
            yield pa.RecordBatch.from_pydict(out.close(), schema=shape)

    shape = pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
    sorted_rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, in no order."""
    ship_code(manifest.sparkSession)
    # one row for a file
    offset = F.coalesce(F.sum("tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    files = manifest.select("bucket", "path", offset.alias("offset"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                ids, index = token_stream(path), token_index(path)
                starts, counts = (index.column(c).to_numpy() for c in ("start", "n_tokens"))
                crcs = [zlib.crc32(ids[a : a + c].astype("<u4").tobytes()) for a, c in zip(starts.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([index.column("doc_id").combine_chunks(), pa.array(starts + offset), pa.array(counts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartitionById(n, F.col("bucket")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _opened(path: str) -> pa.ipc.RecordBatchFileReader:
    fs, local = pafs.FileSystem.from_uri(path)
    source = pa.memory_map(local) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(local)
    return pa.ipc.open_file(source)


def token_index(path: str) -> pa.Table:
    return _opened(f"{path}.index.arrow").read_all()


def token_stream(path: str) -> np.ndarray:
    """All ids of one file without the padding."""
    reader = _opened(f"{path}.arrow")
    parts = []
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        ids = batch.column("ids").flatten().to_numpy()
        parts.append(ids[: batch.column("mask").flatten().sum().as_py() or 0] if i == reader.num_record_batches - 1 else ids)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def read_sequence(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence k of a file and its mask; the ids are a view of the mapped file."""
    reader = _opened(f"{path}.arrow")
    batch = reader.get_batch(k // SEQUENCES_PER_BATCH)
    row = k % SEQUENCES_PER_BATCH
    return batch.column("ids")[row].values.to_numpy(), batch.column("mask")[row].values.to_numpy(zero_copy_only=False)


def tokenize(docs: DataFrame, tokenizer_path: str | None = None, **options) -> DataFrame:
    """Writes the files into a new shared folder and reads them back. Odd rows are treated as in write_token_files, texts of
    any length are taken whole."""
    folder = shared_dir(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer_path or word_bpe_path(), **options))
