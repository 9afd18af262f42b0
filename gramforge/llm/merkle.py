"""Merkle dataset manifest with a broadcast upper tree.

Rows become leaves in the scan; narrow rows (tree, order, digests) are ranged, numbered and packed, 3 ** BLOCK_LEVELS
consecutive leaves of one tree a block. Tasks reduce each block to its node. Nodes are packed and reduced again until
at most TOP are left; the driver builds the small upper tree of those and broadcasts each one's suffix: its siblings
from there to the root. Tasks then go over the packed blocks once more, finish the proofs of their rows and fold every
row up to the root. Trees of sources meet in one tree of subroots: on the driver, or, where there are more than TOP of
them, in the same layers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramforge.llm.runtime import Scratch, ship_code, stored

ARITY, BLOCK_LEVELS, TOP = 3, 7, 3**9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PACKED = "t string, b long, keys array<string>, leaves binary, others binary"
OUT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
SIZE = 32
#: Packed blocks of an Arrow batch on its way out.
BATCH_ROWS = 4096


def digest(data: bytes) -> bytes:
    """Lowercase hex, as bytes."""
    return hashlib.sha256(data).hexdigest().encode()


def grow(level: list[bytes], levels: int | None) -> list[list[bytes]]:
    """The levels over some nodes: as many as are asked for, or until one node is left."""
    out = [level]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest(b"".join(last[k : k + ARITY])) for k in range(0, len(last), ARITY)])
    return out


def siblings(levels: list[list[bytes]], at: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of a node within its run, level by level."""
    out = []
    for level in levels[:-1]:
        run = at - at % ARITY
        out.append((b"".join(level[run:at]), b"".join(level[at + 1 : run + ARITY])))
        at //= ARITY
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def _packed_path(path: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(bytes([len(x) // 64, len(y) // 64]) + bytes.fromhex((x + y).decode()) for x, y in path)


def _read_path(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at < len(data):
        left, right = data[at], data[at + 1]
        text = data[at + 2 : at + 2 + SIZE * (left + right)].hex().encode()
        out.append((text[: 64 * left], text[64 * left :]))
        at += 2 + SIZE * (left + right)
    return out


def _block_levels(b: int, leaves: bytes, depth: int) -> list[list[bytes]]:
    """Levels within a block. A tree of one block that isn't full ends when one node is left; all others go up `depth`."""
    text = leaves.hex().encode()
    nodes = [text[k : k + 64] for k in range(0, len(text), 64)]
    return grow(nodes, None if b == 0 and len(nodes) < ARITY**depth else depth)


def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with pos, their place within their tree `t` by `order` (a total order): ranged, counted in the tasks, and
    moved by the counts of earlier ranges, which at most one tree for each range needs."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, run = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column("t")
            changed = np.concatenate([[t[0].as_py() != last], pc.not_equal(t[1:], t[:-1]).to_numpy(zero_copy_only=False)])
            begin = np.maximum.accumulate(np.where(changed, np.arange(len(t)), -run))
            r = np.arange(len(t)) - begin
            last, run = t[len(t) - 1].as_py(), int(r[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(t), own, np.int32)), pa.array(r.astype(np.int64))], names=[*batch.schema.names, "p", "r"])

    shape = T.StructType([*rows.schema.fields, T.StructField("p", T.IntegerType()), T.StructField("r", T.LongType())])
    ranged = rows.repartitionByRange("t", *order).sortWithinPartitions("t", *order)
    kept = scratch.keep(ranged.mapInArrow(number, shape), name)
    counts = kept.groupBy("p", "t").agg((F.max("r") + 1).alias("n"))
    earlier = Window.partitionBy("t").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    moved = scratch.keep(counts.withColumn("off", F.sum("n").over(earlier)).filter("off > 0").select("p", "t", "off"), f"{name}-offsets")
    # a row for each range at most: only the first tree of a range began before it
    return kept.join(F.broadcast(moved), ["p", "t"], "left").withColumn("pos", F.col("r") + F.coalesce("off", F.lit(0))).drop("p", "r", "off")


def _packed(nodes: DataFrame, depth: int, scratch: Scratch, name: str) -> DataFrame:
    """From (t, pos, key, leaf, other) to blocks (t, b, keys, leaves, others) of consecutive nodes; other is null where it
    is equal to leaf."""
    size = ARITY**depth

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def made() -> dict:
            t = pa.Table.from_batches(held)
            flat = lambda c: b"".join(c.to_pylist())
            return {"t": at[0], "b": at[1], "keys": t.column("key").to_pylist(), "leaves": flat(t.column("leaf")), "others": flat(pc.coalesce(t.column("other"), t.column("leaf")))}

        done: list[dict] = []
        shape = pa.schema([("t", pa.string()), ("b", pa.int64()), ("keys", pa.list_(pa.string())), ("leaves", pa.binary()), ("others", pa.binary())])
        out = lambda: pa.RecordBatch.from_pylist(done, schema=shape)
        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t, b = batch.column("t"), batch.column("b")
            changed = pc.or_(pc.not_equal(t[1:], t[:-1]), pc.not_equal(b[1:], b[:-1])).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                now = (t[s].as_py(), b[s].as_py())
                if now != at:
                    if held:
                        done.append(made())
                        waiting += sum(x.num_rows for x in held)
                        if waiting >= BATCH_ROWS:
                            yield out()
                            done.clear()
                            waiting = 0
                    held, at = [], now
                held.append(batch.slice(s, e - s))
        if held:
            done.append(made())
        if done:
            yield out()

    blocks = nodes.select("t", F.expr(f"pos div {size}").alias("b"), "pos", F.col("key").cast("string").alias("key"), "leaf", "other")
    return scratch.keep(blocks.repartition("t", "b").sortWithinPartitions("t", "b", "pos").mapInArrow(pack, PACKED), name)


def _reduced(packed: DataFrame, depth: int, scratch: Scratch, name: str) -> DataFrame:
    """The node of each block: (t, pos, key, leaf, other), pos its block's number."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [bytes.fromhex(_block_levels(b, leaves, depth)[-1][0].decode()) for b, leaves in zip(batch.column("b").to_pylist(), batch.column("leaves").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("b"), pa.nulls(len(tops), pa.string()), pa.array(tops, pa.binary()), pa.nulls(len(tops), pa.binary())], names=["t", "pos", "key", "leaf", "other"])

    return scratch.keep(packed.select("t", "b", "leaves").mapInArrow(reduce, "t string, pos long, key string, leaf binary, other binary"), name)


def _top(nodes: list[tuple[str, int, bytes]], one_tree: bool) -> tuple[bytes, dict[tuple[str, int], tuple[bytes, bytes]]]:
    """The root, and of every node its subroot (empty where the nodes are of the tree of subroots) and its suffix. No
    nodes have no root."""
    if not nodes:
        return b"", {}
    trees: dict[str, list[bytes]] = {}
    for t, _, leaf in sorted(nodes):
        trees.setdefault(t, []).append(leaf.hex().encode())
    grown = {t: grow(level, None) for t, level in trees.items()}
    over = grow([x[-1][0] for x in grown.values()], None)
    out = {}
    for k, (t, levels) in enumerate(grown.items()):
        rest = siblings(over, k)
        for b in range(len(levels[0])):
            out[t, b] = (b"" if one_tree else levels[-1][0], _packed_path(siblings(levels, b) + rest))
    return over[-1][0], out


def _spread(packed: DataFrame, suffixes, depth: int, joined: bool) -> DataFrame:
    """Suffixes of a layer's blocks handed down to their nodes: (t, b, subroot, suffix). `joined`: the nodes are subroots,
    each a block of the tree that its key names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = _block_levels(row["b"], row["leaves"], depth)
                subroot, suffix = suffixes(row)
                n = len(levels[0])
                names = row["keys"] if joined else [row["t"]] * n
                numbers = np.zeros(n, np.int64) if joined else row["b"] * ARITY**depth + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers), pa.array(levels[0] if joined else [subroot] * n, pa.binary()), pa.array([_packed_path(siblings(levels, k)) + suffix for k in range(n)], pa.binary())], names=["t", "b", "subroot", "suffix"])

    return packed.mapInArrow(run, "t string, b long, subroot binary, suffix binary")


def _finished(packed: DataFrame, suffixes, root: bytes, depth: int, id_col: str, id_type: str) -> DataFrame:
    """Every row's leaf, proof and fold; the fold goes from `others`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = _block_levels(row["b"], row["leaves"], depth)
                others = row["others"].hex().encode()
                subroot, suffix = suffixes(row)
                rest = _read_path(suffix)
                end = b"".join(x + y for x, y in rest)
                proofs, folded = [], []
                for k in range(len(levels[0])):
                    own = siblings(levels, k)
                    proofs.append(digest(b"".join(x + y for x, y in own) + end).decode())
                    folded.append(fold(fold(others[64 * k : 64 * k + 64], own), rest))
                n = len(proofs)
                text = lambda xs: pa.array([x.decode() for x in xs], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.string()), text(levels[0]), text([subroot] * n), text([root] * n), pa.array(proofs, pa.string()), text(folded), pa.array([x == root for x in folded])], names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return packed.mapInArrow(run, f"key string, {OUT}").select(F.col("key").cast(id_type).alias(id_col), *[c.split(" ")[0] for c in OUT.split(", ")])


def leaves(docs: DataFrame, fields: tuple[str, ...], tree_col: str, id_col: str, text_col: str, tampered: Column | None) -> DataFrame:
    """(t, k, key, leaf, other, m): tree, order, id, digests of the row and of what became of its text; m tells rows that
    are equal in all else apart."""
    whole = lambda text: F.unhex(F.sha2(F.concat(*[field(text if c == text_col else F.col(c)) for c in fields]).cast("binary"), 256))
    other = F.lit(None).cast("binary") if tampered is None else F.when(F.coalesce(tampered & F.contains(F.col(text_col), F.lit("\n")), F.lit(False)), whole(F.replace(F.col(text_col), F.lit("\n"))))
    # the null tree comes first
    t = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))
    return docs.select(t.alias("t"), F.col(id_col).cast("long").alias("k"), F.col(id_col).cast("string").alias("key"), whole(F.col(text_col)).alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("m"))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, tree_col: str = "source", id_col: str = "doc_id", text_col: str = "text", depth: int = BLOCK_LEVELS, top: int = TOP) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A leaf is the digest of the fields of its row; `tampered` (of the columns of docs) tells whose texts lose their line
    breaks before the fold. Null fields are `-`; a null tree comes first, a null id first within its tree and is never
    tampered with unless `tampered` says so; rows of one id are in the order of their leaves, repeated rows are leaves
    of their own; texts of any length are taken whole, in the scan; columns that aren't fields are left out; an empty
    table gives no rows. At most `top` nodes reach the driver. The result is stored, intermediates are removed.
    """
    spark = docs.sparkSession
    ship_code(spark)
    scratch = Scratch(spark, "merkle")
    rows = scratch.keep(leaves(docs, fields, tree_col, id_col, text_col, tampered), "leaves")
    layers = [(_packed(_numbered(rows, ["k", "leaf", "m"], scratch, "ranged"), depth, scratch, "blocks"), False)]
    nodes, one_tree = _reduced(layers[0][0], depth, scratch, "nodes"), False
    while nodes.count() > top:
        join = not one_tree and not nodes.filter("pos > 0").limit(1).count()
        if join:  # each tree is one node by now
            one_tree = True
            subroots = nodes.select(F.lit("").alias("t"), F.col("t").alias("key"), "leaf", "other")
            nodes = _numbered(subroots, ["key"], scratch, "subroots")
        layers.append((_packed(nodes, depth, scratch, f"blocks-{len(layers)}"), join))
        nodes = _reduced(layers[-1][0], depth, scratch, f"nodes-{len(layers)}")
    root, small = _top([(r["t"], r["pos"], bytes(r["leaf"])) for r in nodes.select("t", "pos", "leaf").collect()], one_tree)
    held = spark.sparkContext.broadcast(small)
    suffixes = lambda row: held.value[row["t"], row["b"]]
    handed = lambda row: (row["subroot"], row["suffix"])
    for k in reversed(range(1, len(layers))):
        packed, join = layers[k]
        down = scratch.keep(_spread(packed, suffixes, depth, join), f"suffixes-{k}")
        layers[k - 1] = (layers[k - 1][0].join(down, ["t", "b"]), layers[k - 1][1])
        suffixes = handed
    id_type = docs.schema[id_col].dataType.simpleString()
    out = stored(_finished(layers[0][0], suffixes, root, depth, id_col, id_type), "merkle")
    held.destroy()
    scratch.remove()
    return out
