"""Merkle manifest of a dataset: block trees in van Emde Boas order, recursing over the block roots."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise

HEIGHT = 12   # a block is an aligned subtree over 2 ** HEIGHT leaves: 8,191 digests of 32 bytes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCKS = "grp string, block bigint, n bigint, keys array<string>, checks binary, nodes binary"


# ------------------------------------------------------------------ layout
@lru_cache
def layout(height: int) -> tuple[tuple[int, int, int], ...]:
    """(top size, bottom size, depth of the top's root) by depth, of a complete tree with ``height`` levels that is cut at
    half its height again and again: the top tree first, then its bottom trees from left to right.
    """
    rows = [(0, 0, 0)] * height

    def cut(depth: int, levels: int) -> None:
        if levels == 1:
            return
        top = levels // 2
        bottom = levels - top
        rows[depth + top] = (2 ** top - 1, 2 ** bottom - 1, depth)
        cut(depth, top)
        cut(depth + top, bottom)

    cut(0, height)
    return tuple(rows)


def addresses(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes number ``index`` (from 0, left to right) at ``depth`` in a tree with ``height`` levels.

    A node at the upper edge of a bottom tree lies behind the top tree and the bottom trees before its own; their common
    root is as many levels up as the top tree has. Any other node lies in the bottom tree of the ancestor at that edge.
    """
    rows, chain = layout(height), []
    while depth:
        chain.append(depth)
        depth = rows[depth][2]
    place, top = np.zeros(len(index), np.int64), (chain or [0])[0]
    for d in chain:
        size, below, _ = rows[d]
        place += size + ((index >> (top - d)) & size) * below
    return place


def levels_of(n: int) -> int:
    """Levels above the leaves of a whole tree over ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def _hex(digests: np.ndarray) -> list[bytes]:
    text = digests.tobytes().hex().encode()
    return [text[i:i + 64] for i in range(0, len(text), 64)]


def grow(leaves: np.ndarray, up: int) -> np.ndarray:
    """Digests (32 bytes a row) of the subtree with ``up`` levels over ``leaves``, in van Emde Boas order; places
    without a node are zero. A last node without a neighbour is hashed alone.
    """
    out = np.zeros((2 ** (up + 1) - 1, 32), np.uint8)
    level = leaves
    for depth in range(up, -1, -1):
        out[addresses(up + 1, depth, np.arange(len(level)))] = level
        if depth:
            text = _hex(level)
            pairs = (hashlib.sha256(b"".join(text[i:i + 2])).digest() for i in range(0, len(text), 2))
            level = np.frombuffer(b"".join(pairs), np.uint8).reshape(-1, 32)
    return out


def siblings(nodes: np.ndarray, count: int) -> np.ndarray:
    """(count, levels, 33) bytes: the neighbour of every leaf's ancestor, level by level upwards, behind a byte that says
    whether it is left (1), right (2) or missing (0).
    """
    up = (len(nodes) + 1).bit_length() - 2
    out, leaf = np.zeros((count, up, 33), np.uint8), np.arange(count)
    for k in range(up):
        index = leaf >> k
        other = index ^ 1
        there = np.flatnonzero(other < -(-count // 2 ** k))
        out[there, k, 0] = 2 - (index[there] & 1)
        out[there, k, 1:] = nodes[addresses(up + 1, up - k, other[there])]
    return out


def fold(digest: bytes, path: bytes) -> bytes:
    """The root, in lower-case hex, that a leaf (hex) and its path lead to."""
    for i in range(0, len(path), 33):
        side, other = path[i], path[i + 1:i + 33].hex().encode()
        digest = hashlib.sha256(other + digest if side == 1 else digest + other if side == 2 else digest).hexdigest().encode()
    return digest


# ------------------------------------------------------------------ tables
def leaf(**values: Column) -> Column:
    """Digest of the values in turn: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    text = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat(*[text(c) for c in values.values()]), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, from 0, and the number ``n`` of rows of every ``grp``, which may hold most of the table: range
    partitions number their own rows, behind the rows of earlier partitions.
    """
    rows = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")  # sampled for the ranges, then read again
    order = [*order, "digest", "tie"]
    parts = materialise(rows.repartitionByRange("grp", *order).withColumn("part", F.spark_partition_id()), "ranges")
    group = Window.partitionBy("grp")
    held = parts.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("here")).select(
        "grp", "part", F.sum("here").over(group).alias("n"),
        F.coalesce(F.sum("here").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order)) - 1
    return parts.withColumn("number", number).join(held, ["grp", "part"]).select(
        "grp", (F.col("number") + F.col("before")).alias("pos"), "n", "digest", "key", "check")


def _grower(height: int):
    def run(batches):
        for b in batches:
            keys, checks, nodes = [], [], []
            for n, rows in zip(b.column("n").to_pylist(), b.column("rows")):
                t = rows.values
                digests = np.frombuffer(b"".join(t.field("digest").to_pylist()), np.uint8).reshape(-1, 32)
                keys.append(t.field("key").to_pylist())
                checks.append(b"".join(t.field("check").to_pylist()))
                nodes.append(grow(digests, height if n > 2 ** height else levels_of(n)).tobytes())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("grp", "block", "n")], pa.array(keys, pa.list_(pa.string())),
                                              pa.array(checks, pa.binary()), pa.array(nodes, pa.binary())], names=["grp", "block", "n", "keys", "checks", "nodes"])
    return run


def _tiers(placed: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks, leaf blocks first, whose roots are the next table's leaves; and (grp, digest) of the roots."""
    size, tiers, roots = 2 ** height, [], []
    while True:
        row = F.struct("pos", "digest", "key", "check")
        blocks = placed.groupBy("grp", F.floor(F.col("pos") / size).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(row)).alias("rows"))
        blocks = materialise(blocks.mapInArrow(_grower(height), BLOCKS), "blocks")
        top = F.substring("nodes", 1, 32).alias("digest")
        tiers.append(blocks)
        roots.append(blocks.where(F.col("n") <= size).select("grp", top))
        rest = blocks.where(F.col("n") > size)
        if rest.isEmpty():
            out = roots[0]
            for r in roots[1:]:
                out = out.union(r)
            return tiers, materialise(out, "roots")
        placed = rest.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), top, F.lit(None).cast("string").alias("key"), top.alias("check"))


def _paths(height: int):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                v = {c: b.column(c)[r].as_py() for c in b.schema.names}
                nodes = np.frombuffer(v["nodes"], np.uint8).reshape(-1, 32)
                count = len(v["keys"])
                up = (len(nodes) + 1).bit_length() - 2
                digests = nodes[addresses(up + 1, up, np.arange(count))]
                cut = lambda x: [x[i:i + 32] for i in range(0, len(x), 32)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([v["grp"]] * count, pa.string()), pa.array(np.arange(count) + v["block"] * 2 ** height, pa.int64()), pa.array(v["keys"], pa.string()),
                    pa.array(cut(digests.tobytes()), pa.binary()), pa.array(cut(v["checks"]), pa.binary()),
                    pa.array([p.tobytes() + v["upper"] for p in siblings(nodes, count)], pa.binary()), pa.array([v["subroot"]] * count, pa.binary())],
                    names=["grp", "pos", "key", "digest", "check", "path", "subroot"])
    return run


def _walk(tiers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """Paths of all leaves, from the last table of blocks down; ``tops``: (grp, upper, subroot)."""
    ddl, above = "grp string, pos bigint, key string, digest binary, check binary, path binary, subroot binary", None
    for k in reversed(range(len(tiers))):
        whole = F.col("n") <= 2 ** height
        rows = tiers[k].where(whole).join(tops, "grp")  # a block is a row, so a large group is no large key
        if above is not None:
            upper = above.select("grp", F.col("pos").alias("block"), F.col("path").alias("upper"), "subroot")
            rows = rows.unionByName(tiers[k].where(~whole).join(upper, ["grp", "block"]))
        above = rows.mapInArrow(_paths(height), ddl)
        if k:
            above = materialise(above, "paths")
    return above


@dataclass(frozen=True)
class Manifest:
    """Tables of blocks and roots: of every group, and of the tree over the groups' roots. ``root`` is hex, None without rows."""
    tiers: list[DataFrame]
    subroots: DataFrame
    top_tiers: list[DataFrame]
    root: str | None
    height: int


def build(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields=FIELDS, check: Column | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of a table. Leaves of a group ascend by ``order`` (an integer; nulls first, equal ones by digest, so
    repeated rows stand side by side); groups ascend by the UTF-8 bytes of ``group``, null first. ``check``: another leaf
    digest of the row, to be held against the tree. Long texts are hashed where they lie; only digests are shuffled.
    """
    cols = {f: F.col(f) for f in fields}
    digest = leaf(**cols)
    name = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = docs.select(name.alias("grp"), F.col(order).cast("long").alias("number"), F.unhex(digest).alias("digest"),
                       F.col(order).cast("string").alias("key"), F.unhex(digest if check is None else check).alias("check"))
    tiers, subroots = _tiers(_placed(rows, ["number"]), height)
    top = subroots.select(F.lit("").alias("grp"), "digest", F.col("grp").alias("key"), F.col("digest").alias("check"))
    top_tiers, root = _tiers(_placed(top, ["key"]), height)
    first = root.first()
    return Manifest(tiers, subroots, top_tiers, first and bytes(first["digest"]).hex(), height)


def prove(manifest: Manifest) -> DataFrame:
    """(key, digest, check, path, subroot) of every leaf; ``path``: 33 bytes a level, as ``siblings`` gives them, up to the root."""
    start = manifest.top_tiers[0].select("grp").distinct().select("grp", F.lit(b"").alias("upper"), F.lit(b"").alias("subroot"))
    tops = _walk(manifest.top_tiers, start, manifest.height).select(F.col("key").alias("grp"), F.col("path").alias("upper"), F.col("digest").alias("subroot"))
    return _walk(manifest.tiers, materialise(tops, "tops"), manifest.height).select("key", "digest", "check", "path", "subroot")


def _audited(batches):
    for b in batches:
        paths, proofs, folded = b.column("path").to_pylist(), [], []
        for p, c in zip(paths, b.column("check").to_pylist()):
            proofs.append(hashlib.sha256("".join([p[i + 1:i + 33].hex() for i in range(0, len(p), 33) if p[i]]).encode()).hexdigest())
            folded.append(fold(c.hex().encode(), p).decode())
        hexed = lambda c: pa.array([v.hex() for v in b.column(c).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("key"), hexed("digest"), hexed("subroot"), pa.array(proofs, pa.string()), pa.array(folded, pa.string())],
                                         names=["key", "leaf", "subroot", "proof_sha256", "folded_root"])


def audit(manifest: Manifest) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) per row: every row's check digest is folded up its
    path and held against the root. An empty table gives no rows; other columns are not returned.
    """
    out = prove(manifest).mapInArrow(_audited, "key string, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(manifest.root).cast("string")
    return out.select("key", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
