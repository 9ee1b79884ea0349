"""Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Every row is a leaf, the leaves of a group (language) ascend by id, and every
8 consecutive nodes (the last run of a level may be shorter) become their hash
until one is left, the *subroot*. The subroots, ordered by group, become the
*root* the same way.

The tree of a group is cut into aligned blocks of four levels: a block of at
most 4096 leaves is one row, so a group with most of the rows is spread over
many tasks. Within a block the nodes stand in van Emde Boas order: a tree of h
levels is its upper half of levels followed by the subtrees that hang below,
each laid out in the same way. ``addresses`` turns (level, number) into a
place; hashing upwards and reading siblings both go through it. The block roots
are the leaves of the next round, so a round divides the rows by 4096; then the
way back hands each block the path from its root to the top of the manifest.

Only one number a round and the root come to the driver.

Defined results: a null field is ``-``; null ids come first, equal ids follow
by leaf hash; a null group comes before all others and is a group of its own.
Repeated rows are leaves of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_step, materialize, ship

ARITY = 8
HEIGHT = 4  # levels of edges in a block
BLOCK = ARITY**HEIGHT
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<l: string, r: string>>"


# -- layout ------------------------------------------------------------------

@cache
def addresses(levels: int) -> list[np.ndarray]:
    """Place of node i of depth d in the van Emde Boas order of a complete tree."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    top, bottom = addresses(levels // 2), addresses(levels - levels // 2)
    size, each = sum(map(len, top)), sum(map(len, bottom))
    roots = np.arange(len(top[-1]) * ARITY)
    return top + [(size + roots[:, None] * each + own[None, :]).ravel() for own in bottom]


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // ARITY), h + 1
    return h


class Tree:
    """One block: 32-byte nodes in van Emde Boas order; level 0 holds the leaves."""

    def __init__(self, nodes: np.ndarray, leaves: int, levels: int):
        self.nodes, self.levels = nodes, levels
        self.counts = [-(-leaves // ARITY**k) for k in range(levels + 1)]

    @classmethod
    def build(cls, leaves: list[bytes], levels: int) -> Tree:
        places = addresses(levels + 1)
        tree = cls(np.zeros((sum(map(len, places)), 32), np.uint8), len(leaves), levels)
        tree.nodes[places[levels][:len(leaves)]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)
        for level in range(levels):
            below = tree.level(level)
            above = [sha256("".join(below[at:at + ARITY]).encode()).digest() for at in range(0, len(below), ARITY)]
            tree.nodes[places[levels - level - 1][:len(above)]] = np.frombuffer(b"".join(above), np.uint8).reshape(-1, 32)
        return tree

    def level(self, level: int) -> list[str]:
        """Hex digests of a level, gathered by address."""
        own = self.nodes[addresses(self.levels + 1)[self.levels - level][:self.counts[level]]]
        raw = own.tobytes().hex()
        return [raw[i:i + 64] for i in range(0, len(raw), 64)]

    def steps(self) -> Iterator[list[tuple[str, str]]]:
        """For every leaf its siblings (to the left, to the right), level by level."""
        rows = [self.level(k) for k in range(self.levels)]

        def step(k, i):
            at = i // ARITY * ARITY
            return "".join(rows[k][at:i]), "".join(rows[k][i + 1:at + ARITY])

        upper: list[list] = [[]] * self.counts[self.levels]
        for k in reversed(range(self.levels)):
            upper = [[step(k, i), *upper[i // ARITY]] for i in range(self.counts[k])]
        return iter(upper)


# -- leaves and their places ------------------------------------------------

def leaf(fields: list[Column]) -> Column:
    """SHA-256 over every field as ``<bytes>:<value>``, ``-`` if null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (place in its group ``g`` by ``order``) and ``total``
    (rows of the group). Range partitions count their own rows; a table with one
    row for each partition and group moves them to their place."""
    names, out = rows.columns, rows.schema
    by = [F.col(c).asc_nulls_first() for c in ["g", *order]]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            local = []
            for g in b.column("g").to_pylist():
                now, seen = g, (seen + 1 if g == now else 0)
                local.append(seen)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(local, pa.int64())], names=[*names, "part", "local"])

    out = T.StructType(list(out.fields)).add("part", T.IntegerType()).add("local", T.LongType())
    placed = materialize(arrow_step(rows.repartitionByRange(*by).sortWithinPartitions(*by), step, out), "merkle-ranked")
    counts = materialize(placed.groupBy("part", "g").agg(F.count("*").alias("n")), "merkle-counts")
    before = Window.partitionBy("g").orderBy("part")
    moves = counts.select("part", "g", (F.sum("n").over(before) - F.col("n")).alias("first"),
                          F.sum("n").over(Window.partitionBy("g")).alias("total"))
    return placed.join(moves, ["part", "g"]).select(*names, (F.col("first") + F.col("local")).alias("pos"), "total")


# -- building upwards --------------------------------------------------------

def blocks(leaves: DataFrame) -> DataFrame:
    """One row per block of the ranked ``leaves`` (g, pos, total, digest, extra):
    g, block, total, levels, root, nodes, extra (the leaves' own values, in order)."""
    extra = leaves.schema["extra"].dataType
    schema = f"g string, block long, total long, levels int, root binary, nodes binary, extra array<{extra.simpleString()}>"

    def step(own: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        total = own.column("total")[0].as_py()
        levels = HEIGHT if total > BLOCK else height(total)
        tree = Tree.build(own.column("digest").to_pylist(), levels)
        root = tree.nodes[addresses(levels + 1)[0][0]].tobytes()
        values = own.column("extra").combine_chunks()
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        packed = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.Table.from_arrays(
            [own.column("g").slice(0, 1), own.column("block").slice(0, 1), pa.array([total], pa.int64()), pa.array([levels], pa.int32()),
             pa.array([root], pa.binary()), pa.array([tree.nodes.tobytes()], pa.binary()), packed],
            names=["g", "block", "total", "levels", "root", "nodes", "extra"])

    ship(leaves.sparkSession)
    cut = leaves.withColumn("block", F.expr(f"pos div {BLOCK}"))
    return materialize(cut.groupBy("g", "block").applyInArrow(step, schema), "merkle-blocks")


def forest(leaves: DataFrame) -> list[DataFrame]:
    """Block tables from the leaves up; a group's tree ends at its first table with one block."""
    tables = [blocks(leaves)]
    while (tables[-1].agg(F.max("block")).first()[0] or 0) > 0:
        low = tables[-1].where(f"total > {BLOCK}")
        up = low.select("g", F.col("block").alias("pos"), F.expr(f"(total + {BLOCK} - 1) div {BLOCK}").alias("total"),
                        F.col("root").alias("digest"), F.lit(None).cast("int").alias("extra"))
        tables.append(blocks(up))
    return tables


def subroots(tables: list[DataFrame]) -> DataFrame:
    tops = [t.where(f"total <= {BLOCK}").select("g", "root") for t in tables]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out


# -- and down again ----------------------------------------------------------

def _tree(nodes: bytes, leaves: int, levels: int) -> Tree:
    return Tree(np.frombuffer(nodes, np.uint8).reshape(-1, 32), leaves, levels)


def descend(table: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of the blocks below: (g, block, path) of every leaf of ``table``."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, block, levels, nodes, extra, path in zip(*(c.to_pylist() for c in b.columns)):
                steps = [[{"l": x, "r": y} for x, y in own] + path for own in _tree(nodes, len(extra), levels).steps()]
                for at in range(0, len(steps), 256):
                    part = steps[at:at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * len(part)), pa.array([block * BLOCK + at + i for i in range(len(part))], pa.int64()),
                         pa.array(part, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))], names=["g", "block", "path"])

    met = table.join(paths, ["g", "block"]).select("g", "block", "levels", "nodes", "extra", "path")
    return arrow_step(met, step, f"g string, block long, path {PATH}")


def block_paths(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, block, path) of the blocks of ``tables[0]``; ``above`` has (g, path) of every subroot."""
    paths = None
    for n in reversed(range(len(tables))):
        tops = tables[n].where(f"total <= {BLOCK}").select("g", "block").join(above, "g")
        paths = materialize(tops if paths is None else tops.union(descend(tables[n + 1], paths)), "merkle-paths")
    return paths


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def _proofs(bottom: DataFrame) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for levels, nodes, extra, path, subroot, root in zip(*(c.to_pylist() for c in b.columns)):
                tree = _tree(nodes, len(extra), levels)
                up = [(p["l"], p["r"]) for p in path]
                above = "".join(x + y for x, y in up)
                out = []
                for own, hexed, steps in zip(extra, tree.level(0), tree.steps()):
                    start = hexed if own["tampered"] is None else own["tampered"].hex()
                    folded = fold(fold(start, steps), up)
                    proof = sha256(("".join(x + y for x, y in steps) + above).encode()).hexdigest()
                    out.append((own["doc_id"], hexed, subroot, root, proof, folded, folded == root))
                columns = list(zip(*out))
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return arrow_step(bottom.select("levels", "nodes", "extra", "path", "subroot", "root"), step,
                      "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, fields: tuple[str, ...], id_col: str = "doc_id", group_col: str = "lang",
             tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified. ``tampered`` replaces fields of the rows that meet
    ``where`` before the proof is checked."""
    changed = tampered or {}
    again = leaf([changed.get(c, F.col(c)) for c in fields])
    again = F.when(F.coalesce(where, F.lit(False)), again) if changed and where is not None else F.lit(None).cast("binary")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g"),
        F.col(id_col).cast("long").alias("doc_id"), leaf([F.col(c) for c in fields]).alias("digest"), again.alias("tampered"))
    # the number only parts equal rows, so that many of them fill several range partitions
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    placed = ranked(rows, ["doc_id", "digest", "tampered", "row"])
    tables = forest(placed.select("g", "pos", "total", "digest", F.struct("doc_id", "tampered").alias("extra")))
    tops = materialize(subroots(tables), "merkle-subroots")
    upper = forest(ranked(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest")), ["name"])
                   .select("g", "pos", "total", "digest", F.col("name").alias("extra")))
    nothing = docs.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast(PATH).alias("path"))
    leaves = descend(upper[0], block_paths(upper, nothing))  # a path for every subroot, by its place
    names = upper[0].select("g", F.posexplode("extra").alias("at", "name"), "block")
    above = materialize(names.select("name", (F.col("block") * BLOCK + F.col("at")).alias("block"))
                        .join(leaves, "block").select(F.col("name").alias("g"), "path"), "merkle-above")
    root = subroots(upper).select(F.lower(F.hex("root"))).first()
    bottom = (tables[0].drop("root").join(block_paths(tables, above), ["g", "block"])
              .join(tops.select("g", F.lower(F.hex("root")).alias("subroot")), "g"))
    return _proofs(bottom.withColumn("root", F.lit(root and root[0]).cast("string")))
