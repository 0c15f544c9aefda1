"""Merkle manifest of a dataset, with a proof for every row, by the variant that broadcasts the upper tree.

Rows are leaves, ordered by id within their group; runs of ARITY nodes become their parent until one node, the subroot,
remains; subroots in the order of their groups become the root in the same way.

1. Leaves are hashed where the texts lie, sorted by ranges of (group, id) and numbered within their groups by the counts
   of the ranges before them. Only digests move.
2. Large blocks, subtrees of a fixed height, are reduced to their top node, a task for each block. A group of any size is
   many blocks.
3. The few top nodes are gathered on the driver, which builds the rest of the tree. It is sent to the workers, who read
   from it what follows the proofs of a block: its suffix path.
4. A second pass over the blocks finishes the proof of every row and folds what is found of the row now up to the root.

The height of blocks follows the number of rows, so that the top nodes are TOP_NODES at most. Where even the highest
blocks are more, or groups are, blocks of top nodes are reduced in a further distributed step, and suffix paths come back
as a table instead. Digests are the same whatever the height.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexolith.llm.common import Stored

#: Nodes of a run.
ARITY, BITS = 16, 4
#: Nodes that the driver gathers at most: 32 bytes each, and their groups' names.
TOP_NODES = 1 << 20
#: Levels of a block: so few that a block fits in a task, and so many that blocks are few.
HEIGHTS = (2, 3, 4)
#: Rows whose proofs are handed on at once.
ROWS_AT_ONCE = 1000
#: The columns of a leaf in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 (hex) of the fields, each as its UTF-8 byte count, a colon and its value, or - if it is null."""
    parts = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in fields.values()]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels(size: int) -> int:
    """Levels above ``size`` nodes until one remains."""
    n = 0
    while size > 1:
        size = -(-size // ARITY)
        n += 1
    return n


def parent(run: bytes) -> bytes:
    return sha256(run).hexdigest().encode()


def climbed(nodes: list[bytes], most: int) -> tuple[list[list[bytes]], list[bytes]]:
    """The runs of each of ``most`` levels above ``nodes``, and what remains; a node alone has a parent too."""
    runs = []
    for _ in range(most):
        runs.append([b"".join(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)])
        nodes = [parent(r) for r in runs[-1]]
    return runs, nodes


def steps_of(runs: list[list[bytes]], at: int) -> list[tuple[int, bytes, bytes]]:
    """(place, siblings before, siblings after) of the node ``at`` and its ancestors."""
    out = []
    for level in runs:
        run, place = level[at // ARITY], at % ARITY
        out.append((place, run[: 64 * place], run[64 * place + 64 :]))
        at //= ARITY
    return out


def folded(digest: bytes, steps: list[tuple[int, bytes, bytes]]) -> bytes:
    for _, before, after in steps:
        digest = parent(before + digest + after)
    return digest


def packed(steps: list[tuple[int, bytes, bytes]]) -> bytes:
    """A path as bytes: for each step its place, its siblings' number and their digests."""
    return b"".join(bytes([place, (len(before) + len(after)) // 64]) + bytes.fromhex((before + after).decode()) for place, before, after in steps)


def unpacked(path: bytes) -> list[tuple[int, bytes, bytes]]:
    out, at = [], 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        hexes = path[at + 2 : at + 2 + 32 * n].hex().encode()
        out.append((place, hexes[: 64 * place], hexes[64 * place :]))
        at += 2 + 32 * n
    return out


class Top:
    """The upper tree: from the top nodes of every group's tree, at most TOP_NODES, to the root."""

    def __init__(self, nodes: list[tuple[str, int, bytes]], joined: bool) -> None:
        trees: dict[str, list[tuple[int, bytes]]] = {}
        for tree, at, digest in nodes:
            trees.setdefault(tree, []).append((at, digest.hex().encode()))
        self.runs, subroots = {}, {}
        for tree, own in trees.items():
            self.runs[tree], (subroots[tree],) = climbed([d for _, d in sorted(own)], levels(len(own)))
        order = sorted(subroots, key=lambda t: t.encode("utf-8", "surrogatepass"))
        self.place = {t: i for i, t in enumerate(order)}
        # joined: the only tree is that of subroots already
        self.above, (self.root,) = ([], [subroots[order[0]]]) if joined else climbed([subroots[t] for t in order], levels(len(order)))

    def suffix(self, tree: str, at: int) -> list[tuple[int, bytes, bytes]]:
        return steps_of(self.runs[tree], at) + steps_of(self.above, self.place[tree])


def numbered(rows: DataFrame, tree: str, by: list[str]) -> DataFrame:
    """``rows`` sorted by ``tree`` and ``by`` in ranges and stored, with at (from 0, within the tree) and size (of the tree).

    A tree may lie in many ranges; what lies before a range follows from one count for each range and tree.
    """
    ranged = rows.repartitionByRange(tree, *by).sortWithinPartitions(tree, *by).withColumn("_row", F.monotonically_increasing_id())
    stored = Stored(ranged).rows.withColumn("_range", F.shiftright("_row", 33))
    parts = stored.groupBy(tree, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(tree).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("size", F.sum("_n").over(Window.partitionBy(tree))).drop("_n")
    found = stored.join(parts, [tree, "_range"])
    return found.withColumn("at", F.col("_before") + F.col("_row") - F.col("_first")).drop("_row", "_range", "_first", "_before")


def _block_of(height: int) -> Column:
    return F.shiftright("at", BITS * height).alias("block")


def _block(batches: list[pa.RecordBatch], schema_names: list[str]) -> dict[str, pa.Array]:
    """The columns of a block's rows in the order of their places."""
    whole = pa.Table.from_batches(batches).combine_chunks()
    order = np.argsort(whole["at"].to_numpy(), kind="stable")
    return {n: whole[n].combine_chunks().take(pa.array(order)) for n in schema_names}


def _levels_in(columns: dict[str, pa.Array], height: int) -> int:
    """Levels of a block: fewer than ``height`` only where its whole tree has fewer, however few nodes a last block has."""
    return min(height, levels(columns["size"][0].as_py()))


def _hexes(column) -> list[bytes]:
    return [d.hex().encode() for d in column.to_pylist()]


def reduced(nodes: DataFrame, height: int) -> DataFrame:
    """The top node (tree, at, size, digest) of every block of ``height`` levels of ``nodes`` (tree, at, size, digest)."""

    def top(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _block(list(batches), ["digest", "size"])
        _, (digest,) = climbed(_hexes(rows["digest"]), _levels_in(rows, height))
        size = -(-rows["size"][0].as_py() // ARITY**height)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([size], pa.int64()), pa.array([bytes.fromhex(digest.decode())], pa.binary())],
            names=["tree", "at", "size", "digest"],
        )

    blocks = nodes.select("tree", "at", "size", "digest", _block_of(height))
    return blocks.groupBy("tree", "block").applyInArrow(top, "tree string, at long, size long, digest binary")


def _finish(nodes: DataFrame, height: int, top, paths: DataFrame | None, rows_of, schema: str) -> DataFrame:
    """``rows_of`` (a block's columns, runs, suffix path) of every block, the suffix from ``top`` (sent) or the table ``paths``."""
    names = nodes.columns
    blocks = nodes.withColumn("block", _block_of(height))

    def finished(batches: list[pa.RecordBatch], suffix: list) -> Iterator[pa.RecordBatch]:
        columns = _block(batches, names)
        runs, _ = climbed(_hexes(columns["digest"]), _levels_in(columns, height))
        yield from rows_of(columns, runs, suffix)

    if paths is None:

        def with_top(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from finished(list(batches), top.value.suffix(key[0].as_py(), key[1].as_py()))

        return blocks.groupBy("tree", "block").applyInArrow(with_top, schema)

    def with_path(own: pa.Table, path: pa.Table) -> pa.Table:
        return pa.Table.from_batches(finished(own.to_batches(), unpacked(path["path"][0].as_py())))

    paths = paths.withColumnRenamed("at", "block")
    return blocks.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(with_path, schema)


def _path_rows(columns: dict, runs: list, suffix: list) -> Iterator[pa.RecordBatch]:
    names = columns["name"].to_pylist()
    ats = columns["own_at"].to_pylist()
    for i in range(0, len(names), ROWS_AT_ONCE):
        some = range(i, min(i + ROWS_AT_ONCE, len(names)))
        found = [packed(steps_of(runs, j) + suffix) for j in some]
        yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in some], pa.string()), pa.array([ats[j] for j in some], pa.int64()), pa.array(found, pa.binary())], names=["tree", "at", "path"])


def upper(nodes: DataFrame, joined: bool, top_nodes: int, height: int) -> tuple[Top | None, DataFrame | None]:
    """The way from ``nodes`` (tree, at, size, digest) to the root: the tree above them, or a table (tree, at, path)."""
    n, largest = nodes.agg(F.count(F.lit(1)), F.max("size")).first()
    if n <= top_nodes:
        return Top([(r["tree"], r["at"], bytes(r["digest"])) for r in nodes.select("tree", "at", "digest").collect()], joined), None
    own = nodes.select(F.col("tree").alias("name"), F.col("at").alias("own_at"), "tree", "at", "size", "digest")
    if largest == 1 and not joined:  # more groups than that: their subroots are numbered as one tree
        own = numbered(own.drop("at", "size").withColumn("tree", F.lit("")), "tree", ["name"])
        joined = True
    parents = Stored(reduced(own, height)).rows
    top, paths = upper(parents, joined, top_nodes, height)
    sent = nodes.sparkSession.sparkContext.broadcast(top) if top is not None else None
    return None, Stored(_finish(own, height, sent, paths, _path_rows, "tree string, at long, path binary")).rows


def manifest(
    docs: DataFrame, found: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, top_nodes: int = TOP_NODES
) -> DataFrame:
    """``id_col``, leaf, subroot, root, proof, places, folded_root and verified of every row of ``docs``.

    A leaf is the SHA-256 of ``fields``; digests are lower-case hex. proof has the siblings on the way to the root, level by
    level and left to right, 64 characters each, and places the node's place among them at each level. ``found`` gives
    columns as they are found now: folded_root is what the row found so and the proof lead to, verified whether it is root.

    Leaves of a group ascend by id, a null id first, equal ids by leaf, so repeated rows are leaves of their own in a
    defined order. A null group comes first and differs from an empty one. Nulls in any field have their own mark; empty
    and very long texts are hashed whole where they lie and never move. A group of one row is its own subroot, a table of
    one group has its subroot as root, an empty table gives no rows. Columns but the id, the group and the fields are not
    read, so they may have any names.
    """
    spark = docs.sparkSession
    own = {c: F.col(f"`{c}`") for c in fields}
    leaf, now = leaf_digest(own), leaf_digest(own | (found or {}))
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("tree"), F.col(f"`{id_col}`").alias("id"), F.unhex(leaf).alias("digest"), F.unhex(F.nullif(now, leaf)).alias("now")
    )  # a tree's name sorts as its group does, null first
    rows = numbered(leaves, "tree", ["id", "digest"])
    sizes = rows.groupBy("tree").agg(F.max("size").alias("size"))
    blocks = {h: F.sum(F.ceil(F.col("size") / ARITY**h)).alias(f"h{h}") for h in HEIGHTS}
    counts = sizes.agg(*blocks.values()).first()
    height = next((h for h in HEIGHTS if (counts[f"h{h}"] or 0) * 16 <= top_nodes), HEIGHTS[-1])
    if counts[0] is None:
        return docs.limit(0).select(F.col(f"`{id_col}`"), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof")], F.lit(None).cast("array<int>").alias("places"), F.lit("").alias("folded_root"), F.lit(True).alias("verified"))
    tops = Stored(reduced(rows, height)).rows
    top, paths = upper(tops, False, top_nodes, height)
    sent = spark.sparkContext.broadcast(top) if top is not None else None
    id_type = leaves.schema["id"].dataType.simpleString()

    def rows_of(columns: dict, runs: list, suffix: list) -> Iterator[pa.RecordBatch]:
        own_levels = levels(columns["size"][0].as_py()) - len(runs)  # of the suffix, those within the group
        leaves, now = _hexes(columns["digest"]), columns["now"].to_pylist()
        _, (block_top,) = climbed(leaves, len(runs))
        subroot = folded(block_top, suffix[:own_levels])
        root = folded(subroot, suffix[own_levels:])
        rest = b"".join(before + after for _, before, after in suffix)
        rest_places = [place for place, _, _ in suffix]
        for i in range(0, len(leaves), ROWS_AT_ONCE):
            n = min(ROWS_AT_ONCE, len(leaves) - i)
            proofs, places, ends = [], [], []
            for j in range(i, i + n):
                steps = steps_of(runs, j)
                proofs.append(b"".join([before + after for _, before, after in steps]) + rest)
                places.append([place for place, _, _ in steps] + rest_places)
                ends.append(folded(folded(now[j].hex().encode() if now[j] is not None else leaves[j], steps), suffix))
            text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [columns["id"][i : i + n], text(leaves[i : i + n]), text([subroot] * n), text([root] * n), text(proofs), pa.array(places, pa.list_(pa.int32())), text(ends), pa.array([e == root for e in ends])],
                names=["id", "leaf", "subroot", "root", "proof", "places", "folded_root", "verified"],
            )

    schema = f"id {id_type}, leaf string, subroot string, root string, proof string, places array<int>, folded_root string, verified boolean"
    return _finish(rows, height, sent, paths, rows_of, schema).withColumnRenamed("id", id_col)
