"""N-gram Jaccard join with token-combination prefixes, and near-duplicate components over its links.

A document is the set of its word shingles; documents with equal sets are one node from the start. Every slot of a
corpus-wide table of counts puts the shingles that fall into it in a class. Shingles are ordered by class, the rare one
first, and by hash within a class. A set is indexed by a prefix of that order:

* rare shingles are keys of their own;
* of frequent shingles pairs are keys. The range of hashes is dealt into parts and only pairs within a part count. The
  prefix is extended until it holds so many shingles, less one for each part that it touches, that a partner which lacks
  as many as the threshold allows must still share a rare shingle or a pair. There are few enough parts that the whole
  set always suffices.

Keys with the same nodes say the same, as those of one passage mostly do; one of them stays. Every node carries a parity
of its set, a bitmap by which most pairs that are no links are told from their sizes and bits alone, before any text is
read. What shares a key is then compared in steps whose rows follow the index, however large a group under a key is:

1. Stars: under each key everyone meets one node, chosen anew for each key. Links are verified on whole texts; their
   components are what is no longer compared.
2. Under keys that still hold several components and up to FEW nodes, the parities of all pairs are compared where the
   rows meet; only what they leave is looked up.
3. Under larger ones a center is chosen, and every node is measured against it: the symmetric difference D of both sets.
   Let w = (100 + percent) |D| - (100 - percent) size. Two sets x and y are similar if and only if w_x + w_y is at most
   2 (100 + percent) times what D_x and D_y share. If neither exceeds what the center allows, both are linked to it;
   otherwise they share part of their differences, which are indexed by prefixes in turn: what a whole group has in
   common is in no difference, so its size no longer matters. These rows take the place of the index, and the steps 2
   and 3 repeat; what is left after the last round is compared pair by pair.

No step leaves out a pair that could be a link between components, so components are exact up to collisions of 64-bit
hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexolith.llm.common import Stored, checkpointed, give_back, kept, settings
from lexolith.llm.components import components
from lexolith.llm.shingles import mixed, set_key, shingle_set

#: Slots of the corpus-wide count and the blocks in which it is summed.
SLOTS, BLOCKS = 1 << 22, 64
#: A slot is frequent if it has so many rows, and as many as chance gives a slot of this corpus (six deviations over the mean).
RARE, DEVIATIONS = 32, 6.0
#: Rows of a slot over that bound from which keys of its shingles may be too many for one task.
HOT, SALTS = 100_000, 1024
#: Rounds of stars by keys, and the stars that a node is compared with in each.
STAR_ROUNDS, STARS = 2, 4
#: Nodes under a key up to which they are compared pair by pair, and rounds in which larger keys are taken apart.
FEW, ROUNDS = 16_384, 6
#: Keys before its own that a row carries where all pairs under a key are compared.
KEYS_BEFORE = 4
#: 64-bit words of the parity of a whole set, and of the short one that index rows carry, the long one folded.
PARITY_WORDS, SHORT_WORDS = 32, 8
#: Nodes whose rows are looked up by a table sent to the workers; more are joined.
LOOKUP_NODES = 2_000_000
#: Rows of the input for each task, and so each checkpoint file, of a list of pairs.
ROWS_PER_TASK = 50_000
#: Sets that a worker keeps while it compares pairs.
CACHE_SETS = 64
#: Texts that a worker indexes, and pairs that it compares, before it hands their rows on.
TEXTS_AT_ONCE = 500
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Levels:
    """Ranges of set sizes: a set's partners at the threshold percent / 100 lie in its own or a neighbouring one."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.starts = [1]

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def tags(self, size: int) -> list[int]:
        """Levels of the smaller set of the pairs that a set may be in."""
        own = self.of(size)
        return [own, own - 1] if own and (self.starts[own] - 1) * 100 >= self.percent * size else [own]

    def needed(self, size: int) -> int:
        """Shingles that a partner may lack, and one more."""
        return size - -(-size * self.percent // 100) + 1

    def parts(self, tag: int) -> int:
        """Parts of the frequent shingles of sets of a level or the next: sets of ``size`` with one shingle less for each
        part still hold needed(size)."""
        return -(-self.starts[tag] * self.percent // 100) - 1


def single_keys(shingles: np.ndarray) -> np.ndarray:
    return mixed(shingles ^ _STEP)


def pair_keys(frequent: np.ndarray, hot: np.ndarray, needed: int, tag: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs in parts of the shortest prefix of ascending shingles that holds ``needed`` more than it touches
    parts, and whether both shingles are hot."""
    if not parts:  # sets of one shingle
        return single_keys(frequent[:needed]), hot[:needed]
    part = ((frequent >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    covered = np.cumsum(np.concatenate(([0], part[1:] == part[:-1])))
    end = int(np.searchsorted(covered, needed)) + 1
    some, part, hot = frequent[:end], part[:end], hot[:end]
    salt = np.uint64(tag * 2_000_003 + 17)
    keys, hots = [np.zeros(0, np.uint64)], [np.zeros(0, np.bool_)]
    for apart in range(1, some.size):
        both = np.flatnonzero(part[apart:] == part[:-apart])
        if not both.size:
            break
        keys.append(mixed(mixed(some[both] + salt) + mixed(some[both + apart]) * np.uint64(3)))
        hots.append(hot[both] & hot[both + apart])
    return np.concatenate(keys), np.concatenate(hots)


def node_keys(shingles: np.ndarray, frequent_slots: np.ndarray, hot_slots: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a set, and whether each may be too frequent for one task."""
    slot = (shingles & np.uint64(SLOTS - 1)).astype(np.int64)
    is_frequent = frequent_slots[slot]
    needed = levels.needed(shingles.size)
    single = single_keys(shingles[~is_frequent][:needed])
    found = [(single, np.zeros(single.size, np.bool_))]
    if single.size < needed:
        for tag in levels.tags(shingles.size):
            found.append(pair_keys(shingles[is_frequent], hot_slots[slot][is_frequent], needed - single.size, tag, levels.parts(tag)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def whole_parity(shingles: np.ndarray) -> np.ndarray:
    """The parity of a set over PARITY_WORDS * 64 slots: two sets differ in as many shingles at least as in slots."""
    slot = mixed(shingles) & np.uint64(PARITY_WORDS * 64 - 1)
    odd = (np.bincount(slot.astype(np.int64), minlength=PARITY_WORDS * 64) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, row_key, node, n, parity words) of every row of ``docs`` (doc_id, row_key, text), and rows (block, counts) of the slot counts."""
    words = [f"p{i}" for i in range(PARITY_WORDS)]
    names = ["doc_id", "row_key", "node", "n", *words, "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("jaccard",), lambda: None)
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            nodes, sizes, parities = [], [], []
            for text in batch.column(2):
                shingles = shingle_set(text.as_py(), width)
                counts[(shingles & np.uint64(SLOTS - 1)).astype(np.int64)] += 1  # a row counts once in a slot
                nodes.append(set_key(shingles) if shingles.size else None)
                sizes.append(shingles.size)
                parities.append(whole_parity(shingles))
            rows = len(nodes)
            parity = np.array(parities, np.int64).reshape(rows, PARITY_WORDS)
            described = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(w) for w in parity.T]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *described, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if counts.any():
            none = [pa.nulls(BLOCKS, pa.int64())] * (4 + PARITY_WORDS)
            packed = [zlib.compress(b.astype("<u4").tobytes(), 1) for b in counts.reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(BLOCKS), pa.int32()), pa.array(packed, pa.binary())], names=names)

    return docs.mapInArrow(run, f"doc_id long, row_key long, node long, n long, {', '.join(w + ' long' for w in words)}, block int, counts binary")


def classes(described: DataFrame, shingles: int) -> tuple[np.ndarray, np.ndarray]:
    """Which slots are frequent and which are hot: two bitmaps of fixed size, from counts over all ``shingles``.

    The bound follows the load of the table, so that classes mean the same at every size of the corpus.
    """
    mean = shingles / SLOTS
    bound = RARE + mean + DEVIATIONS * mean**0.5
    hot = bound + HOT

    def summed(batches: Iterator[pa.RecordBatch], column: int, kind: str) -> np.ndarray:
        total = np.zeros(SLOTS // BLOCKS, np.int64)
        for batch in batches:
            for counts in batch.column(column):
                total += np.frombuffer(zlib.decompress(counts.as_py()), kind)
        return total

    def add_some(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zlib.compress(summed(batches, 2, "<u4").astype("<i8").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], names=["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = summed(batches, 1, "<i8")
        bits = [pa.array([np.packbits(total >= least).tobytes()], pa.binary()) for least in (bound, hot)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *bits], names=["block", "frequent", "hot"])

    found = np.zeros((2, BLOCKS, SLOTS // BLOCKS), np.bool_)
    # first the tables of some tasks, then these sums: of n tasks, no task adds up more than about the root of n
    part = F.pmod(F.xxhash64("counts"), F.lit(max(1, round(described.rdd.getNumPartitions() ** 0.5))))
    blocks = described.filter("block IS NOT NULL").select("block", part.alias("part"), "counts")
    blocks = blocks.groupBy("block", "part").applyInArrow(add_some, "block int, counts binary")
    for r in blocks.groupBy("block").applyInArrow(add, "block int, frequent binary, hot binary").collect():  # BLOCKS rows, a megabyte
        for i, name in enumerate(("frequent", "hot")):
            found[i, r["block"]] = np.unpackbits(np.frombuffer(bytes(r[name]), np.uint8))
    return found[0].ravel(), found[1].ravel()


def index(docs: DataFrame, slots, width: int, percent: int) -> DataFrame:
    """Index rows (key, node, n, hot); a worker indexes equal sets once. ``slots``: a broadcast pair of packed bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("jaccard",), lambda: None)
        frequent, hot = (np.unpackbits(b).astype(np.bool_) for b in slots.value)
        levels, done = Levels(percent), set()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                found = []
                for text in batch.column(0)[at : at + TEXTS_AT_ONCE]:
                    shingles = shingle_set(text.as_py(), width)
                    if not shingles.size or (node := set_key(shingles)) in done:
                        continue
                    done.add(node)
                    keys, hots = node_keys(shingles, frequent, hot, levels)
                    found.append((keys, np.full(keys.size, node), np.full(keys.size, shingles.size, np.int32), hots))
                if found:
                    keys, node, n, hots = (np.concatenate(p) for p in zip(*found))
                    yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(node, pa.int64()), pa.array(n), pa.array(hots)], names=["key", "node", "n", "hot"])

    return docs.select("text").mapInArrow(run, "key long, node long, n int, hot boolean")


def _sizes_match(a: str, b: str, percent: int) -> Column:
    size_a, size_b = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    return (size_a * 100 >= size_b * percent) & (size_b * 100 >= size_a * percent)


def _close_as_wholes(a: str, b: str, percent: int, words: list[str]) -> Column:
    """What the parities of two whole sets that are similar fulfil."""
    apart = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in words), F.lit(0))
    return apart * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def differences(x: np.ndarray, center: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[bool, list[tuple[np.ndarray, int]]]:
    """Whether ``x`` is linked to ``center``, and prefixes of their symmetric difference with the sides that they are for.

    The order is that of all sets measured against the center: rare shingles that it lacks, frequent ones that it lacks,
    its own. Side 0 meets side 0: both far from the center; side 1, linked to it, meets side 2, far from it.
    """
    more, less = 100 + percent, 100 - percent
    new, lost = np.setdiff1d(x, center, assume_unique=True), np.setdiff1d(center, x, assume_unique=True)
    d, edge = new.size + lost.size, less * center.size
    w = more * d - less * x.size
    # a partner's differences hold what both share, so its w has this at least
    partner = w - 2 * less * (x.size * 100 // percent)
    far = w > edge
    ranges = [(0, edge + 1, None), (2, -edge, edge)] if far else [(1, edge + 1, None)]
    is_frequent = frequent[(new & np.uint64(SLOTS - 1)).astype(np.int64)]
    order, out = np.concatenate((new[~is_frequent], new[is_frequent], lost)), []
    for side, least, most in ranges:
        least = max(least, partner)
        if most is not None and least > most:
            continue
        shared = max(1, -(-(w + least) // (2 * more)))
        if shared <= d:
            out.append((order[: d - shared + 1], side))
    return not far, out


def compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, slots, width: int, percent: int, tasks: int) -> DataFrame:
    """Of ``pairs`` (a, b, measure) the similar ones as (a, b), counted on the whole text of one row of each node; where
    ``measure`` holds, index rows (key, node, n, side) of the differences of a from b too."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = checkpointed(nodes.groupBy("node").agg(F.min("row_key").alias("own_key")).join(needed, "node").coalesce(tasks))
    few = F.broadcast(rows) if rows.count() <= LOOKUP_NODES else rows
    texts = docs.join(few, docs["row_key"] == rows["own_key"]).groupBy("node").agg(F.first("text").alias("text"))
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    names = ["a", "b", "key", "node", "n", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(("jaccard",), lambda: None)
        sets: dict[int, np.ndarray] = {}
        frequent = np.unpackbits(slots.value[0]).astype(np.bool_)

        def shingles(node: int, text: pa.StringScalar) -> np.ndarray:
            if node not in sets:
                if len(sets) >= CACHE_SETS:
                    sets.pop(next(iter(sets)))
                sets[node] = shingle_set(text.as_py(), width)
            return sets[node]

        def handed_on(links: list, found: list) -> Iterator[pa.RecordBatch]:
            if links:
                a, b = (pa.array(v, pa.int64()) for v in zip(*links))
                yield pa.RecordBatch.from_arrays([a, b, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32())], names=names)
            if found:
                keys, node, n, side = (np.concatenate(p) for p in zip(*found))
                none = pa.nulls(keys.size, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, _signed(keys), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(side, pa.int32())], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                links, found = [], []
                some = batch.slice(at, TEXTS_AT_ONCE)
                for a, b, measure, text_a, text_b in zip(*(some.column(i).to_pylist() for i in range(3)), some.column(3), some.column(4)):
                    x, y = shingles(a, text_a), shingles(b, text_b)
                    if measure:
                        similar, prefixes = differences(x, y, frequent, percent)
                        for tokens, side in prefixes:
                            salt = mixed(np.array([b], np.int64).view(np.uint64) + np.uint64(min(side, 1)))
                            found.append((mixed(tokens * np.uint64(3) + salt), np.full(tokens.size, a), np.full(tokens.size, x.size), np.full(tokens.size, side)))
                    else:
                        both = np.intersect1d(x, y, assume_unique=True).size
                        similar = 100 * both >= percent * (x.size + y.size - both)
                    if similar:
                        links.append((min(a, b), max(a, b)))
                yield from handed_on(links, found)
        sets.clear()
        give_back()

    return two.select("a", "b", "measure", "text_a", "text_b").mapInArrow(run, "a long, b long, key long, node long, n int, side int")


class Join:
    """The state of a join: links found so far and the pairs that were compared."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, slots, width: int, percent: int, tasks: int) -> None:
        self.docs, self.nodes, self.slots, self.width, self.percent, self.tasks = docs, nodes, slots, width, percent, tasks
        self.long, self.short = [f"p{i}" for i in range(PARITY_WORDS)], [f"q{i}" for i in range(SHORT_WORDS)]
        self.parities = checkpointed(nodes.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", *self.long)]))
        self.links = self.tested = self.roots = None

    def compare(self, pairs: DataFrame) -> Stored:
        """Compares ``pairs`` (a, b, measure), each once, and gives the index rows of the differences asked for."""
        pairs = pairs.groupBy("a", "b").agg(F.max("measure").alias("measure"))
        if self.tested is not None:
            known = self.tested.withColumn("tested", F.lit(True))
            pairs = pairs.join(known, ["a", "b"], "left").filter("measure OR tested IS NULL").drop("tested")
        pairs = checkpointed(pairs.coalesce(self.tasks))
        with settings(self.docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=TEXTS_AT_ONCE):  # two whole texts a row
            found = Stored(compared(pairs, self.docs, self.nodes, self.slots, self.width, self.percent, self.tasks))
        links, tested = checkpointed(found.rows.filter("a IS NOT NULL").select("a", "b").coalesce(self.tasks)), pairs.filter("NOT measure").select("a", "b")
        self.links = links if self.links is None else self.links.unionByName(links)
        self.tested = tested if self.tested is None else self.tested.unionByName(tested)
        self.roots = components(self.links)
        return found

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the root of their node's component."""
        if self.roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(self.roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))

    def open_rows(self, rows: DataFrame) -> DataFrame:
        """Rows of keys under which different components, on sides that meet, are left, and how many rows (``under``) each key has."""
        rows = self.placed(rows)
        ends = [f(c).alias(f"{name}_{c}") for c in ("root", "side") for name, f in (("least", F.min), ("most", F.max))]
        left = rows.groupBy("key").agg(F.count(F.lit(1)).alias("under"), *ends)
        left = left.filter("least_root <> most_root AND (least_side = 0 OR least_side <> most_side)").select("key", "under")
        return rows.join(left, "key")

    def close(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b, ...) whose parities allow a link."""
        pairs = checkpointed(pairs.coalesce(self.tasks))
        needed = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().coalesce(self.tasks))
        own = self.parities.join(F.broadcast(needed) if needed.count() <= LOOKUP_NODES else needed, "node").select("node", F.struct("n", *self.long).alias("whole"))
        one = pairs.join(own.select(F.col("node").alias("a"), F.col("whole").alias("whole_a")), "a")
        two = one.join(own.select(F.col("node").alias("b"), F.col("whole").alias("whole_b")), "b")
        return two.filter(_close_as_wholes("whole_a", "whole_b", self.percent, self.long)).select(pairs.columns)

    def stars(self, keyed: DataFrame, star: int) -> None:
        """Everyone against one node under each key; of a node's stars those it shares most keys with."""
        rows = self.open_rows(keyed) if self.roots is not None else self.placed(keyed)
        center = rows.groupBy("key").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", "key", F.lit(star))).alias("c"))
        met = rows.alias("x").join(center.select("key", "c.*").alias("y"), "key").filter((F.col("x.root") != F.col("y.root")) & _sizes_match("x", "y", self.percent))
        met = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("keys"))
        best = self.close(met).withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("keys"), "b"))).filter(F.col("nth") <= STARS)
        self.compare(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(False).alias("measure"))).drop()

    def pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of open rows of one key whose components differ and whose sizes and parities allow a link.

        A row carries the last few keys of its node before its own. Two rows that have one of these in common have met
        under it, so a pair appears about once however many keys it shares.
        """
        before = Window.partitionBy("node", "side").orderBy("key").rowsBetween(-KEYS_BEFORE, -1)
        folded = [reduce(Column.bitwiseXOR, [F.col(f"p{j}") for j in range(i, PARITY_WORDS, SHORT_WORDS)]).alias(f"q{i}") for i in range(SHORT_WORDS)]
        known = rows.withColumn("before", F.collect_list("key").over(before)).join(self.parities.select("node", *folded), "node")
        x, y = known.alias("x"), known.alias("y")
        sides = (F.col("x.side") + F.col("y.side")).isin(0, 3)
        apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & sides
        allowed = apart & _sizes_match("x", "y", self.percent) & _close_as_wholes("x", "y", self.percent, self.short)
        both = x.join(y, allowed & ~F.arrays_overlap("x.before", "y.before"))
        met = both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        return self.close(met).withColumn("measure", F.lit(False))

    def measured(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of every node and the centers under its keys: the node with most rows of all.

        Keys are split by size first, so that a center is not much larger or smaller than what it serves.
        """
        level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0001 / self.percent)))
        split = rows.select(F.explode(F.array(level, level - 1)).alias("level"), "key", "node", "n")
        split = split.select(F.xxhash64("key", "level").alias("key"), "node")
        weights = split.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
        center = split.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", F.xxhash64("node"))).alias("b"))
        met = split.join(center, "key").filter("node <> b")
        return met.select(F.col("node").alias("a"), "b", F.lit(True).alias("measure"))

    def run(self, keyed: DataFrame) -> None:
        for star in range(STAR_ROUNDS):
            self.stars(keyed, star)
        rows, found = keyed, None
        for nth in range(ROUNDS):
            rows = checkpointed(self.open_rows(rows))
            if found is not None:
                found.drop()
            most = rows.agg(F.max("under")).first()[0]
            if most is None:
                return
            if most <= FEW or nth == ROUNDS - 1:
                self.compare(self.pairs(rows)).drop()
                return
            found = self.compare(self.pairs(rows.filter(F.col("under") <= FEW)).unionByName(self.measured(rows.filter(F.col("under") > FEW))))
            rows = found.rows.filter("key IS NOT NULL").select("key", "node", "n", "side")


def one_of_each(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (key, node, n), each once, under one of all keys that have the same nodes, of which there are
    two at least. Sets of nodes are told apart by their size and 128 bits of the sums of their hashes."""
    bits = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"bits{i}") for i in range(2)]
    rows = rows.distinct()
    sets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("under"), *bits).filter("under > 1")
    return rows.join(sets.groupBy("under", "bits0", "bits1").agg(F.min("key").alias("key")).select("key"), "key")


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row's id and whole text."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))


def linked_rows(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, n (set size) and root, what all rows of a component share and null for an empty set, of every row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    described = checkpointed(describe(docs, shingle))
    rows = described.filter("block IS NULL").drop("block", "counts")
    nodes = rows.filter("node IS NOT NULL")
    n_rows, shingles = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    # short lists, of pairs and of the nodes in them, take as few tasks as the rows they come from allow
    tasks = max(2, -(-n_rows // ROWS_PER_TASK))
    slots = docs.sparkSession.sparkContext.broadcast([np.packbits(b) for b in classes(described, shingles or 0)])
    # keys of one node go; those that may be hot are dealt over tasks by node and stay
    under_key = Window.partitionBy("key", F.when(F.col("hot"), F.pmod("node", F.lit(SALTS))))
    keyed = index(docs, slots, shingle, percent)
    keyed = keyed.withColumn("least", F.min("node").over(under_key)).withColumn("most", F.max("node").over(under_key))
    keyed = checkpointed(keyed.filter("hot OR least <> most").select("key", "node", "n"))
    keyed = checkpointed(one_of_each(keyed).withColumn("side", F.lit(0)))
    join = Join(docs, nodes, slots, shingle, percent, tasks)
    join.run(keyed)
    return join.placed(rows).select("doc_id", "row_key", "n", "root")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles (set size) and component_id of every row of ``docs``.

    Rows are linked when their sets of ``shingle``-word shingles have a Jaccard similarity of ``percent`` hundredths or
    more; component_id is the least id that links reach. A text with fewer words is one shingle; texts of any
    length are compared whole. A row without words,
    null text included, has an empty set, links with nothing and is its own component. Repeated rows and ties share
    their component; a null id is kept, and is a component's id only if the component has no other. An empty table
    gives an empty result; other columns are not read.
    """
    labelled = linked_rows(docs, shingle, percent, id_col, text_col)
    least_ids = labelled.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = labelled.join(least_ids, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
