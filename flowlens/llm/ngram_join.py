"""N-gram Jaccard join over count vectors.

A text's set is its distinct word shingles, as 64-bit hashes. Equal sets are one point from the start. Hashing the
shingles into groups gives each set a point of group counts; the summed coordinate minima of two
points bound their overlap from above. The more shingles share a group, the weaker the bound, so larger sets have more groups, always
a power of two: a finer point folds into a coarser one by adding up, and a tree takes all its points as fine as its coarsest. Points lie in packed R-trees whose boxes hold the largest count of each
group, so a pair of boxes whose bound is below the least overlap that the similarity asks for is left
out whole, then pairs of points, and what survives is verified on the sets.

No tree could hold all points, so they are dealt out first, without loss. Sets that link differ in at most d
shingles, d following from their sizes. Their shingles are hashed into more than d blocks, so one block at least
is equal in both, whatever the texts share besides: all sets with an equal block meet in one tree. The emptiest
blocks say little and are left out where enough others remain to keep the promise. Trees give spanning edges of the pairs
within the bound; their components are the clusters, and each cluster gets one tree of points with
sets, where pairs not yet connected are verified. A bucket over ``NODE`` points and a cluster over ``CLUSTER_SETS``
sets or ``CLUSTER_SHINGLES`` shingles is cut into nodes, and every pair of nodes is a tree of its own, so no task holds more than two nodes.

Contract. A text with fewer words than a shingle is one shingle; a text without words (or null) has an empty set, links
with nothing and is its own component. Repeated rows and equal texts share a component. A component's id is its smallest
id. An empty table gives an empty table. Hashes of 64 bits stand for shingles and for sets, so among 10^9 distinct sets two
would be taken for one with a probability of 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.components import components
from flowlens.llm.tables import merged, written

# Least and most groups of a point.
GROUPS = 64
FINEST = 4096
NODE = 1024
LEAF = 32
SMALL = 12
CLASS_RATIO = 1.5
SLICE = 1 << 20
# Texts whose block keys are handed on together.
KEYED_TOGETHER = 256
# A node of a cluster holds about so many sets and so many shingles at most; a cluster of several nodes sends each set to
# every pair of nodes it takes part in, so nodes are as large as two of them fit a task.
CLUSTER_SETS = 16_384
CLUSTER_SHINGLES = 4_000_000

WORD = r"[^\x20\x09-\x0D]"

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((salt * int(ODD)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of a byte string, by sums of mixed bytes times powers of an odd number."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)
        byte = np.arange(256, dtype=np.uint8)
        lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        self.value = mixed(lower.astype(np.uint64) + np.uint64(1), 7)
        self.gap = np.isin(byte, [0x20, 9, 10, 11, 12, 13])

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each word; ASCII capitals count as small letters."""
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        if len(self.power) <= n:
            size = max(n + 1, 2 * SLICE)
            self.power, self.inverse = (np.full(size, base, np.uint64) for base in (ODD, pow(int(ODD), -1, 1 << 64)))
            for steps in (self.power, self.inverse):
                steps[0] = 1
                np.cumprod(steps, out=steps)
        solid = np.zeros(n + 2, np.int8)
        solid[1:-1] = ~self.gap[raw]
        edge = np.diff(solid)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[raw] * self.power[:n], out=total[1:])
        return mixed((total[end] - total[start]) * self.inverse[start], 1), start


HASHER = WordHasher()


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Short texts are hashed many at a time."""
    data = [(t or "").encode() for t in texts]
    at = 0
    while at < len(data):
        stop, total = at, 0
        while stop < len(data) and (stop == at or total + len(data[stop]) < SLICE):
            total += len(data[stop]) + 1
            stop += 1
        length = np.fromiter((len(d) + 1 for d in data[at:stop]), np.int64, stop - at)
        words, start = HASHER.words(b"\n".join(data[at:stop]))
        bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(length))))
        rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for i in range(size):
            rolled += mixed(words[i:len(words) - size + 1 + i], 11 + i) if len(rolled) else rolled
        rolled = mixed(rolled, 5)
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            if last - first >= size:
                yield np.unique(rolled[first:last - size + 1])
            elif last > first:
                whole = np.array([last - first], np.uint64)
                for i in range(first, last):
                    whole += mixed(words[i:i + 1], 11 + int(i - first))
                yield mixed(whole, 6)
            else:
                yield np.zeros(0, np.uint64)
        at = stop


def set_key(shingles: np.ndarray) -> int:
    """64 bits for a whole set."""
    return int(mixed(shingles, 21).sum(dtype=np.uint64)) - 2**63 if len(shingles) else 0


class Similarity:
    """The law 'percent * union <= 100 * intersection' and what follows from it."""

    def __init__(self, percent: int):
        self.percent = percent
        top, bounds = 1, []
        while top < 1 << 40:
            bounds.append(top)
            top = max(top + 1, int(top * CLASS_RATIO))
        self.tops = np.array(bounds)

    def groups(self, n: int) -> int:
        """Groups of the point of a set of n shingles: as many as tell unrelated sets, and most that share half their shingles, from linked ones.

        With c shingles a group, the minima of two unrelated points come to about 1 - 1 / sqrt(pi * c) of them; linked sets need
        the share 1 - (100 - percent) / (100 + percent).
        """
        crowd = max(1, (100 + self.percent) ** 2 // (20 * max(1, 100 - self.percent) ** 2))
        found = GROUPS
        while found < FINEST and n > crowd * found:
            found *= 2
        return found

    def overlap(self, sizes):
        """Least intersection of two sets with these sizes in sum."""
        return -(-self.percent * sizes // (100 + self.percent))

    def differ(self, sizes: int) -> int:
        """Most shingles that only one of two linked sets has, for any sum of sizes up to this one."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def classes(self, n: int) -> list[int]:
        """Size classes in which a set of n shingles meets its partners: its own, and all up to that of its largest partner."""
        own, last = np.searchsorted(self.tops, (n, n * 100 // self.percent)).tolist()
        return list(range(own, last + 1))

    def blocks(self, kind: int) -> tuple[int, int]:
        """(blocks, emptiest blocks that may be left out) of a size class.

        Linked sets have one block more in common than may be left out. Take the set that leaves out blocks up to the larger filling: it
        keeps an equal block, which is fuller than that, so the other set keeps it as well.
        """
        most = self.differ(2 * int(self.tops[kind]))
        spare = 1 + (most + 1) // 4
        return most + 1 + spare, spare


def block_keys(shingles: np.ndarray, law: Similarity) -> np.ndarray:
    """One hash per block, size class and set. Only sets that can differ from a partner need them."""
    n, out = len(shingles), []
    if n == 0 or law.differ(n + n * 100 // law.percent) == 0:
        return np.zeros(0, np.int64)
    for kind in law.classes(n):
        count, spare = law.blocks(kind)
        block = ((mixed(shingles, 31 + kind) >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        filled = np.bincount(block, minlength=count)
        total = np.zeros(count, np.uint64)
        np.add.at(total, block, mixed(shingles, 41))
        key = mixed(total + mixed(np.arange(count, dtype=np.uint64) + np.uint64(kind << 32), 43), 44).view(np.int64)
        # the emptiest blocks go, all of one filling together, as long as no more than the spare ones go
        gone = np.cumsum(np.bincount(filled))
        out.append(key[filled >= np.searchsorted(gone, spare, side="right")])
    return np.concatenate(out)


def point(shingles: np.ndarray, groups: int) -> np.ndarray:
    """Counts of the shingles by hashed group."""
    return np.bincount((mixed(shingles, 51) >> np.uint64(40)).astype(np.int64) % groups, minlength=groups)


def packed(counts: np.ndarray) -> bytes:
    """A point as bytes: how many a count takes, one where all counts are below 256, else four; then the counts."""
    width = 1 if counts.max(initial=0) < 256 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpacked(points: list[bytes]) -> np.ndarray:
    """Points as rows, all folded to the groups of the coarsest."""
    rows = [np.frombuffer(p, f"<u{p[0]}", offset=1) for p in points]
    groups = min(map(len, rows))
    return np.stack([r.astype(np.int32) if len(r) == groups else r.reshape(-1, groups).sum(axis=0, dtype=np.int32) for r in rows])


def fingerprints(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set_a, point) of every row; a task gives the point of equal sets once."""
    law = Similarity(percent)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, a, points = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), size):
                own = set_key(s)
                n.append(len(s))
                a.append(own)
                points.append(None if own in seen else packed(point(s, law.groups(len(s)))))
                seen.add(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(points, pa.binary())], ["id", "n", "set_a", "point"])

    return source.mapInArrow(run, f"id {kind}, n long, set_a long, point binary")


def keyed_sets(docs: DataFrame, size: int, percent: int, text_col: str) -> DataFrame:
    """(key, set_a): the block keys of every set; a task gives those of equal sets once.

    Keys are nearly as large as the texts, so they are made anew from them and go into their one shuffle, never into a table.
    """
    law = Similarity(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, KEYED_TOGETHER):
                keys, sets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for s in shingle_sets(batch.column("text").slice(at, KEYED_TOGETHER).to_pylist(), size):
                    own = set_key(s)
                    if own not in seen:
                        seen.add(own)
                        keys.append(block_keys(s, law))
                        sets.append(np.full(len(keys[-1]), own, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sets))], ["key", "set_a"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key long, set_a long")


def shared_keys(rows: DataFrame) -> DataFrame:
    """From (key, set_a): keys of two or more sets, as pairs of sets where they are few, else one row per set.

    Columns: a, b (the pair), or key, node, a. Rows come sorted, so a task holds one batch and one short run.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "a", "b"]
        key_now, held, long_run = None, [], 0

        def pairs(members: list[int]) -> tuple[list[int], list[int]]:
            return [x for i, x in enumerate(members) for _ in members[i + 1:]], [y for i in range(len(members)) for y in members[i + 1:]]

        for batch in batches:
            keys, sets = batch.column("key").to_numpy(), batch.column("set_a").to_numpy()
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
            keys, sets = keys[fresh], sets[fresh]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            ends = np.append(starts[1:], len(keys))
            # runs of one set in the middle of a batch need no look
            wide = (ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)
            out_a, out_b, big_key, big_node, big_a = [], [], [], [], []

            def close() -> None:
                if 2 <= len(held) <= SMALL and not long_run:
                    left, right = pairs(held)
                    out_a.extend(left)
                    out_b.extend(right)

            for first, last in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
                if keys[first] != key_now:
                    close()
                    key_now, held, long_run = keys[first], [], 0
                members = sets[first:last].tolist()
                if held and members[0] == held[-1]:
                    members = members[1:]
                if long_run or len(held) + len(members) > SMALL:
                    members = members if long_run else held + members
                    big_key += [int(key_now)] * len(members)
                    big_node += [(long_run + i) // NODE for i in range(len(members))]
                    big_a += members
                    long_run += len(members)
                    held = members[-1:] or held[-1:]
                else:
                    held = held + members
            if len(starts) and keys[-1] != key_now:
                close()
                key_now, held, long_run = keys[-1], [int(sets[-1])], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([None] * len(out_a) + big_key, pa.int64()), pa.array([0] * len(out_a) + big_node, pa.int64()),
                 pa.array(out_a + big_a, pa.int64()), pa.array(out_b + [None] * len(big_a), pa.int64())], names)
        if key_now is not None and 2 <= len(held) <= SMALL and not long_run:
            left, right = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(left), pa.int64()), pa.array([0] * len(left), pa.int64()),
                                              pa.array(left, pa.int64()), pa.array(right, pa.int64())], names)

    return rows.repartition("key").sortWithinPartitions("key", "set_a").mapInArrow(run, "key long, node long, a long, b long")


class CountTree:
    """A packed R-tree of count points: leaves of points near in size and in their first coordinates, each with its box."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        band = (np.log(np.maximum(sizes, 1)) / np.log(1.05)).astype(np.int64)
        self.order = np.lexsort((points[:, 1], points[:, 0], band))
        self.sizes, self.points = sizes[self.order], points[self.order]
        self.starts = np.arange(0, len(sizes), LEAF)
        self.high = np.maximum.reduceat(self.points, self.starts, axis=0)
        self.least = np.minimum.reduceat(self.sizes, self.starts)
        self.most = np.maximum.reduceat(self.sizes, self.starts)

    def leaf_pairs(self, law: Similarity) -> Iterator[tuple[int, int]]:
        """Pairs of leaves whose boxes allow a link."""
        for i in range(len(self.starts)):
            bound = np.minimum(self.high[i], self.high[i:]).sum(axis=1)
            near = (bound >= law.overlap(self.least[i] + self.least[i:])) & (100 * self.most[i] >= law.percent * self.least[i:]) \
                & (100 * self.most[i:] >= law.percent * self.least[i])
            for j in np.flatnonzero(near):
                yield i, i + int(j)

    def candidate_pairs(self, law: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points, by pair of leaves, whose summed minima reach the least overlap."""
        for i, j in self.leaf_pairs(law):
            a, b = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
            bound = np.minimum(self.points[a, None], self.points[None, b]).sum(axis=2)
            x, y = np.nonzero(bound >= law.overlap(self.sizes[a, None] + self.sizes[None, b]))
            x, y = x + i * LEAF, y + j * LEAF
            keep = x < y
            yield self.order[x[keep]], self.order[y[keep]]


def tree_edges(sizes: np.ndarray, points: np.ndarray, law: Similarity, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the links among the points: verified on the sets, or within the bound where none are given."""
    out: list[tuple[int, int]] = []
    if len(sizes) < 2:
        return out
    if len(sizes) == 2 and sets is None:
        reach = np.minimum(points[0], points[1]).sum() >= law.overlap(sizes[0] + sizes[1])
        return [(0, 1)] if reach else out
    group = np.arange(len(sizes))  # points connected already share a number
    for xs, ys in CountTree(sizes, points).candidate_pairs(law):
        apart = group[xs] != group[ys]
        for x, y in zip(xs[apart].tolist(), ys[apart].tolist(), strict=True):
            if group[x] == group[y]:
                continue
            if sets is not None:
                both = np.concatenate((sets[x], sets[y]))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common < law.percent * (len(both) - common):
                    continue
            group[group == group[y]] = group[x]
            out.append((x, y))
    return out


def in_trees(rows: DataFrame, percent: int, with_sets: bool) -> DataFrame:
    """(a, b) edges from rows (tree, left, right, set_a, n, point[, shingles]), one tree at a time within sorted partitions."""
    law = Similarity(percent)
    columns = ["tree", "set_a", "n", "point", *(["shingles"] if with_sets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            a, b = [], []
            if len(held) > 1:
                ids = [r[1] for r in held]
                points = unpacked([r[3] for r in held])
                sets = [np.frombuffer(r[4], "<u8") for r in held] if with_sets else None
                for x, y in tree_edges(np.array([r[2] for r in held]), points, law, sets):
                    a.append(min(ids[x], ids[y]))
                    b.append(max(ids[x], ids[y]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(batch.column("where").to_pylist(), *(batch.column(c).to_pylist() for c in columns[1:]), strict=True):
                if row[0] != now:
                    if len(held) > 1:
                        yield close()
                    now, held = row[0], []
                held.append(row)
        if len(held) > 1:
            yield close()

    keyed = rows.repartition("tree", "left", "right").sortWithinPartitions("tree", "left", "right", "n", "set_a")
    where = F.concat_ws(":", F.col("tree").cast("string"), F.col("left").cast("string"), F.col("right").cast("string"))
    return keyed.select(where.alias("where"), *columns[1:]).mapInArrow(run, "a long, b long")


def node_pairs(rows: DataFrame) -> DataFrame:
    """Rows (tree, node, ...) copied to every pair of nodes of their tree they take part in.

    Only trees of several nodes are looked up, at most one for every ``NODE`` rows; the table is written, so that the join
    may split a tree that holds many rows.
    """
    nodes = written(rows.groupBy("tree").agg(F.max("node").alias("last")).where("last > 0"), "ngram-nodes")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(0).cast("long"))))
    return rows.join(nodes, "tree", "left").withColumn("other", other).withColumn("left", F.least("node", "other")) \
        .withColumn("right", F.greatest("node", "other")).drop("other", "last", "node")


def bounded_edges(prints: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """Spanning edges (a, b) of the pairs of sets that meet in a block and pass the bound of the summed minima."""
    sets = prints.where("point is not null and n > 0").select("set_a", "n", "point").dropDuplicates(["set_a"])
    found = written(shared_keys(keyed), "ngram-keys")
    pairs = found.where("key is null").select("a", "b").distinct()
    few = pairs.withColumn("tree", F.xxhash64("a", "b")).select("tree", F.explode(F.array("a", "b")).alias("set_a"), F.lit(0).cast("long").alias("node"))
    many = found.where("key is not null").select(F.col("key").alias("tree"), F.col("a").alias("set_a"), "node")
    rows = few.withColumn("left", F.col("node")).withColumn("right", F.col("node")).drop("node").unionByName(node_pairs(many))
    return in_trees(rows.join(merged(sets), "set_a"), percent, with_sets=False)


def with_sets(docs: DataFrame, members: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``members`` (tree, node, set_a, id) with size, point and shingles, from the text of each set's first document."""
    law = Similarity(percent)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = source.join(merged(members), source["id"].eqNullSafe(members["id"])).select("tree", "node", "set_a", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("set_a").to_pylist()
            n, points, sets, same = [], [], [], []
            for wanted, s in zip(own, shingle_sets(batch.column("text").to_pylist(), size), strict=True):
                n.append(len(s))
                points.append(packed(point(s, law.groups(len(s)))))
                sets.append(s.astype("<u8").tobytes())
                same.append(set_key(s) == wanted)  # another text under the same id is not this set
            out = pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("node"), batch.column("set_a"), pa.array(n, pa.int64()),
                                              pa.array(points, pa.binary()), pa.array(sets, pa.binary())],
                                             ["tree", "node", "set_a", "n", "point", "shingles"])
            yield out.filter(pa.array(same, pa.bool_()))

    return rows.mapInArrow(run, "tree long, node long, set_a long, n long, point binary, shingles binary")


def ngram_components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``."""
    prints = written(fingerprints(docs, size, percent, id_col, text_col), "ngram-prints")
    keyed = keyed_sets(docs, size, percent, text_col)
    first = written(prints.where("n > 0").groupBy("set_a").agg(F.min("id").alias("id"), F.max("n").alias("n")), "ngram-first")
    clusters = components(bounded_edges(prints, keyed, percent)).withColumnRenamed("node", "set_a")
    sized = written(clusters.join(merged(first), "set_a"), "ngram-clusters")
    load = F.greatest(F.sum("n") / CLUSTER_SHINGLES, F.count("*") / CLUSTER_SETS)
    nodes = sized.groupBy("component").agg(F.ceil(load).alias("nodes"))
    members = written(sized.join(merged(nodes), "component").select(
        F.col("component").alias("tree"), F.pmod(F.xxhash64("set_a"), F.col("nodes")).alias("node"), "set_a", "id"), "ngram-members")
    verified = in_trees(node_pairs(written(with_sets(docs, members, size, percent, id_col, text_col), "ngram-sets")), percent, with_sets=True)
    linked = components(verified).select(F.col("node").alias("set_a"), "component")
    smallest = first.join(merged(linked), "set_a").groupBy("component").agg(F.min("id").alias("least"))
    by_set = first.join(merged(linked), "set_a", "left").join(merged(smallest), "component", "left").select("set_a", F.coalesce("least", "id").alias("component_id"))
    return prints.select("id", "n", "set_a").join(merged(by_set), "set_a", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component: of the smallest id, and of its texts the one of smallest hash. Rows without words all stay."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # an id may stand for several texts, so a row goes by id and text
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), F.octet_length(text), text).alias("b"))
    worded = text.rlike(WORD)
    rows = docs.where(worded).select(F.struct("*").alias("row"), key.alias("key"))
    classes = ngram_components(docs.where(worded).select(key.alias("key"), text.alias("text")), size, percent, "key", "text")
    first = classes.where(F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key").alias("kept")).distinct()
    kept = rows.join(first, F.col("key").eqNullSafe(F.col("kept")), "left_semi").dropDuplicates(["key"]).select("row.*")
    return docs.where(~worded).unionByName(kept)
