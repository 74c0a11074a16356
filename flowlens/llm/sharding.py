"""Sharding by Karmarkar-Karp differencing, for groups that must stay whole.

Rows of one group (equal texts) are an item of the group's total size. An item starts as a partial
partition (size, 0, ..., 0); the two partials of largest spread are combined again and again, one in
descending and one in ascending order, until one is left. That is done first within chunks of a few
thousand items, then among the partials of up to ``FAN`` chunks, and so on upwards, so no task and no
driver ever holds more than a chunk. The way down gives each item its shard.

Contract. A null text has no bytes and forms a group of its own, apart from the empty text. Repeated
rows are one group. An empty table gives an empty table. Ties go by the group's hash, so the result
does not depend on how rows are dealt out. A group larger than a shard's fair share stays whole, and
the other shards share the rest. Slots number a shard's rows by bucket and then by id, without gaps.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.tables import written

CHUNK = 4096
FAN = 256
SLOT_ROWS = 20_000
ROW_BYTES = 16


def difference(vectors: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over partial partitions (rows): the final place of each row's each place."""
    m, k = vectors.shape
    sums = list(vectors)
    children: list[tuple[int, np.ndarray, int, np.ndarray] | None] = [None] * m
    heap = [(-int(v.max() - v.min()), i) for i, v in enumerate(vectors)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        down, up = np.argsort(-sums[a], kind="stable"), np.argsort(sums[b], kind="stable")
        total = sums[a][down] + sums[b][up]
        heapq.heappush(heap, (-int(total.max() - total.min()), len(sums)))
        sums.append(total)
        children.append((a, down, b, up))
    place: list[np.ndarray | None] = [None] * len(sums)
    place[-1] = np.arange(k)
    for node in range(len(sums) - 1, m - 1, -1):
        a, down, b, up = children[node]
        for child, order in ((a, down), (b, up)):
            own = np.empty(k, np.int64)
            own[order] = place[node]
            place[child] = own
    return np.stack(place[:m])


def item_places(shards: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "key_a", "key_b"], ascending=False, ignore_index=True)
        vectors = np.zeros((len(group), shards), np.int64)
        vectors[:, 0] = group["bytes"]
        return group.assign(place=difference(vectors)[:, 0].astype("int32"))
    return run


def node_places(shards: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        places = difference(np.stack(group["sums"].to_numpy()))
        return pd.DataFrame({
            "node": np.repeat(group["node"].to_numpy(), shards), "place": np.tile(np.arange(shards, dtype="int32"), len(group)),
            "above": np.repeat(group["above"].to_numpy(), shards), "place_above": places.ravel().astype("int32"),
            "bytes": np.concatenate(group["sums"].to_numpy())})
    return run


def group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """``groups`` (key_a, key_b, bytes), with the shard of each group."""
    nodes = max(1, math.ceil(groups.count() / CHUNK))
    items = groups.withColumn("node", F.pmod(F.col("key_a"), F.lit(nodes)))
    placed = written(items.groupBy("node").applyInPandas(
        item_places(shards), "key_a long, key_b long, bytes long, node long, place int"), "shard-items")
    levels, sums = [], placed.groupBy("node", "place").agg(F.sum("bytes").alias("bytes"))
    while True:
        nodes = math.ceil(nodes / FAN)
        packed = sums.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("place", "bytes"))).alias("by")).select(
            "node", F.pmod("node", F.lit(nodes)).alias("above"),
            F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda p: F.coalesce(F.col("by")[p], F.lit(0))).alias("sums"))
        level = written(packed.groupBy("above").applyInPandas(
            node_places(shards), "node long, place int, above long, place_above int, bytes long"), "shard-level")
        levels.append(level)
        if nodes == 1:
            break
        sums = level.groupBy(F.col("above").alias("node"), F.col("place_above").alias("place")).agg(F.sum("bytes").alias("bytes"))
    final = levels[-1].select("node", "place", F.col("place_above").alias("shard"))
    for level in levels[-2::-1]:
        final = level.join(final.select(F.col("node").alias("above"), F.col("place").alias("place_above"), "shard"),
                           ["above", "place_above"]).select("node", "place", "shard")
    return placed.join(final, ["node", "place"]).select("key_a", "key_b", "bytes", "shard")


def numbered(rows: DataFrame, shard_col: str, id_col: str) -> DataFrame:
    """``rows`` with a gapless ``slot`` in each shard: offsets of small buckets plus the rank in the bucket."""
    buckets = max(1, math.ceil(rows.count() / SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(id_col, F.lit("slot")), F.lit(buckets)))
    sizes = rows.groupBy(shard_col, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard_col).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard_col, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy(shard_col, "bucket").orderBy(id_col, "key_a", "key_b"))
    return rows.withColumn("rank", rank).join(offsets, [shard_col, "bucket"]).withColumn("slot", F.col("offset") + F.col("rank") - 1)


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; equal texts share a shard."""
    text = F.col(text_col).cast("string")
    rows = written(docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("key_a"),
        F.xxhash64(F.lit("second"), text.isNull(), text, F.octet_length(text)).alias("key_b")), "shard-rows")
    groups = written(rows.groupBy("key_a", "key_b").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = written(rows.join(group_shards(groups, shards).drop("bytes"), ["key_a", "key_b"]), "shard-placed")
    return numbered(placed, "shard", "id").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
