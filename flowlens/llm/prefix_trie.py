"""The trie of conversation prefixes, with subtree totals by parallel tree contraction.

Every distinct sequence of first turns is a node; a conversation is a member of the node of each of its prefixes. A
node's key is the exclusive-or of two 64-bit hashes of (depth, role, text) over its turns, 128 bits in all. Running
exclusive-ors are taken in two levels, within pieces of ``PIECE`` turns and over pieces, so that one very long
conversation is dealt to many tasks.

Subtree totals come from contraction rounds, each a few joins. Rake: every leaf hands its total to its parent and is
final. Compress: in chains of nodes with one child, an independent set (local minima of a hash that changes with the
round) is spliced out; its value waits on the edge to the child that takes its place. A chain of any length is gone after
logarithmically many rounds. Then the spliced nodes are put back, last round first: total = total of the heir + what was
kept for it.

Defined results: turns are ordered by turn (null first), then role and text; null role and text count as empty; a turn
that is repeated counts as often as it is there; rows without a conversation id belong to no conversation; an empty table
gives an empty trie; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.tables import written

# Turns of one conversation that are numbered and hashed by one task at a time.
PIECE = 4096
WORD = r"[^\x20\x09-\x0D]+"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): every turn with its place in its conversation, from 0.

    Repeated rows are counted first and expanded after numbering, so copies of one row never meet in one task.
    """
    rows = (turns.where(F.col("conv_id").isNotNull())
            .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
            .groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("piece", F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(-(1 << 62)))))
    ahead = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("conv_id", "piece").agg(F.sum("copies").alias("copies"))
               .select("conv_id", "piece", F.sum("copies").over(ahead).alias("before")).where("before IS NOT NULL"))
    within = Window.partitionBy("conv_id", "piece").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("inside", F.coalesce(F.sum("copies").over(within), F.lit(0)))
              .join(offsets, ["conv_id", "piece"], "left")
              .withColumn("first", F.col("inside") + F.coalesce("before", F.lit(0))))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return placed.select("conv_id", "first", "role", "text", copy.alias("copy")).select(
        "conv_id", (F.col("first") + F.col("copy")).alias("pos"), "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words) of every turn; ``turns`` has conv_id, depth (dense, from 1), role and text."""
    def hashed(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.col("depth").cast("long"), "role", "text")

    rows = (turns.withColumn("a", hashed(1)).withColumn("b", hashed(2)).withColumn("words", F.regexp_count("text", F.lit(WORD)).cast("long"))
            .withColumn("piece", F.floor((F.col("depth") - 1) / PIECE)).drop("role", "text"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (rows.groupBy("conv_id", "piece").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
              .select("conv_id", "piece", F.bit_xor("a").over(before).alias("before_a"), F.bit_xor("b").over(before).alias("before_b"))
              .where("piece > 0"))
    upto = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = (rows.withColumn("upto_a", F.bit_xor("a").over(upto)).withColumn("upto_b", F.bit_xor("b").over(upto))
              .join(pieces, ["conv_id", "piece"], "left"))
    a = F.col("upto_a").bitwiseXOR(F.coalesce("before_a", F.lit(0)))
    b = F.col("upto_b").bitwiseXOR(F.coalesce("before_b", F.lit(0)))
    return joined.select("conv_id", "depth", key(a, b).alias("node"), key(a.bitwiseXOR(F.col("a")), b.bitwiseXOR(F.col("b"))).alias("parent"), "words")


def key(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def root() -> Column:
    """The key of the empty prefix."""
    return F.unhex(F.lit("0" * 32))


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) over the rows (node, conv_id): the ids of each node, ascending, joined by commas, hashed.

    The rows of a node arrive in order and are hashed as they come, so a node where very many conversations end takes
    no memory; SHA-256 itself allows no other order.
    """
    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for found, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found == node:
                    state.update(f",{conv}".encode())
                else:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = found, hashlib.sha256(f"{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                                             ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    ordered = ends.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    return ordered.mapInArrow(digest, "node binary, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, depth, role and text; ``conversations`` has every conv_id, those without a turn as well, and
    ``n_turns``. n_leaves and saved_tokens are totals over the node's subtree, itself included.
    """
    rows = written(prefixes(turns).join(conversations.select("conv_id", "n_turns"), "conv_id"), "trie-rows")
    members = rows.groupBy("node", "parent", F.col("depth").cast("long").alias("depth"), "words").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    top = (conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
            .select(root().alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
                    F.lit(0).cast("long").alias("words"), "conv_id", "n_convs"))
    listed = written(members.unionByName(top).withColumn("id", F.monotonically_increasing_id()), "trie-nodes")
    children = listed.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    above = listed.select(F.col("node").alias("parent"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    nodes = written(listed.join(children, "node", "left").join(above, "parent", "left")
                    .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).drop("parent"), "trie-linked")

    own = nodes.select(F.col("id").alias("node"), F.col("parent_id").alias("parent"), (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"]).withColumnRenamed("node", "id")
    last = rows.where("depth = n_turns").select("node", "conv_id")
    ends = id_digests(last.unionByName(conversations.where("n_turns = 0").select(root().alias("node"), "conv_id")))
    return (nodes.join(totals, "id").join(ends, "node", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


# ---------------------------------------------------------------- contraction
def raked(state: DataFrame, values: list[str]) -> DataFrame:
    """One rake: leaves are marked final, their parents take their values; ``heir`` names the only child that is left."""
    kids = state.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    marked = state.join(kids, "node", "left").withColumn("leaf", F.col("kids").isNull()).drop("kids")
    given = marked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        *[F.sum(F.when(F.col("leaf"), F.col(v) + F.col(f"edge_{v}")).otherwise(0)).alias(f"give_{v}") for v in values],
        F.count_if(~F.col("leaf")).alias("left"), F.min(F.when(~F.col("leaf"), F.col("node"))).alias("child"))
    taken = marked.join(given, "node", "left")
    heir = F.when((F.col("left") == 1) & F.col("parent").isNotNull(), F.col("child"))
    return taken.select("node", "parent", "leaf", *[(F.col(v) + F.coalesce(f"give_{v}", F.lit(0))).alias(v) for v in values],
                        *[f"edge_{v}" for v in values], heir.alias("heir"))


def compressed(kept: DataFrame, values: list[str], turn: int) -> DataFrame:
    """One compress: nodes with one child that come first among their neighbours of that kind are spliced out.

    A row of the result is a node that stays; where it takes the place of a spliced parent, ``gone`` is that parent and
    ``gone_*`` what the parent's total has beyond this node's.
    """
    unary = kept.where("heir IS NOT NULL").select("node", "heir", F.struct(F.xxhash64(F.lit(turn), "node").alias("draw"), "node").alias("rank"))
    below = unary.select(F.col("node").alias("heir"), F.col("rank").alias("other"))
    beaten = unary.join(below, "heir").select(F.when(F.col("rank") < F.col("other"), F.col("heir")).otherwise(F.col("node")).alias("node"))
    chosen = unary.select("node").join(beaten.distinct(), "node", "left_anti")
    leaving = kept.join(chosen, "node").select(
        F.col("heir").alias("node"), F.col("node").alias("gone"), F.col("parent").alias("new_parent"),
        *[F.col(v).alias(f"own_{v}") for v in values], *[F.col(f"edge_{v}").alias(f"above_{v}") for v in values])
    stays = kept.join(chosen, "node", "left_anti").join(leaving, "node", "left")

    def moved(v: str) -> list[Column]:
        passed = F.col(f"own_{v}") + F.col(f"edge_{v}")
        return [F.coalesce(passed + F.col(f"above_{v}"), F.col(f"edge_{v}")).alias(f"edge_{v}"), passed.alias(f"gone_{v}")]

    return stays.select("node", F.when(F.col("gone").isNotNull(), F.col("new_parent")).otherwise(F.col("parent")).alias("parent"), *values,
                        *[c for v in values for c in moved(v)], "gone")


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(node, values): sums over each node's subtree, itself included. ``nodes`` has node (a number), parent (null: a root)
    and the values."""
    state = written(nodes.select("node", "parent", *values, *[F.lit(0).cast("long").alias(f"edge_{v}") for v in values]), "contract")
    final, spliced = [], []
    while True:
        rake = written(raked(state, values), "rake")
        final.append(rake.where("leaf").select("node", *values))
        kept = rake.where("NOT leaf").drop("leaf")
        if kept.isEmpty():
            break
        step = written(compressed(kept, values, len(spliced)), "compress")
        spliced.append(step.where("gone IS NOT NULL").select(F.col("gone"), "node", *[f"gone_{v}" for v in values]))
        state = step.drop("gone", *[f"gone_{v}" for v in values])

    def together(tables: list[DataFrame]) -> DataFrame:
        whole = tables[0]
        for t in tables[1:]:
            whole = whole.unionByName(t)
        return whole

    for step in reversed(spliced):
        back = step.join(together(final), "node").select(F.col("gone").alias("node"), *[(F.col(v) + F.col(f"gone_{v}")).alias(v) for v in values])
        final.append(written(back, "expand"))
    return together(final)
