"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A document's paragraphs are its lines, cut after ``PARAGRAPH`` characters where a line is longer, blanks at the ends
taken off; its digests are the distinct 64-bit hashes of the paragraphs that are left. A sketch has three tables of
``TABLE`` cells. Each digest goes into one cell of each: the cell counts it and takes the exclusive-or of the digests and
of their check hashes. The fingerprint is the sketch, as text.

Two sketches subtract cell by cell; digests that both texts hold cancel. A cell whose count is 1 or -1 and whose check
fits holds one digest that only one text has. It is taken out of its three cells, which frees others: peeling recovers
the paragraphs that differ. If cells are left over, the sketch was too small. A larger one deals the digests to more
parts of the same size by their hash; only the parts that fail are dealt on and tried again, in other cells. Likeness is the share of digests that both texts hold among all that either holds (1.0 for two texts without any).

Built-in functions only. Defined results: null text counts as empty; documents are ordered by id (null first), then by
text, so a repeated row's next document is its copy; equal texts have equal fingerprints; texts that differ only in the
order or number of equal paragraphs, or in blanks at their ends, share a fingerprint; the only row of a table is its own
next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.tables import let, written
from flowlens.operators.indexing import with_row_index
from flowlens.session import shuffle_partitions

PARAGRAPH = 200
TABLES = 3
TABLE = 8
# Digests of both sides that a part of a larger sketch is sized for, the parts that one round may deal to, and the rounds
# of peeling before a part counts as failed.
LOAD = 8
WAYS = 16
PEELS = 16
CHECK_SEED = 77

CELL = "struct<n: int, digest: bigint, check: bigint>"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, whole, as they come."""
    found = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PARAGRAPH}}}"), F.lit(0))
    return F.filter(F.transform(found, lambda p: F.btrim(p, F.lit(" \t\r"))), lambda p: p != "")


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def check(digest: Column) -> Column:
    return F.xxhash64(F.lit(CHECK_SEED), digest).bitwiseAND(F.lit((1 << 32) - 1))


def places(digest: Column, salt: Column) -> Column:
    """The cell of a digest in each table; the cells of all tables are counted through."""
    return F.array(*[F.pmod(F.xxhash64(salt, F.lit(t), digest), F.lit(TABLE)).cast("int") + F.lit(t * TABLE) for t in range(TABLES)])


def sketch(found: Column, salt: Column) -> Column:
    """Cells of an array of digests."""
    entries = F.transform(found, lambda d: F.struct(d.alias("digest"), check(d).alias("check"), places(d, salt).alias("at")))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("digest"), F.lit(0).cast("long").alias("check"))

    def cell(entries: Column, j: Column) -> Column:
        mine = F.filter(entries, lambda e: F.array_contains(e["at"], j))
        return F.aggregate(mine, nothing, lambda c, e: F.struct(
            (c["n"] + F.lit(1)).alias("n"), c["digest"].bitwiseXOR(e["digest"]).alias("digest"), c["check"].bitwiseXOR(e["check"]).alias("check")))

    return let(entries, lambda es: F.transform(F.sequence(F.lit(0), F.lit(TABLES * TABLE - 1)), lambda j: cell(es, j)))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["digest"].bitwiseXOR(y["digest"]).alias("digest"),
                                                  x["check"].bitwiseXOR(y["check"]).alias("check")))


def peeled(cells: Column, salt: Column) -> Column:
    """(cells, only_a, only_b): what is left of a subtracted sketch, and how many digests of each side came out of it."""
    def pure(cells: Column) -> Column:
        found = F.filter(cells, lambda c: (F.abs(c["n"]) == 1) & (check(c["digest"]) == c["check"]))
        return F.array_distinct(F.transform(found, lambda c: F.struct(
            c["n"].alias("n"), c["digest"].alias("digest"), c["check"].alias("check"), places(c["digest"], salt).alias("at"))))

    def without(cell: Column, j: Column, out: Column) -> Column:
        mine = F.filter(out, lambda p: F.array_contains(p["at"], j))
        return F.aggregate(mine, cell, lambda c, p: F.struct(
            (c["n"] - p["n"]).alias("n"), c["digest"].bitwiseXOR(p["digest"]).alias("digest"), c["check"].bitwiseXOR(p["check"]).alias("check")))

    def counted(out: Column, sign: int) -> Column:
        return F.size(F.filter(out, lambda p: p["n"] == sign)).cast("long")

    def step(state: Column, _: Column) -> Column:
        return let(pure(state["cells"]), lambda out: F.when(F.size(out) == 0, state).otherwise(F.struct(
            F.transform(state["cells"], lambda c, j: without(c, j, out)).alias("cells"),
            (state["only_a"] + counted(out, 1)).alias("only_a"), (state["only_b"] + counted(out, -1)).alias("only_b"))))

    start = F.struct(cells.cast(f"array<{CELL}>").alias("cells"), F.lit(0).cast("long").alias("only_a"), F.lit(0).cast("long").alias("only_b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PEELS)), start, step)


def empty(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c["n"] == 0) & (c["digest"] == 0) & (c["check"] == 0))


def as_text(cells: Column) -> Column:
    """A sketch as text: count, digest and check of every cell, in hexadecimal digits."""
    return F.array_join(F.transform(cells, lambda c: F.concat(
        F.hex(c["n"]), F.lit(":"), F.hex(c["digest"]), F.lit(":"), F.hex(c["check"]))), "|")


# ---------------------------------------------------------------- likeness of two texts
def tried(pairs: DataFrame) -> DataFrame:
    """(pair, salt, a, b) -> (pair, salt, solved, only_a, only_b, a, b); the digests of a solved part are no longer needed."""
    difference = subtracted(sketch(F.col("a"), F.col("salt")), sketch(F.col("b"), F.col("salt")))
    done = pairs.withColumn("left", peeled(difference, F.col("salt"))).withColumn("solved", empty(F.col("left.cells")))
    return done.select("pair", "salt", "solved", F.col("left.only_a").alias("only_a"), F.col("left.only_b").alias("only_b"),
                       *[F.when(~F.col("solved"), F.col(c)).alias(c) for c in ("a", "b")])


def dealt(failed: DataFrame) -> DataFrame:
    """(pair, salt, a, b) of every part that the digests of a failed part are dealt to, under the next salt.

    At least two parts and at most ``WAYS``, so a part of any size shrinks by each round at a cost in proportion to it.
    """
    salt = F.col("salt")
    ways = F.least(F.lit(WAYS), F.greatest(F.lit(2), F.ceil((F.size("a") + F.size("b")) / F.lit(float(LOAD)))))

    def tagged(side: str) -> Column:
        return F.transform(side, lambda d: F.struct(F.pmod(F.xxhash64(salt, F.lit(-1), d), ways).alias("way"), d.alias("digest")))

    def of(side: Column, way: Column) -> Column:
        return F.transform(F.filter(side, lambda t: t["way"] == way), lambda t: t["digest"])

    parts = let(F.struct(tagged("a").alias("a"), tagged("b").alias("b")), lambda t: F.transform(
        F.sequence(F.lit(0).cast("long"), ways.cast("long") - 1), lambda way: F.struct(of(t["a"], way).alias("a"), of(t["b"], way).alias("b"))))
    again = failed.select("pair", (F.col("salt") + 1).alias("salt"), "a", "b")
    return again.withColumn("part", F.explode(parts)).select("pair", "salt", "part.a", "part.b")


def likenesses(pairs: DataFrame) -> DataFrame:
    """(pair, likeness) for pairs (pair: any key, a, b: arrays of distinct digests)."""
    sizes = pairs.select("pair", F.size("a").cast("long").alias("n_a"))
    now = written(tried(pairs.select("pair", F.lit(0).alias("salt"), "a", "b")), "sketch-round")
    found = []
    while True:
        found.append(now.where("solved").select("pair", "only_a", "only_b"))
        failed = now.where("NOT solved")
        if failed.isEmpty():
            break
        # few bytes and much work: dealt to all tasks, however few files the last round left
        spread = failed.repartition(shuffle_partitions(failed.sparkSession), "pair")
        now = written(tried(dealt(spread)), "sketch-round")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    differing = every.groupBy("pair").agg(F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"))
    common = F.col("n_a") - F.col("only_a")
    union = F.col("n_a") + F.col("only_b")
    return sizes.join(differing, "pair").select("pair", F.when(union == 0, 1.0).otherwise(common / union).alias("likeness"))


# ---------------------------------------------------------------- documents and their edited texts
def with_next(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key, next_key, doc_id, n_chars, place, next_place): every row's successor by (doc_id, text), the last one's being
    the first. ``place`` counts the rows in that order from 0."""
    narrow = texts.select(*key, "doc_id", F.xxhash64("text").alias("hash"), F.char_length("text").cast("long").alias("n_chars"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), *[F.col(c) for c in key]]
    placed = written(with_row_index(narrow, order, "place").drop("hash"), "fingerprint-order")
    total = placed.agg(F.count(F.lit(1)).alias("total"))      # one row
    wanted = placed.crossJoin(F.broadcast(total)).withColumn("next_place", (F.col("place") + 1) % F.col("total")).drop("total")
    return wanted.join(placed.select(F.col("place").alias("next_place"), *[F.col(c).alias(f"next_{c}") for c in key]), "next_place")


def edited(texts: DataFrame, key: list[str]) -> DataFrame:
    """(doc_id, n_chars, place, next_place, text, edited): the last half of each text replaced by the start of its next one.

    Whole texts are shuffled once, by their key; both joins read that one exchange. Only the starts that are used move on.
    """
    order = written(with_next(texts, key), "fingerprint-next")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    whole = texts.select(*key, "text")
    named = order.select(*[F.col(c).alias(f"own_{c}") for c in key], *[f"next_{c}" for c in key], "doc_id", "n_chars", "place", "next_place")
    is_next = [whole[c] == named[f"next_{c}"] for c in key]
    starts = whole.join(named, is_next).select(*[F.col(f"own_{c}") for c in key], "doc_id", "n_chars", "place", "next_place",
                                               F.substring("text", F.lit(1), half).alias("start"))
    is_own = [whole[c] == starts[f"own_{c}"] for c in key]
    kept = (F.col("n_chars") - half).cast("int")
    return whole.join(starts, is_own).select("doc_id", "n_chars", "place", "next_place", "text",
                                             F.concat(F.substring("text", F.lit(1), kept), "start").alias("edited"))


def fingerprints(docs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs``.

    ``key`` names columns, never null, that identify a row and stay the same however often ``docs`` is computed, such as
    the file and row number of a scan. Without such columns the rows are numbered and written first.
    """
    plain = F.coalesce("text", F.lit("")).alias("text")
    if key is None:
        key = ["row"]
        texts = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", plain), "fingerprint-texts")
    else:
        texts = docs.select(*key, "doc_id", plain)
    found = written(edited(texts, key).select("place", "next_place", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                                              digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed")), "fingerprint-digests")
    # a pair's key: twice the row's place, plus 1 for the next document
    same = found.select((F.col("place") * 2).alias("pair"), F.col("own").alias("a"), F.col("changed").alias("b"))
    after = found.select(F.col("place").alias("next_place"), F.col("own").alias("b"))
    following = found.select("place", "next_place", F.col("own").alias("a")).join(after, "next_place").select(
        (F.col("place") * 2 + 1).alias("pair"), "a", "b")
    near = written(likenesses(same.unionByName(following)), "fingerprint-likeness")

    def of(kind: int, name: str) -> DataFrame:
        return near.where(F.col("pair") % 2 == kind).select(F.expr("pair div 2").alias("place"), F.col("likeness").alias(name))

    no_salt = F.lit(0)
    return (found.join(of(0, "near_edited"), "place").join(of(1, "near_next"), "place")
            .select("doc_id", "n_chars", "edited_sha256", as_text(sketch(F.col("own"), no_salt)).alias("fingerprint"),
                    as_text(sketch(F.col("changed"), no_salt)).alias("edited_fingerprint"), "near_edited", "near_next"))
