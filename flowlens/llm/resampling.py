"""Importance resampling towards a target distribution, over hashed n-grams found by prefix CRCs.

A document is normalised to its words joined by one blank and scanned once: its running CRC-32 is kept at every word
end. CRC-32 is linear over GF(2), so the CRC of any run of words follows from two of these prefixes: the earlier one,
shifted by the run's length in zero bytes, cancels out of the later one. No n-gram is ever cut out or hashed by itself.

A feature's CRC modulo ``buckets`` is its bucket. Every bucket has a gain: the logarithm of how much likelier it is in
the target than in the documents, both smoothed by one. A document's weight is the floored mean of its features' gains;
weight plus a Gumbel draw that depends on seed and id is its score, and the highest scores are the sample (drawing
without replacement in proportion to exp(weight)).

Defined results: null text counts as empty and an empty text has no feature and weight 0; ids may repeat or be null
(a null id draws as an empty one and sorts first); equal scores and ids are ranked in the order in which the rows were
first written; an empty table gives an empty result; other columns of the inputs are ignored. Texts are whole, however
long: they are scanned in parts of ``PART`` bytes, the running CRC carried from part to part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.tables import written
from flowlens.operators.indexing import with_row_index

# Bytes of one document that are cut into words at a time, and bytes of documents whose CRCs are derived together.
PART = 1 << 20
TOGETHER = 4 << 20
# The reflected polynomial of CRC-32 (fixed value), as zlib and Spark's crc32 use it.
POLYNOMIAL = 0xEDB88320

# Bytes of words stay, A-Z in lower case; every other byte of ASCII becomes the separator.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def one_byte() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


BYTE = one_byte()


def applied(shift: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return shift[0][crc & 255] ^ shift[1][(crc >> 8) & 255] ^ shift[2][(crc >> 16) & 255] ^ shift[3][crc >> 24]


def doublings(count: int = 40) -> list[np.ndarray]:
    """The shifts by 1, 2, 4, ... zero bytes, each as four tables of 256 (one for every byte of a CRC)."""
    basis = [np.arange(256, dtype=np.uint32) << np.uint32(8 * place) for place in range(4)]
    found = [np.stack([BYTE[b & 255] ^ (b >> 8) for b in basis])]
    for _ in range(count - 1):
        found.append(np.stack([applied(found[-1], applied(found[-1], b)) for b in basis]))
    return found


SHIFTS = doublings()


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Every CRC behind so many zero bytes (GF(2) multiplication by a power of x, by doublings)."""
    crc = crc.copy()
    for k in range(int(zeros.max(initial=0)).bit_length()):
        at = np.flatnonzero((zeros >> k) & 1)
        crc[at] = applied(SHIFTS[k], crc[at])
    return crc


def with_blank(crc: np.ndarray) -> np.ndarray:
    """The CRC after one more byte, the separator."""
    inner = ~crc
    return ~(BYTE[(inner ^ np.uint32(32)) & 255] ^ (inner >> 8))


def parts(text: str) -> Iterator[bytes]:
    """The normalised bytes of a text, cut only between words."""
    data = text.encode("utf-8", "surrogatepass").translate(NORMAL)
    start = 0
    while start < len(data):
        end = len(data) if len(data) - start <= PART else data.find(b" ", start + PART)
        end = len(data) if end < 0 else end
        yield data[start:end]
        start = end


def scanned(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(running CRC at each word's end, each word's length in bytes) of the words joined by one blank."""
    crcs, sizes, last = [], [], None
    for part in parts(text or ""):
        words = part.split()
        if not words:
            continue
        first = words[0] if last is None else b" " + words[0]
        rest = accumulate((b" " + w for w in words[1:]), lambda crc, w: zlib.crc32(w, crc), initial=zlib.crc32(first, last or 0))
        crcs.append(np.fromiter(rest, np.uint32, len(words)))
        sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
        last = int(crcs[-1][-1])
    none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return (np.concatenate(crcs), np.concatenate(sizes)) if crcs else none


def run_crcs(scans: list[tuple[np.ndarray, np.ndarray]], shortest: int, longest: int) -> list[np.ndarray]:
    """The CRC of every run of ``shortest`` to ``longest`` words, document by document."""
    ends = np.concatenate([s[0] for s in scans])
    sizes = np.concatenate([s[1] for s in scans])
    doc = np.repeat(np.arange(len(scans)), [len(s[0]) for s in scans])
    head = np.ones(len(ends), bool)
    head[1:] = doc[1:] != doc[:-1]
    before = np.zeros(len(ends), np.uint32)             # the prefix up to a word's first byte
    before[1:] = with_blank(ends[:-1])
    before[head] = 0
    until = np.cumsum(sizes + 1)                         # with a blank behind each word; differences stay in a document
    runs, owners = [], []
    for n in range(shortest, longest + 1):
        at = np.flatnonzero(doc[:len(doc) - n + 1] == doc[n - 1:]) if len(doc) >= n else np.zeros(0, np.int64)
        last = at + n - 1
        length = until[last] - until[at] + sizes[at]
        runs.append(ends[last] ^ shifted(before[at], length))
        owners.append(doc[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.split(np.concatenate(runs)[order], np.searchsorted(owner[order], np.arange(1, len(scans))))


def bucket_type(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def bucketed(shortest: int, longest: int, buckets: int):
    """Arrow batches (text, ...) -> (..., n_words, n_features, buckets: one fixed-width number a feature)."""
    width = bucket_type(buckets)

    def block(kept: pa.RecordBatch, scans: list) -> pa.RecordBatch:
        found = run_crcs(scans, shortest, longest)
        columns = [pa.array([len(s[0]) for s in scans], pa.int64()), pa.array([len(f) for f in found], pa.int64()),
                   pa.array([(f % np.uint32(buckets)).astype(width).tobytes() for f in found], pa.binary())]
        return pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "n_words", "n_features", "buckets"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column("text"), batch.select([n for n in batch.schema.names if n != "text"])
            start, held, scans = 0, 0, []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                scans.append(scanned(text))
                held += len(text or "")
                if held >= TOGETHER or i + 1 == batch.num_rows:
                    yield block(keep.slice(start, i + 1 - start), scans)
                    start, held, scans = i + 1, 0, []
    return cut


def values(column: pa.Array, width: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and where each row's begin (one more at the end)."""
    if not len(column):
        return np.zeros(0, width), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    numbers = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view(width) if data is not None else np.zeros(0, width)
    return numbers, (offsets - offsets[0]) // np.dtype(width).itemsize


def feature_table(texts: DataFrame, shortest: int, longest: int, buckets: int, name: str) -> DataFrame:
    """(row, doc_id, n_words, n_features, buckets) of every row; scanned once, written once."""
    rows = texts.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    found = rows.mapInArrow(bucketed(shortest, longest, buckets), f"row long, doc_id {kind}, n_words long, n_features long, buckets binary")
    return written(found, name)


def histogram(features: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, name) over all features; a task adds up its share before anything is shuffled."""
    width = bucket_type(buckets)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(values(batch.column(0), width)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return features.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln(((t+1)/(T+buckets)) / ((s+1)/(S+buckets))))."""
    spark = documents.sparkSession
    both = (spark.range(buckets).select(F.col("id").alias("bucket"))
            .join(histogram(documents, buckets, "s"), "bucket", "left").join(histogram(target, buckets, "t"), "bucket", "left")
            .na.fill(0, ["s", "t"]))
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))      # one row
    s, t, every_s, every_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = ((t + 1) * (every_s + float(buckets))) / ((s + 1) * (every_t + float(buckets)))
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """Features -> (row, doc_id, n_words, n_features, weight). ``gain`` has one number a bucket, however many rows."""
    width = bucket_type(len(gain))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, bounds = values(batch.column("buckets"), width)
            upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[numbers])])
            size = np.diff(bounds)
            weight = np.where(size > 0, (upto[bounds[1:]] - upto[bounds[:-1]]) // np.maximum(size, 1), 0)
            kept = [batch.column(c) for c in ("row", "doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weight, pa.int64())], ["row", "doc_id", "n_words", "n_features", "weight"])

    kind = dict(features.dtypes)["doc_id"]
    return features.mapInArrow(weigh, f"row long, doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256("seed:id")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def least_drawn(scores: DataFrame, wanted: int) -> int:
    """The greatest score that at least ``wanted`` rows reach. Scores are whole numbers in a range that logarithms
    bound, so the table of counts by score that the window runs over does not grow with the rows."""
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("score").desc())))
    return upto.where(F.col("upto") >= wanted).agg(F.max("score")).first()[0]


def resample(docs: DataFrame, target: DataFrame, percent: int, seed: int, min_words: int, shortest: int = 1, longest: int = 1,
             buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every row of ``docs``; ``rank`` is null where not drawn.

    Drawn are floor(percent * N / 100) of the N rows with at least ``min_words`` words: those of the highest score,
    ties to the smaller id. ``docs`` has doc_id and text, ``target`` has text.
    """
    features = feature_table(docs.select("doc_id", "text"), shortest, longest, buckets, "resample-features")
    wanted_features = feature_table(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), shortest, longest, buckets, "resample-target")
    table = {r["bucket"]: r["gain"] for r in gains(features, wanted_features, buckets).collect()}    # one row a bucket: a parameter, not data
    gain = np.array([table[b] for b in range(buckets)], np.int64)
    scores = written(weighed(features, gain).withColumn("score", F.col("weight") + gumbel(seed)), "resample-scores")

    eligible = scores.where(F.col("n_words") >= min_words)
    wanted = percent * eligible.count() // 100
    plain = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    if wanted == 0:
        return scores.select(*plain, F.lit(None).cast("long").alias("rank"), "n_words")
    chosen = (F.col("n_words") >= min_words) & (F.col("score") >= least_drawn(eligible, wanted))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row")]
    rank = F.col("place") + 1
    ranked = with_row_index(scores.where(chosen), order, "place").select(*plain, F.when(rank <= wanted, rank).alias("rank"), "n_words")
    rest = scores.where(~chosen).select(*plain, F.lit(None).cast("long").alias("rank"), "n_words")
    return ranked.unionByName(rest)


def drawn(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose id was drawn (all rows of an id that has one drawn row)."""
    chosen = ranks.where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("drawn_id")), "left_semi")
