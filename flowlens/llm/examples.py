"""Bounded samples of labelled documents as neighbours, and what voting by neighbours needs around them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.tables import GAP, written

LETTERS = re.compile(r"[^\W\d_]+")
Terms = Callable[[str], Counter]


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, limit: int, id_col: str, text_col: str) -> DataFrame:
    """(no, id, label, text) of at most ``limit`` labelled documents that ``learn`` allows, by hash order; equal texts once.

    Ids are chosen first, so only the chosen rows' texts are moved. A document with several labels has the highest.
    """
    chosen = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(label_col).cast("int")).alias("label")).orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), "id").groupBy(F.xxhash64("text").alias("hash"), F.length("text").alias("size")).agg(
        F.min_by(F.struct("id", "label", "text"), F.struct("id", "label")).alias("r"))
    few = found.orderBy("hash", "size").limit(limit)
    return written(few.select(F.monotonically_increasing_id().alias("no"), "r.*"), "examples")


def without_copies(examples: DataFrame) -> DataFrame:
    """``examples`` without those whose least shingle hashes, all four, are those of an earlier one: near copies are no further evidence."""
    words = F.split(F.lower("text"), GAP)
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))), lambda i: F.xxhash64(F.slice("words", i + 1, 3)))
    least = F.concat_ws(":", *(F.array_min(F.transform("shingles", lambda s: F.xxhash64(s, F.lit(j)))).cast("string") for j in range(4)))
    signs = examples.select("no", words.alias("words")).withColumn("shingles", shingles).select("no", least.alias("signs"))
    return examples.join(signs.groupBy("signs").agg(F.min("no").alias("no")).select("no"), "no", "left_semi")


def class_counts(examples: DataFrame, terms: Terms) -> DataFrame:
    """(term, n, n1): examples that hold a term, and those of label 1 among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                own = sorted(terms(text))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([label] * len(own), pa.int32())], ["term", "label"])

    return examples.select("text", "label").mapInArrow(run, "term string, label int").groupBy("term").agg(
        F.count("*").alias("n"), F.sum("label").alias("n1"))


def document_frequencies(docs: DataFrame, terms: Terms, vocabulary: dict[str, int], text_col: str) -> tuple[np.ndarray, int]:
    """How many of all documents hold each term of the (bounded) vocabulary, and how many documents there are."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total[[known[t] for t in terms(text or "").keys() & known.keys()]] += 1
                total[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary) + 1, np.int64)
    found = counted.toArrow()
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out[:-1], int(out[-1])


class TfIdf:
    """Unit TF-IDF vectors over a vocabulary."""

    def __init__(self, terms: Terms, vocabulary: dict[str, int], frequencies: np.ndarray, documents: int, scale: Callable):
        self.terms, self.vocabulary, self.scale = terms, vocabulary, scale
        self.idf = np.log1p(documents / (1.0 + frequencies))

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, weights); empty where no term is known."""
        counts = self.terms(text or "")
        at = sorted((self.vocabulary[t], counts[t]) for t in counts.keys() & self.vocabulary.keys())
        if not at:
            return np.zeros(0, np.int64), np.zeros(0)
        index, tf = np.array([a for a, _ in at]), np.array([c for _, c in at], np.float64)
        value = self.scale(tf) * self.idf[index]
        return index, value / np.sqrt((value * value).sum())

    def of(self, examples: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(id, label, term numbers, weights) of the examples, by number; the sample's bound holds."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = [self.vector(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("no"), batch.column("id"), batch.column("label"),
                     pa.array([v[0].astype("<i4").tobytes() for v in vectors], pa.binary()),
                     pa.array([v[1].astype("<f8").tobytes() for v in vectors], pa.binary())], ["no", "id", "label", "terms", "weights"])

        kind = examples.schema["id"].dataType.simpleString()
        rows = examples.select("no", "id", "label", "text").mapInArrow(run, f"no long, id {kind}, label int, terms binary, weights binary").orderBy("no").toArrow()
        return [(i, label, np.frombuffer(t.as_buffer(), "<i4"), np.frombuffer(w.as_buffer(), "<f8")) for i, label, t, w in zip(
            rows.column("id").to_pylist(), rows.column("label").to_pylist(), rows.column("terms"), rows.column("weights"), strict=True)]


class Calibration:
    """Isotonic map from raw votes to probabilities, fitted on votes that left the voter itself out."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, bins: int = 40, prior: float = 1.0):
        if len(votes) == 0:
            self.x, self.y = np.array([0.0]), np.array([0.5])
            return
        order = np.argsort(votes, kind="stable")
        rate = float(labels.mean())
        blocks: list[list[float]] = []  # weight, sum of labels, sum of votes
        for part in np.array_split(order, min(bins, len(order))):
            blocks.append([float(len(part)), float(labels[part].sum()), float(votes[part].sum())])
            while len(blocks) > 1 and (blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]
                                       or blocks[-2][2] / blocks[-2][0] >= blocks[-1][2] / blocks[-1][0]):
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.x = np.array([v / n for n, _, v in blocks])
        # the pull towards the base rate is stronger on small blocks, so order is put right after it
        self.y = np.maximum.accumulate([(s + prior * rate) / (n + prior) for n, s, _ in blocks])

    def __call__(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, self.x, self.y)
