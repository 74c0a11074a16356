"""Quality by nearest-neighbour voting among latent-semantic vectors.

Terms describe how a text is written: each word's shape (runs of letters and digits are one sign, other signs stand
for themselves), words and lines that repeat, the share of distinct words in eighths, and the text's length on a log scale. The ``TERMS`` most frequent among a sample of
at most ``EXAMPLES`` labelled documents are the vocabulary, weighted by document frequencies over all documents. The eigenvectors
of the examples' term products span ``RANK`` latent dimensions. The examples' unit vectors (at most
EXAMPLES x RANK doubles) are broadcast, and every document's cosine with every example is taken, block by block, keeping
the best ``NEIGHBOURS``. Their labels vote by similarity to the power ``SHARPNESS``; votes of the examples, each without itself, fit an isotonic
calibration.

Contract. A null text is an empty one; its only terms are its length and share. Ties between neighbours go to the earlier example. Repeated rows get
one score each. Without labels every score is 0.5. An empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.examples import Calibration, TfIdf, class_counts, document_frequencies, sample

EXAMPLES = 6000
TERMS = 1024
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 8
BLOCK = 2048

SAME = re.compile(r"([^\w\s])\1+")
PARTS = re.compile(r"[^\W\d_]+|\d+|[\W_]")


@lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    """A word's signs, with ``A`` for a run of capitals, ``a`` for other letters and ``0`` for digits; at most 12 of them."""
    marked = SAME.sub(r"\1\1", word)
    out = "".join("A" if part.isalpha() and part.isupper() else "a" if part.isalpha() else "0" if part.isdigit() else part
                  for part in PARTS.findall(marked))
    return out[:12]


def terms(text: str) -> Counter:
    found = text.split()
    out: Counter = Counter()
    for word, n in Counter(found).items():
        out[shape(word) if len(word) < 100 else "long word"] += n
    total = max(1, len(found))
    same = sum(a == b for a, b in zip(found, found[1:], strict=False))
    if same:
        out["same word"] = same
    lines = [x for x in text.split("\n") if x.strip()]
    twice = len(lines) - len(set(lines))
    if twice:
        out["same line"] = max(1, total * twice // len(lines))
    out[f"distinct {8 * len(set(found)) // total}"] = max(1, total // 8)
    out[f"length {int(np.log2(len(found) + 1))}"] = max(1, total // 8)
    return out


def rooted(tf: np.ndarray) -> np.ndarray:
    return np.sqrt(tf)


class LatentVoter:
    """Unit vectors of the examples in the latent space, and votes of the nearest."""

    def __init__(self, tfidf: TfIdf, examples: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.tfidf = tfidf
        self.labels = np.array([e[1] for e in examples], np.float64)
        size, width = len(examples), len(tfidf.vocabulary)
        gram = np.zeros((width, width))
        for _, _, at, weight in examples:
            gram[np.ix_(at, at)] += np.outer(weight, weight)
        self.axes = np.linalg.eigh(gram)[1][:, ::-1][:, :RANK] if width else np.zeros((0, 1))
        self.vectors = self.latent([e[2:] for e in examples])
        self.calibration = Calibration(self.votes(self.vectors, np.arange(size)), self.labels) if size else Calibration(np.zeros(0), np.zeros(0))

    def latent(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(vectors), self.axes.shape[1]))
        for i, (at, weight) in enumerate(vectors):
            out[i] = weight @ self.axes[at]
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)

    def votes(self, vectors: np.ndarray, without: np.ndarray | None = None) -> np.ndarray:
        """Share of label 1 among the nearest of every row, weighted by similarity."""
        out = []
        for begin in range(0, len(vectors), 512):
            part = vectors[begin:begin + 512]
            cosine, label = np.zeros((len(part), 0)), np.zeros((len(part), 0))
            for first in range(0, len(self.vectors), BLOCK):
                block = part @ self.vectors[first:first + BLOCK].T
                if without is not None:
                    own = without[begin:begin + 512] - first
                    inside = (own >= 0) & (own < block.shape[1])
                    block[np.flatnonzero(inside), own[inside]] = -1
                cosine = np.concatenate((cosine, np.round(block, 9)), axis=1)
                label = np.concatenate((label, np.broadcast_to(self.labels[first:first + BLOCK], block.shape)), axis=1)
                # rows hold earlier examples first; a tiny slope keeps that order among equal cosines
                best = np.argpartition(-cosine + 1e-13 * np.arange(cosine.shape[1]), min(NEIGHBOURS, cosine.shape[1] - 1), axis=1)[:, :NEIGHBOURS]
                best.sort(axis=1)
                cosine, label = np.take_along_axis(cosine, best, 1), np.take_along_axis(label, best, 1)
            weight = np.maximum(cosine, 1e-6) ** SHARPNESS
            out.append((weight * label).sum(axis=1) / weight.sum(axis=1))
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.labels) == 0:
            return np.full(len(texts), 0.5)
        return self.calibration(self.votes(self.latent([self.tfidf.vector(t) for t in texts])))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str, id_col: str, text_col: str, examples: int = EXAMPLES) -> LatentVoter:
    rows = sample(docs, labels, label_col, learn, examples, id_col, text_col)
    common = class_counts(rows, terms).orderBy(F.desc("n"), "term").limit(TERMS).collect()
    vocabulary = {r["term"]: i for i, r in enumerate(common)}
    frequencies, documents = document_frequencies(docs, terms, vocabulary, text_col)
    tfidf = TfIdf(terms, vocabulary, frequencies, documents, rooted)
    return LatentVoter(tfidf, tfidf.of(rows))


def quality(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
            examples: int = EXAMPLES) -> DataFrame:
    """(id, score) of every row of ``docs``; ``learn`` says which rows of ``labels`` may be learnt from."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learn, label_col, id_col, text_col, examples))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = sent.value
        for batch in batches:
            scores = voter.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
