"""Toxicity by the nearest labelled examples, found exactly by TF-IDF cosine in a block-max inverted index.

The examples are a sample of at most ``EXAMPLES`` labelled documents. Every word of theirs is a term, and so are the first
``STEM`` letters of a longer word, so that forms of one stem meet. No term is dropped: a term weighs its inverse document frequency
over all documents, times ``LEAST`` plus the log-likelihood ratio of its going with a label among the examples (near copies
counted once). Plain frequencies alone find neighbours by topic, not by tone; see the README for figures of both.

The index keeps the terms that many examples hold as rows of a dense matrix, which a batch of documents multiplies at once, and all others as
postings by term and block of ``BLOCK`` examples with the largest weight of each. A block's best product so far plus a document's products with
those maxima bounds its cosine with the block: the best blocks are finished first, then every block whose bound
reaches the k-th similarity so far, so the neighbours are exact.

Neighbours vote with weight 1 / (``SOFT`` + distance). Votes of the examples themselves, each without itself and taken in tasks, fit an
isotonic calibration. A document without known terms takes the calibrated share of the examples without terms.

Contract. A null text is an empty one, and has no terms. Ties between neighbours go to the earlier example. Repeated rows
get one score each. Without labels every score is 0.5. An empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.examples import LETTERS, Calibration, sample, without_copies
from flowlens.llm.tables import written

EXAMPLES = 2000
STEM = 5
LEAST = 0.1
BLOCK = 256
NEIGHBOURS = 15
SOFT = 0.05
FIRST_BLOCKS = 1
EVIDENCE = 3
# A term that one example in so many holds is a dense row; documents that are multiplied at once.
DENSE_SHARE = 16
TOGETHER = 128
# Tasks that the votes of the examples are taken in.
CALIBRATION_TASKS = 16


MARK = "#"


def word_terms(word: str) -> list[str]:
    """A word and, where it is longer, its first ``STEM`` letters; the mark keeps stems apart from words."""
    return [word, MARK + word[:STEM]] if len(word) > STEM else [word]


class Known(dict):
    """Numbers of words; an unknown word has that of its stem, or -1."""

    def __init__(self, words: dict[str, int], stems: dict[str, int]):
        super().__init__(words)
        self.stems = stems

    def __missing__(self, word: str) -> int:
        return self.stems.get(word[:STEM], -1) if len(word) > STEM else -1


class Cutter:
    """Counts of a text's known terms. A known word is looked up once: its number tells that of its stem."""

    def __init__(self, names: list[str]):
        stems = {t[1:]: i for i, t in enumerate(names) if t[0] == MARK}
        self.known = Known({t: i for i, t in enumerate(names) if t[0] != MARK}, stems)
        # by term number, the stem of a longer word, -1 for every other term and, at the end, for no term
        self.stem = np.array([stems.get(t[:STEM], -1) if t[0] != MARK and len(t) > STEM else -1 for t in names] + [-1], np.int32)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, how often) of a text."""
        words = LETTERS.findall((text or "").lower())
        found = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        found = np.concatenate((found, self.stem[found]))
        found = np.sort(found[found >= 0])
        first = np.flatnonzero(np.diff(found, prepend=-1))
        return found[first], np.diff(first, append=len(found))


class TermWeights:
    """The vocabulary with each term's weight, and unit vectors of texts."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights
        self.cutter: Cutter | None = None

    def __getstate__(self) -> tuple:
        return "\n".join(self.names), self.weights

    def __setstate__(self, state: tuple) -> None:
        self.names, self.weights, self.cutter = state[0].split("\n") if state[0] else [], state[1], None

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, weights), ascending; empty where no term is known."""
        if self.cutter is None:
            self.cutter = Cutter(self.names)
        at, tf = self.cutter.counts(text)
        value = damped(tf) * self.weights[at]
        return at, value / np.sqrt((value * value).sum()) if len(at) else value


def damped(tf: np.ndarray) -> np.ndarray:
    return 1 + np.log(tf)


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length), length)


class BlockMaxIndex:
    """Unit vectors by term: dense rows of the common terms, and postings of the others by cell (term and block that has it)
    with each cell's largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.size, self.blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        self.number = np.argsort(np.array(heaviest, np.int64), kind="stable")  # alike examples share blocks
        term = np.concatenate([vectors[i][0] for i in self.number] + [np.zeros(0, np.int32)])
        place = np.repeat(np.arange(self.size, dtype=np.int32), [len(vectors[i][0]) for i in self.number])
        weight = np.concatenate([vectors[i][1] for i in self.number] + [np.zeros(0)]).astype(np.float32)
        order = np.argsort(term, kind="stable")
        counts = np.bincount(term, minlength=terms).astype(np.int32)
        self.__setstate__((self.size, self.number, place[order].astype(np.min_scalar_type(self.size)), weight[order], counts))

    def __getstate__(self) -> tuple:
        """Rows and cells follow from the postings, so they are not sent along."""
        return self.size, self.number, self.place, self.weight, self.counts

    def __setstate__(self, state: tuple) -> None:
        self.size, self.number, self.place, self.weight, self.counts = state
        self.blocks = max(1, -(-self.size // BLOCK))
        self.edges = np.arange(0, max(self.size, 1), BLOCK)
        dense = self.counts * DENSE_SHARE > self.size
        self.row = np.where(dense, np.cumsum(dense) - 1, -1).astype(np.int32)
        term = np.repeat(np.arange(len(self.counts)), self.counts)
        common = dense[term]
        self.matrix = np.zeros((int(dense.sum()), self.size))
        self.matrix[self.row[term[common]], self.place[common]] = self.weight[common]
        self.thin_place, self.thin_weight = self.place[~common], self.weight[~common]
        cell = term[~common] * self.blocks + self.thin_place.astype(np.int64) // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.start = np.append(first, len(cell)).astype(np.int32)
        self.block = (cell[first] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.thin_weight, first) if len(first) else np.zeros(0, np.float32)
        self.cells = np.searchsorted(cell[first], np.arange(len(self.counts) + 1) * self.blocks).astype(np.int32)

    def dense_products(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Every vector's products with every example over the common terms."""
        left = np.zeros((len(vectors), len(self.matrix)))
        for i, (terms, weights) in enumerate(vectors):
            row = self.row[terms]
            left[i, row[row >= 0]] = weights[row >= 0]
        return left @ self.matrix

    def add_thin(self, cosine: np.ndarray, cells: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> None:
        """Add the products over the other terms for the examples of the blocks."""
        if len(blocks) < self.blocks:
            wanted = np.zeros(self.blocks, bool)
            wanted[blocks] = True
            inside = wanted[self.block[cells]]
            cells, weights = cells[inside], weights[inside]
        length = self.start[cells + 1] - self.start[cells]
        at = ranges(self.start[cells], length)
        cosine += np.bincount(self.thin_place[at], self.thin_weight[at] * np.repeat(weights, length), minlength=self.size)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the k nearest with a cosine above 0, nearest first; ``dense`` is the vector's row
        of ``dense_products``."""
        thin = self.row[terms] < 0
        terms, weights = terms[thin], weights[thin]
        length = self.cells[terms + 1] - self.cells[terms]
        cells, weights = ranges(self.cells[terms], length), np.repeat(weights, length)
        bound = np.bincount(self.block[cells], weights * self.most[cells], minlength=self.blocks) + np.maximum.reduceat(dense, self.edges)
        order = np.argsort(-bound, kind="stable")
        cosine = dense.copy()
        self.add_thin(cosine, cells, weights, order[:FIRST_BLOCKS])
        # what is missing only adds, so the k-th product so far is a floor; one more than k, as the example left out may be among them
        least = np.partition(cosine, -(k + 1))[-(k + 1)] if self.size > k else 0.0
        rest = order[FIRST_BLOCKS:]
        rest = rest[(bound[rest] >= least - 1e-9) & (bound[rest] > 0)]
        if len(rest):
            self.add_thin(cosine, cells, weights, rest)
        cosine = np.round(cosine, 12)
        found = np.flatnonzero(cosine > 0)
        number, value = self.number[found], cosine[found]
        number, value = number[number != without], value[number != without]
        if len(value) > k:
            near = value >= np.partition(value, -k)[-k]
            number, value = number[near], value[near]
        best = np.lexsort((number, -value))[:k]
        return number[best], np.minimum(value[best], 1.0)

    def nearest_of_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(vectors), TOGETHER):
            some = vectors[at:at + TOGETHER]
            for i, ((terms, weights), dense) in enumerate(zip(some, self.dense_products(some), strict=True)):
                yield self.nearest(terms, weights, dense, k, without[at + i] if without else -1)


class Voter:
    """Neighbours' votes; calibrated scores once ``calibration`` is there."""

    def __init__(self, terms: TermWeights, examples: list[tuple[object, int, np.ndarray, np.ndarray]]):
        self.terms, self.ids = terms, [str(e[0]) for e in examples]
        self.labels = np.array([e[1] for e in examples], np.float64)
        self.index = BlockMaxIndex([e[2:] for e in examples], len(terms.names)) if examples else None
        bare = np.array([len(e[2]) == 0 for e in examples], bool)
        rate = self.labels.mean() if examples else 0.5
        self.bare_score = float((self.labels[bare].sum() + rate) / (bare.sum() + 1)) if examples else 0.5

    def votes(self, texts: list[str | None], without: list[int] | None = None) -> Iterator[tuple[float | None, np.ndarray, np.ndarray]]:
        """(vote, example numbers, cosines) of every text; no vote for a text without known terms or neighbours."""
        vectors = [self.terms.vector(t) for t in texts]
        if self.index is None:
            yield from ((None, np.zeros(0, np.int64), np.zeros(0)) for _ in texts)
            return
        for numbers, cosines in self.index.nearest_of_all(vectors, NEIGHBOURS, without):
            weight = 1 / (SOFT + 1 - cosines)
            yield float(weight @ self.labels[numbers] / weight.sum()) if len(numbers) else None, numbers, cosines

    def judged(self, texts: list[str | None], calibration: Calibration) -> Iterator[tuple[float, list[dict]]]:
        for vote, numbers, cosines in self.votes(texts):
            evidence = [{"example": self.ids[n], "similarity": float(c), "label": int(self.labels[n])}
                        for n, c in zip(numbers[:EVIDENCE].tolist(), cosines.tolist(), strict=False)]
            yield self.bare_score if vote is None else float(calibration(np.array([vote]))[0]), evidence


def label_ratio(n: np.ndarray, n1: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of terms in n examples, n1 of them of label 1, against the share of label 1."""
    def part(seen: np.ndarray, expected: float) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(n * expected, 1e-300)), 0.0)

    return np.maximum(2 * (part(n1, share) + part(n - n1, 1 - share)), 0.0)


def term_counts(examples: DataFrame) -> DataFrame:
    """(term, n, m, m1): examples that hold a term, those of them apart from copies, and of those the ones of label 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, alone, ones = Counter(), Counter(), Counter()
        for batch in batches:
            for text, label, apart in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "apart")), strict=True):
                own = {t for w in set(LETTERS.findall(text.lower())) for t in word_terms(w)}
                every.update(own)
                if apart:
                    alone.update(own)
                    if label:
                        ones.update(own)
        names = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in (every, alone, ones))],
                                         ["term", "n", "m", "m1"])

    counted = examples.select("text", "label", "apart").mapInArrow(run, "term string, n long, m long, m1 long")
    return counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "m", "m1")])


def document_frequencies(docs: DataFrame, names: list[str], text_col: str) -> tuple[np.ndarray, int]:
    """How many of all documents hold each term, and how many documents there are."""
    sent = docs.sparkSession.sparkContext.broadcast("\n".join(names))
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(sent.value.split("\n"))
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total[cutter.counts(text)[0]] += 1
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size + 1, np.int64)
    found = counted.toArrow()
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out[:-1], int(out[-1])


def weighted_terms(docs: DataFrame, examples: DataFrame, text_col: str) -> TermWeights:
    """Every term of the examples and its weight; a table of examples is bounded, and so are these."""
    apart = without_copies(examples).select("no", F.lit(True).alias("apart"))
    marked = written(examples.join(apart, "no", "left").withColumn("apart", F.coalesce("apart", F.lit(False))), "examples-marked")
    counted = term_counts(marked).orderBy("term").toArrow()
    names = counted.column("term").to_pylist()
    size, ones = marked.where("apart").agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    ratio = label_ratio(*(counted.column(c).to_numpy().astype(np.float64) for c in ("m", "m1")), ones / size if size else 0.0)
    if not names:
        return TermWeights([], np.zeros(0))
    frequencies, documents = document_frequencies(docs, names, text_col)
    return TermWeights(names, np.log1p(documents / (1.0 + frequencies)) * (LEAST + ratio))


def example_vectors(examples: DataFrame, terms: TermWeights) -> list[tuple[object, int, np.ndarray, np.ndarray]]:
    """(id, label, term numbers, weights) of the examples, by number; the sample's bound holds."""
    sent = examples.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [sent.value.vector(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("no"), batch.column("id"), batch.column("label"),
                                              pa.array([v[0].astype("<i4").tobytes() for v in vectors], pa.binary()),
                                              pa.array([v[1].astype("<f4").tobytes() for v in vectors], pa.binary())], ["no", "id", "label", "terms", "weights"])

    kind = examples.schema["id"].dataType.simpleString()
    rows = examples.select("no", "id", "label", "text").mapInArrow(run, f"no long, id {kind}, label int, terms binary, weights binary").orderBy("no").toArrow()
    return [(i, label, np.frombuffer(t.as_buffer(), "<i4"), np.frombuffer(w.as_buffer(), "<f4")) for i, label, t, w in zip(
        rows.column("id").to_pylist(), rows.column("label").to_pylist(), rows.column("terms"), rows.column("weights"), strict=True)]


def calibrated(examples: DataFrame, voter) -> Calibration:
    """The calibration of the votes of the examples, each without itself; ``voter`` is the broadcast one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("place").to_pylist()
            votes = [v for v, _, _ in voter.value.votes(batch.column("text").to_pylist(), numbers)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch.column("label"), pa.array(votes, pa.float64())], ["place", "label", "vote"])

    # an example's number in the index is its place in the order of ``no``; few rows
    order = {r["no"]: i for i, r in enumerate(examples.select("no").orderBy("no").collect())}
    places = examples.sparkSession.createDataFrame([(n, i) for n, i in order.items()], "no long, place long")
    found = examples.join(places, "no").repartition(CALIBRATION_TASKS, "place").select("place", "text", "label").mapInArrow(
        run, "place long, label int, vote double").where("vote IS NOT NULL").orderBy("place").toArrow()
    return Calibration(found.column("vote").to_numpy(), found.column("label").to_numpy().astype(np.float64))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
             examples: int = EXAMPLES) -> DataFrame:
    """(id, score, evidence) of every row of ``docs``; ``learn`` says which rows of ``labels`` may be learnt from."""
    rows = sample(docs, labels, label_col, learn, examples, id_col, text_col)
    terms = weighted_terms(docs, rows, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(Voter(terms, example_vectors(rows, terms)))
    calibration = calibrated(rows, sent)
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("example", pa.string()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = list(sent.value.judged(batch.column("text").to_pylist(), calibration))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s for s, _ in judged], pa.float64()),
                                              pa.array([e for _, e in judged], shape)], ["id", "score", "evidence"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {kind}, score double, evidence array<struct<example:string,similarity:double,label:int>>") \
        .withColumnRenamed("id", id_col)
