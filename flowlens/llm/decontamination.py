"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ by ``rate`` x n edits, rounded down to k. Of its k + 1 pieces at least one
must then stand unchanged in the text, so the exact hits of all pieces (found in one pass by an Aho-Corasick
automaton) lead to every occurrence. Around each hit, Myers' bit-parallel distance finds the best
match within the budget. Case and runs of white space do not count; positions are those of the text itself.

Items are broadcast in rounds of at most ``ROUND_CHARS`` characters (one round for any usual benchmark), and each
round is one pass over the documents, so memory does not grow with the benchmark.

Contract. Null or blank items match nothing; items with one text each get their own matches, and a repeated
item row gets none of its own. A null text is an empty one. Each item is reported once per row, at its smallest distance,
earliest on ties. Repeated rows are repeated. An empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 0.08
ROUND_CHARS = 8_000_000
MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()),
                                  T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def origins(text: str) -> list[int]:
    """For each character of ``normal(text)``, its place in ``text``."""
    out, blank = [], True
    for i, c in enumerate(text):
        if c.isspace():
            if not blank:
                out.append(i)
            blank = True
        else:
            out.extend([i] * len(c.lower()))
            blank = False
    return out


def pieces(length: int, count: int) -> list[tuple[int, int]]:
    """``count`` contiguous pieces of nearly equal length, none of them empty."""
    bounds = [length * i // count for i in range(count + 1)]
    return [(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


class Pattern:
    """Myers' bit vectors of one item, for matches that begin and end anywhere in a window."""

    def __init__(self, text: str):
        self.length = len(text)
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.masks[c] |= 1 << i
        self.masks.default_factory = None
        self.full = (1 << self.length) - 1
        self.top = 1 << (self.length - 1)

    def best(self, window: str) -> tuple[int, int]:
        """(smallest distance, first end) of the item within ``window``."""
        get, full, top = self.masks.get, self.full, self.top
        plus, minus, score = full, 0, self.length
        least, end = score, 0
        for i, c in enumerate(window):
            eq = get(c, 0)
            across = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = minus | ~(across | plus) & full, plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < least:
                    least, end = score, i + 1
            up, down = (up << 1) & full, (down << 1) & full
            eq |= minus
            plus, minus = down | ~(eq | up) & full, up & eq
        return least, end


class Matcher:
    """Automaton of the pieces of a round of items; kept by each worker process."""

    _kept: tuple[str, Matcher] | None = None

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick
        self.items = [(item_id, text, int(rate * len(text))) for item_id, text in items]
        self.patterns: dict[int, tuple[Pattern, Pattern]] = {}
        by_piece: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, budget) in enumerate(self.items):
            for a, b in pieces(len(text), budget + 1):
                by_piece[text[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        if by_piece:
            self.automaton.make_automaton()
        self.empty = not by_piece

    @classmethod
    def of(cls, key: str, items: list[tuple[int, str]], rate: float) -> Matcher:
        if cls._kept is None or cls._kept[0] != key:
            cls._kept = (key, cls(items, rate))
        return cls._kept[1]

    def pattern(self, n: int) -> tuple[Pattern, Pattern]:
        if n not in self.patterns:
            text = self.items[n][1]
            self.patterns[n] = (Pattern(text), Pattern(text[::-1]))
        return self.patterns[n]

    def matches(self, text: str | None) -> list[dict]:
        flat = normal(text or "")
        if self.empty or not flat:
            return []
        begins: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(flat):
            for n, offset in places:
                begins[n].add(end + 1 - size - offset)
        out, places = [], None
        for n, at in begins.items():
            item_id, item, budget = self.items[n]
            found = None
            for a, b in self.windows(sorted(at), len(item), budget):
                forward, backward = self.pattern(n)
                window = flat[max(0, a):b]
                distance, end = forward.best(window)
                if distance <= budget and (found is None or distance < found[0]):
                    begin = end - backward.best(window[:end][::-1])[1]
                    found = (distance, max(0, a) + begin, max(0, a) + end)
            if found:
                places = places or origins(text)
                out.append({"item_id": item_id, "distance": found[0], "start": places[found[1]], "end": places[found[2] - 1] + 1})
        return sorted(out, key=lambda m: (m["start"], m["item_id"]))

    @staticmethod
    def windows(begins: list[int], length: int, budget: int) -> Iterator[tuple[int, int]]:
        """Stretches that hold every match whose piece begins where the hits say; near ones are joined."""
        low = high = begins[0]
        for begin in begins[1:]:
            if begin - high > length:
                yield low - budget, high + length + budget
                low = begin
            high = begin
        yield low - budget, high + length + budget


def rounds(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple[int, str]]]:
    """The items' normal texts in lists of about ``size`` characters; each list is bounded before it is collected."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").dropDuplicates()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / size))
    for part in range(parts):
        chunk = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect()
        yield sorted((r["id"], flat) for r in chunk if (flat := normal(r["text"])))


def with_matches(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text", round_chars: int = ROUND_CHARS) -> DataFrame:
    """(row, matches): every row of ``docs`` as a struct, and the items found in its text."""
    spark = docs.sparkSession
    found = docs.select(F.struct("*").alias("row"), F.array().cast(MATCH).alias("matches"))
    shape = T.StructType([found.schema["row"], T.StructField("matches", MATCH)])
    for chunk in rounds(items, item_id_col, item_text_col, round_chars):
        sent = spark.sparkContext.broadcast(chunk)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = Matcher.of(key, sent.value, rate)
            for batch in batches:
                texts, so_far = batch.column("row").field(text_col).to_pylist(), batch.column("matches").to_pylist()
                new = [[*old, *matcher.matches(text)] for text, old in zip(texts, so_far, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, ARROW_MATCH)], ["row", "matches"])

        found = found.mapInArrow(run, shape)
    return found


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """(id, item_id, distance, start, end) of every item found in a row of ``docs``."""
    found = with_matches(docs.select(id_col, text_col), items, rate, text_col, **names)
    return found.select(F.col(f"row.{id_col}").alias(id_col), F.explode("matches").alias("m")).select(id_col, "m.*")


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, **names) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    return with_matches(docs, items, rate, **names).where(F.size("matches") == 0).select("row.*")
