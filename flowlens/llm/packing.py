"""Vector best-fit packing of token sequences.

A bin (training sequence) has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths). Pieces come longest first. Every open bin that holds a piece under all three
capacities is a candidate, and the weighted norm of what would be left of the capacities (``norm``, smallest
wins) or the weighted dot product of piece and residual (``dot``, largest wins) selects one; with no
candidate a bin is opened. Documents longer than a bin are cut from the end, so only the first piece is short.

Documents are dealt into groups of about ``GROUP_DOCS`` by hash, and each group is packed on its own, so a
task holds piece lengths of one group and never texts; a group leaves about one bin part empty.

Contract. A null text is an empty one, and every document ends with the end id, so an empty text is one
piece of length 1. Repeated rows are packed as often as they come. Ties go to the smaller id, then the
earlier piece, and among bins to the oldest. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.bpe import Encoder

GROUP_DOCS = 8192
PIECES_TOGETHER = 4096
WEIGHTS = (1.0, 0.05, 0.05)


def pieces_of(ids: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of each piece of at most ``size``; only the first may be shorter."""
    first = len(ids) % size or size
    yield 0, ids[:first]
    for start in range(first, len(ids), size):
        yield start, ids[start:start + size]


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end = np.array([end_id], np.int32)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in encoder.ids(batch.column("text").to_pylist()):
                for k, (at, part) in enumerate(pieces_of(np.concatenate((ids, end)).astype("<u4"), size)):
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, cost: int, weights: tuple[float, float, float],
             rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces are taken in the order given."""
    full = np.array([tokens, documents, cost], np.float64)
    weight = np.array(weights) / full ** (2 if rule == "norm" else 1)
    left = np.empty((3, 1024))
    number = np.empty(1024, np.int64)
    used, opened = 0, 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length], np.float64)
        rest = left[:, :used] - need[:, None]
        fits = (rest >= 0).all(axis=0)
        at = -1
        if fits.any():
            score = weight @ (rest * rest) if rule == "norm" else -(weight * need / full) @ left[:, :used]
            at = int(np.argmin(np.where(fits, score, np.inf)))
        if at < 0:
            if used == left.shape[1]:
                left, number = np.concatenate((left, np.empty_like(left)), axis=1), np.concatenate((number, np.empty_like(number)))
            at, used = used, used + 1
            left[:, at], number[at] = full, opened
            opened += 1
        bins[i], offsets[i] = number[at], tokens - left[0, at]
        left[:, at] -= need
        if left[:, at].min() < 1:  # nothing fits any more: the bin is closed
            used -= 1
            left[:, at:used], number[at:used] = left[:, at + 1:used + 1].copy(), number[at + 1:used + 1].copy()
    return bins, offsets


def pack(pieces: DataFrame, groups: int, tokens: int, documents: int | None = None, cost: int | None = None,
         weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with sequence_id and offset. Without a limit for documents or cost, the token limit implies it."""
    documents, cost = documents or tokens, cost or tokens * tokens
    shape = pieces.schema.simpleString().removeprefix("struct<").removesuffix(">")
    keyed = pieces.withColumn("pack_group", F.pmod(F.xxhash64(id_col, F.floor(F.col("piece") / PIECES_TOGETHER)), F.lit(groups)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", id_col, "piece"], ascending=[False, True, True], ignore_index=True)
        bins, offsets = best_fit(group["length"].to_numpy(), tokens, documents, cost, weights, rule)
        sequence = group["pack_group"].to_numpy() * (1 << 32) + bins
        return group.drop(columns="pack_group").assign(sequence_id=sequence, offset=offsets)

    return keyed.groupBy("pack_group").applyInPandas(run, f"{shape}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, tokens: int = 1024, end_id: int = 2, documents: int | None = None,
                   cost: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    groups = max(1, math.ceil(docs.count() / GROUP_DOCS))
    return pack(token_pieces(docs, path, tokens, end_id, id_col, text_col), groups, tokens, documents, cost, id_col=id_col)
