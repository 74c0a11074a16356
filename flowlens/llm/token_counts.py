"""Token counts: Arrow batches go in, only lengths come out.

Contract. A null text counts as empty. Special strings inside a text are single ids, as the library's
default has it; nothing is added, cut or padded. Every input row gives one row, repeated rows included;
an empty table gives an empty table. Columns of the input other than the id and the text are left out,
so names cannot clash. Texts of any length are encoded whole: a batch is dealt into blocks of equal
size in characters, and a text longer than a block is split where no piece can span the cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.bpe import Encoder

_models: dict[str, object] = {}


def plain_byte_level(path: str) -> bool:
    """True where the piece rule of ``Encoder`` is the file's own and nothing else touches a text."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    cut = config.get("pre_tokenizer") or {}
    return (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
            and not config.get("normalizer") and not config["model"].get("ignore_merges") and not config.get("truncation"))


def text_lengths(path: str, texts: list[str | None]) -> np.ndarray:
    """Number of ids of each text by the library that reads ``path``."""
    if path.endswith(".model"):
        if path not in _models:
            import sentencepiece
            _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return np.array([len(_models[path].encode(t or "")) for t in texts], np.int64)
    if path not in _models:
        _models[path] = plain_byte_level(path)
    encoder = Encoder.of(path)
    if _models[path]:
        return encoder.lengths(texts)
    return np.array([len(encoder.library.encode(t or "", add_special_tokens=False).ids) for t in texts], np.int64)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of ``docs``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            n_tokens = pa.array(text_lengths(path, texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, n_tokens], ["id", "n_bytes", "n_tokens"])

    return source.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
