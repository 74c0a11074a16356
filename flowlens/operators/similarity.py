"""Text chunking, embedding pooling and process-level similarity.

Scale notes:
  * tokens and chunks are row-local array expressions over the whole text (no explode per token);
  * pooling explodes vectors to (instance, dim) and averages with partial aggregation, so an
    instance with very many chunks is combined map-side, never collected into one row;
  * similarity is reported between processes: the mean cosine over all instance pairs of two
    processes equals (sum of unit vectors of p) . (sum of unit vectors of q) / (n_p * n_q).
    That is a matrix product S S^T computed as an equi-join on ``dim`` plus an aggregate:
    O(N d) work, output processes^2 rows, and no instance pair is ever materialised.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.text import truncate_label
from flowlens.operators.indexing import with_running
from flowlens.session import cut_lineage

# Chunk size of the embedding step (the reference's model limit is 8191 tokens).
MAX_TOKENS = 8000
# Whitespace tokens; a pluggable stand-in for a subword tokenizer.
# Each token carries the blanks before it, the last one also those after it, so the tokens make up the whole text.
TOKEN_PATTERN = r"[ \t\n\r\f\x0B]*[^ \t\n\r\f\x0B]+(?:[ \t\n\r\f\x0B]+\z)?"


def whitespace_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)


def token_counts(df: DataFrame, text_col: str = "text",
                 tokenizer: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    return df.withColumn("num_tokens", F.size(tokenizer(F.col(text_col))).cast("int"))


def chunk_tokens(df: DataFrame, id_cols: list[str], text_col: str = "text", max_tokens: int = MAX_TOKENS,
                 tokenizer: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    """One row per chunk of at most ``max_tokens`` tokens (last chunk shorter; a text that fits,
    including an empty one, is a single chunk). Joined, the chunks give the text unchanged: ``tokenizer``
    returns tokens that make up the whole text, and a text without tokens is kept as it is."""
    m = int(max_tokens)
    if m <= 0:
        raise ValueError("max_tokens must be positive")
    # tokens once per row; the chunk lambda then slices the materialised array
    base = df.select(*id_cols, F.col(text_col).alias("_text"), tokenizer(F.col(text_col)).alias("_tok"))
    tok = F.col("_tok")
    n_chunks = F.greatest(F.lit(1), F.ceil(F.size(tok) / m).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda k: F.slice(tok, k * m + 1, m))
    return (base.select(*id_cols, F.when(F.size(tok) == 0, F.col("_text")).alias("_text"), F.posexplode(chunks).alias("chunk", "_toks"))
            .select(*id_cols, "chunk", F.size("_toks").alias("n_tokens"),
                    F.coalesce("_text", F.array_join("_toks", "")).alias("chunk_text")))


def chunked_lines(lines: DataFrame, id_cols: list[str], order_col: str, text_col: str = "text", max_tokens: int = MAX_TOKENS,
                  tokenizer: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    """Chunks of texts that are given line by line: (id, chunk, n_tokens, chunk_text), the same chunks as of the lines
    joined by newlines, which is never done.

    A running token count places every line in its text; a line that reaches into further chunks is cut at their limits,
    and each chunk is put together from its own lines only. A newline belongs to the token after it, blanks at the end
    of a line to the token before. Null lines are left out; a text without any token is one chunk.
    """
    m = int(max_tokens)
    if m <= 0:
        raise ValueError("max_tokens must be positive")
    kept = lines.where(F.col(text_col).isNotNull()).select(*id_cols, order_col, F.col(text_col).alias("_text"))
    counted = kept.withColumn("_count", F.size(tokenizer(F.col("_text"))))
    placed = with_running(counted, id_cols, [order_col], {"_start": F.col("_count"), "_line": F.lit(1)})
    whole = F.when(F.col("_line") == 0, F.col("_text")).otherwise(F.concat(F.lit("\n"), "_text"))
    tokens = placed.withColumn("_tok", tokenizer(whole)).withColumn("_text", whole)
    n = F.col("_count")
    first, last = F.col("_start"), F.col("_start") + n - 1
    chunk = F.when(n > 0, F.sequence(F.floor(first / m), F.floor(last / m))).otherwise(F.array(F.floor(F.greatest(first - 1, F.lit(0)) / m)))
    cut = tokens.withColumn("chunk", F.explode(chunk))
    begin = F.greatest(F.col("chunk") * m - first, F.lit(0)).cast("int")
    taken = (F.least((F.col("chunk") + 1) * m - first, n.cast("bigint")) - begin).cast("int")
    piece = F.when(n == 0, F.col("_text")).otherwise(F.array_join(F.slice("_tok", begin + 1, F.greatest(taken, F.lit(0))), ""))
    parts = cut.select(*id_cols, order_col, F.col("chunk").cast("int").alias("chunk"), piece.alias("_piece"), F.when(n > 0, taken).otherwise(0).alias("_taken"))
    return parts.groupBy(*id_cols, "chunk").agg(F.sum("_taken").cast("int").alias("n_tokens"),
                                                F.expr(f"listagg(_piece, '') WITHIN GROUP (ORDER BY `{order_col}`)").alias("chunk_text"))


def finite_vectors(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Drop vectors that are null or hold NaN (their similarity rows would be all NaN)."""
    return df.where(F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda x: F.isnan(x)))


def pool_long(chunks: DataFrame, id_cols: list[str], vec_col: str = "embedding") -> DataFrame:
    """Unweighted mean of chunk vectors, long form (id..., dim, value)."""
    return (chunks.select(*id_cols, F.posexplode(vec_col).alias("dim", "_v"))
            .groupBy(*id_cols, "dim").agg(F.avg(F.col("_v").cast("double")).alias("value")))


def pool_embeddings(chunks: DataFrame, id_cols: list[str], vec_col: str = "embedding") -> DataFrame:
    """Unweighted mean of chunk vectors as an array per id (dims re-assembled in order; an array
    holds one vector, bounded by the dimension)."""
    lg = pool_long(chunks, id_cols, vec_col)
    return (lg.groupBy(*id_cols)
            .agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_s"))
            .select(*id_cols, F.transform("_s", lambda x: x["value"]).alias(vec_col)))


def unit_vectors(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """v / |v|; a zero vector stays zero (so its cosine with anything is 0, not NaN)."""
    norm = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda acc, x: acc + x * x))
    return df.withColumn(vec_col, F.when(norm > 0, F.transform(vec_col, lambda x: x / norm))
                         .otherwise(F.transform(vec_col, lambda x: x * 0.0)))


def process_similarity(vectors: DataFrame, group_col: str = "process_name", vec_col: str = "embedding") -> DataFrame:
    """Mean pairwise cosine between the instances of every two processes (diagonal included,
    self-pairs included), i.e. the block means of the instance similarity matrix."""
    u = unit_vectors(finite_vectors(vectors, vec_col), vec_col)
    counts = u.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    sums = (u.select(group_col, F.posexplode(vec_col).alias("dim", "_v"))
            .groupBy(group_col, "dim").agg(F.sum("_v").alias("s")))
    a = sums.select(F.col(group_col).alias("process_i"), "dim", F.col("s").alias("s_i"))
    b = sums.select(F.col(group_col).alias("process_j"), "dim", F.col("s").alias("s_j"))
    dots = a.join(b, "dim").groupBy("process_i", "process_j").agg(F.sum(F.col("s_i") * F.col("s_j")).alias("dot"))
    ci = counts.select(F.col(group_col).alias("process_i"), F.col("n").alias("n_i"))
    cj = counts.select(F.col(group_col).alias("process_j"), F.col("n").alias("n_j"))
    return (dots.join(ci, "process_i").join(cj, "process_j")
            .select("process_i", "process_j", (F.col("dot") / (F.col("n_i") * F.col("n_j"))).alias("mean_cosine"),
                    "n_i", "n_j"))


# Vectors of one block of the neighbour search: a task multiplies two blocks.
BLOCK = 4096
# Digits that cosines are compared by, so that equal vectors tie whatever the order of the sums.
DIGITS = 9


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int, id_col: str = "instance_id", vec_col: str = "embedding",
                       block: int = BLOCK) -> DataFrame:
    """(query, neighbour, cosine, rank): the k most similar other vectors of every row that ``queries`` selects, exact.

    Queries and rows are dealt to blocks by the hash of their id. Every pair of a query block and a row block is one
    group, multiplied as two matrices; a group hands on the k best rows of each query, and those are ranked over all
    groups. Equal cosines (to nine digits) are ranked by id. Null and NaN vectors take no part; pairs are never stored.
    """
    # written once: ids, blocks and both sides are read from it
    unit = cut_lineage(unit_vectors(finite_vectors(vectors, vec_col), vec_col).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"),
                                                                                      queries.alias("asks")))
    n = unit.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("queries")).first()
    row_blocks, query_blocks = -(-n["rows"] // block) or 1, -(-n["queries"] // block) or 1

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select("qb", "rb", "id", "v"))

    asked = dealt(unit.where("asks"), "qb", query_blocks, "rb", row_blocks)
    rows = dealt(unit, "rb", row_blocks, "qb", query_blocks)
    kind = dict(unit.dtypes)["id"]

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "neighbour": [], "cosine": []})
        if not len(q) or not len(r):
            return empty
        r = r.sort_values("id")
        ids = r["id"].to_numpy()
        cosine = np.round(np.stack(q["v"].to_numpy()) @ np.stack(r["v"].to_numpy()).T, DIGITS)
        out = []
        for query, scores in zip(q["id"], cosine):
            # rows are in order of id, so a stable sort breaks ties by id; one more than k, for the query itself
            top = np.argsort(-scores, kind="stable")[:k + 1]
            top = top[ids[top] != query][:k]
            out.append(pd.DataFrame({"query": query, "neighbour": ids[top], "cosine": scores[top]}))
        return pd.concat(out) if out else empty

    found = asked.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(best, f"query {kind}, neighbour {kind}, cosine double")
    order = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similarity_blocks(items: DataFrame, group_col: str = "process_name", truncate: int | None = 20,
                      vec_col: str = "embedding") -> DataFrame:
    """Heatmap blocks: items sorted by process name; each (truncated) label's block starts at the
    index of its first item and ends where the next block starts. Names sharing the first
    ``truncate`` characters merge into one block (SURVEY Q7); truncate=None keeps exact names.
    Items whose vector is null or holds NaN have no place in the heatmap."""
    if vec_col in items.columns:
        items = finite_vectors(items, vec_col)
    counts = items.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(group_col).rowsBetween(Window.unboundedPreceding, -1)  # one row per process
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))
    label = truncate_label(group_col, truncate) if truncate else F.col(group_col)
    return (starts.groupBy(label.alias("block_label"))
            .agg(F.min("start").alias("block_start"), F.max(F.col("start") + F.col("n")).alias("block_end"),
                 F.sum("n").alias("n_items")))
