"""Chunking, pooling and process-level cosine against NumPy brute force (Q7, Q9)."""

import numpy as np
import pytest

from flowlens.operators import similarity as SIM


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, "x  y\n\tz"), (4, "one"), (5, " \n "), (6, "line one\nline  two\n")], "id int, text string")
    got = {(r.id, r.chunk): (r.n_tokens, r.chunk_text) for r in SIM.chunk_tokens(df, ["id"], max_tokens=2).collect()}
    assert got == {(1, 0): (2, "a b"), (1, 1): (2, " c d"), (1, 2): (1, " e"), (2, 0): (0, ""),
                   (3, 0): (2, "x  y"), (3, 1): (1, "\n\tz"), (4, 0): (1, "one"), (5, 0): (0, " \n "),
                   (6, 0): (2, "line one"), (6, 1): (2, "\nline  two\n")}
    counts = {r.id: r.num_tokens for r in SIM.token_counts(df).collect()}
    assert counts == {1: 5, 2: 0, 3: 3, 4: 1, 5: 0, 6: 4}


def test_pool(spark):
    rows = [(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (2, 0, [0.5, -0.5])]
    df = spark.createDataFrame(rows, "id int, chunk int, embedding array<double>")
    got = {r.id: r.embedding for r in SIM.pool_embeddings(df, ["id"]).collect()}
    assert got == {1: [2.0, 3.0], 2: [0.5, -0.5]}


def test_process_similarity_matches_dense_mean(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(30, 8))
    vecs[4] = 0.0                                   # Q9: zero vector -> cosine 0
    procs = [f"P{i % 4}" for i in range(30)]
    rows = [(i, procs[i], [float(x) for x in vecs[i]]) for i in range(30)]
    rows.append((99, "P0", [float("nan")] * 8))     # dropped (all-NaN row)
    df = spark.createDataFrame(rows, "id int, process_name string, embedding array<double>")
    got = {(r.process_i, r.process_j): r.mean_cosine for r in SIM.process_similarity(df).collect()}
    norms = np.linalg.norm(vecs, axis=1, keepdims=True)
    unit = np.divide(vecs, np.where(norms == 0, 1, norms))
    sim = unit @ unit.T
    for (pi, pj), v in got.items():
        a = [i for i in range(30) if procs[i] == pi]
        b = [i for i in range(30) if procs[i] == pj]
        assert v == pytest.approx(sim[np.ix_(a, b)].mean(), abs=1e-12)
    assert len(got) == 16


def test_blocks_merge_truncated(spark):
    names = ["Quarterly budget review and approval"] * 2 + ["Quarterly budget review and archive"] * 3 + ["Alpha"] * 2
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, process_name string")
    got = {r.block_label: (r.block_start, r.block_end) for r in SIM.similarity_blocks(df).collect()}
    assert got == {"Alpha": (0, 2), "Quarterly budget rev...": (2, 7)}
    exact = {r.block_label: (r.block_start, r.block_end) for r in SIM.similarity_blocks(df, truncate=None).collect()}
    assert exact["Quarterly budget review and archive"] == (4, 7)


def test_lines_give_the_same_chunks_as_the_whole_text(spark):
    import random
    rng = random.Random(2)
    rows, whole = [], []
    for doc in range(12):
        lines = [rng.choice(["one", "a b c", "  lead", "x\ty z", "", None, "w " * 20 + "end"]) for _ in range(rng.randint(1, 15))]
        rows += [(doc, i, line) for i, line in enumerate(lines)]
        whole.append((doc, "\n".join(line for line in lines if line is not None)))
    rows += [(99, i, f"t{i}") for i in range(300)]
    whole.append((99, "\n".join(f"t{i}" for i in range(300))))
    df = spark.createDataFrame(rows, "id int, seq int, text string").repartition(4)
    for m in (1, 3, 7, 1000):
        got = {(r.id, r.chunk): (r.n_tokens, r.chunk_text) for r in SIM.chunked_lines(df, ["id"], "seq", max_tokens=m).collect()}
        by_doc = {}
        for (doc, chunk), (n, text) in sorted(got.items()):
            assert n <= m and n == len(text.split())
            by_doc.setdefault(doc, []).append((chunk, text))
        for doc, text in whole:
            chunks = by_doc.get(doc, [])
            assert [c for c, _ in chunks] == list(range(len(chunks)))
            assert "".join(t for _, t in chunks) == text
            assert len(chunks) == max(1, -(-len(text.split()) // m)) or (not text and not chunks)


def test_neighbours_match_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(230, 6))
    vecs[100] = vecs[3]                             # equal vectors tie: the smaller id first
    vecs[7] = 0.0
    rows = [(i, [float(x) for x in vecs[i]]) for i in range(230)] + [(500, None), (550, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "instance_id long, embedding array<double>")
    from pyspark.sql import functions as F
    got = {(r.query, r["rank"]): (r.neighbour, r.cosine) for r in SIM.nearest_neighbours(df, F.col("instance_id") % 50 == 0, k=4, block=32).collect()}
    norm = np.linalg.norm(vecs, axis=1, keepdims=True)
    unit = np.divide(vecs, np.where(norm == 0, 1, norm))
    for q in range(0, 230, 50):
        cos = np.round(unit @ unit[q], 9)
        want = sorted((i for i in range(230) if i != q), key=lambda i: (-cos[i], i))[:4]
        assert [got[q, r][0] for r in range(1, 5)] == want
        assert [got[q, r][1] for r in range(1, 5)] == pytest.approx([cos[i] for i in want])
    assert len(got) == 20                           # 500 and 550 have no usable vector


def test_no_queries_and_no_rows(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, [1.0])], "instance_id long, embedding array<double>")
    assert SIM.nearest_neighbours(df, F.col("instance_id") % 50 == 0, k=3).count() == 0
    assert SIM.nearest_neighbours(df.limit(0), F.lit(True), k=3).count() == 0
