"""The training-data operators against brute force on a small fixture with nulls, empty texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from flowlens.llm import (
    catalog,
    chat_format,
    components,
    decontamination,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    token_counts,
    toxicity,
)
from flowlens.llm.examples import Calibration
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, n long, row string, key_a string, word string"


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, words, n))


def texts() -> list[tuple[int, str | None]]:
    base = prose(1, 200, 5000)
    near = base.replace(base.split()[50], "other", 1)
    return [(0, base), (1, near), (2, base.upper()), (3, None), (4, ""), (5, " \n\t"), (6, "two words"), (6, "two words"), (7, "Two  Words"),
            (8, prose(2, 300, 5000)), (9, prose(3, 30_000, 5000)), (10, base), (11, "x"),
            (12, f"{prose(4, 40)}\npassword = hunter22 AKIA{'A' * 16} {'0a' * 14}\nlogin: someone é https://a.example/x {'Ab1' * 13}Z")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", "k", "w") for i, t in rows], SHAPE)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).cache()


def shingles(text: str | None, size: int) -> set:
    words = WORD.findall((text or "").lower())
    return set(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else {tuple(words)} - {()}


def classes(rows, size: int, percent: int) -> dict[int, int]:
    sets = [(i, shingles(t, size)) for i, t in rows]
    label = {i: i for i, _ in sets}
    for _ in sets:
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_ngram_components(spark, docs, size, percent):
    got = ngram_join.ngram_components(docs, size, percent).collect()
    want = classes(texts(), size, percent)
    assert len(got) == len(texts())
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, size)) for i, t in texts()}
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0


def test_ngram_components_of_random_edits(spark):
    rng = np.random.default_rng(5)
    rows = []
    for family in range(12):
        words = prose(100 + family, int(rng.integers(5, 120)), 3000).split()
        for _ in range(8):
            own = list(words)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, len(own)))] = f"e{rng.integers(0, 1000)}"
            rows.append((len(rows), " ".join(own)))
    for size, percent in ((3, 90), (5, 80), (2, 60)):
        got = ngram_join.ngram_components(frame(spark, rows), size, percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == classes(rows, size, percent)


def test_ngram_components_over_several_nodes(spark, monkeypatch):
    """A block that many sets share is cut into nodes; every pair of nodes is compared."""
    monkeypatch.setattr(ngram_join, "NODE", 4)
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "CLUSTER_SETS", 9)
    monkeypatch.setattr(ngram_join, "CLUSTER_SHINGLES", 600)
    rng = np.random.default_rng(8)
    base = prose(7, 90, 3000).split()
    rows = []
    for i in range(40):
        words = list(base)
        words[int(rng.integers(0, len(words)))] = f"copy{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(i, prose(500 + i, 60, 3000)) for i in range(10)] + [(300, rows[0][1]), (301, None), (302, "")]
    for size, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(frame(spark, rows), size, percent).collect()}
        assert got == classes(rows, size, percent)
        assert len({got[100 + i] for i in range(40)}) < 40


def test_long_texts_that_share_half_are_told_apart_by_their_points(spark, monkeypatch):
    """Only linked texts are gathered with their sets: 64 counts would not tell sets of 3000 shingles that share half."""
    gathered = []

    def counted(docs, members, *rest):
        gathered.append(members.count())
        return whole(docs, members, *rest)

    whole = ngram_join.with_sets
    monkeypatch.setattr(ngram_join, "with_sets", counted)
    shared = prose(1, 1500, 10**6)
    rows = [(i, f"{shared} {prose(50 + i, 1500, 10**6)}") for i in range(20)]
    rows += [(100, rows[3][1] + " more words"), (101, "short " + prose(90, 1200, 10**6)), (102, prose(90, 1200, 10**6))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(frame(spark, rows), 5, 80).collect()}
    assert got == {i: {100: 3, 102: 101}.get(i, i) for i, _ in rows} == classes(rows, 5, 80)
    assert gathered == [4]


def test_points_fold_into_coarser_ones():
    """Sets of unlike size are compared as fine as the coarser point, and the bound is never below their overlap."""
    law = ngram_join.Similarity(80)
    for seed, n in enumerate((200, 256, 257, 3000, 4100, 20_000)):
        large = np.random.default_rng(seed).integers(0, 2**63, n).astype(np.uint64)
        small = large[:-(-n * 4 // 5)]
        points = [ngram_join.point(s, law.groups(len(s))) for s in (small, large)]
        rows = ngram_join.unpacked([ngram_join.packed(p) for p in points])
        assert rows.shape[1] == len(points[0]) and rows.sum(axis=1).tolist() == [len(small), n]
        assert np.minimum(*rows).sum() == len(small)
        assert ngram_join.tree_edges(np.array([len(small), n]), rows, law) == [(0, 1)]
    wide = ngram_join.point(np.full(5000, 7, np.uint64), 64)     # counts above one byte
    assert (ngram_join.unpacked([ngram_join.packed(wide)])[0] == wide).all()
    assert ngram_join.Similarity(100).groups(1000) == ngram_join.Similarity(99).groups(10) == ngram_join.GROUPS
    assert law.groups(10**9) == ngram_join.FINEST


def test_linked_sets_two_size_classes_apart_share_a_block():
    law = ngram_join.Similarity(60)
    for seed in range(20):
        large = np.random.default_rng(seed).integers(0, 2**63, 100).astype(np.uint64)
        assert set(ngram_join.block_keys(large[:63], law).tolist()) & set(ngram_join.block_keys(large, law).tolist())


def test_representatives_keep_one_row_of_each_class_and_all_without_words(docs):
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    want = classes(texts(), 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, c in want.items() if i == c})


def test_components_of_a_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components.components(edges).collect()} == {0}


def test_quality_counts(docs):
    got = {r["doc_id"]: r for r in quality_rules.verdicts(docs, docs.select("doc_id", F.lit(1).alias("quality"))).collect()}
    for i, text in texts():
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
        covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(8)}
        row = got[i]
        assert (row["n_words"], row["word_chars"], row["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert row["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert row["kept"] == (not row["base_failed"])


def test_certified_cutoffs_bound_false_rejections(spark):
    good = [(i, prose(i, 30)) for i in range(3000)]
    bad = [(5000 + i, " ".join(w + "!!" for w in prose(i, 30).split())) for i in range(100)]
    few = [(9000, " ".join(w + "!!" for w in prose(7, 30).split()))]
    docs = frame(spark, good + bad + few)
    labels = docs.select("doc_id", (F.col("doc_id") < 5000).cast("int").alias("quality")).where("doc_id != 9000")
    kept = {r["doc_id"] for r in quality_rules.passing(docs, labels).collect()}
    assert kept == {i for i, _ in good}
    assert quality_rules.passing(docs, labels.limit(0)).count() == 3101


def test_steps_are_certified_jointly_and_copies_count_once(spark):
    # 700 good texts, one of them with symbols and repeated 500 times; 60 bad ones full of symbols; 100 texts in a short band
    good = [(i, prose(i, 60)) for i in range(699)] + [(10_000 + k, prose(5, 60) + " ### ###") for k in range(500)]
    bad = [(2000 + i, " ".join(w + "##" for w in prose(3000 + i, 60).split())) for i in range(60)]
    short = [(4000 + i, prose(4000 + i, 30)) for i in range(100)] + [(4500, " ".join(w + "##" for w in prose(9, 30).split()))]
    docs = frame(spark, good + bad + short)
    labels = docs.select("doc_id", (~F.col("doc_id").between(2000, 2059) & (F.col("doc_id") != 4500)).cast("int").alias("quality"))
    rated = quality_rules.with_ratios(quality_rules.features(docs))
    steps = {(r["stratum"], r["step"]): r for r in quality_rules.certified_steps(rated, labels).collect()}
    level = quality_rules.DELTA / 4
    for (stratum, step), r in steps.items():
        tail = sum(math.comb(r["n_good"], j) * 0.01 ** j * 0.99 ** (r["n_good"] - j) for j in range(r["good_hit"] + 1))
        before = step == 0 or steps[stratum, step - 1]["certified"]
        assert r["certified"] == (before and tail <= level)
        assert r["n_good"] == {0: 100, 1: 700}[stratum]          # the repeated text is one trial
    assert not steps[0, 0]["certified"] and steps[1, 0]["certified"]
    kept = {r["doc_id"] for r in quality_rules.passing(docs, labels).collect()}
    assert not kept & {i for i, _ in bad} and {i for i, _ in good} <= kept and {i for i, _ in short} <= kept


def test_binomial_tail(spark):
    rows = [(0, 100, 0.05), (3, 100, 0.05), (2, 3000, 0.0025), (0, 1, 0.5)]
    for k, n, p in rows:
        want = sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_at_most(F.lit(float(k)), F.lit(float(n)), p).alias("x")).first()[0]
        assert got == pytest.approx(want, rel=1e-6) or k >= n * p


def test_secret_spans_and_linking(docs):
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.secret_spans(docs).collect()}
    text = dict(texts())[12]
    kinds = {k: text[a:b] for k, a, b in got[12]}
    assert kinds["assign"] == "password = hunter22" and kinds["access"] == "AKIA" + "A" * 16 and kinds["hex"] == "0a" * 14
    assert kinds["id"] == "login: someone" and kinds["endpoint"] == "https://a.example/x" and kinds["blob"] == "Ab1" * 13 + "Z"
    assert all(not spans for i, spans in got.items() if i != 12)


def test_lone_weak_parts_are_not_reported(spark):
    rows = [(1, "login: someone"), (2, "https://a.example/x"), (3, "Ab1" * 13 + "Z"), (4, "login: someone" + " x" * 400 + " secret: abcdefgh")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.secret_spans(frame(spark, rows)).collect()}
    assert got == {1: [], 2: [], 3: [], 4: ["assign"]}


def test_redaction_leaves_the_rest(docs):
    out = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    assert "hunter22" not in out[12] and "AKIA" not in out[12] and "é" in out[12]
    assert all(out[i] == t for i, t in texts() if i != 12)


def distance_within(pattern: str, text: str) -> int:
    last = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        row = [i + 1]
        for j, c in enumerate(text):
            row.append(min(last[j] + (p != c), last[j + 1] + 1, row[j] + 1))
        last = row
    return min(last)


def test_decontamination_against_plain_distance(spark):
    item = prose(9, 20)
    off = item.replace("w1", "v1").upper()
    rows = [(1, f"before {item} after"), (2, f"before {off}\nafter"), (3, prose(10, 60)), (4, None), (5, item[:len(item) // 2]), (6, item.replace(" ", " \n "))]
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, " ", "x"), (1, item, "y")], "item_id long, text string, doc_id string")
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["distance"] for r in decontamination.contaminated(docs, items).collect()}
    flat = decontamination.normal(item)
    want = {i: distance_within(flat, decontamination.normal(t or "")) for i, t in rows}
    assert got == {i: d for i, d in want.items() if d <= int(decontamination.RATE * len(flat))} and 1 in got and 6 in got and 3 not in got
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - set(got)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", catalog.ADDED_TEXT), (1, 1, "assistant", "</turn>\n<turn assistant>\\"), (2, 0, None, None), (2, 1, "assistant", "é" * 5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(chat_format.text_parts(turns))).collect()}
    for conv in (1, 2):
        own = [r for r in rows if r[0] == conv]
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_token_counts_and_packing(spark, docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(catalog.tokenizer_path())
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in texts()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, catalog.tokenizer_path()).collect()} == {i: len(x) for i, x in ids.items()}
    pieces = packing.pack_documents(docs, catalog.tokenizer_path(), 256).collect()
    filled: dict[int, list] = {}
    for r in pieces:
        own = np.array([*ids[r["doc_id"]], 2], "<u4")[r["start"]:r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in pieces) == sum(len(ids[i]) + 1 for i, _ in texts())


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_under_tight_document_and_cost_capacities(rule):
    full, weights = (100, 3, 2600), (1.0, 0.05, 0.05)
    lengths = np.sort(np.random.default_rng(6).integers(1, 51, 300))[::-1]
    bins, offsets = packing.best_fit(lengths, *full, weights, rule)
    left: list[list[int]] = []
    for length, own, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        need = (length, 1, length * length)
        rests = {b: [x - y for x, y in zip(now, need, strict=True)] for b, now in enumerate(left)}
        rated = {b: sum(w * (r / f) ** 2 for w, r, f in zip(weights, rest, full, strict=True)) if rule == "norm"
                 else -sum(w * n * x / f ** 2 for w, n, x, f in zip(weights, need, left[b], full, strict=True))
                 for b, rest in rests.items() if min(rest) >= 0}
        if own == len(left):
            assert not rated
            left.append(list(full))
        assert offset == full[0] - left[own][0]
        if rated:
            assert rated[own] <= min(rated.values()) + 1e-9
        left[own] = [x - y for x, y in zip(left[own], need, strict=True)]
        assert min(left[own]) >= 0
    assert any(x[1] == 0 and x[0] > 0 and x[2] > 0 for x in left) and any(x[1] > 0 and x[2] < 100 for x in left)


def test_shards_keep_equal_texts_together_and_near_equal(spark):
    rows = [(i, prose(i, 5 + i % 40)) for i in range(400)] + [(1000 + i, "same") for i in range(5)]
    got = sharding.shard_rows(frame(spark, rows), 8).collect()
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len({r["shard"] for r in got if r["doc_id"] >= 1000}) == 1
    assert max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values()) / 8


def labelled(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        words = prose(i, int(rng.integers(20, 80))).split()
        if i % 4 == 0:
            words[3] = words[9] = "vile"
        rows.append((i, " ".join(words)))
    docs = frame(spark, [*rows, (700, None), (701, ""), (702, "vile"), (702, "vile")])
    return docs, frame(spark, rows).select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic"))


def test_toxicity_on_unseen_rows(spark):
    docs, labels = labelled(spark)
    got = toxicity.toxicity(docs, labels, F.col("doc_id") % 3 != 1).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0 if r["doc_id"] < 700 else r["doc_id"] == 702) for r in got)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_toxicity_scores_equal_a_plain_computation(spark):
    """Frequencies, weights, cosines with every example, votes and calibration, without any index."""
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels, F.col("doc_id") % 3 != 1).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}

    def terms(text):
        return Counter(t for w in re.findall(r"[^\W\d_]+", text.lower()) for t in ([w, "#" + w[:5]] if len(w) > 5 else [w]))

    rows = docs.collect()
    counted = {i: terms(t) for i, t in texts.items()}
    learnt = [i for i in marks if i % 3 != 1]
    held = Counter(t for i in learnt for t in counted[i])
    toxic = Counter(t for i in learnt if marks[i] for t in counted[i])
    share = sum(marks[i] for i in learnt) / len(learnt)
    frequency = Counter(t for r in rows for t in terms(r["text"] or ""))

    def ratio(n, n1):
        return 2 * sum(a * math.log(a / (n * e)) for a, e in ((n1, share), (n - n1, 1 - share)) if a)

    weight = {t: math.log1p(len(rows) / (1 + frequency[t])) * (toxicity.LEAST + max(ratio(n, toxic[t]), 0)) for t, n in held.items()}

    def vector(c):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in c.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(counted[i]) for i in learnt}

    def vote(v, without=None):
        near = sorted(((sum(x * vectors[j].get(t, 0) for t, x in v.items()), j) for j in learnt if j != without), reverse=True)[:toxicity.NEIGHBOURS]
        near = [(c, j) for c, j in near if c > 0]
        return near, sum(marks[j] / (toxicity.SOFT + 1 - c) for c, j in near) / sum(1 / (toxicity.SOFT + 1 - c) for c, _ in near)

    votes = {i: vote(vectors[i], i)[1] for i in learnt}
    calibration = Calibration(np.array([votes[i] for i in learnt]), np.array([float(marks[i]) for i in learnt]))
    for i in range(1, 600, 30):
        near, value = vote(vector(counted[i]))
        assert got[i]["score"] == pytest.approx(float(calibration(np.array([value]))[0]), abs=1e-4), i
        assert [e["similarity"] for e in got[i]["evidence"]] == pytest.approx([c for c, _ in near[:toxicity.EVIDENCE]], abs=1e-5)


def test_toxicity_spread_over_rare_word_forms(spark):
    rng = np.random.default_rng(8)

    def made(n: int) -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, n))

    pool, rows = [made(7) for _ in range(200)], []
    for i in range(300):
        words = [pool[k] for k in rng.integers(0, 200, 30)]
        # three forms of one stem, each in no other text
        words[4:7] = [("bomente" if i % 4 == 0 else "casita") + made(4) for _ in range(3)]
        rows.append((i, " ".join(words)))
    docs = frame(spark, rows)
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic"))
    got = toxicity.toxicity(docs, labels, F.col("doc_id") % 3 != 1).collect()
    assert {r["doc_id"] for r in got if r["score"] >= 0.7} == {i for i, _ in rows if i % 4 == 0}


def test_known_words_are_looked_up_once():
    cutter = toxicity.Cutter(["#bombe", "#casit", "ab", "bombed", "casitas", "one"])
    text = "Bombed bombers, bombed; casitas one AB ab abc bombe unknownword 12 casitos"
    got = cutter.counts(text)
    assert dict(zip(*(x.tolist() for x in got), strict=True)) == {0: 3, 1: 2, 2: 2, 3: 2, 4: 1, 5: 1}
    assert got[0].dtype == np.int32 and (np.diff(got[0]) > 0).all()
    assert [len(x) for x in cutter.counts(None)] == [len(x) for x in cutter.counts("12 zzz")] == [0, 0]
    cutter.known.stems = {}
    assert dict(zip(*(x.tolist() for x in cutter.counts("bombed casitas")), strict=True)) == {0: 1, 1: 1, 3: 1, 4: 1}


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(11)
    vectors = []
    for _ in range(500):
        at = np.sort(rng.choice(60, size=int(rng.integers(1, 9)), replace=False))
        weight = rng.random(len(at)) + 0.1
        vectors.append((at, weight / np.sqrt((weight ** 2).sum())))
    dense = np.zeros((500, 60))
    for i, (at, weight) in enumerate(vectors):
        dense[i, at] = weight
    assert toxicity.DENSE_SHARE > 1
    for share in (2, 32, 10**9):           # no dense rows, some, all
        toxicity.DENSE_SHARE, before = share, toxicity.DENSE_SHARE
        try:
            index = pickle.loads(pickle.dumps(toxicity.BlockMaxIndex(vectors, 60)))
        finally:
            toxicity.DENSE_SHARE = before
        asked = list(range(0, 500, 7))
        for i, (numbers, got) in zip(asked, index.nearest_of_all([vectors[i] for i in asked], 15, asked), strict=True):
            cosine = dense @ dense[i]
            cosine[i] = 0
            want = np.sort(cosine)[::-1][:15]
            assert np.allclose(got, want[want > 0][:15])
            assert np.allclose(got, cosine[numbers]) and i not in numbers


def test_quality_on_unseen_rows(spark):
    rows = [(i, " ".join(w + "!!" for w in prose(i, 60).split()) if i % 3 == 0 else prose(i, 60)) for i in range(400)]
    docs = frame(spark, [*rows, (900, None), (901, "")])
    labels = docs.where("doc_id < 400").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    got = quality_classifier.quality(docs, labels, F.col("doc_id") % 4 != 2).collect()
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 3 != 0) for r in got if r["doc_id"] < 400)
    assert {r["score"] for r in quality_classifier.quality(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_calibration_is_monotone():
    rng = np.random.default_rng(2)
    votes = rng.random(500)
    curve = Calibration(votes, (rng.random(500) < votes).astype(float))
    assert (np.diff(curve(np.linspace(0, 1, 50))) >= 0).all()


def test_pipeline_stages_keep_the_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
