"""op11 to op13 and their operators against brute force, on rows with nulls, ties, repeats, odd texts and other columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowlens.llm import catalog, fingerprints, oracles, prefix_trie, resampling

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, copies int, piece string"
DOCS = "doc_id long, text string, row string, place int, weight double, score string, rank string, `n_words` int"


def table(spark, root, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/{name}.parquet")


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    shared = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[:shared[c]] + own[c][shared[c]:] for c in own}


def trie_rows(convs):
    """The contract, plainly."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    for n in members:
        if n:
            kids[n[:-1]].add(n)
    leaves, saved = Counter(), Counter()
    for n in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(members[n]) - 1) * words
            leaves[n[:d]] += n not in kids
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, ())), leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items())


def conversations(seed):
    rng, rows = random.Random(seed), []
    for c in range(70):
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["ok then", "a b  c", "", None, "żó łw"])))
    rows += [(100, t, "user", f"deep {t}") for t in range(60)]                     # one long chain
    rows += [(101, 5, "user", "same turn"), (101, 5, "user", "same turn"), (101, 5, "assistant", "same turn"), (101, None, "user", "first")]
    rows += [(None, 1, "user", "belongs to none"), (102, None, None, None), (141, 0, "user", "no base, all cut off?")]
    return [(*r, "x", 1, 7, "y") for r in rows]


@pytest.mark.parametrize("piece", [2, 4096])
def test_op11_equals_the_contract(spark, tmp, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = conversations(piece)
    table(spark, tmp, "conversations", rows, SCHEMA)
    got = Counter(tuple(r) for r in catalog.op11_prefix_trie(spark, tmp).collect())
    assert got == trie_rows(rebuilt(rows))


def test_op11_on_an_empty_table_and_turnless_conversations(spark, tmp):
    table(spark, tmp, "conversations", [], SCHEMA)
    assert catalog.op11_prefix_trie(spark, tmp).count() == 0
    # ids whose first turn is replaced by a base that is not there: some are left without a turn
    rows = [(c, 0, "user", "hello", None, None, None, None) for c in range(201, 215)]
    table(spark, tmp + "/b", "conversations", rows, SCHEMA)
    assert any(not v for v in rebuilt(rows).values())
    assert Counter(tuple(r) for r in catalog.op11_prefix_trie(spark, tmp + "/b").collect()) == trie_rows(rebuilt(rows))


def test_contraction_of_a_long_chain_a_star_and_a_random_tree(spark):
    rng = random.Random(5)
    trees = {"chain": {i: i - 1 if i else None for i in range(120)}, "star": {i: 0 if i else None for i in range(90)},
             "random": {i: rng.randrange(max(0, i - 4), i) if i else None for i in range(150)}}
    for name, parent in trees.items():
        value = {i: rng.randint(0, 9) for i in parent}
        want = dict(value)
        for i in sorted(parent, reverse=True):
            if parent[i] is not None:
                want[parent[i]] += want[i]
        nodes = spark.createDataFrame([(i, p, value[i]) for i, p in parent.items()], "node long, parent long, v long").repartition(3)
        got = {r.node: r.v for r in prefix_trie.subtree_totals(nodes, ["v"]).collect()}
        assert got == want, name


def documents(seed):
    rng = random.Random(seed)
    texts = ["\n".join(" ".join(rng.choice(["alpha", "Beta", "żółw", "d'or", "e2e", "𝒳y"]) for _ in range(rng.randint(1, 30)))
                       for _ in range(rng.randint(1, 25))) for _ in range(60)]
    texts += ["", None, " ", "x", "żó", texts[0], texts[0], "\n\n  \n", "long line " * 900, "\n".join(f"line {i}" for i in range(3000)), "tab\tand\r\nreturn"]
    return [(i * 3, t, "clash", 1, 2.0, "s", "r", 9) for i, t in enumerate(texts)]


def pieces(text):
    return {p.strip(" \t\r") for p in re.findall(rf"[^\n]{{1,{fingerprints.PARAGRAPH}}}", text)} - {""}


def likeness(a, b):
    return len(pieces(a) & pieces(b)) / len(pieces(a) | pieces(b)) if pieces(a) | pieces(b) else 1.0


def edits(rows):
    ordered = sorted((r[0], r[1] or "") for r in rows)
    for (doc, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        yield doc, text, following, text[:len(text) - half] + following[:half]


def test_op12_equals_the_contract(spark, tmp):
    rows = documents(1)
    table(spark, tmp, "documents", rows, DOCS)
    got = {r.doc_id: r for r in catalog.op12_document_fingerprints(spark, tmp).collect()}
    assert len(got) == len(rows)
    prints = defaultdict(set)
    for doc, text, following, edited in edits(rows):
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(text, edited), abs=1e-12) and r.near_next == pytest.approx(likeness(text, following), abs=1e-12)
        prints[text].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
    assert all(len(found) == 1 for found in prints.values())           # equal texts, equal fingerprints
    assert len({f for found in prints.values() for f in found}) > 60


def test_op12_one_row_repeated_rows_null_ids_and_an_empty_table(spark, tmp):
    text = "one\ntwo\nthree\nfour"
    for name, rows in {"empty": [], "one": [(7, text)], "repeated": [(7, text)] * 3 + [(None, text), (None, None)]}.items():
        table(spark, f"{tmp}/{name}", "documents", [(*r, "", 0, 0.0, "", "", 0) for r in rows], DOCS)
        got = catalog.op12_document_fingerprints(spark, f"{tmp}/{name}").collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        if name == "one":
            assert got[0].near_next == 1.0 and got[0].edited_sha256 == hashlib.sha256((text[:-9] + text[:9]).encode()).hexdigest()
        if name == "repeated":                                          # the order is null, null, 7, 7, 7 and back to null
            assert sum(r.near_next == 1.0 for r in got if r.doc_id == 7) >= 2


def test_fingerprints_number_rows_that_have_no_key(spark):
    rows = documents(2)[:40]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    for doc, text, following, edited in edits(rows):
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc].near_next == pytest.approx(likeness(text, following), abs=1e-12)


def test_peeling_recovers_differences_of_any_size(spark):
    rng = random.Random(4)
    pairs = []
    for i, size in enumerate([0, 1, 2, 5, 10, 20, 40, 200, 3000]):
        both = [rng.getrandbits(63) for _ in range(size)]
        pairs.append((i, both + [rng.getrandbits(63) for _ in range(size // 2)], both + [rng.getrandbits(63) for _ in range(size)]))
    got = {r.pair: r.likeness for r in fingerprints.likenesses(spark.createDataFrame(pairs, "pair long, a array<long>, b array<long>")).collect()}
    assert got == {i: pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0) for i, a, b in pairs}


def test_a_small_difference_comes_out_of_the_first_sketch(spark):
    a = [i * 7919 + 13 for i in range(500)]
    pair = spark.createDataFrame([(0, 0, a, a[:-3] + [1, 2])], "pair long, salt int, a array<long>, b array<long>")
    r = fingerprints.tried(pair).first()
    assert r.solved and (r.only_a, r.only_b) == (3, 2) and r.a is None   # 500 digests, a sketch of 24 cells


# ---------------------------------------------------------------- op13
def test_crcs_of_runs_come_from_prefixes(monkeypatch):
    monkeypatch.setattr(resampling, "PART", 50)
    text = " ".join(f"Wörd{i % 17} x{'y' * (i % 40)}--{i}" for i in range(300)) + "\x00tail" + "z" * 5000
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    scans = [resampling.scanned(t) for t in (text, "", None, "one two", text[:40])]
    assert len(scans[0][0]) == len(words)
    for shortest, longest in ((1, 1), (1, 3), (2, 2), (4, 400)):
        found = resampling.run_crcs(scans, shortest, longest)
        want = [zlib.crc32(" ".join(words[i:i + n]).encode()) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]
        assert found[0].tolist() == want and len(found) == 5 and not len(found[1]) and not len(found[2])
        pair = [zlib.crc32(w.encode()) for w in ("one", "two")] * (shortest == 1) + [zlib.crc32(b"one two")] * (shortest <= 2 <= longest)
        assert found[3].tolist() == pair


def resampled(rows, target):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        return [zlib.crc32(w.encode()) % 10000 for w in word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]

    docs = [(r[0], features(r[1])) for r in rows]
    s, t = Counter(b for _, f in docs for b in f), Counter(b for text in target for b in features(text))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    out = []
    for doc, f in docs:
        h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(able[:10 * len(able) // 100])}
    return Counter((*r, rank.get(r[0])) for r in out)


def test_op13_equals_the_contract(spark, tmp):
    rows = documents(3) + [(1000 + i, f"{'alpha ' * (i % 40)} beta {i}", "", 0, 0.0, "", "", 0) for i in range(200)]
    target = ["alpha alpha beta", None, "", "gamma"]
    table(spark, tmp, "documents", rows, DOCS)
    table(spark, tmp, "benchmark", [(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, bucket string")
    got = catalog.op13_importance_resampling(spark, tmp).drop("n_words").collect()
    assert Counter(tuple(r) for r in got) == resampled(rows, target)
    assert sum(r.rank is not None for r in got) >= 10


def test_op13_empty_tables_null_ids_and_repeated_rows(spark, tmp):
    schema = "item_id long, text string"
    text = " ".join(f"w{i}" for i in range(30))
    for name, rows in {"empty": [], "short": [(1, "too few words")], "repeated": [(5, text)] * 40 + [(None, text)] * 10 + [(6, None)]}.items():
        table(spark, f"{tmp}/{name}", "documents", [(*r, "", 0, 0.0, "", "", 0) for r in rows], DOCS)
        table(spark, f"{tmp}/{name}", "benchmark", [], schema)
        got = catalog.op13_importance_resampling(spark, f"{tmp}/{name}").collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        assert sorted(r.rank for r in got if r.rank is not None) == list(range(1, 10 * sum(r[1] == text for r in rows) // 100 + 1))


def test_drawn_rows_lean_towards_the_target_and_runs_of_words_count(spark):
    rows = [(i, " ".join(["cat", "dog", "sat"][(i % 2) * 2:][j % 2 if i % 2 == 0 else 0] for j in range(30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("cat dog cat dog",)], "text string")
    ranks = resampling.resample(docs, target, percent=20, seed=1, min_words=20, longest=2, buckets=1 << 20)
    assert {r.n_features for r in ranks.collect()} == {59}
    kept = resampling.drawn(docs, ranks).collect()
    assert len(kept) == 80 and sum("cat" in r.text for r in kept) > 60
    assert set(kept[0].asDict()) == {"doc_id", "text"}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracles_agree_with_the_queries(spark, tmp, name):
    duckdb = pytest.importorskip("duckdb")
    table(spark, tmp, "conversations", conversations(9), SCHEMA)
    table(spark, tmp, "documents", documents(9), DOCS)
    table(spark, tmp, "benchmark", [(1, "alpha beta gamma"), (2, None)], "item_id long, text string")
    table(spark, tmp, "labels", [(i * 3, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    for t in ("conversations", "documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp}/{t}.parquet/*.parquet')")
    rel = con.sql(oracles.ORACLES[name])
    spark_rows = catalog.QUERIES[name](spark, tmp)
    order = sorted(spark_rows.columns)
    assert sorted(rel.columns) == order
    assert Counter(tuple(r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall()) == Counter(tuple(r) for r in spark_rows.select(*order).collect())


def test_every_shift_is_what_zlib_computes():
    rng = np.random.default_rng(0)
    for length in (0, 1, 5, 300, 70_000):
        a, b = rng.bytes(11), rng.bytes(length)
        moved = resampling.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([length]))[0]
        assert int(moved) ^ zlib.crc32(b) == zlib.crc32(a + b)
