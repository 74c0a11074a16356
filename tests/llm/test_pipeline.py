"""The composed pipeline, row by row, against a brute-force version of its five stages."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from flowlens.llm import decontamination

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "the quick experiment number seven shows that seventeen tokens are enough to tell an item apart"


def prose(seed, n, words=4000):
    return " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, words, n))


def documents():
    near = prose(1, 90).split()
    near[40] = "other"
    leak = prose(2, 30) + "  " + ITEM.upper().replace(" ", "\n", 3) + " " + prose(3, 30)
    edited = prose(4, 30) + " " + ITEM.replace("seven ", "sevn ").replace("tokens", "tokns") + " " + prose(5, 30)
    far = prose(6, 30) + " " + ITEM[:40] + " " + prose(7, 40)
    key = prose(8, 30) + " AKIA" + "Z9" * 8 + " " + prose(9, 30)
    rows = [prose(1, 90), " ".join(near), prose(1, 90).upper(), leak, edited, far, key, key + " tail", "too short", None, "", prose(10, 3000),
            "again and again we say it " * 20, prose(11, 60), prose(11, 60), "x\n" * 40 + prose(12, 25)]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)]


def good(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(8)}
    return len(words) >= 20 and 100 * len(covered) <= 30 * len(words)


def first_of_each_class(rows):
    def shingles(text):
        words = WORD.findall(text.lower())
        return set(zip(*(words[i:] for i in range(5)), strict=False)) if len(words) >= 5 else {tuple(words)}

    label = {i: i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows}
    for _ in rows:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return [(i, t) for i, t in rows if label[i] == i]


def leaks(text):
    plain, item = re.sub(r"\s+", " ", text.lower()), re.sub(r"\s+", " ", ITEM.lower())
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in plain:
        last, row[0] = row[0], 0
        for j, d in enumerate(item, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        best = min(best, row[-1])
    return best <= int(decontamination.RATE * len(item))


def test_run_equals_brute_force(spark, tmp):
    rows = documents()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp}/documents.parquet")
    # far too few labels to certify a cutoff beyond the base rules
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    kept = [(i, t) for i, t in first_of_each_class([(i, t) for i, t, *_ in rows if good(t)]) if not leaks(t)]
    assert {i for i, _ in kept} == {0, 5, 6, 11, 13}
    # the one kind of secret that is planted
    texts = {i: re.sub(r"AKIA[A-Z0-9]{16,}", "[secret]", t) for i, t in kept}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True

    got, room = {}, Counter()
    for r in corpus_pipeline.run(spark, tmp).collect():
        got[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
        room[r.sequence_id] += r.length
    want = {}
    for i, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        pieces = sorted((v for (d, _), v in got.items() if d == i))
        assert sum(n for _, n, _ in pieces) == len(ids)
        for piece, (start, n, _) in enumerate(pieces):
            want[i, piece] = (start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes()))
            assert n == 1024 or piece == 0
    assert got == want
    assert max(room.values()) <= corpus_pipeline.SEQUENCE_TOKENS
