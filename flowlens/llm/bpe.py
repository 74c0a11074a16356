"""Byte-level BPE over Arrow batches: pieces are cut with array operations, repeated pieces are encoded once.

The tokenizer file is the one of the public ``tokenizers`` library. Its byte-level splitting rule works
on runs of letters, digits, white space and other characters, so the cut points of a whole block of text
follow from comparisons of neighbouring code points. Each piece gets a 64-bit fingerprint; a
fixed-size table in the worker remembers the ids of pieces met before, and only the others go through
the library's merges. Two pieces with one fingerprint would share ids: about 1e-6 likely in ten million pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

# Fixed values of the byte-level splitting rule.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

SPACE, LETTER, DIGIT, OTHER = range(4)
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
TABLE_BITS = 20
POOL_IDS = 6_000_000
BLOCK_CHARS = 1 << 19


def class_table() -> np.ndarray:
    """Class of every code point: white space, letter, digit or other."""
    import regex
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for run in regex.finditer(pattern, points):
            first, last = run.start(), run.end() - 1
            table[ord(points[first]):ord(points[last]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[list(WHITE_SPACE)] = SPACE
    return table


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 as it is, others from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


def piece_starts(points: np.ndarray, kinds: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Boolean per code point: does a piece of the splitting rule begin here? Texts never share a piece."""
    n = len(points)
    first = np.zeros(n, bool)
    first[text_starts] = True
    change = first.copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    blank = kinds == SPACE
    gap = points == 0x20
    starts = change.copy()
    # a word takes the one blank before it; other white space before a word stands alone
    before_word = change[1:] & ~first[1:] & blank[:-1] & ~blank[1:]
    at = np.flatnonzero(before_word)
    starts[at] = True
    starts[at + 1] = ~gap[at]
    # contractions: an apostrophe that begins a piece takes its ending along
    for p in np.flatnonzero((points == 0x27) & starts):
        stop = min(p + 3, n)
        inside = np.flatnonzero(first[p + 1:stop])
        stop = p + 1 + inside[0] if len(inside) else stop
        tail = "".join(map(chr, points[p:stop]))
        for ending in CONTRACTIONS:
            if tail.startswith(ending):
                starts[p + 1:p + len(ending)] = False
                if p + len(ending) < n:
                    starts[p + len(ending)] = True
                break
    return starts


def safe_cuts(text: str, size: int) -> list[str]:
    """Split a long text where no piece of the splitting rule can span: one blank between two ASCII letters."""
    if len(text) <= size:
        return [text]
    out, begin = [], 0
    while len(text) - begin > size:
        at = text.find(" ", begin + size)
        while at != -1 and not (at + 1 < len(text) and text[at - 1].isascii() and text[at - 1].isalpha()
                                and text[at + 1].isascii() and text[at + 1].isalpha()):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        out.append(text[begin:at])
        begin = at
    out.append(text[begin:])
    return out


class Encoder:
    """Encoder of one worker process; ``of(path)`` keeps it between batches and tasks."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = byte_letters()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.kinds = class_table()
        self.power = self.inverse = np.ones(1, np.uint64)
        self.reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def reset(self) -> None:
        size = 1 << TABLE_BITS
        self.keys = np.zeros(size, np.uint64)
        self.begin = np.zeros(size, np.int64)
        self.count = np.zeros(size, np.int32)
        self.pool = np.zeros(POOL_IDS, np.int32)
        self.used = 0

    def grow_powers(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, BLOCK_CHARS * 2)
            self.power, self.inverse = (np.full(size, base, np.uint64) for base in (ODD, pow(int(ODD), -1, 1 << 64)))
            for steps in (self.power, self.inverse):
                steps[0] = 1
                np.cumprod(steps, out=steps)

    def fingerprints(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        self.grow_powers(len(points) + 1)
        value = (points.astype(np.uint64) + np.uint64(1)) * MIX
        value ^= value >> np.uint64(29)
        value *= self.power[:len(points)]
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        key = (total[end] - total[begin]) * self.inverse[begin]
        key ^= key >> np.uint64(32)
        key *= MIX
        key ^= key >> np.uint64(29)
        return key | np.uint64(1)

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, first id in the pool, id count) of every piece of the texts, in order."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(length) - length
        filled = first[length > 0]
        starts = piece_starts(points, self.kinds[points], filled)
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], len(points))
        owner = np.flatnonzero(length > 0)[np.searchsorted(filled, begin, side="right") - 1]
        key = self.fingerprints(points, begin, end)
        slot = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != key)
        piece_first, piece_count = self.begin[slot], self.count[slot]
        if len(miss):
            fresh, at, back = np.unique(key[miss], return_index=True, return_inverse=True)
            spots = miss[at]
            words = [joined[s:e] for s, e in zip(begin[spots].tolist(), end[spots].tolist(), strict=True)]
            ids = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))] for w in words]
            counts = np.fromiter(map(len, ids), np.int32, len(ids))
            need = int(counts.sum())
            if self.used + need > len(self.pool):
                self.reset()
                if need > len(self.pool):
                    self.pool = np.zeros(need, np.int32)
                return self.block(texts)
            self.pool[self.used:self.used + need] = np.fromiter((i for x in ids for i in x), np.int32, need)
            offsets = self.used + np.cumsum(counts) - counts
            self.used += need
            place = slot[spots]
            self.keys[place], self.begin[place], self.count[place] = fresh, offsets, counts
            # pieces of this block that share a table place keep their own values
            piece_first[miss], piece_count[miss] = offsets[back], counts[back]
        return owner, piece_first, piece_count

    def units(self, texts: list[str | None], size: int = BLOCK_CHARS) -> Iterator[tuple[list[int], list[str], list[int]]]:
        """Blocks of about ``size`` characters: document of each part, the part, and 1 for a special string."""
        rows: list[int] = []
        parts: list[str] = []
        marks: list[int] = []
        filled = 0
        for row, text in enumerate(texts):
            for part, mark in self.split_special(text or ""):
                for chunk in [part] if mark else safe_cuts(part, size):
                    if filled and filled + len(chunk) > size:
                        yield rows, parts, marks
                        rows, parts, marks, filled = [], [], [], 0
                    rows.append(row)
                    parts.append(chunk)
                    marks.append(mark)
                    filled += len(chunk)
        if rows:
            yield rows, parts, marks

    def split_special(self, text: str) -> list[tuple[str, int]]:
        """Special strings inside a text are single ids, as the library's default has it."""
        out = [(text, 0)]
        for name in self.special:
            if name in text:
                out = [(piece, int(mark or (i % 2)))
                       for part, mark in out
                       for i, piece in enumerate([part] if mark else self.interleave(part, name))]
        return out

    @staticmethod
    def interleave(text: str, name: str) -> list[str]:
        parts = text.split(name)
        return [x for p in parts[:-1] for x in (p, name)] + [parts[-1]]

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        total = np.zeros(len(texts), np.int64)
        for rows, parts, marks in self.units(texts):
            row = np.array(rows)
            mark = np.array(marks, bool)
            np.add.at(total, row[mark], 1)
            owner, _, count = self.block(["" if m else p for p, m in zip(parts, marks, strict=True)])
            total += np.bincount(row[owner], count, len(texts)).astype(np.int64)
        return total

    def ids(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each text, in order; a text in several blocks is put together."""
        row_now, gathered = 0, []
        for rows, parts, marks in self.units(texts):
            owner, begin, count = self.block(["" if m else p for p, m in zip(parts, marks, strict=True)])
            ends = np.cumsum(count)
            step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
            flat = self.pool[np.repeat(begin, count) + step]
            size = np.bincount(owner, count, len(parts)).astype(np.int64)
            stop = np.cumsum(size)
            for part, row in enumerate(rows):
                while row_now < row:
                    yield row_now, np.concatenate(gathered) if gathered else np.zeros(0, np.int32)
                    row_now, gathered = row_now + 1, []
                gathered.append(np.array([self.special[parts[part]]], np.int32) if marks[part]
                                else flat[stop[part] - size[part]:stop[part]])
        while row_now < len(texts):
            yield row_now, np.concatenate(gathered) if gathered else np.zeros(0, np.int32)
            row_now, gathered = row_now + 1, []
