"""Chat formatting with typed content parts.

A turn is an ordered list of parts. A visitor flattens them: text is escaped, an image, audio or document
part becomes a numbered placeholder such as ``<image 0>``, and its reference and expanded token count
are recorded. A turn reads ``<turn ROLE>TEXT</turn>`` and a line feed. Escaping puts a backslash
before every backslash, ``<`` and ``>`` of a role or text, so a control string can never stand inside one, and
reading back is exact. The loss mask is a list of code point spans over the assistant's text.

One row goes out per turn, with its place in the conversation's text, so a task holds one batch of
turns at a time however long a conversation is; rows of a conversation arrive sorted in one partition.

Contract. Rows of a conversation are ordered by turn, then role, then parts; a null turn comes first.
Null texts and roles are empty, a null part list is an empty turn, an unknown kind becomes an
``attachment`` of no tokens. Rows without a conversation id form one conversation. Repeated rows are repeated turns. An
empty table gives an empty table. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = ("conv_id string, turn_index long, formatted string, offset long, loss array<struct<start:long,end:long>>, "
             "attachments array<struct<number:int,kind:string,ref:string,tokens:long>>, attachment_tokens long")

IMAGE_PATCH = 28
AUDIO_TOKENS_A_SECOND = 25
DOCUMENT_TOKENS_A_PAGE = 512
TURN = re.compile(r"<turn ((?:[^\\<>]++|\\.)*+)>((?:[^\\<>]++|\\.|<(?:image|audio|document|attachment) \d+>)*+)</turn>\n", re.S)
PLACEHOLDER = re.compile(r"(?:[^\\<>]++|\\.)++|<[a-z]+ \d+>", re.S)


def escaped(text: str) -> str:
    return re.sub(r"([\\<>])", r"\\\1", text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class PartVisitor:
    """Flattens the parts of one conversation; attachments are numbered through all its turns."""

    def __init__(self) -> None:
        self.number = 0

    def flatten(self, parts) -> tuple[str, list[tuple[int, int]], list[dict]]:
        """(flat text, spans of its text parts, attachments) of one turn."""
        out, spans, attachments, at = [], [], [], 0
        for part in parts if parts is not None else ():
            flat, attachment = getattr(self, f"visit_{part['kind']}", self.visit_unknown)(part)
            if attachment is None and flat:
                spans.append((at, at + len(flat)))
            elif attachment is not None:
                attachments.append(attachment)
            out.append(flat)
            at += len(flat)
        return "".join(out), spans, attachments

    def visit_text(self, part) -> tuple[str, None]:
        return escaped(part["text"] or ""), None

    def visit_image(self, part) -> tuple[str, dict]:
        patches = math.ceil((part["width"] or 0) / IMAGE_PATCH) * math.ceil((part["height"] or 0) / IMAGE_PATCH)
        return self.attach("image", part, patches)

    def visit_audio(self, part) -> tuple[str, dict]:
        return self.attach("audio", part, math.ceil((part["seconds"] or 0) * AUDIO_TOKENS_A_SECOND))

    def visit_document(self, part) -> tuple[str, dict]:
        return self.attach("document", part, (part["pages"] or 0) * DOCUMENT_TOKENS_A_PAGE)

    def visit_unknown(self, part) -> tuple[str, dict]:
        return self.attach("attachment", part, 0)

    def attach(self, kind: str, part, tokens: int) -> tuple[str, dict]:
        number, self.number = self.number, self.number + 1
        return f"<{kind} {number}>", {"number": number, "kind": kind, "ref": part["ref"], "tokens": tokens}


def text_parts(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """``turns`` with a ``parts`` column that holds the text as the only part."""
    return turns.withColumn("parts", F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))))


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, parts), in order within sorted partitions."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.col("parts").cast(f"array<{PART}>").alias("parts"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, visitor, index, offset = object(), PartVisitor(), 0, 0
        for batch in batches:
            out = []
            for conv_id, role, parts in zip(batch["conv_id"], batch["role"], batch["parts"], strict=True):
                if conv_id != now:
                    now, visitor, index, offset = conv_id, PartVisitor(), 0, 0
                flat, spans, attachments = visitor.flatten(parts)
                head = f"<turn {escaped(role)}>"
                text = f"{head}{flat}</turn>\n"
                begin = offset + len(head)
                loss = [{"start": begin + a, "end": begin + b} for a, b in spans] if role == loss_role else []
                out.append((conv_id, index, text, offset, loss, attachments, sum(a["tokens"] for a in attachments)))
                index, offset = index + 1, offset + len(text)
            yield pd.DataFrame(out, columns=["conv_id", "turn_index", "formatted", "offset", "loss", "attachments", "attachment_tokens"])

    return rows.select("conv_id", "role", "parts").mapInPandas(run, FORMATTED).withColumn("conv_id", F.col("conv_id").cast(kind))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; placeholders stay, escapes are undone."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescaped(m[1]), "".join(x if x[0] == "<" else unescaped(x) for x in PLACEHOLDER.findall(m[2]))))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from ``format_turns``: turns, digest of roles and texts, digest of what the loss mask covers, length."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachment_tokens"]
        rows = (row for batch in batches for row in zip(
            batch["conv_id"], batch["formatted"], batch["offset"], batch["loss"], batch["attachment_tokens"], strict=True))
        done = []
        for conv_id, same in groupby(rows, key=lambda row: row[0]):
            turns, masked, state = hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
            for _, text, offset, loss, tokens in same:
                for role, content in parse(text):
                    turns.update(f"{role}\n{content}\n".encode())
                    state[0] += 1
                for span in loss:
                    kept = unescaped(text[span["start"] - offset:span["end"] - offset])
                    masked.update(kept.encode())
                    state[1] += len(kept)
                state[2] += len(text)
                state[3] += tokens
            done.append((conv_id, state[0], turns.hexdigest(), state[1], masked.hexdigest(), state[2], state[3]))
            if len(done) >= 10_000:
                yield pd.DataFrame(done, columns=names)
                done = []
        if done:
            yield pd.DataFrame(done, columns=names)

    rows = formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "offset", "loss", "attachment_tokens")
    return rows.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                 "formatted_chars long, attachment_tokens long").withColumn("conv_id", F.col("conv_id").cast(kind))
