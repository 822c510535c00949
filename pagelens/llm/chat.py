"""Chat formatting with a loss mask aligned to token offsets.

Rows are sorted into conversations by Spark and rendered as a stream. A rendered
part is encoded once, with offsets; the spans of assistant texts are intersected
with the token spans by binary search. The control strings are added tokens of
the tokenizer, so a token never crosses the edge of a text, and control strings
inside texts and roles are escaped reversibly, so they never mark a turn.
A conversation is one part unless it is longer than PART_CHARS; then it is cut
between turns, where cutting changes no token.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

OPEN, BEGIN, END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"  # before a turn, before and after its text, after the turn
CONTROLS = (OPEN, BEGIN, END, CLOSE)
LOSS_ROLE = "assistant"
PART_CHARS = 4_000_000
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)


def escape(text: str) -> str:
    """Double each backslash and put one after the first character of each control string."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of turns (role, text), and the sorted spans of the texts under the loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{BEGIN}", escape(text)
        if role == LOSS_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END + CLOSE)
        at += len(head) + len(body) + len(END + CLOSE)
    return "".join(out), spans


def load_tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.processors import ByteLevel

    own = Tokenizer.from_file(path)
    own.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROLS])
    own.post_processor = ByteLevel(trim_offsets=False)  # offsets keep the spaces
    return own


def token_ranges(spans: list[tuple[int, int]], offsets: np.ndarray) -> list[tuple[int, int]]:
    """For each span, the tokens (first, after the last) that overlap it; offsets is (n, 2), sorted."""
    if not spans:
        return []
    s = np.asarray(spans, np.int64)
    first = np.searchsorted(offsets[:, 1], s[:, 0], side="right")
    after = np.searchsorted(offsets[:, 0], s[:, 1], side="left")
    return list(zip(first.tolist(), after.tolist()))


def _format(path: str, part_chars: int):
    def encode(own, conv_id, part: int, turns: list[tuple[str, str]]) -> dict:
        text, spans = render(turns)
        e = own.encode(text, add_special_tokens=False)
        offsets = np.asarray(e.offsets, np.uint32).reshape(-1, 2)
        return {
            "conv_id": conv_id, "part": part, "formatted": text, "ids": np.asarray(e.ids, "<u4").tobytes(),
            "offsets": offsets.astype("<u4").tobytes(), "loss": [{"first": a, "after": b} for a, b in token_ranges(spans, offsets.astype(np.int64))],
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = load_tokenizer(path)
        now, part, turns, size, begun = None, 0, [], 0, False
        for pdf in batches:
            out = []
            for conv_id, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                role, text = role or "", text or ""
                if begun and (conv_id != now or size + len(text) > part_chars):
                    out.append(encode(own, now, part, turns))
                    turns, size = [], 0
                    part = part + 1 if conv_id == now else 0
                now, begun = conv_id, True
                turns.append((role, text))
                size += len(text)
            if out:
                yield pd.DataFrame(out)
        if begun:
            yield pd.DataFrame([encode(own, now, part, turns)])

    return run


def format_conversations(rows: DataFrame, tokenizer: str, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (conv_id, turn, role, text) as formatted conversations.

    Returns conv_id (as string), part (from 0), formatted, ids and offsets (little-endian
    unsigned 32-bit integers; offsets are pairs of code points), loss (ranges of
    tokens under the loss mask). Turns are in the order of turn, then role and
    text; repeated rows are turns of their own. Null texts and roles count as
    empty, null turns come first, and rows with a null conv_id are one
    conversation. An empty table gives an empty result. Other columns are not read.
    """
    own = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text")
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInPandas(_format(tokenizer, part_chars), "conv_id string, part int, formatted string, ids binary, offsets binary, loss array<struct<first:int,after:int>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def loss_text(formatted: str, offsets: bytes, loss: list) -> Iterator[str]:
    """The unescaped texts under the loss mask, from the tokens' offsets."""
    at = np.frombuffer(offsets, "<u4").reshape(-1, 2)
    for r in loss:
        if r["after"] > r["first"]:
            yield unescape(formatted[int(at[r["first"], 0]) : int(at[r["after"] - 1, 1])])


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of each conversation; its parts follow each other in order."""
    now = None
    row, turns_hash, loss_hash = {}, None, None

    def closed() -> dict:
        return row | {"turns_sha256": turns_hash.hexdigest(), "loss_sha256": loss_hash.hexdigest()}

    for pdf in batches:
        out = []
        for conv_id, part, formatted, offsets, loss in zip(pdf["conv_id"], pdf["part"], pdf["formatted"], pdf["offsets"], pdf["loss"]):
            if part == 0 or conv_id != now:
                if row:
                    out.append(closed())
                now, turns_hash, loss_hash = conv_id, hashlib.sha256(), hashlib.sha256()
                row = {"conv_id": conv_id, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
            for role, text in parse(formatted):
                row["n_turns"] += 1
                turns_hash.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for text in loss_text(formatted, offsets, loss):
                row["loss_chars"] += len(text)
                loss_hash.update(text.encode("utf-8", "surrogatepass"))
            row["formatted_chars"] += len(formatted)
        if out:
            yield pd.DataFrame(out)
    if row:
        yield pd.DataFrame([closed()])


def digests(formatted: DataFrame) -> DataFrame:
    """What reads back from format_conversations' result: one row of counts and digests for each conversation.

    The parts of a conversation must follow each other, as format_conversations leaves them.
    """
    return formatted.mapInPandas(_digest, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
