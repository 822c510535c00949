"""Token ids of whole texts as the tokenizers library gives them.

A single space between two characters that are not white space always begins a
new pre-token of a byte-level BPE, so the ids of a text are the joined ids of
the chunks between such spaces, and a chunk is encoded once while it stays in
the cache. Where the ranks of the same vocabulary are given, such a text goes to tiktoken
whole instead, for speed: both libraries give the same ids for text without added
tokens. A text with other runs of spaces, or one that holds the string of an
added token, goes to the tokenizers library whole.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

_OTHER_SPACES = re.compile(r" (?:\s|(?<=\s ))")
CACHE = 200_000


class _Chunks(dict):
    """Ids of chunks (kept without their leading space), in two generations so that frequent ones stay."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = array("I", self.encode(" " + chunk)).tobytes()
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.chunks = _Chunks(self._ids)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ")
        if not rest or not head or not rest[-1] or _OTHER_SPACES.search(text) or any(a in text for a in self.added):
            return array("I", self._ids(text)).tobytes()
        if self.whole:
            return self.whole.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return array("I", self._ids(head)).tobytes() + b"".join(map(self.chunks.__getitem__, rest))


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, ranks_path: str | None = None, pattern: str | None = None) -> ChunkEncoder:
    """This worker's encoder for a tokenizer file; its cache lasts over tasks."""
    key = (path, ranks_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]
