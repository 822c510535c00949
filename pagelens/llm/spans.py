"""Words of whole texts as arrays: boundaries by a table of bytes, hashes eight bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 4_000_000  # characters of texts that are taken apart together, but for one longer text

_G = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first bytes of eight
_BYTES = np.arange(256)
#: Bytes between words: space and the five control characters from tab to carriage return.
SPACES = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a buffer of bytes, none of them empty."""
    eight = np.ndarray((len(buf) + 1,), "<u8", buffer=buf.tobytes() + bytes(8), strides=(1,))  # the eight bytes from each place on
    out, at, lo, left = np.zeros(len(begins), np.uint64), np.arange(len(begins)), begins, ends - begins
    while len(at):
        out[at] = mix((out[at] ^ (eight[lo] & _MASKS[np.minimum(left, 8)])) + _G)
        more = left > 8
        at, lo, left = at[more], lo[more] + 8, left[more] - 8
    return out


def words(texts: list[bytes], between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, and where each text's words begin, the end last. between: which of 256 bytes part words; a line feed must."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    inside = np.r_[False, ~between[buf]]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    return span_hashes(buf, begins, ends), np.r_[0, np.searchsorted(begins, starts)]


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[slice]:
    """Slices of a list of texts that hold about `most` characters each."""
    lo = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= most:
            yield slice(lo, i + 1)
            lo, held = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))
