"""Words of many texts at once: runs of letters, digits and non-ASCII bytes, only A-Z lower-cased.

Texts are taken in blocks of a bounded number of bytes; a longer text is cut between words. One block's words are
numbered by a dictionary of its own, in numpy and Arrow, without a Python loop over words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_IN_WORD = np.ones(256, bool)
_IN_WORD[[b for b in range(128) if _GAP.match(bytes([b]))]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Segment:
    """A text, or a part of a long one: its row, its bytes, and how many of its first words were in the part before."""

    row: int
    data: bytes
    context: int = 0


def _last_words(text: bytes, end: int, n: int) -> list[bytes]:
    """The last n words of text[:end]; a word begins or ends at `end`."""
    width = 256
    while True:
        start = max(0, end - width)
        found = _WORD.findall(text, start, end)
        if not start or len(found) > n:
            return found[max(0, len(found) - n) :]
        width *= 4


def blocks(texts: Iterable[bytes | None], context: int = 0, most: int = BLOCK_BYTES) -> Iterator[list[Segment]]:
    """Runs of segments of about `most` bytes together. Parts of a long text after its first repeat `context` words."""
    block: list[Segment] = []
    size = 0
    for row, text in enumerate(texts):
        text = text or b""
        at, before = 0, []
        while True:
            gap = _GAP.search(text, at + most) if len(text) - at > most else None
            end = gap.start() if gap else len(text)
            block.append(Segment(row, b" ".join([*before, text[at:end]]), len(before)))
            size += end - at
            if size >= most:
                yield block
                block, size = [], 0
            if end == len(text):
                break
            at, before = end, _last_words(text, end, context)
    if block:
        yield block


@dataclass
class Words:
    """ids of a block's words in order, the segment of each, and the words that the ids stand for."""

    ids: np.ndarray
    segment: np.ndarray
    vocabulary: pa.Array

    @classmethod
    def of(cls, block: list[Segment]) -> Words:
        data = np.frombuffer(b"\x00" + b"\x00".join(s.data for s in block) + b"\x00", np.uint8)
        inside = _IN_WORD[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        flat = _LOWER[data[inside]]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        begins = np.cumsum([1, *(len(s.data) + 1 for s in block[:-1])])
        return cls(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(begins, starts, "right") - 1, words.dictionary)


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()
