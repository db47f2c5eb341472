"""Words and sentence ends of long texts, counted on the UTF-8 bytes of whole Arrow batches.

Spark's regexp_count lists every match, which takes most of a minute for 100 MB of words; the rules are those of
`functions.text`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pagewright.functions.text import WS

_SPACES = [c.encode() for c in re.findall(WS, "".join(chr(k) for k in range(0x10000) if not 0xD800 <= k < 0xE000))]
#: By byte: white space of one byte, first bytes of longer ones, sentence ends, and capital letters of one byte.
_ONE, _LEAD, _STOP, _CAPITAL = (np.isin(np.arange(256), list(x)) for x in (b"".join(c for c in _SPACES if len(c) == 1), bytes(c[0] for c in _SPACES if len(c) > 1), b".!?", bytes(range(ord("A"), ord("Z") + 1))))
#: By the byte after 0xD0: capital letters of two bytes.
_CYRILLIC = np.isin(np.arange(256), [c.encode()[1] for c in map(chr, [0x401, *range(0x410, 0x430)])])
_LONGER = {n: np.array([int.from_bytes(c, "big") for c in _SPACES if len(c) == n]) for n in (2, 3)}
#: Bytes that are looked at together, about.
PART_BYTES = 1 << 22


def counts(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentences and words of each text; x holds the texts' bytes and two more, text k from offsets[k] on."""
    n = len(x) - 2
    space = _ONE[x[:n]]
    at = np.flatnonzero(_LEAD[x[:n]])
    two = x[at].astype(np.int64) << 8 | x[at + 1]
    for size, code in ((2, two), (3, two << 8 | x[at + 2])):
        found = at[np.isin(code, _LONGER[size])]
        for k in range(size):
            space[found + k] = True
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts, ends = ~space & cut[:-1], ~space & cut[1:]
    starts[1:] |= ~space[1:] & space[:-1]
    ends[:-1] |= ~space[:-1] & space[1:]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    word = np.searchsorted(first, offsets)  # each text's first word
    head = x[first]
    new = _CAPITAL[head] | ((head == 0xD0) & _CYRILLIC[x[first + 1]])
    new[1:] &= _STOP[x[last[:-1]]]
    new[word[:-1][np.diff(word) > 0]] = True
    return np.diff(np.searchsorted(first[new], offsets)), np.diff(word)


def in_parts(texts: pa.Array) -> pa.Array:
    """sentences and words of each text, of a few megabytes at a time; nulls count as empty."""
    t = texts.cast(pa.large_binary())
    offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int64)
    data = np.frombuffer(t.buffers()[2] or b"", np.uint8)
    out, a = [np.zeros((2, 0), np.int64)], 0
    while a < len(t):
        z = min(max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART_BYTES))), len(t))
        part = np.append(data[offsets[a] : offsets[z]], np.zeros(2, np.uint8))
        out.append(np.stack(counts(part, offsets[a : z + 1] - offsets[a])))
        a = z
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(out, axis=1)], names=["sentences", "words"])


def sentence_stats(text: Column) -> Column:
    """sentences and words of a text, whose white space need not be collapsed; both null where it is."""
    udf = F.arrow_udf(in_parts, StructType([StructField("sentences", LongType()), StructField("words", LongType())]))
    return F.when(text.isNotNull(), udf(F.coalesce(text, F.lit(""))))
