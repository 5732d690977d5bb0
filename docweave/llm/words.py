"""Words of whole texts as numpy arrays, straight from Arrow's UTF-8 buffers.

Texts are taken in blocks of bounded size (a longer text is a block of its own), so memory
follows the longest text, not the batch.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20  # bytes of text that numpy works on at once
SPAN = 1 << 16  # bytes hashed at once
U64 = np.uint64
ROOT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(ROOT, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _lower_table(keep) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words once A-Z is lower-cased, and a 64-bit value per byte."""
    low = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])
    return np.array([bool(keep(b)) for b in low]), mix(low.astype(U64) + U64(1))


#: Words end at space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = _lower_table(lambda b: b != 32 and not 9 <= b <= 13)
#: Words are of digits, letters a-z and everything beyond ASCII.
ALNUM = _lower_table(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def blocks(at: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one longer row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (ROOT, INVERSE):
        p = np.full(n, base, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_spans(at: np.ndarray, data: np.ndarray, table=SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses from one text into the next."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[0][data]
    edge = np.zeros(n + 1, bool)
    edge[at[:-1]] = True
    first = inside[1:-1] & (~inside[:-2] | edge[:-1])
    last = inside[1:-1] & (~inside[2:] | edge[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(at: np.ndarray, data: np.ndarray, table=SPACED, head: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per lower-cased word (or its first ``head`` bytes), and the words of each text."""
    starts, ends = word_spans(at, data, table)
    if head is not None:
        ends = np.minimum(ends, starts + head)
    out = np.empty(len(starts), U64)
    power, inverse = _powers(SPAN)
    i = 0
    while i < len(starts):
        s = starts[i]
        j = int(np.searchsorted(ends, s + SPAN, side="right"))
        if j <= i:  # one word longer than a span
            lowered = bytes(data[s : ends[i]]).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
            out[i] = int.from_bytes(hashlib.blake2b(lowered, digest_size=8).digest(), "little")
            i += 1
            continue
        sums = np.zeros(ends[j - 1] - s + 1, U64)
        np.cumsum(table[1][data[s : ends[j - 1]]] * power[: len(sums) - 1], out=sums[1:])
        a, b = starts[i:j] - s, ends[i:j] - s
        out[i:j] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U64))
        i = j
    return out, counts_within(starts, at)


def counts_within(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each row's range."""
    return np.diff(np.searchsorted(places, at))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` consecutive words from each place where that many follow."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = words[:m].copy()
    for k in range(1, n):
        out = mix(out * U64(ROOT) + words[k : k + m])
    return out


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per row, rows given by offsets; empty rows sum to nothing."""
    out = np.zeros(len(at) - 1, values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, at[:-1][full], dtype=out.dtype)
    return out


def offsets(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them) for all i."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = offsets(counts)
    return np.arange(total) - np.repeat(at[:-1] - starts, counts)
