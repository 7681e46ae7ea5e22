"""Words and shingles of many texts at once, as 64-bit hashes, with numpy inside Arrow batches.

A word's hash sums one random-looking value for each (place, byte) pair, drawn by table and finaliser:
no arithmetic ties places together, so words that are built to defeat polynomial hashes don't meet.
Two given words share a hash with a probability of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
#: Bytes of text that are worked on at once: numbers made of them take some 40 times as much, in each of an executor's Python workers.
CHUNK = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_NEAR = 64  # places in a word whose values come from a table
_STEP = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_BYTE = _BYTE[_LOWER]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = mixed(np.arange(_NEAR, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))


def _placed(place: np.ndarray) -> np.ndarray:
    """A 64-bit value for each place in a word."""
    out = _PLACE[np.minimum(place, _NEAR - 1)]
    far = place >= _NEAR
    if far.any():
        out[far] = mixed(place[far].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
    return out


def _piece(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    inside = _INSIDE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    end[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    size = ends - starts
    letters = data[inside]  # bytes of words, one word after the other
    heads = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(heads, size)
    value = (_BYTE[letters] ^ _placed(place)) * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    h = np.add.reduceat(value, heads)
    return starts, mixed(h ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of each word; A-Z count as a-z.

    data: bytes of all texts, one after the other; bounds: where each begins, and the end.
    """
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    starts, hashes, at = [], [], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        if to < len(data):  # cut where a word ends, so that none is split
            gaps = np.flatnonzero(~_INSIDE[data[at:to]] | first[at:to])
            if len(gaps) and gaps[-1]:
                to = at + int(gaps[-1])
            else:
                later = np.flatnonzero(~_INSIDE[data[to:]] | first[to:-1])
                to = to + int(later[0]) if len(later) else len(data)
        s, h = _piece(data[at:to], first[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    where = np.concatenate(starts)
    return np.searchsorted(bounds, where, "right") - 1, np.concatenate(hashes)


def shingles(doc: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of each run of k words; a shorter text is one run."""
    n = len(h)
    docs, out = [], []
    if n >= k:
        s = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            s += h[j : n - k + 1 + j] * _STEP[j]
        whole = doc[: n - k + 1] == doc[k - 1 :]
        docs.append(doc[: n - k + 1][whole])
        out.append(s[whole])
    if n:
        own, at, count = np.unique(doc, return_index=True, return_counts=True)
        for c in range(1, k):
            few = count == c
            if few.any():
                s = np.full(int(few.sum()), c, np.uint64)
                for j in range(c):
                    s += h[at[few] + j] * _STEP[j + 4]
                docs.append(own[few])
                out.append(s)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), mixed(np.concatenate(out))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow string column; null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about size bytes of text (or one longer text), with bytes and bounds."""
    data, bounds = texts(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to
