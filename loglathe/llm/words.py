"""Arrow text columns as byte arrays, and hashes of their words, computed for many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at a time.  A longer document is cut between words.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and where each row begins and the last one ends; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown when a longer piece comes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            size = max(n + 1, SLICE_BYTES + 1)
            cls.up, cls.down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
            cls.up[0] = cls.down[0] = 1
            np.multiply.accumulate(cls.up, out=cls.up)
            np.multiply.accumulate(cls.down, out=cls.down)
        return cls.up[:n], cls.down[: n + 1]


def _hash_piece(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(data)
    inside = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _Powers.of(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[data] * up, out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, ...]:
    """Starts, ends and 64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``; then, per document, where its words begin.

    ``fold`` lower-cases A-Z.  Words are hashed by the bytes they hold, so equal words have equal hashes everywhere.
    """
    letters = _FOLDED if fold else _LETTERS
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data) and not _SPACE[data[end]]:  # to the next space, in steps that stay short
            near = np.flatnonzero(_SPACE[data[end : end + 4096]])
            end = min(len(data), end + (int(near[0]) if len(near) else 4096))
            if len(near):
                break
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        s, e, h = _hash_piece(data[at:end], inner, letters)
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = end
    first = np.concatenate(starts)
    return first, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and, per document, where its words begin and the last ones end."""
    return word_spans(data, offsets, fold)[2:]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, fold: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each document.

    A shorter document has its whole word sequence as one shingle, one without words has none.
    """
    words, bounds = word_hashes(data, offsets, fold)
    n = len(words) - width + 1
    if n > 0:
        joined = words[:n].copy()
        for k in range(1, width):
            joined = joined * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
        joined = mix(joined)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    x = x * np.uint64(0xA0761D6478BD642F) + w
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
