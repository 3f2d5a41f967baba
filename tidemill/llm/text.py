"""Words and shingles of whole texts, vectorised over the bytes of an Arrow column.

A word is a maximal run of bytes outside space and \\t..\\r. Only A-Z is lower-cased, so both steps
work on UTF-8 bytes: no byte of a multi-byte character is below 0x80.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes (a longer text is a step of its own).
STEP_BYTES = 2 << 20
#: Bytes of text that are hashed at once.
HASH_BYTES = 256 << 10

_BYTE = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_IN_WORD = ~((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_STEPS = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a worker for later stages, and allocators keep what it freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    begin = 0
    for end in [*cuts.tolist(), len(sizes)]:
        if end > begin:
            yield batch.slice(begin, end - begin)
        begin = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    text = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return text, offsets - offsets[0]


def spans(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte positions of all words, and the first word of each text (with the total at the end)."""
    inside = _IN_WORD[text]
    before = np.empty(len(text), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(text)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(text), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends_at = cuts[cuts > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_CLOSING = np.isin(_BYTE, np.frombuffer(b".,!?;:*&%$#|", dtype=np.uint8))


def without_closing(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of words before their closing punctuation; a word of nothing else keeps its end."""
    bodies, open_ = ends.copy(), np.arange(len(ends))
    while len(open_):
        open_ = open_[(bodies[open_] > starts[open_]) & _CLOSING[text[bodies[open_] - 1]]]
        bodies[open_] -= 1
    return np.where(bodies > starts, bodies, ends)


def span_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of the text that stand in order and do not overlap.

    A piece's hash is a polynomial of its own bytes. `HASH_BYTES` of text are hashed at once, so that the
    arrays of 8 bytes per byte stay small however long the text, or one piece, is.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        stop = int(np.searchsorted(ends, starts[k] + HASH_BYTES, side="right"))
        if stop > k:
            out[k:stop] = _sums(text[starts[k] : ends[stop - 1]], starts[k:stop] - starts[k], ends[k:stop] - starts[k])
        else:
            stop, total = k + 1, np.zeros(1, np.uint64)
            for at in range(int(starts[k]), int(ends[k]), HASH_BYTES):
                part = text[at : min(at + HASH_BYTES, ends[k])]
                total += _sums(part, np.zeros(1, np.int64), np.array([len(part)])) * np.uint64(pow(_BASE, at - int(starts[k]), 1 << 64))
            out[k] = total[0]
        k = stop
    return mix(out + (ends - starts).astype(np.uint64))


def _sums(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of code x power of the place in the piece, for pieces that cover a text but for what parts them."""
    longest = max(1, int((ends - starts).max()))
    place = np.arange(len(text)) - np.repeat(starts, np.diff(starts, append=len(text)))
    np.minimum(place, longest - 1, out=place)
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(_CODES[text] * _powers(longest)[place], out=sums[1:])
    return sums[ends] - sums[starts]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, and the first word of each text (with the total at the end)."""
    text, offsets = raw(column)
    if not len(text):
        return np.empty(0, np.uint64), np.zeros(len(offsets), dtype=np.int64)
    starts, ends, first = spans(text, offsets)
    return span_hashes(LOWER[text], starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in text order, and the first shingle of each text.

    A text of 1 to k-1 words has one shingle, its whole sequence; a text without words has none.
    """
    lengths = np.diff(first)
    counts = np.where(lengths >= k, lengths - k + 1, (lengths > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(counts)])
    if not begin[-1]:
        return np.empty(0, np.uint64), begin
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], counts) + np.repeat(first[:-1], counts)
    stop = np.repeat(first[1:], counts)
    total = np.zeros(begin[-1], dtype=np.uint64)
    for i in range(k):
        inside = at + i < stop
        total += np.where(inside, words[np.minimum(at + i, len(words) - 1)] * _STEPS[i], np.uint64(0))
    return mix(total), begin
