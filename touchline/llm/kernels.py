"""Vectorised text kernels shared by the corpus operators.

Every function takes the Arrow string column of one batch and works on its UTF-8 bytes with
numpy, so that a Python worker never loops over words.  Words are the maximal runs of bytes
outside ``[\\x20\\x09-\\x0D]``; a null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Texts are taken in slices of about so many bytes, which keeps the arrays in the cache.
SLICE_BYTES = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; returns a new array."""
    x = x ^ (x >> np.uint64(33))
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, doc_offsets): byte spans of the words, and where each text's words begin."""
    solid = ~WHITE[raw]
    first, last = solid.copy(), solid.copy()
    if len(raw):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, lower: bool = False) -> np.ndarray:
    """64-bit hash of each span, eight bytes at a time; ``lower`` folds A-Z."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = _LOWER[raw] if lower else raw
    blocks = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = mix64(size.astype(np.uint64) * _A + np.uint64(seed))
    at, left, rows = starts, size, None
    while len(at):
        piece = blocks[at] & _MASKS[np.minimum(left, 8)]
        if rows is None:
            out = mix64((out ^ piece) * _A + _C)
        else:
            out[rows] = mix64((out[rows] ^ piece) * _A + _C)
        more = np.flatnonzero(left > 8)
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def same_spans(raw: np.ndarray, starts: np.ndarray, size: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_size: np.ndarray) -> bool:
    """Whether every span equals its counterpart; ``other`` ends with eight bytes that no span uses."""
    if not np.array_equal(size, other_size):
        return False
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    a, b = (np.ndarray(shape=(len(x) - 7,), dtype="<u8", buffer=x, strides=(1,)) for x in (padded, other))
    while len(starts):
        if ((a[starts] ^ b[other_starts]) & _MASKS[np.minimum(size, 8)]).any():
            return False
        more = np.flatnonzero(size > 8)
        starts, other_starts, size = starts[more] + 8, other_starts[more] + 8, size[more] - 8
    return True


def shingles(hashes: np.ndarray, doc_offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width`` consecutive words of one text.

    Returns (values, doc_offsets of the values).  A text with fewer words, but any, has one
    value, made of all of them.
    """
    n = np.diff(doc_offsets)
    total = len(hashes)
    value = hashes.copy()
    for j in range(1, min(width, total)):
        value[: total - j] = mix64(value[: total - j] * _A + hashes[j:])
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(n)), counts)
    index = np.arange(out_offsets[-1]) - out_offsets[doc] + doc_offsets[doc]
    out = value[index]
    for d in np.flatnonzero((n > 0) & (n < width)).tolist():
        v = hashes[doc_offsets[d] : doc_offsets[d] + 1].copy()
        for h in hashes[doc_offsets[d] + 1 : doc_offsets[d + 1]]:
            v = mix64(v * _A + h)
        out[out_offsets[d]] = mix64(v ^ np.uint64(n[d]))[0]
    return out, out_offsets


def rolling(hashes: np.ndarray, doc_offsets: np.ndarray, width: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hash of every full window of ``width`` words: (values, doc_offsets of them)."""
    n = np.diff(doc_offsets)
    counts = np.maximum(n - width + 1, 0)
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    if not out_offsets[-1]:
        return np.zeros(0, np.uint64), out_offsets
    total = len(hashes)
    power = np.full(total, base, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = np.full(total, pow(base, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(hashes * power)])
    doc = np.repeat(np.arange(len(n)), counts)
    index = np.arange(out_offsets[-1]) - out_offsets[doc] + doc_offsets[doc]
    return mix64((prefix[index + width] - prefix[index]) * inverse[index]), out_offsets
