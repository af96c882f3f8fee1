"""Substring dedup: windows of words that occur earlier are cut out of every later text.

1. Each partition counts the hashes of its windows in a count-min sketch whose counters stop at
   two, sent as its occupied cells only; the merged sketch has a fixed upper size and overestimates every count, so a window it
   puts below two occurs once.
2. Only windows estimated to be repeated are grouped, exactly, by a 96-bit hash; the group's
   smallest (document, start) is its first occurrence.  Map-side aggregation leaves one row of a
   frequent window per task.
3. Each text gets the starts of which it is the first holder.  Every other window that the sketch
   calls repeated occurs earlier, and its words go.

A corpus far beyond the sketch's size is filtered less, and step 2 groups more; nothing is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.kernels import hash_words, rolling, slices, text_bytes, words
from touchline.llm.shared import short_batches

WIDTH = 20
DEPTH = 2
#: Bounds of log2 of the cells of a sketch row; two rows of 2**30 one-bit "repeated" marks are 256 MB.
LEAST_BITS, MOST_BITS = 16, 30
BLOCK_BYTES = 1 << 18
MERGERS = 64
#: A task sends its part of the sketch after so many windows (8 bytes each).
PART_WINDOWS = 2_000_000
_BASES = (0x5851F42D4C957F2D, 0x27BB2EE687B0B0FD)
_LAST = (1 << 63) - 1


def sketch_bits(octets: int) -> int:
    """Enough cells for about three times the words of so many bytes of text, within the bounds."""
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1, octets / 6 * 3))))))


def pack(marks: np.ndarray, codec: pa.Codec) -> bytes:
    """The ascending places of a bitmap's marks as the gaps between them, a byte each with 255 as an escape, compressed."""
    gaps = np.diff(marks, prepend=-1) - 1
    escapes = gaps // 255
    out = np.full(len(gaps) + int(escapes.sum()), 255, dtype=np.uint8)
    out[np.arange(len(gaps)) + np.cumsum(escapes)] = gaps % 255
    return len(out).to_bytes(4, "little") + codec.compress(out.tobytes(), asbytes=True)


def unpack(data: bytes, size: int) -> np.ndarray:
    """The bitmap of ``size`` bytes whose marks ``pack`` was given."""
    coded = np.frombuffer(pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True), dtype=np.uint8)
    marks = np.cumsum(np.where(coded == 255, 255, coded.astype(np.int64) + 1))[coded != 255] - 1
    bits = np.zeros(size * 8, dtype=np.uint8)
    bits[marks] = 1
    return np.packbits(bits, bitorder="little")


def _row_cells(hashes: np.ndarray, bits: int, row: int) -> np.ndarray:
    """The cells of a sketch row: the low bits of the hashes, then the high ones."""
    return (hashes >> np.uint64(64 - bits) if row else hashes & np.uint64((1 << bits) - 1)).astype(np.uint32)


def sketch_part(hashes: np.ndarray, bits: int, blocks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, cells counted, cells counted at least twice) of the sketch of some hashes.

    Row r's blocks are numbered from r * blocks; cells are ascending places within their block.
    Only cells that occur are held, so memory follows the hashes and not the sketch.
    """
    for r in range(DEPTH):
        cells = _row_cells(hashes, bits, r)
        cells.sort()
        fresh = np.ones(len(cells), dtype=bool)
        fresh[1:] = cells[1:] != cells[:-1]
        many = np.zeros(len(cells), dtype=bool)
        many[:-1] = ~fresh[1:]
        cells, many, size = cells[fresh], many[fresh], (1 << bits) // blocks
        edges = np.searchsorted(cells, (np.arange(1, blocks) * size).astype(np.uint32))
        edges = np.concatenate([[0], edges, [len(cells)]])
        for b in np.flatnonzero(np.diff(edges)).tolist():
            mine = cells[edges[b] : edges[b + 1]].astype(np.int64) - b * size
            yield r * blocks + b, mine, mine[many[edges[b] : edges[b + 1]]]


def repeated(hashes: np.ndarray, more: np.ndarray, bits: int) -> np.ndarray:
    """Which windows the merged sketch counts at least twice."""
    out = np.ones(len(hashes), dtype=bool)
    for r in range(DEPTH):
        cells = _row_cells(hashes, bits, r)
        out &= (more[r, (cells >> np.uint32(3)).astype(np.int64)] >> (cells & np.uint32(7)).astype(np.uint8)) & 1 == 1
    return out


def _blocks(bits: int) -> int:
    return max(1, (1 << (bits - 3)) // BLOCK_BYTES)


def merged_sketch(texts: DataFrame, bits: int, width: int = WIDTH) -> list[tuple[int, bytes]]:
    """(block, packed) of the "at least twice" bitmaps over all windows of ``texts`` (one string column)."""
    blocks = _blocks(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _opened.clear()
        codec, held, size = pa.Codec("zstd", compression_level=1), [], 0

        def part() -> pa.RecordBatch:
            hashes = np.concatenate(held)
            held.clear()
            rows = [(b, pack(once, codec), pack(more, codec)) for b, once, more in sketch_part(hashes, bits, blocks)]
            numbers, once, more = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["block", "once", "more"])

        for batch in batches:
            for i, j in slices(batch.column(0)):
                raw, offsets = text_bytes(batch.column(0).slice(i, j - i))
                starts, ends, at = words(raw, offsets)
                held.append(rolling(hash_words(raw, starts, ends), at, width, _BASES[0])[0])
                size += len(held[-1])
                if size > PART_WINDOWS:
                    yield part()
                    size = 0
        if size:
            yield part()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _opened.clear()
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = (1 << (bits - 3)) // blocks
        for batch in batches:
            for block, *packed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                once, more = (unpack(x.as_py(), size) for x in packed)
                if block in held:
                    had, twice = held[block]
                    held[block] = had | once, twice | more | (had & once)
                else:
                    held[block] = once, more
        codec = pa.Codec("zstd", compression_level=1)
        for block, (_, more) in held.items():
            marks = np.flatnonzero(np.unpackbits(more, bitorder="little"))
            if len(marks):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(marks, codec)], pa.binary())], names=["block", "more"])

    parts = texts.mapInArrow(count, "block int, once binary, more binary").repartition(MERGERS, "block").mapInArrow(merge, "block int, more binary")
    with short_batches(texts.sparkSession):
        parts = parts.toArrow()
    return list(zip(*(c.to_pylist() for c in parts.columns), strict=True))


_opened: dict[str, np.ndarray] = {}


def opened(key: str, packed: list[tuple[int, bytes]], bits: int) -> np.ndarray:
    """The bitmaps of a merged sketch, unpacked once in a worker; it keeps those of one sketch."""
    if key not in _opened:
        _opened.clear()
        blocks = _blocks(bits)
        out = np.zeros((DEPTH * blocks, (1 << (bits - 3)) // blocks), dtype=np.uint8)
        for block, data in packed:
            out[block] = unpack(data, out.shape[1])
        _opened[key] = out.reshape(DEPTH, -1)
    return _opened[key]


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bits: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text.

    A word goes if a window of ``width`` words that covers it also starts earlier: in a smaller
    id, or earlier in the same text; all windows of the input count, also those of words that go.
    The words that stay are joined by one space.  Null text has no words.  A null id comes after
    all others.  Rows that repeat an id are one document with several texts, of which equal
    starts are equally early.  Other columns are ignored.  An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("place"), F.col(text_col).alias("text"))
    if bits is None:
        bits = sketch_bits(base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    shared, key = docs.sparkSession.sparkContext.broadcast(merged_sketch(base.select("text"), bits, width)), uuid.uuid4().hex

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = opened(key, shared.value, bits)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(batch.column(1)):
                raw, offsets = text_bytes(batch.column(1).slice(i, j - i))
                starts, ends, at = words(raw, offsets)
                hashes = hash_words(raw, starts, ends)
                first, of = rolling(hashes, at, width, _BASES[0])
                use = np.flatnonzero(repeated(first, more, bits))
                second = rolling(hashes, at, width, _BASES[1])[0][use]
                doc = np.repeat(np.arange(j - i), np.diff(of))[use]
                start = use - of[doc]
                # of a window that repeats within a text, only the first start can be the first of all
                order = np.lexsort((start, first[use], doc))
                key_doc, key_hash = doc[order], first[use][order]
                fresh = np.ones(len(order), dtype=bool)
                fresh[1:] = (key_doc[1:] != key_doc[:-1]) | (key_hash[1:] != key_hash[:-1])
                chosen = np.sort(order[fresh])
                use, second, doc, start = use[chosen], second[chosen], doc[chosen], start[chosen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[use].view(np.int64)), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids[i:j][doc]), pa.array(start.astype(np.int32))],
                    names=["hash_a", "hash_b", "place", "start"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = opened(key, shared.value, bits)
        for batch in batches:
            text, firsts = batch.column(1), batch.column(2)
            for i, j in slices(text):
                part = text.slice(i, j - i)
                raw, offsets = text_bytes(part)
                starts, ends, at = words(raw, offsets)
                first, of = rolling(hash_words(raw, starts, ends), at, width, _BASES[0])
                again = repeated(first, more, bits)
                own = firsts.slice(i, j - i)
                owner = np.repeat(np.arange(j - i), [len(x) if x.is_valid else 0 for x in own])
                own_starts = own.flatten().to_numpy(zero_copy_only=False)
                inside = own_starts < np.diff(of)[owner]  # false only where rows share an id
                again[of[owner[inside]] + own_starts[inside]] = False
                use = np.flatnonzero(again)
                doc = np.repeat(np.arange(j - i), np.diff(of))[use]
                begin = use - of[doc] + at[doc]
                edge = np.bincount(begin, minlength=len(starts) + 1) - np.bincount(begin + width, minlength=len(starts) + 1)
                stay = np.cumsum(edge)[: len(starts)] == 0
                kept, data = [], raw.tobytes()
                for d in range(j - i):
                    kept.append(b" ".join(compress(data[offsets[d] : offsets[d + 1]].split(), stay[at[d] : at[d + 1]].tolist())))
                n = np.diff(at)
                total = np.concatenate([[0], np.cumsum(~stay)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(total[at[1:]] - total[at[:-1]], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    found = base.select("place", "text").mapInArrow(candidates, "hash_a long, hash_b int, place long, start int")
    firsts = found.groupBy("hash_a", "hash_b").agg(F.min_by("start", "place").alias("start"), F.min("place").alias("holder"))
    held = firsts.groupBy("holder").agg(F.collect_list("start").alias("firsts"))
    joined = base.join(held, F.col("place") == F.col("holder"), "left").select("doc_id", "text", "firsts")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
