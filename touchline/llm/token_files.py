"""Tokenised corpora in binary files: ids in document order, range-coded in checksummed blocks.

A file is::

    "TLTK2\\n"
    block*        u32 ids, u32 bytes, u32 CRC-32 of the ids, coded bytes
    index         zstd of: u32 documents, i64 doc_id * n, u8 has_id * n, u32 n_tokens * n
    trailer       u64 offset of the index, u32 its bytes, u32 its unpacked bytes, u32 its CRC-32, "TLTK"

Blocks are reset, so a damaged one is found by its checksum and costs no other.  Ids stand in
ascending ``doc_id`` order within a file and over the files of a manifest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.kernels import hash_words, same_spans, slices, text_bytes, words
from touchline.llm.range_coder import decode_block, encode_block
from touchline.llm.shared import new_path, stash
from touchline.llm.warc import _open

MAGIC, END = b"TLTK2\n", b"TLTK"
#: Ids of a block; they are held in memory while it is coded.
BLOCK_IDS = 1 << 20
#: A task starts another file after so many ids.
FILE_IDS = 4 * BLOCK_IDS
#: Words whose ids a worker remembers at most (about 80 bytes each).
REMEMBERED = 2_000_000
#: Texts are encoded in pieces of about so many bytes.
PIECE_BYTES = 1_000_000
_OUTSIDE = re.compile(r"[^A-Za-zÀ-ÖØ-öø-ÿ.,!?;:*$%&#]")
#: The normaliser and pre-tokeniser for which texts may be encoded word by word.
_BY_WORD = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)


class _Ids:
    """Lists of ids by row, end to end in one array."""

    def __init__(self):
        self.ids, self.size, self.begin = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.size = np.concatenate([self.ids, ids.astype(np.uint32)]), np.concatenate([self.size, sizes])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the rows, end to end; their sizes)."""
        size = self.size[rows]
        return self.ids[spread(self.begin[rows], size)], size


_LETTER, _MARK, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[list(b".,!?;:*$%&#")] = _MARK
_KIND[32] = 0


def split_words(raw: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which words are letters, then marks; their letters in lower case; their marks; which have marks).

    ``raw`` holds the words, each with a space before and the last one with a space after it.
    Letters are A-Z and the Latin-1 ones, marks are ``.,!?;:*$%&#``.  In the two byte arrays
    spaces stand for all else, so they hold one part a word.
    """
    kind = _KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    after = raw[lead + 1]
    lead = lead[(after >= 0x80) & (after != 0x97) & (after != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    at = np.cumsum(kind == 0) - 1
    odd = np.zeros(len(raw), dtype=bool)
    odd[1:] = (kind[1:] == _OTHER) | ((kind[1:] == _LETTER) & (kind[:-1] == _MARK)) | ((kind[1:] == _MARK) & (kind[:-1] == 0))
    simple = np.bincount(at[odd], minlength=number + 1)[:number] == 0
    low = raw + (((raw >= 65) & (raw <= 90)) << 5).astype(np.uint8)
    low[lead[raw[lead + 1] <= 0x9E] + 1] += 32
    mine = np.append(simple, False)[at]
    mark = (kind == _MARK) & mine
    return simple, np.where(mine & (kind == _LETTER), low, 32).astype(np.uint8), np.where(mark, raw, 32).astype(np.uint8), np.bincount(at[mark], minlength=number + 1)[:number] > 0


class _Table:
    """A row number for every distinct word.

    Words are looked up by a 64-bit hash and then compared in full; ``None`` is returned where two
    words share a hash, for the caller to start over with another ``seed``.
    """

    def __init__(self, seed: int):
        self.seed = seed
        self.hash, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw, self.begin, self.size = np.zeros(8, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(row of every word, where the new rows' words are among them)."""
        hashes = hash_words(raw, starts, ends, self.seed)
        order = np.argsort(hashes)
        ranked = hashes[order]
        first = np.ones(len(ranked), dtype=bool)
        first[1:] = ranked[1:] != ranked[:-1]
        distinct, group = ranked[first], np.cumsum(first) - 1
        place = np.searchsorted(self.hash, distinct)
        held = np.append(self.hash, np.uint64(0))[place] == distinct
        held &= place < len(self.hash)
        rows = np.zeros(len(distinct), np.int64)
        rows[held] = self.row[place[held]]
        fresh = order[first][~held]
        rows[~held] = len(self.row) + np.arange(len(fresh))
        if len(fresh):
            size = ends[fresh] - starts[fresh]
            self.begin = np.concatenate([self.begin, len(self.raw) - 8 + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.raw = np.concatenate([self.raw[:-8], raw[spread(starts[fresh], size)], np.zeros(8, np.uint8)])
            self.row = np.insert(self.row, place[~held], rows[~held])
            self.hash = np.insert(self.hash, place[~held], distinct[~held])
        sorted_rows = rows[group]
        if not same_spans(raw, starts[order], ends[order] - starts[order], self.raw, self.begin[sorted_rows], self.size[sorted_rows]):
            return None
        out = np.empty(len(order), np.int64)
        out[order] = sorted_rows
        return out, fresh


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``begin``, ``begin`` + 1 ... of every span, end to end."""
    out = np.repeat(begin - np.cumsum(size) + size, size)
    out += np.arange(len(out))
    return out


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words, each with a space before, and a space at the end."""
    size = ends - starts + 1
    out = np.full(int(size.sum()) + 1, 32, np.uint8)
    body = np.ones(len(out), dtype=bool)
    body[np.cumsum(size) - size] = False
    body[-1] = False
    out[body] = raw[spread(starts, ends - starts)]
    return out


class _Words:
    """The ids of words, each distinct one encoded once."""

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = tokenizer
        # letters in lower case are left as they are by the normaliser and the pre-tokeniser but for the spelling of their bytes
        self.plain = Tokenizer(tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = np.zeros((256, 2), np.uint8)
        for c in map(chr, range(0xDF, 0x100)):
            if c.isalpha():
                for octet, letter in zip(c.encode(), spell(c)[0][0], strict=True):
                    self.spelling[octet] = list(letter.encode())
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(tokenizer.model.end_of_word_suffix)]] = True
        self.forget(0)

    def forget(self, seed: int) -> None:
        self.seed = seed
        self.table, self.ids, self.parts, self.part_ids = _Table(seed), _Ids(), _Table(seed), _Ids()

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the words, end to end; how many each has)."""
        if len(self.table.row) + len(self.parts.row) > REMEMBERED:
            self.forget(self.seed)
        while True:
            found = self.table.of(raw, starts, ends)
            if found and (not len(found[1]) or self._learn(raw, starts[found[1]], ends[found[1]])):
                return self.ids.of(found[0])
            self.forget(self.seed + 1)

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Encodes new words; false if two of their parts share a hash."""
        simple, letters, marks, marked = split_words(joined(raw, starts, ends), len(starts))
        begin, end, _ = words(letters, np.array([0, len(letters)]))
        parts = self.parts.of(letters, begin, end)
        if parts is None:
            return False
        self._learn_parts(letters, begin[parts[1]], end[parts[1]])
        ending = self._whole(marks.tobytes().split())
        others = self._whole([raw[a:b].tobytes() for a, b in zip(starts[~simple].tolist(), ends[~simple].tolist(), strict=True)])
        # three lists of ids, of which a word has the first two or the last one
        lists, size = [], np.zeros((len(starts), 3), np.int64)
        for k, (who, (found, n)) in enumerate(((simple, self.part_ids.of(parts[0])), (marked, ending), (~simple, others))):
            lists.append(found)
            size[who, k] = n
        begin = np.cumsum(size, axis=0) - size + np.cumsum([0, *map(len, lists[:2])])
        self.ids.extend(np.concatenate(lists)[spread(begin.ravel(), size.ravel())], size.sum(axis=1))
        return True

    def _learn_parts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes new runs of letters in lower case, 100 in a line."""
        lines, line = joined(raw, starts, ends), 100
        breaks = np.concatenate([np.cumsum(ends - starts + 1) - (ends - starts + 1), [len(lines) - 1]])[[*range(0, len(starts), line), len(starts)]]
        foreign = lines >= 0x80
        place = np.cumsum(1 + foreign) - 1 - foreign
        out = np.repeat(lines, 1 + foreign)
        out[place[foreign]], out[place[foreign] + 1] = self.spelling[lines[foreign], 0], self.spelling[lines[foreign], 1]
        data, edges = out.tobytes(), place[breaks].tolist()
        found = self.plain.encode_batch_fast([data[a:b].decode() for a, b in zip(edges, edges[1:], strict=False)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int64), *(np.array(e.ids, np.int64) for e in found)])
        self.part_ids.extend(ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))

    def _whole(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by the tokeniser as it is, each distinct one encoded once."""
        place = {w: i for i, w in enumerate(dict.fromkeys(parts))}
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in place], add_special_tokens=False)]
        lists = [found[place[w]] for w in parts]
        return np.fromiter(chain.from_iterable(lists), dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64)


class TextTokenizer:
    """Ids of texts, equal to the tokenizers library's on whole texts.

    Where the vocabulary file's normaliser and pre-tokeniser are known to separate tokens at white
    space, a text's ids are those of its words, one after another, and each distinct word is
    encoded once.  With any other file, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = _Words(self.tokenizer) if self.by_word() else None

    def by_word(self) -> bool:
        known = json.loads(self.tokenizer.to_str())
        split = {"type": "Split", "pattern": {"Regex": _BY_WORD[1]}, "behavior": "Removed", "invert": True}
        octets = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        model = known["model"]
        return (
            known["normalizer"] == _BY_WORD[0]
            and known["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, octets]}
            and (model["type"], model["dropout"], model["unk_token"], model["continuing_subword_prefix"]) == ("BPE", None, None, None)
            and bool(model["end_of_word_suffix"])
            and not model.get("ignore_merges")
            and not any(set(t["content"]) & set(" \t\n\x0b\x0c\r") or not _OUTSIDE.search(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in known["added_tokens"])
        )

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of a string column, ``end_id`` after each text; null counts as empty."""
        if self.words is None:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            n = np.array([len(x) + 1 for x in found], dtype=np.int64)
            return np.fromiter((t for x in found for t in (*x, end_id)), dtype=np.uint32, count=int(n.sum())), n
        raw, offsets = text_bytes(texts)
        starts, ends, at = words(raw, offsets)
        ids, size = self.words.of(raw, starts, ends)
        n = np.diff(np.concatenate([[0], np.cumsum(size)])[at]) + 1
        out = np.full(int(n.sum()), end_id, dtype=np.uint32)
        keep = np.ones(len(out), dtype=bool)
        keep[np.cumsum(n) - 1] = False
        out[keep] = ids
        return out, n


_tokenizers: dict[str, TextTokenizer] = {}


def tokenizer(path: str) -> TextTokenizer:
    """The worker's tokeniser for a vocabulary file; workers are reused, and so is what they know."""
    if path not in _tokenizers:
        _tokenizers[path] = TextTokenizer(path)
    return _tokenizers[path]


class _File:
    """A file being written."""

    def __init__(self, folder: str, part: int, number: int):
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name = f"part-{part:05d}-{number:04d}-{uuid.uuid4().hex}.ids"
        self.uri, self.part, self.number = f"{folder}/{name}", part, number
        self.out = system.open_output_stream(f"{path}/{name}", compression=None)
        self.out.write(MAGIC)
        self.size, self.ids, self.docs = len(MAGIC), 0, []
        self.pending: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray, doc_ids: list, counts: np.ndarray) -> None:
        self.docs.append((doc_ids, counts))
        self.pending.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= BLOCK_IDS:
            self._blocks(final=False)

    def _blocks(self, final: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        full = len(ids) if final else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, full, BLOCK_IDS):
            block = ids[i : min(i + BLOCK_IDS, full)]
            data = encode_block(block)
            head = struct.pack("<III", len(block), len(data), zlib.crc32(block.astype("<u4").tobytes()))
            self.out.write(head + data)
            self.size += len(head) + len(data)
        self.pending, self.held = [ids[full:]], len(ids) - full

    def close(self) -> dict:
        self._blocks(final=True)
        names = [d for docs, _ in self.docs for d in docs]
        counts = np.concatenate([c for _, c in self.docs]) if self.docs else np.zeros(0)
        plain = struct.pack("<I", len(names)) + np.array([d or 0 for d in names], "<i8").tobytes() + np.array([d is not None for d in names], "u1").tobytes() + counts.astype("<u4").tobytes()
        packed = pa.compress(plain, "zstd", asbytes=True)
        self.out.write(packed + struct.pack("<QIII", self.size, len(packed), len(plain), zlib.crc32(plain)) + END)
        self.out.close()
        return {"file": self.uri, "part": self.part, "number": self.number, "n_tokens": self.ids, "n_docs": len(names)}


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and write all rows in ascending id order; returns the manifest, one row a file:
    file, part, number, n_tokens, n_docs, start (ids in all files before it).

    Texts are range-partitioned by id and sorted within; a null id comes first, and rows that
    repeat an id stand together in no particular order.  ``end_id`` follows every text, also an
    empty or null one.  Files that a lost or repeated attempt wrote are in no manifest.
    """
    target = folder or new_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, number = TaskContext.get().partitionId(), None, 0
        done = []
        words = tokenizer(vocabulary)
        for batch in batches:
            for i, j in slices(batch.column(1), PIECE_BYTES):
                piece = batch.slice(i, j - i)
                ids, counts = words.encode(piece.column(1), end_id)
                if current is None:
                    current = _File(target, part, number)
                current.add(ids, piece.column(0).to_pylist(), counts)
                if current.ids >= FILE_IDS:
                    done.append(current.close())
                    current, number = None, number + 1
        if current is not None:
            done.append(current.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = stash(ordered.mapInArrow(write, "file string, part long, number long, n_tokens long, n_docs long"), "files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def _body_and_index(file) -> tuple[bytes, bytes]:
    """The coded blocks and the unpacked index of an open file."""
    size = file.size()
    index_at, packed, unpacked, check, end = struct.unpack("<QIII4s", file.read_at(24, size - 24))
    body = file.read_at(index_at - len(MAGIC), len(MAGIC))
    # an index holds 13 bytes a document, and zstd cannot pack more than 2**15 or so of them into one byte
    if end != END or file.read_at(len(MAGIC), 0) != MAGIC or index_at + packed + 24 != size or unpacked > packed << 16:
        raise ValueError("wrong marks or sizes")
    plain = pa.decompress(file.read_at(packed, index_at), unpacked, "zstd", asbytes=True)
    if zlib.crc32(plain) != check:
        raise ValueError("wrong checksum of the index")
    return body, plain


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u32) of every document.

    A task decodes one file at a time, and raises on a damaged index, or a block whose checksum is wrong.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _open(uri)
                with system.open_input_file(path) as file:
                    try:
                        body, plain = _body_and_index(file)
                        heads, at = [], 0
                        while at < len(body):
                            heads.append((*struct.unpack_from("<III", body, at), at + 12))
                            at += 12 + heads[-1][1]
                    except (OSError, OverflowError, ValueError, struct.error) as broken:
                        raise ValueError(f"{uri} is damaged") from broken
                n = struct.unpack_from("<I", plain)[0]
                names = np.frombuffer(plain, "<i8", n, 4)
                known = np.frombuffer(plain, "u1", n, 4 + 8 * n) == 1
                counts = np.frombuffer(plain, "<u4", n, 4 + 9 * n).astype(np.int64)
                doc, held, base = 0, np.zeros(0, np.uint32), start
                for number, octets, check, a in heads:
                    try:
                        found = decode_block(body[a : a + octets], number)
                    except (IndexError, ValueError, OverflowError, struct.error, zlib.error) as broken:
                        raise ValueError(f"{uri} has a damaged block at {a}") from broken
                    if zlib.crc32(found.astype("<u4").tobytes()) != check:
                        raise ValueError(f"{uri} has a damaged block at {a}")
                    held = np.concatenate([held, found])
                    last = doc + int(np.searchsorted(np.cumsum(counts[doc:]), len(held), side="right"))
                    for d in range(doc, last, 1000):
                        mine = counts[d : min(d + 1000, last)]
                        edges = np.concatenate([[0], np.cumsum(mine)])
                        data = held[: edges[-1]].astype("<u4").tobytes()
                        held = held[edges[-1] :]
                        ids = [data[4 * a : 4 * b] for a, b in zip(edges, edges[1:], strict=False)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names[d : d + len(mine)], pa.int64(), mask=~known[d : d + len(mine)]), pa.array(base + edges[:-1], pa.int64()), pa.array(mine, pa.int64()), pa.array(ids, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        base += int(edges[-1])
                    doc = last

    n = max(1, min(10_000, manifest.count()))
    spread = manifest.repartitionByRange(n, "part", "number").select("file", "start")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
