"""N-gram Jaccard join by parity sketches.

1. One pass over the texts gives the size of each document's set of word shingles, a digest of
   the set, and parity sketches of it.  Documents with equal sets form one class; its smallest id
   stands for it from there on.
2. Sizes are cut into bands.  In a band, sets similar enough differ in at most D shingles, and a
   sketch has D + 1 words of 64 bits.  Every shingle flips one bit of its sketch, so sketches
   differ in at most as many bits as sets differ in shingles: the Hamming distance is a lower
   bound.  By the pigeonhole principle, sets at most D apart have the same shingles in one word at
   least; that word, with an XOR of its shingles' hashes (without which words of one shingle would
   meet by chance), is what the join buckets by.  A set that smaller ones of a lower band may be similar to
   has a sketch of that band too.  Nothing of this is random in its outcome: no link is lost.
3. Within a bucket no list of all pairs is made.  In each of a few rounds every member is compared
   with one hub of its bucket, unless both are already connected; what is left, members of buckets
   that still hold several components, is compared in blocks of bounded size.
4. Pairs whose sketches are near enough for their sizes are verified on the full sets.  Links
   become components by star contraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.kernels import mix64
from touchline.llm.minhash import _groups, _placed, _verified, document_sets
from touchline.llm.shared import new_path, remove, short_batches, stash

WIDTH = 3
#: The threshold, as a ratio of integers so that links are decided exactly.
SIMILAR = (90, 100)
#: A band reaches up to so many times its lower end.  In wide ones, small sets have longer sketches than
#: they need, whose words are near empty and meet by chance; narrow ones put more sets into two bands.
BAND = (5, 4)
#: Hub rounds, and how many partners of a member a block lists before it compares in place.
ROUNDS, LISTED = 2, 8
#: Sets of a slice of texts are sketched at once; the arrays of so many shingles are in memory.
SLICE = 150_000
#: Words of sketches that one task turns into keys and counts.
TASK_WORDS = 400_000

_SALT = np.uint64(0x9FB21C651E98DF25)
_SIZED = "doc_id long, n_shingles long, digest binary"
_SKETCHED = _SIZED + ", band int, sketch binary, marks binary"


def edges(most: int = 1 << 40) -> np.ndarray:
    """The lower ends of the bands."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * BAND[0] // BAND[1]))
    return np.array(out, dtype=np.int64)


def differ(total, similar: tuple[int, int]):
    """In how many elements sets of ``total`` elements in all differ at most."""
    part, whole = similar
    return total * (whole - part) // (whole + part)


def sketch_words(similar: tuple[int, int], ends: np.ndarray) -> np.ndarray:
    """The words of a sketch in each band but the last; 0 where only equal sets can link."""
    part, whole = similar
    high = ends[1:] - 1
    most = differ(high + high * whole // part, similar)
    return np.where(most > 0, most + 1, 0)


def lower_size(n, similar: tuple[int, int]):
    """The smallest size of a set similar to one of size n."""
    part, whole = similar
    return -(-n * part // whole)


def sketch(flat: np.ndarray, of: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, marks, offsets): the parity sketches of sets given as shingles and the set of each, and the XOR of each word's hashes."""
    at = np.concatenate([[0], np.cumsum(words)])
    mixed = mix64(flat ^ _SALT)
    place = at[of] + (((mixed >> np.uint64(32)) * words[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    out, marks = np.zeros(at[-1], dtype=np.uint64), np.zeros(at[-1], dtype=np.uint32)
    np.bitwise_xor.at(out, place, np.uint64(1) << (mixed & np.uint64(63)))
    np.bitwise_xor.at(marks, place, (mix64(mixed) >> np.uint64(32)).astype(np.uint32))
    return out, marks, at


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, list[np.ndarray], list[bytes]]]:
    """(ids, sets, digests) of some texts at a time."""
    for batch in batches:
        at, ids, sets = 0, [], []
        for part in document_sets(batch.column(1), width):
            ids += batch.column(0).slice(at, len(part)).to_pylist()
            sets += part
            at += len(part)
            if sum(map(len, sets)) > SLICE or at == batch.num_rows:
                yield ids, sets, [hashlib.sha256(s.tobytes()).digest() for s in sets]
                ids, sets = [], []


def _sized(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, digests in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "n_shingles", "digest"])

    return run


def _sketched(similar: tuple[int, int], width: int):
    """The sketch of each text in its own band, and in the lower ones that a similar set may have."""
    ends = edges()
    lengths = sketch_words(similar, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, digests in _sets(batches, width):
            size = np.array([len(s) for s in sets], dtype=np.int64)
            flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            own = np.searchsorted(ends, size, "right") - 1
            low = np.searchsorted(ends, lower_size(size, similar), "right") - 1
            for down in range(int((own - low).max(initial=0)) + 1):
                band = own - down
                words = np.where((size > 0) & (band >= low), lengths[np.maximum(band, 0)], 0)
                stay, rows = words[of] > 0, np.flatnonzero(words)
                value, marks, at = sketch(flat[stay], of[stay], words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in rows], pa.int64()), pa.array(size[rows]), pa.array([digests[i] for i in rows], pa.binary()), pa.array(band[rows].astype(np.int32)), *[pa.array([x[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary()) for x in (value, marks)]],
                    names=["doc_id", "n_shingles", "digest", "band", "sketch", "marks"],
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, band) of each word of each sketch; a key stands for band, place and word."""
    for batch in batches:
        size = np.array([len(s) // 8 for s in batch.column(2).to_pylist()], dtype=np.int64)
        if not size.sum():
            continue
        value = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64)
        marks = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
        band = batch.column(1).to_numpy(zero_copy_only=False)[row]
        key = mix64(mix64(value ^ _SALT) + mix64(marks + _SALT) + mix64((band.astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(batch.column(0).to_numpy(zero_copy_only=False)[row]), pa.array(band.astype(np.int32))], names=["key", "rep", "band"])


def near_sketches(a: list[bytes], b: list[bytes], total: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Which pairs of equally long sketches are near enough for the sum of their sets' sizes."""
    size = np.array([len(x) // 8 for x in a], dtype=np.int64)
    apart = np.bitwise_count(np.frombuffer(b"".join(a), np.uint64) ^ np.frombuffer(b"".join(b), np.uint64)).astype(np.int64)
    return np.add.reduceat(apart, np.cumsum(size) - size) <= differ(total, similar)


def _survivors(pairs: DataFrame, sketches: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of a band that sizes and sketches do not rule out."""
    part, whole = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
                stay = near_sketches(batch.column(3).to_pylist(), batch.column(5).to_pylist(), n + m, similar)
                stay &= whole * np.minimum(n, m) >= part * np.maximum(n, m)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(stay))

    side = sketches.select(F.col("rep").alias("r"), F.col("band").alias("x"), "n", "sketch")
    joined = pairs.join(side, (F.col("a") == F.col("r")) & (F.col("band") == F.col("x"))).select("a", "b", "band", F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    joined = joined.join(side, (F.col("b") == F.col("r")) & (F.col("band") == F.col("x"))).select("a", "b", "n_a", "s_a", F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    return joined.mapInArrow(run, "a long, b long").distinct()


def _near_rows(x: int, other: np.ndarray, words: np.ndarray, size: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Those of ``other`` that the sketch of x does not rule out."""
    part, whole = similar
    other = other[whole * np.minimum(size[other], size[x]) >= part * np.maximum(size[other], size[x])]
    apart = np.bitwise_count(words[other] ^ words[x]).sum(axis=1, dtype=np.int64)
    return other[apart <= differ(size[other] + size[x], similar)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()  # one band: equally long
    return np.frombuffer(b"".join(values), dtype=np.uint64).reshape(len(values), -1)


def _blockwise(placed: DataFrame, sketches: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(a, b, key, lb, rb) of pairs of different components that the sketches do not rule out.

    A member with more than ``LISTED`` such partners in a block is not listed with them; it gets
    one row with a null b, and ``_within`` compares it.
    """
    side = sketches.select(F.col("rep").alias("r"), F.col("band").alias("x"), "n", "sketch")
    rows = placed.join(side, (F.col("rep") == F.col("r")) & (F.col("band") == F.col("x"))).select("key", "lb", "rb", "side", "rep", "label", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            key, lb, rb, side, rep, label, size = (group.column(i).to_numpy() for i in range(7))
            words = _matrix(group.column(7))
            right = np.flatnonzero(side == 1)
            found: list[tuple[int, int | None]] = []
            for x in np.flatnonzero(side == 0).tolist():
                near = _near_rows(x, right[label[right] != label[x]], words, size, similar)
                mine = int(rep[x])
                found += [(min(mine, y), max(mine, y)) for y in rep[near].tolist()] if len(near) <= LISTED else [(mine, None)]
            if found:
                a, b = zip(*found, strict=True)
                at = [pa.array(np.full(len(a), c[0])) for c in (key, lb, rb)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *at], names=["a", "b", "key", "lb", "rb"])

    ordered = rows.repartition("key", "lb", "rb").sortWithinPartitions("key", "lb", "rb")
    return ordered.mapInArrow(run, "a long, b long, key long, lb int, rb int")


def _within(over: DataFrame, placed: DataFrame, sketches: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links (u, v) of the members in ``over`` (a, key, lb, rb), verified inside their block pair.

    The full sets come to the block, so its pairs never become rows.  A partner that is connected
    by then is not compared.
    """
    part, whole = similar
    group = ["key", "lb", "rb"]
    left = placed.filter("side = 0").join(over.select(*group, F.col("a").alias("rep")), [*group, "rep"], "left_semi")
    right = placed.filter("side = 1").join(over.select(group).distinct(), group, "left_semi")
    side = sketches.select(F.col("rep").alias("r"), F.col("band").alias("x"), "n", "sketch")
    rows = left.unionByName(right).join(side, (F.col("rep") == F.col("r")) & (F.col("band") == F.col("x")))
    rows = rows.join(sets.select(F.col("id").alias("i"), "members"), F.col("rep") == F.col("i")).select(*group, "side", "rep", "label", "n", "sketch", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            side, rep, label, size = (table.column(i).to_numpy() for i in range(3, 7))
            words, packed = _matrix(table.column(7)), table.column(8)
            parent = {x: x for x in label.tolist()}

            def root(x: int, parent=parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            right, links = np.flatnonzero(side == 1), []
            for x in np.flatnonzero(side == 0).tolist():
                own = np.frombuffer(packed[x].as_py(), dtype=np.uint64)
                for y in _near_rows(x, right, words, size, similar).tolist():
                    p, q = root(int(label[x])), root(int(label[y]))
                    if p == q:
                        continue
                    other = np.frombuffer(packed[y].as_py(), dtype=np.uint64)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if whole * both >= part * (len(own) + len(other) - both):
                        parent[max(p, q)] = min(p, q)
                        links.append((int(rep[x]), int(rep[y])))
            if links:
                u, v = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "u long, v long")


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in document_sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "members"])
                at += len(sets)

    return run


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like ``stash``, with the path, so that a large table can go before the driver ends."""
    path = new_path(df.sparkSession, name)
    with short_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = SIMILAR, width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents link when part of whole of their shingles are shared (``similar``), decided on sets
    of 64-bit hashes of the shingles.  Null text and text without words have the empty set and are
    linked with nothing.  Rows that repeat an id are taken as one document with several texts, of
    which the first of a class stands for the id.  A null id is linked with nothing and its
    component is null.  Other columns are ignored.  An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    sized = stash(base.mapInArrow(_sized(width), _SIZED), "sized")
    known = sized.filter("n_shingles > 0 and doc_id is not null")
    classes = stash(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")), "classes")

    # sketches of the classes' first documents only, in so many tasks that the keys of one fit well
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    tasks = 1 + 2 * differ(2 * shingles, similar) // TASK_WORDS
    sketched = base.mapInArrow(_sketched(similar, width), _SKETCHED).repartition(tasks, "doc_id", "digest")
    first = classes.select("rep", F.col("digest").alias("of"))
    banded = sketched.join(first, (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("of"))).select("rep", "band", F.col("n_shingles").alias("n"), "sketch", "marks")
    banded, banded_path = _written(banded, "banded")

    # from here on all is joined by sort and merge at every size: a side that could be broadcast on a
    # small table cannot on a large one
    keys = banded.select("rep", "band", "sketch", "marks").mapInArrow(_keys, "key long, rep long, band int")
    shared = keys.groupBy(F.col("key").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket").hint("merge")
    members = stash(keys.join(shared, F.col("key") == F.col("bucket")).select("key", "rep", "band"), "members")
    wanted = stash(members.select(F.col("rep").alias("wanted")).distinct(), "wanted").hint("merge")
    sketches = stash(banded.drop("marks").join(wanted, F.col("rep") == F.col("wanted"), "left_semi").dropDuplicates(["rep", "band"]), "sketches")
    remove(spark, banded_path)
    texts = base.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
    sets = stash(texts.mapInArrow(_full_sets(width), "id long, members binary"), "sets").hint("merge")
    sketches = sketches.hint("merge")

    labels = wanted.select(F.col("wanted").alias("node"), F.col("wanted").alias("label"))
    tested = None
    for turn in range(ROUNDS + 1):
        labelled = members.join(labels.hint("merge"), F.col("rep") == F.col("node")).select("key", "rep", "band", "label")
        rank = F.xxhash64(F.lit(turn), "rep")
        hubs = labelled.groupBy(F.col("key").alias("bucket")).agg(
            F.min_by(F.struct("rep", "label"), rank).alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")
        )
        # a bucket of two was compared whole in the first round
        hubs = hubs.filter("lo < hi" if not turn else "lo < hi and n > 2").hint("merge")
        open_rows = labelled.join(hubs, F.col("key") == F.col("bucket"))
        inside = None
        if turn < ROUNDS:
            pairs = open_rows.filter("label <> hub.label").select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"), "band").distinct()
            pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
            pairs = stash(_survivors(pairs, sketches, similar), "pairs")
            tested = pairs if tested is None else tested.union(pairs)
        else:
            open_rows = stash(open_rows.select("key", "rep", "label", "band"), "open")
            bands = open_rows.groupBy(F.col("key").alias("bucket")).agg(F.min("band").alias("band"))
            placed = _placed(open_rows.select("key", "rep", "label"))
            placed = stash(placed.join(bands, F.col("key") == F.col("bucket")).drop("bucket"), "placed")
            block = stash(_blockwise(placed, sketches, similar), "block")
            pairs = block.filter("b is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
            inside = _within(block.filter("b is null"), placed, sketches, sets, similar)
        links = _verified(pairs, sets, similar)
        links = links if inside is None else links.union(inside)
        node = labels.select("node", "label").hint("merge")
        joined = links.join(node, F.col("u") == F.col("node")).select(F.col("label").alias("lu"), "v").join(node, F.col("v") == F.col("node"))
        merged = components(joined.select(F.col("lu").alias("u"), F.col("label").alias("v")))
        labels = stash(labels.join(merged.withColumnRenamed("node", "old"), F.col("label") == F.col("old"), "left").select("node", F.coalesce("component", "label").alias("label")), "labels")

    found = classes.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("of"), F.coalesce("label", "rep").alias("component"))
    rows = sized.select("doc_id", "n_shingles", "digest")
    joined = rows.join(found, (F.col("digest") == F.col("of")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
