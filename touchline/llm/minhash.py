"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over the texts gives each document's set of word shingles as hashes, its size, a
   128-bit fingerprint of the set and a signature of 128 minima.  Documents with equal sets form
   one class, and its smallest id stands for it from there on.
2. The signature is cut into bands; classes that share a band's key are candidates.  Within a
   bucket no list of all pairs is made.  In each of a few rounds every member is compared with
   one hub of its bucket, unless both are already known to be connected; what is left (members
   of buckets that still hold several components) is compared in blocks of bounded size.
3. A comparison reads the signatures batch by batch and ends as soon as the posterior probability
   that the similarity reaches the threshold, under a uniform prior, is below ``MISS``.
   Survivors are verified on the full sets, and only verified links count.
4. Links become components by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.kernels import hash_words, mix64, shingles, slices, text_bytes, words
from touchline.llm.shared import stash

WIDTH = 5
#: The threshold, as a ratio of integers so that links are decided exactly.
SIMILAR = (75, 100)
HASHES = 128
BAND_ROWS = 4
BATCH = 32
MISS = 1e-5
ROUNDS = 2
BLOCK = 1024
LISTED = 8

_draw = np.random.default_rng(11)
_LOW = _draw.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_HIGH = _draw.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def least_matches(threshold: float, size: int, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(compared, least): with fewer equal minima among those compared, a pair is given up.

    With a uniform prior and n of m equal, P(similarity >= t) is the chance that a binomial of
    m + 1 trials at t is at most n.
    """
    out = []
    for m in range(batch, size + 1, batch):
        total, n = 0.0, -1
        while total < miss:
            n += 1
            total += comb(m + 1, n) * threshold**n * (1 - threshold) ** (m + 1 - n)
        out.append((m, n))
    return out


def similar_signatures(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two equally shaped signature arrays survive all batches."""
    alive, equal, before = np.arange(len(a)), np.zeros(len(a), dtype=np.int64), 0
    for m, least in bounds:
        equal = equal + (a[alive, before:m] == b[alive, before:m]).sum(axis=1)
        stay = equal >= least
        alive, equal, before = alive[stay], equal[stay], m
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def document_sets(column: pa.Array, width: int = WIDTH) -> Iterator[list[np.ndarray]]:
    """For each slice of a batch, the sorted distinct shingle hashes of each text."""
    for i, j in slices(column):
        raw, offsets = text_bytes(column.slice(i, j - i))
        starts, ends, at = words(raw, offsets)
        values, of = shingles(hash_words(raw, starts, ends, lower=True), at, width)
        yield [np.unique(values[of[d] : of[d + 1]]) for d in range(j - i)]


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    a, b = mix64(values).sum(dtype=np.uint64), mix64(values * _SALT + np.uint64(1)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), HASHES) minima, 16 bits each, of non-empty sets."""
    flat = mix64(np.concatenate(sets))
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.empty((len(sets), HASHES), dtype=np.uint16)
    for k in range(HASHES):
        out[:, k] = (np.minimum.reduceat(low * _LOW[k] + high * _HIGH[k], start) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Equally long rows of a contiguous array as a binary column."""
    rows = np.ascontiguousarray(rows)
    size = rows.itemsize * rows.shape[1]
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for sets in document_sets(batch.column(1)):
            ids = batch.column(0).slice(at, len(sets))
            at += len(sets)
            marks = [_fingerprint(s) for s in sets]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = np.zeros((len(sets), HASHES), dtype=np.uint16)
            if full:
                sig[full] = signatures([sets[i] for i in full])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), _binary(sig)],
                names=["doc_id", "n_shingles", "mark_a", "mark_b", "sig"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for sets in document_sets(batch.column(1)):
            kept = [i for i, s in enumerate(sets) if len(s)]
            ids = batch.column(0).slice(at, len(sets)).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([sets[i].tobytes() for i in kept], pa.binary())], names=["id", "members"])
            at += len(sets)


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = HASHES // BAND_ROWS
    number = mix64(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in batches:
        sig = _matrix(batch.column(1))
        keys = mix64(np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands) ^ number)
        rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(rep)], names=["key", "rep"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), HASHES)


def _survivors(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that the signatures do not rule out."""
    bounds = least_matches(threshold, HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = similar_signatures(_matrix(batch.column(2)), _matrix(batch.column(3)), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(stay))

    sig = reps.select(F.col("rep").alias("r"), "sig")
    joined = pairs.join(sig, F.col("a") == F.col("r")).select("a", "b", F.col("sig").alias("sig_a"))
    joined = joined.join(sig, F.col("b") == F.col("r")).select("a", "b", "sig_a", F.col("sig").alias("sig_b"))
    return joined.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough."""
    part, whole = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                stay.append(whole * both >= part * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(stay, pa.bool_()))

    side = sets.select(F.col("id").alias("r"), "members")
    joined = pairs.join(side, F.col("a") == F.col("r")).select("a", "b", F.col("members").alias("set_a"))
    joined = joined.join(side, F.col("b") == F.col("r")).select("a", "b", "set_a", F.col("members").alias("set_b"))
    return joined.mapInArrow(run, "u long, v long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first ``keys`` columns of sorted batches, across batch ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(c[i]) for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _placed(mixed: DataFrame) -> DataFrame:
    """(key, lb, rb, side, rep, label): the members of buckets, dealt to block pairs.

    Left blocks (side 0) hold those outside the bucket's largest component, right blocks all, so
    members of the largest are not compared with each other.  A block pair is one group of about
    ``BLOCK`` by ``BLOCK`` rows; a bucket of any size is spread over groups of bounded size.
    """
    counts = mixed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    bucket = counts.groupBy(F.col("key").alias("bucket")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("major"))
    rows = mixed.join(bucket, F.col("key") == F.col("bucket"))
    left_blocks, right_blocks = F.ceil((F.col("n") - F.col("most")) / BLOCK), F.ceil(F.col("n") / BLOCK)
    own_left, own_right = (F.pmod(F.xxhash64(F.lit(i), "rep"), n).cast("int") for i, n in ((1, left_blocks), (2, right_blocks)))
    every_left, every_right = (F.sequence(F.lit(0), n.cast("int") - 1) for n in (left_blocks, right_blocks))
    shape = ["key", "lb", "rb", "side", "rep", "label"]
    left = rows.filter("label <> major").withColumn("lb", own_left).withColumn("rb", F.explode(every_right)).withColumn("side", F.lit(0))
    right = rows.withColumn("rb", own_right).withColumn("lb", F.explode(every_left)).withColumn("side", F.lit(1))
    return left.select(shape).union(right.select(shape))


def _blockwise(placed: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, key, lb, rb) of pairs of different components that the signatures do not rule out.

    A member with more than ``LISTED`` such partners in a block is not listed with them; it gets
    one row with a null b, and ``_within`` compares it.
    """
    bounds = least_matches(threshold, HASHES)
    rows = placed.join(reps.select(F.col("rep").alias("r"), "sig"), F.col("rep") == F.col("r")).select("key", "lb", "rb", "side", "rep", "label", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            key, lb, rb, side, rep, label = (group.column(i).to_numpy() for i in range(6))
            sig = _matrix(group.column(6))
            right = np.flatnonzero(side == 1)
            found: list[tuple[int, int | None]] = []
            for x in np.flatnonzero(side == 0).tolist():
                other = right[label[right] != label[x]]
                near = other[similar_signatures(np.broadcast_to(sig[x], (len(other), HASHES)), sig[other], bounds)]
                mine = int(rep[x])
                found += [(min(mine, y), max(mine, y)) for y in rep[near].tolist()] if len(near) <= LISTED else [(mine, None)]
            if found:
                a, b = zip(*found, strict=True)
                at = [pa.array(np.full(len(a), c[0])) for c in (key, lb, rb)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *at], names=["a", "b", "key", "lb", "rb"])

    ordered = rows.repartition("key", "lb", "rb").sortWithinPartitions("key", "lb", "rb")
    return ordered.mapInArrow(run, "a long, b long, key long, lb int, rb int")


def _within(over: DataFrame, placed: DataFrame, reps: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links (u, v) of the members in ``over`` (a, key, lb, rb), verified inside their block pair.

    The full sets come to the block, so its pairs never become rows.  Partners are tried from the
    most alike downwards, and one that is connected by then is not compared.
    """
    part, whole = similar
    bounds = least_matches(part / whole, HASHES)
    group = ["key", "lb", "rb"]
    left = placed.filter("side = 0").join(over.select(*group, F.col("a").alias("rep")), [*group, "rep"], "left_semi")
    right = placed.filter("side = 1").join(over.select(group).distinct(), group, "left_semi")
    rows = left.unionByName(right).join(reps.select(F.col("rep").alias("r"), "sig"), F.col("rep") == F.col("r"))
    rows = rows.join(sets.select(F.col("id").alias("i"), "members"), F.col("rep") == F.col("i")).select(*group, "side", "rep", "label", "sig", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            side, rep, label = (table.column(i).to_numpy() for i in (3, 4, 5))
            sig, packed = _matrix(table.column(6)), table.column(7)
            parent = {x: x for x in label.tolist()}

            def root(x: int, parent=parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            right, links = np.flatnonzero(side == 1), []
            for x in np.flatnonzero(side == 0).tolist():
                near = right[similar_signatures(np.broadcast_to(sig[x], (len(right), HASHES)), sig[right], bounds)]
                alike = (sig[near] == sig[x]).sum(axis=1)
                own = np.frombuffer(packed[x].as_py(), dtype=np.uint64)
                for y in near[np.argsort(-alike, kind="stable")].tolist():
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


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null text and text without words have the empty set and are linked with nothing.  Rows that
    share an id count as one document with several texts.  A null id is linked with nothing: its
    component is null and it is kept.  Other columns are ignored.  An empty table gives an empty
    result.
    """
    threshold = similar[0] / similar[1]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stash(base.mapInArrow(_signed, "doc_id long, n_shingles long, mark_a long, mark_b long, sig binary"), "signed")
    classes = stash(signed.filter("n_shingles > 0 and doc_id is not null").groupBy("mark_a", "mark_b").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "classes")

    bands = classes.select("rep", "sig").mapInArrow(_band_keys, "key long, rep long")
    shared = bands.groupBy(F.col("key").alias("bucket")).agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("bucket")
    members = stash(bands.join(shared, F.col("key") == F.col("bucket")).select("key", "rep"), "members")
    wanted = members.select(F.col("rep").alias("wanted")).distinct()
    reps = classes.join(wanted, F.col("rep") == F.col("wanted"), "left_semi").select("rep", "sig")
    reps = stash(reps.dropDuplicates(["rep"]), "reps")
    texts = base.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
    sets = stash(texts.mapInArrow(_full_sets, "id long, members binary"), "sets")

    labels = reps.select(F.col("rep").alias("node"), F.col("rep").alias("label"))
    tested = None
    for turn in range(ROUNDS + 1):
        labelled = members.join(labels, F.col("rep") == F.col("node")).select("key", "rep", "label")
        rank = F.xxhash64(F.lit(turn), "rep")
        hubs = labelled.groupBy(F.col("key").alias("bucket")).agg(F.min_by(F.struct("rep", "label"), rank).alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        open_rows = labelled.join(hubs, F.col("key") == F.col("bucket"))
        inside = None
        if turn < ROUNDS:
            pairs = open_rows.filter("label <> hub.label").select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
            pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
            pairs = stash(_survivors(pairs, reps, threshold), "pairs")
            tested = pairs if tested is None else tested.union(pairs)
        else:
            placed = stash(_placed(open_rows.select("key", "rep", "label")), "placed")
            block = stash(_blockwise(placed, reps, threshold), "block")
            pairs = block.filter("b is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
            inside = _within(block.filter("b is null"), placed, reps, sets, similar)
        links = _verified(pairs, sets, similar)
        links = links if inside is None else links.union(inside)
        node = labels.select("node", "label")
        edges = links.join(node, F.col("u") == F.col("node")).select(F.col("label").alias("lu"), "v").join(node, F.col("v") == F.col("node")).select(F.col("lu").alias("u"), F.col("label").alias("v"))
        merged = components(edges)
        labels = stash(labels.join(merged.withColumnRenamed("node", "old"), F.col("label") == F.col("old"), "left").select("node", F.coalesce("component", "label").alias("label")), "labels")

    found = classes.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("mark_a").alias("ka"), F.col("mark_b").alias("kb"), F.coalesce("label", "rep").alias("component"))
    known = signed.select("doc_id", "n_shingles", "mark_a", "mark_b")
    joined = known.join(found, (F.col("mark_a") == F.col("ka")) & (F.col("mark_b") == F.col("kb")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, all columns.

    Of rows that repeat the kept id, all stay.
    """
    gone = near_components(docs, id_col, text_col, similar).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
