"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root.  A round splits the active classes by their next
turns, turn by turn: members that agree up to a depth are one class there, which its smallest
member names.  A class of one member is retired as soon as it appears, and the rest of its
conversation is emitted as a unary chain without being looked at again.  A round takes 8 turns at
first and twice as many each time, so that long copies need few rounds.  At the end the sums of
subtrees are folded back over the classes that were shared; each step of the fold doubles the
distance over which it adds, so a trie of depth n takes log2(n) steps.

Turns are compared by the SHA-256 of role and text, classes by chains of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.shared import stash

#: Turns of the first round, and the most turns of a round: what one row holds of a conversation.
FIRST_TURNS, MOST_TURNS = 8, 256
#: Conversations of a family share beginnings of fewer turns than the other number.
FAMILY, SHARED = 5, 9
_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, bytes): the turns of each conversation, numbered from 1.

    The order is by turn, null first; turns of one number follow in the order of their keys, and
    equal rows are turns of their own.  Null role or text is the empty string; rows without
    conv_id belong to no conversation and are left out.  Other columns are ignored.

    Rows are ranged by conversation and place, so that a conversation of any size is spread; a
    row's number is its place in its range plus what earlier ranges hold of the conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("key")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = stash(placed.select("conv_id", "key", "bytes", "place", F.shiftright("place", 33).alias("range")), "ranged")
    pieces = placed.groupBy("conv_id", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    pieces = pieces.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    joined = placed.join(pieces, (F.col("conv_id") == F.col("c")) & (F.col("range") == F.col("r")))
    return stash(joined.select("conv_id", (F.col("place") - F.col("first") + F.col("earlier") + 1).alias("pos"), "key", "bytes"), "turns")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of numbered turns: (conv_id, depth, key, bytes) and (conv_id, length)."""
    return turns.withColumnRenamed("pos", "depth"), stash(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")), "convs")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their family's first: (turns, convs) as above.

    Conversation c gets the first h turns of conversation c - c % 5, as far as there are any, then
    its own turns after its first h; h is the unsigned crc32 of its decimal id, modulo 9.  It may
    end up without turns.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % SHARED
    sizes = stash(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    firsts = sizes.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.withColumn("of", F.col("conv_id") - F.col("conv_id") % FAMILY).join(firsts, F.col("of") == F.col("base"), "left")
    convs = convs.select("conv_id", "of", head.alias("head"), F.least(head, F.coalesce("base_n", F.lit(0))).alias("given"), "n")
    convs = stash(convs.withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("head"), F.lit(0))), "convs")
    own = turns.join(convs.select(F.col("conv_id").alias("c"), "head", "given"), F.col("conv_id") == F.col("c")).filter("pos > head")
    own = own.select("conv_id", (F.col("pos") - F.col("head") + F.col("given")).alias("depth"), "key", "bytes")
    lent = turns.filter((F.col("pos") < SHARED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "lender")
    lent = lent.join(convs.select("conv_id", "of", "head"), (F.col("lender") == F.col("of")) & (F.col("pos") <= F.col("head")))
    return stash(own.union(lent.select("conv_id", F.col("pos").alias("depth"), "key", "bytes")), "rebuilt"), convs.select("conv_id", "length")


def _chains(active: DataFrame | None, root: int, turns: DataFrame, start: int, width: int) -> DataFrame:
    """(conv_id, class, depth, chain, before, bytes): the next ``width`` turns of active members.

    ``chain`` stands for the turns since ``start``, ``before`` for those without the last.
    """
    block = turns.filter((F.col("depth") > start) & (F.col("depth") <= start + width))
    if active is None:
        block = block.withColumn("class", F.lit(root).cast("long"))
    else:
        block = block.join(active.select(F.col("conv_id").alias("member"), "class"), F.col("conv_id") == F.col("member"))
    listed = block.groupBy("conv_id", "class").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "bytes"))).alias("next"))
    grow = lambda chains, turn: F.concat(chains, F.array(F.sha2(F.concat(F.element_at(chains, -1), turn["key"]), 256)))
    chained = listed.withColumn("chains", F.aggregate("next", F.array(F.lit("")), grow))
    rows = chained.select("conv_id", "class", "chains", F.posexplode("next").alias("i", "turn"))
    return rows.select("conv_id", "class", F.col("turn.depth").alias("depth"), F.col("chains")[F.col("i") + 1].alias("chain"), F.col("chains")[F.col("i")].alias("before"), F.col("turn.bytes").alias("bytes"))


def refine(turns: DataFrame, root: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(classes, last): the classes of two members or more, and where each member left them.

    classes: (depth, node, parent, n, bytes), the root not among them; last: (conv_id, at, node),
    the deepest shared class of a conversation, for each round that it took part in.
    """
    classes, last, active, start, width = [], [], None, 0, FIRST_TURNS
    while True:
        rows = stash(_chains(active, root, turns, start, width), "chains")
        split = rows.groupBy("class", "depth", "chain").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), F.min("before").alias("before"), F.min("bytes").alias("bytes"))
        split = stash(split.filter("n > 1"), "split")
        upper = split.select(F.col("class").alias("c"), (F.col("depth") + 1).alias("d"), F.col("chain").alias("b"), F.col("node").alias("up"))
        under = split.join(upper, (F.col("class") == F.col("c")) & (F.col("depth") == F.col("d")) & (F.col("before") == F.col("b")), "left")
        classes.append(under.select("depth", "node", F.coalesce("up", "class").alias("parent"), "n", "bytes"))
        shared = rows.select("conv_id", "class", "depth", "chain").join(split.select("class", "depth", "chain", "node"), ["class", "depth", "chain"])
        here = stash(shared.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("deepest")), "deepest")
        here = here.select("conv_id", F.col("deepest.depth").alias("at"), F.col("deepest.node").alias("node"))
        last.append(here)
        start, width = start + width, min(2 * width, MOST_TURNS)
        active = here.filter(F.col("at") == start).select("conv_id", F.col("node").alias("class"))
        if active.isEmpty():
            return reduce(DataFrame.union, classes), reduce(DataFrame.union, last)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each (depth, node) of sorted batches; ids pass through, none is held."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["depth", "node", "ends_sha256"])

    for batch in batches:
        if not batch.num_rows:
            continue
        depth, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ids = batch.column(2).to_pylist()
        cuts = [0, *(np.flatnonzero((np.diff(depth) != 0) | (np.diff(node) != 0)) + 1).tolist(), len(ids)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            found = int(depth[i]), int(node[i])
            if found != key:
                if key is not None:
                    yield row()
                key, state = found, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids[i:j])).encode())
    if key is not None:
        yield row()


def _folded(nodes: DataFrame) -> DataFrame:
    """(depth, node, n_leaves, saved_tokens) over subtrees, from what every node has of its own.

    After a step of distance s, a node's sums hold its descendants less than 2 s below it.
    """
    state = stash(nodes.select("depth", "node", F.col("parent").alias("up"), "n_leaves", "saved_tokens"), "fold")
    deepest, step = state.agg(F.max("depth")).first()[0], 1
    while step <= deepest:
        below = state.filter(F.col("depth") >= step)
        adds = below.groupBy((F.col("depth") - step).alias("d"), F.col("up").alias("v")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        state_and = state.join(adds, (F.col("depth") == F.col("d")) & (F.col("node") == F.col("v")), "left").drop("d", "v")
        jump = state.select((F.col("depth") + step).alias("d"), F.col("node").alias("v"), F.col("up").alias("higher"))
        state = state_and.join(jump, (F.col("depth") == F.col("d")) & (F.col("up") == F.col("v")), "left").select(
            "depth", "node", F.col("higher").alias("up"), *[(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))]
        )
        state, step = stash(state, "fold"), 2 * step
    return state.drop("up")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie, see the module's text.

    ``turns`` has conv_id, depth (1, 2, ... without gaps), key and bytes; ``convs`` every conv_id
    with its length, 0 included.  Columns: conv_id, smallest member; depth; parent_conv_id, the
    parent's conv_id, null at the root; n_convs, members; n_children; n_leaves, childless nodes of
    the subtree; saved_tokens, the sum over the subtree of (n_convs - 1) times the bytes of a
    node's last text; ends_sha256, of the comma-joined ids, ascending, of the members that end
    here.  Without conversations the result is empty.

    No class is gathered: members are counted by partial aggregation, and the ids that end in one
    node run through a digest in order, one row at a time.  That digest is sequential by nature.
    """
    least, total = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    spark = convs.sparkSession
    if not total:
        return spark.createDataFrame([], _SCHEMA)
    classes, last = refine(turns, least)
    root = spark.createDataFrame([(0, least, None, total, 0)], "depth long, node long, parent long, n long, bytes long")
    shared = stash(classes.union(root), "classes")
    deepest = last.groupBy("conv_id").agg(F.max(F.struct("at", "node")).alias("deepest")).select(F.col("conv_id").alias("c"), "deepest")
    left = convs.join(deepest, F.col("conv_id") == F.col("c"), "left").select(
        "conv_id", "length", F.coalesce("deepest.at", F.lit(0).cast("long")).alias("at"), F.coalesce("deepest.node", F.lit(least).cast("long")).alias("node")
    )
    left = stash(left, "left")

    tails = left.filter("length > at")
    below = shared.filter("depth > 0").select((F.col("depth") - 1).alias("d"), F.col("parent").alias("v"), F.lit(0).alias("tail"))
    below = below.union(tails.select("at", "node", F.lit(1))).groupBy("d", "v").agg(F.count(F.lit(1)).alias("n_children"), F.sum("tail").cast("long").alias("tails"))
    own = shared.join(below, (F.col("depth") == F.col("d")) & (F.col("node") == F.col("v")), "left").select(
        "depth", "node", "parent", "n", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("tails", F.lit(1).cast("long")).alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved_tokens")
    )
    own = stash(own, "own")
    sums = _folded(own)
    ended = left.filter("length = at").select(F.col("at").alias("depth"), "node", "conv_id")
    ends = ended.repartition("depth", "node").sortWithinPartitions("depth", "node", "conv_id").mapInArrow(_digests, "depth long, node long, ends_sha256 string")

    def digest(ids: Column) -> Column:
        return F.sha2(F.coalesce(ids, F.lit("")), 256)

    top = own.drop("n_leaves", "saved_tokens").join(sums, ["depth", "node"]).join(ends, ["depth", "node"], "left")
    top = top.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", digest(F.lit(None).cast("string"))).alias("ends_sha256"))
    chain = turns.select(F.col("conv_id").alias("c"), "depth").join(tails, (F.col("c") == F.col("conv_id")) & (F.col("depth") > F.col("at")))
    is_last, one = F.col("depth") == F.col("length"), F.lit(1).cast("long")
    chain = chain.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("at") + 1, F.col("node")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(is_last, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        digest(F.when(is_last, F.col("conv_id").cast("string"))).alias("ends_sha256"),
    )
    return top.union(chain)
