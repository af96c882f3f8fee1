"""Benchmark decontamination with SimHash windows, built from SQL functions only.

A document is contaminated by an item if some window of the document, as many words long as the
item, has a weighted shingle similarity of at least the threshold with it (shingles of five
lower-cased words; the weight of a shingle is how often it occurs, so similarity is the sum of
minima over the sum of maxima).

1. Windows: a window that reaches the threshold shares at least three quarters of the item's
   shingles, in any order.  So windows are placed, for each item size, at every start from which
   that many positions of the window hold a shingle of some item of the size; all others are
   skipped without loss.
2. Every placed window gets a 64-bit SimHash of its words.
3. Multi-index Hamming blocks: fingerprints are cut into ``BLOCKS`` blocks, more than half of the
   radius; two fingerprints within the radius differ in at most one bit of at least one block.  So
   joining windows and items of one size on (block number, block bits), items with the bits of all
   neighbours one bit away too, finds all of them, and the distance is then checked.
   Items that few words dominate take another way: where two words make up most of a text, a small
   change of their shares flips many bits at once, and no radius is safe.  Some of an item's most
   frequent shingles must be in every window like it; windows of its size that hold one are taken.
4. The exact weighted similarity decides.

Generators over computed arrays are the outer variants: for an inner one the optimiser adds a
filter on the array's size and pushes it down, which computes the words anew for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.shared import BROADCAST_BYTES, stash, text_or_empty

WIDTH = 5
THRESHOLD = 0.75
#: Of 64 bits, about 10 differ (standard deviation 3) between bags of words at the threshold; this is over three deviations more.
RADIUS = 21
BLOCKS = RADIUS // 2 + 1
#: Items of at most so many words in effect (the square of their number over the sum of squared counts)
#: are not left to their fingerprints.
NARROW = 12

_FINGERPRINT = """aggregate(transform(sequence(0, 63), b ->
    if(2 * aggregate({hashes}, 0, (n, h) -> n + cast(shiftright(h, b) & 1L as int)) > size({hashes}), shiftleft(1L, b), 0L)),
    0L, (x, y) -> x | y)"""


def lower_words(text_col: str) -> Column:
    return F.array_remove(F.split(F.lower(text_or_empty(text_col)), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(words: str, width: int) -> Column:
    """Hashes of every ``width`` consecutive words of an array column; empty if there are fewer."""
    parts = ", ".join(f"{words}[i + {j}]" for j in range(width))
    return F.expr(f"if(size({words}) >= {width}, transform(sequence(0, size({words}) - {width}), i -> xxhash64({parts})), array())")


def with_bag(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the shingles as strings, each numbered among its equals, which makes a set of the bag.

    Only a bag that repeats a shingle is searched for the numbers.
    """
    plain = f"if(size({words}) = 0, array(), transform(sequence(0, greatest(size({words}) - {WIDTH}, 0)), i -> array_join(slice({words}, i + 1, {WIDTH}), ' ')))"
    numbered = "transform(_bag, (s, i) -> concat(cast(size(filter(slice(_bag, 1, i), t -> t = s)) as string), ' ', s))"
    simple = "transform(_bag, s -> concat('0 ', s))"
    return df.withColumn("_bag", F.expr(plain)).withColumn(name, F.expr(f"if(size(array_distinct(_bag)) = size(_bag), {simple}, {numbered})")).drop("_bag")


def with_fingerprint(df: DataFrame, words: str) -> DataFrame:
    hashed = df.withColumn("_hashes", F.expr(f"transform({words}, w -> xxhash64(w))"))
    return hashed.withColumn("mark", F.expr(_FINGERPRINT.format(hashes="_hashes"))).drop("_hashes")


def blocks(mark: str, count: int = BLOCKS, neighbours: bool = False) -> Column:
    """array<struct<block, bits>>: ``count`` blocks that cover the 64 bits; with ``neighbours``, also every value one bit away."""
    edges = [64 * j // count for j in range(count + 1)]
    parts = []
    for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        bits = F.shiftrightunsigned(mark, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        flips = [0, *(1 << k for k in range(b - a))] if neighbours else [0]
        parts += [F.struct(F.lit(j).alias("block"), bits.bitwiseXOR(F.lit(x)).alias("bits")) for x in flips]
    return F.array(*parts)


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, words, size (in words), width (of its shingles) of the items that have a word."""
    items = benchmark.select(F.col(id_col).alias("item_id"), lower_words(text_col).alias("words")).filter("size(words) > 0 and item_id is not null")
    return items.withColumn("size", F.size("words")).withColumn("width", F.least("size", F.lit(WIDTH)))


def _ranges(need: str, low: str, high: str) -> str:
    """Disjoint ranges of the starts from ``low`` to ``high`` whose ``n`` positions have ``need`` or more of the sorted ``at``."""
    return f"""if(size(at) >= {need}, filter(transform(sequence(0, size(at) - {need}), i -> struct(
        greatest({low}, at[i + {need} - 1] - n + 1, if(i > 0, at[i - 1] + 1, 0)) as lo, least({high}, at[i]) as hi)), r -> r.lo <= r.hi), array())"""


def _placed(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, size, start) of the windows worth a fingerprint."""
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # five values at most
    found = None
    for width in widths:
        own = items.filter(F.col("width") == width).withColumn("hashes", shingle_hashes("words", width))
        own = own.select("size", F.explode_outer("hashes").alias("item_hash")).distinct()
        hashed = docs.select("doc_id", (F.size("words") - (width - 1)).alias("total"), shingle_hashes("words", width).alias("hashes"))
        hashed = hashed.select("doc_id", "total", F.posexplode_outer("hashes").alias("p", "hash"))
        own = F.broadcast(own) if own.count() * 12 <= BROADCAST_BYTES else own  # an int and a long a row
        hits = hashed.join(own, F.col("hash") == F.col("item_hash")).select("doc_id", "size", (F.col("size") - width + 1).alias("n"), "total", "p")
        found = hits if found is None else found.union(hits)
    if found is None:
        return docs.select("doc_id", F.lit(0).alias("size"), F.lit(0).alias("start")).limit(0)
    # texts that share an id: the shortest has the fewest whole windows
    lines = found.groupBy("doc_id", "size", "n").agg(F.sort_array(F.collect_set("p")).alias("at"), F.min("total").alias("total"))
    # of a whole window this share must be the item's; one cut off by the end of the text has fewer shingles, and may do with less
    lines = lines.withColumn("whole", F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - 1e-9).cast("int")).withColumn("part", F.ceil(F.col("n") * threshold - 1e-9).cast("int"))
    ranges = F.expr(f"concat({_ranges('whole', '0', 'total - n')}, {_ranges('part', 'total - n + 1', 'total')})")
    dense = lines.filter("size(at) >= part").select("doc_id", "size", F.explode_outer(ranges).alias("r"))
    return dense.select("doc_id", "size", F.explode_outer(F.expr("sequence(r.lo, r.hi)")).alias("start")).filter("start is not null")


def _anchored(windows: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, size, start, item_id) of windows that hold an anchor of an item of their size.

    A similar window has all but n - need of an item's n shingles, need being the threshold's share of
    them; so of shingles that make up more than that together, it has one.  The most frequent ones are
    taken, which are the fewest.
    """
    spread = lambda words, width: F.explode_outer(shingle_hashes(words, width))
    found = None
    for width in sorted(r["width"] for r in items.select("width").distinct().collect()):  # five values at most
        own = items.filter(F.col("width") == width).select("item_id", "size", (F.col("size") - width + 1).alias("n"), spread("words", width).alias("anchor"))
        counted = own.groupBy("item_id", "size", "n", "anchor").agg(F.count(F.lit(1)).alias("times"))
        before = Window.partitionBy("item_id").orderBy(F.desc("times"), "anchor").rowsBetween(Window.unboundedPreceding, -1)  # an item's shingles
        spare = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9)
        anchors = counted.withColumn("above", F.coalesce(F.sum("times").over(before), F.lit(0))).filter(F.col("above") <= spare).select("item_id", F.col("size").alias("item_size"), "anchor")
        sizes = anchors.select(F.col("item_size").alias("of_size")).distinct()
        held = windows.join(sizes, F.col("size") == F.col("of_size"), "left_semi").select("doc_id", "size", "start", spread("window", width).alias("held")).distinct()
        met = held.join(anchors, (F.col("held") == F.col("anchor")) & (F.col("size") == F.col("item_size"))).select("doc_id", "size", "start", "item_id")
        found = met if found is None else found.union(met)
    return found


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """One row per (doc_id, item_id) that match: also similarity (of the best window) and start (its first word).

    Null and empty texts match nothing; an empty table of either kind gives an empty result.  Of
    windows equally alike, the first counts; items with equal texts are matched each.  An item with fewer than five words is one shingle.
    Rows that share an id are one document.  A null id is not reported.  Only id and text columns
    are read.  The benchmark's shingle table is broadcast up to a fixed number of rows, and joined
    by shuffle beyond it.
    """
    items = stash(with_bag(with_fingerprint(benchmark_items(benchmark), "words"), "words", "bag"), "items")
    base = docs.select(F.col(id_col).alias("doc_id"), lower_words(text_col).alias("words")).filter("doc_id is not null")
    placed = stash(_placed(base, items, threshold), "placed")
    # a merge join at every size: the texts of matching documents are as many as the corpus has, and words are split after it
    starts = placed.groupBy("doc_id").agg(F.collect_list(F.struct("size", "start")).alias("at"))
    texts = docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("body"))
    matched = texts.join(starts.hint("merge"), F.col("of") == F.col("doc_id")).select("doc_id", lower_words("body").alias("words"), "at")
    spread = matched.select("doc_id", "words", F.explode_outer("at").alias("at")).select("doc_id", "words", "at.size", "at.start")
    cut = spread.select("doc_id", "size", "start", F.expr("slice(words, start + 1, size)").alias("window")).filter("size(window) > 0")
    windows = stash(with_fingerprint(cut, "window"), "windows")

    count = radius // 2 + 1  # so many blocks cannot all differ in two bits or more
    left = windows.select("doc_id", "size", "start", "mark", F.explode_outer(blocks("mark", count)).alias("key")).select("doc_id", "size", "start", "mark", "key.block", "key.bits")
    right = items.select("item_id", F.col("size").alias("item_size"), F.col("mark").alias("item_mark"), F.explode_outer(blocks("mark", count, neighbours=True)).alias("key"))
    right = right.select("item_id", "item_size", "item_mark", F.col("key.block").alias("item_block"), F.col("key.bits").alias("item_bits"))
    near = left.join(right, (F.col("size") == F.col("item_size")) & (F.col("block") == F.col("item_block")) & (F.col("bits") == F.col("item_bits")))
    near = near.filter(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= radius).select("doc_id", "size", "start", "item_id")
    squares = F.expr("aggregate(array_distinct(words), 0L, (t, w) -> t + power(size(filter(words, x -> x = w)), 2)::long)")
    narrow = items.filter(F.col("size") * F.col("size") <= NARROW * squares)
    if not narrow.isEmpty():
        near = near.union(_anchored(windows, narrow, threshold))
    near = near.distinct()

    bags = with_bag(windows.select(F.col("doc_id").alias("d"), F.col("size").alias("s"), F.col("start").alias("at"), "window"), "window", "window_bag")
    pairs = near.join(bags, (F.col("doc_id") == F.col("d")) & (F.col("size") == F.col("s")) & (F.col("start") == F.col("at")))
    pairs = pairs.join(items.select(F.col("item_id").alias("i"), "bag"), F.col("item_id") == F.col("i"))
    both = F.size(F.array_intersect("window_bag", "bag"))
    similarity = both / (F.size("window_bag") + F.size("bag") - both)
    scored = pairs.select("doc_id", "item_id", "start", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
    return scored.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min_by("start", F.struct(-F.col("similarity"), "start")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose document matches no item, all columns."""
    gone = contaminated_pairs(docs, benchmark, id_col, text_col, threshold).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
