"""Benchmark decontamination by SimHash of item-sized windows, DataFrame expressions only.

A window is as many consecutive words of a document as a benchmark item has (a shorter document is one
window). Similarity is the weighted Jaccard similarity of the two multisets of five-word shingles, weights
being their counts: sum of smaller counts over sum of larger ones.

1. Windows that cannot reach the threshold are left out without loss: a similar window holds at least
   ``threshold`` of the item's shingles, so it holds one of any (1 - threshold) * L + 1 of them. These anchor
   shingles are looked up in all documents; each hit places a window at every start that holds it.
2. Windows get a 64-bit SimHash over their shingles with repeats, as items do.
3. Multi-index: fingerprints are cut into blocks; within ``radius`` bits one block differs by
   radius // blocks bits at most. Items list the Hamming balls of their blocks, windows look their blocks up,
   among items of their size; that finds every item fingerprint within the radius, verified in full.
4. Candidates are verified by their exact similarity; the best window of each (document, item) stays.

The radius of 20 bits is 3.6 standard deviations above the mean of a pair at similarity 0.8.

Words: runs of letters and digits, lower case. Defined results: NULL and empty texts and items without words
match nothing; an item of fewer than five words is one shingle of its whole length; repeated rows are
reported once per (doc_id, item_id); NULL doc_ids are reported with NULL; empty tables give no rows.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import BROADCAST_ROWS, small, stored

SHINGLE, THRESHOLD, RADIUS, BLOCKS = 5, 0.8, 20, 8


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, k: int) -> Column:
    """Hashes of all k-word shingles, in order, with repeats; fewer than k words: none."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def simhash(hashes: Column) -> Column:
    """Bit set if it is set in more than half of the hashes."""
    bit = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.shiftright(h, b).bitwiseAND(F.lit(1)).cast("int"))
    on = [F.when(bit(b) * 2 > F.size(hashes), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    out = on[0].cast("long")
    for x in on[1:]:
        out = out.bitwiseOR(x.cast("long"))
    return out


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.array_intersect(a, b)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    least = F.aggregate(both, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    shared = F.when(plain, F.size(both)).otherwise(least)
    return shared / (F.size(a) + F.size(b) - shared)


def block(fp: Column, b: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, b * width).bitwiseAND(F.lit((1 << width) - 1))


def leaks(docs: DataFrame, items: DataFrame, *, k: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, item_id, start, similarity): documents' best windows per similar item; start counts words from 0."""
    it = items.select("item_id", tokens(F.col("text")).alias("w")).where("size(w) > 0")
    it = it.withColumn("k", F.least(F.size("w"), F.lit(k)))
    hashed = F.lit(None).cast("array<bigint>")
    for size in range(1, k + 1):
        hashed = F.when(F.col("k") == size, shingles(F.col("w"), size)).otherwise(hashed)
    it = it.withColumn("s", hashed).withColumn("fp", simhash(F.col("s"))).withColumn("size", F.size("w"))
    it = stored(it.select("item_id", "k", "size", "s", "fp"), "items")
    # positions that must be looked for: spread over the item, one more than may be missing
    need = F.size("s") - F.ceil(F.size("s") * F.lit(threshold) - 1e-9).cast("int") + 1
    at = F.transform(F.sequence(F.lit(0), need - 1), lambda i: F.floor(i * F.size("s") / need).cast("int"))
    spots = it.select("item_id", "k", "size", "s", F.explode(at).alias("q")).select("item_id", "size", "k", "q", F.get("s", F.col("q")).alias("h"))
    spots = stored(spots, "anchors")
    n = spots.count()
    anchors = small(spots.drop("k"), n)
    lengths = [r[0] for r in spots.select("k").distinct().collect()]  # k values at most

    row = F.xxhash64("doc_id", "text")
    words = docs.select("doc_id", row.alias("row"), tokens(F.col("text")).alias("w"))
    hits = None
    for size in sorted(lengths):
        found = words.select("row", F.size("w").alias("words"), F.posexplode(shingles(F.col("w"), size)).alias("p", "h")).join(anchors, "h")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:  # no items
        return docs.select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity")).limit(0)
    inside = lambda x: F.greatest(F.lit(0), F.least(x, F.col("words") - F.col("size")))
    starts = F.sequence(inside(F.col("p") - F.col("size") + F.least("size", F.lit(k))), inside(F.col("p")))
    places = stored(hits.select("row", "words", "size", "p").distinct().select("row", "size", F.explode(starts).alias("start")).distinct(), "windows")
    rows = places.select("row").distinct()
    near = words.join(small(rows, rows.count(), BROADCAST_ROWS), "row", "left_semi")
    window = F.slice("w", F.col("start") + 1, F.col("size"))
    cut = places.join(near, "row").select("doc_id", "row", "start", "size", window.alias("w")).dropDuplicates(["row", "start", "size"])
    sets = F.lit(None).cast("array<bigint>")
    for size in range(1, k + 1):
        sets = F.when(F.least("size", F.lit(k)) == size, shingles(F.col("w"), size)).otherwise(sets)
    windows = cut.select("doc_id", "row", "start", "size", sets.alias("v")).where("size(v) > 0")
    windows = stored(windows.withColumn("fp", simhash(F.col("v"))), "fingerprints")

    width = 64 // blocks
    reach = radius // blocks
    flips = [m for m in range(1 << width) if m.bit_count() <= reach]
    assert len(flips) == sum(comb(width, i) for i in range(reach + 1))
    ball = F.transform(F.array(*[F.lit(m).cast("long") for m in flips]), lambda m: F.col("part").bitwiseXOR(m))
    parts = lambda: F.posexplode(F.array(*[block(F.col("fp"), b, width) for b in range(blocks)])).alias("block", "part")
    index = it.select("item_id", "size", F.col("fp").alias("item_fp"), parts()).select("item_id", "size", "item_fp", "block", F.explode(ball).alias("part"))
    index = small(index, it.count() * blocks * len(flips))
    found = windows.select("doc_id", "row", "start", "size", "fp", parts()).join(index, ["size", "block", "part"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    pairs = found.select("row", "start", "size", "item_id").distinct()
    checked = pairs.join(windows.select("doc_id", "row", "start", "size", "v"), ["row", "start", "size"]).join(it.select("item_id", "s"), "item_id")
    scored = checked.select("doc_id", "item_id", "start", weighted_jaccard(F.col("v"), F.col("s")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = F.min(F.struct((-F.col("similarity")).alias("less"), "start")).alias("best")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.start").alias("start"), F.round(-F.col("best.less"), 6).alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that hold a window similar to an item; rows with NULL doc_id are checked by text."""
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id"), F.xxhash64("text", F.lit("no id"))))
    bad = stored(leaks(keyed.select(F.col("__id").alias("doc_id"), "text"), items, **settings).select(F.col("doc_id").alias("__id")).distinct(), "leaks")
    return keyed.join(small(bad, bad.count()), "__id", "left_anti").drop("__id")
