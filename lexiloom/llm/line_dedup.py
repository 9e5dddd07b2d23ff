"""Fuzzy line deduplication, DataFrame expressions only.

Lines are compared without outer blanks and in lower case. Equal lines are collapsed first, by a digest of 128 bits: their
texts are not shuffled for it, shingles are hashed where a line occurs. Then, per distinct line: overlapping character shingles, MinHash signatures of 40 values, dealt to bands of 5 in two ways (recall 0.993 at
the threshold, 0.999 at 0.85), exact Jaccard similarity of the shingle sets of lines that share a band, and a distributed
union-find. Of each component one line stays: that of the smallest doc_id, at its first occurrence there. All other lines of the component are removed from their documents.

MinHash by one permutation: every shingle at every position is hashed once, its hash belongs to one of 40 bins, and each bin
keeps its smallest. A bin without any hash takes the smallest of an own hash function of all bins' values, so lines of few
shingles have independent values too, and lines of the same shingles the same ones.

Defined results: NULL text stays NULL, with 0 lines; blank lines are never removed; a line shorter than a
shingle is its own shingle; rows equal in doc_id and text are treated alike; NULL doc_ids count as
largest; an empty table gives no rows; input columns n_lines and n_removed are replaced, other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import drop, link_buckets, setting, small, stored, sweep

SHINGLE, THRESHOLD, VALUES, ROWS, PARTITIONS = 7, 0.8, 40, 5, 2
#: Words of 64 bits in a sketch, a power of two.
WORDS = 64
#: So many shingles' hashes are made in a row when a set is gathered.
STRIDE = 16
#: Rows that may be broadcast where they are a digest and an id.
KEY_ROWS = 1_000_000
#: NULL doc_ids count as this one.
LAST = (1 << 63) - 1


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, line, h1, h2): non-blank normalised lines with a 128-bit digest."""
    out = docs.select("doc_id", row_key(docs).alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    # blank before the lower case, which is made once then
    out = out.where(F.trim("raw") != "").select("doc_id", "row", "pos", normal(F.col("raw")).alias("line"))
    return out.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def spread(df: DataFrame, k: int, raw: str = "raw") -> DataFrame:
    """``df`` with a row per k-character shingle of its UTF-16 column ``raw``, whose hash h takes that column's place.

    ``raw`` must be a plain column: an expression would be evaluated again for every shingle.
    """
    rest = [c for c in df.columns if c != raw]
    return df.select(*rest, raw, F.explode(starts(F.col(raw), k)).alias("at")).select(*rest, F.xxhash64(F.substring(F.col(raw), F.col("at"), F.lit(2 * k))).alias("h"))


def starts(raw: Column, k: int) -> Column:
    """Byte positions of the shingles, from 1; a shorter text has one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(raw) - 2 * k + 1), F.lit(2))


def bands(values: int, rows: int, partitions: int) -> list[list[int]]:
    """Bands as lists of signature values: each partition deals all values to bands of ``rows`` in another way."""
    n = values // rows
    return [[(b + r * p) % n + r * n for r in range(rows)] for p in range(partitions) for b in range(n)]


def minima(hashes: DataFrame, values: int, by: tuple[str, ...], *also: Column) -> DataFrame:
    """(by, also, m0, m1, ...) of hashes (by, h): each bin's smallest. Hashes are folded to them before the shuffle."""
    binned = hashes.withColumn("bin", F.expr(f"cast((shiftrightunsigned(h, 32) * {values}L) >> 32 as int)"))
    mins = binned.groupBy(*by).agg(*also, *[F.expr(f"min(h) FILTER (WHERE bin = {j})").alias(f"b{j}") for j in range(values)])
    bins = [f"b{j}" for j in range(values)]
    # few lines have an empty bin; only they need the list
    held = mins.withColumn("held", F.when(F.expr(" or ".join(f"{x} is null" for x in bins)), F.array_compact(F.array(*bins))))
    own = lambda j: F.array_min(F.transform("held", lambda x: F.xxhash64(x, F.lit(j))))
    return held.select(*[c for c in mins.columns if c not in bins], *[F.coalesce(f"b{j}", own(j)).alias(f"m{j}") for j in range(values)])


def keys_of(values: int, rows: int, partitions: int) -> Column:
    """The keys of all bands of a signature (m0, m1, ...)."""
    return F.array(*[F.xxhash64(F.lit(b), *[f"m{v}" for v in vs]) for b, vs in enumerate(bands(values, rows, partitions))])


def band_keys(lines: DataFrame, k: int, values: int, rows: int, partitions: int) -> DataFrame:
    """(id, key): one row per line (id, line) and band."""
    hashes = spread(lines.select("id", F.encode("line", "UTF-16BE").alias("raw")), k)
    return minima(hashes, values, ("id",)).select("id", F.explode(keys_of(values, rows, partitions)).alias("key"))


def keyed_lines(docs: DataFrame, k: int, values: int, rows: int, partitions: int) -> DataFrame:
    """(h1, h2, first, n, keys): each different line, its smallest doc_id, how often it occurs and its bands' keys."""
    first = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("first")
    raw = lines_of(docs).select(first, "h1", "h2", F.encode("line", "UTF-16BE").alias("raw"))
    hashes = raw.select("first", "h1", "h2", "raw", F.explode(starts(F.col("raw"), k)).alias("at"))
    hashes = hashes.select("first", "h1", "h2", "at", F.xxhash64(F.substring(F.col("raw"), F.col("at"), F.lit(2 * k))).alias("h"))
    # an occurrence has one shingle at its start
    once = F.sum(F.expr("if(at = 1, 1L, 0L)")).alias("n")
    return minima(hashes, values, ("h1", "h2"), F.min("first").alias("first"), once).select("h1", "h2", "first", "n", keys_of(values, rows, partitions).alias("keys"))


def sketches(lines: DataFrame, k: int, words: int = WORDS) -> DataFrame:
    """(id, size, w) of lines (id, raw): the number of shingles, repeats included, and a set of 64 * words bits with one for each.

    One array, not a column a word: rows of so many columns make plans that the driver has no room for.
    """
    hashes = spread(lines, k)
    word = lambda j: F.expr(f"bit_or(shiftleft(1L, cast(h & 63 as int))) FILTER (WHERE (shiftrightunsigned(h, 6) & {words - 1}) = {j})")
    made = hashes.groupBy("id").agg(F.count("*").alias("size"), *[word(j).alias(f"w{j}") for j in range(words)])
    return made.select("id", "size", F.array(*[F.coalesce(f"w{j}", F.lit(0).cast("long")) for j in range(words)]).alias("w"))


def may_be_similar(threshold: float, words: int = WORDS) -> str:
    """Condition on two sketches that holds for all similar lines.

    Bits that only one has come from as many shingles at least that only one has, of which similar sets have few. Most pairs
    fail by the first quarter of the words already.
    """
    first = " + ".join(f"bit_count(get(w, {j}) ^ get(w2, {j}))" for j in range(-(-words // 4)))
    every = "aggregate(zip_with(w, w2, (x, y) -> bit_count(x ^ y)), 0, (a, c) -> a + c)"
    most = f"(size + size2) * {(1 - threshold) / (1 + threshold)!r}D + 1e-9"
    return f"({first}) <= {most} and {every} <= {most}"


def shingle_sets(lines: DataFrame, k: int) -> DataFrame:
    """(id, s) of lines (id, raw): the different shingles' hashes in 32 bits; of n shingles n * n / 2**33 coincide."""
    last = F.greatest(F.lit(1), F.octet_length("raw") - 2 * k + 1)
    runs = lines.select("id", "raw", last.alias("last")).select("id", "raw", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2 * STRIDE))).alias("at"))
    # the last run repeats the last shingle
    h = lambda i: F.xxhash64(F.substring(F.col("raw"), F.least(F.col("at") + 2 * i, F.col("last")), F.lit(2 * k)))
    made = runs.select("id", F.array(*[F.shiftright(h(i), 32).cast("int") for i in range(STRIDE)]).alias("h"))
    return made.groupBy("id").agg(F.flatten(F.collect_list("h")).alias("s")).select("id", F.array_distinct("s").alias("s"))


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose sets (id, s) are similar enough."""
    x, y = sets.select(F.col("id").alias("a"), F.col("s").alias("x")), sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", (F.size("x") + F.size("y")).alias("t"), F.size(F.array_intersect("x", "y")).alias("s"))
    return both.where(F.col("s") >= F.lit(threshold) * (F.col("t") - F.col("s"))).select("a", "b")


def shared_keys(members: DataFrame) -> DataFrame:
    """(key): those of several members (key, id).

    Nearly every key is of one line, so a small map before the large one is soon full and only costs a look more for each row.
    """
    with setting(members.sparkSession, "spark.sql.codegen.aggregate.map.twolevel.enabled", "false"):
        return stored(members.groupBy("key").count().where("count > 1").select("key"), "keys")


def line_classes(docs: DataFrame, *, k: int = SHINGLE, threshold: float = THRESHOLD, values: int = VALUES, rows: int = ROWS, partitions: int = PARTITIONS) -> tuple[DataFrame, DataFrame]:
    """Lines with copies or links: their places (id, doc_id, row, pos) and (id, keep), the doc_id where one occurrence stays, NULL where none does."""
    # numbers once given are written down, so they stay the same whatever is computed again
    table = stored(keyed_lines(docs, k, values, rows, partitions).withColumn("id", F.monotonically_increasing_id()), "lines")
    members = table.select("id", F.explode("keys").alias("key"))
    shared = shared_keys(members)
    meet = stored(members.join(small(shared, shared.count(), KEY_ROWS), "key", "left_semi").select("key", "id"), "meet")
    ids = meet.select("id").distinct().withColumn("meets", F.lit(True))
    marked = table.select("id", "h1", "h2", "first", "n").join(small(ids, ids.count(), KEY_ROWS), "id", "left").withColumn("meets", F.coalesce("meets", F.lit(False)))
    known = stored(marked.where("meets or n > 1"), "known")
    drop(table, shared)
    places = stored(occurrences(docs, known), "places")
    texts = places.where("line is not null").select("id", "line").distinct()
    raw = stored(texts.select("id", F.encode("line", "UTF-16BE").alias("raw")), "candidates")
    # sketches spare most pairs the comparison of whole sets
    sketch, alike = stored(sketches(raw, k), "sketches"), may_be_similar(threshold)

    def sets_of(some: DataFrame) -> DataFrame:
        some = stored(some.distinct(), "ids")
        out = stored(shingle_sets(raw.join(small(some, some.count(), KEY_ROWS), "id", "left_semi"), k), "sets")
        drop(some)
        return out

    def verify(pairs: DataFrame) -> DataFrame:
        first, second = sketch.withColumnRenamed("id", "a"), sketch.select(F.col("id").alias("b"), *[F.col(x).alias(x + "2") for x in sketch.columns if x != "id"])
        close = stored(pairs.join(first, "a").join(second, "b").where(alike).select("a", "b"), "pairs")
        sets = sets_of(close.select(F.explode(F.array("a", "b")).alias("id")))
        found = stored(similar(close, sets, threshold), "similar")
        drop(close, sets)
        return found

    def rare_shingles(open_ids: DataFrame) -> DataFrame:
        """Each id's rarest shingles, one more than a similar line may lack."""
        sets = sets_of(open_ids.select("id"))
        every = stored(open_ids.join(sets, "id").select("id", "c", F.size("s").alias("n"), F.explode("s").alias("token")), "shingles")
        # a shingle of one line joins nothing; it still takes its place among the rarest
        often = every.groupBy("token").count().where("count > 1")
        common = every.join(often, "token")
        rank = F.row_number().over(Window.partitionBy("id").orderBy("count", "token"))
        held = F.count("*").over(Window.partitionBy("id"))
        placed = common.withColumns({"rank": rank, "held": held}).withColumn("rank", F.col("rank") + F.col("n") - F.col("held"))
        most = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
        out = stored(placed.where(F.col("rank") <= most).select("id", "c", "token", "rank", "n"), "tokens")
        drop(sets, every)
        return out

    comp = link_buckets(meet, verify, tokens=rare_shingles, threshold=threshold, sketch=sketch, near=alike)
    linked = stored(known.select("id", "h1", "h2", "first").join(comp, "id"), "linked")
    best = linked.groupBy("component").agg(F.min(F.struct("first", "h1", "h2")).alias("best"))
    near = linked.join(best, "component").select("id", F.when((F.col("best.h1") == F.col("h1")) & (F.col("best.h2") == F.col("h2")), F.col("first")).alias("keep"))
    copies = known.where("n > 1").join(linked, "id", "left_anti").select("id", F.col("first").alias("keep"))
    classes = stored(near.unionByName(copies), "classes")
    drop(meet, raw, sketch, linked, comp, known)
    return places, classes


def occurrences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, doc_id, row, pos, line) of known lines (id, h1, h2, meets); line is NULL where no other line is met."""
    every = lines_of(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "row", "pos", "line", "h1", "h2")
    digests = known.select("id", F.col("h1").alias("k1"), F.col("h2").alias("k2"), "meets")
    # a table keyed by one long is small; the second half of the digest is compared behind it
    both = (F.col("h1") == F.col("k1")) & (F.col("h2").bitwiseXOR(F.col("k2")) == 0)
    found = every.join(small(digests, digests.count(), KEY_ROWS), both)
    return found.select("id", "doc_id", "row", "pos", F.when(F.col("meets"), F.col("line")).alias("line"))


def removals(docs: DataFrame, **settings) -> DataFrame:
    """(row, removed): positions of removed lines, for documents that lose some."""
    places, classes = line_classes(docs, **settings)
    spots = stored(places.drop("line").join(small(classes, classes.count()), "id"), "spots")
    drop(places, classes)
    # of several texts under the kept doc_id one keeps the line; a line's one staying place is an aggregate, so no line's occurrences meet
    stays = spots.where("keep = doc_id").groupBy("id").agg(F.min(F.struct("row", "pos")).alias("at"))
    stays = stays.select(F.col("at.row").alias("row"), F.col("at.pos").alias("pos"))
    out = stored(spots.select("row", "pos").join(stays, ["row", "pos"], "left_anti").groupBy("row").agg(F.collect_set("pos").alias("removed")), "removed")
    drop(spots)
    return out


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with texts less their removed lines, and n_lines and n_removed (long)."""
    # stages of many columns become methods too long for the JVM to compile; under this limit Spark runs them in small ones
    with setting(docs.sparkSession, "spark.sql.codegen.hugeMethodLimit", "8000"):
        gone = removals(docs, **settings)
    sweep(docs.sparkSession)
    gone = gone.select(F.col("row").alias("__row"), F.col("removed").alias("__gone"))
    joined = docs.withColumn("__row", row_key(docs)).join(gone, "__row", "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    out = joined.withColumns({"n_lines": n_lines, "n_removed": F.coalesce(F.array_size("__gone"), F.lit(0)).cast("long"), "text": text})
    return out.drop("__row", "__gone")
