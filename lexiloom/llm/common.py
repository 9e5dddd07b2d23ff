"""Shared pieces of the training-data operators: scratch tables, word expressions, union-find, bucket linking.

Everything that outlives a stage is a written table in the folder that the cluster names in
``spark.checkpoint.dir``; nothing is kept in executors only, so a lost executor costs a
recomputation of its tasks and never a failed job.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the documents' contracts: blank and the bytes 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Broadcast hints are given only to tables whose counted rows stay at or under this.
BROADCAST_ROWS = 200_000
#: Buckets of up to so many members compare all their sketches, which is linear in the memberships.
CROWD = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is configured: a local one in local mode (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    small_batches(spark)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Batches to Python are held in both processes, several times over: 16 MB each, unless the session has less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "16m")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for some writes, put back afterwards."""
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, value)
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, what: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives executors.

    Shuffle files of the finished write are released at once, since only the table is needed.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted size allows it; else leave the join to the planner."""
    return F.broadcast(df) if rows <= limit else df


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage: its broadcast tables and shuffle files of finished steps go only then, and its heap shrinks."""
    gc.collect()
    spark._jvm.System.gc()


def release() -> None:
    """Give memory that a worker no longer uses back to the system; idle workers count as well."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A partition's function that releases memory at its end."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Non-empty words of a text (NULL: no words)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def few(df: DataFrame, rows: int) -> DataFrame:
    """Fewer tasks for a counted table that is small for the session's number of shuffle partitions."""
    n = max(8, rows // 25_000)
    return df.coalesce(n) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Distributed union-find: (a, b) links to (id, component), component the smallest reachable id.

    Alternating large-star and small-star steps (Kiveris et al., 2014). A step groups with ``min``
    (combined map-side) and joins back, so a node with very many neighbours is no single task's
    list. Ids that have no link do not appear. Loops end when every id points at a root.
    """
    pairs = links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(pairs.distinct(), "edges")

    def settled(df: DataFrame, rows: int) -> bool:
        """Whether every id has one link, and that to an id without any."""
        twice = few(df.groupBy("a").count().where("count > 1").select("a"), rows)
        chained = df.join(small(few(df.select(F.col("a").alias("b")).distinct(), rows), rows), "b", "left_semi").select("a")
        return twice.unionByName(chained).isEmpty()

    n = edges.count()
    for _ in range(max_rounds):
        if settled(edges, n):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = few(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), 2 * n)
        large = both.where("b > a").join(small(least, 2 * n), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = few(large.groupBy("a").agg(F.min("b").alias("m")), n)
        joined = large.join(small(least, n), "a")
        step = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")
        new = stored(few(step.distinct(), n), "edges")
        drop(edges)
        edges, n = new, new.count()
    else:
        raise RuntimeError("union-find did not settle")
    roots = few(edges.select(F.col("b").alias("id")).distinct(), n).withColumn("component", F.col("id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def joined_components(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after more links (a, b): only whole components go through the union-find again."""
    of = lambda name: comp.select(F.col("id").alias(name), F.col("component").alias(f"c{name}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    up = stored(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "joined")
    moved = comp.join(up.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    new = up.join(comp.select("id"), "id", "left_anti")
    return moved.select("id", F.coalesce("to", "component").alias("component")).unionByName(new.select("id", "component"))


def link_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], rounds: int = 2, tokens: Callable[[DataFrame], DataFrame] | None = None, threshold: float = 0.8, sketch: DataFrame | None = None, near: str = "true", crowd: int = CROWD) -> DataFrame:
    """Components of all verified pairs that share a bucket, without emitting all pairs of a bucket.

    ``members`` has (key, id), one row per membership; ``verify`` keeps those rows of (a, b) that
    are links. Every pair sharing a bucket is either verified or already joined through others:

    1. each bucket's members are verified against its smallest member;
    2. for ``rounds`` times, buckets that still span several components verify the members outside
       their largest component against another representative of that component;
    3. what is left compares members of *different* components only: all pairs of a bucket or, with
       ``tokens``, all that share a token. That function turns (id, c) into a table (id, c, token, rank, n)
       with each id's rarest tokens, their ranks from 1 and the size of its set; sets of Jaccard similarity
       ``threshold`` share one, and the first they share stands so early in both that what follows it
       can make up the overlap they need (prefix and positional filtering). With a ``sketch``, a table (id, ...)
       of which ``near`` holds for every linked pair (SQL over its columns and the second one's, named with a 2 at
       the end), buckets of up to ``crowd`` members compare the sketches of all pairs; only larger ones go by tokens.

    A bucket of n near copies costs about n comparisons; only pairs that no chain of links joins
    are compared one by one. Returns (id, component) for linked ids.
    """
    sized = members.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    open_ = stored(members.join(sized, "key").select("key", "id", "rep", "n"), "members")
    rows = open_.count()
    pairs = few(open_.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct(), rows)
    found = stored(verify(pairs), "links")
    comp = stored(components(found), "components")
    # two members: the one pair was compared; larger buckets go on until one component is left
    wide = stored(open_.where("n > 2").select("key", "id", "rep"), "members")
    drop(open_, found)

    def labelled(df: DataFrame) -> DataFrame:
        lab = few(df.join(comp, "id", "left").select("key", "id", "rep", F.coalesce("component", "id").alias("c")), rows)
        mixed = few(lab.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), rows)
        return stored(few(lab.join(mixed, "key", "left_semi"), rows), "members")

    def beside(df: DataFrame, condition: str) -> DataFrame:
        """(id, to): pairs of rows of a bucket, as far as their sketches allow a link."""
        df = df.select("key", "id", "rep", "c")
        df = df if sketch is None else df.join(sketch, "id")
        other = df.select("key", *[F.col(x).alias(x + "2") for x in df.columns if x != "key"])
        return df.join(other, "key").where(f"{condition} and {near}").select("id", F.col("id2").alias("to"))

    def by_tokens(df: DataFrame) -> DataFrame:
        own = tokens(few(df.select("id", "c").distinct(), rows))
        other = own.select("token", F.col("id").alias("to"), F.col("c").alias("c2"), F.col("rank").alias("rank2"), F.col("n").alias("n2"))
        enough = f"1 + least(n - rank, n2 - rank2) >= (n + n2) * {threshold / (1 + threshold)!r}D - 1e-9"
        return own.join(other, "token").where(f"c < c2 and {enough}").select("id", "to")

    for r in range(1, rounds + 2):
        sweep(members.sparkSession)
        left = labelled(wide)
        drop(wide)
        wide = left.select("key", "id", "rep")
        wide._scratch = left._scratch
        rows = left.count()
        if not rows:
            break
        if r <= rounds:
            per = few(left.groupBy("key", "c").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(r)), "id"))["id"].alias("to")), rows)
            best = few(per.groupBy("key").agg(F.max(F.struct("n", "c", "to")).alias("best")).where("best.n > 1").select("key", F.col("best.c").alias("top"), F.col("best.to").alias("to")), rows)
            pairs = left.join(best, "key").where("c <> top").select("id", "to")
        elif tokens and sketch is None:
            pairs = by_tokens(left)
        else:
            every, crowded = left, None
            if tokens:
                crowded = few(left.groupBy("key").count(), rows).where(F.col("count") > crowd).select("key")
                every = left.join(crowded, "key", "left_anti")
            # pairs with the bucket's smallest member were compared in the first step
            pairs = beside(every, "c < c2 and id <> rep and id2 <> rep2")
            if crowded is not None and not crowded.isEmpty():
                pairs = pairs.unionByName(by_tokens(left.join(crowded, "key", "left_semi")))
        pairs = few(pairs.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct(), rows)
        more = stored(verify(pairs), "links")
        if not more.isEmpty():
            again = stored(joined_components(comp, more), "components")
            drop(comp)
            comp = again
        drop(more)
    drop(wide)
    return comp


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
