"""SimHash near-duplicates by multi-index hashing.

Fingerprint: 64 bits over word shingles with repeats; a bit is set if it is set in more than half of the
shingles' hashes (XXH64, seed 42). Linking, over *distinct* fingerprints only: the fingerprint is cut
into two segments of 32 bits. Two fingerprints within 3 bits differ by 1 bit at most in one of the
segments, so each looks up the Hamming ball of radius 1 around both of its segments in a table of
segments and verifies the whole distance. Found links go through a distributed union-find.

Defined results: NULL is an empty text; no words give fingerprint 0, linked like any other; repeated
rows and equal texts share a component; an empty table gives no rows. NULL doc_ids keep their row
and count as no document's smallest id unless all of the component's are NULL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import LOWER, UPPER, drop, link_buckets, stored, tidy

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans(UPPER, LOWER)


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = WORDS.findall((text or "").translate(FOLD))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    half, ones = n / 2, np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        part = [xxh64_intdigest(" ".join(words[i : i + shingle]).encode("utf-8", "surrogatepass"), 42) for i in range(lo, min(n, lo + 65536))]
        ones += np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones > half).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint_of(t, shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fps})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(tidy(run), "doc_id long, fp long")


def near_components(fps: DataFrame, distance: int = 3, segment_bits: int = 32) -> DataFrame:
    """(id, component) of distinct fingerprints (fp) linked at ``distance`` or fewer bits, as far as they have links.

    A bucket is one table segment with the fingerprints whose ball reaches it; every linked pair shares
    the bucket of a segment in which they differ by ``distance`` // segments bits at most.
    """
    n = 64 // segment_bits
    radius = distance // n
    if radius > 1:
        raise ValueError("balls of radius 0 or 1 only: use more segments")
    mask = (1 << segment_bits) - 1
    cut = F.array(*[F.expr(f"shiftrightunsigned(fp, {i * segment_bits}) & {mask}L") for i in range(n)])
    own = fps.select(F.col("fp").alias("id"), F.posexplode(cut).alias("seg", "part"))
    flips = F.array(F.lit(0).cast("long"), *([F.lit(1 << i).cast("long") for i in range(segment_bits)] if radius else []))
    key = lambda part: F.shiftleft(F.col("seg").cast("long"), segment_bits).bitwiseOR(part).alias("key")
    ball = own.select("id", "seg", F.explode(F.transform(flips, lambda m: F.col("part").bitwiseXOR(m))).alias("near")).select("id", key(F.col("near")))
    table = own.select(key(F.col("part"))).distinct()
    return link_buckets(ball.join(table, "key", "left_semi"), lambda pairs: pairs.where(f"bit_count(a ^ b) <= {distance}"))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, distance: int = 3, segment_bits: int = 32) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every document (doc_id, text)."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = near_components(distinct, distance, segment_bits)
    of = distinct.join(comp, distinct["fp"] == comp["id"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    roots = of.groupBy("c").agg(F.min("least").alias("component_id"))
    classes = stored(of.join(roots, "c").select("fp", "component_id"), "classes")
    drop(distinct)
    return prints.join(classes, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each component: its smallest doc_id; rows with NULL doc_id stay.

    Repeated rows of one doc_id are one document's copies: a single row stays.
    """
    classes = near_duplicates(docs, **settings)
    kept = classes.where("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))
