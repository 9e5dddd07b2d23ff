"""Lexical retrieval packing: a sharded BM25 inverted index fills each seed document's window.

Terms are token ids, so every statistic (document frequencies, lengths) has at most one entry per
vocabulary id and is counted over all documents. Documents are dealt to shards by content: each has a key of
three consistently sampled terms, rarer ones likelier (two documents agree in a sample as often as their weighted term
sets overlap), the table is range-partitioned and sorted by the key, and each run of about
``shard_tokens`` tokens in that order is a shard, whose inverted index is held in memory. Equal keys are split by row, so neither a
frequent term nor a group of copies makes a shard larger.

In a shard, whole windows are cut off long documents first. Then the first unused document seeds a window,
BM25 ranks all unused documents of the shard by the seed's terms, and they follow in that order
until the window is full; the last one is cut, and its rest seeds the next window. Only a shard's last window has padding.

A seed sees its shard, so work and memory grow with the input and not with its square; neighbours in other shards
are out of its reach. ``tests/llm`` holds the share of true neighbours in the same shard against that of random shards.

Defined results: NULL and empty texts are the end id alone and are packed like any other; repeated
rows are packed each; ties in a list go to the earlier document of the shard's order; no documents, no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import stored, tidy
from lexiloom.llm.token_output import encoder_of, tokenizer_path

K1, B = 1.2, 0.75
#: Sampled terms of a key.
SAMPLES = 3


def sample_scores(size: int) -> np.ndarray:
    """(SAMPLES, size): the order in which terms are preferred as samples. Later ids of the vocabulary are rarer and weigh more."""
    weight = np.log(np.arange(size) + 2.0) ** 2
    draws = np.random.default_rng(7).random((SAMPLES, size)) ** (1 / weight)
    return np.argsort(np.argsort(draws, axis=1), axis=1).astype(np.int64)


def encoded(docs: DataFrame, end_id: int, path: str) -> DataFrame:
    """(doc_id, ids, key): ids as little-endian unsigned integers, end id included; key: the content's place in the order of shards."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        scores = sample_scores(encoder.size)
        for b in batches:
            for lo, texts in encoder.blocks(b.column("text")):
                flat, offsets = encoder.block(texts, end_id)
                places = pa.py_buffer((offsets * encoder.dtype.itemsize).astype(np.int32).tobytes())
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, places, pa.py_buffer(flat.tobytes())])
                key = np.zeros(len(texts), np.int64)
                for order in scores:
                    key = key << 20 | np.maximum.reduceat(order[flat], offsets[:-1])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, len(texts)), ids, pa.array(key)], ["doc_id", "ids", "key"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(encode), "doc_id long, ids binary, key long")


def distinct(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each id once; ``place`` is scratch space with a cell per id of the vocabulary."""
    at = np.arange(len(ids))
    place[ids] = at
    return ids[place[ids] == at]


def statistics(tokens: DataFrame, dtype: np.dtype, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, tokens and document frequencies; at most ``size`` + 2 rows reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, place = np.zeros(size + 2, np.int64), np.zeros(size, np.int64)
        for b in batches:
            for raw in b["ids"]:
                ids = np.frombuffer(raw, dtype)
                seen[size : size + 2] += 1, len(ids)
                seen[distinct(ids, place)] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"term": at, "n": seen[at]})

    df = np.zeros(size + 2, np.int64)
    for term, n in tokens.select("ids").mapInPandas(tidy(count), "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        df[term] = n
    return int(df[size]), int(df[size + 1]), df[:size]


def pack_shard(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of one shard, each a list of (document, start, length)."""
    n = len(ids)
    out, left = [], np.zeros(n, np.int64)
    for d, x in enumerate(ids):
        whole = len(x) // window * window
        out += [[(d, s, window)] for s in range(0, whole, window)]
        left[d] = len(x) - whole
    length = np.array([len(x) for x in ids], np.int64)
    start = length - left
    place, terms, counts = np.zeros(len(idf), np.int64), [], []
    for x in ids:
        u = distinct(x, place)
        place[u] = np.arange(len(u))
        terms.append(u)
        counts.append(np.bincount(place[x], minlength=len(u)))
    doc = np.repeat(np.arange(n), [len(u) for u in terms])
    term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float64)
    order = np.argsort(term, kind="stable")
    doc, tf, term = doc[order], tf[order], term[order]
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
    first = np.searchsorted(term, np.arange(len(idf) + 1))
    indexed = n

    unused = left > 0
    seeds = iter(np.argsort(-left, kind="stable"))
    seed = next((d for d in seeds if unused[d]), None)
    while seed is not None:
        take, room, rest = [], window, None
        if (free := int(unused.sum())) * 2 < indexed:  # used documents leave the index
            stay = unused[doc]
            doc, weight, term, indexed = doc[stay], weight[stay], term[stay], free
            first = np.searchsorted(term, np.arange(len(idf) + 1))
        chosen = [seed]
        if left[seed] < room:
            begin = first[terms[seed]]
            sizes = first[terms[seed].astype(np.int64) + 1] - begin
            ends = np.cumsum(sizes)
            postings = np.arange(ends[-1]) + np.repeat(begin - ends + sizes, sizes)
            score = np.bincount(doc[postings], weight[postings], n)
            score[~unused] = -1
            score[seed] = -1
            # only as many of the best as can be needed; each holds one token at least
            ranked = np.argsort(-score, kind="stable")[: free - 1]
            enough = int(np.searchsorted(np.cumsum(left[ranked]), room - left[seed])) + 1
            chosen += ranked[:enough].tolist()
        for d in chosen:
            part = int(min(room, left[d]))
            if not part:
                break
            take.append((int(d), int(start[d]), part))
            start[d] += part
            left[d] -= part
            room -= part
            unused[d] = left[d] > 0
            rest = d if unused[d] else None
        out.append(take)
        seed = rest if rest is not None else next((d for d in seeds if unused[d]), None)
    return out


def shards_of(batches: Iterator[pd.DataFrame], dtype: np.dtype, shard_tokens: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """doc_ids and ids of each shard: rows in their order, as many as hold ``shard_tokens`` tokens."""
    doc_ids, ids, held = [], [], 0
    for b in batches:
        for d, raw in zip(b["doc_id"].astype("Int64").tolist(), b["ids"], strict=True):
            doc_ids.append(d)
            ids.append(np.frombuffer(raw, dtype))
            held += len(ids[-1])
            if held >= shard_tokens:
                yield doc_ids, ids
                doc_ids, ids, held = [], [], 0
    if ids:
        yield doc_ids, ids


def in_shard_order(tokens: DataFrame, partitions: int) -> DataFrame:
    """Partitions whose rows are sorted by content; rows of one key by their place in the written table, so they part anywhere."""
    placed = tokens.withColumn("place", F.monotonically_increasing_id())
    return placed.repartitionByRange(partitions, "key", "place").sortWithinPartitions("key", "place")


def pack(docs: DataFrame, *, window: int = 4096, end_id: int = 2, path: str | None = None, shard_tokens: int = 1_000_000, with_ids: bool = True) -> DataFrame:
    """Pieces of packed windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    The sequence id has the partition's number times 2**32 and the window's number in it.
    """
    path = path or tokenizer_path()
    encoder = encoder_of(path)
    dtype, size = encoder.dtype, encoder.size
    tokens = stored(encoded(docs, end_id, path), "tokens")
    count, total, df = statistics(tokens, dtype, size)
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    mean = total / max(1, count)
    share = docs.sparkSession.sparkContext.broadcast(idf)  # one float per id of the vocabulary
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for doc_ids, ids in shards_of(batches, dtype, shard_tokens):
            rows = []
            for pieces in pack_shard(ids, share.value, mean, window):
                at = 0
                for d, s, n in pieces:
                    x = ids[d][s : s + n]
                    rows.append((doc_ids[d], s, n, zlib.crc32(x.astype("<u4").tobytes()), len(ids[d]), number, at, *([x.astype(np.int32)] * with_ids)))
                    at += n
                number += 1
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    partitions = max(1, min(round(total / shard_tokens), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return in_shard_order(tokens, partitions).select("doc_id", "ids").mapInPandas(tidy(run), schema)
