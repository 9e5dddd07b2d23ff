"""Language-model scoring with an Elias-Fano n-gram trie.

Levels (each a set of memory-mapped shard files, see ``elias_fano``):

* vocabulary: sorted 64-bit word hashes with counts; a word's id is its rank;
* bigrams: per first word a monotone pointer, and the second words' ids;
* trigrams: per bigram a monotone pointer, and the third word as its *rank among the successors of the second word*,
  so a query first finds (second, third) among the bigrams and then searches that rank.

Probabilities: interpolated absolute discounting. With D = n1 / (n1 + 2 n2) per order,
p(x | v w) = max(c - D, 0) / c(v w) + g(v w) p(x | w), where g is whatever mass the kept successors leave, and likewise
for p(x | w); p(x) = (c - D) / N for known tokens and D V / N for the one unknown token, so each sums
to 1 over the V tokens and the unknown one. Ratios and g are quantised to 16 bits on a logarithmic scale
(steps of 12/65534 decades). Every bigram and trigram of the training rows has an entry, those that occur once too.

Documents are counted in tasks; what goes between tasks are compressed sorted blocks of distinct keys with
counts, dealt by ranges of the first word, so a frequent word or pair arrives once from each task.

Defined results: NULL and empty texts are the end token alone; repeated rows count repeatedly; NULL doc_ids are
learnt from; with no training row every token is unknown with probability 1; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import elias_fano, shared_files
from lexiloom.llm.common import LOWER, UPPER, drop, release, stored, tidy

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans(UPPER, LOWER)
FOLDS, HELD = 7, 2
STEP = 12 / 65534
UNKNOWN = 0xFFFFFFFF
#: Tokens handled at once.
TOKENS = 1_000_000
#: Bytes of text that are cut at once.
BLOCK = 8_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


#: No word holds a line feed.
END = "\n"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(FOLD))


def word_hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


def coded_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different tokens, each token's place among them, and the documents' starts (one more than documents)."""
    from xxhash import xxh64_intdigest

    # the ASCII kernels know exactly these letters and blanks, and leave other bytes alone
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    offsets, coded = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
    kinds, codes = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy()
    hashes = np.array([xxh64_intdigest(w, 42) for w in kinds] + [word_hash(END)], np.uint64)
    if b"" in kinds:
        real = codes != kinds.index(b"")
        offsets, codes = np.concatenate([[0], np.cumsum(real)])[offsets], codes[real]
    # an end token behind each document's words
    starts = offsets + np.arange(len(offsets))
    at = np.full(starts[-1], len(kinds), np.int32)
    inner = np.ones(len(at), bool)
    inner[starts[1:] - 1] = False
    at[inner] = codes
    return hashes, at, starts


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BLOCK bytes of text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
        cuts = np.unique(np.searchsorted(size, np.arange(BLOCK, size[-1] if len(size) else 0, BLOCK)) + 1)
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if lo < hi:
                yield batch.slice(lo, hi - lo)


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log10(p) / STEP)
    return np.where(p > 0, np.clip(code, 0, 65534), 65535).astype(np.uint16)


PROBABILITY = np.append(10.0 ** (-STEP * np.arange(65535)), 0.0)


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys with counts, as deltas, compressed."""
    import zstandard

    deltas = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    columns = np.ascontiguousarray(deltas.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    raw = len(keys).to_bytes(8, "little") + columns.tobytes() + np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    deltas = np.ascontiguousarray(raw[8 : 8 + 8 * n].reshape(8, n).T).view("<u8").reshape(-1)
    counts = np.ascontiguousarray(raw[8 + 8 * n :].reshape(8, n).T).view("<u8").reshape(-1)
    return np.cumsum(deltas, dtype=np.uint64), counts.astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpacked(bytes(b)) for b in blobs]
    return summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


@dataclass(frozen=True)
class Trie:
    folder: str
    shards: int  # of the bigrams and trigrams
    vocabulary: tuple[tuple[int, int, int], ...]  # part, words, base
    words: int
    tokens: int
    starts: int  # training documents
    discounts: tuple[float, float, float]
    bases: tuple[int, ...] = ()  # bigrams before each shard


class Reader:
    """Maps a trie's files in a worker and answers arrays of queries."""

    def __init__(self, trie: Trie):
        self.trie = trie
        parts = [elias_fano.load(f"{trie.folder}/words-{p:05d}") for p, _, _ in trie.vocabulary]
        self.parts = [(x["hash"], x["count"]) for x in parts]
        self.first = np.array([b for _, _, b in trie.vocabulary], np.int64)
        self.top = np.array([p for p, _, _ in trie.vocabulary], np.int64)

    def bounds(self, shard: int) -> tuple[int, int]:
        """First words [lo, hi) of a shard; the start token's id is the number of words."""
        n, s = self.trie.words + 1, self.trie.shards
        return -(-shard * n // s), -(-(shard + 1) * n // s)

    def shard_of(self, first: np.ndarray) -> np.ndarray:
        return first * self.trie.shards // (self.trie.words + 1)

    @lru_cache(None)  # noqa: B019
    def bigram_shard(self, shard: int):
        x = elias_fano.load(f"{self.trie.folder}/bigrams-{shard:05d}")
        return elias_fano.Level(x), x

    @lru_cache(None)  # noqa: B019
    def trigram_shard(self, shard: int):
        x = elias_fano.load(f"{self.trie.folder}/trigrams-{shard:05d}")
        return elias_fano.Level(x), x

    def known(self, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (UNKNOWN if there is none) and training counts of different hashes."""
        order = np.argsort(hashes)
        ask, ids, counts = hashes[order], np.full(len(hashes), UNKNOWN, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(ask >> np.uint64(64 - bits) if bits else np.zeros(len(ask), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))
        for k, p in enumerate(self.top.tolist()):
            a, b = cuts[p], cuts[p + 1]
            if a < b:
                have, n = self.parts[k]
                i = np.minimum(np.searchsorted(have, ask[a:b]), len(have) - 1)
                ok = np.flatnonzero(have[i] == ask[a:b])
                ids[order[a + ok]] = self.first[k] + i[ok]
                counts[order[a + ok]] = n[i[ok]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts; 0 for the unknown token, the number of training documents for the start."""
        out = np.zeros(len(ids), np.int64)
        out[ids == self.trie.words] = self.trie.starts
        order = np.argsort(ids)
        ask = ids[order]
        cuts = np.searchsorted(ask, np.append(self.first, self.trie.words))
        for k in range(len(self.parts)):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                out[order[a:b]] = self.parts[k][1][ask[a:b] - self.first[k]]
        return out

    def by_shard(self, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        known = np.flatnonzero(first <= self.trie.words)
        shard = self.shard_of(first[known])
        order = np.argsort(shard.astype(np.uint16), kind="stable")  # at most 4096 shards: sorted by radix
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)) if len(order) else []
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            yield int(shard[order[a]]), known[order[a:b]]

    def bigrams(self, v: np.ndarray, w: np.ndarray, *, payload: bool = True) -> dict[str, np.ndarray]:
        """Of pairs: index in v's shard, rank among v's successors, quantised ratio; and the quantised rest of v."""
        out = {"index": np.full(len(v), -1, np.int64), "rank": np.full(len(v), -1, np.int64), "ratio": np.full(len(v), 65535, np.uint16), "rest": np.zeros(len(v), np.uint16)}
        for s, at in self.by_shard(v):
            level, x = self.bigram_shard(s)
            parent = v[at] - self.bounds(s)[0]
            known = np.flatnonzero(w[at] <= self.trie.words)
            i, r = level.find(parent[known], w[at[known]])
            out["index"][at[known]], out["rank"][at[known]] = i, r
            if payload:
                out["rest"][at] = x["rest"][parent]
                ok = known[i >= 0]
                out["ratio"][at[ok]] = x["ratio"][i[i >= 0]]
        return out

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token; ``first`` marks the documents' first tokens."""
        n, t = len(ids), self.trie
        before = np.where(first, t.words, np.concatenate([[t.words], ids[:-1]]))
        pairs, at = np.unique(before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64), return_inverse=True)
        v, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        c = self.counts(w)
        d1 = t.discounts[0]
        unigram = np.where(c > 0, (c - d1) / max(1, t.tokens), d1 * t.words / t.tokens if t.tokens else 1.0)
        two = self.bigrams(v, w)
        p = PROBABILITY[two["ratio"]] + PROBABILITY[two["rest"]] * unigram
        index, rank, p = two["index"][at], two["rank"][at], p[at]
        # trigrams: the bigram that ends just before, and the rank of this token after the last one
        context = np.where(first, -1, np.concatenate([[-1], index[:-1]]))
        head = np.concatenate([[0], before[:-1]])
        ask = np.flatnonzero(context >= 0)
        for s, i in self.by_shard(head[ask]):
            i = ask[i]
            level, x = self.trigram_shard(s)
            rest = PROBABILITY[x["rest"][context[i]]]
            found = np.flatnonzero(rank[i] >= 0)
            # each different trigram once and in order, so the level is read forwards
            asked, back = np.unique(context[i[found]] << 24 | rank[i[found]], return_inverse=True)
            k = level.find(asked >> 24, asked & (1 << 24) - 1)[0][back]
            ratio = np.zeros(len(i))
            ratio[found[k >= 0]] = PROBABILITY[x["ratio"][k[k >= 0]]]
            p[i] = ratio + rest * p[i]
        assert len(p) == n
        return np.log10(np.maximum(p, 1e-300))


@lru_cache(2)
def reader_of(trie: Trie) -> Reader:
    return Reader(trie)


def _vocabulary(docs: DataFrame, folder: str, bits: int) -> tuple[list, int]:
    def part_of(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes))).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _texts(batches):
            hashes, at, _ = coded_words(batch.column("text"))
            n = np.bincount(at, minlength=len(hashes))
            held.append(summed(hashes[n > 0], n[n > 0]))
            size += len(held[-1][0])
            if size > 3 * TOKENS:
                yield pa.RecordBatch.from_pandas(_blocks(held, part_of), preserve_index=False)
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_pandas(_blocks(held, part_of), preserve_index=False)

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        h, n = merged(part["block"].tolist())
        elias_fano.save(f"{folder}/words-{key[0]:05d}", {"hash": h, "count": n})
        return pd.DataFrame({"part": [key[0]], "words": [len(n)], "tokens": [n.sum()], "n1": [(n == 1).sum()], "n2": [(n == 2).sum()]})

    counted = docs.select("text").mapInArrow(tidy(count), "shard int, block binary")
    rows = counted.groupBy("shard").applyInPandas(write, "part int, words long, tokens long, n1 long, n2 long").collect()
    return sorted(rows), bits


def _encoded(docs: DataFrame, trie: Trie, bits: int) -> DataFrame:
    """(doc_id, held_out, ids, n_tokens, n_known, base_score) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(trie)
        for part in _texts(batches):
            hashes, at, starts = coded_words(part.column("text"))
            ids, c = reader.known(hashes, bits)
            base = np.log10((c + 1) / (trie.tokens + trie.words + 1))
            raw = pa.py_buffer(ids.astype("<u4")[at].tobytes())
            binary = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((starts * 4).astype(np.int32).tobytes()), raw])
            columns = [part.column("doc_id"), part.column("held_out"), binary, np.diff(starts), np.add.reduceat((c > 0)[at], starts[:-1], dtype=np.int64), np.add.reduceat(base[at], starts[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], ["doc_id", "held_out", "ids", "n_tokens", "n_known", "base_score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, ids binary, n_tokens long, n_known long, base_score double")


def _slabs(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of about TOKENS tokens: the rows, all ids, marks of first tokens, and the rows' starts."""
    for b in batches:
        size = b["ids"].map(len).to_numpy() // 4
        slab = (np.cumsum(size) - 1) // TOKENS
        for _, rows in b.groupby(slab, sort=False):
            ids = np.frombuffer(b"".join(rows["ids"]), "<u4").astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(rows["ids"].map(len).to_numpy() // 4)[:-1]])
            first = np.zeros(len(ids), bool)
            first[starts] = True
            yield rows[columns], ids, first, starts


def _blocks(keys: list[tuple[np.ndarray, np.ndarray]], shard_of) -> pd.DataFrame:
    k, c = summed(np.concatenate([x for x, _ in keys]), np.concatenate([x for _, x in keys]))
    shard = shard_of(k)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = [*cuts[1:], len(k)]
    return pd.DataFrame({"shard": shard[cuts].astype(np.int32), "block": [packed(k[a:b], c[a:b]) for a, b in zip(cuts, ends, strict=True)]})


def _counted(tokens: DataFrame, trie: Trie, keys_of, shard_of) -> DataFrame:
    """(shard, block, n1, n2): one block per shard with all keys."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, held, size = reader_of(trie), [], 0
        for _, ids, first, _ in _slabs(batches, ["n_tokens"]):
            held.append(summed(keys_of(reader, ids, first)))
            size += len(held[-1][0])
            if size > 3 * TOKENS:
                yield _blocks(held, lambda k: shard_of(reader, k))
                held, size = [], 0
        if size:
            yield _blocks(held, lambda k: shard_of(reader, k))

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        k, c = merged(part["block"].tolist())
        release()
        return pd.DataFrame({"shard": [key[0]], "block": [packed(k, c)], "n1": [(c == 1).sum()], "n2": [(c == 2).sum()]})

    counted = tokens.where("not held_out").select("ids", "n_tokens").mapInPandas(tidy(count), "shard int, block binary")
    return stored(counted.groupBy("shard").applyInPandas(merge, "shard int, block binary, n1 long, n2 long"), "counts")


def _discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5


def _built(counts: DataFrame, trie: Trie, build) -> list:
    """Build and write the files of every shard, of those without counted keys too."""
    spark = counts.sparkSession
    every = spark.range(trie.shards).select(F.col("id").cast("int").alias("shard")).join(counts.select("shard", "block"), "shard", "left")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        blob = part["block"].iloc[0]
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return pd.DataFrame({"shard": [key[0]], "n": [build(reader_of(trie), int(key[0]), *(empty if blob is None else unpacked(bytes(blob))))]})

    return sorted(every.groupBy("shard").applyInPandas(run, "shard int, n long").collect())


def _pairs(reader: Reader, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.where(first, reader.trie.words, np.concatenate([[0], ids[:-1]]))
    return before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def _triples(reader: Reader, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of trigrams:
    first word's shard (12 bits), bigram in it (28 bits), rank of the third (24 bits)."""
    pairs, at = np.unique(_pairs(reader, ids, first), return_inverse=True)
    two = reader.bigrams((pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), payload=False)
    index, rank = two["index"][at], two["rank"][at]
    head = np.where(first, reader.trie.words, np.concatenate([[0], ids[:-1]]))
    ok = np.flatnonzero(~first[1:] & (index[:-1] >= 0) & (rank[1:] >= 0))
    shard = reader.shard_of(head[:-1][ok])
    if ok.size and (index.max() >= 1 << 28 or rank.max() >= 1 << 24):
        raise OverflowError("more shards are needed")
    return shard.astype(np.uint64) << np.uint64(52) | index[:-1][ok].astype(np.uint64) << np.uint64(24) | rank[1:][ok].astype(np.uint64)


def train(docs: DataFrame, folder: str, shards: int) -> tuple[Trie, DataFrame]:
    """Build the trie from ``docs`` (doc_id, text, held_out) and return it with the encoded documents."""
    # a slab of tokens asks every shard, so there are no more of them than asked for
    bits = max(0, min(12, shards.bit_length() - 1))
    shards = 1 << bits
    rows, bits = _vocabulary(docs.where("not held_out"), folder, bits)
    parts, base = [], 0
    for r in rows:
        parts.append((r.part, r.words, base))
        base += r.words
    if base >= UNKNOWN - 1:
        raise OverflowError("word ids have 32 bits")
    tokens, n1, n2 = (sum(r[k] for r in rows) for k in ("tokens", "n1", "n2"))
    d1 = _discount(n1, n2)
    trie = Trie(folder, shards, tuple(parts), base, tokens, 0, (d1, 0.5, 0.5))
    encoded = stored(_encoded(docs, trie, bits), "ids")
    starts = encoded.where("not held_out").count()
    trie = Trie(folder, shards, tuple(parts), base, tokens, starts, (d1, 0.5, 0.5))

    counts = _counted(encoded, trie, _pairs, lambda r, k: r.shard_of((k >> np.uint64(32)).astype(np.int64)))
    d2 = _discount(*counts.agg(F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n2"), F.lit(0))).first())
    trie = Trie(folder, shards, tuple(parts), base, tokens, starts, (d1, d2, 0.5))

    def bigrams(reader: Reader, shard: int, keys: np.ndarray, c: np.ndarray) -> int:
        lo, hi = reader.bounds(shard)
        v, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        total = np.maximum(1, reader.counts(np.arange(lo, hi)))
        ratio = (c - d2) / total[v - lo]
        kept = np.bincount(v - lo, ratio, hi - lo)
        elias_fano.save(f"{folder}/bigrams-{shard:05d}", elias_fano.Level.encode(v - lo, w, hi - lo) | {"ratio": quantised(ratio), "rest": quantised(np.maximum(0, 1 - kept)), "count": c.astype(np.uint32 if c.max(initial=0) < 1 << 32 else np.uint64)})
        return len(keys)

    _built(counts, trie, bigrams)
    drop(counts)
    counts = _counted(encoded, trie, _triples, lambda r, k: (k >> np.uint64(52)).astype(np.int64))
    d3 = _discount(*counts.agg(F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n2"), F.lit(0))).first())
    trie = Trie(folder, shards, tuple(parts), base, tokens, starts, (d1, d2, d3))

    def trigrams(reader: Reader, shard: int, keys: np.ndarray, c: np.ndarray) -> int:
        total = reader.bigram_shard(shard)[1]["count"].astype(np.float64)
        parent, rank = (keys >> np.uint64(24)).astype(np.int64) & (1 << 28) - 1, (keys & np.uint64((1 << 24) - 1)).astype(np.int64)
        ratio = (c - d3) / total[parent]
        kept = np.bincount(parent, ratio, len(total)) if len(total) else np.zeros(0)
        elias_fano.save(f"{folder}/trigrams-{shard:05d}", elias_fano.Level.encode(parent, rank, len(total)) | {"ratio": quantised(ratio), "rest": quantised(np.maximum(0, 1 - kept))})
        return len(keys)

    _built(counts, trie, trigrams)
    drop(counts)
    return trie, encoded


def scored(encoded: DataFrame, trie: Trie) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = reader_of(trie)
        for rows, ids, first, starts in _slabs(batches, names):
            out = rows.assign(train_tokens=trie.tokens, score=np.add.reduceat(reader.score(ids, first), starts))
            yield out.astype({"doc_id": "Int64"})[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    return encoded.mapInPandas(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame, folder: str, *, shards: int | None = None) -> DataFrame:
    """Train on the rows of ``docs`` outside the held-out fold, score all of them."""
    marked = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
    trie, encoded = train(marked, folder, shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return scored(encoded, trie)


def remove(folder: str) -> None:
    """Delete a trie's files."""
    store, path = shared_files._open(folder)
    store.delete_dir(path)
