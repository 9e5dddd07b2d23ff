"""Substring deduplication by paragraph MinHash banding.

Passages repeat in the middle of other text, so a paragraph here ends with its line or with a sentence: a passage is
cut alike wherever it stands, but for its first sentence, which may go on from other words. Paragraphs of
fewer than ``UNIT`` words are left out. Equal paragraphs (by their words) are collapsed. Then MinHash over
five-word shingles, bands tuned for high recall (2 rows, 8 bands: 0.9997 at similarity 0.8; equal ones need
none), exact Jaccard similarity of paragraphs that share a band, and components by
a distributed union-find. Runs of repeated paragraphs make a passage if they have ``min_words`` words within a line or
``wide_words`` over several lines; left-out paragraphs do not end a run, nor do they count.

Of each component the occurrence that stays is the smallest by (doc_id, row, start).

Defined results: NULL and empty texts have no paragraphs; rows equal in doc_id and text are one document; NULL
doc_ids count as largest; an empty table gives no rows; only repeated passages are returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import drop, link_buckets, small, stored, tidy

SHINGLE, THRESHOLD, BANDS, ROWS, MIN_WORDS, WIDE_WORDS, UNIT = 5, 0.8, 8, 2, 20, 50, 6
OUTSIDE = re.compile(r"[\W_]+")
#: NULL doc_ids count as this one.
LAST = (1 << 63) - 1
#: Rows that may be broadcast where they are a key and a place.
KEY_ROWS = 1_000_000
#: Characters of text that are cut at once.
BLOCK = 8_000_000
#: Fixed odd multipliers of the mixing steps.
P1, P2, P3 = map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SALT = np.random.default_rng(20240229).integers(1, 1 << 64, 256, np.uint64)
S31, S29 = np.uint64(31), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> S31) * P1
    x = (x ^ x >> S29) * P2
    return x ^ x >> S31


def word_core(word: str) -> str:
    return OUTSIDE.sub("", word)


def paragraph_words(text: str) -> list[str]:
    """Words of a paragraph as they are compared: lower case, letters and digits only."""
    return [w for w in map(word_core, text.lower().split(" ")) if w]


def cut_lines(lines: list[str], k: int, bands: int, rows: int, unit: int) -> dict[str, np.ndarray]:
    """Paragraphs of the lines: line, start in it, n_chars, n_words, digest h1 and h2, band keys k0, k1, ..."""
    from xxhash import xxh3_64_intdigest

    split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
    flat, offsets = split.flatten(), split.offsets.to_numpy()
    coded = flat.dictionary_encode()
    kinds, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    cores = [word_core(w.lower()) for w in kinds]
    word = np.fromiter((xxh3_64_intdigest(c) | 1 if c else 0 for c in cores), np.uint64, len(cores))[at]
    stop = np.fromiter((w.endswith((".", "!", "?")) for w in kinds), bool, len(kinds))[at]
    size = pc.utf8_length(flat).to_numpy().astype(np.int64)
    n = len(at)
    line = np.repeat(np.arange(len(lines)), np.diff(offsets))
    # where a paragraph ends
    cut = stop
    cut[offsets[1:] - 1] = True
    of = np.concatenate([[0], np.cumsum(cut)[:-1]]) if n else np.zeros(0, np.int64)
    real = np.flatnonzero(word)
    words = np.bincount(of[real], minlength=int(of[-1]) + 1 if n else 0)
    chosen = np.flatnonzero(words >= unit)
    kept = real[words[of[real]] >= unit]
    w, n_words = word[kept], words[chosen]
    ends = np.cumsum(n_words)
    starts = ends - n_words
    place = (np.arange(len(w)) - np.repeat(starts, n_words)).astype(np.uint64)
    out: dict[str, np.ndarray] = {}
    if len(chosen):
        out["h1"] = np.add.reduceat(mix(w + place * P2), starts).view(np.int64)
        out["h2"] = np.add.reduceat(mix(w * P3 ^ place * P1 + P2), starts).view(np.int64)
        padded = np.concatenate([w, np.zeros(k, np.uint64)])
        shingle = padded[: len(w)].copy()
        for i in range(1, k):
            shingle = shingle * P1 + padded[i : i + len(w)]
        shingle = mix(shingle)[place.astype(np.int64) < np.repeat(np.maximum(1, n_words - k + 1), n_words)]
        per = np.maximum(1, n_words - k + 1)
        first = np.cumsum(per) - per
        for b in range(bands):
            key = np.full(len(chosen), b + 1, np.uint64) * P3
            for r in range(rows):
                key = mix(key + np.minimum.reduceat(mix(shingle + SALT[b * rows + r]), first))
            out[f"k{b}"] = key.view(np.int64)
    else:
        out = {name: np.zeros(0, np.int64) for name in ("h1", "h2", *(f"k{b}" for b in range(bands)))}
    edge = np.flatnonzero(cut)
    token_start = np.cumsum(size + 1) - size - 1
    begin, end = np.append(0, edge[:-1] + 1)[chosen] if n else edge, edge[chosen]
    head = line[begin] if n else begin
    # token starts count from the block's first line
    origin = token_start[offsets[:-1]] if n else np.zeros(0, np.int64)
    return out | {"line": head, "start": token_start[begin] - origin[head], "n_chars": token_start[end] + size[end] - token_start[begin], "n_words": n_words}


def paragraphs(docs: DataFrame, *, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, unit: int = UNIT) -> DataFrame:
    """One row per paragraph occurrence: doc_id, row, pos (line), no (in the document), start, n_chars, n_words, h1, h2, k0, ..."""
    names = ["h1", "h2", *(f"k{b}" for b in range(bands))]
    schema = "doc_id long, row long, pos int, no int, start int, n_chars int, n_words int, " + ", ".join(f"{n} long" for n in names)

    def block(doc: list[int], pos: list[int], base: list[int], lines: list[str], ids: pa.Array, row: np.ndarray) -> pa.RecordBatch:
        got = cut_lines(lines, k, bands, rows, unit)
        line = got["line"]
        d, p, b = (np.array(x, np.int64)[line] for x in (doc, pos, base))
        no = np.arange(len(d)) - np.searchsorted(d, d, "left")
        ints = [p, no, b + got["start"], got["n_chars"], got["n_words"]]
        columns = [ids.take(pa.array(d)), pa.array(row[d]), *[pa.array(x.astype(np.int32)) for x in ints], *[pa.array(got[n]) for n in names]]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = batch.column("doc_id"), batch.column("row").to_numpy()
            doc, pos, base, lines, size = [], [], [], [], 0
            for d, text in enumerate(batch.column("text").to_pylist()):
                at = 0
                for i, line in enumerate((text or "").split("\n")):
                    if len(line) > 2 * unit - 2:
                        doc.append(d)
                        pos.append(i)
                        base.append(at)
                        lines.append(line)
                    at += len(line) + 1
                size += at
                if size > BLOCK:
                    yield block(doc, pos, base, lines, ids, row)
                    doc, pos, base, lines, size = [], [], [], [], 0
            if lines:
                yield block(doc, pos, base, lines, ids, row)

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), "text").mapInArrow(tidy(run), schema)


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def similar(pairs: DataFrame, payload: DataFrame, k: int, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose texts' shingle sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[int, frozenset] = {}

        def of(ident: int, text: str) -> frozenset:
            if ident not in sets:
                if len(sets) > 500:
                    sets.clear()
                ws = paragraph_words(text)
                sets[ident] = frozenset(hash(tuple(ws[i : i + k])) for i in range(max(1, len(ws) - k + 1)))
            return sets[ident]

        for b in batches:
            ok = []
            for i, j, x, y in b.itertuples(index=False):
                s, t = of(i, x), of(j, y)
                both = len(s & t)
                ok.append(both >= threshold * (len(s) + len(t) - both))
            yield b.loc[ok, ["a", "b"]]

    a = payload.select(F.col("id").alias("a"), F.col("part").alias("x"))
    b = payload.select(F.col("id").alias("b"), F.col("part").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInPandas(tidy(run), "a long, b long")


def rare_shingles(ids: DataFrame, payload: DataFrame, k: int, threshold: float) -> DataFrame:
    """(id, c, token, rank, n): each id's rarest shingles, one more than a similar paragraph may lack."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            out = []
            for i, c, text in b[["id", "c", "part"]].itertuples(index=False):
                ws = paragraph_words(text)
                own = {xxh3_64_intdigest(" ".join(ws[j : j + k])) for j in range(max(1, len(ws) - k + 1))}
                most = len(own) - int(np.ceil(threshold * len(own) - 1e-9)) + 1
                out += [(i, c, most, t - (1 << 63), len(own)) for t in own]
            yield pd.DataFrame(out, columns=["id", "c", "most", "token", "n"])

    every = ids.join(payload, "id").select("id", "c", "part").mapInPandas(tidy(run), "id long, c long, most int, token long, n int")
    every = stored(every, "shingles")
    counted = every.join(every.groupBy("token").count(), "token")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("count", "token"))
    out = stored(counted.withColumn("rank", rank).where("rank <= most").select("id", "c", "token", "rank", "n"), "tokens")
    drop(every)
    return out


def repeated_paragraphs(docs: DataFrame, *, k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, min_words: int = MIN_WORDS, wide_words: int = WIDE_WORDS, unit: int = UNIT) -> DataFrame:
    """(doc_id, row, pos, start, n_chars, n_words, component, keep_doc, keep): every paragraph of a repeated passage.

    start and n_chars: the span in the text, in characters; component: the digest of one of the class; keep_doc: the document whose occurrence
    stays; keep: whether it is this one.
    """
    table = stored(paragraphs(docs, k=k, bands=bands, rows=rows, unit=unit), "paragraphs")
    keys = [f"k{b}" for b in range(bands)]
    # a place where the words stand, for their text: all of one occurrence, as the three are updated and merged together
    place = [F.first(c).alias(c) for c in ("row", "start", "n_chars")]
    # numbers once given are written down, so they stay the same whatever is computed again
    numbered = table.groupBy("h1", "h2").agg(F.count("*").alias("n"), *place, *[F.min(c).alias(c) for c in keys]).withColumn("id", F.monotonically_increasing_id())
    distinct = stored(numbered, "distinct")
    members = distinct.select("id", F.explode(F.array(*keys)).alias("key"))
    shared = stored(members.groupBy("key").count().where("count > 1").select("key"), "keys")
    meet = stored(members.join(small(shared, shared.count(), KEY_ROWS), "key", "left_semi").select("key", "id"), "meet")
    drop(shared)
    met = meet.select("id").distinct()
    ids = stored(distinct.select("id", "h1", "h2", "row", "start", "n_chars").join(small(met, met.count(), KEY_ROWS), "id", "left_semi"), "ids")
    # the texts of candidates, each from one of its occurrences; whole texts are shuffled only where the places are many
    lines = docs.select(row_key().alias("row"), "text")
    parts = lines.join(small(ids.select("id", "row", "start", "n_chars"), ids.count(), KEY_ROWS), "row")
    payload = stored(parts.select("id", F.substring("text", F.col("start") + 1, F.col("n_chars")).alias("part")).dropDuplicates(["id"]), "payload")
    comp = link_buckets(meet, lambda pairs: similar(pairs, payload, k, threshold), tokens=lambda ids: rare_shingles(ids, payload, k, threshold), threshold=threshold)
    digest = F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))
    near = ids.join(comp, "id").join(ids.select(F.col("id").alias("component"), digest.alias("name")), "component").select("h1", "h2", F.col("name").alias("component"))
    alone = distinct.where("n > 1").select("h1", "h2", digest.alias("component")).join(near, ["h1", "h2"], "left_anti")
    classes = stored(near.unionByName(alone), "classes")
    spots = table.join(classes, ["h1", "h2"]).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "row", "pos", "no", "start", "n_chars", "n_words", "component").dropDuplicates(["row", "no"])
    # paragraphs are numbered through the document, so a number less its rank is the same along a run
    island = F.col("no") - F.row_number().over(Window.partitionBy("row").orderBy("no"))
    words = lambda *by: F.sum("n_words").over(Window.partitionBy("row", "island", *by))
    spots = spots.withColumn("island", island).withColumns({"run": words(), "in_line": words("pos")})
    spots = spots.where((F.col("in_line") >= min_words) | (F.col("run") >= wide_words))
    spots = stored(spots.drop("island", "run", "in_line", "no"), "repeats")
    best = spots.groupBy("component").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "row", "start")).alias("best")).where("times > 1")
    # a very frequent passage is one component: broadcast where counted small, its occurrences stay where they are
    best = stored(best.select("component", "best"), "best")
    best = small(best, best.count())
    drop(table, distinct, meet, ids, payload, classes)
    keep = (F.col("best.row") == F.col("row")) & (F.col("best.start") == F.col("start"))
    back = lambda c: F.nullif(F.col(c), F.lit(LAST))
    return spots.join(best, "component").select(back("doc_id").alias("doc_id"), "row", "pos", "start", "n_chars", "n_words", "component", back("best.doc_id").alias("keep_doc"), keep.alias("keep"))


def remove_repeats(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with texts less the repeated paragraphs that do not stay, and n_removed (long)."""
    gone = repeated_paragraphs(docs, **settings).where("not keep").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "n_chars"))).alias("__gone")).withColumnRenamed("row", "__row")
    joined = docs.withColumn("__row", row_key()).join(gone, "__row", "left")
    # what lies between the spans
    end = lambda s: s["start"] + s["n_chars"]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")
    fold = F.aggregate("__gone", start, lambda a, s: F.struct(end(s).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).alias("out")), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    out = joined.withColumns({"text": F.when(F.col("__gone").isNull(), text).otherwise(fold), "n_removed": F.coalesce(F.array_size("__gone"), F.lit(0)).cast("long")})
    return out.drop("__row", "__gone")
