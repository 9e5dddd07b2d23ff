"""Licence scans, scoring, token files, media and packing against brute force, round trips and held-out labels."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiloom.llm import elias_fano, license_scan, lm_score, media_ts, packing, quality_crf, queries, token_output
from lexiloom.llm.common import scratch

KIND = "doc_id long, text string, lang string, count string, row int"
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("the cat sat on a mat and ran far".split()) for _ in range(rng.randint(1, 60))), "en", "x", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "x", 1), (102, " \n\t", "en", "x", 1), (3, rows[3][1], "en", "x", 1), (None, "no id here", "en", "x", 1), (None, None, None, None, None), (103, "É naïve <|endoftext|> , don't. " * 3000, "fr", "x", 1), (104, "中文 \U0001f600 \x0b x", "zh", "x", 1)]
    return spark.createDataFrame(rows, KIND), rows


# --- licences -----------------------------------------------------------------------------------------


def test_every_known_text_has_the_hint():
    assert all(re.search(license_scan.HINT, t.lower()) for ts in license_scan.KNOWN.values() for t in ts)


def test_canonical_forms():
    c = license_scan.canonical
    assert c("Copyright (c) 2020 X\nReleased under the “MIT” Licence!") == c("released  under the MIT license")
    assert c("All rights reserved.\n\nhttps://www.apache.org/x") == c("apache.org x")
    assert c("... \n --") == ""


def test_licence_scan(spark):
    mit = license_scan.KNOWN["MIT"][0]
    rows = [(1, "Copyright (c) 2021 Someone\n\n" + mit.upper().replace(".", " .")), (2, "prose\nReleased under the MIT Licence.\nReleased under the MIT License.\n"), (3, None), (4, ""), (5, "..."), (2, "prose"), (None, "SPDX-License-Identifier: 0BSD"), (6, mit + " and more")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r.doc_id or 0, r.document_license, r.line_licenses, r.license_lines) for r in got), key=repr)
    assert found == sorted([(1, "MIT", ["MIT"], 1), (2, None, ["MIT"], 2), (2, None, [], 0), (3, None, [], 0), (4, None, [], 0), (5, None, [], 0), (6, None, [], 0), (0, "0BSD", ["0BSD"], 1)], key=repr)
    assert all((r.digest is None) == (r.doc_id in (3, 4, 5)) for r in got)
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licence_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op1_license_scan"]).fetchall()
    got = [tuple(r) for r in queries.op1_license_scan(spark, str(DATA)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- language model -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (900, 1000), (5000, 10**6), (3000, 10**14)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top, n))
    ef = elias_fano.EliasFano(elias_fano.encode(v, "x"), "x")
    assert (ef.get(np.arange(len(v))) == v).all()
    ask = np.concatenate([v, rng.integers(0, top + 3, 500)])
    place = {x: i for i, x in enumerate(v.tolist())}
    assert ef.find(ask).tolist() == [place.get(x, -1) for x in ask.tolist()]


@pytest.mark.parametrize("gap", [1, 300, 70_000, 2**20])
def test_elias_fano_reads_in_place(gap, tmp_path):
    v = np.cumsum(np.random.default_rng(gap).integers(1, 2 * gap, 20_000))
    elias_fano.save(str(tmp_path / "x"), elias_fano.encode(v, "x"))
    arrays = elias_fano.load(str(tmp_path / "x"))
    ef = elias_fano.EliasFano(arrays, "x")
    # no directory is copied, and slices of a mapped file are plain arrays
    assert all(type(x) is np.ndarray for x in arrays.values())
    assert all(any(np.shares_memory(x, y) for y in arrays.values()) for x in vars(ef).values() if isinstance(x, np.ndarray) and x.size)
    # elements with equal high bits are few
    assert np.bincount(v >> ef.shift).max() <= 64
    assert (ef.get(np.arange(len(v))) == v).all() and (ef.find(v) == np.arange(len(v))).all() and (ef.find(np.setdiff1d(v + 1, v)) == -1).all()


def test_coded_words(odd):
    texts = [r[1] for r in odd[1]] + ["".join(map(chr, range(256))), "  A\x1cB\x85 \t\x0b É\u2028É ", "\x00 a\x00", "İK"]
    hashes, at, starts = lm_score.coded_words(pa.array([None, *texts, "x"]).slice(1, len(texts)))
    assert [hashes[at[a:b]].tolist() for a, b in zip(starts, starts[1:])] == [[lm_score.word_hash(w) for w in [*lm_score.words_of(t), lm_score.END]] for t in texts]
    assert sum(b.num_rows for b in lm_score._texts(iter([pa.record_batch({"text": pa.array(["x" * 3_000_000, None, "y" * 9_000_000, "z"])})]))) == 4


def test_lm_has_no_more_shards_than_asked_for(spark, odd):
    folder = scratch(spark, "trie")
    trie, _ = lm_score.train(odd[0].select("doc_id", "text", F.lit(False).alias("held_out")), folder, 6)
    assert trie.shards == 4 and len(list(Path(folder.removeprefix("file://")).glob("trigrams-?????"))) == 4


def test_counts_above_32_bits_survive():
    keys = np.array([3, 9], np.uint64)
    k, c = lm_score.merged([lm_score.packed(keys, np.array([2**32 + 7, 1])), lm_score.packed(keys[:1], np.array([1]))])
    assert k.tolist() == [3, 9] and c.tolist() == [2**32 + 8, 1]


def model_of(texts):
    """Interpolated absolute discounting by dictionaries, without quantisation."""
    docs = [lm_score.words_of(t) + ["\n"] for t in texts]
    one = Counter(w for d in docs for w in d)
    two = Counter((a, b) for d in docs for a, b in zip(["<s>", *d], d))
    three = Counter((a, b, c) for d in docs for a, b, c in zip(["<s>", *d], d, d[1:]))
    n, v = sum(one.values()), len(one)
    discount = lambda c: lm_score._discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    d1, d2, d3 = discount(one), discount(two), discount(three)
    heads = one | {"<s>": len(docs)}
    after, after2 = {}, {}
    for (a, b), c in two.items():
        after.setdefault(a, {})[b] = (c - d2) / heads[a]
    for (a, b, x), c in three.items():
        after2.setdefault((a, b), {})[x] = (c - d3) / two[a, b]

    def p(x, before):
        q = (one[x] - d1) / n if x in one else d1 * v / n
        b = before[-1]
        if b in heads:
            q = after.get(b, {}).get(x, 0) + (1 - sum(after.get(b, {}).values())) * q
        if len(before) > 1 and tuple(before[-2:]) in two:
            a = after2.get(tuple(before[-2:]), {})
            q = a.get(x, 0) + (1 - sum(a.values())) * q
        return q

    return p, one, n, v


def test_lm_against_brute_force(spark, odd):
    df, rows = odd
    got = lm_score.lm_scores(df, scratch(spark, "trie"), shards=4).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    p, one, n, v = model_of([t for i, t, *_ in rows if not held(i)])
    want = []
    for i, t, *_ in rows:
        ws = lm_score.words_of(t) + ["\n"]
        score = sum(math.log10(p(w, ["<s>", *ws[:k]][-2:])) for k, w in enumerate(ws))
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws)
        want.append((i, held(i), len(ws), sum(w in one for w in ws), n, base, score))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=4e-4 * w[2])
    for before in (["<s>"], ["<s>", "the"], ["the", "cat"], ["zzz", "cat"], ["a", "zzz"]):
        assert sum(p(x, before) for x in [*one, "unknown!"]) == pytest.approx(1)


def test_lm_beats_its_base_on_held_out_documents(spark):
    got = lm_score.lm_scores(spark.read.parquet(str(DATA / "documents.parquet")), scratch(spark, "trie")).where("held_out")
    row = got.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row.s > row.b


def test_lm_of_an_empty_table(spark, odd):
    assert lm_score.lm_scores(odd[0].limit(0), scratch(spark, "trie")).count() == 0
    (row,) = lm_score.lm_scores(odd[0].where("doc_id = 4"), scratch(spark, "trie"), shards=1).collect()
    assert row.n_tokens >= 2


# --- quality ------------------------------------------------------------------------------------------


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 3, 5])
    unary, change = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    good, pairs, z = quality_crf.forward_backward(unary, lengths, change)
    for d, m in enumerate(lengths):
        weight = {y: math.exp(sum(unary[d, t] * y[t] for t in range(m)) + sum(change[y[t - 1], y[t]] for t in range(1, m))) for y in itertools.product((0, 1), repeat=int(m))}
        total = sum(weight.values())
        assert z[d] == pytest.approx(math.log(total))
        for t in range(m):
            assert good[d, t] == pytest.approx(sum(w for y, w in weight.items() if y[t]) / total)
        for a, b in itertools.product((0, 1), repeat=2):
            assert pairs[d, a, b] == pytest.approx(sum(w * sum((y[t - 1], y[t]) == (a, b) for t in range(1, m)) for y, w in weight.items()) / total)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_crf.train(docs, labels)
    held = quality_crf.score(docs.select("doc_id", "text"), model).where(quality_crf.held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    good, bad = held[held.quality == 1].score.values, held[held.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert (held[held.quality == 1].predicted == 1).mean() > 0.98


def test_quality_of_odd_rows(spark, odd):
    df, rows = odd
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_crf.train(df, none)
    assert {r.score for r in quality_crf.score(df, model).collect()} == {0.5}
    one = quality_crf.train(df, spark.createDataFrame([(1, 1), (5, 1), (None, 0)], "doc_id long, quality int"))
    assert {r.score for r in quality_crf.score(df, one).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    out = quality_crf.score(df, quality_crf.train(df, both, sample=20))
    assert out.columns == [*df.columns, "score", "predicted"] and out.count() == len(rows)
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert quality_crf.score(df.limit(0), model).count() == 0


# --- token files --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_output.tokenizer_path())


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(0)
    pool = [chr(x) for x in [*range(32, 0x250), 0x300, 0x301, 0x3A3, 0x3C3, 0x2019, 0x4E2D, 0xAC00, 0x1100, 0x1161, 10, 9, 0xA0, 0x3000]]
    texts = ["".join(rng.choice(pool) + " " * (rng.random() < 0.3) for _ in range(60)) for _ in range(500)]
    texts += ["", "a.", "a,.", "Hello,  World.", "İ. İstanbul,", "<|startoftext|>x <|endoftext|>.", "don't,", "ΟΔΟΣ,", "1,2.", None]
    encoder = token_output.WordEncoder(token_output.tokenizer_path(), remember=200)
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    for block in (500, 10**6):
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts, 1, block)] == want


def test_token_files_round_trip(spark, odd, tokenizer, tmp_path):
    df, rows = odd
    files = token_output.write_tokens(df, f"file://{tmp_path}", partitions=5)
    got = token_output.read_tokens(spark, files, with_ids=True).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for i, t, *_ in order:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    flat = np.concatenate([np.fromfile(p, files.dtype) for p in sorted(tmp_path.glob("*.bin"))])
    assert flat.tolist() == [x for w in want for x in w[-1]]
    assert sum(p.stat().st_size // 8 - 1 for p in tmp_path.glob("*.off")) == len(rows)


def test_token_files_of_an_empty_table(spark, odd, tmp_path):
    files = token_output.write_tokens(odd[0].limit(0), f"file://{tmp_path}")
    assert token_output.read_tokens(spark, files).count() == 0


# --- media --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 170, 176, 180, 183, 184, 185, 1000, 8191, 8192, 8193, 70000])
def test_transport_stream_round_trip(size):
    text = "".join(chr(33 + i % 90) for i in range(size))
    payload, n = media_ts.padded(text)
    stream = media_ts.mux(payload)
    s = media_ts.demux(stream)
    assert n == size and s.payload == payload and len(payload) % 64 == 0 and len(payload) >= 64 and len(stream) % 188 == 0
    assert len(s.pts) == -(-len(payload) // media_ts.UNIT) and s.random_access == tuple(range(0, len(s.pts), media_ts.RANDOM_ACCESS))
    assert s.pts == tuple(media_ts.FIRST_PTS + media_ts.TICKS * i for i in range(len(s.pts)))


def test_every_stuffing_length():
    for n in range(64, 64 * 12, 64):
        for cut in range(3):
            payload = bytes(range(256)) * 4
            assert media_ts.demux(media_ts.mux(payload[cut : cut + n])).payload == payload[cut : cut + n]


@pytest.mark.parametrize("at, what", [(0, "synchronisation"), (10, "table"), (188 * 4 + 3, "counter"), (188 * 2 + 12 + 4, "damaged")])
def test_damage_is_noticed(at, what):
    stream = bytearray(media_ts.mux(b"x" * 2048))
    stream[at] ^= 0x05
    with pytest.raises(ValueError, match=what):
        media_ts.demux(bytes(stream))
    with pytest.raises(ValueError):
        media_ts.demux(bytes(stream[:-1]))


def test_media_table(spark, odd):
    df, rows = odd
    got = media_ts.media_features(media_ts.store_media(df)).collect()
    want = sorted(((i, len((t or "").encode()), hashlib.sha256(media_ts.padded(t)[0]).hexdigest(), zlib.crc32(media_ts.padded(t)[0][-64:])) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=repr) == want
    per = {}
    for r in got:
        per.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in per.values())
    assert media_ts.media_features(media_ts.store_media(df.limit(0))).count() == 0


# --- packing ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard_tokens", [3000, 10**6])
def test_packing_holds_each_id_once(spark, odd, tokenizer, shard_tokens):
    df, rows = odd
    got = packing.pack(df, window=256, shard_tokens=shard_tokens).collect()
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in rows]
    pieces = Counter()
    windows = {}
    for r in got:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert any(i == r.doc_id and x[r.start : r.start + r.length] == r.ids and len(x) == r.doc_tokens for i, x in ids)
        pieces[r.doc_id, r.doc_tokens] += r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = Counter()
    for i, x in ids:
        want[i, len(x)] += len(x)
    assert pieces == want
    short = 0
    for parts in windows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
        short += at < 256
    # one window a shard has padding; each partition's last shard may be smaller
    assert short <= sum(map(len, (x for _, x in ids))) / shard_tokens + 4
    assert packing.pack(df.limit(0)).count() == 0


def test_neighbours_follow_bm25():
    rng = np.random.default_rng(0)
    ids = [rng.integers(10 * (d % 3), 10 * (d % 3) + 12, 20).astype(np.uint16) for d in range(12)]
    df = np.zeros(50)
    for x in ids:
        df[np.unique(x)] += 1
    idf = np.log1p((12 - df + 0.5) / (df + 0.5))
    first = packing.pack_shard(ids, idf, 20.0, 60)[0]
    score = {d: sum(idf[t] * (ids[d] == t).sum() * 2.2 / ((ids[d] == t).sum() + 1.2) for t in set(ids[0].tolist())) for d in range(1, 12)}
    best = sorted(score, key=lambda d: (-score[d], d))[:2]
    assert [d for d, _, _ in first] == [0, *best]


def test_neighbours_share_shards(spark):
    """The share of each document's best BM25 neighbours, over all documents, that its shard holds, and that of random shards."""
    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    common, rows = [word() for _ in range(30)], []
    for g in range(60):
        own = [word() for _ in range(25)]
        for i in range(8):
            rows.append((g + 100 * i, " ".join(rng.choice(own if rng.random() < 0.6 else common) for _ in range(60))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = packing.tokenizer_path()
    encoder = packing.encoder_of(path)
    tokens = packing.stored(packing.encoded(df, 2, path), "tokens")
    n, total, seen = packing.statistics(tokens, encoder.dtype, encoder.size)
    idf, mean = np.log1p((n - seen + 0.5) / (seen + 0.5)), total / n
    placed = packing.in_shard_order(tokens, 10).withColumn("shard", F.spark_partition_id()).collect()
    ids, shard = [np.frombuffer(r.ids, encoder.dtype) for r in placed], np.array([r.shard for r in placed])
    tf = np.zeros((n, encoder.size), np.float32)
    for d, x in enumerate(ids):
        np.add.at(tf[d], x, 1)
    weight = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf.sum(1, keepdims=True) / mean))
    score = (tf > 0).astype(np.float32) @ weight.T
    np.fill_diagonal(score, -1)
    best = np.argsort(-score, axis=1)[:, :5]
    share = (shard[best] == shard[:, None]).mean()
    by_chance = np.mean([(shard == s).mean() for s in shard])
    assert len(set(shard.tolist())) == 10 and share >= 2.5 * by_chance, (share, by_chance)


def test_shards_of_copies_are_bounded(spark):
    """Rows that are equal in every column part anywhere; no shard is larger than the setting and one document."""
    batch = [pd.DataFrame({"doc_id": pd.array([None] * 1000, "Int64"), "ids": [np.array([5, 2], np.uint16).tobytes()] * 1000})]
    sizes = [sum(map(len, ids)) for _, ids in packing.shards_of(iter(batch), np.dtype(np.uint16), 300)]
    assert max(sizes) == 300 and sum(sizes) == 2000
    got = packing.pack(spark.createDataFrame([(None, None)] * 1000, "doc_id long, text string"), window=16, shard_tokens=100).collect()
    assert len(got) == 1000 and {r.doc_tokens for r in got} == {1}
