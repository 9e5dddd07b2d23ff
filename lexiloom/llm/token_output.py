"""Token-id output: flat unsigned integer files plus 64-bit document offsets, memory-mapped.

``write_tokens`` deals the documents by ranges of doc_id to partitions; every task encodes its own
range and writes three files: ``.bin`` (ids, unsigned 16 or 32 bits as the vocabulary needs),
``.off`` (unsigned 64-bit offsets inside the part, one more than documents) and ``.doc`` (doc_ids).
The driver gets one row per part, never per document, and the parts' bases are their prefix sums,
so the parts in order are one flat file. ``read_tokens`` maps the files and returns rows.

Defined results: NULL and empty texts hold the end id alone; NULL doc_ids come first; repeated
doc_ids stay separate documents, ordered by text; an empty table gives an empty dataset.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import shared_files
from lexiloom.llm.common import tidy

VOCABULARY = "word_bpe_49k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words that the vocabulary's normaliser only lower-cases and its pattern leaves whole.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def byte_letters() -> np.ndarray:
    """Code points of the byte-level alphabet of BPE vocabularies: printable Latin-1 stands for itself, the rest from
    U+0100 on. The blank, which separates words, stays."""
    out = np.arange(256, dtype="<u4")
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    out[odd] = 256 + np.arange(len(odd))
    out[32] = 32
    return out


class WordEncoder:
    """Encodes whole texts with the tokenizers library, remembering the ids of each blank-separated chunk.

    Valid for vocabularies that lower-case, drop white space (no token spans a blank) and mark word ends, as
    the default one does. Chunks are remembered in two generations of at most half of ``remember``
    each, so the memory is bounded and frequent chunks stay. Chunks of Latin letters go to the
    vocabulary's model without its normaliser and pattern, which would leave them as they are; one closing comma or
    full stop is a token of its own in any case. All other chunks take the whole way.
    """

    def __init__(self, path: str, remember: int = 2_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.size, self.remember = size, remember
        self.letters = byte_letters()
        model = json.loads(self.tokenizer.to_str())
        suffix = model["model"].get("end_of_word_suffix")
        self.plain = None
        if suffix and "lowercase" in json.dumps(model["normalizer"]).lower():
            self.plain = Tokenizer.from_str(json.dumps(model | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            self.ends = np.zeros(size, bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.known, self.old = {"": b""}, {}
        self.closing = dict(zip(",.", self._whole([",", "."]), strict=True))

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Words of Latin letters, many in one call; their last tokens tell them apart."""
        out, width = [], self.dtype.itemsize
        for lo in range(0, len(words), 500):
            raw = np.frombuffer(" ".join(words[lo : lo + 500]).lower().encode(), np.uint8)
            ids = np.array(self.plain.encode_batch_fast([self.letters[raw].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, self.dtype)
            ends, raw = (np.flatnonzero(self.ends[ids]) + 1) * width, ids.tobytes()
            ends = ends.tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _learn(self, new: list[str]) -> None:
        known, old, closing, latin = self.known, self.old, self.closing, LATIN.fullmatch
        words, other, closed = set(), [], []
        for c in new:
            if (got := old.get(c)) is not None:
                known[c] = got
            elif self.plain is None:
                other.append(c)
            elif latin(c):
                words.add(c)
            elif c[-1] in closing and latin(c[:-1]):
                closed.append(c)
                c = c[:-1]
                if c not in known:
                    if (got := old.get(c)) is not None:
                        known[c] = got
                    else:
                        words.add(c)
            else:
                other.append(c)
        words = list(words)
        known.update(zip(words, self._words(words), strict=True))
        known.update(zip(other, self._whole(other), strict=True))
        for c in closed:
            known[c] = known[c[:-1]] + closing[c[-1]]

    def _known(self, chunks: list[str]) -> list[bytes]:
        if len(self.known) > self.remember // 2:
            self.known, self.old = {"": b""}, self.known
        got = list(map(self.known.get, chunks))
        if missing := [i for i, v in enumerate(got) if v is None]:
            self._learn([chunks[i] for i in missing])
            for i in missing:
                got[i] = self.known[chunks[i]]
        return got

    def block(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, an end id after each, and the texts' offsets in them. NULL is an empty text.

        Each different chunk is looked up once; the rest is array work.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # the vocabulary lower-cases; doing so first makes fewer different chunks
        split = pc.split_pattern(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), " ")
        coded = split.flatten().dictionary_encode()
        got, at = self._known(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        got.append(np.array([end_id], self.dtype).tobytes())
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // self.dtype.itemsize
        ids, starts = np.frombuffer(b"".join(got), self.dtype), np.cumsum(sizes) - sizes
        # the end id is one more chunk of every text
        cuts = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        at = np.insert(at.astype(np.int64), cuts, len(got) - 1)
        each = sizes[at]
        ends = np.cumsum(each)
        flat = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - ends + each, each)]
        return flat, np.append(0, ends[cuts + np.arange(len(cuts))])

    def blocks(self, texts: pa.Array, size: int = 12_000_000) -> Iterator[tuple[int, pa.Array]]:
        """Slices of about ``size`` bytes, with their places."""
        total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + size, "right")))
            yield lo, texts.slice(lo, hi - lo)
            lo = hi

    def encode(self, texts: list[str | None] | pa.Array, end_id: int, size: int = 12_000_000) -> list[bytes]:
        """Each text's ids and the end id, as little-endian unsigned integers of ``dtype``."""
        out = []
        for _, part in self.blocks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), size):
            flat, offsets = self.block(part, end_id)
            raw, cuts = flat.tobytes(), (offsets * self.dtype.itemsize).tolist()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out


@lru_cache(2)
def encoder_of(path: str) -> WordEncoder:
    """One encoder per Python worker: later tasks find the chunks that earlier ones have learnt."""
    return WordEncoder(path)


@dataclass(frozen=True)
class TokenFiles:
    """What ``read_tokens`` needs: the folder, the type of an id, and a row per part."""

    folder: str
    dtype: str
    parts: tuple[tuple[int, int, int, int, int], ...]  # part, documents, documents with NULL ids, tokens, base


def write_tokens(docs: DataFrame, folder: str, *, end_id: int = 1, path: str | None = None, partitions: int | None = None) -> TokenFiles:
    """Encode ``docs`` (doc_id, text) into token files under ``folder``; see the module's text."""
    path, spark = path or tokenizer_path(), docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), encoder_of(path)
        ids, lengths, doc, nulls = [], [], [], 0
        for b in batches:
            for lo, texts in encoder.blocks(b.column("text")):
                flat, offsets = encoder.block(texts, end_id)
                ids.append(flat)
                lengths.append(np.diff(offsets))
                known = b.column("doc_id").slice(lo, len(texts))
                nulls += known.null_count
                doc.append(pc.fill_null(known, 0).to_numpy())
        if not ids:
            return
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        name = f"{folder}/tokens-{part:05d}"
        shared_files.write(f"{name}.bin", *ids)
        shared_files.write(f"{name}.off", offsets.astype("<u8").tobytes())
        shared_files.write(f"{name}.doc", np.concatenate(doc).astype("<i8").tobytes())
        row = {"part": pa.array([part], pa.int32()), "docs": [len(offsets) - 1], "nulls": [nulls], "tokens": [int(offsets[-1])]}
        yield pa.RecordBatch.from_pydict(row)

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    rows = sorted(map(tuple, dealt.mapInArrow(tidy(write), "part int, docs long, nulls long, tokens long").collect()))
    parts, base = [], 0
    for part, count, nulls, tokens in rows:
        parts.append((part, count, nulls, tokens, base))
        base += tokens
    return TokenFiles(folder, encoder_of(path).dtype.str, tuple(parts))


def read_tokens(spark, files: TokenFiles, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read from the mapped files."""
    folder, dtype = files.folder, files.dtype
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, count, nulls, _, base in b.itertuples(index=False):
                name = f"{folder}/tokens-{part:05d}"
                ids, offsets, docs = (shared_files.mapped(f"{name}.{x}", t) for x, t in (("bin", dtype), ("off", "<u8"), ("doc", "<i8")))
                for lo in range(0, count, 4096):
                    at = offsets[lo : min(lo + 4096, count) + 1].astype(np.int64)
                    pieces = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                    doc = pd.Series(docs[lo : lo + len(pieces)], dtype="Int64")
                    doc[np.arange(lo, lo + len(pieces)) < nulls] = pd.NA
                    cols = [doc, base + at[:-1], np.diff(at), [zlib.crc32(x.astype("<u4").tobytes()) for x in pieces]]
                    yield pd.DataFrame(dict(zip(names, cols + [[x.astype(np.int64) for x in pieces]] * with_ids, strict=True)))

    parts = spark.createDataFrame(list(files.parts), "part int, docs long, nulls long, tokens long, base long")
    return parts.repartition(max(1, len(files.parts))).mapInPandas(tidy(read), schema)
