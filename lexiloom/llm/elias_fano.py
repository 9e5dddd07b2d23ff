"""Elias-Fano sequences over memory-mapped arrays, and the container files that hold them.

A non-decreasing sequence keeps its low bits in an array of whole bytes and its high bits in unary
in a bit vector. Directories of ones and of zeros every 64 bits make ``get`` a select of ones and ``find`` (successor
search) a select of zeros and a search among the few elements with equal high bits. All
operations take arrays of queries; a reader makes no array as long as a sequence or its directories, they stay in the mapped file.
"""

from __future__ import annotations

import json

import numpy as np

from lexiloom.llm import shared_files

CHUNK = 1 << 17
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
U1, U2, U3, U4, U7, U8, U255 = map(np.uint64, (1, 2, 3, 4, 7, 8, 255))
M1, M2, M4, ONES, HIGH = map(np.uint64, (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080))
#: SELECT[byte, k]: position of the k-th set bit.
SELECT = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _at = np.flatnonzero(BITS[_byte])
    SELECT[_byte, : len(_at)] = _at


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a header of 8-byte-aligned places, then the arrays."""
    places, at = {}, 0
    for name, x in arrays.items():
        places[name] = [x.dtype.str, list(x.shape), at]
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(places).encode()
    head += b" " * (-len(head) % 8)
    body = [np.ascontiguousarray(x).tobytes().ljust(-(-x.nbytes // 8) * 8, b"\0") for x in arrays.values()]
    shared_files.write(uri, len(head).to_bytes(8, "little"), head, *body)


def load(uri: str) -> dict[str, np.ndarray]:
    raw = shared_files.mapped(uri, np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(raw[8 : 8 + size].tobytes()).items():
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = raw[8 + size + at : 8 + size + at + n].view(kind).reshape(shape)
    return out


def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Arrays of the sequence ``values`` (non-decreasing, unsigned 64 bits)."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    shift = 0
    while n and top >> shift > 2 * n:
        shift += 1
    # up to eight bits in unary cost no more than a byte more of each element
    if n and top >> shift // 8 * 8 <= 8 * n:
        shift = shift // 8 * 8
    high = (values >> np.uint64(shift)).astype(np.int64)
    size = n + (int(high[-1]) if n else 0) + 1
    blocks = -(-size // 64) + 1
    bits = np.zeros(blocks * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    upper = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)[:-1]])
    kind = np.uint32 if 64 * blocks < 1 << 32 else np.uint64
    low = (values & np.uint64((1 << shift) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-shift // 8)]
    zeros = np.arange(blocks) * 64 - ones
    return {f"{name}.upper": upper, f"{name}.ones": ones.astype(kind), f"{name}.zeros": zeros.astype(kind), f"{name}.low": np.ascontiguousarray(low), f"{name}.n": np.array([n, size, shift], np.int64)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.upper, self.ones, self.zeros, low = (arrays[f"{name}.{x}"] for x in ("upper", "ones", "zeros", "low"))
        self.n, self.size, self.shift = map(int, arrays[f"{name}.n"])
        self.width = low.shape[1]
        self.low = low.view({1: "<u1", 2: "<u2", 4: "<u4"}[self.width]).reshape(-1) if self.width in (1, 2, 4) else low

    def _select(self, k: np.ndarray, counts: np.ndarray, invert: bool) -> np.ndarray:
        """Positions of the k-th ones (zeros): the directory gives the word, bytes' prefix sums the byte, a table the bit."""
        # of one type, else the directory is copied
        word = np.searchsorted(counts, k.astype(counts.dtype), "right") - 1
        left = (k - counts[word].astype(np.int64)).astype(np.uint64)
        w = self.upper[word]
        w = ~w if invert else w
        x = w - (w >> U1 & M1)
        x = (x & M2) + (x >> U2 & M2)
        sums = (x + (x >> U4) & M4) * ONES
        byte = np.bitwise_count((left * ONES | HIGH) - sums & HIGH).astype(np.uint64)
        shift = byte << U3
        before = sums << U8 >> shift & U255
        return word * 64 + (byte.astype(np.int64) << 3) + SELECT[(w >> shift & U255).astype(np.int64), (left - before & U7).astype(np.int64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if self.width in (1, 2, 4):
            return self.low[i].astype(np.int64)
        out = np.zeros(len(i), np.int64)
        for b in range(self.width):
            out |= self.low[i, b].astype(np.int64) << (8 * b)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the indexes i."""
        i = i.astype(np.int64)
        return (self._select(i, self.ones, False) - i << self.shift) | self._low(i) if self.n else np.zeros(len(i), np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value x, or -1. Values that occur are assumed to occur once."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        for lo_ in range(0, len(x), CHUNK):
            v = x[lo_ : lo_ + CHUNK].astype(np.int64)
            high = v >> self.shift
            ok = np.flatnonzero(high <= self.size - self.n - 1)
            high, v = high[ok], v[ok]
            end = self._select(high, self.zeros, True) - high
            start = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) - (high - 1), 0)
            want, a = v & (1 << self.shift) - 1, start.copy()
            open_ = np.flatnonzero(start < end)
            x0, x1, ask = start[open_], end[open_], want[open_]
            while open_.size:
                mid = x0 + x1 >> 1
                less = self._low(mid) < ask
                x0, x1 = np.where(less, mid + 1, x0), np.where(less, x1, mid)
                more = x0 < x1
                a[open_] = x0
                open_, x0, x1, ask = open_[more], x0[more], x1[more], ask[more]
            hit = a < end
            hit[hit] = self._low(a[hit]) == want[hit]
            part = np.full(len(high), -1, np.int64)
            part[hit] = a[hit]
            out[lo_ + ok] = part
        return out


class Level:
    """Nodes of a trie level: pointers from parents, and the children's keys made monotone over all parents."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.pointers, self.keys = EliasFano(arrays, "pointers"), EliasFano(arrays, "keys")

    @staticmethod
    def encode(parent: np.ndarray, key: np.ndarray, parents: int) -> dict[str, np.ndarray]:
        """Of children sorted by (parent, key)."""
        starts = np.searchsorted(parent, np.arange(parents + 1))
        sizes = np.diff(starts)
        full = np.flatnonzero(sizes)
        last = key[starts[full + 1] - 1].astype(np.uint64) + np.uint64(1) if len(full) else np.zeros(0, np.uint64)
        base = np.zeros(parents, np.uint64)
        base[full] = np.concatenate([[np.uint64(0)], np.cumsum(last, dtype=np.uint64)[:-1]]) if len(full) else 0
        return encode(starts, "pointers") | encode(base[parent] + key.astype(np.uint64) + np.uint64(1), "keys")

    def find(self, parent: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, index relative to the parent's first child) of each child, -1 where there is none."""
        if (parent[1:] >= parent[:-1]).all():
            new = np.append(True, parent[1:] != parent[:-1])[: len(parent)]
            nodes, at = parent[new], np.cumsum(new) - 1
        else:
            nodes, at = np.unique(parent, return_inverse=True)
        begin, end = self.pointers.get(nodes), self.pointers.get(nodes + 1)
        base = np.where(begin > 0, self.keys.get(np.maximum(begin - 1, 0)), 0)
        has = np.flatnonzero((begin < end)[at])
        index, rank = np.full(len(parent), -1, np.int64), np.full(len(parent), -1, np.int64)
        i = self.keys.find(base[at[has]] + key[has] + 1)
        ok = (i >= 0) & (i < end[at[has]])
        index[has[ok]] = i[ok]
        rank[has[ok]] = i[ok] - begin[at[has[ok]]]
        return index, rank
