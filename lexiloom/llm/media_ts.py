"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

``mux`` stores payload bytes as one elementary stream in 188-byte packets: a program association table,
a program map table, then one packetised elementary packet per access unit, each with a presentation
timestamp; every ``RANDOM_ACCESS`` units a clock reference and the random-access flag. ``demux`` parses
the tables, checks the continuity counters, reassembles the elementary packets and returns payload,
timestamps and random-access points. ``store_media`` writes a table with a media column;
``media_features`` reads it back.

Defined results: NULL and empty texts are 64 zero bytes of payload; equal texts give equal streams; a
stream with a wrong sync byte, table checksum, counter or length raises ``ValueError`` in ``demux``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import stored, tidy

PACKET, PMT_PID, DATA_PID, STREAM = 188, 0x1000, 0x0100, 0xBD
#: Payload bytes of an access unit, units from one random-access point to the next, ticks (90 kHz) a unit.
UNIT, RANDOM_ACCESS, TICKS, FIRST_PTS = 8192, 8, 3600, 90_000
ROWS = 256


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ CRC[(c >> 24) ^ x]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _pts(t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([0x21 | (t >> 30) << 1, t >> 22 & 0xFF, 0x01 | (t >> 15 & 0x7F) << 1, t >> 7 & 0xFF, 0x01 | (t & 0x7F) << 1])


def _pcr(t: int) -> bytes:
    return ((t & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big")


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes followed by zeros up to a positive multiple of 64, and the length before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def mux(payload: bytes) -> bytes:
    out, counter = [TABLES], 0
    starts = [(b"\x47" + (0x4000 * first | DATA_PID).to_bytes(2, "big")) for first in (0, 1)]
    for k, lo in enumerate(range(0, len(payload), UNIT)):
        unit, t = payload[lo : lo + UNIT], FIRST_PTS + k * TICKS
        pes = b"\x00\x00\x01" + bytes([STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(t) + unit
        at, size = 0, len(pes)
        while at < size:
            field = b"\x50" + _pcr(t) if not at and k % RANDOM_ACCESS == 0 else b""
            room = PACKET - 4 - (len(field) + 1 if field else 0)
            if size - at < room:  # the last packet is stuffed
                lack = room - (size - at)
                if field:
                    field += b"\xff" * lack
                else:
                    field = (b"\x00" + b"\xff" * (lack - 2)) if lack > 1 else b""
                    out += (starts[not at], bytes([0x30 | counter, lack - 1]), field, pes[at:])
                    counter = counter + 1 & 15
                    break
            if field:
                part = pes[at : at + PACKET - 5 - len(field)]
                out += (starts[not at], bytes([0x30 | counter, len(field)]), field, part)
            else:
                part = pes[at : at + PACKET - 4]
                out += (starts[not at], bytes([0x10 | counter]), part)
            at += len(part)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass(frozen=True)
class Stream:
    payload: bytes
    pid: int
    stream_type: int
    packets: int
    pts: tuple[int, ...]
    random_access: tuple[int, ...]  # indexes of elementary packets


def _section_of(data: bytes, table: int) -> bytes:
    section = data[1 + data[0] :]
    size = 3 + (int.from_bytes(section[1:3], "big") & 0xFFF)
    section = section[:size]
    if section[0] != table or crc32_mpeg(section):
        raise ValueError("a program table is damaged")
    return section[8:-4]


def demux(media: bytes) -> Stream:
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    pmt_pid = pid = kind = -1
    counters: dict[int, int] = {}
    units: list[list[bytes]] = []
    flags: list[bool] = []
    for at in range(0, len(media), PACKET):
        if media[at] != 0x47:
            raise ValueError("lost synchronisation")
        head = media[at + 1] << 8 | media[at + 2]
        this, start, control = head & 0x1FFF, head & 0x4000, media[at + 3]
        if this == 0x1FFF:
            continue
        lo, flag = at + 4, False
        if control & 0x20:
            flag = bool(media[lo]) and bool(media[lo + 1] & 0x40)
            lo += 1 + media[lo]
        if not control & 0x10:
            continue
        if (last := counters.get(this)) is not None and last + 1 & 15 != control & 15:
            raise ValueError(f"continuity counter of pid {this} jumps")
        counters[this] = control & 15
        data = media[lo : at + PACKET]
        if this == pid:
            if start:
                units.append([data])
                flags.append(flag)
            elif units:
                units[-1].append(data)
        elif this == 0:
            body = _section_of(data, 0)
            pmt_pid = next(int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(body), 4) if body[i : i + 2] != b"\0\0")
        elif this == pmt_pid:
            body = _section_of(data, 2)
            at_es = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
            kind, pid = body[at_es], int.from_bytes(body[at_es + 1 : at_es + 3], "big") & 0x1FFF
    parts, pts = [], []
    for unit in units:
        pes = b"".join(unit)
        size = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or len(pes) != 6 + size:
            raise ValueError("an elementary packet is damaged")
        if pes[7] & 0x80:
            p = pes[9:14]
            pts.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        parts.append(pes[9 + pes[8] :])
    return Stream(b"".join(parts), pid, kind, len(media) // PACKET, tuple(pts), tuple(i for i, f in enumerate(flags) if f))


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): written as a table in the shared folder and read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), ROWS):
                part = b.iloc[lo : lo + ROWS]
                both = [padded(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "n_bytes": [n for _, n in both], "media": [mux(p) for p, _ in both]}).astype({"doc_id": "Int64"})

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(tidy(run), "doc_id long, n_bytes long, media binary"), "media")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<int>"


def media_features(media: DataFrame) -> DataFrame:
    """Parses every stored stream; timestamps and random-access points come as arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, n, raw in zip(b["doc_id"].astype("Int64"), b["n_bytes"], b["media"], strict=True):
                raw = bytes(raw)
                s = demux(raw)
                seen = f"pid={s.pid};type={s.stream_type};packets={s.packets};units={len(s.pts)};pts={s.pts[0]}-{s.pts[-1]};random_access={','.join(map(str, s.random_access))}"
                rows.append((doc_id, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), seen, list(s.pts), list(s.random_access)))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return media.mapInPandas(tidy(run), FEATURES)
