"""ISO base media files: build, walk and describe them without decoding payloads.

A file is a tree of boxes. ``describe`` walks the nested boxes, decodes the sample tables
(stsz, stsc, stco/co64, stts, stss) and gives codec, duration and the byte ranges of
keyframes; it never looks into the samples. ``wrap`` stores raw 8-bit samples ("raw " in
one track), one sample per 576-byte unit.

Odd input: null text is the empty text, which is stored as one unit of padding; equal
texts give equal files; a payload of any length streams through in one row; rows repeat
as they come; an empty table gives no rows; extra columns are not looked at. Bytes that
are no such file give a description with ``error`` set and nothing else.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
RATE = 44_100
#: A keyframe (sync sample) at every so many units.
KEY_EVERY = 64
#: Units in a chunk of the media data.
PER_CHUNK = 256
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"])


# ------------------------------------------------------------------ writing
def _box(kind: bytes, *parts: bytes, wide: bool = False) -> bytes:
    body = b"".join(parts)
    if not wide and len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes) -> bytes:
    """``payload`` with bytes 255 appended up to a positive multiple of the unit."""
    size = max(UNIT, -(-len(payload) // UNIT) * UNIT)
    return payload + b"\xff" * (size - len(payload))


def wrap(payload: bytes) -> bytes:
    """A file whose one track holds ``payload``, a positive multiple of the unit."""
    n = len(payload) // UNIT
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ticks = n * UNIT
    head = _box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    chunks = -(-n // PER_CHUNK)
    runs = [(1, PER_CHUNK if chunks > 1 else n)]
    if chunks > 1 and n % PER_CHUNK:
        runs.append((chunks, n % PER_CHUNK))
    stsc = struct.pack(">I", len(runs)) + b"".join(struct.pack(">III", first, count, 1) for first, count in runs)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    wide = len(payload) + 4096 > 1 << 32

    def moov(base: int) -> bytes:
        at = base + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * UNIT)
        offsets = _full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes()) if wide else _full(b"stco", struct.pack(">I", chunks), at.astype(">u4").tobytes())
        stbl = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, UNIT)), _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", stsc), _full(b"stsz", struct.pack(">II", UNIT, n)), offsets,
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    start = len(head) + len(moov(0)) + (16 if wide else 8)
    return b"".join([head, moov(start), _box(b"mdat", payload, wide=wide)])


# ------------------------------------------------------------------ reading
def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, bool, int, int]]:
    """(kind, in a track, body start, body end) of every box, outer boxes first, however deep
    they are nested."""
    open_ = [(start, end, False)]
    while open_:
        at, end, tracked = open_.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("cut box header")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield kind, tracked, body, stop
        open_.append((stop, end, tracked))
        if kind in CONTAINERS:
            open_.append((body, stop, tracked or kind == b"trak"))


class Track:
    """Sample tables of one ``trak`` box."""

    def __init__(self, data: memoryview) -> None:
        self.data = data
        self.codec, self.kind, self.scale, self.ticks = "", "", 0, 0
        self.sizes = np.zeros(0, np.int64)
        self.offsets = np.zeros(0, np.int64)
        self.runs: np.ndarray = np.zeros((0, 3), np.int64)
        self.keys: np.ndarray | None = None
        self.deltas: np.ndarray = np.zeros((0, 2), np.int64)

    def table(self, at: int, end: int, count: int, width: int, kind: str) -> np.ndarray:
        if at + count * width * np.dtype(kind).itemsize > end:
            raise ValueError("a table is longer than its box")
        return np.frombuffer(self.data, kind, count * width, at).astype(np.int64).reshape(count, width)

    def take(self, name: bytes, at: int, end: int) -> None:
        u32 = lambda pos: struct.unpack_from(">I", self.data, pos)[0]
        if name == b"mdhd":
            if self.data[at] == 1:
                self.scale, self.ticks = struct.unpack_from(">IQ", self.data, at + 20)
            else:
                self.scale, self.ticks = struct.unpack_from(">II", self.data, at + 12)
        elif name == b"hdlr":
            self.kind = bytes(self.data[at + 8 : at + 12]).decode("latin-1")
        elif name == b"stsd" and u32(at + 4):
            self.codec = bytes(self.data[at + 12 : at + 16]).decode("latin-1")
        elif name == b"stsz":
            fixed, n = u32(at + 4), u32(at + 8)
            if fixed * n > len(self.data):
                raise ValueError("more samples than the file has bytes")
            self.sizes = np.full(n, fixed, np.int64) if fixed else self.table(at + 12, end, n, 1, ">u4")[:, 0]
        elif name == b"stco":
            self.offsets = self.table(at + 8, end, u32(at + 4), 1, ">u4")[:, 0]
        elif name == b"co64":
            self.offsets = self.table(at + 8, end, u32(at + 4), 1, ">u8")[:, 0]
        elif name == b"stsc":
            self.runs = self.table(at + 8, end, u32(at + 4), 3, ">u4")
        elif name == b"stss":
            self.keys = self.table(at + 8, end, u32(at + 4), 1, ">u4")[:, 0]
        elif name == b"stts":
            self.deltas = self.table(at + 8, end, u32(at + 4), 2, ">u4")

    def ranges(self) -> np.ndarray:
        """(start, end) of every sample in the file."""
        n = len(self.sizes)
        if not n or not len(self.runs) or not len(self.offsets):
            return np.zeros((0, 2), np.int64)
        first = np.append(self.runs[:, 0] - 1, len(self.offsets))
        if first[0] != 0 or (np.diff(first) < 0).any():
            raise ValueError("runs of chunks out of order")
        per_chunk = np.repeat(self.runs[:, 1], np.diff(first))
        ends = np.cumsum(per_chunk)
        if not len(ends) or ends[-1] < n:
            raise ValueError("fewer chunk places than samples")
        chunk = np.searchsorted(ends, np.arange(n), side="right")
        before = np.cumsum(self.sizes) - self.sizes
        lead = ends - per_chunk
        start = self.offsets[chunk] + before - before[np.minimum(lead[chunk], n - 1)]
        out = np.stack([start, start + self.sizes], axis=1)
        if len(out) and (out.min() < 0 or out.max() > len(self.data)):
            raise ValueError("a sample lies outside the file")
        return out

    def keyframes(self) -> np.ndarray:
        """Byte ranges of the sync samples; all samples where there is no stss box."""
        found = self.ranges()
        return found if self.keys is None else found[self.keys[(self.keys >= 1) & (self.keys <= len(found))] - 1]

    def duration(self) -> float:
        ticks = int((self.deltas[:, 0] * self.deltas[:, 1]).sum()) or self.ticks
        return ticks / self.scale if self.scale else 0.0


def tracks(data: bytes | memoryview) -> list[Track]:
    view = memoryview(data)
    out: list[Track] = []
    for kind, tracked, at, end in boxes(view, 0, len(view)):
        if kind == b"trak":
            out.append(Track(view))
        elif out and tracked:
            out[-1].take(kind, at, end)
    return out


def read_payload(data: bytes | memoryview) -> bytes:
    """The samples of the first track, joined, found by its sample tables."""
    found = tracks(data)[0].ranges()
    new = np.ones(len(found), bool)
    new[1:] = found[1:, 0] != found[:-1, 1]
    at = np.flatnonzero(new)
    stops = np.append(at[1:], len(found)) - 1
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in zip(found[at, 0].tolist(), found[stops, 1].tolist(), strict=True))


def feature(data: bytes | memoryview) -> str:
    """Codec, kind, duration, samples, and the keyframes' number, first and last byte range,
    CRC of all ranges and CRC of the bytes in them, of the first track."""
    t = tracks(data)[0]
    keys = t.keyframes()
    inside, view = 0, memoryview(data)
    for a, b in keys.tolist():
        inside = zlib.crc32(view[a:b], inside)
    edge = lambda i: f"{keys[i, 0]}-{keys[i, 1]}" if len(keys) else "-"
    return f"codec={t.codec.strip()};kind={t.kind};seconds={t.duration():.6f};samples={len(t.sizes)};keyframes={len(keys)};first={edge(0)};last={edge(-1)};ranges={zlib.crc32(keys.astype('<i8').tobytes())};bytes={inside}"


# ------------------------------------------------------------------ on DataFrames
DESCRIPTION = "tracks array<struct<codec: string, kind: string, seconds: double, samples: long, key_starts: array<long>, key_ends: array<long>>>, error string"


def describe(media: DataFrame, content: str = "content") -> DataFrame:
    """``media`` with ``tracks`` and ``error``, from its binary column ``content``.

    The rows pass by in Arrow batches; all other columns go through untouched. Columns
    named like the two new ones are replaced.
    """
    media = media.drop("tracks", "error")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in media.schema)}, {DESCRIPTION}"

    def one(data: bytes | None) -> tuple[list, str | None]:
        try:
            rows = []
            for t in tracks(data or b""):
                keys = t.keyframes()
                rows.append({"codec": t.codec, "kind": t.kind, "seconds": t.duration(), "samples": len(t.sizes), "key_starts": keys[:, 0].tolist(), "key_ends": keys[:, 1].tolist()})
            return rows, None if rows else "no track"
        except (ValueError, struct.error, IndexError) as why:
            return [], str(why) or type(why).__name__

    kind = pa.list_(pa.struct([("codec", pa.string()), ("kind", pa.string()), ("seconds", pa.float64()), ("samples", pa.int64()), ("key_starts", pa.list_(pa.int64())), ("key_ends", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(x.as_py()) for x in b.column(b.schema.get_field_index(content))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.string())], [*b.schema.names, "tracks", "error"])

    return media.mapInArrow(run, schema)


def media_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: its text is stored in a file, read back and described."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def one(doc_id: int | None, body: bytes) -> tuple:
        stored = wrap(pad(body))
        back = read_payload(stored)
        return doc_id, len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(i.as_py(), t.as_buffer().to_pybytes() if t.is_valid else b"") for i, t in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip([f[0] for f in fields], r, strict=True)) for r in rows], pa.schema(fields))

    slim = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
