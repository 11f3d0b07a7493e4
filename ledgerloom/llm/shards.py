"""Shards of documents that ask about keys, and get answers back.

A shard is a run of documents of bounded bytes, kept as one row of a written table. It
asks once about each of its distinct keys, so a key that a third of all documents share
costs one question a shard. Questions of one range of keys travel in one message, and no
empty message is sent: messages are never more than keys, which grow with the input. They
meet by range of keys; only answers that tell a shard something new go back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHARD_BYTES = 2 << 20
PACKED = "shard long, ids binary, nulls binary, sizes binary, body binary"
#: The rank of a null doc_id: above all others.
LAST = np.iinfo(np.int64).max


def shard_rows(docs: DataFrame, schema: str, build: Callable[[np.ndarray, np.ndarray, list[bytes]], list], shard_bytes: int, total: int) -> DataFrame:
    """One written row per shard of ``docs(doc_id, text)``: its number, then what ``build``
    makes of (ids, flags of null ids, texts). Documents stay where they are read."""
    names = [c.split()[0] for c in schema.split(", ")]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        body: list[bytes] = []
        size, place, part = 0, 0, 0

        def out() -> pa.RecordBatch:
            known, nulls = np.array([i if i is not None else 0 for i in ids], np.int64), np.array([i is None for i in ids], bool)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + place]), *[pa.array([x], pa.binary()) for x in build(known, nulls, body)]], names)

        for b in batches:
            for i, t, p in zip(b.column(0), b.column(1), b.column(2), strict=True):
                part = p.as_py()
                raw = t.as_buffer().to_pybytes()
                ids.append(i.as_py())
                body.append(raw)
                size += len(raw) + 16
                if size >= shard_bytes:
                    yield out()
                    ids, body, size, place = [], [], 0, place + 1
        if ids:
            yield out()

    return materialize(slim.mapInArrow(run, schema), "shards", SMALL_GROUPS, by_shard(total))


#: A reader takes a whole row group into memory.
SMALL_GROUPS = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false"}


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def by_shard(total: int, each: int = 12 << 20) -> tuple[int, str]:
    """How tables of shards are bucketed: answers come to them, they are not shuffled."""
    return min(100_000, max(8, -(-total // each))), "shard"


def squeezed(raw: bytes) -> bytes:
    """Compressed once, so that neither tables nor shuffles hold more."""
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unsqueezed(raw, size: int) -> bytes:
    return pa.decompress(raw, size, codec="zstd", asbytes=True) if size else b""


def planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, lowest first, compressed."""
    return squeezed(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes())


def unplanes(raw, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(unsqueezed(raw, n * width), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(kind).ravel()


def pack_shards(docs: DataFrame, total: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of whole texts (:class:`Shard` reads a row)."""

    def build(ids: np.ndarray, nulls: np.ndarray, texts: list[bytes]) -> list:
        return [ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), squeezed(b"".join(texts))]

    return shard_rows(docs, PACKED, build, shard_bytes, total)


class Shard:
    """Documents of one packed row. ``rank``: the order of doc_id, null above all."""

    def __init__(self, row: dict) -> None:
        self.key = row["shard"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.nulls = np.frombuffer(row["nulls"], np.uint8).astype(bool)
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.at = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.buf = np.frombuffer(unsqueezed(row["body"], int(self.at[-1])), np.uint8)
        self.rank = np.where(self.nulls, LAST, self.ids)


def each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that no more than one shard is open."""
    for b in batches:
        for i in range(b.num_rows):
            yield {n: (v.as_buffer() if pa.types.is_binary(v.type) and v.is_valid else v.as_py()) for n, v in zip(b.schema.names, (b.column(k)[i] for k in range(b.num_columns)), strict=True)}


# ------------------------------------------------------------------ questions and answers
_KINDS = {"key": "<u8", "long": "<i8", "int": "<i4", "double": "<f8", "float": "<f4", "boolean": "u1"}
ASK = "bucket int, shard long, base int, rows binary"
ANSWER = "shard long, rows binary, words long, tokens long"
#: Bytes of text whose keys make up about one bucket, and buckets of a task.
BUCKET_BYTES = 4 << 20
TOGETHER = 4


def bucket_bits(total_bytes: int, each: int = BUCKET_BYTES) -> int:
    """Bits so that 2^bits ranges of keys get about ``each`` bytes of text apiece."""
    bits = 4
    while bits < 30 and total_bytes > each << bits:
        bits += 1
    return bits


def pack(fields: dict[str, str], columns: list[np.ndarray]) -> bytes:
    """Columns byte by byte, lowest first, compressed as one, after how many rows they have;
    nothing for none. Keys of one range share their high bytes, counts have few low ones."""
    n = len(columns[0])
    if not n:
        return b""
    flat = [np.ascontiguousarray(np.ascontiguousarray(c, _KINDS[k]).view(np.uint8).reshape(n, -1).T).tobytes() for c, k in zip(columns, fields.values(), strict=True)]
    return n.to_bytes(4, "little") + squeezed(b"".join(flat))


def unpack(raw, fields: dict[str, str]) -> list[np.ndarray]:
    """The columns of :func:`pack`; empty ones for null."""
    kinds = [np.dtype(_KINDS[k]) for k in fields.values()]
    if raw is None or not len(raw):
        return [np.zeros(0, k) for k in kinds]
    raw = memoryview(raw)
    n = int.from_bytes(raw[:4], "little")
    flat = np.frombuffer(unsqueezed(raw[4:], n * sum(k.itemsize for k in kinds)), np.uint8)
    out, at = [], 0
    for k in kinds:
        end = at + n * k.itemsize
        out.append(np.ascontiguousarray(flat[at:end].reshape(k.itemsize, n).T).view(k).ravel())
        at = end
    return out


def asks(shard: int, bits: int, fields: dict[str, str], *columns: np.ndarray) -> pa.RecordBatch:
    """A shard's questions, sorted by their first column, a 64-bit key: one message for each
    range of keys that has any, so there are never more messages than keys."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    cut = np.append(np.searchsorted(columns[0], edges), len(columns[0]))
    some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
    rows = [pack(fields, [c[cut[i] : cut[i + 1]] for c in columns]) for i in some]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([shard] * len(some), pa.int64()), pa.array(cut[some], pa.int32()), pa.array(rows, pa.binary())], ["bucket", "shard", "base", "rows"])


def answered(asked: DataFrame, bits: int, fields: dict[str, str], answer: Callable, told: dict[str, str]) -> DataFrame:
    """(shard, rows, words, tokens): ``answer`` gets the columns of all questions of a
    bucket, in the order of shards, and returns which of them it answers, what it tells of
    those (``told`` without its first field, the question's place in its shard), and two
    numbers about the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                bucket = b.column(0)[i].as_py()
                if bucket != now:
                    if held:
                        yield send(held)
                    now, held = bucket, []
                held.append((b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_buffer().to_pybytes()))
        if held:
            yield send(held)

    def send(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        parts = [unpack(raw, fields) for _, _, raw in held]
        size = np.array([len(p[0]) for p in parts])
        begin = np.cumsum(size) - size
        which, columns, words, tokens = answer([np.concatenate(c) for c in zip(*parts, strict=True)])
        place = which - np.repeat(begin - [base for _, base, _ in held], size)[which]
        cut = np.searchsorted(which, np.append(begin, size.sum()))
        shards, rows = [], []
        for (shard, _, _), a, b in zip(held, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b > a or not shards:  # the first carries the numbers
                shards.append(shard)
                rows.append(pack(told, [place[a:b], *[c[a:b] for c in columns]]))
        rest = [0] * (len(shards) - 1)
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(rows, pa.binary()), pa.array([words, *rest], pa.int64()), pa.array([tokens, *rest], pa.int64())], ["shard", "rows", "words", "tokens"])

    tasks = max(1, (1 << bits) // TOGETHER)
    return asked.repartition(tasks, "bucket").sortWithinPartitions("bucket", "shard").mapInArrow(run, ANSWER)


def gather(answers: DataFrame, told: dict[str, str], name: str) -> DataFrame:
    """(shard, name): all that a shard was told, column after column in one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def send() -> Iterator[pa.RecordBatch]:
            if held:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([pack(told, columns)], pa.binary())], ["shard", name])

        for b in batches:
            for shard, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if shard != now:
                    yield from send()
                    now, held = shard, []
                held.append(unpack(raw.as_buffer().to_pybytes(), told))
        yield from send()

    return answers.where(F.length("rows") > 0).select("shard", "rows").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, f"shard long, {name} binary")


def with_replies(packed: DataFrame, *replies: DataFrame) -> DataFrame:
    """``packed`` with the columns of :func:`gather`; null where a shard was told nothing."""
    for r in replies:
        packed = packed.join(r, "shard", "left")
    return packed
