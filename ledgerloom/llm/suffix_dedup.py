"""Removal of repeated byte strings by suffix arrays.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller
doc_id. Documents lie in shards of bounded bytes (:mod:`shards`), wherever they are read.

1. Candidates. In every 50-byte window the smallest hash of its 24-byte strings is the
   window's key; equal windows have equal keys, and a run of windows that share a key is
   one string. Shards ask about their distinct (key, hash of the run's string) pairs, with
   the smallest doc_id that has each, and learn the smallest doc_id of all and whether the
   key has other strings elsewhere. A run with a smaller doc_id goes as a whole; one whose
   key has this string alone stays as a whole. That is exact, and settles most windows.
2. Suffix arrays. Over the windows that are left each shard builds a suffix array by
   Larsson-Sadakane refinement and Kasai's common prefixes; a class of suffixes that
   share 50 bytes is one string, with the smallest doc_id that has it in the shard.
3. Merging. Shards ask about each such string once, by two independent 64-bit hashes, and
   learn the smallest doc_id of all; answers come with the places of their questions. This
   departs from a merge of sorted classes by binary search over their bytes: strings of
   different shards are compared by hashes alone.

What is shuffled grows with the input: 24 bytes for each 14 windows and for each distinct
string that is left, an answer where it tells something new, and the texts once a phase.
Runs are compared by 128 bits (key and string) and strings by 128 bits, so a wrong match
has a chance of about strings^2 / 2^128.

Odd input: null text is empty; a null doc_id is larger than all others, and rows without
one never lose bytes to each other; equal ids neither; repeated rows each get their row;
texts shorter than 50 bytes lose nothing; an empty table gives no rows; extra columns are
ignored by :func:`repeated` and kept by :func:`cut_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, finish, gram_hashes, materialize, mix, span_hashes
from .shards import ASK, Shard, answered, asks, bucket_bits, each_shard, gather, pack_shards, text_bytes, unpack, with_replies

LENGTH = 50
GRAM = 24


# ------------------------------------------------------------------ suffix arrays
def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``text`` (uint8), by Larsson-Sadakane refinement.

    Ranks start from the first seven bytes; each step doubles the compared length and
    sorts only the positions whose rank is still shared. The end sorts below all bytes.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    wide = np.zeros(n + 8, np.int64)
    wide[:n] = text.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = key * 257 + wide[i : i + n]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    # a rank is the place of the last member of its group, as in the paper
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(new)
    rank[order] = np.repeat(np.append(starts[1:], n) - 1, np.diff(np.append(starts, n)))
    size = np.diff(np.append(starts, n))
    open_ = np.flatnonzero(np.repeat(size, size) > 1)  # places in the order still unsorted
    h = 7
    while len(open_):
        pos = order[open_]
        ahead = pos + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        first = rank[pos]
        turn = np.lexsort((second, first))
        pos, first, second = pos[turn], first[turn], second[turn]
        order[open_] = pos
        cut = np.ones(len(pos), bool)
        cut[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(cut)
        size = np.diff(np.append(at, len(pos)))
        rank[pos] = np.repeat(open_[np.append(at[1:], len(pos)) - 1], size)
        open_ = open_[np.repeat(size, size) > 1]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[i]: common bytes of suffixes order[i-1] and order[i]; lcp[0] is 0.

    Kasai's rule, lcp at position p+1 is at least that at p less 1, is an equality unless
    the bytes before the two neighbours differ. So bytes are compared only at positions
    where they do, eight at a time, and all other values are counted down from there.
    """
    n = len(text)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)  # the neighbour below, by position
    before[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    p = np.arange(1, n)
    q = before[1:]
    fresh[1:] = (q <= 0) | (before[:-1] < 0) | (text[p - 1] != text[np.maximum(q - 1, 0)])
    # counted down only where the neighbour moves along; else compared anew
    fresh[1:] |= before[:-1] + 1 != q
    at = np.flatnonzero(fresh & (before >= 0))
    wide = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.zeros(n + 8, np.uint64)
    for i in range(8):
        words |= wide[i : i + n + 8].astype(np.uint64) << np.uint64(8 * i)
    value = np.zeros(n, np.int64)
    left = at
    while len(left):
        a, b = left + value[left], before[left] + value[left]
        room = n - np.maximum(a, b)
        diff = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = diff & (~diff + np.uint64(1))
        same = np.where(diff == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
        same = np.minimum(same, np.maximum(room, 0))
        value[left] += same
        left = left[(same == 8) & (room > 8)]
    lead = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    by_pos = np.where(before >= 0, np.maximum(0, value[lead] - (np.arange(n) - lead)), 0)
    lcp[:] = by_pos[order]
    lcp[0] = 0
    return lcp


# ------------------------------------------------------------------ windows of a shard
class Windows:
    """The 50-byte windows of a shard's documents, in runs of one key."""

    def __init__(self, shard: Shard, length: int = LENGTH, gram: int = GRAM) -> None:
        self.shard, self.length = shard, length
        n = len(shard.buf)
        count = np.maximum(0, shard.sizes - length + 1)
        begin = shard.at[:-1]
        # key of every window of the buffer, also those across documents, then the real ones;
        # a shard is far below 2 GB unless one document is not, so places are 32-bit numbers
        if n >= 1 << 31:
            raise ValueError("a document of 2 GB or more")
        grams = gram_hashes(shard.buf, (gram, length))
        h, self.hash50 = grams[gram], grams[length]
        span = length - gram + 1
        keys = np.empty(max(0, n - length + 1), np.uint64)
        block = 1 << 16
        for at in range(0, len(keys), block):
            part = h[at : at + block + span - 1]
            w = 1
            while w * 2 <= span:
                part = np.minimum(part[:-w], part[w:])
                w *= 2
            if w < span:
                part = np.minimum(part[: len(part) - (span - w)], part[span - w :])
            keys[at : at + len(part)] = part
        del h, grams
        self.doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
        lead = (begin - np.concatenate([[0], np.cumsum(count)[:-1]])).astype(np.int32)
        self.pos = np.repeat(lead, count)
        self.pos += np.arange(len(self.pos), dtype=np.int32)
        k = keys[self.pos]
        del keys
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.first = np.flatnonzero(new)  # window index of each run's first window
        self.count = np.diff(np.append(self.first, len(k)))
        # a smallest hash is small: hashed once more, one to one, keys fill all ranges alike
        self.key = finish(k[self.first])
        self.run_doc = self.doc[self.first]
        # hash of the run's whole string: its bytes from the first window to the last's end
        self.string = self._strings()

    def _strings(self) -> np.ndarray:
        start = self.pos[self.first]
        size = self.count + self.length - 1
        if not len(start):
            return np.zeros(0, np.uint64)
        last = start + size - self.length
        out = mix(self.hash50[start], self.hash50[last]) + size.astype(np.uint64)
        # two windows cover a string of up to twice their length; in periodic text a run may
        # be longer, and the windows between go in too
        at, long_ = start + self.length, np.flatnonzero(last > start + self.length)
        while len(long_):
            out[long_] = mix(out[long_], self.hash50[at[long_]])
            at[long_] += self.length
            long_ = long_[at[long_] < last[long_]]
        return finish(out)

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (key, string) pairs, the smallest rank of each, and each run's pair."""
        rank = self.shard.rank[self.run_doc]
        order = np.lexsort((rank, self.string, self.key))
        k, s = self.key[order], self.string[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        place = np.empty(len(k), np.int64)
        place[order] = np.cumsum(new) - 1
        return k[new], s[new], rank[order][new], place


#: What a shard asks and learns of its pairs: the smallest rank of all that have one, and
#: whether the key has other strings. Of its strings: the smallest rank of all.
ASK_RUNS, RUNS = {"key": "key", "string": "key", "low": "long"}, {"at": "int", "low": "long", "many": "boolean"}
ASK_STRINGS, STRINGS = {"one": "key", "two": "key", "low": "long"}, {"at": "int", "low": "long"}


def _lowest(one: np.ndarray, two: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (one, two): the smallest ``low`` of all equal ones; the order that sorts them
    and which places in it begin a new ``one``."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new_one = np.ones(len(a), bool)
    new_one[1:] = a[1:] != a[:-1]
    new = new_one.copy()
    new[1:] |= b[1:] != b[:-1]
    starts = np.flatnonzero(new)
    least = np.empty(len(a), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], starts), np.diff(np.append(starts, len(a)))) if len(a) else 0
    return least, order, new_one


def answer_runs(columns: list[np.ndarray]):
    key, string, low = columns
    least, order, new = _lowest(key, string, low)
    starts = np.flatnonzero(new)
    s = string[order]
    many = np.empty(len(key), bool)
    many[order] = np.repeat(np.minimum.reduceat(s, starts) != np.maximum.reduceat(s, starts), np.diff(np.append(starts, len(s))))
    which = np.flatnonzero(many | (least < low))
    return which, [least[which], many[which]], 0, 0


def answer_strings(columns: list[np.ndarray]):
    least, _, _ = _lowest(*columns)
    which = np.flatnonzero(least < columns[2])
    return which, [least[which]], 0, 0


class Verdicts:
    """What a shard knows after phase 1: which windows go, which need the suffix array."""

    def __init__(self, w: Windows, reply) -> None:
        self.w = w
        _, _, low, place = w.asked()
        at, lowest, other = unpack(reply, RUNS)
        low, many = low.copy(), np.zeros(len(low), bool)
        low[at] = lowest
        many[at] = other > 0
        gone = low[place] < w.shard.rank[w.run_doc]
        self.gone = np.repeat(gone, w.count)
        self.look_window = np.flatnonzero(np.repeat(many[place] & ~gone, w.count))

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window in ``look_window``: its class, a number by the order of strings;
        for each class: the smallest rank of its documents, and one of its windows."""
        w = self.w
        pos = w.pos[self.look_window]
        if not len(pos):
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        # the text under these windows, without the rest
        edge = np.zeros(len(w.shard.buf) + 1, np.int32)
        np.add.at(edge, pos, 1)
        np.add.at(edge, pos + w.length, -1)
        kept = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        place = np.searchsorted(kept, pos)
        text = w.shard.buf[kept]
        order = suffix_array(text)
        lcp = common_prefixes(text, order)
        rank = np.empty(len(text), np.int64)
        rank[order] = np.arange(len(text))
        label = np.cumsum(lcp < w.length)
        _, first, found = np.unique(label[rank[place]], return_index=True, return_inverse=True)
        low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(low, found, w.shard.rank[w.doc[self.look_window]])
        return found, low, self.look_window[first]

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each class, sorted: two hashes of its 50 bytes, and its smallest rank here."""
        _, low, window = self.sorted_classes()
        pos = self.w.pos[window].astype(np.int64)
        return self.w.hash50[pos], span_hashes(self.w.shard.buf, pos, pos + self.w.length), low

    def sorted_classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`classes`, numbered by the hash of their bytes."""
        found, low, window = self.classes()
        turn = np.argsort(self.w.hash50[self.w.pos[window]], kind="stable")
        place = np.empty(len(turn), np.int64)
        place[turn] = np.arange(len(turn))
        return place[found], low[turn], window[turn]


def removed_bytes(v: Verdicts, reply) -> np.ndarray:
    """Flags of the shard's bytes that go. ``reply``: what was learnt of its strings."""
    w = v.w
    gone = v.gone.copy()
    found, low, _ = v.sorted_classes()
    if len(found):
        at, lowest = unpack(reply, STRINGS)
        low = low.copy()
        low[at] = np.minimum(low[at], lowest)
        gone[v.look_window] |= w.shard.rank[w.doc[v.look_window]] > low[found]
    edge = np.zeros(len(w.shard.buf) + 1, np.int32)
    hit = w.pos[gone]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + w.length, -1)
    return np.cumsum(edge[:-1]) > 0


# ------------------------------------------------------------------ on DataFrames
def _phases(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Packed shards with the answers of both phases."""
    total = text_bytes(docs)
    packed, bits = pack_shards(docs, total), bucket_bits(total)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_shard(batches):
            key, string, low, _ = Windows(Shard(row), length, gram).asked()
            yield asks(row["shard"], bits, ASK_RUNS, key, string, low)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_shard(batches):
            yield asks(row["shard"], bits, ASK_STRINGS, *Verdicts(Windows(Shard(row), length, gram), row["runs"]).asked())

    told = materialize(answered(packed.mapInArrow(pairs, ASK), bits, ASK_RUNS, answer_runs, RUNS), "told")
    runs = materialize(gather(told, RUNS, "runs"), "runs")
    discard(told)
    told = materialize(answered(with_replies(packed, runs).mapInArrow(strings, ASK), bits, ASK_STRINGS, answer_strings, STRINGS), "told")
    below = materialize(gather(told, STRINGS, "strings"), "strings")
    discard(told)
    return with_replies(packed, runs, below)


def _removed(row: dict, length: int, gram: int) -> tuple[Shard, np.ndarray]:
    shard = Shard(row)
    return shard, removed_bytes(Verdicts(Windows(shard, length, gram), row["runs"]), row["strings"])


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_shard(batches):
            shard, gone = _removed(row, length, gram)
            start = gone.copy()
            start[1:] &= ~gone[:-1]
            start[shard.at[:-1][shard.sizes > 0]] = gone[shard.at[:-1][shard.sizes > 0]]
            total = np.concatenate([[0], np.cumsum(gone)])
            runs = np.concatenate([[0], np.cumsum(start)])
            digest = [hashlib.sha256(shard.buf[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(shard.at[:-1], shard.at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.ids, mask=shard.nulls), pa.array(shard.sizes), pa.array(total[shard.at[1:]] - total[shard.at[:-1]]), pa.array(runs[shard.at[1:]] - runs[shard.at[:-1]]), pa.array(digest)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _phases(docs, length, gram).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_text(raw: bytes, gone: np.ndarray) -> str:
    """The text that is left. A character goes only if all its bytes do."""
    buf = np.frombuffer(raw, np.uint8)
    head = (buf & 0xC0) != 0x80
    char = np.cumsum(head) - 1
    stays = np.zeros(int(char[-1]) + 1 if len(char) else 0, bool)
    np.logical_or.at(stays, char, ~gone)
    return buf[stays[char]].tobytes().decode("utf-8", "replace") if len(char) else ""


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``. A document of which no word
    is left goes; one that had none stays. Other columns stay as they are, ``n_chars``
    follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_shard(batches):
            shard, gone = _removed(row, length, gram)
            hit = [i for i in range(len(shard.ids)) if gone[shard.at[i] : shard.at[i + 1]].any()]
            texts = [kept_text(shard.buf[shard.at[i] : shard.at[i + 1]].tobytes(), gone[shard.at[i] : shard.at[i + 1]]) for i in hit]
            before = [hashlib.sha256(shard.buf[shard.at[i] : shard.at[i + 1]].tobytes()).hexdigest() for i in hit]
            yield pa.RecordBatch.from_arrays([pa.array(shard.ids[hit], mask=shard.nulls[hit]), pa.array(before, pa.string()), pa.array(texts, pa.string())], ["id", "hash", "left"])

    # what is left of a text depends on (doc_id, text) alone; the row travels as one struct
    cut = _phases(docs, length, gram).mapInArrow(run, "id long, hash string, left string").groupBy("id", "hash").agg(F.first("left").alias("left"))
    cut = materialize(cut, "cut").alias("c")
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("sha", F.sha2(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"), 256)).alias("d")
    joined = rows.join(cut, (F.col("d.sha") == F.col("c.hash")) & F.col("d.row.doc_id").cast("long").eqNullSafe(F.col("c.id")), "left")
    same = F.col("c.hash").isNull()
    out = joined.where(same | (F.length(F.trim(F.regexp_replace("c.left", "[\\x09-\\x0D]", ""))) > 0))
    text = F.when(same, F.col("d.row.text")).otherwise(F.col("c.left"))
    changed = {"text": text, "n_chars": F.when(same, F.col("d.row")["n_chars"]).otherwise(F.length(text)) if "n_chars" in docs.columns else None}
    return out.select(*[(changed[c] if c in changed else F.col("d.row")[c]).cast(t).alias(c) for c, t in docs.dtypes])
