"""Mixture-controlled packing of documents into fixed windows of tokens.

Each source is a queue. Every window takes a source's quantum, its target share of the
window; documents are cut where the quantum ends and go on in the source's part of the
next window. What a window owes a queue, a part of a token, is a deficit that later windows
pay back, whatever partition their documents lie in: after any number of windows a queue
has had its share of all tokens to within one. A queue that runs dry gives its rest at
once, and the others share its place. By default a source's target share is its share of
all tokens, so that all run dry together; give ``shares`` for other proportions.

However many sources there are, each has its deficit. Sources of less than ``POOL`` tokens a
window take turns in one queue, which has all their shares: their documents are cut into runs
of ``RUN`` tokens, and a run's turn is the tokens its source has had by its middle, over the
source's share. So a window isn't cut into pieces of a token or two, and what a small source
is owed is never more than a few runs.

Nothing of this is sequential: how many tokens of each queue lie before a place on the line
of windows has a closed form (:class:`Rounds`), and a document's place in its queue is a
running sum over numbers only. Token ids are written once, and move once to be cut.

Odd input: null text is empty and is one token, the end mark; null and empty sources are
queues of their own; a null doc_id is packed like others; repeated rows are packed each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, range_start, running_start

WINDOW = 2048
END_ID = 1
#: Words whose ids a Python worker keeps; it starts anew beyond that.
CACHE = 400_000
#: Tokens of a window below which sources take turns in one queue; so there are at most
#: WINDOW / POOL + 2 queues, however many sources.
POOL = 8
#: Tokens of a small source's turn.
RUN = 32


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts of these characters alone are cut into the tokenizer's own pieces here: ASCII and
#: the accented letters of Latin-1, which normalisation leaves as they are.
PLAIN = re.compile(r"[\n\r\t -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \n\r\ta-z0-9\xdf-\xf6\xf8-\xff]+")


class WordEncoder:
    """Ids of whole texts, piece by piece; pieces that come again are looked up.

    The tokenizer lower-cases, drops white space and encodes the matches of a pattern one
    by one. For plain texts the same pattern is applied here; others are cut at spaces and
    line feeds only, which no match crosses, and encoded between them.
    """

    def __init__(self, path: str, plain: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = plain
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.size, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def is_piece(self, word: str) -> bool:
        """The word is one match of the pattern. Words of texts cut at spaces may be several
        (``foo,``) or none (a tab), and their capitals are not letters of the pattern."""
        return self.plain and "<|" not in word and bool(PIECE.fullmatch(word) and PLAIN.fullmatch(word)) and word == word.lower()

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Pieces go many at a time, parted by spaces: each is one match of
        the pattern, so its last id is the next one that ends a word. Others go one by one."""
        joined = [self.is_piece(w) for w in words]
        pieces = iter(self._ids_of_pieces([w for w, fit in zip(words, joined, strict=True) if fit]))
        single = [w for w, fit in zip(words, joined, strict=True) if not fit]
        others = iter(self.tokenizer.encode_batch_fast(single, add_special_tokens=False) if single else [])
        return [next(pieces) if fit else next(others).ids for fit in joined]

    def _ids_of_pieces(self, words: list[str]) -> list[list[int]]:
        lines = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
        flat = np.fromiter((x for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids), np.int64)
        cut = [0, *(np.flatnonzero(self.ends_word[flat]) + 1).tolist()]
        flat = flat.tolist()
        out = [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        if len(out) != len(words):
            raise ValueError("a piece is not one word of the tokenizer")
        return out

    def learn(self, words: list[str]) -> None:
        ids = self.ids_of(words)
        n, size = len(self.index), np.array([len(i) for i in ids], np.int64)
        while len(self.start) < n + len(ids):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while len(self.flat) < self.used + size.sum():
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.size[n : n + len(ids)] = size
        self.start[n : n + len(ids)] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + size.sum()] = np.fromiter((x for i in ids for x in i), np.uint32, int(size.sum()))
        self.used += int(size.sum())
        self.index.update(zip(words, range(n, n + len(ids)), strict=True))

    def parts(self, text: str) -> list[str]:
        if self.plain and PLAIN.fullmatch(text) and "<|" not in text:
            return PIECE.findall(text.lower())
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str], end_id: int | None = END_ID) -> list[np.ndarray]:
        parts = [self.parts(t) for t in texts]
        if len(self.index) > CACHE:
            self.clear()
        # the batch's distinct pieces first: most come many times
        coded = pa.array(list(chain.from_iterable(parts)), pa.string()).dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        new = [w for w in kinds if w not in self.index]
        if new:
            self.learn(new)
        at = np.array(list(map(self.index.__getitem__, kinds)), np.int64)[coded.indices.to_numpy()]
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(int(size.sum()))]
        cut = np.concatenate([[0], ends])[np.cumsum([0, *map(len, parts)])]
        tail = [] if end_id is None else [np.array([end_id], np.uint32)]
        return [np.concatenate([ids[a:b], *tail]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder, kept between batches and tasks."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # the pattern is that of this vocabulary's tokenizer; others are cut at spaces
        _encoders[path] = WordEncoder(path, plain=os.path.basename(path) == "word_bpe_49k.json")
    return _encoders[path]


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, source, n_tokens, ids): ids as little-endian 16-bit numbers where they all
    fit, else 32-bit; ``wide`` says which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            at, texts = 0, b.column(2).to_pylist()
            while at < b.num_rows:
                stop, size = at, 0
                while stop < b.num_rows and size < 1 << 21:
                    size += len(texts[stop] or "")
                    stop += 1
                part = b.slice(at, stop - at)
                ids = enc.encode([t or "" for t in texts[at:stop]], end_id)
                wide = [bool(len(x) and x.max() > 65535) for x in ids]
                blobs = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(wide), pa.array(blobs, pa.binary())], ["doc_id", "source", "n_tokens", "wide", "ids"])
                at = stop

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, source string, n_tokens long, wide boolean, ids binary")


class Rounds:
    """How many tokens of each queue lie before any place on the line of windows.

    The line is cut into phases with fixed weights of the queues that are left. In a phase
    the tokens of the first i queues in its first y places are floor(y * weights of the
    first i / all weights), so windows are full and a queue is never off by a token. A phase
    ends at the last window's end before a queue would run dry; then comes the rest of that
    queue, a phase of its own, which is less than its quantum and two tokens. Weights must
    give a queue a token of each window at least, or be 0: such queues come last.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int) -> None:
        self.window, self.total = window, sum(totals)
        self.starts: list[int] = []
        self.base: list[list[int]] = []  # by phase, tokens given of the first i queues
        self.prefix: list[list[int]] = []  # by phase, weights of the first i queues
        left, given, at = list(totals), [0] * len(totals), 0
        live = [i for i, t in enumerate(totals) if t > 0]
        weights = list(weights)

        def phase(of: dict[int, int], size: int) -> None:
            nonlocal at
            prefix = [0, *accumulate(of.get(i, 0) for i in range(len(totals)))]
            self.starts.append(at)
            self.base.append([0, *accumulate(given)])
            self.prefix.append(prefix)
            for i in of:
                n = size * prefix[i + 1] // prefix[-1] - size * prefix[i] // prefix[-1]
                given[i] += n
                left[i] -= n
            at += size

        while live:
            if not any(weights[i] for i in live):  # no share asked for any: one after another
                phase({live[0]: 1}, left[live[0]])
                live.pop(0)
                continue
            every = sum(weights[i] for i in live)
            first = min((i for i in live if weights[i]), key=lambda i: (Fraction(left[i], weights[i]), i))
            end = at + left[first] * every // weights[first]
            if (full := end - end % window) > at:
                phase({i: weights[i] for i in live if weights[i]}, full - at)
            if left[first]:
                phase({first: 1}, left[first])
            live.remove(first)
        # tokens of each queue before each phase, to look places up
        self.before = [[b[i + 1] - b[i] for b in self.base] for i in range(len(totals))]

    def first_queues(self, i: int, place: int) -> int:
        """Tokens of the first i queues before ``place``."""
        p = bisect_right(self.starts, place) - 1
        prefix = self.prefix[p]
        return self.base[p][i] + (place - self.starts[p]) * prefix[i] // prefix[-1]

    def of_queue(self, i: int, place: int) -> int:
        return self.first_queues(i + 1, place) - self.first_queues(i, place)

    def pieces(self, queue: int, begin: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, window, offset) of the parts of a document that begins at
        ``begin`` in its queue."""
        p = bisect_right(self.before[queue], begin) - 1
        weight = self.prefix[p][queue + 1] - self.prefix[p][queue]
        w = (self.starts[p] + (begin - self.before[queue][p]) * self.prefix[p][-1] // max(1, weight)) // self.window
        w = min(w, (self.total - 1) // self.window)
        while w > 0 and self.of_queue(queue, w * self.window) > begin:
            w -= 1
        at, end = begin, begin + size
        low, low_first = self.of_queue(queue, w * self.window), self.first_queues(queue, w * self.window)
        while at < end:
            place = min((w + 1) * self.window, self.total)
            high, high_first = self.of_queue(queue, place), self.first_queues(queue, place)
            if high > at:
                n = min(high, end) - at
                yield at - begin, n, w, high_first - low_first + at - low
                at += n
            low, low_first, w = high, high_first, w + 1


def queued(tokens: DataFrame, window: int = WINDOW, shares: DataFrame | None = None, rows_each: int = 20_000) -> tuple[DataFrame, dict[tuple, int], Rounds]:
    """Of ``tokens(row, doc_id, source, n_tokens)``: (row, kind, name, at, size, before), the
    queue of each document, or of each run of a small source's documents, and the tokens
    before it there; the queues' numbers; the rounds.

    ``shares(source, share)``: target shares of a window; a source without one comes after
    all that have one.
    """
    whole = tokens.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    if shares is None:
        every = tokens.agg(F.sum("n_tokens")).first()[0] or 0
        plan = whole.withColumn("share", F.col("total") / F.lit(float(max(1, every))))
    else:
        plan = whole.alias("w").join(shares.alias("s"), F.expr("w.source <=> s.source"), "left").select("w.source", "total", F.coalesce("s.share", F.lit(0.0)).alias("share"))
    kind = F.when(F.col("share") * window >= POOL, 0).when(F.col("share") > 0, 1).otherwise(2)
    plan = materialize(plan.withColumn("kind", kind), "shares")
    small = plan.where("kind = 1").agg(F.sum("share")).first()[0] or 0.0
    if 0 < small * window < 1:
        # the small ones have no token of each window: the smallest queue takes turns with them
        least = plan.where("kind = 0").agg(F.min(F.struct("share", "source"))).first()[0]
        if least is not None:
            plan = plan.withColumn("kind", F.when(F.col("source").eqNullSafe(F.lit(least.source)), 1).otherwise(F.col("kind")))
    plan = plan.withColumn("name", F.when(F.col("kind") == 0, F.col("source")))
    # at most window / POOL + 2 rows
    rows = plan.groupBy("kind", "name").agg(F.sum("total").alias("total"), F.sum("share").alias("share")).orderBy("kind", F.col("name").asc_nulls_last()).collect()
    index = {(r.kind, r.name): i for i, r in enumerate(rows)}
    totals = [r.total for r in rows]
    weights = totals if shares is None else [round(r.share * (1 << 40)) for r in rows]
    # shares that are less than a token a window all in all come last
    rounds = Rounds(totals, [w if r.share * window >= 1 else 0 for w, r in zip(weights, rows, strict=True)], window)
    named = tokens.alias("t").join(plan.alias("p"), F.expr("t.source <=> p.source")).select("t.row", "t.doc_id", "t.source", "t.n_tokens", "p.kind", "p.name", "p.share")
    # a queue is in the order of a hash, so that its parts are alike and none is large
    named = named.withColumn("mixed", F.xxhash64(F.coalesce("doc_id", "row"), "n_tokens", "row"))
    buckets = max(64, -(-tokens.count() // rows_each))
    order = [F.col("mixed"), F.col("doc_id"), F.col("n_tokens"), F.col("row")]
    by_hash = F.pmod(F.shiftrightunsigned("mixed", 40), F.lit(buckets))
    plain = running_start(named.where("kind <> 1"), ["kind", "name"], by_hash, order, "n_tokens", "before").select("row", "kind", "name", F.lit(0).cast("long").alias("at"), F.col("n_tokens").alias("size"), "before")
    if (1, None) not in index:
        return plain, index, rounds
    runs = running_start(named.where("kind = 1"), ["source"], by_hash, order, "n_tokens", "had")
    runs = runs.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(RUN).cast("long")))).withColumn("size", F.least(F.lit(RUN).cast("long"), F.col("n_tokens") - F.col("at")))
    runs = runs.withColumn("turn", (F.col("had") + F.col("at") + F.col("size") / 2) / F.col("share")).select("row", "kind", "name", "at", "size", "turn", "mixed")
    turns = range_start(runs, [F.col("turn"), F.col("mixed"), F.col("row"), F.col("at")], "size", "before")
    return plain.unionByName(turns.select(*plain.columns)), index, rounds


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, shares: DataFrame | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids (binary, 32-bit little-endian),
    ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()
    tokens = materialize(tokenize(docs, path, end_id).withColumn("row", F.monotonically_increasing_id()), "tokens")
    started, index, rounds = queued(tokens.select("row", "doc_id", "source", "n_tokens"), window, shares)
    # a document's runs lie together: at most one for each RUN of its tokens
    queues = materialize(started, "queues").groupBy("row", "kind", "name").agg(F.sort_array(F.collect_list(F.struct("at", "size", "before"))).alias("runs"))
    joined = tokens.join(queues, "row").select("doc_id", "source", "n_tokens", "wide", "ids", "kind", "name", F.col("runs.at").alias("at"), F.col("runs.size").alias("size"), F.col("runs.before").alias("before"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for doc_id, source, n, wide, blob, kind, name, *runs in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ids = np.frombuffer(blob, "<u4" if wide else "<u2").astype("<u4")
                queue = index[kind, name]
                parts = ((at + start, *rest) for at, size, before in zip(*runs, strict=True) for start, *rest in rounds.pieces(queue, before, size))
                for start, length, sequence, offset in parts:
                    raw = ids[start : start + length].tobytes()
                    for col, v in zip(out, (doc_id, source, start, length, raw, zlib.crc32(raw), n, sequence, offset), strict=True):
                        col.append(v)
                    held += len(raw)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                    out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return joined.mapInArrow(cut, "doc_id long, source string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pieces_digest(docs: DataFrame, **options) -> DataFrame:
    """:func:`pack` without the ids themselves."""
    return pack(docs, **options).drop("ids")
