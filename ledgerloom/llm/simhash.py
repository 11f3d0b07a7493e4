"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints at distance <= 2r have a common variant: flip half of the differing bits
in one and the other half in the other. So every distinct fingerprint stands for all its
variants within radius r, and fingerprints that own the same variant are linked; they are
within 2r of each other, since each is within r of it.

A 64-bit fingerprint has 2,081 variants within radius 2. They are not shipped one by one:
the first ``prefix_bits`` bits of a variant name the task that owns it, a fingerprint is
sent once to each owner its ball touches (1 + p + p(p-1)/2 of them), and the owner makes
the variants that begin with its prefix. The rows shuffled grow with p squared, not with
the size of the ball.

Contract for odd input: null text is empty; a text without words has fingerprint 0 and
is linked like any other; a null doc_id keeps its row but never names a component unless
its whole component has none; repeated rows each get their row; extra columns are ignored
by :func:`fingerprints` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, finish, materialize, mix
from .linear import Piece, pieces

RADIUS = 2  # links at 4 or fewer differing bits
SEED = 42
#: Variants that one slice of an owner's work may hold in memory.
SLICE = 1 << 22


def _bits(hashes: np.ndarray) -> int:
    """Bit i of the result is set where bit i is set in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    out = 0
    for bit in 2 * ones > len(hashes):
        out = out * 2 + int(bit)
    return out


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of one whole text over ``words``-word shingles, repeats counted."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split: the six ASCII spaces
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        line = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = (ends - [len(w) + 1 for w in found]).tolist()
        ends = (ends - 1).tolist()
        shingles = [line[a:b] for a, b in zip(starts, ends[words - 1 :], strict=False)]
    digest = xxhash.xxh64_intdigest
    return _bits(np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(score, "doc_id long, fp long")


# ------------------------------------------------------------------ the ball, by owners
def _masks(width: int, r: int) -> np.ndarray:
    """All masks of ``width`` low bits with at most r bits set."""
    return np.array([sum(1 << i for i in c) for k in range(r + 1) for c in combinations(range(width), k)], np.uint64)


def _forest(owner: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each variant with several owners: its first owner and each other one."""
    order = np.lexsort((owner, variant))
    owner, variant = owner[order], variant[order]
    new = np.ones(len(variant), bool)
    new[1:] = variant[1:] != variant[:-1]
    first = owner[np.maximum.accumulate(np.where(new, np.arange(len(variant)), 0))]
    link = ~new & (first != owner)
    return first[link], owner[link]


def _merge(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indexes reaches over the links (a, b)."""
    root = np.arange(n)
    if len(a):
        a, b = np.unique(np.stack([a, b]), axis=1)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    while (root != root[root]).any():
        root = root[root]
    return root


def owned_links(prefix: int, fps: np.ndarray, prefix_bits: int, radius: int = RADIUS, limit: int = SLICE) -> np.ndarray:
    """Links (2 x n, uint64) among ``fps`` that share a variant beginning with ``prefix``.

    Variants are made in slices by their next bits, each of at most about ``limit`` of
    them, however many fingerprints there are; links are merged into a forest of stars.
    """
    fps = np.unique(fps)
    low = 64 - prefix_bits
    off = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(prefix))
    links_a, links_b = [], []

    def slice_(head: int, width: int, index: np.ndarray, spent: np.ndarray) -> None:
        """Variants whose low bits begin with ``head`` (all but ``width`` bits are fixed)."""
        sizes = [sum(1 for k in range(radius - s + 1) for _ in combinations(range(width), k)) for s in range(radius + 1)]
        if width > 8 and sum(int((spent == s).sum()) * sizes[s] for s in range(radius + 1)) > limit:
            bit = (fps[index] >> np.uint64(width - 1)) & np.uint64(1)
            for nxt in (0, 1):
                more = spent + (bit != nxt)
                fit = more <= radius
                if fit.sum() > 1:
                    slice_(head * 2 + nxt, width - 1, index[fit], more[fit])
            return
        own, var = [], []
        tail = fps[index] & np.uint64((1 << width) - 1)
        for s in range(radius + 1):
            at = np.flatnonzero(spent == s)
            if len(at):
                masks = _masks(width, radius - s)
                var.append((tail[at][:, None] ^ masks[None, :]).ravel())
                own.append(np.repeat(index[at], len(masks)))
        if own:
            a, b = _forest(np.concatenate(own), np.concatenate(var))
            if len(a):
                links_a.append(a)
                links_b.append(b)

    fit = np.flatnonzero(off <= radius)
    slice_(0, low, fit, off[fit].astype(np.int64))
    if not links_a:
        return np.zeros((2, 0), np.uint64)
    root = _merge(len(fps), np.concatenate(links_a), np.concatenate(links_b))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return np.stack([fps[root[moved]], fps[moved]])


def ball_links(distinct: DataFrame, radius: int = RADIUS, rows_each: int = 2000, limit: int = SLICE) -> DataFrame:
    """(a, b): links between the distinct fingerprints in ``distinct(fp)``.

    ``prefix_bits`` follows the number of fingerprints, so that an owner has about
    ``rows_each`` in the inner part of its ball.
    """
    n = distinct.count()
    bits = 4
    while bits < 24 and n > rows_each << (bits - 4):
        bits += 1
    masks = [int(m) << (64 - bits) for m in _masks(bits, radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    routed = distinct.select(
        F.col("fp"),
        F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: F.shiftrightunsigned(F.col("fp").bitwiseXOR(m), 64 - bits))).alias("owner"),
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has several owners, sorted: one is worked on at a time
        now, held = None, []
        for b in batches:
            fp, owner = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y <= x:
                    continue
                if owner[x] != now:
                    yield from emit(now, held)
                    now, held = owner[x], []
                held.append(fp[x:y].copy())
        yield from emit(now, held)

    def emit(owner, held: list) -> Iterator[pa.RecordBatch]:
        if held:
            found = owned_links(int(owner), np.concatenate(held), bits, radius, limit).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 16)
    return routed.repartition(tasks, "owner").sortWithinPartitions("owner").mapInArrow(links, "a long, b long")


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for ``prints(doc_id, fp)``; component_id is the smallest
    doc_id reachable over links, itself included."""
    prints = materialize(prints, "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = connected_components(ball_links(distinct.select("fp"), radius))
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    classes = materialize(classes, "classes")
    low = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    low = materialize(classes.join(low, "root").select("fp", "component_id"), "class-of")
    return prints.join(low, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits. Equal texts have equal fingerprints and
    meet there; no pair of copies is ever made.
    """
    found = components(fingerprints(docs, words, text), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ------------------------------------------------------------------ near copies of whole texts
SKETCH = 128
#: Standard errors below 0.8 at which a sketch refuses a pair before its sets are compared.
ERRORS = 5.0
#: Documents of the sample that tells frequent shingles, at least, and what part of all.
SAMPLE, SAMPLE_PART = 20_000, 64
#: Shingles known as frequent, at most.
FREQUENT = 1 << 16
#: Members of a list of which all pairs are made at once; pairs a longer one makes in the
#: first round.
WIDE, ROUND = 64, 1 << 18
#: Pairs of one text whose sets are compared in the first round. Both bounds grow by GROWTH
#: a round, so that rounds are few however large a group is.
TRIES = 4
GROWTH = 8


def _sketches(piece: Piece, words: int) -> np.ndarray:
    """(texts, SKETCH) bytes: in each cell the smallest hash of the shingles that fall into
    it, as 1..255; 0 where none does."""
    h, doc = _shingles(piece, words)
    cell = doc * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64)
    low = np.full(piece.n * SKETCH, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, cell, finish(h))
    return np.where(low == np.iinfo(np.uint64).max, 0, low % np.uint64(255) + np.uint64(1)).astype(np.uint8).reshape(piece.n, SKETCH)


def _shingles(piece: Piece, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and their texts. A text with fewer words is one shingle."""
    h, first = piece.word_grams(words)
    short = np.flatnonzero((np.diff(piece.first) < words) & (np.diff(piece.first) > 0))
    whole = np.array([np.bitwise_xor.reduce(finish(mix(piece.words[piece.first[i] : piece.first[i + 1]], np.arange(piece.first[i + 1] - piece.first[i], dtype=np.uint64)))) for i in short], np.uint64)
    return np.concatenate([h, whole]), np.concatenate([piece.doc[first], short])


def _sets(piece: Piece, words: int) -> list[np.ndarray]:
    """The sorted set of each text's shingles."""
    h, doc = _shingles(piece, words)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    cut = np.searchsorted(doc, np.arange(piece.n + 1))
    return [h[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _fingerprints(piece: Piece, words: int) -> np.ndarray:
    """The SimHash of each text over its shingles, repeats counted."""
    h, doc = _shingles(piece, words)
    order = np.argsort(doc, kind="stable")
    h, cut = finish(h[order]), np.searchsorted(doc[order], np.arange(piece.n + 1))
    return np.array([_bits(h[a:b]) if b > a else 0 for a, b in zip(cut[:-1], cut[1:], strict=True)], np.uint64)


def _set_hash(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)


def _prefix(s: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones before frequent ones, of which two sets with a
    similarity of 0.8 have at least one in common."""
    if not len(s):
        return s
    weight = np.zeros(len(s), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        weight = np.where(often[at] == s, rank[at], 0)
    return s[np.lexsort((s, weight))][: len(s) - (4 * len(s) + 4) // 5 + 1]


def _alike(a: bytes, b: bytes) -> bool:
    """The exact similarity of two sorted sets is 0.8 or more."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 9 * both >= 4 * (len(x) + len(y))


def _agree(a: bytes, b: bytes) -> bool:
    """Two sketches don't differ clearly."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    some = int(((x > 0) | (y > 0)).sum())
    return ((x == y) & (x > 0)).sum() >= 0.8 * some - ERRORS * (0.16 * some) ** 0.5


def _checked(pairs: DataFrame, columns: DataFrame, name: str, test) -> DataFrame:
    """The rows of ``pairs(a, b)`` for which ``test`` holds of column ``name`` of both in
    ``columns(eq, name)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit = pa.array([test(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(2), b.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(fit)

    left = columns.select(F.col("eq").alias("a"), F.col(name).alias("of_a"))
    right = columns.select(F.col("eq").alias("b"), F.col(name).alias("of_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _may(n_a, n_b, pos_a, pos_b) -> np.ndarray:
    """Two sets whose first common shingle is at these positions may have a similarity of 0.8."""
    return (5 * np.minimum(n_a, n_b) >= 4 * np.maximum(n_a, n_b)) & (9 * np.minimum(n_a - pos_a, n_b - pos_b) >= 4 * (n_a + n_b))


def _list_pairs(eq: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, done: np.ndarray, wide: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Of one list: pairs (a, b) to compare now, which members have met all others, and
    whether pairs are left for another round.

    A member that has met all others needs nothing more, and neither do members that are
    linked already. So the members outside the largest group come one after another and
    meet all that are in other groups.
    """
    open_ = np.flatnonzero(~done)
    _, group, size = np.unique(root[open_], return_inverse=True, return_counts=True)
    lead = int(np.argmax(size)) if len(size) else -1
    turn = np.flatnonzero(group != lead)
    turn = turn[np.lexsort((eq[open_][turn], size[group[turn]]))]
    more = len(open_) > wide and len(turn) > (k := max(wide, most // max(1, len(open_))))
    if more:
        turn = turn[:k]
    a, b = [], []
    for t in turn.tolist():
        i = open_[t]
        other = open_[root[open_] != root[i]]
        other = other[_may(n[other], n[i], pos[other], pos[i])]
        a.append(np.minimum(eq[other], eq[i]))
        b.append(np.maximum(eq[other], eq[i]))
    done = done.copy()
    done[open_[turn]] = True
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none), done, bool(more)


LIST = "key long, eq long, n int, pos int, root long, done boolean"


def _meet(lists: DataFrame, wide: int, most: int) -> DataFrame:
    """Of ``lists`` (:data:`LIST`): rows with a key are members of lists that need another
    round; rows without one are pairs (eq, root) to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last list so far
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(cols[0])) + 1, [b.num_rows]])
            if held and held[0][0][0] != cols[0][0]:
                yield from send(one(held))
                held = []
            if len(cut) == 2:
                held.append([c.copy() for c in cols])
                continue
            if held:
                held.append([c[: cut[1]] for c in cols])
                yield from send(one(held))
                cut = cut[1:]
            held = [[c[cut[-2] :].copy() for c in cols]]
            size, out = np.diff(cut)[:-1], []
            for i in np.flatnonzero(size > wide).tolist():
                out += one([[c[cut[i] : cut[i + 1]] for c in cols]])
            # all short lists at once: row i with row i + d of the same list
            end = np.repeat(cut[1:-1], np.where(size > wide, 0, size))
            at = np.flatnonzero(np.repeat(size <= wide, size)) + cut[0]
            for d in range(1, wide):
                fit = at + d < end
                at, end = at[fit], end[fit]
                if not len(at):
                    break
                apart = cols[4][at] != cols[4][at + d]  # members of one group need no pair
                out += pairs_of(*(cols[k].astype(np.int64)[x[apart]] for k in (1, 2, 3) for x in (at, at + d)))
            yield from send(out)
        yield from send(one(held) if held else [])

    def pairs_of(eq_a, eq_b, n_a, n_b, pos_a, pos_b) -> list:
        fit = _may(n_a, n_b, pos_a, pos_b)
        return pairs(np.minimum(eq_a, eq_b)[fit], np.maximum(eq_a, eq_b)[fit])

    def pairs(a: np.ndarray, b: np.ndarray) -> list:
        zero = np.zeros(len(a), np.int64)
        return [(zero > 0, zero, a, zero, zero, b, zero > 0)] if len(a) else []

    def one(held: list[list[np.ndarray]]) -> list:
        key, eq, n, pos, root, done = (np.concatenate(c) for c in zip(*held, strict=True)) if len(held) > 1 else held[0]
        if len(eq) < 2:
            return []
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        a, b, done, more = _list_pairs(eq, n, pos, root, done, wide, most)
        out = pairs(a, b)
        if more:
            out.append((np.full(len(eq), True), key, eq, n, pos, root, done))
        return out

    def send(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            some, key, eq, n, pos, root, done = (np.concatenate(c) for c in zip(*out, strict=True))
            cols = [pa.array(key, pa.int64(), mask=~some), pa.array(eq), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(root), pa.array(done)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "eq", "n", "pos", "root", "done"])

    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(run, LIST)


def _frequent(slim: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample, sorted, and their ranks by frequency. Which are known
    bears on the length of lists alone; any order of shingles gives the same links."""
    rows = slim.count()
    part = max(SAMPLE / max(1, rows), 1 / SAMPLE_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches):
            found = np.concatenate(_sets(Piece(texts, lower=True), words))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["gram"])

    sample = slim if part >= 1 else slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    counts = sample.mapInArrow(run, "gram long").groupBy("gram").count().where("count > 2")
    found = counts.orderBy(F.desc("count"), "gram").limit(FREQUENT).toArrow()
    gram = found.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    return gram[order], (len(gram) - np.arange(len(gram)))[order]


def near_copy_links(docs: DataFrame, words: int = 5, wide: int = WIDE, most: int = ROUND) -> DataFrame:
    """(a, b): links between doc_ids of near copies: whole texts whose sets of
    ``words``-word shingles have a similarity (Jaccard) of 0.8 or more.

    Every such pair that isn't joined by other links is found. Texts with one set meet by
    its hash. SimHash of the same shingles comes first: sets whose fingerprints are equal or
    linked by :func:`ball_links` are compared, and those alike are linked. The rest, since
    a similarity of 0.8 may differ in more bits than a ball reaches, meets exactly: two sets with a similarity of 0.8 have a shingle in common among the first
    fifth of each in any one order of all shingles, so sets meet in the lists of these.
    Rare shingles come first, and a list's pairs are not made at once: members that are
    linked need no pair (:func:`_list_pairs`). A sketch refuses pairs that differ clearly;
    of all others the sets are compared.
    """
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    often, rank = _frequent(slim, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            piece = Piece(texts, lower=True)
            sets, cells, prints = _sets(piece, words), _sketches(piece, words), _fingerprints(piece, words)
            heads = [_prefix(s, often, rank).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([_set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array(prints.view(np.int64))],
                ["id", "eq", "n", "sketch", "head", "fp"],
            )

    prints = materialize(slim.mapInArrow(run, "id long, eq long, n int, sketch binary, head array<long>, fp long"), "prints")
    first = materialize(prints.groupBy("eq").agg(F.min("id").alias("low")), "first")
    same = prints.select("id", "eq").join(first, "eq").where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    own = materialize(prints.join(first.toDF("eq", "id"), ["eq", "id"], "left_semi").dropDuplicates(["eq"]), "own")
    sketches = own.select("eq", "sketch")
    lists = own.select("eq", "n", F.posexplode("head").alias("pos", "key")).select("key", "eq", "n", "pos", F.col("eq").alias("root"), F.lit(False).alias("done"))
    links = _simhash_links(own, first, slim, words)
    if links is not None:
        lists = _with_roots(lists, links)
    while True:
        met = materialize(_meet(lists, wide, most), "met")
        most *= GROWTH
        pairs = met.where("key is null").select(F.col("eq").alias("a"), F.col("root").alias("b")).distinct()
        alike = materialize(_checked(pairs, sketches, "sketch", _agree), "alike")
        new = _verified(alike, first, slim, words)
        discard(alike)
        if new is not None:
            links = new if links is None else _joined(links, new)
        left = met.where("key is not null")
        if left.isEmpty():
            break
        if links is None:
            lists = left
            continue
        lists = _with_roots(left, links)
    if links is None:
        return same
    left, right = first.toDF("a", "id_a"), first.toDF("b", "id_b")
    return same.unionByName(links.join(left, "a").join(right, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


def _with_roots(lists: DataFrame, links: DataFrame) -> DataFrame:
    """``lists`` with each member's group as ``links`` have it now."""
    roots = connected_components(links).withColumnRenamed("root", "top")
    return lists.join(roots, F.col("eq") == F.col("node"), "left").select("key", "eq", "n", "pos", F.coalesce("top", "root").alias("root"), "done")


def _simhash_links(own: DataFrame, first: DataFrame, slim: DataFrame, words: int) -> DataFrame | None:
    """Links (a, b) between sets whose fingerprints meet in a ball and which are alike, or
    None. Each fingerprint is stood for by its smallest set; the others are compared to it."""
    lead = materialize(own.groupBy("fp").agg(F.min("eq").alias("low")), "fingerprints")
    alike_prints = ball_links(lead.select("fp"), limit=SLICE // 4).distinct()
    near = alike_prints.join(lead.toDF("a", "low_a"), "a").join(lead.toDF("b", "low_b"), "b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))
    equal = own.join(lead, "fp").where("eq <> low").select(F.col("low").alias("a"), F.col("eq").alias("b"))
    alike = materialize(_checked(near.unionByName(equal).distinct(), own.select("eq", "sketch"), "sketch", _agree), "alike")
    links = _verified(alike, first, slim, words)
    discard(alike, lead)
    return links


def _joined(links: DataFrame, new: DataFrame) -> DataFrame:
    """One written table of both, so that plans don't grow with the rounds."""
    both = materialize(links.unionByName(new), "verified")
    discard(links, new)
    return both


def _verified(alike: DataFrame, first: DataFrame, slim: DataFrame, words: int) -> DataFrame | None:
    """Links (a, b) among the pairs ``alike`` of which the exact sets have a similarity of
    0.8, or None. Pairs that other links join already are left out: each round compares
    TRIES pairs of a text, until none is left."""
    if alike.isEmpty():
        return None
    nodes = alike.select(F.explode(F.array("a", "b")).alias("eq")).distinct().join(first, "eq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for want, texts in pieces(batches):
            sets = _sets(Piece(texts, lower=True), words)
            # rows of one doc_id may have other texts
            fit = [(w, s) for w, s in zip(want, sets, strict=True) if _set_hash(s) == w]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in fit], pa.int64()), pa.array([s.tobytes() for _, s in fit], pa.binary())], ["eq", "members"])

    texts = slim.join(nodes, F.col("doc_id") == F.col("low")).select("eq", "text")
    sets = materialize(texts.mapInArrow(run, "eq long, members binary").dropDuplicates(["eq"]), "sets")
    links, left, tries = None, alike, TRIES
    while True:
        turn = F.row_number().over(Window.partitionBy("b").orderBy("a"))
        left = materialize(left.withColumn("turn", turn), "left")
        new = materialize(_checked(left.where(F.col("turn") <= tries).select("a", "b"), sets, "members", _alike), "verified")
        links = new if links is None else _joined(links, new)
        left = left.where(F.col("turn") > tries).select("a", "b")
        tries *= GROWTH
        if left.isEmpty():
            discard(sets)
            return links
        roots = connected_components(links)
        tops = [roots.toDF(x, f"top_{x}") for x in "ab"]
        left = left.join(tops[0], "a", "left").join(tops[1], "b", "left")
        left = left.where(F.coalesce("top_a", "a") != F.coalesce("top_b", "b")).select("a", "b")


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest
    (doc_id, text hash).

    Of rows that share a doc_id one stays. Rows without a doc_id are no duplicates of
    anything and stay. All columns stay.
    """
    groups = materialize(connected_components(near_copy_links(docs, words)).where("node <> root").select("node"), "copies").alias("g")
    # the row travels as one struct
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    kept = rows.where("doc.doc_id is not null").join(groups, F.col("doc.doc_id").cast("long") == F.col("g.node"), "left_anti")
    first = F.row_number().over(Window.partitionBy("doc.doc_id").orderBy(F.xxhash64(F.coalesce("doc.text", F.lit("")))))
    kept = kept.withColumn("turn", first).where("turn = 1").select("doc").unionByName(rows.where("doc.doc_id is null"))
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
