"""Phrases of two to four words that belong together, by best-first branch and bound.

A phrase of count a that is cut into a first part (count l) and a rest (count r) scores
floor(2000000 * a / (l + r)); the lowest cut counts. A prefix p whose first word has count h
bounds every phrase that grows from it: a <= f(p) and r >= a give a score of at most
floor(2000000 * f(p) / (h + f(p))). So the search grows the best prefixes first: a language's
threshold starts at the score of its 4000th pair of words; prefixes whose bound reaches it
are extended by a word, phrases whose score reaches it are also extended to the left, since
only an extension by one word can show that a phrase is a part of a longer one that is
nearly as frequent. What reaches the threshold is then settled. Where fewer than ``top``
phrases survive it is lowered and the next part of the frontier is grown, until the last
place, ties included, is settled or nothing is left to grow.

Texts are read once and written as numbers of words, some MB of one language a row. A pass
over these rows counts phrases: it looks prefixes and phrases up in bit fields of ``BITS``
bits, which is all that is sent to the tasks. A field only spares work (what passes by
chance is counted for nothing, and what a field lets pass is the same wherever a phrase
stands); every count is exact, of words themselves and not of hashes, and so is the
arithmetic, in decimals of 38 digits. Counts are added up in each row before they are
shuffled, so no frequent word or passage meets in one task.

Odd input: null text is empty, a null lang is ``und``; texts without words add nothing; a
table without frequent phrases, or without rows, gives no rows; repeated rows count each;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, finish, materialize, mix, span_hashes

#: Least count of a phrase, and the most words it has.
LEAST, LONGEST = 30, 4
#: Phrases of each language; a part goes where 100 * longer >= SHARE * its count.
TOP, SHARE = 2000, 80
#: Score of a phrase whose parts never stand elsewhere.
SCALE = 2_000_000
#: Bytes of text in a row of numbers, and rows of a batch of counts.
CHUNK, OUT = 8 << 20, 100_000
#: A bit field has 2**BITS bits (8 MB), whatever the corpus.
BITS = 26
#: The threshold starts at the score in place FIRST * top and goes on to STEP times as many.
FIRST, STEP = 2, 4

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1  # between words
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2  # between pieces


# ------------------------------------------------------------------ texts as numbers
class Coded(NamedTuple):
    """Distinct words, and the text as their numbers from 1; 0 ends a piece."""

    words: pa.Array
    codes: np.ndarray


def code(texts: pa.Array) -> Coded:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), pa.scalar("\n", pa.large_string()))
    buf = ascii_lower(np.frombuffer(joined[0].as_buffer() or b"", np.uint8))
    kind = _KIND[buf]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    at = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=at[1:])
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(buf[inside])]).dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int64)[begin] if len(begin) else begin
    # a 0 before each word that begins a new piece
    fresh = np.flatnonzero(np.diff(piece)) + 1
    return Coded(spelled.dictionary, np.insert(spelled.indices.to_numpy().astype(np.int32) + 1, fresh, 0))


def numbered(docs: DataFrame) -> DataFrame:
    """(lang, words, ends, codes): up to ``CHUNK`` bytes of texts of one language a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            words, codes = code(pa.concat_arrays(held.pop(lang)))
            size.pop(lang)
            ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int32)
            row = [pa.array([lang]), *(pa.array([x], pa.binary()) for x in (b"".join(words.to_pylist()), ends.tobytes(), codes.tobytes()))]
            return pa.RecordBatch.from_arrays(row, ["lang", "words", "ends", "codes"])

        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                texts = b.column(1).filter(pc.equal(b.column(0), lang))
                held.setdefault(lang, []).append(texts)
                size[lang] = size.get(lang, 0) + texts.nbytes
                if size[lang] >= CHUNK:
                    yield flush(lang)
            if sum(size.values()) >= 2 * CHUNK:
                yield flush(max(size, key=size.get))
        for lang in list(held):
            yield flush(lang)

    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "lang string, words binary, ends binary, codes binary")


def _read(row: dict) -> Coded:
    ends = np.frombuffer(row["ends"], np.int32)
    at = np.concatenate([np.zeros(1, np.int32), ends])
    return Coded(pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(row["words"])]), np.frombuffer(row["codes"], np.int32))


def _counts(lang: str, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), OUT):
        part = phrases.slice(at, OUT).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(n[at : at + OUT], pa.int64())], ["lang", "phrase", "f"])


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, phrase, f) of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                words, codes = _read(row)
                yield from _counts(row["lang"], words, np.bincount(codes, minlength=len(words) + 1)[1:])

    return rows.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


# ------------------------------------------------------------------ bit fields
def _of_lang(lang: str, n: int = 1) -> np.ndarray:
    return np.full(n, zlib.crc32(lang.encode()), np.uint64)


def bit_field(phrases: DataFrame, m: int) -> np.ndarray:
    """A field with the bits of all ``phrases(lang, phrase)`` of m words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                buf = np.frombuffer(b"".join(p.encode() + b" " for p in b.column(1).to_pylist()), np.uint8)
                end = np.flatnonzero(buf == 32)
                words = span_hashes(buf, np.concatenate([[0], end[:-1] + 1]), end).reshape(-1, m)
                h = np.concatenate([_of_lang(x) for x in b.column(0).to_pylist()])
                for i in range(m):
                    h = mix(h, words[:, i])
                yield pa.RecordBatch.from_arrays([pa.array((finish(h) >> np.uint64(64 - BITS)).astype(np.int64) + 1)], ["bit"])

    bits = phrases.select("lang", "phrase").mapInArrow(run, "bit long")
    # 2**BITS / 32768 rows of 4 KB at most
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    field = np.zeros(1 << (BITS - 3), np.uint8)
    for p in parts:
        field[(p.part - 1) * 4096 : p.part * 4096] = np.frombuffer(p.bits, np.uint8)
    return field


class Look(NamedTuple):
    """The ``size`` words from word ``at`` of a phrase must be in field ``field``."""

    at: int
    size: int
    field: str


def _phrases_of(row: dict, m: int, ways: list[list[Look]], fields: dict[str, np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The distinct phrases of m words in a row that pass, and how often each stands there."""
    words, codes = _read(row)
    none = pa.array([], pa.string()), np.zeros(0, np.int64)

    def passed(h: np.ndarray, field: str) -> np.ndarray:
        bit = finish(h) >> np.uint64(64 - BITS)
        return (fields[field][bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1

    ends = np.frombuffer(row["ends"], np.int32).astype(np.int64)
    of_word = span_hashes(np.frombuffer(row["words"], np.uint8), np.concatenate([[0], ends])[:-1], ends)
    known = np.concatenate([[False], passed(mix(_of_lang(row["lang"], len(words)), of_word), "words")])
    codes = np.where(known[codes], codes, 0)
    codes = codes[(codes > 0) | (np.concatenate([[1], codes[:-1]]) > 0)]
    if len(codes) < m:
        return none
    of_word = np.concatenate([np.zeros(1, np.uint64), of_word])
    whole = {1: codes > 0}
    for k in range(2, m + 1):
        whole[k] = whole[k - 1][:-1] & whole[1][k - 1 :]
    places = np.flatnonzero(whole[m])
    seen: dict[tuple[int, str], np.ndarray] = {}

    def look(x: Look) -> np.ndarray:
        """At ``places``: the words there are in the field."""
        if (x.size, x.field) not in seen:
            near = np.zeros(len(codes) + m, bool)
            at = np.flatnonzero(whole[x.size])
            h = _of_lang(row["lang"], len(at))
            for i in range(x.size):
                h = mix(h, of_word[codes[at + i]])
            near[at] = passed(h, x.field)
            seen[x.size, x.field] = near
        return seen[x.size, x.field][places + x.at]

    keep = np.zeros(len(places), bool)
    for way in ways:
        keep |= np.logical_and.reduce([look(x) for x in way]) if way else True
    places = places[keep]
    if not len(places):
        return none
    # exact numbers of the distinct phrases: by the number so far and the next word
    key = codes[places].astype(np.int64)
    for i in range(1, m):
        if i > 1:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key *= len(words) + 1
        key += codes[places + i]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    first = places[first]
    parts = [words.take(pa.array(codes[first + i] - 1)).cast(pa.string()) for i in range(m)]
    return pc.binary_join_element_wise(*parts, " "), n


def count_phrases(rows: DataFrame, m: int, ways: list[list[Look]], fields: dict[str, np.ndarray]) -> DataFrame:
    """(lang, phrase, f): exact counts, of ``LEAST`` and more, of all phrases of m words that
    pass all looks of one of the ``ways``. Words outside the field ``words`` end a piece."""
    used = {"words", *(x.field for way in ways for x in way)}
    sent = {k: rows.sparkSession.sparkContext.broadcast(fields[k]) for k in used}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_hand = {k: v.value for k, v in sent.items()}
        for b in batches:
            for i in range(b.num_rows):
                row = {k: c[i].as_py() if k == "lang" else c[i].as_buffer() for k, c in zip(b.schema.names, b.columns, strict=True)}
                yield from _counts(row["lang"], *_phrases_of(row, m, ways, at_hand))

    # a row of texts sends a phrase once, with its count there: there is little for a task to
    # add up before the shuffle, and a table of all its phrases would fill its memory
    found = rows.mapInArrow(run, "lang string, phrase string, f long").repartition("lang", "phrase")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST)


# ------------------------------------------------------------------ scores and bounds
def scored(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found(lang, phrase, m, f)`` with k, l, r, score of the lowest cut and ``bound``, that of
    all phrases that grow from it. ``unknown`` is a rest of a count that ``known(lang, phrase,
    f)`` has not; the phrase's own count stands for it, so that its score is a bound too."""
    words = F.split("phrase", " ")
    cuts = found.select(
        "lang", "phrase", "m", "f",
        F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(words, k + 1, F.col("m") - k), " ").alias("rest")))).alias("cut"),
    ).select("lang", "phrase", "m", "f", "cut.*")
    first = known.select(F.col("lang"), F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = known.select(F.col("lang"), F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"], "left")
    r = F.coalesce("r", "f")
    wide = lambda c: c.cast("decimal(20,0)")
    both = both.withColumn("score", _divided(wide(F.col("f")), wide(F.col("l")) + wide(r)))
    return both.groupBy("lang", "phrase", "m", "f").agg(
        F.min(F.struct("score", "k", "l", r.alias("r"))).alias("low"), F.max(F.when(F.col("k") == 1, F.col("l"))).alias("head"), F.max(F.when(F.col("r").isNull(), F.col("rest"))).alias("unknown")
    ).select("lang", "phrase", "m", "f", "low.*", "unknown", _divided(wide(F.col("f")), wide(F.col("head")) + wide(F.col("f"))).alias("bound"))


def _divided(a: Column, parts: Column) -> Column:
    """floor(SCALE * a / parts), of whole decimals: what is left of the product is taken away
    first, so that the division is one without remainder."""
    product = a * F.lit(SCALE).cast("decimal(7,0)")
    return ((product - product % parts) / parts).cast("long")


def places(scores: DataFrame, place: int) -> DataFrame:
    """(lang, threshold): the score in that place of each language, or 0 where it has fewer."""
    held = scores.groupBy("lang", "score").agg(F.count("*").alias("n"))  # at most SCALE / 2 + 1 rows a language
    down = held.withColumn("before", F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)))
    return down.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("before") >= place, F.col("score"))), F.lit(0)).alias("threshold"))


def surviving(scores: DataFrame, top: int = TOP, share: int = SHARE) -> DataFrame:
    """Those of ``scores`` that no extension by one word nearly always comes with."""
    longer = scores.where("m > 2").select(
        "lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)"))).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = scores.join(longer, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * share)).drop("longer")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    rows = materialize(numbered(docs), "numbers", {"compression": "zstd"})
    every = materialize(count_words(rows), "words")
    words = every.where(F.col("f") >= LEAST)
    fields = {"words": bit_field(words, 1)}
    pairs = materialize(count_phrases(rows, 2, [[]], fields).withColumn("m", F.lit(2)), "pairs")
    known = words.unionByName(pairs.drop("m"))
    two = materialize(scored(pairs, known), "scored")
    fields["pairs"] = bit_field(pairs, 2)

    three = four = extra = None
    place, open_, settled = FIRST * top, None, None
    while True:
        # thresholds of this round, and those up to which all is grown already
        asked = places(two, place).withColumnRenamed("threshold", "low")
        asked = asked.withColumn("high", F.lit(SCALE).cast("long")) if open_ is None else asked.join(open_, "lang")
        asked = materialize(asked.where("low < high"), "thresholds")
        due = lambda of, by: of.join(asked, "lang").where(F.col(by).between(F.col("low"), F.col("high") - 1)).select("lang", "phrase")

        fields |= {"grow2": bit_field(due(two, "bound"), 2), "left2": bit_field(due(two, "score"), 2)}
        ways = [[Look(0, 2, "grow2"), Look(1, 2, "pairs")], [Look(1, 2, "left2"), Look(0, 2, "pairs")]]
        three = _added(three, count_phrases(rows, 3, ways, fields), 3)
        known3 = known.unionByName(three.drop("m"))
        s3 = materialize(scored(three, known3), "scored")

        fields |= {"grow3": bit_field(due(s3, "bound"), 3), "left3": bit_field(due(s3, "score"), 3)}
        ways = [[Look(0, 3, "grow3"), Look(1, 2, "pairs"), Look(2, 2, "pairs")], [Look(1, 3, "left3"), Look(0, 2, "pairs")]]
        four = _added(four, count_phrases(rows, 4, ways, fields), 4)
        known4 = known3 if extra is None else known3.unionByName(extra.drop("m")).distinct()
        s4 = materialize(scored(four, known4), "scored")
        # rests of three words that no prefix led to
        due4 = s4.where("unknown IS NOT NULL").join(asked, "lang").where("score >= low").select("lang", F.col("unknown").alias("phrase")).distinct()
        rests = bit_field(due4, 3)
        if rests.any():
            extra = _added(extra, count_phrases(rows, 3, [[Look(0, 3, "rests")]], {"words": fields["words"], "rests": rests}), 3)
            discard(s4)
            s4 = materialize(scored(four, known3.unionByName(extra.drop("m")).distinct()), "scored")

        alive = surviving(two.unionByName(s3).unionByName(s4))
        reached = alive.join(asked, "lang").where("score >= low")
        done = reached.groupBy("lang", "low").agg(F.count("*").alias("n")).where((F.col("n") >= top) | (F.col("low") == 0)).select("lang")
        final = materialize(reached.join(done, "lang").select("lang", "phrase", "f", "l", "r", "score"), "settled")
        settled = final if settled is None else settled.unionByName(final)
        left = asked.where("low > 0").join(final.select("lang").distinct(), "lang", "left_anti")
        open_ = materialize(left.select("lang", F.col("low").alias("high")), "open")
        if open_.isEmpty():
            break
        place *= STEP

    n = every.groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    ranked = settled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def _added(before: DataFrame | None, counted: DataFrame, m: int) -> DataFrame:
    """Counts of this round with those of earlier ones; a phrase counted twice has one count."""
    fresh = counted.withColumn("m", F.lit(m))
    return materialize(fresh if before is None else before.unionByName(fresh).distinct(), "phrases")


COLLOCATIONS_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), listed AS (
  SELECT lang, [x FOR x IN string_split_regex(piece, '[ \t]+') IF x <> ''] AS w FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed), (SELECT unnest(range(1, {LONGEST} + 1)) AS m) WHERE i + m - 1 <= len(w)
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), many AS (
  SELECT * FROM f WHERE f >= {LEAST}
), cuts AS (
  SELECT lang, m, phrase, f, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 : m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM many WHERE m > 1)
), rated AS (
  SELECT c.lang, c.m, c.phrase, c.f AS a, c.k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.f) // (x.f::HUGEINT + y.f) AS score
  FROM cuts c JOIN many x ON x.lang = c.lang AND x.phrase = c.head JOIN many y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
  SELECT DISTINCT q.lang, array_to_string(string_split(q.phrase, ' ')[i : i + s - 1], ' ') AS phrase, q.f
  FROM many q, (SELECT unnest(range(1, {LONGEST} + 1)) AS i), (SELECT unnest(range(2, {LONGEST})) AS s) WHERE s < q.m AND i + s - 1 <= q.m
), kept AS (
  SELECT p.* FROM lowest p WHERE NOT EXISTS (SELECT 1 FROM parts q WHERE q.lang = p.lang AND q.phrase = p.phrase AND q.f::HUGEINT * 100 >= p.a::HUGEINT * {SHARE})
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(k.phrase)) AS rank, k.phrase, a, l, r, t.n::BIGINT AS n, score::BIGINT AS score
FROM kept k JOIN (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang) t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(k.phrase)) <= {TOP}"""
