"""Quality rules: base counts of a text and a calibrated n-gram classifier.

The classifier is a logistic regression on hashed shares of words, word pairs and runs of
3 and 5 bytes. It learns from at most ``sample`` rows of ``labels(doc_id, quality)``, those
with the smallest hash of doc_id; two thirds train it, a third calibrates it (Platt). It
scores every whole text in Arrow batches against the fixed threshold ``KEEP_AT``.

Odd input: null text has no words, fails the base rules and is not kept; a null doc_id
keeps its row; repeated rows each get theirs; an empty table gives no rows; with no
labels, or labels of one kind, the base rules alone decide; labels that are null, or
whose doc_id is null, teach nothing; extra columns are ignored here and kept by
:func:`keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .linear import Piece, fit_logistic, fit_platt, pieces, rate_scores, sigmoid, sparse_rates

BITS = 16
SAMPLE = 2500
#: P(good) from which a text is kept.
KEEP_AT = 0.4
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True
_letter = np.ones(256, bool)  # bytes that begin a code point of a word
_letter[list(SPACES)] = False
_letter[0x80:0xC0] = False


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int = BITS

    def probability(self, piece: Piece) -> np.ndarray:
        return sigmoid(self.slope * (rate_scores(piece, self.weights, self.bits) + self.bias) + self.shift)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def repeat_words(piece: Piece, k: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in a k-word window found twice or more in it."""
    h, first = piece.word_grams(k)
    order = np.lexsort((h, piece.doc[first]))
    g, d = h[order], piece.doc[first][order]
    same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(piece.words) + 1, np.int64)
    hit = first[order[twice]]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + k, -1)
    return piece.per_text(np.cumsum(edge[:-1]) > 0, piece.first)


def base_counts(piece: Piece, texts: list[bytes]) -> dict[str, np.ndarray]:
    return {
        "n_words": np.diff(piece.first).astype(np.int64),
        "word_chars": piece.per_text(_letter[piece.buf]).astype(np.int64),
        "n_symbols": piece.per_text(_symbol[piece.buf]).astype(np.int64),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeat_words(piece).astype(np.int64),
    }


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> QualityModel:
    """Fit on at most ``sample`` labelled rows, in one task."""
    taught = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("quality").cast("double").alias("good"))
    taught = materialize(taught.orderBy(F.xxhash64("__id"), "__id").limit(sample), "labels")
    # at most ``sample`` rows of two numbers go to every task; of rows with one id, one
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(taught), F.col("doc_id") == F.col("__id"))
    picked = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([(i.as_py(), g.as_py()) for i, g in zip(b.column(0), b.column(2), strict=True)], pa.struct([("i", pa.int64()), ("g", pa.float64())]))
            for keys, texts in pieces([pa.RecordBatch.from_arrays([ids, b.column(1)], ["k", "text"])]):
                rows = sparse_rates(Piece(texts), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k["i"] for k in keys]), pa.array([k["g"] for k in keys]), pa.array([c.astype("<i4").tobytes() for c, _ in rows]), pa.array([v.astype("<f4").tobytes() for _, v in rows])],
                    ["doc_id", "good", "cols", "vals"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches, schema=pa.schema([("doc_id", pa.int64()), ("good", pa.float64()), ("cols", pa.binary()), ("vals", pa.binary())])).sort_by("doc_id")
        m = _fitted(got, bits)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), *[pa.array([x], pa.float64()) for x in (m.bias, m.slope, m.shift)]], ["weights", "bias", "slope", "shift"])

    # at most ``sample`` rows meet in one task, so that the driver sees the weights alone
    got = picked.mapInArrow(run, "doc_id long, good double, cols binary, vals binary").repartition(1).mapInArrow(fit, "weights binary, bias double, slope double, shift double").first()
    return QualityModel(np.frombuffer(got.weights, np.float64), got.bias, got.slope, got.shift, bits)


def _fitted(got: pa.Table, bits: int) -> QualityModel:
    y = got["good"].to_numpy()
    rows = [(np.frombuffer(c.as_buffer(), "<i4"), np.frombuffer(v.as_buffer(), "<f4")) for c, v in zip(got["cols"], got["vals"], strict=True)]
    if len(np.unique(y)) < 2:
        return QualityModel(np.zeros(1 << bits), 0.0, 0.0, 40.0, bits)
    third = np.arange(len(y)) % 3 == 2
    w, b = fit_logistic([r for r, t in zip(rows, third, strict=True) if not t], y[~third], 1 << bits, l2=1e-3)
    held = np.array([v @ w[c] + b for (c, v), t in zip(rows, third, strict=True) if t])
    return QualityModel(w, b, *fit_platt(held, y[third]), bits)


def assess(docs: DataFrame, model: QualityModel, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, base counts, base_failed, p_good, kept): one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            piece = Piece(texts)
            base = base_counts(piece, texts)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
            good = shared.value.probability(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), *[pa.array(base[f]) for f in fields], pa.array(failed), pa.array(good), pa.array(~failed & (good >= keep_at))],
                ["doc_id", *fields, "base_failed", "p_good", "kept"],
            )

    schema = f"doc_id long, {', '.join(f'{f} long' for f in fields)}, base_failed boolean, p_good double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return assess(docs, train(docs, labels, sample))


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that the rules reject; all columns stay.

    The verdict is found beside the row, in one pass: the row travels as one struct.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = []
            index = pa.array(range(b.num_rows))
            for _, texts in pieces([pa.RecordBatch.from_arrays([index, b.column(at).cast(pa.binary())], ["i", "text"])]):
                piece = Piece(texts)
                n = np.diff(piece.first)
                flags.append((n >= MIN_WORDS) & (100 * repeat_words(piece) <= MAX_REPEAT_PERCENT * n) & (model.value.probability(piece) >= KEEP_AT))
            yield b.filter(pa.array(np.concatenate(flags) if flags else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
