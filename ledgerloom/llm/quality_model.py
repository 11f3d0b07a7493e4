"""Quality classifier from weak labels: no label is read.

Overlapping heuristic labellers vote "junk" on each text; expectation-maximisation
(:mod:`weaklabel`) estimates how often each is right from vote patterns over all
documents; the posterior labels of at most ``sample`` documents train a hashed linear
scorer, which scores every whole text.

Odd input: null text is the empty text; texts of fewer than ``MIN_WORDS`` words give
labellers little to see and are scored like others; a null doc_id keeps its row but isn't
sampled; repeated rows each get theirs; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .linear import Piece, fit_logistic, pieces, rate_scores, sigmoid, sparse_rates
from .quality_rules import base_counts
from .weaklabel import LabelModel, fit_label_model, patterns

BITS = 16
SAMPLE = 2000
#: P(good) from which a text is kept.
KEEP_AT = 0.5
LABELLERS = ("symbols", "symbol_words", "bangs", "pipes", "capitals", "repeated_words", "repeated_lines", "twin_words", "few_kinds", "long_words")

_upper = np.zeros(256, bool)
_upper[65:91] = True
_lower = np.zeros(256, bool)
_lower[97:123] = True


def labeller_votes(piece: Piece, texts: list[bytes]) -> np.ndarray:
    """(texts, labellers): True where a labeller says junk."""
    base = base_counts(piece, texts)
    n = np.maximum(1, base["n_words"])
    chars = np.maximum(1, base["word_chars"])
    count = lambda byte: piece.per_text(piece.buf == byte)
    upper, lower = piece.per_text(_upper[piece.buf]), piece.per_text(_lower[piece.buf])
    size = piece.ends - piece.starts
    last = piece.buf[np.maximum(piece.ends - 1, 0)] if len(size) else np.zeros(0, np.uint8)
    marked = np.isin(last, np.frombuffer(b"#*$%&|<>", np.uint8)) & (size > 1)
    twin = np.zeros(len(size), bool)
    if len(size) > 1:
        twin[1:] = (piece.words[1:] == piece.words[:-1]) & (piece.doc[1:] == piece.doc[:-1])
    _, kinds_at = np.unique(np.stack([piece.doc.astype(np.uint64), piece.words]), axis=1, return_index=True)
    kinds = np.bincount(piece.doc[kinds_at], minlength=piece.n)
    lines = np.array([t.count(b"\n") + 1 for t in texts])
    return np.stack([
        base["n_symbols"] > 0.05 * chars,
        piece.per_text(marked, piece.first) > 0.2 * n,
        count(ord("!")) > 0.3 * n,
        count(ord("|")) > 0.1 * n,
        upper > 0.4 * np.maximum(1, upper + lower),
        (base["n_repeat_words"] > 0.2 * n) & (n >= 10),
        (base["n_dup_lines"] > 0.3 * lines) & (base["n_dup_lines"] > 1),
        piece.per_text(twin, piece.first) > 0.1 * n,
        (kinds < 0.25 * np.minimum(n, 200)) & (n >= 20),
        (size.size > 0) & (piece.per_text(size > 30, piece.first) > 0.1 * n),
    ], axis=1)


@dataclass(frozen=True)
class WeakQuality:
    label_model: LabelModel
    weights: np.ndarray
    bias: float

    def good(self, piece: Piece) -> np.ndarray:
        return sigmoid(rate_scores(piece, self.weights, BITS) + self.bias)


def vote_table(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern): bit j of pattern is labeller j's vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            votes = labeller_votes(Piece(texts), texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array((votes @ (1 << np.arange(len(LABELLERS)))).astype(np.int64))], ["doc_id", "pattern"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, pattern long")


def train(docs: DataFrame, votes: DataFrame, sample: int = SAMPLE) -> WeakQuality:
    table = votes.groupBy("pattern").count().collect()  # at most 2^labellers rows
    every = patterns(len(LABELLERS))
    seen = np.array([r.pattern for r in table], np.int64)
    model = fit_label_model(every[seen], np.array([r["count"] for r in table]))
    junk = model.posterior(every)
    likely = F.col("pattern").isin([int(x) for x in seen[junk[seen] >= 0.5]])

    def pick(cond: F.Column, most: int) -> DataFrame:
        found = votes.where(cond & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("pattern").alias("pattern"))
        return found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("__pick"), "pattern")

    picked = materialize(pick(likely, sample // 2).unionByName(pick(~likely, sample // 2)), "picked")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("__pick"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, raw in pieces(batches):
            rows = sparse_rates(Piece(raw), BITS)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([c.astype("<i4").tobytes() for c, _ in rows]), pa.array([v.astype("<f4").tobytes() for _, v in rows])], ["pattern", "cols", "vals"])

    got = texts.select("pattern", "text").mapInArrow(run, "pattern long, cols binary, vals binary").toPandas().sort_values(["pattern", "cols"], kind="stable")
    rows = [(np.frombuffer(c, "<i4"), np.frombuffer(v, "<f4")) for c, v in zip(got["cols"], got["vals"], strict=True)]
    y = 1 - junk[got["pattern"].to_numpy(np.int64)]
    if len(rows) == 0 or y.min() > 0.5:
        return WeakQuality(model, np.zeros(1 << BITS), 4.0)
    # the sample is half junk; the bias goes back to the corpus' own share
    w, b = fit_logistic(rows, y, 1 << BITS, l2=1e-3)
    share = float(np.mean(y))
    return WeakQuality(model, w, b - np.log(share / (1 - share)) + np.log((1 - model.prior) / model.prior))


def assess(docs: DataFrame, sample: int = SAMPLE, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, pattern, posterior_good, score, kept): one row per document. ``score`` is the
    linear scorer's P(good), which alone decides ``kept``."""
    votes = materialize(vote_table(docs), "votes")
    model = train(docs, votes, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    good = 1 - model.label_model.posterior(patterns(len(LABELLERS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            piece = Piece(texts)
            pattern = labeller_votes(piece, texts) @ (1 << np.arange(len(LABELLERS)))
            p = shared.value.good(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pattern.astype(np.int64)), pa.array(good[pattern]), pa.array(p), pa.array(p >= keep_at)], ["doc_id", "pattern", "posterior_good", "score", "kept"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return slim.mapInArrow(run, "doc_id long, pattern long, posterior_good double, score double, kept boolean")
