"""Toxicity by weak supervision: many voters, a label model, a linear classifier.

1. Voters: word lists (insults, contempt, threats, obscenities, other languages), patterns
   (insult after "you", digits for letters, two insults close together, one insult twice)
   and two lists learnt from labelled training rows: words, and word beginnings used twice
   or three times in a text. Lists overlap on purpose.
2. The label model (:func:`weaklabel.fit_tree_model`) estimates the voters' accuracies and,
   along a tree, their correlations from vote patterns over all documents; labelled
   training rows enter with their class.
3. A sparse (L1) logistic regression on hashed words and repeated word beginnings learns
   the label model's posteriors of at most ``sample`` documents, chosen by hash of doc_id,
   likely and unlikely ones alike. Labels are no target of it.
4. Every whole text is scored by that classifier alone.

Rows with crc32(doc_id) mod 4 = 2 are held out: no label of theirs is used. Labels,
language, source and doc_id are no inputs of a score.

Odd input: null text is empty and gets the score of the bias; a null doc_id keeps its row
and is in the training part (its label can't be found); repeated rows each get theirs; an
empty table gives no rows; no labels leave the fixed voters; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finish, materialize, mix, span_hashes
from .linear import Piece, fit_logistic, pieces, sigmoid
from .weaklabel import TreeModel, fit_tree_model, patterns

THRESHOLD = 0.3
BITS = 20
SAMPLE = 4000
L1 = 1.5e-3
FOLDS, HELD_OUT = 4, 2
#: Labelled rows from which the lists are learnt, at most.
LABELLED = 20_000
#: Longest learnt list, in how many toxic training rows a feature of it must be, and what
#: part of its rows must be toxic.
LEARNT, LEARNT_ROWS, LEARNT_PRECISION = 256, 3, 0.8
#: Word beginnings, in bytes, and how often one must occur in a text to count.
PREFIXES, TIMES = (4, 5, 6, 7, 8), (2, 3)

# Word lists of the voters (fixed values).
LISTS: dict[str, tuple[str, ...]] = {
    "insults": ("idiot", "idiots", "moron", "morons", "imbecile", "fool", "fools", "dimwit", "dumbass", "clown", "clowns", "loser", "losers", "jerk", "creep", "freak"),
    "contempt": ("stupid", "dumb", "pathetic", "worthless", "disgusting", "useless", "ugly", "filthy", "vile", "trash", "garbage", "scum", "vermin"),
    "people": ("idiot", "moron", "clown", "loser", "scum", "trash", "pig", "pigs", "rat", "parasite", "bastard", "bitch", "whore"),
    "judgement": ("stupid", "pathetic", "worthless", "disgusting", "idiotic", "moronic", "retarded", "hateful", "despicable"),
    "threats": ("kill", "die", "murder", "hang", "shoot", "rape", "destroy"),
    "obscene": ("fuck", "fucking", "shit", "shitty", "asshole", "bullshit", "damn", "crap", "bitch"),
    "german": ("idiot", "dumm", "dummkopf", "arschloch", "scheiße", "trottel", "abschaum", "wertlos", "erbärmlich"),
    "romance": ("idiota", "imbécil", "estúpido", "basura", "mierda", "idiote", "stupide", "imbécile", "ordure", "merde", "connard"),
}
SPELT = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting")
LEET = {"i": "1", "o": "0", "e": "3", "a": "4", "s": "5"}
VOTERS = (*LISTS, "addressed", "spelt", "close", "twice", "learnt_a", "learnt_b")

_word = np.ones(256, bool)
_word[:128] = [chr(i).isalnum() for i in range(128)]


def _hash(words: list[str]) -> np.ndarray:
    """Hashes as :class:`Piece` makes them, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.concatenate([Piece([w.encode()], True, _word).words for w in words]))


def features(piece: Piece, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, base) triples, each once: a word, or a word beginning that occurs
    TIMES. ``wanted``: look at these sorted bases only."""
    out = []
    size = piece.ends - piece.starts
    for k in (0, *PREFIXES):
        at = np.flatnonzero(size > k) if k else np.arange(len(size))
        base = mix(span_hashes(piece.buf, piece.starts[at], piece.starts[at] + k), np.uint64(k)) if k else piece.words
        doc = piece.doc[at]
        if wanted is not None:
            hit = _is_in(base, wanted)
            base, doc = base[hit], doc[hit]
        order = np.lexsort((base, doc))
        base, doc = base[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (base[1:] != base[:-1]) | (doc[1:] != doc[:-1])])) if len(base) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(base)))
        for t in TIMES if k else (1,):
            at = new[count >= t]
            out.append((doc[at], finish(mix(base[at], np.uint64(t))), base[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


@dataclass(frozen=True)
class Voters:
    lists: tuple[np.ndarray, ...]
    insulting: np.ndarray
    you: np.ndarray
    spelt: np.ndarray
    learnt: tuple[np.ndarray, np.ndarray]  # features
    bases: np.ndarray

    @classmethod
    def build(cls, learnt: list[tuple[int, int]]) -> Voters:
        """``learnt``: (feature, base) pairs as signed longs. Each of two lists has two
        thirds of them."""
        pairs = np.array(learnt, np.int64).reshape(-1, 2).view(np.uint64)
        halves = tuple(np.unique(pairs[np.arange(len(pairs)) % 3 != k, 0]) for k in (0, 1))
        spelt = [w.translate(str.maketrans(LEET)) for w in SPELT]
        bad = [w for k in ("insults", "contempt") for w in LISTS[k]]
        return cls(tuple(_hash(list(w)) for w in LISTS.values()), _hash(bad), _hash(["you", "your", "youre", "du", "tu"]), _hash(spelt), halves, np.unique(pairs[:, 1]))

    def votes(self, piece: Piece) -> np.ndarray:
        """(texts, voters) of 0 and 1."""
        any_ = lambda flags: piece.per_text(flags, piece.first) > 0
        found = [any_(_is_in(piece.words, h)) for h in self.lists]
        bad, you = _is_in(piece.words, self.insulting), _is_in(piece.words, self.you)
        near = np.zeros(len(bad), bool)
        for step in (1, 2, 3):
            near[step:] |= bad[step:] & you[:-step] & (piece.doc[step:] == piece.doc[:-step])
        at = np.flatnonzero(bad)
        close, twice = np.zeros(piece.n, bool), np.zeros(piece.n, bool)
        words, doc = piece.words[at], piece.doc[at]
        close[doc[1:][(doc[1:] == doc[:-1]) & (np.diff(at) <= 3)]] = True
        order = np.lexsort((words, doc))
        words, doc = words[order], doc[order]
        twice[doc[1:][(doc[1:] == doc[:-1]) & (words[1:] == words[:-1])]] = True
        doc, feat, _ = features(piece, self.bases)
        own = [np.bincount(doc[_is_in(feat, h)], minlength=piece.n) > 0 for h in self.learnt]
        return np.stack([*found, any_(near), any_(_is_in(piece.words, self.spelt)), close, twice, *own], axis=1)


def fold(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def training_labels(labels: DataFrame) -> DataFrame:
    """(__id, toxic) of the labelled rows that are not held out, each id once."""
    some = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return some.where(fold(F.col("__id")) != HELD_OUT)


def learn_features(docs: DataFrame, labels: DataFrame) -> list[tuple[int, int]]:
    """(feature, base) of toxic training rows that clean ones lack: at most LEARNT pairs,
    most frequent first. Counted over at most LABELLED labelled training rows, those with
    the smallest hash of doc_id, which go to every task; the driver gets the list."""
    taught = materialize(training_labels(labels).orderBy(F.xxhash64("__id"), "__id").limit(LABELLED), "labels")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(taught), F.col("doc_id") == F.col("__id")).select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in pieces(batches):
            doc, feat, base = features(Piece(texts, True, _word))
            h, first, back = np.unique(feat, return_index=True, return_inverse=True)
            bad = np.bincount(back, np.array(keys)[doc] == 1, len(h)).astype(np.int64)
            every = np.bincount(back, minlength=len(h)).astype(np.int64)
            some = bad > 0  # the clean rows of other features are of no use
            yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(base[first][some].view(np.int64)), pa.array(bad[some]), pa.array(every[some])], ["feat", "base", "bad", "every"])

    counts = text.mapInArrow(run, "feat long, base long, bad long, every long").groupBy("feat", "base").agg(F.sum("bad").alias("bad"), F.sum("every").alias("every"))
    # as if two clean rows more had it, so that chance in a few rows isn't taken for a mark
    sure = F.col("bad") >= LEARNT_PRECISION * (F.col("every") + 2)
    rows = counts.where((F.col("bad") >= LEARNT_ROWS) & sure).orderBy(F.desc("bad"), "feat").limit(LEARNT).collect()
    return [(r.feat, r.base) for r in rows]


@dataclass(frozen=True)
class ToxicityModel:
    label_model: TreeModel
    cols: np.ndarray  # hashed features with a weight, sorted
    weights: np.ndarray
    bases: np.ndarray  # of those features
    bias: float

    def scores(self, piece: Piece) -> np.ndarray:
        """P(toxic): the sum of the weights of each text's features."""
        doc, feat, _ = features(piece, self.bases)
        col = (feat & np.uint64((1 << BITS) - 1)).astype(np.int64)
        hit = np.flatnonzero(_is_in(col, self.cols))
        total = np.zeros(piece.n)
        if len(hit):
            total = np.bincount(doc[hit], self.weights[np.searchsorted(self.cols, col[hit])], minlength=piece.n)
        return sigmoid(total + self.bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    spark = docs.sparkSession
    voters = spark.sparkContext.broadcast(Voters.build(learn_features(docs, labels)))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            bits = voters.value.votes(Piece(texts, True, _word)) @ (1 << np.arange(len(VOTERS)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bits.astype(np.int64))], ["doc_id", "pattern"])

    raw = keyed.mapInArrow(vote, "doc_id long, pattern long")
    votes = materialize(raw.join(training_labels(labels), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "pattern", "toxic"), "votes")
    counts, known = np.zeros(1 << len(VOTERS)), np.zeros((1 << len(VOTERS), 2))
    for r in votes.groupBy("pattern", "toxic").count().collect():  # at most 3 * 2^voters rows
        if r.toxic in (0, 1):
            known[r.pattern, r.toxic] += r["count"]
        else:
            counts[r.pattern] += r["count"]
    seen = np.flatnonzero(counts + known.sum(axis=1))
    every = patterns(len(VOTERS))
    model = fit_tree_model(every[seen], counts[seen], known[seen])
    believed = model.posterior(every)
    likely = F.col("pattern").isin([int(x) for x in np.intersect1d(np.flatnonzero(believed >= 0.5), seen)])

    def pick(cond: F.Column, most: int) -> DataFrame:
        found = votes.where(cond & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("pattern").alias("pattern"))
        return found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("__pick"), "pattern")

    picked = materialize(pick(likely, sample // 2).unionByName(pick(~likely, sample // 2)).dropDuplicates(["__pick"]), "picked")
    texts = keyed.join(F.broadcast(picked), F.col("doc_id") == F.col("__pick"))  # at most ``sample`` rows of two numbers
    texts = texts.select("pattern", "text")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, raw in pieces(batches):
            doc, feat, base = features(Piece(raw, True, _word))
            order = np.lexsort((feat, doc))
            cut = np.searchsorted(doc[order], np.arange(len(raw) + 1))
            part = lambda x: pa.array([x[order][a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), part(feat), part(base)], ["pattern", "feats", "bases"])

    got = texts.mapInArrow(listed, "pattern long, feats binary, bases binary").toPandas().sort_values(["pattern", "feats"], kind="stable")
    if not len(got):
        return ToxicityModel(model, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64), -3.0)
    feats = [np.frombuffer(x, np.uint64) for x in got["feats"]]
    bases = [np.frombuffer(x, np.uint64) for x in got["bases"]]
    y = believed[got["pattern"].to_numpy()]
    # features in fewer than three rows can't be told from chance
    cols = [(f & np.uint64((1 << BITS) - 1)).astype(np.int64) for f in feats]
    often = np.bincount(np.concatenate(cols), minlength=1 << BITS) >= 3
    rows = [(k := c[often[c]], np.ones(len(k))) for c in cols]
    w, b = fit_logistic(rows, y, 1 << BITS, l1=L1, steps=300)
    used = np.concatenate([x[w[c] != 0] for x, c in zip(bases, cols, strict=True)])
    nonzero = np.flatnonzero(w)
    return ToxicityModel(model, nonzero, w[nonzero], np.unique(used), b)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            p = shared.value.scores(Piece(texts, True, _word))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample))
