"""Hashed features of whole texts and a sparse logistic regression in numpy.

Scoring runs inside Arrow batches; a batch is cut into pieces of about a megabyte of
text, so that memory doesn't follow the number of rows in a batch. Training runs on a
bounded sample whose size is a parameter of the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import ascii_lower, finish, gram_hashes, joined_bytes, mix, span_hashes, word_spans

PIECE = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as bytes) of columns 0 and 1, null texts as empty ones."""
    for b in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(b.column(0), b.column(1), strict=True):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            ids.append(i.as_py())
            texts.append(raw)
            size += len(raw)
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


class Piece:
    """Words of several texts at once. ``word_bytes``: a table of the 256 bytes that make
    words, or None for all but the six ASCII spaces."""

    def __init__(self, texts: list[bytes], lower: bool = False, word_bytes: np.ndarray | None = None) -> None:
        self.n = len(texts)
        self.buf, self.at = joined_bytes(texts)
        if lower:
            self.buf = ascii_lower(self.buf)
        if word_bytes is None:
            self.starts, self.ends = word_spans(self.buf)
        else:
            inside = word_bytes[self.buf]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
            self.starts, self.ends = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.at)  # of each text's words, and the end
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))
        self.words = span_hashes(self.buf, self.starts, self.ends)

    def per_text(self, flags: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Sums of ``flags`` (by byte, or by word with ``at=self.first``) for each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)])
        return np.diff(total[np.minimum(self.at if at is None else at, len(flags))])

    def word_grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows that lie in one text, and the index of their first words."""
        n = len(self.words)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.words[: n - k + 1]
        for i in range(1, k):
            h = mix(h, self.words[i : n - k + 1 + i])
        fit = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return finish(h[fit]), fit


def blocks(piece: Piece, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) pairs of each block: words, word pairs, runs of 3 and of 5 bytes."""
    size, out = np.uint64((1 << bits) - 1), []
    for tag, (h, doc) in enumerate([(piece.words, piece.doc), (g := piece.word_grams(2))[0:1] + (piece.doc[g[1]],)]):
        out.append((doc, (mix(h, np.uint64(tag)) & size).astype(np.int64)))
    where = np.repeat(np.arange(piece.n), np.diff(piece.at))
    for k, h in gram_hashes(piece.buf, (3, 5)).items():
        same = where[: len(h)] == where[k - 1 : k - 1 + len(h)]
        out.append((where[: len(h)][same], (mix(h[same], np.uint64(10 + k)) & size).astype(np.int64)))
    return out


SCALE = 20.0


def sparse_rates(piece: Piece, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its features and their values: shares of each block, times SCALE."""
    n, parts = piece.n, []
    for doc, col in blocks(piece, bits):
        count = np.maximum(1, np.bincount(doc, minlength=n))
        key, times = np.unique(doc * (1 << bits) + col, return_counts=True)
        owner = key >> bits
        parts.append((owner, key & ((1 << bits) - 1), SCALE * times / count[owner]))
    owner, col, val = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(owner, kind="stable")
    col, val = col[order], val[order]
    cut = np.searchsorted(owner[order], np.arange(n + 1))
    return [(col[a:b], val[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def rate_scores(piece: Piece, weights: np.ndarray, bits: int) -> np.ndarray:
    """The product of ``weights`` and each text's shares, without listing them."""
    total = np.zeros(piece.n)
    for doc, col in blocks(piece, bits):
        count = np.maximum(1, np.bincount(doc, minlength=piece.n))
        total += SCALE * np.bincount(doc, weights[col], minlength=piece.n) / count
    return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, l2: float = 0.0, l1: float = 0.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient on the mean log loss; ``y`` may be
    probabilities. Deterministic."""
    n, blocks = max(1, len(rows)), _row_blocks(rows)
    there = np.zeros(size, bool)
    for _, _, col, _ in blocks:
        there[col] = True
    used = np.flatnonzero(there)
    place = np.cumsum(there, dtype=np.int32) - 1
    blocks = [(first, row, place[col], val) for first, row, col, val in blocks]

    def scores(w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for first, row, col, val in blocks:
            got = np.bincount(row, val * w[col])
            out[first : first + len(got)] = got
        return out

    def sums(off: np.ndarray) -> np.ndarray:
        out = np.zeros(len(used))
        for first, row, col, val in blocks:
            out += np.bincount(col, val * off[first + row], minlength=len(used))
        return out

    w, b = np.zeros(len(used)), 0.0
    if 0 < (m := float(np.mean(y)) if len(rows) else 0.5) < 1:
        b = np.log(m / (1 - m))
    vw, vb, t = w.copy(), b, 1.0
    # the curvature is at most a quarter of the largest eigenvalue of X'X/n, by power steps
    probe, top = np.ones(len(used)), 1.0
    for _ in range(15):
        probe = sums(scores(probe)) / n
        top = float(np.linalg.norm(probe)) or 1.0
        probe /= top
    rate = 1 / (0.25 * (top + 1) * 1.1 + l2)
    for _ in range(steps):
        off = (sigmoid(scores(vw) + vb) - y) / n
        nw = vw - rate * (sums(off) + l2 * vw)
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - rate * l1)
        nb = vb - rate * off.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    full = np.zeros(size)
    full[used] = w
    return full, float(b)


def _row_blocks(rows: list[tuple[np.ndarray, np.ndarray]], limit: int = 1 << 18) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows from it on, features, values) of blocks of about ``limit`` entries,
    so that no step needs more than a block beside the sample."""
    out, held, size, first = [], [], 0, 0
    for i, (c, _) in enumerate(rows):
        held.append(i)
        size += len(c)
        if size >= limit or i == len(rows) - 1:
            row = np.repeat(np.arange(len(held), dtype=np.int32), [len(rows[k][0]) for k in held])
            out.append((first, row, np.concatenate([rows[k][0] for k in held]).astype(np.int32), np.concatenate([rows[k][1] for k in held]).astype(np.float32)))
            held, size, first = [], 0, i + 1
    return out


def fit_platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b with P(y=1) = sigmoid(a * score + b), by Newton on smoothed labels; a >= 0."""
    if len(score) == 0 or len(np.unique(y)) < 2:
        return 1.0, 0.0
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * score + b)
        g = np.array([((p - goal) * score).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        q = p * (1 - p)
        h = np.array([[(q * score * score).sum() + 1e-3, (q * score).sum()], [(q * score).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)
