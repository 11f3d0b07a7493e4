"""A label model: what overlapping voters say, turned into posterior labels.

Each voter fires (1) or not (0). Given the true class, voter j fires with a rate of its
own; expectation-maximisation finds the rates and the share of the positive class from
counts of vote patterns alone. At most 2^voters patterns exist, so the counts of the
whole corpus are a small table whatever its size.

Voters that agree beyond what the class explains are not independent evidence. Their
correlation given the class is measured from the same counts, and the log odds of each
voter are divided by 1 + the sum of its positive correlations with the others.

:func:`fit_tree_model` has the correlations in the model itself: given the class, voters
depend on each other along a tree, whose rates EM estimates together with the classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MAX_VOTERS = 14


@dataclass(frozen=True)
class LabelModel:
    prior: float
    rates: np.ndarray  # (2, voters): how often each fires in class 0 and 1
    correlation: np.ndarray  # (voters, voters), given the class
    share: np.ndarray  # how much of its log odds each voter keeps

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) for rows of votes (n, voters)."""
        lo, hi = self.rates
        fired = np.log(hi / lo) * self.share
        quiet = np.log((1 - hi) / (1 - lo)) * self.share
        z = np.log(self.prior / (1 - self.prior)) + votes @ fired + (1 - votes) @ quiet
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def accuracies(self) -> np.ndarray:
        """How often each voter is right."""
        return self.prior * self.rates[1] + (1 - self.prior) * (1 - self.rates[0])


def patterns(voters: int) -> np.ndarray:
    """All vote patterns; row p has bit j of p in column j."""
    return (np.arange(1 << voters)[:, None] >> np.arange(voters) & 1).astype(np.float64)


def started(votes: np.ndarray, prior: float = 0.15) -> tuple[np.ndarray, LabelModel]:
    """P(class 1) of each pattern and the model that EM starts from."""
    any_vote, voters = votes.sum(axis=1), votes.shape[1]
    rates = np.array([np.full(voters, 0.02), np.full(voters, 0.3)])
    return np.where(any_vote > 0, 1 - 0.4**any_vote, 0.02), LabelModel(prior, rates, np.eye(voters), np.ones(voters))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, start_prior: float = 0.15, steps: int = 300, correlated: bool = True) -> LabelModel:
    """EM over patterns ``votes`` seen ``counts`` times. ``known``: counts (n, 2) of rows of
    each pattern whose class is given; they enter with that class.

    It starts from "a pattern with any vote is likely class 1". Rates are smoothed by half
    a row each way and class 1 fires at least as often as class 0, so the classes can't
    swap. No rows give the start.
    """
    n, voters = votes.shape
    if voters > MAX_VOTERS:
        raise ValueError(f"{voters} voters; at most {MAX_VOTERS}")
    known = np.zeros((n, 2)) if known is None else known
    counts = counts.astype(np.float64)
    p, model = started(votes, start_prior)
    if counts.sum() + known.sum() == 0:
        return model
    for _ in range(steps):
        up, down = counts * p + known[:, 1], counts * (1 - p) + known[:, 0]
        hi = (up @ votes + 0.5) / (up.sum() + 1)
        lo = (down @ votes + 0.5) / (down.sum() + 1)
        lo = np.minimum(lo, hi)
        prior = np.clip((up.sum() + 0.5) / (up.sum() + down.sum() + 1), 1e-4, 1 - 1e-4)
        model = LabelModel(float(prior), np.clip(np.array([lo, hi]), 1e-6, 1 - 1e-6), np.eye(voters), np.ones(voters))
        new = model.posterior(votes)
        if np.abs(new - p).max() < 1e-10:
            break
        p = new
    if not correlated:
        return model
    up, down = counts * p + known[:, 1], counts * (1 - p) + known[:, 0]
    cov, var = np.zeros((voters, voters)), np.zeros(voters)
    for weight, rate in ((up, model.rates[1]), (down, model.rates[0])):
        off = votes - rate
        cov += (off * weight[:, None]).T @ off
        var += weight @ (off * off)
    corr = cov / np.sqrt(np.maximum(np.outer(var, var), 1e-12))
    np.fill_diagonal(corr, 1.0)
    extra = np.maximum(corr, 0).sum(axis=1) - 1
    return LabelModel(model.prior, model.rates, corr, 1 / (1 + np.maximum(0, extra - 0.05 * (voters - 1))))


@dataclass(frozen=True)
class TreeModel:
    """Voters that depend, given the class, on one other voter each (``parent``; -1: none)."""

    prior: float
    parent: tuple[int, ...]
    table: np.ndarray  # (2, voters, 2): how often each fires in class 0 and 1, by its parent's vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) for rows of votes (n, voters)."""
        j = np.arange(len(self.parent))
        lo, hi = self.table[0][j, above(votes, self.parent)], self.table[1][j, above(votes, self.parent)]
        z = np.log(self.prior / (1 - self.prior)) + (votes * np.log(hi / lo) + (1 - votes) * np.log((1 - hi) / (1 - lo))).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def above(votes: np.ndarray, parent: tuple[int, ...]) -> np.ndarray:
    """The vote of each voter's parent, 0 where it has none."""
    at = np.array(parent)
    return np.where(at >= 0, votes[:, at], 0).astype(np.int64)


def dependence_tree(votes: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> tuple[int, ...]:
    """Parents in the spanning forest of largest mutual information given the class.

    ``weights``: how many rows of each pattern are of class 0 and of class 1. A pair is
    linked only if that gains more than the two rates it costs (half a logarithm of the
    rows each).
    """
    voters = votes.shape[1]
    gain = np.zeros((voters, voters))
    for w in weights:
        total = w.sum()
        if total <= 0:
            continue
        sides = (1 - votes, votes)
        for a in sides:
            for b in sides:
                both = (a * w[:, None]).T @ b
                apart = np.outer(w @ a, w @ b) / total
                some = (both > 0) & (apart > 0)
                gain[some] += both[some] * np.log(both[some] / apart[some])
    gain -= np.log(max(2.0, sum(w.sum() for w in weights)))
    parent, inside = [-1] * voters, [0]
    while len(inside) < voters:
        rest = [j for j in range(voters) if j not in inside]
        best, i, j = max(((gain[i, j], -i, -j) for i in inside for j in rest), default=(0, 0, 0))
        parent[-j] = -i if best > 0 else -1
        inside.append(-j)
    return tuple(parent)


def fit_tree_model(votes: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, steps: int = 300, rounds: int = 5) -> TreeModel:
    """EM as in :func:`fit_label_model`, from the same start: classes of a model of
    independent voters would be those of the largest set of copies.

    The tree is drawn anew from the classes found, until it stays or ``rounds`` are over.
    Given its parent's vote, a voter fires in class 1 at least as often as in class 0, so no
    vote speaks against class 1. Rates are smoothed by one row of the voter's own rate.
    """
    known = np.zeros((len(votes), 2)) if known is None else known
    counts = counts.astype(np.float64)
    p, start = started(votes)
    parent = (-1,) * votes.shape[1]
    model = TreeModel(start.prior, parent, np.repeat(start.rates[:, :, None], 2, axis=2))
    if counts.sum() + known.sum() == 0:
        return model
    for turn in range(rounds):
        tree = dependence_tree(votes, (counts * (1 - p) + known[:, 0], counts * p + known[:, 1]))
        if turn and tree == parent:
            break
        parent, up = tree, above(votes, tree)
        for _ in range(steps):
            parts = (counts * (1 - p) + known[:, 0], counts * p + known[:, 1])
            table = np.empty((2, votes.shape[1], 2))
            for c, w in enumerate(parts):
                own = (w @ votes + 0.5) / (w.sum() + 1)
                for u in (0, 1):
                    of = (up == u) * w[:, None]
                    table[c, :, u] = ((of * votes).sum(axis=0) + own) / (of.sum(axis=0) + 1)
            table[0] = np.minimum(table[0], table[1])
            prior = np.clip((parts[1].sum() + 0.5) / (parts[0].sum() + parts[1].sum() + 1), 1e-4, 1 - 1e-4)
            model = TreeModel(float(prior), tree, np.clip(table, 1e-6, 1 - 1e-6))
            new = model.posterior(votes)
            moved, p = np.abs(new - p).max(), new
            if moved < 1e-10:
                break
    return model
