"""Whitening against numpy on whole numbers of any size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerloom.llm import whitening

COLUMNS = "vec_id long, embedding array<float>, n long, x long"


def brute(vectors):
    """n, deviation by row, |whitened| by (row, component), explained by component."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    deviation = ((x * n - s) ** 2).sum(axis=1)
    centred = (fit * n - s).astype(float) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    return n, deviation, (x * n - s).astype(float) / n @ u / np.sqrt(e), e / np.trace(v)


def check(spark, rows, got):
    keep = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    n, deviation, white, explained = brute([r[1] for r in keep])
    assert len(got) == 4 * len(keep)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
        assert r.n == n and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    sign = [None] * 4
    for i, row in enumerate(keep):
        mine = [r for r in by[row[0]] if r.deviation == deviation[i]]
        for k in range(4):
            w = next(r.whitened for r in mine if r.component == k + 1)
            if abs(white[i, k]) > 1e-3:
                s = np.sign(w * white[i, k])
                assert sign[k] in (None, s)
                sign[k] = s
            assert abs(abs(w) - abs(white[i, k])) < 1e-8 * max(1, abs(w))


def test_random_rows_with_odd_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in (rng.normal(size=12) * np.linspace(3, 0.1, 12)).astype("f4")], i, i) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 0, 0) for i in range(400)]  # copies count once in the fit
    rows += [(2000, None, 0, 0), (2001, [None] * 12, 0, 0), (2002, [math.nan] * 12, 0, 0), (2003, [math.inf] + [0.0] * 11, 0, 0)]
    check(spark, rows, whitening.whiten(spark.createDataFrame(rows, COLUMNS).repartition(5)).collect())


def test_large_entries_take_wide_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in (rng.normal(size=6) * 10_000).astype("f4")], 0, 0) for i in range(200)]
    check(spark, rows, whitening.whiten(spark.createDataFrame(rows, COLUMNS)).collect())


def test_sf(spark):
    table = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pylist()
    got = whitening.whiten(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).collect()
    check(spark, [(r["vec_id"], r["embedding"]) for r in table], got)


def test_small_blocks_are_summed_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", (64, 64))
    monkeypatch.setattr(whitening, "BLOCKS_EACH", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=5).astype("f4")], 0, 0) for i in range(333)]
    check(spark, rows, whitening.whiten(spark.createDataFrame(rows, COLUMNS)).collect())


def test_little_or_no_variance(spark):
    make = lambda vs: spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "vec_id long, embedding array<float>")
    assert whitening.whiten(make([[1.0, 2.0]] * 3)).collect() == []
    assert whitening.whiten(make([[1.0]]).limit(0)).collect() == []
    assert whitening.whiten(make([[], None])).collect() == []
    two = whitening.whiten(make([[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.deviation, r.n) for r in two) == [(i, 1, 1.0, 256 * 256, 2) for i in range(3)]
    short = whitening.whiten(make([[1.0], [0.0, 3.0], []])).collect()
    assert {r.vec_id for r in short} == {0, 1, 2} and {r.component for r in short} == {1, 2}
    with pytest.raises(ValueError):
        whitening.whiten(make([[0.0] * 5000]))
