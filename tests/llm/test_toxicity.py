import zlib

import numpy as np

from ledgerloom.llm import toxicity, weaklabel

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_label_model_recovers_rates_and_sees_copies():
    rng = np.random.default_rng(1)
    n, rates = 200_000, np.array([[0.01, 0.03, 0.02, 0.05], [0.5, 0.7, 0.4, 0.6]])
    y = rng.random(n) < 0.12
    v = (rng.random((n, 4)) < rates[y.astype(int)]).astype(int)
    v = np.column_stack([v, v[:, 1]])  # the fifth voter copies the second
    code, count = np.unique(v @ (1 << np.arange(5)), return_counts=True)
    full = weaklabel.fit_label_model(weaklabel.patterns(5)[code][:, :4], count)
    assert np.abs(full.rates - rates).max() < 0.03 and abs(full.prior - 0.12) < 0.01
    m = weaklabel.fit_label_model(weaklabel.patterns(5)[code], count)
    assert m.correlation[1, 4] > 0.9 and m.share[1] < 0.6 < m.share[0]


def test_tree_model_counts_a_copied_voter_once_and_beats_the_majority():
    rng = np.random.default_rng(2)
    n, rates = 200_000, np.array([[0.02, 0.03, 0.02, 0.10], [0.6, 0.7, 0.5, 0.5]])
    y = rng.random(n) < 0.15
    v = (rng.random((n, 4)) < rates[y.astype(int)]).astype(int)
    v = np.column_stack([v, v[:, 3], v[:, 3]])  # two more voters copy the worst one
    code, back, count = np.unique(v @ (1 << np.arange(6)), return_inverse=True, return_counts=True)
    votes = weaklabel.patterns(6)[code]
    tree = weaklabel.fit_tree_model(votes, count)
    odds = np.log(0.15 / 0.85) + votes[:, :4] @ np.log(rates[1] / rates[0]) + (1 - votes[:, :4]) @ np.log((1 - rates[1]) / (1 - rates[0]))
    assert np.abs(tree.posterior(votes) - 1 / (1 + np.exp(-odds))).max() < 0.1
    wrong = lambda said: np.mean(said[back] != y)
    apart = weaklabel.fit_label_model(votes, count, correlated=False).posterior(votes)
    assert wrong(tree.posterior(votes) >= 0.5) < min(wrong(votes.sum(axis=1) >= 3), wrong(votes.sum(axis=1) >= 1), wrong(apart >= 0.5))
    assert weaklabel.fit_tree_model(votes[:0], count[:0]).parent == (-1,) * 6


def test_held_out_rows_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = [(7001, None, "en", "a", 0), (7001, None, "en", "a", 0), (7002, "", None, None, None), (None, "You pathetic idiot, you are worthless scum.", "en", "a", 1), (7003, "calm words " * 40_000, "en", "a", 1)]
    got = toxicity.toxicity(docs.unionByName(spark.createDataFrame(odd, DOCS)).withColumn("score", toxicity.F.lit("clash")), labels).collect()
    assert len(got) == docs.count() + len(odd)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    toxic, clean = [p for t, p in held if t], [p for t, p in held if not t]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean), (sum(toxic), len(toxic), sum(clean), len(clean))
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[7001].predicted == by[7002].predicted == by[7003].predicted == 0


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), none).count() == 0
    rows = [(i, "you stupid worthless idiot" if i % 5 == 0 else f"a calm text number {i % 7}", "en", "a", 1) for i in range(60)]
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(spark.createDataFrame(rows, DOCS), none).collect()}
    assert all(got[i] == int(i % 5 == 0) for i in range(60))
