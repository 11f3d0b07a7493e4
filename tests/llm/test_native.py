"""Mixing and sharding."""

import math
import zlib
from collections import defaultdict

import pytest

from ledgerloom.llm import mixing, queries, sharding

from .oracle import same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "one two", None, "b", 7), (3, "one two", None, "b", 7), (None, "x " * 9000, "en", "a", None), (4, "é ü three", "de", None, 9)]


def test_mixing_matches_its_sql(spark):
    assert same(queries.op4_mixing(spark, SF), mixing.MIX_SQL, SF) == 200


def test_mixing_odd_rows_and_empty_table(spark):
    got = mixing.mix(spark.createDataFrame(ODD, DOCS).withColumn("size", mixing.F.lit("clash"))).collect()
    assert len(got) == len(ODD)
    per = defaultdict(lambda: [0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        per[r.source_size][0] += r.taken
        per[r.source_size][1] = r.target
    assert all(t == round(want) for t, want in per.values())
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_tilts_with_prior_rates_meet_targets_under_the_cap(spark):
    rows = [("a", 10 + i % 7, 0.1 + (i % 13) * 0.3) for i in range(500)] + [("b", 5, 1.0)] * 50
    sizes = spark.createDataFrame(rows, "source string, size long, prior double")
    whole = sum(s for k, s, _ in rows if k == "a")
    targets = spark.createDataFrame([("a", whole * 2.2), ("b", 40.0)], "source string, target double")
    got = {r.source: r for r in mixing.tilts(sizes, targets).collect()}
    for k, want in (("a", whole * 2.2), ("b", 40.0)):
        assert sum(s * min(3.0, q * math.exp(got[k].lam * s)) for x, s, q in rows if x == k) == pytest.approx(want, rel=1e-9)
        assert got[k].steps > 1


def test_rates_are_the_closest_ones_in_relative_entropy(spark):
    """Moving words between any two documents of a source, target kept, never lowers the
    divergence; rates differ with the size."""
    rows = [(i, ("word " * (1 + (i * 7) % 40)).strip(), "en", "ab"[i % 3 == 0], 1) for i in range(120)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    source = {r[0]: r[3] for r in rows}
    cost = lambda r: r * math.log(r) - r + 1
    for k in "ab":
        own = [r for r in got if source[r.doc_id] == k]
        assert sum(r.rate * r.size for r in own) == pytest.approx(own[0].target, rel=1e-9)
        assert len({round(r.rate, 6) for r in own}) > 10
        for a in own[:12]:
            for b in own[12:24]:
                for eps in (1e-4, -1e-4):
                    x, y = a.rate + eps / a.size, b.rate - eps / b.size
                    if max(x, y) <= 3:
                        assert cost(x) + cost(y) >= cost(a.rate) + cost(b.rate) - 1e-12


def test_mix_documents_takes_words_not_more(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    want = sorted((r.doc_id or -1, r.taken) for r in mixing.mix(docs).collect() if r.taken)
    got = defaultdict(int)
    for r in mixing.mix_documents(docs).collect():
        got[r.doc_id or -1] += len(r.text.split())
    total = defaultdict(int)
    for k, t in want:
        total[k] += t
    assert dict(got) == dict(total)


def brute_place(number, n, key, spark):
    return [r[0] for r in spark.range(n).select(sharding.permuted(sharding.F.col("id"), n, key)).collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4099])
def test_permutation_is_one(spark, n):
    places = brute_place(None, n, 7, spark)
    assert sorted(places) == list(range(n))
    if n > 50:
        assert places != list(range(n)) and places != brute_place(None, n, 8, spark)


def test_shards_follow_the_rows_law(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, DOCS)
    got = sharding.shard(docs.unionByName(odd)).collect()
    again = sharding.shard(odd.unionByName(docs).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(slots) == list(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1 for r in got if r.doc_id and r.doc_id > 10)
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
