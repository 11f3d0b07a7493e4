from ledgerloom.llm import quality_model as q

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_weak_labels_tell_junk_from_prose_without_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(8001, None, "en", "a", 0), (8002, "", None, None, None), (8002, "", None, None, None), (None, "BUY!! NOW!! CHEAP!! " * 40, "en", "a", 1)]
    got = q.assess(docs.unionByName(spark.createDataFrame(odd, DOCS)).withColumn("kept", q.F.lit("clash"))).collect()
    assert len(got) == docs.count() + len(odd)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(truth[r.doc_id], r.kept, r.posterior_good >= 0.5) for r in got if r.doc_id in truth]
    good, bad = [k for y, k, _ in judged if y], [k for y, k, _ in judged if not y]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad), (sum(good), len(good), sum(bad), len(bad))
    assert [r.kept for r in got if r.doc_id is None] == [False]


def test_empty_table(spark):
    assert q.assess(spark.createDataFrame([], DOCS)).count() == 0
