"""Extra columns with the names that operators use inside."""

from pyspark.sql import functions as F

from ledgerloom.llm import mixing, packing, quality_rules, sharding, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"
NAMES = ["__key", "__hash", "__id", "__size", "__first", "__row", "__bucket", "__base", "row", "id", "hash", "left", "sha", "node", "turn", "size", "taken", "copy", "shard", "runs", "kind", "before", "rate"]


def _docs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for n in NAMES:
        docs = docs.withColumn(n, F.col("doc_id"))
    return docs


def test_filters_keep_clashing_columns(spark):
    docs, labels = _docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    for out in (quality_rules.keep(docs, labels), simhash.keep_one(docs), suffix_dedup.cut_repeats(docs), mixing.mix_documents(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == r.doc_id for r in rows for n in NAMES)


def test_digests_ignore_clashing_columns(spark):
    docs, labels = _docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    plain = docs.drop(*NAMES)
    for f in (lambda d: quality_rules.rules(d, labels), mixing.mix, sharding.shard, packing.pieces_digest, suffix_dedup.repeated):
        assert sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain).collect()))
