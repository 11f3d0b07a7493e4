import re

from ledgerloom.llm import quality_rules as q

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(5001, None, "en", "a", 0), (5002, "", None, None, None), (5003, "a b c d e a b c d e f", "en", "a", 1), (5003, "a b c d e a b c d e f", "en", "a", 1), (None, "x y\n \nx y\nx y | # é\v\x85z", "en", "a", 1)]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = {}, set()
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= set(range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_counts_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(ODD, DOCS))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    taught = labels.where("doc_id % 3 <> 0")
    got = q.rules(docs, taught).collect()
    texts = sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0], x[1] or ""))
    rows = sorted(got, key=lambda r: r.doc_id if r.doc_id is not None else -1)
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows] == [brute(t) for _, t in texts]
    assert all(not (r.base_failed and r.kept) for r in rows)
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    judged = [(held[r.doc_id], r.kept) for r in rows if r.doc_id in held and r.n_words >= 10]
    good, bad = [k for y, k in judged if y], [k for y, k in judged if not y]
    assert sum(good) / len(good) > 0.93 and sum(bad) / len(bad) < 0.15


def test_keep_takes_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([*ODD, (1, " ".join(f"word{i}" for i in range(40)), "en", "a", 1)], DOCS).withColumn("kept", q.F.lit("clash"))
    none = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = q.keep(docs, none)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "None"]
    assert q.rules(spark.createDataFrame([], DOCS), none).count() == 0
