import os
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from ledgerloom.llm import packing
from ledgerloom.llm.common import materialize

from .test_quality_rules import brute as base
from .test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_does_its_work_on_all_rows_of_the_last(spark):
    odd = [(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "just a few words", "en", None, 1), (None, "words without an id that are of good quality and quite normal prose", "en", "src2", 1)]
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet")).unionByName(spark.createDataFrame(odd, SCHEMA))
    kept = [materialize(docs, "start")]
    for name, stage in cp.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), name))
    start, good, single, cut, mixed, packed = kept
    assert all(k.columns == cp.COLUMNS for k in kept[:-1])
    # quality: every kept text passes the base rules, nothing is changed
    assert {(r.doc_id, r.text) for r in good.collect()} <= {(r.doc_id, r.text) for r in start.collect()}
    assert not any(base(r.text)[-1] for r in good.collect()) and good.count() > 0.7 * start.count()
    # copies: no text twice; most documents stay
    texts = [r.text for r in single.collect()]
    assert len(set(texts)) == len(texts) == len({r.text for r in good.collect()} & set(texts)) and len(texts) > 0.8 * good.count()
    # repeats: as many bytes are left as brute force leaves, but for parts of characters
    left = sum(n - gone for _, n, gone, _, _ in repeats([(r.doc_id, r.text) for r in single.collect()]))
    have = sum(len(r.text.encode()) for r in cut.collect())
    assert left <= have <= left + 6 * single.count()
    # mixture: words per source, then windows: all ids, gapless
    assert mixed.count() > 0
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    rows = packed.collect()
    assert sum(r.length for r in rows) == want
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
        assert len(np.frombuffer(r.ids, "<u4")) == r.length
    assert all(fill[i] == 2048 for i in range(len(fill) - 1))


def test_run_gives_the_last_stage(spark):
    assert "sequence_id" in cp.run(spark, SF).columns
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
