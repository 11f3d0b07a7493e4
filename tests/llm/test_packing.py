import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from ledgerloom.llm import packing

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(901, None, "en", "a", 0), (902, "", None, None, None), (903, "don't STOP it's  \x1cfine\r\n\tx\x85y 'll é<|endoftext|>é", "en", "a", 1), (903, "same words", "en", "a", 1), (903, "same words", "en", "a", 1), (None, "x1 " * 30_000, "en", None, 1)]


def test_pieces_hold_every_id_once_and_leave_little_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(ODD, DOCS))
    got = packing.pack(docs.withColumn("place", packing.F.lit("clash"))).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = defaultdict(int)
    for r in docs.collect():
        ids = tuple(tok.encode(r.text or "", add_special_tokens=False).ids) + (1,)
        want[(r.doc_id, r.source, ids)] += 1
    windows = defaultdict(list)
    runs = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes()) and len(ids) == r.length > 0
        windows[r.sequence_id].append((r.offset, r.length))
        runs[(r.doc_id, r.source, r.doc_tokens)].append((r.sequence_id * 2048 + r.offset, r.start, tuple(ids.tolist())))
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert sorted(windows) == list(range(len(windows)))
    assert sum(2048 - sum(x[1] for x in p) for p in windows.values()) < 2048
    back = defaultdict(int)
    for (doc_id, source, n), parts in runs.items():
        ids, begun = (), False
        for _, start, piece in sorted(parts):
            assert start == len(ids)
            ids += piece
            if len(ids) == n:
                back[(doc_id, source, ids)] += 1
                ids = ()
        assert ids == ()
    assert back == want


def _mix(got):
    total = defaultdict(lambda: defaultdict(int))
    for r in got:
        total[r.sequence_id][r.source] += r.length
    return total


def test_windows_follow_the_target_shares(spark):
    # texts of 5 words to many windows; c runs dry first, then a
    rows = [(i, "word " * (5 + i % 11 if i % 50 else 9000), "en", "ab"[i % 2] if i % 5 else "c", 1) for i in range(1500)]
    shares = {"a": 0.55, "b": 0.3, "c": 0.15}
    got = packing.pack(spark.createDataFrame(rows, DOCS), shares=spark.createDataFrame(list(shares.items()), "source string, share double")).collect()
    total, left = _mix(got), defaultdict(int)
    for _, text, _, source, _ in rows:
        left[source] += text.count("word") + 1
    exact = phases = 0
    for k in range(len(total) - 1):
        live = {s: p for s, p in shares.items() if left[s] > 0}
        want = {s: 2048 * p / sum(live.values()) for s, p in live.items()}
        assert sum(total[k].values()) == 2048
        if all(left[s] >= 2 * w + 2 for s, w in want.items()):
            assert all(abs(total[k][s] - w) < 2 for s, w in want.items()), (k, dict(total[k]), want)
            exact += 1
        else:
            phases += 1
        for s, n in total[k].items():
            left[s] -= n
    assert exact > 50 and phases <= 8


def test_every_window_of_whole_tables_has_each_sources_share(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    total, whole = _mix(got), defaultdict(int)
    for r in got:
        whole[r.source] += r.length
    every = sum(whole.values())
    had = defaultdict(int)
    for k in range(len(total) - 1):
        for s, n in whole.items():
            had[s] += total[k][s]
            # what is owed is less than a token at all times, so a window is off by less than two
            assert abs(had[s] - 2048 * (k + 1) * n / every) < 1 and abs(total[k][s] - 2048 * n / every) < 2


def test_many_small_sources_share_a_queue_and_no_share_comes_last(spark):
    rows = [(i, "some words of a text " * (1 + i % 9), "en", f"s{i % 900}" if i % 3 else "big", 1) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, DOCS)).collect()
    assert len(packing.queued(spark.createDataFrame([(i, i, r[3], 10) for i, r in enumerate(rows)], "row long, doc_id long, source string, n_tokens long"))[1]) == 2
    total = _mix(got)
    assert all(sum(x.values()) == 2048 for k, x in total.items() if k < len(total) - 1)
    late = packing.pack(spark.createDataFrame(rows, DOCS), shares=spark.createDataFrame([("s1", 1.0)], "source string, share double")).collect()
    assert min(r.sequence_id for r in late if r.source == "big") >= max(r.sequence_id for r in late if r.source == "s1")


def test_each_of_many_small_sources_has_its_share_all_along(spark):
    # 900 sources of very different documents, one in three of them a long one
    rows = [(i, "word " * (400 if i % 3 == 0 else 20 + i % 40), "en", f"s{i % 900}", 1) for i in range(5400)]
    got = packing.pack(spark.createDataFrame(rows, DOCS)).collect()
    total, whole, had = _mix(got), defaultdict(int), defaultdict(int)
    for _, text, _, source, _ in rows:
        whole[source] += text.count("word") + 1
    every, worst = sum(whole.values()), 0.0
    for k in range(len(total) - 1):
        assert sum(total[k].values()) == 2048
        for s, n in whole.items():
            had[s] += total[k][s]
            worst = max(worst, abs(had[s] - 2048 * (k + 1) * n / every))
    assert worst <= 2 * packing.RUN, worst
    back = defaultdict(int)
    for r in got:
        back[r.source] += r.length
    assert back == whole


def test_a_small_source_takes_turns_with_the_smallest_queue(spark):
    rows = [(i, "word " * 2000, "en", "ab"[i % 2], 1) for i in range(40)] + [(99, "tiny words here", "en", "c", 1)]
    shares = spark.createDataFrame([("a", 0.9), ("b", 0.09999), ("c", 0.00001)], "source string, share double")
    got = packing.pack(spark.createDataFrame(rows, DOCS), shares=shares).collect()
    assert sum(r.length for r in got) == sum(len(r[1].split()) + 1 for r in rows)
    assert min(r.sequence_id for r in got if r.source == "b") == 0


def test_rounds_give_every_token_once():
    import random

    rng = random.Random(8)
    for _ in range(200):
        k, window = rng.randrange(1, 6), rng.choice([64, 256])
        totals = [rng.choice([0, 1, 2, rng.randrange(1, 500)]) for _ in range(k)]
        rounds = packing.Rounds(totals, [rng.choice([0, 9, rng.randrange(9, 99)]) for _ in range(k)], window)
        seen = set()
        for q, t in enumerate(totals):
            at = 0
            while at < t:
                n, done = min(t - at, rng.randrange(1, 90)), 0
                for start, length, w, offset in rounds.pieces(q, at, n):
                    assert start == done and length > 0 and offset + length <= window
                    done += length
                    seen |= {w * window + offset + i for i in range(length)}
                assert done == n
                at += n
        assert seen == set(range(sum(totals)))


def test_encoder_gives_the_tokenizers_ids():
    import random

    tok = Tokenizer.from_file(packing.tokenizer_path())
    enc = packing.WordEncoder(packing.tokenizer_path(), plain=True)
    rng = random.Random(4)
    letters = "aAbZ09 '.,!\n\t\r-_|<>*Ééßüø÷×ÀÿÐ\u0301\u00a0\u2028Σ\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["don't I'll WE'VE 's't", "a<|endoftext|>b <|startoftext|>", "É\u0301 e\u0301", "ΑΣ ΑΣ."]
    for plain in (texts, texts[::-1]):
        for t, got in zip(plain, enc.encode(plain, None)):
            assert got.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_warm_encoder_gives_the_tokenizers_ids_of_words_that_are_several_pieces():
    tok = Tokenizer.from_file(packing.tokenizer_path())
    for second in ("foo, — bar", "it's — FOO! don't x1y2", "foo, — \t bar", "a\tb — É! 'S"):
        enc = packing.WordEncoder(packing.tokenizer_path(), plain=True)
        # the dash is known from the first batch; all new words of the second are plain
        for text in ("one — two", second):
            assert enc.encode([text], None)[0].tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
