import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import shards, suffix_dedup as s

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, length=50):
    """(doc_id, bytes, flags) by a table of all strings."""
    top = 1 << 62
    low = {}
    raws = [((top if i is None else i), (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for p in range(len(raw) - length + 1):
            g = raw[p : p + length]
            low[g] = min(low.get(g, top + 1), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if low[raw[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((str(None if i == top else i), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("letters", [1, 2, 4, 26])
def test_suffix_arrays_and_common_prefixes(letters):
    rng = random.Random(letters)
    for n in (1, 2, 7, 60, 700):
        text = bytes(97 + rng.randrange(letters) for _ in range(n)) + (b"abc" * 40 if n > 50 else b"")
        order = s.suffix_array(np.frombuffer(text, np.uint8))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        lcp = s.common_prefixes(np.frombuffer(text, np.uint8), order)
        for a, b, got in zip(want, want[1:], lcp[1:].tolist()):
            k = 0
            while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert got == k


@pytest.fixture
def rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:70]
    rng = random.Random(5)
    for i in range(25):  # passages that cross, overlap and repeat
        a, b = rng.choice(rows)[1], rng.choice(rows)[1]
        x, y = rng.randrange(len(a)), rng.randrange(len(b))
        rows.append((1000 + i, a[x : x + rng.randrange(20, 400)] + b[y : y + rng.randrange(20, 400)] * 2))
    same = "The very same passage of well over fifty bytes, with é and ü in it, repeats here. "
    rows += [(2000 + i, f"start {i} {same}end {i}") for i in range(12)]
    rows += [(3000, None), (3001, ""), (3002, "short"), (2003, rows[3][1]), (2003, rows[3][1]), (None, same), (None, same), (3003, "ab" * 3000), (3004, "ab" * 2000)]
    return rows


@pytest.mark.parametrize("size", [1 << 22, 3000])
def test_matches_brute_force(spark, rows, size, monkeypatch):
    monkeypatch.setattr(shards.pack_shards, "__defaults__", (size,))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("shard", s.F.lit("clash"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.repeated(docs).collect())
    assert got == brute(rows)


def _windows(text: bytes):
    sizes = np.array([len(text)], "<i8")
    return s.Windows(shards.Shard({"shard": 0, "ids": np.zeros(1, "<i8").tobytes(), "nulls": b"\0", "sizes": sizes.tobytes(), "body": shards.squeezed(text)}))


def test_periodic_texts_in_two_shards_that_differ_in_one_middle_byte(spark, monkeypatch):
    monkeypatch.setattr(shards.pack_shards, "__defaults__", (1,))
    # texts of which the period's own 24 bytes are the smallest string of every window
    texts = [bytes([c]) * 200 + bytes([m]) + bytes([c]) * 200 for c in range(33, 127) for m in range(33, 127) if c != m]
    low = min(range(33, 127), key=lambda c: int(s.gram_hashes(np.full(24, c, np.uint8), (24,))[24][0]))
    one_run = [t for t in texts if t[0] == low and len(_windows(t).first) == 1]
    assert len(one_run) > 2
    rows = [(i, t.decode()) for i, t in enumerate(one_run[:5])]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_run_of_one_key_is_told_apart_by_its_middle():
    def run(middle: bytes):
        half = b"x" * 24 + b"0 0 0 1 " * 20
        text = half + middle + half
        w = _windows(text)
        # as if one key were the smallest throughout
        w.first, w.count = np.array([0]), np.array([len(text) - s.LENGTH + 1])
        return w._strings()[0]

    assert run(b"a") != run(b"b") and run(b"a") == run(b"a")
    assert len({int(run(bytes([97 + i]) * 30)) for i in range(20)}) == 20


def test_cut_repeats_keeps_columns_and_whole_characters(spark):
    same = "é" * 40
    rows = [(1, f"{same} one", "a"), (2, f"x{same}y two", "b"), (3, same, "c"), (4, None, "d"), (4, None, "d")]
    out = {(r.doc_id, r.tag): r for r in s.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string, tag string")).collect()}
    assert set(out) == {(1, "a"), (2, "b"), (4, "d")}
    assert out[(1, "a")].text == rows[0][1] and out[(2, "b")].text == "xy two"
    assert s.repeated(spark.createDataFrame([], DOCS)).count() == 0
    assert s.cut_repeats(spark.createDataFrame([], DOCS)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_keys_fill_all_ranges_alike():
    """Keys are the smallest hashes of their windows; the ranges they are sent by must not be."""
    raw = bytes(random.Random(5).choices(range(97, 123), k=1 << 18))
    row = {"shard": 1, "ids": np.array([7], "<i8").tobytes(), "nulls": b"\0", "sizes": np.array([len(raw)], "<i8").tobytes(), "body": shards.squeezed(raw)}
    key, string, low, place = s.Windows(shards.Shard(row)).asked()
    per = np.bincount((key >> np.uint64(60)).astype(np.int64), minlength=16)
    assert per.max() < 1.2 * per.mean() and (np.diff(key.astype(np.float64)) >= 0).all()
