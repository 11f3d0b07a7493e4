import hashlib
import struct
import zlib

import numpy as np

from ledgerloom.llm import media

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_round_trip_of_all_sizes():
    for n in (0, 1, 575, 576, 577, 576 * 64, 576 * 256, 576 * 256 + 1, 576 * 1000 + 17):
        raw = bytes(i * 7 % 251 for i in range(n))
        stored = media.wrap(media.pad(raw))
        back = media.read_payload(stored)
        assert back[:n] == raw and set(back[n:]) <= {255} and len(back) == max(576, -(-n // 576) * 576)
        (t,) = media.tracks(stored)
        units = len(back) // 576
        assert t.codec == "raw " and t.kind == "soun" and len(t.sizes) == units
        assert abs(t.duration() - len(back) / 44100) < 1e-9
        keys = t.keyframes()
        assert len(keys) == -(-units // 64)
        assert all(stored[a:b] == back[i * 64 * 576 : i * 64 * 576 + 576] for i, (a, b) in enumerate(keys.tolist()))


def test_variable_sizes_and_no_sync_table():
    samples = [b"a" * 5, b"b" * 9, b"c", b"d" * 4, b"e" * 2]
    head = media._box(b"ftyp", b"isom", bytes(4))
    data = b"xx".join([b"".join(samples[:2]), b"".join(samples[2:4]), samples[4]])

    def moov(base):
        at = [base, base + 14 + 2, base + 14 + 2 + 5 + 2]
        stbl = media._box(
            b"stbl", media._full(b"stsd", struct.pack(">I", 1), media._box(b"avc1", bytes(78))), media._full(b"stts", struct.pack(">IIIII", 2, 3, 10, 2, 20)),
            media._full(b"stsc", struct.pack(">I", 2), struct.pack(">6I", 1, 2, 1, 3, 1, 1)), media._full(b"stsz", struct.pack(">II", 0, 5), struct.pack(">5I", *map(len, samples))),
            media._full(b"co64", struct.pack(">I", 3), struct.pack(">3Q", *at)),
        )
        mdia = media._box(b"mdia", media._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 70, 0, 0)), media._full(b"hdlr", bytes(4), b"vide"), media._box(b"minf", stbl))
        return media._box(b"moov", media._box(b"trak", mdia))

    stored = head + moov(len(head) + len(moov(0)) + 16) + struct.pack(">I4sQ", 1, b"mdat", len(data) + 16) + data
    (t,) = media.tracks(stored)
    assert [stored[a:b] for a, b in t.ranges().tolist()] == samples
    assert len(t.keyframes()) == 5 and t.duration() == 0.7 and t.codec == "avc1"


def test_digest_of_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(900, None, "en", "a", 0), (901, "", None, None, None), (902, "", "en", "a", 0), (None, "é" * 300, "en", "a", 1), (903, "z" * 200_000, "en", "a", 1)]
    rows = {r.doc_id: r for r in media.media_digest(docs.unionByName(spark.createDataFrame(odd, DOCS)).withColumn("feature", media.F.lit(1))).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()} | {r[0]: r[1] for r in odd}
    assert set(rows) == set(texts)
    for k, text in texts.items():
        raw = (text or "").encode()
        whole = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        stored = media.wrap(whole)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[900][1:] == rows[901][1:] == rows[902][1:]
    assert media.media_digest(spark.createDataFrame([], DOCS)).count() == 0


def test_describe_keeps_columns_and_names_errors(spark):
    good = media.wrap(media.pad(b"hello" * 9000))
    rows = [(1, good, "x"), (2, good[:60], "y"), (3, None, "z"), (4, b"\0\0\0\x04mdat", "w")]
    got = {r.id: r for r in media.describe(spark.createDataFrame(rows, "id long, content binary, error string")).collect()}
    assert got[1].error is None and got[1].tracks[0].codec == "raw "
    starts = np.array(got[1].tracks[0].key_starts)
    assert (np.diff(starts) == 64 * 576).all()
    assert all(got[i].error for i in (2, 3, 4))


def test_odd_boxes_are_errors_and_no_crash(spark):
    nested = b""
    for _ in range(3000):
        nested = struct.pack(">I4s", len(nested) + 8, b"moov") + nested
    stored = media.wrap(media.pad(b"abc\n" * 500))
    at = stored.index(b"stsz")
    many = stored[: at + 8] + struct.pack(">II", 1, 2**32 - 1) + stored[at + 16 :]
    longer = stored[: at + 8] + struct.pack(">II", 0, 2**31) + stored[at + 16 :]
    at = stored.index(b"stsc")
    runs = stored[: at + 12] + struct.pack(">II", 2**31, 2**32 - 1) + stored[at + 20 :]
    rows = [(i, x) for i, x in enumerate((nested, many, longer, runs, stored))]
    got = {r.i: r for r in media.describe(spark.createDataFrame(rows, "i int, content binary")).collect()}
    assert [bool(got[i].error) for i in range(5)] == [True, True, True, True, False]
    assert got[0].error == "no track" and got[4].tracks[0].samples == 4


def test_features_follow_the_content():
    of = lambda t: media.feature(media.wrap(media.pad(t)))
    assert of(b"abc") != of(b"xyz") and of(b"abc") == of(b"abc")
    assert of(b"a" * 2000) != of(b"a" * 100 + b"\n" + b"a" * 1899)
