import numpy as np
import xxhash

from ledgerloom.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """doc_id -> (fingerprint, component) by comparing every pair."""
    import re

    fps = []
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 4 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        low[r] = min([x for x in (low.get(r), doc_id) if x is not None], default=None)
    return sorted((str(rows[i][0]), f"{fps[i]:016x}", low[find(i)]) for i in range(len(rows)))


def test_matches_brute_force_on_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = rows[5][1].split(" ")
    rows += [(1000 + i, " ".join(words[:i] + ["edit"] + words[i + 1 :])) for i in range(12)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One two"), (2004, "one TWO"), (2004, "one TWO"), (None, "one two")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == brute(rows)


def test_ball_links_lose_no_link_at_distance_four():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in base[:20]:
        for d in (1, 2, 3, 4, 5):
            fps.append(int(x) ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    fps = np.array(fps, np.uint64)
    for limit in (1 << 22, 64):
        found = [simhash.owned_links(p, fps, 4, limit=limit) for p in range(16)]
        a, b = np.concatenate(found, axis=1)
        assert (np.bitwise_count(a ^ b) <= 64).all()
        index = {int(f): i for i, f in enumerate(np.unique(fps))}
        pos = np.array([[index[int(x)] for x in a], [index[int(x)] for x in b]])
        root = simhash._merge(len(index), pos[0], pos[1])
        for x in fps:
            for y in fps:
                if int(x ^ y).bit_count() <= 4:
                    assert root[index[int(x)]] == root[index[int(y)]]


def test_keep_one_keeps_one_of_each_group(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, text, "en", "a", 1), (2, text, None, None, None), (2, text, "en", "b", 1), (3, "quite another text with its own words here", "en", "a", 1), (None, text, "en", "a", 1)]
    out = simhash.keep_one(spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "fp")).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "3", "None"]
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_near_copies_of_five_word_shingles_are_found_and_others_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    grams = {}
    for i, t in rows:
        w = t.lower().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    by = {}
    for i, g in grams.items():
        for x in g:
            by.setdefault(x, []).append(i)
    pairs = {(min(a, b), max(a, b)) for l in by.values() for a in l for b in l[:30] if a != b}
    alike = {p: len(grams[p[0]] & grams[p[1]]) / len(grams[p[0]] | grams[p[1]]) for p in pairs}
    gone = {r.doc_id for r in docs.join(simhash.keep_one(docs).select("doc_id"), "doc_id", "left_anti").collect()}
    must = {max(p) for p, j in alike.items() if j >= 0.85}
    may = {k for p, j in alike.items() if j >= 0.65 for k in p}
    assert len(must - gone) <= 0.05 * len(must), (len(must), len(must - gone))
    assert gone <= may


def _exact(rows):
    """doc_id -> smallest doc_id over all pairs of a similarity of 0.8, by brute force."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    by, root = {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for x in s for j in by.get(x, ())}:
            both = len(s & sets[j])
            if 10 * both >= 8 * (len(s) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
        for x in s:
            by.setdefault(x, []).append(i)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def _reordered(rng, words, n):
    """Texts of the same words in other orders, each with a near copy: one word SimHash."""
    rows = []
    for i in range(n):
        order = [words[k] for k in rng.permutation(len(words))]
        rows += [(10 * i + 1, " ".join(order)), (10 * i + 2, " ".join([order[-1], *order[:-1]]))]
    return rows


def test_near_copies_chained_to_an_unrelated_smaller_text_are_found(spark):
    # x has their words in another order and comes first; y and z are near copies
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(words[::-1])), (5, " ".join(words)), (7, " ".join(words[:-1] + ["other"]))]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOCS)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 5]
    for wide, most in ((64, 1 << 18), (2, 4)):
        # long lists in several rounds give the same groups
        rows = [(100 * g + i, " ".join(w[: 119 - i % 9] + [f"x{i % 9}"] * (i % 9))) for g in range(3) for w in [[words[k] for k in rng.permutation(120)]] for i in range(14)]
        docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOCS)
        links = simhash.near_copy_links(docs, wide=wide, most=most)
        got = {r.node: r.root for r in simhash.connected_components(links).collect()}
        assert {i: got.get(i, i) for i, _ in rows} == _exact(rows)


def test_near_copies_behind_another_text_with_the_same_words_are_found(spark):
    rows = _reordered(np.random.default_rng(2), [f"w{i}" for i in range(100)], 6)
    rows += [(i + 3, t) for i, t in rows[1::2]]  # exact copies as well
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOCS)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 11, 21, 31, 41, 51]


def test_groups_are_those_of_the_exact_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    words = [f"v{i}" for i in range(404)]
    # 400 shingles: 11 to 12 changed words of five shingles each leave less than 0.8
    for k in range(5, 16):
        changed = [f"c{k}" if i % 26 == 12 and i // 26 < k else w for i, w in enumerate(words)]
        rows += [(10**6 + 2 * k, " ".join(f"{k}{w}" for w in words)), (10**6 + 2 * k + 1, " ".join(f"{k}{w}" for w in changed))]
    want = _exact(rows)
    kept = simhash.keep_one(spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOCS))
    assert {r.doc_id for r in kept.collect()} == {i for i, low in want.items() if i == low}


def test_near_copies_are_linked_by_simhash_before_lists(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [[f"{g}w{i}" for i in rng.permutation(900)] for g in range(4)]
    rows = [(10 * g + k, " ".join(w[:-k] if k else w)) for g, w in enumerate(words) for k in range(3)]
    rows += [(100, "one"), (101, ""), (102, None), (103, "two")]
    found = []
    inner = simhash._simhash_links
    monkeypatch.setattr(simhash, "_simhash_links", lambda *a: found.append(inner(*a)) or found[0])
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], DOCS)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 10, 20, 30, 100, 101, 103]
    assert found[0] is not None and found[0].count() >= 4
    # exact groups, also where the ball hashing finds nothing
    monkeypatch.setattr(simhash, "_simhash_links", lambda *a: None)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 10, 20, 30, 100, 101, 103]
