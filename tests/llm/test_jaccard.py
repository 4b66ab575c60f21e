"""Components of similar documents against all pairs."""

import random

import numpy as np
import pytest

from quillon.llm import jaccard


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    s = {i: sets_of(t, k) for i, t in rows}
    parent = {i: i for i in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), root(i)) for i in s}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_against_all_pairs(spark, k, percent):
    rng = random.Random(k)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi".split()) + str(rng.randrange(9))
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one"), (4, "one"), (5, "One two"), (6, "a b c d e f"), (7, "A b c D e f")]
    line = [word() for _ in range(30)]
    for g in range(8):
        base = [word() for _ in range(rng.choice([6, 20, 90, 200]))]
        for c in range(9):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += line
            rows.append((100 * (g + 1) + c, " ".join(copy)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_a_link_beside_a_larger_set(spark):
    # All rare words of two linked sets are also in a third, which links with neither: whichever a list's centres are, the two must meet.
    rows = []
    for g in range(300):
        shared = [f"s{g}x{i}" for i in range(18)]
        rows += [(3 * g, " ".join([*shared, *"abcdef"])), (3 * g + 1, " ".join([*shared, "y"])), (3 * g + 2, " ".join([*shared, "z"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 1).collect()}
    assert got == {i: i - i % 3 + (i % 3 > 0) for i in range(900)}


def test_nulls_repeats_and_empty_tables(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, "x y"), (None, "q")], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.jaccard_components(docs.selectExpr("*", "1 as n", "text as sig")).collect() if r.doc_id is not None)
    assert got == [(3, 1, 3), (7, 2, 7), (7, 2, 7)]


def test_bitmaps_bound_the_difference(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n in (1, 40, 500, 530, 1000, 3000):
        for m in (n, n + 20, n * 11 // 10):
            a = np.unique(rng.integers(0, 1 << 63, m, dtype=np.uint64))
            b = np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 63, n - n * 9 // 10, dtype=np.uint64)])
            rows.append((len(np.setxor1d(a, b)), jaccard.bitmap(a).tolist(), jaccard.bitmap(b).tolist()))
    df = spark.createDataFrame(rows, "n int, a array<long>, b array<long>")
    for r in df.select("n", jaccard.differing(df.a, df.b).alias("x")).collect():
        assert r.n * 0.4 <= r.x <= r.n


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PARTNERS", 3)
    monkeypatch.setattr(jaccard, "CENTRES", 1)
    monkeypatch.setattr(jaccard, "FEW_WANTED", 5)
    rng = random.Random(3)
    base, rows = [f"w{i}" for i in range(70)], []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(70)] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute(rows, 4, 85)


def test_without_near_duplicates(spark, monkeypatch):
    line = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(5, line), (3, line + " more"), (None, line), (7, "q w e r t"), (7, "z z z z a"), (9, "q w e r t"), (1, None), (1, None), (2, ""), (8, "x y"), (8, "x y"), (None, "lone words here now"), (None, "lone words here now")]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, row_key long").selectExpr("*", "4 as Row")
    want = sorted([(3, line + " more"), (7, "q w e r t"), (7, "z z z z a"), (1, None), (1, None), (2, ""), (8, "x y"), (None, "lone words here now")], key=str)
    for few in (jaccard.FEW_WANTED, 0):
        monkeypatch.setattr(jaccard, "FEW_WANTED", few)
        got = jaccard.without_near_duplicates(docs)
        assert got.columns == ["doc_id", "text", "row_key", "Row"]
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
    assert jaccard.without_near_duplicates(docs.where("false")).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(50_000)}" for _ in range(150_000)]
    rows = [(4, " ".join(long)), (2, " ".join(long[:-500] + ["end"] * 3)), (3, "a" * 500_000), (1, "a " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 2, 3: 3, 4: 2} and got[1][0] == 1 and got[3][0] == 1
