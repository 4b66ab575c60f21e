"""The automaton against edit distances, and a small learned model."""

import random
import zlib

from quillon.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automata_against_distances():
    rng = random.Random(7)
    words = ["ab", "abc", "clown", "worthless", "pathetic", "abcabc"]
    for errors in (1, 2):
        automaton = toxicity.Automaton(words, errors)
        for _ in range(3000):
            w = list(rng.choice(words))
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "x", "st"])
            w = "".join(w)
            near = min(distance(w, x) for x in words)
            assert automaton.distance(w) == (near if near <= errors else -1), (w, near, errors)


def test_matcher_against_distances(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 40)
    rng = random.Random(8)
    words = ["clown", "scum", "worthless", "pathetic", "stupid", "abcabc", "ugh"]
    match = toxicity.Matcher(words, ["zzqq"], ["clowns"])
    for _ in range(4000):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "x", "st"])
        w = "".join(w)
        to = lambda low, high: min((distance(w, x) for x in words if low <= len(x) < high), default=9)
        want = "exact" if w in words else "" if w == "clowns" else "fuzzy" if to(6, 99) == 1 or to(9, 99) <= 2 else "short" if to(4, 6) == 1 else ""
        assert match(w) == want, (w, want)
    assert match("zzqqanything") == "stem" and match("zzq") == ""
    assert [match(w) for w in ("cl0wn", "scvm", "clowns", "wirthlss", "uhg")] == ["short", "short", "", "fuzzy", ""]


def test_quotation_counts_apart():
    match = toxicity.Matcher(["idiot"], [])
    at = dict(zip(toxicity.FEATURES, toxicity.features('you are an idiot', match)))
    assert at["exact"] > 0 and at["aimed"] > 0 and at["quoted"] == 0
    at = dict(zip(toxicity.FEATURES, toxicity.features('the word "idiot" was used', match)))
    assert at["quoted"] > 0 and at["exact"] == 0
    assert toxicity.features(None, match) == [0.0] * 7


def test_digest(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioutrns") for _ in range(6))
    docs, labels = [], []
    for i in range(240):
        words, bad = [word() for _ in range(40)], i % 3 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(40)] = rng.choice(["moronic", "vilest", "trashy"])
        docs.append((i, " ".join(words), 0.0))
        labels.append((i, 1, int(bad)))
    docs += [(900, None, 0.0), (901, "", 0.0), (None, "vilest", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, tox_score double")
    got = toxicity.toxicity_digest(df, spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out for i in held) and sum(by[i].predicted == (i % 3 == 0) for i in held) >= 0.95 * len(held)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.toxicity_digest(docs, labels).collect()] == [0, 0]
    scored = toxicity.score(docs.selectExpr("*", "'x' as TOX_SCORE", "2 as toxic"), toxicity.fit(docs, labels))
    assert [c.lower() for c in scored.columns] == ["doc_id", "text", "tox_score", "toxic"] and scored.count() == 2
    assert toxicity.toxicity_digest(docs.where("false"), labels).count() == 0


def test_tables_of_any_size_estimate_the_same_model(spark):
    rng = random.Random(10)
    docs, labels = [], []
    for i in range(1200):
        bad = i % 12 == 0
        docs.append((i, " ".join(rng.choice("aeioutrns") * 3 + str(rng.randrange(50)) for _ in range(20)) + (" vilest vilest" if bad or i % 40 == 1 else "")))
        labels.append((i, int(bad)))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, part = (toxicity.fit(df, known, n) for n in (4000, 60))
    share = [{r.doc_id: r.tox_score for r in toxicity.score(df, m).collect()} for m in (whole, part)]
    assert whole[0] == part[0] == ["vilest"]
    assert abs(sum(share[0].values()) - sum(share[1].values())) < 0.4 * sum(share[0].values())


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "vilest " * 100_000), (2, "x" * 300_000)], "doc_id long, text string")
    got = toxicity.score(docs, (["vilest"], [], [], [1.0] * 8)).collect()
    assert all(0 <= r.tox_score <= 1 for r in got)
