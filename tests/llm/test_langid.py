"""The forward sum against all segmentations, and held-out accuracy."""

import itertools
import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

from quillon.llm import langid


def every_segmentation(word, p):
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        total += np.prod([p.get(x, 0.0) for x in parts])
    return total


def test_forward_sums_over_all_segmentations():
    trie = langid.Trie.of(["▁", "a", "b", "ab", "▁a", "ba", "bab", "aba"])
    rng = np.random.default_rng(1)
    probability = np.zeros((len(trie.step), 2))
    for node in trie.node_of.values():
        probability[node] = rng.random(2)
    model = langid.Model(["x", "y"], trie, probability)
    for word in ("abab", "bbaba", "a"):
        got = np.exp(model.score([word])[0])
        for k in range(2):
            want = every_segmentation("▁" + word, {p: probability[n, k] for p, n in trie.node_of.items()})
            assert abs(got[k] - want) < 1e-12 * max(1, want)


def test_unknown_letters_and_long_words_have_scores():
    model = langid.learn({"en": Counter("the cat sat on the mat ".split() * 5), "de": Counter("der hund und die katze ".split() * 5)}, ["▁", "the", "der", "at", "▁the"])
    s = model.score(["the", "жук", "t" * 500, "ж" * 39, "thehund" * 20_000])
    assert np.isfinite(s).all() and s[0].argmax() == model.languages.index("en")


def test_long_words_are_summed_over_all_segmentations(monkeypatch):
    monkeypatch.setattr(langid, "STRETCH", 7)
    trie = langid.Trie.of(["▁", "a", "b", "ab", "▁a", "ba", "bab", "aba"])
    rng = np.random.default_rng(2)
    probability = np.zeros((len(trie.step), 2))
    for node in trie.node_of.values():
        probability[node] = rng.random(2) * 0.3
    probability[2] = langid.FLOOR
    word = "▁" + "".join(rng.choice(list("ab")) for _ in range(500)) + "xx"
    for w in (word[:30], word):
        want = []
        for k in range(2):
            # Exact sums of fractions, one prefix after the other.
            p = {x: Fraction(probability[n, k]) for x, n in trie.node_of.items()}
            alpha = [Fraction(1)]
            for j in range(1, len(w) + 1):
                alpha.append(sum(alpha[i] * p.get(w[i:j], Fraction(langid.FLOOR) if j - i == 1 and w[i] == "x" else 0) for i in range(max(0, j - 4), j)))
            want.append(math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator))
        assert np.allclose(langid.forward_long(trie, w, probability), want, rtol=1e-9)
        assert np.allclose(langid.Model(["x", "y"], trie, probability).score([w[1:]])[0], want, rtol=1e-9)


def test_digest(spark):
    rows = [(i, "the quick brown fox and the lazy dog " * (1 + i % 3), "en", 1) for i in range(60)] + [(100 + i, "der schnelle braune fuchs und der faule hund " * (1 + i % 3), "de", 2) for i in range(60)]
    rows += [(300, None, "en", 3), (301, "", None, 3), (302, "123 !!", "de", 3), (303, "der hund", None, 3), (None, "the dog", "en", 3), (304, "½ ² ① ٣", "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").selectExpr("*", "1 as share", "2 as found", "3 as draw")
    assert langid.identify(docs, langid.fit(docs)).columns == ["doc_id", "text", "lang", "share", "found", "draw", "lang_pred", "score"]
    got = langid.langid_digest(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    truth = {i: lang for i, _, lang, _ in rows if i is not None and i < 300}
    assert all(by[i].lang_pred == lang for i, lang in truth.items())
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    assert [by[i].lang_pred for i in (300, 301, 302, 303, 304)] == ["und", "und", "und", "de", "und"] and by[300].score == 0.0
    assert all(0 <= r.score <= 1 for r in got)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "the dog", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.langid_digest(docs).collect()] == ["und"]
    assert langid.langid_digest(docs.where("false")).count() == 0


def test_many_languages_are_all_learned(spark):
    name = lambda k: "l" + "abcdefghijklmnopqrst"[k // 10] + "abcdefghij"[k % 10]
    docs = spark.createDataFrame([(3 * k + i, f"{name(k)} wort{name(k)} " * (3 + i), name(k)) for k in range(200) for i in range(3)], "doc_id long, text string, lang string")
    words = langid.training_words(docs, 2).collect()
    learned = {r.lang for r in words}
    rest = {name(k) for k in range(200) if any(zlib.crc32(str(3 * k + i).encode()) % 3 != 1 for i in range(3))}
    assert learned == rest and langid.fit(docs, 2).languages == sorted(rest)


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(i, ("the dog and the cat ", "der hund und die katze ")[i % 2] * 5, ("en", "de")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    more = spark.createDataFrame([(100, "the cat " * 100_000), (101, "derhundunddiekatze" * 3_000), (102, " " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(more, langid.fit(docs)).collect()}
    assert got == {100: "en", 101: "de", 102: "und"}


def test_rows_left_out_by_text(spark, monkeypatch):
    say = {"en": "the river and the people of that house", "de": "der fluss und die leute von dem haus"}
    rows = [(i, f"{say[lang]} {i}", lang, 7) for i, lang in enumerate(["en", "de"] * 20)]
    rows += [(None, say["en"], "en", 7), (3, None, "en", 7), (None, None, None, 7), (50, "", "en", 7), (51, "12 !", "de", 7), (51, "12 !", "de", 7), (None, "12 !", "de", 7), (52, "z", "en", 7), (52, "z", "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Digest int")
    model = langid.fit(docs)
    key = lambda r: (r.doc_id, r.text, r.lang, r.Digest)
    for sure in (0.5, 0.99, 1.1):
        found = langid.identify(docs, model).collect()
        want = sorted((key(r) for r in found if r.lang_pred != langid.UNDECIDED and r.score >= sure), key=str)
        for few in (1 << 17, 0):
            monkeypatch.setattr(langid, "FEW_LEFT_OUT", few)
            got = langid.identified(docs, model, sure)
            assert got.columns == docs.columns and sorted(map(key, got.collect()), key=str) == want
    assert langid.identified(docs.where("false"), model, 0.5).count() == 0
