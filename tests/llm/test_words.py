"""Shingles, anchors and their hashes against plain code."""

import random

import numpy as np

from quillon.llm import anchors, words


def test_shingles_follow_ascii_rules():
    h = words.WordHashes()
    n = lambda t, k=4: len(words.shingles(t, k, h))
    assert [n(t) for t in (None, "", " \t\n", "a", "a b c", "a b c d", "a b c d a b c d a")] == [0, 0, 0, 1, 1, 1, 4]
    same = lambda a, b: np.array_equal(words.shingles(a, 4, h), words.shingles(b, 4, h))
    assert same("A b C d", "a B\x0bc\rD") and not same("a b c d", "a b c\x85d") and not same("É b c d", "é b c d")
    assert not same("a b c", "a b c c") and not same("ab c", "a bc")


def test_anchors_partition_windows():
    rng = random.Random(2)
    for data in (bytes(rng.choice(b"abc ") for _ in range(3000)), b"a" * 500, b"abcab" * 100, bytes(rng.randrange(256) for _ in range(100))):
        b = np.frombuffer(data, np.uint8)
        h, _, at, first, last = anchors_of(b)
        covered = np.concatenate([np.arange(x, y + 1) for x, y in zip(first, last)])
        assert sorted(covered.tolist()) == list(range(len(b) - 99))
        assert all(x <= a <= x + 68 and y <= a for a, x, y in zip(at, first, last))


def anchors_of(b):
    from quillon.llm.substrings import anchors as make

    return make(b)


def test_hashes_depend_on_content_alone():
    data = np.frombuffer(b"xx" + b"hello world, hello world" + b"yy", np.uint8)
    h = anchors.Hasher(data)
    assert h.of(np.array([2]), np.array([7])) == h.of(np.array([15]), np.array([20]))
    assert h.grams(5)[2] == h.grams(5)[15]
