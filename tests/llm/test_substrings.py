"""Removed bytes against a plain search for earlier equal strings."""

import hashlib
import random

import numpy as np
import xxhash

from quillon.llm import substrings


def brute(rows, length=100):
    seen, out = set(), {}
    texts = {}
    for key, text in rows:
        texts.setdefault(key, set()).add(text)
    # Rows that repeat an id come by the hash of their text.
    hashed = lambda t: 0 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    for key, text in sorted({(k, t) for k, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]))):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[key, text] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, doubling=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = substrings.deduplicated(docs, doubling=True).drop("kept") if doubling else substrings.substrings_digest(docs)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = brute(rows)
    assert got == sorted(((k, *want[k, t]) for k, t in rows), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passages = [word(n) for n in (99, 100, 101, 130, 260, 900)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 400), (4, "ab" * 300), (5, "a" * 99), (None, word(300))]
    for i in range(10, 70):
        parts = [word(rng.randrange(150)) for _ in range(4)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        parts.insert(rng.randrange(4), rng.choice(passages)[rng.randrange(40) :])
        rows.append((i, "".join(parts)))
    base = word(1500)
    rows += [(100, base), (101, base), (102, base[:700] + "#" + base[700:]), (103, base[:40] + "!" + base[41:]), (104, base[::-1]), (105, base[5:] + base[:200])]
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, rows, doubling=True)


def test_a_document_that_repeats_itself_and_hot_lines(spark):
    line = "the same licence line that stands in every one of many documents, word for word, to its very end.\n"
    rows = [(i, f"{i * 7919} head {line}{'tail ' * (i % 3)}{i}" + (line if i % 5 == 0 else "")) for i in range(60)]
    check(spark, [*rows, (200, line * 20), (201, "x" * 5000)])
    check(spark, [*rows, (200, line * 20), (201, "x" * 5000)], doubling=True)


def test_null_and_repeated_ids(spark):
    line = "the same licence line that stands in every one of many documents, word for word, to its very end.\n"
    check(spark, [(i % 3 or None, f"{line * (1 + i % 4)}{i // 4}{line}") for i in range(40)] + [(7, line)] * 3 + [(None, None), (None, "")])


def test_very_long_texts(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    check(spark, [(1, text), (2, text[50_000:] + text[:60_000]), (3, "ab" * 50_000)])


def test_empty_table(spark):
    assert substrings.substrings_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, "x" * 150, 9, 8)], "doc_id long, text string, rank int, doc int")
    assert [r.n_removed for r in substrings.deduplicated(rows).collect()] == [149]
