"""Exact top-k against all inner products."""

import math
import random

from quillon.llm import search


def floor(x):
    return math.floor(1024 * x)


def brute(rows):
    good = [(i, [floor(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in good:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:10]
            if scores:
                out[q] = [(n + 1, i, max(-(2**63) + 1, min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores)]
    return out


def found(spark, rows):
    got = {}
    df = spark.createDataFrame([(i, v, i, "s") for i, v in rows], "vec_id long, embedding array<double>, shard long, known string")
    for r in search.search_digest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def small(monkeypatch):
    for name, value in (("SHARD", 100), ("SMALL", 50), ("QUERIES", 3), ("SAMPLE", 60)):
        monkeypatch.setattr(search, name, value)


def test_against_all_products(spark, monkeypatch):
    small(monkeypatch)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(20)]) for i in range(700)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1100, None), (1200, [1.0, None] + [0.0] * 18), (1300, [float("nan")] * 20), (1400, [float("inf")] * 20), (1600, [0.0] * 20), (1700, [1.0]), (1701, [2.0]), (1800, []), (1801, []), (None, [0.5] * 20)]
    assert found(spark, rows) == brute(rows)


def test_components_beyond_machine_numbers(spark, monkeypatch):
    small(monkeypatch)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(20)]) for i in range(300)]
    rows += [(1500, [1e30] * 20), (1501, [-1e30] * 20), (1502, [3e9] * 20), (1503, [1e4, -1e4] * 10), (1600, [2e6, -2e6] * 10), (1601, [1e300] + [0.0] * 19)]
    got, want = found(spark, rows), brute(rows)
    assert set(got) == set(want)
    for q in want:
        assert [s for *_, s in got[q]] == [s for *_, s in want[q]], q
        assert [i for _, i, s in got[q] if abs(s) < 2**63 - 1] == [i for _, i, s in want[q] if abs(s) < 2**63 - 1], q


def test_repeated_ids(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.5, 0.0]), (7, [1.0, 1.0]), (7, [2.0, 1.0]), (8, [2.0, 5.0])]
    assert found(spark, rows) == {100: [(1, 7, 1024 * 1024), (2, 8, 1024 * 1024), (3, 7, 512 * 1024)]}


def test_empty_table(spark):
    assert search.search_digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
