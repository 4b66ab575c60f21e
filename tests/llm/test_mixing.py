"""Targets and draws against plain arithmetic."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import mixing


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left, target = set(), sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        rest = left - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s] * (1 + 1e-12)}
        if not above:
            return target
        full |= above


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_draws(spark):
    rows = [(i, "w " * (37 * i % 900), f"s{i % 5}" if i % 11 else None) for i in range(400)]
    rows += [(1000 + i, "tiny one", "a") for i in range(30)] + [(2000, None, "b"), (2001, " \n", "b"), (2002, "x " * 50000, "s1")]
    got = mixing.mix_digest(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = defaultdict(int)
    for i, _, s in rows:
        by[s] += size[i]
    want, source, taken = fill(by), {i: s for i, _, s in rows}, defaultdict(int)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert taken[s] == round(t), (s, taken[s], t)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = docs(spark, [(i, "a b c d " * (i % 50), f"s{i % 3}") for i in range(300)])
    once = sorted(mixing.mix_digest(rows.repartition(3)).collect())
    assert once == sorted(mixing.mix_digest(rows.repartition(7)).collect())


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), mixing.digest(F.lit("k"))).alias("p"))
        got = [r.p for r in df.collect()]
        assert sorted(got) == list(range(n))
        salt = spark.range(1).select(mixing.digest(F.lit("k")).alias("s")).first().s
        assert mixing.permuted_array(np.arange(n), n, salt).tolist() == got
        # Neighbours part, and about half of all indices change sides.
        assert n < 64 or sum(abs(a - b) == 1 for a, b in zip(got, got[1:])) < n / 8
        assert n < 64 or 0.3 * n < sum((a < n // 2) != (b < n // 2) for a, b in enumerate(got)) < 0.7 * n


def test_nulls_ties_and_empty_tables(spark):
    assert mixing.mix_digest(docs(spark, [])).count() == 0
    got = mixing.mix_digest(docs(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    got = mixing.mix_digest(docs(spark, [(1, "a b c", "a"), (1, "a b c", "a"), (None, "x", None)])).collect()
    assert len(got) == 3 and all(r.taken <= 3 * r["size"] for r in got)


def test_inverse_permutation(spark):
    df = spark.range(97).select("id", mixing.permuted(F.col("id"), F.lit(97), mixing.digest(F.lit("k"))).alias("p"))
    assert all(r.id == r.q for r in df.select("id", mixing.permuted(F.col("p"), F.lit(97), mixing.digest(F.lit("k")), inverse=True).alias("q")).collect())


def test_counts_of_shards_are_drawn_and_make_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 300)
    rows = docs(spark, [(i, "w " * 2000, "ab"[i % 2]) for i in range(40)])
    goals = mixing.targets(mixing.sizes(rows))
    drawn = mixing.counts(goals).collect()
    assert len({r.shard for r in drawn}) > 2 and {r.origin for r in drawn} == {"=a", "=b"}
    assert len({r["count"] for r in drawn}) > 2
    want = {(r.origin[1:], r.shard): r["count"] for r in drawn}
    got = {(r.source, r.shard): r.n for r in mixing.mix(rows).groupBy("source", "shard").agg(F.count_distinct("slot").alias("n")).collect()}
    assert got == want


def test_pieces_rebuild_the_words(spark):
    rows = docs(spark, [(i, " ".join(f"{i}.{k}" for k in range(i * 13 % 200)), "ab"[i % 2]) for i in range(30)])
    pieces = mixing.mix(rows).collect()
    for r in pieces:
        assert 0 <= r.first and r.first + r.words <= r.doc_id * 13 % 200
    taken = {r.doc_id: r.taken for r in mixing.mixed(rows).collect()}
    assert all(taken[i] == sum(r.words for r in pieces if r.doc_id == i) for i in taken)


def test_repeated_rows_and_tiny_sources(spark):
    rows = [(7, "w " * 100, "a")] * 30 + [(None, "v " * 50, "a")] * 10 + [(8, "x " * 10, "b"), (8, "y " * 20, "b"), (9, "z " * 4000, "c")]
    got = mixing.mix_digest(docs(spark, rows)).collect()
    by, want = defaultdict(int), fill({"a": 3500, "b": 30, "c": 4000})
    for r in got:
        by[r.source_size] += r.taken
        assert r.taken <= 3 * r["size"]
    assert len(got) == len(rows) and {k: round(v) for k, v in by.items()} == {3500: round(want["a"]), 30: round(want["b"]), 4000: round(want["c"])}


def test_columns_of_any_name(spark):
    rows = docs(spark, [(1, "a b c", "s"), (2, "d e", "t")]).selectExpr("*", "1 as _s", "2 as origin", "3 as rows", "4 as text_hash", "5 as Size", "6 as words", "7 as ID")
    got = mixing.mixed(rows)
    assert got.columns == ["doc_id", "text", "source", "_s", "origin", "rows", "text_hash", "words", "ID", "size", "source_size", "target", "taken"]
    assert {(r.doc_id, r["_s"], r.origin, r.rows, r.text_hash, r.words, r.ID, r["size"]) for r in got.collect()} == {(1, 1, 2, 3, 4, 6, 7, 3), (2, 1, 2, 3, 4, 6, 7, 2)}
