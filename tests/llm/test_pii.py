"""Spans against a plain reading of the rules."""

import hashlib
import random
import re
import time

import pytest

from quillon.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(t):
    d = [int(c) for c in reversed(re.sub(r"\D", "", t))]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def good(kind, t):
    n = len(re.sub("[^0-9]", "", t))
    if kind == "ip":
        return all(int(p) <= 255 for p in t.split("."))
    if kind == "card":
        return 12 <= n <= 19 and luhn(t)
    return kind != "phone" or 9 <= n <= 15


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if good(kind, m[0])]
    return sorted(found)


HARD = [
    None, "", "a@b.c_d@e.f", "x@y", "mail me: jo.e+1@ex-a.co.uk.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.004", "0.0.0.0", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "+49 (30) 123-456-78", "+1", "+12", "\U0001f600 é a@b.cd \U0001f600 10.0.0.1", "9" * 5000, "1 " * 3000, "a" * 20000 + "@b.c", "@" * 50, "a@b..c a@b.c.", "99999999999999999999.1.1.1",
    "4111111111111111" * 2, "+1 2 3 4 5 6 7 8 9)", "a@b.c@d.e", "a%b@c-d.e-f", "IBAN GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433",
]


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice("ab1239.@+- ()%_é") for _ in range(rng.randrange(120))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_digest(rows).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text)
        said = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (text, said, got[i].spans)
        assert set(said.split(",")) - {""} <= set(got[i].spans.split(","))
        for kind in BASE:
            assert got[i][f"n_{kind}"] == sum(x[2] == kind for x in want)


def test_iban_needs_its_checksum(spark):
    rows = spark.createDataFrame([(0, "IBAN GB82 WEST 1234 5698 7654 32 ok"), (1, "IBAN GB82 WEST 1234 5698 7654 33 ok")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_digest(rows).collect()}
    assert "iban:5:" in got[0] and "iban" not in got[1]


def test_redaction_and_other_columns(spark):
    rows = spark.createDataFrame([(0, "to a@b.cd from 10.0.0.1!", 7), (1, None, 8), (2, "", 9)], "doc_id long, text string, pii int")
    got = {r.doc_id: r for r in pii.redact(rows).collect()}
    assert [got[i].text for i in range(3)] == ["to <email> from <ip>!", None, ""]
    assert [got[i].pii for i in range(3)] == [7, 8, 9]


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pii_digest(empty).count() == 0
    twice = spark.createDataFrame([(None, "a@b.cd"), (None, "a@b.cd")], "doc_id long, text string")
    assert [r.n_email for r in pii.pii_digest(twice).collect()] == [1, 1]


@pytest.mark.parametrize("digits,ok", [("79927398713", True), ("79927398710", False)])
def test_luhn(spark, digits, ok):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.luhn(F.lit(digits)).alias("x")).first().x is ok


def test_overlapping_spans_leave_nothing(spark):
    rows = spark.createDataFrame([(0, "pay@shop.4111 1111 1111 1111 now"), (1, "x 4111 1111 1111 1111, a@b.cd" + " fill" * 2000 + " 10.0.0.1")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert got[0] == "<email> now"
    assert got[1] == "x <card>, <email>" + " fill" * 2000 + " <ip>"


def test_very_many_candidates_take_little_time(spark):
    texts = ["12," * 340_000, "123456789012," * 20_000, "1.2.3.4 " * 20_000, "+1 " * 100_000]
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.monotonic() - began < 60
    assert got[0].spans == "" and got[2].n_ip == 20_000
    assert got[2].spans.endswith("ip:159992:159999")
