"""Personal data: patterns propose spans, checksums confirm them, context adjusts scores.

Native throughout: one projection over the documents, no shuffle and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.spans import BEFORE, cut, find_spans, joined, once, pieces_of, running


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: cheap test, proposing pattern, prior score and context words."""

    name: str
    test: str
    pattern: str
    prior: float
    context: str
    base: bool = True


# Possessive quantifiers and look-behinds keep each pattern linear in the text: a run that
# cannot start a match is not tried again from its inner positions. \G admits the rest of a
# run whose head a previous match has taken. Runs too short for a card are no candidates.
KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"\b(e-?mail|mail|contact|correo|courriel)\b"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\b(ip|host|server|address|client)\b"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){11}", r"[0-9](?:[ -]?[0-9]){11,}+", 0.7, r"\b(card|visa|credit|karte|tarjeta|carte)\b"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, r"\b(phone|tel|call|mobile|fax)\b"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.8, r"\b(iban|account|konto|cuenta|compte)\b", base=False),
)
BASE = tuple(k.name for k in KINDS if k.base)
#: What a context word in the BEFORE characters before a span adds.
CONTEXT_GAIN = 0.3
#: Spans of kinds outside BASE are kept from this score on.
KEEP = 0.75


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def term(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + term(i))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 modulo 97, its first four characters moved last."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c >= "A", (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1


def _digits(t: Column) -> Column:
    return F.translate(t, " ().+-", "")


def _valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4
        small = lambda p: F.coalesce(F.when(part(p), F.ltrim(p, F.lit("0"))).try_cast("int"), F.when(F.ltrim(p, F.lit("0")) == "", F.lit(0)), F.lit(256)) <= 255
        return F.forall(F.split(t, r"\."), small)
    if kind == "card":
        n = F.length(_digits(t))
        return F.when((n >= 12) & (n <= 19), luhn(_digits(t))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(t)).between(9, 15)
    if kind == "iban":
        return mod97(F.translate(t, " ", ""))
    return F.lit(True)


def pii_spans(text: Column) -> Column:
    """Confirmed spans of a text: structs (start, rank, kind, end, score) by start, then kind.

    A null text counts as empty. Matches that fail their validator are dropped and not
    retried. The score starts at the kind's prior and gains where a context word of the
    kind stands in the characters before the span, as far back as the kind's candidate
    before it; base kinds are kept whatever their score.
    """
    text = F.coalesce(text, F.lit(""))
    found = [_of_kind(text, rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def _of_kind(text: Column, rank: int, kind: Kind) -> Column:
    test = F.contains(text, F.lit(kind.test)) if kind.test == "@" else text.rlike(kind.test)

    def scored(x: Column) -> Column:
        gain = F.when(F.lower(x["b"]).rlike(kind.context), CONTEXT_GAIN).otherwise(0.0)
        score = F.least(F.lit(1.0), F.lit(kind.prior) + gain)
        return F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), x["e"].alias("end"), score.alias("score"))

    spans = F.transform(F.filter(find_spans(text, kind.pattern), lambda x: _valid(kind.name, x["t"])), scored)
    if not kind.base:
        spans = F.filter(spans, lambda x: x["score"] >= KEEP)
    return F.when(test, spans).otherwise(F.array().cast(SPANS))


#: Type of what ``pii_spans`` returns.
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with a column of confirmed spans.

    Other columns pass through, whatever their names; a column named as ``into`` is
    replaced. No rows: no rows. Repeated rows are each treated alone.
    """
    return docs.withColumn(into, pii_spans(docs[text]))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every personal span replaced by its kind in angle brackets.

    Spans that overlap are one, from the start of the first to the furthest end, and take
    the kind of the first. Null texts stay null, no rows give no rows, and repeated rows
    are each treated alone.
    """
    said = docs[text]

    def clean(spans: Column) -> Column:
        taken = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

        def assembled(pieces: Column) -> Column:
            part = lambda x, to: F.when(x["start"] >= to, F.concat(cut(said, pieces, to, x["start"] - to), F.lit("<"), x["kind"], F.lit(">"))).otherwise(F.lit(""))
            last = F.array_max(F.transform(spans, lambda x: x["end"]))
            return F.concat(F.array_join(F.zip_with(spans, taken, part), ""), F.substring(said, last + 1, F.length(said)))

        return F.when(F.size(spans) > 0, once(pieces_of(said), assembled)).otherwise(said)

    return docs.withColumn(text, F.when(said.isNotNull(), once(pii_spans(said), clean)))


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base kinds, hash of the base spans, all spans."""
    found = find_pii(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["rank"] < len(BASE))
    number = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k))
    counts = [number(k).cast("long").alias(f"n_{k}") for k in BASE]
    top = F.array_max(F.transform("pii", lambda x: x["score"])).alias("top_score")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), top)


__all__ = ["BASE", "BEFORE", "KINDS", "find_pii", "pii_digest", "pii_spans", "redact"]
