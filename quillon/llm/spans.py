"""Native regular-expression spans: code-point offsets from DataFrame functions only.

Arrays are built in chunks, so that a text with very many matches costs time in proportion
to their number and not to its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of an array that are added one by one, and characters of a text that are cut out together.
CHUNK, PIECE = 256, 4096
#: Characters before a span that its context holds.
BEFORE = 40


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of some ints, starting from 0, what ``combine`` makes of all before it."""
    n = F.size(values)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda i: F.slice(values, i * CHUNK + 1, F.lit(CHUNK)))

    def grown(array: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(combine(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
        return F.aggregate(array, start, step, lambda acc: acc["out"])

    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), combine))
    each = F.flatten(F.zip_with(chunks, grown(totals, F.lit(0)), grown))
    return F.when(n > 0, each).otherwise(F.array().cast("array<int>"))


def find_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a Java pattern: structs (s, e, t, b).

    They hold the code-point start, the exclusive end, the matched text and, of the
    characters between the match before and this one, the last BEFORE. The matches and the
    gaps between them come from the same engine, so a running sum of their lengths gives the
    offsets. ``text`` must not be null; a pattern must not match the empty string.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    met = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("t"), F.length(g).alias("g"), F.length(m).alias("n"), F.right(g, F.lit(BEFORE)).alias("b")))

    def placed(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda p: p["g"] + p["n"]), lambda a, b: a + b)
        span = lambda p, at: F.struct((at + p["g"]).alias("s"), (at + p["g"] + p["n"]).alias("e"), p["t"].alias("t"), p["b"].alias("b"))
        return F.zip_with(pairs, before, span)

    return once(met, placed)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time for a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def pieces_of(text: Column) -> Column:
    """A text cut into pieces of PIECE characters."""
    last = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / PIECE).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))


def cut(text: Column, pieces: Column, at: Column, n: Column) -> Column:
    """``n`` characters of a text from an offset on, read from its pieces where they are few."""
    i = F.floor(at / PIECE).cast("int")
    near = F.concat(F.get(pieces, i), F.coalesce(F.get(pieces, i + 1), F.lit("")))
    return F.when(n <= 0, F.lit("")).when(n > PIECE, F.substring(text, at + 1, n)).otherwise(F.substring(near, at % PIECE + 1, n))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of structs (start, rank, kind, end, ...), in that order, comma-joined."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))
