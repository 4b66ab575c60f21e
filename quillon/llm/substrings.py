"""Exact substring deduplication by ranks of growing context around chosen positions.

A suffix array by prefix doubling ranks all positions; here only positions that the content
chooses are ranked, about one in thirty, such that every window of LENGTH bytes has one
that depends on the window alone. Each round ranks what is still undecided by a longer
context and drops what is unique or decided: first the gram at a position, then the gram
with all the windows that chose it, then blocks of BLOCK windows by what they share and by
what they span, and last the single windows that stand between. Ranks are hashes, so equal
context has equal rank without a global sort, and minima per rank are combined before they
are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.anchors import Hasher, chosen, finish, minima
from quillon.llm.lean import lean
from quillon.llm.store import discard, stored

#: Bytes of a repeated string; of the grams that choose positions; windows in a block.
LENGTH, GRAM, BLOCK = 100, 32, 8
_ALONE = np.uint64(0xA0761D6478BD642F)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _chosen(hasher: Hasher, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and the chosen positions."""
    h = hasher.grams(gram)
    return h, chosen(h, minima(h, width), width)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Chosen positions with windows: (gram hash, context hash, position, first and last window).

    Every window of ``length`` bytes belongs to the leftmost least gram in it; the windows
    of a position are consecutive, and the context spans them.
    """
    none = (np.empty(0, np.uint64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    if len(data) < length:
        return none
    width, windows = length - gram + 1, len(data) - length + 1
    hasher = Hasher(data)
    h, at = _chosen(hasher, width, gram)
    value = h[at] >> np.uint64(32)
    first, last = np.maximum(at - width + 1, 0), np.minimum(at, windows - 1)
    for k in range(1, len(at)):
        near = at[k:] - at[:-k] < width
        if not near.any():
            break
        left, right = value[:-k], value[k:]
        np.maximum(first[k:], np.where(near & (left <= right), at[:-k] + 1, 0), out=first[k:])
        np.minimum(last[:-k], np.where(near & (right < left), at[k:] - width, windows), out=last[:-k])
    some = first <= last
    at, first, last = at[some], first[some], last[some]
    shape = ((at - first) << 16 | (last - first)).astype(np.uint64)
    return h[at], finish(hasher.of(first, last + length) + finish(shape)), at, first, last


def _each(function: Callable[[np.ndarray, list | None], tuple], columns: list[str]) -> Callable:
    """Rows of ``columns`` made from each document's bytes and its list of work, if it has one."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            work = b["work"] if "work" in b else [None] * len(b)
            parts = [(doc, rank, function(_bytes(text), doc, some)) for doc, rank, text, some in zip(b["doc"], b["rank"], b["text"], work, strict=True)]
            n = [len(p[2][0]) for p in parts]
            out = {"doc": np.repeat(np.array([p[0] for p in parts], np.int64), n), "rank": np.repeat(np.array([p[1] for p in parts], np.int64), n)}
            for i, c in enumerate(columns):
                values = np.concatenate([p[2][i] for p in parts]) if parts else np.empty(0, np.int64)
                out[c] = values.view(np.int64) if values.dtype == np.uint64 else values
            yield pd.DataFrame(out)

    return make


def _gram_rows(length: int, gram: int) -> Callable:
    """The gram hashes of chosen positions alone."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [np.empty(0, np.uint64)]
            for data in map(_bytes, b["text"]):
                if len(data) >= length:
                    h, at = _chosen(Hasher(data), length - gram + 1, gram)
                    found.append(h[at])
            yield pd.DataFrame({"h": np.concatenate(found).view(np.int64)})

    return make


def _anchor_rows(length: int, gram: int) -> Callable:
    return _each(lambda data, doc, work: anchors(data, length, gram), ["h", "context", "at", "first", "last"])


def _block_rows(length: int, gram: int, block: int) -> Callable:
    """Blocks of windows around positions: hash of what all of a block's windows share, and of what they span.

    Windows lie at offsets before their position; a block is a range of offsets, the same for
    every document. A block that the document's ends cut spans nothing that another could.
    """

    def blocks(data: np.ndarray, doc: int, work: list) -> tuple[np.ndarray, ...]:
        at, first, last = (np.array([r[c] for r in work], np.int64) for c in ("at", "first", "last"))
        low, high = (at - last) // block, (at - first) // block
        n = high - low + 1
        j = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        start, stop = j * block, np.minimum(j * block + block - 1, length - gram)
        hasher = Hasher(data)
        shared = finish(hasher.of(at - start, at - stop + length) + finish(j.astype(np.uint64)))
        whole = (at - stop >= 0) & (at - start + length <= len(data))
        span = np.where(whole, hasher.of(np.maximum(at - stop, 0), np.minimum(at - start + length, len(data))), finish(finish(np.full(len(at), doc, np.int64).view(np.uint64)) + at.astype(np.uint64) + _ALONE))
        return shared, span, at, j

    return _each(blocks, ["shared", "span", "at", "block"])


def _window_rows(length: int, gram: int, block: int) -> Callable:
    """The windows of blocks, each once: (hash, start)."""

    def windows(data: np.ndarray, doc: int, work: list) -> tuple[np.ndarray, ...]:
        at, j = (np.array([r[c] for r in work], np.int64) for c in ("at", "block"))
        offsets = (j * block)[:, None] + np.arange(block)[None, :]
        start = np.unique((at[:, None] - offsets)[offsets <= length - gram])
        start = start[(start >= 0) & (start + length <= len(data))]
        return Hasher(data).of(start, start + length), Hasher(data, 1).of(start, start + length), start

    return _each(windows, ["h", "check", "start"])


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, rank, text): a null id comes first; rows that repeat an id come in the order of the hashes of their texts."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), "text")
    ids = keyed.select("doc", F.xxhash64("text").alias("t"))
    twice = stored(ids.groupBy("doc").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("doc"), "twice")
    if twice.isEmpty():
        discard(twice)
        return keyed.select("doc", F.lit(0).cast("long").alias("rank"), "text")
    marked = keyed.join(twice.withColumn("again", F.lit(True)), "doc", "left")
    return marked.select("doc", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).alias("rank"), "text")


def _not_first(rows: DataFrame, by: list[str], place: list[str], firsts: DataFrame) -> DataFrame:
    """Rows of a rank that are not its first place."""
    other = F.lit(False)
    for c in place:
        other = other | (F.col(c) != F.col(f"place.{c}"))
    return rows.join(firsts, by).where(other)


def repeated_spans(numbered: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(doc, rank, spans): the spans (begin, end) of bytes covered by strings that start earlier too; they may overlap.

    What a join meets is a table of its own each time, so that Spark can split the rows of
    a key that very many positions share.
    """
    place = ["doc", "rank", "at"]
    first = lambda *c: F.min(F.struct(*c)).alias("place")
    several = lambda rows, key, name: stored(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), name)
    made = numbered.mapInPandas(lean(_anchor_rows(length, gram)), "doc long, rank long, h long, context long, at int, first int, last int")
    again = several(numbered.select("text").mapInPandas(lean(_gram_rows(length, gram)), "h long"), "h", "again")
    anchored = stored(made.join(again, "h"), "anchors")
    discard(again)

    firsts = stored(anchored.groupBy("h", "context").agg(first(*place, "first", "last")), "firsts")
    covered = _not_first(anchored, ["h", "context"], place, firsts).select("doc", "rank", F.col("first").alias("begin"), (F.col("last") + length).alias("end"))
    spans = [stored(covered, "spans")]
    discard(anchored)

    mixed = several(firsts, "h", "mixed")
    work = firsts.join(mixed, "h").select("place.*").groupBy("doc", "rank").agg(F.collect_list(F.struct("at", "first", "last")).alias("work"))
    blocks = stored(numbered.join(work, ["doc", "rank"]).select("doc", "rank", "text", "work").mapInPandas(lean(_block_rows(length, gram, block)), "doc long, rank long, shared long, span long, at int, block int"), "blocks")
    discard(firsts, mixed)

    firsts = stored(blocks.groupBy("shared", "span").agg(first(*place, "block")), "firsts")
    begin = F.col("at") - F.least((F.col("block") + 1) * block - 1, F.lit(length - gram))
    covered = _not_first(blocks, ["shared", "span"], place, firsts).select("doc", "rank", begin.alias("begin"), (F.col("at") - F.col("block") * block + length).alias("end"))
    spans.append(stored(covered, "spans"))
    discard(blocks)

    mixed = several(firsts, "shared", "mixed")
    work = firsts.join(mixed, "shared").select("place.*").groupBy("doc", "rank").agg(F.collect_list(F.struct("at", "block")).alias("work"))
    windows = stored(numbered.join(work, ["doc", "rank"]).select("doc", "rank", "text", "work").mapInPandas(lean(_window_rows(length, gram, block)), "doc long, rank long, h long, check long, start int"), "windows")
    discard(firsts, mixed)
    place = ["doc", "rank", "start"]
    firsts = stored(windows.groupBy("h", "check").agg(first(*place), F.count("*").alias("n")).where("n > 1").select("h", "check", "place"), "firsts")
    covered = _not_first(windows, ["h", "check"], place, firsts).select("doc", "rank", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))
    spans.append(stored(covered, "spans"))
    discard(windows, firsts)
    gathered = spans[0].unionByName(spans[1]).unionByName(spans[2]).groupBy("doc", "rank").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    out = stored(gathered, "spans")
    discard(*spans)
    return out


#: Bytes that the first ranks of prefix doubling are sorted by.
START = 16


def _start_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every position with its next START bytes as two numbers, big-endian, so that they sort as the bytes do."""
    for b in batches:
        for doc, rank, text in zip(b["doc"], b["rank"], b["text"], strict=True):
            data = _bytes(text)
            n = len(data) - START + 1
            if n > 0:
                eight = np.zeros(len(data) - 7, np.uint64)
                for k in range(8):
                    eight = eight << np.uint64(8) | data[k : len(data) - 7 + k].astype(np.uint64)
                # Signed numbers sort as unsigned ones do when the top bit is turned.
                eight = (eight ^ np.uint64(1 << 63)).view(np.int64)
                yield pd.DataFrame({"doc": doc, "rank": rank, "at": np.arange(n, dtype=np.int32), "a": eight[:n], "b": eight[8 : 8 + n]})


def doubled_spans(numbered: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same spans as ``repeated_spans`` by prefix doubling over all positions.

    Positions are sorted by pairs of ranks, of their own and of the position as many bytes
    on as the ranks cover, and ranked anew by the pairs' order; positions whose pair is
    unique leave. Ranks are places in a sort, not hashes. Every round shuffles all
    positions that are left, so that this needs many times the input on disk.
    """
    if length < START:
        raise ValueError(f"strings have {START} bytes or more")

    def reranked(pairs: DataFrame) -> DataFrame:
        twice = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").orderBy("a", "b")
        ranks = stored(twice.select("a", "b", F.monotonically_increasing_id().alias("r")), "ranks")
        out = stored(pairs.join(ranks, ["a", "b"]).select("doc", "rank", "at", "r"), "ranked")
        discard(ranks)
        return out

    now = reranked(numbered.mapInPandas(lean(_start_rows), "doc long, rank long, at int, a long, b long"))
    covered = START
    while covered < length:
        step = min(covered, length - covered)
        later = now.select("doc", "rank", (F.col("at") - step).alias("at"), F.col("r").alias("b"))
        last, now = now, reranked(now.withColumnRenamed("r", "a").join(later, ["doc", "rank", "at"]))
        discard(last)
        covered += step
    place = ["doc", "rank", "at"]
    firsts = stored(now.groupBy("r").agg(F.min(F.struct(*place)).alias("place")), "firsts")
    spans = _not_first(now, ["r"], place, firsts).groupBy("doc", "rank").agg(F.collect_list(F.struct(F.col("at").alias("begin"), (F.col("at") + length).alias("end"))).alias("spans"))
    out = stored(spans, "spans")
    discard(now, firsts)
    return out


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that overlap or touch."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    opens = np.ones(len(begin), bool)
    opens[1:] = begin[1:] > reach[:-1]
    return begin[opens], reach[np.append(opens[1:], True)] if len(reach) else reach


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, text, spans in zip(b["doc"], b["text"], b["spans"], strict=True):
            data = _bytes(text)
            spans = [] if spans is None else spans
            begin, end = merged(np.array([s["begin"] for s in spans], np.int64), np.array([s["end"] for s in spans], np.int64))
            keep = np.ones(len(data), bool)
            for x, y in zip(begin, end, strict=True):
                keep[x:y] = False
            rest = data[keep].tobytes()
            rows.append((doc, len(data), len(data) - len(rest), len(begin), hashlib.sha256(rest).hexdigest(), rest))
        yield pd.DataFrame(rows, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame, length: int = LENGTH, doubling: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of ``docs``.

    ``doubling`` ranks all positions by prefix doubling in place of chosen ones, with the
    same result.

    Texts are UTF-8 bytes, null ones empty; a byte goes if a string of ``length`` bytes over
    it also starts earlier: in a smaller id (null comes first) or earlier in the same text.
    Rows that repeat an id come in the order of their texts' hashes; rows equal in both are
    one document, each with the same result. No rows: no rows. Other columns are ignored.
    """
    numbered = _numbered(docs)
    spans = doubled_spans(numbered, length) if doubling else repeated_spans(numbered, length)
    joined = numbered.join(spans, ["doc", "rank"], "left").select("doc", "text", "spans")
    out = joined.mapInPandas(lean(_finish), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    doc_id = F.when(F.col("doc") != F.lit(-(2**63)), F.col("doc"))
    return out.select(doc_id.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def substrings_digest(docs: DataFrame) -> DataFrame:
    """One row per document: sizes, removed runs and the hash of what is kept."""
    return deduplicated(docs.select("doc_id", "text")).drop("kept")
