"""Benchmark decontamination through templates.

Numbers, names and units become typed placeholders, so that a question asked again with
other parameters keeps its template. Windows of template tokens of documents and items
meet by hash, and so do windows of the plain case-folded words. Windows on neighbouring
displacements are chained in order, so that inserted, lost and changed tokens do not hide
an item; the values that stood in the slots must then map one to one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.lean import lean
from quillon.llm.names import fresh
from quillon.llm.store import stored
from quillon.llm.words import MEMORY, mixed

#: Tokens in a window (short items have shorter ones), and the share of an item's tokens that a leak's windows cover.
WINDOW, SHARE = 8, 0.6
#: Items of fewer tokens match verbatim alone, and where they stand as a sentence or line of their own.
LEAST = 4
#: Shortest window of an item of WINDOW tokens or more, and covered tokens that are enough of an item of any length.
SHORTEST, PART = 5, 20
#: Documents whose tokens are hashed at once.
CHUNK = 128
#: Words of a filter over the items' window hashes, 64 bits each: a fixed 1 MB, whatever the items.
FILTER_WORDS = 1 << 17
#: Units of measure, fixed values.
UNITS = frozenset("km m cm mm mile miles mi ft feet foot inch inches yard yards kg g mg lb lbs pound pounds ounce ounces oz ton tons hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent mph kmh litre litres liter liters ml gallon gallons degree degrees".split())
#: Signs and the words that say the same.
SIGNS = {"$": "dollars", "€": "euros", "£": "pounds", "%": "percent", "°": "degrees"}
_TOKEN = re.compile(r"[^\W_]+(?:[.,][0-9]+)*|[.!?\n]|[%$€£°]")
_PIECE = re.compile(r"[^\W_]+(?:[.,][0-9]+)*|[.!?\n:;,()\"“”]|[%$€£°]")
_NUMBER = re.compile(r"[0-9]+(?:[.,][0-9]+)*\Z")
_STOP = frozenset(".!?\n")
#: Marks after which a capital says nothing, and marks that merely part slots.
_START, _BREAK = frozenset(".!?\n:\"“("), frozenset(";,)”")
#: Kinds of tokens, in the low bits of their hashes.
_WORD, _STOPPED, _PARTED, _NUM, _SIGN, _UNIT, _CAPITAL, _UNIT_CAPITAL, _KNOWN = range(9)
_KIND = np.uint64(15)
#: Streams: plain words; templates of long items; templates of items under WINDOW tokens, whose sentence starts stay words.
_PLAIN, _LONG, _BRIEF = range(3)
#: What stands for a slot.
_NAME_SLOT, _NUMBER_SLOT = np.uint64(16), np.uint64(32)


def template(text: str | None) -> tuple[list[str], list[str]]:
    """Template tokens of a text and, beside each, the value of its slot (empty if none).

    A name is a capitalised word inside a sentence whose other letters are not all
    capitals; a unit is a known word or sign right after a number. Everything else is a
    lower-case word; punctuation leaves no token.
    """
    tokens, values, first, number = [], [], True, False
    for t in _TOKEN.findall(text or ""):
        if t in _STOP:
            first, number = True, False
            continue
        low, value = t.lower(), ""
        if _NUMBER.match(t):
            out, value = "<num>", t
        elif number and (low in UNITS or not t[0].isalnum()):
            out, value = "<unit>", low
        elif not t[0].isalnum():
            continue
        elif not first and t[0].isupper() and t[1:].islower():
            out, value = "<name>", low
        else:
            out = low
        number, first = out == "<num>", False
        tokens.append(out)
        values.append(value)
    return tokens, values


def admitted(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold: a clear bit means that no item has the window."""
    return words[(h >> np.uint64(6)) % np.uint64(len(words))] >> (h & np.uint64(63)) & np.uint64(1) == 1


class _Pieces(dict):
    """Hash of a token's lower-case form with its kind, computed once while remembered."""

    def __missing__(self, t: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        low, first = t.lower(), t[0]
        h = xxhash.xxh3_64_intdigest(low) & ~15
        if first.isalpha():
            capital = first.isupper() and t[1:].islower()
            if low in UNITS:
                kind = _UNIT_CAPITAL if capital else _UNIT
            else:
                kind = _CAPITAL if capital else _WORD
        elif t in _START:
            kind = _STOPPED
        elif t in _BREAK:
            kind = _PARTED
        elif t in SIGNS:
            kind = _SIGN
        else:
            kind = _NUM if _NUMBER.match(t) else _WORD
        h = self[t] = h | kind
        return h


def _before(x: np.ndarray, first: np.ndarray, fill: int) -> np.ndarray:
    """The value before each place, ``fill`` at the start of a text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = fill
    return out


class _Texts:
    """Streams of some texts, one after the other; ``names`` is a filter over words that stand for names."""

    def __init__(self, texts: list[str], pieces: _Pieces, names: np.ndarray | None = None):
        found = [_PIECE.findall(t) for t in texts]
        self.raw = [t for f in found for t in f]
        packed = np.fromiter(map(pieces.__getitem__, self.raw), np.uint64, len(self.raw))
        self.owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        kind = (packed & _KIND).astype(np.int8)
        self.hash = packed & ~_KIND
        if names is not None:
            kind[(kind == _WORD) & admitted(names, mixed(self.hash))] = _KNOWN
        first = np.flatnonzero(np.diff(self.owner, prepend=-1))
        before = _before(kind, first, _STOPPED)
        after = np.append(kind[1:], np.int8(_STOPPED))
        self.start = before == _STOPPED
        # Where nothing but marks that part slots stands before the end of a sentence, line or text.
        ends = np.append(self.owner[1:] != self.owner[:-1], True) if len(kind) else np.empty(0, bool)
        self.stop = ends | (after == _STOPPED)
        said = (kind == _WORD) | (kind == _KNOWN) | (kind == _NUM) | (kind == _UNIT) | (kind == _CAPITAL) | (kind == _UNIT_CAPITAL)
        unit = ((kind == _UNIT) | (kind == _UNIT_CAPITAL) | (kind == _SIGN)) & (before == _NUM)
        number = (kind == _NUM) | unit | (kind == _SIGN) & (after == _NUM)
        self.capital = ((kind == _CAPITAL) | (kind == _UNIT_CAPITAL)) & ~unit
        name = self.capital | (kind == _KNOWN)
        self.first, self.said, self.number = first, said, number
        self.slot = {_LONG: self._slots(name), _BRIEF: self._slots(self.capital & ~self.start | (kind == _KNOWN))}

    def _slots(self, name: np.ndarray) -> np.ndarray:
        """1 for a token of a name's slot, 2 of a number's, else 0."""
        return np.where(self.number, 2, name).astype(np.int8)

    def stream(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the tokens of a stream; a run of one kind of slot is one token."""
        if which == _PLAIN:
            at = np.flatnonzero(self.said)
            return at, self.hash[at]
        slot = self.slot[which]
        at = np.flatnonzero((self.said | (slot > 0)) & ((slot == 0) | (_before(slot, self.first, 0) != slot)))
        return at, np.where(slot[at] == 1, _NAME_SLOT, np.where(slot[at] == 2, _NUMBER_SLOT, self.hash[at]))

    def value(self, which: int, at: int) -> str:
        """What stands in the slot that begins at a place: the names, or the numbers and then the units."""
        slot, end = self.slot[which], at + 1
        while end < len(slot) and slot[end] == slot[at] and self.owner[end] == self.owner[at]:
            end += 1
        said = [SIGNS.get(t, t.lower()) for t in self.raw[at:end]]
        return " ".join(said if slot[at] == 1 else sorted(said))

    def certain(self, which: int, at: int) -> bool:
        """Whether a slot holds a name for sure: more than a capital that may only begin a sentence."""
        slot = self.slot[which]
        if slot[at] == 2 or not self.start[at] or at + 1 < len(slot) and slot[at + 1] == 1 and self.owner[at + 1] == self.owner[at]:
            return True
        return bool(((self.hash == self.hash[at]) & (self.owner == self.owner[at]) & self.capital & ~self.start).any())


def _window_of(n: int) -> int:
    """Window length of an item: of two halves around a changed token, both hold one."""
    return n if n < WINDOW else min(WINDOW, max(SHORTEST, (n - 1) // 2))


def _growing(h: np.ndarray, stream: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of the windows of each length up to ``most``."""
    out = np.full(len(h), np.uint64(stream + 1))
    with np.errstate(over="ignore"):
        for w in range(1, min(most, len(h)) + 1):
            out = mixed(out[: len(h) - w + 1] * np.uint64(0x9E3779B97F4A7C15) + h[w - 1 :])
            yield w, out


def _row(texts: _Texts, stream: int, at: np.ndarray, h: np.ndarray, i: int, w: int, item: bool) -> tuple[list[str], list[int]]:
    slots = []
    if stream != _PLAIN:
        for p in at[i : i + w].tolist():
            if texts.slot[stream][p]:
                slots.append(texts.value(stream, p) if not item or texts.certain(stream, p) else "")
    return slots, h[i : i + w].view(np.int64).tolist()


_WINDOW_SCHEMA = "id long, text_key long, h long, stream int, at int, place int, n int, w int, slots array<string>, tokens array<long>"
_WINDOW_COLUMNS = [c.split()[0] for c in _WINDOW_SCHEMA.split(", ")]


def _item_windows(names: np.ndarray, length: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _Pieces()
        for batch in batches:
            rows = []
            for id_, text in zip(batch["item_id"], batch["text"], strict=True):
                texts = _Texts([text], pieces, names)
                for stream in (_PLAIN, _LONG, _BRIEF):
                    at, h = texts.stream(stream)
                    n = len(h)
                    if n == 0 or (stream != _PLAIN and n < LEAST) or (stream == _LONG and n < WINDOW) or (stream == _BRIEF and n >= WINDOW):
                        continue
                    w = min(length, _window_of(n))
                    for k, hashes in _growing(h, stream, w):
                        if k == w:
                            signed = hashes.view(np.int64).tolist()
                            for i, x in enumerate(signed):
                                slots, tokens = _row(texts, stream, at, h, i, w, True)
                                # A list of names or numbers alone says nothing.
                                if stream == _PLAIN or w - len(slots) >= LEAST // 2:
                                    rows.append((id_, 0, x, stream, i, int(at[i]), n, w, slots, tokens))
            yield pd.DataFrame(rows, columns=_WINDOW_COLUMNS)

    return make


def _document_windows(names: np.ndarray, bits: np.ndarray, lengths: list[tuple[int, int]]):
    """The windows that the filter admits, of the streams and lengths that items have."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, wanted = _Pieces(), {s: {w for t, w in lengths if t == s} for s, _ in lengths}
        for batch in batches:
            rows = []
            ids, keys, said = batch["doc_id"].tolist(), batch["text_key"].tolist(), batch["text"].tolist()
            for low in range(0, len(said), CHUNK):
                texts = _Texts(said[low : low + CHUNK], pieces, names)
                for stream, some in wanted.items():
                    at, h = texts.stream(stream)
                    owner = texts.owner[at]
                    for w, hashes in _growing(h, stream, max(some)):
                        if w not in some:
                            continue
                        fits = owner[: len(hashes)] == owner[w - 1 :]
                        if w < LEAST:
                            fits &= texts.start[at[: len(hashes)]] & texts.stop[at[w - 1 :]]
                        hit = np.flatnonzero(admitted(bits, hashes) & fits)
                        for i in hit.tolist():
                            d = low + int(owner[i])
                            slots, tokens = _row(texts, stream, at, h, i, w, False)
                            rows.append((ids[d], keys[d], int(hashes[i].view(np.int64)), stream, i, int(at[i]), 0, w, slots, tokens))
            yield pd.DataFrame(rows, columns=_WINDOW_COLUMNS)

    return make


def _bits(hashes: DataFrame) -> np.ndarray:
    """A bit filter of fixed size over the column h."""
    slot = F.pmod(F.shiftrightunsigned("h", 6), F.lit(FILTER_WORDS)).cast("int").alias("slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int")).alias("bit")
    words = np.zeros(FILTER_WORDS, np.uint64)
    for r in hashes.select(slot, bit).groupBy("slot").agg(F.bit_or("bit").alias("bits")).collect():
        words[r.slot] = np.int64(r.bits).view(np.uint64)
    return words


def item_names(items: DataFrame) -> np.ndarray:
    """A filter over the words that items have as names inside a sentence and never in lower case.

    They stand for a name on both sides, however they are written.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _Pieces()
        for batch in batches:
            texts = _Texts(batch["text"].tolist(), pieces)
            small = np.array([t.islower() for t in texts.raw], bool)
            some = texts.capital & ~texts.start | small
            yield pd.DataFrame({"h": mixed(texts.hash[some]).view(np.int64), "small": small[some]})

    words = items.where("text is not null").select("text").mapInPandas(lean(make), "h long, small boolean")
    return _bits(words.groupBy("h").agg(F.bool_or("small").alias("small")).where("not small"))


def item_windows(items: DataFrame, length: int = WINDOW, names: np.ndarray | None = None) -> DataFrame:
    """Windows of the benchmark items: (item_id, h, stream, at, n, w, slots, tokens)."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    names = item_names(items) if names is None else names
    return rows.mapInPandas(lean(_item_windows(names, length)), _WINDOW_SCHEMA).drop("text_key", "place").withColumnRenamed("id", "item_id")


def _fits(mapping: tuple[dict, dict], a: list[str], b: list[str]) -> bool:
    """Extend a one-to-one mapping by the slots of a window; False, and no change, if they contradict it."""
    there, back = dict(mapping[0]), dict(mapping[1])
    for x, y in zip(a, b, strict=True):
        if x and (there.setdefault(x, y) != y or back.setdefault(y, x) != x):
            return False
    mapping[0].update(there)
    mapping[1].update(back)
    return True


def _chains(hits: list, n: int, w: int, share: float) -> Iterator[tuple[int, bool, bool, int, int]]:
    """(windows, one to one, same values, first and last place) of the chains that cover enough of an item.

    A chain starts from the windows at one displacement and takes in windows at
    neighbouring ones that keep the order, cover more and fit its mapping.
    """
    need = n if n < WINDOW else max(WINDOW, min(share * n, PART))
    reach = max(2, n // 4)
    by: dict[int, list] = {}
    for hit in hits:
        by.setdefault(hit[0] - hit[1], []).append(hit)
    shifts = sorted(by)
    for base in shifts:
        near = sorted((s for s in range(base - reach, base + reach + 1) if s != base and s in by), key=lambda s: (abs(s - base), s))
        if w * (len(by[base]) + sum(len(by[s]) for s in near)) < need:
            continue
        taken, mapping, covered, sound = [], ({}, {}), set(), True
        for hit in sorted(by[base]):
            sound &= _fits(mapping, hit[4], hit[3])
            taken.append(hit)
            covered.update(range(hit[1], hit[1] + w))
        for s in near:
            for hit in sorted(by[s]):
                if covered.issuperset(range(hit[1], hit[1] + w)):
                    continue
                if all((hit[0] < t[0]) == (hit[1] < t[1]) and hit[0] != t[0] and hit[1] != t[1] for t in taken) and _fits(mapping, hit[4], hit[3]):
                    taken.append(hit)
                    covered.update(range(hit[1], hit[1] + w))
        if len(covered) >= need:
            places = [t[2] for t in taken]
            yield len({t[1] for t in taken}), sound, all(x == y for x, y in mapping[0].items()), min(places), max(places)


def _judged(share: float):
    """Pairs of a text and an item from all windows that they share."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, item, hits in zip(batch["doc_id"], batch["item_id"], batch["hits"], strict=True):
                of: dict[tuple, list] = {}
                for x in hits:
                    of.setdefault((x["stream"], x["item_n"], x["w"]), []).append((x["at"], x["item_at"], x["place"], list(x["slots"]), list(x["item_slots"])))
                good, broken = [], []
                for (stream, n, w), some in sorted(of.items(), reverse=True):
                    for windows, sound, same, low, high in _chains(some, n, w, share):
                        if not sound:
                            broken.append((low, high))
                        elif stream != _PLAIN or not any(low <= b and a <= high for a, b in broken):
                            # Values decide in templates; plain words that are found have the same values.
                            good.append((stream != _PLAIN, windows, n - w + 1, same))
                if good:
                    typed = [g for g in good if g[0]] or good
                    best = max(good, key=lambda g: g[1] / g[2])
                    rows.append((doc, item, best[1], best[2], any(g[3] for g in typed)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "windows", "item_windows", "exact"])

    return judge


def leaks(docs: DataFrame, items: DataFrame, length: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, exact): items that a document contains.

    A document contains an item if a chain of windows, of plain words whatever their case
    or of the template, covers ``share`` of the item's tokens (at least WINDOW of them; PART
    are enough; items of fewer than WINDOW wholly, and of fewer than LEAST verbatim and as a
    sentence or line of its own) and the slot values map one to one. ``exact`` says that the
    values are the same. Null ids, null texts and texts without tokens on either side, and
    empty tables, yield nothing; rows that repeat a document yield its pairs once. Window
    hashes are confirmed token by token. Other columns are ignored.
    """
    names = item_names(items)
    known = item_windows(items, length, names).withColumnsRenamed({"slots": "item_slots", "at": "item_at", "n": "item_n", "tokens": "item_tokens"})
    lengths = sorted((r.stream, r.w) for r in known.select("stream", "w").distinct().collect())
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = rows.mapInPandas(lean(_document_windows(names, _bits(known), lengths)), _WINDOW_SCHEMA).withColumnRenamed("id", "doc_id").drop("n")
    met = found.join(known, ["h", "w", "stream"]).where("tokens = item_tokens")
    hits = met.groupBy("doc_id", "text_key", "item_id").agg(F.collect_set(F.struct("stream", "at", "item_at", "item_n", "w", "place", "slots", "item_slots")).alias("hits"))
    good = hits.select("doc_id", "item_id", "hits").mapInPandas(lean(_judged(share)), "doc_id long, item_id long, windows long, item_windows int, exact boolean")
    most = F.max_by(F.struct("windows", "item_windows"), F.col("windows") / F.col("item_windows"))
    best = good.groupBy("doc_id", "item_id").agg(most.alias("best"), F.bool_or("exact").alias("exact"))
    return best.select("doc_id", "item_id", "best.windows", "best.item_windows", "exact")


#: Leaked rows up to which their keys are broadcast (8 bytes each); beyond, they meet by a shuffle.
FEW_LEAKS = 1 << 17


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item, whatever their id.

    Rows without a text stay; other columns pass through, whatever their names. No rows: no
    rows; without items every row stays.
    """
    (key,) = fresh(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(docs["doc_id"], docs["text"]))
    found = leaks(keyed.select(F.col(key).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(key)).distinct()
    leaked = stored(found, "leaked")
    few = leaked.count() <= FEW_LEAKS
    return keyed.join(F.broadcast(leaked) if few else leaked, key, "left_anti").drop(key)
