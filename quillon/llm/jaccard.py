"""Exact self-join of documents by the Jaccard similarity of their word n-grams.

Equal sets form one class. Every class puts its rarest tokens, in order, into an inverted
index: as many as guarantee that similar sets meet in a list. An entry knows its set's size
and its own position, which bound what two sets can still share, so that lists are skipped
in blocks: an entry reads only those sizes that its position leaves possible.

Only short lists are searched pair by pair. A few centres of each longer list are compared
with its other entries first; whoever links with a centre shares its component, and pairs
within a component need no further answer. Entries outside a list's largest component are then
matched with a bounded number of others at a time, until few pairs are left across
components, and these are compared without exception. Distances to a list's first centre
rule out pairs by the triangle inequality, so that a set's remaining comparisons follow
from those of the similar set. A pair that is left is weighed by bitmaps of the parities of
the sets' tokens, which bound the intersection from above, and if that does not settle it,
compared token by token.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.graph import components
from quillon.llm.lean import lean, released
from quillon.llm.names import fresh
from quillon.llm.store import discard, stored
from quillon.llm.words import WordHashes, shingles

#: Words in a shingle; least similarity in hundredths.
LENGTH, PERCENT = 4, 85
#: Shingles a task counts before it reports those it has seen REPEATED times; frequent ones remembered (8 bytes each).
COUNTED, REPEATED, FREQUENT = 2_000_000, 3, 1 << 20
#: Centres of a list, others that an entry is matched with in a round, and rounds at most before all pairs that are left are compared.
CENTRES, PARTNERS, ROUNDS = 4, 32, 6
#: Pairs for each entry of a list that the last step may compare without one more round.
ENOUGH = 2
#: Entries of a list whose pairs are all compared at once, at most.
SHORT = 5
#: Tokens of a set for each 64-bit word of its bitmap, at most; words of the smallest bitmap.
DENSE, SMALLEST = 64, 8
#: Blocks of sizes between two sizes of which the larger just links with the smaller.
FINE = 4
#: Wanted rows up to which their keys are broadcast (16 bytes each); beyond, a filter of 16 bits for each of them selects rows, of this many 64-bit words at most (32 MB).
FEW_WANTED, FILTER_WORDS = 1 << 17, 1 << 22


def needed(n: Column, m: Column, percent: int) -> Column:
    """Least intersection that links sets of these sizes."""
    return F.ceil((n + m) * percent / F.lit(100.0 + percent) - 1e-9)


def _frequent(docs: DataFrame, length: int) -> np.ndarray:
    """Frequency classes of frequent shingles, as two rows: sorted hashes, class.

    Every shingle of every document is counted; tasks report those that repeat among
    COUNTED shingles. The result only orders tokens, so its bound (8 MB of hashes) cannot
    lose a link.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, n = WordHashes(), [], 0

        def report() -> pd.DataFrame:
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            return pd.DataFrame({"h": h[c >= REPEATED].view(np.int64), "c": c[c >= REPEATED]})

        for batch in batches:
            for text in batch["text"]:
                held.append(shingles(text, length, hashes))
                n += len(held[-1])
                if n >= COUNTED:
                    out = report()
                    held, n = [], 0
                    yield out
        yield report()

    counted = docs.select("text").mapInPandas(lean(count), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    table = stored(counted, "frequent")
    top = table.orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas()
    discard(table)
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(h)
    out = np.stack([h[order], np.minimum(255, 1 + 8 * np.log2(np.maximum(c[order], 1))).astype(np.uint64)])
    del top, h, c, order
    released()
    return out


def keyed(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Tokens as keys in the common order: frequency class in the top byte, then the hash."""
    keys = tokens >> np.uint64(8)
    if frequent.shape[1] and len(tokens):
        at = np.minimum(np.searchsorted(frequent[0], tokens), frequent.shape[1] - 1)
        keys = keys | np.where(frequent[0][at] == tokens, frequent[1][at], np.uint64(0)) << np.uint64(56)
    return np.sort(keys)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of which a linked set must share one."""
    return n - -(-n * percent // 100) + 1 if n else 0


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """For each cell of a bitmap, whether an odd number of tokens falls there.

    Two sets' bitmaps differ in no more cells than the sets differ in tokens.
    """
    words = SMALLEST
    while words * DENSE < len(tokens):
        words *= 2
    odd = np.bincount((tokens & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def differing(a: Column, b: Column) -> Column:
    """Cells in which two bitmaps differ, at least; a longer one is folded to the length of the other."""

    def fold(x: Column, n: Column) -> Column:
        half = F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda i, j: i.bitwiseXOR(j))
        return F.when(F.size(x) > n, half).otherwise(x)

    apart = F.zip_with(fold(a, F.size(b)), fold(b, F.size(a)), lambda i, j: F.bit_count(i.bitwiseXOR(j)))
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * F.least(F.size(a), F.size(b)), F.aggregate(apart, F.lit(0), lambda acc, x: acc + x)).otherwise(0)


def sets(docs: DataFrame, length: int = LENGTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row_key, n, sig, prefix, bits) of every document.

    That is the hash of id and text, the set's size, its digest, its rarest keys in order
    and its bitmap.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, length))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, known = WordHashes(), frequent.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                tokens = shingles(text, length, hashes)
                prefix = keyed(tokens, known)[: prefix_length(len(tokens), percent)]
                rows.append((len(tokens), xxhash.xxh3_128_digest(tokens.tobytes()), prefix.view(np.int64), bitmap(tokens)))
            out = pd.DataFrame(rows, columns=["n", "sig", "prefix", "bits"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out.insert(1, "row_key", batch["row_key"].to_numpy())
            yield out

    # Ids travel as text, so that null ids survive pandas.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), _row_key().alias("row_key"), "text")
    made = rows.mapInPandas(lean(make), "doc_id string, row_key long, n long, sig binary, prefix array<long>, bits array<long>")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _class_id(salt: int) -> Column:
    """The short id of a class, from the digest of its set."""
    return F.xxhash64("sig", F.lit(salt))


def _filter(wanted: DataFrame, n: int) -> np.ndarray:
    """A bit filter over row keys, of 16 bits for each and FILTER_WORDS words at most."""
    words = min(FILTER_WORDS, 1 << max(10, int(n).bit_length() - 2))
    cell = F.pmod("row_key", F.lit(words * 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))
    bits = np.zeros(words, np.int64)
    by_slot = wanted.select(F.floor(cell / 64).cast("int").alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    found = by_slot.toPandas()
    bits[found["slot"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def _tokens(docs: DataFrame, wanted: DataFrame, length: int, salt: int) -> DataFrame:
    """(id, tokens) of the wanted classes (id, row_key): whole sets, computed again from one row of each.

    Few row keys are broadcast, a bit filter of bounded size stands for many; what it
    lets through by chance the join drops.
    """
    n = wanted.count()
    rows = docs.select(_row_key().alias("row_key"), "text")
    if n <= FEW_WANTED:
        rows, shared = rows.join(F.broadcast(wanted.select("row_key")), "row_key", "left_semi"), None
    else:
        shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted, n))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            keys, texts = b["row_key"].to_numpy(np.int64), b["text"]
            if shared is not None:
                cell = (keys % (64 * len(shared.value))).astype(np.int64)
                some = shared.value[cell >> 6] >> (cell & 63).astype(np.uint64) & np.uint64(1) == 1
                keys, texts = keys[some], texts[some]
            tokens = [shingles(text, length, hashes) for text in texts]
            lists = {"sig": [xxhash.xxh3_128_digest(t.tobytes()) for t in tokens], "tokens": [t.view(np.int64) for t in tokens]}
            yield pd.DataFrame({"row_key": keys} | {c: pd.Series(x, dtype=object) for c, x in lists.items()})

    made = rows.mapInPandas(lean(make), "row_key long, sig binary, tokens array<long>").withColumn("id", _class_id(salt))
    made = made.join(wanted, ["id", "row_key"], "left_semi") if shared is not None else made
    # Only rows that repeat both id and text are here more than once.
    return made.groupBy("id").agg(F.first("tokens").alias("tokens"))


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(u, v, low, high, linked) of pairs of classes from their whole sets: the distance twice."""

    def side(x: str) -> DataFrame:
        return tokens.select(F.col("id").alias(x), F.col("tokens").alias(f"t{x}"))

    met = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
    both = met.select("u", "v", F.size(F.array_intersect("tu", "tv")).alias("both"), (F.size("tu") + F.size("tv")).alias("n"))
    either = F.col("n") - F.col("both")
    distance = 1 - F.col("both") / either
    return both.select("u", "v", distance.alias("low"), distance.alias("high"), (F.col("both") * 100 >= either * percent).alias("linked"))


class _Join:
    """The state of one join: its classes and lists, the answers so far and the components they give."""

    def __init__(self, docs: DataFrame, length: int, percent: int):
        self.docs, self.length, self.percent, self.seen = docs, length, percent, 0
        wide = stored(sets(docs, length, percent), "sets")
        classes = self._classes(wide)
        self.members = stored(wide.select("doc_id", "row_key", "n", F.when(F.col("n") > 0, _class_id(self.salt)).alias("id")), "members")
        discard(wide)
        entries = classes.select("id", "n", F.posexplode("prefix").alias("at", "token"))
        # Of two linked sets the one that is not larger has their first common token this early.
        early = F.col("at") <= F.col("n") - needed(F.col("n"), F.col("n"), percent)
        met = entries.groupBy("token").agg(F.count("*").alias("k"), F.bool_or(early).alias("early")).where("k > 1 and early")
        met = stored(met.select("token", "k"), "met")
        self.lists = stored(entries.join(met, "token").select("token", "id", F.col("n").cast("int").alias("n"), F.col("at").cast("int").alias("at"), "k"), "lists")
        self.classes = stored(classes.select("id", "row_key", "n", "bits"), "classes")
        discard(met, classes)
        self.answers: DataFrame | None = None
        self.tables: list[DataFrame] = [self.members, self.lists, self.classes]
        self.labels: DataFrame | None = None

    def _classes(self, wide: DataFrame) -> DataFrame:
        """(id, n, row_key, prefix, bits): one row per distinct set, with a short id that no other has."""
        grouped = wide.where("n > 0").groupBy("sig").agg(F.max("n").alias("n"), F.min("row_key").alias("row_key"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
        for self.salt in itertools.count():
            classes = stored(grouped.select(_class_id(self.salt).alias("id"), "n", "row_key", "prefix", "bits"), "classes")
            if classes.groupBy("id").count().where("count > 1").isEmpty():
                return classes
            discard(classes)

    def ask(self, pairs: DataFrame) -> None:
        """Compare pairs (u, v) of classes that were not compared before; keep the answers and the components they give."""
        weighed = stored(self.weighed(pairs), "weighed")
        likely = weighed.where("likely")
        names = likely.select(F.col("u").alias("id")).union(likely.select("v")).distinct()
        wanted = stored(self.classes.select("id", "row_key").join(names, "id", "left_semi"), "wanted")
        tokens = stored(_tokens(self.docs, wanted, self.length, self.salt), "tokens")
        settled = weighed.where("not likely").select("u", "v", "low", F.lit(1.0).alias("high"), F.lit(False).alias("linked"))
        found = stored(_verified(likely, tokens, self.percent).unionByName(settled), "answers")
        discard(tokens, wanted, weighed)
        self.tables.append(found)
        self.answers = found if self.answers is None else self.answers.unionByName(found)
        links = found.where("linked").select("u", "v")
        if self.labels is not None:
            links = links.unionByName(self.labels.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")))
        before, self.labels = self.labels, components(links)
        discard(before)

    def weighed(self, pairs: DataFrame) -> DataFrame:
        """(u, v, low, likely): a bound of each pair's distance from the bitmaps, and whether it leaves a link possible."""
        side = lambda x, k: self.classes.select(F.col("id").alias(x), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"b{k}"))
        met = pairs.select("u", "v").join(side("u", 1), "u").join(side("v", 2), "v")
        n = F.col("n1") + F.col("n2")
        both = met.select("u", "v", n.alias("n"), needed(F.col("n1"), F.col("n2"), self.percent).alias("need"), F.floor((n - differing(F.col("b1"), F.col("b2"))) / 2).alias("most"))
        return both.select("u", "v", (1 - F.col("most") / (F.col("n") - F.col("most"))).alias("low"), (F.col("most") >= F.col("need")).alias("likely"))

    def new(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v, ...) that have no answer yet."""
        return pairs if self.answers is None else pairs.join(self.answers.select("u", "v"), ["u", "v"], "left_anti")

    def near(self, a: Column, b: Column) -> Column:
        """Whether the sizes of two sets let them link."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def fits(self, n: Column, at: Column, m: Column, at2: Column) -> Column:
        """Whether sizes and positions of two entries of a list let their sets link, if this is their first common token."""
        return self.near(n, m) & (F.least(n - at, m - at2) >= needed(n, m, self.percent))

    def centres(self) -> tuple[DataFrame, DataFrame]:
        """The centres of every list of more than SHORT entries, drawn by hash, and the pairs of its entries with them; all pairs of a shorter list.

        Draws can meet in one entry, so a short list's centres may be too few to answer it.
        """
        short, long = self.lists.where(F.col("k") <= SHORT), self.lists.where(F.col("k") > SHORT)
        one = lambda k: F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("draw"), "id", "n", "at"))
        drawn = stored(long.groupBy("token").agg(F.array(*map(one, range(CENTRES))).alias("centres")), "centres")
        met = long.join(drawn, "token").withColumn("c", F.explode(F.array_distinct("centres"))).select("id", "n", "at", "c.id", "c.n", "c.at")
        each = short.groupBy("token").agg(F.collect_list(F.struct("id", "n", "at")).alias("all")).select("all", F.posexplode("all").alias("k", "e"))
        each = each.withColumn("c", F.explode(F.slice("all", F.col("k") + 2, F.lit(SHORT)))).select("e.id", "e.n", "e.at", "c.id", "c.n", "c.at")
        pairs = met.union(each).toDF("id", "n", "at", "id2", "n2", "at2")
        pairs = pairs.where((F.col("id") != F.col("id2")) & self.fits(F.col("n"), F.col("at"), F.col("n2"), F.col("at2")))
        return drawn, pairs.select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v")).distinct()

    def measured(self, drawn: DataFrame) -> DataFrame:
        """Entries of the lists of more than SHORT entries, with bounds of the distance to the first centre where they are known."""
        entries = self.lists.where(F.col("k") > SHORT).join(drawn.select("token", F.col("centres")[0]["id"].alias("c")), "token")
        entries = entries.withColumns({"u": F.least("id", "c"), "v": F.greatest("id", "c")})
        known = entries.join(self.answers.select("u", "v", "low", "high"), ["u", "v"], "left")
        bound = lambda c: F.when(F.col("u") == F.col("v"), 0.0).otherwise(F.col(c)).alias(c)
        return known.select("token", "id", "n", "at", bound("low"), bound("high"))

    def open_lists(self, entries: DataFrame) -> DataFrame:
        """Entries with their components, and their list's entries and largest component, of the lists that hold more than one."""
        label = self.labels.select(F.col("node").alias("id"), F.col("component").alias("label"))
        labelled = entries.select("token", "id", "n", "at", "low", "high").join(label, "id", "left")
        labelled = stored(labelled.withColumn("component", F.coalesce("label", "id")).drop("label"), "labelled")
        by = labelled.groupBy("token", "component").agg(F.count("*").alias("k"))
        state = by.groupBy("token").agg(F.sum("k").alias("total"), F.max(F.struct("k", "component")).alias("major"))
        state = stored(state.where("major.k < total").select("token", "total", F.col("major.component").alias("major")), "state")
        opened = stored(labelled.join(state, "token"), "open")
        discard(labelled, state)
        return opened

    def across(self, few: DataFrame, entries: DataFrame, by: str) -> DataFrame:
        """Pairs (u, v) of an entry outside its list's largest component with others that neither component, size, position nor distance rules out."""
        few = few.select("token", by, *[F.col(c).alias(f"{c}2") for c in ("id", "n", "at", "component", "low", "high")])
        # The distances of linked sets to a third differ by no more than their own.
        close = F.coalesce(F.greatest(F.col("low") - F.col("high2"), F.col("low2") - F.col("high")) <= 1 - self.percent / 100 + 1e-9, F.lit(True))
        met = few.join(entries, ["token", by])
        met = met.where((F.col("component") != F.col("component2")) & self.fits(F.col("n"), F.col("at"), F.col("n2"), F.col("at2")) & close)
        return met.select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v"), F.ceil(F.col("total") / PARTNERS).alias("share"))

    def matched(self, entries: DataFrame, seed: int) -> DataFrame:
        """(u, v, share): a random part of the pairs that are left, one in ``share`` of a list's."""
        drawn = entries.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("total") / PARTNERS)))
        return self.across(drawn.where("component <> major"), drawn, "bucket")

    def rest(self, entries: DataFrame) -> DataFrame:
        """All pairs that are left. Lists are read in blocks of sizes: an entry skips those that its size or position rules out."""
        step = float(np.log(100 / self.percent)) / FINE
        block = lambda n: F.floor(F.log(n) / step)
        # An entry's position bounds its partner's size: needed(n, m) <= n - at.
        most = F.least(F.col("n") * 100 / float(self.percent), (F.col("n") - F.col("at")) * ((100.0 + self.percent) / self.percent) - F.col("n"))
        least = F.col("n") * self.percent / 100.0
        few = entries.where("component <> major").withColumns({"first": block(least - 1e-6), "last": block(most + 1e-6)}).where("first <= last")
        few = few.withColumn("block", F.explode(F.sequence("first", "last")))
        return self.across(few, entries.withColumn("block", block(F.col("n"))), "block")

    def run(self) -> None:
        drawn, pairs = self.centres()
        pairs = stored(pairs, "pairs")
        self.ask(pairs)
        entries = stored(self.measured(drawn), "entries")
        discard(pairs, drawn)
        for seed in range(1, ROUNDS + 2):
            opened = self.open_lists(entries)
            discard(entries)
            entries, size = opened, opened.count()
            if not size:
                break
            last = seed > ROUNDS
            found = self.rest(entries) if last else self.matched(entries, seed)
            pairs = stored(self.new(found.groupBy("u", "v").agg(F.max("share").alias("share"))), "pairs")
            # Each pair found in a list stands for as many that were not drawn.
            row = pairs.agg(F.count("*").alias("n"), F.sum("share").alias("left")).first()
            if row.n:
                self.ask(pairs)
            discard(pairs)
            if last:
                break
            if (row.left or 0) <= ENOUGH * size:
                opened = self.open_lists(entries)
                pairs = stored(self.new(self.rest(opened).select("u", "v").distinct()), "pairs")
                if not pairs.isEmpty():
                    self.ask(pairs)
                discard(pairs, opened)
                break
        discard(entries)

    def named(self) -> DataFrame:
        """(doc_id, row_key, n, component) of every document."""
        label = self.labels.select(F.col("node").alias("id"), "component")
        return self.members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def result(self) -> DataFrame:
        """(doc_id, n, component_id) of every document."""
        # A table of its own, so that the join below can split a large component's rows.
        least = stored(self.named().where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
        own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
        out = stored(self.named().join(least, "component", "left").select("doc_id", "n", own.alias("component_id")), "joined")
        discard(self.labels, least, *self.tables)
        return out

    def spare(self) -> tuple[DataFrame, DataFrame]:
        """Row keys that are not the first of their component, and first ones that several equal rows have."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
        best = stored(self.named().where("n > 0").groupBy("component").agg(first).select("component", F.col("first.row_key").alias("kept")), "best")
        gone = stored(self.named().where("n > 0").join(best, "component").where("row_key <> kept").select("row_key").distinct(), "gone")
        twice = self.members.where("n > 0").groupBy("row_key").agg(F.count("*").alias("k")).where("k > 1").select("row_key")
        twice = stored(twice.join(gone, "row_key", "left_anti"), "twice")
        discard(self.labels, best, *self.tables)
        return gone, twice


def jaccard_components(docs: DataFrame, length: int = LENGTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets of
    distinct ``length``-word shingles; component_id is the least doc_id reachable by links,
    the row's own where it links with nothing. Null, empty and wordless texts have empty
    sets and link with nothing. Rows with null ids link like others but name no component;
    rows that repeat an id each have their own set. No rows: no rows. Other columns are ignored.
    """
    join = _Join(docs.select("doc_id", "text"), length, percent)
    join.run()
    return join.result().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def without_near_duplicates(docs: DataFrame, length: int = LENGTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component of linked documents: that of the least id, null last.

    Of rows that are equal in id and text one stays. Rows without words link with nothing
    and all stay. No rows: no rows. Other columns pass through, whatever their names.
    """
    join = _Join(docs.select("doc_id", "text"), length, percent)
    join.run()
    gone, twice = join.spare()
    (key, row) = fresh(docs, "row_key", "row")
    keyed = docs.withColumn(key, _row_key())
    named = gone.select(F.col("row_key").alias(key))
    rest = keyed.join(F.broadcast(named) if gone.count() <= FEW_WANTED else named, key, "left_anti")
    if twice.isEmpty():
        return rest.drop(key)
    some = twice.select(F.col("row_key").alias(key))
    once = W.partitionBy(key).orderBy(F.lit(0))
    again = rest.join(some, key, "left_semi").withColumn(row, F.row_number().over(once)).where(F.col(row) == 1).drop(row)
    return rest.join(some, key, "left_anti").unionByName(again).drop(key)
