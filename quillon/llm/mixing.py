"""Mixing sources to target weights in fixed-length blocks.

The words of each source form one stream, cut into blocks of a fixed length. A source's
target gives the slots that it fills; how many of them each output shard holds is a
multinomial draw. The slots of a shard are mapped through a pseudorandom permutation of the
source's blocks, one permutation for each pass over them, and meet the blocks by index.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.lean import lean
from quillon.llm.names import fresh
from quillon.llm.store import discard, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block, slots in an output shard on average, documents in a bucket, buckets in a group.
BLOCK, SHARD_SLOTS, BUCKET_DOCS, GROUP = 64, 1 << 15, 1000, 1000
#: Slots that a task maps at a time.
STRETCH = 1 << 16
WEIGHTS, MOST, ROUNDS = (5.0, 2.0, 1.0), 3, 16
#: What tells rows apart: id, source and text, with nulls made values.
KEY = ("id", "no_id", "origin", "text_hash")
#: Modulus and multiplier of the hashes behind permutations; products of two residues fit in a long.
PRIME, FACTOR = (1 << 31) - 1, 48271


def digest(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as SQL elsewhere computes them too."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def word_count() -> Column:
    """Words of the column ``text``; a null text has none."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _key() -> list[Column]:
    id_ = F.col("doc_id").cast("string")
    return [F.coalesce(id_, F.lit("")), id_.isNull(), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), F.coalesce(digest(F.col("text")), F.lit(0))]


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words of every document, and its KEY."""
    return docs.select("doc_id", "source", word_count().alias("size"), *[c.alias(n) for c, n in zip(_key(), KEY, strict=True)])


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: origin (its key), source, size, documents, weight and target.

    Weights repeat over the sources in code-point order, null last. Targets share the size
    of all sources by weight and stop at ``most`` times their own source's size; the excess
    is shared again until none is above. That fixed point fills sources in the order of
    size to weight: those before the level are full, the others share the rest. The
    windows run over one row per source, not over documents.
    """
    by_source = sized.groupBy("origin", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    index = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (index % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = filling.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = ranked.withColumn("level", left / open_weight).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.max(F.when(F.col("fits"), F.col("level"))).over(every)
    target = F.least(F.col("cap").cast("double"), F.coalesce(final * F.col("weight"), F.col("cap").cast("double")))
    return level.select("origin", "source", "source_size", "n_docs", "weight", target.alias("target"))


def permuted(index: Column, n: Column, salt: Column, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, by swap-or-not rounds, or its inverse.

    Each round reflects an index at a keyed point or leaves it, as a bit of the hash of the
    larger of the pair decides, so each round is its own inverse and every n is allowed.
    Keys and hashes are linear modulo PRIME, with multipliers that the salt, a number of 60 bits, gives.
    """

    def round_(x: Column, r: Column) -> Column:
        a, b = (salt % PRIME * (FACTOR + r) + r * r) % PRIME + 1, (F.shiftright(salt, 30) % PRIME * (FACTOR - r) + r) % PRIME
        mirror = F.pmod((a * PRIME + b) % n - x, n)
        larger = F.greatest(x, mirror)
        bit = F.floor((larger % PRIME * a % PRIME + F.shiftright(larger, 31) * FACTOR % PRIME + b) % PRIME * FACTOR % PRIME / F.lit(1 << 16)) % 2
        return F.when(bit == 1, mirror).otherwise(x)

    rounds = F.sequence(F.lit(ROUNDS).cast("long"), F.lit(1).cast("long"), F.lit(-1).cast("long")) if inverse else F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long"))
    return F.aggregate(rounds, index.cast("long"), round_)


def salted(origin: Column, turn: Column, seed: int) -> Column:
    """The salt of a source's permutation in one pass."""
    return digest(F.concat_ws(":", origin, turn.cast("string"), F.lit(str(seed))))


def permuted_array(x: np.ndarray, n: int, salt: int) -> np.ndarray:
    """``permuted`` for many indices of one permutation."""
    x = x.astype(np.int64)
    for r in range(1, ROUNDS + 1):
        a, b = (salt % PRIME * (FACTOR + r) + r * r) % PRIME + 1, ((salt >> 30) % PRIME * (FACTOR - r) + r) % PRIME
        mirror = ((a * PRIME + b) % n - x) % n
        larger = np.maximum(x, mirror)
        bit = ((larger % PRIME * a % PRIME + (larger >> 31) * FACTOR % PRIME + b) % PRIME * FACTOR % PRIME >> 16) & 1
        x = np.where(bit == 1, mirror, x)
    return x


def _expanded(block: int, seed: int):
    """The slots of a shard's count, mapped to blocks; STRETCH slots at a time."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for origin, n_blocks, n_slots, kept, shard, begin, count in batch.itertuples(index=False, name=None):
                for low in range(begin, begin + count, STRETCH):
                    slot = np.arange(low, min(low + STRETCH, begin + count), dtype=np.int64)
                    turn, to = slot // n_blocks, np.empty(len(slot), np.int64)
                    for t in np.unique(turn).tolist():
                        salt = int(hashlib.md5(f"{origin}:{t}:{seed}".encode()).hexdigest()[:15], 16)
                        to[turn == t] = permuted_array(slot[turn == t] % n_blocks, n_blocks, salt)
                    yield pd.DataFrame({"origin": origin, "slot": slot, "shard": shard, "block": to, "kept": np.where(slot == n_slots - 1, kept, block)})

    return expand


def blocks(sized: DataFrame, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pieces of documents that make up each source's blocks: (origin, block, KEY, begin, first, words).

    ``begin`` is a piece's place in its block and ``first`` its first word in its document.
    Offsets are running sums within small hashed buckets of a source, over groups of
    buckets, and over the groups, so that no window holds a whole source.
    """
    keyed = sized.where("size > 0").join(goals.select("origin", "n_docs"), "origin")
    keyed = keyed.withColumn("place", digest(F.concat_ws(":", "id", F.col("text_hash").cast("string"))))
    keyed = keyed.withColumn("bucket", F.col("place") % F.ceil(F.col("n_docs") / BUCKET_DOCS))
    totals = keyed.groupBy("origin", "bucket").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = totals.groupBy("origin", "group").agg(F.sum("words").alias("words"))
    sum_before = lambda by, order: F.coalesce(F.sum("words").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("origin", "group", sum_before(["origin"], "group").alias("start"))
    offsets = totals.withColumn("before", sum_before(["origin", "group"], "bucket")).join(groups, ["origin", "group"])
    offsets = offsets.select("origin", "bucket", (F.col("start") + F.col("before")).alias("offset"))
    within = W.partitionBy("origin", "bucket").orderBy("place", "no_id", "id", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    local = keyed.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = local.join(offsets, ["origin", "bucket"]).select(*KEY, "size", (F.col("offset") + F.col("local")).alias("at"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    pieces = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("at"), F.col("block") * block)
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - begin
    return pieces.select(*KEY, "block", (begin - F.col("block") * block).alias("begin"), (begin - F.col("at")).alias("first"), words.cast("long").alias("words"))


def passes(goals: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(origin, n_blocks, n_slots, kept): the slots that bring a source's words to its target, rounded.

    Whole passes over the blocks come first. In the last, the source's short block may be
    among the slots or not; the last slot keeps only the first ``kept`` words of its block.
    """
    own = goals.where("source_size > 0 and round(target) > 0").select("origin", F.ceil(F.col("source_size") / block).alias("n_blocks"), "source_size", F.round("target").cast("long").alias("want"))
    own = own.withColumns({"whole": F.floor(F.col("want") / F.col("source_size")), "lacks": F.col("n_blocks") * block - F.col("source_size")})
    own = own.withColumn("rest", F.col("want") - F.col("whole") * F.col("source_size"))
    own = own.withColumn("salt", salted(F.col("origin"), F.col("whole"), seed))
    own = own.withColumn("short_at", permuted(F.col("n_blocks") - 1, F.col("n_blocks"), F.col("salt"), inverse=True))
    most = F.ceil(F.col("rest") / block)
    lost = F.when(F.col("short_at") < most, F.col("lacks")).otherwise(0)
    some = F.ceil((F.col("rest") + lost) / block)
    # Of the last slot's block, what is beyond the target is not taken; a last slot that completes a pass is whole.
    over = some * block - F.when(F.col("short_at") < some, F.col("lacks")).otherwise(0) - F.col("rest")
    here = F.when(F.col("short_at") == some - 1, block - F.col("lacks")).otherwise(block)
    return own.select("origin", "n_blocks", (F.col("whole") * F.col("n_blocks") + some).alias("n_slots"), F.when(F.col("rest") > 0, here - over).otherwise(block).alias("kept"))


def _drawn(shards: int, seed: int):
    """Each source's slots dealt to the shards: multinomial counts, and where each shard's slots begin."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for origin, n_blocks, n_slots, kept in zip(batch["origin"], batch["n_blocks"], batch["n_slots"], batch["kept"], strict=True):
                rng = np.random.Generator(np.random.PCG64([seed, zlib.crc32(origin.encode()), len(origin)]))
                counts = rng.multinomial(n_slots, np.full(shards, 1 / shards))
                some = np.flatnonzero(counts)
                begin = np.cumsum(counts) - counts
                yield pd.DataFrame({"origin": origin, "n_blocks": n_blocks, "n_slots": n_slots, "kept": kept, "shard": some, "begin_slot": begin[some], "count": counts[some]})

    return draw


def counts(goals: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(origin, n_blocks, n_slots, kept, shard, begin_slot, count): how many slots of each source each output shard holds.

    Given the sources' totals, which stay at their targets, the counts are a multinomial draw.
    """
    per = stored(passes(goals, block, seed), "passes")
    slots = per.agg(F.sum("n_slots")).first()[0] or 0
    return per.mapInPandas(lean(_drawn(max(1, -(-slots // SHARD_SLOTS)), seed)), "origin string, n_blocks long, n_slots long, kept long, shard long, begin_slot long, count long")


def slots(goals: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix as slots: (origin, slot, shard, block, kept). Shards are dealt out before their slots are expanded."""
    # A number of partitions, as what is few now is many once it is expanded.
    parts = int(goals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts(goals, block, seed).repartition(parts, "origin", "shard")
    columns = ["origin", "n_blocks", "n_slots", "kept", "shard", "begin_slot", "count"]
    return dealt.select(columns).mapInPandas(lean(_expanded(block, seed)), "origin string, slot long, shard long, block long, kept long")


def _mix(sized: DataFrame, goals: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(shard, slot, block, KEY, first, words): the pieces that the mix takes."""
    # Slots are few bytes before they are expanded and many after: never to be broadcast.
    met = blocks(sized, goals, block).join(slots(goals, block, seed).hint("merge"), ["origin", "block"])
    words = F.least(F.col("words"), F.col("kept") - F.col("begin"))
    return met.select("shard", "slot", "block", *KEY, "first", words.alias("words")).where("words > 0")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Every piece of a document that the mix takes: (shard, source, slot, block, doc_id, text_hash, first, words).

    A piece is ``words`` words of the document from the ``first``; one that several slots
    draw comes once for each. Documents without words have no pieces; a null source is a
    source of its own. The same input and seed give the same mix. No rows: no rows.
    """
    sized = stored(sizes(docs), "sizes")
    goals = stored(targets(sized), "goals")
    id_ = F.when(~F.col("no_id"), F.col("id")).cast(docs.schema["doc_id"].dataType)
    source = F.when(F.col("origin") != "", F.expr("substring(origin, 2)"))
    return _mix(sized, goals, block, seed).select("shard", source.alias("source"), "slot", "block", id_.alias("doc_id"), "text_hash", "first", "words")


def _taken(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(KEY, rows, words): how many rows have each key and the words that the mix takes of them together."""
    rows = sized.groupBy(*KEY).agg(F.count("*").alias("rows"))
    drawn = _mix(sized, goals).groupBy(*KEY).agg(F.sum("words").alias("words"))
    return stored(rows.join(drawn, list(KEY), "left").select(*KEY, "rows", F.coalesce("words", F.lit(0)).cast("long").alias("words")), "taken")


def _shared(rows: DataFrame, key: list[str], n: str, words: str, taken: DataFrame) -> DataFrame:
    """``rows`` with the column ``words`` dealt out among rows of one key, the remainder to the first of them."""
    if taken.where("rows > 1").isEmpty():
        return rows
    (at,) = fresh(rows, "at")
    many = rows.where(F.col(n) > 1).withColumn(at, F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0))))
    part = lambda k: F.floor(F.col(words) * k / F.col(n)).cast("long")
    return rows.where(F.col(n) <= 1).unionByName(many.withColumn(words, part(F.col(at)) - part(F.col(at) - 1)).drop(at))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with size, source_size, target and taken, the words the mix takes of each row.

    Rows that are equal in id, source and text share their words evenly, the remainder
    going one word each to some of them. Columns of these names are replaced, others pass
    through whatever their names. No rows: no rows.
    """
    sized = stored(sizes(docs), "sizes")
    goals = stored(targets(sized), "goals")
    taken = _taken(sized, goals)
    rest = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    names = fresh(docs, *KEY, "rows", "words", "size", "source_size", "target", "taken")
    rows = docs.withColumns(dict(zip((*names[:4], names[6]), (*_key(), word_count()), strict=True)))
    rows = rows.join(goals.select(F.col("origin").alias(names[2]), F.col("source_size").alias(names[7]), F.col("target").alias(names[8])), names[2])
    rows = rows.join(taken.withColumnsRenamed(dict(zip((*KEY, "rows", "words"), names, strict=False))), names[:4])
    out = _shared(rows, names[:4], names[4], names[5], taken)
    added = zip(("size", "source_size", "target", "taken"), (names[6], names[7], names[8], names[5]), strict=True)
    return out.select(*rest, *[F.col(n).alias(c) for c, n in added])


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per document row: size, source_size, target and the words the mix takes."""
    sized = stored(sizes(docs), "sizes")
    goals = stored(targets(sized), "goals")
    taken = _taken(sized, goals)
    rows = sized.join(goals.select("origin", "source_size", "target"), "origin").join(taken, list(KEY))
    out = stored(_shared(rows, list(KEY), "rows", "words", taken).select("doc_id", "size", "source_size", "target", F.col("words").alias("taken")), "mixed")
    discard(sized, goals, taken)
    return out
