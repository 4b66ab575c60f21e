"""Exact top-k search by inner product with MaxScore.

The dimensions of quantised vectors are the terms. Within a shard every term keeps its
postings as one array over the shard's vectors, built once, and the largest and least value
in it, which bound what the term can add to a score. Queries stream past the shard, and
each brings the k-th best score that it has among a sample of the rows. A query's terms are
taken by falling bound: the essential ones are traversed for the whole shard; once what is
left could not lift a vector to the k-th best score known, only those still competitive are
probed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.lean import lean
from quillon.llm.store import stored

#: Vectors in a shard at most (on average) and, while there are fewer shards than cores, at least; sampled for first thresholds; queries in a block of these.
SHARD, SMALL, SAMPLE, QUERIES = 1 << 16, 2048, 2048, 1024
#: Terms taken at a time.
STEP = 8
SCALE = 1024
_MOST = 2**63 - 1


def quantise(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, q): integer components floor(scale * x), x as double, held as doubles.

    Rows with a null id, a null vector or a null or non-finite component take no part.
    """
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # FLOOR gives a long, which would hold large components wrong; these are whole already.
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(F.greatest(F.least(x, F.lit(1.7e308)), F.lit(-1.7e308)))
    q = F.transform("embedding", lambda x: whole(x.cast("double") * scale))
    return rows.where(usable & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), q.alias("q"))


def maxscore(query: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores of all vectors that can be among the k best of a shard.

    ``postings`` has a row for each term. Vectors that tie with the k-th best, or with the
    threshold that the query brings, are kept.
    """
    n = postings.shape[1]
    best, least = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
    order = np.argsort(least - best, kind="stable")
    alive, partial = np.arange(n), np.zeros(n, postings.dtype)
    for i in range(0, len(order), STEP):
        terms, rest = order[i : i + STEP], order[i + STEP :]
        lists = postings[terms] if len(alive) == n else postings[np.ix_(terms, alive)]
        partial = partial + query[terms] @ lists
        if len(rest) == 0:
            continue
        if len(alive) > k and (threshold is None or i % (2 * STEP) == 0):
            leaders = np.argpartition(partial, len(partial) - k)[-k:]
            exact = partial[leaders] + query[rest] @ postings[np.ix_(rest, alive[leaders])]
            threshold = exact.min() if threshold is None else max(threshold, exact.min())
        if threshold is not None:
            keep = partial + best[rest].sum() >= threshold
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
    return alive, partial


class _Shard:
    """The postings of a shard's vectors; those with components too large for exact machine numbers are apart."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        largest = abs(vectors).max(axis=1) if vectors.shape[1] else np.zeros(len(vectors))
        # Products of two components below 2^25 add up exactly in doubles over 8 dimensions, below 2^20 over 8192.
        self.limit = 2.0 ** ((52 - max(1, vectors.shape[1]).bit_length()) // 2)
        plain = largest < self.limit
        self.ids, self.wide_ids = ids[plain], ids[~plain]
        self.postings = np.ascontiguousarray(vectors[plain].T)
        self.wide = [[int(x) for x in v] for v in vectors[~plain]]
        if not self.postings.shape[0]:
            self.postings = np.zeros((1, len(self.ids)))
        some = len(self.ids) > 0
        self.high, self.low = (self.postings.max(axis=1), self.postings.min(axis=1)) if some else (None, None)
        self.all_wide = [(int(i), v) for i, v in zip(self.wide_ids, self.wide, strict=True)]

    def top(self, query_id: int, query: np.ndarray, k: int, threshold: float | None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to smaller ids."""
        found: list[tuple[int, int]] = []
        if len(query) and abs(query).max() >= self.limit:
            q = [int(x) for x in query]
            columns = [[int(x) for x in v] for v in self.postings.T]
            found = [(sum(a * b for a, b in zip(q, v, strict=True)), int(i)) for i, v in zip(self.ids, columns, strict=True) if i != query_id]
        elif len(self.ids):
            q = query if len(query) else np.zeros(1)
            at, score = maxscore(q, self.postings, self.high, self.low, k + int((self.ids == query_id).sum()), threshold)
            own = self.ids[at] != query_id
            at, score = at[own], score[own]
            best = np.lexsort((self.ids[at], -score))[:k]
            found = [(int(s), int(i)) for s, i in zip(score[best], self.ids[at[best]], strict=True)]
        if self.wide:
            q = [int(x) for x in query]
            found += [(sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in self.all_wide if i != query_id]
        return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


_FOUND = "query_id long, dim int, vec_id long, score long, beyond double"


def _beyond(score: int) -> float:
    """0 for a score that a long holds, else the score as a double."""
    return 0.0 if -_MOST <= score <= _MOST else float(max(min(score, int(1.7e308)), -int(1.7e308)))


def _stream(k: int):
    """Rows sorted by shard, its vectors before the queries: each query's best of the shard."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, shard = None, [], None
        for batch in batches:
            rows = []
            keys = list(zip(batch["dim"].tolist(), batch["shard"].tolist(), strict=True))
            for place, query, vec_id, q, known in zip(keys, batch["query"].tolist(), batch["vec_id"].tolist(), batch["q"], batch["known"].tolist(), strict=True):
                if place != key:
                    key, held, shard = place, [], None
                if not query:
                    held.append((vec_id, q))
                    continue
                if not held and shard is None:
                    continue
                if shard is None:
                    shard, held = _Shard(np.array([i for i, _ in held], np.int64), np.stack([v for _, v in held])), []
                for score, i in shard.top(vec_id, np.asarray(q), k, None if known != known else known):
                    rows.append((vec_id, place[0], i, max(-_MOST, min(_MOST, score)), _beyond(score)))
            yield pd.DataFrame(rows, columns=["query_id", "dim", "vec_id", "score", "beyond"])

    return search


def _met(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best of each (dim, shard) of rows (vec_id, dim, q, shard) for each of its queries (with known)."""
    columns = ["dim", "shard", "query", "vec_id", "q", "known"]
    vectors = rows.withColumns({"query": F.lit(False), "known": F.lit(None).cast("double")}).select(columns)
    both = vectors.unionByName(queries.withColumn("query", F.lit(True)).select(columns))
    return both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "query").mapInPandas(lean(_stream(k)), _FOUND)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query by integer inner product.

    Both sides come from ``quantise``. A row with the query's own id is no candidate; ties
    go to the smaller id; vectors meet those of their own length only. Rows are dealt into
    shards of bounded size by hash, and every query passes every shard once. Scores are
    exact whole numbers; one that a long cannot hold is given as the nearest long, and such
    scores are ranked as doubles. Rows that repeat an id are candidates each; of queries
    that repeat one, the least vector counts. A query without candidates, and an empty
    table, have no rows in the result.
    """
    spark = rows.sparkSession
    queries = queries.groupBy("vec_id", "dim").agg(F.min("q").alias("q"))
    n = rows.count()
    shards = max(1, -(-n // SHARD), min(spark.sparkContext.defaultParallelism, -(-n // SMALL)))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    first = queries.withColumn("known", F.lit(None).cast("double"))
    if n > SMALL:
        # A first threshold from a sample of the rows: each block of queries meets its own copy.
        blocks = max(1, -(-queries.count() // QUERIES))
        sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n)) < SAMPLE).withColumn("shard", upto(blocks))
        asked = first.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)))
        seen = stored(_met(sample, asked, k), "seen")
        # Scores beyond a long give no threshold; of others the k-th best of a sample bounds that of all rows from below.
        known = seen.where("beyond = 0").groupBy("query_id", "dim").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k)
        known = known.select(F.col("query_id").alias("vec_id"), "dim", F.col("least").alias("known"))
        first = queries.join(known, ["vec_id", "dim"], "left")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)))
    met = _met(dealt, first.withColumn("shard", upto(shards)), k)
    merged = W.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_digest(embeddings: DataFrame) -> DataFrame:
    """The ten best rows for every row whose id is divisible by 100."""
    rows = quantise(embeddings)
    return top_k(rows.where("vec_id % 100 = 0"), rows, 10)
