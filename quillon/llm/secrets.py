"""Secret scans over a trigram inverted index.

Each rule's pattern yields a Boolean query over trigrams that every match must contain.
One pass over the texts writes the posting lists of those trigrams; the lists are
intersected as each rule's query asks, and only the documents that remain are read again
and verified with the pattern itself. Rules without mandatory trigrams scan every document.
Native throughout; what is shuffled are postings, keys and spans, and texts only of
candidates, where there are too many to name them in a broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.names import fresh
from quillon.llm.spans import find_spans, joined
from quillon.llm.store import discard, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the least length of a match or of one of its groups."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = True
    test: str = ""


RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    # Runs that are too short are no matches, so the pattern may ask for the length itself.
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", test="[0-9a-f]{32}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", base=False),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", base=False),
)
BASE = tuple(r.name for r in RULES if r.base)
#: Strings that a part of a pattern may stand for before its trigrams are taken.
MOST_STRINGS = 64
#: Candidates up to which their keys are broadcast (some 60 bytes each); beyond, texts are shuffled to them.
FEW_CANDIDATES = 1 << 17

#: All of the clauses hold; a clause holds if all trigrams of one of its sets are there.
Query = tuple[frozenset[frozenset[str]], ...]


def _clauses(strings: set[str]) -> Query:
    if not strings or min(map(len, strings)) < 3:
        return ()
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    # A set that holds all of another asks for no other documents.
    return (frozenset(a for a in sets if not any(b < a for b in sets)),)


def _branches(parts: list[tuple[set[str] | None, Query]]) -> tuple[set[str] | None, Query]:
    exact = [p for p, _ in parts]
    if None not in exact and sum(map(len, exact)) <= MOST_STRINGS:
        return set().union(*exact), ()
    queries = [_clauses(p) if p is not None else q for p, q in parts]
    if not all(queries):
        return None, ()
    anded = [frozenset().union(*choice) for q in queries for choice in product(*q)]
    return None, (frozenset(anded),) if len(anded) <= MOST_STRINGS else ()


def _item(op, arg) -> tuple[set[str] | None, Query]:
    """The lower-case strings that an item stands for, if they are few, else what it asks for."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ()
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(a).lower() for _, a in arg}, ()
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.ATOMIC_GROUP:
        return _sequence(arg)
    if op is sre.BRANCH:
        return _branches([_sequence(a) for a in arg[1]])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, body = arg
        exact, query = _sequence(body)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, ()
        return None, () if low == 0 else query if exact is None else _clauses(exact)
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, ()
    return None, ()


def _sequence(items) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, (), True
    for op, arg in items:
        exact, own = _item(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in exact}
            continue
        query, whole = (*query, *_clauses(run), *own), False
        run = exact if exact is not None else {""}
    return (run, ()) if whole else (None, (*query, *_clauses(run)))


@cache
def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that the lower-cased text of every match satisfies."""
    exact, query = _sequence(_parser.parse(pattern))
    return _clauses(exact) if exact is not None else query


def trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """Every trigram that some rule's query asks for, in order."""
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for all_ in clause for t in all_})


#: What names a document: its id (and whether it has one) and the hash of its text.
KEY = ("id", "no_id", "text_hash")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows that have a text, with their KEY: rows equal in id and text share one."""
    id_ = F.col("doc_id").cast("string")
    return docs.where("text is not null").select(F.coalesce(id_, F.lit("")).alias("id"), id_.isNull().alias("no_id"), F.xxhash64("text").alias("text_hash"), "text")


def trigram_index(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Posting lists (trigram, id, no_id, text_hash): the documents (doc_id, text) that hold each of the wanted trigrams."""
    low = _keyed(docs).withColumn("text", F.lower("text"))
    held = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(t)) for t in wanted]).cast("array<string>"))
    return low.select(*KEY, F.explode(held).alias("trigram"))


def _constant(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of literals."""
    structs = [F.struct(*[F.lit(x).alias(n) for x, n in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, no_id, text_hash, rules): the documents in the intersections of posting lists that the rules' queries ask for.

    A document is in the intersection of a set of trigrams if it stands in as many of their
    lists as there are; a clause holds for the union of its sets' intersections and a rule
    for the intersection of its clauses. The counts are combined before they are shuffled.
    """
    if not any(trigram_query(r.pattern) for r in rules):
        return index.select(*KEY, F.array().cast("array<string>").alias("rules")).where("false")
    asked = [(r.name, c, n, len(all_), t) for r in rules for c, clause in enumerate(trigram_query(r.pattern)) for n, all_ in enumerate(sorted(clause, key=sorted)) for t in sorted(all_)]
    clauses = [(r.name, len(q)) for r in rules if (q := trigram_query(r.pattern))]
    # Both tables follow from the rules alone.
    lists = F.broadcast(_constant(index.sparkSession, asked, ["rule", "clause", "choice", "need", "trigram"]))
    whole = F.broadcast(_constant(index.sparkSession, clauses, ["rule", "clauses"]))
    met = index.join(lists, "trigram").groupBy(*KEY, "rule", "clause", "choice", "need").agg(F.size(F.collect_set("trigram")).alias("held"))
    holding = met.where("held = need").groupBy(*KEY, "rule").agg(F.count_distinct("clause").alias("clauses"))
    return holding.join(whole, ["rule", "clauses"]).groupBy(*KEY).agg(F.collect_set("rule").alias("rules"))


def _verified(text: Column, rank: int, rule: Rule, test: Column) -> Column:
    def long_enough(x: Column) -> Column:
        part = x["t"] if rule.group == 0 else F.regexp_extract(x["t"], rule.pattern, rule.group)
        return F.length(part) >= rule.least

    def named(x: Column) -> Column:
        return F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.name).alias("kind"), x["e"].alias("end"))

    spans = F.transform(F.filter(find_spans(text, rule.pattern), long_enough), named)
    return F.when(test, spans).otherwise(F.array().cast(SPANS))


#: Type of the spans of a document, by start, then kind.
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def indexed_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, no_id, text_hash, spans) of the documents (doc_id, text) with matches of rules that have trigrams, through the index."""
    index = stored(trigram_index(docs, trigrams(rules)), "postings")
    found = stored(candidates(index, rules), "candidates")
    discard(index)
    named = F.broadcast(found) if found.count() <= FEW_CANDIDATES else found
    both = _keyed(docs).join(named, list(KEY))
    spans = [_verified(F.col("text"), rank, rule, F.array_contains("rules", rule.name)) for rank, rule in enumerate(rules) if trigram_query(rule.pattern)]
    verified = both.select(*KEY, F.concat(F.array().cast(SPANS), *spans).alias("spans")).where(F.size("spans") > 0)
    out = stored(verified.groupBy(*KEY).agg(F.first("spans").alias("spans")), "spans")
    discard(found)
    return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """``docs`` with a column of verified spans.

    A null text counts as empty. Rows are told apart by id, null or not, and text, so that
    rows that repeat an id are each treated by their own text. No rows: no rows. Other
    columns pass through, whatever their names, but one named as ``into`` is replaced.
    Matches that fail a length are dropped and not retried.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    scanned = [_verified(text, rank, rule, text.rlike(rule.test or rule.pattern)) for rank, rule in enumerate(rules) if not trigram_query(rule.pattern)]
    id_ = docs["doc_id"].cast("string")
    names = fresh(docs, *KEY, "scanned", "spans")
    own = [F.coalesce(id_, F.lit("")), id_.isNull(), F.xxhash64(docs["text"]), F.concat(F.array().cast(SPANS), *scanned)]
    keyed = docs.withColumns(dict(zip(names, own, strict=False)))
    spans = indexed_spans(docs.select("doc_id", "text"), rules).withColumnsRenamed(dict(zip((*KEY, "spans"), (*names[:3], names[4]), strict=True)))
    all_ = F.array_sort(F.concat(F.col(names[3]), F.coalesce(F.col(names[4]), F.array().cast(SPANS))))
    return keyed.join(spans, names[:3], "left").withColumn(into, all_).select(*[c for c in docs.columns if c.lower() != into.lower()], into)


def secrets_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base kinds, hash of the base spans, all spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["rank"] < len(BASE))
    number = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k))
    counts = [number(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


__all__ = ["BASE", "RULES", "Rule", "candidates", "find_secrets", "secrets_digest", "trigram_index", "trigram_query", "trigrams"]
