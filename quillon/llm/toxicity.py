"""Toxicity: a lexicon trie met by Levenshtein automata, and scores of the context.

The lexicon (words, and stems that many words share) is learned from labelled rows. Words
of a text run through the product of the trie and the automaton of one error, or of two for
long terms, made deterministic as it is used; words that clean rows use are no
misspellings. A hit counts as quoted, aimed or plain by the words and marks around it, and
a logistic model over these counts gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.lean import lean, released
from quillon.llm.store import discard, stored

#: Labelled rows of each class learned from, at most; terms in the lexicon at most; frequent words of clean rows looked at.
SAMPLE, TERMS, CLEAN = 4000, 400, 50_000
#: A term stands in this many toxic rows at least, in this share of them, and is this much more frequent there (stems more so).
SUPPORT, SHARE, LIFT, STEM_LIFT = 4, 0.01, 12.0, 50.0
#: Shortest stem; shortest terms for which one error and two are allowed; clean rows that make a word no misspelling.
STEM, ONE, TWO, KNOWN = 3, 4, 9, 2
#: Words before and after a hit that are its context.
REACH = 6
#: Words remembered by a task.
MEMORY = 100_000
_TOKEN = re.compile(r"\w+|[\"“”«»„‘’]")
_QUOTES = frozenset("\"“”«»„‘’")
#: Words that report what others say, and words that address someone: fixed lists.
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word words term terms slur insult insults means meaning sagte schrieb nannte wort zitat dit écrit mot terme citation dijo escribió llamó palabra cita".split())
ADDRESS = frozenset("you your youre u ur du dein deine dich dir ihr euch tu ton ta toi vous votre tú tus usted eres".split())
FEATURES = ("exact", "short", "fuzzy", "stem", "quoted", "aimed", "density")
#: States of an automaton that are remembered.
STATES = 50_000


class Automaton:
    """The product of a trie of terms and a Levenshtein automaton, deterministic where words go.

    A state is a set of (node, errors). States and their moves are kept while there are few.
    """

    def __init__(self, terms: list[str], errors: int):
        self.children, self.final, self.errors = [{}], [False], errors
        for term in terms:
            at = 0
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.final.append(False)
                at = self.children[at][c]
            self.final[at] = True
        self.restart()

    def restart(self) -> None:
        self.states, self.moves = {}, []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state, closed under letters that the word lacks; nodes have their least errors."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            if (e := nodes[node] + 1) <= self.errors:
                for child in self.children[node].values():
                    if nodes.get(child, e + 1) > e:
                        nodes[child] = e
                        todo.append(child)
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.moves)
            self.moves.append(({}, key, min((e for n, e in key if self.final[n]), default=-1)))
        return self.states[key]

    def _move(self, nodes: frozenset, c: str) -> int:
        out: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.errors and out.get(node, e + 1) > e:
                out[node] = e

        for node, e in nodes:
            put(node, e + 1)
            for letter, child in self.children[node].items():
                put(child, e + (letter != c))
        return self._state(out) if out else -1

    def distance(self, word: str) -> int:
        """Errors between a word and the nearest term, -1 if there are too many."""
        if len(self.moves) > STATES:
            self.restart()
        at = self.start
        for c in word:
            moves, nodes, _ = self.moves[at]
            if (to := moves.get(c)) is None:
                to = moves[c] = self._move(nodes, c)
            if to < 0:
                return -1
            at = to
        return self.moves[at][2]


class Matcher:
    """How a word matches the lexicon: exact, fuzzy, short (fuzzy to a term of few letters), stem, or '' if not at all.

    A term of ONE letters or more allows one error and one of TWO letters two; a word that
    clean rows have is no misspelling.
    """

    def __init__(self, words: list[str], stems: list[str], clean: list[str] = ()):
        self.words, self.clean, self.known = frozenset(words), frozenset(clean), {}
        self.stems = tuple(stems)
        self.long, self.short = Automaton([w for w in words if len(w) >= ONE + 2], 1), Automaton([w for w in words if ONE <= len(w) < ONE + 2], 1)
        self.longest = Automaton([w for w in words if len(w) >= TWO], 2)

    def __call__(self, word: str) -> str:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = self.known[word] = self._match(word)
        return found

    def _match(self, word: str) -> str:
        if word in self.words:
            return "exact"
        if self.stems and word.startswith(self.stems):
            return "stem"
        if word in self.clean:
            return ""
        return self.near(word)

    def near(self, word: str) -> str:
        """fuzzy or short for a word some errors from a term, whatever clean rows have."""
        if len(word) > ONE and (self.long.distance(word) > 0 or len(word) >= TWO - 2 and self.longest.distance(word) > 0):
            return "fuzzy"
        return "short" if ONE - 1 <= len(word) <= ONE + 2 and self.short.distance(word) > 0 else ""


def features(text: str | None, match: Matcher) -> list[float]:
    """Counts of hits by kind and by context, and hits among the words, of a whole text."""
    tokens = _TOKEN.findall((text or "").lower())
    out = dict.fromkeys(FEATURES, 0)
    n, hits, opened = 0, 0, 0
    for i, t in enumerate(tokens):
        if t in _QUOTES:
            opened += 1
            continue
        n += 1
        if not (kind := match(t)):
            continue
        hits += 1
        near = tokens[max(0, i - REACH) : i] + tokens[i + 1 : i + 1 + REACH]
        framed = bool(_QUOTES.intersection(tokens[max(0, i - 2) : i])) and bool(_QUOTES.intersection(tokens[i + 1 : i + 3]))
        if framed or REPORTING.intersection(near):
            out["quoted"] += 1
        else:
            out[kind] += 1
            out["aimed"] += bool(ADDRESS.intersection(near))
    return [math.log1p(out[f]) for f in FEATURES[:-1]] + [10.0 * hits / n if n else 0.0]


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, text) of the ``sample`` labelled rows of each class whose ids hash least, as a table, and how many each class has.

    The chosen ids are 2 * ``sample`` at most and are broadcast, so that no text is shuffled.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~_held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    least = W.partitionBy("toxic").orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id")
    drawn = known.withColumn("row", F.row_number().over(least)).where(F.col("row") <= sample).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "text")
    return stored(rows, "sample"), counts


def counted(rows: DataFrame) -> DataFrame:
    """(w, stem, bad, good): rows of each class that have a word, or a word that begins with a stem."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    own = rows.select("toxic", words.alias("words"))
    heads = F.transform(F.sequence(F.lit(STEM), F.lit(STEM + 4)), lambda k: F.transform(F.filter("words", lambda w: F.length(w) > k), lambda w: F.substring(w, F.lit(1), k)))
    both = F.concat(F.transform("words", lambda w: F.struct(w.alias("w"), F.lit(False).alias("stem"))), F.transform(F.array_distinct(F.flatten(heads)), lambda w: F.struct(w.alias("w"), F.lit(True).alias("stem"))))
    each = own.select("toxic", F.explode(both).alias("x")).select("toxic", "x.w", "x.stem")
    return each.groupBy("w", "stem").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def chosen(counts: list[tuple[str, bool, int, int]], n: dict[int, int], terms: int = TERMS) -> tuple[list[str], list[str]]:
    """The words and stems that mark toxic rows, of counts (w, stem, bad, good); the most frequent if there are too many."""
    least = max(SUPPORT, SHARE * n[1])
    lift = lambda bad, good: bad / n[1] / ((good + 0.5) / n[0])
    top = sorted((x for x in counts if x[2] >= least and lift(x[2], x[3]) >= (STEM_LIFT if x[1] else LIFT)), key=lambda x: (-x[2], x[0]))
    words = [w for w, stem, *_ in top if not stem][:terms]
    stems: list[str] = []
    for w in sorted((w for w, stem, *_ in top if stem), key=len):
        if not any(w.startswith(s) for s in stems):
            stems.append(w)
    # A stem that merely is the head of one listed word says no more than the word.
    return sorted(words), sorted([s for s in stems if sum(w.startswith(s) for w in words) != 1][:terms])


def lexicon(rows: DataFrame, n: dict[int, int], terms: int = TERMS) -> tuple[list[str], list[str], list[str]]:
    """Words, stems, and words of clean rows that are near a term, from (toxic, text) rows."""
    table = stored(counted(rows), "counts")
    lift = F.col("bad") / n[1] / ((F.col("good") + 0.5) / n[0])
    marked = table.where((F.col("bad") >= max(SUPPORT, SHARE * n[1])) & (lift >= F.when(F.col("stem"), STEM_LIFT).otherwise(LIFT)))
    words, stems = chosen([tuple(r) for r in marked.orderBy(F.desc("bad"), "w", "stem").limit(8 * terms).collect()], n, terms)
    clean = table.where(~F.col("stem") & (F.col("good") >= KNOWN) & (lift < LIFT)).orderBy(F.desc("good"), "w").select("w").limit(CLEAN).collect()
    discard(table)
    match = Matcher(words, stems)
    return words, stems, sorted(r.w for r in clean if match.near(r.w))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method with a small ridge; rows count by their weight."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return w


#: Words, stems, words that are no misspellings, and weights.
Model = tuple[list[str], list[str], list[str], list[float]]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows. Without rows of both classes nothing is learned and scores are about 0.

    A sampled row counts for as many as its class has for each that was drawn, so that
    tables of any size estimate the same model.
    """
    rows, every = training_sample(docs, labels, sample)
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        discard(rows)
        return [], [], [], [0.0] * len(FEATURES) + [-30.0]
    words, stems, clean = lexicon(rows, n)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = Matcher(words, stems, clean)
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [features(t, match) for t in batch["text"]]})

    got = rows.mapInPandas(lean(measure), "toxic int, x array<double>").toPandas()
    discard(rows)
    x, y = np.stack(got["x"].to_numpy()).astype(float), got["toxic"].to_numpy(float)
    # Rows in a fixed order, so that sums do not depend on that of the tasks.
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    share = np.array([every[0] / n[0], every[1] / n[1]])
    return words, stems, clean, logistic(x, y, (share / share.min())[y.astype(int)]).tolist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with tox_score, 0 to 1, which replaces a column of this name; others pass through.

    Null and empty texts have a score too, that of a text without hits. Repeated rows are
    each treated alone; no rows give no rows.
    """
    words, stems, clean, weights = model

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match, w = Matcher(words, stems, clean), np.array(weights)
        for texts in batches:
            x = np.array([features(t, match) for t in texts], float).reshape(-1, len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))
        match = None
        released()

    return docs.withColumn("tox_score", F.pandas_udf(rate, "double")("text"))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held_out, score and the predicted label."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).withColumn("score", F.col("tox_score"))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
