"""Language identification by segmentation-marginalised unigram models.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum, by the forward algorithm, over all of its segmentations
into pieces; a text's is the product over its words. The piece probabilities are learned
by expectation maximisation over the same lattice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.lean import lean, released
from quillon.llm.names import fresh
from quillon.llm.store import discard, stored

#: Public vocabulary; labelled texts learned from for each language, at most; rounds of learning.
VOCABULARY, SAMPLE, ROUNDS = "/opt/tokenizers/piece_bpe_32k.model", 300, 4
#: Words learned from, the most frequent of the sample, in all languages together and for each at least; letters of such a word at most.
LEARNED, LEARNED_EACH, LEARNED_LETTERS = 500_000, 2_000, 32
#: Sampled texts up to which their keys are broadcast (8 bytes each); beyond, they meet by a shuffle.
FEW_SAMPLED = 1 << 17
#: Texts that are left out up to which their digests are broadcast (32 bytes each); beyond, they meet by a shuffle.
FEW_LEFT_OUT = 1 << 17
#: Words of up to so many letters are scored many at a time, longer ones one by one; letters of these whose pieces are found at a time.
SHORT, STRETCH = 40, 1 << 14
#: Below TINY a sum is multiplied by 1 / TINY, and the factor remembered.
TINY = 1e-150
#: Probability of a letter that is no piece; weight added to every piece's count.
FLOOR, SMOOTH = 1e-8, 0.05
#: Words remembered by a task; texts whose new words it scores together.
MEMORY, CHUNK = 150_000, 1000
UNDECIDED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters of a whole text."""
    found = _WORD.findall(text.lower()) if text else []
    if not found or "".join(found).isalpha():
        return found
    # Numbers such as fractions and circled digits are word characters, but no letters.
    return [x for w in found for x in ("".join(c if c.isalpha() else " " for c in w).split())]


def pieces(path: str = VOCABULARY) -> list[str]:
    """The lower-case letter pieces of the vocabulary, with its mark of a word's beginning."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = {p for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)).lstrip("▁").isalpha() and p == p.lower() and "▁" not in p[1:]}
    return sorted(kept | {"▁"})


@dataclass
class Trie:
    """Pieces as a transition table: node 0 is dead, 1 the root, 2 an unknown letter."""

    letters: dict[str, int]
    step: np.ndarray
    node_of: dict[str, int]
    depth: int

    @classmethod
    def of(cls, pieces: list[str]) -> Trie:
        letters = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        rows, node_of = [{}, {}, {}], {}
        for p in pieces:
            at = 1
            for c in p:
                if c not in rows[at]:
                    rows[at][c] = len(rows)
                    rows.append({})
                at = rows[at][c]
            node_of[p] = at
        step = np.zeros((len(rows), len(letters) + 2), np.int32)
        for i, row in enumerate(rows):
            for c, j in row.items():
                step[i, letters[c]] = j
        step[1, : len(letters) + 1][step[1, : len(letters) + 1] == 0] = 2
        return cls(letters, step, node_of, max(map(len, pieces)))

    def codes(self, parts: list[str]) -> np.ndarray:
        """Letters of each part as columns, padded with a code that no piece has."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.full((lengths.max(initial=0), len(parts)), len(self.letters) + 1, np.int32)
        said = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(lengths) - lengths
        out[np.arange(len(said)) - np.repeat(begin, lengths), np.repeat(np.arange(len(parts)), lengths)] = self.code_of[said]
        return out

    @cached_property
    def code_of(self) -> np.ndarray:
        """Code of each code point; 0 for letters that no piece has."""
        out = np.zeros(0x110000, np.int32)
        for c, code in self.letters.items():
            out[ord(c)] = code
        return out


def _edges(trie: Trie, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lattice edges (begin, end, parts, nodes) by rising begin."""
    for i in range(len(codes)):
        part, node = np.arange(codes.shape[1]), np.ones(codes.shape[1], np.int32)
        for j in range(i, min(len(codes), i + trie.depth)):
            node = trie.step[node, codes[j, part]]
            alive = node > 0
            part, node = part[alive], node[alive]
            if not len(part):
                break
            yield i, j + 1, part, node


def forward(trie: Trie, codes: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """alpha[i, part, language]: probability of the first i letters, over all segmentations."""
    alpha = np.zeros((len(codes) + 1, codes.shape[1], probability.shape[1]))
    alpha[0] = 1
    for i, j, part, node in _edges(trie, codes):
        alpha[j, part] += alpha[i, part] * probability[node]
    return alpha


def by_length(lengths: np.ndarray, longest: int, most: int = 400_000) -> Iterator[np.ndarray]:
    """Indices of words of up to ``longest`` letters, in groups of like length and of ``most`` letters with padding."""
    order = np.argsort(lengths, kind="stable")
    order = order[: np.searchsorted(lengths[order], longest, "right")]
    low = 0
    while low < len(order):
        top = min(2 * int(lengths[order[low]]) + 4, longest)
        high = min(int(np.searchsorted(lengths[order], top, "right")), low + max(1, most // top))
        yield order[low:high]
        low = high


def forward_long(trie: Trie, word: str, probability: np.ndarray) -> np.ndarray:
    """Log probability of one long word in each language, over all segmentations.

    Sums are rescaled as they shrink, so that no length loses them.
    """
    codes = np.array([trie.letters.get(c, 0) for c in word], np.int32)
    n, depth, languages = len(codes), trie.depth, probability.shape[1]
    alpha, scale = np.zeros((depth, languages)), np.zeros(languages)
    alpha[-1] = 1  # alpha[-d] is the sum of the prefix that ends d letters back
    for low in range(0, n, STRETCH):
        # ending[i, d]: node of the piece of d + 1 letters that ends at letter low + i.
        begin, high = max(0, low - depth + 1), min(n, low + STRETCH)
        ending = np.zeros((high - low, depth), np.int32)
        at, node = np.arange(begin, high), np.ones(high - begin, np.int32)
        for d in range(depth):
            end = at + d
            some = end < high
            at, node, end = at[some], trie.step[node[some], codes[end[some]]], end[some]
            alive = node > 0
            at, node, end = at[alive], node[alive], end[alive]
            inside = end >= low
            ending[end[inside] - low, d] = node[inside]
        for row in ending:
            # Node 0 has no probability, so lengths without a piece add nothing.
            now = (alpha[::-1] * probability[row]).sum(axis=0)
            alpha[:-1] = alpha[1:]
            alpha[-1] = now
            if now.min() < TINY:
                small = now < TINY
                alpha[:, small] /= TINY
                scale += small
    return np.log(alpha[-1]) + scale * np.log(TINY)


@dataclass
class Model:
    """Languages and, for each node of the trie, its piece's probability in each of them."""

    languages: list[str]
    trie: Trie
    probability: np.ndarray

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, marked at its beginning, in each language."""
        marked = ["▁" + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        out = np.zeros((len(words), len(self.languages)))
        for which in by_length(lengths, SHORT):
            some = [marked[i] for i in which.tolist()]
            alpha = forward(self.trie, self.trie.codes(some), self.probability)
            with np.errstate(divide="ignore"):
                out[which] = np.log(alpha[lengths[which], np.arange(len(which))])
        # Long words, and short ones of so many unknown letters that their sums vanish.
        for i in np.flatnonzero((lengths > SHORT) | ~np.isfinite(out).all(axis=1)).tolist():
            out[i] = forward_long(self.trie, marked[i], self.probability)
        return out


def learn(counts: dict[str, dict[str, int]], vocabulary: list[str], rounds: int = ROUNDS) -> Model:
    """A model from each language's word counts; pieces that no language uses are left out.

    Words of more than LEARNED_LETTERS letters are not learned from.
    """
    counts = {lang: {w: n for w, n in by.items() if len(w) <= LEARNED_LETTERS} for lang, by in counts.items()}
    languages = sorted(counts)
    letters = {c for by in counts.values() for w in by for c in w}
    trie = Trie.of(sorted({p for p in vocabulary if set(p) <= letters | {"▁"}} | letters | {"▁"}))
    is_piece = np.zeros(len(trie.step), bool)
    is_piece[list(trie.node_of.values())] = True
    probability = np.zeros((len(trie.step), len(languages)))
    for k, lang in enumerate(languages):
        known = ["▁" + w for w in sorted(counts[lang])]
        groups = []
        lengths = np.fromiter(map(len, known), np.int64, len(known))
        for group in by_length(lengths, LEARNED_LETTERS + 1):
            some = [known[i] for i in group.tolist()]
            codes = trie.codes(some)
            groups.append((codes, lengths[group], np.array([counts[lang][w[1:]] for w in some], float), list(_edges(trie, codes))))
        p = np.where(is_piece, 1.0 / is_piece.sum(), 0.0)[:, None]
        p[2] = FLOOR
        for _ in range(rounds):
            found = np.zeros(len(p))
            for codes, lengths, weight, edges in groups:
                every = np.arange(len(lengths))
                alpha = forward(trie, codes, p)[:, :, 0]
                beta = np.zeros_like(alpha)
                total = alpha[lengths, every]
                beta[lengths, every] = 1
                for i, j, part, node in reversed(edges):
                    through = p[node, 0] * beta[j, part]
                    beta[i, part] += through
                    found += np.bincount(node, alpha[i, part] * through * weight[part] / total[part], len(p))
            found = np.where(is_piece, found + SMOOTH, 0.0)
            p = (found / found.sum())[:, None]
            p[2] = FLOOR
        probability[:, k] = p[:, 0]
    return Model(languages, trie, probability)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_words(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, word, n): the words of the ``sample`` labelled texts of each language whose ids and texts hash least.

    Held-out rows, null texts and null languages are left out. Each task keeps the least
    hashes of its own rows before any are shuffled, and no text is shuffled.
    """
    known = docs.where(~_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("lang", "text", F.xxhash64(F.lit("sample"), "doc_id", "text").alias("draw"))
    least = W.partitionBy("lang").orderBy("draw")
    picked = stored(known.select("lang", "draw").withColumn("row", F.row_number().over(least)).where(F.col("row") <= sample).select("draw").distinct(), "sample")
    keys = F.broadcast(picked) if picked.count() <= FEW_SAMPLED else picked
    rows = known.join(keys, "draw", "left_semi").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by = Counter((lang, w) for lang, text in zip(batch["lang"], batch["text"], strict=True) for w in words_of(text) if len(w) <= LEARNED_LETTERS)
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in by.items()], columns=["lang", "word", "n"])

    return rows.mapInPandas(lean(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample: int = SAMPLE, vocabulary: str = VOCABULARY) -> Model:
    """A model learned from the labelled rows of ``docs`` (see ``training_words``): the LEARNED most frequent words."""
    words = stored(training_words(docs, sample), "words")
    languages = max(1, words.agg(F.count_distinct("lang")).first()[0])
    most = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = words.withColumn("row", F.row_number().over(most)).where(F.col("row") <= max(LEARNED_EACH, LEARNED // languages))
    counts: dict[str, dict[str, int]] = {}
    for r in kept.select("lang", "word", "n").collect():
        counts.setdefault(r.lang, {})[r.word] = r.n
    discard(words)
    model = learn(counts, pieces(vocabulary))
    del counts
    released()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, the posterior of the predicted language.

    A null text, or one without letters, or a model without languages gives ``und`` and 0.
    Languages are equally likely beforehand; ties go to the first by name. Other columns
    pass through; lang_pred and score replace columns of these names. No rows: no rows.
    """
    trie = model.trie
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, trie.letters, trie.step, trie.depth, model.probability))

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, letters, step, depth, probability = shared.value
        model, ids, table = Model(languages, Trie(letters, step, {}, depth), probability), {}, None
        for batch in batches:
            langs, scores = [], []
            for low in range(0, len(batch), CHUNK):
                if table is None or len(ids) > MEMORY:
                    ids, table = {}, np.zeros((0, len(model.languages)))
                rows, new = [], len(ids)
                for text in batch.iloc[low : low + CHUNK]:
                    words = Counter(words_of(text))
                    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
                    rows.append((at, np.fromiter(words.values(), float, len(words))))
                if len(ids) > new:
                    table = np.concatenate([table, model.score(list(islice(ids, new, None)))])
                for at, n in rows:
                    if not len(at) or not model.languages:
                        langs.append(UNDECIDED)
                        scores.append(0.0)
                        continue
                    total = n @ table[at]
                    best = int(total.argmax())
                    langs.append(model.languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
        ids, table = {}, None
        released()

    predicted = F.pandas_udf(predict, "lang_pred string, score double")
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    (name,) = fresh(docs, "found")
    found = docs.withColumn(name, predicted("text"))
    return found.select(*rest, F.col(name)["lang_pred"].alias("lang_pred"), F.col(name)["score"].alias("score"))


def identified(docs: DataFrame, model: Model, sure: float) -> DataFrame:
    """The rows of ``docs`` whose language ``identify`` predicts with a score of ``sure`` at least; other columns pass through.

    Python is given texts alone, while the digests of those to leave out are written as a
    table, so that its workers hold few rows at a time whatever the session's settings.
    Null texts and those without letters are left out. No rows: no rows.
    """
    texts = docs.where(F.col("text").isNotNull())
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    kept = (F.col("lang_pred") != UNDECIDED) & (F.col("score") >= sure)
    gone = stored(identify(texts.select("text"), model).where(~kept).select(digest.alias("digest")).distinct(), "unsure")
    n = gone.count()
    if not n:
        discard(gone)
        return texts
    (key,) = fresh(docs, "digest")
    named = gone.select(F.col("digest").alias(key))
    return texts.withColumn(key, digest).join(F.broadcast(named) if n <= FEW_LEFT_OUT else named, key, "left_anti").drop(key)


def langid_digest(docs: DataFrame) -> DataFrame:
    """One row per document: held_out, the predicted language and its score."""
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
