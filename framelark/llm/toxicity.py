"""Toxicity by a weighted lexicon that is learned from labelled documents.

Texts are folded first: look-alike letters and the digits that stand for
letters become plain letters, and everything else parts words.  The lexicon
holds words and word beginnings that labelled toxic documents use more often
than others, weighted by the logarithm of the ratio, and phrases around them
that clean documents use (exceptions, which cancel a match).  All patterns are
matched in one pass by an Aho-Corasick automaton; the weight found and its
ratio to the length give the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.llm._spark import hash_sample, release, staged, trimmed

#: Letters that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = str.maketrans(
    "абвгеёзікмнорсѕтухјһԁԛԝαβγεικνορτυχ0134567@$|€",
    "abbreesikmhopcstyxjhdqwabyeikvoptuxoieasgtasie",
)
SIGNS = re.compile(r"[@$|€](?=\w)")
PARTS = re.compile(r"[\W_]+")
#: Lengths of the word beginnings that may enter the lexicon.
SHORTEST, LONGEST = 3, 8
#: Clean rows for each toxic one that a pattern may have, and a word before its exceptions count.
RARELY, OFTEN = 0.05, 0.5


def fold(text: str | None) -> str:
    """``text`` as lower-case words between single spaces, with one at either end."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "@" in text or "$" in text or "|" in text or "€" in text:
        text = SIGNS.sub(lambda m: m[0].translate(LOOKALIKES), text)
        text = re.sub(r"[@$|€]", " ", text)
    return f" {PARTS.sub(' ', text.translate(LOOKALIKES)).strip()} "


def patterns_of(word: str) -> list[str]:
    """The word, and its beginnings, as they stand in folded text."""
    ends = range(SHORTEST, min(LONGEST, len(word)) + 1)
    return [f" {word} ", *(f" {word[:n]}" for n in ends)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (pattern, clean documents, toxic documents) by task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        rows = [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(rows, ["pattern", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[toxic].update({p for w in set(fold(text).split()) for p in patterns_of(w)})
        if len(counts[0]) + len(counts[1]) > 200_000:
            yield out()
    yield out()


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # below zero: a phrase that cancels what it holds
    bias: tuple[float, float, float] = (-8.0, 0.0, 0.0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def automaton(self):
        """Made at the first use, and again if the weights have been replaced."""
        import ahocorasick

        made = self.__dict__.get("_automaton")
        if made is None or made[0] is not self.weights or made[1] != len(self.weights):
            found = ahocorasick.Automaton()
            for pattern, weight in self.weights.items():
                found.add_word(pattern, (pattern, weight))
            if self.weights:
                found.make_automaton()
            made = self._automaton = (self.weights, len(self.weights), found)
        return made[2]

    def matches(self, folded: str, automaton) -> list[tuple[str, float]]:
        """The patterns found, with their weights, outside all exception phrases."""
        found = [(end - len(p) + 1, end, p, w) for end, (p, w) in automaton.iter(folded)] if self.weights else []
        spared = sorted((lo, hi) for lo, hi, _, w in found if w < 0)
        if not spared:
            return [(p, w) for _, _, p, w in found]
        starts, reach, most = [lo for lo, _ in spared], [], -1  # reach: how far any of the first phrases goes
        for _, hi in spared:
            reach.append(most := max(most, hi))

        def within(lo: int, hi: int) -> bool:
            at = bisect_right(starts, lo)
            return at > 0 and hi <= reach[at - 1]

        return [(p, w) for lo, hi, p, w in found if w > 0 and not within(lo, hi)]

    def features(self, text: str | None, automaton) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, w in self.matches(folded, automaton))
        return float(np.log1p(total)), float(np.log1p(100 * total / (folded.count(" ") + 10)))

    def scores(self, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        machine = self.automaton()
        x = np.array([self.features(t, machine) for t in texts])
        return 1 / (1 + np.exp(-(self.bias[0] + x @ np.array(self.bias[1:]))))


def training_rows(
    docs: DataFrame, labels: DataFrame, usable, bound: int, id_col: str, text_col: str, label_col: str
) -> DataFrame:
    """At most ``bound`` documents with a label, chosen by a hash of the id: ``(text, toxic)``."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("key")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic"))
    known = hash_sample(known, ["key"], bound)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "key")  # at most ``bound`` ids
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")  # of several texts of an id
    return staged(rows.groupBy("key").agg(one, F.max("toxic").alias("toxic")).select("text", "toxic"))


def _g_statistic(c: Column, t: Column, clean: int, toxic: int) -> Column:
    """Twice the log likelihood ratio of the rows with a pattern against no difference between the labels."""
    p = (c + t) / float(clean + toxic)
    cells = ((t, toxic * p), (c, clean * p), (toxic - t, toxic * (1 - p)), (clean - c, clean * (1 - p)))
    return 2 * sum((F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))


def learn(rows: DataFrame, size: int = 2000, phrases: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon of at most ``size`` patterns and as many exceptions from ``(text, toxic)`` rows.

    ``phrases`` are exceptions whatever the labels say.

    Without a toxic and a clean row there is nothing to learn, and every score
    is near zero.
    """
    sums = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sums.get(0, 0), sums.get(1, 0)
    if not clean or not toxic:
        return Lexicon()
    counted = rows.mapInArrow(trimmed(_counts), "pattern string, clean bigint, toxic bigint")
    counted = staged(counted.groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    tested = counted.where("clean + toxic >= 3").count()
    found = counted.where((F.col("toxic") >= 3) & (F.col("toxic") * clean > 4 * F.col("clean") * toxic))
    # the test of significance runs before anything is sent; what passes is bounded by the training rows
    found = found.where(_g_statistic(F.col("clean"), F.col("toxic"), clean, toxic) >= 2 * math.log(max(tested, 2)))
    good: dict[str, tuple[float, int, int]] = {}
    for pattern, c, t in (tuple(r) for r in found.select("pattern", "clean", "toxic").collect()):
        good[pattern] = (float(np.log((t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1)))), c, t)
    weights: dict[str, float] = {}
    doubtful: dict[str, float] = {}  # words that clean rows use too: kept if exceptions explain that
    for pattern in sorted(good, key=lambda p: (p.endswith(" "), len(p), p)):
        stem = pattern.rstrip(" ")
        weight, c, t = good[pattern]
        if c > RARELY * t:
            if pattern.endswith(" ") and c <= OFTEN * t:
                doubtful[pattern] = weight
            continue
        shorter = [stem[:n] for n in range(SHORTEST + 1, len(stem) + 1) if stem[:n] in weights]
        if shorter and t >= 0.95 * good[shorter[-1]][2]:  # the same words, named more closely
            del weights[shorter[-1]]
        elif shorter and weights[shorter[-1]] >= weight - 1.5:
            continue
        weights[pattern] = weight
    ranked = sorted(weights, key=lambda p: (-weights[p], p))[:size]
    lexicon = Lexicon({p: weights[p] for p in ranked})
    tried = Lexicon(lexicon.weights | doubtful)
    tried.weights |= exceptions(rows, tried, size, phrases)
    if doubtful:
        for pattern, c, t in kept_matches(rows, tried):
            if c <= RARELY * t:
                doubtful.pop(pattern, None)
        for pattern in doubtful:
            del tried.weights[pattern]
    lexicon = tried

    @F.pandas_udf("array<double>")
    def features(text: pd.Series) -> pd.Series:
        machine = lexicon.automaton()
        return pd.Series([list(lexicon.features(t, machine)) for t in text], dtype=object)

    seen = rows.select("toxic", features("text").alias("x")).collect()  # at most the training bound
    lexicon.bias = fitted(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen]))
    return lexicon


def kept_matches(rows: DataFrame, lexicon: Lexicon) -> list[tuple[str, int, int]]:
    """(pattern, clean rows, toxic rows) with a match that no exception cancels."""

    @F.pandas_udf("array<string>")
    def found(text: pd.Series) -> pd.Series:
        machine = lexicon.automaton()
        return pd.Series([sorted({p for p, _ in lexicon.matches(fold(t), machine)}) for t in text], dtype=object)

    hits = rows.select("toxic", F.explode(found("text")).alias("p")).groupBy("p")
    return [tuple(r) for r in hits.agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).collect()]  # of one lexicon


def exceptions(rows: DataFrame, lexicon: Lexicon, size: int = 2000, phrases: tuple[str, ...] = ()) -> dict[str, float]:
    """Two-word phrases around matches that clean rows use and toxic ones hardly do, and given ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        out: list[tuple[str, float, int]] = []
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folded = fold(text)
                for end, (pattern, weight) in machine.iter(folded) if lexicon.weights else ():
                    start = end - len(pattern) + 1
                    stop = folded.index(" ", start + 1)
                    left = folded.rfind(" ", 0, start) if start else -1
                    right = folded.find(" ", stop + 1)
                    phrases = ([folded[left : stop + 1]] if left >= 0 else []) + ([folded[start : right + 1]] if right > 0 else [])
                    out += [(p, weight, toxic) for p in phrases]
        a, b, c = zip(*out, strict=True) if out else ([],) * 3
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.int32())], ["phrase", "weight", "toxic"])

    near = rows.mapInArrow(run, "phrase string, weight double, toxic int").groupBy("phrase", "weight")
    near = near.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where("n - t >= 3 and t * 10 <= n")
    learned = {r["phrase"]: -r["weight"] for r in near.orderBy(F.desc("n"), "phrase").limit(size).collect()}
    for phrase in map(fold, phrases):
        if any(p in phrase for p in lexicon.weights):
            learned.setdefault(phrase, -1.0)
    return learned


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def score_udf(lexicon: Lexicon):
    """A column function: the score of a text, 0 to 1; a null text is empty."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield pd.Series(lexicon.scores(text), dtype="float64")
        release()

    return score


def classify(
    docs: DataFrame,
    labels: DataFrame,
    usable,
    held_out,
    threshold: float = 0.7,
    bound: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row.

    The lexicon is learned from at most ``bound`` labelled rows whose id is
    ``usable``; a score looks at the whole text alone.  Null and empty texts
    get the score of a text without matches; null ids are kept, repeated rows
    give equal rows, a label that a document has twice is toxic if one of them
    is, and of several texts of a labelled id that of the smallest hash is
    learned from.  Empty tables give an empty result or scores near zero; other
    columns are not looked at.
    """
    rows = training_rows(docs, labels, usable, bound, id_col, text_col, label_col)
    score = score_udf(learn(rows))
    scored = docs.select(F.col(id_col).alias("id"), score(F.col(text_col).cast("string")).alias("score"))
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
