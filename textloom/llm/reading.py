"""Reading level of a text (problem 3).

Interpolated n-gram models, one per graded level, are trained on texts of known level. Each order is mixed with
the next lower one by a weight that depends on how often its context was met (none if never), down to the uniform
distribution, so that the probabilities of all words sum to one after any context; the weights are fitted by
expectation-maximisation on texts that the models haven't seen. A document's surprisal is computed sentence by
sentence under every model. The distribution of what the sentences' surprisals say of the level - its mean and its
quartiles - is mapped to the graded scale by isotonic regressions, each and then together, fitted out of fold.

Defined results: a null, empty or wordless text has no level; where no text of known level exists every text is
of the middle level; ties between levels go to the lower one.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import garbled
from textloom.llm.canonical import transducer
from textloom.llm.sentences import spans
from textloom.llm.worker import Shared

#: Texts of known level, about, that the models are trained on (drawn by their hash); bounds what is broadcast.
TRAIN_TEXTS = 20_000
LEVELS = (1, 2, 3)
#: How often a context was met, in steps; each step of each order has its own weight.
STEPS = (1, 2, 4, 8, 16, 64)
#: What is taken of the distribution over a document's sentences: the mean, and quantiles.
QUANTILES = (0.25, 0.5, 0.75)
FOLDS = 5


def sentence_units(text: str) -> list[list[str]]:
    t = transducer().canonical(text)
    return [u for a, b in spans(t) if (u := garbled.units(t[a:b]))]


class NGrams:
    """Counts of trigrams, bigrams and words, and of their contexts."""

    def __init__(self) -> None:
        self.n: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())
        self.context: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())

    def add(self, sentence: list[str]) -> None:
        s = ["", "", *sentence]
        for k in range(2, len(s)):
            for order in range(3):
                gram = tuple(s[k - order : k + 1])
                self.n[order][gram] += 1
                self.context[order][gram[:-1]] += 1

    def parts(self, sentence: list[str]) -> list[list[tuple[float, int]]]:
        """For each word and order: its relative frequency after the context, and the step of how often that was met (-1: never)."""
        s = ["", "", *sentence]
        out = []
        for k in range(2, len(s)):
            row = []
            for order in range(3):
                gram = tuple(s[k - order : k + 1])
                met = self.context[order][gram[:-1]]
                row.append((self.n[order][gram] / met, bisect_right(STEPS, met) - 1) if met else (0.0, -1))
            out.append(row)
        return out


class Interpolation:
    """Weights of each order against the lower ones, by the step of its context."""

    def __init__(self, vocabulary: int) -> None:
        self.vocabulary = vocabulary
        self.weight = [[0.9] * len(STEPS), [0.6] * len(STEPS), [0.5] * len(STEPS)]

    def lower(self, row: list[tuple[float, int]], orders: int) -> float:
        p = 1.0 / self.vocabulary
        for order in range(orders):
            f, step = row[order]
            if step >= 0:
                w = self.weight[order][step]
                p = w * f + (1.0 - w) * p
        return p

    def fit(self, rows: list[list[tuple[float, int]]]) -> None:
        """Expectation-maximisation on held-out words, order by order from below: each is a mixture of two known probabilities."""
        for order in range(3):
            f, step = (np.array([row[order][k] for row in rows], dtype=float) for k in (0, 1))
            low = np.array([self.lower(row, order) for row in rows])
            for s in range(len(STEPS)):
                at = step == s
                if not at.any():
                    continue
                w = self.weight[order][s]
                for _ in range(20):
                    w = float(np.clip((w * f[at] / (w * f[at] + (1 - w) * low[at])).sum() + 0.5, 0.0, at.sum()) / (at.sum() + 1.0))
                self.weight[order][s] = min(0.999, max(0.001, w))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit by pooling adjacent violators: places and values of its steps."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for k in order:
        blocks.append([float(y[k]), 1.0, float(x[k]), float(x[k])])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = last
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    return xs, np.array([v for b in blocks for v in (b[0] / b[1],) * 2])


class Surprisal:
    """A model with its weights multiplied out: what a gram adds, and what its context leaves to the lower order."""

    def __init__(self, model: NGrams, mix: Interpolation) -> None:
        self.adds: list[dict[tuple[str, ...], float]] = []
        self.leaves: list[dict[tuple[str, ...], float]] = []
        for order in range(3):
            met = model.context[order]
            w = {context: mix.weight[order][bisect_right(STEPS, n) - 1] for context, n in met.items()}
            self.adds.append({gram: w[gram[:-1]] * n / met[gram[:-1]] for gram, n in model.n[order].items()})
            self.leaves.append({context: 1.0 - x for context, x in w.items()})
        self.uniform = self.leaves[0].get((), 1.0) / mix.vocabulary

    def bits(self, sentence: list[str]) -> float:
        """Bits of the sentence."""
        (one, two, three), (_, after_one, after_two), uniform = self.adds, self.leaves, self.uniform
        a, b, bits = "", "", 0.0
        for c in sentence:
            p = uniform + one.get((c,), 0.0)
            if (left := after_one.get((b,))) is not None:
                p = left * p + two.get((b, c), 0.0)
                if (left := after_two.get((a, b))) is not None:
                    p = left * p + three.get((a, b, c), 0.0)
            bits -= math.log2(p)
            a, b = b, c
        return bits


class Scale:
    """Monotone map of a distribution's summary to the graded scale: one isotonic regression for each part, and one for their mean."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.parts = [isotonic(x[:, k], y) for k in range(x.shape[1])]
        self.whole = isotonic(self._mean(x), y)

    def _mean(self, x: np.ndarray) -> np.ndarray:
        return np.mean([np.interp(x[:, k], *p) for k, p in enumerate(self.parts)], axis=0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self._mean(x), *self.whole)


class Grader:
    """Models and scale from (text, level) pairs."""

    def __init__(self, known: list[tuple[str, int]]) -> None:
        docs = [(sentence_units(t), level) for t, level in known if level in LEVELS and t]
        docs = [d for d in docs if d[0]]
        self.models: dict[int, Surprisal] = {}
        self.mix = Interpolation(1)
        self.scale: Scale | None = None
        if not docs:
            return
        scores = []
        for fold in range(FOLDS):  # the scale is fitted to scores of texts that the models haven't seen
            held = [d for k, d in enumerate(docs) if k % FOLDS == fold]
            self._train([d for k, d in enumerate(docs) if k % FOLDS != fold])
            if fold == 0:
                self.mix.fit([row for units, level in held if level in self.counts for s in units for row in self.counts[level].parts(s)])
                self._compile()
            scores += [(self.summary(u), level) for u, level in held]
        self._train(docs)
        self.counts = {}
        if len(docs) >= 20:
            self.scale = Scale(np.array([x for x, _ in scores]), np.array([float(v) for _, v in scores]))

    def _train(self, docs: list[tuple[list[list[str]], int]]) -> None:
        self.counts: dict[int, NGrams] = {}
        for units, level in docs:
            model = self.counts.setdefault(level, NGrams())
            for s in units:
                model.add(s)
        self.mix.vocabulary = len({g for m in self.counts.values() for g in m.n[0]}) + 1000
        self._compile()

    def _compile(self) -> None:
        self.models = {level: Surprisal(m, self.mix) for level, m in self.counts.items()}

    def summary(self, sentences: list[list[str]]) -> list[float]:
        """Mean and quantiles, over the sentences, of the level that their surprisals let expect; long sentences count a little more."""
        of, weight = [], []
        for s in sentences:
            bits = {level: m.bits(s) for level, m in self.models.items()}
            least = min(bits.values(), default=0.0)
            p = {level: 2.0 ** -min(60.0, b - least) for level, b in bits.items()}
            of.append(sum(level * q for level, q in p.items()) / sum(p.values()) if p else 2.0)
            weight.append(math.sqrt(len(s)))
        x, w = np.array(of), np.array(weight)
        order = np.argsort(x, kind="stable")
        upto = (np.cumsum(w[order]) - w[order] / 2) / w.sum()
        return [float((x * w).sum() / w.sum()), *np.interp(QUANTILES, upto, x[order]).tolist()]

    def grade(self, text: str) -> float | None:
        """The level on the graded scale, before it is rounded."""
        units = sentence_units(text)
        if not units:
            return None
        x = self.summary(units)
        return float(self.scale(np.array([x]))[0]) if self.scale else x[0]


def grader(known: DataFrame, column: str = "text", level: str = "known_level") -> Grader:
    """Train on rows of (text, level)."""
    rows = known.filter(F.col(level).isNotNull() & (F.length(column) > 0)).select(F.col(column).alias("t"), F.col(level).cast("int").alias("v")).distinct()
    every = max(1, rows.count())
    rows = rows.filter(F.pmod(F.xxhash64("t"), F.lit(every)) < TRAIN_TEXTS)
    return Grader(sorted((r["t"], r["v"]) for r in rows.collect()))


def levels(df: DataFrame, model: Grader, key: str = "request_id", column: str = "text") -> DataFrame:
    """key, reading_score (1 to 3) and reading_level of each row with words."""
    shared = Shared(df.sparkSession, model, lambda m: m)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grade = shared.get().grade
        for b in batches:
            scores = [(k, grade(t)) for k, t in zip(b[key], b[column], strict=True) if isinstance(t, str)]
            scores = [(k, s, math.ceil(s - 0.5)) for k, s in scores if s is not None]
            if scores:
                yield pd.DataFrame(scores, columns=[key, "reading_score", "reading_level"])

    return df.select(key, column).mapInPandas(run, f"{key} {kind}, reading_score double, reading_level long")
