"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

A lexicon of words and word stems is learned from the labelled sample by their smoothed log-odds. A text's features are
counts and densities of lexicon hits, hits near a second-person word, hits that only show after undoing obfuscation,
capitals, punctuation, symbols and lengths. Trees are fitted in numpy on the driver to at most `train_rows` labelled
documents chosen by a hash of their id; a part of the sample that no tree sees calibrates the scores (pool adjacent
violators). Only counts of words and rows of features reach the driver, never texts, so their length doesn't matter.
Scoring is one pass without any shuffle and reads every text whole.

Null and empty texts have all-zero features and are scored like any other. Rows are scored one by one, so repeated rows
agree; an empty table gives no rows. Several labels for one id count as their maximum. Without both classes in the sample
every score is the sample's toxic rate (0 if empty). score() hands on the columns that the caller names, such as a struct
of them all, and ignores others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .language import held_out

#: Bound of the labelled sample: rows of each class.
TRAIN_ROWS = 4000
LEXICON = 600
STEMS = (4, 5, 6)
#: Least log-odds of a lexicon entry.
LEAST_ODDS = 2.0
NEAR = 5
WORD = re.compile(r"[^\W\d_]+")
#: A sign or digit with a letter behind it, and what is left of a token that has one once its outer marks are gone.
ODD = re.compile(r"[0-9@$!*._+|-](?=[^\W\d_])")
TOKEN, OUTER = re.compile(r"\S*"), ".,;:?!()[]{}<>\"'*_+|-"
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-*_]){3,}[^\W\d_](?!\w)")
# Characters that stand for letters, and second-person words of the corpus's languages.
LEET = str.maketrans("013457@$!|", "oieastasil")
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted tú ti tus".split())
FEATURES = ("words", "hits", "density", "stem_hits", "stem_density", "weight", "top", "near_you", "hidden", "capitals", "shouts", "marks", "symbols", "digits")


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    @classmethod
    def learn(cls, counts: list[tuple[str, int, int]], bad: int, good: int, most: int = LEXICON) -> Lexicon:
        """From (w:word or s:stem, toxic texts, other texts that have it): those at least e^2 times likelier in toxic texts,
        the best `most` of them."""
        rated = sorted(((log_odds(k, n, bad, good), k, w) for w, k, n in counts), key=lambda x: (-x[0] * math.log1p(x[1]), x[2]))
        top = [(s, w) for s, _, w in rated if s > LEAST_ODDS][:most]
        return cls({w[2:]: s for s, w in top if w[0] == "w"}, {w[2:]: s for s, w in top if w[0] == "s"})


def log_odds(k: int, n: int, bad: int, good: int) -> float:
    return math.log((k + 0.5) / (bad + 1) * (good + 1) / (n + 0.5))


def marks(text: str) -> set[str]:
    """The words and stems of a text, each once."""
    words = set(WORD.findall(text.lower()))
    return {f"w:{w}" for w in words} | {f"s:{w[:n]}" for w in words for n in STEMS if len(w) > n}


def features(text: str, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    lowered = text.lower()
    words = WORD.findall(lowered)
    n, distinct = max(1, len(words)), set(words)
    hits = stem_hits = near = hidden = 0
    weight = top = 0.0
    known = distinct & lexicon.words.keys()
    stemmed = {w for w in distinct if len(w) > 4 and (w[:4] in lexicon.stems or w[:5] in lexicon.stems or w[:6] in lexicon.stems)}
    if known or stemmed:
        worth = {w: max(lexicon.words.get(w, 0.0), *(lexicon.stems.get(w[:k], 0.0) for k in STEMS)) for w in known | stemmed}
        for i, w in enumerate(words):
            if w in worth:
                hits += 1
                weight += worth[w]
                top = max(top, worth[w])
                near += any(x in YOU for x in words[max(0, i - NEAR) : i + NEAR + 1])
                stem_hits += w in stemmed
    for token in disguised(lowered):
        letters = "".join(ch for ch in token.translate(LEET) if ch.isalpha())
        hidden += letters in lexicon.words and letters != token
    for m in SPACED.finditer(lowered):
        hidden += "".join(ch for ch in m[0] if ch.isalpha()) in lexicon.words
    k = len(text)
    capitals, signs, digits = counted(text)
    return [
        math.log1p(len(words)), float(hits), hits / n, float(stem_hits), stem_hits / n, weight / n, top, near / n, float(hidden), capitals / k,
        (len(SHOUT.findall(text)) if capitals > 2 else 0) / n, (text.count("!") + text.count("?")) / k, signs / k, digits / k,
    ]


def disguised(text: str) -> Iterator[str]:
    """The tokens in which a sign or digit stands before a letter, without marks around them; each part of the text is passed
    over once."""
    done = 0
    for m in ODD.finditer(text):
        if m.start() >= done:
            a = m.start()
            while a > done and not text[a - 1].isspace():
                a -= 1
            done = TOKEN.match(text, m.start()).end()
            yield text[a:done].strip(OUTER)


SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
#: Class of each character below 256: 1 capital, 2 sign, 3 digit.
KIND = np.zeros(257, np.uint8)
for _marks, _kind in (("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", 1), ("#*$%&|<>@~^", 2), ("0123456789", 3)):
    KIND[[ord(_x) for _x in _marks]] = _kind


def counted(text: str) -> tuple[int, int, int]:
    """How many capitals, signs and digits a text has."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    times = np.bincount(KIND[np.minimum(codes, 256)], minlength=4)
    return int(times[1]), int(times[2]), int(times[3])


@dataclass
class Tree:
    """A complete binary tree of fixed depth: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := at < len(self.feature)).any():
            at = np.where(inner, 2 * at + 1 + (x[np.arange(len(x)), self.feature[np.minimum(at, len(self.feature) - 1)]] > self.threshold[np.minimum(at, len(self.feature) - 1)]), at)
        return self.leaf[at - len(self.feature)]


def grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> Tree:
    """Best second-order gain over histograms, level by level; a node without gain sends all its rows left."""
    inner = 2**depth - 1
    feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        best = (1e-6, 0, np.inf)
        for f, e in enumerate(edges):
            if len(e) and len(rows):
                gs, hs = np.bincount(bins[rows, f], g[rows], len(e) + 1).cumsum(), np.bincount(bins[rows, f], h[rows], len(e) + 1).cumsum()
                gl, hl = gs[:-1], hs[:-1]
                gain = gl**2 / (hl + ridge) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, e[k])
        feature[node], threshold[node] = best[1], best[2]
        at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
    leaf = np.zeros(inner + 1)
    for k in range(inner + 1):
        rows = at == inner + k
        leaf[k] = -g[rows].sum() / (h[rows].sum() + ridge)
    return Tree(feature, threshold, leaf)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone step fit: pool adjacent violators over rows by score, equal scores as one."""
    levels, where, n = [], *np.unique(score, return_counts=True)
    means = [y[score == s].mean() for s in where]
    for s, value, weight in zip(where, means, n, strict=True):
        levels.append([s, s, value, weight])
        while len(levels) > 1 and levels[-2][2] >= levels[-1][2]:
            a, b = levels[-2], levels.pop()
            levels[-1] = [a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / (a[3] + b[3]), a[3] + b[3]]
    return np.array([s for a in levels for s in a[:2]]), np.array([a[2] for a in levels for _ in range(2)])


@dataclass
class Model:
    lexicon: Lexicon
    base: float
    rate: float = 0.2
    trees: list[Tree] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self.rate * t(x) for t in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-self.raw(x)))
        return np.clip(p if self.knots is None else np.interp(p, *self.knots), 0, 1)


def train(x: np.ndarray, labels: np.ndarray, later: np.ndarray, lexicon: Lexicon, trees: int = 40, depth: int = 3) -> Model:
    """Trees from the rows of features x that are not `later`; the later ones calibrate."""
    y = labels[~later].astype(float)
    rate = float(np.clip(y.mean() if len(y) else labels.mean(), 1e-3, 1 - 1e-3))
    model, xf = Model(lexicon, math.log(rate / (1 - rate))), x[~later]
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, 33)[1:-1])) if len(np.unique(v)) > 32 else (np.unique(v)[:-1] + np.unique(v)[1:]) / 2 for v in xf.T]
    bins = np.column_stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, xf.T, strict=True)])
    raw = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        model.trees.append(grow(xf, bins, edges, p - y, p * (1 - p), depth, 1.0))
        raw += model.rate * model.trees[-1](xf)
    if len(np.unique(labels[later])) == 2:
        model.knots = isotonic(model.score(x[later]), labels[later].astype(float))
    return model


def sample(docs: DataFrame, labels: DataFrame, most: int, seed: int) -> DataFrame:
    """text, toxic, later (a quarter of the rows) of at most `most` ids of each class, by a hash of the id. Ids are chosen
    before texts are read."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [tuple(r) for y in (0, 1) for r in rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "toxic").collect()]
    side = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    later = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)) == 0
    return docs.select("doc_id", "text").join(F.broadcast(side), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), later.alias("later"))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, seed: int = 1) -> Model:
    """The model of a bounded sample of labelled documents. Words are counted and features built where the texts are."""
    keep = c.Scratch(docs)
    chosen = keep(sample(docs, labels, most, seed), "toxic-sample")
    sizes = {(r.toxic, r.later): r["count"] for r in chosen.groupBy("toxic", "later").count().collect()}
    bad, good = sizes.get((1, False), 0), sizes.get((0, False), 0)
    if not bad or not good:
        all_ = sum(sizes.values())
        rate = sum(k for (y, _), k in sizes.items() if y) / all_ if all_ else 0.0
        keep.close()
        return Model(Lexicon(), 0.0, knots=(np.array([0.0, 1.0]), np.array([rate, rate])))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column("text"), b.column("toxic"), strict=True):
                found = sorted(marks(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic.as_py()] * len(found), pa.int32())], names=["mark", "toxic"])

    counted = chosen.where("NOT later").mapInArrow(c.released(listed), "mark string, toxic int").groupBy("mark").agg(F.sum("toxic").alias("k"), F.sum(1 - F.col("toxic")).alias("n")).where("k >= 3")
    odds = F.log((F.col("k") + 0.5) / (bad + 1) * (good + 1) / (F.col("n") + 0.5))
    best = counted.where(odds > LEAST_ODDS).orderBy(F.desc(odds * F.log1p("k")), "mark").limit(LEXICON)
    lexicon = Lexicon.learn([(r.mark, r.k, r.n) for r in best.collect()], bad, good)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py(), lexicon) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic"), b.column("later")], names=["x", "toxic", "later"])

    rows = sorted(tuple(r) for r in chosen.mapInArrow(c.released(measured), "x array<double>, toxic int, later boolean").collect())
    keep.close()
    x, y, later = (np.array(v) for v in zip(*rows, strict=True))
    return train(x.reshape(-1, len(FEATURES)), y, later, lexicon)


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns with score."""
    kept = docs.select(*columns, *([] if "text" in columns else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "", model.lexicon) for t in b.column("text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in columns), pa.array(model.score(x), pa.float64())], names=[*columns, "score"])

    return kept.mapInArrow(c.released(run), kept.select(*columns, F.lit(0.0).alias("score")).schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents")
    model = fit(docs, c.read(spark, sf_dir, "labels").where(~held_out(5, 0)))
    out = score(docs, model)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
