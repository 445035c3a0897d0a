"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a text are densities of toxic words (a plain list, the same after
undoing obfuscation, and word stems induced from the training fold by their
log-odds), how near they stand to a second person, capitals, punctuation and
obfuscation rates. The induced list is cross-fitted: trees see each training
text only through stems found without it. Scores of texts the trees have not
seen fit the isotonic calibration. All is numpy, on a bounded sample
(``SAMPLE`` labelled texts by hash of the id); the model's size is bounded by
``STEMS`` and the number of trees.

Defined cases: null and empty texts have all features zero and get the score
of such a text; equal texts get equal scores, whatever their id; a null id is
never held out; rows with null or repeated ids are scored like others; an empty
table gives an empty result; without labelled texts, or with one class only, every score is
the share of toxic labels (0 if none).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of, held_out, id_crc, sliced, table
from .sampling import labelled_texts

SAMPLE, STEMS, TREES, DEPTH, RATE, BINS = 6000, 4000, 80, 3, 0.15, 96
PREFIXES = (4, 5, 6, 7)
INSULTS = frozenset(
    """idiot idiots moron morons stupid dumb loser losers clown clowns scum trash garbage worthless pathetic
    disgusting fool fools imbecile jerk creep freak ugly filthy vermin coward liar hate kill die
    imbécile idiote crétin débile ordure connard salaud dummkopf trottel abschaum dreckig idioten
    estúpido estúpida imbécil basura asqueroso inútil""".split()
)
SECOND = frozenset("you your yours yourself u ur tu toi te vous votre vos ton ta tes du dich dir dein deine ihr euch tú ti usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"[^\W_]+")
#: A run that hides letters: a letter, then digits or symbols, then a letter; hyphens alone hide nothing.
HIDDEN = re.compile(r"[^\W\d_][0-9@$!|*.\-]+[^\W_][\w@$!|*.\-]*+")
HIDES = re.compile(r"[0-9@$!|*.]")
SPACED = re.compile(r"\b(?:[^\W\d_][ .\-]){3,}[^\W\d_]\b")
NONE, STEM, STRONG, PLAIN, SECONDP = range(5)
FEATURES = 16


def terms(word: str) -> list[str]:
    """The word and its stems, a stem marked by a trailing star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def induced(texts: list[tuple[str, int]]) -> dict[str, float]:
    """Stems and words with high smoothed log-odds of document frequency."""
    df: dict[str, int] = {}
    n_pos = n_neg = 0
    for text, y in texts:
        if y == 1:
            n_pos += 1
            for t in {t for w in set(WORD.findall(text.lower())) for t in terms(w)}:
                df[t] = df.get(t, 0) + 1
    df = {t: c for t, c in df.items() if c >= max(4, n_pos // 200)}
    other = dict.fromkeys(df, 0)
    for text, y in texts:
        if y != 1:
            n_neg += 1
            for t in {t for w in set(WORD.findall(text.lower())) for t in terms(w)}:
                if t in other:
                    other[t] += 1
    if not n_pos or not n_neg:
        return {}
    odds = {t: float(np.log((c + 0.5) / (n_pos + 1)) - np.log((other[t] + 0.5) / (n_neg + 1))) for t, c in df.items()}
    best = sorted((t for t in odds if odds[t] > 1.2), key=lambda t: (-odds[t] * df[t] ** 0.5, t))[:STEMS]
    return {t: odds[t] for t in best}


class Features:
    """Dense features of a text, given the induced stems."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.memo: dict[str, int] = {}

    def code(self, word: str) -> int:
        if word in INSULTS:
            return PLAIN
        if word in SECOND:
            return SECONDP
        best = max((self.stems.get(t, 0.0) for t in terms(word)), default=0.0)
        return STRONG if best > 2.8 else STEM if best > 0 else NONE

    def of(self, text: str | None) -> np.ndarray:
        out = np.zeros(FEATURES)
        if not text:
            return out
        words = WORD.findall(text.lower())
        memo = self.memo
        if len(memo) > 300_000:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.code(w)
        codes = np.fromiter(map(memo.__getitem__, words), np.uint8, len(words))
        n = max(1, len(words))
        count = np.bincount(codes, minlength=5)
        toxic = np.flatnonzero((codes == STRONG) | (codes == PLAIN))
        near = 0
        if len(toxic) and count[SECONDP]:
            second = np.flatnonzero(codes == SECONDP)
            at = np.searchsorted(second, toxic)
            gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - toxic), np.abs(second[np.maximum(at - 1, 0)] - toxic))
            near = int((gap <= 3).sum())
        hidden = [m.group(0) for m in HIDDEN.finditer(text) if HIDES.search(m.group(0))] if any(c in text for c in "013457@$!|*") else []
        undone = sum(t.lower().translate(LEET).replace("*", "").replace(".", "").replace("-", "") in INSULTS for t in hidden)
        spaced = [re.sub(r"[ .\-]", "", m.group(0)).lower() for m in SPACED.finditer(text)]
        chars = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        upper = int(((chars >= 65) & (chars <= 90)).sum())
        letters = max(1, int((((chars | 32) >= 97) & ((chars | 32) <= 122)).sum()))
        bang, ask = int((chars == 33).sum()), int((chars == 63).sum())
        punct = int(((chars > 32) & (chars < 48)).sum())
        insults = count[PLAIN] + undone + sum(s in INSULTS for s in spaced)
        out[:] = (
            insults / n, np.log1p(insults), count[STRONG] / n, np.log1p(count[STRONG]), (count[STEM] + count[STRONG]) / n,
            (count[STRONG] + insults) / n, len(set(np.array(words, object)[toxic])) if len(toxic) else 0, near / n,
            count[SECONDP] / n, upper / letters, bang / len(chars), ask / len(chars), punct / len(chars),
            len(hidden) / n, len(spaced) / n, np.log1p(len(words)),
        )
        return out


class Trees:
    """Histogram gradient boosting with the logistic loss."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        # cuts by share of rows and by share of distinct values: most densities are zero in most texts
        grid = np.linspace(0, 1, BINS // 2)[1:-1]
        self.cuts = [np.unique(np.concatenate([np.quantile(c, grid), np.quantile(np.unique(c), grid), [0.0]])) for c in x.T]
        b = self.bins(x)
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base, self.trees = np.log(share / (1 - share)), []
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self.grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += RATE * self.leaf(tree, b)
        return self

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], axis=1)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete binary tree: feature and bin of each inner node, value of each leaf."""
        inner = (1 << DEPTH) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS + 1)
        node = np.zeros(len(g), np.int64)
        for at in range(inner):
            own = np.flatnonzero(node == at)
            best = 1e-6
            if len(own) >= 20:
                total_g, total_h = g[own].sum(), h[own].sum()
                for k in range(b.shape[1]):
                    cg = np.cumsum(np.bincount(b[own, k], g[own], BINS + 1))[:-1]
                    ch = np.cumsum(np.bincount(b[own, k], h[own], BINS + 1))[:-1]
                    n = np.cumsum(np.bincount(b[own, k], minlength=BINS + 1))[:-1]
                    gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                    gain[(n < 8) | (len(own) - n < 8)] = 0
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, feature[at], cut[at] = gain[i], k, i
            node[own] = 2 * at + 1 + (b[own, feature[at]] > cut[at])
        leaf = node - inner
        value = np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + 1)
        return feature, cut, value

    @staticmethod
    def leaf(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.base + RATE * sum((self.leaf(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the calibrated share."""
    order = np.argsort(raw, kind="stable")
    knots: list[list[float]] = []
    for r, v in zip(raw[order], y[order]):
        knots.append([r, v, 1.0, r])
        while len(knots) > 1 and knots[-2][1] / knots[-2][2] >= knots[-1][1] / knots[-1][2]:
            _, v1, n1, hi = knots.pop()
            knots[-1][1] += v1
            knots[-1][2] += n1
            knots[-1][3] = hi
    return np.array([(k[0] + k[3]) / 2 for k in knots]), np.array([k[1] / k[2] for k in knots])


class Model:
    def __init__(self, rows: list[tuple[int, str, int]]):
        y = np.array([r[2] for r in rows], float)
        self.share = float(y.mean()) if len(y) else 0.0
        self.trees: Trees | None = None
        self.features = Features({})
        if len(set(y)) < 2:
            return
        fold = np.array([crc_of(f"fold-{r[0]}") % 3 for r in rows])
        x = np.zeros((len(rows), FEATURES))
        for k in range(3):
            own = Features(induced([(t, int(v)) for (_, t, _), v, f in zip(rows, y, fold) if f != k]))
            for i in np.flatnonzero(fold == k):
                x[i] = own.of(rows[i][1])
        raw = np.zeros(len(rows))
        for k in range(3):
            if len(set(y[fold != k])) == 2 and (fold == k).any():
                raw[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
        self.knots, self.values = isotonic(raw, y)
        self.trees = Trees().fit(x, y)
        self.features = Features(induced([(t, int(v)) for (_, t, _), v in zip(rows, y)]))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        raw = self.trees.raw(np.array([self.features.of(t) for t in texts]).reshape(-1, FEATURES))
        # a little of the raw order is kept inside the calibrated steps
        return 0.98 * np.interp(raw, self.knots, self.values) + 0.02 / (1 + np.exp(-raw))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            got = shared.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = Model(labelled_texts(docs, labels, "toxic", id_crc() % 3 != 1, SAMPLE))
    return score(docs, model).select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
