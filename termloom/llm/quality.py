"""Quality classifier: supervised subword embeddings.

Words and the character n-grams (``GRAMS`` bytes, the blank around a word
included) of a text are hashed into ``2 ** BITS`` rows of learned vectors; two
more rows say of each word whether it repeats the one before it. A
text is the average of its vectors, a softmax layer gives the two classes, and
numpy stochastic gradient descent trains both on a bounded sample (``SAMPLE``
labelled texts by hash of the id), whole texts. As the softmax of two classes
is linear in the average, scoring folds the layer into one number a row: a text
costs hashing and one gather for each n-gram. The score is Platt-calibrated on
a tenth of the sample that training leaves out.

Defined cases: null, empty and blank texts have no feature and get the prior's
score; equal texts get equal scores, whatever their id; a null id is never held
out; rows with null or repeated ids are scored like others; an empty table gives
an empty result; without labelled texts, or with one class only, every score is the share
of label 1 (1 if there is none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of, held_out, id_crc, sliced, table
from .sampling import labelled_texts

SAMPLE, BITS, DIM, EPOCHS, RATE, GRAMS = 3000, 18, 8, 6, 0.5, (3, 4, 5)
BASE = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: Texts are hashed together up to so many bytes.
BLOCK = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def buckets(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature rows of texts laid end to end, blanks between: (bucket, text number) for n-grams of each length, words, and whether a word repeats the one before."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    b = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    blank = BLANKS[b]
    wide = np.where(blank, np.uint8(32), b).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), lengths)
    owner = np.append(owner, len(texts) - 1) if len(texts) else owner
    down = np.uint64(64 - BITS)
    out = []
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = wide[:m]
        for i in range(1, n):
            h = h * BASE + wide[i : m + i]
        inner = np.zeros(m, bool)  # a blank may stand only at either end
        for i in range(1, n - 1):
            inner |= blank[i : m + i]
        at = np.flatnonzero(~inner & ~(blank[:m] & blank[n - 1 :]))
        out.append((((h[at] + np.uint64(n)) * MIX >> down).astype(np.int64), owner[at]))
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    stops = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(wide * powers(BASE, len(wide)), dtype=np.uint64)])
    h = (total[stops] - total[starts]) * powers(BACK, len(wide) + 1)[starts]
    out.append((((h + np.uint64(1)) * MIX >> down).astype(np.int64), owner[starts]))
    same = (h[1:] == h[:-1]) & (owner[starts[1:]] == owner[starts[:-1]])
    out.append(((1 << BITS) + same.astype(np.int64), owner[starts[1:]]))  # two rows of their own
    return out


def blocks(texts: list[bytes]):
    """Runs of texts of about BLOCK bytes; a longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


class Model:
    """``weight`` of each row, ``bias``; a text's logit is the mean weight plus the bias."""

    def __init__(self, rows: list[tuple[int, str, int]], seed: int = 7):
        y = np.array([r[2] for r in rows], np.int64)
        self.weight = np.zeros((1 << BITS) + 2, np.float32)
        self.bias = 0.0
        share = float(np.clip(y.mean() if len(y) else 1.0, 1e-4, 1 - 1e-4))
        self.bias = float(np.log(share / (1 - share)))
        if len(set(y.tolist())) < 2:
            return
        sparse = []
        for _, text, _ in rows:
            found = [f[0] for f in buckets([text.encode("utf-8", "surrogatepass")])]
            u, c = np.unique(np.concatenate(found), return_counts=True)
            sparse.append((u.astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
        test = np.array([crc_of(f"calibrate-{r[0]}") % 10 == 0 for r in rows])
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, ((1 << BITS) + 2, DIM)).astype(np.float32)
        layer = np.zeros((DIM, 2), np.float32)
        prior = np.log(np.array([1 - share, share], np.float32))
        train = np.flatnonzero(~test)
        steps, done = EPOCHS * len(train), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(train):
                u, c = sparse[i]
                hidden = c @ vectors[u]
                z = hidden @ layer + prior
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                rate = RATE * 20 * (1 - done / steps)
                back = layer @ p
                layer -= rate / 20 * np.outer(hidden, p)
                vectors[u] -= (rate * c)[:, None] * back[None]
                done += 1
        self.weight = (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32)
        z = np.array([c @ self.weight[u] for u, c in sparse])
        self.slope = 1.0
        own = test if len(set(y[test].tolist())) == 2 else np.ones(len(y), bool)
        self.slope, self.bias = platt(z[own], y[own], self.bias)

    slope = 1.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        mean = np.zeros(len(data))
        for at, part in blocks(data):
            total, count = np.zeros(len(part)), np.zeros(len(part))
            for bucket, owner in buckets(part):
                total += np.bincount(owner, self.weight[bucket], len(part))
                count += np.bincount(owner, minlength=len(part))
            mean[at : at + len(part)] = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * mean + self.bias, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray, bias: float) -> tuple[float, float]:
    """Slope and bias of a logistic fit by Newton's method, with a weak pull to (1, prior)."""
    w = np.array([1.0, bias])
    x = np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.01 * (w - np.array([1.0, bias]))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.05)), float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            got = shared.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = Model(labelled_texts(docs, labels, "quality", id_crc() % 5 != 0, SAMPLE))
    return score(docs, model).select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLES: dict[str, str] = {}
