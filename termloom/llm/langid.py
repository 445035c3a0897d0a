"""Language identification by interpolated Kneser-Ney character models.

One model for each language, orders 1 to ``ORDER``, over lower-cased letters
with everything else folded to one blank. The models share sorted arrays of
hashed n-grams; beside every n-gram stands its interpolated probability in each
language, so scoring is one binary search an order. A document goes to the
language with the lowest cross-entropy per character; the score is the softmax
of entropy margins at a temperature fitted on training texts. A text of at least
``SHORT`` characters is rejected if its entropy lies nearer to that of random
letters than to that of the worst training text.

The counts come from a bounded sample of labelled texts (``SAMPLE`` a language,
by hash of the id), whole texts. The model is then at most ``MAX_GRAMS`` n-grams
of the longest order: rare ones are pruned first, so a broadcast model has a
fixed bound. The alphabet is every letter of the sample, up to the ``LETTERS``
most frequent, which keeps n-grams of four exact in 64 bits. Temperature and
limits come from every ``HELD``-th text of a language, which the model they are
fitted with has not counted (a language with fewer texts is fitted on its own).

Defined cases: null texts and texts without a letter are ``und``, score 0, rejected;
letters never seen in training share one unknown symbol; equal entropies go to
the language that sorts first; without a training text every text is ``und``;
rows with a null or repeated doc_id are scored like any others and may train, a
null id is never held out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, id_crc, sliced, table

ORDER, SAMPLE, MAX_GRAMS, SHORT, LETTERS, HELD = 4, 400, 400_000, 60, 65_000, 5
UNKNOWN, BLANK = 1, 0
MIX = np.uint64(0x9E3779B97F4A7C15)


class Alphabet:
    """Code points -> small symbols; blank for non-letters, one symbol for unknown letters."""

    def __init__(self, letters: str):
        self.known = {ord(c): i + 2 for i, c in enumerate(sorted(set(letters)))}
        self.size = len(self.known) + 2
        self.low = np.zeros(0x3000, np.uint8 if self.size <= 255 else np.uint16)
        for cp in range(0x3000):
            if chr(cp).isalpha():
                self.low[cp] = self.known.get(cp, UNKNOWN)
        self.high = {c: s for c, s in self.known.items() if c >= 0x3000}

    def symbols(self, text: str) -> np.ndarray:
        cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        far = cps >= 0x3000
        if far.any():
            out = self.low[np.where(far, 0, cps)].copy()
            out[far] = [self.high.get(c, UNKNOWN if chr(c).isalpha() else BLANK) for c in cps[far].tolist()]
        else:
            out = self.low[cps]
        keep = np.ones(len(out), bool)  # runs of blanks count once
        keep[1:] = (out[1:] != BLANK) | (out[:-1] != BLANK)
        out = out[keep]
        if not (out != BLANK).any():
            return out[:0]
        return np.concatenate([[BLANK], out[int(out[0] == BLANK) :], [BLANK][: int(out[-1] != BLANK)]]).astype(np.uint64)


def grams(symbols: np.ndarray, n: int, size: int) -> np.ndarray:
    """Hashes of the n-grams that end at each symbol from the n-th on."""
    if len(symbols) < n:
        return np.zeros(0, np.uint64)
    key = np.zeros(len(symbols) - n + 1, np.uint64)
    for i in range(n):
        key = key * np.uint64(size) + symbols[i : len(symbols) - n + 1 + i]
    return key * MIX  # odd multiplier: one to one, so equal hashes are equal n-grams


class SortedHashes:
    """Sorted array of hashes with a table of where each leading-bits bucket starts."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))  # a guard that no bucket reaches
        bits = max(4, len(keys).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(keys)))
        self.deepest = int(np.diff(self.start).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 where it is absent."""
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.where((at < end) & (self.keys[at] == h), at, -1)
        for step in range(1, self.deepest):
            more = np.flatnonzero((out < 0) & (at + step < end))
            if not len(more):
                break
            ok = self.keys[at[more] + step] == h[more]
            out[more[ok]] = at[more[ok]] + step
        return out


class Model:
    """Interpolated Kneser-Ney models of several languages over shared sorted hash arrays."""

    def __init__(self, langs: list[str], alphabet: Alphabet, counts: list[list[tuple[np.ndarray, np.ndarray]]]):
        """counts[lang][n - 1]: hashes and counts of n-grams."""
        self.langs, self.alphabet = langs, alphabet
        self.index: list[SortedHashes] = []
        self.context: list[SortedHashes] = []
        self.logp: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        size = np.uint64(alphabet.size)
        unmix = np.uint64(pow(int(MIX), -1, 1 << 64))
        lower_keys, lower_p = np.zeros(1, np.uint64), None
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([c[n - 1][0] for c in counts])) if counts else np.zeros(0, np.uint64)
            p = np.zeros((len(keys), len(langs)))
            raw = keys * unmix
            context = raw // size
            suffix = (raw % np.uint64(alphabet.size ** (n - 1))) * MIX
            ctx_ids, ctx = np.unique(context, return_inverse=True)
            back = np.ones((len(ctx_ids), len(langs)))
            for k in range(len(langs)):
                c = np.zeros(len(keys))
                c[np.searchsorted(keys, counts[k][n - 1][0])] = counts[k][n - 1][1]
                if n < ORDER:  # continuation counts: distinct symbols that stand before
                    wide = counts[k][n][0] * unmix
                    tail = (wide % np.uint64(alphabet.size**n)) * MIX
                    u, m = np.unique(tail, return_counts=True)
                    c = np.zeros(len(keys))
                    c[np.searchsorted(keys, u)] = m
                ones, twos = (c == 1).sum(), (c == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                total = np.bincount(ctx, c, len(ctx_ids))
                kinds = np.bincount(ctx, c > 0, len(ctx_ids))
                with np.errstate(divide="ignore", invalid="ignore"):
                    seen = np.where(total[ctx] > 0, np.maximum(c - d, 0) / total[ctx], 0)
                    back[:, k] = np.where(total > 0, d * kinds / total, 1)
                if n == 1:
                    below = np.full(len(keys), 1 / alphabet.size)
                else:
                    below = lower_p[np.searchsorted(lower_keys, suffix), k]  # type: ignore[index]
                p[:, k] = seen + back[ctx, k] * below
            if n == 1:  # a symbol that no text held
                self.floor = np.log(back[0] / alphabet.size) if len(back) else np.zeros(len(langs))
            self.index.append(SortedHashes(keys))
            self.logp.append(np.log(p).astype(np.float32))
            order = np.argsort(ctx_ids * MIX)
            self.context.append(SortedHashes((ctx_ids * MIX)[order]))
            self.back.append(np.log(back[order]).astype(np.float32))
            lower_keys, lower_p = keys, p

    def entropies(self, symbols: np.ndarray) -> np.ndarray:
        """Cross-entropy per character (nats) in each language.

        The longest n-gram is looked up for every symbol; where it is unseen the
        weight of its context is taken and the next lower order tried.
        """
        size = self.alphabet.size
        total = np.zeros(len(self.langs))
        at = np.arange(1, len(symbols))  # the first blank is context only
        for n in range(ORDER, 0, -1):
            early = at[: np.searchsorted(at, n - 1)] if n > 1 else at[:0]  # no whole context yet
            at = at[len(early) :]
            key = symbols[at - (n - 1)]
            for i in range(n - 2, -1, -1):
                key = key * np.uint64(size) + symbols[at - i]
            row = self.index[n - 1].find(key * MIX)
            hit = row >= 0
            total += self.logp[n - 1][row[hit]].sum(axis=0, dtype=np.float64)
            at = at[~hit]
            if n > 1:
                ctx = self.context[n - 1].find(key[~hit] // np.uint64(size) * MIX)
                total += self.back[n - 1][ctx[ctx >= 0]].sum(axis=0, dtype=np.float64)
                at = np.concatenate([early, at])
            else:
                total += self.floor * len(at)
        return -total / (len(symbols) - 1)

    def calibrate(self, texts: list[tuple[str, str]]) -> None:
        """Temperature of the score and entropy limits of rejection, from labelled texts."""
        self.temperature, self.limit = 10.0, {}
        if not self.langs:
            return
        margins, own = [], {k: [] for k in self.langs}
        for text, lang in texts:
            s = self.alphabet.symbols(text)
            if len(s) < 2:
                continue
            e = self.entropies(s)
            k = self.langs.index(lang)
            own[lang].append(e[k])
            margins.append(e - e[k])
        m = np.array(margins) if margins else np.zeros((1, len(self.langs)))
        best = (np.inf, 10.0)
        for t in np.geomspace(1, 200, 40):
            loss = np.log(np.exp(np.clip(-t * m, -50, 50)).sum(axis=1)).mean()
            best = min(best, (loss, t))
        self.temperature = best[1]
        # rejection: half way from the worst training text to letters drawn at random
        noise = np.random.default_rng(1).integers(2, self.alphabet.size, 4000) if self.alphabet.size > 2 else np.zeros(0)
        random = self.entropies(np.concatenate([[BLANK], noise]).astype(np.uint64)) if len(noise) else np.full(len(self.langs), np.inf)
        self.limit = {k: ((max(own[k]) + random[i]) / 2 if own[k] else np.inf) for i, k in enumerate(self.langs)}

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, entropy, rejected."""
        s = self.alphabet.symbols(text or "")
        if not self.langs or len(s) < 2:
            return "und", 0.0, 0.0, True
        e = self.entropies(s)
        k = int(e.argmin())
        p = float(1 / np.exp(np.clip(-self.temperature * (e - e[k]), -700, 0)).sum())
        return self.langs[k], p, float(e[k]), bool(len(s) >= SHORT and e[k] > self.limit[self.langs[k]])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: doc_id, text, lang. At most ``sample`` texts a language are taken."""
    ranked = labelled.where("text is not null and lang is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    # salted first pass: a hot language is cut down before its rows meet
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    few = ranked.select("lang", "h").withColumn("r", F.row_number().over(salted)).where(F.col("r") <= sample)
    # at most 64 x sample hashes a language are left, and tasks send arrays of them
    least = F.slice(F.sort_array(F.collect_list("h")), 1, sample)
    picked = {(r.lang, h) for r in few.groupBy("lang").agg(least.alias("hs")).collect() for h in r.hs}
    wanted = sorted({h for _, h in picked})
    rows = ranked.where(F.col("h").isin(wanted)).select("text", "lang", "h").collect() if wanted else []
    rows = sorted((r.lang, r.h, r.text) for r in rows if (r.lang, r.h) in picked)
    rows = [(text, lang) for at, (lang, _, text) in enumerate(rows) if at < sample or rows[at - sample][0] != lang]
    langs = sorted({lang for _, lang in rows})
    letters: dict[str, int] = {}
    for text, _ in rows:
        for c in set(text.lower()):
            if c.isalpha():
                letters[c] = letters.get(c, 0) + 1
    alphabet = Alphabet("".join(sorted(letters, key=lambda c: (-letters[c], c))[:LETTERS]))
    number = {lang: 0 for lang in langs}
    held = []
    for _, lang in rows:
        number[lang] += 1
        held.append(number[lang] % HELD == 0)
    few = {lang for lang in langs if number[lang] < HELD}
    part = counted(langs, alphabet, [r for r, h in zip(rows, held) if not h])
    part.calibrate([r for r, h in zip(rows, held) if h or r[1] in few])
    model = counted(langs, alphabet, rows)
    model.temperature, model.limit = part.temperature, part.limit
    return model


def counted(langs: list[str], alphabet: Alphabet, rows: list[tuple[str, str]]) -> Model:
    """The models of (text, lang) rows."""
    counts = []
    for lang in langs:
        symbols = [alphabet.symbols(t) for t, own in rows if own == lang]
        by_order = []
        for n in range(1, ORDER + 1):
            keys, c = np.unique(np.concatenate([grams(s, n, alphabet.size) for s in symbols]), return_counts=True)
            by_order.append((keys, c))
        for n in range(ORDER, 1, -1):  # prune the rarest of the longest first; lower orders then still hold every suffix
            keys, c = by_order[n - 1]
            if n == ORDER and len(keys) > MAX_GRAMS // max(1, len(langs)):
                top = np.sort(np.argsort(-c, kind="stable")[: MAX_GRAMS // len(langs)])
                by_order[n - 1] = (keys[top], c[top])
        counts.append(by_order)
    return Model(langs, alphabet, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, entropy, rejected`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            got = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            cols = list(zip(*got)) if got else [(), (), (), ()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            yield batch.filter(pa.array([not shared.value.predict(t)[3] for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(id_crc() % 5 != 0).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(5, 0), "lang_pred", "score", "entropy", "rejected")


QUERIES = {"op4_langid": op4_langid}
ORACLES: dict[str, str] = {}
