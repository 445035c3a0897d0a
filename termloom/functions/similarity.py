"""Sequence similarity: the one function that plain Spark lacks."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Up to this length blocks are sought by plain search, which then is quicker than SequenceMatcher.
SHORT = 24


def ratio_of(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([ratio_of(a, b) for a, b in zip(left, right)], dtype="float64")


def ratio(left, right):
    """Ratcliff/Obershelp ratio of (text, term), in Arrow batches. Not symmetric: never swap."""
    return F.pandas_udf(_ratios, "double")(left, right)


def bound(a, b, threshold: float):
    """Largest edit distance that a ratio of ``threshold`` leaves possible."""
    return F.floor(F.lit(1 - threshold) * (F.length(a) + F.length(b)) + F.lit(1e-9)).cast("int")


def in_band(a, b, threshold: float):
    """Lengths for which the ratio can reach the threshold."""
    return 2 * F.least(F.length(a), F.length(b)) >= F.lit(threshold) * (F.length(a) + F.length(b)) - F.lit(1e-9)


def candidate_pairs(texts: DataFrame, targets: DataFrame, threshold: float) -> DataFrame:
    """``text, target`` pairs within the edit-distance bound, by an equi-join.

    ``texts`` has a distinct column text, ``targets`` a distinct column target.
    A pair within distance d shares one of d + 1 segments of the target, at a
    place moved by at most d: targets post their segments, texts every part of
    a segment's length. No pair is lost and no cross join is made.
    """
    t = F.col("target")
    n = F.length(t)
    widest = F.floor(n * F.lit((2 - threshold) / threshold) + F.lit(1e-9)).cast("int")
    d = F.floor(F.lit(1 - threshold) * (n + widest) + F.lit(1e-9)).cast("int")
    posted = targets.where(n > 0).select("target", d.alias("d"), n.alias("n"))
    k = F.col("d") + 1
    start = lambda i: F.floor(i * F.col("n") / k).cast("int")
    segments = F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.struct(F.substring(F.col("target"), start(i) + 1, start(i + 1) - start(i)).alias("part"), (start(i) + 1).alias("at")))
    posted = posted.select("target", "d", F.explode(segments).alias("s")).select("target", "d", "s.part", F.col("s.at").alias("target_at")).where("part <> ''")
    facts = posted.agg(F.min(F.length("part")), F.max(F.length("part")), F.max(F.length("target"))).first()
    if facts is None or facts[0] is None:
        return targets.select(t.alias("text"), "target").limit(0)
    limit = int(facts[2] * (2 - threshold) / threshold + 1e-9)
    x = F.col("text")
    lengths = F.sequence(F.lit(facts[0]), F.least(F.lit(facts[1]), F.length(x)))
    parts = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.length(x) - m + 1), lambda i: F.struct(F.substring(x, i, m).alias("part"), i.alias("text_at")))))
    cut = texts.where((F.length(x) >= facts[0]) & (F.length(x) <= limit)).select("text", F.explode(parts).alias("p")).select("text", "p.part", "p.text_at")
    met = cut.join(posted, "part").where((F.abs(F.col("text_at") - F.col("target_at")) <= F.col("d")) & in_band(x, t, threshold)).select("text", "target").distinct()
    # with a bound as third argument the distance stops early and is -1 beyond it
    return met.where(F.call_function("levenshtein", x, t, bound(x, t, threshold)) >= 0)


def _counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and how often each of 32 classes of letters occurs."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) & 31
    cells = np.repeat(np.arange(len(words)), lengths) * 32 + letters
    return lengths, np.minimum(np.bincount(cells, minlength=32 * len(words)), 65535).reshape(-1, 32).astype(np.uint16)


def _alphabet(targets: list[str]) -> np.ndarray:
    return np.unique(np.frombuffer("".join(targets).encode("utf-32-le", "surrogatepass"), np.uint32))


def _grid(words: list[str], alphabet: np.ndarray) -> np.ndarray:
    """Letters of words as numbers from 1 in the alphabet, 0 for others and beyond the end; words as columns."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(np.searchsorted(alphabet, letters), len(alphabet) - 1)
    out = np.zeros((int(lengths.max(initial=0)), len(words)), np.int32)
    col = np.repeat(np.arange(len(words)), lengths)
    out[np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths), col] = np.where(alphabet[at] == letters, at + 1, 0)
    return out


def _common(grid: np.ndarray, rows: np.ndarray, masks: np.ndarray, targets: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Longest common subsequences of pairs (row of the grid, target of up to 64 letters), a bit for each letter of the target."""
    v = np.full(len(rows), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for letters in grid:
        u = v & masks[targets, letters[rows]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - m[targets]).astype(np.uint64)))


def _marks(counts: np.ndarray) -> np.ndarray:
    """For every class of letters two bits: whether it occurs once, and twice or more."""
    bits = np.uint64(1) << np.arange(32, dtype=np.uint64)
    return ((counts >= 1) * bits).sum(axis=1, dtype=np.uint64) | ((counts >= 2) * bits).sum(axis=1, dtype=np.uint64) << np.uint64(32)


def _matched(a: str, b: str) -> int:
    """Letters that Ratcliff/Obershelp matches: the longest common block, the first in a and then in b, and so on either side of it."""
    for size in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - size + 1):
            j = b.find(a[i : i + size])
            if j >= 0:
                return size + _matched(a[:i], b[:j]) + _matched(a[i + size :], b[j + size :])
    return 0


def _near(texts: list[str], targets: list[str], threshold: float) -> list[tuple[str, str]]:
    """Pairs by ratio. Matched letters are letters that two strings share, and a common subsequence: those bounds go first.

    Marks that only one of two strings has are letters without a match, so the marks of all go before the letters' counts.
    """
    n, have = _counts(texts)
    order = np.argsort(n, kind="stable")
    n, have = n[order], have[order]
    marks = _marks(have)
    m, want = _counts(targets)
    wanted = _marks(want)
    hits, owners, spare, size = [], [], np.zeros(0), -1
    for k in range(len(targets)):
        if m[k] != size:
            size = m[k]
            lo = np.searchsorted(n, math.ceil(size * threshold / (2 - threshold) - 1e-9))
            hi = np.searchsorted(n, math.floor(size * (2 - threshold) / threshold + 1e-9), "right")
            spare = np.minimum(np.floor((1 - threshold) * (n[lo:hi] + size) + 1e-9), 255).astype(np.uint8)
        hit = np.flatnonzero(np.bitwise_count(marks[lo:hi] ^ wanted[k]) <= spare) + lo
        shared = np.minimum(have[hit], want[k]).sum(axis=1)
        hit = hit[2.0 * shared >= threshold * (n[hit] + m[k]) - 1e-9]
        if len(hit):
            hits.append(hit)
            owners.append(np.full(len(hit), k))
    if not hits:
        return []
    return _verified(texts, targets, order[np.concatenate(hits)], np.concatenate(owners), threshold)


def _verified(texts: list[str], targets: list[str], row: np.ndarray, owner: np.ndarray, threshold: float) -> list[tuple[str, str]]:
    """Those of the pairs (number of the text, number of the target) that have the ratio: common subsequences first, then blocks."""
    used, row = np.unique(row, return_inverse=True)
    texts = [texts[i] for i in used.tolist()]
    n, m = (np.array([len(w) for w in words], np.int64) for words in (texts, targets))
    short = np.flatnonzero(m[owner] <= 64)
    if len(short):
        alphabet = _alphabet(targets)
        masks = np.zeros((len(targets), len(alphabet) + 1), np.uint64)
        letters = _grid(targets, alphabet)[:64]
        for i, line in enumerate(letters):
            masks[np.arange(len(targets)), line] |= np.uint64(1 << i)
        masks[:, 0] = 0
        grid = _grid(texts, alphabet)
        keep = np.ones(len(row), bool)
        for part in np.array_split(short, 1 + len(short) // 100_000):
            common = _common(grid[: int(n[row[part]].max())], row[part], masks, owner[part], m)
            keep[part] = 2.0 * common >= threshold * (n[row[part]] + m[owner[part]]) - 1e-9
        row, owner = row[keep], owner[keep]
    out, matcher, last = [], SequenceMatcher(None, "", ""), -1
    for i, k in zip(row.tolist(), owner.tolist()):
        text, target = texts[i], targets[k]
        if len(text) <= SHORT and len(target) <= SHORT:
            if 2.0 * _matched(text, target) / (len(text) + len(target)) < threshold:
                continue
        elif text != target:
            if k != last:
                matcher.set_seq2(target)
                last = k
            matcher.set_seq1(text)
            if matcher.ratio() < threshold:
                continue
        out.append((text, target))
    return out


def _akin(sizes: np.ndarray, letters: np.ndarray, marks: np.ndarray, targets: list[str], limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``word, target`` (numbers) that differ by at most the target's limit in letters, whatever their order."""
    order = np.argsort(sizes, kind="stable")
    n, marks = sizes[order], marks[order]
    m, want = _counts(targets)
    hits, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (wanted, limit) in enumerate(zip(_marks(want), limits)):
        lo, hi = np.searchsorted(n, m[k] - limit), np.searchsorted(n, m[k] + limit, "right")
        hit = order[lo + np.flatnonzero(np.bitwise_count(marks[lo:hi] ^ wanted) <= limit)]
        if len(hit):
            hits.append(hit[np.abs(letters[hit].astype(np.int32) - want[k]).sum(axis=1, dtype=np.int32) <= limit])
            owners.append(np.full(len(hits[-1]), k))
    return np.concatenate(hits), np.concatenate(owners)


def near_runs(vocabulary: list[str], runs: np.ndarray, targets: list[str], threshold: float) -> list[tuple[int, str]]:
    """``run, target`` of runs of words (numbers in the vocabulary, a run a row) that resemble a target when joined by blanks.

    A ratio leaves d letters without a match. Either all blanks match: then
    words face words, and one of w has at most d / w such letters. Or a blank on
    either side has no match: then the letters have at most d - 2. Only runs
    that pass one of these, and the bounds on shared letters, become strings.
    """
    if not len(runs) or not targets:
        return []
    width = runs.shape[1]
    sizes, letters = _counts(vocabulary)
    marks, half, lower = _marks(letters), np.uint64(32), np.uint64(0xFFFFFFFF)
    m, want = _counts(targets)
    n = sizes[runs].sum(axis=1) + width - 1
    order = np.flatnonzero((n >= m.min() * threshold / (2 - threshold) - 1e-9) & (n <= m.max() * (2 - threshold) / threshold + 1e-9))
    order = order[np.argsort(n[order], kind="stable")]
    runs, n = runs[order], n[order]
    once, twice = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    for more in marks[runs].T:
        twice |= (more >> half) | (once & more & lower)
        once |= more & lower
    own = once | twice << half
    bare = _marks(_counts([t.replace(" ", "") for t in targets])[1])
    spare = lambda i, k: np.floor((1 - threshold) * (n[i] + m[k]) + 1e-9).astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    # a word faces its like: marks of the letters of all words differ by no more than the letters
    split = [t.split(" ") for t in targets]
    widest = np.floor((1 - threshold) * (m + np.floor(m * (2 - threshold) / threshold + 1e-9)) + 1e-9).astype(np.int64) // width
    for at in range(width):
        by_word: dict[str, list[int]] = {}
        for k, w in enumerate(split):
            by_word.setdefault(w[at], []).append(k)
        facing = list(by_word)
        word, like = _akin(sizes, letters, marks, facing, [int(widest[by_word[w]].max()) for w in facing])
        each = np.array([len(by_word[w]) for w in facing], np.int64)
        flat = np.concatenate([np.array(by_word[w], np.int64) for w in facing])
        of = np.arange(int(each[like].sum())) - np.repeat(np.cumsum(each[like]) - each[like] - (np.cumsum(each) - each)[like], each[like])
        word, of = np.repeat(word, each[like]), flat[of]
        flat = of[np.argsort(word, kind="stable")]
        counts = np.bincount(word, minlength=len(sizes))
        starts = np.cumsum(counts) - counts
        held = np.flatnonzero(counts[runs[:, at]])
        for part in np.array_split(held, 1 + len(held) // 100_000):
            each = counts[runs[part, at]]
            i = np.repeat(part, each)
            k = flat[np.arange(len(i)) - np.repeat(np.cumsum(each) - each - starts[runs[part, at]], each)]
            keep = np.bitwise_count(own[i] ^ bare[k]) <= spare(i, k)
            found.append((i[keep], k[keep]))

    # a blank has no match
    low, high = (np.ceil((m * threshold + 2) / (2 - threshold) - 1e-9), np.floor((m * (2 - threshold) - 2) / threshold + 1e-9))
    for lo in range(0, len(n), 1 << 15):
        block, lengths = own[lo : lo + (1 << 15)], n[lo : lo + (1 << 15)]
        for k in np.flatnonzero((low <= high) & (low <= lengths[-1]) & (high >= lengths[0])).tolist():
            first, last = np.searchsorted(lengths, [low[k], high[k] + 1])
            if first < last:
                hit = np.flatnonzero(np.bitwise_count(block[first:last] ^ bare[k]) <= math.floor((1 - threshold) * (lengths[last - 1] + m[k]) + 1e-9) - 2)
                if len(hit):
                    i = hit + (lo + first)
                    found.append((i, np.full(len(i), k)))

    row, owner = (np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64) for x in (0, 1))
    keep = np.zeros(len(row), bool)
    for part in np.array_split(np.arange(len(row)), 1 + len(row) // 100_000):
        have = letters[runs[row[part]]].sum(axis=1, dtype=np.uint32)
        have[:, 0] += width - 1
        keep[part] = 2.0 * np.minimum(have, want[owner[part]]).sum(axis=1) >= threshold * (n[row[part]] + m[owner[part]]) - 1e-9
    row, owner = np.divmod(np.unique(row[keep] * len(targets) + owner[keep]), len(targets))
    if not len(row):
        return []
    used, row = np.unique(row, return_inverse=True)
    texts = [" ".join([vocabulary[i] for i in run]) for run in runs[used].tolist()]
    places: dict[str, list[int]] = {}
    for text, at in zip(texts, order[used].tolist()):
        places.setdefault(text, []).append(at)
    return [(at, target) for text, target in dict.fromkeys(_verified(texts, targets, row, owner, threshold)) for at in places[text]]


class Resembling:
    """Targets that words resemble. Words met before are not compared again; the latest ``hold`` to twice as many are kept."""

    def __init__(self, targets: list[str], threshold: float, hold: int = 150_000):
        self.targets, self.threshold, self.hold = targets, threshold, hold
        sizes = [len(t) for t in targets] or [1]
        self.least = math.ceil(min(sizes) * threshold / (2 - threshold) - 1e-9)
        self.most = math.floor(max(sizes) * (2 - threshold) / threshold + 1e-9)
        self.known: dict[str, tuple[str, ...]] = {}
        self.before: dict[str, tuple[str, ...]] = {}

    def of(self, words: set[str]) -> dict[str, tuple[str, ...]]:
        """For every one of the words its targets; other words may be there too."""
        if len(self.known) > self.hold:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = [w for w in words if w not in known]
        known.update((w, before.get(w, ())) for w in new)
        new = [w for w in new if w not in before and self.least <= len(w) <= self.most]
        for text, target in _near(new, self.targets, self.threshold) if new and self.targets else []:
            known[text] += (target,)
        return known


_kept: list[Resembling] = []


def resembling(targets: list[str], threshold: float) -> Resembling:
    """The same for later tasks of a Python worker, while they ask for the same targets; the latest two are kept."""
    for found in _kept:
        if (found.targets, found.threshold) == (targets, threshold):
            return found
    _kept[:] = [Resembling(targets, threshold), *_kept[:1]]
    return _kept[0]


def few_targets(targets: DataFrame, few: int) -> list[str] | None:
    """The targets, shortest first, if there are at most ``few`` of them."""
    rows = targets.select("target").limit(few + 1).collect()
    return sorted({r.target for r in rows if r.target}, key=lambda t: (len(t), t)) if len(rows) <= few else None


def similar_rows(rows: DataFrame, targets: DataFrame, threshold: float, few: int = 5000) -> DataFrame:
    """``id, text, target`` of rows (id, text) whose text resembles a target.

    Up to ``few`` targets (the size is checked) go to every batch of rows; more
    are met by the equi-join of ``candidate_pairs`` over the distinct texts.
    """
    wanted = few_targets(targets, few)
    if wanted is None:
        pairs = candidate_pairs(rows.select("text").distinct(), targets, threshold).where(ratio("text", "target") >= threshold)
        return rows.join(pairs, "text").select("id", "text", "target")

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            distinct = list({w for w in texts if w})
            found: dict[str, list[str]] = {}
            for text, target in _near(distinct, wanted, threshold) if distinct and wanted else []:
                found.setdefault(text, []).append(target)
            out = [(i, t, g) for i, t in zip(ids, texts) for g in found.get(t, ())] if found else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field("id").type), *(pa.array([o[k] for o in out], pa.string()) for k in (1, 2))], ["id", "text", "target"])

    return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, target string")


def similar_pairs(texts: DataFrame, targets: DataFrame, threshold: float, few: int = 5000) -> DataFrame:
    """``text, target`` with ratio(text, target) of at least the threshold, for distinct texts."""
    return similar_rows(texts.select(F.lit(0).alias("id"), "text"), targets, threshold, few).select("text", "target")
