"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of words (lower-cased runs of letters and
digits). Every place of a text begins windows as long as the items; the CGK
random walk embeds windows and items so that a small edit distance becomes a
small Hamming distance. Walks from one place are prefixes of one another, so
one walk serves windows of all lengths. ``tables(...)`` samples of embedded
positions are compared with the items' own, so many that a window whose
embedding differs from an item's in share ``DIFFER`` still meets it with
probability ``RECALL``. What meets is verified by the exact edit distance of the
item to the best substring around the window. A text holds an item if that is at
most ``EDITS`` of the item's words (a similarity of 0.8).

Items of like length (``GROWTH``) form a class with common samples, taken over
the embedding of its shortest item. One bound spares walks without loss: k edits
leave n - k of an item's words in place, so a place cannot match where fewer of
the next n + k words occur in any item of n words (``bound=False`` walks from
every place).

Items are a broadcast index in blocks of ``ITEMS`` items at most, one alive at a
time; more items mean more scans, not a larger broadcast.

Defined cases: null and empty texts hold nothing; items without a word match
nothing; repeated item ids are separate items of the same id, reported once by
their best match: fewest edits, then the earliest, then the shortest; documents
are told apart by doc_id, null ids counting as one document; an empty table on
either side gives no row.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table, written

EDITS, RECALL, DIFFER, SAMPLED, WALKS, GROWTH, ITEMS = 0.2, 0.995, 0.55, 3, 8, 1.5, 20_000
PAST, MIX = (1 << 32) - 1, np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\W_]+")


def tables(recall: float = RECALL, differ: float = DIFFER, sampled: int = SAMPLED) -> int:
    """How many samples reach the recall: 1 - (1 - (1 - differ) ** sampled) ** tables."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** sampled))


def class_length(n: int) -> int:
    """The shortest length of the class of items of n words."""
    return n if n < 8 else int(8 * GROWTH ** int(math.log(n / 8) / math.log(GROWTH) + 1e-9))


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits of item to a substring of text, with that substring's start and end."""
    n = len(text)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, x in enumerate(item.tolist(), 1):
        diag = row[:-1] + (text != x)
        up = row[1:] + 1
        best = np.minimum(diag, up)
        origin = np.where(diag <= up, start[:-1], start[1:])
        new, src = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], src[0] = i, start[0]
        # new[j] = min(best[j], new[j-1] + 1): a running minimum of best[j] - j
        lowered = np.concatenate([[i], best]) - np.arange(n + 1)
        low = np.minimum.accumulate(lowered)
        at = np.maximum.accumulate(np.where(lowered == low, np.arange(n + 1), 0))
        new = low + np.arange(n + 1)
        src = np.concatenate([[start[0]], origin])[at]
        row, start = new, src
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


class Lengths:
    """Items of one class: which they are, and the sorted keys of their samples."""

    def __init__(self, own: list[int], items: list[np.ndarray], n0: int, walked: np.ndarray):
        each = -(-tables() // WALKS)
        self.steps = max(1, 2 * n0 - 1)
        self.samples = np.random.default_rng(n0).integers(0, self.steps, (WALKS, each, SAMPLED))
        by_length: dict[int, list[np.ndarray]] = {}
        for i in own:
            by_length.setdefault(len(items[i]), []).append(items[i])
        #: of each length: words needed, words looked at, and which words count
        self.bounds = [(n - int(EDITS * n), n + int(EDITS * n), np.unique(np.concatenate(xs))) for n, xs in by_length.items()]
        keys = self.keys(walked[:, :, own])
        order = np.argsort(keys, axis=None, kind="stable")
        self.key, self.owner = keys.ravel()[order], np.tile(own, len(keys))[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.key >> np.uint64(44)).astype(np.int64)] = True

    def possible(self, x: np.ndarray, words: int) -> np.ndarray:
        """Places around those that the bound leaves."""
        n = len(x)
        ok = np.zeros(n, bool)
        known = np.zeros(n + max(span for _, span, _ in self.bounds) + 1, np.int32)
        for need, span, vocabulary in self.bounds:
            counts = np.zeros(words + 1, np.int8)
            counts[vocabulary] = 1
            np.cumsum(counts.take(x), dtype=np.int32, out=known[1 : n + 1])
            known[n + 1 :] = known[n]
            starts = np.flatnonzero(known[span : span + n] - known[:n] >= need)
            # a match is found from places up to 2k before its start and k behind it
            k = span - (need + span) // 2
            change = np.zeros(n + 1, np.int32)
            np.add.at(change, np.maximum(starts - 2 * k, 0), 1)
            np.add.at(change, np.minimum(starts + k + 1, n), -1)
            ok |= np.cumsum(change[:n]) > 0
        return ok

    def keys(self, walked: np.ndarray) -> np.ndarray:
        """(walks, steps, windows) symbols -> (tables, windows) keys."""
        out = np.empty((self.samples.shape[0] * self.samples.shape[1], walked.shape[2]), np.uint64)
        for t, (w, at) in enumerate((w, at) for w in range(WALKS) for at in self.samples[w]):
            key = np.full(walked.shape[2], t + 1, np.uint64)
            for j in at:
                key *= MIX
                key += walked[w, j]
            key *= MIX
            key ^= key >> np.uint64(29)
            np.multiply(key, MIX, out=out[t])
        return out

    def meet(self, walked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) that share a sample."""
        keys = self.keys(walked)
        t, window = np.nonzero(self.seen[(keys >> np.uint64(44)).view(np.int64)])
        key = keys[t, window]
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        many = hi - lo
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        return np.repeat(window, many), self.owner[at]


class Index:
    """Items of one block: vocabulary, walks, classes."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 5, bound: bool = True):
        split = [(i, WORD.findall((t or "").lower())) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.bound = bound
        self.ids = [i for i, _ in split]
        self.vocab = {w: k + 1 for k, w in enumerate(sorted({x for _, ws in split for x in ws}))}
        self.items = [np.array([self.vocab[x] for x in w], np.int64) for _, w in split]
        self.k = [int(EDITS * len(x)) for x in self.items]
        lengths: dict[int, list[int]] = {}
        for i, x in enumerate(self.items):
            lengths.setdefault(class_length(len(x)), []).append(i)
        self.steps = 2 * max(lengths, default=0)
        #: CGK: one random bit for each step, walk and symbol (by a hash of the symbol into 256)
        self.bits = np.random.default_rng(seed).integers(0, 2, (self.steps, WALKS * 256), np.int64)
        ends = np.cumsum([len(x) + self.steps for x in self.items])
        flat = np.full(int(ends[-1]) if len(ends) else 0, PAST, np.int64)
        starts = np.array([e - len(x) - self.steps for e, x in zip(ends, self.items)], np.int64)
        for s, x in zip(starts, self.items):
            flat[s : s + len(x)] = x
        walked = self.walk(flat, starts, self.steps)
        self.classes = [Lengths(own, self.items, n0, walked) for n0, own in sorted(lengths.items())]

    def walk(self, x: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
        """(walks, steps, starts) symbols met from each place; x holds ``steps`` symbols beyond the last."""
        x = x.astype(np.uint32)
        mark = (x * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int64)
        out = np.empty((WALKS, steps, len(starts)), np.uint32)
        for w in range(WALKS):
            at = starts.copy()
            for j in range(steps):
                np.take(x, at, out=out[w, j])
                at += self.bits[j].take(mark.take(at) + 256 * w)
        return out

    def candidates(self, x: np.ndarray, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (item, place) whose samples meet. x: words, 0 where none; padded: the same with PAST between texts and behind."""
        n = len(x)
        own = np.stack([c.possible(x, len(self.vocab)) if self.bound else np.ones(n, bool) for c in self.classes])
        last = np.where(own.any(axis=0), len(own) - 1 - own[::-1].argmax(axis=0), -1)  # the longest class a place has to walk for
        items, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(len(own)):
            every = np.flatnonzero(last == k)
            for at in range(0, len(every), 2048):
                part = every[at : at + 2048]
                walked = self.walk(padded, part, self.classes[k].steps)
                for c, mine in zip(self.classes[: k + 1], own):
                    rows = np.flatnonzero(mine[part])
                    if len(rows):
                        window, item = c.meet(walked if len(rows) == len(part) else walked[:, : c.steps, rows])
                        items.append(item)
                        starts.append(part[rows[window]])
        both = np.unique(np.concatenate(items).astype(np.int64) * (n + 1) + np.concatenate(starts))
        return both // (n + 1), both % (n + 1)

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """Items in texts: text number, item id, edits, item words, first word, end word."""
        out: list[tuple[int, int, int, int, int, int]] = []
        if not self.items:
            return out
        get = self.vocab.get
        at = 0
        while at < len(texts):  # texts of about 2^18 words together, each followed by a gap no walk crosses
            parts, owners, size = [], [], 0
            while at < len(texts) and size < 1 << 18:
                w = WORD.findall((texts[at] or "").lower())
                if w:
                    parts.append(np.fromiter((get(t, 0) for t in w), np.int64, len(w)))
                    owners.append(at)
                    size += len(w)
                at += 1
            if not parts:
                continue
            ends = np.cumsum([len(p) + self.steps for p in parts])
            begins = ends - self.steps - np.array([len(p) for p in parts])
            x, padded = np.zeros(ends[-1], np.int64), np.full(ends[-1] + self.steps, PAST, np.int64)
            for s, p in zip(begins.tolist(), parts):
                x[s : s + len(p)] = padded[s : s + len(p)] = p
            item, place = self.candidates(x, padded)
            text = np.searchsorted(ends, place, "right")
            order = np.lexsort((place, item, text))
            item, place, text = item[order], place[order], text[order]
            edges = np.append(np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0)), len(order)).tolist()
            for lo, hi in zip(edges, edges[1:]):
                t, i = int(text[lo]), int(item[lo])
                own = place[lo:hi] - begins[t]
                best = self.verified(i, parts[t], own[own < len(parts[t])])
                if best:
                    out.append((owners[t], self.ids[i], *best))
        return out

    def verified(self, i: int, x: np.ndarray, starts: np.ndarray) -> tuple[int, int, int, int] | None:
        """Edits, item words, first and end word of the best match around sorted places."""
        item, k, n = self.items[i], self.k[i], len(self.items[i])
        hits = np.concatenate([[0], np.cumsum(np.isin(x, item))])
        lo, hi = np.maximum(starts - k, 0), np.minimum(starts + n + k, len(x))
        ok = hits[hi] - hits[lo] >= n - k  # fewer of the item's words cannot do
        lo, hi = lo[ok], hi[ok]
        best = None
        at = 0
        while at < len(lo):
            to = at + 1  # neighbouring windows are looked through together
            while to < len(lo) and lo[to] <= lo[to - 1] + k + 1:
                to += 1
            d, a, b = edit_distance(item, x[lo[at] : hi[to - 1]])
            if d <= k and (best is None or d < best[0]):
                best = (d, n, int(lo[at]) + a, int(lo[at]) + b)
                if d == 0:
                    return best
            at = to
        return best


def contaminated(docs: DataFrame, items: DataFrame, items_in_block: int = ITEMS) -> DataFrame:
    """``doc_id, item_id, edits, item_words, first_word, end_word`` for each text and item it holds."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-bench.count() // items_in_block))
    schema = "doc_id long, item_id long, edits long, item_words long, first_word long, end_word long"
    found = None
    for block in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]))

        def run(batches, shared=shared):
            for batch in sliced(batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], *f) for t, *f in shared.value.find(batch.column("text").to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "edits", "item_words", "first_word", "end_word"])

        one = narrow.mapInArrow(run, schema)
        if blocks > 1:  # the block's matches are kept, its index is not
            one = written(one, "matches")
            shared.unpersist()
        found = one if found is None else found.unionByName(one)
    best = F.min(F.struct("edits", "first_word", "item_words", "end_word")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.edits", "b.item_words", "b.first_word", "b.end_word")  # type: ignore[union-attr]


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES: dict[str, str] = {}
