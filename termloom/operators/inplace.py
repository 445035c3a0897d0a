"""Matches of few terms and rules, text by text: no word, pair of words or match leaves its row.

A ``Slice`` holds some thousand normalized texts as numbers of words. Every
match gives ``row, k`` pairs, k being the number of a term or a rule.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from ..functions.similarity import near_runs, resembling

#: Rows of a slice, distinct fuzzy targets, and rows of a list up to which lists go to every batch.
ROWS, FEW, MOST = 2000, 5000, 20_000


def few_rows(rows: DataFrame, most: int = MOST) -> list | None:
    """The rows, if there are at most so many."""
    found = rows.limit(most + 1).collect()
    return found if len(found) <= most else None


class Slice:
    """Texts of single-blank-separated words; null and empty texts have no word."""

    def __init__(self, texts: list[str | None]):
        self.texts = texts
        words = [t.split(" ") if t else [] for t in texts]
        self.vocabulary = list(set().union(*words))
        index = {w: i for i, w in enumerate(self.vocabulary)}
        sizes = np.array([len(w) for w in words], np.int64)
        self.ids = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int32, int(sizes.sum()))
        self.rows = np.repeat(np.arange(len(words)), sizes)
        self.ends = np.cumsum(sizes)


def sliced_texts(batches, column: str):
    """Parts of Arrow batches with their texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch, Slice(batch.column(column).to_pylist())


def lists_of(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of numbers, one for each word: where each starts, its size, the numbers end to end."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.cumsum(sizes) - sizes, sizes, np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))


def spread_lists(lists, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words in a row: the place of each of their numbers, and the numbers."""
    starts, sizes, flat = lists
    n = sizes[words]
    place = np.repeat(np.arange(len(words)), n)
    return place, flat[np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[words], n)]


def at_words(part: Slice, lists) -> set[tuple[int, int]]:
    """``row, number`` of every word's numbers."""
    held = np.flatnonzero(lists[1][part.ids])
    place, number = spread_lists(lists, part.ids[held])
    return distinct(part.rows[held[place]], number)


def distinct(rows: np.ndarray, numbers: np.ndarray) -> set[tuple[int, int]]:
    return set(zip(rows.tolist(), numbers.tolist()))


class Pairs:
    """Numbers (a, b) of words apart by up to ``window`` places in a text."""

    SLOTS = 4_194_301

    def __init__(self, wanted: dict[tuple[int, int], list[int]]):
        self.base = max((b for _, b in wanted), default=0) + 1
        found = sorted((a * self.base + b, k) for (a, b), k in wanted.items())
        self.keys = np.array([key for key, _ in found], np.int64)
        self.of = [k for _, k in found]
        self.slots = np.zeros(self.SLOTS, bool)
        self.slots[self.keys % self.SLOTS] = True

    def met(self, part: Slice, left, right, window: int):
        """``place, number of the pair, distance``, short distances first; left and right: lists of the words' numbers."""
        if not len(self.keys):
            return
        first = np.flatnonzero(left[1][part.ids])
        for d in range(1, window + 1):
            i = first[first + d < len(part.ids)]
            i = i[(part.rows[i] == part.rows[i + d]) & (right[1][part.ids[i + d]] > 0)]
            for i in np.array_split(i, 1 + len(i) // 200_000):
                place, a = spread_lists(left, part.ids[i])
                again, b = spread_lists(right, part.ids[i[place] + d])
                place, keys = place[again], a[again] * self.base + b
                may = np.flatnonzero(self.slots[keys % self.SLOTS])
                at = np.minimum(np.searchsorted(self.keys, keys[may]), len(self.keys) - 1)
                sure = self.keys[at] == keys[may]
                yield from zip(i[place[may[sure]]].tolist(), at[sure].tolist(), [d] * int(sure.sum()))


class Windows:
    """Rules (lists of words) whose words occur in order, each the nearest within ``window`` tokens of the one before."""

    def __init__(self, rules: list[list[str]], targets: list[str], threshold: float, window: int):
        self.rules, self.targets, self.threshold, self.window = rules, targets, threshold, window
        self.index = {t: k for k, t in enumerate(targets)}
        wanted: dict[tuple[int, int], list[int]] = {}
        for at, w in enumerate(rules):
            if len(w) > 1 and w[0] in self.index and w[1] in self.index:
                wanted.setdefault((self.index[w[0]], self.index[w[1]]), []).append(at)
        self.pairs = Pairs(wanted)

    def of(self, part: Slice) -> set[tuple[int, int]]:
        near = resembling(self.targets, self.threshold).of(set(part.vocabulary))
        lists = lists_of([[self.index[t] for t in near[w]] for w in part.vocabulary])
        out: set[tuple[int, int]] = set()
        tried: set[tuple[int, int]] = set()
        for place, pair, d in self.pairs.met(part, lists, lists, self.window):
            row = int(part.rows[place])
            for at in self.pairs.of[pair]:
                if (row, at) in out:
                    continue
                rest = self.rules[at][2:]
                if rest and (place, at) in tried:  # only the nearest second word counts
                    continue
                tried.add((place, at))
                if not rest or self._reaches(rest, place + d + 1, int(part.ends[row]), part, near):
                    out.add((row, at))
        return out

    def _reaches(self, rest: list[str], cursor: int, end: int, part: Slice, near) -> bool:
        for target in rest:
            ahead = part.ids[cursor : min(end, cursor + self.window)].tolist()
            step = next((k + 1 for k, w in enumerate(ahead) if target in near[part.vocabulary[w]]), 0)
            if not step:
                return False
            cursor += step
        return True


class Contained:
    """Phrases of two words or more that are a substring of the text; their first two words end and start neighbouring words of it."""

    def __init__(self, phrases: list[str]):
        self.phrases = phrases
        self.lefts: dict[str, int] = {}
        self.rights: dict[str, int] = {}
        wanted: dict[tuple[int, int], list[int]] = {}
        for k, p in enumerate(phrases):
            w = p.split(" ")
            if len(w) > 1 and w[0]:
                wanted.setdefault((self.lefts.setdefault(w[0], len(self.lefts)), self.rights.setdefault(w[1], len(self.rights))), []).append(k)
        self.longer = {k for k, p in enumerate(phrases) if p.count(" ") > 1}
        self.pairs = Pairs(wanted)
        # most words are told apart by the letters that even the shortest first or second word has
        self.left_sizes, self.right_sizes = (sorted({len(w) for w in words}) for words in (self.lefts, self.rights))
        self.least_left, self.least_right = (min(sizes, default=0) for sizes in (self.left_sizes, self.right_sizes))
        self.tails, self.heads = {w[len(w) - self.least_left :] for w in self.lefts}, {w[: self.least_right] for w in self.rights}

    def of(self, part: Slice) -> set[tuple[int, int]]:
        lefts, rights = self.lefts, self.rights
        tails, heads, a, b = self.tails, self.heads, self.least_left, self.least_right
        left = lists_of([[lefts[w[-n:]] for n in self.left_sizes if n <= len(w) and w[-n:] in lefts] if w[-a:] in tails else () for w in part.vocabulary])
        right = lists_of([[rights[w[:n]] for n in self.right_sizes if n <= len(w) and w[:n] in rights] if w[:b] in heads else () for w in part.vocabulary])
        met = {(int(part.rows[place]), k) for place, pair, _ in self.pairs.met(part, left, right, 1) for k in self.pairs.of[pair]}
        return {(row, k) for row, k in met if k not in self.longer or self.phrases[k] in part.texts[row]}


class Words:
    """Texts that hold one of the words, or with ``inside`` a word of which one is a part."""

    def __init__(self, words: list[str], inside: bool = False):
        self.index = {w: k for k, w in enumerate(words)}
        self.sizes = sorted({len(w) for w in words}) if inside else []
        self.inside = inside

    def of(self, part: Slice) -> set[tuple[int, int]]:
        if not self.index:
            return set()
        if self.inside:
            held = [{self.index[c] for n in self.sizes for i in range(len(w) - n + 1) if (c := w[i : i + n]) in self.index} for w in part.vocabulary]
        else:
            held = [(self.index[w],) if w in self.index else () for w in part.vocabulary]
        return at_words(part, lists_of(held))


class NearWords:
    """Words outside the safe set that resemble a target."""

    def __init__(self, targets: list[str], safe: set[str], threshold: float):
        self.targets, self.safe, self.threshold = targets, safe, threshold
        self.index = {t: k for k, t in enumerate(targets)}

    def of(self, part: Slice) -> set[tuple[int, int]]:
        if not self.targets:
            return set()
        near = resembling(self.targets, self.threshold).of(set(part.vocabulary))
        return at_words(part, lists_of([() if w in self.safe else [self.index[t] for t in near[w]] for w in part.vocabulary]))


class NearRuns:
    """Targets of several words that resemble as many consecutive words."""

    def __init__(self, targets: list[str], threshold: float):
        self.targets, self.threshold = targets, threshold
        self.index = {t: k for k, t in enumerate(targets)}
        self.by_size: dict[int, list[str]] = {}
        for t in targets:
            self.by_size.setdefault(t.count(" ") + 1, []).append(t)

    def of(self, part: Slice) -> set[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        for n, targets in self.by_size.items():
            count = max(len(part.ids) - n + 1, 0)
            start = np.flatnonzero(part.rows[:count] == part.rows[len(part.rows) - count :])
            runs, which = part.ids[start[:, None] + np.arange(n)], np.zeros(len(start), np.int64)
            for column in runs.T:  # every distinct run once
                which = np.unique(which * len(part.vocabulary) + column, return_inverse=True)[1]
            order = np.argsort(which, kind="stable")
            ends = np.cumsum(np.bincount(which)) if len(which) else which
            firsts = order[ends - np.bincount(which)] if len(which) else which
            for i, t in near_runs(part.vocabulary, runs[firsts], targets, self.threshold):
                same = order[ends[i - 1] if i else 0 : ends[i]]
                out |= {(row, self.index[t]) for row in part.rows[start[same]].tolist()}
        return out


def by_length(texts) -> list[str]:
    return sorted(set(texts), key=lambda t: (len(t), t))


class Rules:
    """Substring and ordered-window matches of combination rules (tid, normalized_phrase): as ``match.combination_matches`` with a threshold."""

    def __init__(self, rules: list[tuple], threshold: float, window: int):
        self.tids: dict[str, list] = {}
        for tid, phrase in rules:
            if phrase and tid is not None:
                self.tids.setdefault(phrase, []).append(tid)
        self.phrases = list(self.tids)
        words = [p.split(" ") for p in self.phrases]
        self.single = [p for p in self.phrases if " " not in p]
        self.parts = [(Contained(self.phrases), self.phrases), (Words(self.single, inside=True), self.single)]
        targets = by_length(w for ws in words if len(ws) > 1 for w in ws if w)
        self.parts.append((Windows(words, targets, threshold, window), self.phrases))
        self.few = len(targets) <= FEW

    def of(self, part: Slice) -> dict[int, set]:
        """Rules by row."""
        out: dict[int, set] = {}
        for matcher, phrases in self.parts:
            for row, k in matcher.of(part):
                out.setdefault(row, set()).update(self.tids[phrases[k]])
        return out


class Terms:
    """All term matches (tid, normalized_term, action): as ``match.term_matches`` with a safe set."""

    def __init__(self, terms: list[tuple], safe: set[str], threshold: float, least: int):
        self.tids: dict[str, list] = {}
        self.risky: dict[str, list] = {}
        for tid, term, action in terms:
            if term and tid is not None:
                self.tids.setdefault(term, []).append(tid)
                if action is not None and action != "ALLOW" and len(term) >= least:
                    self.risky.setdefault(term, []).append(tid)
        terms_, near, runs = list(self.tids), by_length(t for t in self.risky if " " not in t), by_length(t for t in self.risky if " " in t)
        single = [t for t in terms_ if " " not in t]
        self.parts = [(Words(single), single, self.tids), (Contained(terms_), terms_, self.tids), (NearWords(near, safe, threshold), near, self.risky), (NearRuns(runs, threshold), runs, self.risky)]
        self.few = max(len(near), len(runs)) <= FEW

    def of(self, part: Slice) -> dict[int, set]:
        """Terms by row."""
        out: dict[int, set] = {}
        for matcher, words, tids in self.parts:
            for row, k in matcher.of(part):
                out.setdefault(row, set()).update(tids[words[k]])
        return out
