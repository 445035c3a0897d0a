"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

Texts are cut by the vocabulary's pattern. Words are folded by Spark's
higher-order functions: a word is an array of token ids, one a byte; every fold
step ranks the adjacent pairs and merges the leftmost pair of the lowest rank. The rank map is a
literal: pairs of ids lie in a perfect-hash table of two literal arrays, so a
lookup is constant time.

The ``WORDS`` most frequent words of the corpus (counted over all documents, in
blocks; a word met once in every block does not compete) are folded so, once
each, and shared as a dictionary of that bounded size. The rest of the
vocabulary grows with the corpus and cannot be shared; those words are merged
where they stand by the same rule in Python, with a heap beyond ``LONG`` bytes.
(Folding them by higher-order functions too costs 60 microseconds a word, see
the README.) The dictionary changes the work, never the result.

Decoding concatenates the ids' byte pieces.

Defined cases: null and empty texts have no token; a word that is itself in the
vocabulary is one token whatever the merges, as in the tiktoken library;
special tokens' strings are ordinary text; every row is encoded on its own,
whatever its id (null and repeated ids too); of words equally frequent any may
be in the dictionary, the result is the same; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table, written

WORDS, LONG, BLOCK = 1 << 18, 256, 16 << 20
NO_PAIR = 1 << 30
K1, K2, K3 = 104_729, 1_299_709, 15_485_863


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def public_vocabulary() -> tuple[str, str]:
    """Path of the ranks and the cutting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: Finds characters that Python's ``re`` may class otherwise than the pattern: all but
#: printable ASCII, its blanks, and Latin letters and signs that are no digits or fractions.
UNLIKE = re.compile("[^\t-\r -~\u00a0-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f]").search


def plain_pattern(pattern: str) -> str | None:
    """The pattern for ``re``, which has no Unicode properties; None if that can't be said."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    return None if r"\p" in plain else plain


def prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


class PairTable:
    """Perfect hash from pairs of ids (a, b) to the id of their joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (np.array(c, np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        self.base = max(ranks.values(), default=0) + 1
        self.buckets, self.slots = len(a) // 3 + 1, prime(len(a) * 5 // 4 + 7)
        key = a * self.base + b
        first = (a * K1 + b * K2) % self.buckets
        second, third = a * K2 + b * K3, (a * K3 + b * K1) % (self.slots - 1) + 1  # a bucket's shift multiplies the third hash
        self.shift = np.zeros(self.buckets, np.int64)
        self.keys = np.full(self.slots, -1, np.int64)
        self.values = np.zeros(self.slots, np.int64)
        order = np.argsort(first, kind="stable")
        cut = np.flatnonzero(np.diff(first[order], prepend=-1, append=-1))
        groups = sorted((order[s:e] for s, e in zip(cut, cut[1:])), key=len, reverse=True)
        for g in groups:
            for d in range(1 << 16):
                at = (second[g] + d * third[g]) % self.slots
                if len(set(at.tolist())) == len(at) and (self.keys[at] < 0).all():
                    break
            else:
                raise ValueError("no perfect hash found for the pairs")
            self.shift[first[g[0]]] = d
            self.keys[at], self.values[at] = key[g], r[g]

    def literals(self) -> tuple[Column, Column, Column]:
        """Constant arrays (folded once by the optimizer): shift, keys, values."""
        return tuple(F.split(F.lit(",".join(map(str, x.tolist()))), ",").cast(kind) for x, kind in ((self.shift, "array<bigint>"), (self.keys, "array<bigint>"), (self.values, "array<int>")))  # type: ignore[return-value]

    def lookup(self, literals: tuple[Column, Column, Column], a: Column, b: Column) -> Column:
        """Rank of a pair, NO_PAIR if its join is no token."""
        shift, keys, values = literals
        a, b = a.cast("long"), b.cast("long")
        moved = F.element_at(shift, ((a * K1 + b * K2) % self.buckets + 1).cast("int"))
        slot = ((a * K2 + b * K3 + moved * ((a * K3 + b * K1) % (self.slots - 1) + 1)) % self.slots + 1).cast("int")
        return F.element_at(transform_one(slot, lambda s: F.when(F.element_at(keys, s) == a * self.base + b, F.element_at(values, s)).otherwise(F.lit(NO_PAIR))), 1)


def transform_one(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it: a one-element transform."""
    return F.transform(F.array(value), use)


def folded(ids: Column, pairs: PairTable) -> Column:
    """array<int> of byte ids -> array<int> of token ids.

    The pairs' ranks are looked up anew in each step: a single lookup in the
    expression keeps a single copy of the literal arrays in the plan.
    """
    lit = pairs.literals()

    def step(word: Column, _: Column) -> Column:
        n = F.size(word) - 1
        ranks = F.zip_with(F.slice(word, 1, n), F.slice(word, 2, n), lambda a, b: pairs.lookup(lit, a, b))

        def merge(r: Column) -> Column:
            low, at = F.array_min(r), F.array_position(r, F.array_min(r)).cast("int")
            return F.when(low < NO_PAIR, F.concat(F.slice(word, 1, at - 1), F.array(low), F.slice(word, at + 2, n + 1))).otherwise(word)

        return F.element_at(transform_one(ranks, merge), 1)

    steps = F.when(F.size(ids) > 1, F.sequence(F.lit(2), F.size(ids))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, ids, step)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Pieces of a word by the same merges, with a heap: for long words."""
    if word in ranks:
        return [word]
    parts: list[bytes | None] = [bytes([c]) for c in word]
    nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(ranks[word[i : i + 2]], i, 1, 1) for i in range(len(word) - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = nxt[i]
        if 0 <= i and j < len(parts):
            a, b = parts[i], parts[j]
            r = ranks.get(a + b)  # type: ignore[operator]
            if r is not None:
                heapq.heappush(heap, (r, i, len(a), len(b)))  # type: ignore[arg-type]

    while heap:
        _, i, la, lb = heapq.heappop(heap)
        j = nxt[i] if parts[i] is not None else len(parts)
        if parts[i] is None or j >= len(parts) or len(parts[i]) != la or len(parts[j]) != lb:  # type: ignore[arg-type]
            continue  # one of the two has changed since
        parts[i] = parts[i] + parts[j]  # type: ignore[operator]
        parts[j] = None
        nxt[i] = nxt[j]
        if nxt[i] < len(parts):
            prv[nxt[i]] = i
        if prv[i] >= 0:
            push(prv[i])
        push(i)
    return [p for p in parts if p is not None]


def merged_short(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same by a plain scan, for words of ordinary length."""
    if word in ranks:
        return [word]
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], NO_PAIR) for i in range(len(word) - 1)]
    while pairs:
        low = min(pairs)
        if low == NO_PAIR:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NO_PAIR)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NO_PAIR)
    return parts


class Tokens:
    """What tasks share: ranks, pattern and the dictionary of frequent words (bounded by WORDS)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, found: tuple[list[str], bytes, np.ndarray] = ([], b"", np.zeros(0, np.int64))):
        self.ranks, self.pattern = ranks, pattern
        #: words, their ids' bytes laid end to end, how many bytes each has
        self.words, self.blob, self.lengths = found

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("ranks", "pattern", "words", "blob", "lengths")}

    def ready(self) -> Tokens:
        if not hasattr(self, "careful"):
            import regex

            self.careful = regex.compile(self.pattern).findall
            quick = plain_pattern(self.pattern)
            self.quick = re.compile(quick).findall if quick else None
            self.bytes_of = {p: r.to_bytes(4, "little") for p, r in self.ranks.items()}
            self.memo: dict[str, bytes] = {}
            ends = np.cumsum(self.lengths)
            self.known = {w: self.blob[s:e] for w, s, e in zip(self.words, (ends - self.lengths).tolist(), ends.tolist())}
            self.words, self.blob = [], b""
            for piece, rank in self.ranks.items():
                try:
                    self.known[piece.decode()] = rank.to_bytes(4, "little")
                except UnicodeDecodeError:
                    pass
            self.pieces = {r: p for p, r in self.ranks.items()}
        return self

    def find(self, text: str) -> list[str]:
        """The pattern's matches; by the faster library where the text has only characters both class alike."""
        return self.quick(text) if self.quick and not UNLIKE(text) else self.careful(text)

    def merge(self, word: str) -> bytes:
        found = self.memo.get(word)
        if found is None:
            raw = word.encode()
            parts = merged(raw, self.ranks) if len(raw) > LONG else merged_short(raw, self.ranks)
            found = b"".join(map(self.bytes_of.__getitem__, parts))
            if len(self.memo) >= 1 << 16:
                self.memo.clear()
            self.memo[word] = found
        return found


def counted(docs: DataFrame, tokens: Tokens) -> DataFrame:
    """``word, n``: words outside the vocabulary, by blocks of text; what a block holds once is left out."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        t = shared.value.ready()
        count: Counter[str] = Counter()
        size = 0

        def flush():
            rows = [(w, n) for w, n in count.items() if n > 1 and w not in t.known and len(w) <= LONG // 4]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])

        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    count.update(t.find(text))
                    size += len(text)
                if size > BLOCK:
                    yield from flush()
                    count.clear()
                    size = 0
        yield from flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, tokens: Tokens, pairs: PairTable, words: int = WORDS) -> tuple[list[str], bytes, np.ndarray]:
    """Dictionary of at most ``words`` frequent words, folded in Spark: words, ids laid end to end, bytes of each."""
    counts = written(counted(docs, tokens), "words")
    step = F.when(F.col("n") <= 1000, F.col("n")).otherwise(1000 + F.floor(F.log2("n") * 16)).cast("long")
    sizes = sorted(((r.step, r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, None
    for s, c in sizes:
        if total + c > words:
            break
        total, least = total + c, s
    byte_ids = F.array(*[F.lit(tokens.ranks[bytes([c])]) for c in range(256)])
    picked = counts.where(step >= (least if least is not None else 1 << 60))
    raw = F.col("word").cast("binary")
    ids = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.element_at(byte_ids, F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int") + 1))
    table = picked.select("word", ids.alias("ids")).select("word", folded(F.col("ids"), pairs).alias("ids")).toArrow()
    lists = table.column("ids").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) * 4
    return table.column("word").to_pylist(), lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes(), lengths


def encoded(docs: DataFrame, path: str, pattern: str, words: int = WORDS) -> DataFrame:
    """``doc_id, ids, decoded``: token ids (little-endian unsigned 32-bit, binary) and the bytes they decode to."""
    ranks = read_ranks(path)
    pairs = PairTable(ranks)
    plain = Tokens(ranks, pattern)
    shared = docs.sparkSession.sparkContext.broadcast(Tokens(ranks, pattern, frequent(docs, plain, pairs, words)))

    def run(batches):
        t = shared.value.ready()
        known, pieces = t.known, t.pieces
        for batch in sliced(batches):
            ids, decoded = [], []
            for text in batch.column("text").to_pylist():
                words = t.find(text) if text else []
                parts = list(map(known.get, words))
                if None in parts:
                    for i in [i for i, p in enumerate(parts) if p is None]:
                        parts[i] = t.merge(words[i])
                raw = b"".join(parts)
                ids.append(raw)
                decoded.append(b"".join(map(pieces.__getitem__, np.frombuffer(raw, "<u4").tolist())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(table(spark, sf_dir, "documents"), *public_vocabulary())
    return digests(found)


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_bpe": op3_bpe}
ORACLES: dict[str, str] = {}
