"""Removal of byte strings that also start earlier, by merging shards' Burrows-Wheeler transforms.

A window is a string of ``WINDOW`` bytes. One transform of the whole corpus is
out of reach, so transforms are made of the contexts in which repeats can lie,
dealt so that equal windows meet:

1. Every window picks the least hash among its ``GRAM``-byte grams, an anchor
   that equal windows choose alike. Each block of texts posts its anchors with
   the range of windows they stand for (a context: the bytes those windows
   cover) and a short hash of those bytes. Contexts that a block holds twice are
   compared there, and only the earliest is posted.
2. A bucket of anchor hashes tells which contexts to cut: none of an anchor
   that occurs once; of the others, those whose byte hash is new (members) and
   those whose byte hash occurred before (copies).
3. Texts cut their contexts. For each bucket a shard of texts sends the
   Burrows-Wheeler transform of its members, and the bytes of its copies.
4. A bucket inverts the transforms to learn which text and place each entry is
   and compares every copy with the bytes it claims to equal; one that differs
   joins the members. The transforms are then merged by interleave refinement
   (Holt and McMillan): round k holds all entries interleaved by their first k
   bytes, and a stable pass over the byte before each entry gives round k + 1.
   A block boundary that appears in round k is a common prefix of k - 1.
   Entries alone in their block stay alone, as do the entries before them, so
   they leave the merge. What is left after ``WINDOW`` rounds are the repeated
   intervals: the earliest entry of each keeps its window. No suffix is sorted
   anew.
5. Texts drop the union of their repeated windows.

Bytes decide everything, with one exception: anchors with over ``HEAVY``
different contexts, such as the edges of a passage that a great many texts hold,
send BLAKE2b hashes (128 bits) of their single windows, dealt by hash, so that
no bucket has to hold them together. Texts travel by ``row``, a 64-bit hash of
id and text that is the same whenever they are read again; the exchange is
reused by steps 3 and 5. The number of buckets and shards follows the bytes of
the input (``SHARE`` each).

Defined cases: null texts are empty; texts shorter than a window lose nothing;
overlaps count; matches never cross texts; ids need not be unique: rows that
share an id and a text count as one document and do not remove one another, rows
that share an id but not a text are documents in order of ``row``; a null doc_id
comes before all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, sliced, table

WINDOW, GRAM, HEAVY, BLOCK, CHUNK, SHARE = 100, 32, 2000, 12 << 20, 2 << 20, 8 << 20
SPAN = WINDOW - GRAM + 1  # grams of a window
END = 255  # ends a context in its transform; no byte of UTF-8
U = np.uint64
BASE = U(0x5851F42D4C957F2D)
BACK = U(pow(int(BASE), -1, 1 << 64))
BYTES = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)
NOBODY = -(1 << 63)
#: Columns of packed lists and their types.
ANCHOR = [("h", "<u8"), ("c", "<u4"), ("doc", "<i8"), ("row", "<i8"), ("pos", "<i4"), ("lo", "u1"), ("hi", "u1")]
ASKED = [("kind", "u1"), *ANCHOR]
WINDOWS = [("w1", "<u8"), ("w2", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4")]
RANGES = [("row", "<i8"), ("start", "<i4"), ("end", "<i4")]
#: What is asked of a context (a sum; 0: a copy), and what a row of step 3 holds.
MEMBER, HASHED, MODEL = 1, 2, 4
KNOWN, COPIES, MODELS, MEMBERS, HASHES = range(5)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def xx_long(v: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long, as unsigned."""
    p1, p2, p3, p4, p5 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)
    k = v.astype(np.int64).view(np.uint64) * p2
    h = U(42) + p5 + U(8)
    h = h ^ (((k << U(31)) | (k >> U(33))) * p1)
    h = ((h << U(27)) | (h >> U(37))) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return h ^ (h >> U(32))


def shard_of(row: np.ndarray, shards: int) -> np.ndarray:
    return xx_long(row).view(np.int64) % shards


def packed(fields, cols: dict[str, np.ndarray]) -> bytes:
    """Columns end to end, each by byte planes: equal high bytes then compress away."""
    return b"".join(np.ascontiguousarray(cols[k].astype(t)).view(np.uint8).reshape(len(cols[k]), np.dtype(t).itemsize).T.tobytes() for k, t in fields)


def unpacked(fields, blob: bytes) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in fields)
    n, at, out = len(blob) // width, 0, {}
    raw = np.frombuffer(blob, np.uint8)
    for k, t in fields:
        w = np.dtype(t).itemsize
        out[k] = np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(t).reshape(n)
        at += n * w
    return out


def joined(fields, blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts = [unpacked(fields, b) for b in blobs]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in fields}


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def anchors(docs: np.ndarray, rows: np.ndarray, texts: list[bytes]) -> dict[str, np.ndarray]:
    """Anchor list of some texts laid end to end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    n = len(b)
    none = {k: np.zeros(0, t) for k, t in ANCHOR}
    if n < WINDOW:
        return none
    back = powers(BACK, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[b] * powers(BASE, n), out=total[1:])
    gram = mix((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1])
    low = (gram & ~U((1 << 28) - 1)) | np.arange(len(gram), dtype=np.uint64)  # ties go to the left
    width = 1
    least = low
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - WINDOW + 1], least[SPAN - width : SPAN - width + n - WINDOW + 1])
    at = (least & U((1 << 28) - 1)).astype(np.int64)  # anchor of the window that starts here
    ends = np.cumsum(sizes)
    first = ends - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[: n - WINDOW + 1]
    inside = np.arange(n - WINDOW + 1) + WINDOW <= ends[owner]
    start = np.flatnonzero(inside)
    if not len(start):
        return none
    at, owner = at[start], owner[start]
    new = np.flatnonzero(np.diff(at, prepend=-1) | np.diff(owner, prepend=-1))
    last = np.append(new[1:], len(at)) - 1
    a, o, s1, s2 = at[new], owner[new], start[new], start[last]
    lo, hi = a - s2, a - s1
    covered = (total[s2 + WINDOW] - total[s1]) * back[s1]
    c = mix(covered ^ (lo.astype(np.uint64) << U(8)) ^ hi.astype(np.uint64))
    return {"h": gram[a] >> U(16), "c": c >> U(32), "doc": docs[o], "row": rows[o], "pos": a - first[o], "lo": lo, "hi": hi}


def runs_of(docs: list[int], rows: list[int], texts: list[bytes]):
    """Lists of texts of about CHUNK bytes; a longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield np.array(docs[at:i], np.int64), np.array(rows[at:i], np.int64), texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield np.array(docs[at:], np.int64), np.array(rows[at:], np.int64), texts[at:]


def buckets_of(fields, cols: dict[str, np.ndarray], key: np.ndarray, count: int):
    """(bucket, blob) of rows dealt by key."""
    part = (key % U(count)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(count + 1))
    cols = {k: v[order] for k, v in cols.items()}
    for i in np.flatnonzero(np.diff(cut)).tolist():
        yield i, packed(fields, {k: v[cut[i] : cut[i + 1]] for k, v in cols.items()})


def body(texts: dict[int, bytes], x: dict[str, np.ndarray], own: np.ndarray) -> list[bytes]:
    """Bytes of contexts."""
    return [texts[r][p - hi : p - lo + WINDOW] for r, p, lo, hi in zip(*(x[k][own].tolist() for k in ("row", "pos", "lo", "hi")))]


def covered(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The ranges that contexts cover, merged where they touch."""
    pos = x["pos"].astype(np.int64)
    return union_of({"row": x["row"], "start": pos - x["hi"], "end": pos - x["lo"] + WINDOW})


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before; the first does."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def firsts(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Contexts by anchor, byte hash and place; the first of each (anchor, byte hash), and which stand elsewhere than their first."""
    order = np.lexsort((x["pos"], x["row"], x["doc"], x["c"], x["h"]))
    x = {k: v[order] for k, v in x.items()}
    form = np.flatnonzero(changes(x["h"], x["c"]))
    head = form[np.searchsorted(form, np.arange(len(order)), "right") - 1]
    return x, head, (x["row"] != x["row"][head]) | (x["pos"] != x["pos"][head])


def post(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 1: ``bucket, known, blob``: anchors, and ranges that repeat within a block."""

    def run(batches):
        found: list[dict[str, np.ndarray]] = []
        texts: dict[int, bytes] = {}
        size = 0

        def flush():
            x, head, later = firsts({k: np.concatenate([f[k] for f in found]) for k, _ in ANCHOR})
            at = np.flatnonzero(later)
            same = np.array([s == t for s, t in zip(body(texts, x, at), body(texts, x, head[at]))], bool)
            at = at[same]
            x, copies = {k: np.delete(v, at) for k, v in x.items()}, {k: v[at] for k, v in x.items()}
            rows = [(b, False, blob) for b, blob in buckets_of(ANCHOR, x, x["h"], buckets)]
            if len(at):
                ranges = covered(copies)
                rows.append((int(xx_long(ranges["row"][:1])[0] % U(buckets)), True, packed(RANGES, ranges)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.binary()))], ["bucket", "known", "blob"])

        for batch in sliced(batches):
            for ids, own, part in runs_of(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), [(t or "").encode() for t in batch.column("text").to_pylist()]):
                found.append(anchors(ids, own, part))
                texts.update(zip(own.tolist(), part))
                size += sum(map(len, part))
                if size > BLOCK:
                    yield from flush()
                    found, texts, size = [], {}, 0
        if found:
            yield from flush()

    return docs.select("doc", "row", "text").mapInArrow(run, "bucket long, known boolean, blob binary")


def by_shard(shards: int, kind: list[bool], lists) -> pa.Table:
    rows = [(s, k, blob) for k, (fields, x) in zip(kind, lists) for s, blob in buckets_of(fields, x, shard_of(x["row"], shards).astype(np.uint64), shards)]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.binary()))], ["shard", "known", "blob"])


def parted(group: pa.Table, column: str) -> dict:
    """Row numbers of a group by the value of a column."""
    out: dict = {}
    for i, k in enumerate(group.column(column).to_pylist()):
        out.setdefault(k, []).append(i)
    return out


def ask(posted: DataFrame, shards: int, parts: int) -> DataFrame:
    """Step 2: ``shard, known, blob``: contexts to cut, and the ranges already known."""

    def merge(group: pa.Table) -> pa.Table:
        blobs, part = group.column("blob").to_pylist(), parted(group, "known")
        x, _, copy = firsts(joined(ANCHOR, [blobs[i] for i in part.get(False, [])]))
        new = changes(x["h"], x["c"])
        anchor = np.cumsum(changes(x["h"])) - 1
        form = np.cumsum(new) - 1
        forms = np.bincount(anchor[new], minlength=1)[anchor] if len(new) else np.zeros(0, np.int64)
        copied = np.bincount(form, copy, 1)[form] > 0 if len(new) else copy
        kind = np.where(forms > HEAVY, HASHED, np.where(forms > 1, MEMBER, 0))
        kind += np.where(copied & (kind != MEMBER), MODEL, 0)
        kind = np.where(copy, 0, kind)
        keep = copy | (new & (kind > 0))
        x = {k: v[keep] for k, v in (x | {"kind": kind.astype(np.uint8)}).items()}
        return by_shard(shards, [False, True], [(ASKED, x), (RANGES, joined(RANGES, [blobs[i] for i in part.get(True, [])]))])

    return posted.repartition(parts, "bucket").groupBy("bucket").applyInArrow(merge, "shard long, known boolean, blob binary")


def texts_of(docs: pa.Table) -> dict[int, bytes]:
    return {d: (t or "").encode() for d, t in zip(docs.column("row").to_pylist(), docs.column("text").to_pylist())}


def laid(bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of a grid filled up with END, and their lengths."""
    size = np.array([len(b) for b in bodies], np.int64)
    grid = np.full((len(bodies), width), END, np.uint8)
    grid[np.repeat(np.arange(len(bodies)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(bodies), np.uint8)
    return grid, size


def transforms(bodies: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transforms of strings, one for each group, end to end, and the group of each entry.

    Strings lie in order of group. Prefix doubling from eight bytes on, over
    what is still tied; equal suffixes stay in order of their strings.
    """
    grid, size = laid(bodies, max(map(len, bodies)) + 9)
    entries = size + 1
    begin = np.cumsum(entries) - entries
    n = int(entries.sum())
    string = np.repeat(np.arange(len(bodies)), entries)
    offset = np.arange(n) - begin[string]
    key = np.zeros((len(bodies), grid.shape[1] - 8), np.uint64)
    for i in range(8):
        key = (key << U(8)) | grid[:, i : i + key.shape[1]]
    key = key[string, offset]
    order = np.lexsort((key, group[string]))
    first = changes(key[order], group[string][order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step, longest = 8, int(size.max())
    while step <= longest:
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))  # places in order
        if not len(tied):
            break
        own = order[tied]
        ahead = np.where(offset[own] + step <= size[string[own]], rank[np.minimum(own + step, n - 1)], -1)
        again = np.lexsort((ahead, rank[own]))
        own, ahead = own[again], ahead[again]
        order[tied] = own
        new = changes(rank[own], ahead)
        first[tied] = new
        rank[own] = tied[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        step *= 2
    before = np.where(offset > 0, grid[string, np.maximum(offset - 1, 0)], np.uint8(END))
    return before[order], group[string[order]]


def cut(docs: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """Step 3: ``bucket, kind, blob, bytes``."""
    schema = "bucket long, kind int, blob binary, bytes binary"  # bytes: by Zstandard

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        small = zstandard.ZstdCompressor(level=3).compress
        rows: list[tuple[int, int, bytes, bytes]] = []
        blobs, part = right.column("blob").to_pylist(), parted(right, "known")
        known = union_of(joined(RANGES, [blobs[i] for i in part.get(True, [])]))
        if len(known["row"]):
            rows.append((int(xx_long(known["row"][:1])[0] % U(buckets)), KNOWN, packed(RANGES, known), b""))
        x = joined(ASKED, [blobs[i] for i in part.get(False, [])])
        texts = texts_of(left)
        bucket = (x["h"] % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        x, bucket = {k: v[order] for k, v in x.items()}, bucket[order]

        def pieces(own: np.ndarray):
            """Contexts of whole buckets, a few thousand together; a bucket with more gives several."""
            at = 0
            while at < len(own):
                to = min(len(own), at + 8192)
                edge = np.searchsorted(bucket[own], bucket[own[to - 1]], "left") if to < len(own) else to
                to = int(edge) if edge > at else to
                yield own[at:to]
                at = to

        for kind, want in ((COPIES, x["kind"] == 0), (MODELS, x["kind"] & MODEL > 0), (MEMBERS, x["kind"] & MEMBER > 0)):
            for own in pieces(np.flatnonzero(want)):
                bodies = body(texts, x, own)
                if kind == MEMBERS:
                    bwt, of = transforms(bodies, bucket[own])
                    sizes = np.cumsum([len(b) + 1 for b in bodies])
                else:
                    bwt, of = np.frombuffer(b"".join(bodies), np.uint8), None
                    sizes = np.cumsum([len(b) for b in bodies])
                edges = np.append(np.flatnonzero(changes(bucket[own])), len(own)).tolist()
                for s, e in zip(edges, edges[1:]):
                    lo = int(sizes[s - 1]) if s else 0
                    rows.append((int(bucket[own[s]]), kind, packed(ANCHOR, {k: x[k][own[s:e]] for k, _ in ANCHOR}), small(bwt[lo : int(sizes[e - 1])].tobytes())))
        got: list[tuple[bytes, int, int, int]] = []
        heavy = np.flatnonzero(x["kind"] & HASHED)
        for d, p, hi, t, r in zip(*(x[k][heavy].tolist() for k in ("doc", "pos", "hi")), body(texts, x, heavy), x["row"][heavy].tolist()):
            got += [(hashlib.blake2b(t[s : s + WINDOW], digest_size=16).digest(), d, r, p - hi + s) for s in range(len(t) - WINDOW + 1)]
        if got:
            w = np.frombuffer(b"".join(g[0] for g in got), "<u8").reshape(-1, 2)
            cols = {"w1": w[:, 0], "w2": w[:, 1], "doc": np.array([g[1] for g in got], np.int64), "row": np.array([g[2] for g in got], np.int64), "start": np.array([g[3] for g in got], np.int64)}
            rows += [(b, HASHES, blob, b"") for b, blob in buckets_of(WINDOWS, cols, cols["w1"], buckets)]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "kind", "blob", "bytes"])

    return docs.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(run, schema)


class Merge:
    """Transforms of several shards, end to end: entry -> string and offset, and the merge."""

    def __init__(self, x: dict[str, np.ndarray], counts: list[int], bwt: np.ndarray):
        """x: contexts in order of shard and string; counts: strings of each shard."""
        self.x, self.bwt = x, bwt
        self.size = WINDOW + x["hi"].astype(np.int64) - x["lo"]
        shard = np.repeat(np.arange(len(counts)), counts)
        entries = np.bincount(shard, self.size + 1, len(counts)).astype(np.int64)
        ends = np.cumsum(entries)
        piece = np.repeat(np.arange(len(counts)).astype(np.uint16 if len(counts) < 1 << 16 else np.int64), entries)
        self.lf = np.empty(len(bwt), np.int64)  # the entry one byte longer
        self.lf[np.lexsort((bwt, piece))] = np.arange(len(bwt))
        # a shard's last entries are its strings' ends, in order; walk every string backwards
        number = np.arange(len(shard)) - (np.cumsum(counts) - counts)[shard]
        at = ends[shard] - np.asarray(counts, np.int64)[shard] + number
        self.string, self.offset = np.zeros(len(bwt), np.int64), np.zeros(len(bwt), np.int64)
        self.grid = np.zeros((len(shard), int(self.size.max(initial=0))), np.uint8)
        live, o = np.arange(len(shard)), self.size.copy()
        while len(live):
            self.string[at], self.offset[at] = live, o[live]
            more = o[live] > 0
            live, at = live[more], at[more]
            o[live] -= 1
            self.grid[live, o[live]] = bwt[at]
            at = self.lf[at]

    def bytes_of(self, i: int) -> bytes:
        return self.grid[i, : self.size[i]].tobytes()

    def repeated(self) -> dict[str, np.ndarray]:
        """Ranges of windows that an earlier place holds too."""
        entry, block = np.arange(len(self.bwt)), np.zeros(len(self.bwt), np.int64)
        for _ in range(WINDOW):
            byte = self.bwt[entry]
            inside = np.flatnonzero(byte != END)
            order = inside[np.argsort(byte[inside], kind="stable")]
            entry, byte, block = entry[order], byte[order], block[order]
            new = changes(byte, block)
            keep = np.flatnonzero(~(new & np.append(new[1:], True)))
            entry, block = self.lf[entry[keep]], np.cumsum(new)[keep]
        own, off = self.string[entry], self.offset[entry]
        x = self.x
        start = x["pos"][own].astype(np.int64) - x["hi"][own] + off
        return later({"row": x["row"][own], "start": start}, x["doc"][own], block)


def later(w: dict[str, np.ndarray], doc: np.ndarray, *same: np.ndarray) -> dict[str, np.ndarray]:
    """Ranges of the windows that are not the first of those with equal ``same``."""
    order = np.lexsort((w["start"], w["row"], doc, *same))
    w = {k: v[order] for k, v in w.items()}
    head = np.flatnonzero(changes(*(s[order] for s in same)))
    own = head[np.searchsorted(head, np.arange(len(order)), "right") - 1] if len(head) else head
    gone = (w["row"] != w["row"][own]) | (w["start"] != w["start"][own])
    return union_of({"row": w["row"][gone], "start": w["start"][gone].astype(np.int64), "end": w["start"][gone].astype(np.int64) + WINDOW})


def cut_up(x: dict[str, np.ndarray], data: bytes) -> list[bytes]:
    ends = np.cumsum(WINDOW + x["hi"].astype(np.int64) - x["lo"]).tolist()
    return [data[s:e] for s, e in zip([0, *ends], ends)]


def resolved(kinds: list[int], blobs: list[bytes], data: list[bytes]) -> dict[str, np.ndarray]:
    """Step 4 for the rows of a bucket: the byte ranges to remove."""
    at = {k: [i for i, own in enumerate(kinds) if own == k] for k in range(5)}
    parts = [joined(RANGES, [blobs[i] for i in at[KNOWN]])]
    pieces = [unpacked(ANCHOR, blobs[i]) for i in at[MEMBERS]]
    x = {k: np.concatenate([p[k] for p in pieces]) if pieces else np.zeros(0, t) for k, t in ANCHOR}
    counts = [len(p["h"]) for p in pieces]
    bwt = np.frombuffer(b"".join(data[i] for i in at[MEMBERS]), np.uint8)
    merge = Merge(x, counts, bwt)
    copies, copied = joined(ANCHOR, [blobs[i] for i in at[COPIES]]), b"".join(data[i] for i in at[COPIES])
    if len(copies["h"]):
        models = joined(ANCHOR, [blobs[i] for i in at[MODELS]])
        model = dict(zip(zip(models["h"].tolist(), models["c"].tolist()), zip(cut_up(models, b"".join(data[i] for i in at[MODELS])), range(len(models["h"])))))
        wanted = np.flatnonzero(np.isin(x["c"], copies["c"]))
        member = {(h, c): merge.bytes_of(i) for h, c, i in zip(x["h"][wanted].tolist(), x["c"][wanted].tolist(), wanted.tolist())}
        keys, bodies = list(zip(copies["h"].tolist(), copies["c"].tolist())), cut_up(copies, copied)
        same = np.array([(member[k] if k in member else model[k][0]) == b for k, b in zip(keys, bodies)], bool)
        parts.append(covered({k: v[same] for k, v in copies.items()}))
        if not same.all():  # equal hashes of different bytes: these contexts, and what they were taken for, are members too
            odd = np.flatnonzero(~same)
            also = sorted({model[keys[i]][1] for i in odd.tolist() if keys[i] not in member})
            more = {k: np.concatenate([copies[k][odd], models[k][also]]) for k, _ in ANCHOR}
            extra, _ = transforms([*(bodies[i] for i in odd.tolist()), *(model[models["h"][i], models["c"][i]][0] for i in also)], np.zeros(len(odd) + len(also), np.int64))
            merge = Merge({k: np.concatenate([x[k], more[k]]) for k, _ in ANCHOR}, [*counts, len(more["h"])], np.concatenate([bwt, extra]))
    parts.append(merge.repeated())
    w = joined(WINDOWS, [blobs[i] for i in at[HASHES]])
    parts.append(later({"row": w["row"], "start": w["start"]}, w["doc"], w["w2"], w["w1"]))
    return union_of({k: np.concatenate([p[k] for p in parts]) for k, _ in RANGES})


def settle(cuts: DataFrame, shards: int, parts: int) -> DataFrame:
    """Step 4: ``shard, blob``: byte ranges to remove."""

    def run(group: pa.Table) -> pa.Table:
        import zstandard

        whole = zstandard.ZstdDecompressor().decompress
        kinds, blobs, data = (group.column(c).to_pylist() for c in ("kind", "blob", "bytes"))
        x = resolved(kinds, blobs, [whole(d) if d else d for d in data])
        rows = list(buckets_of(RANGES, x, shard_of(x["row"], shards).astype(np.uint64), shards))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return cuts.repartition(parts, "bucket").groupBy("bucket").applyInArrow(run, "shard long, blob binary")


def union_of(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Ranges merged where they touch, by row and start."""
    if not len(x["row"]):
        return x
    order = np.lexsort((x["start"], x["row"]))
    row, start, end = (x[k][order].astype(np.int64) for k in ("row", "start", "end"))
    # running maximum of ends within a row: lift each row above the one before
    lift = np.cumsum(np.diff(row, prepend=row[:1]) != 0) * (1 << 33)
    reach = np.maximum.accumulate(end + lift)
    new = np.append(True, (start + lift)[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return {"row": row[first], "start": start[first], "end": (reach - lift)[last]}


def deduplicated(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed byte ranges, and the bytes that stay."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)).alias("doc"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("row", F.xxhash64("doc", "text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), -(-size // (4 * SHARE)))
    shards = buckets = max(parts, -(-size // SHARE))
    dealt = keyed.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).repartition(parts, "shard")
    asked = ask(post(keyed, buckets), shards, parts).repartition(parts, "shard")
    ranges = settle(cut(dealt, asked, buckets), shards, parts).repartition(parts, "shard")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        x = union_of(joined(RANGES, right.column("blob").to_pylist() if right.num_rows else []))
        rows, spans, kept, size = left.column("row").to_pylist(), [], [], []
        lo, hi = np.searchsorted(x["row"], rows, "left").tolist(), np.searchsorted(x["row"], rows, "right").tolist()
        start, end = x["start"].tolist(), x["end"].tolist()
        for t, i, j in zip(left.column("text").to_pylist(), lo, hi):
            raw = (t or "").encode()
            own = [(s, min(e, len(raw))) for s, e in zip(start[i:j], end[i:j]) if s < len(raw)]
            edges = [0, *(p for s in own for p in s), len(raw)]
            kept.append(b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
            spans.append([{"start": s, "end": e} for s, e in own])
            size.append(len(raw))
        ids = [None if d == NOBODY else d for d in left.column("doc").to_pylist()]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})

    return dealt.groupBy("shard").cogroup(ranges.groupBy("shard")).applyInArrow(drop, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op2_substrings": op2_substrings}
ORACLES: dict[str, str] = {}
