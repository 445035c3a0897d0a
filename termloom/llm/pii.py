"""Personal data: fixed patterns plus bootstrapped contextual extraction.

One pass over the texts finds the base entities (email, ip, card, phone) and
every other identifier-shaped token or row of digit groups, each with the one and
two words before it on its line (a word: a run of letters, digits and
underscores, or any other character). A token is an identifier if it holds an @
or from 5 to ``DIGITS_IN_TOKEN`` digits, groups of digits if they have 5 to
``DIGITS_IN_GROUPS`` together: more are tables or numbers, as a card is no card
beyond 19 digits. Neither has a limit on characters.
Base entities are seeds: the contexts they stand in are lexical patterns. Spark
then scores the bipartite graph of patterns and instances, in turn, ``ROUNDS``
times: a pattern is worth the share of its distinct instances that are known
(with at least ``SUPPORT`` known ones), an instance the noisy-or of its
patterns. Identifiers that reach ``SURE`` through a pattern of at least
``TRUST`` they stand in become spans of that pattern's kind; base spans stay.

The scanners take time in proportion to a text, however long its runs of digits
or letters are; where a match fails its test it is dropped and scanning goes on
after it.

Defined cases: null and empty texts have no span; spans of different kinds may
overlap, an added span overlaps no base span; offsets are code points, ends
exclusive; every row has a result of its own, whatever its id (null and repeated
ids too), and equal documents give equal rows; of kinds that reach a value
equally the last by name is taken; an empty table gives an empty result. Pairs of pattern and instance are
distinct before anything is joined, so a context in a third of all documents
costs a partial aggregate and a join that adaptive execution can split.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, TRUST, SURE = 3, 4, 0.6, 0.7
DIGITS_IN_TOKEN, DIGITS_IN_GROUPS = 64, 19
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
PHONE_RUN = re.compile(r"[ ().0-9-]*")
MARK = re.compile(r"[0-9@]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = re.compile(r"\S+")
#: The middle and the end of an address that is spelled out; its beginning is read backwards.
AT = re.compile(r" ?(?:\(at\)|\[at\]| at ) ?", re.I)
DOT = re.compile(r"[\w-]++ ?(?:\(dot\)|\[dot\]| dot ) ?\w++", re.I)
SPELLED = re.compile(r"[\w.+-]")
#: Groups of digits joined by blanks, brackets or hyphens.
SPACED = re.compile(r"(?<!\w)[(\[]?[0-9]++(?:[ ()\[\]-]{1,3}[0-9]++)+(?!\w)")
TRIM = "\"'()[]{}<>,;:!?.|*#$%&="


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL_CHARS:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)  # no later local part reaches back over this sign
        at = text.find("@", done)
    return out


def digit_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in DIGITS.finditer(text)]


def ips(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, i = [], 0
    while i + 3 < len(runs):
        if all(runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] == "." for j in (i, i + 1, i + 2)):
            parts = [text[s:e].lstrip("0") for s, e in runs[i : i + 4]]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((runs[i][0], runs[i + 3][1]))
            i += 4
        else:
            i += 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, i = [], 0
    while i < len(runs):
        j = i
        n = runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            n += runs[j][1] - runs[j][0]
        if 13 <= n <= 19 and luhn("".join(text[s:e] for s, e in runs[i : j + 1])):
            out.append((runs[i][0], runs[j][1]))
        i = j + 1
    return out


def phones(text: str) -> list[tuple[int, int]]:
    out, at = [], text.find("+")
    while at >= 0:
        nxt = at + 1
        if nxt < len(text) and "0" <= text[nxt] <= "9":
            end = PHONE_RUN.match(text, at + 2).end()  # type: ignore[union-attr]
            while end > at + 3 and not "0" <= text[end - 1] <= "9":
                end -= 1
            if end > at + 3:
                if 9 <= sum("0" <= c <= "9" for c in text[at:end]) <= 15:
                    out.append((at, end))
                nxt = end
        at = text.find("+", nxt)
    return out


def base(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    if not text or not MARK.search(text):
        return []
    runs = digit_runs(text)
    found = (emails(text) if "@" in text else [], ips(text, runs), cards(text, runs), phones(text) if "+" in text else [])
    return [(kind, s, e) for kind, spans in zip(KINDS, found) for s, e in spans]


def contexts(text: str, start: int) -> list[str]:
    """Lexical patterns before a position: the last word, the last two words (of its line)."""
    w: list[str] = []
    at = start
    while at > 0 and len(w) < 2 and text[at - 1] != "\n":
        end = at
        if text[at - 1].isspace():
            at -= 1
            continue
        at -= 1
        while at > 0 and inside(text[end - 1]) and inside(text[at - 1]):
            at -= 1
        w.insert(0, DIGITS.sub("0", text[at:end].lower()))
    return [f"{n}|{' '.join(w[-n:])}" for n in (1, 2) if len(w) >= n]


def inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def hidden_emails(text: str) -> list[tuple[int, int]]:
    """Addresses with at and dot spelled out, leftmost first."""
    out, done, m = [], 0, AT.search(text)
    while m:
        lo = m.start()
        while lo > done and SPELLED.match(text[lo - 1]):
            lo -= 1
        while lo < m.start() and not inside(text[lo]):
            lo += 1
        hit = DOT.match(text, m.end()) if lo < m.start() else None
        if hit:
            out.append((lo, hit.end()))
            done = hit.end()
        m = AT.search(text, done if hit else m.start() + 1)
    return out


def may_hide(text: str) -> bool:
    """Whether an address can be spelled out: it needs an 'at' and a 'dot', in any case."""
    low = text.lower()
    return any(x in low for x in ("(dot)", "[dot]", " dot ")) and any(x in low for x in ("(at)", "[at]", " at "))


def others(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-shaped tokens and groups of digits that touch no base span; of those that overlap, the first and longest."""
    out, end = [], -1
    taken = sorted((s, e) for _, s, e in spans)
    i = 0
    shaped = []
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        lo = m.start()
        while lo > max(end, 0) and not text[lo - 1].isspace():
            lo -= 1
        hit = TOKEN.match(text, lo)
        end = hit.end()  # type: ignore[union-attr]
        s, e = lo, end
        while s < e and text[s] in TRIM:
            s += 1
        while e > s and text[e - 1] in TRIM:
            e -= 1
        digits = sum(c.isdigit() for c in text[s:e])
        if e > s and digits <= DIGITS_IN_TOKEN and ("@" in text[s:e] or digits >= 5):
            shaped.append((s, e))
    for m in SPACED.finditer(text):
        if 5 <= sum(c.isdigit() for c in m.group()) <= DIGITS_IN_GROUPS:
            shaped.append(m.span())
    if may_hide(text):
        shaped += hidden_emails(text)
    for s, e in sorted(shaped, key=lambda x: (x[0], -x[1])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if (i == len(taken) or taken[i][0] >= e) and (not out or out[-1][1] <= s):
            out.append((s, e))
    return out


KIND = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, row, base, seen``: base spans, and every identifier with its contexts (kind '' if not base)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    seen = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(batches):
        for batch in sliced(batches):
            bases, seens = [], []
            for text in batch.column("text").to_pylist():
                spans = base(text)
                bases.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                every = []
                if text:
                    more = others(text, spans) if MARK.search(text) or may_hide(text) else []
                    every = [(k, s, e) for k, s, e in spans] + [("", s, e) for s, e in more]
                seens.append([{"kind": k, "start": s, "end": e, "value": text[s:e].lower(), "patterns": contexts(text, s)} for k, s, e in every])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, pa.list_(span)), pa.array(seens, pa.list_(seen))], ["doc_id", "base", "seen"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id long, base {KIND}, seen array<struct<kind:string,start:long,end:long,value:string,patterns:array<string>>>")


def bootstrap(seen: DataFrame) -> DataFrame:
    """``pattern, kind, worth`` of trusted patterns. seen: kind, value, pattern."""
    edges = written(seen.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where("kind <> ''").groupBy("value").agg(F.max("kind").alias("kind")).select("value", "kind", F.lit(1.0).alias("score"))
    known, good = seeds, None
    for _ in range(ROUNDS):
        share = edges.select("pattern", "value").join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s")).where(F.col("s") >= SUPPORT)
        good = share.join(sizes, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("worth")).where(F.col("worth") >= TRUST)
        good = written(good, "patterns")
        new = edges.where("kind = ''").select("pattern", "value").join(good, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("worth"))))).alias("score"))
        known = seeds.unionByName(new.where(F.col("score") >= SURE).select("value", "kind", "score"))
    return good  # type: ignore[return-value]


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added``: base spans and the spans the patterns add."""
    rows = written(scan(docs).withColumn("row", F.monotonically_increasing_id()), "scan")
    flat = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    each = flat.select("row", "kind", "start", "end", "value", F.explode("patterns").alias("pattern"))
    good = bootstrap(each.select("kind", "value", "pattern"))
    # a value's worth over all its trusted patterns; a place counts if it stands in one of them
    pairs = each.where("kind = ''").drop("kind").join(good, "pattern")
    worth = pairs.select("value", "pattern", "kind", "worth").distinct().groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("worth"))))).alias("score"))
    best = worth.where(F.col("score") >= SURE).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", F.col("b.kind").alias("kind"))
    places = pairs.select("row", "start", "end", "value", "kind").distinct().join(best, ["value", "kind"])
    added = places.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    joined = rows.select("row", "doc_id", "base").join(added, "row", "left")
    return joined.select("doc_id", "base", F.coalesce("added", F.array().cast(KIND)).alias("added"))


def digest(spans: F.Column) -> F.Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x == F.lit(kind)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.col("base")["kind"], _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(F.concat("base", "added")).alias("spans"))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans merge."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
