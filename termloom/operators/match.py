"""Term and combination matching against a document collection.

``docs`` has id, nx (normalized text); ``terms`` has tid, normalized_term,
action. Every match is ``id, tid``. Joins are equi-joins: adaptive execution
broadcasts the lexicon while it is small and shuffles beyond that.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.similarity import few_targets, similar_pairs, similar_rows
from ..functions.text import tokens
from . import inplace

TERM_RATIO, TOKEN_RATIO, WINDOW, MIN_FUZZY = 0.86, 0.82, 4, 5


def doc_words(docs: DataFrame) -> DataFrame:
    """``id, word``: distinct words of each document."""
    return docs.select("id", F.explode(F.array_distinct(tokens(F.col("nx")))).alias("word"))


def word_count(c):
    return F.size(tokens(c))


def exact_words(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One-word terms that are a token of the text."""
    single = terms.where((F.col("normalized_term") != "") & (word_count(F.col("normalized_term")) == 1)).select("tid", F.col("normalized_term").alias("word"))
    return doc_words(docs).join(single, "word").select("id", "tid")


def containing(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrases (tid, phrase; two words or more) that are a substring of the text.

    A phrase lies over neighbouring words s t of a text where s ends with its
    first word and t starts with its second (is it, if a third follows). The
    join key is the phrase's first blank with up to three letters on either
    side; what meets is verified on the two words, and on the text only where a
    phrase has more than two.
    """
    p = F.col("phrase")
    two = phrases.where(F.instr(p, " ") > 1)
    left, right = F.substring_index(p, " ", 1), F.element_at(F.split(p, " "), 2)
    a, b = F.least(F.length(left), F.lit(3)), F.least(F.length(right), F.lit(3))
    keyed = two.select("tid", "phrase", left.alias("left"), right.alias("right"), a.alias("a"), b.alias("b"), F.concat(F.right(left, a), F.lit(" "), F.substring(right, F.lit(1), b)).alias("key"))
    kinds = [(r.a, r.b) for r in keyed.select("a", "b").distinct().collect()]  # nine at most
    if not kinds:
        return docs.select("id", F.lit(0).cast("long").alias("tid")).limit(0)
    w = tokens(F.col("nx"))
    n = F.greatest(F.size(w) - 1, F.lit(0))
    near = docs.select("id", F.explode(F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda s, t: F.struct(s.alias("s"), t.alias("t")))).alias("p")).select("id", "p.s", "p.t")
    s, t = F.col("s"), F.col("t")
    hits = None
    for ka, kb in kinds:
        posted = near.where((F.length(s) >= ka) & (F.length(t) >= kb)).withColumn("key", F.concat(F.right(s, F.lit(ka)), F.lit(" "), F.substring(t, 1, kb)))
        own = keyed.where((F.col("a") == ka) & (F.col("b") == kb)).drop("a", "b")
        met = posted.join(own, "key").where(s.endswith(F.col("left")) & t.startswith(F.col("right"))).select("id", "tid", "phrase")
        hits = met if hits is None else hits.unionByName(met)
    hits = hits.distinct()  # type: ignore[union-attr]
    longer = F.size(F.split(p, " ")) > 2
    if keyed.where(longer).limit(1).count() == 0:
        return hits.select("id", "tid")
    checked = hits.where(longer).join(docs.select("id", "nx"), "id").where(F.col("nx").contains(p))
    return hits.where(~longer).select("id", "tid").unionByName(checked.select("id", "tid"))


def grams(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """``id, n, gram``: distinct runs of n consecutive words."""
    w = tokens(F.col("nx"))
    out = None
    for n in lengths:
        m = F.greatest(F.size(w) - (n - 1), F.lit(0))
        # the slices are cut once, outside the lambda, which joins their i-th words
        runs = F.transform(F.arrays_zip(*[F.slice(w, k + 1, m).alias(f"w{k}") for k in range(n)]), lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(n)]))
        one = docs.select("id", F.lit(n).alias("n"), F.explode(F.array_distinct(runs)).alias("gram"))
        out = one if out is None else out.unionByName(one)
    return out  # type: ignore[return-value]


def fuzzy_words(docs: DataFrame, terms: DataFrame, safe: DataFrame, threshold: float = TERM_RATIO) -> DataFrame:
    """One-word risk terms of five letters or more that resemble a token outside the safe set (normalized_term)."""
    t = F.col("normalized_term")
    risk = terms.where((F.col("action") != "ALLOW") & (F.length(t) >= MIN_FUZZY) & (word_count(t) == 1)).select("tid", t.alias("target"))
    words = doc_words(docs)
    vocabulary = words.select(F.col("word").alias("text")).distinct().join(safe.select(t.alias("text")), "text", "left_anti")
    pairs = similar_pairs(vocabulary, risk.select("target").distinct(), threshold)
    return words.withColumnRenamed("word", "text").join(pairs, "text").join(risk, "target").select("id", "tid").distinct()


def fuzzy_grams(docs: DataFrame, terms: DataFrame, threshold: float = TERM_RATIO) -> DataFrame:
    """Risk terms of several words that resemble as many consecutive tokens."""
    t = F.col("normalized_term")
    risk = terms.where((F.col("action") != "ALLOW") & (F.length(t) >= MIN_FUZZY) & (word_count(t) > 1)).select("tid", t.alias("target"), word_count(t).alias("n"))
    lengths = [r.n for r in risk.select("n").distinct().collect()]
    if not lengths:
        return docs.select("id", F.lit(0).cast("long").alias("tid")).limit(0)
    found = None
    for n in lengths:  # few grams repeat, so they are compared where they stand
        own = risk.where(F.col("n") == n).select("tid", "target")
        near = similar_rows(grams(docs, [n]).select("id", F.col("gram").alias("text")), own.select("target").distinct(), threshold)
        one = near.join(own, "target").select("id", "tid")
        found = one if found is None else found.unionByName(one)
    return found.distinct()  # type: ignore[union-attr]


def term_matches(docs: DataFrame, terms: DataFrame, safe: DataFrame | None = None) -> DataFrame:
    """All term matches; without a safe set, exact ones only."""
    exact = exact_words(docs, terms).unionByName(containing(docs, terms.select("tid", F.col("normalized_term").alias("phrase"))))
    if safe is not None:
        exact = exact.unionByName(fuzzy_words(docs, terms, safe)).unionByName(fuzzy_grams(docs, terms))
    return exact.distinct()


def ordered_windows(docs: DataFrame, rules: DataFrame, threshold: float | None = TOKEN_RATIO, window: int = WINDOW, few: int = 5000) -> DataFrame:
    """Rules (tid, normalized_phrase) whose words occur in order, each the nearest within ``window`` tokens of the one before.

    Greedy from every start, no backtracking. A threshold of None asks for
    equal tokens. One-word phrases have no such match. Up to ``few`` distinct
    words of at most four times as many rules (both are checked) go to every
    batch of texts, which are walked where they stand. Otherwise words that
    resemble a rule's are met by joins; what rules' first two words let through
    is followed further.
    """
    w = tokens(F.col("normalized_phrase"))
    parted = rules.where(F.size(w) > 1).select("tid", F.size(w).alias("k"), w.alias("w"))
    if threshold is not None:
        listed = parted.select("tid", "w").limit(4 * few + 1).collect()
        wanted = few_targets(parted.select(F.explode("w").alias("target")).distinct(), few) if len(listed) <= 4 * few else None
        if wanted is not None:
            return _walked(docs, [(r.tid, r.w) for r in listed], rules.schema["tid"].dataType, wanted, threshold, window)
        return _joined(docs, parted, threshold, window)
    words = tokens(F.col("nx"))
    firsts = parted.select("tid", "k", F.col("w")[0].alias("s"), F.col("w")[1].alias("t"))
    n = F.size(words)
    apart = [F.zip_with(F.slice(words, 1, F.greatest(n - d, F.lit(0))), F.slice(words, 1 + d, F.greatest(n - d, F.lit(0))), lambda s, t: F.struct(s.alias("s"), t.alias("t"))) for d in range(1, window + 1)]
    pairs = docs.select("id", F.explode(F.flatten(F.array(*apart))).alias("p")).select("id", "p.s", "p.t")
    met = pairs.join(firsts, ["s", "t"]).select("id", "tid", "k").distinct()
    if parted.where("k > 2").limit(1).count() == 0:
        return met.select("id", "tid")
    return met.where("k = 2").select("id", "tid").unionByName(_followed(docs, parted, met.where("k > 2"), None, window))


def _walked(docs: DataFrame, rules: list[tuple], tid_type, targets: list[str], threshold: float, window: int) -> DataFrame:
    """Matches of few rules, text by text: no word or pair of words leaves its row, and a row names a rule once."""
    tids_of: dict[tuple, list] = {}
    for tid, w in rules:
        tids_of.setdefault(tuple(w), []).append(tid)
    windows, tids_of = inplace.Windows([list(w) for w in tids_of], targets, threshold, window), [list(dict.fromkeys(x)) for x in tids_of.values()]

    def run(batches):
        for batch, part in inplace.sliced_texts(batches, "nx"):
            hits = sorted({(row, tid) for row, at in windows.of(part) for tid in tids_of[at]}, key=lambda h: h[0])
            ids = batch.column("id").take(pa.array([row for row, _ in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([tid for _, tid in hits], tids)], ["id", "tid"])

    tids = to_arrow_type(tid_type)
    return docs.select("id", "nx").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tid {tid_type.simpleString()}").distinct()


def _joined(docs: DataFrame, parted: DataFrame, threshold: float, window: int) -> DataFrame:
    """Matches of any number of rules: places of similar words meet within their row, so a word's variants never multiply rules."""
    keyed = docs.select(F.struct(F.col("id").alias("id"), F.xxhash64("nx").alias("text")).alias("id"), "nx")
    like = similar_pairs(doc_words(keyed).select(F.col("word").alias("text")).distinct(), parted.select(F.explode("w").alias("target")).distinct(), threshold)
    places = keyed.select("id", F.posexplode(tokens(F.col("nx"))).alias("pos", "text")).join(like, "text").select("id", "pos", "target")
    firsts = parted.select("tid", "k", F.col("w")[0].alias("t0"), F.col("w")[1].alias("t1"))
    ahead = places.withColumnRenamed("target", "t0").join(firsts.select("t0").distinct(), "t0", "left_semi")
    ahead = ahead.select("id", "t0", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + window)).alias("pos"))
    second = places.withColumnRenamed("target", "t1").join(firsts.select("t1").distinct(), "t1", "left_semi")
    met = ahead.join(second, ["id", "pos"]).select("id", "t0", "t1").distinct().join(firsts, ["t0", "t1"]).select("id", "tid", "k")
    both = met.where("k = 2").select("id", "tid").unionByName(_followed(keyed, parted, met.where("k > 2"), like, window))
    return both.select(F.col("id.id").alias("id"), "tid").distinct()


def _followed(docs: DataFrame, parted: DataFrame, met: DataFrame, like: DataFrame | None, window: int) -> DataFrame:
    """The greedy walk for candidate (id, tid) of longer rules."""
    parts = met.join(parted.select("tid", F.posexplode("w").alias("i", "target")), "tid")
    place = docs.join(met.select("id").distinct(), "id", "left_semi").select("id", F.posexplode(tokens(F.col("nx"))).alias("pos", "text"))
    near = place.withColumn("target", F.col("text")) if like is None else place.join(like, "text")
    places = near.join(parts.select("id", "target").distinct(), ["id", "target"]).groupBy("id", "target").agg(F.sort_array(F.collect_set("pos")).alias("ps"))
    rows = places.join(parts, ["id", "target"]).groupBy("id", "tid", "k").agg(F.sort_array(F.collect_list(F.struct("i", "ps"))).alias("row"))
    rows = rows.where(F.size("row") == F.col("k")).withColumn("ps", F.transform("row", lambda r: r["ps"]))

    def follow(cursor, ps):
        ahead = F.array_min(F.filter(ps, lambda p: (p >= cursor) & (p < cursor + window)))
        return F.when(cursor < 0, cursor).otherwise(F.coalesce(ahead + 1, F.lit(-1)))

    rest = F.slice("ps", 2, F.col("k") - 1)
    hit = F.exists(F.element_at("ps", 1), lambda s: F.aggregate(rest, s + 1, follow) >= 0)
    return rows.where(hit).select("id", "tid")


def combination_matches(docs: DataFrame, rules: DataFrame, threshold: float | None = TOKEN_RATIO, window: int = WINDOW) -> DataFrame:
    """Substring or ordered-window matches. One-word phrases match as substrings of any token."""
    phrases = rules.select("tid", F.col("normalized_phrase").alias("phrase"))
    several = containing(docs, phrases)
    single = within_words(docs, phrases.where((F.col("phrase") != "") & (F.instr("phrase", " ") == 0)))
    return several.unionByName(single).unionByName(ordered_windows(docs, rules, threshold, window)).distinct()


def within_words(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """One-word phrases inside a token: vocabulary words post their parts of the phrases' lengths."""
    lengths = [r.n for r in phrases.select(F.length("phrase").alias("n")).distinct().collect()]
    if not lengths:
        return docs.select("id", F.lit(0).cast("long").alias("tid")).limit(0)
    words = doc_words(docs)
    v = F.col("word")
    cut = [F.when(F.length(v) >= n, F.transform(F.sequence(F.lit(1), F.length(v) - n + 1), _part(v, n))).otherwise(F.array().cast("array<string>")) for n in lengths]
    parts = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.flatten(F.array(*cut)))).alias("phrase"))
    hit = parts.join(phrases, "phrase").select("word", "tid")
    return words.join(hit, "word").select("id", "tid").distinct()


def _part(v, n: int):
    return lambda i: F.substring(v, i, F.lit(n))
