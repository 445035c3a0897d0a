"""Lexica derived from the driver's tables, the same in Spark and in DuckDB SQL.

Terms, phrases and rules come from ``benchmark``, approved names and white
words from ``part``, overrides from ``events``: every operator meets real rows
without a curated list being shipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BASES, CONSTRUCT, DASHES, PREFIX_LETTERS, QUOTES, STRIPPABLE, normalize_text, tokens


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table over the cores: few row groups are few tasks. A table with splits enough is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def normalized(docs: DataFrame) -> DataFrame:
    return docs.select("id", normalize_text(F.coalesce("text", F.lit(""))).alias("nx"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def _owned(rows: DataFrame) -> DataFrame:
    """rows: term, item_id, pos -> term rows with tid and ord, owner the smallest (item_id, pos)."""
    first = rows.groupBy("term").agg(F.min(F.struct("item_id", "pos")).alias("o")).select("term", "o.item_id", "o.pos")
    k = F.col("item_id") % 3
    return first.select(
        (F.col("item_id") * 100000 + F.col("pos")).alias("tid"), "term", F.col("term").alias("normalized_term"), F.concat(F.lit("cat"), (F.col("item_id") % 5).cast("string")).alias("category"),
        F.element_at(F.array(*map(F.lit, ("seed_blacklist", "seed_whitelist", "public_list", "other"))), (F.col("item_id") % 4 + 1).cast("int")).alias("source"),
        (50 + (F.col("item_id") * 7) % 50).cast("int").alias("risk_level"), F.when(k == 0, "BLOCK").when(k == 1, "ALLOW").otherwise("MANUAL_REVIEW").alias("action"),
        F.lit(0.9).alias("confidence"), F.lit("").alias("notes"), (F.col("item_id") * 100000 + F.col("pos")).alias("ord"),
    )


def _bench_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tokens(normalize_text(F.col("text")))
    return read(spark, sf_dir, "benchmark").select("item_id", w.alias("w"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-word terms of five letters or more."""
    return _owned(_bench_words(spark, sf_dir).select("item_id", F.posexplode("w").alias("pos", "term")).where(F.length("term") >= 5))


def _pairs(spark: SparkSession, sf_dir: str, gap: int) -> DataFrame:
    w = _bench_words(spark, sf_dir).where(F.size("w") > gap)
    i = F.explode(F.sequence(F.lit(0), F.size("w") - 1 - gap)).alias("pos")
    two = w.select("item_id", "w", i).select("item_id", "pos", F.element_at("w", F.col("pos") + 1).alias("a"), F.element_at("w", F.col("pos") + 1 + gap).alias("b"))
    return two.where((F.length("a") >= 4) & (F.length("b") >= 4)).select("item_id", "pos", F.concat_ws(" ", "a", "b").alias("term"))


def _triples(spark: SparkSession, sf_dir: str, places: tuple[int, int, int]) -> DataFrame:
    last = places[2]
    w = _bench_words(spark, sf_dir).where(F.size("w") > last)
    i = F.explode(F.sequence(F.lit(0), F.size("w") - 1 - last)).alias("pos")
    three = w.select("item_id", "w", i).select("item_id", "pos", *[F.element_at("w", F.col("pos") + 1 + p).alias(f"w{k}") for k, p in enumerate(places)])
    return three.where(" and ".join(f"length(w{k}) >= 4" for k in range(3))).select("item_id", "pos", F.concat_ws(" ", "w0", "w1", "w2").alias("term"))


def phrases3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word terms."""
    return _owned(_triples(spark, sf_dir, (0, 1, 2))).withColumns({"tid": F.col("tid") + 70000, "ord": F.col("ord") + 70000})


def rules3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word rules: a word, the next but one, and the one after that."""
    rows = _owned(_triples(spark, sf_dir, (0, 2, 3)))
    return rows.select((F.col("tid") + 80000).alias("tid"), F.col("term").alias("phrase"), F.col("term").alias("normalized_phrase"), F.col("risk_level").alias("risk_score"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word terms."""
    return _owned(_pairs(spark, sf_dir, 1)).withColumns({"tid": F.col("tid") + 50000, "ord": F.col("ord") + 50000})


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).unionByName(phrases(spark, sf_dir))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word rules whose words stand one word apart in an item."""
    rows = _owned(_pairs(spark, sf_dir, 2))
    return rows.select("tid", F.col("term").alias("phrase"), F.col("term").alias("normalized_phrase"), F.col("risk_level").alias("risk_score"))


def approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("resource_name"), F.when(F.col("p_size") % 4 == 0, "BLOCK").otherwise("ALLOW").alias("action"), F.col("p_partkey").alias("ord"))


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of the conversations as an external list, in alphabetical order of the word."""
    w = read(spark, sf_dir, "conversations").select(F.explode(tokens(normalize_text(F.col("text")))).alias("term")).distinct()
    return w.select(
        "term", F.col("term").alias("normalized_term"), F.lit("general").alias("category"), F.lit("ext").alias("source"), F.lit(0).alias("risk_level"),
        F.lit("ALLOW").alias("action"), F.lit(0.45).alias("confidence"), F.lit("").alias("notes"), F.conv(F.substring(F.hex(F.col("term")), 1, 12), 16, 10).cast("long").alias("ord"),
    )


BLACK_PATTERNS = [(0, "first", "ther"), (1, "first", "tion"), (2, "second", "ing"), (3, "second", "anth"), (4, "third", "ere")]
GREY_PATTERNS = [(0, "context", "thou"), (1, "context", "ent"), (2, "project", "hand")]
SAFE = ["therea", "tionth", "there", "thand"]


def patterns(spark: SparkSession, rows: list[tuple[int, str, str]] = BLACK_PATTERNS) -> DataFrame:
    return spark.createDataFrame(rows, "rule_ord int, category string, pattern string")


def safe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in SAFE], "normalized_term string")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override requests: each event's user asks about one word of the lexicon's spelling."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("Term-"), (F.col("user_id") % 97).cast("string")).alias("term"),
        F.when(F.col("event_id") % 2 == 0, "ALLOW").otherwise("BLOCK").alias("action"), F.col("ts").alias("created_at"), "event_id",
    )


# --- DuckDB -----------------------------------------------------------------


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_marks(x: str) -> str:
    return rf"regexp_replace({x}, '\p{{Mn}}', '', 'g')"


def sql_word(w: str, strip: bool = True) -> str:
    out = f"regexp_replace({w}, '^[{PREFIX_LETTERS}]{{1,3}}({'|'.join(STRIPPABLE)})$', '\\1')" if strip else w
    cases = " ".join(f"when {quoted(a)} then {quoted(b)}" for a, b in CONSTRUCT.items())
    return f"(case {out} {cases} else {out} end)"


KEEP = r"[^\x{0590}-\x{05FF}0-9a-zA-Z]+"


def sql_norm(x: str) -> str:
    clean = f"lower(trim(regexp_replace(regexp_replace(translate({sql_marks(x)}, {quoted(QUOTES)}, ''), '[{DASHES}]+', ' ', 'g'), '{KEEP}', ' ', 'g')))"
    return f"array_to_string(list_transform(string_split({clean}, ' '), lambda w: {sql_word('w')}), ' ')"


def sql_token(x: str, strip: bool = True) -> str:
    clean = f"regexp_replace(translate(lower(trim({sql_marks(x)})), {quoted(QUOTES)}, ''), '{KEEP}', '', 'g')"
    return sql_word(clean, strip)


def _sql_owned(name: str, rows: str, shift: int = 0) -> str:
    return f"""{name} as (
  select item_id * 100000 + pos + {shift} as tid, term, term as normalized_term, 'cat' || (item_id % 5) as category,
    ['seed_blacklist', 'seed_whitelist', 'public_list', 'other'][(item_id % 4 + 1)::int] as source, (50 + (item_id * 7) % 50)::int as risk_level,
    case item_id % 3 when 0 then 'BLOCK' when 1 then 'ALLOW' else 'MANUAL_REVIEW' end as action, item_id * 100000 + pos + {shift} as ord
  from (select term, min(item_id * 100000 + pos) // 100000 as item_id, min(item_id * 100000 + pos) % 100000 as pos from ({rows}) group by term))"""


def _sql_pairs(gap: int) -> str:
    return f"""select item_id, pos, w[pos + 1] || ' ' || w[pos + 1 + {gap}] as term
    from (select item_id, w, unnest(range(0, len(w) - {gap})) as pos from bw where len(w) > {gap})
    where length(w[pos + 1]) >= 4 and length(w[pos + 1 + {gap}]) >= 4"""


def _sql_triples(places: tuple[int, int, int]) -> str:
    w = [f"w[pos + 1 + {p}]" for p in places]
    return f"""select item_id, pos, {w[0]} || ' ' || {w[1]} || ' ' || {w[2]} as term
    from (select item_id, w, unnest(range(0, len(w) - {places[2]})) as pos from bw where len(w) > {places[2]})
    where {' and '.join(f'length({x}) >= 4' for x in w)}"""


SQL = {
    "docs": f"docs as (select doc_id as id, text, {sql_norm("coalesce(text, '')")} as nx from documents)",
    "msgs": f"msgs as (select conv_id * 1000 + turn as id, text, {sql_norm("coalesce(text, '')")} as nx from conversations)",
    "bw": f"bw as (select item_id, [x for x in string_split({sql_norm('text')}, ' ') if x <> ''] as w from benchmark)",
    "words": _sql_owned("words", "select item_id, pos, w[pos + 1] as term from (select item_id, w, unnest(range(0, len(w))) as pos from bw) where length(w[pos + 1]) >= 5"),
    "phrases": _sql_owned("phrases", _sql_pairs(1), 50000),
    "rules": _sql_owned("rules", _sql_pairs(2)),
    "phrases3": _sql_owned("phrases3", _sql_triples((0, 1, 2)), 70000),
    "rules3": _sql_owned("rules3", _sql_triples((0, 2, 3)), 80000),
    "mplace": "mplace as (select id, unnest(w) as word, unnest(range(0, len(w))) as pos from (select id, [x for x in string_split(nx, ' ') if x <> ''] as w from msgs))",
    "terms": "terms as (select * from words union all select * from phrases)",
    "place": "place as (select id, unnest(w) as word, unnest(range(0, len(w))) as pos from (select id, [x for x in string_split(nx, ' ') if x <> ''] as w from docs))",
    "approved": "approved as (select p_name as resource_name, case when p_size % 4 = 0 then 'BLOCK' else 'ALLOW' end as action, p_partkey as ord from part)",
    "external": f"""external as (select distinct term, term as normalized_term, 'general' as category, 'ext' as source, 0 as risk_level, 'ALLOW' as action, 0.45 as confidence, '' as notes
  from (select unnest(string_split({sql_norm('text')}, ' ')) as term from conversations) where term <> '')""",
}


def sql_block(a: str, b: str) -> str:
    """The longest common part of two strings, the first in a and then in b: struct(l, i, j), places from 1."""
    longest = f"list_max([l for l in range(0, length({a}) - i + 2) if contains({b}, substr({a}, i, l))])"
    lengths = f"[{longest} for i in range(1, length({a}) + 1)]"
    return f"""(select struct_pack(l := m, i := list_position(ls, m), j := instr({b}, substr({a}, cast(list_position(ls, m) as bigint), cast(m as bigint))))
      from (select ls, list_max(ls) as m from (select {lengths} as ls)))"""


def sql_near(name: str, texts: str, targets: str, threshold: float) -> str:
    """``name``(text, target, ratio): Ratcliff/Obershelp ratio of at least the threshold, of distinct texts and targets.

    Pairs are cut down by length and edit distance first. The distance counts
    bytes, so beyond ASCII four times the bound is let through.
    """
    size = "(length(text) + length(target))"
    wide = "case when strlen(text) = length(text) and strlen(target) = length(target) then 1 else 4 end"
    return f"""{name}_c as materialized (select text, target from (select distinct text from ({texts})) join (select distinct target from ({targets}))
    on 2 * least(length(text), length(target)) >= {threshold} * {size} - 1e-9 where text <> '' and levenshtein(text, target) <= floor((1 - {threshold}) * {size} + 1e-9) * {wide}),
{name}_s as (select text, target, text as a, target as b, {sql_block('text', 'target')} as x from {name}_c
  union all select text, target, y.a, y.b, {sql_block('y.a', 'y.b')} from
    (select text, target, unnest([struct_pack(a := substr(a, 1, x.i - 1), b := substr(b, 1, x.j - 1)), struct_pack(a := substr(a, x.i + x.l), b := substr(b, x.j + x.l))]) as y from {name}_s where x.l > 0)
    where y.a <> '' and y.b <> ''),
{name} as materialized (select text, target, case when text = target then 1.0::double else cast(2 as double) * sum(x.l) / {size} end as ratio from {name}_s group by text, target having ratio >= {threshold}::double)"""


def with_(names: str, select: str) -> str:
    return "with recursive " + ",\n".join(SQL[n] for n in names.split()) + "\n" + select


assert set(CONSTRUCT) <= set(BASES)
