"""Registry of the engine's own queries: name -> callable, name -> DuckDB SQL.

Array results are given as delimited strings, so values compare alike in both.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.similarity import candidate_pairs
from ..operators import browse, build, match, overrides, review, store, suggest, validate
from ..operators.classify import REASON_COMBINATION, REASON_NONE, REASON_TERM, classify
from ..sources import lexicon as src
from ..sources import sinks
from ..sources.lexicon import in_order
from . import lexica as lx
from .lexica import SQL, quoted, sql_marks, sql_near, sql_norm, sql_token, with_

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- text -------------------------------------------------------------------

HEBREW = ["במפקדה ללשכה והמודיעין", "רַע״נ רע''נ רע\"נ", "תת-אלוף", "לשכת אלוף", "8200", "של", "בסיס", "מבצע", "מרפאה", "תור למרפאה ובדיקת דם", "caf\u00e9 x", "cafe\u0301", "בדם", "ולמבצעים", "", "חמ\"ל־צפון", "  A_b/C  "]
FIXTURE = "fixture(id, text) as (values " + ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(HEBREW)) + ")"


def hebrew(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(HEBREW)), "id long, text string")


@query(with_("docs", "select id as doc_id, nx as normalized_text from docs"))
def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    return lx.documents(spark, d).select(F.col("id").alias("doc_id"), tx.normalize_text(F.coalesce("text", F.lit(""))).alias("normalized_text"))


@query(f"with {FIXTURE} select cast(id as bigint) as id, {sql_norm('text')} as normalized_text from fixture")
def normalize_hebrew_fixture(spark: SparkSession, d: str) -> DataFrame:
    return hebrew(spark).select("id", tx.normalize_text(F.col("text")).alias("normalized_text"))


@query(f"with {FIXTURE} select cast(id as bigint) as id, {sql_token('text', False)} as normalized_token, {sql_token('text')} as stripped_token from fixture")
def normalize_tokens_noprefix(spark: SparkSession, d: str) -> DataFrame:
    return hebrew(spark).select("id", tx.normalize_token(F.col("text"), False).alias("normalized_token"), tx.normalize_token(F.col("text")).alias("stripped_token"))


@query(f"select page_id, {sql_marks('url || chr(769) || html')} as stripped from pages")
def strip_marks_pages(spark: SparkSession, d: str) -> DataFrame:
    return lx.read(spark, d, "pages").select("page_id", tx.strip_marks(F.concat("url", F.lit("\u0301"), "html")).alias("stripped"))


@query(with_("docs place", "select d.id as doc_id, count(p.word) as n_tokens, count(distinct p.word) as n_distinct from docs d left join place p on d.id = p.id group by 1"))
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    w = tx.tokens(F.col("nx"))
    return lx.normalized(lx.documents(spark, d)).select(F.col("id").alias("doc_id"), F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query(r"select page_id, cast(len(t) as bigint) as n, array_to_string(t, '|') as tokens from (select page_id, regexp_extract_all(html, '[\x{0590}-\x{05ff}A-Za-z0-9]+') as t from pages)")
def raw_tokens_pages(spark: SparkSession, d: str) -> DataFrame:
    t = tx.raw_tokens(F.col("html"))
    return lx.read(spark, d, "pages").select("page_id", F.size(t).cast("long").alias("n"), F.array_join(t, "|").alias("tokens"))


# --- lexicon build ----------------------------------------------------------

TERM_COLS = "term, normalized_term, category, source, risk_level, action"
ALL_TERMS = "all_terms as (select * from words union all select * from phrases)"
FIRST = "qualify row_number() over (partition by normalized_term, action, source order by ord) = 1"


@query(with_("bw words phrases terms", f"select {TERM_COLS}, ord from terms"))
def lexicon_terms(spark: SparkSession, d: str) -> DataFrame:
    return lx.terms(spark, d).select(*TERM_COLS.split(", "), "ord")


APPROVED_TOKENS = f"""approved_tokens as (
  select term, term as normalized_term, 'approved_token' as category, 'approved_examples+approved_token' as source, 0 as risk_level, 'ALLOW' as action, min(ord * 16777216 + pos) as ord
  from (select ord, unnest(w) as term, unnest(range(0, len(w))) as pos from (select ord, string_split({sql_norm('resource_name')}, ' ') as w from approved where action = 'ALLOW'))
  where term <> '' group by term)"""


@query(with_("approved", f", {APPROVED_TOKENS} select {TERM_COLS}, ord from approved_tokens"))
def lexicon_approved_tokens(spark: SparkSession, d: str) -> DataFrame:
    return build.approved_tokens(lx.approved(spark, d)).select(*TERM_COLS.split(", "), (F.col("ord")[0] * 16777216 + F.col("ord")[1]).alias("ord"))


def sql_patterns(name: str, rows) -> str:
    return f"{name}(rule_ord, category, pattern) as (values " + ", ".join(f"({o}, {quoted(c)}, {quoted(p)})" for o, c, p in rows) + ")"


def sql_hits(name: str, source: str, patterns: str) -> str:
    return f"""{name} as (select normalized_term, arg_min(category, rule_ord) as hit from (select distinct t.normalized_term, p.rule_ord, p.category from {source} t join {patterns} p
  on t.normalized_term = p.pattern or (length(p.pattern) > 3 and starts_with(t.normalized_term, p.pattern))) group by 1)"""


BLACK_SQL, GREY_SQL = sql_patterns("bp", lx.BLACK_PATTERNS), sql_patterns("gp", lx.GREY_PATTERNS)


@query(f"with {FIXTURE} select cast(id as bigint) as id, array_to_string([x for x in [{sql_token('w', False)} for w in regexp_split_to_array(text, '[ \\t\\n\\f\\r\\x0b]+')] if x <> ''], ' ') as pattern from fixture")
def normalize_pattern_fixture(spark: SparkSession, d: str) -> DataFrame:
    return hebrew(spark).select("id", tx.normalize_pattern(F.col("text")).alias("pattern"))


RATIO_WORDS = "rw as (select distinct unnest(string_split(p_name, ' ')) as word from part), rt as (select distinct unnest(string_split(lower(p_type), ' ')) as word from part)"


@query(f"with recursive {RATIO_WORDS}, {sql_near('near', 'select word as text from rw', 'select word as target from rt', 0.3)} select text, target, round(ratio, 9) as ratio, ratio >= 0.82::double as similar from near")
def similarity_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The ratio and the token predicate over the words of two small vocabularies."""
    from ..functions.similarity import ratio, similar_pairs

    part = lx.read(spark, d, "part")
    one = part.select(F.explode(F.split("p_name", " ")).alias("text")).distinct()
    two = part.select(F.explode(F.split(F.lower("p_type"), " ")).alias("target")).distinct()
    near = similar_pairs(one, two, 0.3).withColumn("r", ratio("text", "target"))
    return near.select("text", "target", F.round("r", 9).alias("ratio"), (F.col("r") >= match.TOKEN_RATIO).alias("similar"))


@query(with_("docs place", "").rstrip() + f", {BLACK_SQL}, t as (select distinct word as normalized_term from place), {sql_hits('h', 't', 'bp')} select normalized_term, hit as category from h")
def pattern_category(spark: SparkSession, d: str) -> DataFrame:
    words = match.doc_words(lx.normalized(lx.documents(spark, d))).select(F.col("word").alias("normalized_term")).distinct()
    return build.pattern_hits(words, lx.patterns(spark))


SAFE_SQL = "safe(normalized_term) as (values " + ", ".join(f"({quoted(w)})" for w in lx.SAFE) + ")"
TAGGED_SQL = f"""{BLACK_SQL}, {GREY_SQL}, {SAFE_SQL}, {sql_hits('bh', 'external', 'bp')}, {sql_hits('gh', 'external', 'gp')},
last as (select * from terms qualify row_number() over (partition by normalized_term order by ord desc) = 1),
tagged as (select e.term, e.normalized_term,
  case when l.term is not null then l.category when s.normalized_term is not null then 'approved_label' when b.hit is not null then b.hit when g.hit is not null then g.hit else 'general_whitelist' end as category,
  case when l.term is not null then l.source when s.normalized_term is not null then 'ext+approved_label' when b.hit is not null then 'ext+heuristic_blacklist' when g.hit is not null then 'ext+heuristic_greylist' else 'ext+default_whitelist' end as source,
  cast(case when l.term is not null then l.risk_level when s.normalized_term is not null then 0 when b.hit is not null then 90 when g.hit is not null then 64 else 0 end as integer) as risk_level,
  case when l.term is not null then l.action when s.normalized_term is not null then 'ALLOW' when b.hit is not null then 'BLOCK' when g.hit is not null then 'MANUAL_REVIEW' else 'ALLOW' end as action
  from external e left join last l using (normalized_term) left join safe s using (normalized_term) left join bh b using (normalized_term) left join gh g using (normalized_term))"""


@query(with_("bw words phrases terms external", "").rstrip() + f", {TAGGED_SQL} select {TERM_COLS} from tagged")
def external_tagging(spark: SparkSession, d: str) -> DataFrame:
    found = build.tag_external(lx.external(spark, d), lx.terms(spark, d), lx.safe(spark), lx.patterns(spark), lx.patterns(spark, lx.GREY_PATTERNS))
    return found.select(*TERM_COLS.split(", "))


def _twice(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon twice, later copies renamed: the first of each key must win."""
    rows = lx.terms(spark, d)
    again = rows.withColumn("term", F.concat("term", F.lit("!"))).withColumn("ord", F.col("ord") + (1 << 40))
    return rows.unionByName(again)


@query(with_("bw words phrases terms", f", twice as (select {TERM_COLS}, ord from terms union all select term || '!', normalized_term, category, source, risk_level, action, ord + 1099511627776 from terms) select {TERM_COLS} from twice {FIRST}"))
def lexicon_dedup(spark: SparkSession, d: str) -> DataFrame:
    return build.deduplicate(_twice(spark, d)).select(*TERM_COLS.split(", "))


SPLIT_ROWS = f"rows_ as (select {TERM_COLS} from terms union all select {TERM_COLS} from tagged)"
SPLIT = "select 'black' as list, * from rows_ where action = 'BLOCK' union all select 'white', * from rows_ w where action = 'ALLOW' and not exists (select 1 from rows_ b where b.action = 'BLOCK' and b.normalized_term = w.normalized_term)"


@query(with_("bw words phrases terms external", "").rstrip() + f", {TAGGED_SQL}, {SPLIT_ROWS} {SPLIT}")
def black_white_split(spark: SparkSession, d: str) -> DataFrame:
    tagged = build.tag_external(lx.external(spark, d), lx.terms(spark, d), lx.safe(spark), lx.patterns(spark), lx.patterns(spark, lx.GREY_PATTERNS))
    cols = TERM_COLS.split(", ")
    black, white = build.split_black_white(lx.terms(spark, d).select(*cols).unionByName(tagged.select(*cols)))
    return black.select(F.lit("black").alias("list"), "*").unionByName(white.select(F.lit("white").alias("list"), "*"))


def _lexicon(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # a build reads both vocabularies several times
    terms, external = lx.terms(spark, d).persist(), lx.external(spark, d).persist()
    return build.build_lexicon(terms.drop("tid"), lx.approved(spark, d), external, lx.safe(spark), lx.patterns(spark), lx.patterns(spark, lx.GREY_PATTERNS))


BUILD_SQL = (
    with_("bw words phrases terms external approved", "").rstrip()
    + f""", {APPROVED_TOKENS}, {TAGGED_SQL.replace("last as (select * from terms", f"curated as (select {TERM_COLS}, 0 as f, ord from terms union all select {TERM_COLS}, 1, ord from approved_tokens), last as (select * from curated").replace("order by ord desc", "order by f desc, ord desc")},
every as (select {TERM_COLS}, f, ord from curated union all select {TERM_COLS}, 2, 0 from tagged),
rows_ as (select {TERM_COLS}, f * 72057594037927936 + ord as ord from every qualify row_number() over (partition by normalized_term, action, source order by f, ord) = 1),
built as (select 'black' as list, * from rows_ where action = 'BLOCK' union all select 'white', * from rows_ w where action = 'ALLOW' and not exists (select 1 from rows_ b where b.action = 'BLOCK' and b.normalized_term = w.normalized_term))"""
)


@query(f"{BUILD_SQL} select list, {TERM_COLS} from built")
def lexicon_build(spark: SparkSession, d: str) -> DataFrame:
    black, white = _lexicon(spark, d)
    cols = TERM_COLS.split(", ")
    return black.select(F.lit("black").alias("list"), *cols).unionByName(white.select(F.lit("white").alias("list"), *cols))


@query(f"{BUILD_SQL} select list, term, source, row_number() over (partition by list order by f, o) as place from (select *, ord // 72057594037927936 as f, ord % 72057594037927936 as o from built) where f < 2")
def lexicon_order(spark: SparkSession, d: str) -> DataFrame:
    """Curated rows of both lists in the order of their sources: seeds, then approved tokens."""
    from pyspark.sql import Window

    black, white = _lexicon(spark, d)
    rows = black.withColumn("list", F.lit("black")).unionByName(white.withColumn("list", F.lit("white"))).where(F.col("ord")[0] == 0)
    return rows.select("list", "term", "source", F.row_number().over(Window.partitionBy("list").orderBy("ord")).alias("place"))


@query(f"{BUILD_SQL} select count(*) as shared from (select normalized_term from built where list = 'black' intersect select normalized_term from built where list = 'white')")
def lists_disjoint(spark: SparkSession, d: str) -> DataFrame:
    black, white = _lexicon(spark, d)
    return black.select("normalized_term").intersect(white.select("normalized_term")).agg(F.count("*").alias("shared"))


@query(
    f"""with seeded as (select distinct p_brand || ' ' || split_part(p_type, ' ', 1) as phrase, p_size as risk_level, min(p_partkey) as ord from part where p_size % 10 = 1 group by 1, 2),
fixed as (select phrase as combination, {sql_norm('phrase')} as normalized_combination, 'seed_combinations' as source, risk_level, ord from seeded),
made as (select p_brand || ' ' || split_part(p_type, ' ', i) as combination, {sql_norm("p_brand || ' ' || split_part(p_type, ' ', i)")} as normalized_combination, 'generated_combinations' as source, p_size + 60 as risk_level, p_partkey * 16777216 + i - 1 as ord
  from (select *, unnest(range(1, len(string_split(p_type, ' ')) + 1)) as i from part)),
new_ as (select * from made qualify row_number() over (partition by normalized_combination order by ord) = 1)
select combination, normalized_combination, source, cast(risk_level as integer) as risk_level, case when risk_level >= 90 then 'BLOCK' else 'MANUAL_REVIEW' end as action from fixed
union all select combination, normalized_combination, source, cast(risk_level as integer), case when risk_level >= 90 then 'BLOCK' else 'MANUAL_REVIEW' end from new_ where normalized_combination not in (select normalized_combination from fixed)"""
)
def combination_generation(spark: SparkSession, d: str) -> DataFrame:
    part = lx.read(spark, d, "part")
    seeded = part.where("p_size % 10 = 1").groupBy(F.concat_ws(" ", "p_brand", F.substring_index("p_type", " ", 1)).alias("phrase"), F.col("p_size").alias("risk_level")).agg(F.min("p_partkey").alias("ord"))
    seeded = seeded.withColumns({"risk": F.lit("High"), "notes": F.lit("")})
    anchors = part.select(F.col("p_brand").alias("anchor"), F.split("p_type", " ").alias("targets"), F.lit("High").alias("risk"), (F.col("p_size") + 60).alias("risk_level"), F.lit("").alias("notes"), F.col("p_partkey").alias("ord"))
    return build.combinations(seeded, anchors).select("combination", "normalized_combination", "source", "risk_level", "action")


# --- matching and classification --------------------------------------------

TERM_CTES = "docs bw words phrases rules terms place"
EXACT = "exact_ as (select distinct p.id, w.tid from place p join words w on p.word = w.normalized_term)"
SUBSTRING = "substring_ as (select d.id, p.tid from docs d join phrases p on contains(d.nx, p.normalized_term))"
COMBO_SUB = "combo_sub as (select d.id, r.tid from docs d join rules r on contains(d.nx, r.normalized_term))"
COMBO_WIN = """combo_win as (select distinct a.id, r.tid from rules r join place a on a.word = split_part(r.normalized_term, ' ', 1)
  join place b on b.id = a.id and b.word = split_part(r.normalized_term, ' ', 2) and b.pos > a.pos and b.pos <= a.pos + 4)"""


@query(with_("docs bw words place", f", {EXACT} select id as doc_id, tid from exact_"))
def term_match_exact(spark: SparkSession, d: str) -> DataFrame:
    return match.exact_words(lx.normalized(lx.documents(spark, d)), lx.words(spark, d)).select(F.col("id").alias("doc_id"), "tid")


@query(with_("docs bw phrases", f", {SUBSTRING} select id as doc_id, tid from substring_"))
def term_match_substring(spark: SparkSession, d: str) -> DataFrame:
    phrases = lx.phrases(spark, d).select("tid", F.col("normalized_term").alias("phrase"))
    return match.containing(lx.normalized(lx.documents(spark, d)), phrases).select(F.col("id").alias("doc_id"), "tid")


FUZZY_WORDS = f"""{SAFE_SQL}, {sql_near('fw', "select word as text from place where word not in (select normalized_term from safe)", "select normalized_term as target from words where action <> 'ALLOW'", match.TERM_RATIO)},
fuzzy_words as (select distinct p.id, w.tid from place p join fw on p.word = fw.text join words w on w.normalized_term = fw.target where w.action <> 'ALLOW')"""


def sql_fuzzy_grams(place: str, phrases: str = "phrases", n: int = 2) -> str:
    """``fuzzy_grams``(id, tid): runs of n words that resemble a risk phrase."""
    joins = " ".join(f"join {place} p{k} on p{k}.id = p0.id and p{k}.pos = p0.pos + {k}" for k in range(1, n))
    text = " || ' ' || ".join(f"p{k}.word" for k in range(n))
    near = sql_near("fg", "select text from gram", f"select normalized_term as target from {phrases} where action <> 'ALLOW'", match.TERM_RATIO)
    return f"""gram as materialized (select distinct p0.id, {text} as text from {place} p0 {joins}), {near},
fuzzy_grams as (select distinct g.id, p.tid from gram g join fg using (text) join {phrases} p on p.normalized_term = fg.target where p.action <> 'ALLOW')"""


def sql_fuzzy_window(place: str) -> str:
    """``fuzzy_window``(id, tid): two-word rules met by similar words up to four apart."""
    near = sql_near("fr", f"select word as text from {place}", "select unnest(string_split(normalized_term, ' ')) as target from rules", match.TOKEN_RATIO)
    return f"""{near}, like_ as materialized (select p.id, p.pos, fr.target from {place} p join fr on p.word = fr.text),
fuzzy_window as (select distinct a.id, r.tid from rules r join like_ a on a.target = split_part(r.normalized_term, ' ', 1)
  join like_ b on b.id = a.id and b.target = split_part(r.normalized_term, ' ', 2) and b.pos > a.pos and b.pos <= a.pos + 4)"""


@query(with_("docs bw words place", f", {FUZZY_WORDS} select id as doc_id, tid from fuzzy_words"))
def term_match_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return match.fuzzy_words(lx.normalized(lx.documents(spark, d)), lx.words(spark, d), lx.safe(spark)).select(F.col("id").alias("doc_id"), "tid")


@query(with_("docs bw phrases place", f", {sql_fuzzy_grams('place')} select id as doc_id, tid from fuzzy_grams"))
def ngram_match_fuzzy_documents(spark: SparkSession, d: str) -> DataFrame:
    return match.fuzzy_grams(lx.normalized(lx.documents(spark, d)), lx.phrases(spark, d)).select(F.col("id").alias("doc_id"), "tid")


@query(with_("docs bw phrases3 place", f", {sql_fuzzy_grams('place', 'phrases3', 3)} select id as doc_id, tid from fuzzy_grams"))
def ngram_match_fuzzy_three(spark: SparkSession, d: str) -> DataFrame:
    return match.fuzzy_grams(lx.normalized(lx.documents(spark, d)), lx.phrases3(spark, d)).select(F.col("id").alias("doc_id"), "tid")


@query(with_("msgs bw phrases mplace", f", {sql_fuzzy_grams('mplace')} select id, tid from fuzzy_grams"))
def ngram_match_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return match.fuzzy_grams(lx.normalized(lx.messages(spark, d)), lx.phrases(spark, d)).select("id", "tid")


@query(
    with_(
        "msgs bw words",
        """, v as (select distinct word from (select unnest(string_split(nx, ' ')) as word from msgs) where word <> '' and regexp_full_match(word, '[ -~]+')), t as (select distinct normalized_term as target from words where regexp_full_match(normalized_term, '[ -~]+'))
select word as text, target from v join t on 2 * least(length(word), length(target)) >= 0.86 * (length(word) + length(target)) - 1e-9 and levenshtein(word, target) <= floor((1 - 0.86) * (length(word) + length(target)) + 1e-9)""",
    )
)
def fuzzy_candidates(spark: SparkSession, d: str) -> DataFrame:
    ascii_ = "^[ -~]+$"
    vocabulary = match.doc_words(lx.normalized(lx.messages(spark, d))).select(F.col("word").alias("text")).distinct().where(F.col("text").rlike(ascii_))
    return candidate_pairs(vocabulary, lx.words(spark, d).select(F.col("normalized_term").alias("target")).distinct().where(F.col("target").rlike(ascii_)), match.TERM_RATIO)


@query(with_("docs bw rules", f", {COMBO_SUB} select id as doc_id, tid from combo_sub"))
def combination_substring(spark: SparkSession, d: str) -> DataFrame:
    rules = lx.rules(spark, d).select("tid", F.col("normalized_phrase").alias("phrase"))
    return match.containing(lx.normalized(lx.documents(spark, d)), rules).select(F.col("id").alias("doc_id"), "tid")


@query(with_("docs bw rules place", f", {COMBO_WIN} select id as doc_id, tid from combo_win"))
def combination_window_exact(spark: SparkSession, d: str) -> DataFrame:
    return match.ordered_windows(lx.normalized(lx.documents(spark, d)), lx.rules(spark, d), None).select(F.col("id").alias("doc_id"), "tid")


@query(with_("docs bw phrases3", ", s as (select d.id, p.tid from docs d join phrases3 p on contains(d.nx, p.normalized_term)) select id as doc_id, tid from s"))
def term_match_substring_three(spark: SparkSession, d: str) -> DataFrame:
    phrases = lx.phrases3(spark, d).select("tid", F.col("normalized_term").alias("phrase"))
    return match.containing(lx.normalized(lx.documents(spark, d)), phrases).select(F.col("id").alias("doc_id"), "tid")


def sql_walk(like: str, rules: str = "rules3") -> str:
    """``walk``(id, tid): three-word rules, every next word the nearest within four of the one before, from every start."""
    part = lambda k: f"split_part(r.normalized_term, ' ', {k})"
    return f"""step1 as (select r.tid, r.normalized_term, a.id, a.pos from {rules} r join {like} a on a.target = {part(1)}),
step2 as (select r.tid, r.normalized_term, r.id, r.pos as start, min(b.pos) as pos from step1 r join {like} b on b.id = r.id and b.target = {part(2)} and b.pos > r.pos and b.pos <= r.pos + 4 group by all),
walk as (select distinct r.tid, r.id from step2 r join {like} c on c.id = r.id and c.target = {part(3)} and c.pos > r.pos and c.pos <= r.pos + 4)"""


@query(with_("docs bw rules3 place", f", like_ as (select id, pos, word as target from place), {sql_walk('like_')} select id as doc_id, tid from walk"))
def combination_window_three(spark: SparkSession, d: str) -> DataFrame:
    return match.ordered_windows(lx.normalized(lx.documents(spark, d)), lx.rules3(spark, d), None).select(F.col("id").alias("doc_id"), "tid")


NEAR_THREE = sql_near("fr", "select word as text from place", "select unnest(string_split(normalized_term, ' ')) as target from rules3", match.TOKEN_RATIO)


@query(with_("docs bw rules3 place", f", {NEAR_THREE}, like_ as materialized (select p.id, p.pos, fr.target from place p join fr on p.word = fr.text), {sql_walk('like_')} select id as doc_id, tid from walk"))
def combination_window_fuzzy_three(spark: SparkSession, d: str) -> DataFrame:
    return match.ordered_windows(lx.normalized(lx.documents(spark, d)), lx.rules3(spark, d)).select(F.col("id").alias("doc_id"), "tid")


@query(with_("docs bw rules place", f", {sql_fuzzy_window('place')} select id as doc_id, tid from fuzzy_window"))
def combination_window_fuzzy_documents(spark: SparkSession, d: str) -> DataFrame:
    return match.ordered_windows(lx.normalized(lx.documents(spark, d)), lx.rules(spark, d)).select(F.col("id").alias("doc_id"), "tid")


@query(with_("msgs bw rules mplace", f", {sql_fuzzy_window('mplace')} select id, tid from fuzzy_window"))
def combination_window_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return match.ordered_windows(lx.normalized(lx.messages(spark, d)), lx.rules(spark, d)).select("id", "tid")


EXACT_MATCHES = (f"{EXACT}, {SUBSTRING}, {COMBO_SUB}, {COMBO_WIN}", "select * from exact_ union select * from substring_", "select * from combo_sub union select * from combo_win")
FULL_MATCHES = (
    f"{EXACT}, {SUBSTRING}, {COMBO_SUB}, {FUZZY_WORDS}, {sql_fuzzy_grams('place')}, {sql_fuzzy_window('place')}",
    "select * from exact_ union select * from substring_ union select * from fuzzy_words union select * from fuzzy_grams", "select * from combo_sub union select * from fuzzy_window",
)


def sql_classified(found: tuple[str, str, str]) -> str:
    ctes, terms, combinations = found
    return f"""{ctes},
hit as (select m.id, t.term, t.risk_level, t.action from ({terms}) m join terms t using (tid)),
bt as (select id, max(risk_level) filter (action <> 'ALLOW') as risk, max(risk_level) filter (action = 'ALLOW') as white, bool_or(action = 'BLOCK') as block, string_agg(distinct term, '|' order by term) as matched_terms from hit group by id),
bc as (select id, max(r.risk_level) as rule, string_agg(distinct r.term, '|' order by r.term) as matched_combination from ({combinations}) m join rules r using (tid) group by id),
classified as (select d.id as doc_id, cast(coalesce(greatest(risk, rule), white, 0) as integer) as risk_score, case when risk is not null or rule is not null then 'BLOCK' else 'ALLOW' end as action,
  coalesce(matched_terms, '') as matched_terms, coalesce(matched_combination, '') as matched_combination,
  case when coalesce(block, false) and rule is not null then '{REASON_TERM}; {REASON_COMBINATION}' when block then '{REASON_TERM}' when rule is not null then '{REASON_COMBINATION}' else '{REASON_NONE}' end as reason
  from docs d left join bt using (id) left join bc using (id))"""


CLASSIFIED = sql_classified(EXACT_MATCHES)


def _classified(spark: SparkSession, d: str, fuzzy: bool) -> DataFrame:
    terms, rules = lx.terms(spark, d).persist(), lx.rules(spark, d).persist()  # the lexicon is read by every kind of match
    return classify(lx.documents(spark, d), terms, rules, lx.safe(spark), fuzzy, DataFrame.persist)


def _flat(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "risk_score", "action", F.array_join("matched_terms", "|").alias("matched_terms"), F.array_join("matched_combination", "|").alias("matched_combination"), "reason")


@query(with_(TERM_CTES, f", {CLASSIFIED} select * from classified"))
def classify_exact(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_classified(spark, d, False))


@query(with_(TERM_CTES, f", {sql_classified(FULL_MATCHES)} select * from classified"))
def classify_full(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_classified(spark, d, True))


@query(with_(TERM_CTES, f", {CLASSIFIED} select doc_id, risk_score, action, d.text as input_text from classified join docs d on d.id = doc_id where action <> 'ALLOW'"))
def audit_events(spark: SparkSession, d: str) -> DataFrame:
    docs = lx.documents(spark, d)
    lines = sinks.audit_lines(_classified(spark, d, False).join(docs, "id").withColumn("normalized_text", F.col("id").cast("string")), at=F.lit("2024-01-01").cast("timestamp"))
    j = F.from_json("value", "input_text string, result struct<risk_score:int,action:string,normalized_text:string>")
    return lines.select(j.alias("j")).select(F.col("j.result.normalized_text").cast("long").alias("doc_id"), "j.result.risk_score", "j.result.action", "j.input_text")


# --- validation -------------------------------------------------------------

SEGMENTS = f"""raw_ as (select id, regexp_extract_all(text, '[\\x{{0590}}-\\x{{05ff}}A-Za-z0-9]+') as t from msgs),
seg as (select id, unnest(range(0, len(t))) as pos, unnest(t) as value from raw_),
vals as (select distinct value, {sql_norm('value')} as n from seg),
bl as (select normalized_term as n, arg_max(term, ord) as term from terms where action <> 'ALLOW' group by 1), wl as (select distinct normalized_term as n from terms where action = 'ALLOW'),
known as (select value, case when bl.n is not null then 'BLOCK' when wl.n is not null then 'ALLOW' else 'UNKNOWN' end as status,
  case when bl.n is not null then 'Blocked term: ' || bl.term when wl.n is not null then 'Approved term' else 'Unknown term' end as reason from vals left join bl using (n) left join wl using (n)),
segments as (select id, pos, value, status, reason from seg join known using (value))"""


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = lx.terms(spark, d)
    return rows.where("action <> 'ALLOW'"), rows.where("action = 'ALLOW'")


@query(with_("msgs bw words phrases terms", f", {SEGMENTS} select id, cast(pos as integer) as pos, value, status, reason from segments"))
def validate_segments(spark: SparkSession, d: str) -> DataFrame:
    return validate.segments(lx.messages(spark, d), *_lists(spark, d))


def sql_validated(window: str, combinations: str) -> str:
    return with_(
        "msgs bw words phrases rules terms mplace",
        f""", {SEGMENTS}, {window},
s as (select id, string_agg(value || ':' || status, '|' order by pos) as segments, bool_or(status = 'BLOCK') as block, bool_or(status = 'UNKNOWN') as unknown, string_agg(distinct value, '|' order by value) filter (status <> 'UNKNOWN') as matched_terms from segments group by id),
c as (select id, string_agg(distinct r.term, '|' order by r.term) as matched_combinations from ({combinations}) m join rules r using (tid) group by id)
select m.id, nx as normalized_text, case when coalesce(block, false) or matched_combinations is not null then 'BLOCK' when unknown then 'UNKNOWN' else 'ALLOW' end as overall_status,
  coalesce(segments, '') as segments, coalesce(matched_terms, '') as matched_terms, coalesce(matched_combinations, '') as matched_combinations from msgs m left join s using (id) left join c using (id)""",
    )


MSG_SUB, MSG_WIN = COMBO_SUB.replace("docs d", "msgs d"), COMBO_WIN.replace("place a", "mplace a").replace("place b", "mplace b")


def _validated(spark: SparkSession, d: str, threshold: float | None) -> DataFrame:
    found = validate.validate_detailed(lx.messages(spark, d), *_lists(spark, d), lx.rules(spark, d), threshold)
    seg = F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["value"], s["status"])), "|")
    return found.select("id", "normalized_text", "overall_status", seg.alias("segments"), F.array_join("matched_terms", "|").alias("matched_terms"), F.array_join("matched_combinations", "|").alias("matched_combinations"))


@query(sql_validated(f"{MSG_SUB}, {MSG_WIN}", "select * from combo_sub union select * from combo_win"))
def validate_detailed(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d, None)


@query(sql_validated(f"{MSG_SUB}, {sql_fuzzy_window('mplace')}", "select * from combo_sub union select * from fuzzy_window"))
def validate_detailed_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d, match.TOKEN_RATIO)


# --- suggestions ------------------------------------------------------------

LISTED = f"""listed as (select display_term, normalized_term, source_type, f, ord from (
  select resource_name as display_term, {sql_norm('resource_name')} as normalized_term, 'approved_example' as source_type, 0 as f, ord from approved where action = 'ALLOW'
  union all select term, {sql_norm('term')}, 'whitelist', 1, ord from terms where action = 'ALLOW')
  where normalized_term <> '' and normalized_term not in (select normalized_term from terms where action = 'BLOCK') qualify row_number() over (partition by normalized_term, source_type order by f, ord) = 1)"""
INDEXED = """posted as (select l.*, substr(c, 1, n) as prefix from (select l.*, unnest(list_distinct(list_concat([normalized_term], string_split(normalized_term, ' ')))) as c from listed l) l, unnest(range(2, least(length(c), 24) + 1)) as u(n)),
firsts as (select prefix, normalized_term, arg_min(display_term, f * 1000000000000 + ord) as display_term, arg_min(source_type, f * 1000000000000 + ord) as source_type, min(f * 1000000000000 + ord) as o from posted group by 1, 2),
index_ as (select prefix, cast(row_number() over (partition by prefix order by o) as integer) as rk, display_term, normalized_term, source_type from firsts qualify row_number() over (partition by prefix order by o) <= 200)"""
SUGGEST_CTES = "bw words phrases terms approved"


def _suggestions(spark: SparkSession, d: str) -> DataFrame:
    rows = lx.terms(spark, d)
    return suggest.suggestions(lx.approved(spark, d), rows.where("action = 'ALLOW'"), rows.where("action = 'BLOCK'"))


@query(with_(SUGGEST_CTES, f", {LISTED} select display_term, normalized_term, source_type from listed"))
def suggestion_list(spark: SparkSession, d: str) -> DataFrame:
    return _suggestions(spark, d).select("display_term", "normalized_term", "source_type")


@query(with_(SUGGEST_CTES, f", {LISTED} select display_term, source_type, row_number() over (order by f, ord) as place from listed"))
def suggestion_order(spark: SparkSession, d: str) -> DataFrame:
    """The suggestion list in order: nested unions keep it."""
    from pyspark.sql import Window

    return _suggestions(spark, d).select("display_term", "source_type", F.row_number().over(Window.orderBy("ord")).alias("place"))


@query(with_(SUGGEST_CTES, f", {LISTED}, {INDEXED} select * from index_"))
def suggestion_prefix_index(spark: SparkSession, d: str) -> DataFrame:
    return suggest.prefix_index(_suggestions(spark, d))


@query(with_(SUGGEST_CTES, f", {LISTED}, {INDEXED} select rk, display_term, normalized_term, source_type from index_ where prefix = 'th' order by rk limit 12"))
def suggest_topk(spark: SparkSession, d: str) -> DataFrame:
    return suggest.suggest(suggest.prefix_index(_suggestions(spark, d)), "Th")


LONG_QUERY = "thinanthereaingthouonandnd"


@query(
    with_(
        SUGGEST_CTES,
        f", {LISTED}, longest as (select normalized_term as q from listed where length(normalized_term) > 0 order by length(normalized_term) desc, normalized_term limit 1), {INDEXED} select rk, display_term, normalized_term, source_type from index_, longest where prefix = substr(q, 1, 24) and (length(q) <= 24 or contains(' ' || normalized_term, ' ' || q)) order by rk limit 12",
    )
)
def suggest_long_query(spark: SparkSession, d: str) -> DataFrame:
    listed = _suggestions(spark, d)
    q = listed.orderBy(F.desc(F.length("normalized_term")), "normalized_term").select("normalized_term").first()
    return suggest.suggest(suggest.prefix_index(listed), q[0] if q else LONG_QUERY)


# --- browsing ---------------------------------------------------------------

LETTER = "case when regexp_matches(normalized_term, '^[a-zA-Z]') then upper(normalized_term[1]) when regexp_matches(normalized_term, '^[0-9]') then normalized_term[1] else " + quoted(tx.OTHER) + " end"
SHAPE_SQL = "term, normalized_term, category, cast(risk_level as varchar) as risk_level, action, '' as notes"


def _shape(spark: SparkSession, d: str) -> DataFrame:
    return browse.shaped(lx.terms(spark, d).where("action = 'BLOCK'"), "blacklist")


@query(with_("bw words phrases terms", f"select {SHAPE_SQL} from terms where action = 'BLOCK' order by normalized_term, ord limit 100 offset 100"))
def browse_page(spark: SparkSession, d: str) -> DataFrame:
    return browse.page_of(_shape(spark, d), page=2)


@query(with_("bw words phrases terms", f", dom(pos, letter) as (values {', '.join(f'({i}, {quoted(b)})' for i, b in enumerate(tx.buckets()))}) select cast(pos as integer) as pos, letter, count(t.b) as count from dom left join (select {LETTER} as b from terms where action = 'BLOCK') t on t.b = letter group by 1, 2"))
def browse_letter_counts(spark: SparkSession, d: str) -> DataFrame:
    return browse.letters(_shape(spark, d))


@query(with_("bw words phrases terms", f"select {SHAPE_SQL} from terms where action = 'BLOCK' and {LETTER} = 'T' and contains(normalized_term, 'er') order by normalized_term, ord limit 100"))
def browse_filtered(spark: SparkSession, d: str) -> DataFrame:
    return browse.page_of(_shape(spark, d), query="Er", letter="t")


@query(with_("bw words phrases terms", f"select 'blacklist' as list, count(*) as total, least(count(*), 100) as items from terms where action = 'BLOCK' and {LETTER} = 'T' and contains(normalized_term, 'er')"))
def browse_total(spark: SparkSession, d: str) -> DataFrame:
    answer = browse.browse(lx.terms(spark, d).where("action = 'BLOCK'"), "blacklist", query="er", letter="T")
    return spark.createDataFrame([(answer["list"], answer["total"], len(answer["items"]))], "list string, total long, items long")


# --- review, overrides, exports ---------------------------------------------

POLICY = review.Policy(approved_terms=["there"], false_positives=["therea", "inge"])
REVIEW_CASE = """case when list = 'black' and (contains(source, 'seed_blacklist') or contains(source, 'heuristic_blacklist') or contains(source, 'seed_promoted_blacklist')) then 'high|reviewed_black_explicit'
  when list = 'black' and hit is not null then 'medium|reviewed_black_pattern' when list = 'black' then 'medium|reviewed_black_other'
  when term in ('there') then 'high|reviewed_white_user_override' when contains(source, 'approved_token') then 'high|reviewed_white_approved_resource_token' when contains(source, 'seed_whitelist') then 'high|reviewed_white_curated'
  when hit is not null and not fam then 'low|needs_second_pass_sensitive_pattern_in_white' when fam then 'medium|reviewed_white_false_positive_family' when contains(source, 'default_whitelist') then 'medium|reviewed_white_general_lexicon'
  else 'low|needs_second_pass_unknown_source' end"""


@query(f"{BUILD_SQL}, {sql_hits('rh', 'built', 'bp')}, x as (select b.*, hit, contains(normalized_term, 'therea') or contains(normalized_term, 'inge') as fam from built b left join rh using (normalized_term)) select term, normalized_term, case list when 'black' then 'BLOCK' else 'ALLOW' end as decision, split_part({REVIEW_CASE}, '|', 1) as confidence, split_part({REVIEW_CASE}, '|', 2) as review_bucket, source from x")
def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    black, white = _lexicon(spark, d)
    return review.review(black, white, lx.patterns(spark), POLICY).drop("reason")


REQUESTS = f"""req as (select 'Term-' || (user_id % 97) as term, {sql_norm("'Term-' || (user_id % 97)")} as normalized_term, case when event_id % 2 = 0 then 'ALLOW' else 'BLOCK' end as action, ts as created_at from events),
latest as (select * from req qualify row_number() over (partition by normalized_term order by created_at desc, term desc, action desc) = 1)"""


@query(f"with {REQUESTS} select term, normalized_term, action, case action when 'ALLOW' then 'user_whitelist_override' else 'user_blacklist_override' end as category, cast(case action when 'ALLOW' then 0 else 95 end as integer) as risk_level, created_at from latest")
def overrides_latest(spark: SparkSession, d: str) -> DataFrame:
    return overrides.latest(overrides.override_rows(lx.requests(spark, d))).select("term", "normalized_term", "action", "category", "risk_level", "created_at")


@query(
    with_(
        "bw words phrases terms",
        f""", {REQUESTS}, o as (select w.term, w.normalized_term, r.action from (select term, normalized_term, row_number() over (order by ord, tid) as n from words) w join (select action, row_number() over (order by normalized_term) as n from latest) r using (n))
select 'black' as list, term, normalized_term, action from terms where action = 'BLOCK' and normalized_term not in (select normalized_term from o) union all select 'black', term, normalized_term, action from o where action = 'BLOCK'
union all select 'white', term, normalized_term, action from terms where action = 'ALLOW' and normalized_term not in (select normalized_term from o) union all select 'white', term, normalized_term, action from o where action = 'ALLOW'""",
    )
)
def overrides_applied(spark: SparkSession, d: str) -> DataFrame:
    """Overrides of lexicon words: the n-th user's last request hits the n-th word."""
    from pyspark.sql import Window

    asked = overrides.latest(overrides.override_rows(lx.requests(spark, d))).select("normalized_term", "action", "created_at")
    asked = asked.select("action", "created_at", F.row_number().over(Window.orderBy("normalized_term")).alias("n"))  # 97 rows
    words = lx.words(spark, d).select("term", "ord", "tid").orderBy("ord", "tid").limit(97)
    words = words.select("term", F.row_number().over(Window.orderBy("ord", "tid")).alias("n"))
    log = overrides.override_rows(words.join(asked, "n").select("term", "action", "created_at"))
    rows = lx.terms(spark, d)
    black, white = overrides.apply_overrides(rows.where("action = 'BLOCK'"), rows.where("action = 'ALLOW'"), log)
    cols = ["term", "normalized_term", "action"]
    return black.select(F.lit("black").alias("list"), *cols).unionByName(white.select(F.lit("white").alias("list"), *cols))


@query(
    with_(
        "bw words phrases terms",
        """, o as (select distinct w.term, w.normalized_term, case when w.tid % 2 = 0 then 'ALLOW' else 'BLOCK' end as action from words w)
select 'black' as list, term, normalized_term, action from terms where action = 'BLOCK' and normalized_term not in (select normalized_term from o) union all select 'black', term, normalized_term, action from o where action = 'BLOCK'
union all select 'white', term, normalized_term, action from terms where action = 'ALLOW' and normalized_term not in (select normalized_term from o) union all select 'white', term, normalized_term, action from o where action = 'ALLOW'""",
    )
)
def overrides_whole_list(spark: SparkSession, d: str) -> DataFrame:
    """A request about every word of the lexicon."""
    asked = lx.words(spark, d).select("term", F.when(F.col("tid") % 2 == 0, "ALLOW").otherwise("BLOCK").alias("action"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    rows = lx.terms(spark, d)
    black, white = overrides.apply_overrides(rows.where("action = 'BLOCK'"), rows.where("action = 'ALLOW'"), overrides.override_rows(asked))
    cols = ["term", "normalized_term", "action"]
    return black.select(F.lit("black").alias("list"), *cols).unionByName(white.select(F.lit("white").alias("list"), *cols))


@query(f"{BUILD_SQL} select distinct term from built where list = 'white' and term <> ''")
def words_export(spark: SparkSession, d: str) -> DataFrame:
    return sinks.words_only(_lexicon(spark, d)[1])


PARTS = f"{BUILD_SQL}, cut as (select term, cast((row_number() over (order by term) - 1) // 500 + 1 as integer) as part from (select distinct term from built where list = 'white' and term <> ''))"


@query(f"{PARTS} select part, term from cut")
def parts_export(spark: SparkSession, d: str) -> DataFrame:
    return sinks.parts(_lexicon(spark, d)[1], 500)


@query(f"{PARTS} select printf('words_part_%03d.csv', part) as file, count(*) as rows from cut group by part")
def parts_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.manifest(sinks.parts(_lexicon(spark, d)[1], 500))


@query(with_("bw words phrases terms", "select term, f, rank from (select term, 0 as f, row_number() over (order by ord, tid) as rank from words union all select term, 1, row_number() over (order by ord, tid) from phrases)"))
def lists_union(spark: SparkSession, d: str) -> DataFrame:
    """Bag union of lists, order kept: each row's place within its list."""
    from pyspark.sql import Window

    both = in_order(lx.words(spark, d), lx.phrases(spark, d)).withColumn("f", F.col("ord")[0].cast("int"))
    return both.select("term", "f", F.row_number().over(Window.partitionBy("f").orderBy("ord", "tid")).alias("rank"))


# --- files: written, then read back -----------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share, removed when the driver ends; local only for a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/termloom-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def _term_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*src.TERM_FIELDS, "ord")


LIST_SQL = "term, normalized_term, category, source, risk_level, action, 0.9::double as confidence, '' as notes"


@query(with_("bw words phrases terms", f"select {LIST_SQL} from terms"))
def csv_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """A list written as CSV and scanned again: empty fields stay empty."""
    path = _folder(spark)
    sinks.write_csv(_term_rows(lx.terms(spark, d)), path, src.TERM_FIELDS)
    return src.read_csv(spark, path, src.TERM)


@query(with_("bw words phrases terms", f"select {LIST_SQL} from terms where action = 'BLOCK' and 1 = 0"))
def csv_missing_scan(spark: SparkSession, d: str) -> DataFrame:
    return src.read_csv_or_empty(spark, f"{_folder(spark)}/absent", src.TERM)


@query(with_("bw words phrases terms", "select term, action, case action when 'BLOCK' then 0 when 'MANUAL_REVIEW' then 1 else 2 end as f, row_number() over (partition by action order by term, ord) as place from terms"))
def csv_union_scan(spark: SparkSession, d: str) -> DataFrame:
    """Three lists, each sorted and written as one or more files, scanned in order: the place of each row within its list."""
    from pyspark.sql import Window

    path = _folder(spark)
    for action in ("BLOCK", "MANUAL_REVIEW", "ALLOW"):
        sinks.write_csv(lx.terms(spark, d).where(F.col("action") == action).orderBy("term", "ord").select(*src.TERM_FIELDS), f"{path}/{action}", src.TERM_FIELDS)
    rows = src.read_terms(spark, [f"{path}/{a}" for a in ("BLOCK", "MANUAL_REVIEW", "ALLOW")]).withColumn("f", F.col("ord")[0].cast("int"))
    return rows.select("term", "action", "f", F.row_number().over(Window.partitionBy("f").orderBy("ord")).alias("place"))


@query(with_("bw rules", "select term as phrase, normalized_term as normalized_phrase, 'High' as risk_label, risk_level as risk_score, '' as notes from rules"))
def csv_combination_scan(spark: SparkSession, d: str) -> DataFrame:
    """Combinations written as CSV, scanned, and loaded as typed rules."""
    path = _folder(spark)
    sinks.write_csv(_combination_rows(spark, d), path, src.COMBINATION_FIELDS)
    return src.rules(src.read_csv(spark, path, src.COMBINATION))


WORD_LINES = "select unnest(string_split(p_name || '\n  ' || p_brand || ' \n\n', '\n')) as line from part"


@query(f"select trim(line) as term, {sql_norm('trim(line)')} as normalized_term, 'general_lexicon' as category, 'external_word_list' as source, 0 as risk_level, 'ALLOW' as action, 0.45::double as confidence, '' as notes from ({WORD_LINES}) where trim(line) <> ''")
def word_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of words, some blank, some padded, as external rows."""
    path = _folder(spark)
    lx.read(spark, d, "part").select(F.concat("p_name", F.lit("\n  "), "p_brand", F.lit(" \n\n")).alias("value")).write.text(path)
    return src.read_words(spark, path).drop("ord")


@query(
    f"""{BUILD_SQL}, {SQL['rules']}, black as (select * from built where list = 'black'), white as (select * from built where list = 'white'),
files as (select 'all_terms' as file, count(*) as n from built union all select 'blacklist', count(*) from black union all select 'greylist', 0 union all select 'whitelist', count(*) from white
  union all select 'combinations', count(*) from rules union all select 'blacklist_words', count(distinct term) from black where term <> '' union all select 'whitelist_words', count(distinct term) from white where term <> ''
  union all select 'combination_words', count(distinct term) from rules where term <> '' union all select 'whitelist_parts/manifest', (count(distinct term) + 9999) // 10000 from white where term <> '')
select file, n from files"""
)
def build_export_files(spark: SparkSession, d: str) -> DataFrame:
    """Build, publish, and count the rows of every file of the version."""
    black, white = _lexicon(spark, d)
    path = _folder(spark)
    number = store.publish(black.select(*src.TERM_FIELDS), white.select(*src.TERM_FIELDS), _combination_rows(spark, d), path)
    files = ["all_terms", "blacklist", "greylist", "whitelist", "combinations", "blacklist_words", "whitelist_words", "combination_words", "whitelist_parts/manifest"]
    counts = [spark.read.option("header", True).csv(f"{path}/versions/{number}/{f}").select(F.lit(f).alias("file")) for f in files]
    each = counts[0]
    for one in counts[1:]:
        each = each.unionByName(one)
    domain = spark.createDataFrame([(f,) for f in files], "file string")
    return domain.join(each.groupBy("file").agg(F.count("*").alias("n")), "file", "left").select("file", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _combination_rows(spark: SparkSession, d: str) -> DataFrame:
    return lx.rules(spark, d).select(
        F.col("phrase").alias("combination"), F.col("normalized_phrase").alias("normalized_combination"), F.lit("c").alias("category"), F.lit("s").alias("source"),
        F.lit("High").alias("risk"), F.col("risk_score").alias("risk_level"), F.lit("BLOCK").alias("action"), F.lit(0.9).alias("confidence"), F.lit("").alias("notes"),
    )


def _published(spark: SparkSession, d: str) -> str:
    """The lexicon's terms as a published version; its folder."""
    path = _folder(spark)
    rows = _term_rows(lx.terms(spark, d)).drop("ord")
    built = store.ensure(spark, path, lambda: (rows.where("action = 'BLOCK'"), rows.where("action = 'ALLOW'"), _combination_rows(spark, d)))
    if not built or store.ensure(spark, path, lambda: (_ for _ in ()).throw(AssertionError("built twice"))):
        raise AssertionError("a folder is built once")
    return path


@query(with_("bw words phrases terms", f"select case action when 'BLOCK' then 'blacklist' else 'whitelist' end as list, {LIST_SQL} from terms where action in ('BLOCK', 'ALLOW')"))
def lists_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Lists built because none were there, then read from the version in force."""
    own = store.lists(spark, _published(spark, d))
    return own["blacklist"].select(F.lit("blacklist").alias("list"), *src.TERM_FIELDS).unionByName(own["whitelist"].select(F.lit("whitelist").alias("list"), *src.TERM_FIELDS))


@query(
    with_(
        "bw words phrases terms",
        f""", rh as (select normalized_term, arg_min(category, rule_ord) as hit from (select distinct t.normalized_term, p.rule_ord, p.category from terms t join bp p on t.normalized_term = p.pattern or (length(p.pattern) > 3 and starts_with(t.normalized_term, p.pattern))) group by 1),
x as (select t.*, case action when 'BLOCK' then 'black' else 'white' end as list, hit, contains(normalized_term, 'therea') or contains(normalized_term, 'inge') as fam from terms t left join rh using (normalized_term) where action in ('BLOCK', 'ALLOW'))
select term, normalized_term, action as decision, split_part({REVIEW_CASE}, '|', 1) as confidence, split_part({REVIEW_CASE}, '|', 2) as review_bucket, source from x""",
    ).replace("with recursive ", f"with recursive {BLACK_SQL}, ", 1)
)
def review_file(spark: SparkSession, d: str) -> DataFrame:
    """The review of a published version, written as a list and read back."""
    path = store.review_file(spark, _published(spark, d), lx.patterns(spark), POLICY)
    return src.read_csv(spark, path, src.REVIEW).drop("reason")


@query(
    with_(
        "bw words phrases terms",
        """, asked as (select term, normalized_term from words order by ord, tid limit 1)
select 'blacklist' as list, term, normalized_term, action, 2 as version from terms where action = 'BLOCK' and normalized_term not in (select normalized_term from asked)
union all select 'whitelist', term, normalized_term, action, 2 from terms where action = 'ALLOW' and normalized_term not in (select normalized_term from asked)
union all select 'whitelist', term, normalized_term, 'ALLOW', 2 from asked union all select 'history', term, normalized_term, 'ALLOW', 2 from asked""",
    )
)
def override_persisted(spark: SparkSession, d: str) -> DataFrame:
    """One override of a published version: the lists of the next version and the history."""
    path = _published(spark, d)
    word = lx.words(spark, d).orderBy("ord", "tid").first().term
    store.override(spark, path, word, "ALLOW")
    own, at = store.lists(spark, path), F.lit(store.current(spark, path)).alias("version")
    cols = ["term", "normalized_term", "action"]
    frames = [own[k].select(F.lit(k).alias("list"), *cols, at) for k in ("blacklist", "whitelist")]
    return frames[0].unionByName(frames[1]).unionByName(store.history(spark, path).select(F.lit("history").alias("list"), *cols, at))


@query(with_(SUGGEST_CTES, f", {LISTED.replace('from approved where', 'from approved where 1 = 0 and')}, {INDEXED} select 'before' as at, rk, display_term from index_ where prefix = 'th' and rk <= 12 union all select 'after', cast(row_number() over (order by rk) as integer), display_term from (select * from index_ where prefix = 'th' and normalized_term <> (select normalized_term from index_ where prefix = 'th' and rk = 1) order by rk limit 12)"))
def catalog_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions of a cached catalog before and after its first one is blocked."""
    path = _folder(spark)
    rows = lx.terms(spark, d)
    lists = [_term_rows(rows.where(F.col("action") == a)) for a in ("BLOCK", "ALLOW")]
    store.publish(*lists, _combination_rows(spark, d), path)
    catalog = store.Catalog(spark, path)
    before = catalog.suggest("th").select("rk", "display_term").collect()
    catalog.override(before[0].display_term, "BLOCK")
    after = catalog.suggest("th").select("rk", "display_term").collect()
    found = [("before", r.rk, r.display_term) for r in before] + [("after", r.rk, r.display_term) for r in after]
    return spark.createDataFrame(found, "at string, rk int, display_term string")


@query(with_(TERM_CTES, f", {CLASSIFIED} select d.text as input_text, action, risk_score from classified join docs d on d.id = doc_id where action <> 'ALLOW'"))
def audit_log_appended(spark: SparkSession, d: str) -> DataFrame:
    """The audit log appended to a folder, read back as lines."""
    path = _folder(spark)
    docs = lx.documents(spark, d).withColumn("h", F.xxhash64("text"))
    found = _classified(spark, d, False).join(docs, "id")
    sinks.append_audit(found, path)
    j = F.from_json("value", "input_text string, result struct<risk_score:int,action:string>")
    return spark.read.text(path).select(j.alias("j")).select("j.input_text", "j.result.action", "j.result.risk_score")
