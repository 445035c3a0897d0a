"""Browsable lists: filters, pages, letter histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import buckets, letter_bucket, normalize_text

# Names of lists and fields that callers see.
LISTS = ("blacklist", "whitelist", "combinations")
SHAPE = ["term", "normalized_term", "category", "risk_level", "action", "notes"]
# End of fixed values.


def shaped(rows: DataFrame, kind: str) -> DataFrame:
    """Term or combination rows in one shape, missing values empty, empty norms out."""
    if kind not in LISTS:
        raise KeyError(f"unknown list: {kind}")
    if kind == "combinations":
        rows = rows.withColumnsRenamed({"combination": "term", "normalized_combination": "normalized_term"})
    have = set(rows.columns)
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in SHAPE]
    return rows.where("coalesce(normalized_term, '') <> ''").select(*cols, "ord")


def filtered(rows: DataFrame, query: str = "", letter: str = "") -> DataFrame:
    if letter:
        wanted = next((b for b in (letter, letter.upper()) if b in buckets()), letter)
        rows = rows.where(letter_bucket(F.col("normalized_term")) == wanted)
    if query:
        # a token that starts with the query contains it, so one test does
        q = normalize_text(F.lit(query))
        rows = rows.where((q == "") | F.col("normalized_term").contains(q))
    return rows


def page_of(rows: DataFrame, query: str = "", letter: str = "", page: int = 1, page_size: int = 100) -> DataFrame:
    if page < 1 or not 1 <= page_size <= 500:
        raise ValueError("page starts at 1, page_size lies between 1 and 500")
    return filtered(rows, query, letter).orderBy("normalized_term", "ord").offset((page - 1) * page_size).limit(page_size).select(*SHAPE)


def letters(rows: DataFrame) -> DataFrame:
    """``letter, count`` over the unfiltered list, every bucket present, in their order."""
    domain = rows.sparkSession.createDataFrame(list(enumerate(buckets())), "pos int, letter string")
    counts = rows.groupBy(letter_bucket(F.col("normalized_term")).alias("letter")).agg(F.count("*").alias("count"))
    return domain.join(counts, "letter", "left").select("pos", "letter", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def browse(rows: DataFrame, kind: str, query: str = "", letter: str = "", page: int = 1, page_size: int = 100) -> dict:
    """A page with its total and letters."""
    return answered(shaped(rows, kind), kind, query, letter, page, page_size)


def answered(shape: DataFrame, kind: str, query: str = "", letter: str = "", page: int = 1, page_size: int = 100) -> dict:
    """The answer of ``browse`` for a list already shaped."""
    items = page_of(shape, query, letter, page, page_size)
    return {
        "list": kind, "query": query, "letter": letter, "page": page, "page_size": page_size, "total": filtered(shape, query, letter).count(),
        "items": [r.asDict() for r in items.collect()], "letters": [{"letter": r.letter, "count": r["count"]} for r in letters(shape).orderBy("pos").collect()],
    }
