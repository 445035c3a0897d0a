"""Sources: schemas and scans of lexicon files, word lists and literal relations.

Order is part of the model (first or last row wins), so every source carries an
explicit ``ord``: a number, or an array of numbers compared from the left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import normalize_text

TERM = "term string, normalized_term string, category string, source string, risk_level int, action string, confidence double, notes string"
COMBINATION = "combination string, normalized_combination string, category string, source string, risk string, risk_level int, action string, confidence double, notes string"
APPROVED = "resource_name string, action string, risk_score int, matched_terms string, matched_combinations string, normalized_text string, recommendation string"
OVERRIDE = "term string, normalized_term string, action string, category string, source string, created_at timestamp, notes string"
REVIEW = "term string, normalized_term string, decision string, confidence string, review_bucket string, reason string, source string"
TERM_FIELDS = [f.split(" ")[0] for f in TERM.split(", ")]
COMBINATION_FIELDS = [f.split(" ")[0] for f in COMBINATION.split(", ")]
REVIEW_FIELDS = [f.split(" ")[0] for f in REVIEW.split(", ")]


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with doubled quotes; empty strings stay empty. Fails if the path is missing."""
    df = spark.read.schema(schema).options(header=True, escape='"', multiLine=False, mode="PERMISSIVE").csv(path)
    return df.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema)


def with_ord(df: DataFrame) -> DataFrame:
    """File order as a column: file by name, block within the file, row within the block.

    The scan keeps its tasks. Rows that come from no file are in the order of
    their partitions.
    """
    row = F.monotonically_increasing_id()
    files = sorted(df.inputFiles())
    if not files:
        return df.withColumn("ord", F.array(row))
    # a local file's name has one slash in the one listing and three in the other
    number = F.create_map(*[x for i, f in enumerate(files) for x in (F.lit(re.sub("^file:/+", "file:/", f)), F.lit(i))])
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    return df.withColumn("ord", F.array(number[name].cast("long"), F.col("_metadata.file_block_start"), row))


def levels(df: DataFrame) -> Column:
    """``ord`` as an array, whichever of its two forms it has."""
    return F.col("ord") if isinstance(df.schema["ord"].dataType, ArrayType) else F.array(F.col("ord").cast("long"))


def in_order(*frames: DataFrame) -> DataFrame:
    """Bag union of ord-carrying frames, each after the one before. Unions may be nested to any depth."""
    marked = [f.withColumn("ord", F.concat(F.array(F.lit(i).cast("long")), levels(f))) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, marked)


def read_terms(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Union scan of term lists in the order given."""
    return in_order(*[with_ord(read_csv(spark, p, TERM)) for p in paths])


def ensure_lists(spark: SparkSession, paths: Iterable[str], build) -> bool:
    """Run ``build()`` if any list is missing; True if it ran."""
    missing = not all(exists(spark, p) for p in paths)
    if missing:
        build()
    return missing


def read_words(spark: SparkSession, path: str, category: str = "general_lexicon", source: str = "external_word_list", confidence: float = 0.45, notes: str = "") -> DataFrame:
    """One word a line, blanks dropped, as ALLOW rows of risk 0. A missing file is an empty list."""
    try:
        lines = spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string")
    except AnalysisException:
        lines = spark.createDataFrame([], "value string")
    words = with_ord(lines.select(F.trim("value").alias("term")).where("term <> ''"))
    return external_rows(words, category, source, confidence, notes)


def external_rows(words: DataFrame, category: str, source: str, confidence: float = 0.45, notes: str = "") -> DataFrame:
    """Term rows of plain words (columns term, ord)."""
    return words.select(
        "term", normalize_text(F.col("term")).alias("normalized_term"), F.lit(category).alias("category"), F.lit(source).alias("source"),
        F.lit(0).alias("risk_level"), F.lit("ALLOW").alias("action"), F.lit(confidence).alias("confidence"), F.lit(notes).alias("notes"), "ord",
    )


def seed_rows(seeds: DataFrame, action: str, source: str | None, confidence: float) -> DataFrame:
    """Literal relation (term, category, risk_level, notes[, source], ord) to term rows."""
    return seeds.select(
        "term", normalize_text(F.col("term")).alias("normalized_term"), "category", (F.lit(source) if source is not None else F.col("source")).alias("source"),
        F.col("risk_level").cast("int").alias("risk_level"), F.lit(action).alias("action"), F.lit(confidence).alias("confidence"), "notes", "ord",
    )


def rules(combinations: DataFrame) -> DataFrame:
    """Typed combination rules; the action is not part of a rule."""
    return combinations.select(
        F.col("combination").alias("phrase"), F.col("normalized_combination").alias("normalized_phrase"), F.col("risk").alias("risk_label"),
        F.col("risk_level").cast("int").alias("risk_score"), F.coalesce("notes", F.lit("")).alias("notes"),
    )
