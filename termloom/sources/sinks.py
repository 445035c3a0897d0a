"""Sinks: CSV lists, word-only lists, parts with a manifest, audit lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexicon import COMBINATION_FIELDS, TERM, TERM_FIELDS, in_order

PART_SIZE = 10_000


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Header CSV of exactly ``fields``, overwriting, in order of ord where there is one. Another column is an error."""
    extra = set(df.columns) - set(fields) - {"ord"}
    if extra:
        raise ValueError(f"columns not in the field list: {sorted(extra)}")
    rows = df.orderBy("ord") if "ord" in df.columns else df
    rows.select(*fields).write.mode("overwrite").options(header=True, escape='"').csv(path)


def words_only(df: DataFrame, key: str = "term") -> DataFrame:
    """Distinct non-empty words, sorted."""
    return df.select(F.col(key).alias("term")).where("coalesce(term, '') <> ''").distinct().orderBy("term")


def parts(df: DataFrame, size: int = PART_SIZE, key: str = "term") -> DataFrame:
    """``part, term``: the sorted distinct words cut into parts of ``size``.

    The place of a word is counted in steps: words before its first character,
    before its first three within that, before its first seven within those, and
    the words inside. So no task sorts the whole list, and a task that numbers
    words holds only those that share seven characters.
    """
    words = df.select(F.col(key).alias("term")).where("coalesce(term, '') <> ''").distinct()
    heads = [F.substring("term", 1, n).alias(f"h{n}") for n in (1, 3, 7)]
    counts = words.select(*heads).groupBy("h1", "h3", "h7").agg(F.count("*").alias("n"))
    three = counts.groupBy("h1", "h3").agg(F.sum("n").alias("n"))
    one = three.groupBy("h1").agg(F.sum("n").alias("n"))

    def before(rows: DataFrame, within: list[str], by: str) -> DataFrame:
        order = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(by)
        return rows.select(*within, by, (F.sum("n").over(order) - F.col("n")).alias(f"before_{by}"))

    placed = before(counts, ["h1", "h3"], "h7").join(before(three, ["h1"], "h3"), ["h1", "h3"]).join(before(one, [], "h1"), "h1")
    start = placed.select("h7", (F.col("before_h1") + F.col("before_h3") + F.col("before_h7")).alias("before"))
    inside = words.withColumn("h7", F.substring("term", 1, 7)).withColumn("i", F.row_number().over(Window.partitionBy("h7").orderBy("term")))
    return inside.join(start, "h7").select((F.floor((F.col("before") + F.col("i") - 1) / size) + 1).cast("int").alias("part"), "term")


def manifest(part_rows: DataFrame, stem: str = "words_part") -> DataFrame:
    """``file, rows`` of every part."""
    return part_rows.groupBy("part").agg(F.count("*").alias("rows")).select(F.format_string(f"{stem}_%03d.csv", "part").alias("file"), "rows")


def write_parts(df: DataFrame, directory: str, size: int = PART_SIZE, stem: str = "words_part") -> None:
    cut = parts(df, size)
    cut.repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").options(header=True, escape='"').csv(f"{directory}/parts")
    write_csv(manifest(cut, stem).orderBy("file"), f"{directory}/manifest", ["file", "rows"])


def export_all(black: DataFrame, white: DataFrame, combinations: DataFrame, directory: str) -> None:
    """All outputs of one build: full, black, grey (empty by design), white, combinations, word lists, parts."""
    spark = black.sparkSession
    every = in_order(black, white) if "ord" in black.columns and "ord" in white.columns else black.unionByName(white)
    write_csv(every, f"{directory}/all_terms", TERM_FIELDS)
    write_csv(black, f"{directory}/blacklist", TERM_FIELDS)
    write_csv(spark.createDataFrame([], TERM), f"{directory}/greylist", TERM_FIELDS)
    write_csv(white, f"{directory}/whitelist", TERM_FIELDS)
    write_csv(combinations, f"{directory}/combinations", COMBINATION_FIELDS)
    write_csv(words_only(black), f"{directory}/blacklist_words", ["term"])
    write_csv(words_only(white), f"{directory}/whitelist_words", ["term"])
    write_csv(words_only(combinations, "combination"), f"{directory}/combination_words", ["term"])
    write_parts(white, f"{directory}/whitelist_parts")


def audit_lines(classified: DataFrame, text: str = "text", at=None) -> DataFrame:
    """JSON lines of every result that is not ALLOW."""
    result = F.struct("risk_score", "action", "matched_terms", "matched_combination", "normalized_text", "reason")
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return classified.where("action <> 'ALLOW'").select(F.to_json(F.struct(stamp.alias("timestamp"), F.col(text).alias("input_text"), result.alias("result"))).alias("value"))


def append_audit(classified: DataFrame, path: str, text: str = "text") -> None:
    audit_lines(classified, text).write.mode("append").text(path)
