"""Lists on disk by version: build and export, review, overrides with their history, cached indexes.

A folder holds ``versions/<n>`` (the outputs of ``export_all``), ``history``
(override rows, appended) and ``CURRENT`` (the number of the version in force).
A version is written whole before ``CURRENT`` names it, so a reader, or a job
that dies, never sees half of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lexicon import COMBINATION, OVERRIDE, REVIEW_FIELDS, TERM, exists, in_order, read_csv, read_csv_or_empty, with_ord
from ..sources.sinks import export_all, write_csv
from . import browse, classify, overrides, suggest, validate
from .review import Policy, review

LISTS = ("blacklist", "whitelist", "combinations")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, directory: str) -> int:
    """Number of the version in force, 0 if there is none."""
    return int(spark.read.text(f"{directory}/CURRENT").first()[0]) if exists(spark, f"{directory}/CURRENT") else 0


def publish(black: DataFrame, white: DataFrame, combinations: DataFrame, directory: str) -> int:
    """Write the next version and put it in force."""
    spark = black.sparkSession
    number = current(spark, directory) + 1
    export_all(black, white, combinations, f"{directory}/versions/{number}")
    fs, new = _path(spark, f"{directory}/CURRENT.{number}")
    out = fs.create(new, True)
    out.write(bytearray(f"{number}\n".encode()))
    out.close()
    _, old = _path(spark, f"{directory}/CURRENT")
    fs.delete(old, False)
    if not fs.rename(new, old):
        raise OSError(f"could not put version {number} of {directory} in force")
    return number


def lists(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The version in force, rows with ord."""
    at = f"{directory}/versions/{current(spark, directory)}"
    return {name: with_ord(read_csv(spark, f"{at}/{name}", COMBINATION if name == "combinations" else TERM)) for name in LISTS}


def ensure(spark: SparkSession, directory: str, build: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]) -> bool:
    """Build and publish if no version is in force; True if it was."""
    missing = current(spark, directory) == 0
    if missing:
        publish(*build(), directory)
    return missing


def review_file(spark: SparkSession, directory: str, patterns: DataFrame, policy: Policy = Policy()) -> str:
    """Review of the version in force as a CSV list beside it; its path."""
    own = lists(spark, directory)
    path = f"{directory}/versions/{current(spark, directory)}/review"
    write_csv(review(own["blacklist"], own["whitelist"], patterns, policy), path, REVIEW_FIELDS)
    return path


def history(spark: SparkSession, directory: str) -> DataFrame:
    """Override rows, all of them; empty before the first."""
    return read_csv_or_empty(spark, f"{directory}/history", OVERRIDE)


def override(spark: SparkSession, directory: str, term: str, action: str, wording: overrides.Wording = overrides.Wording()) -> dict:
    """One override: history first, then all lists, word lists and parts as a new version. Returns the acknowledgement."""
    own = lists(spark, directory)
    black, white, answer = overrides.override(own["blacklist"], own["whitelist"], term, action, wording)
    fields = [f.split(" ")[0] for f in OVERRIDE.split(", ")]
    asked = spark.createDataFrame([(answer["term"], action)], "term string, action string").withColumn("created_at", F.current_timestamp())
    overrides.override_rows(asked, wording).select(*fields).write.mode("append").options(header=True, escape='"').csv(f"{directory}/history")
    answer["version"] = publish(black, white, own["combinations"], directory)
    return answer


class Catalog:
    """The version in force with its indexes cached; ``refresh`` follows a new version."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory, self.version, self._cached = spark, directory, -1, []
        self.refresh()

    def refresh(self) -> bool:
        """Rebuild the indexes if another version came into force; True if so."""
        number = current(self.spark, self.directory)
        if number == self.version:
            return False
        for df in self._cached:
            df.unpersist()
        self.version, self.lists = number, lists(self.spark, self.directory)
        self.shapes = {k: browse.shaped(v, k).persist() for k, v in self.lists.items()}
        names = self.spark.createDataFrame([], "resource_name string, action string, ord array<bigint>")
        self.index = suggest.prefix_index(suggest.suggestions(names, self.lists["whitelist"], self.lists["blacklist"])).persist()
        both = in_order(self.lists["blacklist"], self.lists["whitelist"])
        self.terms = both.select(F.xxhash64("ord").alias("tid"), "term", "normalized_term", "risk_level", "action").persist()
        rows = self.lists["combinations"]
        self.rules = rows.select(F.xxhash64("ord").alias("tid"), F.col("combination").alias("phrase"), F.col("normalized_combination").alias("normalized_phrase"), F.col("risk_level").alias("risk_score")).persist()
        self._cached = [*self.shapes.values(), self.index, self.terms, self.rules]
        return True

    def suggest(self, query: str, limit: int = 12) -> DataFrame:
        return suggest.suggest(self.index, query, limit)

    def browse(self, kind: str, **asked) -> dict:
        if kind not in self.shapes:
            raise KeyError(f"unknown list: {kind}")
        return browse.answered(self.shapes[kind], kind, **asked)

    def classify(self, docs: DataFrame, fuzzy: bool = True) -> DataFrame:
        return classify.classify(docs, self.terms, self.rules, None, fuzzy)

    def classify_text(self, text: str) -> dict:
        return classify.classify_text(text, self.terms, self.rules)

    def validate(self, docs: DataFrame) -> DataFrame:
        return validate.validate_detailed(docs, self.lists["blacklist"], self.lists["whitelist"], self.rules)

    def override(self, term: str, action: str) -> dict:
        answer = override(self.spark, self.directory, term, action)
        self.refresh()
        return answer
