"""From raw documents to a training mix: five stages, each of which applies one text operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next stage's documents. All stages but the last return the columns of
documents, whatever these are called; the last adds size, source_size, target and taken.

Defined cases: a null or empty text has no letters, so language ID rejects it; a null doc_id is
kept like others and is the last to stand for a group of near-duplicates; rows with equal id and
text are one document to near-dedup; a null source is a source of its own; without labelled
documents every text is of an unknown language and the result is empty; empty tables give empty
results, and an empty benchmark rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanbox.llm import decontaminate, language, lines, mixing, neardup
from gleanbox.llm.common import load, materialize

#: A text is rejected if this little of it is in the language that it is most like.
LEAST_LANGUAGE_SHARE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in none of the languages of labelled documents, go."""
    return language.spoken(docs, language.fit(docs.select("doc_id", "text", "lang")), LEAST_LANGUAGE_SHARE)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; the documents stay."""
    return lines.drop_recurring_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8)."""
    return neardup.one_of_each_group(docs, width=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each."""
    return mixing.mix_sources(docs).filter(F.col("taken") > 0)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_template_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("source mix", mix_to_targets),
]

#: SQL can't express the stages; tests/llm holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
