"""A corpus pipeline of five stages over ``documents``: each stage takes and (but the last) returns its columns.

``run`` writes every stage's rows to the shared checkpoint folder and goes on from there, so a stage's input is computed
once however often the stage reads it, and a lost executor costs no more than the stage at hand.

Cases that all stages share: an empty table gives an empty one; texts of any length are taken whole; columns beyond those
of ``documents`` are passed on (but the last stage returns pieces), whatever their names; the order of rows plays no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import line_dedup, ngram_join, packing, quality, substring
from tidewire.llm.common import cut, read_table
from tidewire.llm.queries import vocabulary


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars made to fit the text again."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the classifier go.

    A null or blank text has under ten words and goes; repeated rows are judged alike; a null doc_id changes nothing;
    without labels of both classes the base rule decides alone.
    """
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three-line windows are taken out of the texts.

    A null text and a row with a null doc_id stay as they are; repeated rows (doc_id and text) are one document and stay
    alike; a tie between windows goes to the smaller doc_id, then to the earlier line; n_chars is counted again (null
    for a null text). A column named n_removed_lines keeps its values.
    """
    return _recounted(line_dedup.drop_repeated_lines(docs, count=None), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays: that with the smallest doc_id.

    Null and blank texts are like nothing and stay, as do rows with a null doc_id; repeated rows share a doc_id and stay
    or go together.
    """
    found = ngram_join.similar_components(docs)
    gone = found.where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under 13-word windows that start in a smaller doc_id are taken out of the texts.

    A text that loses no word stays as it is, line ends and all; null texts and rows with a null doc_id stay; repeated rows
    are treated alike; a text may end up empty; n_chars is counted again.
    """
    return _recounted(substring.drop_repeated(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full token sequences.

    A null or empty text is its closing id alone; repeated rows are packed as often as they occur; a null doc_id is packed
    under null.
    """
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("ngram_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed),
]

#: A trained model and a tokenizer have no SQL; the stages are held against brute force in tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
