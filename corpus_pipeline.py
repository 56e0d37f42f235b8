"""The corpus pipeline: language, repeated lines, near-duplicates, packing.

Every stage takes a table with doc_id, text and lang, carries all other columns
along, whatever their names, and treats rows as rows: repeated ones, null ids
and ids that occur twice are allowed. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaxis.llm.common import scratch
from lexaxis.llm.langid import keep_languages
from lexaxis.llm.line_dedup import dedup_lines
from lexaxis.llm.packing import pack
from lexaxis.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are in one of the languages the labels name.

    * null and empty texts, and those of no language, go; with no label at all nothing is known, and all stay;
    * very long texts are judged by all their windows; of languages that tie the first by name counts;
    * repeated rows are judged alike, so all of them stay or go; the text isn't changed.
    """
    return keep_languages(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier document, or an earlier line of their own, has; n_chars follows.

    * null and empty texts, and those of blank lines, stay as they are; blank lines stay where they are;
    * a document whose lines all stand elsewhere goes; of repeated rows the first stays;
    * ties between equal doc_ids are decided by the files' order, null ids come last;
    * very long texts and lines, and texts of very many lines, count whole.
    """
    order = docs.columns
    kept = dedup_lines(docs)
    if "n_chars" in order:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*(kept[f"`{c}`"] for c in order))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of least doc_id, and all that are in none.

    * texts without words, null ones among them, have no fingerprint and all stay;
    * of repeated rows one stays; ties between equal doc_ids are decided by the files' order, null ids come last;
    * very long texts count whole; the text isn't changed.
    """
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed contexts: (pack_id, tokens, pieces).

    * null, empty and blank texts have no tokens and no piece; very long ones fill contexts of their own and leave a rest;
    * repeated rows and null ids have pieces of their own; of equal lengths the files' order decides.
    """
    return pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packing)]

#: A trained network, fingerprints and a rounded linear program: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
