"""The corpus pipeline: documents to packed training sequences in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slitloom.llm import bestfit, chaining, decontaminate, fertility, simhash
from slitloom.llm.common import discard, load, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tokeniser fertility lies in the bands of their language.

    Null and empty texts and rows without an id go; of rows that repeat an id
    all stay if one does.  A text of any length is measured whole; a value on
    a limit goes.  An empty table stays empty; columns may have any names."""
    return fertility.keep_fertile(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id.

    Null, empty and wordless texts are no copies and stay; rows that repeat an
    id are one document and stay or go together.  A text of any length counts
    whole.  An empty table stays empty; columns may have any names."""
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds.

    Null and empty texts stay as they are; a document of which nothing is left
    goes.  Rows that repeat an id count as the longest of them and are cut
    alike.  A text of any length is searched whole; of equal passages the one
    in the least doc_id stays.  An empty table stays empty; columns may have
    any names."""
    return chaining.cut_words(docs, chaining.passages(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item.

    Null and empty texts stay; of rows that repeat an id all go if one holds a
    copy.  A text of any length is searched whole; a score equal to the
    threshold is a copy.  An empty table, or an empty benchmark, leaves the
    documents as they are; columns may have any names."""
    return decontaminate.drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence that holds each piece of each document.

    Null and empty texts have no piece; rows that repeat an id count once, as
    the longest.  A text of any length is cut into whole sequences and a rest;
    equal sizes are taken by doc_id.  An empty table gives no rows; columns may
    have any names."""
    return bestfit.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Tokenisation, signatures, chaining and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
