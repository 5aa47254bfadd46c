"""The corpus pipeline: STAGES, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockwise.llm import decontamination, line_quality, mixing, pii, queries, simhash
from blockwise.llm.common import table
from blockwise.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the line labelling rejects go.

    Null, empty and very short texts fail the base rule; repeated rows are judged alike; without labelled documents the labelling has
    fixed weights; columns beyond those of documents are left out; an empty table stays empty.
    """
    field = line_quality.fit(docs, table(spark, sf_dir, "labels"))
    return line_quality.keep(docs.select(COLUMNS), field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays.

    Near are fingerprints of 3-word shingles, as in the query of the operator, that differ in 3 bits or fewer: that finds near copies
    with few changes, and leaves in many that share 80 or 90 % of their shingles.  Texts without words are one group; repeated
    rows count as copies; a group keeps its smallest doc_id.
    """
    return simhash.deduplicate(docs).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items make up a twentieth or more go.

    Documents and items without words meet nothing; rows that share an id are judged by their own texts.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars follows the new text.

    A null text stays null, with null n_chars; equal entities get equal surrogates in all rows.
    """
    return pii.pseudonymise(docs, queries.PII_KEY).selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as bigint) as n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: a row for each time that a document is taken.

    A null source is a source of its own; documents without words are taken as often as the others of their source; repeated rows
    are taken together.
    """
    return mixing.mix(docs).select(*COLUMNS, "repetition")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("source_mixing", source_mixing),
]

#: The stages of quality rules and near-duplicates cannot be said in SQL; the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        docs = stage(docs) if i < len(STAGES) - 1 else docs
    return docs
