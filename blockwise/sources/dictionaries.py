"""Dictionaries: entities with their labels, and the keyword lists as a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwise import schemas
from blockwise.vocabulary import DEFAULT, Vocabulary


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file (a JSON array) as labelled rows; a missing file is an empty dictionary."""
    try:
        entries = spark.read.schema(schemas.DICTIONARY_ENTRY).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        entries = spark.createDataFrame([], schemas.DICTIONARY_ENTRY)
    # an array of one file arrives in order, in one partition
    return load_dictionary(entries.withColumn("entry_ord", F.monotonically_increasing_id()))


def load_dictionary(entries: DataFrame) -> DataFrame:
    """One row per entry and label; an entry without labels keeps one row with none."""
    usable = entries.filter(F.col("id").isNotNull())
    return usable.select(F.col("id").alias("entry_id"), "entry_ord", F.col("canonicalName").alias("canonical"), "rarity", "expertise",
                         F.posexplode_outer("labels").alias("label_ord", "label"))


def keyword_dimension(spark: SparkSession, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """keywords(list, kw, kw_ord) with the order of every list kept."""
    rows = [(name, word, i) for name, words in vocabulary.keywords.items() for i, word in enumerate(words)]
    return spark.createDataFrame(rows, "list string, kw string, kw_ord int")


def keyword_union(keywords: DataFrame, lists: list[str], sizes: dict[str, int]) -> DataFrame:
    """Lists joined end to end: duplicates kept, ``kw_ord`` counted on from one list to the next."""
    base, cases = 0, None
    for name in lists:
        cases = F.when(F.col("list") == name, base) if cases is None else cases.when(F.col("list") == name, base)
        base += sizes[name]
    return keywords.filter(F.col("list").isin(lists)).select("list", "kw", (F.col("kw_ord") + cases).cast("int").alias("kw_ord"))
