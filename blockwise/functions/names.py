"""Tags and names split out of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockwise.functions import numbers as N
from blockwise.functions.text import contains_any
from blockwise.vocabulary import DEFAULT, Vocabulary

# Fixed value: the characters a tag may hold besides letters and digits.
TAG_KEEP = r"""[^a-zA-Z0-9\-_."':!@#$%&*+=<>?]"""


def clean_display_name(text: Column) -> Column:
    """Word characters, spaces, hyphens and square brackets only."""
    return F.trim(F.regexp_replace(text, r"(?U)[^\w\s\-\[\]]", ""))


def clean_tag(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, TAG_KEEP, ""))


def split_tag_and_name(text: Column) -> Column:
    """STRUCT<tag, name>: bracketed tag, half-bracketed tag, leading short word, or no tag."""
    t = F.trim(text)
    close = F.locate("]", t)
    closed = F.struct(
        clean_tag(F.replace(F.substring_index(t, "]", 1), F.lit("["), F.lit(""))).alias("tag"),
        clean_display_name(F.substr(t, close + 1)).alias("name"))

    body = F.substr(t, F.lit(2))
    space = F.locate(" ", body)
    cut = F.when((space >= 2) & (space <= 6), space - 1).otherwise(F.lit(4))
    skip = F.when((space >= 2) & (space <= 6), space + 1).otherwise(F.lit(5))
    half_open = F.struct(
        clean_tag(F.substr(body, F.lit(1), cut)).alias("tag"),
        clean_display_name(F.substr(body, skip)).alias("name"))

    gap = F.locate(" ", t)
    word = clean_tag(F.substring_index(t, " ", 1))
    loose = F.struct(word.alias("tag"), clean_display_name(F.substr(t, gap + 1)).alias("name"))
    bare = F.struct(F.lit("--").alias("tag"), clean_display_name(t).alias("name"))

    return (F.when(close > 1, closed)
            .when(F.startswith(t, F.lit("[")), half_open)
            .when((gap > 0) & F.length(word).between(2, 5), loose)
            .otherwise(bare))


def split_tag_rigid(text: Column) -> Column:
    """STRUCT<tag, suffix> for report headers."""
    t = F.trim(text)
    # fixed values
    both = r"^\[([^\]]{2,6})\](.*)"
    tail = r"^(.{3,5})\](.*)"
    body = F.substr(t, F.lit(2))
    stripped = F.trim(F.translate(t, "[]", ""))
    return (F.when(t.rlike(both), F.struct(F.regexp_extract(t, both, 1).alias("tag"),
                                           F.regexp_extract(t, both, 2).alias("suffix")))
            .when(t.rlike(tail), F.struct(F.regexp_extract(t, tail, 1).alias("tag"),
                                          F.regexp_extract(t, tail, 2).alias("suffix")))
            .when(F.startswith(t, F.lit("[")) & (F.length(body) >= 4),
                  F.struct(F.substring(body, 1, 4).alias("tag"), F.substr(body, F.lit(5)).alias("suffix")))
            .otherwise(F.struct(F.substring(stripped, 1, 5).alias("tag"), F.lit("").alias("suffix"))))


def is_level_text(text: Column) -> Column:
    return text.rlike(N.LEVEL)


def without_level(text: Column) -> Column:
    """Text left once level markers are removed; may be empty."""
    return F.trim(F.regexp_replace(text, N.LEVEL_PREFIX, ""))


def without_leading_digits(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^\d+\s*", ""))


def is_player_name(text: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """Long enough, not a date, time or coordinate, and free of PvE and interface words."""
    # fixed values: what a date and a time look like
    looks_like_data = (text.rlike(r"\d{4}/\d{2}/\d{2}") | text.rlike(r"\d{2}:\d{2}")
                       | text.rlike(N.REPORT_COORDINATES))
    words = contains_any(text, vocabulary.words("pve_terms", "ui_blacklist"))
    return F.coalesce((F.length(F.trim(text)) > 0) & (F.length(text) >= 2) & ~looks_like_data & ~words, F.lit(False))


def clean_player_name(text: Column) -> Column:
    return F.trim(F.translate(text, "[]", ""))
