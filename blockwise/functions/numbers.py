"""Numbers and dates read out of noisy text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockwise.functions.literals import let, word_array
from blockwise.vocabulary import DEFAULT, METRIC_STRIP_ORDER, Vocabulary

# The patterns below decide which texts count as which kind of number.
BAR_STATUS = r"\d+[.,]?\d*\s*/\s*\d+"
ID_DIGITS = r"\d{7,12}"
CLOCK = r"UTC|\d{1,2}:\d{2}"
REPORT_TAG = r"^\[.+|\[.*\]"
REPORT_DATE = r"\d{2}:\d{2}|UTC|\d{2}/\d{2}"
REPORT_COORDINATES = r"(?i)X:?\s*\d+.*Y:?\s*\d+"
BAR = r"(\d[\d,.]*)\s*/\s*(\d[\d,.]*)"
OWNED = r"(?i)(?:Own|Owned|Possui|Possuído).*?(\d[\d.,]*)"
ID_PREFIX = r"(ID|1D|lD|Id|id)\s*[:).]?\s*"
PAGE_DATE = r"(\d{2,4}[/-]\d{2}([/-]\d{2,4})?)"
PAGE_COORDINATES = r"(?i)X:?\s*(\d+)\D*Y:?\s*(\d+)"
LEVEL = r"(?i)[LN]V\.?\s*\d+"
LEVEL_PREFIX = r"(?i)([LN]V\.?|Nível)\s*\d+"
PLAYER_ID = r"\d{7,10}"
METRIC = r"(\d+[.,]?\d*)\s*([KM]?)"
METRIC_GROUPS = r"^[^0-9]*(\d{1,3}(?:[.,]\d{3}){2,})\s*([KM]?)"
DECIMAL = r"(\d+[,.]\d+)"


def _int(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def _long(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def digits_only_int(text: Column) -> Column:
    """All digits of the text read as one INT; 0 when there are none or too many."""
    return _int(_digits(text))


def is_pure_number(text: Column) -> Column:
    """Digits with an optional K/M once separators, spaces and plus signs are removed."""
    return F.translate(F.trim(text), "., +", "").rlike(r"^\d+[KM]?$")


def has_digit(text: Column) -> Column:
    return text.rlike(r"\d")


def is_digits(text: Column) -> Column:
    return text.rlike(r"^\d+$")


def is_plain_number(text: Column) -> Column:
    """The digits fit a BIGINT and the text has no letter."""
    return _digits(text).try_cast("bigint").isNotNull() & ~text.rlike(r"\p{L}")


def player_id(text: Column) -> Column:
    """First run of 7 to 10 digits after the prefix is removed; 0 when absent or beyond INT."""
    return _int(F.regexp_extract(F.regexp_replace(text, ID_PREFIX, ""), PLAYER_ID, 0))


def grouped_long(text: Column) -> Column:
    """First digit run once separators are dropped and K/M are written out."""
    plain = F.replace(F.replace(F.translate(text, ".,", ""), F.lit("K"), F.lit("000")), F.lit("M"), F.lit("000000"))
    return _long(F.regexp_extract(plain, r"\d+", 0))


def metric_text(text: Column, vocabulary: Vocabulary = DEFAULT) -> Column:
    """Upper-cased text without label words and with misread digits restored."""
    labels = word_array([w.upper() for w in vocabulary.words(*METRIC_STRIP_ORDER)])
    bare = F.aggregate(labels, F.upper(text), lambda acc, word: F.replace(acc, word, F.lit("")))
    # every label has a letter, so plain figures are left alone
    bare = F.when(text.rlike(r"\p{L}"), bare).otherwise(text)
    return F.trim(F.translate(bare, "|ILO+", " 110"))


def _metric_value(clean: Column, fix_multi_group: bool) -> Column:
    suffix = F.regexp_extract(clean, METRIC, 2)
    number = F.translate(F.regexp_extract(clean, METRIC, 1), ",", ".")
    thousands = (suffix == "") & number.rlike(r"\.\d{3}$")
    number = F.when(thousands, F.translate(number, ".", "")).otherwise(F.rtrim(number, F.lit(".")))
    if fix_multi_group:
        whole = F.regexp_extract(clean, METRIC_GROUPS, 1)
        number = F.when(whole != "", F.translate(whole, ".,", "")).otherwise(number)
        suffix = F.when(whole != "", F.regexp_extract(clean, METRIC_GROUPS, 2)).otherwise(suffix)
    scale = F.when(suffix == "K", 1000).when(suffix == "M", 1000000).otherwise(1)
    return F.rint(number.try_cast("double") * scale).cast("bigint")


def suffixed_number(text: Column, vocabulary: Vocabulary = DEFAULT, fix_multi_group: bool = True) -> Column:
    """Metric value with an optional K/M suffix, rounded half to even.

    ``fix_multi_group`` reads "1,234,567" whole; without it only its first two groups count.
    """
    value = let(metric_text(text, vocabulary), lambda clean: _metric_value(clean, fix_multi_group))
    readable = (F.trim(text) != "") & ~F.contains(text, F.lit("%"))
    zero = F.lit(0).cast("bigint")
    return F.when(readable, F.coalesce(value, zero)).otherwise(zero)


def bar_values(text: Column) -> tuple[Column, Column]:
    """Current and maximum of a "875/1,000" text, 0 where absent."""
    return tuple(_int(F.translate(F.regexp_extract(text, BAR, g), ".,", "")) for g in (1, 2))


def owned_quantity(text: Column) -> Column:
    """First number after an ownership word."""
    return _int(F.translate(F.regexp_extract(text, OWNED, 1), ".,", ""))


def damage_percent(text: Column) -> Column:
    """The decimal number in a percentage text; 0 without decimals."""
    number = F.translate(F.regexp_extract(text, DECIMAL, 1), ",", ".")
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def first_number_int(text: Column) -> Column:
    return _int(F.regexp_extract(text, r"\d+", 0))


def page_timestamp(text: Column, as_of_year: Column | int) -> Column:
    """Date in a text; a date without a year gets ``as_of_year``."""
    found = F.regexp_extract(text, PAGE_DATE, 1)
    year = F.lit(as_of_year) if isinstance(as_of_year, int) else as_of_year
    dated = F.when(F.length(found) <= 5, F.concat_ws("/", year.cast("string"), found)).otherwise(found)
    dated = F.translate(dated, "-", "/")
    # two-digit years are of this century, and stand last unless the first number can only be a year
    parts = [F.try_to_timestamp(dated, F.lit(p)) for p in ("yyyy/M/d", "yyyy/M", "M/d/yyyy", "M/d/yy", "yy/M/d")]
    return F.coalesce(*parts)


def page_coordinates(text: Column) -> Column:
    """"X:.. Y:.." when the text holds map coordinates, else NULL."""
    x, y = (F.regexp_extract(text, PAGE_COORDINATES, g) for g in (1, 2))
    return F.when(x != "", F.concat(F.lit("X:"), x, F.lit(" Y:"), y))
