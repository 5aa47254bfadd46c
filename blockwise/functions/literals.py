"""Lists as constants of an expression."""

from __future__ import annotations

import json

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(value: list | dict, schema: str) -> Column:
    """A nested Python value as one foldable expression; the optimizer turns it into a literal once."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def word_array(words: list[str]) -> Column:
    return constant(words, "array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
