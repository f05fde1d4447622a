"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The invisible characters that are no part of a word.
INVISIBLE = "​‌‍⁠﻿­"
WORD = r"[\p{L}\p{Nd}]+"


def words(text: Column) -> Column:
    """Words of a text in order: invisible characters dropped, lower case, maximal runs of letters and digits.

    A null text has no words (an empty array)."""
    found = F.regexp_extract_all(F.lower(F.translate(text, INVISIBLE, "")), F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def word_bag(text: Column) -> Column:
    """The words in sorted order as one string, repeats kept; null where there are none."""
    w = words(text)
    return F.when(F.size(w) > 0, F.array_join(F.array_sort(w), " "))


def title_key(title: Column) -> Column:
    """``lower(trim(title))``, ordinary spaces only."""
    return F.lower(F.trim(title))
