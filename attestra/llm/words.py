"""The word rule that the operators on word n-grams share.

Words are maximal runs of ASCII digits, lower-case ASCII letters and any character beyond ASCII, after
A-Z became a-z. Fixed value: the pattern of the benchmark contract.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """Array of words; null text has none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
