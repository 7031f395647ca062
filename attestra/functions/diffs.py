"""Unified diffs and byte repair: the two text functions that no built-in expression can give."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """The unified diff of two texts without file names; empty where they are equal, null counts as empty."""
    make = lambda a, b: "\n".join(list(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), lineterm=""))[2:])
    return pd.Series([make(a, b) for a, b in zip(before, after, strict=True)])


def _decoded(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    for charset in ("utf-8", "gb18030", "cp1252"):
        try:
            return bytes(raw).decode(charset)
        except UnicodeDecodeError:
            continue
    return bytes(raw).decode("utf-8", errors="replace")


@F.pandas_udf(StringType())
def _repaired(raw: pd.Series) -> pd.Series:
    return raw.map(_decoded)


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8, else in the first charset that fits, else UTF-8 with replacement characters. Only bytes that aren't UTF-8 go to Python."""
    valid = F.is_valid_utf8(raw.cast("string"))
    return F.when(valid, raw.cast("string")).otherwise(_repaired(F.when(~valid, raw)))
