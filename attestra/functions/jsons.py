"""JSON held in strings: envelopes, fields, alias maps, and repair of broken quotes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def envelope(raw: Column) -> Column:
    """{content, tool_used, actual_url} or plain text -> struct of the three; plain text is its own content."""
    parsed = F.from_json(raw, "content string, tool_used string, actual_url string")
    is_envelope = F.coalesce(parsed["content"].isNotNull(), F.lit(False))
    return F.struct(
        F.when(is_envelope, parsed["content"]).otherwise(raw).alias("content"),
        F.when(is_envelope, F.coalesce(parsed["tool_used"], F.lit("piped"))).otherwise(F.lit("piped")).alias("tool_used"),
        F.when(is_envelope, parsed["actual_url"]).alias("actual_url"),
    )


def numeric_keys(raw: Column, path: str) -> Column:
    """The keys of the object at path that are numbers, in their order."""
    keys = F.map_keys(F.from_json(F.get_json_object(raw, path), "map<string,string>"))
    return F.coalesce(F.filter(keys, lambda k: k.rlike(r"^\d+$")), F.array().cast("array<string>"))


def coerced(value: Column, valid: list[str], aliases: dict[str, str], default: str) -> Column:
    """A valid value stays, an alias becomes what it stands for, anything else the default; null stays null."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), value) if aliases else F.lit(None).cast("string")
    return F.when(value.isNull(), value).when(value.isin(valid), value).otherwise(F.coalesce(known, F.lit(default)))


@F.pandas_udf(StringType())
def repaired(raw: pd.Series) -> pd.Series:
    """Escape quotes inside JSON strings: one that is no end of a string, as no : , ] } or end follows. Needs a state
    for each character, which no built-in expression has."""
    return raw.map(lambda s: None if s is None else _escape_inner(s))


def _escape_inner(s: str) -> str:
    out, inside, k = [], False, 0
    while k < len(s):
        ch = s[k]
        if ch == "\\" and inside and k + 1 < len(s):
            out.append(s[k : k + 2])
            k += 2
            continue
        if ch == '"':
            if not inside:
                inside = True
            elif s[k + 1 :].lstrip()[:1] in ("", ":", ",", "]", "}"):
                inside = False
            else:
                ch = '\\"'
        out.append(ch)
        k += 1
    return "".join(out)


def parsed_or_repaired(raw: Column, schema: str) -> Column:
    """The parsed document; where it isn't valid JSON, what parses after straightening quotes and escaping inner ones."""
    from attestra.functions.text import straight_quotes

    ok = F.call_function("try_parse_json", raw).isNotNull()
    return F.from_json(F.when(ok, raw).otherwise(repaired(straight_quotes(raw))), schema)
