"""The library from SQL text: rewriters and line parsers as functions of a session, and claims, their sources and edges as views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf


def _text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_rewriter(spark: SparkSession, name: str, rules: list[tuple[str, str]]) -> None:
    """name(url) in SQL: the first rule (pattern, replacement) whose pattern is in the URL rewrites it; without one the URL stays, null stays null.

    It is a SQL function, so it is part of the plan, not a call to Python.
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"not a name: {name}")
    cases = " ".join(f"WHEN url RLIKE {_text(p)} THEN regexp_replace(url, {_text(p)}, {_text(to)})" for p, to in rules)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(url STRING) RETURNS STRING RETURN {f'CASE {cases} ELSE url END' if cases else 'url'}")


class Sections:
    """A state machine over a document's lines, for TABLE(doc, pos, line) PARTITION BY doc ORDER BY pos.

    A row for each heading: its document (as a string), place, level and title, whether it is more than one level below the heading before, and how many
    lines stand below it before the next heading.
    """

    def __init__(self):
        self.open, self.before = None, None

    def eval(self, row):
        line = row["line"] or ""
        level = len(line) - len(line.lstrip("#"))
        if 1 <= level <= 6 and line[level : level + 1] in (" ", "\t"):
            if self.open:
                yield self.open
            doc = None if row["doc"] is None else str(row["doc"])
            self.open = (doc, row["pos"], level, line[level:].strip(), self.before is not None and level > self.before + 1, 0)
            self.before = level
        elif self.open:
            self.open = (*self.open[:-1], self.open[-1] + 1)

    def terminate(self):
        if self.open:
            yield self.open


def register_sections(spark: SparkSession, name: str = "sections_of") -> None:
    """SELECT * FROM sections_of(TABLE(lines) PARTITION BY doc ORDER BY pos)"""
    spark.udtf.register(name, udtf(Sections, returnType="doc string, pos long, level int, title string, skipped boolean, body_rows long"))


def register_views(spark: SparkSession, claims: DataFrame, edges: DataFrame, sources: DataFrame, prefix: str = "") -> None:
    """The views <prefix>claims, <prefix>edges and <prefix>sources, and two functions over them: <prefix>claims_of(section) and
    <prefix>cited_by(claim), the sources that a claim cites."""
    for name, df in (("claims", claims), ("edges", edges), ("sources", sources)):
        df.createOrReplaceTempView(prefix + name)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}claims_of(wanted STRING) RETURNS TABLE (cid BIGINT, summary STRING, num BIGINT) RETURN SELECT cid, summary, num FROM {prefix}claims WHERE section = wanted")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}cited_by(claim BIGINT) RETURNS TABLE (s_suppkey BIGINT, host STRING, tier INT, supports BOOLEAN) "
        f"RETURN SELECT e.s_suppkey, s.host, s.tier, e.supports FROM {prefix}edges e JOIN {prefix}sources s ON s.s_suppkey = e.s_suppkey WHERE e.cid = claim"
    )
