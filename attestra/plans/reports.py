"""Queries of the checks on rendered reports, over one made report for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import reports
from attestra.plans.registry import Tables, query

_BODY = """'---' || chr(10) || 'topic: a' || chr(10) || 'goal_type: b' || chr(10) || 'date: c' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'review_status: d' || chr(10) ELSE '' END || '---' || chr(10) || '# T' || chr(10) || 'see [1] and [2]'
 || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '## A' ELSE '### A' END || chr(10) || regexp_replace(text, '[#`\\[|]', '', 'g') || chr(10) || '## A' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'x' || chr(10) END
 || CASE WHEN doc_id % 7 = 0 THEN '```' || chr(10) ELSE '' END || '|a|b|' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '|-|' ELSE '|-|-|' END || chr(10) || '## References' || chr(10) || CASE WHEN doc_id % 6 = 0 THEN '[1]: http://x' || chr(10) || '[3]: http://y' ELSE '[1] one' || chr(10) || '[3] three' END"""


def made(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    parts = [
        F.lit("---\ntopic: a\ngoal_type: b\ndate: c\n"), F.when(d % 3 == 0, "review_status: d\n").otherwise(""), F.lit("---\n# T\nsee [1] and [2]\n"), F.when(d % 2 == 0, "## A").otherwise("### A"), F.lit("\n"),
        F.regexp_replace("text", r"[#`\[|]", ""), F.lit("\n## A\n"), F.when(d % 5 == 0, "").otherwise("x\n"), F.when(d % 7 == 0, "```\n").otherwise(""), F.lit("|a|b|\n"), F.when(d % 4 == 0, "|-|").otherwise("|-|-|"),
        F.lit("\n## References\n"), F.when(d % 6 == 0, "[1]: http://x\n[3]: http://y").otherwise("[1] one\n[3] three"),
    ]
    return t.documents.select(d.alias("report_id"), F.concat(*parts).alias("body"))


def _sql(gate: str, level: str, passed: str, metric: str = "NULL", threshold: str = "NULL", detail: str = "''") -> str:
    return f"SELECT '{gate}' AS gate, CAST(doc_id AS VARCHAR) AS subject, '{level}' AS level, {passed} AS passed, CAST({metric} AS DOUBLE) AS metric, CAST({threshold} AS DOUBLE) AS threshold, {detail} AS detail FROM (SELECT doc_id, text, {_BODY} AS body FROM documents)"


_SPLIT = "regexp_extract(body, '(?s)^(.*)## References', 1)"
_CITED = f"list_distinct(list_transform(regexp_extract_all({_SPLIT}, '\\[(\\d{{1,2}})[†‡]?\\]', 1), lambda x: CAST(x AS INTEGER)))"
_DEFINED = "list_distinct(list_transform(regexp_extract_all(regexp_extract(body, '(?s)^.*(## References.*)$', 1), '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)))"


def _diff(a: str, b: str) -> str:
    return f"list_sort(list_filter({a}, lambda y: NOT list_contains({b}, y)))"


@query("Q37_Q38_citations", " UNION ALL ".join(_sql(g, "BLOCKER", f"len({x}) = 0", f"len({x})", "0", f"array_to_string({x}, ',')") for g, x in (("report_dangling_refs", _diff(_CITED, _DEFINED)), ("report_orphaned_defs", _diff(_DEFINED, _CITED)))))
def q37(t: Tables):
    return reports.citation_gates(made(t))


@query("Q39_refs_visibility", _sql("report_refs_visibility", "WARN", "doc_id % 6 <> 0"))
def q39(t: Tables):
    return reports.visibility_gate(made(t))


@query("Q40_table_delimiters", _sql("report_table_delimiters", "WARN", "doc_id % 4 <> 0", "CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END", "0"))
def q40(t: Tables):
    return reports.table_gate(made(t))


@query("Q41_front_matter", _sql("report_front_matter", "BLOCKER", "doc_id % 3 = 0", "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END", "0", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'review_status' END"))
def q41(t: Tables):
    return reports.front_matter_gate(made(t))


_EMPTY = "CASE WHEN regexp_matches(regexp_replace(text, '[#`\\[|]', '', 'g'), '\\S') THEN 0 ELSE 1 END"


@query(
    "Q42_Q43_Q45_headings",
    " UNION ALL ".join(
        [
            _sql("report_heading_levels", "WARN", "doc_id % 2 = 0", "doc_id % 2", "0"),
            _sql("report_duplicate_headings", "WARN", "doc_id % 2 <> 0", "1 - doc_id % 2", "0"),
            _sql("report_empty_sections", "WARN", f"{_EMPTY} = 0", _EMPTY, "0"),
        ]
    ),
)
def q42(t: Tables):
    return reports.heading_gates(made(t))


_LONG = "len(list_filter(string_split(body, chr(10)), lambda x: length(x) > 500))"


@query("Q44_Q46_lines", " UNION ALL ".join([_sql("report_unclosed_code_blocks", "WARN", "doc_id % 7 <> 0"), _sql("report_overlong_lines", "WARN", f"{_LONG} = 0", _LONG, "0")]))
def q44(t: Tables):
    return reports.line_gates(made(t))


@query("F23_report_front_matter", f"SELECT doc_id AS report_id, doc_id % 3 = 0 AS complete FROM (SELECT doc_id, {_BODY} AS body, text FROM documents)")
def f23(t: Tables):
    return reports.front_matter_gate(made(t)).select(F.col("subject").cast("long").alias("report_id"), F.col("passed").alias("complete"))
