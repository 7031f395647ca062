"""Checks on rendered Markdown reports. Each takes reports(report_id, body) and gives one gate row for each report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions import text

GATE = ["gate", "subject", "level", "passed", "metric", "threshold", "detail"]


def row(gate: str, subject: Column, level: str, passed: Column, metric: Column | None = None, threshold: float | None = None, detail: Column | None = None) -> list[Column]:
    """The columns of a gate row: passed with the figure that was compared and its bound."""
    return [
        F.lit(gate).alias("gate"), subject.cast("string").alias("subject"), F.lit(level).alias("level"), passed.alias("passed"),
        (F.lit(None) if metric is None else metric).cast("double").alias("metric"), F.lit(threshold).cast("double").alias("threshold"),
        (F.lit("") if detail is None else F.coalesce(detail, F.lit(""))).alias("detail"),
    ]


def split_references(body: Column) -> tuple[Column, Column]:
    """(text, reference section): cut at the last heading that begins the references; null where there is none."""
    at = F.length(body) - F.locate("secnerefeR ##", F.reverse(body)) - len("## References") + 2
    has = F.contains(body, F.lit("## References"))
    return F.when(has, F.substring(body, F.lit(1), at - 1)), F.when(has, F.substring(body, at, F.length(body)))


def _numbers(c: Column, pattern: str) -> Column:
    return F.transform(F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.array().cast("array<string>")), lambda x: x.cast("int"))


def cited(body: Column) -> Column:
    """Numbers cited in the text: [n] and [n][], with or without a mark."""
    return F.array_distinct(_numbers(body, r"\[(\d{1,3})[†‡]?\](?!\()"))


def defined(references: Column) -> Column:
    return F.array_distinct(_numbers(references, r"\[(\d+)\]"))


def citation_gates(reports: DataFrame, id_column: str = "report_id") -> DataFrame:
    """report_dangling_refs and report_orphaned_defs: pass without a reference section."""
    body, refs = split_references(F.col("body"))
    sides = reports.select(id_column, cited(body).alias("c"), defined(refs).alias("d"))
    out = []
    for gate, extra in (("report_dangling_refs", F.array_except("c", "d")), ("report_orphaned_defs", F.array_except("d", "c"))):
        n = F.coalesce(F.size(extra), F.lit(0))
        out.append(sides.select(*row(gate, F.col(id_column), "BLOCKER", F.coalesce(F.size(extra) <= 0, F.lit(True)), n, 0, F.array_join(F.sort_array(extra), ","))))
    return out[0].unionByName(out[1])


def visibility_gate(reports: DataFrame, id_column: str = "report_id") -> DataFrame:
    """Hidden definitions without a visible list."""
    _, refs = split_references(F.col("body"))
    lines = F.split(refs, "\n", -1)
    hidden, seen = F.exists(lines, lambda x: x.rlike(r"^\[\d+\]:\s*\S")), F.exists(lines, lambda x: x.rlike(r"^(?:[-*]\s+|\d+\.\s+)?\[\d+\][^:]"))
    return reports.select(*row("report_refs_visibility", F.col(id_column), "WARN", F.coalesce(~(hidden & ~seen), F.lit(True))))


def body_lines(reports: DataFrame, id_column: str, body: str = "body") -> DataFrame:
    return reports.select(id_column, F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))


def table_mismatches(reports: DataFrame, id_column: str, body: str = "body") -> DataFrame:
    """Table headers whose next line that isn't blank is a delimiter row with another number of bars."""
    rows = body_lines(reports, id_column, body).withColumn("line", F.trim("line")).where("line <> ''")
    delimiter = r"^[\s|:-]+$"
    bars = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))).cast("int")
    rows = rows.withColumn("next", F.lead("line").over(Window.partitionBy(id_column).orderBy("pos")))
    heads = rows.where(F.contains("line", F.lit("|")) & ~F.col("line").rlike(delimiter) & F.col("next").rlike(delimiter))
    return heads.select(id_column, "pos", bars(F.col("line")).alias("header"), bars(F.col("next")).alias("delimiter")).where("header <> delimiter")


def without_front_matter(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\A---(?:.*?)\n---[ \t]*(?=\n|\z)", "")


def headings(reports: DataFrame, id_column: str = "report_id") -> DataFrame:
    """(id, pos, level, text, next): headings of each report after its front matter, and where the next stands."""
    rows = body_lines(reports.withColumn("body", without_front_matter(F.col("body"))), id_column)
    found = rows.where(F.col("line").rlike(r"^#{1,6}\s+.+$"))
    return found.select(
        id_column, "pos", F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)).alias("level"), F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)).alias("text")
    )


def _counted(reports: DataFrame, found: DataFrame, gate: str, id_column: str, level: str = "WARN") -> DataFrame:
    """A gate that passes where nothing was found."""
    n = found.groupBy(id_column).agg(F.count("*").alias("n"))
    on = reports.select(id_column).join(n, id_column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return on.select(*row(gate, F.col(id_column), level, F.col("n") == 0, F.col("n"), 0))


def heading_gates(reports: DataFrame, id_column: str = "report_id") -> DataFrame:
    """report_heading_levels, report_duplicate_headings and report_empty_sections."""
    heads = headings(reports, id_column)
    w = Window.partitionBy(id_column).orderBy("pos")
    skips = heads.withColumn("before", F.lag("level").over(w)).where("level > before + 1")
    twice = heads.groupBy(id_column, "level", "text").agg(F.count("*").alias("k")).where("k > 1")
    lines = body_lines(reports.withColumn("body", without_front_matter(F.col("body"))), id_column)
    marked = lines.withColumn("head", F.col("line").rlike(r"^#{1,6}\s+.+$")).withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    empty = marked.where("section > 0").groupBy(id_column, "section").agg(F.max(F.when(~F.col("head") & (F.trim("line") != ""), 1).otherwise(0)).alias("filled")).where("filled = 0")
    return (
        _counted(reports, skips, "report_heading_levels", id_column)
        .unionByName(_counted(reports, twice, "report_duplicate_headings", id_column))
        .unionByName(_counted(reports, empty, "report_empty_sections", id_column))
    )


#: What a report's front matter must name.
FRONT_MATTER = ["topic", "goal_type", "date", "review_status"]


def front_matter_gate(reports: DataFrame, id_column: str = "report_id") -> DataFrame:
    own = F.regexp_extract("body", r"(?s)\A---(.*?)\n---[ \t]*(?:\n|\z)", 1)
    lacking = F.filter(F.array(*map(F.lit, FRONT_MATTER)), lambda f: ~F.regexp(own, F.concat(F.lit("(?m)^"), f, F.lit(r"\s*:"))))
    return reports.select(*row("report_front_matter", F.col(id_column), "BLOCKER", (own != "") & (F.size(lacking) == 0), F.size(lacking), 0, F.array_join(lacking, ",")))


def line_gates(reports: DataFrame, id_column: str = "report_id", most: int = 500) -> DataFrame:
    """report_unclosed_code_blocks and report_overlong_lines."""
    body = without_front_matter(F.col("body"))
    fences = reports.select(*row("report_unclosed_code_blocks", F.col(id_column), "WARN", ~text.open_fence(body)))
    over = text.overlong_lines(F.col("body"), most)
    return fences.unionByName(reports.select(*row("report_overlong_lines", F.col(id_column), "WARN", over == 0, over, 0)))


def table_gate(reports: DataFrame, id_column: str = "report_id") -> DataFrame:
    return _counted(reports, table_mismatches(reports, id_column), "report_table_delimiters", id_column)


def all_gates(reports: DataFrame, id_column: str = "report_id") -> DataFrame:
    """All ten checks of every report as one relation."""
    return (
        citation_gates(reports, id_column).unionByName(visibility_gate(reports, id_column)).unionByName(table_gate(reports, id_column)).unionByName(front_matter_gate(reports, id_column))
        .unionByName(heading_gates(reports, id_column)).unionByName(line_gates(reports, id_column))
    )
