"""Append-only Markdown logs: notepads, observation logs and to-do lists, read as tables and only ever appended to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.sources.documents import read_whole

#: The notepads there are, and the fields of an observation.
CATEGORIES = ["learnings", "decisions", "issues", "problems", "conventions"]
FIELDS = ["Status", "Session", "Skill", "Type", "Issue", "Improvement", "Principle"]


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Notepad files under root -> (path, category, pos, ts, task, body): entries begin with ## [time] Task: id."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), "value")
    parts = files.select("path", F.posexplode(F.split("value", r"(?m)^(?=## \[)")).alias("pos", "part")).where(F.col("part").startswith("## ["))
    head = r"^## \[([^\]]*)\]\s*(?:Task:\s*(.*))?"
    return parts.select(
        "path", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("category"), "pos", F.try_to_timestamp(F.regexp_extract("part", head, 1), F.lit("yyyy-MM-dd HH:mm")).alias("ts"),
        F.trim(F.regexp_extract("part", head, 2)).alias("task"), F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"),
    )


def retrieve(df: DataFrame, topic: str, category: str | None = None) -> DataFrame:
    """Entries whose body contains the topic in any case, of one category if named."""
    found = df.where(F.contains(F.lower("body"), F.lit(topic.lower())))
    return found.where(F.col("category") == category) if category else found


def observations(spark: SparkSession, path: str) -> DataFrame:
    """An observation log -> (num, title, status, fields, body): entries begin with ### Observation n."""
    parts = read_whole(spark, path).select(F.explode(F.split("raw", r"(?m)^(?=### Observation \d+)")).alias("part")).where(F.col("part").rlike(r"^### Observation \d+"))
    field = lambda k: F.trim(F.regexp_extract("part", rf"(?m)^\*\*{k}:\*\*\s*(.*)$", 1))
    return parts.select(
        F.regexp_extract("part", r"^### Observation (\d+)", 1).cast("long").alias("num"), F.trim(F.regexp_extract("part", r"^### Observation \d+:?[ \t]*(.*)", 1)).alias("title"),
        *[field(k).alias(k.lower()) for k in FIELDS], F.col("part").alias("body"),
    )


def entry_text(num: Column, title: Column, fields: dict[str, Column]) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("### Observation "), num.cast("string"), F.lit(": "), title), *[F.concat(F.lit(f"**{k}:** "), v) for k, v in fields.items()])


def todo_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, done, text, quadrant, someday, doing, delegated) of - [ ] lines; a quadrant heading holds until the next."""
    from pyspark.sql.window import Window

    lines = read_whole(spark, path).select("path", F.posexplode(F.split("raw", "\n", -1)).alias("pos", "line"))
    heading = F.when(F.col("line").rlike(r"^#+\s"), F.trim(F.regexp_replace("line", r"^#+\s+", "")))
    lines = lines.withColumn("quadrant", F.last(heading, ignorenulls=True).over(Window.partitionBy("path").orderBy("pos")))
    items = lines.where(F.col("line").rlike(r"^\s*- \[[ xX]\]"))
    tag = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    return items.select(
        "path", "pos", F.lower("line").rlike(r"^\s*- \[x\]").alias("done"), F.trim(F.regexp_replace("line", r"^\s*- \[[ xX]\]", "")).alias("text"), "quadrant",
        F.call_function("try_to_date", tag(r"\[someday:([^\]]+)\]")).alias("someday"), F.contains("line", F.lit("[doing]")).alias("doing"), tag(r"\[delegated:([^\]]+)\]").alias("delegated"),
    )
