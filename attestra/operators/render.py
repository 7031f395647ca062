"""Rendering of reports as Markdown, for many workspaces at once: rows with an order become one string each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The mark of each verification class, and the order of the summary's rows.
MARKS = {"source_absent": "‡", "source_indirect": "†"}
CLASSES = ["source_confirmed", "source_indirect", "source_absent"]


def joined(df: DataFrame, group: list[str], order: list[str], line: str, by: str = "\n", name: str = "body") -> DataFrame:
    """The lines of each group in order, as one string."""
    own = F.sort_array(F.collect_list(F.struct(*order, F.col(line).alias("_line"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(own, lambda x: x["_line"]), by).alias(name))


def front_matter(fields: list[tuple[str, Column]]) -> Column:
    """name: value lines between rules; null values are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def mark(sv: Column) -> Column:
    return F.when(sv == "source_absent", MARKS["source_absent"]).when(sv == "source_indirect", MARKS["source_indirect"]).otherwise("")


def claim_line(summary: Column, sv: Column, numbers: Column) -> Column:
    """- claim, its mark, and its reference numbers as [n][]."""
    return F.concat(F.lit("- "), summary, mark(sv), F.array_join(F.transform(numbers, lambda n: F.concat(F.lit(" ["), n.cast("string"), F.lit("][]"))), ""))


def sections(claims: DataFrame, compact: Column | None = None) -> DataFrame:
    """claims(ws, sec, sec_order, cid, line) -> (ws, body): a heading for each section and a line for each claim.

    compact (a condition on a row) leaves the claims of a workspace out and keeps the headings.
    """
    shown = claims.withColumn("line", F.when(compact, F.lit(None)).otherwise(F.col("line"))) if compact is not None else claims
    bodies = joined(shown.where("line IS NOT NULL"), ["ws", "sec_order", "sec"], ["cid"], "line")
    heads = claims.select("ws", "sec_order", "sec").distinct().join(bodies, ["ws", "sec_order", "sec"], "left")
    text = heads.withColumn("text", F.concat(F.lit("## "), "sec", F.lit("\n\n"), F.coalesce("body", F.lit(""))))
    return joined(text, ["ws"], ["sec_order", "sec"], "text", "\n\n")


def verification_table(classified: DataFrame) -> DataFrame:
    """classified(ws, sv) -> (ws, body): counts and shares of the classes, in fixed order, as a table."""
    n = classified.groupBy("ws").agg(F.count("*").alias("total"), *[F.count(F.when(F.col("sv") == c, 1)).alias(c) for c in CLASSES])
    percent = lambda c: F.concat(F.round(100 * F.col(c) / F.col("total")).cast("int").cast("string"), F.lit("%"))
    rows = [F.concat(F.lit(f"| {c} | "), F.col(c).cast("string"), F.lit(" | "), percent(c), F.lit(" |")) for c in CLASSES]
    return n.select("ws", F.concat_ws("\n", F.lit("| class | claims | share |"), F.lit("|---|---|---|"), *rows).alias("body"))


def conditions_table(claims: DataFrame) -> DataFrame:
    """claims(ws, cid, summary, conditions, date, kind): a row for each claim with any of the three."""
    some = claims.where("conditions IS NOT NULL OR date IS NOT NULL OR kind IS NOT NULL")
    cell = lambda c: F.coalesce(c, F.lit("-"))
    lines = some.withColumn("line", F.concat(F.lit("| "), "summary", F.lit(" | "), cell("conditions"), F.lit(" | "), cell("date"), F.lit(" | "), cell("kind"), F.lit(" |")))
    return joined(lines, ["ws"], ["cid"], "line")


def references(numbered: DataFrame, known: DataFrame) -> DataFrame:
    """numbered(ws, src, number) x known(src, title, tier): the reference list; unknown sources are named by their key."""
    on = numbered.join(known, "src", "left")
    title = F.coalesce("title", F.col("src").cast("string"))
    lines = on.withColumn("line", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), title, F.coalesce(F.concat(F.lit(" (Tier "), F.col("tier").cast("string"), F.lit(")")), F.lit(""))))
    return joined(lines, ["ws"], ["number"], "line")


def checklist(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """questions(ws, question) with a tick or a cross."""
    on = questions.join(answered.select("ws", "question", F.lit(True).alias("yes")).distinct(), ["ws", "question"], "left")
    lines = on.withColumn("line", F.concat(F.when(F.col("yes"), "✓ ").otherwise("✗ "), F.lit("Q"), F.col("question").cast("string")))
    return joined(lines, ["ws"], ["question"], "line")
