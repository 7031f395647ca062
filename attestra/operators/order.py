"""Order-dependent operators: windows over a document's own lines, turns or marks. Windows are partitioned by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_seen_rank(df: DataFrame, document: list[str], key: str, order: list[str]) -> DataFrame:
    """Keys of each document numbered by first appearance."""
    first = df.groupBy(*document, key).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(*document).orderBy("_first", key))).drop("_first")


def level_skips(df: DataFrame, document: list[str], level: str, order: list[str]) -> DataFrame:
    """Rows whose level is more than one deeper than the row before."""
    before = F.lag(level).over(Window.partitionBy(*document).orderBy(*order))
    return df.withColumn("previous", before).where(F.col(level) > F.col("previous") + 1)


def segments(df: DataFrame, document: list[str], header: Column, order: str) -> DataFrame:
    """[header, next header) of each header row: first, next (null at the end) and how many rows lie between."""
    heads = df.withColumn("_h", header)
    total = F.max(order).over(Window.partitionBy(*document))
    heads = heads.withColumn("_end", total + 1).where("_h")
    nxt = F.lead(order).over(Window.partitionBy(*document).orderBy(order))
    return heads.withColumn("next", nxt).withColumn("body_rows", F.coalesce("next", "_end") - F.col(order) - 1).drop("_h", "_end")


def adjacent_dedup(df: DataFrame, document: list[str], values: list[str], text: str, order: list[str]) -> DataFrame:
    """Rows with text that differ in any of values from the row with text before them."""
    w = Window.partitionBy(*document).orderBy(*order)
    rows = df.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    now, before = F.struct(*values), F.lag(F.struct(*values)).over(w)
    return rows.withColumn("_same", F.coalesce(now == before, F.lit(False))).where("NOT _same").drop("_same")


def by_root_author(df: DataFrame, document: list[str], author: str, order: list[str]) -> DataFrame:
    """Rows by the author of the first row; a blank first author keeps all."""
    root = F.first(author).over(Window.partitionBy(*document).orderBy(*order))
    return df.withColumn("_root", root).where((F.coalesce("_root", F.lit("")) == "") | (F.col(author) == F.col("_root"))).drop("_root")


def repeated(df: DataFrame, document: list[str], key: list[str]) -> DataFrame:
    """Keys that stand more than once in a document."""
    return df.groupBy(*document, *key).agg(F.count("*").alias("n")).where("n > 1")


def precedence(explicit: Column, canonical: Column, name: Column) -> list[Column]:
    """Sort keys: explicit integers first, then the canonical position, then the name."""
    return [F.when(explicit.isNotNull(), 0).when(canonical.isNotNull(), 1).otherwise(2), F.coalesce(explicit, canonical, F.lit(0)), name]


def priority_top(df: DataFrame, group: list[str], priority: str, order: list[Column], most: int, allowed: list[str]) -> DataFrame:
    """The first ``most`` rows of each group by allowed priority (in that order), then by order."""
    rank = F.array_position(F.array(*map(F.lit, allowed)), F.col(priority))
    w = Window.partitionBy(*group).orderBy(rank, *order)
    return df.where(F.col(priority).isin(allowed)).withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def mentioned_lines(df: DataFrame, document: str, body: str) -> DataFrame:
    """(document, pos, line) of a text column; pos from 0."""
    return df.select(document, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n", -1)).alias("pos", "line"))


def unchanged_stop(df: DataFrame, document: list[str], count: str, order: str, times: int) -> DataFrame:
    """Where a count has stayed the same ``times`` times in a row for the first time."""
    w = Window.partitionBy(*document).orderBy(order)
    same = df.withColumn("_s", F.coalesce(F.col(count) == F.lag(count).over(w), F.lit(False)).cast("int"))
    run = same.withColumn("_run", F.sum("_s").over(w.rowsBetween(1 - times, 0)))
    return run.where(F.col("_run") == times).groupBy(*document).agg(F.min(order).alias("stop"))
