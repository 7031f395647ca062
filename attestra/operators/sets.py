"""Set operators: two-way differences, conserving splits and order-keeping unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dangling_and_orphaned(cited: DataFrame, defined: DataFrame, on: list[str]) -> DataFrame:
    """Cited without a definition (dangling) and defined without a citation (orphaned)."""
    a = cited.select(*on).distinct().join(defined.select(*on), on, "left_anti").withColumn("side", F.lit("dangling"))
    b = defined.select(*on).distinct().join(cited.select(*on), on, "left_anti").withColumn("side", F.lit("orphaned"))
    return a.unionByName(b)


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for which condition holds, all other rows); null counts as not. Together they are df."""
    yes = F.coalesce(condition, F.lit(False))
    return df.where(yes), df.where(~yes)


def split_counts(df: DataFrame, condition: Column) -> DataFrame:
    """How many rows are archived, kept and there were; conserved says that none got lost."""
    yes = F.coalesce(condition, F.lit(False))
    out = df.agg(F.count(F.when(yes, 1)).alias("archived"), F.count(F.when(~yes, 1)).alias("kept"), F.count("*").alias("total"))
    return out.withColumn("conserved", F.col("archived") + F.col("kept") == F.col("total"))
