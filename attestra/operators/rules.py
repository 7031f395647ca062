"""Small rules that several gates share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard_present(names: Column, section: Column) -> Column:
    """One of the file names contains the section's id."""
    return F.exists(names, lambda n: F.contains(n, section))


def joined_first(value: Column, most: int, ellipsis: str = " …", by: str = "; ") -> Column:
    """The first ``most`` distinct values in order as one string, with an ellipsis if there are more (an aggregate)."""
    own = F.sort_array(F.collect_set(value))
    return F.concat(F.array_join(F.slice(own, 1, most), by), F.when(F.size(own) > most, ellipsis).otherwise(""))


def fix_summary(report: DataFrame, listed: DataFrame) -> DataFrame:
    """report(issue, status) x listed(issue, severity): fixed and left blockers and left warnings; unknown issues are blockers."""
    on = report.join(listed, "issue", "left").withColumn("severity", F.coalesce("severity", F.lit("BLOCKER")))
    count = lambda c: F.count(F.when(c, 1))
    blocker, fixed = F.col("severity") == "BLOCKER", F.col("status") == "fixed"
    return on.agg(count(blocker & fixed).alias("blocker_fixed"), count(blocker & ~fixed).alias("blocker_skipped"), count(~blocker & ~fixed).alias("warn_skipped"))


def until(lines: Column, stop: str) -> Column:
    """The lines before the first that matches stop."""
    at = F.array_position(F.transform(lines, lambda x: x.rlike(stop)), True)
    return F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)
