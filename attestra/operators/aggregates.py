"""Aggregations: ratios, histograms, conflicts, concentration and frequency. Each is one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions import numbers, text
from attestra.session import written

#: How severe a verification class is.
SEVERITY = ["source_confirmed", "source_indirect", "source_absent"]


def share(condition: Column) -> Column:
    """The part of all rows for which condition holds."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def status_counts(df: DataFrame, status: Column, known: list[str]) -> DataFrame:
    """A column for each known status, others and the total."""
    s = F.lower(status)
    other = F.count(F.when(~F.coalesce(s.isin([k.lower() for k in known]), F.lit(False)), 1)).alias("other")
    return df.agg(*[F.count(F.when(s == k.lower(), 1)).alias(k.lower()) for k in known], other, F.count("*").alias("total"))


def histogram(df: DataFrame, group: list[str], kind: str) -> DataFrame:
    """Counts of kind within group, with the share of the group's total."""
    counts = df.groupBy(*group, kind).agg(F.count("*").alias("n"))
    total = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(total))


def worst_of(df: DataFrame, key: str, kind: str, order: list[str] = SEVERITY) -> DataFrame:
    """The most severe kind of each key."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(kind))
    return df.groupBy(key).agg(F.max(rank).alias("_rank")).select(key, F.get(F.array(*map(F.lit, order)), (F.col("_rank") - 1).cast("int")).alias(kind))


def exact_duplicates(df: DataFrame, value: Column, place: str, preview: int = 40) -> DataFrame:
    """Trimmed texts that stand more than once: how often, in which places, and how they begin."""
    groups = df.withColumn("_v", F.trim(value)).where("_v <> ''").groupBy("_v").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(place)).alias("places"))
    return groups.where("n > 1").select(F.left("_v", F.lit(preview)).alias("preview"), "n", F.array_join("places", ",").alias("places"))


def distinct_over(df: DataFrame, group: list[str], value: str, most: int = 1) -> DataFrame:
    """Groups with more than ``most`` distinct values."""
    return df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.countDistinct(value).alias("kinds")).where(F.col("kinds") > most)


def variance_conflicts(df: DataFrame, group: list[str], value: str, most: float = 0.05) -> DataFrame:
    """Groups of at least two values that spread by more than ``most`` of their mean."""
    stats = df.groupBy(*group).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    return stats.where((F.col("n") >= 2) & (F.col("mean") > 0) & ((F.col("high") - F.col("low")) / F.col("mean") > most))


def entity_numbers(c: Column, stop_words: list[str] = text.STOP_WORDS) -> Column:
    """(entity, number) pairs: a word of at least three letters before a number of at least two digits."""
    pattern = r"([A-Za-z][A-Za-z]{2,})\s+(?:[a-z]+\s+){0,2}?(\d[\d,]*\d)"
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("entity"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("number"))
    return F.filter(F.transform(pairs, lambda p: F.struct(F.lower(p["entity"]).alias("entity"), F.replace(p["number"], F.lit(","), F.lit("")).alias("number"))), lambda p: ~p["entity"].isin(stop_words))


def entity_conflicts(df: DataFrame, body: Column) -> DataFrame:
    """Entities that stand with more than one number."""
    pairs = df.select(F.explode(entity_numbers(body)).alias("p")).select("p.entity", "p.number").distinct()
    return pairs.groupBy("entity").agg(F.count("*").alias("numbers"), F.min("number").alias("first"), F.max("number").alias("last")).where("numbers > 1")


def concentration(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """The most frequent key of each group and its share; ties go to the smaller key."""
    counts = df.groupBy(*group, key).agg(F.count("*").alias("n"))
    best = counts.groupBy(*group).agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    first = counts.join(best, group).where("n = most").groupBy(*group, "most", "total").agg(F.min(key).alias(key))
    return first.select(*group, key, "most", "total", (F.col("most") / F.col("total")).alias("share"))


def recurring_terms(df: DataFrame, body: Column, least: int = 2, most: int = 20, stop_words: list[str] = text.STOP_WORDS) -> DataFrame:
    """The most frequent terms of four letters or more; ties by name. Counts are pre-aggregated and only the top is sorted."""
    terms = df.select(F.explode(F.regexp_extract_all(F.lower(body), F.lit(r"[a-z_][a-z0-9_]{3,}"), F.lit(0))).alias("term"))
    counts = terms.where(~F.col("term").isin(stop_words)).groupBy("term").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(most)


def line_quality(df: DataFrame, body: Column, padding: str, template: str) -> DataFrame:
    """Shares of padding and template lines among the lines that aren't blank."""
    own = F.filter(text.lines(body), lambda x: F.trim(x) != "")
    n = F.nullif(F.size(own), F.lit(0))
    return df.withColumn("padding_ratio", F.coalesce(F.size(F.filter(own, lambda x: x.rlike(padding))) / n, F.lit(0.0))).withColumn(
        "template_ratio", F.coalesce(F.size(F.filter(own, lambda x: x.rlike(template))) / n, F.lit(0.0))
    )


def fidelity(sources: DataFrame, failed: Column, chars: Column, overlap: Column, shallow: int = 2000, thin: int = 5000, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each group of ``by``: counts of failed, missing, shallow, thin and overlapping sources, their shares and the verdict.

    chars is null where no body is stored. The verdicts are tried in order; the shares are of the sources that didn't
    fail, the exempt one of all.
    """
    ok = ~failed
    count = lambda c: F.count(F.when(c, 1))
    counts = sources.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), count(failed).alias("failed"), count(ok & (F.coalesce(chars, F.lit(0)) == 0)).alias("missing"),
        count(ok & (chars > 0) & (chars < shallow)).alias("shallow"), count(ok & (chars >= shallow) & (chars < thin)).alias("thin"),
        count(ok & (chars >= shallow) & (overlap > 0.8)).alias("overlapping"),
    )
    of = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("total") - F.col("failed"), F.lit(0)), F.lit(0.0))
    exempt = F.coalesce(F.col("failed") / F.nullif("total", F.lit(0)), F.lit(0.0))
    verdict = (
        F.when(F.col("total") == F.col("failed"), "pass").when(of("missing") > 0.3, "block_missing").when(of("shallow") > 0.3, "block_shallow").when(of("overlapping") > 0.3, "block_overlap")
        .when(exempt > 0.5, "warn_exempt").when(F.col("missing") > 0, "warn_missing").when((F.col("shallow") > 0) | (F.col("thin") > 0), "warn_depth").otherwise("pass")
    )
    return counts.select("*", of("missing").alias("missing_ratio"), of("shallow").alias("shallow_ratio"), of("thin").alias("thin_ratio"), exempt.alias("exempt_ratio"), verdict.alias("verdict"))


def weighted_rank(df: DataFrame, items: Column, weight: Column) -> DataFrame:
    """Weighted frequency of the items, the heaviest first; ties by name."""
    return df.select(F.explode(items).alias("item"), weight.alias("w")).groupBy("item").agg(F.count("*").alias("n"), F.sum("w").alias("weight")).orderBy(F.desc("weight"), "item")


def pass_rates(df: DataFrame, dimension: str, passed: Column, priority: Column, least: float = 0.8) -> DataFrame:
    """Pass rate of each dimension; flagged below ``least`` or if any failure has priority P0 or P1."""
    urgent = F.max(F.when(~passed & priority.isin("P0", "P1"), 1).otherwise(0)) == 1
    out = df.groupBy(dimension).agg(F.avg(F.when(passed, 1.0).otherwise(0.0)).alias("rate"), urgent.alias("_urgent"))
    return out.select(dimension, "rate", ((F.col("rate") < least) | F.col("_urgent")).alias("flagged"))


def next_ids(existing: DataFrame, new: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """New rows numbered on from the largest id there is.

    Rows are numbered within their range partition and partitions by running totals, so no task sorts all rows. The ranged
    rows are written first: a range partition is sampled, and both the totals and the numbers must see the same one.
    """
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("top"))
    ranged = written(new.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = local.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return local.join(F.broadcast(before), "_p").join(F.broadcast(top)).withColumn(id_column, F.col("top") + F.col("before") + F.col("_k")).drop("_p", "_k", "before", "top")


def precise_values(df: DataFrame, body: Column) -> DataFrame:
    return df.withColumn("value", F.explode(numbers.values(body)))
