"""Join-shaped operators: look-ups, anti-joins, division, and theta joins turned into equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions import urls
from attestra.functions.text import bound


def keep_last(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The last row of each key; blank or null keys go. The window's rank filter prunes before the shuffle."""
    w = Window.partitionBy("_key").orderBy(*[o.desc_nulls_last() for o in order])
    rows = df.withColumn("_key", key).where("_key IS NOT NULL AND CAST(_key AS STRING) <> ''")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_key")


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    w = Window.partitionBy("_key").orderBy(*[o.asc_nulls_last() for o in order])
    return df.withColumn("_key", key).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_key")


def missing(refs: DataFrame, known: DataFrame, on: list[str] | str) -> DataFrame:
    """References without a known counterpart (anti-join)."""
    return refs.join(known, on, "left_anti")


def uncovered(required: DataFrame, present: DataFrame, on: list[str] | str) -> DataFrame:
    """Relational division as an anti-join: the required values without any row. Empty means that all are covered."""
    return required.distinct().join(present, on, "left_anti")


def with_default(left: DataFrame, right: DataFrame, on: str, column: str, default) -> DataFrame:
    return left.join(right.select(on, column), on, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def domain_tier(pages: DataFrame, tiers: DataFrame, url: str = "url", miss: int | None = 3, last_wins: bool = True) -> DataFrame:
    """pages x tiers(ord, domain, tier): the tier of the domain that a page's host is or ends in.

    Hosts are exploded into their suffixes, so the suffix test is an equi-join. Of several matches the first in the
    table's order counts; a domain listed twice has its last tier (last_wins) or its first.
    """
    one = keep_last(tiers, F.col("domain"), [F.col("ord")]) if last_wins else keep_first(tiers, F.col("domain"), [F.col("ord")])
    hosts = pages.select(urls.host(F.col(url)).alias("_host")).distinct()
    matched = hosts.select("_host", F.explode(urls.host_suffixes(F.col("_host"))).alias("domain")).join(one, "domain")
    best = matched.groupBy("_host").agg(F.min_by("tier", "ord").alias("tier"))
    return pages.withColumn("_host", urls.host(F.col(url))).join(best, "_host", "left").withColumn("tier", F.coalesce("tier", F.lit(miss).cast("int"))).drop("_host")


def prefix_suggestions(wanted: DataFrame, known: DataFrame, length: int = 40, most: int = 3) -> DataFrame:
    """wanted(url) x known(known): up to ``most`` known URLs that share the first ``length`` characters, by name.

    A known URL begins with the first characters of a wanted one, or the wanted begins with those of the known one. Both
    long enough: an equi-join on the prefix. One of them shorter: its whole self is a prefix of the other, which is an
    equi-join on that length; there are at most ``length`` such lengths. A prefix that many known URLs have keeps its
    first ``most`` before the join, as no more of them can be suggested.
    """
    a = wanted.select("url").distinct()
    b = known.select("known").distinct()
    pa = a.select("url", F.explode(_prefixes(F.col("url"), length)).alias("p"))
    pb = b.select("known", F.explode(_prefixes(F.col("known"), length)).alias("p"))
    first = F.row_number().over(Window.partitionBy("p").orderBy("known"))
    leading = lambda df: df.withColumn("_r", first).where(F.col("_r") <= most).drop("_r")
    whole_a, whole_b = a.select("url", F.left("url", F.lit(length)).alias("p")), b.select("known", F.left("known", F.lit(length)).alias("p"))
    pairs = whole_a.join(leading(pb), "p").select("url", "known").union(pa.join(leading(whole_b), "p").select("url", "known")).distinct()
    w = Window.partitionBy("url").orderBy("known")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _prefixes(c: Column, length: int) -> Column:
    """Its prefixes of up to ``length`` characters that may equal another's cut-off prefix."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length(c), F.lit(length)), F.lit(1))), lambda n: F.substring(c, F.lit(1), n))


def two_way_diff(planned: DataFrame, actual: DataFrame, on: str) -> DataFrame:
    """(planned_only, actual_only, planned, deviation) of two id lists."""
    both = planned.select(on, F.lit(1).alias("p")).distinct().join(actual.select(on, F.lit(1).alias("a")).distinct(), on, "full_outer")
    out = both.agg(
        F.count(F.when(F.col("a").isNull(), 1)).alias("planned_only"), F.count(F.when(F.col("p").isNull(), 1)).alias("actual_only"), F.count("p").alias("planned")
    )
    return out.withColumn("deviation", (F.col("planned_only") + F.col("actual_only")) / F.nullif("planned", F.lit(0)))


def upsert(base: DataFrame, updates: DataFrame, on: str, columns: list[str], keep_if_null: list[str] = ()) -> DataFrame:
    """base with the columns of the matching update; those in keep_if_null change only to a value."""
    new = updates.select(on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = base.join(new, on, "left")
    for c in columns:
        value = F.coalesce(f"_new_{c}", c) if c in keep_if_null else F.col(f"_new_{c}")
        out = out.withColumn(c, F.when(F.col("_hit"), value).otherwise(F.col(c)))
    return out.select(*base.columns)


def overlap_ratio(body: Column, snippet: Column) -> Column:
    """Share of the body's words (characters, if the snippet has CJK) that the snippet has too; 0 without either.

    Both are split once. Each word that both have is counted by one search of the body, its words written between marks.
    """
    trimmed = lambda c: F.lower(F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit("\ufdd0")), r"(?U)^\s+|\s+$", ""))
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    chars = lambda c: F.filter(F.split(F.regexp_replace(c, r"(?U)\s+", ""), ""), lambda w: w != "")
    mark = F.lit("\x00")

    def split(x: Column) -> Column:
        cjk = x["s"].rlike(r"[一-鿿]")
        return F.struct(F.when(cjk, chars(x["b"])).otherwise(words(x["b"])).alias("b"), F.when(cjk, chars(x["s"])).otherwise(words(x["s"])).alias("s"))

    def met(x: Column) -> Column:
        return F.struct(F.concat(mark, F.array_join(x["b"], "\x00\x00"), mark).alias("text"), F.array_intersect(x["b"], x["s"]).alias("both"), F.size(x["b"]).alias("n"))

    def share(x: Column) -> Column:
        size = F.octet_length
        times = lambda w: ((size(x["text"]) - size(F.replace(x["text"], F.concat(mark, w, mark), F.lit("")))) / (size(w) + 2)).cast("long")
        return F.coalesce(F.aggregate(x["both"], F.lit(0).cast("long"), lambda n, w: n + times(w)) / F.nullif(x["n"], F.lit(0)), F.lit(0.0))

    return bound(bound(bound(F.struct(trimmed(body).alias("b"), trimmed(snippet).alias("s")), split), met), share)
