"""Operator 1: URL filters. A blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a canonical URL (host without scheme, lower-cased, and path); it covers its host, all
subdomains, and every path that starts with its own. A page is looked up under each (host suffix, path
prefix of a listed length). Those keys first probe the blocked Bloom filter: one block of eight 64-bit words
for each key, one bit a word, so a probe is one hash join against a table of bounded size. What passes goes on
to an exact join with the list, so the filter's false positives never reach the result.

Only DataFrame functions are used. The filter has at most ``max_filter_mb``; a longer list makes it less
selective, never wrong. The list itself is joined as Spark sees fit and may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.words import ascii_lower

WORDS = 8
BITS_PER_KEY = 16
#: Tasks that the rows of one URL, and those without one, are dealt out to.
SALTS, NULLS = 8, 4096


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("long")


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the block, from a second hash."""
    second = F.xxhash64(key, F.lit("bits"))
    places = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """keys(key) -> blocks(block, w0..w7): at most n_blocks rows, whatever the number of keys."""
    parts = keys.select(_block(F.col("key"), n_blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    return parts.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def listed_matches(urls: DataFrame, listed: DataFrame, max_filter_mb: int = 64) -> DataFrame:
    """urls(url) distinct, listed(host, path, ...) -> url with the listed entry's columns, for each entry that covers it."""
    entries = listed.withColumn("key", F.concat("host", "path")).withColumnsRenamed({"host": "l_host", "path": "l_path"})
    facts = entries.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("l_path"))).alias("lengths")).first()
    n_blocks = max(1, min(facts["n"] * BITS_PER_KEY // (64 * WORDS) + 1, max_filter_mb * 2**20 // (8 * (WORDS + 1))))
    blocks = bloom_blocks(entries.select("key"), n_blocks)

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.lit(facts["lengths"] or [0]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.array_distinct(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))
    probes = (
        urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .where("host <> ''")
        .select("url", F.explode(keys).alias("key"))
    )
    hits = (
        probes.withColumn("block", _block(F.col("key"), n_blocks))
        .join(F.broadcast(blocks), "block")  # bounded by max_filter_mb
        .where(_all(F.col(f"w{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(F.col("key")))))
        .select("url", "key")
    )
    return hits.join(entries, "key")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame, max_filter_mb: int = 64) -> DataFrame:
    """Judge every row of pages(url, ...).

    rules(host, path, verdict): the longest rule that covers the URL decides. listed(host, path): a URL without a
    rule is blocked if a listed entry covers it, else allowed. Adds host, path, rule, verdict and listed (the
    longest covering entry, or null).

    Null URLs and URLs without :// have empty host and path, match nothing and are allowed. Repeated rows each
    keep their row. Empty lists allow everything; an empty table gives an empty result. Other columns of pages
    are kept, save ones with the names of the added columns, which are replaced.
    """
    added = ["host", "path", "rule", "verdict", "listed"]
    pages = pages.drop(*added)
    both = rules.select("host", "path", F.lower("verdict").alias("_v"), F.lit(1).alias("_rule")).unionByName(
        listed.select("host", "path", F.lit("block").alias("_v"), F.lit(0).alias("_rule"))
    )
    found = listed_matches(pages.select("url").where("url is not null").distinct(), both, max_filter_mb)
    longest = F.struct(F.length("key").alias("n"), F.length("l_host").alias("h"), F.col("key").alias("key"), F.col("_v").alias("v"))
    judged = found.groupBy(F.col("url").alias("_url")).agg(
        F.max(F.when(F.col("_rule") == 1, longest)).alias("_r"), F.max(F.when(F.col("_rule") == 0, longest)).alias("_l")
    )
    # a URL that a third of all rows may have is dealt out by a salt, and null ones, which match nothing, by another
    at = F.monotonically_increasing_id()
    dealt = pages.withColumn("_salt", F.pmod(at, F.lit(SALTS)).cast("int")).withColumn("_key", F.coalesce("url", F.concat(F.lit("\0"), F.pmod(at, F.lit(NULLS)))))
    repeated = judged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("_url", "_key")
    return dealt.join(repeated, ["_key", "_salt"], "left").select(
        *pages.columns,
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("_r.key").alias("rule"),
        F.coalesce(F.col("_r.v"), F.when(F.col("_l").isNotNull(), "block"), F.lit("allow")).alias("verdict"),
        F.col("_l.key").alias("listed"),
    )
