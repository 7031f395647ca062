"""Claim verification: whether the sources a claim cites bear it out.

Edges claim -> source are aggregated to flags of each claim and one CASE gives the class. Indirect beats confirmed
beats absent. Two rule sets differ in which source types count as a vendor's, what makes a venue of no authority, and
how a cited entity is compared with the sources' hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of evidence, source type and precision that the rules name.
EVIDENCE = ["official_data", "independent_benchmark", "third_party_estimate", "qualitative_trend", "expert_opinion"]
WEAK_EVIDENCE = ["third_party_estimate", "qualitative_trend", "expert_opinion"]
NEEDS_AUTHORITY = ["third_party_estimate", "official_data"]
VENDOR = {"v2": ["vendor_benchmark", "vendor_survey", "vendor_blog"], "v1": ["analyst_forecast", "vendor_benchmark", "vendor_survey", "vendor_blog"]}
PRECISIONS = ["exact", "range", "qualitative"]
#: Phrases that cite somebody else, with the entity as group 1.
CITING = [r"(?i)(?:according to|reported by|said by)\s+(.+?)(?:\s*[,\.]|$)", r"(?i)(.+?)\s+(?:reports?|announces?|claims?|states?)\s+that"]


def cited_entity(summary: Column) -> Column:
    """Whom a claim cites, by the first phrase that matches; null if nobody."""
    return F.coalesce(*[F.nullif(F.lower(F.trim(F.regexp_extract(summary, p, 1))), F.lit("")) for p in CITING])


def entity_on_host(entity: Column, host: Column, ruleset: str = "v2") -> Column:
    """v2: the host is, begins or ends with the entity; v1: one of the host's labels is the entity."""
    if ruleset == "v2":
        return (host == entity) | host.startswith(entity) | host.endswith(entity)
    return F.array_contains(F.split(host, r"\."), F.regexp_replace(entity, r"[.,;:)]+$", ""))


def edge_flags(edges: DataFrame) -> DataFrame:
    """edges(cid, tier, supports[, host_matches]) -> flags of each claim."""
    matches = F.bool_or(F.coalesce("host_matches", F.lit(False))) if "host_matches" in edges.columns else F.lit(None).cast("boolean")
    return edges.groupBy("cid").agg(
        F.coalesce(F.bool_or(F.col("tier") >= 3), F.lit(False)).alias("some_low"), F.coalesce(F.bool_or(F.col("tier") <= 2), F.lit(False)).alias("some_high"),
        F.coalesce(F.bool_or("supports"), F.lit(False)).alias("supported"), matches.alias("host_matches"), F.count("*").alias("n_sources"),
    )


def classified(claims: DataFrame, flags: DataFrame, ruleset: str = "v2") -> DataFrame:
    """claims(cid, ev, pr, st, has_number[, entity]) x flags -> claims with n_sources, source_verification, verified."""
    on = claims.join(flags, "cid", "left")
    low, high, hit = (F.coalesce(c, F.lit(False)) for c in ("some_low", "some_high", "supported"))
    venue = low if ruleset == "v2" else ~high
    vendor = F.coalesce(F.col("st").isin(VENDOR[ruleset]) & F.col("pr").isin("exact", "range"), F.lit(False)) & venue
    needs = F.coalesce(F.col("ev").isin(NEEDS_AUTHORITY), F.lit(False)) & low
    elsewhere = (F.col("entity").isNotNull() & ~F.coalesce("host_matches", F.lit(False))) if "entity" in claims.columns else F.lit(False)
    sv = F.when(needs | vendor | elsewhere, "source_indirect").when(hit | ~F.col("has_number"), "source_confirmed").otherwise("source_absent")
    out = on.withColumn("source_verification", sv).withColumn("verified", F.col("source_verification") != "source_absent").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
    return out.drop("some_low", "some_high", "supported", "host_matches")
