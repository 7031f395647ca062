"""Repair of loosely typed records: aliases, defaults, downgrades and source filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.jsons import coerced
from attestra.operators.verification import EVIDENCE, PRECISIONS, WEAK_EVIDENCE

#: The keys that sections and claims keep.
SECTION_KEYS = ["id", "title", "content", "claims", "depth_strategy", "key_insights", "tensions", "order"]
CLAIM_KEYS = ["summary", "sources", "evidence_type", "confidence", "precision", "metric_type", "source_metadata", "verified", "source_verification"]
KEY_ALIASES = {"section_id": "id", "text": "summary", "source_urls": "sources"}
#: What loose names of evidence and source types stand for.
EVIDENCE_ALIASES = {
    "blog": "third_party_estimate", "post": "third_party_estimate", "article": "third_party_estimate",
    "opinion": "expert_opinion", "commentary": "expert_opinion", "independent_test": "independent_benchmark",
}
CONFIDENCES = ["high", "medium", "low"]
SOURCE_TYPES = ["official_report", "independent_test", "production_case", "survey", "vendor_benchmark", "analyst_forecast", "vendor_survey", "vendor_blog"]
#: What loose names of source types stand for.
SOURCE_ALIASES = {
    "independent_benchmark": "independent_test", "benchmark": "independent_test", "official": "official_report", "production": "production_case",
    "peer_reviewed_study": "official_report", "peer_reviewed_paper": "official_report", "peer_reviewed_technical_report": "official_report", "academic_paper": "official_report",
    "technical_report": "official_report", "research_paper": "official_report", "industry_analysis": "analyst_forecast", "industry_guide": "analyst_forecast",
    "news_report": "analyst_forecast", "government_media": "analyst_forecast", "expert_quoted_in_media": "analyst_forecast", "official_repository": "vendor_blog",
    "official_documentation": "vendor_blog", "official_pricing_page": "vendor_blog", "company_disclosure_via_journalist": "vendor_blog", "encyclopedia": "survey",
    "platform_data": "survey", "international_organization_report": "survey",
}
#: The enumerations of a claim: (valid values, aliases, what anything else becomes).
ENUMS = {
    "evidence_type": (EVIDENCE, EVIDENCE_ALIASES, "qualitative_trend"),
    "confidence": (CONFIDENCES, {}, "medium"),
    "precision": (PRECISIONS, {}, "qualitative"),
    "source_type": (SOURCE_TYPES, SOURCE_ALIASES, "survey"),
}


def enumerated(df: DataFrame) -> DataFrame:
    """Each column of ENUMS that df has, coerced; null, which stands for a missing key, stays null."""
    return df.withColumns({c: coerced(F.col(c), *rule) for c, rule in ENUMS.items() if c in df.columns})


def whitelisted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in keys])


def aliased(df: DataFrame, aliases: dict[str, str] = KEY_ALIASES) -> DataFrame:
    """The old name's value where the new one has none; old names go."""
    for old, new in aliases.items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(new, old) if new in df.columns else F.col(old)).drop(old)
    return df


def filled(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(c, F.lit(v)))
    return df


def downgraded(precision: Column, evidence: Column) -> Column:
    """exact with weak evidence is a range."""
    return F.when((precision == "exact") & evidence.isin(WEAK_EVIDENCE), "range").otherwise(precision)


def known_sources(sources: Column, known: Callable[[Column], Column]) -> Column:
    """The known ones, if there are any, else all."""
    kept = F.filter(sources, known)
    return F.when(F.size(kept) > 0, kept).otherwise(sources)


def directions(names: Column) -> Column:
    return F.filter(F.transform(F.filter(names, lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def pending(df: DataFrame, failed: Column, chars: Column, group: str) -> DataFrame:
    """Rows that didn't fail and have no stored body yet, for each group."""
    return df.where(~failed & (F.coalesce(chars, F.lit(0)) == 0)).groupBy(group).agg(F.count("*").alias("pending"))
