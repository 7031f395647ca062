"""Workspaces on disk -> the relations that gates and verification read.

One glob reads any number of workspaces: a workspace is a folder with scope.json, collected.json and analysis.json.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import urls
from attestra.sources import documents


@dataclass
class Workspace:
    scopes: DataFrame
    directions: DataFrame
    collected: DataFrame
    sections: DataFrame
    claims: DataFrame
    cites: DataFrame
    markers: DataFrame
    tensions: DataFrame


def _key(c: str = "path"):
    return F.regexp_extract(c, r"([^/]+)/[^/]+$", 1)


def load(spark: SparkSession, root: str) -> Workspace:
    """root/<workspace>/*.json. Sources are keyed by their normalised URL; of equal ones the last row counts."""
    from attestra.operators.joins import keep_last

    scope = documents.read_json(spark, f"{root}/*/scope.json", documents.SCOPE).select(_key().alias("ws"), "doc.*")
    rows = documents.read_json(spark, f"{root}/*/collected.json", f"array<{documents._struct(documents.SOURCE)}>").select(_key().alias("ws"), F.posexplode("doc").alias("pos", "s")).select("ws", "pos", "s.*")
    rows = rows.withColumn("src", urls.normalize_url(F.col("url"))).withColumn("host", urls.host(F.col("url")))
    last = keep_last(rows, F.concat_ws(" ", "ws", F.nullif("url", F.lit("")), "src"), [F.col("pos")])
    collected = last.select("ws", "src", "url", "title", "snippet", F.col("source_tier").alias("tier"), "direction", "host", "source_file", "fetched_content", F.coalesce("fetch_failed", F.lit(False)).alias("failed"), F.length("fetched_content").alias("chars"))
    analysis = documents.read_json(spark, f"{root}/*/analysis.json", documents.ANALYSIS, repair=True).select(_key().alias("ws"), F.posexplode("doc.sections").alias("sec_idx", "s"))
    sections = analysis.select("ws", "sec_idx", F.col("s.id").alias("sec"), "s.title", "s.content", "s.claims", "s.tensions")
    claims = sections.select("ws", "sec", "sec_idx", F.posexplode("claims").alias("claim_idx", "c")).withColumn("cid", 1_000_000 * F.col("sec_idx").cast("long") + F.col("claim_idx"))
    flat = claims.select(
        "ws", "sec", "cid", "c.summary", F.col("c.evidence_type").alias("ev"), F.col("c.precision").alias("pr"), F.col("c.confidence").alias("conf"), F.col("c.metric_type").alias("metric_type"),
        F.col("c.source_metadata.source_type").alias("st"), F.col("c.source_metadata.test_conditions").alias("conditions"),
    )
    cites = claims.select("ws", "cid", F.explode("c.sources").alias("url")).select("ws", "cid", "url", urls.normalize_url(F.col("url")).alias("src"))
    markers = sections.select("ws", "sec", F.explode(F.regexp_extract_all("content", F.lit(r"\{\{ref:(.*?)\}\}"), F.lit(1))).alias("u")).select("ws", "sec", urls.normalize_url(F.col("u")).alias("src"))
    tensions = sections.select("ws", "sec", F.explode("tensions").alias("t")).select("ws", "sec", "t.summary", F.coalesce("t.resolved", F.lit(False)).alias("resolved"))
    directions = scope.select("ws", F.explode("search_directions").alias("direction"))
    return Workspace(scope, directions, collected, sections.select("ws", "sec", "sec_idx", "title", "content"), flat, cites, markers, tensions)


def phases(spark: SparkSession, root: str) -> DataFrame:
    """(ws, phase) of the workspaces under root that have any file, by their phase-state file or else by their artifacts."""
    from attestra.operators.pipeline import recorded_phase

    files = spark.read.option("pathGlobFilter", "*.{json,md}").text(f"{root}/*/*", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    named = files.select(_key().alias("ws"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "value")
    has = lambda name: F.max(F.when(F.col("name") == name, 1).otherwise(0)) == 1
    on = named.groupBy("ws").agg(
        F.max(F.when(F.col("name") == "pipeline_state.json", F.col("value"))).alias("state"), has("scope.json").alias("a"), has("collected.json").alias("b"), has("analysis.json").alias("c"), has("review_report.md").alias("d")
    )
    return on.select("ws", recorded_phase(F.col("state"), F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("phase"))


def verified(w: Workspace, ruleset: str = "v2") -> DataFrame:
    """The claims of all workspaces with n_sources and source_verification, by numbers in the sources' texts."""
    from attestra.functions.numbers import number_set, supported
    from attestra.operators import verification

    key = lambda df: df.withColumn("cid", F.concat_ws("#", "ws", "cid"))
    text = documents.source_text(F.lit(None).cast("string"), F.col("fetched_content"), F.col("snippet"))
    claims = key(w.claims).withColumn("has_number", F.size(number_set(F.col("summary"))) > 0).withColumn("entity", verification.cited_entity(F.col("summary")))
    known = w.collected.select("ws", "src", "tier", text.alias("text"))
    on = key(w.cites).join(known, ["ws", "src"], "left").join(claims.select("cid", "summary", "entity"), "cid")
    edges = on.select(
        "cid", "tier", supported(F.col("summary"), F.coalesce("text", F.lit(""))).alias("supports"),
        F.coalesce(verification.entity_on_host(F.col("entity"), urls.host(F.col("url")), ruleset), F.lit(True)).alias("host_matches"),
    )
    return verification.classified(claims, verification.edge_flags(edges), ruleset)
