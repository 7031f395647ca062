"""Quality gates over many workspaces at once.

Every gate returns one relation (gate, subject, level, passed, metric, threshold, detail): one row for each workspace,
with the figure that decided. Messages are formatted only where a report is rendered. Inputs are relations keyed by
ws: scopes, directions, collected, sections, claims, cites (claim -> source) and markers (section -> source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.aggregates import fidelity
from attestra.operators.reports import row
from attestra.operators.verification import EVIDENCE, PRECISIONS, WEAK_EVIDENCE

#: How many sources each depth needs, and the share of single-source claims that it allows.
MIN_SOURCES = {"quick": 3, "standard": 5, "deep": 8}
SINGLE_SOURCE = {"standard": 0.70, "deep": 0.50}
#: The source tiers that each kind of goal must visit.
ROUTES = {
    "tech_selection": [2, 3, 4, 1], "competitive_comparison": [2, 1, 3, 4], "feasibility_assessment": [2, 1, 3], "fact_check": [1, 2, 4], "background_check": [3, 2, 1, 4],
    "market_analysis": [3, 4, 1, 2], "academic_research": [1, 2], "panoramic_understanding": [2, 1, 3, 4], "exploratory": [4, 3, 2], "other": [2, 3, 1, 4],
}
#: Sections that a kind of goal must have; others need overview and details.
REQUIRED = {
    "tech_selection": ["overview", "comparison", "recommendation", "methodology"], "feasibility_assessment": ["overview", "analysis", "conclusion", "methodology"],
    "fact_check": ["claims", "evidence", "conclusion"], "competitive_comparison": ["overview", "comparison", "positioning", "methodology"],
    "academic_research": ["abstract", "findings", "references", "methodology"], "market_analysis": ["overview", "data", "trends", "conclusion", "methodology"],
}
#: Goals of an open kind, test conditions that say nothing, and words that name a limit.
EXPLORATORY = ["exploratory", "panoramic_understanding", "background_check", "other"]
GENERIC_CONDITIONS = ["various environments and survey methodologies", "various environments", "n/a", "not specified", "see source"]
LIMITATIONS = ["limit", "limitation", "shortcom", "drawback", "weakness", "局限", "不足", "缺陷", "短板", "缺点", "限制", "can only", "cannot", "fails to"]


def judged(scopes: DataFrame, figures: DataFrame, gate: str, level: str, passed: Column, threshold: float | Column | None = None, empty: float | None = 0) -> DataFrame:
    """A gate row for each workspace; figures(ws, m), where missing ``empty`` stands for m."""
    on = scopes.select("ws", *[c for c in scopes.columns if c not in ("ws", "m")]).join(figures.select("ws", "m"), "ws", "left").withColumn("m", F.coalesce("m", F.lit(empty)))
    cols = row(gate, F.col("ws"), level, F.coalesce(passed, F.lit(True)), F.col("m"))
    cols[5] = (threshold if isinstance(threshold, Column) else F.lit(threshold)).cast("double").alias("threshold")
    return on.select(*cols)


def _count(df: DataFrame) -> DataFrame:
    return df.groupBy("ws").agg(F.count("*").alias("m"))


def collected_exists(scopes: DataFrame, collected: DataFrame) -> DataFrame:
    return judged(scopes, _count(collected), "collected_exists", "BLOCKER", F.col("m") >= 1, 1)


def min_sources(scopes: DataFrame, collected: DataFrame) -> DataFrame:
    least = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in MIN_SOURCES.items() for x in p]), F.col("depth")), F.lit(5))
    return judged(scopes, _count(collected), "min_sources", "BLOCKER", F.col("m") >= least, least)


def tier_coverage(scopes: DataFrame, collected: DataFrame) -> DataFrame:
    """Tiers of the goal's route without any source: division over route x workspace."""
    route = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in ROUTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("goal_type")), F.array(*map(F.lit, ROUTES["other"])))
    needed = scopes.select("ws", F.explode(route).alias("tier"))
    return judged(scopes, _count(needed.join(collected.select("ws", "tier").distinct(), ["ws", "tier"], "left_anti")), "tier_coverage", "BLOCKER", F.col("m") == 0, 0)


def source_fidelity(scopes: DataFrame, collected: DataFrame) -> DataFrame:
    """The share of sources without a stored body among those that didn't fail; fidelity_verdicts() judges all there is to judge."""
    ok = ~F.col("failed")
    m = collected.groupBy("ws").agg((F.count(F.when(ok & (F.coalesce("chars", F.lit(0)) == 0), 1)) / F.nullif(F.count(F.when(ok, 1)), F.lit(0))).alias("m"))
    return judged(scopes, m, "source_fidelity", "BLOCKER", F.col("m") <= 0.3, 0.3)


#: The shares beyond which a workspace is blocked or warned.
FIDELITY = {"block_missing": 0.30, "block_shallow": 0.30, "block_overlap": 0.30, "warn_exempt": 0.50}


def fidelity_verdicts(scopes: DataFrame, collected: DataFrame) -> DataFrame:
    """The whole ladder for each workspace, from collected(ws, failed, chars, overlap): the first rung that it fails on tells level, metric and threshold.

    Bodies are missing, shallow or little more than their snippet for too many sources: a blocker each. Too many sources are
    exempt, any body is missing, or any is shallow or thin: a warning each. A workspace without sources, or whose
    sources have all failed, passes. detail is the rung's name, empty where all is well; on the last two rungs metric counts sources.
    """
    found = fidelity(collected, F.col("failed"), F.col("chars"), F.col("overlap"), by=["ws"])
    overlapping = F.coalesce(F.col("overlapping") / F.nullif(F.col("total") - F.col("failed"), F.lit(0)), F.lit(0.0))
    metrics = {
        "block_missing": F.col("missing_ratio"), "block_shallow": F.col("shallow_ratio"), "block_overlap": overlapping, "warn_exempt": F.col("exempt_ratio"),
        "warn_missing": F.col("missing").cast("double"), "warn_depth": (F.col("shallow") + F.col("thin")).cast("double"),
    }
    told = scopes.select("ws").join(found, "ws", "left").withColumn("verdict", F.coalesce("verdict", F.lit("pass")))
    of = lambda values: F.coalesce(*[F.when(F.col("verdict") == name, v) for name, v in values.items()], F.lit(0.0))
    failing = F.col("verdict") != "pass"
    level = F.when(F.col("verdict").startswith("warn"), "WARN").otherwise("BLOCKER")
    gate = row("source_fidelity", F.col("ws"), "BLOCKER", ~failing, of(metrics), None, F.when(failing, F.col("verdict")))
    gate[2], gate[5] = level.alias("level"), of({k: F.lit(v) for k, v in FIDELITY.items()}).alias("threshold")
    return told.select(*gate)


def direction_tagging(scopes: DataFrame, directions: DataFrame, collected: DataFrame, level: str = "BLOCKER") -> DataFrame:
    """No source lacks a direction where directions are declared."""
    untagged = collected.where(F.trim(F.coalesce("direction", F.lit(""))) == "").join(directions.select("ws").distinct(), "ws", "left_semi")
    return judged(scopes, _count(untagged), "direction_tagging", level, F.col("m") == 0, 0)


def direction_coverage(scopes: DataFrame, directions: DataFrame, collected: DataFrame, level: str = "BLOCKER", fold: bool = True) -> DataFrame:
    """Declared directions without a source; v1 folds case and blanks, v2 compares as written and skips other."""
    key = (lambda c: F.lower(F.trim(c))) if fold else (lambda c: c)
    needed = directions.select("ws", key(F.col("direction")).alias("direction")).distinct()
    needed = needed if fold else needed.where("direction <> 'other'")
    present = collected.select("ws", key(F.col("direction")).alias("direction")).distinct()
    return judged(scopes, _count(needed.join(present, ["ws", "direction"], "left_anti")), "direction_coverage", level, F.col("m") == 0, 0)


def direction_anchor(scopes: DataFrame, directions: DataFrame, collected: DataFrame, cites: DataFrame) -> DataFrame:
    """Declared directions that have sources, none of which a claim cites."""
    key = F.lower(F.trim("direction"))
    tagged = directions.select("ws", key.alias("direction")).distinct().join(collected.select("ws", key.alias("direction"), "src"), ["ws", "direction"])
    used = tagged.join(cites.select("ws", "src").distinct(), ["ws", "src"]).select("ws", "direction").distinct()
    return judged(scopes, _count(tagged.select("ws", "direction").distinct().join(used, ["ws", "direction"], "left_anti")), "direction_coverage_claims", "WARN", F.col("m") == 0, 0)


def url_traceability(scopes: DataFrame, collected: DataFrame, cites: DataFrame) -> DataFrame:
    return judged(scopes, _count(cites.select("ws", "cid", "src").join(collected.select("ws", "src").distinct(), ["ws", "src"], "left_anti")), "url_traceability", "BLOCKER", F.col("m") == 0, 0)


def section_coverage(scopes: DataFrame, sections: DataFrame) -> DataFrame:
    """Required sections that are missing; exploratory goals need an overview and two sections at all."""
    own = sections.groupBy("ws").agg(F.collect_set("sec").alias("own"))
    need = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("goal_type")), F.array(F.lit("overview"), F.lit("details")))
    on = scopes.join(own, "ws", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    free = (~F.array_contains("own", "overview")).cast("int") + (F.size("own") < 2).cast("int")
    lacking = F.when(F.col("goal_type").isin(EXPLORATORY), free).otherwise(F.size(F.array_except(need, F.col("own"))))
    return judged(scopes, on.select("ws", lacking.alias("m")), "section_coverage", "BLOCKER", F.col("m") == 0, 0)


def _claim_ratio(claims: DataFrame, condition: Column) -> DataFrame:
    return claims.groupBy("ws").agg(F.avg(F.when(condition, 1.0).otherwise(0.0)).alias("m"))


def cited_claims(claims: DataFrame, cites: DataFrame) -> DataFrame:
    """claims with n_sources."""
    n = cites.groupBy("ws", "cid").agg(F.count("*").alias("n_sources"))
    return claims.join(n, ["ws", "cid"], "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))


def quality_heuristics(scopes: DataFrame, claims: DataFrame, cites: DataFrame) -> DataFrame:
    """Too large a share of claims with fewer than two sources; quick research isn't judged."""
    most = F.when(F.col("depth") == "quick", F.lit(None)).otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SINGLE_SOURCE.items() for x in p]), F.col("depth")), F.lit(0.5)))
    return judged(scopes, _claim_ratio(cited_claims(claims, cites), F.col("n_sources") < 2), "quality_heuristics", "WARN", F.col("m") <= most, most)


def source_tier_balance(scopes: DataFrame, collected: DataFrame, cites: DataFrame) -> DataFrame:
    """Too few tier 1 and 2 sources among the distinct cited ones that are known."""
    cited = cites.select("ws", "src").distinct().join(collected.select("ws", "src", "tier").dropDuplicates(["ws", "src"]), ["ws", "src"])
    m = cited.groupBy("ws").agg(F.avg(F.when(F.col("tier") <= 2, 1.0).otherwise(0.0)).alias("m"))
    return judged(scopes, m, "source_tier_balance", "WARN", F.col("m") >= 0.3, 0.3, 1)


def table_suggestion(scopes: DataFrame, claims: DataFrame, least: int = 4) -> DataFrame:
    many = claims.groupBy("ws", "sec").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return judged(scopes, _count(many), "table_suggestion", "WARN", F.col("m") == 0, 0)


def section_deviation(scopes: DataFrame, planned: DataFrame, sections: DataFrame) -> DataFrame:
    both = planned.select("ws", "sec", F.lit(1).alias("p")).join(sections.select("ws", "sec", F.lit(1).alias("a")), ["ws", "sec"], "full_outer")
    m = both.groupBy("ws").agg((F.count(F.when(F.col("a").isNull() | F.col("p").isNull(), 1)) / F.nullif(F.count("p"), F.lit(0))).alias("m"))
    return judged(scopes, m, "section_deviation", "WARN", F.col("m") <= 0.5, 0.5)


def facet_coverage(scopes: DataFrame, collected: DataFrame, claims: DataFrame) -> DataFrame:
    """Facets without support: tier 1 or 2, tier 3, two tier 4 hosts, and a claim that names a limit."""
    tiers = collected.groupBy("ws").agg(
        F.max((F.col("tier") <= 2).cast("int")).alias("a"), F.max((F.col("tier") == 3).cast("int")).alias("b"), (F.countDistinct(F.when(F.col("tier") == 4, F.col("host"))) >= 2).cast("int").alias("c")
    )
    limits = claims.groupBy("ws").agg(F.max(F.lower("summary").rlike("|".join(LIMITATIONS)).cast("int")).alias("d"))
    have = lambda c: F.coalesce(c, F.lit(0))
    m = scopes.select("ws").join(tiers, "ws", "left").join(limits, "ws", "left").select("ws", (4 - have("a") - have("b") - have("c") - have("d")).alias("m"))
    return judged(scopes, m, "facet_coverage", "WARN", F.col("m") == 0, 0)


# claims


def claim_metadata(scopes: DataFrame, claims: DataFrame) -> DataFrame:
    lacks = F.col("ev").isNull() | F.col("conf").isNull() | F.col("pr").isNull()
    return judged(scopes, _claim_ratio(claims, lacks), "claim_metadata", "WARN", F.col("m") <= 0.5, 0.5)


def precision_inflation(scopes: DataFrame, claims: DataFrame) -> DataFrame:
    """exact claims on weak evidence, and metric types whose exact values spread by more than 5 %."""
    weak = claims.where((F.col("pr") == "exact") & F.col("ev").isin(WEAK_EVIDENCE)).select("ws")
    spread = claims.where("pr = 'exact' AND metric_type IS NOT NULL").groupBy("ws", "sec", "metric_type").agg(F.count("num").alias("n"), F.min("num").alias("lo"), F.max("num").alias("hi"), F.avg("num").alias("mean"))
    spread = spread.where("n >= 2 AND mean > 0 AND (hi - lo) / mean > 0.05").select("ws")
    return judged(scopes, _count(weak.unionAll(spread)), "precision_inflation", "WARN", F.col("m") == 0, 0)


def conditions_problem(evidence: Column, conditions: Column) -> Column:
    """Why the test conditions of authoritative evidence don't do, by the first rule that applies; null if they do."""
    bare = F.lower(F.trim(conditions))
    return F.when(
        evidence.isin("official_data", "independent_benchmark"),
        F.when(conditions.isNull(), "missing").when(bare == "", "empty").when(bare.isin(GENERIC_CONDITIONS), "generic").when(F.length(bare) < 10, "short"),
    )


def source_metadata(scopes: DataFrame, claims: DataFrame) -> DataFrame:
    return judged(scopes, _count(claims.where(conditions_problem(F.col("ev"), F.col("conditions")).isNotNull())), "source_metadata", "WARN", F.col("m") == 0, 0)


def metric_type_homogeneity(scopes: DataFrame, claims: DataFrame) -> DataFrame:
    own = claims.where(F.col("ev").isin("official_data", "independent_benchmark") & F.col("metric_type").isNotNull())
    mixed = own.groupBy("ws", "sec").agg(F.countDistinct("metric_type").alias("n")).where("n > 1")
    return judged(scopes, _count(mixed), "metric_type_homogeneity", "WARN", F.col("m") == 0, 0)


def claim_dedup(scopes: DataFrame, claims: DataFrame) -> DataFrame:
    twice = claims.where(F.trim("summary") != "").groupBy("ws", F.trim("summary").alias("s")).agg(F.count("*").alias("n")).where("n > 1")
    return judged(scopes, _count(twice), "claim_dedup", "WARN", F.col("m") == 0, 0)


def ref_marker_validity(scopes: DataFrame, markers: DataFrame, collected: DataFrame, only_collected: bool = False) -> DataFrame:
    """Markers that name no collected source; v2 judges only workspaces that collected anything."""
    bad = markers.select("ws", "sec", "src").join(collected.select("ws", "src").distinct(), ["ws", "src"], "left_anti")
    if only_collected:
        bad = bad.join(collected.select("ws").distinct(), "ws", "left_semi")
    return judged(scopes, _count(bad), "ref_marker_validity", "BLOCKER", F.col("m") == 0, 0)


def claim_source_ref_coverage(scopes: DataFrame, claims: DataFrame, cites: DataFrame, markers: DataFrame) -> DataFrame:
    """Cited sources that the claim's own section doesn't mark (a correlated anti-join on section and source)."""
    cited = cites.select("ws", "cid", "src").join(claims.select("ws", "cid", "sec"), ["ws", "cid"])
    return judged(scopes, _count(cited.join(markers.select("ws", "sec", "src").distinct(), ["ws", "sec", "src"], "left_anti")), "claim_source_ref_coverage", "BLOCKER", F.col("m") == 0, 0)


def source_verification_check(scopes: DataFrame, classified: DataFrame) -> DataFrame:
    return judged(scopes, _claim_ratio(classified, F.col("sv") == "source_absent"), "source_verification_check", "INFO", F.lit(True))


def primary_source_ratio(scopes: DataFrame, claims: DataFrame, cites: DataFrame, collected: DataFrame) -> DataFrame:
    """Claims on tier 1 or 2 sources; claims on a single host, if one host has that large a share itself. quick isn't judged."""
    known = collected.select("ws", "src", "tier", "host").dropDuplicates(["ws", "src"])
    each = cites.join(known, ["ws", "src"], "left").groupBy("ws", "cid").agg(F.min("tier").alias("best"), F.countDistinct("host").alias("hosts"), F.min("host").alias("host"))
    on = claims.select("ws", "cid").join(each, ["ws", "cid"], "left")
    single = on.where("hosts = 1").groupBy("ws", "host").agg(F.count("*").alias("n")).groupBy("ws").agg(F.max("n").alias("top"), F.sum("n").alias("single"))
    total = on.groupBy("ws").agg(F.count("*").alias("total"), F.count(F.when(F.col("best") <= 2, 1)).alias("primary"))
    figures = scopes.select("ws", "depth").join(total, "ws").join(single, "ws", "left")
    most = F.when(F.col("depth") == "deep", 0.5).otherwise(0.7)
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("total")
    bad = (share("primary") < 0.5) | ((share("single") > most) & (share("top") >= most))
    m = figures.select("ws", share("primary").alias("m"), bad.alias("bad"))
    out = scopes.select("ws", "depth").join(m, "ws", "left")
    return out.select(*row("primary_source_ratio", F.col("ws"), "WARN", F.coalesce(~F.col("bad"), F.lit(True)) | (F.col("depth") == "quick"), F.col("m"), 0.5))


# live rule set


def scope_gates(scopes: DataFrame) -> DataFrame:
    """scope_topic, scope_goal_type and scope_english_title."""
    from attestra.functions.text import has_cjk

    topic, title = F.trim(F.coalesce("topic", F.lit(""))), F.trim(F.coalesce("english_title", F.lit("")))
    rules = {"scope_topic": topic != "", "scope_goal_type": F.coalesce(F.col("goal_type").isin(list(ROUTES)), F.lit(False)), "scope_english_title": ~has_cjk(topic) | (title != "")}
    out = [scopes.select(*row(name, F.col("ws"), "BLOCKER", ok)) for name, ok in rules.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def source_sufficiency(scopes: DataFrame, collected: DataFrame, questions: DataFrame, answered: DataFrame) -> DataFrame:
    """Without any tier 1 or 2 source it fails; with decision questions each needs an answer on such a source
    (answered(ws, question)); without questions a fifth of the sources must be of these tiers."""
    good = collected.groupBy("ws").agg(F.count(F.when(F.col("tier") <= 2, 1)).alias("good"), F.count("*").alias("total"))
    asked = questions.groupBy("ws").agg(F.count("*").alias("asked"))
    left = questions.join(answered, ["ws", "question"], "left_anti").groupBy("ws").agg(F.count("*").alias("open"))
    on = scopes.select("ws").join(good, "ws", "left").join(asked, "ws", "left").join(left, "ws", "left").na.fill(0)
    ok = F.when(F.col("good") == 0, False).when(F.col("asked") > 0, F.col("open") == 0).otherwise(F.col("good") / F.col("total") >= 0.2)
    return on.select(*row("source_sufficiency", F.col("ws"), "WARN", ok, F.col("open"), 0))


def precision_rules(scopes: DataFrame, claims: DataFrame) -> DataFrame:
    """exact on weak evidence, and values outside the enumerations."""
    bad = ((F.col("pr") == "exact") & F.col("ev").isin(WEAK_EVIDENCE)) | ~F.col("ev").isin(EVIDENCE) | ~F.col("pr").isin(PRECISIONS)
    return judged(scopes, _count(claims.where(bad)), "precision_rules", "BLOCKER", F.col("m") == 0, 0)


# deep dive


def deep_dive_targets(classified: DataFrame, tensions: DataFrame, indirect: float = 0.3, single: float = 0.5) -> DataFrame:
    """(ws, reason, sec, n, target): absent claims by section, too many indirect or single-source claims, open tensions by
    section; targets of a workspace are numbered in that order.

    classified(ws, sec, sv, n_sources), tensions(ws, sec, resolved).
    """
    from pyspark.sql.window import Window

    absent = classified.where("sv = 'source_absent'").groupBy("ws", "sec").agg(F.count("*").alias("n")).select("ws", F.lit(1).alias("o"), F.lit("source_absent").alias("reason"), "sec", "n")
    total = classified.groupBy("ws").agg(F.count("*").alias("all"), F.count(F.when(F.col("sv") == "source_indirect", 1)).alias("ind"), F.count(F.when(F.col("n_sources") < 2, 1)).alias("one"))
    ind = total.where(F.col("ind") / F.col("all") > indirect).select("ws", F.lit(2).alias("o"), F.lit("source_indirect").alias("reason"), F.lit("").alias("sec"), F.col("ind").alias("n"))
    one = total.where(F.col("one") / F.col("all") > single).select("ws", F.lit(3).alias("o"), F.lit("single_source").alias("reason"), F.lit("").alias("sec"), F.col("one").alias("n"))
    tense = tensions.where("NOT resolved").groupBy("ws", "sec").agg(F.count("*").alias("n")).select("ws", F.lit(4).alias("o"), F.lit("tension_unresolved").alias("reason"), "sec", "n")
    every = absent.unionByName(ind).unionByName(one).unionByName(tense)
    return every.withColumn("target", F.row_number().over(Window.partitionBy("ws").orderBy("o", "sec"))).drop("o")


#: Fixed value: the rounds that a plan may take if it names no number.
MAX_ROUNDS = 3


def deep_dive_gates(scopes: DataFrame, targets: DataFrame, classified: DataFrame, plans: DataFrame) -> DataFrame:
    """The plan's gates: it exists, its targets are done or skipped for a reason, done ones found three sources, no claim of
    a targeted section stays absent, and, which never fail, whether it declares convergence and the rounds it has used.
    targets(ws, sec, status, skip_reason, new_sources), plans(ws, round, max_rounds, convergence)."""
    done = F.col("status") == "completed"
    plan = judged(scopes, _count(targets), "deep_dive_plan_exists", "BLOCKER", F.col("m") >= 1, 1)
    unfinished = targets.where(~(done | ((F.col("status") == "skipped") & (F.trim(F.coalesce("skip_reason", F.lit(""))) != ""))))
    completion = judged(scopes, _count(unfinished), "target_completion", "BLOCKER", F.col("m") == 0, 0)
    shallow = judged(scopes, _count(targets.where(done & (F.col("new_sources") < 3))), "deep_dive_source_depth", "BLOCKER", F.col("m") == 0, 0)
    named = targets.where("sec <> ''").select("ws", "sec").distinct()
    aimed = classified.join(named, ["ws", "sec"], "left_semi").unionByName(classified.join(named.select("ws").distinct(), "ws", "left_anti"))
    left = judged(scopes, _count(aimed.where("sv = 'source_absent'")), "deep_dive_verification", "BLOCKER", F.col("m") == 0, 0)
    on = scopes.select("ws").join(plans.select("ws", "round", "max_rounds", "convergence", F.lit(True).alias("_plan")), "ws", "left")
    open_ = F.col("_plan") & F.col("convergence").isNull()
    used, most = F.coalesce("round", F.lit(0)), F.coalesce("max_rounds", F.lit(MAX_ROUNDS))
    declared = row("convergence_declared", F.col("ws"), "WARN", F.lit(True), F.when(F.coalesce(open_, F.lit(False)), 0.0).otherwise(1.0))
    declared[6] = F.when(open_, "not yet declared").otherwise("").alias("detail")
    budget = row("round_budget", F.col("ws"), "INFO", F.lit(True), F.when(F.col("_plan"), used))
    budget[5] = F.when(F.col("_plan"), most).cast("double").alias("threshold")
    budget[6] = F.when(F.col("_plan"), F.concat_ws("/", used.cast("string"), most.cast("string"))).otherwise("").alias("detail")
    return plan.unionByName(completion).unionByName(shallow).unionByName(left).unionByName(on.select(*declared)).unionByName(on.select(*budget))


def convergence(round_: Column, max_rounds: Column, targets: Column, new_sources: Column) -> Column:
    """hard (budget used up) > natural (no targets) > soft (nothing new from round 2 on) > continue."""
    return F.when(round_ >= max_rounds, "hard").when(targets == 0, "natural").when((new_sources == 0) & (round_ >= 2), "soft").otherwise("continue")
