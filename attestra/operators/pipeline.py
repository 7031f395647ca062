"""Rules of the phase machine as expressions and driver-side control flow over small relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phases in order.
PHASES = ["scope", "search", "analysis", "deep_dive", "review", "final"]
#: Legal transitions, and which artifacts a phase's reset removes.
TRANSITIONS = [("scope", "search"), ("search", "analysis"), ("analysis", "deep_dive"), ("analysis", "review"), ("deep_dive", "search"), ("deep_dive", "review"), ("review", "final"), ("review", "review")]
RESET = {
    "scope": ["scope.json", "collected.json", "analysis.json", "review_report.md", "pipeline_state.json"],
    "search": ["collected.json", "analysis.json", "review_report.md"],
    "analysis": ["analysis.json", "review_report.md"],
    "deep_dive": ["deep_dive_plan.json"],
    "review": ["review_report.md"],
    "final": ["pipeline_state.json"],
}


def phase(state: Column, has_scope: Column, has_collected: Column, has_analysis: Column) -> Column:
    """A valid recorded phase wins; else the first artifact that is missing tells the phase."""
    return F.when(state.isin(PHASES), state).when(~has_scope, "scope").when(~has_collected, "search").when(~has_analysis, "analysis").otherwise("review")


#: What a phase-state file may name.
STATES = ["pre_scope", "post_scope", "post_search", "post_analysis", "post_deep_dive", "post_review", "post_final"]


def recorded_phase(state: Column, has_scope: Column, has_collected: Column, has_analysis: Column, has_review: Column) -> Column:
    """What the phase-state file (its raw text) records, if that is a state; else what the artifacts tell that are there."""
    named = F.get_json_object(F.when(F.call_function("try_parse_json", state).isNotNull(), state), "$.current_phase")
    found = F.when(~has_scope, "pre_scope").when(~has_collected, "post_scope").when(~has_analysis, "post_search").when(~has_review, "post_analysis").otherwise("post_review")
    return F.when(named.isin(STATES), named).otherwise(found)


def legal(source: Column, target: Column) -> Column:
    return F.concat_ws(">", source, target).isin([f"{a}>{b}" for a, b in TRANSITIONS])


def removed_by_reset(phase: Column) -> Column:
    """The artifacts that a reset to the phase removes, none for any other word."""
    known = F.coalesce(*[F.when(phase == p, F.array(*map(F.lit, files))) for p, files in RESET.items()])
    return F.coalesce(known, F.array().cast("array<string>"))


def depth_allows(depth: Column, target: Column) -> Column:
    """quick research has no deep dive."""
    return ~((target == "deep_dive") & (depth == "quick"))


def blocking(gates: DataFrame, names: list[str]) -> DataFrame:
    """Failing blockers among the named gates."""
    return gates.where((F.col("level") == "BLOCKER") & ~F.col("passed") & F.col("gate").isin(names))


def advance(state: str, target: str, depth: str, gates: DataFrame) -> tuple[bool, str]:
    """Whether the machine may go from state to target: legal, allowed at this depth, and no failing blocker."""
    if (state, target) not in TRANSITIONS:
        return False, "illegal transition"
    if target == "deep_dive" and depth == "quick":
        return False, "quick depth has no deep dive"
    if not gates.where("level = 'BLOCKER' AND NOT passed").isEmpty():
        return False, "blocked"
    return True, target


def review_status(blocker_skipped: Column, warn_skipped: Column, lightweight_failed: Column) -> Column:
    """degraded if a blocker was left or the light review failed; else passed, if with issues where warnings were left."""
    return F.when((blocker_skipped > 0) | lightweight_failed, "degraded").when(warn_skipped > 0, "passed_with_issues").otherwise("passed")


def verdict(report: Column, window: int = 200) -> Column:
    """pass, pass_with_issues or fail: after the word verdict, else whatever of them stands in the first characters."""
    low = F.lower(report)
    named = F.regexp_extract(low, r"verdict\W{0,10}(pass_with_issues|pass|fail)", 1)
    opening = F.regexp_extract(F.left(low, F.lit(window)), r"\b(pass_with_issues|pass|fail)\b", 1)
    return F.when(named != "", named).when(opening != "", opening)


def default_min_sources(configured: Column, by_depth: dict[str, int], depth: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in by_depth.items() for x in pair])
    return F.coalesce(configured, F.try_element_at(table, depth), F.lit(5))
