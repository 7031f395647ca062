"""Queries of the quality gates, the deep-dive rules, the schema checks and the rendering, over workspaces that are
derived from the order tables: each customer is a workspace, orders are its claims, suppliers its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.operators import gates, pipeline, render, schemas
from attestra.plans import fixture
from attestra.plans.registry import Tables, query

GOALS = list(gates.ROUTES)
SECTIONS = ["overview", "details", "methodology", "conclusion", "comparison"]
CONDITIONS = [None, "", "n/a", "short", "a full description"]


class Workspaces:
    def __init__(self, t: Tables):
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
        n, w = F.col("c_nationkey"), F.col("c_custkey")
        self.scopes = t.customer.select(
            w.alias("ws"), pick(GOALS, n % 10).alias("goal_type"), pick(["quick", "standard", "deep"], w % 3).alias("depth"),
            F.when(w % 2 == 0, F.concat(F.lit("题 "), "c_name")).otherwise(F.col("c_name")).alias("topic"), F.when(w % 4 == 0, F.col("c_name")).alias("english_title"),
        )
        sec = pick(SECTIONS, F.left("o_orderpriority", F.lit(1)).cast("int") - 1)
        self.claims = t.orders.select(
            c.alias("ws"), k.alias("cid"), sec.alias("sec"), pick(fixture.EV, k % 5).alias("ev"), pick(fixture.PR, (k + c) % 3).alias("pr"), F.when(k % 3 != 0, "high").alias("conf"),
            F.concat(F.lit("m"), c % 7).alias("metric_type"), (1 + k % 50).alias("num"), F.concat(F.lit("claim "), k % 50).alias("summary"), pick(CONDITIONS, F.floor(k / 5) % 5).alias("conditions"),
        )
        lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey", sec.alias("sec")), F.col("l_orderkey") == k).select(c.alias("ws"), k.alias("cid"), F.col("l_suppkey").alias("src"), "sec", "l_returnflag", "l_linestatus")
        self.cites = lines.select("ws", "cid", "src").distinct()
        known = fixture.sources(t).withColumnRenamed("s_suppkey", "src")
        s = F.col("src")
        self.collected = lines.where("l_returnflag <> 'R'").select("ws", "src").distinct().join(known, "src").select(
            "ws", "src", "tier", "host", F.when(s % 11 == 0, "").otherwise(F.col("direction")).alias("direction"), F.when(s % 7 == 0, 0).otherwise(1000 * (s % 9)).alias("chars"), ((F.col("ws") + s) % 17 == 0).alias("failed")
        )
        nations = F.broadcast(t.nation.select("n_nationkey", "n_name"))
        two = t.customer.select(w.alias("ws"), F.explode(F.array(n.cast("long"), w % 25)).alias("n_nationkey")).distinct()
        self.directions = two.join(nations, "n_nationkey").select("ws", F.col("n_name").alias("direction"))
        self.sections = self.claims.select("ws", "sec").distinct()
        self.markers = lines.where("l_linestatus = 'F'").select("ws", "sec", "src").distinct()
        self.classified = fixture.classified(t).select("cid", F.col("source_verification").alias("sv"), "n_sources").join(self.claims.select("ws", "cid", "sec", "ev", "pr", "summary"), "cid")
        self.questions = t.customer.select(w.alias("ws"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("question"))
        good = self.collected.where("tier <= 2").select("ws", "src")
        self.answered = self.cites.join(self.claims.where("sec = 'overview'").select("ws", "cid"), ["ws", "cid"]).join(good, ["ws", "src"]).select("ws", (F.col("cid") % 2).alias("question")).distinct()
        self.tensions = self.claims.where("ev = 'expert_opinion'").select("ws", "sec", (F.col("pr") == "exact").alias("resolved"))
        q = self.classified.where("ev = 'qualitative_trend'")
        plan = t.customer.where(w % 6 != 0)
        self.plans = plan.select(w.alias("ws"), (w % 4).alias("round"), F.when(w % 5 != 0, 2 + w % 3).alias("max_rounds"), F.when(w % 2 == 0, "natural").alias("convergence"))
        self.targets = q.select("ws", "sec", pick(["completed", "skipped", "pending"], F.col("cid") % 3).alias("status"), F.when(F.col("cid") % 2 == 0, "no source").alias("skip_reason"), F.col("n_sources").alias("new_sources"))


_list = fixture._list
GSQL = f"""WITH {fixture.SQL},
scope AS (SELECT c_custkey AS ws, {_list(GOALS)}[c_nationkey % 10 + 1] AS goal_type, list_value('quick', 'standard', 'deep')[c_custkey % 3 + 1] AS depth,
          CASE WHEN c_custkey % 2 = 0 THEN '题 ' || c_name ELSE c_name END AS topic, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS english_title FROM customer),
g AS (SELECT o_custkey AS ws, o_orderkey AS cid, {_list(SECTIONS)}[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS sec, {_list(fixture.EV)}[o_orderkey % 5 + 1] AS ev, {_list(fixture.PR)}[(o_orderkey + o_custkey) % 3 + 1] AS pr,
      CASE WHEN o_orderkey % 3 <> 0 THEN 'high' END AS conf, 'm' || (o_custkey % 7) AS metric_type, 1 + o_orderkey % 50 AS num, 'claim ' || (o_orderkey % 50) AS summary,
      list_value(NULL, '', 'n/a', 'short', 'a full description')[(o_orderkey // 5) % 5 + 1] AS conditions FROM orders),
lines AS (SELECT ws, cid, l_suppkey AS src, sec, l_returnflag, l_linestatus FROM lineitem JOIN g ON l_orderkey = cid),
cites AS (SELECT DISTINCT ws, cid, src FROM lines),
collected AS (SELECT ws, d.src, tier, host, CASE WHEN d.src % 11 = 0 THEN '' ELSE direction END AS direction, CASE WHEN d.src % 7 = 0 THEN 0 ELSE 1000 * (d.src % 9) END AS chars, (ws + d.src) % 17 = 0 AS failed
              FROM (SELECT DISTINCT ws, src FROM lines WHERE l_returnflag <> 'R') d JOIN src ON s_suppkey = d.src),
directions AS (SELECT DISTINCT ws, n_name AS direction FROM (SELECT c_custkey AS ws, unnest([CAST(c_nationkey AS BIGINT), c_custkey % 25]) AS k FROM customer) JOIN nation ON n_nationkey = k),
sections AS (SELECT DISTINCT ws, sec FROM g),
markers AS (SELECT DISTINCT ws, sec, src FROM lines WHERE l_linestatus = 'F'),
classed AS (SELECT g.ws, g.cid, g.sec, g.ev, g.pr, g.summary, cls.sv, cls.n_sources FROM g JOIN cls USING (cid)),
questions AS (SELECT c_custkey AS ws, unnest([0, 1]) AS question FROM customer),
answered AS (SELECT DISTINCT ws, cid % 2 AS question FROM cites JOIN g USING (ws, cid) JOIN collected USING (ws, src) WHERE sec = 'overview' AND tier <= 2),
tensions AS (SELECT ws, sec, pr = 'exact' AS resolved FROM g WHERE ev = 'expert_opinion'),
plans AS (SELECT c_custkey AS ws, c_custkey % 4 AS round, CASE WHEN c_custkey % 5 <> 0 THEN 2 + c_custkey % 3 END AS max_rounds, CASE WHEN c_custkey % 2 = 0 THEN 'natural' END AS convergence FROM customer WHERE c_custkey % 6 <> 0),
targets AS (SELECT ws, sec, list_value('completed', 'skipped', 'pending')[cid % 3 + 1] AS status, CASE WHEN cid % 2 = 0 THEN 'no source' END AS skip_reason, n_sources AS new_sources FROM classed WHERE ev = 'qualitative_trend')
"""


def gate_sql(gate: str, level: str, figures: str, passed: str, threshold: str = "0", empty: str = "0") -> str:
    return (
        f"SELECT '{gate}' AS gate, CAST(ws AS VARCHAR) AS subject, '{level}' AS level, coalesce({passed}, true) AS passed, CAST(m AS DOUBLE) AS metric, CAST({threshold} AS DOUBLE) AS threshold, '' AS detail"
        f" FROM (SELECT scope.*, coalesce(f.m, {empty}) AS m FROM scope LEFT JOIN ({figures}) f USING (ws))"
    )


def gate(name: str, sql: str):
    return query(name, GSQL + sql)


_N = "SELECT ws, count(*) AS m FROM {} GROUP BY ws"
_LEAST = "CASE depth WHEN 'quick' THEN 3 WHEN 'standard' THEN 5 ELSE 8 END"


@gate("Q01_collected_exists", gate_sql("collected_exists", "BLOCKER", _N.format("collected"), "m >= 1", "1"))
def q01(t: Tables):
    w = Workspaces(t)
    return gates.collected_exists(w.scopes, w.collected)


@gate("Q03_min_sources", gate_sql("min_sources", "BLOCKER", _N.format("collected"), f"m >= {_LEAST}", _LEAST))
def q03(t: Tables):
    w = Workspaces(t)
    return gates.min_sources(w.scopes, w.collected)


_ROUTE = "CASE goal_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in gates.ROUTES.items()) + " END"


@gate("Q04_tier_coverage", gate_sql("tier_coverage", "BLOCKER", _N.format(f"(SELECT ws, unnest({_ROUTE}) AS tier FROM scope) n WHERE (ws, tier) NOT IN (SELECT ws, tier FROM collected)"), "m = 0"))
def q04(t: Tables):
    w = Workspaces(t)
    return gates.tier_coverage(w.scopes, w.collected)


_FID = "SELECT ws, count(*) FILTER (NOT failed AND chars = 0) / nullif(count(*) FILTER (NOT failed), 0) AS m FROM collected GROUP BY ws"


@gate("Q05_source_fidelity", gate_sql("source_fidelity", "BLOCKER", _FID, "m <= 0.3", "0.3"))
def q05(t: Tables):
    w = Workspaces(t)
    return gates.source_fidelity(w.scopes, w.collected)


@gate(
    "Q05_fidelity_verdicts",
    """, f AS (SELECT ws, count(*) AS total, count(*) FILTER (failed) AS bad, count(*) FILTER (NOT failed AND chars = 0) AS missing, count(*) FILTER (NOT failed AND chars > 0 AND chars < 2000) AS shallow,
      count(*) FILTER (NOT failed AND chars >= 2000 AND chars < 5000) AS thin, count(*) FILTER (NOT failed AND chars >= 2000 AND src % 3 = 0) AS overlapping FROM collected GROUP BY ws),
    r AS (SELECT *, missing / (total - bad) AS m, shallow / (total - bad) AS s, overlapping / (total - bad) AS o, bad / total AS x FROM f),
    v AS (SELECT *, CASE WHEN total = bad THEN 'pass' WHEN m > 0.3 THEN 'block_missing' WHEN s > 0.3 THEN 'block_shallow' WHEN o > 0.3 THEN 'block_overlap' WHEN x > 0.5 THEN 'warn_exempt'
      WHEN missing > 0 THEN 'warn_missing' WHEN shallow + thin > 0 THEN 'warn_depth' ELSE 'pass' END AS verdict FROM r)
    SELECT 'source_fidelity' AS gate, CAST(scope.ws AS VARCHAR) AS subject, CASE WHEN verdict LIKE 'warn%' THEN 'WARN' ELSE 'BLOCKER' END AS level, coalesce(verdict, 'pass') = 'pass' AS passed,
      CAST(coalesce(CASE verdict WHEN 'block_missing' THEN m WHEN 'block_shallow' THEN s WHEN 'block_overlap' THEN o WHEN 'warn_exempt' THEN x WHEN 'warn_missing' THEN missing WHEN 'warn_depth' THEN shallow + thin END, 0) AS DOUBLE) AS metric,
      CAST(CASE WHEN verdict IN ('block_missing', 'block_shallow', 'block_overlap') THEN 0.3 WHEN verdict = 'warn_exempt' THEN 0.5 ELSE 0 END AS DOUBLE) AS threshold, CASE WHEN verdict <> 'pass' THEN verdict ELSE '' END AS detail
    FROM scope LEFT JOIN v USING (ws)""",
)
def q05b(t: Tables):
    """The whole ladder over all workspaces; one source in three is little more than its snippet."""
    w = Workspaces(t)
    return gates.fidelity_verdicts(w.scopes, w.collected.withColumn("overlap", F.when(F.col("src") % 3 == 0, 0.9).otherwise(0.2)))


@gate("Q06_direction_tagging", gate_sql("direction_tagging", "BLOCKER", _N.format("collected WHERE direction = '' AND ws IN (SELECT ws FROM directions)"), "m = 0"))
def q06(t: Tables):
    w = Workspaces(t)
    return gates.direction_tagging(w.scopes, w.directions, w.collected)


@gate("Q07_direction_coverage", gate_sql("direction_coverage", "BLOCKER", _N.format("(SELECT DISTINCT ws, lower(direction) AS d FROM directions) n WHERE (ws, d) NOT IN (SELECT ws, lower(direction) FROM collected)"), "m = 0"))
def q07(t: Tables):
    w = Workspaces(t)
    return gates.direction_coverage(w.scopes, w.directions, w.collected)


@query("Q08_repair_hints", f"WITH {fixture.SQL} SELECT tier, 'Tier ' || tier || ' → sources: ' || array_to_string(list_sort(list(DISTINCT host)), ', ') AS hint FROM src GROUP BY tier")
def q08(t: Tables):
    names = F.array_join(F.sort_array(F.collect_set("host")), ", ")
    return fixture.sources(t).groupBy("tier").agg(F.concat(F.lit("Tier "), F.col("tier").cast("string"), F.lit(" → sources: "), names).alias("hint"))


@gate("Q09_artifact_exists", "SELECT ws, array_to_string(list_filter([CASE WHEN ws NOT IN (SELECT ws FROM collected) THEN 'collected' END, CASE WHEN ws NOT IN (SELECT ws FROM g) THEN 'analysis' END], lambda x: x IS NOT NULL), ', ') AS missing FROM scope")
def q09(t: Tables):
    w = Workspaces(t)
    have = w.scopes.select("ws").join(w.collected.select("ws", F.lit(1).alias("a")).distinct(), "ws", "left").join(w.claims.select("ws", F.lit(1).alias("b")).distinct(), "ws", "left")
    lacking = F.array_compact(F.array(F.when(F.col("a").isNull(), "collected"), F.when(F.col("b").isNull(), "analysis")))
    return have.select("ws", F.array_join(lacking, ", ").alias("missing"))


@gate("Q10_url_traceability", gate_sql("url_traceability", "BLOCKER", _N.format("cites WHERE (ws, src) NOT IN (SELECT ws, src FROM collected)"), "m = 0"))
def q10(t: Tables):
    w = Workspaces(t)
    return gates.url_traceability(w.scopes, w.collected, w.cites)


_REQ = "CASE goal_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in gates.REQUIRED.items()) + " ELSE ['overview', 'details'] END"
_EXP = "('" + "', '".join(gates.EXPLORATORY) + "')"
_COV = f"""SELECT ws, CASE WHEN goal_type IN {_EXP} THEN CAST(NOT list_contains(own, 'overview') AS INTEGER) + CAST(len(own) < 2 AS INTEGER) ELSE len(list_filter({_REQ}, lambda x: NOT list_contains(own, x))) END AS m
FROM (SELECT scope.ws, goal_type, coalesce(own, []) AS own FROM scope LEFT JOIN (SELECT ws, list(DISTINCT sec) AS own FROM sections GROUP BY ws) USING (ws))"""


@gate("Q11_section_coverage", gate_sql("section_coverage", "BLOCKER", _COV, "m = 0"))
def q11(t: Tables):
    w = Workspaces(t)
    return gates.section_coverage(w.scopes, w.sections)


_SINGLE = "CASE depth WHEN 'standard' THEN 0.7 WHEN 'deep' THEN 0.5 END"


@gate("Q13_quality_heuristics", gate_sql("quality_heuristics", "WARN", "SELECT ws, avg(CASE WHEN n_sources < 2 THEN 1.0 ELSE 0.0 END) AS m FROM classed GROUP BY ws", f"m <= {_SINGLE}", _SINGLE))
def q13(t: Tables):
    w = Workspaces(t)
    return gates.quality_heuristics(w.scopes, w.claims, w.cites)


@query(
    "Q14_content_concreteness",
    r"SELECT doc_id, regexp_matches(regexp_replace(regexp_replace(regexp_replace(text, '\b20[0-9]{2}\b', '', 'g'), '(?i)\bv\d+\.\d+', '', 'g'), '(?m)^\s*\d+\.', '', 'g'), '\b\d+(?:\.\d+)?\b') AS has_number, false AS vague FROM documents",
)
def q14(t: Tables):
    from attestra.functions import text

    c = F.col("text")
    return t.documents.select("doc_id", text.has_number(c).alias("has_number"), F.coalesce(text.vague_density(c) > 0.1, F.lit(False)).alias("vague"))


@query("Q15_methodology_depth", r"SELECT doc_id, len(regexp_extract_all(text, '[^\s　-〿＀-￯]+')) >= 150 AND contains(text, '|') AS passed FROM documents")
def q15(t: Tables):
    from attestra.functions import text

    return t.documents.select("doc_id", ((text.word_count(F.col("text")) >= 150) & F.contains("text", F.lit("|"))).alias("passed"))


@query("Q16_recommendation_structure", "SELECT doc_id, contains(text, '|') AND contains(lower(text), 'not recommended') AS passed FROM documents")
def q16(t: Tables):
    return t.documents.select("doc_id", (F.contains("text", F.lit("|")) & F.contains(F.lower("text"), F.lit("not recommended"))).alias("passed"))


@gate("Q17_source_tier_balance", gate_sql("source_tier_balance", "WARN", "SELECT ws, avg(CASE WHEN tier <= 2 THEN 1.0 ELSE 0.0 END) AS m FROM (SELECT DISTINCT ws, src FROM cites) JOIN collected USING (ws, src) GROUP BY ws", "m >= 0.3", "0.3", "1"))
def q17(t: Tables):
    w = Workspaces(t)
    return gates.source_tier_balance(w.scopes, w.collected, w.cites)


@gate("Q18_key_insights", "SELECT ws, sec, count(*) FILTER (n_sources >= 2) AS supported, count(*) FILTER (n_sources >= 2) >= 2 AS passed FROM classed WHERE ev = 'expert_opinion' GROUP BY ws, sec")
def q18(t: Tables):
    own = Workspaces(t).classified.where("ev = 'expert_opinion'").groupBy("ws", "sec").agg(F.count(F.when(F.col("n_sources") >= 2, 1)).alias("supported"))
    return own.withColumn("passed", F.col("supported") >= 2)


@gate("Q19_subagent_delegation", "SELECT ws, count(*) AS sections, count(*) FILTER (sec IN ('overview', 'details')) AS shards, count(*) < 2 OR count(*) = count(*) FILTER (sec IN ('overview', 'details')) AS passed FROM sections GROUP BY ws")
def q19(t: Tables):
    from attestra.operators.rules import shard_present

    names = F.array(F.lit("section_overview.json"), F.lit("section_details.json"))
    n = Workspaces(t).sections.groupBy("ws").agg(F.count("*").alias("sections"), F.count(F.when(shard_present(names, F.col("sec")), 1)).alias("shards"))
    return n.withColumn("passed", (F.col("sections") < 2) | (F.col("sections") == F.col("shards")))


_DEV = "SELECT coalesce(p.ws, a.ws) AS ws, count(*) FILTER (p.ws IS NULL OR a.ws IS NULL) / nullif(count(p.ws), 0) AS m FROM (SELECT ws, unnest(['overview', 'details', 'methodology']) AS sec FROM scope) p FULL JOIN sections a ON p.ws = a.ws AND p.sec = a.sec GROUP BY 1"


@gate("Q20_section_deviation", gate_sql("section_deviation", "WARN", _DEV, "m <= 0.5", "0.5"))
def q20(t: Tables):
    w = Workspaces(t)
    planned = w.scopes.select("ws", F.explode(F.array(F.lit("overview"), F.lit("details"), F.lit("methodology"))).alias("sec"))
    return gates.section_deviation(w.scopes, planned, w.sections)


@gate("Q21_table_suggestion", gate_sql("table_suggestion", "WARN", _N.format("(SELECT ws, sec FROM g GROUP BY ws, sec HAVING count(*) >= 4)"), "m = 0"))
def q21(t: Tables):
    w = Workspaces(t)
    return gates.table_suggestion(w.scopes, w.claims)


_ANCHOR = "(SELECT DISTINCT ws, lower(d.direction) AS k FROM directions d JOIN collected c USING (ws) WHERE lower(d.direction) = lower(c.direction)) n WHERE (ws, k) NOT IN (SELECT ws, lower(direction) FROM collected JOIN cites USING (ws, src))"


@gate("Q22_direction_anchor", gate_sql("direction_coverage_claims", "WARN", _N.format(_ANCHOR), "m = 0"))
def q22(t: Tables):
    w = Workspaces(t)
    return gates.direction_anchor(w.scopes, w.directions, w.collected, w.cites)


_FACET = """SELECT scope.ws, 4 - coalesce(a, 0) - coalesce(b, 0) - coalesce(c, 0) AS m FROM scope LEFT JOIN (SELECT ws, max(CAST(tier <= 2 AS INTEGER)) AS a, max(CAST(tier = 3 AS INTEGER)) AS b, CAST(count(DISTINCT host) FILTER (tier = 4) >= 2 AS INTEGER) AS c FROM collected GROUP BY ws) f USING (ws)"""


@gate("Q23_facet_coverage", gate_sql("facet_coverage", "WARN", _FACET, "m = 0"))
def q23(t: Tables):
    w = Workspaces(t)
    return gates.facet_coverage(w.scopes, w.collected, w.claims)


@gate("Q24a_claim_metadata", gate_sql("claim_metadata", "WARN", "SELECT ws, avg(CASE WHEN conf IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM g GROUP BY ws", "m <= 0.5", "0.5"))
def q24a(t: Tables):
    w = Workspaces(t)
    return gates.claim_metadata(w.scopes, w.claims)


_INFL = "(SELECT ws FROM g WHERE pr = 'exact' AND ev IN ('third_party_estimate', 'qualitative_trend', 'expert_opinion') UNION ALL SELECT ws FROM g WHERE pr = 'exact' GROUP BY ws, sec, metric_type HAVING count(*) >= 2 AND (max(num) - min(num)) / avg(num) > 0.05)"


@gate("Q24b_precision_inflation", gate_sql("precision_inflation", "WARN", _N.format(_INFL), "m = 0"))
def q24b(t: Tables):
    w = Workspaces(t)
    return gates.precision_inflation(w.scopes, w.claims)


@gate("Q24c_source_metadata", gate_sql("source_metadata", "WARN", _N.format("g WHERE ev IN ('official_data', 'independent_benchmark') AND coalesce(conditions, '') <> 'a full description'"), "m = 0"))
def q24c(t: Tables):
    w = Workspaces(t)
    return gates.source_metadata(w.scopes, w.claims)


@gate("Q24d_metric_type_homogeneity", gate_sql("metric_type_homogeneity", "WARN", _N.format("(SELECT ws, sec FROM g WHERE ev IN ('official_data', 'independent_benchmark') GROUP BY ws, sec HAVING count(DISTINCT metric_type) > 1)"), "m = 0"))
def q24d(t: Tables):
    w = Workspaces(t)
    return gates.metric_type_homogeneity(w.scopes, w.claims)


@gate("Q24e_claim_dedup", gate_sql("claim_dedup", "WARN", _N.format("(SELECT ws, summary FROM g GROUP BY ws, summary HAVING count(*) > 1)"), "m = 0"))
def q24e(t: Tables):
    w = Workspaces(t)
    return gates.claim_dedup(w.scopes, w.claims)


@gate("Q24f_entity_number_conflict", "SELECT ws, count(DISTINCT num) AS numbers FROM g WHERE num >= 10 GROUP BY ws HAVING count(DISTINCT num) > 1")
def q24f(t: Tables):
    from attestra.operators.aggregates import entity_numbers

    pairs = Workspaces(t).claims.select("ws", F.explode(entity_numbers(F.concat(F.lit("Vendor sells "), "num"))).alias("p"))
    return pairs.groupBy("ws", "p.entity").agg(F.countDistinct("p.number").alias("numbers")).where("numbers > 1").select("ws", "numbers")


@gate("Q24g_ref_marker_validity", gate_sql("ref_marker_validity", "BLOCKER", _N.format("markers WHERE (ws, src) NOT IN (SELECT ws, src FROM collected)"), "m = 0"))
def q24g(t: Tables):
    w = Workspaces(t)
    return gates.ref_marker_validity(w.scopes, w.markers, w.collected)


@gate("Q24h_claim_source_ref_coverage", gate_sql("claim_source_ref_coverage", "BLOCKER", _N.format("(SELECT ws, sec, src FROM cites JOIN g USING (ws, cid)) c WHERE (ws, sec, src) NOT IN (SELECT ws, sec, src FROM markers)"), "m = 0"))
def q24h(t: Tables):
    w = Workspaces(t)
    return gates.claim_source_ref_coverage(w.scopes, w.claims, w.cites, w.markers)


@gate("Q24i_source_verification_check", gate_sql("source_verification_check", "INFO", "SELECT ws, avg(CASE WHEN sv = 'source_absent' THEN 1.0 ELSE 0.0 END) AS m FROM classed GROUP BY ws", "true", "NULL"))
def q24i(t: Tables):
    w = Workspaces(t)
    return gates.source_verification_check(w.scopes, w.classified)


@gate(
    "Q24j_primary_source_ratio",
    """, each_ AS (SELECT ws, cid, min(tier) AS best, count(DISTINCT host) AS hosts, min(host) AS host FROM cites LEFT JOIN collected USING (ws, src) GROUP BY ws, cid),
    on_ AS (SELECT g.ws, g.cid, best, hosts, host FROM g LEFT JOIN each_ USING (ws, cid)),
    s AS (SELECT ws, max(n) AS top, sum(n) AS single FROM (SELECT ws, host, count(*) AS n FROM on_ WHERE hosts = 1 GROUP BY ws, host) GROUP BY ws),
    f AS (SELECT ws, count(*) AS total, count(*) FILTER (best <= 2) AS prim FROM on_ GROUP BY ws)
    SELECT 'primary_source_ratio' AS gate, CAST(scope.ws AS VARCHAR) AS subject, 'WARN' AS level,
      coalesce(NOT (prim / total < 0.5 OR (coalesce(single, 0) / total > CASE WHEN depth = 'deep' THEN 0.5 ELSE 0.7 END AND coalesce(top, 0) / total >= CASE WHEN depth = 'deep' THEN 0.5 ELSE 0.7 END)), true) OR depth = 'quick' AS passed,
      prim / total AS metric, CAST(0.5 AS DOUBLE) AS threshold, '' AS detail FROM scope LEFT JOIN f USING (ws) LEFT JOIN s USING (ws)""",
)
def q24j(t: Tables):
    w = Workspaces(t)
    return gates.primary_source_ratio(w.scopes, w.claims, w.cites, w.collected)


# schemas


def _scope_json(t: Tables) -> DataFrame:
    w = F.col("c_custkey")
    made = F.concat(
        F.lit('{"topic":"'), F.when(w % 4 == 0, "").otherwise(F.col("c_name")), F.lit('","goal_type":"'), F.when(w % 3 == 0, "nonsense").otherwise("other"), F.lit('"'),
        F.when(w % 5 != 0, ',"depth":"quick"').otherwise(',"depth":7'), F.when(w % 2 == 0, ',"search_directions":["a",1]').otherwise(""), F.lit("}"),
    )
    return t.customer.select(w.alias("ws"), F.when(w % 97 == 0, "not json").otherwise(made).alias("raw"))


@query(
    "Q28_scope_schema",
    """SELECT ws, field, message FROM (
      SELECT c_custkey AS ws, unnest(list_filter([CASE WHEN c_custkey % 4 = 0 THEN {'field': 'topic', 'message': 'must not be empty'} END, CASE WHEN c_custkey % 3 = 0 THEN {'field': 'goal_type', 'message': 'invalid goal_type'} END,
        CASE WHEN c_custkey % 5 = 0 THEN {'field': 'depth', 'message': 'expected str'} END, CASE WHEN c_custkey % 2 = 0 THEN {'field': 'search_directions', 'message': 'expected list of str'} END], lambda x: x IS NOT NULL), recursive := true)
      FROM customer WHERE c_custkey % 97 <> 0) UNION ALL SELECT c_custkey, '$', 'not a JSON object' FROM customer WHERE c_custkey % 97 = 0""",
)
def q28(t: Tables):
    return schemas.errors(_scope_json(t), "ws", "raw", schemas.scope_rules)


@query(
    "Q29_analysis_schema",
    """SELECT o_orderkey AS ws, 'sections[0].claims[1].sources' AS field, 'must not be empty' AS message FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, 'sections[0].title', 'missing required field: title' FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, 'sections[0].claims[0].precision', 'invalid precision' FROM orders WHERE o_orderkey % 5 = 0""",
)
def q29(t: Tables):
    k = F.col("o_orderkey")
    made = F.concat(
        F.lit('{"sections":[{"id":"a","content":"c"'), F.when(k % 3 != 0, ',"title":"t"').otherwise(""), F.lit(',"claims":[{"summary":"s","sources":["u"],"precision":"'), F.when(k % 5 == 0, "vague").otherwise("exact"),
        F.lit('"},{"summary":"s","sources":['), F.when(k % 2 != 0, '"u"').otherwise(""), F.lit("]}]}]}"),
    )
    return schemas.analysis_errors(t.orders.select(k.alias("ws"), made.alias("raw")), "ws", "raw")


@query(
    "Q30_collected_schema",
    "SELECT s_suppkey AS id, 'source_tier' AS field, 'expected int' AS message FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'direction', 'must not be empty' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'snippet', 'missing required field: snippet' FROM supplier",
)
def q30(t: Tables):
    k = F.col("s_suppkey")
    made = F.concat(F.lit('{"url":"u","title":"t","vendor_affiliation":null,"source_tier":'), F.when(k % 2 == 0, '"2"').otherwise("2"), F.lit(',"direction":"'), F.when(k % 3 == 0, " ").otherwise("d"), F.lit('"}'))
    return schemas.errors(t.supplier.select(k.alias("id"), made.alias("raw")), "id", "raw", schemas.collected_rules)


@query("Q31_plan_schema", "SELECT p_partkey AS id, 'status' AS field, 'invalid status' AS message FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'trigger_reason', 'missing required field: trigger_reason' FROM part")
def q31(t: Tables):
    made = F.concat(F.lit('{"id":"x","new_sources":[],"status":"'), F.when(F.col("p_partkey") % 2 == 0, "lost").otherwise("pending"), F.lit('"}'))
    return schemas.errors(t.part.select(F.col("p_partkey").alias("id"), made.alias("raw")), "id", "raw", schemas.target_rules)


@query(
    "Q32_trust_boundary",
    "SELECT o_orderkey AS id, 'untrusted' AS problem FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey WHERE s_suppkey IS NULL AND o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'invalid' FROM orders WHERE o_orderkey % 7 = 0",
)
def q32(t: Tables):
    from attestra.operators.joins import missing

    raw = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, "{").otherwise(F.format_string('{"id":"a","title":"t","content":"c","claims":[{"summary":"s","sources":["%d"]}]}', "o_custkey")).alias("raw"))
    bad = schemas.errors(raw, "id", "raw", schemas.section_rules).select("id", F.lit("invalid").alias("problem")).distinct()
    urls = raw.select("id", F.explode(F.from_json("raw", "claims array<struct<sources array<string>>>")["claims"]).alias("c")).select("id", F.explode("c.sources").alias("src"))
    return bad.unionByName(missing(urls, t.supplier.select(F.col("s_suppkey").cast("string").alias("src")), "src").select("id", F.lit("untrusted").alias("problem")))


# deep dive

_DD = [
    gate_sql("deep_dive_plan_exists", "BLOCKER", _N.format("targets"), "m >= 1", "1"),
    gate_sql("target_completion", "BLOCKER", _N.format("targets WHERE NOT (status = 'completed' OR (status = 'skipped' AND skip_reason IS NOT NULL))"), "m = 0"),
    gate_sql("deep_dive_source_depth", "BLOCKER", _N.format("targets WHERE status = 'completed' AND new_sources < 3"), "m = 0"),
    gate_sql("deep_dive_verification", "BLOCKER", _N.format("classed WHERE sv = 'source_absent' AND ((ws, sec) IN (SELECT ws, sec FROM targets) OR ws NOT IN (SELECT ws FROM targets))"), "m = 0"),
    """SELECT 'convergence_declared', CAST(s.ws AS VARCHAR), 'WARN', true, CASE WHEN p.ws IS NOT NULL AND convergence IS NULL THEN 0.0 ELSE 1.0 END, CAST(NULL AS DOUBLE),
       CASE WHEN p.ws IS NOT NULL AND convergence IS NULL THEN 'not yet declared' ELSE '' END FROM scope s LEFT JOIN plans p ON p.ws = s.ws""",
    """SELECT 'round_budget', CAST(s.ws AS VARCHAR), 'INFO', true, CAST(round AS DOUBLE), CASE WHEN p.ws IS NOT NULL THEN CAST(coalesce(max_rounds, 3) AS DOUBLE) END,
       CASE WHEN p.ws IS NOT NULL THEN round || '/' || coalesce(max_rounds, 3) ELSE '' END FROM scope s LEFT JOIN plans p ON p.ws = s.ws""",
]


@gate("Q33_deep_dive_gates", " UNION ALL ".join(_DD))
def q33(t: Tables):
    w = Workspaces(t)
    return gates.deep_dive_gates(w.scopes, w.targets, w.classified.select("ws", "sec", "sv"), w.plans)


@gate(
    "Q34_targets",
    """, t AS (SELECT ws, count(*) AS n, count(*) FILTER (sv = 'source_indirect') AS ind, count(*) FILTER (n_sources < 2) AS one FROM classed GROUP BY ws),
    e AS (SELECT ws, 1 AS o, 'source_absent' AS reason, sec, count(*) AS n FROM classed WHERE sv = 'source_absent' GROUP BY ws, sec UNION ALL SELECT ws, 2, 'source_indirect', '', ind FROM t WHERE ind / n > 0.3
      UNION ALL SELECT ws, 3, 'single_source', '', one FROM t WHERE one / n > 0.5 UNION ALL SELECT ws, 4, 'tension_unresolved', sec, count(*) FROM tensions WHERE NOT resolved GROUP BY ws, sec)
    SELECT ws, reason, sec, n, row_number() OVER (PARTITION BY ws ORDER BY o, sec) AS target FROM e""",
)
def q34(t: Tables):
    w = Workspaces(t)
    return gates.deep_dive_targets(w.classified, w.tensions)


@query("Q35_convergence", "SELECT p_partkey, CASE WHEN p_size % 5 >= 4 THEN 'hard' WHEN p_partkey % 3 = 0 THEN 'natural' WHEN p_partkey % 2 = 0 AND p_size % 5 >= 2 THEN 'soft' ELSE 'continue' END AS convergence FROM part")
def q35(t: Tables):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", gates.convergence(F.col("p_size") % 5, F.lit(4), k % 3, k % 2).alias("convergence"))


@query("Q36_plan_merge", "SELECT 'dd_' || (mx + row_number() OVER (ORDER BY p_partkey)) AS id, p_partkey FROM part, (SELECT max(s_suppkey) AS mx FROM supplier) UNION ALL SELECT 'dd_' || s_suppkey, NULL FROM supplier")
def q36(t: Tables):
    from attestra.operators.aggregates import next_ids

    old = t.supplier.select(F.col("s_suppkey").alias("n"))
    new = next_ids(old, t.part.select("p_partkey"), "n", ["p_partkey"])
    return new.select(F.concat(F.lit("dd_"), "n").alias("id"), "p_partkey").unionByName(old.select(F.concat(F.lit("dd_"), "n").alias("id"), F.lit(None).cast("long").alias("p_partkey")))


# live rule set


@gate(
    "Q47_scope_gates",
    "SELECT gate, CAST(ws AS VARCHAR) AS subject, 'BLOCKER' AS level, passed, CAST(NULL AS DOUBLE) AS metric, CAST(NULL AS DOUBLE) AS threshold, '' AS detail FROM (SELECT 'scope_topic' AS gate, ws, true AS passed FROM scope UNION ALL SELECT 'scope_goal_type', ws, true FROM scope UNION ALL SELECT 'scope_english_title', ws, ws % 2 <> 0 OR english_title IS NOT NULL FROM scope)",
)
def q47(t: Tables):
    return gates.scope_gates(Workspaces(t).scopes)


_LIVE = "directions WHERE direction <> 'other' AND (ws, direction) NOT IN (SELECT ws, direction FROM collected)"


@gate("Q48_live_direction_coverage", gate_sql("direction_coverage", "WARN", _N.format(_LIVE), "m = 0"))
def q48(t: Tables):
    w = Workspaces(t)
    return gates.direction_coverage(w.scopes, w.directions, w.collected, "WARN", fold=False)


@gate(
    "Q49_source_sufficiency",
    """SELECT 'source_sufficiency' AS gate, CAST(scope.ws AS VARCHAR) AS subject, 'WARN' AS level, coalesce(good, 0) > 0 AND coalesce(open, 0) = 0 AS passed, CAST(coalesce(open, 0) AS DOUBLE) AS metric, CAST(0 AS DOUBLE) AS threshold, '' AS detail
    FROM scope LEFT JOIN (SELECT ws, count(*) FILTER (tier <= 2) AS good FROM collected GROUP BY ws) USING (ws) LEFT JOIN (SELECT ws, count(*) AS open FROM questions WHERE (ws, question) NOT IN (SELECT ws, question FROM answered) GROUP BY ws) USING (ws)""",
)
def q49(t: Tables):
    w = Workspaces(t)
    return gates.source_sufficiency(w.scopes, w.collected, w.questions, w.answered)


@gate("Q50_precision_rules", gate_sql("precision_rules", "BLOCKER", _N.format("g WHERE pr = 'exact' AND ev IN ('third_party_estimate', 'qualitative_trend', 'expert_opinion')"), "m = 0"))
def q50(t: Tables):
    w = Workspaces(t)
    return gates.precision_rules(w.scopes, w.claims)


@gate("Q51_live_ref_marker_validity", gate_sql("ref_marker_validity", "BLOCKER", _N.format("markers WHERE ws IN (SELECT ws FROM collected) AND (ws, src) NOT IN (SELECT ws, src FROM collected)"), "m = 0"))
def q51(t: Tables):
    w = Workspaces(t)
    return gates.ref_marker_validity(w.scopes, w.markers, w.collected, only_collected=True)


# orchestration


_PHASES = "list_value(" + ", ".join(f"'{p}'" for p in pipeline.PHASES) + ")"


@query(
    "Q52_transitions",
    f"""WITH seen AS (SELECT {_PHASES}[event_id * 7 % 6 + 1] AS b, lag({_PHASES}[event_id * 7 % 6 + 1]) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events)
    SELECT a || '>' || b AS step, a || '>' || b IN ('scope>search', 'search>analysis', 'analysis>deep_dive', 'analysis>review', 'deep_dive>search', 'deep_dive>review', 'review>final', 'review>review') AS legal, count(*) AS n
    FROM seen WHERE a IS NOT NULL GROUP BY a, b""",
)
def q52(t: Tables):
    """The steps that each user's events take from phase to phase, and which of them are legal."""
    now = F.get(F.array(*map(F.lit, pipeline.PHASES)), (F.col("event_id") * 7 % 6).cast("int"))
    before = F.lag("b").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seen = t.events.withColumn("b", now).withColumn("a", before).where("a IS NOT NULL")
    return seen.groupBy("a", "b").agg(F.count("*").alias("n")).select(F.concat_ws(">", "a", "b").alias("step"), pipeline.legal(F.col("a"), F.col("b")).alias("legal"), "n")


@gate("Q53_named_blockers", f"SELECT count(*) AS blocked FROM ({gate_sql('min_sources', 'BLOCKER', _N.format('collected'), f'm >= {_LEAST}', _LEAST)}) WHERE NOT passed")
def q53(t: Tables):
    w = Workspaces(t)
    every = gates.min_sources(w.scopes, w.collected).unionByName(gates.claim_dedup(w.scopes, w.claims))
    return pipeline.blocking(every, ["min_sources", "url_traceability"]).agg(F.count("*").alias("blocked"))


@query("Q54_review_status", "SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 OR o_orderstatus = 'P' THEN 'degraded' WHEN o_orderkey % 4 > 0 THEN 'passed_with_issues' ELSE 'passed' END AS status FROM orders")
def q54(t: Tables):
    return t.orders.select("o_orderkey", pipeline.review_status(F.col("o_custkey") % 3, F.col("o_orderkey") % 4, F.col("o_orderstatus") == "P").alias("status"))


@query("Q55_verdict", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'pass_with_issues' WHEN 2 THEN 'fail' END AS verdict FROM orders")
def q55(t: Tables):
    body = F.get(F.array(F.lit("# R\nVerdict: **pass**"), F.lit("result pass_with_issues"), F.lit("intro\nVERDICT - fail"), F.lit("nothing said")), (F.col("o_orderkey") % 4).cast("int"))
    return t.orders.select("o_orderkey", pipeline.verdict(body).alias("verdict"))


_RESETS = ", ".join(f"('{p}', '{f}')" for p, files in pipeline.RESET.items() for f in files)


@query("Q56_reset", f"SELECT o_orderpriority, file, count(*) AS removals FROM orders JOIN (VALUES {_RESETS}) v(phase, file) ON phase = {_PHASES}[o_orderkey % 6 + 1] GROUP BY o_orderpriority, file")
def q56(t: Tables):
    """How often each artifact goes when every order is reset to its phase."""
    phase = F.get(F.array(*map(F.lit, pipeline.PHASES)), (F.col("o_orderkey") % 6).cast("int"))
    return t.orders.select("o_orderpriority", F.explode(pipeline.removed_by_reset(phase)).alias("file")).groupBy("o_orderpriority", "file").agg(F.count("*").alias("removals"))


@query("Q57_source_recommendation", f"WITH {fixture.SQL}, r AS (SELECT unnest([2, 3, 4, 1]) AS tier, generate_subscripts([2, 3, 4, 1], 1) AS step) SELECT step, tier, count(*) AS sources, array_to_string(list_sort(list(DISTINCT host)), ',') AS hosts FROM r JOIN src USING (tier) GROUP BY step, tier")
def q57(t: Tables):
    route = t.spark.createDataFrame([(k + 1, x) for k, x in enumerate(gates.ROUTES["tech_selection"])], "step int, tier int")
    return fixture.sources(t).join(F.broadcast(route), "tier").groupBy("step", "tier").agg(F.count("*").alias("sources"), F.array_join(F.sort_array(F.collect_set("host")), ",").alias("hosts"))


@query("Q58_min_source_default", "SELECT c_custkey, CAST(coalesce(CASE WHEN c_custkey % 5 = 0 THEN 4 END, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 8 END, 5) AS INTEGER) AS least FROM customer")
def q58(t: Tables):
    depth = F.get(F.array(F.lit("quick"), F.lit("standard"), F.lit("deep"), F.lit("odd")), (F.col("c_custkey") % 4).cast("int"))
    return t.customer.select("c_custkey", pipeline.default_min_sources(F.when(F.col("c_custkey") % 5 == 0, 4), gates.MIN_SOURCES, depth).alias("least"))


# rendering


@gate("R01_front_matter", "SELECT ws, '---' || chr(10) || 'topic: ' || topic || chr(10) || 'goal_type: ' || goal_type || chr(10) || 'date: 2024-01-31' || coalesce(chr(10) || 'english_title: ' || english_title, '') || chr(10) || '---' AS body FROM scope")
def r01(t: Tables):
    s = Workspaces(t).scopes
    fields = [("topic", F.col("topic")), ("goal_type", F.col("goal_type")), ("date", F.lit("2024-01-31")), ("english_title", F.col("english_title"))]
    return s.select("ws", render.front_matter(fields).alias("body"))


_NUM = ", num_ AS (SELECT ws, src, row_number() OVER (PARTITION BY ws ORDER BY f, src) AS number FROM (SELECT ws, src, min(cid) AS f FROM cites GROUP BY ws, src))"
_LINES = _NUM + """, li AS (SELECT c.ws, c.sec, c.cid, '- ' || summary || CASE sv WHEN 'source_absent' THEN '‡' WHEN 'source_indirect' THEN '†' ELSE '' END || coalesce(refs, '') AS line
  FROM classed c LEFT JOIN (SELECT ws, cid, string_agg(' [' || number || '][]', '' ORDER BY number) AS refs FROM cites JOIN num_ USING (ws, src) GROUP BY ws, cid) r USING (ws, cid))"""


def _claim_lines(w: Workspaces) -> DataFrame:
    from attestra.operators.order import first_seen_rank

    numbered = first_seen_rank(w.cites, ["ws"], "src", ["cid"])
    refs = w.cites.join(numbered, ["ws", "src"]).groupBy("ws", "cid").agg(F.sort_array(F.collect_list("number")).alias("numbers"))
    on = w.classified.join(refs, ["ws", "cid"], "left").withColumn("numbers", F.coalesce("numbers", F.array().cast("array<int>")))
    return on.select("ws", "sec", F.lit(0).alias("sec_order"), "cid", render.claim_line(F.col("summary"), F.col("sv"), F.col("numbers")).alias("line"))


@gate("R02_sections", _LINES + " SELECT ws, sha256(string_agg('## ' || sec || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY sec)) AS digest FROM (SELECT ws, sec, string_agg(line, chr(10) ORDER BY cid) AS body FROM li GROUP BY ws, sec) GROUP BY ws")
def r02(t: Tables):
    return render.sections(_claim_lines(Workspaces(t))).select("ws", F.sha2(F.col("body").cast("binary"), 256).alias("digest"))


_PCT = "CAST(CAST(floor(100 * count(*) FILTER (sv = '{0}') / count(*) + 0.5) AS INTEGER) AS VARCHAR)"


@gate(
    "R03_verification_table",
    "SELECT ws, '| class | claims | share |' || chr(10) || '|---|---|---|' " + " ".join(f"|| chr(10) || '| {c} | ' || count(*) FILTER (sv = '{c}') || ' | ' || {_PCT.format(c)} || '% |'" for c in render.CLASSES) + " AS body FROM classed GROUP BY ws",
)
def r03(t: Tables):
    return render.verification_table(Workspaces(t).classified)


@gate("R04_test_conditions", "SELECT ws, string_agg('| ' || summary || ' | ' || coalesce(conditions, '-') || ' | - | ' || coalesce(conf, '-') || ' |', chr(10) ORDER BY cid) AS body FROM g WHERE conditions IS NOT NULL OR conf IS NOT NULL GROUP BY ws")
def r04(t: Tables):
    c = Workspaces(t).claims.select("ws", "cid", "summary", "conditions", F.lit(None).cast("string").alias("date"), F.col("conf").alias("kind"))
    return render.conditions_table(c)


@gate("R05_references", _NUM + " SELECT ws, string_agg('[' || number || '] ' || coalesce(s_name, CAST(num_.src AS VARCHAR)) || coalesce(' (Tier ' || tier || ')', ''), chr(10) ORDER BY number) AS body FROM num_ LEFT JOIN (SELECT * FROM src WHERE s_suppkey % 6 <> 0) k ON k.s_suppkey = num_.src GROUP BY ws")
def r05(t: Tables):
    from attestra.operators.order import first_seen_rank

    w = Workspaces(t)
    known = fixture.sources(t).where("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("src"), F.col("s_name").alias("title"), "tier")
    return render.references(first_seen_rank(w.cites, ["ws"], "src", ["cid"]), known)


@gate("R06_marks", "SELECT sec, CASE sv WHEN 'source_absent' THEN '‡' WHEN 'source_indirect' THEN '†' ELSE '' END AS mark, count(*) AS n FROM classed GROUP BY 1, 2")
def r06(t: Tables):
    return Workspaces(t).classified.groupBy("sec", render.mark(F.col("sv")).alias("mark")).agg(F.count("*").alias("n"))


@gate("R07_checklist", "SELECT ws, string_agg(CASE WHEN (ws, question) IN (SELECT ws, question FROM answered) THEN '✓ Q' ELSE '✗ Q' END || question, chr(10) ORDER BY question) AS body FROM questions GROUP BY ws")
def r07(t: Tables):
    w = Workspaces(t)
    return render.checklist(w.questions, w.answered)


@gate("R08_compact", "SELECT ws, string_agg('## ' || sec || chr(10) || chr(10), chr(10) || chr(10) ORDER BY sec) AS body FROM sections GROUP BY ws")
def r08(t: Tables):
    return render.sections(_claim_lines(Workspaces(t)), compact=F.lit(True))
