"""Queries of the joins, aggregations, ordered and set operators, and of claim verification.

The tables have no claims, citations or statuses, so fixed arithmetic on keys says which rows play which part (collected,
defined, failed, ...). All rows of a table are read, and nothing is left out to save work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import urls
from attestra.operators import aggregates, joins, order, sets, verification
from attestra.plans import fixture
from attestra.plans.registry import Tables, query

_WITH = f"WITH {fixture.SQL} "
_WORDS = r"regexp_extract_all(text, '[^\s]+')"


def _norm_sql(c: str) -> str:
    """The normalised URL of this data's URLs, which have neither ;parameters nor anything to encode."""
    path, query_ = f"regexp_replace(lower(regexp_extract({c}, '://[^/?#]*([^?#]*)', 1)), '/+$', '')", f"regexp_extract({c}, '[?]([^#]*)', 1)"
    return (
        f"(lower(regexp_extract({c}, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract({c}, '://([^/?#]*)', 1)), '^www[.]', '')"
        f" || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query_} = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split({query_}, '&')), '&') END)"
    )


# joins


@query("J01_keep_last", f"SELECT url_norm, max(page_id) AS page_id FROM (SELECT page_id, {_norm_sql('url')} AS url_norm FROM pages) GROUP BY 1")
def j01(t: Tables):
    norm = t.pages.select("page_id", urls.normalize_url(F.col("url")).alias("url_norm"))
    return joins.keep_last(norm, F.col("url_norm"), [F.col("page_id")]).select("url_norm", "page_id")


@query("J02_url_set", f"SELECT DISTINCT {_norm_sql('url')} AS url_norm FROM pages")
def j02(t: Tables):
    return t.pages.select(urls.normalize_url(F.col("url")).alias("url_norm")).distinct()


@query("J03_untraceable", _WITH + "SELECT cid, s_suppkey FROM edge WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 9)")
def j03(t: Tables):
    return joins.missing(fixture.edges(t).select("cid", "s_suppkey"), t.supplier.where("s_suppkey % 10 <> 9").select("s_suppkey"), "s_suppkey").select("cid", "s_suppkey")


@query(
    "J04_marker_untraceable",
    f"""SELECT doc_id, url FROM (SELECT page_id AS doc_id, {_norm_sql("'http://x.example' || substr(url, 9)")} AS url FROM pages WHERE page_id % 4 = 0) WHERE url NOT IN (SELECT {_norm_sql('url')} FROM pages)""",
)
def j04(t: Tables):
    body = F.concat(F.lit("see {{ref:"), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("http://x.example"), F.substring("url", 9, 10_000))).otherwise(F.col("url")), F.lit("}} end"))
    markers = t.pages.select(F.col("page_id").alias("doc_id"), F.explode(F.regexp_extract_all(body, F.lit(r"\{\{ref:(.*?)\}\}"), F.lit(1))).alias("url"))
    return joins.missing(markers.withColumn("url", urls.normalize_url(F.col("url"))), t.pages.select(urls.normalize_url(F.col("url")).alias("url")), "url").select("doc_id", "url")


@query(
    "J05_all_references_untraceable",
    _WITH + """SELECT kind, id FROM (SELECT 'claim' AS kind, cid AS id, s_suppkey FROM edge UNION ALL SELECT 'insight', ps, ss FROM (SELECT p_partkey AS ps, p_partkey % 120 AS ss FROM part)
    UNION ALL SELECT 'tension', c_custkey, c_custkey % 130 FROM customer) WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def j05(t: Tables):
    refs = (
        fixture.edges(t).select(F.lit("claim").alias("kind"), F.col("cid").alias("id"), "s_suppkey")
        .unionByName(t.part.select(F.lit("insight").alias("kind"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 120).alias("s_suppkey")))
        .unionByName(t.customer.select(F.lit("tension").alias("kind"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 130).alias("s_suppkey")))
    )
    return joins.missing(refs, t.supplier.select("s_suppkey"), "s_suppkey").select("kind", "id")


@query(
    "J06_section_markers",
    _WITH + """SELECT cid, edge.s_suppkey FROM claim JOIN edge USING (cid) WHERE NOT EXISTS (SELECT 1 FROM supplier m WHERE m.s_suppkey = edge.s_suppkey AND m.s_suppkey % 5 = CAST(substr(section, 1, 1) AS BIGINT) - 1)""",
)
def j06(t: Tables):
    cited = fixture.claims(t).select("cid", "section").join(fixture.edges(t).select("cid", "s_suppkey"), "cid")
    marks = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 5).alias("k"))
    sections = fixture.claims(t).select("section").distinct().withColumn("k", F.left("section", F.lit(1)).cast("long") - 1)
    return joins.missing(cited, marks.join(F.broadcast(sections), "k").select("section", "s_suppkey"), ["section", "s_suppkey"]).select("cid", "s_suppkey")


@query("J07_tier_lookup", _WITH + "SELECT tier, count(*) AS edges FROM edge LEFT JOIN (SELECT * FROM src WHERE s_suppkey % 10 <> 9) USING (s_suppkey) GROUP BY tier")
def j07(t: Tables):
    known = fixture.sources(t).where("s_suppkey % 10 <> 9").select("s_suppkey", F.col("tier").alias("tier_known"))
    return fixture.edges(t).select("s_suppkey").join(known, "s_suppkey", "left").groupBy(F.col("tier_known").alias("tier")).agg(F.count("*").alias("edges"))


@query(
    "J08_default_severity",
    "SELECT coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, 'BLOCKER') AS severity, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def j08(t: Tables):
    listed = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("issue"), F.col("c_mktsegment").alias("severity"))
    return joins.with_default(t.orders.select(F.col("o_custkey").alias("issue")), listed, "issue", "severity", "BLOCKER").groupBy("severity").agg(F.count("*").alias("n"))


#: A small catalogue of domains: order, domain, tier. A domain that is listed twice has its last tier.
DOMAINS = [(0, "example.com", 2), (1, "ththth.example.org", 1), (2, "example.org", 3), (3, "tionsh.example.net", 4), (4, "example.com", 1)]


@query(
    "J09_domain_tier",
    r"""SELECT page_id, CAST(CASE WHEN regexp_matches(h, '(^|[.])ththth[.]example[.]org$') THEN 1 WHEN regexp_matches(h, '(^|[.])example[.]org$') THEN 3
    WHEN regexp_matches(h, '(^|[.])tionsh[.]example[.]net$') THEN 4 WHEN regexp_matches(h, '(^|[.])example[.]com$') THEN 1 ELSE 3 END AS INTEGER) AS tier
    FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h FROM pages)""",
)
def j09(t: Tables):
    tiers = t.spark.createDataFrame(DOMAINS, "ord int, domain string, tier int")
    return joins.domain_tier(t.pages.select("page_id", "url"), tiers).select("page_id", "tier")


@query(
    "J10_platform",
    "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://blog[.]') THEN 'blog' WHEN regexp_matches(url, '/\\d+[.]html') THEN 'article' WHEN regexp_matches(url, '^https?://m[.]') THEN 'mobile' ELSE 'generic' END AS platform FROM pages",
)
def j10(t: Tables):
    rules = [(r"^https?://blog\.", "blog"), (r"/\d+\.html", "article"), (r"^https?://m\.", "mobile")]
    return t.pages.select("page_id", urls.first_match(F.col("url"), rules, F.lit("generic")).alias("platform"))


@query(
    "J11_prefix_suggest",
    f"""WITH u AS (SELECT DISTINCT {_norm_sql('url')} AS url FROM pages WHERE contains(url, '?')), k AS (SELECT DISTINCT {_norm_sql('url')} AS known FROM pages WHERE NOT contains(url, '?'))
    SELECT url, known, rank FROM (SELECT url, known, row_number() OVER (PARTITION BY url ORDER BY known) AS rank FROM u JOIN k ON starts_with(known, substr(url, 1, 40)) OR starts_with(url, substr(known, 1, 40))) WHERE rank <= 3""",
)
def j11(t: Tables):
    norm = t.pages.select(F.contains("url", F.lit("?")).alias("asked"), urls.normalize_url(F.col("url")).alias("url"))
    return joins.prefix_suggestions(norm.where("asked"), norm.where("NOT asked").select(F.col("url").alias("known")))


@query("J12_contained_id", "SELECT p_partkey FROM part WHERE contains(p_type, p_brand) OR contains(lower(p_name), substr(lower(p_type), 1, 3))")
def j12(t: Tables):
    from attestra.operators.rules import shard_present

    names = F.array("p_type", F.lower("p_name"))
    wide = t.part.where(shard_present(names, F.col("p_brand")) | F.contains(F.lower("p_name"), F.left(F.lower("p_type"), F.lit(3))))
    return wide.select("p_partkey")


@query(
    "J13_entity_host",
    "SELECT page_id, CAST(list_contains(string_split(h, '.'), 'example') AS BOOLEAN) AS v1, starts_with(h, 'm.') OR ends_with(h, 'm.') OR h = 'm.' AS v2 FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h FROM pages)",
)
def j13(t: Tables):
    h = urls.host(F.col("url"))
    return t.pages.select("page_id", verification.entity_on_host(F.lit("example"), h, "v1").alias("v1"), verification.entity_on_host(F.lit("m."), h, "v2").alias("v2"))


@query("J14_number_support", _WITH + "SELECT section, count(*) FILTER (coalesce(hit, false)) AS supported, count(*) AS claims FROM claim LEFT JOIN flag USING (cid) GROUP BY section")
def j14(t: Tables):
    from attestra.functions.numbers import supported

    body = t.lineitem.groupBy(F.col("l_orderkey").alias("cid")).agg(F.array_join(F.collect_list(F.col("l_quantity").cast("long")), " ; ").alias("body"))
    on = fixture.claims(t).join(body, "cid", "left").select("section", supported(F.col("summary"), F.coalesce("body", F.lit(""))).alias("ok"))
    return on.groupBy("section").agg(F.count(F.when(F.col("ok"), 1)).alias("supported"), F.count("*").alias("claims"))


@query("J15_coverage", "SELECT lang, source FROM (SELECT DISTINCT lang, source FROM documents) WHERE (lang, source) NOT IN (SELECT lang, source FROM documents WHERE n_chars > 20000)")
def j15(t: Tables):
    return joins.uncovered(t.documents.select("lang", "source"), t.documents.where("n_chars > 20000").select("lang", "source"), ["lang", "source"])


@query("J16_tier_division", _WITH + "SELECT direction, tier FROM (SELECT DISTINCT direction FROM src) CROSS JOIN (SELECT unnest([1, 2, 3]) AS tier) WHERE (direction, tier) NOT IN (SELECT direction, tier FROM src)")
def j16(t: Tables):
    s = fixture.sources(t).select("direction", "tier")
    return joins.uncovered(s.select("direction").distinct().withColumn("tier", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))), s, ["direction", "tier"])


@query("J17_direction_anchored", _WITH + "SELECT direction FROM (SELECT DISTINCT direction FROM src) WHERE direction NOT IN (SELECT direction FROM src JOIN edge USING (s_suppkey) JOIN claim USING (cid) WHERE ev = 'official_data' AND pr = 'exact' AND num > 49)")
def j17(t: Tables):
    s = fixture.sources(t).select("s_suppkey", "direction")
    anchored = fixture.edges(t).select("cid", "s_suppkey").join(fixture.claims(t).where("ev = 'official_data' AND pr = 'exact' AND num > 49").select("cid"), "cid").join(s, "s_suppkey").select("direction")
    return joins.uncovered(s.select("direction"), anchored, "direction")


@query(
    "J18_dq_sufficiency",
    _WITH + """SELECT c_custkey AS question FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN edge ON o_orderkey = edge.cid JOIN src USING (s_suppkey) WHERE tier <= 2 AND o_orderpriority = '1-URGENT')""",
)
def j18(t: Tables):
    good = fixture.edges(t).where("tier <= 2").select("cid").distinct()
    answered = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("cid"), F.col("o_custkey").alias("question")).join(good, "cid", "left_semi")
    return joins.uncovered(t.customer.select(F.col("c_custkey").alias("question")), answered.select("question"), "question")


@query("J19_required_sections", "SELECT unnest(['1-URGENT', '2-HIGH', '9-NONE']) AS section EXCEPT SELECT o_orderpriority FROM orders")
def j19(t: Tables):
    required = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("9-NONE",)], "section string")
    return joins.uncovered(required, t.orders.select(F.col("o_orderpriority").alias("section")), "section")


@query(
    "J20_two_way_diff",
    """SELECT planned_only, actual_only, planned, (planned_only + actual_only) / planned AS deviation FROM (SELECT count(*) FILTER (a IS NULL) AS planned_only, count(*) FILTER (p IS NULL) AS actual_only, count(p) AS planned
    FROM (SELECT DISTINCT l_partkey AS k, 1 AS p FROM lineitem WHERE l_quantity < 10) x FULL JOIN (SELECT DISTINCT l_partkey AS k, 1 AS a FROM lineitem WHERE l_quantity > 45) y USING (k))""",
)
def j20(t: Tables):
    return joins.two_way_diff(t.lineitem.where("l_quantity < 10").select("l_partkey"), t.lineitem.where("l_quantity > 45").select("l_partkey"), "l_partkey")


@query(
    "J21_overlap",
    r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda w: w <> '') AS w, doc_id % 40 AS item_id FROM documents),
    b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda w: w <> '')) AS s FROM benchmark)
    SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: list_contains(s, x))) / len(w) END AS overlap FROM d JOIN b USING (item_id)""",
)
def j21(t: Tables):
    d = t.documents.select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"))
    b = t.benchmark.select("item_id", F.col("text").alias("snippet"))
    return d.join(b, "item_id").select("doc_id", joins.overlap_ratio(F.col("text"), F.col("snippet")).alias("overlap"))


@query(
    "J22_upsert",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'new' END ELSE c_name END AS c_name, CASE WHEN c_custkey % 15 = 0 THEN 99 ELSE c_nationkey END AS c_nationkey FROM customer""",
)
def j22(t: Tables):
    base = t.customer.select("c_custkey", "c_name", "c_nationkey")
    updates = t.customer.where("c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "new").alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, 99).alias("c_nationkey"))
    return joins.upsert(base, updates, "c_custkey", ["c_name", "c_nationkey"], keep_if_null=["c_nationkey"])


@query("J23_reference_labels", _WITH + "SELECT cid, edge.s_suppkey, coalesce(s_name, 'supplier ' || edge.s_suppkey) AS label FROM edge LEFT JOIN (SELECT * FROM src WHERE s_suppkey % 6 <> 0) k ON k.s_suppkey = edge.s_suppkey")
def j23(t: Tables):
    named = t.supplier.where("s_suppkey % 6 <> 0").select("s_suppkey", "s_name")
    cited = fixture.edges(t).select("cid", "s_suppkey").join(named, "s_suppkey", "left")
    return cited.select("cid", "s_suppkey", F.coalesce("s_name", F.concat(F.lit("supplier "), "s_suppkey")).alias("label"))


# aggregations


@query("A01_status_counts", "SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type NOT IN ('click', 'view')) AS other, count(*) AS total FROM events")
def a01(t: Tables):
    return aggregates.status_counts(t.events, F.col("event_type"), ["CLICK", "VIEW"])


@query("A02_single_source_ratio", _WITH + "SELECT section, avg(CASE WHEN n_sources < 2 THEN 1.0 ELSE 0.0 END) AS ratio, avg(CASE WHEN n_sources < 2 THEN 1.0 ELSE 0.0 END) > 0.7 AS warn FROM cls GROUP BY section")
def a02(t: Tables):
    ratio = fixture.classified(t).groupBy("section").agg(aggregates.share(F.col("n_sources") < 2).alias("ratio"))
    return ratio.withColumn("warn", F.col("ratio") > 0.7)


@query("A03_missing_metadata", "SELECT o_orderpriority AS section, avg(CASE WHEN o_orderkey % 7 = 0 OR o_custkey % 9 = 0 THEN 1.0 ELSE 0.0 END) > 0.5 AS warn, count(*) FILTER (o_orderkey % 7 = 0 OR o_custkey % 9 = 0) AS lacking FROM orders GROUP BY 1")
def a03(t: Tables):
    d = t.orders.select(F.col("o_orderpriority").alias("section"), F.when(F.col("o_orderkey") % 7 != 0, 1).alias("a"), F.when(F.col("o_custkey") % 9 != 0, 1).alias("b"))
    lacks = F.col("a").isNull() | F.col("b").isNull()
    return d.groupBy("section").agg((aggregates.share(lacks) > 0.5).alias("warn"), F.count(F.when(lacks, 1)).alias("lacking"))


@query("A04_tier_balance", _WITH + "SELECT section, count(*) FILTER (tier <= 2) / count(*) AS share FROM (SELECT DISTINCT section, s_suppkey, tier FROM claim JOIN edge USING (cid) JOIN src USING (s_suppkey) WHERE s_suppkey % 10 <> 9) GROUP BY section")
def a04(t: Tables):
    cited = fixture.claims(t).select("cid", "section").join(fixture.edges(t).where("s_suppkey % 10 <> 9").select("cid", "s_suppkey", "tier"), "cid").select("section", "s_suppkey", "tier").distinct()
    return cited.groupBy("section").agg((F.count(F.when(F.col("tier") <= 2, 1)) / F.count("*")).alias("share"))


@query(
    "A05_fidelity",
    """WITH d AS (SELECT doc_id % 13 = 0 AS failed, CASE WHEN doc_id % 11 <> 0 THEN n_chars END AS chars, CASE WHEN doc_id % 5 = 0 THEN 0.9 ELSE 0.1 END AS overlap FROM documents),
    c AS (SELECT count(*) AS total, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT failed AND coalesce(chars, 0) = 0) AS missing, count(*) FILTER (NOT failed AND chars > 0 AND chars < 2000) AS shallow,
                 count(*) FILTER (NOT failed AND chars >= 2000 AND chars < 5000) AS thin, count(*) FILTER (NOT failed AND chars >= 2000 AND overlap > 0.8) AS overlapping FROM d)
    SELECT *, missing / (total - failed) AS missing_ratio, shallow / (total - failed) AS shallow_ratio, thin / (total - failed) AS thin_ratio, failed / total AS exempt_ratio,
      CASE WHEN missing / (total - failed) > 0.3 THEN 'block_missing' WHEN shallow / (total - failed) > 0.3 THEN 'block_shallow' WHEN overlapping / (total - failed) > 0.3 THEN 'block_overlap'
           WHEN failed / total > 0.5 THEN 'warn_exempt' WHEN missing > 0 THEN 'warn_missing' WHEN shallow > 0 OR thin > 0 THEN 'warn_depth' ELSE 'pass' END AS verdict FROM c""",
)
def a05(t: Tables):
    d = t.documents.select((F.col("doc_id") % 13 == 0).alias("failed"), F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("chars"), F.when(F.col("doc_id") % 5 == 0, 0.9).otherwise(0.1).alias("overlap"))
    return aggregates.fidelity(d, F.col("failed"), F.col("chars"), F.col("overlap"))


@query(
    "A06_concentration",
    _WITH + """, n AS (SELECT section, host, count(*) AS n FROM claim JOIN edge USING (cid) JOIN src USING (s_suppkey) GROUP BY 1, 2), m AS (SELECT section, sum(n) AS total, max(n) AS most FROM n GROUP BY 1)
    SELECT section, min(host) AS host, CAST(any_value(most) AS BIGINT) AS most, CAST(any_value(total) AS BIGINT) AS total, CAST(any_value(most) AS DOUBLE) / any_value(total) AS share FROM n JOIN m USING (section) WHERE n = most GROUP BY section""",
)
def a06(t: Tables):
    cited = fixture.claims(t).select("cid", "section").join(fixture.edges(t).select("cid", "host"), "cid")
    return aggregates.concentration(cited, ["section"], "host")


@query("A07_verification_summary", _WITH + "SELECT section, sv AS source_verification, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY section) AS DOUBLE) AS ratio FROM cls GROUP BY section, sv")
def a07(t: Tables):
    return aggregates.histogram(fixture.classified(t), ["section"], "source_verification")


@query(
    "A08_worst_of",
    _WITH + """SELECT s_suppkey, list_value('source_confirmed', 'source_indirect', 'source_absent')[max(CASE sv WHEN 'source_confirmed' THEN 1 WHEN 'source_indirect' THEN 2 ELSE 3 END)] AS source_verification FROM cls JOIN edge USING (cid) GROUP BY s_suppkey""",
)
def a08(t: Tables):
    cited = fixture.classified(t).select("cid", "source_verification").join(fixture.edges(t).select("cid", "s_suppkey"), "cid")
    return aggregates.worst_of(cited, "s_suppkey", "source_verification")


@query(
    "A09_exact_dups",
    "SELECT substr(v, 1, 40) AS preview, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS places FROM (SELECT trim(text, ' ') AS v, source FROM documents) WHERE v <> '' GROUP BY v HAVING count(*) > 1",
)
def a09(t: Tables):
    return aggregates.exact_duplicates(t.documents.select("text", "source"), F.col("text"), "source")


@query("A10_mixed_types", _WITH + "SELECT section, st, count(DISTINCT metric_type) AS kinds FROM claim WHERE ev IN ('official_data', 'independent_benchmark') GROUP BY 1, 2 HAVING count(DISTINCT metric_type) > 1")
def a10(t: Tables):
    return aggregates.distinct_over(fixture.claims(t).where(F.col("ev").isin("official_data", "independent_benchmark")), ["section", "st"], "metric_type")


@query("A11_variance_conflict", _WITH + "SELECT section, metric_type, count(num) AS n, CAST(min(num) AS DOUBLE) AS low, CAST(max(num) AS DOUBLE) AS high FROM claim WHERE pr = 'exact' GROUP BY 1, 2 HAVING count(*) >= 2 AND (max(num) - min(num)) / avg(num) > 0.05")
def a11(t: Tables):
    d = aggregates.precise_values(fixture.claims(t).where("pr = 'exact'").select("section", "metric_type", "summary"), F.col("summary"))
    return aggregates.variance_conflicts(d, ["section", "metric_type"], "value").drop("mean")


@query(
    "A12_entity_conflict",
    r"""WITH p AS (SELECT DISTINCT lower(regexp_extract(x, '([A-Za-z]{3,})', 1)) AS entity, replace(regexp_extract(x, '(\d[\d,]*\d)$', 1), ',', '') AS number
      FROM (SELECT unnest(regexp_extract_all(p_name || ' ' || p_brand || ' sold ' || (p_size + 10), '[A-Za-z][A-Za-z]{2,}\s+(?:[a-z]+\s+){0,2}?\d[\d,]*\d')) AS x FROM part))
    SELECT entity, count(*) AS numbers, min(number) AS first, max(number) AS last FROM p WHERE length(entity) >= 3 GROUP BY entity HAVING count(*) > 1""",
)
def a12(t: Tables):
    body = F.concat_ws(" ", "p_name", "p_brand", F.lit("sold"), F.col("p_size") + 10)
    return aggregates.entity_conflicts(t.part.select(body.alias("body")), F.col("body"))


@query("A13_facet_coverage", _WITH + "SELECT section, bool_or(tier = 1) AS t1, bool_or(tier = 2) AS t2, count(DISTINCT host) FILTER (tier = 4) AS t4_hosts, count(DISTINCT host) FILTER (tier = 4) < 2 AS thin FROM claim JOIN edge USING (cid) JOIN src USING (s_suppkey) GROUP BY section")
def a13(t: Tables):
    cited = fixture.claims(t).select("cid", "section").join(fixture.edges(t).select("cid", "tier", "host"), "cid")
    hosts = F.countDistinct(F.when(F.col("tier") == 4, F.col("host")))
    return cited.groupBy("section").agg(F.bool_or(F.col("tier") == 1).alias("t1"), F.bool_or(F.col("tier") == 2).alias("t2"), hosts.alias("t4_hosts"), (hosts < 2).alias("thin"))


_STOP = "('" + "', '".join(aggregates.text.STOP_WORDS) + "')"


@query("A14_recurring_terms", f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{{3,}}')) AS term FROM documents) WHERE term NOT IN {_STOP} GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 20")
def a14(t: Tables):
    return aggregates.recurring_terms(t.documents, F.col("text"))


@query("A15_next_id", "SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY o_orderkey) AS event_id, o_orderkey FROM orders")
def a15(t: Tables):
    return aggregates.next_ids(t.events, t.orders.select("o_orderkey"), "event_id", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("A16_reconcile", "SELECT event_type, count(*) AS before, count(*) FILTER (event_id % 3 = 0) AS archived, count(*) - count(*) FILTER (event_id % 3 = 0) AS after, true AS conserved FROM events GROUP BY event_type")
def a16(t: Tables):
    gone, kept = sets.split(t.events, F.col("event_id") % 3 == 0)
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("before"))
    counts = counts.join(gone.groupBy("event_type").agg(F.count("*").alias("archived")), "event_type", "left").join(kept.groupBy("event_type").agg(F.count("*").alias("after")), "event_type", "left")
    counts = counts.na.fill(0, ["archived", "after"])
    return counts.withColumn("conserved", F.col("before") == F.col("archived") + F.col("after"))


@query(
    "A17_phrase_density",
    """SELECT doc_id, ((length(t) - length(replace(t, 'of the', ''))) // 6 + (length(t) - length(replace(t, 'the', ''))) // 3) / nullif(len(regexp_extract_all(text, '[^\\s　-〿＀-￯]+')), 0) AS density
    FROM (SELECT doc_id, text, lower(text) AS t FROM documents)""",
)
def a17(t: Tables):
    from attestra.functions.text import phrase_density

    return t.documents.select("doc_id", phrase_density(F.col("text"), ["of the", "the"]).alias("density"))


@query(
    "A18_line_quality",
    r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents)
    SELECT doc_id, coalesce(len(list_filter(l, lambda x: regexp_matches(x, '^.{0,20}$'))) / nullif(len(l), 0), 0.0) AS padding_ratio, coalesce(len(list_filter(l, lambda x: regexp_matches(x, '[|]|^[A-Z]'))) / nullif(len(l), 0), 0.0) AS template_ratio FROM l""",
)
def a18(t: Tables):
    return aggregates.line_quality(t.documents.select("doc_id", "text"), F.col("text"), r"^.{0,20}$", r"[|]|^[A-Z]").drop("text")


@query("A19_gate_passes", "SELECT o_orderpriority AS section, bool_and(o_orderkey % 5000 <> 0) AS passed FROM orders GROUP BY 1")
def a19(t: Tables):
    return t.orders.groupBy(F.col("o_orderpriority").alias("section")).agg((~F.bool_or(F.col("o_orderkey") % 5000 == 0)).alias("passed"))


@query("A20_new_sources", _WITH + "SELECT section, CAST(sum(n_sources) AS BIGINT) AS new_sources FROM cls WHERE pr IN ('exact', 'range') GROUP BY section")
def a20(t: Tables):
    return fixture.classified(t).where(F.col("pr").isin("exact", "range")).groupBy("section").agg(F.sum("n_sources").alias("new_sources"))


@query("A21_min_sources", _WITH + "SELECT cid, n_sources FROM cls WHERE pr = 'exact' AND n_sources < 3")
def a21(t: Tables):
    return fixture.classified(t).where("pr = 'exact' AND n_sources < 3").select("cid", F.col("n_sources").cast("long").alias("n_sources"))


@query(
    "A22_fix_summary",
    "SELECT count(*) FILTER (s = 'BLOCKER' AND o_orderstatus = 'F') AS blocker_fixed, count(*) FILTER (s = 'BLOCKER' AND o_orderstatus <> 'F') AS blocker_skipped, count(*) FILTER (s <> 'BLOCKER' AND o_orderstatus <> 'F') AS warn_skipped FROM (SELECT o_orderstatus, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN 'WARN' END, 'BLOCKER') AS s FROM orders LEFT JOIN customer ON o_custkey = c_custkey)",
)
def a22(t: Tables):
    from attestra.operators.rules import fix_summary

    report = t.orders.select(F.col("o_custkey").alias("issue"), F.when(F.col("o_orderstatus") == "F", "fixed").otherwise("skipped").alias("status"))
    return fix_summary(report, t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("issue"), F.lit("WARN").alias("severity")))


@query("A23_joined_first", "SELECT source, array_to_string(list_sort(list(DISTINCT doc_id))[1:5], '; ') || CASE WHEN count(DISTINCT doc_id) > 5 THEN ' …' ELSE '' END AS first FROM documents GROUP BY source")
def a23(t: Tables):
    from attestra.operators.rules import joined_first

    return t.documents.groupBy("source").agg(joined_first(F.col("doc_id"), 5).alias("first"))


@query("A24_weighted_rank", "SELECT event_type AS item, count(*) AS n, CAST(sum(CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END) AS BIGINT) AS weight FROM events GROUP BY 1")
def a24(t: Tables):
    weight = F.when(F.col("user_id") % 3 == 0, 1).when(F.col("user_id") % 3 == 1, 3).otherwise(5)
    return aggregates.weighted_rank(t.events, F.array("event_type"), weight)


@query("A25_pass_rate", "SELECT source, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS rate, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) < 0.8 OR bool_or(quality <> 1 AND toxic = 1) AS flagged FROM labels JOIN documents USING (doc_id) GROUP BY source")
def a25(t: Tables):
    on = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return aggregates.pass_rates(on, "source", F.col("quality") == 1, F.when(F.col("toxic") == 1, "P0").otherwise("P2"))


# ordered


@query("W01_first_seen_rank", "SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY f, l_suppkey) AS number FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2)")
def w01(t: Tables):
    return order.first_seen_rank(t.lineitem, ["l_orderkey"], "l_suppkey", ["l_linenumber"])


@query("W02_level_skip", "SELECT conv_id, turn, level, previous FROM (SELECT *, lag(level) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT conv_id, turn, 1 + length(text) % 6 AS level FROM conversations)) WHERE level > previous + 1")
def w02(t: Tables):
    return order.level_skips(t.conversations.select("conv_id", "turn", (1 + F.length("text") % 6).cast("long").alias("level")), ["conv_id"], "level", ["turn"])


@query(
    "W03_segments",
    """SELECT conv_id, turn, next, coalesce(next, e) - turn - 1 AS body_rows FROM (SELECT conv_id, turn, e, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next
    FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) + 1 AS e FROM conversations) WHERE role = 'user')""",
)
def w03(t: Tables):
    return order.segments(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], F.col("role") == "user", "turn").drop("role")


@query("W04_adjacent_dedup", "SELECT conv_id, turn FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE trim(coalesce(text, '')) <> '') WHERE r IS NULL OR r <> role")
def w04(t: Tables):
    return order.adjacent_dedup(t.conversations, ["conv_id"], ["role"], "text", ["turn"]).select("conv_id", "turn")


@query("W05_root_author", "SELECT conv_id, turn, role FROM (SELECT *, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE coalesce(r, '') = '' OR role = r")
def w05(t: Tables):
    return order.by_root_author(t.conversations, ["conv_id"], "role", ["turn"]).select("conv_id", "turn", "role")


_IMG = "'![a](https://i.example/' || (doc_id % 3) || '){width=\"600\"}'"


@query("W06_image_lines", f"SELECT doc_id, {_IMG} || chr(10) || 'x' || chr(10) || '![b](https://i.example/9){{width=\"600\"}}' AS body FROM documents")
def w06(t: Tables):
    from attestra.functions.html import distinct_image_lines

    img = F.concat(F.lit("![a](https://i.example/"), F.col("doc_id") % 3, F.lit('){width="600"}'))
    body = F.concat_ws("\n", img, F.lit("x"), img, F.lit('![b](https://i.example/9){width="600"}'))
    return t.documents.select("doc_id", distinct_image_lines(body).alias("body"))


@query(
    "W07_keep_first",
    "SELECT page_id, key, row_number() OVER (ORDER BY page_id) AS number FROM (SELECT min(page_id) AS page_id, key FROM (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS key FROM pages) GROUP BY key)",
)
def w07(t: Tables):
    first = joins.keep_first(t.pages.select("page_id", F.regexp_extract("url", "^([^?#]*)", 1).alias("key")), F.col("key"), [F.col("page_id")])
    none = t.spark.createDataFrame([], "number long")
    return aggregates.next_ids(none, first, "number", ["page_id"]).select("page_id", "key", "number")


@query(
    "W08_tail_cut",
    r"""SELECT doc_id, sha256(CASE WHEN cut IS NULL THEN text ELSE regexp_replace(array_to_string(l[1:cut - 1], chr(10)), '\s+$', '') END) AS digest FROM (
      SELECT doc_id, text, l, list_min(list_filter(range(greatest(len(l) - 30, 0) + 1, len(l) + 1), lambda i: contains(l[i], 'License') OR contains(l[i], 'ing.'))) AS cut FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents))""",
)
def w08(t: Tables):
    from attestra.functions.html import tail_cut

    return t.documents.select("doc_id", F.sha2(tail_cut(F.col("text"), ["License", "ing."]).cast("binary"), 256).alias("digest"))


@query("W09_section_skip", "SELECT doc_id, '# A' || chr(10) || 'a' || chr(10) || '## C' || chr(10) || 'c' AS body FROM documents")
def w09(t: Tables):
    from attestra.functions.html import COMMENTS, without_sections

    body = F.concat_ws("\n", F.lit("# A"), F.lit("a"), F.lit("## Comments"), F.col("lang"), F.lit("#### deep"), F.lit("## Discussion"), F.lit("y"), F.lit("## C"), F.lit("c"))
    return t.documents.select("doc_id", without_sections(body, COMMENTS).alias("body"))


@query("W10_until_noise", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' || chr(10) || event_type ELSE 'a' END AS kept FROM events")
def w10(t: Tables):
    from attestra.operators.rules import until

    lines = F.array(F.lit("a"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("12K"), F.lit("Reply"), F.lit("b"))
    return t.events.select("event_id", F.array_join(until(lines, r"(?i)^(\d[\d.,]*[km]?|reply|like|share)$"), "\n").alias("kept"))


@query("W11_table_rows", "SELECT p_partkey, 2 + p_partkey % 3 AS header, 3 AS delimiter FROM part WHERE 2 + p_partkey % 3 <> 3")
def w11(t: Tables):
    from attestra.operators.reports import table_mismatches

    body = F.concat(F.expr("repeat('|a', CAST(1 + p_partkey % 3 AS INT))"), F.lit("|\n\n|-|-|\n|1|2|"))
    return table_mismatches(t.part.select(F.col("p_partkey"), body.alias("body")), "p_partkey", "body").select("p_partkey", F.col("header").cast("long").alias("header"), "delimiter")


@query("W12_repeated_lines", "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 20 GROUP BY 1, 2 HAVING count(*) > 1")
def w12(t: Tables):
    rows = order.mentioned_lines(t.documents, "doc_id", "text").where(F.length("line") > 20)
    return order.repeated(rows, ["doc_id"], ["line"])


@query("O01_precedence_sort", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN 1 ELSE 2 END, CASE WHEN p_partkey % 3 < 2 THEN p_size ELSE 0 END, p_name, p_partkey) AS position FROM part")
def o01(t: Tables):
    from pyspark.sql.window import Window

    keys = order.precedence(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")), F.when(F.col("p_partkey") % 3 == 1, F.col("p_size")), F.col("p_name"))
    return t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(*keys, "p_partkey")).alias("position"))


@query("O02_stable_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 10 END, 0), o_orderkey) AS position FROM orders")
def o02(t: Tables):
    from pyspark.sql.window import Window

    explicit = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 10)
    return t.orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.coalesce(explicit, F.lit(0)), "o_orderkey")).alias("position"))


@query("O05_newest", "SELECT user_id, max(event_id) AS event_id FROM events JOIN (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1) USING (user_id, ts) GROUP BY user_id")
def o05(t: Tables):
    return t.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("O06_first_links", "SELECT DISTINCT url FROM pages ORDER BY url LIMIT 10")
def o06(t: Tables):
    return t.pages.select("url").distinct().orderBy("url").limit(10)


@query("O07_sorted_distinct", "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY lang")
def o07(t: Tables):
    return t.documents.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query(
    "O08_priority_topn",
    "SELECT o_custkey, o_orderkey, position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS position FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE position <= 3",
)
def o08(t: Tables):
    return order.priority_top(t.orders, ["o_custkey"], "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 3, ["1-URGENT", "2-HIGH"]).select("o_custkey", "o_orderkey", "position")


# sets


@query("X01_dangling_orphan", "SELECT k, 'dangling' AS side FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0) UNION ALL SELECT p_partkey, 'orphaned' FROM part WHERE p_partkey % 4 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def x01(t: Tables):
    return sets.dangling_and_orphaned(t.lineitem.select(F.col("l_partkey").alias("k")), t.part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("k")), ["k"])


@query("X02_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 5 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 46")
def x02(t: Tables):
    return t.lineitem.where("l_quantity < 5").select(F.col("l_partkey").alias("k")).intersect(t.lineitem.where("l_quantity > 46").select(F.col("l_partkey").alias("k")))


@query("X03_ordered_union", "SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS path FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 IN (1, 2) THEN [1, 2] ELSE list_concat([1, 2], [p_partkey % 5]) END AS list_distinct_ordered FROM part)")
def x03(t: Tables):
    union = F.array_union(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), F.array(F.col("p_partkey") % 5))
    return t.part.select("p_partkey", F.array_join(union, ",").alias("path"))


@query("X04_union_all", "SELECT k, count(*) AS n FROM (SELECT l_partkey AS k FROM lineitem UNION ALL SELECT p_partkey FROM part) GROUP BY k")
def x04(t: Tables):
    return t.lineitem.select(F.col("l_partkey").alias("k")).unionByName(t.part.select(F.col("p_partkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n"))


@query("X05_union", "SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier")
def x05(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("k")).union(t.supplier.select("s_suppkey")).distinct()


@query("X06_archive_split", "SELECT count(*) FILTER (event_type = 'click') AS archived, count(*) FILTER (event_type <> 'click') AS kept, count(*) AS total, true AS conserved FROM events")
def x06(t: Tables):
    return sets.split_counts(t.events, F.col("event_type") == "click")


# verification


@query("Q25_classify", _WITH + "SELECT cid, sv AS source_verification FROM cls")
def q25(t: Tables):
    return fixture.classified(t).select("cid", "source_verification")


_V1 = """SELECT cid, (ev IN ('official_data', 'third_party_estimate') AND coalesce(low, false)) OR (st IN ('analyst_forecast', 'vendor_benchmark', 'vendor_survey', 'vendor_blog') AND pr IN ('exact', 'range') AND NOT coalesce(high, false)) AS indirect FROM claim LEFT JOIN flag USING (cid)"""


@query("Q26_indirect_v1", _WITH + _V1)
def q26(t: Tables):
    return fixture.classified(t, "v1").select("cid", (F.col("source_verification") == "source_indirect").alias("indirect"))


@query("Q27_write_back", _WITH + "SELECT section, count(*) FILTER (sv <> 'source_absent') AS verified, count(*) FILTER (sv = 'source_absent') AS unverified FROM cls GROUP BY section")
def q27(t: Tables):
    return fixture.classified(t).groupBy("section").agg(F.count(F.when(F.col("verified"), 1)).alias("verified"), F.count(F.when(~F.col("verified"), 1)).alias("unverified"))
