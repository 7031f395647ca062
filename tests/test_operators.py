"""Operators on hand-made rows: ties, nulls, empties and conservation."""

from pyspark.sql import functions as F

from attestra.operators import aggregates, joins, order, pipeline, reports, sanitize, schemas, sets, verification


def test_keep_last_skips_blank_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("", 9), (None, 9), ("b", 2)], "k string, n int")
    assert sorted((r.k, r.n) for r in joins.keep_last(df, F.col("k"), [F.col("n")]).collect()) == [("a", 3), ("b", 2)]


def test_domain_tier(spark):
    pages = spark.createDataFrame([("https://a.b.com/x",), ("https://b.com",), ("https://xb.com",), ("",)], "url string")
    tiers = spark.createDataFrame([(0, "b.com", 1), (1, "com", 2)], "ord int, domain string, tier int")
    assert {r.url: r.tier for r in joins.domain_tier(pages, tiers).collect()} == {"https://a.b.com/x": 1, "https://b.com": 1, "https://xb.com": 2, "": 3}


def test_prefix_suggestions_match_brute_force(spark):
    words = ["aaaa", "aaab", "aa", "a", "b", "aaaac", "aaaab", "bbbb"]
    known = words[::2] + ["aaaazz"]
    n = 4
    want = {w: sorted({k for k in known if k.startswith(w[:n]) or w.startswith(k[:n])})[:3] for w in words}
    got = {w: [] for w in words}
    df = joins.prefix_suggestions(spark.createDataFrame([(w,) for w in words], "url string"), spark.createDataFrame([(k,) for k in known], "known string"), length=n)
    for r in df.orderBy("url", "rank").collect():
        got[r.url].append(r.known)
    assert got == want


def test_next_ids_are_dense(spark):
    old = spark.createDataFrame([(7,)], "n long")
    new = spark.range(1000).select(F.col("id").alias("x"))
    got = [(r.x, r.n) for r in aggregates.next_ids(old, new, "n", ["x"]).orderBy("x").collect()]
    assert got == [(k, 8 + k) for k in range(1000)]
    assert aggregates.next_ids(old.where("false"), new.limit(1), "n", ["x"]).first().n == 1


def test_split_conserves(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    a, b = sets.split(df, F.col("x") > 1)
    assert (a.count(), b.count()) == (1, 2)


def test_precedence_of_classes(spark):
    claims = spark.createDataFrame([(1, "official_data", "exact", "survey", True), (2, "expert_opinion", "exact", "survey", True), (3, "expert_opinion", "exact", "vendor_blog", True), (4, None, None, None, False)], "cid int, ev string, pr string, st string, has_number boolean")
    edges = spark.createDataFrame([(1, 3, True), (2, 3, True), (3, 1, True), (3, 4, False)], "cid int, tier int, supports boolean")
    flags = verification.edge_flags(edges)
    sv = lambda rs: {r.cid: r.source_verification for r in verification.classified(claims, flags, rs).collect()}
    assert sv("v2") == {1: "source_indirect", 2: "source_confirmed", 3: "source_indirect", 4: "source_confirmed"}
    assert sv("v1")[3] == "source_confirmed"


def test_entities(spark):
    df = spark.createDataFrame([("according to Acme, x", "acme.com"), ("Bolt reports that y", "z.org")], "s string, h string")
    got = [(r.e, r.m) for r in df.select(verification.cited_entity(F.col("s")).alias("e"), verification.entity_on_host(verification.cited_entity(F.col("s")), F.col("h")).alias("m")).collect()]
    assert got == [("acme", True), ("bolt", False)]


def test_windows(spark):
    df = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "a", "x"), (1, 2, "a", " "), (1, 3, "a", "x"), (1, 4, "b", "x")], "d int, p int, w string, t string")
    assert [r.p for r in order.adjacent_dedup(df, ["d"], ["w", "t"], "t", ["p"]).orderBy("p").collect()] == [0, 4]
    assert order.by_root_author(df, ["d"], "w", ["p"]).count() == 4
    seg = order.segments(df, ["d"], F.col("p").isin(0, 3), "p").orderBy("p").collect()
    assert [(r.p, r.next, r.body_rows) for r in seg] == [(0, 3, 2), (3, None, 1)]


def test_schema_errors(spark):
    raw = ['{"topic":"研究","goal_type":"other","depth":"quick"}', '{"goal_type":5,"depth":null}', "[]"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "id int, raw string")
    got = {(r.id, r.field, r.message) for r in schemas.errors(df, "id", "raw", schemas.scope_rules).collect()}
    assert got == {(0, "english_title", "required for a topic that is not ASCII"), (1, "topic", "missing required field: topic"), (1, "goal_type", "expected str"), (1, "depth", "expected str"), (2, "$", "not a JSON object")}


def test_report_gates(spark):
    good = "---\ntopic: a\ngoal_type: b\ndate: c\nreview_status: d\n---\n# T\nx [1]\n## References\n[1] one\n"
    bad = "# T\n#### U\n[2][]\n```\n## References\n[1]: http://x\n"
    df = spark.createDataFrame([("good", good), ("bad", bad)], "report_id string, body string")
    got = {(r.gate, r.subject): r.passed for r in reports.all_gates(df).collect()}
    assert len(got) == 20 and all(v for (g, s), v in got.items() if s == "good")
    failed = {g for (g, s), v in got.items() if s == "bad" and not v}
    assert failed == {"report_dangling_refs", "report_orphaned_defs", "report_refs_visibility", "report_front_matter", "report_heading_levels", "report_unclosed_code_blocks", "report_empty_sections"}


def test_machine(spark):
    none = spark.createDataFrame([], "gate string, level string, passed boolean")
    failing = spark.createDataFrame([("g", "BLOCKER", False)], "gate string, level string, passed boolean")
    assert pipeline.advance("scope", "search", "deep", none)[0]
    assert not pipeline.advance("scope", "final", "deep", none)[0]
    assert not pipeline.advance("analysis", "deep_dive", "quick", none)[0]
    assert not pipeline.advance("scope", "search", "deep", failing)[0]


def test_aliases(spark):
    df = spark.createDataFrame([(None, "t"), ("s", "t")], "summary string, text string")
    assert [r.summary for r in sanitize.aliased(df).collect()] == ["t", "s"]
    assert sanitize.whitelisted(df, ["text"]).columns == ["text"]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k string, n int, t string")
    assert aggregates.recurring_terms(none, F.col("t")).count() == 0
    assert aggregates.concentration(none, ["k"], "t").count() == 0
    assert joins.two_way_diff(none, none, "k").first().planned == 0
