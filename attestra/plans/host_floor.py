"""Queries of what the host engine offers beside the inventory: joins on time, streams, large keyword lists, totals on several levels,
sketches, SQL functions, logs with several writers, and a source for Markdown folders."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from attestra.functions import registered
from attestra.operators import keywords, render, temporal, totals
from attestra.plans import fixture
from attestra.plans.registry import Tables, query
from attestra.session import new_path, written
from attestra.sources import documents, manifest, markdown
from attestra.streaming import append_log, events


@query(
    "H01_asof_join",
    """SELECT e.event_id, e.user_id, p.event_id AS purchase_id, p.value AS purchase_value FROM events e
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts > p.ts""",
)
def h01(t: Tables):
    """Each event with its user's newest earlier purchase."""
    bought = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    return temporal.asof(t.events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "bought", tie="purchase_id", values=["purchase_id", "purchase_value"], strict=True).drop("ts")


@query(
    "H01_asof_next",
    """SELECT e.event_id, n.event_id AS error_id FROM events e
    ASOF LEFT JOIN (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id, ts) n ON e.user_id = n.user_id AND e.ts <= n.ts AND true WHERE e.event_type = 'click' AND (n.ts IS NULL OR n.ts <= e.ts + INTERVAL 1 DAY)
    UNION ALL SELECT e.event_id, NULL FROM events e
    ASOF JOIN (SELECT user_id, ts FROM events WHERE event_type = 'error' GROUP BY user_id, ts) n ON e.user_id = n.user_id AND e.ts <= n.ts WHERE e.event_type = 'click' AND n.ts > e.ts + INTERVAL 1 DAY""",
)
def h01b(t: Tables):
    """Each click with the first error of its user that follows within a day."""
    errors = t.events.where("event_type = 'error'").select("user_id", F.col("ts").alias("failed"), F.col("event_id").alias("error_id"))
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return temporal.asof(clicks, errors, ["user_id"], "ts", "failed", tie="error_id", values=["error_id"], direction="forward", tolerance=F.expr("INTERVAL 1 DAY")).select("event_id", "error_id")


_SPANS = "SELECT event_id, user_id % 5 AS team, event_type, ts AS s, ts + to_microseconds(CAST(floor(value * value) AS BIGINT) * 1000000) AS e FROM events"


@query(
    "H02_interval_overlap",
    f"""WITH spans AS ({_SPANS}) SELECT a.event_id, count(*) AS met, CAST(sum(epoch_us(least(a.e, b.e)) - epoch_us(greatest(a.s, b.s))) AS BIGINT) AS micros
    FROM spans a JOIN spans b ON a.team = b.team AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e WHERE a.event_type = 'purchase' AND b.event_type = 'error' GROUP BY a.event_id""",
)
def h02(t: Tables):
    """For the time that each purchase takes, how many errors of its team go on in it and for how long; some last a second, some a day."""
    spans = t.events.select("event_id", (F.col("user_id") % 5).alias("team"), "event_type", F.col("ts").alias("s"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * F.col("value")) * 1_000_000).alias("e"))
    met = temporal.overlapping(spans.where("event_type = 'purchase'"), spans.where("event_type = 'error'"), ("s", "e"), ("s", "e"), ["team"])
    micros = F.unix_micros(F.least("l.e", "r.e")) - F.greatest(F.unix_micros(F.col("l.s").cast("timestamp")), F.unix_micros(F.col("r.s").cast("timestamp")))
    return met.groupBy("l.event_id").agg(F.count("*").alias("met"), F.sum(micros).alias("micros"))


# Streams. The events come in three batches of files, each read by a run of its own that goes on from the checkpoint: up to the 11th, the 21st, and
# the rest. One in 50 is repeated in its batch, and the last hour of a batch again in the next one, one in 89 of it only there. One in 97 of the first
# batch comes in the third, ten days late.

FEED = "event_id long, us long, user_id long, event_type string, value double"
LATE, GAP = "2 hours", "30 minutes"
_FED = "fed AS (SELECT * FROM events WHERE NOT (event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-11')), mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR AS wm FROM fed)"


def _batches(t: Tables):
    rows = t.events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value")
    cuts = [F.unix_micros(F.lit(d).cast("timestamp")) for d in ("2024-01-11", "2024-01-21")]
    k, us = F.col("event_id"), F.col("us")
    own = F.when(us < cuts[0], 0).when(us < cuts[1], 1).otherwise(2)
    last_hour = ((us < cuts[0]) & (us >= cuts[0] - 3_600_000_000)) | ((us < cuts[1]) & (us >= cuts[1] - 3_600_000_000))
    late = (k % 97 == 0) & (own == 0)
    times = F.when(late, F.array(F.lit(2))).when(last_hour & (k % 89 == 0), F.array(own + 1)).when(last_hour, F.array(own, own + 1)).when(k % 50 == 0, F.array(own, own)).otherwise(F.array(own))
    fed = rows.withColumn("batch", F.explode(times))
    return [fed.where(F.col("batch") == b).drop("batch") for b in range(3)]


def _streamed(t: Tables, transform, kind: str = "stream"):
    """What transform(the stream of the feed) has given after all batches."""
    root = new_path(t.spark, kind)
    out = None
    for b, batch in enumerate(_batches(t)):
        batch.write.json(f"{root}/in/{b}")
        fed = events.read(t.spark, f"{root}/in", FEED).withColumn("ts", F.timestamp_micros("us")).drop("us")
        out = events.caught_up(transform(fed), f"{root}/out", f"{root}/checkpoint")
    return out


@query("H03_stream_once", f"WITH {_FED} SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM fed GROUP BY event_type")
def h03(t: Tables):
    once = _streamed(t, lambda s: events.once(s, ["event_id"], "ts", LATE))
    return once.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "H03_stream_sessions",
    f"""WITH {_FED}, starts AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM fed WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM starts),
    closed AS (SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS total FROM numbered GROUP BY user_id, n)
    SELECT user_id, epoch_us(began) AS began, epoch_us(ended) AS ended, events, total FROM closed, mark WHERE ended <= wm""",
)
def h03b(t: Tables):
    """Sessions over a stream without its repeats: two stateful steps in one query. Those that the last watermark hasn't passed stay open."""
    closed = _streamed(t, lambda s: events.sessions(events.once(s, ["event_id"], "ts", LATE), "user_id", "ts", GAP, value="event_id"))
    return closed.select("user_id", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "events", "total")


@query(
    "H03_stream_followed",
    f"WITH {_FED} SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM fed c JOIN fed p ON c.user_id = p.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'",
)
def h03c(t: Tables):
    """Clicks and the purchases that follow them within six hours: a join of two streams."""

    def pairs(s):
        own = events.once(s, ["event_id"], "ts", LATE)
        clicks = own.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("clicked"))
        bought = own.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("bought"))
        return events.followed(clicks, bought, "user_id", "clicked", "bought", "6 HOURS")

    return _streamed(t, pairs).select("click_id", "purchase_id")


@query("S11_keyed_stream", "SELECT user_id, max(event_id) AS last_id, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def s11b(t: Tables):
    """The last row of each user of the same feed, late or not, kept in a keyed table that each batch rewrites in part."""
    root = new_path(t.spark, "keyed")
    for b, batch in enumerate(_batches(t)):
        batch.write.json(f"{root}/in/{b}")
        fed = events.read(t.spark, f"{root}/in", FEED)
        append_log.keyed_sink(fed, f"{root}/table", f"{root}/checkpoint", key="user_id", order="event_id").awaitTermination()
    return append_log.latest(t.spark, f"{root}/table").select("user_id", F.col("event_id").alias("last_id"), F.col("event_type").alias("last_type"))


# Large keyword lists: every run of three words of the benchmark texts is a pattern.

_PATTERNS = """w AS (SELECT list_filter(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT array_to_string(w[i:i + 2], ' ') AS pattern FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT doc_id, lower(text) AS t FROM documents)"""


def _patterns(t: Tables):
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), r"\s+", " "), " "), lambda x: x != "")
    runs = t.benchmark.select(w.alias("w")).where(F.size("w") >= 3).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, F.lit(3)), " "))).alias("pattern"))
    return runs.distinct()


@query(
    "H04_keyword_matches",
    f"WITH {_PATTERNS} SELECT doc_id, pattern, (length(t) - length(replace(t, pattern, ''))) // length(pattern) AS times, CAST(strpos(t, pattern) - 1 AS INTEGER) AS first FROM d JOIN p ON contains(t, pattern)",
)
def h04(t: Tables):
    """Where the patterns stand in the documents: how often each, and its first place."""
    hits = keywords.matches(t.documents, _patterns(t), "doc_id", "text", overlapping=False)
    return hits.groupBy("doc_id", "pattern").agg(F.count("*").alias("times"), F.min("start").alias("first"))


@query("P10_keyword_any_large", f"WITH {_PATTERNS}, hit AS (SELECT DISTINCT doc_id FROM d JOIN p ON contains(t, pattern)) SELECT source, count(*) FILTER (doc_id IN (SELECT doc_id FROM hit)) AS n FROM documents GROUP BY source")
def p10b(t: Tables):
    marked = keywords.any_of(t.documents.select("doc_id", "source", "text"), _patterns(t), "doc_id", "text", "hit")
    return marked.groupBy("source").agg(F.count(F.when(F.col("hit"), 1)).alias("n"))


@query(
    "A17_phrase_density_large",
    f"""WITH {_PATTERNS}, n AS (SELECT doc_id, sum((length(t) - length(replace(t, pattern, ''))) // length(pattern)) AS times FROM d JOIN p ON contains(t, pattern) GROUP BY doc_id)
    SELECT documents.doc_id, coalesce(times, 0) / nullif(len(regexp_extract_all(text, '[^\\s　-〿＀-￯]+')), 0) AS density FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id""",
)
def a17b(t: Tables):
    from attestra.functions.text import word_count

    counted = keywords.times(t.documents, _patterns(t), "doc_id", "text")
    words = t.documents.select("doc_id", word_count(F.col("text")).alias("words"))
    return words.join(counted, "doc_id").select("doc_id", (F.col("times") / F.nullif("words", F.lit(0))).alias("density"))


# Totals on several levels, over each claim and each of its sources.

_CITED = f"WITH {fixture.SQL}, cited AS (SELECT section, tier, sv, supports FROM cls JOIN edge USING (cid) JOIN src USING (s_suppkey))"
_TOTALS = "count(*) AS n, count(*) FILTER (supports) AS supporting, CAST(grouping(section) * 4 + grouping(tier) * 2 + grouping(sv) AS INTEGER) AS level"
_DIMS = ["section", "tier", "sv"]


def _cited(t: Tables, sets):
    claims = fixture.classified(t).select("cid", "section", F.col("source_verification").alias("sv"))
    rows = claims.join(fixture.edges(t).select("cid", "tier", "supports"), "cid")
    return totals.totals(rows, _DIMS, sets, [F.count("*").alias("n"), F.count(F.when(F.col("supports"), 1)).alias("supporting")])


@query("H05_rollup", f"{_CITED} SELECT section, tier, sv, {_TOTALS} FROM cited GROUP BY ROLLUP (section, tier, sv)")
def h05(t: Tables):
    return _cited(t, totals.rollup(_DIMS))


@query("H05_cube", f"{_CITED} SELECT section, tier, sv, {_TOTALS} FROM cited GROUP BY CUBE (section, tier, sv)")
def h05b(t: Tables):
    return _cited(t, totals.cube(_DIMS))


@query("H05_grouping_sets", f"{_CITED} SELECT section, tier, sv, {_TOTALS} FROM cited GROUP BY GROUPING SETS ((section, sv), (tier), ())")
def h05c(t: Tables):
    return _cited(t, [["section", "sv"], ["tier"], []])


# Sketches: one for each type and day, stored; what is asked later is answered from these.


def _days(t: Tables):
    return t.events.select("event_type", F.to_date("ts").alias("day"), "user_id", "value")


@query("H06_distinct_sketches", "SELECT event_type, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY event_type UNION ALL SELECT 'all', count(DISTINCT user_id), true FROM events")
def h06(t: Tables):
    """Users of each type and of all: the exact figure, and whether the estimate from the stored sketches is within its error."""
    kept = written(totals.distinct_sketches(_days(t), ["event_type", "day"], "user_id"), "sketches")
    told = totals.distinct_estimate(kept, ["event_type"]).unionByName(totals.distinct_estimate(kept.withColumn("event_type", F.lit("all")), ["event_type"]))
    both = _days(t).withColumn("event_type", F.explode(F.array("event_type", F.lit("all"))))
    exact = both.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(told, "event_type").select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * totals.DISTINCT_ERROR)).alias("within"))


@query("H06_quantile_sketches", "SELECT event_type, q, count(*) AS n, true AS within FROM events, (SELECT unnest([0.1, 0.5, 0.9, 0.99]) AS q) GROUP BY event_type, q")
def h06b(t: Tables):
    """Quantiles of each type's values from the stored sketches: whether the rank of each estimate is within its error."""
    kept = written(totals.quantile_sketches(_days(t), ["event_type", "day"], "value"), "sketches")
    told = totals.quantile_estimates(kept, ["event_type"], [0.1, 0.5, 0.9, 0.99])
    ranks = _days(t).join(F.broadcast(told), "event_type").groupBy("event_type", "q").agg(  # a row for each type and quantile
        F.count("*").alias("n"), F.avg((F.col("value") < F.col("estimate")).cast("int")).alias("under"), F.avg((F.col("value") <= F.col("estimate")).cast("int")).alias("upto")
    )
    error = totals.RANK_ERROR
    return ranks.select("event_type", F.col("q").cast("decimal(4,2)").alias("q"), "n", ((F.col("under") <= F.col("q") + error) & (F.col("upto") >= F.col("q") - error)).alias("within"))


# Functions and views for SQL text.


@query(
    "H07_sql_rewriter",
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://mirror.example/' || doc_id WHEN 1 THEN 'https://b.example/it''s/' || doc_id ELSE 'https://c.example/' || doc_id END AS url FROM documents",
)
def h07(t: Tables):
    registered.register_rewriter(t.spark, "attestra_mirror", [(r"^https://a\.example/", "https://mirror.example/"), (r"^(https://b\.example)/(\d+)$", "$1/it's/$2")])
    t.documents.createOrReplaceTempView("attestra_documents")
    return t.spark.sql("SELECT doc_id, attestra_mirror(concat('https://', substr('abc', CAST(doc_id % 3 + 1 AS INT), 1), '.example/', doc_id)) AS url FROM attestra_documents")


@query(
    "H07_sql_sections",
    """WITH heads AS (SELECT conv_id, turn, 1 + length(text) % 6 AS level, lead(turn) OVER w AS next, lag(1 + length(text) % 6) OVER w AS previous, e
      FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) + 1 AS e FROM conversations) WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn AS pos, CAST(level AS INTEGER) AS level, 'turn ' || turn AS title, coalesce(level > previous + 1, false) AS skipped, coalesce(next, e) - turn - 1 AS body_rows FROM heads""",
)
def h07b(t: Tables):
    """Turns as lines, users' as headings: a table function with a state machine over each conversation."""
    registered.register_sections(t.spark, "attestra_sections")
    line = F.when(F.col("role") == "user", F.concat(F.repeat(F.lit("#"), (1 + F.length("text") % 6).cast("int")), F.lit(" turn "), F.col("turn"))).otherwise("text below")
    t.conversations.select("conv_id", F.col("turn").alias("pos"), line.alias("line")).createOrReplaceTempView("attestra_lines")
    return t.spark.sql(
        "SELECT CAST(doc AS BIGINT) AS conv_id, pos, level, title, skipped, body_rows FROM attestra_sections(TABLE(SELECT conv_id AS doc, pos, line FROM attestra_lines) PARTITION BY doc ORDER BY pos)"
    )


@query(
    "H10_catalog_summary",
    f"WITH {fixture.SQL} SELECT sv AS source_verification, count(*) AS n, count(*) / (SELECT count(*) FROM cls) AS ratio FROM cls GROUP BY sv",
)
def h10(t: Tables):
    """The verification histogram as SQL text over the views."""
    registered.register_views(t.spark, fixture.claims(t), fixture.edges(t), fixture.sources(t), "attestra_")
    return t.spark.sql(
        """WITH flag AS (SELECT e.cid, bool_or(s.tier >= 3) AS low, bool_or(e.supports) AS hit FROM attestra_edges e JOIN attestra_sources s ON s.s_suppkey = e.s_suppkey GROUP BY e.cid),
        cls AS (SELECT CASE WHEN (ev IN ('official_data', 'third_party_estimate') OR st IN ('vendor_benchmark', 'vendor_survey', 'vendor_blog') AND pr IN ('exact', 'range')) AND coalesce(low, false) THEN 'source_indirect'
                            WHEN coalesce(hit, false) THEN 'source_confirmed' ELSE 'source_absent' END AS source_verification FROM attestra_claims c LEFT JOIN flag ON flag.cid = c.cid)
        SELECT source_verification, count(*) AS n, count(*) / sum(count(*)) OVER () AS ratio FROM cls GROUP BY source_verification"""
    )


@query("H10_claims_of_section", f"WITH {fixture.SQL} SELECT section, num, count(*) AS n FROM claim WHERE section IN ('1-URGENT', '5-LOW') GROUP BY section, num")
def h10b(t: Tables):
    registered.register_views(t.spark, fixture.claims(t), fixture.edges(t), fixture.sources(t), "attestra_")
    return t.spark.sql("SELECT '1-URGENT' AS section, num, count(*) AS n FROM attestra_claims_of('1-URGENT') GROUP BY num UNION ALL SELECT '5-LOW', num, count(*) FROM attestra_claims_of('5-LOW') GROUP BY num")


# A log with several writers.


@query("H08_manifest_log", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, true AS whole FROM events WHERE event_id % 4 < 3 GROUP BY event_type")
def h08(t: Tables):
    """Two writers append at the same time while a third drops one row in four: nothing is lost, and each version that was read is whole."""
    table = new_path(t.spark, "log")
    rows = t.events.select("event_id", "event_type")
    k = F.col("event_id")
    sizes = {r["p"]: r["n"] for r in rows.groupBy((k % 8).alias("p")).agg(F.count("*").alias("n")).collect()}

    def write(parts):
        for p in parts:
            manifest.append(rows.where(k % 8 == p), table)

    def drop():
        manifest.rewrite(t.spark, table, lambda now: rows.limit(0) if now is None else now.where(k % 4 < 3))

    with ThreadPoolExecutor(3) as pool:
        jobs = [pool.submit(write, [0, 1, 2, 3]), pool.submit(write, [4, 5, 6, 7]), pool.submit(drop)]
        for job in jobs:
            job.result()
    manifest.rewrite(t.spark, table, lambda now: now.where(k % 4 < 3))
    whole = True
    for v in manifest.versions(t.spark, table):  # of each part a version has all rows or none, but for those dropped
        seen = {r["p"]: r["n"] for r in manifest.snapshot(t.spark, table, v).groupBy((k % 8).alias("p")).agg(F.count("*").alias("n")).collect()}
        whole = whole and all(n == sizes[p] for p, n in seen.items())
    return manifest.snapshot(t.spark, table).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).withColumn("whole", F.lit(whole))


# A folder of Markdown files.


@query(
    "H09_markdown_source",
    "SELECT 'supplier ' || s_suppkey AS topic, '2024-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') AS date, length('# ' || s_name || chr(10) || 'text' || chr(10)) AS chars FROM supplier WHERE s_suppkey % 3 = 1",
)
def h09(t: Tables):
    """Reports with front matter, written as files and read as a table: the filter on a field is the source's own work."""
    root = new_path(t.spark, "reports")
    k = F.col("s_suppkey")
    fields = [("topic", F.concat(F.lit("supplier "), k)), ("goal_type", F.get(F.array(F.lit("other"), F.lit("fact_check"), F.lit("market")), (k % 3).cast("int"))), ("date", F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")))]
    text = F.concat(render.front_matter(fields), F.lit("\n# "), "s_name", F.lit("\ntext"))
    documents.write_texts(t.supplier.select(F.concat(F.lit("r"), k).alias("name"), text.alias("text")), root, "name", "text", ".md")
    markdown.register(t.spark)
    found = t.spark.read.format(markdown.NAME).schema("topic string, goal_type string, date string, body string").load(root)
    return found.where(F.col("goal_type") == "fact_check").select("topic", "date", F.length("body").cast("long").alias("chars"))
