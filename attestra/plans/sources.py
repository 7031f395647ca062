"""Queries of readers, writers' row rules, configuration tables and the extension surface, on rows made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import diffs, rewriters
from attestra.operators import gates, joins, sanitize, schemas
from attestra.plans import fixture
from attestra.plans.gates import GSQL, Workspaces, gate_sql
from attestra.plans.registry import Tables, query
from attestra.session import new_path
from attestra.sources import documents, logs


def _artifacts(t: Tables) -> str:
    """A folder of JSON artifacts, one for each supplier but one in four, with a byte-order mark; one in three is broken."""
    root = new_path(t.spark, "artifacts")
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("s_name").alias("topic"))))
    rows = t.supplier.where(k % 4 != 0).select(F.concat(F.lit("n"), k % 7, F.lit("__ws"), k).alias("name"), F.concat(F.lit("\ufeff"), raw).alias("raw"))
    documents.write_texts(rows, root, "name", "raw", ".json")
    return root


def _ws():
    return F.regexp_extract("path", r"ws(\d+)\.json$", 1).cast("long")


@query("S01_read_json", "SELECT s_suppkey AS ws, s_suppkey % 3 <> 0 AS valid, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS topic FROM supplier WHERE s_suppkey % 4 <> 0")
def s01(t: Tables):
    """Files read by a glob; what is no JSON is a row with an error."""
    return documents.read_json(t.spark, f"{_artifacts(t)}/*/*.json", documents.SCOPE).select(_ws().alias("ws"), "valid", F.col("doc.topic").alias("topic"))


@query("S02_write_json", "SELECT event_type AS kind, count(*) AS rows FROM events GROUP BY 1")
def s02(t: Tables):
    """Rows written as JSON, where every executor can write, and read again."""
    path = new_path(t.spark, "json")
    t.events.select(F.col("event_type").alias("kind")).write.json(path)
    return t.spark.read.schema("kind string").json(path).groupBy("kind").agg(F.count("*").alias("rows"))


@query(
    "S03_artifact_state",
    "SELECT 'ws' || s_suppkey AS name, s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0 AS readable, s_suppkey % 2 <> 0 OR s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0 AS passed FROM supplier",
)
def s03(t: Tables):
    """Which of the suppliers' artifacts are there and sound; those of odd suppliers may be missing or broken."""
    found = documents.read_json(t.spark, f"{_artifacts(t)}/*/*.json", documents.SCOPE).select(F.concat(F.lit("ws"), _ws()).alias("name"), "valid")
    expected = t.supplier.select(F.concat(F.lit("ws"), "s_suppkey").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("required"))
    return documents.artifact_state(found, expected)


@query(
    "S04_read_with_repair",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'say "' || event_type || '" twice' WHEN 2 THEN chr(39) || event_type || chr(39) END AS topic,
       event_id % 4 = 0 AS valid, event_id % 4 <> 3 AS readable FROM events""",
)
def s04(t: Tables):
    """Whole JSON artifacts: sound ones, ones with bare quotes inside a string, with curly quotes, and broken ones."""
    from attestra.functions import jsons

    made = lambda a, b: F.concat(F.lit(a), "event_type", F.lit(b))
    shapes = F.array(made('{"topic":"', '"}'), made('{"topic":"say "', '" twice"}'), made('{"topic":"“', '”"'), F.lit("{broken"))
    raw = F.get(shapes, (F.col("event_id") % 4).cast("int"))
    raw = F.when(F.col("event_id") % 4 == 2, F.concat(raw, F.lit(', "x": "a "b" c"}'))).otherwise(raw)
    doc = jsons.parsed_or_repaired(raw, documents.SCOPE)
    return t.events.select("event_id", doc["topic"].alias("topic"), F.call_function("try_parse_json", raw).isNotNull().alias("valid"), doc["topic"].isNotNull().alias("readable"))


@query("S05_merge_shards", "SELECT n_name AS id, max_by(s_name, s_suppkey) AS content FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 11 <> 0 GROUP BY n_name")
def s05(t: Tables):
    """Section shards in files of their own, read by a glob: broken ones are left out, of a section's the last one counts."""
    root = new_path(t.spark, "shards")
    k = F.col("s_suppkey")
    named = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    raw = F.when(k % 11 == 0, "broken").otherwise(F.to_json(F.struct(F.col("n_name").alias("id"), F.lit("t").alias("title"), F.col("s_name").alias("content"))))
    documents.write_texts(named.select(F.concat(F.lit("section-"), F.lpad(k.cast("string"), 12, "0")).alias("name"), raw.alias("raw")), root, "name", "raw", ".json")
    return documents.merge_shards(t.spark, f"{root}/section-*.json").select("id", "content")


@query(
    "S06_batch_parse",
    "SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS items FROM events",
)
def s06(t: Tables):
    one = '{"url":"u","content":"c"}'
    shapes = F.array(F.lit(f'[{one},{{"url":"v"}}]'), F.lit(f'{{"items":[{one},{one}]}}'), F.lit(one), F.lit('{"url":"","content":"c"}'))
    return t.events.select("event_id", F.size(documents.parse_batch(F.get(shapes, (F.col("event_id") % 4).cast("int")))).cast("long").alias("items"))


_HASH = "'sources/' || substr(sha256('https://e.example/' || doc_id), 1, 12) || '.md'"


@query("S07_S08_ingest", f"SELECT 'https://e.example/' || doc_id AS url, 3 AS source_tier, lang AS direction, {_HASH} AS source_file, length(substr(text, 1, 200)) AS indexed FROM documents WHERE lang <> ''")
def s07(t: Tables):
    rows = t.documents.select(F.concat(F.lit("https://e.example/"), "doc_id").alias("url"), F.col("text").alias("content"), F.col("lang").alias("direction"))
    return documents.ingested(rows).select("url", "source_tier", "direction", "source_file", F.length("fetched_content").cast("long").alias("indexed"))


@query("S09_source_text", "SELECT doc_id, sha256(lower(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'Fetched' END || ' ' || source)) AS digest FROM documents")
def s09(t: Tables):
    body = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("")
    return t.documents.select("doc_id", F.sha2(documents.source_text(body, F.lit("Fetched"), F.col("source")).cast("binary"), 256).alias("digest"))


_PADS = ["learnings", "decisions", "issues", "problems", "conventions"]


@query(
    "S10_log_entries",
    f"""SELECT user_id % 20 AS pad, list_value({', '.join(f"'{p}'" for p in _PADS)})[event_id % 5 + 1] AS category, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS at, event_type AS task, 'body ' || event_id AS body FROM events""",
)
def s10(t: Tables):
    """Notepads in folders of their own, found by a scan below the root and split into entries."""
    root = new_path(t.spark, "notepads")
    pad = F.concat(F.lit("u"), F.col("user_id") % 20, F.lit("__"), F.get(F.array(*map(F.lit, _PADS)), (F.col("event_id") % 5).cast("int")))
    entry = F.format_string("## [%s] Task: %s\nbody %d\n", F.date_format("ts", "yyyy-MM-dd HH:mm"), "event_type", "event_id")
    documents.write_texts(t.events.select(pad.alias("name"), entry.alias("text")), root, "name", "text", ".md")
    found = logs.entries(t.spark, root)
    return found.select(F.regexp_extract("path", r"/u(\d+)/", 1).cast("long").alias("pad"), "category", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "task", "body")


@query("S11_append_only", "SELECT event_type, 2 * count(*) AS lines, CAST(sum(event_id) AS BIGINT) + count(*) * 1000000 + CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def s11(t: Tables):
    """Two appends to one log: the second leaves the lines of the first as they are."""
    path = new_path(t.spark, "log")
    rows = t.events.select("event_type", "event_id")
    documents.append(rows, path)
    documents.append(rows.withColumn("event_id", F.col("event_id") + 1_000_000), path)
    log = t.spark.read.schema("event_type string, event_id long").json(path)
    return log.groupBy("event_type").agg(F.count("*").alias("lines"), F.sum("event_id").alias("total"))


@query(
    "S12_catalogue",
    f"""WITH {fixture.SQL} SELECT host AS ws, CAST(row_number() OVER (PARTITION BY host ORDER BY tier, s_suppkey) - 1 AS INTEGER) AS ord, tier, lower(s_name) || '.org' AS domain, CASE WHEN s_suppkey % 2 = 0 THEN 'zh' ELSE 'en' END AS language FROM src""",
)
def s12(t: Tables):
    """A configuration file for each nation, with its suppliers by tier, read back as one table of sources."""
    root = new_path(t.spark, "configs")
    rows = fixture.sources(t).select("host", F.col("tier").cast("string").alias("tier"), "s_suppkey", F.struct(F.col("s_name").alias("name"), F.concat(F.lower("s_name"), F.lit(".org")).alias("domain"), F.when(F.col("s_suppkey") % 2 == 0, "zh").alias("language")).alias("source"))
    tiers = rows.groupBy("host", "tier").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "source"))).alias("s")).select("host", "tier", F.struct(F.transform("s", lambda x: x["source"]).alias("sources")).alias("entry"))
    configs = tiers.groupBy("host").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tier", "entry")))).alias("sources"))
    documents.write_texts(configs.select("host", F.to_json(F.struct("sources")).alias("raw")), root, "host", "raw", ".json")
    files = documents.read_whole(t.spark, f"{root}/*.json").withColumn("ws", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    return documents.catalogues(files, "ws", "raw").select("ws", "ord", "tier", "domain", "language")


@query(
    "S12_routes",
    f"""WITH {fixture.SQL}, own AS (SELECT host, array_to_string(list_sort(list(DISTINCT tier)), ',') AS path FROM src GROUP BY host)
    SELECT host AS ws, 'fact_check' AS goal_type, path, 2 AS optional FROM own UNION ALL SELECT host, 'other', '2,3,1,4', 0 FROM own""",
)
def s12b(t: Tables):
    """The routes of each nation's configuration: one is a list of the tiers that it has, the other is left to the default."""
    tiers = fixture.sources(t).groupBy(F.col("host").alias("ws")).agg(F.sort_array(F.collect_set("tier")).alias("path"))
    route = F.to_json(F.struct(F.lit(1).alias("entry_tier"), "path", F.array(F.lit(5), F.lit(6)).alias("optional_tiers")))
    configs = tiers.select("ws", F.concat(F.lit('{"routes":{"fact_check":'), route, F.lit(',"other":"auto"}}')).alias("raw"))
    return documents.routes(configs, "ws", "raw", gates.ROUTES["other"]).select("ws", "goal_type", F.array_join("path", ",").alias("path"), F.size("optional").alias("optional"))


@query(
    "S13_fetch_ladder",
    """SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) >= 5000 DESC, CASE WHEN length(text) >= 5000 THEN doc_id END, length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1""",
)
def s13(t: Tables):
    return documents.longest_shallow(t.documents.select("source", "doc_id", "text"), "source", "text", "doc_id", 5000).select("source", "doc_id")


@query("S14_decode", "SELECT doc_id, sha256(text) AS digest FROM documents")
def s14(t: Tables):
    return t.documents.select("doc_id", F.sha2(diffs.decoded(F.col("text").cast("binary")).cast("binary"), 256).alias("digest"))


@query("S15_report_name", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') || CASE WHEN p_partkey % 2 = 0 THEN '_20240131' ELSE '' END || '.md' AS file FROM part")
def s15(t: Tables):
    from attestra.functions.text import ascii_slug

    taken = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(ascii_slug(F.col("p_name")), F.lit(".md")))).otherwise(F.array().cast("array<string>"))
    return t.part.select("p_partkey", documents.report_name(F.col("p_name"), taken, F.lit("2024-01-31").cast("date")).alias("file"))


@query(
    "S16_phase_state",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'post_deep_dive' WHEN event_id % 5 = 0 THEN 'pre_scope' WHEN event_id % 3 = 0 THEN 'post_scope' WHEN event_id % 2 = 0 THEN 'post_search'
       WHEN event_id % 11 = 0 THEN 'post_analysis' ELSE 'post_review' END AS phase FROM events""",
)
def s16(t: Tables):
    """A state that the file names wins; a broken file, an unknown name or none leaves it to the artifacts."""
    from attestra.operators.pipeline import recorded_phase

    e = F.col("event_id")
    state = F.when(e % 7 == 0, '{"current_phase":"post_deep_dive"}').when(e % 13 == 0, "{broken").when(e % 17 == 0, '{"current_phase":"elsewhere"}')
    return t.events.select("event_id", recorded_phase(state, e % 5 != 0, e % 3 != 0, e % 2 != 0, e % 11 != 0).alias("phase"))


@query("P01_whitelist", "SELECT o_orderkey AS id, o_orderstatus AS title FROM orders")
def p01(t: Tables):
    made = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), "o_totalprice", "o_orderpriority")
    return sanitize.whitelisted(made, sanitize.SECTION_KEYS)


@query("F24_unified_diff", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE '@@ -1,2 +1,2 @@' || chr(10) || ' a' || chr(10) || '-b' || chr(10) || '+' || event_type END AS diff FROM events")
def f24(t: Tables):
    after = F.concat(F.lit("a\n"), F.when(F.col("event_id") % 2 == 0, "b").otherwise(F.col("event_type")))
    return t.events.select("event_id", diffs.unified_diff(F.lit("a\nb"), after).alias("diff"))


@query("F27_percent", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') / count(*) AS share FROM orders GROUP BY 1")
def f27(t: Tables):
    """Ratios stay doubles; per cent is only how they are written."""
    return t.orders.groupBy("o_orderpriority").agg((F.count(F.when(F.col("o_orderstatus") == "F", 1)) / F.count("*")).alias("share"))


@query("F38_required_keys", "SELECT event_id, event_id % 2 = 0 AS complete FROM events")
def f38(t: Tables):
    v = F.try_parse_json(F.when(F.col("event_id") % 2 == 0, '{"evidence_type":null,"confidence":1,"precision":"x"}').otherwise('{"confidence":1}'))
    here = [schemas.kind_of(v, f"$.{k}").isNotNull() for k in ("evidence_type", "confidence", "precision")]
    return t.events.select("event_id", (here[0] & here[1] & here[2]).alias("complete"))


@query(
    "Q02_collected_schema",
    "SELECT s_suppkey % 5 AS ws, count(*) FILTER (s_suppkey % 3 = 0) = 0 AS passed, count(*) FILTER (s_suppkey % 3 = 0) AS errors FROM supplier GROUP BY 1",
)
def q02(t: Tables):
    k = F.col("s_suppkey")
    made = F.concat(F.lit('{"url":"u","title":"t","snippet":"s","source_tier":'), F.when(k % 3 == 0, '"x"').otherwise("1"), F.lit("}"))
    rows = t.supplier.select((k % 5).alias("ws"), k.alias("id"), made.alias("raw"))
    bad = schemas.errors(rows, "ws", "raw", schemas.collected_rules).groupBy("ws").agg(F.count("*").alias("errors"))
    on = rows.select("ws").distinct().join(bad, "ws", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return on.select("ws", (F.col("errors") == 0).alias("passed"), "errors")


@query("Q12_analysis_schema", "SELECT o_orderkey AS ws, CASE WHEN o_orderkey % 3 = 0 THEN 'BLOCKER' WHEN o_orderkey % 2 = 0 THEN 'WARN' ELSE 'BLOCKER' END AS level, o_orderkey % 3 <> 0 AS passed FROM orders")
def q12(t: Tables):
    k = F.col("o_orderkey")
    content = F.when(k % 2 == 0, "## twice").otherwise("text")
    made = F.concat(F.lit('{"sections":[{"id":"a","content":"'), content, F.lit('"'), F.when(k % 3 != 0, ',"title":"t"').otherwise(""), F.lit("}]}"))
    rows = t.orders.select(k.alias("ws"), made.alias("raw"), content.startswith("## ").alias("heading"))
    bad = schemas.analysis_errors(rows, "ws", "raw").select("ws", F.lit(True).alias("bad")).distinct()
    on = rows.join(bad, "ws", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    return on.select("ws", F.when(~F.col("bad") & F.col("heading"), "WARN").otherwise("BLOCKER").alias("level"), (~F.col("bad")).alias("passed"))


@query("Q48_live_direction_tagging", GSQL + gate_sql("direction_tagging", "WARN", "SELECT ws, count(*) AS m FROM collected WHERE direction = '' AND ws IN (SELECT ws FROM directions) GROUP BY ws", "m = 0"))
def q48(t: Tables):
    w = Workspaces(t)
    return gates.direction_tagging(w.scopes, w.directions, w.collected, "WARN")


@query("O03_by_number", "SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey) AS ordered FROM lineitem GROUP BY 1")
def o03(t: Tables):
    from attestra.operators.render import joined

    return joined(t.lineitem.withColumn("s", F.col("l_suppkey").cast("string")), ["l_orderkey"], ["l_linenumber", "l_suppkey"], "s", ",", "ordered")


@query("O04_top_terms", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def o04(t: Tables):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


@query(
    "U01_U03_rewriters",
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://ar5iv.labs.arxiv.org/html/1.' || doc_id WHEN 1 THEN 'https://github.com/o/r' || doc_id || '/blob/main/README.md' ELSE 'https://new.example/' || doc_id END AS url_new FROM documents",
)
def u01(t: Tables):
    made = F.get(F.array(F.concat(F.lit("https://arxiv.org/abs/1."), "doc_id"), F.concat(F.lit("https://github.com/o/r"), "doc_id"), F.concat(F.lit("https://old.example/"), "doc_id")), (F.col("doc_id") % 3).cast("int"))
    strategies = [(r"(^|\.)arxiv\.org$", "arxiv"), (r"^github\.com$", "github")]
    return t.documents.select("doc_id", rewriters.routed(made, strategies, [(r"^https://old\.example/(.*)$", "https://new.example/$1")]).alias("url_new"))


@query(
    "U02_loaded_rewriters",
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://mirror.example/' || doc_id WHEN 1 THEN 'https://b.example/' || doc_id ELSE 'https://c.example/' || doc_id || '?plain' END AS url FROM documents",
)
def u02(t: Tables):
    """Rewriters of a folder, one JSON file of rules each, by name; a broken file and a missing name leave the URL as it is."""
    files = t.spark.createDataFrame(
        [("file:/x/mirror.json", '{"rules":[{"match":"^https://nowhere/","replace":"x"},{"match":"^https://a\\\\.example/","replace":"https://mirror.example/"}]}'), ("file:/x/broken.json", "{"), ("file:/x/plain.json", '{"rules":[{"match":"$","replace":"?plain"}]}')],
        "path string, raw string",
    )
    found = rewriters.loaded(files)
    k = F.col("doc_id")
    url = F.concat(F.get(F.array(*[F.lit(f"https://{h}.example/") for h in "abc"]), (k % 3).cast("int")), k)
    names = ["mirror", "broken", "plain"]
    out = F.coalesce(*[F.when(k % 3 == i, found.get(name, lambda c: c)(url)) for i, name in enumerate(names)])
    return t.documents.select("doc_id", out.alias("url"))


@query("U04_platform_table", "SELECT platform, count(*) AS n FROM (SELECT CASE WHEN contains(url, '.html') THEN 'article' WHEN contains(url, '?page=') THEN 'list' ELSE 'generic' END AS platform FROM pages) GROUP BY 1")
def u04(t: Tables):
    """A site is a row of configuration: its patterns become one CASE."""
    from attestra.functions.urls import first_match

    config = {"article": [r"\.html"], "list": [r"\?page="]}
    rules = [(p, name) for name, patterns in config.items() for p in patterns]
    return t.pages.groupBy(first_match(F.col("url"), rules, F.lit("generic")).alias("platform")).agg(F.count("*").alias("n"))


@query(
    "W13_unchanged_stop",
    """SELECT conv_id, min(turn) AS stop FROM (SELECT conv_id, turn, sum(CAST(same AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS run
    FROM (SELECT conv_id, turn, coalesce(length(text) // 400 = lag(length(text) // 400) OVER (PARTITION BY conv_id ORDER BY turn), false) AS same FROM conversations)) WHERE run = 2 GROUP BY conv_id""",
)
def w13(t: Tables):
    from attestra.operators.order import unchanged_stop

    counts = t.conversations.select("conv_id", "turn", F.floor(F.length("text") / 400).alias("n"))
    return unchanged_stop(counts, ["conv_id"], "n", "turn", 2)
