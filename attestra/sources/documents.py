"""Whole documents: JSON artifacts with their errors as data, batch inputs of several shapes, bodies and reports.

Every reader keeps the raw text beside what was parsed, so a document that is no JSON is a row with an error, not a
failed job. Retries are Spark's task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.functions import jsons, urls

SOURCE = "url string, title string, snippet string, source_tier int, fetched_content string, vendor_affiliation string, source_file string, direction string, fetch_failed boolean, tier_override_reason string"
CLAIM = "summary string, sources array<string>, evidence_type string, confidence string, precision string, metric_type string, source_metadata struct<test_conditions:string,test_date:string,source_type:string>, source_verification string"
NOTE = "summary string, sources array<string>, resolved boolean"


def _struct(ddl: str) -> str:
    """A column list as the fields of a struct type, with colons at its own level only."""
    depth, out = 0, []
    for field in ddl.split(", "):
        name, kind = field.split(" ", 1)
        out.append(f"{name}:{kind}")
    return "struct<" + ",".join(out) + ">" if not depth else ddl


SECTION = f"id string, title string, content string, claims array<{_struct(CLAIM)}>, depth_strategy string, key_insights array<{_struct(NOTE)}>, tensions array<{_struct(NOTE)}>, `order` int, decision_questions_answered array<string>"
ANALYSIS = f"topic string, goal_type string, sections array<{_struct(SECTION).replace('`order`', 'order')}>"
SCOPE = "topic string, goal_type string, depth string, audience string, scope_description string, search_directions array<string>, report_language string, english_title string, decision_questions array<struct<id:string,question:string,context:string>>"


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw): each file as one string, without a byte-order mark."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return text.withColumn("raw", F.regexp_replace("raw", "^﻿", ""))


def read_json(spark: SparkSession, path: str, schema: str, repair: bool = False) -> DataFrame:
    """(path, raw, doc, valid): doc is null where raw is no JSON; with repair, quotes are mended where that helps."""
    raw = read_whole(spark, path)
    valid = F.call_function("try_parse_json", F.col("raw")).isNotNull()
    doc = jsons.parsed_or_repaired(F.col("raw"), schema) if repair else F.when(valid, F.from_json("raw", schema))
    return raw.withColumn("doc", doc).withColumn("valid", valid)


def artifact_state(found: DataFrame, expected: DataFrame) -> DataFrame:
    """expected(name) x found(name, valid) -> (name, readable, passed): a missing or broken optional artifact passes."""
    on = expected.join(found.select("name", "valid"), "name", "left")
    readable = F.coalesce("valid", F.lit(False))
    return on.select("name", readable.alias("readable"), (readable | ~F.coalesce("required", F.lit(True))).alias("passed"))


def merge_shards(spark: SparkSession, glob: str) -> DataFrame:
    """Section shards as one table, in order; unreadable shards are left out, a section id counts once (the last path)."""
    from attestra.operators.joins import keep_last

    shards = read_json(spark, glob, SECTION).where("valid AND doc.id IS NOT NULL")
    return keep_last(shards.select("path", "doc.*"), F.col("id"), [F.col("path")])


def parse_batch(raw: Column) -> Column:
    """An array of items, {items: [...]} or one item -> the items that have url and content."""
    item = "struct<url:string,content:string,tier:int>"
    many, wrapped, one = F.from_json(raw, f"array<{item}>"), F.from_json(raw, f"items array<{item}>")["items"], F.from_json(raw, item.replace("struct<", "").rstrip(">").replace(":", " "))
    is_array = F.coalesce(F.schema_of_variant(F.call_function("try_parse_json", raw)).startswith("ARRAY"), F.lit(False))
    items = F.when(is_array, many).otherwise(F.coalesce(wrapped, F.array(one)))
    return F.filter(items, lambda x: (F.coalesce(x["url"], F.lit("")) != "") & (F.coalesce(x["content"], F.lit("")) != ""))


def ingested(rows: DataFrame, default_tier: int = 3, index_chars: int = 200) -> DataFrame:
    """rows(url, content, [title, snippet, tier, direction]) as collected rows: defaults filled, the body's name from the
    URL's hash, the first characters kept as an index. Nothing is deduplicated: that is the reader's keep-last."""
    has = set(rows.columns)
    col = lambda c: F.col(c) if c in has else F.lit(None)
    return rows.select(
        "url", F.coalesce(F.nullif(col("title").cast("string"), F.lit("")), "url").alias("title"), F.coalesce(col("snippet").cast("string"), F.lit("")).alias("snippet"),
        F.coalesce(col("tier").cast("int"), F.lit(default_tier)).alias("source_tier"), F.coalesce(F.nullif(col("direction").cast("string"), F.lit("")), F.lit("other")).alias("direction"),
        F.left("content", F.lit(index_chars)).alias("fetched_content"), F.concat(F.lit("sources/"), urls.url_hash(F.col("url")), F.lit(".md")).alias("source_file"), F.col("content").alias("body"),
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_texts(rows: DataFrame, root: str, name: str, text: str, kind: str) -> None:
    """A file root/<name><kind> for each name, with the texts of its rows one below the other, as users keep such folders.

    Names are of letters, digits, - and _; two _ in a row make a folder. Null names go. Tasks write the files, the driver only renames them.
    """
    spark, parts = rows.sparkSession, f"{root}-parts"
    rows.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("_name"), F.col(text).alias("value")).repartition("_name").write.partitionBy("_name").text(parts)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(root))
    for found in fs.globStatus(path(f"{parts}/_name=*/part-*")) or []:
        to = path(f"{root}/{found.getPath().getParent().getName().split('=', 1)[1].replace('__', '/')}{kind}")
        fs.mkdirs(to.getParent())
        fs.rename(found.getPath(), to)
    fs.delete(path(parts), True)


def source_text(body: Column, fetched: Column, snippet: Column) -> Column:
    """What claims are compared with: the stored body, else the fetched text, and always the snippet, in lower case."""
    return F.lower(F.concat_ws(" ", F.coalesce(F.nullif(body, F.lit("")), fetched, F.lit("")), F.coalesce(snippet, F.lit(""))))


def longest_shallow(attempts: DataFrame, key: str, content: str, order: str, enough: int) -> DataFrame:
    """Of each key's fetch attempts the first whose content is long enough, else the longest."""
    from pyspark.sql.window import Window

    long_enough = F.length(content) >= enough
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(long_enough), F.when(long_enough, F.col(order)), F.desc(F.length(content)), order))
    return attempts.withColumn("_r", rank).where("_r = 1").drop("_r")


def report_name(topic: Column, existing: Column, asof: Column) -> Column:
    """A report's file name; with the date where that name is taken."""
    from attestra.functions.text import ascii_slug

    base = F.coalesce(F.nullif(ascii_slug(topic), F.lit("")), F.lit("report"))
    taken = F.array_contains(existing, F.concat(base, F.lit(".md")))
    return F.concat(base, F.when(taken, F.concat(F.lit("_"), F.date_format(asof, "yyyyMMdd"))).otherwise(F.lit("")), F.lit(".md"))


def catalogues(configs: DataFrame, key: str, raw: str) -> DataFrame:
    """configs(key, raw): JSON of tier -> sources -> (key, ord, tier, name, domain, site_query, language), a row for each source in its
    order. What isn't JSON, or has no sources, has no rows; a tier that is no number is null."""
    entry = "struct<name:string,domain:string,site_query:string,language:string>"
    parsed = F.from_json(raw, f"sources map<string,struct<sources:array<{entry}>>>")["sources"]
    tiers = configs.select(key, F.posexplode(F.map_entries(parsed)).alias("_t", "_e"))
    rows = tiers.select(key, "_t", F.col("_e.key").try_cast("int").alias("tier"), F.posexplode(F.col("_e.value.sources")).alias("_k", "_s"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_t", "_k")) - 1
    return rows.select(key, place.alias("ord"), "tier", "_s.name", "_s.domain", "_s.site_query", F.coalesce("_s.language", F.lit("en")).alias("language"))


def routes(configs: DataFrame, key: str, raw: str, default: list[int]) -> DataFrame:
    """configs(key, raw): JSON of routes by goal type -> (key, goal_type, path, optional). A route without a path, as "auto", takes the default one."""
    parsed = F.from_json(raw, "routes map<string,string>")["routes"]
    each = configs.select(key, F.explode(F.map_entries(parsed)).alias("_e"))
    route = F.from_json(F.col("_e.value"), "path array<int>, optional_tiers array<int>")
    none = F.array().cast("array<int>")
    return each.select(key, F.col("_e.key").alias("goal_type"), F.coalesce(route["path"], F.array(*map(F.lit, default))).alias("path"), F.coalesce(route["optional_tiers"], none).alias("optional"))
