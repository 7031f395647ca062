"""A log with several writers, the Markdown source, and functions for SQL text."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from attestra.functions import registered
from attestra.sources import manifest, markdown


def test_appends_of_several_writers_are_all_kept(spark, tmp_path):
    table = f"file://{tmp_path}/log with space"
    seen = []

    def write(w):
        return [manifest.append(spark.range(w * 100 + k * 10, w * 100 + k * 10 + 10), table) for k in range(3)]

    def look(_):
        for _ in range(4):
            now = manifest.snapshot(spark, table)
            seen.append(0 if now is None else now.count())

    with ThreadPoolExecutor(4) as pool:
        reader = pool.submit(look, None)
        made = [v for vs in pool.map(write, range(3)) for v in vs]
        reader.result()
    assert sorted(made) == manifest.versions(spark, table) == list(range(1, 10))
    assert manifest.snapshot(spark, table).count() == 90 and all(n % 10 == 0 for n in seen)
    assert manifest.snapshot(spark, table, 4).count() == 40 and manifest.snapshot(spark, table, 0) is None
    assert [r.kind for r in manifest.history(spark, table).collect()] == ["append"] * 9
    assert not [p for p in (tmp_path / "log with space" / "_log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_rewrite_begins_anew_when_another_version_comes_first(spark, tmp_path):
    table, calls = f"file://{tmp_path}/t", []
    manifest.append(spark.range(10), table)

    def change(now):
        calls.append(now.count())
        if len(calls) == 1:
            manifest.append(spark.range(10, 15), table)  # another writer, between the read and the commit
        return now.where("id % 2 = 0")

    assert manifest.rewrite(spark, table, change) == 3
    assert calls == [10, 15] and sorted(r.id for r in manifest.snapshot(spark, table).collect()) == [0, 2, 4, 6, 8, 10, 12, 14]
    assert manifest.snapshot(spark, table, 2).count() == 15  # what a version lists stays
    manifest.append(spark.range(100, 101), table)
    assert manifest.snapshot(spark, table).count() == 9 and len(manifest.entries(spark, table)) == 2


def test_a_taken_version_is_a_conflict(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    manifest.append(spark.range(1), table)
    entry = {"version": 1, "kind": "append", "data": "x", "schema": "id long"}
    assert not manifest._created(spark, table, entry) and manifest._created(spark, table, {**entry, "version": 2})


FILES = {
    "a.md": "---\ntopic: A: one\ngoal_type: other\ndate: 2024-01-02\n---\n# A\nx",
    "d/b.md": "﻿---\r\ntopic: B\r\ngoal_type:  fact_check \r\n---\r\nbody\r\n",
    "plain.md": "# no front matter\n---\nx: y\n---\n",
    "open.md": "---\ntopic: never closed\n",
    "long.md": "---\ntopic: L\ngoal_type: other\n" + "note: " + "n" * 9000 + "\n---\n" + "z" * 9000,
    "empty.md": "",
    "no.txt": "---\ntopic: T\n---\n",
}


@pytest.fixture
def reports(spark, tmp_path):
    for name, text in FILES.items():
        at = tmp_path / "r" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode())
    markdown.register(spark)
    return tmp_path / "r"


@pytest.mark.parametrize("size", ["1", "1000000"])
def test_markdown_files_are_rows(spark, reports, size):
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.format("markdown").option("partitionBytes", size).load(str(reports)).collect()}
    assert set(rows) == {"a.md", "b.md", "plain.md", "open.md", "long.md", "empty.md"}
    assert (rows["a.md"].topic, rows["a.md"].goal_type, rows["a.md"].date, rows["a.md"].body) == ("A: one", "other", "2024-01-02", "# A\nx")
    assert (rows["b.md"].topic, rows["b.md"].goal_type, rows["b.md"].body.strip()) == ("B", "fact_check", "body")
    assert rows["plain.md"].topic is None and rows["plain.md"].body == FILES["plain.md"] and rows["open.md"].body == FILES["open.md"]
    assert rows["long.md"].topic == "L" and len(rows["long.md"].body) == 9000 and rows["empty.md"].body == ""


def test_markdown_filters_and_columns_are_pushed(spark, reports):
    df = spark.read.format("markdown").schema("topic string, goal_type string, note string").load(f"file://{reports}")
    got = df.where("goal_type IN ('other', 'x')").where(F.col("topic") == "L")
    assert [(r.topic, len(r.note)) for r in got.collect()] == [("L", 9000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan markdown[topic#" in plan and " IN " not in plan and "= L" not in plan  # the source has taken both, none is left to Spark
    assert df.where("topic > 'B'").count() == 1 and df.where("topic IS NULL").count() == 3  # left to Spark
    reader = markdown.MarkdownReader({"path": str(reports)}, ["topic"])
    kept = list(reader.pushFilters([markdown.EqualTo(("topic",), "B"), markdown.EqualTo(("body",), "x")]))
    assert [f.attribute for f in kept] == [("body",)]
    assert [r for p in reader.partitions() for r in reader.read(p)] == [("B",)]
    with pytest.raises(Exception, match="are strings"):
        spark.read.format("markdown").schema("topic int").load(str(reports)).collect()


def test_rewriters_from_sql(spark):
    registered.register_rewriter(spark, "t_rewrite", [(r"^https://a'b\.org/(\d+)$", r"https://c.org/$1"), (r"\.org", ".net")])
    values = ["https://a'b.org/12", "https://x.org/", "https://y.com", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    df.createOrReplaceTempView("t_urls")
    assert [r[0] for r in spark.sql("SELECT t_rewrite(v) FROM t_urls ORDER BY k").collect()] == ["https://c.org/12", "https://x.net/", "https://y.com", None]
    registered.register_rewriter(spark, "t_same", [])
    assert spark.sql("SELECT t_same('u')").first()[0] == "u"
    with pytest.raises(ValueError):
        registered.register_rewriter(spark, "no name; DROP", [])


def test_sections_from_sql(spark):
    lines = ["intro", "# A", "x", "### C", "", "## B", "#hash", "####### seven"]
    rows = [(1, k, v) for k, v in enumerate(lines)] + [(2, 0, None), (3, 0, "## only"), (None, 5, "# n")]
    spark.createDataFrame(rows, "doc long, pos long, line string").repartition(3).createOrReplaceTempView("t_lines")
    registered.register_sections(spark, "t_sections")
    got = [tuple(r) for r in spark.sql("SELECT * FROM t_sections(TABLE(t_lines) PARTITION BY doc ORDER BY pos)").collect()]
    want = [("1", 1, 1, "A", False, 1), ("1", 3, 3, "C", True, 1), ("1", 5, 2, "B", False, 2), ("3", 0, 2, "only", False, 0), (None, 5, 1, "n", False, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_views_and_table_functions(spark):
    claims = spark.createDataFrame([(1, "s", "x", 3), (2, "t", "y", 4)], "cid long, section string, summary string, num long")
    edges = spark.createDataFrame([(1, 7, True), (1, 8, False), (2, 8, True)], "cid long, s_suppkey long, supports boolean")
    sources = spark.createDataFrame([(7, "h", 1), (8, "i", 3)], "s_suppkey long, host string, tier int")
    registered.register_views(spark, claims, edges, sources, "t_")
    assert [tuple(r) for r in spark.sql("SELECT * FROM t_claims_of('s')").collect()] == [(1, "x", 3)]
    assert sorted(tuple(r) for r in spark.sql("SELECT c.cid, b.host, b.tier FROM t_claims c, LATERAL t_cited_by(c.cid) b").collect()) == [(1, "h", 1), (1, "i", 3), (2, "i", 3)]


def test_the_registry_loads_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 200"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
