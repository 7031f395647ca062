"""Readers, logs, workspaces and streams on small folders."""

import json

from pyspark.sql import functions as F

from attestra.functions import rewriters
from attestra.operators import gates
from attestra.sources import documents, logs, workspace
from attestra.streaming import append_log


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_read_json_keeps_broken_rows(spark, tmp_path):
    put(tmp_path / "a.json", "﻿" + json.dumps({"topic": "x"}))
    put(tmp_path / "b.json", "{")
    got = {r.path[-6:]: (r.valid, r.doc.topic if r.doc else None) for r in documents.read_json(spark, str(tmp_path), documents.SCOPE).collect()}
    assert got == {"a.json": (True, "x"), "b.json": (False, None)}


def test_batch_shapes(spark):
    raw = ['[{"url":"u","content":"c","tier":2},{"url":"","content":"c"}]', '{"items":[{"url":"v","content":"d"}]}', '{"url":"w","content":"e"}', "{}", "no"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, raw string")
    got = [[i.url for i in (r[0] or [])] for r in df.select(documents.parse_batch(F.col("raw")), "k").orderBy("k").collect()]
    assert got == [["u"], ["v"], ["w"], [], []]


def test_ingest_appends_with_defaults(spark, tmp_path):
    rows = spark.createDataFrame([("https://e.com/A", "x" * 300)], "url string, content string")
    made = documents.ingested(rows)
    for _ in range(2):
        documents.append(made, str(tmp_path / "c"))
    r = made.first()
    assert (r.source_tier, r.direction, r.title, len(r.fetched_content)) == (3, "other", "https://e.com/A", 200)
    assert spark.read.json(str(tmp_path / "c")).count() == 2


def test_shards_and_fetch_ladder(spark, tmp_path):
    put(tmp_path / "s1.json", {"id": "a", "title": "t", "content": "old"})
    put(tmp_path / "s2.json", {"id": "a", "title": "t", "content": "new"})
    put(tmp_path / "s3.json", "broken")
    assert [r.content for r in documents.merge_shards(spark, str(tmp_path / "s*.json")).collect()] == ["new"]
    tries = spark.createDataFrame([("u", 1, "x" * 5), ("u", 2, "x" * 20), ("u", 3, "x" * 30), ("v", 1, "a"), ("v", 2, "aaa")], "u string, o int, c string")
    assert {r.u: r.o for r in documents.longest_shallow(tries, "u", "c", "o", 10).collect()} == {"u": 2, "v": 2}


def make_workspace(root, name, summary, text):
    put(root / name / "scope.json", {"topic": name, "goal_type": "other", "depth": "quick", "search_directions": ["d"]})
    put(root / name / "collected.json", [{"url": "https://www.E.com/a/", "title": "t", "snippet": "s", "source_tier": 1, "fetched_content": text, "direction": "d"}])
    claim = {"summary": summary, "sources": ["https://e.com/a", "https://missing.org/"], "evidence_type": "official_data", "confidence": "high", "precision": "exact"}
    put(root / name / "analysis.json", {"topic": name, "goal_type": "other", "sections": [{"id": "overview", "title": "o", "content": "{{ref:https://e.com/a}} {{ref:https://no.org}}", "claims": [claim], "tensions": []}]})


def test_workspaces_end_to_end(spark, tmp_path):
    make_workspace(tmp_path, "w1", "it costs 42 ms", "measured 42 ms")
    make_workspace(tmp_path, "w2", "it costs 42 ms", "measured 7 ms")
    w = workspace.load(spark, str(tmp_path))
    assert {r.ws: r.source_verification for r in workspace.verified(w).collect()} == {"w1": "source_confirmed", "w2": "source_absent"}
    trace = {r.subject: (r.passed, r.metric) for r in gates.url_traceability(w.scopes, w.collected, w.cites).collect()}
    assert trace == {"w1": (False, 1.0), "w2": (False, 1.0)}
    marks = {r.subject: r.metric for r in gates.ref_marker_validity(w.scopes, w.markers, w.collected).collect()}
    assert marks == {"w1": 1.0, "w2": 1.0}


def test_logs(spark, tmp_path):
    put(tmp_path / "n" / "learnings.md", "## [2024-01-02 03:04] Task: t1\nbody One\n## [2024-01-03 00:00] Task: t2\nother\n")
    got = logs.entries(spark, str(tmp_path / "n"))
    assert [(r.category, r.task, r.body) for r in got.orderBy("pos").collect()] == [("learnings", "t1", "body One"), ("learnings", "t2", "other")]
    assert logs.retrieve(got, "ONE").count() == 1
    put(tmp_path / "o.md", "# Log\n### Observation 1: a\n**Status:** OPEN\n**Issue:** x\n### Observation 2: b\n**Status:** ACTIONED 2024-01-01\n")
    assert [(r.num, r.status, r.issue) for r in logs.observations(spark, str(tmp_path / "o.md")).orderBy("num").collect()] == [(1, "OPEN", "x"), (2, "ACTIONED 2024-01-01", "")]
    put(tmp_path / "t.md", "# P1\n- [ ] a [someday:2024-02-01]\n- [x] b [delegated:me]\n# P2\n- [ ] c [doing]\n")
    todo = logs.todo_lines(spark, str(tmp_path / "t.md")).orderBy("pos").collect()
    assert [(r.quadrant, r.done, str(r.someday), r.doing, r.delegated) for r in todo] == [("P1", False, "2024-02-01", False, None), ("P1", True, "None", False, "me"), ("P2", False, "None", True, None)]


def test_keyed_stream(spark, tmp_path):
    put(tmp_path / "in" / "1.json", '{"url":"https://e.com/a","ts":"2024-01-01T00:00:00","title":"one"}\n{"url":"https://e.com/b","ts":"2024-01-01T00:00:00","title":"b"}')
    run = lambda: append_log.keyed_sink(append_log.read(spark, str(tmp_path / "in"), "url string, ts timestamp, title string"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    put(tmp_path / "in" / "2.json", '{"url":"https://www.E.com/a/","ts":"2024-01-02T00:00:00","title":"two"}')
    run()
    got = append_log.latest(spark, str(tmp_path / "out"))
    assert sorted(r.title for r in got.collect()) == ["b", "two"]
    for k in range(3, 6):  # the bucket of b stays as it was written first, those that are left behind go
        put(tmp_path / "in" / f"{k}.json", f'{{"url":"https://e.com/a","ts":"2024-01-0{k}T00:00:00","title":"v{k}"}}')
        run()
    assert sorted(r.title for r in append_log.latest(spark, str(tmp_path / "out")).collect()) == ["b", "v5"]
    assert set(append_log.newest(spark, str(tmp_path / "out")).values()) == {0, 4}
    assert sum(1 for _ in (tmp_path / "out").glob("v=*/bucket=*")) <= 3


def test_phase_states_and_loaded_rewriters(spark, tmp_path):
    for name, files in {"a": {"pipeline_state.json": '{"current_phase":"post_final"}'}, "b": {"pipeline_state.json": "{", "scope.json": "{}"}, "c": {"scope.json": "{}", "collected.json": "[]", "analysis.json": "{}", "review_report.md": "x"}, "d": {"other.md": "x"}}.items():
        for file, body in files.items():
            put(tmp_path / "ws" / name / file, body)
    assert {r.ws: r.phase for r in workspace.phases(spark, str(tmp_path / "ws")).collect()} == {"a": "post_final", "b": "post_scope", "c": "post_review", "d": "pre_scope"}
    put(tmp_path / "r" / "one.json", {"rules": [{"match": "^http:", "replace": "https:"}]})
    put(tmp_path / "r" / "two.json", "import os")
    found = rewriters.loaded(documents.read_whole(spark, str(tmp_path / "r")))
    assert set(found) == {"one"} and spark.range(1).select(found["one"](F.lit("http://e.com"))).first()[0] == "https://e.com"


def test_windowed_counts(spark, tmp_path):
    put(tmp_path / "in" / "1.json", '{"ts":"2024-01-01T00:01:00","s":"a"}\n{"ts":"2024-01-01T00:02:00","s":"a"}\n{"ts":"2024-01-01T00:31:00","s":"b"}')
    stream = append_log.status_counts(append_log.read(spark, str(tmp_path / "in"), "ts timestamp, s string"), "ts", "s")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.s, r.n) for r in spark.sql("select * from counted").collect()) == [("a", 2), ("b", 1)]


def test_texts_are_written_as_files(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a__b", "one"), ("c", "x\ny"), (None, "gone"), ("a__b", "two"), ("d-1", "")], "name string, text string")
    documents.write_texts(rows, root, "name", "text", ".md")
    found = {str(p.relative_to(tmp_path / "out")): sorted(p.read_text().split("\n")) for p in (tmp_path / "out").rglob("*.md")}
    assert found == {"a/b.md": ["", "one", "two"], "c.md": ["", "x", "y"], "d-1.md": ["", ""]}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_configurations_of_many_workspaces(spark):
    good = {"sources": {"2": {"sources": [{"name": "a", "domain": "a.org", "language": "zh"}, {"name": "b"}]}, "1": {"sources": [{"domain": "c.org"}]}, "x": {"sources": [{"name": "d"}]}, "3": {}}}
    rows = [("w", json.dumps(good)), ("broken", "{"), ("none", "{}"), ("null", None)]
    df = spark.createDataFrame(rows, "ws string, raw string")
    got = [(r.ws, r.ord, r.tier, r.name, r.domain, r.language) for r in documents.catalogues(df, "ws", "raw").orderBy("ord").collect()]
    assert got == [("w", 0, 2, "a", "a.org", "zh"), ("w", 1, 2, "b", None, "en"), ("w", 2, 1, None, "c.org", "en"), ("w", 3, None, "d", None, "en")]
    routes = {"routes": {"fact_check": {"entry_tier": 1, "path": [1, 2], "optional_tiers": [4]}, "other": "auto"}}
    df = spark.createDataFrame([("w", json.dumps(routes)), ("broken", "no")], "ws string, raw string")
    got = {r.goal_type: (r.ws, r.path, r.optional) for r in documents.routes(df, "ws", "raw", [2, 3]).collect()}
    assert got == {"fact_check": ("w", [1, 2], [4]), "other": ("w", [2, 3], [])}


def test_fidelity_ladder(spark):
    cases = {
        1: ([(False, 9000, 0.1)] * 3, ("BLOCKER", True, 0.0, "")), 2: ([(False, 0, None), (False, 9000, 0.1), (False, None, 0.1)], ("BLOCKER", False, 2 / 3, "block_missing")),
        3: ([(False, 100, 0.9), (False, 9000, 0.1)], ("BLOCKER", False, 0.5, "block_shallow")), 4: ([(False, 9000, 0.9), (False, 9000, 0.1)], ("BLOCKER", False, 0.5, "block_overlap")),
        5: ([(True, 0, None)] * 2 + [(False, 9000, 0.1)], ("WARN", False, 2 / 3, "warn_exempt")), 6: ([(False, 0, None)] + [(False, 9000, 0.1)] * 4, ("WARN", False, 1.0, "warn_missing")),
        7: ([(False, 3000, 0.1), (False, 100, 0.1)] + [(False, 9000, 0.1)] * 4, ("WARN", False, 2.0, "warn_depth")), 8: ([(True, 0, None)], ("BLOCKER", True, 0.0, "")), 9: ([], ("BLOCKER", True, 0.0, "")),
    }
    rows = spark.createDataFrame([(ws, *r) for ws, (own, _) in cases.items() for r in own], "ws long, failed boolean, chars long, overlap double")
    got = {int(r.subject): (r.level, r.passed, r.metric, r.detail) for r in gates.fidelity_verdicts(spark.createDataFrame([(k,) for k in cases], "ws long"), rows).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}


def test_bytes_of_any_charset(spark):
    from attestra.functions import diffs

    raw = ["naïve 汉字".encode(), "汉字".encode("gb18030"), b"caf\xe9", b"", None, b"ok \xff\xfe\xfd\x81"]
    df = spark.createDataFrame([(k, None if r is None else bytearray(r)) for k, r in enumerate(raw)], "k int, raw binary")
    got = [r.t for r in df.select("k", diffs.decoded(F.col("raw")).alias("t")).orderBy("k").collect()]
    assert got[:2] == ["naïve 汉字", "汉字"] and got[2:5] == ["café", "", None] and got[5].startswith("ok ")
