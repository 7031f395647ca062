"""The pipeline's stages on a small fixture, and the registered queries against their SQL."""

import random
from pathlib import Path

import corpus_pipeline
import pytest
from tests.conftest import SF, same
from tests.llm.test_pairs import around_one, brute
from tests.llm.test_texts import contaminated

from attestra.llm import queries
from attestra.session import own_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Real documents, and planted ones: copies, near copies, benchmark passages, junk and texts without letters."""
    root = tmp_path_factory.mktemp("tables")
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    r = random.Random(3)
    clean = [d for d in docs if d[2] == "en" and 800 < d[4] < 3000 and "%%%" not in d[1] and "!!" not in d[1]][:6]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    for k, d in enumerate(clean[:3]):
        w = d[1].split(" ")
        w[r.randrange(len(w))] = "changedword"
        docs += [(9000 + k, d[1], "en", "s", d[4]), (9100 + k, " ".join(w), "en", "s", d[4])]
    docs += [(9200, clean[3][1] + " " + bench + " " + clean[4][1], "en", "s", 1), (9300, "12345 !!! 678", "en", "s", 9), (9301, None, None, "s", 0), (None, "12345 !!! 678", "en", "no letters", 9), (None, "%%% ### " * 300 + "Q#x%j " * 300, "en", "junk", 1), (None, clean[5][1] + " " + bench, "en", "benchmark", 1), (None, clean[4][1], None, "clean", 1), (9400, clean[5][1], "en", "again", 1), (9400, clean[5][1], "en", "again", 1), (9302, "%%% ### " * 300 + "Q#x%j " * 300, "en", "s", 1)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{root}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{root}/{t}.parquet")
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, nameless = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert sorted(docs.columns) == sorted(before.columns)
            rows = docs.collect()
            docs = spark.createDataFrame(rows, SCHEMA)
            kept[name] = {x.doc_id: x.text for x in rows if x.doc_id is not None}
            nameless[name] = {(x.source, x.lang) for x in rows if x.doc_id is None}
        if name == "ngram_dedup":
            texts = [(x.doc_id, x.text) for x in before.where("doc_id is not null").select("doc_id", "text").collect()]
            assert set(kept[name]) == {c for _, c, _ in brute(texts)}
        if name == "decontamination":
            rows = [(x.doc_id, x.text) for x in before.where("doc_id is not null").select("doc_id", "text").collect()]
            items = [(x.item_id, x.text) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            judged = contaminated([t for _, t in rows], items)
            assert set(kept[name]) == {i for (i, _), j in zip(rows, judged, strict=True) if not j[1]}
        if name == "packing":
            own = docs.select("doc_id").distinct().collect()
            assert {x.doc_id for x in own} == {None, *kept["decontamination"]}
    assert not {9300, 9301} & set(kept["language_id"]) and 9302 not in kept["quality"]
    assert not {9000, 9001, 9002, 9100, 9101, 9102} & set(kept["ngram_dedup"]) and 9200 not in kept["decontamination"] and 9400 not in kept["ngram_dedup"]
    assert nameless["language_id"] == {("junk", "en"), ("benchmark", "en"), ("clean", "en")}  # whose lang was null
    assert nameless["quality"] == nameless["ngram_dedup"] == {("benchmark", "en"), ("clean", "en")} and nameless["decontamination"] == {("clean", "en")}


def test_third_stage_finds_links_over_classes_that_stand_between(spark, folder):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([*around_one(80), "another text"])], SCHEMA)
    assert sorted(x.doc_id for x in dict(corpus_pipeline.STAGES)["ngram_dedup"](spark, docs, folder).collect()) == [0, 81]


def test_third_stage_keeps_one_document_of_shifted_copies(spark, folder):
    texts = [*around_one(80), "another text"]
    docs = spark.createDataFrame([(100 + i + 300 * k, t, "en", "s", len(t)) for k in range(6) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(x.doc_id for x in dict(corpus_pipeline.STAGES)["ngram_dedup"](spark, docs, folder).collect()) == [100, 181]


def test_stages_of_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_run_is_registered(spark, folder):
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, folder)
    assert out.where("offset = 0").count() > 0
    left = Path(own_dir(spark).removeprefix("file:")).glob("stage-*")
    assert len(list(left)) == 1  # what stages store goes with them
