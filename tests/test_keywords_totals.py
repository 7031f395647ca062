"""Large keyword lists, totals on several levels, and merged sketches."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestra.operators import keywords, totals


def places(text, word, overlapping):
    out, at = [], text.find(word)
    while at >= 0:
        out.append(at)
        at = text.find(word, at + (1 if overlapping else len(word)))
    return out


@pytest.mark.parametrize("overlapping", [True, False])
@pytest.mark.parametrize("shard_bytes", [4 * 2**20, 10])
def test_matches_equal_brute_force(spark, overlapping, shard_bytes):
    r = random.Random(1)
    texts = [(k, "".join(r.choice("abAéB 🙂") for _ in range(r.randrange(60)))) for k in range(60)] + [(60, None), (61, ""), (None, "abab"), (3, "aaaa")]
    words = ["a", "aa", "ab", "bab", "É", "🙂a", " ", "zz", "AA", "", None, "ab"]
    got = keywords.matches(spark.createDataFrame(texts, "k int, t string").withColumn("start", F.lit("clash")), spark.createDataFrame([(w,) for w in words], "pattern string"), "k", "t", overlapping=overlapping, shard_bytes=shard_bytes)
    want = [(k, w, at) for k, t in texts if t for w in {x.lower() for x in words if x} for at in places(t.lower(), w, overlapping)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 300


def test_a_hundred_thousand_patterns_in_one_scan(spark):
    patterns = spark.range(100_000).select(F.concat(F.lit("item-"), F.col("id"), F.lit(";")).alias("pattern"))
    texts = spark.range(300).select("id", F.concat(F.lit("x ITEM-"), F.col("id") * 7, F.lit("; item-"), F.col("id") + 99_990, F.lit(";")).alias("t"))
    got = keywords.matches(texts, patterns, "id", "t")
    found = sorted(map(tuple, got.collect()))
    assert found == sorted([(i, f"item-{7 * i};", 2) for i in range(300)] + [(i, f"item-{i + 99_990};", 9 + len(str(7 * i))) for i in range(10)])
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_no_patterns_and_no_texts(spark):
    texts, none = spark.createDataFrame([("a", "x"), (None, None)], "k string, t string"), spark.createDataFrame([], "pattern string")
    assert keywords.matches(texts, none, "k", "t").count() == 0 and keywords.matches(texts.where("false"), none, "k", "t").count() == 0
    assert [r.hit for r in keywords.any_of(texts, none, "k", "t", "hit").collect()] == [False, False]
    assert {r.k: r.times for r in keywords.times(texts.where("k = 'a'"), spark.createDataFrame([("x",)], "pattern string"), "k", "t").collect()} == {"a": 1}


def test_totals_of_all_levels(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.choice([1, 2, None]), r.randrange(10)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b int, v int")
    for sets in (totals.rollup(["a", "b"]), totals.cube(["a", "b"]), [["b"], []]):
        got = totals.totals(df, ["a", "b"], sets, [F.count("*").alias("n"), F.sum("v").alias("v")])
        want = []
        for s in sets:
            level = sum(bit for bit, c in ((2, "a"), (1, "b")) if c not in s)
            n, v = Counter(), Counter()
            for a, b, x in rows:
                k = (a if "a" in s else None, b if "b" in s else None, level)
                n[k] += 1
                v[k] += x
            want += [(*k, n[k], v[k]) for k in n]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    assert [tuple(x) for x in totals.totals(df.where("false"), ["a", "b"], totals.rollup(["a", "b"]), [F.count("*").alias("n")]).collect()] == [(None, None, 3, 0)]


def test_merged_sketches_keep_their_errors(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 40).alias("day"), F.pmod(F.xxhash64("id"), F.lit(20_011)).alias("who"), F.when(F.col("id") % 7 > 0, F.rand(5) * 100).alias("v"))
    df = df.unionByName(spark.createDataFrame([(9, 0, None, None)], "g long, day long, who long, v double"))
    kept = totals.distinct_sketches(df, ["g", "day"], "who")
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("who").alias("n")).collect()}
    for r in totals.distinct_estimate(kept, ["g"]).collect():
        assert abs(r.estimate - exact[r.g]) <= max(1, exact[r.g] * totals.DISTINCT_ERROR)
    at = [0.0, 0.01, 0.5, 0.99, 1.0]
    told = totals.quantile_estimates(totals.quantile_sketches(df, ["g", "day"], "v"), ["g"], at).collect()
    values = {g: sorted(x.v for x in rows) for g, rows in itertools.groupby(sorted(df.where("v IS NOT NULL").collect(), key=lambda x: x.g), key=lambda x: x.g)}
    assert len(told) == 3 * len(at)
    for r in told:
        own = values[r.g]
        rank = sum(x <= r.estimate for x in own) / len(own)
        assert abs(rank - r.q) <= totals.RANK_ERROR + 1 / len(own)
