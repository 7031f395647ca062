"""Joins on time against brute force."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import temporal

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def sides(seed, n=150, keys=4):
    r = random.Random(seed)
    key = lambda: None if r.random() < 0.05 else 0 if r.random() < 0.4 else r.randrange(keys)
    time = lambda: None if r.random() < 0.05 else r.randrange(60)
    left = [(k, key(), time()) for k in range(n)]
    return left + left[:5], [(k, key(), time()) for k in range(n)]


def brute(left, right, direction, strict, tolerance):
    out = []
    for i, k, t in left:
        ok = [(rt, j) for j, rk, rt in right if None not in (k, t, rk, rt) and rk == k and (rt <= t if direction == "backward" else rt >= t) and not (strict and rt == t) and (tolerance is None or abs(t - rt) <= tolerance)]
        best = None if not ok else max(ok) if direction == "backward" else min(ok)
        out.append((i, best[1] if best else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction, strict, most, tolerance", [("backward", False, 10**6, None), ("backward", True, 20, None), ("forward", False, 20, None), ("forward", True, 20, 5), ("backward", False, 3, 4)])
def test_asof_equals_brute_force(spark, direction, strict, most, tolerance):
    left, right = sides(most)
    a = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "i long, k long, t timestamp")
    b = spark.createDataFrame([(j, k, at(t)) for j, k, t in right], "j long, k long, u timestamp")
    gap = None if tolerance is None else F.expr(f"INTERVAL {tolerance} MINUTES")
    got = temporal.asof(a, b, ["k"], "t", "u", tie="j", direction=direction, strict=strict, tolerance=gap, most=most)
    assert got.columns == ["i", "k", "t", "j"]
    assert sorted(((r.i, r.j) for r in got.collect()), key=str) == brute(left, right, direction, strict, tolerance)
    plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_asof_of_empty_sides(spark):
    a, b = spark.createDataFrame([(1, 1, at(3))], "i long, k long, t timestamp"), spark.createDataFrame([], "j long, k long, u timestamp")
    assert [r.j for r in temporal.asof(a, b, ["k"], "t", "u").collect()] == [None]
    assert temporal.asof(a.where("i > 1"), b, ["k"], "t", "u").count() == 0


@pytest.mark.parametrize("width", [None, 1, 60_000_000, 10**12])
@pytest.mark.parametrize("on", [["k"], []])
def test_overlaps_equal_brute_force(spark, width, on):
    r = random.Random(7)

    def spans(n):
        out = []
        for i in range(n):
            s = r.randrange(-500, 3000)
            out.append((i, r.randrange(3), s, s + r.choice((0, -3, 1, 2, 7, 30, 400, 3000))))
        return [*out, (n, None, 5, 9), (n + 1, 1, None, 9), (0, 0, 10, 20), (0, 0, 10, 20)]

    left, right = spans(80), spans(70)
    make = lambda rows: spark.createDataFrame([(i, k, at(s), at(e)) for i, k, s, e in rows], "i long, k long, s timestamp, e timestamp")
    got = temporal.overlapping(make(left), make(right), ("s", "e"), ("s", "e"), on, width)
    want = [
        (a[0], b[0]) for a, b in itertools.product(left, right)
        if None not in a[2:] + b[2:] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3] and (not on or None not in (a[1], b[1]) and a[1] == b[1])
    ]
    assert sorted((x.l.i, x.r.i) for x in got.collect()) == sorted(want) and len(want) > 100


def test_a_long_span_has_few_bins(spark):
    rows = spark.createDataFrame([(1, at(0), at(60 * 24 * 3650)), (2, at(5), at(6))], "i long, s timestamp, e timestamp")
    spans = temporal._spans(rows, ("s", "e"), [], "l").withColumn("_own", temporal._level(60_000_000))
    levels = {x["_own"] for x in spans.select("_own").collect()}
    assert temporal._binned(spans, 60_000_000, levels).groupBy("l.i").count().agg(F.max("count")).first()[0] <= 4


def test_visitors_of_a_bin_do_not_meet(spark):
    """Many short spans beside a long one on either side: what the joins make stays in proportion to the result."""
    short = spark.range(400).select(F.col("id").alias("i"), F.timestamp_seconds(F.col("id") * 60).alias("s"), F.timestamp_seconds(F.col("id") * 60 + 30).alias("e"))
    long = spark.createDataFrame([(1000, at(-60 * 24 * 365 * 60), at(60))], "i long, s timestamp, e timestamp")
    both = short.unionByName(long)
    assert temporal.overlapping(both, both, ("s", "e"), ("s", "e")).count() == 400 + 2 * 400 + 1
