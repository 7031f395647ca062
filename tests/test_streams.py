"""Streams: what is late goes, what repeats counts once, and a later run goes on from the checkpoint."""

import datetime as dt
import json

from pyspark.sql import functions as F

from attestra.streaming import events

SCHEMA = "id long, ts timestamp, who string, kind string"
NOON = dt.datetime(2024, 1, 1, 12)


def batch(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"id": i, "ts": None if m is None else (NOON + dt.timedelta(minutes=m)).isoformat(), "who": who, "kind": kind}) for i, m, who, kind in rows]
    (path / f"{name}.json").write_text("\n".join(lines))


def minutes(t):
    return int((t - NOON).total_seconds() / 60)


def run(spark, tmp_path, transform, *batches):
    out = []
    for k, rows in enumerate(batches):
        batch(tmp_path / "in", f"b{k}", rows)
        stream = transform(events.read(spark, str(tmp_path / "in"), SCHEMA))
        out.append(events.caught_up(stream, str(tmp_path / "out"), str(tmp_path / "check")).collect())
    return out


def test_each_event_once(spark, tmp_path):
    first = [(1, 0, "a", "x"), (1, 0, "a", "x"), (2, 100, "a", "x"), (3, None, "a", "x")]
    second = [(2, 100, "a", "x"), (4, 39, "a", "late"), (5, 40, "a", "at the watermark"), (6, 41, "a", "in time"), (7, 200, "b", "x")]
    got = run(spark, tmp_path, lambda s: events.once(s, ["id"], "ts", "60 minutes"), first, second)
    assert sorted(r.id for r in got[0]) == [1, 2]
    assert sorted(r.id for r in got[1]) == [1, 2, 6, 7]  # the watermark is 100 - 60 minutes: what isn't after it is late


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    first = [(1, 0, "a", "x"), (2, 5, "a", "x"), (3, 30, "a", "x"), (4, 0, "b", "x"), (5, 60, "b", "x"), (6, 1, None, "x")]
    second = [(7, 35, "a", "joins the open one"), (8, 2, "a", "late"), (9, 200, "c", "x")]
    got = run(spark, tmp_path, lambda s: events.sessions(s, "who", "ts", "10 minutes", "30 minutes", value="id"), first, second)
    told = lambda rows: sorted((r.who, minutes(r.began), minutes(r.ended), r.events, r.total) for r in rows)
    assert told(got[0]) == [("a", 0, 15, 2, 3), ("b", 0, 10, 1, 4)]
    assert told(got[1]) == [("a", 0, 15, 2, 3), ("a", 30, 45, 2, 10), ("b", 0, 10, 1, 4), ("b", 60, 70, 1, 5)]


def test_streams_that_follow_each_other(spark, tmp_path):
    def pairs(how):
        def transform(s):
            left = s.where("kind = 'click'").select(F.col("id").alias("l"), "who", F.col("ts").alias("t"))
            right = s.where("kind = 'buy'").select(F.col("id").alias("r"), "who", F.col("ts").alias("u"))
            return events.followed(left, right, "who", "t", "u", "20 MINUTES", "30 minutes", how)

        return transform

    first = [(1, 0, "a", "click"), (2, 20, "a", "buy"), (3, 21, "a", "buy"), (4, 0, "b", "click"), (5, 0, "a", "buy"), (6, 10, None, "click"), (7, 11, None, "buy")]
    second = [(8, 15, "b", "buy"), (9, 300, "c", "click"), (10, 300, "c", "buy")]
    third = [(11, 600, "c", "click"), (12, 601, "c", "buy")]
    got = run(spark, tmp_path / "i", pairs("inner"), first, second)
    assert sorted((r.l, r.r) for r in got[1]) == [(1, 2), (4, 8)]
    got = run(spark, tmp_path / "o", pairs("leftOuter"), first, second, third)
    assert sorted((r.l, r.r) for r in got[2] if r.r is not None) == [(1, 2), (4, 8), (11, 12)]
    assert 9 in {r.l for r in got[2] if r.r is None}
