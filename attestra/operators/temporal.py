"""Joins on time: the newest earlier row of a key, and intervals that overlap. Both are sorts and equi-joins, never nested loops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.session import few, written

#: Rows of a key that are sorted in one task; a key with more is cut into ranges of time.
MOST = 1_000_000
#: Each level of bins is this many times as wide as the one before.
FACTOR = 16


def asof(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, tie: str | None = None, values: list[str] | None = None,
    direction: str = "backward", strict: bool = False, tolerance: Column | None = None, most: int = MOST,
) -> DataFrame:
    """left's rows with the columns ``values`` of the newest row of right that has the same ``on`` and is not later.

    Of right rows at the same time the one with the largest ``tie`` counts. direction forward: the oldest that is not
    earlier, with the smallest tie. strict: right's time must differ. tolerance: how far apart the two may be, an
    interval. Without such a row, or with a null in on or a time, values are null; right's nulls never match; left's
    repeated rows each get their row. Values (all other columns of right, if not told) mustn't be names of left's columns.

    Both sides are one table, sorted once for each key, along which the last right row is carried on. A key with over
    ``most`` rows is cut into ranges of time by quantiles, so that several tasks sort it; the last right row before a
    range is carried into it from a table with one row for each range.
    """
    values = [c for c in right.columns if c not in (*on, right_time)] if values is None else values
    sign = 1 if direction == "backward" else -1
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * sign
    known = [F.col(c).isNotNull() for c in on]
    order = F.lit(0) if tie is None else F.col(tie)
    a = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], micros(left_time).alias("_t"), F.lit(1 if not strict else 0).alias("_side"), F.struct(*left.columns).alias("_row"))
    b = right.where(F.col(right_time).isNotNull())
    for k in known:
        b = b.where(k)
    held = F.struct(micros(right_time).alias("_at"), order.alias("_tie"), F.struct(*values).alias("_values"))
    b = b.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], micros(right_time).alias("_t"), F.lit(0 if not strict else 1).alias("_side"), held.alias("_held"))
    keys = [f"_k{i}" for i in range(len(on))]
    both = a.withColumn("_held", F.lit(None).cast(b.schema["_held"].dataType)).unionByName(b.withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType)))

    lost = F.col("_t").isNull()  # rows that match nothing need no order, so they are dealt out
    for k in keys:
        lost = lost | F.col(k).isNull()
    spread = F.when(lost, -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(0).cast("int")
    hot = written(both.where(~lost).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most), "hot")
    largest = hot.agg(F.max("_n")).first()[0]
    if largest is None:
        parted, cuts = both.withColumn("_part", spread), None
    else:
        marks = [i / k for k in [min(4096, math.ceil(largest / most) + 1)] for i in range(1, k)]
        cuts = both.where(~lost).join(few(hot.select(*keys)), keys).groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_t", marks, 10_000)).alias("_cuts"))
        cuts = few(written(cuts, "cuts"), 64 + 8 * len(marks))
        part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_t"))), F.lit(0))
        parted = both.join(cuts, keys, "left").withColumn("_part", F.when(lost, spread).when(F.col("_cuts").isNull(), 0).otherwise(part)).withColumn("_hot", F.col("_cuts").isNotNull()).drop("_cuts")

    # of right rows at one time the winner comes last: the largest tie going backward, the smallest going forward
    ranked = F.col("_held")["_tie"].asc_nulls_first() if sign == 1 else F.col("_held")["_tie"].desc_nulls_first()
    along = Window.partitionBy(*keys, "_part").orderBy("_t", "_side", ranked).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parted.withColumn("_found", F.last("_held", ignorenulls=True).over(along)).where("_row IS NOT NULL")

    if cuts is not None:  # the last right row of each range of a hot key goes on into the ranges after it
        at, tied = F.col("_held")["_at"], F.col("_held")["_tie"]
        end = F.max_by("_held", F.struct(at.alias("at"), tied.alias("tie"))) if sign == 1 else F.min_by("_held", F.struct((-at).alias("at"), tied.isNull().alias("none"), tied.alias("tie")))
        ends = parted.where("_hot AND _held IS NOT NULL").groupBy(*keys, "_part").agg(end.alias("_end"))
        spans = cuts.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_part"))
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = spans.join(ends, [*keys, "_part"], "left").withColumn("_before", F.last("_end", ignorenulls=True).over(before)).where("_before IS NOT NULL")
        out = out.join(starts.select(*keys, "_part", "_before"), [*keys, "_part"], "left").withColumn("_found", F.coalesce("_found", "_before"))
    match = ~lost
    if tolerance is not None:
        here, there = F.timestamp_micros(F.col("_t") * sign), F.timestamp_micros(F.col("_found")["_at"] * sign)
        match = match & ((there + tolerance >= here) if sign == 1 else (here + tolerance >= there))
    return out.select("_row.*", *[F.when(match, F.col("_found")["_values"][c]).alias(c) for c in values])


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: list[str] | None = None, width: int | None = None) -> DataFrame:
    """(l, r): structs of the rows of left and right whose half-open spans [start, end) overlap and that agree in ``on``.

    Spans are of timestamps. Nulls and spans that end before or as they start overlap with nothing; repeated rows count again.

    The axis is cut into bins on several levels, each FACTOR times as wide as the one before. A span lives on the lowest
    level whose bins are at least as wide as it is, in one or two bins, and also looks into the one or two bins on each
    higher level that it touches, so however long or short, it has few rows. Two spans meet on the higher one of their levels, and count only
    in the bin where the later one starts, which is the first that both touch. width: the lowest level's, in
    microseconds; by default the median length.
    """
    on = on or []
    a, b = _spans(left, left_span, on, "l"), _spans(right, right_span, on, "r")
    if width is None:
        lengths = a.select((F.col("_e") - F.col("_s")).alias("n")).unionAll(b.select((F.col("_e") - F.col("_s")).alias("n")))
        width = lengths.agg(F.percentile_approx("n", 0.5)).first()[0] or 1
    a, b = a.withColumn("_own", _level(width)), b.withColumn("_own", _level(width))
    of_a, of_b = ({r["_own"] for r in side.select("_own").distinct().collect()} for side in (a, b))  # a few levels
    a, b = _binned(a, width, of_b), _binned(b, width, of_a).withColumnsRenamed({"_s": "_rs", "_e": "_re", "_home": "_rhome"})
    keys = [*[f"_k{i}" for i in range(len(on))], "_level", "_bin"]
    # visitors of a bin meet those that live there, not each other
    met = a.where("_home").join(b, keys).unionByName(a.where("NOT _home").join(b.where("_rhome"), keys))
    first = F.floor(F.greatest("_s", "_rs") / _size(width)) == F.col("_bin")
    return met.where((F.col("_s") < F.col("_re")) & (F.col("_rs") < F.col("_e")) & first).select("l", "r")


def _spans(df: DataFrame, span: tuple[str, str], on: list[str], name: str) -> DataFrame:
    start, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in span)
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], start.alias("_s"), end.alias("_e"), F.struct(*df.columns).alias(name))
    return rows.where("_s < _e")


def _level(width: int) -> Column:
    """The lowest level whose bins are as wide as the span."""
    return F.greatest(F.lit(0), F.ceil(F.log((F.col("_e") - F.col("_s")) / F.lit(width)) / math.log(FACTOR) - 1e-9)).cast("int")


def _size(width: int) -> Column:
    return F.lit(width) * F.pow(F.lit(FACTOR), F.col("_level")).cast("long")


def _binned(spans: DataFrame, width: int, others: set[int]) -> DataFrame:
    """A row for each bin that a span lives in, or looks into on a higher level on which spans of the other side live."""
    higher = F.filter(F.array(*map(F.lit, sorted(others))), lambda x: x > F.col("_own")) if others else F.array().cast("array<int>")
    levels = spans.withColumn("_level", F.explode(F.concat(F.array("_own"), higher)))
    bins = F.sequence(F.floor(F.col("_s") / _size(width)), F.floor((F.col("_e") - 1) / _size(width)))
    return levels.withColumn("_bin", F.explode(bins)).withColumn("_home", F.col("_level") == F.col("_own")).drop("_own")
