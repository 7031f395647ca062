"""Many keywords in one scan: an automaton over all patterns instead of one alternation.

A scan's cost doesn't depend on how many patterns there are. The automaton is built from a bounded shard of the
patterns and broadcast; patterns beyond a shard's bytes make further shards, each of which is a scan of its own, so none is left out.
"""

from __future__ import annotations

import math
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attestra.session import written

#: Bytes of the patterns of one automaton, which takes about 100 times as much at the most, and matches that a task hands on at once.
SHARD_BYTES, FLUSH = 4 * 2**20, 50_000


def matches(texts: DataFrame, patterns: DataFrame, key: str, text: str, fold: bool = True, overlapping: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """texts(key, text, ...) x patterns(pattern, ...) -> (key, pattern, start) for each place where a pattern stands in a text.

    start is a code point from 0. fold: both are compared in lower case, and start counts in the lower-cased text. Occurrences of different
    patterns may overlap; those of one pattern too, unless overlapping is False: then, as str.count does, each one begins
    behind the end of the one before. Null and empty patterns and null texts match nothing; a pattern that is told twice
    counts once; rows with the same key each give their matches.
    """
    spark = texts.sparkSession
    low = (lambda c: F.lower(c)) if fold else (lambda c: c)
    wanted = patterns.select(low(F.col("pattern")).alias("pattern")).where("pattern <> ''").distinct()
    wanted = written(wanted, "patterns")
    size = wanted.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))
    rows = texts.select(F.col(key), low(F.col(text)).alias("_text")).where("_text IS NOT NULL")
    found = None
    for shard in range(shards):
        own = wanted if shards == 1 else wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == shard)
        part = _scanned(rows, key, [r["pattern"] for r in own.collect()], overlapping, spark)  # about shard_bytes
        found = part if found is None else found.unionByName(part)
    return found


def _scanned(rows: DataFrame, key: str, patterns: list[str], overlapping: bool, spark) -> DataFrame:
    name = uuid.uuid4().hex
    told = spark.sparkContext.broadcast(patterns)  # the automaton itself is built once a worker, as it is larger than its patterns

    def scan(batches):
        machine = _machine(name, told)
        keys, words, starts = [], [], []
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                last: dict[str, int] = {}
                for end, word in machine.iter(value.as_py()) if machine else ():
                    start = end - len(word) + 1
                    if not overlapping:
                        if start < last.get(word, 0):
                            continue
                        last[word] = end + 1
                    keys.append(k)
                    words.append(word)
                    starts.append(start)
                    if len(keys) >= FLUSH:
                        yield told_rows(keys, words, starts)
                        keys, words, starts = [], [], []
        yield told_rows(keys, words, starts)

    kind = rows.schema[key].dataType
    schema, arrow = f"`{key}` {kind.simpleString()}, pattern string, start int", to_arrow_type(kind)

    def told_rows(keys, words, starts):
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(words, pa.string()), pa.array(starts, pa.int32())], names=[key, "pattern", "start"])

    return rows.mapInArrow(scan, schema)


#: The automaton of the last shard that a worker has met, by the shard's name.
_LAST: dict[str, object] = {}


def _machine(shard: str, patterns):
    if shard not in _LAST:
        _LAST.clear()
        machine = ahocorasick.Automaton()
        for word in patterns.value:
            machine.add_word(word, word)
        if len(machine):
            machine.make_automaton()
        _LAST[shard] = machine if len(machine) else None
    return _LAST[shard]


def any_of(texts: DataFrame, patterns: DataFrame, key: str, text: str, out: str, fold: bool = True) -> DataFrame:
    """texts with out: whether any pattern stands in the text. Keys are to be those of rows, null keys have none."""
    hits = matches(texts, patterns, key, text, fold).select(F.col(key)).distinct().withColumn(out, F.lit(True))
    return texts.join(hits, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def times(texts: DataFrame, patterns: DataFrame, key: str, text: str) -> DataFrame:
    """(key, times): how often the patterns stand in the texts of a key, counted as str.count counts each, 0 without any."""
    hits = matches(texts, patterns, key, text, overlapping=False).groupBy(key).agg(F.count("*").alias("times"))
    return texts.select(key).distinct().join(hits, key, "left").select(key, F.coalesce("times", F.lit(0)).cast("long").alias("times"))
