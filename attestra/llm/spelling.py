"""Operator 13: spelling variants by anagram hashing.

A word's anagram key is the sum of its letters' fifth powers, an integer that doesn't depend on their order. Two words that
differ by one letter have keys that differ by the value of that letter, if it is added or removed, or by the
difference of two values, if one is exchanged for another. So each word gives its key less the value of each of its
letters: a shorter word's own key among these is a removal (and, the other way round, an addition), an equal
one from a word of the same length is an exchange. Words that meet are verified letter by letter.

Words with the same letters in another order share their keys, so a group of them may be of any size. One letter's
difference leaves either the first or the last half of the shorter word as it is: groups over ``CROWD`` words are therefore split further
by that half, from either end, which loses no pair and keeps what meets in bounds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm.work import few, forget, map_arrow, stored
from attestra.llm.words import UPPER

#: The pattern of the contract, and its power of a letter's code.
RUN = r"[A-Za-zÀ-ÿ]+"
POWER = 5
SHORTEST, RAREST, RATIO = 5, 3, 2
#: Words that a task counts before it hands them on, characters of a text that are split at once, words of a group without further split.
FLUSH, LONG, CROWD = 400_000, 1_000_000, 128
#: Keys are kept under this, so that words of any length have one.
MODULUS = 2**61 - 1

_RUN = re.compile(RUN)
_LOWER = {ord(c): ord(c.lower()) for c in UPPER}


def runs_of(text: str) -> Counter:
    """How often each run of letters, A-Z lower-cased, stands in a text."""
    raw = Counter(_RUN.findall(text)) if len(text) <= LONG else Counter(m.group() for m in _RUN.finditer(text))
    out: Counter = Counter()
    for run, n in raw.items():
        out[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    return out


def noisy(doc_id: int | None, run: str, every: int) -> str:
    """The run, without one of its letters if every divides the crc32 of doc_id:run."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, noise: int | None = None, shortest: int = SHORTEST) -> DataFrame:
    """docs(doc_id, text, ...) -> (word, n) over whole texts. noise: the divisor of noisy(). Each task sums its own words first."""

    def count(batches):
        sums: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for run, n in runs_of(text.as_py() or "").items():
                    word = noisy(doc_id, run, noise) if noise else run
                    if len(word) >= shortest:
                        sums[word] += n
                if len(sums) > FLUSH:
                    yield told(sums)
                    sums = Counter()
        yield told(sums)

    def told(sums):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.int64())})

    return map_arrow(docs.select("doc_id", "text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def value(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def anagram_key(word: Column) -> Column:
    """The sum of the fifth powers of the letters' codes, under MODULUS."""
    letters = F.split(word, "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda total, c: F.pmod(total + value(c), F.lit(MODULUS)))


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """words(word, n), each word once -> (word, near, near_n): ordered pairs that differ by exactly one letter added, removed or exchanged."""
    keyed = stored(words.where("word <> ''").select("word", "n", F.length("word").alias("size"), anagram_key(F.col("word")).alias("key")), "keyed")
    letters = F.array_distinct(F.split("word", ""))
    less = F.transform(letters, lambda c: F.pmod(F.col("key") - value(c), F.lit(MODULUS)))
    removed = keyed.select("word", "n", "size", F.explode(less).alias("key"))
    # removal and addition: a longer word less one letter meets a shorter word itself; exchange: two words less one letter each meet
    long_side = removed.select("word", "n", (F.col("size") - 1).alias("rest"), "key")
    short_side = keyed.select("word", "n", F.col("size").alias("rest"), "key")
    spread = stored(long_side.withColumn("whole", F.lit(False)).unionByName(short_side.withColumn("whole", F.lit(True))), "keys")
    large = few(stored(spread.groupBy("rest", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select("rest", "key"), "crowds"))
    marked = spread.join(large.withColumn("_large", F.lit(True)), ["rest", "key"], "left")
    half = F.floor(F.col("rest") / 2).cast("int")
    ends = F.array(
        F.concat(F.lit("<"), F.substring("word", F.lit(1), half)),
        F.concat(F.lit(">"), F.substring("word", F.length("word") - (F.col("rest") - half) + 1, F.col("rest") - half)),
    )
    dealt = marked.withColumn("end", F.explode(F.when(F.col("_large"), ends).otherwise(F.array(F.lit(""))))).drop("_large")
    a = dealt.where("NOT whole").select(F.col("word").alias("a"), F.col("n").alias("a_n"), "rest", "key", "end")
    b = dealt.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "rest", "key", "end", "whole")
    met = a.join(b, ["rest", "key", "end"]).where(F.col("whole") | (F.col("a") < F.col("b")))
    pairs = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))


def variants(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """words(word, n) -> (word, n, n_near, form, form_n, root), each word once.

    n_near is the number of near words. form is the near word with the largest n, ties by code-point order, if that n is at least
    ratio times the word's, else null; root is the end of the chain of forms, the word itself without one. Null and
    empty words go; of repeated words the n are summed; other columns are ignored; an empty table gives an empty result.
    """
    own = stored(words.where("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    pairs = near_words(own, crowd)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    summed = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = own.join(summed, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    formed = stored(formed, "formed")
    return formed.join(_roots(formed.where("form IS NOT NULL").select("word", "form"), ratio), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(forms: DataFrame, ratio: int) -> DataFrame:
    """forms(word, form) -> (word, root): pointers are doubled until none moves. n grows along a chain, so it ends."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(64):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        new = stored(now.join(step, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "roots")
        moved = not new.where("moved").isEmpty()
        forget(now)
        now = new.drop("moved")
        if not moved:
            return now
    raise RuntimeError("chains of forms didn't end")


def spelling_variants(docs: DataFrame, noise: int | None = None, shortest: int = SHORTEST, rarest: int = RAREST, ratio: int = RATIO) -> DataFrame:
    """docs(doc_id, text, ...) -> word, form, root, n, n_near, form_n for each word of at least shortest letters and rarest occurrences.

    Words are runs of Latin letters of whole texts, A-Z lower-cased; null and empty texts have none. With noise, letters are
    removed by noisy() first, a null doc_id being ``None``. Repeated rows count again. See variants() for the rest.
    """
    words = stored(word_counts(docs, noise, shortest).where(F.col("n") >= rarest), "counts")
    return variants(words, ratio).select("word", "form", "root", "n", "n_near", "form_n")


__all__ = ["anagram_key", "near_words", "spelling_variants", "variants", "word_counts"]
