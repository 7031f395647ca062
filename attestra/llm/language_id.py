"""Operator 10: language ID by word-first backoff.

A known word adds its log frequency in each language. An unseen word falls back to its character n-grams (with marks
for its two ends), the longest first: the first length of which the model knows a gram decides. The language with the
highest sum wins, and the score is its share of the likelihood.

Words and n-grams are counted by Spark over a sample of labelled rows, whole texts, chosen by a hash of doc_id: of about
``fit_rows`` documents and ``fit_chars`` characters, whichever is less. All its words and n-grams are in the model that is
broadcast, so that sample bounds it. The model holds 64-bit hashes of them, not the strings: two sorted arrays and a row of log
frequencies for each.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.work import few, map_arrow, numbered, remaining, sampled, shared, stored

FIT_ROWS, FIT_CHARS, LONGEST = 20_000, 60_000_000, 5
WORDS, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
UNKNOWN = "und"


def word_counts(text: str | None) -> Counter:
    """How often each word stands in a text: maximal runs of letters (Unicode category L), lower-cased."""
    found = Counter(WORDS.findall(text.lower())) if text else Counter()
    for odd in [w for w in found if not w.isalpha()]:  # the pattern also takes numerals as ½ and ②, which are no letters
        n = found.pop(odd)
        for w in LETTERS.findall(odd):
            found[w] += n
    return found


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> dict:
    """labelled(doc_id, text, lang) -> model. Rows with null text or lang teach nothing; without any, all is und."""
    known = labelled.where("text is not null and lang is not null")
    size = known.agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars")).first()
    share = min(1.0, fit_rows / max(1, size["n"]), fit_chars / max(1, size["chars"] or 0))
    sample = known.where(sampled(F.col("doc_id"), share, "fit"))
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    counts = stored(sample.select("lang", F.explode(letters).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    places = F.sequence(F.lit(1), F.length("word") + 2)
    each = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda k: F.transform(F.filter(places, lambda i: i + k <= F.length("word") + 3), lambda i: F.substring(marked, i, k))))
    grams = counts.select("lang", (1 + F.log("n")).alias("w"), F.explode(each).alias("gram")).groupBy("lang", "gram").agg(F.sum("w").alias("w"))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # a row for each language
    words = counts.select(F.xxhash64("word").alias("key"), "lang", F.col("n").cast("double").alias("n"), F.lit(0).alias("size"))
    return {"langs": langs, "words": _logs(words, langs), "grams": _logs(grams.select(F.xxhash64("gram").alias("key"), "lang", F.col("w").alias("n"), F.length("gram").alias("size")), langs)}


def _logs(counts: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """counts(key, lang, n, size) -> sorted keys, and a row of log frequencies by language for each; keys of a size are smoothed by themselves."""
    rows = counts.toArrow().combine_chunks()
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32)
    told = rows.column("lang").combine_chunks().dictionary_encode()
    keys, first, which = np.unique(rows.column("key").to_numpy().view(np.uint64), return_index=True, return_inverse=True)
    table = np.zeros((len(keys), len(langs)))
    np.add.at(table, (which.reshape(-1), np.array([langs.index(x) for x in told.dictionary.to_pylist()])[told.indices.to_numpy()]), rows.column("n").to_numpy())
    sizes = rows.column("size").to_numpy()[first]
    out = np.zeros(table.shape, np.float32)
    for size in np.unique(sizes):
        own = sizes == size
        out[own] = np.log((table[own] + 0.1) / (table[own].sum(axis=0) + 0.1 * own.sum()))
    return keys, out


def _hashes(strings: list[str]) -> np.ndarray:
    """The 64-bit hashes that Spark's xxhash64 gives."""
    return np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in strings], np.uint64)


def _grams(word: str, size: int) -> list[str]:
    if size == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def _placed(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted stand among sorted keys, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Predictor:
    """What a Python worker holds: the model, and a table with the rows of the last words met, ``most`` at most."""

    def __init__(self, model: dict, most: int = 20_000):
        self.langs, self.words, self.grams, self.most = model["langs"], model["words"], model["grams"], most
        self.rows: dict[str, int] = {}
        # the last column tells whether the model knows anything of the word
        self.table = np.zeros((most, len(self.langs) + 1), np.float32)

    def _learn(self, words: list[str]) -> None:
        """Rows for words that have none: known words', else the mean of the longest n-grams of which the model knows one."""
        keys, logs = self.words
        at, known = _placed(keys, _hashes(words))
        made = np.zeros((len(words), self.table.shape[1]), np.float32)
        made[known, :-1], made[known, -1] = logs[at[known]], 1
        left, (keys, logs) = np.flatnonzero(~known), self.grams
        for size in range(LONGEST, 0, -1):
            if not len(left):
                break
            grams = [_grams(words[k], size) for k in left]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            at, known = _placed(keys, _hashes([g for own in grams for g in own]))
            times = np.bincount(owner[known], minlength=len(left))
            sums = np.zeros((len(left), len(self.langs)))
            np.add.at(sums, owner[known], logs[at[known]])
            some = times > 0
            made[left[some], :-1], made[left[some], -1] = sums[some] / times[some, None], 1
            left = left[~some]
        begin = len(self.rows)
        self.table[begin : begin + len(words)] = made
        self.rows.update(zip(words, range(begin, begin + len(words)), strict=True))

    def _rows(self, words: list[str]) -> list[int]:
        """The table rows of at most ``most`` words."""
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > self.most:
            self.rows.clear()
            new = words
        if new:
            self._learn(new)
        return [self.rows[w] for w in words]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, its share of the likelihood, the share of words that the model knows something of)."""
        counts = word_counts(text)
        if not counts or not self.langs:
            return UNKNOWN, 0.0, 0.0
        words, times = list(counts), np.array(list(counts.values()), dtype=np.float64)
        total = np.zeros(len(self.langs) + 1)
        for a in range(0, len(words), self.most):
            total += times[a : a + self.most] @ self.table[self._rows(words[a : a + self.most])]
        likely, known = total[:-1], total[-1] / times.sum()
        share = np.exp(likely - likely.max())
        best = int(likely.argmax())
        return self.langs[best], float(share[best] / share.sum()), float(known)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score, known for each row, by whole texts.

    Null texts and texts without a letter are ``und`` with score 0. Equal likelihoods go to the first language by name.
    known is the share of words of which the model knows at least a letter. Repeated rows each get their row, columns
    beside these two are ignored, an empty table gives an empty result.
    """
    told = shared(docs.sparkSession, model)  # words and n-grams of the bounded sample

    def run(batches):
        predictor = Predictor(told.value)
        for batch in batches:
            made = [predictor(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "lang_pred": pa.array([m[0] for m in made], pa.string()), "score": pa.array([m[1] for m in made], pa.float64()), "known": pa.array([m[2] for m in made], pa.float64())}
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double, known double")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of doc_id as text falls in the part that isn't learnt from; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def _taught(docs: DataFrame, fit_rows: int) -> dict:
    return fit(docs.where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "text", "lang"), fit_rows)


def language_id(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Learn from the rows with lang that aren't held out (crc32 mod 5 is not 0) and predict all of docs(doc_id, text, lang)."""
    return predict(docs, _taught(docs, fit_rows)).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, fit_rows: int = FIT_ROWS, least: float = 0.3, known: float = 0.5) -> DataFrame:
    """docs whose language is recognised: with a score of at least ``least`` and at least the share ``known`` of words the
    model knows something of, as no text of another script has. und documents go.

    Rows are judged one by one, whatever their doc_id: null ids, repeated ids and repeated rows each have their verdict.
    Columns stay those of docs; a null lang becomes the predicted one. Where docs has no row to learn from, nothing is recognised; an empty table stays empty.
    """
    rows = numbered(docs)
    told = predict(rows.select(F.col("_row").alias("doc_id"), "_doc.text"), _taught(docs, fit_rows)).withColumnRenamed("doc_id", "_row")
    told = stored(told, "told")
    kept = remaining(rows, told.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least) | (F.col("known") < known)))
    named = stored(told.join(rows.where("_doc.lang is null").select("_row"), "_row").select("_row", "lang_pred"), "named")
    filled = kept.join(few(named), "_row", "left").withColumn("_doc", F.col("_doc").withField("lang", F.coalesce("_doc.lang", "lang_pred")))
    return filled.select("_doc.*").select(*docs.columns)
