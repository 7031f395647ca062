"""Operator 9: quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model has order 4 over characters, trained on trusted text. A gram is a pair of longs: g holds its last three code
points at 21 bits each, b the one before, so that every character has a code of its own. Tasks count their grams in numpy and hand over one row for each kind of gram; Spark sums the shards, and the counts of lower
orders, contexts and discounts are grouped sums and equi-joins on the gram, so all statistics cover all trusted text
and no table leaves the cluster. Only the finished probabilities are read by the scoring tasks: by broadcast while they
have at most ``most_grams`` rows, else by joining each document's own gram counts with them, shard by shard.

Documents are dealt into ``FOLDS`` by a hash of their id, and each is judged by a model that has learnt from the trusted
documents of the other folds only, so trusted documents count like any others. A document's figure is its perplexity.
Its threshold is the quantile over the trusted documents of its language of at least ``SHORT`` characters, times
exp(``spread`` / sqrt(characters)): the mean of a few characters scatters so much that a short clean text would often
exceed what holds for long ones, and short ones among the trusted would raise the level of long ones by that scatter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm.work import few, map_arrow, numbered, remaining, shared, stored

ORDER, BITS = 4, 21
CODE = (1 << BITS) - 1
MOST_GRAMS = 4_000_000
QUANTILE, SLACK, SPREAD, FOLDS, SHORT = 0.99, 1.0, 4.0, 3, 400
#: Steps of a perplexity from one to e: quantiles are counted on them, so they don't depend on the order of rows, and are right to a 5,000th.
STEPS = 5_000
PAD = 2


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts -> (b, g) of their kinds of grams, which kind each character's gram is, and where each text's grams begin.

    Contexts start with pads.
    """
    pad = chr(PAD) * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    own = np.arange(at[-1]) + np.repeat((np.arange(len(texts)) + 1) * (ORDER - 1), lengths)
    present = np.zeros(CODE + 1, bool)
    present[codes] = True
    kinds = np.flatnonzero(present)
    if len(kinds) <= 1 << 16:  # numbered anew, the codes of a gram fit into one value
        number = np.zeros(CODE + 1, np.uint64)
        number[kinds] = np.arange(len(kinds), dtype=np.uint64)
        few, packed = number[codes], np.zeros(len(own), np.uint64)
        for j in range(ORDER):
            packed |= few[own - j] << np.uint64(16 * j)
        seen, which = np.unique(packed, return_inverse=True)
        found = [kinds[((seen >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64)] for j in range(ORDER)]
    else:
        rows, which = np.unique(np.stack([codes[own - j] for j in range(ORDER)], axis=1), axis=0, return_inverse=True)
        found = [rows[:, j].astype(np.int64) for j in range(ORDER)]
    return found[3], found[0] | found[1] << BITS | found[2] << (2 * BITS), which.reshape(-1), at


def _runs(column, most: int = 250_000):
    run, begin, total = [], 0, 0
    for i, v in enumerate(column):
        text = v.as_py() or ""
        if run and total + len(text) > most:
            yield begin, run
            run, begin, total = [], i, 0
        run.append(text)
        total += len(text)
    if run:
        yield begin, run


def gram_counts(texts: DataFrame, flush: int = 1_000_000) -> DataFrame:
    """texts(text, [fold]) -> ([fold], b, g, c): how often each gram occurs. Each task sums its own before anything is shuffled."""
    by = ["fold"] if "fold" in texts.columns else []

    def count(batches):
        sums: dict[int, pa.Table] = {}
        for batch in batches:
            for f, at in _folds(batch.column(1)):
                for _, run in _runs(batch.column(0).take(pa.array(at))):
                    b, g, which, _ = grams_of(run)
                    own = pa.table({"b": b, "g": g, "c": np.bincount(which, minlength=len(b))})
                    if f in sums:
                        own = pa.concat_tables([sums[f], own]).group_by(["b", "g"], use_threads=False).aggregate([("c", "sum")]).rename_columns(["b", "g", "c"])
                    sums[f] = own
                    if len(own) > flush:
                        yield from told(f, sums.pop(f))
        for f, own in sums.items():
            yield from told(f, own)

    def told(f, table):
        table = table.append_column("fold", pa.array(np.full(len(table), f, np.int32))).select(["fold", "b", "g", "c"])
        return table.combine_chunks().to_batches()

    rows = texts.select("text", F.col("fold").cast("int") if by else F.lit(0).alias("fold"))
    return map_arrow(rows, count, "fold int, b long, g long, c long").groupBy(*by, "b", "g").agg(F.sum("c").alias("c"))


def _folds(column) -> list[tuple[int, np.ndarray]]:
    """Each fold of a column and the rows it has."""
    folds = column.to_numpy(zero_copy_only=False)
    return [(int(f), np.flatnonzero(folds == f)) for f in np.unique(folds)]


def _suffix(g: Column, k: int) -> Column:
    """The last k of at most three codes."""
    return g.bitwiseAND(F.lit((1 << (BITS * k)) - 1)) if k < ORDER - 1 else g


def _context(k: int, b: Column, g: Column) -> Column:
    """What stands before the last code of a gram of order k."""
    before = F.shiftrightunsigned(_suffix(g, k), BITS)
    return before.bitwiseOR(F.shiftleft(b, 2 * BITS)) if k == ORDER else before


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """counts(b, g, c, [m]) of order 4 -> for each order 1 to 4 the seen grams: (m, b, g, p, h, gamma); b is 0 below order 4.

    m is the number of a model, 0 where it isn't told: all models are built in one go. p is the interpolated probability of the gram's last code after its
    context h, gamma what h leaves to the lower order. Orders below 4 count continuations: the kinds of grams that end so.
    Discounts are the modified ones, from the counts of counts, and what all this leaves over is spread evenly over the
    known codes and one unknown.
    """
    counts = counts if "m" in counts.columns else counts.withColumn("m", F.lit(0))
    levels = {ORDER: counts.select("m", "b", "g", "c")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = stored(levels[k + 1].groupBy("m", F.lit(0).cast("long").alias("b"), _suffix(F.col("g"), k).alias("g")).agg(F.count("*").alias("c")), f"kn{k}")
    out: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        n = levels[k].groupBy("m").agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in range(1, 5)], F.count("*").alias("kinds")).collect()  # a row for each model
        cut, kinds = F.lit(0.5), F.lit(1)
        for own in n:
            d = discounts([own[f"n{i}"] for i in range(1, 5)])
            here = F.col("m") == own["m"]
            cut = F.when(here, F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])).otherwise(cut)
            kinds = F.when(here, own["kinds"]).otherwise(kinds)
        own = levels[k].select("m", "b", "g", "c", _context(k, F.col("b"), F.col("g")).alias("h"), cut.alias("d"))
        totals = own.groupBy("m", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
        own = own.join(totals, ["m", "h"]).select("m", "b", "g", "h", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), (F.col("left") / F.col("total")).alias("gamma"))
        if k == 1:
            p = own.select("m", "b", "g", "h", "gamma", (F.col("own") + F.col("gamma") / (kinds + 1)).alias("p"))
        else:
            low = out[-1].select("m", F.col("g").alias("s"), F.col("p").alias("low"))
            p = own.withColumn("s", _suffix(F.col("g"), k - 1)).join(low, ["m", "s"]).select("m", "b", "g", "h", "gamma", (F.col("own") + F.col("gamma") * F.col("low")).alias("p"))
        out.append(stored(p.select("m", "b", "g", "p", "h", "gamma"), f"p{k}"))
    return out


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from how many grams occur once to four times."""
    if min(n[:2]) == 0:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 for i in (1, 2, 3)]
    return [min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), raw, strict=True)]


class Scorer:
    """Probabilities of any gram from the seen ones: for each order sorted contexts, and sorted (context, code) pairs."""

    def __init__(self, tables: list[tuple[np.ndarray, ...]]):
        self.contexts, self.grams = [], []
        for g, p, h, gamma in tables:
            kinds, first, where = np.unique(h, return_index=True, return_inverse=True)
            keys = where.reshape(-1) << BITS | (g & CODE)
            order = np.argsort(keys)
            self.contexts.append((kinds, gamma[first]))
            self.grams.append((keys[order], p[order]))
        left = self.contexts[0][1]
        self.unknown = float(left[0] / (len(self.grams[0][0]) + 1)) if len(left) else 1.0

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where x stands among sorted keys, and whether it does."""
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        k = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return k, keys[k] == x

    def log_p(self, b: np.ndarray, g: np.ndarray) -> np.ndarray:
        p = np.full(len(g), self.unknown)
        for k in range(1, ORDER + 1):
            part = g & np.int64((1 << (BITS * k)) - 1) if k < ORDER - 1 else g
            h = part >> BITS | b << (2 * BITS) if k == ORDER else part >> BITS
            (kinds, gamma), (keys, values) = self.contexts[k - 1], self.grams[k - 1]
            at, known = self._find(kinds, h)
            place, seen = self._find(keys, at << BITS | (g & CODE))
            if k > 1 and len(kinds):
                p = np.where(known, gamma[at] * p, p)
            if len(keys):
                p = np.where(known & seen, values[place], p)
        return np.log(p)


def perplexities(docs: DataFrame, model: list[DataFrame], most_grams: int = MOST_GRAMS) -> DataFrame:
    """docs(doc_id, text, ...) -> its columns but text, n_codes (characters) and perplexity (null for null or empty text)."""
    return _by_folds(docs.withColumn("fold", F.lit(0)), model, 1, most_grams).drop("fold")


def _by_folds(docs: DataFrame, model: list[DataFrame], folds: int, most_grams: int) -> DataFrame:
    """perplexities() of docs(fold, ...), each by the model that has its fold's number."""
    docs = docs.withColumn("n_codes", F.coalesce(F.length("text"), F.lit(0)))
    others = [c for c in docs.columns if c != "text"]
    if sum(m.count() for m in model) > most_grams:
        return reduce(DataFrame.unionByName, [_by_joins(docs.where(F.col("fold") == f), [m.where(F.col("m") == f) for m in model]) for f in range(folds)])
    tables: list[list[tuple]] = [[] for _ in range(folds)]
    for m in model:
        rows = m.select("m", "g", "p", "h", "gamma").toArrow()  # together at most most_grams rows
        number, *columns = (rows.column(c).to_numpy() for c in range(5))
        for f in range(folds):
            tables[f].append(tuple(c[number == f] for c in columns))
    told = shared(docs.sparkSession, [Scorer(own) for own in tables])
    del tables

    def score(batches):
        for batch in batches:
            out = np.full(batch.num_rows, np.nan)
            for f, own in _folds(batch.column(1)):
                scorer = told.value[f]
                for begin, run in _runs(batch.column(0).take(pa.array(own))):
                    b, g, which, at = grams_of(run)
                    logs = np.concatenate([[0.0], np.cumsum(scorer.log_p(b, g)[which])])
                    n = np.diff(at)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        out[own[begin : begin + len(run)]] = np.exp(-(logs[at[1:]] - logs[at[:-1]]) / n)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.float64(), mask=np.isnan(out))], names=[*named, "perplexity"])

    named = ["fold", *[c for c in others if c != "fold"]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*named).schema)
    return map_arrow(docs.select("text", *named), score, f"{schema}, perplexity double").select(*others, "perplexity")


def _by_joins(docs: DataFrame, model: list[DataFrame]) -> DataFrame:
    """The same without a broadcast: each document's gram counts meet the tables in joins on the gram.

    Grams are summed within each document first. A gram that all documents share meets a single row of the model, and
    the join's skew handling splits the other side.
    """
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    others = [c for c in docs.columns if c not in ("text", "_row")]

    def own(batches):
        for batch in batches:
            for row, v in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                b, g, which, _ = grams_of([v.as_py() or ""])
                yield pa.RecordBatch.from_pydict({"_row": pa.array(np.full(len(b), row)), "b": pa.array(b), "g": pa.array(g), "n": pa.array(np.bincount(which, minlength=len(b)))})

    base = stored(docs.select("_row", *others, "text"), "docs")
    counts = map_arrow(base.select("_row", "text"), own, "_row long, b long, g long, n long")
    kinds = stored(counts.select("b", "g").distinct(), "kinds")
    first = model[0].agg((F.first("gamma") / (F.count("*") + 1)).alias("u")).first()["u"] or 1.0
    p = kinds.withColumn("p", F.lit(first))
    for k in range(1, ORDER + 1):
        seen = model[k - 1].select(F.col("b").alias("b_part"), F.col("g").alias("part"), F.col("p").alias("seen"))
        left = model[k - 1].groupBy("h").agg(F.first("gamma").alias("gamma"))
        p = p.withColumn("part", _suffix(F.col("g"), k)).withColumn("b_part", F.col("b") if k == ORDER else F.lit(0).cast("long")).withColumn("h", _context(k, F.col("b"), F.col("g")))
        p = p.join(seen, ["part", "b_part"], "left")
        p = p.join(left, "h", "left") if k > 1 else p.withColumn("gamma", F.lit(1.0))
        p = stored(p.select("b", "g", F.coalesce("seen", F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p")), "p")
    sums = counts.join(p, ["b", "g"]).groupBy("_row").agg((-F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("bits"))
    return base.join(sums, "_row", "left").select(*others, F.exp("bits").alias("perplexity"))


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, spread: float = SPREAD, most_grams: int = MOST_GRAMS) -> DataFrame:
    """docs(doc_id, text, lang), trusted(doc_id) -> doc_id, lang, perplexity, threshold, accepted for each row.

    Each row is scored by the model of the trusted documents outside its fold (crc32 of doc_id as text mod FOLDS; null ids
    are in fold 0), or by one model of all where trusted texts are in a single fold. threshold is slack times
    exp(spread / sqrt(characters)) times the quantile over the trusted documents of the same lang, or over all trusted
    ones where a lang (or null) has none; of these, over those of at least SHORT characters, if there are any. Null and empty texts have null perplexity and are not accepted. Without any
    trusted text there is nothing to judge by: thresholds are null and all other documents are accepted. Repeated rows
    each get their row; extra columns are ignored.
    """
    judged = _judged(docs.select("doc_id", "text", "lang"), trusted, quantile, slack, spread, most_grams)
    return judged.select("doc_id", "lang", "perplexity", "threshold", "accepted")


def _judged(docs: DataFrame, trusted: DataFrame, quantile: float, slack: float, spread: float, most_grams: int) -> DataFrame:
    """docs with perplexity, threshold and accepted; what stands in its columns beside doc_id, text and lang goes along."""
    ids = few(stored(trusted.select(F.col("doc_id").alias("_trusted")).where("_trusted is not null").distinct(), "trusted"))
    marked = docs.join(ids, F.col("doc_id") == F.col("_trusted"), "left").withColumn("_trusted", F.col("_trusted").isNotNull())
    marked = marked.withColumn("fold", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int"))
    counts = stored(gram_counts(marked.where("_trusted and length(text) > 0").select("text", "fold")), "counts")
    folds = FOLDS if counts.select("fold").distinct().count() > 1 else 1
    learnt = _left_out(counts) if folds > 1 else counts.groupBy("b", "g").agg(F.sum("c").alias("c"))
    model = kneser_ney(stored(learnt, "counts"))
    scored = stored(_by_folds(marked if folds > 1 else marked.withColumn("fold", F.lit(0)), model, folds, most_grams), "scored")
    good = scored.where("_trusted and perplexity is not null")
    step = F.floor(F.log("perplexity") * STEPS).cast("long")
    steps = stored(good.groupBy("lang", (F.col("n_codes") >= SHORT).alias("long"), step.alias("step")).agg(F.count("*").alias("n")), "steps")
    each = _levels(steps, "lang", quantile).select("lang", "own")
    of_all = (_levels(steps.withColumn("lang", F.lit(0)), "lang", quantile).first() or [None, None])[1]
    level = F.coalesce("own", F.lit(of_all).cast("double")) * slack * F.exp(spread / F.sqrt(F.greatest("n_codes", F.lit(1))))
    return (
        scored.join(F.broadcast(each.withColumnRenamed("lang", "_lang")), F.col("lang") == F.col("_lang"), "left")  # a row for each language
        .withColumn("threshold", level)
        .withColumn("accepted", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    )


def _left_out(counts: DataFrame) -> DataFrame:
    """counts(fold, b, g, c) -> (m, b, g, c): the counts outside fold m, for each m. The rows are summed once."""
    own = [F.sum(F.when(F.col("fold") == f, F.col("c")).otherwise(0)).alias(f"_{f}") for f in range(FOLDS)]
    summed = counts.groupBy("b", "g").agg(F.sum("c").alias("all"), *own)
    each = F.array(*[F.struct(F.lit(f).alias("m"), (F.col("all") - F.col(f"_{f}")).alias("c")) for f in range(FOLDS)])
    return summed.select("b", "g", F.explode(each).alias("_e")).select("_e.m", "b", "g", "_e.c").where("c > 0")


def _levels(steps: DataFrame, by: str, quantile: float) -> DataFrame:
    """steps(by, long, step, n) -> (by, own): the end of the first step up to which lies this share of the rows, of the long ones if there are any."""
    found = None
    for name, rows in (("of_long", steps.where("long")), ("of_any", steps)):
        each = rows.groupBy(by, "step").agg(F.sum("n").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy(by).orderBy("step"))
        enough = each.withColumn("_upto", so_far).withColumn("_all", F.sum("n").over(Window.partitionBy(by))).where(F.col("_upto") >= quantile * F.col("_all"))
        own = enough.groupBy(by).agg(F.exp((F.min("step") + 1) / STEPS).alias(name))
        found = own if found is None else own.join(found, by, "left")
    return found.select(by, F.coalesce("of_long", "of_any").alias("own"))


def accepted(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, spread: float = SPREAD, most_grams: int = MOST_GRAMS) -> DataFrame:
    """The rows of docs that quality() accepts, with the columns of docs, whatever their names.

    Rows are judged one by one: null ids, repeated ids and repeated rows each have their verdict. Null and empty texts go;
    without trusted texts all others stay.
    """
    rows = numbered(docs)
    judged = _judged(rows.select("_row", "_doc.doc_id", "_doc.text", "_doc.lang"), trusted, quantile, slack, spread, most_grams)
    return remaining(rows, judged.where("not accepted")).select("_doc.*")


__all__ = ["accepted", "discounts", "gram_counts", "kneser_ney", "perplexities", "quality"]
