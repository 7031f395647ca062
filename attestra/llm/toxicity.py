"""Operator 8: toxicity by compression distance.

Two zstandard dictionaries are made, one from ordinary and one from toxic text. Not by the library's trainer, which picks what any
text repeats and so can't tell the two apart (README has the figures): their content is chosen here, by counts over the training
texts, and handed to the compressor as raw dictionaries. Every window of a text, a single word behind a fixed anchor, is compressed with
each of them; the pair of compressed lengths is the window's cell. Training counts how often toxic and ordinary texts fall into each cell,
which gives a cell its log ratio; a text's score is a logistic function, fitted on training texts, of how many windows
pass several thresholds of length difference and log ratio. So what decides is which chosen segments a word shares, measured by compression.

Dictionaries hold segments behind the anchor: the ordinary one the words of ordinary texts that most texts have, the toxic
one in addition words and word beginnings that significantly more toxic than ordinary texts have. Both are as the
trained content of a raw dictionary: segments that pay most lie last, where references are cheapest.

The fit reads a sample of about ``fit_rows`` labelled texts, whole, chosen by a hash of doc_id; all its counts are Spark
aggregations, and the driver gets the dictionaries' segments, a table of cells and one row of figures for each text. The
sizes of the dictionaries are parameters of the model: ``SEGMENT_BYTES`` of ordinary words, ``MOST_SEGMENTS`` toxic segments.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.language_id import held_out
from attestra.llm.work import map_arrow, sampled, shared, stored

FIT_ROWS, SEGMENT_BYTES, MOST_SEGMENTS, LEAST_Z, CUT = 12_000, 16_384, 2_000, 4.0, 0.3
ANCHOR = b"01234567"
WORD = re.compile(r"[^\W\d_]+")
WIDTH = 64  # lengths from here on share a cell


def windows(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def segments(word: str) -> set[str]:
    """The beginnings of a word between blanks, from 5 characters, and all of it."""
    marked = f" {word} "
    return {marked[:k] for k in range(5, len(marked) + 1)}


def _document_counts(texts: DataFrame) -> DataFrame:
    """texts(text, toxic) -> (segment, whole, toxic_docs, ordinary_docs): in how many texts each stands."""

    def count(batches):
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own: set[str] = set()
                for word in set(windows(text.as_py())):
                    own |= segments(word)
                seen[toxic].update(own)
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield _rows(seen)
                seen = {0: Counter(), 1: Counter()}
        yield _rows(seen)

    def _rows(seen):
        keys = [(k, t, n) for t, c in seen.items() for k, n in c.items()]
        return pa.RecordBatch.from_pydict({"segment": pa.array([k[0] for k in keys], pa.string()), "t": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array([k[2] for k in keys], pa.int64())})

    counts = map_arrow(texts.select("text", "toxic"), count, "segment string, t int, n long")
    return counts.groupBy("segment").agg(F.sum(F.when(F.col("t") == 1, F.col("n")).otherwise(0)).alias("toxic_docs"), F.sum(F.when(F.col("t") == 0, F.col("n")).otherwise(0)).alias("ordinary_docs"))


def chosen(rows: list[tuple[str, float]]) -> list[str]:
    """Segments by rising significance, without those whose longer forms are about as significant."""
    z = dict(rows)
    longer: dict[str, float] = {}
    for s, v in z.items():
        for k in range(5, len(s)):
            longer[s[:k]] = max(longer.get(s[:k], 0.0), v)
    return sorted((s for s, v in z.items() if longer.get(s, -1.0) < 0.95 * v), key=lambda s: (z[s], s))


def dictionaries(texts: DataFrame) -> tuple[bytes, bytes]:
    """texts(text, toxic 0/1) -> the contents of the ordinary and the toxic dictionary."""
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, ordinary = n.get(1, 0), n.get(0, 0)
    counts = stored(_document_counts(texts), "segments")
    share = (F.col("toxic_docs") + F.col("ordinary_docs")) / float(max(1, toxic + ordinary))
    spread = F.sqrt(share * (1 - share) * (1.0 / max(1, toxic) + 1.0 / max(1, ordinary)) + 1e-12)
    z = (F.col("toxic_docs") / float(max(1, toxic)) - F.col("ordinary_docs") / float(max(1, ordinary))) / spread
    telling = counts.where("toxic_docs >= 4").withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "segment").limit(MOST_SEGMENTS)
    own = chosen([(r["segment"], r["z"]) for r in telling.select("segment", "z").collect()])
    whole = F.col("segment").endswith(" ") & (F.length("segment") > 2)
    usual = counts.where(whole & (F.col("ordinary_docs") > 0)).orderBy(F.desc("ordinary_docs"), "segment").limit(SEGMENT_BYTES // (len(ANCHOR) + 8))
    starts = tuple(own)
    words = [r["segment"] for r in usual.select("segment").collect()]
    base = b"".join(ANCHOR + w.encode() for w in words[::-1] if not (starts and w.startswith(starts)))
    return base + ANCHOR, base + b"".join(ANCHOR + s.encode() for s in own) + ANCHOR


class Meter:
    """Compresses windows with both dictionaries; the cells of words met so far are kept, in a bounded cache."""

    def __init__(self, contents: tuple[bytes, bytes], most: int = 300_000):
        self.compressors, self.cache, self.most = [], {}, most
        for content in contents:
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTOPT,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            own.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=own, compression_params=how))

    def cell(self, word: str) -> int:
        found = self.cache.get(word)
        if found is None:
            window = ANCHOR + f" {word} ".encode()
            a, b = (min(len(c.compress(window)), WIDTH - 1) for c in self.compressors)
            if len(self.cache) >= self.most:
                self.cache.clear()
            found = self.cache[word] = a * WIDTH + b
        return found

    def cells(self, text: str | None) -> np.ndarray:
        words = windows(text)
        return np.array([self.cell(w) for w in words] or [WIDTH + 1])


def features(cells: np.ndarray, ratio: np.ndarray) -> list[float]:
    gain, n, v = cells // WIDTH - cells % WIDTH, len(cells), ratio[cells]
    top = np.sort(v)[::-1]
    return [
        *(np.log1p((gain >= k).sum()) for k in range(1, 8)),
        *((gain >= k).mean() * 10 for k in range(1, 8, 2)),
        *(float((gain >= k).sum() >= c) for k in (2, 3, 4) for c in (2, 3)),
        *(np.log1p((v >= k).sum()) for k in (0.7, 1.0, 1.4, 2.1, 3.0)),
        np.log(n), gain.max(), v.mean(), top[0], top[:3].sum(), np.log1p(np.maximum(v - 0.5, 0).sum()),
        np.log1p((v >= 1).sum()) - 0.5 * np.log(n), min(1.0, (v >= 1).mean() * 20),
    ]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> dict:
    """Ridge logistic regression by Newton steps on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    hold = np.r_[1e-6, np.full(len(w) - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (p - y) + hold * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "weights": w}


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> dict | None:
    """labelled(doc_id, text, toxic) -> model; None where one of the two classes has no text. Null texts count as empty."""
    rows = labelled.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    picked = rows.where(sampled(F.col("doc_id"), fit_rows / max(1, rows.count()), "toxic"))
    texts = stored(picked.select("text", F.col("toxic").cast("int").alias("toxic")), "labelled").repartition(2 * labelled.sparkSession.sparkContext.defaultParallelism)
    if texts.select("toxic").distinct().count() < 2:
        return None
    contents = dictionaries(texts)

    def tally(batches):
        meter = Meter(contents)
        for batch in batches:
            sums = np.zeros((2, WIDTH * WIDTH))
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                cells = meter.cells(text.as_py())
                sums[toxic] += np.bincount(cells, minlength=WIDTH * WIDTH) / len(cells)
            toxic, cell = np.nonzero(sums)
            yield pa.RecordBatch.from_pydict({"toxic": pa.array(toxic.astype(np.int32)), "cell": pa.array(cell.astype(np.int32)), "share": pa.array(sums[toxic, cell])})

    shares = np.zeros((2, WIDTH * WIDTH))
    tallied = map_arrow(texts, tally, "toxic int, cell int, share double").groupBy("toxic", "cell").agg(F.sum("share").alias("share"))
    for r in tallied.collect():  # at most two rows for each pair of lengths
        shares[r["toxic"], r["cell"]] = r["share"]
    shares /= shares.sum(axis=1, keepdims=True)
    ratio = np.log((shares[1] + 2e-4) / (shares[0] + 2e-4))

    def measure(batches):
        meter = Meter(contents)
        for batch in batches:
            made = [[float(v) for v in features(meter.cells(t.as_py()), ratio)] for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(1), "x": pa.array(made, pa.list_(pa.float64()))})

    rows = map_arrow(texts, measure, "toxic int, x array<double>").collect()  # about fit_rows
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows])
    order = np.lexsort([*x.T, y])
    return {"contents": contents, "ratio": ratio, **logistic(x[order], y[order])}


def scores(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, score for each row, by all windows of its whole text; without a model 0."""
    told = shared(docs.sparkSession, model)  # two dictionaries and two small tables

    def run(batches):
        m = told.value
        meter = Meter(m["contents"]) if m else None
        for batch in batches:
            out = [0.0] * batch.num_rows
            if m:
                x = np.array([features(meter.cells(t.as_py()), m["ratio"]) for t in batch.column(1)]).reshape(batch.num_rows, -1)
                z = np.c_[np.ones(len(x)), (x - m["mean"]) / m["scale"]] @ m["weights"] if len(x) else np.zeros(0)
                out = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(out, pa.float64())})

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, cut: float = CUT) -> DataFrame:
    """docs(doc_id, text) and labels(doc_id, toxic) -> doc_id, held_out, score, predicted for each row of docs.

    Learns only from rows whose crc32(doc_id as text) mod 4 is not 2. Null and empty texts have no windows and get the
    score of that. A doc_id labelled both 0 and 1 counts as 1. Repeated rows each get their row; other columns are
    ignored; an empty table gives an empty result.
    """
    taught = labels.where(~held_out(F.col("doc_id"), 4, 2) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taught = taught.where(sampled(F.col("doc_id"), 2 * fit_rows / max(1, taught.count()), "labels"))
    model = fit(docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id"), fit_rows)  # about twice fit_rows ids at most
    held = held_out(F.col("doc_id"), 4, 2)
    return scores(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
