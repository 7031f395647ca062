"""Operator 11: hard negatives by a search over buckets of norms.

1. Vectors become integers, floor(scale * x), and a row's score is its integer inner product with an anchor.
2. Candidates are sorted by norm, longest first, into buckets: files of a stored table of about ``BUCKET`` rows, each a
   range of norms. Rows of equal norm are told apart by their id, so any number of copies spreads over buckets.
3. Anchors are searched in blocks of bounded bytes, themselves cut by norm. A block goes through the buckets in waves of falling
   norm. No score exceeds the product of two norms (Cauchy-Schwarz), so a wave reads only buckets whose norms can still reach,
   for some anchor, the lower limit of one of its windows and the score of the k-th row found so far; inside a task each
   anchor is dropped for a chunk of rows by the same bound, with the task's own running k-th score.
4. A first pass finds each anchor's positives, a second one, for each positive, the negatives in its window of scores.

A task holds one block of anchors, one chunk of candidates and the best rows of each window, and hands on no more than
the best rows of each window; waves and blocks are cut by tables in the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm.work import forget, map_arrow, scratch, shared, stored
from attestra.session import new_path

SCALE, POSITIVES, NEGATIVES, EVERY = 256, 5, 5, 100
#: Percents of the positive's score that a negative's score lies between.
LOWER, UPPER = 80, 100
#: Rows of a bucket, bytes of a block of anchors, and scores that a task computes at once.
BUCKET, BLOCK_BYTES, SCORES = 65_536, 8 * 2**20, 2_000_000
#: The shares of the candidates, by falling norm, at which a wave ends; the last one ends with the shortest.
WAVES = (1 / 16, 1 / 4, 1.0)
#: Sums of products up to here are exact in doubles; what doubles lose in a norm.
EXACT, SLACK = 2.0**53, 1 + 1e-9
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (id, label, dims, norm, q): q holds floor(scale * x) as 64-bit integers.

    Rows with a null id, label or vector, or with a null or non-finite component, are left out. Of rows with the same id
    the one with the smallest label and q counts. Components beyond 64 bits are held at the limits.
    """

    def whole(batches):
        for batch in batches:
            keep, dims, norms, out = [], [], [], []
            for k, v in enumerate(batch.column(2)):
                x = v.values
                if x is None or x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    y = np.floor(x * float(scale))
                q = y.astype(np.int64) if not len(y) or np.abs(y).max() < 2.0**62 else np.array([max(LEAST, min(MOST, math.floor(a) * scale if abs(a) > 2.0**53 else int(b))) for a, b in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
                keep.append(k)
                dims.append(len(q))
                norms.append(math.sqrt(float((q.astype(np.float64) ** 2).sum())))
                out.append(q.tobytes())
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_pydict({"id": own.column(0), "label": own.column(1), "dims": pa.array(dims, pa.int32()), "norm": pa.array(norms, pa.float64()), "q": pa.array(out, pa.binary())})

    some = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    made = map_arrow(some.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")), whole, "id long, label long, dims int, norm double, q binary")
    return made.groupBy("id").agg(F.min(F.struct("label", "q", "dims", "norm")).alias("r")).select("id", "r.label", "r.dims", "r.norm", "r.q")


class Windows:
    """What is looked for around the anchors of a block: for each window its anchor, the limits of its scores, and whether
    labels are to be the same. ``kth`` is the score that the k-th row found so far has; less can't be among the k best."""

    def __init__(self, ids, labels, norms, vectors, anchor, lower, upper, same: bool, k: int, positive=None):
        self.ids, self.labels, self.norms, self.vectors = ids, labels, norms, vectors
        self.anchor, self.lower, self.upper, self.same, self.k = anchor, lower, upper, same, k
        self.positive = anchor if positive is None else positive
        self.kth = lower.copy()

    def needed(self) -> np.ndarray:
        """For each anchor the least score that counts in any of its windows; more than any score for one without windows."""
        need = np.full(len(self.ids), np.inf)
        np.minimum.at(need, self.anchor, np.maximum(self.lower, self.kth).astype(np.float64))
        return need

    def floor(self) -> float:
        """The norm under which no candidate can score enough for any anchor."""
        need, out = self.needed(), np.inf
        reach = need <= 0
        if reach.any():
            return 0.0
        long = self.norms > 0
        return float((need[long] / (self.norms[long] * SLACK)).min()) if long.any() else out

    def raised(self, scores: dict[int, int]) -> None:
        """Told the k-th score of windows that are full."""
        for w, s in scores.items():
            self.kth[w] = max(self.kth[w], s)


class Best:
    """The k best rows of each window that a task has seen: highest score first, ties by smaller id."""

    def __init__(self, windows: Windows):
        self.w, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.windows, self.kth = windows, windows.kth.copy()
        self.starts = np.searchsorted(windows.anchor, np.arange(len(windows.ids)))
        self.counts = np.bincount(windows.anchor, minlength=len(windows.ids))

    def needed(self) -> np.ndarray:
        need = np.full(len(self.windows.ids), np.inf)
        np.minimum.at(need, self.windows.anchor, np.maximum(self.windows.lower, self.kth).astype(np.float64))
        return need

    def see(self, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray, vectors: np.ndarray, longest: float) -> bool:
        """Score a chunk of candidates, the longest of which has that norm; False if no anchor could gain by it."""
        at = np.flatnonzero(self.windows.norms * (longest * SLACK) >= self.needed())
        if not len(at):
            return False
        width = max(1, SCORES // max(1, len(ids)))
        for a in range(0, len(at), width):
            self._score(ids, labels, norms, vectors, at[a : a + width])
        return True

    def _score(self, ids, labels, norms, vectors, at) -> None:
        x, own = self.windows, self.windows.vectors[at]
        need = self.needed()[at]
        if float(norms.max(initial=0)) * float(x.norms[at].max()) * SLACK < EXACT:
            scores = vectors.astype(np.float64) @ own.astype(np.float64).T
            good = scores >= need
        else:  # integers of any size, held at the limits of 64 bits
            wide = vectors.astype(object) @ own.astype(object).T if vectors.shape[1] else np.zeros((len(ids), len(at)), object)
            scores = np.clip(wide, LEAST, MOST).astype(np.int64)
            good = scores >= need
        same = labels[:, None] == x.labels[at][None, :]
        good &= (same & (ids[:, None] != x.ids[at][None, :])) if x.same else ~same
        r, c = np.nonzero(good)
        if not len(r):
            return
        s, i, c = scores[r, c].astype(np.int64), ids[r], at[c]
        found = [(self.w, self.score, self.id)]
        for j in range(int(self.counts[at].max(initial=0))):
            has = self.counts[c] > j
            w = self.starts[c[has]] + j
            fits = (s[has] >= np.maximum(x.lower[w], self.kth[w])) & (s[has] <= x.upper[w])
            found.append((w[fits], s[has][fits], i[has][fits]))
        w, s, i = (np.concatenate(part) for part in zip(*found, strict=True))
        order = np.lexsort((i, -s.astype(np.float64) if len(s) and np.abs(s.astype(np.float64)).max() < EXACT else ~s, w))
        w, s, i = w[order], s[order], i[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        top = rank < x.k
        self.w, self.score, self.id = w[top], s[top], i[top]
        last = rank[top] == x.k - 1
        self.kth[self.w[last]] = np.maximum(self.kth[self.w[last]], self.score[last])

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"w": pa.array(self.w), "id": pa.array(self.id), "score": pa.array(self.score)})


def _found(candidates: DataFrame, windows: Windows, dims: int) -> DataFrame:
    """candidates(id, label, norm, q) of one wave, in order -> (w, id, score): the best of each window in each task."""
    told = shared(candidates.sparkSession, windows)

    def search(batches):
        best = Best(told.value)
        for batch in batches:
            ids, labels, norms = (batch.column(k).to_numpy() for k in range(3))
            for a in range(0, batch.num_rows, 4096):
                part = slice(a, a + 4096)
                longest = float(norms[part].max(initial=0))
                if not (best.windows.norms * (longest * SLACK) >= best.needed()).any():
                    continue
                vectors = np.frombuffer(b"".join(batch.column(3).slice(a, 4096).to_pylist()), np.int64).reshape(-1, dims) if dims else np.zeros((len(ids[part]), 0), np.int64)
                best.see(ids[part], labels[part], norms[part], vectors, longest)
        yield best.rows()

    return map_arrow(candidates.select("id", "label", "norm", "q"), search, "w long, id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _passed(candidates: DataFrame, windows: Windows, dims: int, cuts: list[float]) -> DataFrame:
    """All waves -> (w, id, score, rank), the k best of each window."""
    best, above = None, None
    for cut in cuts:
        floor = windows.floor()
        wave = candidates.where(F.col("norm") >= max(cut, floor))
        if above is not None:
            wave = wave.where(F.col("norm") < above)
        found = _found(wave, windows, dims)
        own = stored(_top(found if best is None else found.unionByName(best.drop("rank")), windows.k), "best")
        if best is not None:
            forget(best)
        best, above = own, cut
        if floor >= cut:  # no shorter row can score enough
            break
        full = best.where(F.col("rank") == windows.k).select("w", "score").collect()  # a row for each window of the block
        windows.raised({r["w"]: r["score"] for r in full})
    return best


def _blocks(anchors: DataFrame, dims: int, block_bytes: int):
    """The anchors in blocks of about block_bytes, cut by norm and, where many have the same norm, by a hash of their id."""
    most = max(1, block_bytes // (8 * dims + 128))
    n = anchors.count()
    if n <= most:
        yield anchors
        return
    cuts = sorted(set(anchors.agg(F.percentile_approx("norm", [k / math.ceil(n / most) for k in range(1, math.ceil(n / most))], 10_000)).first()[0]))
    cell = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("norm")))
    sizes = anchors.groupBy(cell.alias("cell")).count().orderBy(F.desc("cell")).collect()  # a row for each block
    for row in sizes:
        parts = math.ceil(row["count"] / most)
        for part in range(parts):
            yield anchors.where((cell == row["cell"]) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part))


def _read(block: DataFrame, dims: int):
    rows = block.select("id", "label", "norm", "q").orderBy("id").toArrow()  # at most a block
    ids, labels, norms = (rows.column(k).to_numpy() for k in range(3))
    vectors = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.int64).reshape(-1, dims) if dims else np.zeros((len(ids), 0), np.int64)
    return ids, labels, norms, vectors


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER,
    scale: int = SCALE, bucket: int = BUCKET, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """vectors(vec_id, embedding, label, ...) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by every. Higher scores come first, ties by smaller id. An anchor's
    positives are its first ``positives`` other rows of the same label; for each the first ``negatives`` rows of another
    label with lower * positive_score <= 100 * negative_score <= upper * positive_score are returned, fewer if there are fewer.
    What quantised() leaves out takes no part, repeated ids are one row, vectors of different lengths never meet, scores
    beyond 64 bits are held at the limits, other columns are ignored, and an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    out = new_path(spark, "negatives")
    spark.createDataFrame([], SCHEMA).write.parquet(out)
    with scratch(spark):
        rows = stored(quantised(vectors, scale), "rows")
        for kind in sorted(r["dims"] for r in rows.select("dims").distinct().collect()):  # a row for each length there is
            own = rows.where(F.col("dims") == kind)
            n = own.count()
            parts = max(1, math.ceil(n / bucket))
            candidates = stored(own.repartitionByRange(parts, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id"), "buckets")
            marks = [1 - share for share in WAVES[:-1]]
            cuts = [*candidates.agg(F.percentile_approx("norm", marks, 10_000)).first()[0], 0.0]
            for block in _blocks(candidates.where(F.col("id") % every == 0), kind, block_bytes):
                with scratch(spark):
                    _mined(candidates, block, kind, cuts, positives, negatives, lower, upper).write.mode("append").parquet(out)
    return spark.read.schema(SCHEMA).parquet(out)


def _mined(candidates, block, dims, cuts, positives, negatives, lower, upper) -> DataFrame:
    """The rows of hard_negatives() for one block of anchors."""
    spark = candidates.sparkSession
    ids, labels, norms, vectors = _read(block, dims)
    n = len(ids)
    if not n:
        return spark.createDataFrame([], SCHEMA)
    first = Windows(ids, labels, norms, vectors, np.arange(n), np.full(n, LEAST), np.full(n, MOST), True, positives)
    near = sorted(tuple(r) for r in _passed(candidates, first, dims, cuts).select("w", "rank", "id", "score").collect())  # at most positives a window
    told = []
    for w, _, p, score in near:
        low, high = -((-lower * score) // 100), upper * score // 100
        if low <= high:
            told.append((w, max(LEAST, low), min(MOST, high), p, score))
    anchor, low, high, p, score = (np.array(c, np.int64) for c in zip(*told, strict=True)) if told else (np.zeros(0, np.int64) for _ in range(5))
    if not len(anchor):
        return spark.createDataFrame([], SCHEMA)
    second = Windows(ids, labels, norms, vectors, anchor, low, high, False, negatives)
    best = _passed(candidates, second, dims, cuts)
    named = pa.table({"w": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": p, "positive_score": score})
    meant = F.broadcast(spark.createDataFrame(named))  # a row for each window of the block
    return best.join(meant, "w").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


__all__ = ["hard_negatives", "quantised"]
