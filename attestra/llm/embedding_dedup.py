"""Operator 2: near-duplicate embeddings by NN-descent.

1. Equal unit vectors are one class, whose smallest vec_id stands for it; copies cost one row each.
2. A neighbour graph starts from the leaves of random-projection trees and is refined by local joins: around each
   centre its neighbours and those that have it as a neighbour meet, and pairs that improve a list go into it. Rounds go on
   until hardly any entry at the threshold is new.
3. Edges at the threshold join classes into components. Lists that are full of such edges are saturated: vectors that
   have one are searched again for neighbours outside their component, which may join components, until a search finds
   none. Inside a component every pair is compared in double precision (attestra.llm.blocks), in blocks if it is large.
4. An audit compares the links of stated query vectors, all whose id is divisible by ``audit_every``, with brute force over
   all vectors, in blocks; while the recall is under target, further trees and rounds follow, and if it is still after the
   last, an error.

Leaves and hubs of any size are dealt into parts of bounded size; no list of partners is cut but the K nearest of the
descent, for which step 3 makes up.
"""

from __future__ import annotations

import hashlib
import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm import blocks
from attestra.llm.graph import components
from attestra.llm.work import few, forget, map_arrow, shared, stored

THRESHOLD, NEIGHBOURS, TREES, LEAF, PART, COMMON = 0.9, 10, 8, 128, 256, 16
AUDIT_EVERY, AUDIT_BYTES, RECALL, MOST_ROUNDS = 100, 32 * 2**20, 0.995, 4
#: The share of new entries at the threshold under which a round of refinement is the last, and the scatter of 32-bit cosines.
CHANGED, SCATTER = 0.002, 1e-4

_log = logging.getLogger(__name__)


def units(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, digest, unit, dims): the vector over its length as 64-bit floats.

    digest and unit are null where the vector is null, empty, zero or holds a null or non-finite component.
    """

    def norm(batches):
        for batch in batches:
            digest, unit, dims = [], [], []
            for v in batch.column(1):
                own = None
                if v.is_valid and len(v.values):
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all() and np.abs(x).max() > 0:
                        x = x / np.abs(x).max()  # so that squares neither overflow nor vanish
                        own = (x / math.sqrt(float(x @ x)) + 0.0).tobytes()
                digest.append(hashlib.md5(own).digest() if own else None)
                unit.append(own)
                dims.append(len(own) // 8 if own else None)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "digest": pa.array(digest, pa.binary()), "unit": pa.array(unit, pa.binary()), "dims": pa.array(dims, pa.int32())})

    return map_arrow(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), norm, "vec_id long, digest binary, unit binary, dims int")


def _leaves(points: DataFrame, trees: int, bits: int, seed: int) -> DataFrame:
    """points(id, dims, unit) -> (grp, id, unit): each point once for each tree, by the signs of random projections."""

    def fall(batches):
        planes: dict[int, np.ndarray] = {}
        weights = (np.int64(1) << np.arange(bits, dtype=np.int64))
        for batch in batches:
            for dims in set(batch.column(1).to_pylist()):
                at = np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False) == dims)
                part = batch.take(pa.array(at))
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), np.float64).reshape(-1, dims)
                if dims not in planes:
                    planes[dims] = np.random.default_rng([seed, dims]).standard_normal((dims, trees * bits))
                signs = (x @ planes[dims] > 0).reshape(len(x), trees, bits)
                leaf = signs @ weights
                small = [v.astype(np.float32).tobytes() for v in x]
                for t in range(trees):
                    yield pa.RecordBatch.from_pydict({"dims": part.column(1), "tree": pa.array(np.full(len(x), t, np.int32)), "leaf": pa.array(leaf[:, t]), "id": part.column(0), "v": pa.array(small, pa.binary())})

    fallen = map_arrow(points.select("id", "dims", "unit"), fall, "dims int, tree int, leaf long, id long, v binary")
    return fallen.select(F.xxhash64("dims", "tree", "leaf").alias("grp"), "id", "v")


def _parted(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """rows(grp, id, ...) with part: groups of more than most rows are dealt at random into parts of about most.

    Each group is dealt by its own hash, so rows that share several groups don't miss each other in all of them alike, and
    about COMMON rows of a dealt group are in each of its parts, so a tight group keeps a tie between its parts.
    """
    large = few(stored(rows.groupBy("grp").agg(F.count("*").alias("_n")).where(F.col("_n") > most), "large"))
    parts = F.coalesce(F.ceil(F.col("_n") / F.lit(most)).cast("long"), F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("id", "grp", F.lit(seed)), parts)
    common = (parts > 1) & (F.pmod(F.xxhash64("grp", "id", F.lit(seed)), F.ceil(F.col("_n") / F.lit(COMMON)).cast("long")) == 0)
    part = F.when(common, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(own))
    return rows.join(large, "grp", "left").withColumn("part", F.explode(part)).drop("_n")


def _local_joins(rows: DataFrame, partitions: int, keep: int) -> DataFrame:
    """rows(grp, part, id, v, worst, own) -> (id, nbr, sim): for each member of a part the best keep others of another own that beat its worst."""

    def meet(batches):
        for ids, vectors, worst, own in _parts(batches):
            if len(ids) < 2:
                continue
            out = []
            for dims in set(map(len, vectors)):
                at = np.flatnonzero([len(v) == dims for v in vectors])
                x = np.frombuffer(b"".join(vectors[k] for k in at), np.float32).reshape(len(at), -1)
                sims = x @ x.T
                sims[own[at][:, None] == own[at][None, :]] = -2
                k = min(keep, len(at) - 1)
                if k < 1:
                    continue
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(sims, best, axis=1)
                good = value > worst[at][:, None]
                out.append((np.repeat(ids[at], k)[good.ravel()], ids[at][best][good], value[good]))
            if out:
                a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"id": pa.array(a), "nbr": pa.array(b), "sim": pa.array(s.astype(np.float64).round(6))})

    dealt = rows.select("grp", "part", "id", "v", "worst", "own").repartition(partitions, "grp", "part").sortWithinPartitions("grp", "part")
    return map_arrow(dealt, meet, "id long, nbr long, sim double")


def _parts(batches):
    key, ids, vectors, worst, own = None, [], [], [], []
    for batch in batches:
        g, p = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1])) + 1), len(g)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if (g[a], p[a]) != key:
                if ids:
                    yield np.concatenate(ids), vectors, np.concatenate(worst), np.concatenate(own)
                key, ids, vectors, worst, own = (g[a], p[a]), [], [], [], []
            ids.append(batch.column(2)[a:b].to_numpy(zero_copy_only=False))
            vectors += batch.column(3)[a:b].to_pylist()
            worst.append(batch.column(4)[a:b].to_numpy(zero_copy_only=False))
            own.append(batch.column(5)[a:b].to_numpy(zero_copy_only=False))
    if ids:
        yield np.concatenate(ids), vectors, np.concatenate(worst), np.concatenate(own)


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """edges(id, nbr, sim) -> the k nearest of each id; each task prunes its own before the shuffle, and a hub's are sorted, not gathered."""
    rank = F.dense_rank().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr"))
    return edges.withColumn("_rank", rank).where(F.col("_rank") <= k).groupBy("id", "nbr").agg(F.max("sim").alias("sim"))


def _refined(graph: DataFrame, points: DataFrame, k: int, part: int, seed: int, partitions: int, inside: DataFrame | None = None) -> DataFrame:
    """One round: neighbours of a centre, in either direction, meet each other and the centre. inside: edges that only make rows meet."""
    near = graph if inside is None else graph.unionByName(inside)
    both = near.select(F.col("id").alias("grp"), F.col("nbr").alias("id")).unionByName(near.select(F.col("nbr").alias("grp"), "id")).distinct()
    worst = graph.groupBy("id").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-1.0)).alias("worst"))
    small = points.join(worst, "id", "left").select("id", F.col("small").alias("v"), F.coalesce("worst", F.lit(-1.0)).alias("worst"), "own")
    rows = _parted(both, part, seed).join(small, "id")
    return _nearest(graph.unionByName(_local_joins(rows, partitions, k)), k)


def _descended(graph: DataFrame, points: DataFrame, near: float, k: int, seed: int, partitions: int) -> DataFrame:
    """Rounds of refinement until the share of entries from near on that are new is at most CHANGED."""
    while True:
        new = stored(_refined(graph, points, k, PART, seed, partitions), "graph")
        own = new.where(F.col("sim") >= near)
        added = own.join(graph.select("id", "nbr"), ["id", "nbr"], "left_anti").count()
        if added <= CHANGED * own.count():
            return new
        forget(graph)
        graph, seed = new, seed + 1


def _enlarged(graph: DataFrame, points: DataFrame, threshold: float, k: int, trees: int, seed: int, partitions: int) -> DataFrame:
    """(id, component) for ids with edges at the threshold: the graph's, and those that saturated lists leave out.

    If a link between two components is in no list, both of its ends have k better ones. Such ends look for neighbours
    outside their component, by trees and a local join, and what is found joins components, so each search but the last
    leaves fewer of them.
    """
    near = threshold - SCATTER
    ties = stored(graph.where(F.col("sim") >= near).select(F.col("id").alias("a"), F.col("nbr").alias("b")), "ties")
    joined = stored(components(ties), "groups")
    full = graph.groupBy("id").agg(F.count("*").alias("n"), F.min("sim").alias("least")).where((F.col("n") >= k) & (F.col("least") >= near))
    full = stored(points.join(full.select("id"), "id").select("id", "dims", "unit", "small"), "full")
    bits = max(1, math.ceil(math.log2(max(2, full.count()) / LEAF)))
    while True:
        own = stored(full.join(joined.select("id", F.col("component").alias("own")), "id"), "own")
        if own.select("own").distinct().limit(2).count() < 2:
            return joined
        seed += 1
        fallen = _parted(_leaves(own, trees, bits, seed), PART, seed).join(own.select("id", "own"), "id").withColumn("worst", F.lit(-1.0))
        outside = stored(_nearest(_local_joins(fallen, partitions, k), k), "outside")
        outside = _refined(outside, own, k, PART, -seed, partitions, inside=graph)
        found = stored(outside.where(F.col("sim") >= near).select(F.col("id").alias("a"), F.col("nbr").alias("b")), "ties")
        if found.isEmpty():
            return joined
        ties = ties.unionByName(found)
        joined = stored(components(ties), "groups")


def _cosine_links(threshold: float):
    def linked(values: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)
        return x @ x.T >= threshold

    return linked


def _audited(rows: DataFrame, points: DataFrame, judged: DataFrame, threshold: float, every: int, block_bytes: int = AUDIT_BYTES) -> float:
    """Recall of the links of all rows(vec_id, digest) whose id is divisible by every, against all vectors: the lower of
    the share of all links and the mean of each query's share. Queries are broadcast block by block.

    Where no id is divisible, classes are asked by hash, one in so many, or else all (of few). Without links it is 1.
    """
    asked = rows.where(F.col("digest").isNotNull() & (F.col("vec_id") % every == 0)).select("digest").distinct()
    asked = stored(points.join(asked, "digest", "left_semi").join(judged.select("id", "n_links"), "id", "left").select("id", "dims", "unit", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "asked")
    if asked.isEmpty():
        by_hash = F.pmod(F.xxhash64("id", F.lit("ask")), F.lit(every)) == 0
        some = points.where(by_hash) if not points.where(by_hash).isEmpty() else points
        asked = some.join(judged.select("id", "n_links"), "id", "left").select("id", "dims", "unit", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    parts = (asked.agg(F.sum(F.length("unit").cast("long"))).first()[0] or 0) // block_bytes + 1
    found = true = shares = linked = 0
    for part in range(parts):
        queries = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()  # about block_bytes
        for dims in sorted({q["dims"] for q in queries}):
            own = [q for q in queries if q["dims"] == dims]
            counts = _counted(points.where(F.col("dims") == dims), np.frombuffer(b"".join(bytes(q["unit"]) for q in own), np.float64).reshape(-1, dims), threshold)
            for q, n in zip(own, counts - np.array([q["copies"] for q in own]), strict=True):
                if n > 0:
                    found, true, shares, linked = found + min(q["n_links"], n), true + n, shares + min(1.0, q["n_links"] / n), linked + 1
    return float(min(found / true, shares / linked)) if linked else 1.0


def _counted(points: DataFrame, asked: np.ndarray, threshold: float) -> np.ndarray:
    """How many rows have at least that cosine with each of the asked vectors, by brute force."""
    told = shared(points.sparkSession, asked)

    def brute(batches):
        q = told.value
        total = np.zeros(len(q), np.int64)
        for batch in batches:
            copies = batch.column(1).to_numpy(zero_copy_only=False)
            for a in range(0, batch.num_rows, 1024):
                x = np.frombuffer(b"".join(batch.column(0).slice(a, 1024).to_pylist()), np.float64).reshape(-1, q.shape[1])
                for b in range(0, len(q), 4096):
                    total[b : b + 4096] += copies[a : a + 1024] @ (x @ q[b : b + 4096].T >= threshold)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"q": pa.array(at), "n": pa.array(total[at])})

    out = np.zeros(len(asked), np.int64)
    for r in map_arrow(points.select("unit", "copies"), brute, "q long, n long").groupBy("q").agg(F.sum("n").alias("n")).collect():
        out[r["q"]] = r["n"]
    return out


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, trees: int = TREES, audit_every: int = AUDIT_EVERY, recall: float = RECALL, most_rounds: int = MOST_ROUNDS
) -> tuple[DataFrame, float]:
    """vectors(vec_id, embedding, ...) -> ((vec_id, n_links, component_id, kept) for each row, audited recall).

    Two vectors are linked if their cosine is at least threshold. n_links counts the other rows linked directly, copies
    included, component_id is the smallest vec_id reachable over links. Null, empty and zero vectors and those with null
    or non-finite components are linked with nothing, and so are rows with null vec_id and vectors of different lengths.
    Repeated rows are copies of each other; other columns are ignored; an empty table gives an empty result. RuntimeError if
    the audited recall stays under the target. The audit costs the rows times the queries, so audit_every is to rise
    with very large tables.
    """
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(units(vectors).withColumn("digest", F.when(F.col("vec_id").isNotNull(), F.col("digest"))), "units")
    points = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first("dims").alias("dims"))
    points = stored(points.withColumn("small", _as_floats(F.col("unit"))), "points")
    n = points.count()
    bits = max(1, math.ceil(math.log2(max(2, n) / LEAF)))
    graph, judged, found = None, None, 0.0
    for r in range(most_rounds):
        fallen = _parted(_leaves(points, trees, bits, r), PART, r).withColumn("worst", F.lit(-1.0)).withColumn("own", F.col("id"))
        edges = _local_joins(fallen, partitions, neighbours)
        graph = stored(_nearest(edges if graph is None else graph.unionByName(edges), neighbours), "graph")
        graph = _descended(graph, points.withColumn("own", F.col("id")), threshold - SCATTER, neighbours, 100 * (most_rounds + r), partitions)
        joined = _enlarged(graph, points, threshold, neighbours, trees, 1000 * (r + 1), partitions)
        judged = stored(_components_of(joined, points, threshold, partitions), "components")
        found = _audited(rows, points, judged, threshold, audit_every)
        _log.info("round %d: audited recall %.4f", r, found)
        if found >= recall:
            break
    else:
        raise RuntimeError(f"audited recall is {found:.4f} after {most_rounds} rounds, under {recall}")
    own = points.select("digest", "id", "copies").join(judged, "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.select("vec_id", "digest").join(own, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), found


def _as_floats(unit: Column) -> Column:
    @F.pandas_udf("binary")
    def narrow(s):
        return s.map(lambda b: np.frombuffer(b, np.float64).astype(np.float32).tobytes())

    return narrow(unit)


def _components_of(joined: DataFrame, points: DataFrame, threshold: float, partitions: int) -> DataFrame:
    """(id, n_links, component): joined(id, component) are candidate components, inside which all pairs are compared."""
    grouped = blocks.counted(joined.select("id", F.col("component").alias("grp")))
    members = grouped.join(points.select("id", "copies", "unit"), "id")
    return blocks.summed(stored(blocks.links(blocks.dealt(members), "unit", _cosine_links(threshold), partitions), "links"))


__all__ = ["near_duplicates", "units"]
