"""All links inside candidate groups, counted exactly without writing out pairs.

A group of at most ``most`` members is one task's matrix. A larger one is dealt into blocks of about that size, and
each pair of blocks is a matrix of its own, so no task ever holds more than two blocks, however large a group is.
A matrix gives, for each member, its number of links and the smallest id it is tied to inside the matrix: that is
enough to sum the links and to join up the groups, and is linear in the members.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.graph import components
from attestra.llm.work import map_arrow

MOST = 1024


def counted(grouped: DataFrame, most: int = MOST) -> DataFrame:
    """grouped(.., grp) with blocks: how many blocks of about most members its group has."""
    sizes = grouped.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("blocks"))
    return grouped.join(sizes, "grp")


def dealt(members: DataFrame) -> DataFrame:
    """members(grp, id, blocks, ...) -> the members once for each matrix (grp, bi, bj) they take part in; own = their block."""
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks").cast("long")).cast("int")
    return (
        members.withColumn("own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("bi", F.least("own", "_other"))
        .withColumn("bj", F.greatest("own", "_other"))
        .drop("_other", "blocks")
    )


def links(rows: DataFrame, payload: str, linked: Callable[[list], np.ndarray], partitions: int) -> DataFrame:
    """rows(grp, bi, bj, own, id, copies, payload) -> (id, n_links, tied): one row for each member of each matrix.

    linked(payloads) gives the square matrix of links as booleans. n_links sums the copies of the linked members;
    in a matrix of two blocks only links between the blocks count, as those inside have a matrix of their own. Repeated
    rows of an id are one member.
    """

    def count(batches):
        for own, ids, copies, values, same in _groups(batches):
            mat = linked(values)
            np.fill_diagonal(mat, False)
            if not same:
                mat &= own[:, None] != own[None, :]
            tied = _smallest(mat, ids)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "n_links": pa.array(mat @ copies), "tied": pa.array(tied)})

    dealt_rows = rows.select("grp", "bi", "bj", "own", "id", "copies", F.col(payload).alias("value"))
    sorted_rows = dealt_rows.repartition(partitions, "grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "id")
    return map_arrow(sorted_rows, count, "id long, n_links long, tied long")


def _groups(batches):
    """The rows of one (grp, bi, bj) after the other, across batches."""
    key, own, ids, copies, values = None, [], [], [], []
    for batch in batches:
        g, i, j, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4))
        again = (m[1:] == m[:-1]) & (g[1:] == g[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1])
        before = key is not None and len(m) and (g[0], i[0], j[0]) == key and ids[-1][-1] == m[0]
        if again.any() or before:
            batch = batch.filter(pa.array(np.r_[not before, ~again]))
            g, i, j = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1), len(g)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            new = (g[a], i[a], j[a])
            if new != key:
                if ids:
                    yield np.concatenate(own), np.concatenate(ids), np.concatenate(copies), values, key[1] == key[2]
                key, own, ids, copies, values = new, [], [], [], []
            own.append(batch.column(3)[a:b].to_numpy(zero_copy_only=False))
            ids.append(batch.column(4)[a:b].to_numpy(zero_copy_only=False))
            copies.append(batch.column(5)[a:b].to_numpy(zero_copy_only=False))
            values += [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column(6)[a:b]]
    if ids:
        yield np.concatenate(own), np.concatenate(ids), np.concatenate(copies), values, key[1] == key[2]


def _smallest(mat: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each member the smallest id of its component in the matrix."""
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[:] = -1
    for first in order:
        if label[first] >= 0:
            continue
        front = np.zeros(len(ids), bool)
        front[first] = True
        seen = front.copy()
        while front.any():
            front = mat[front].any(axis=0) & ~seen
            seen |= front
        label[seen] = ids[first]
    return label


def summed(found: DataFrame) -> DataFrame:
    """What links() found -> (id, n_links, component) for each member."""
    total = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("tied").alias("b")))
    return total.join(joined, "id", "left").select("id", "n_links", F.coalesce("component", "id").alias("component"))
