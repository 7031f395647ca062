"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and an equi-join, so edges never leave Spark's tables, and a hub's edges are
salted. Every round is written to the shared folder, which keeps plans short and survives lost
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.work import forget, stored


#: Tasks that a hub's edges are dealt out to, the neighbours that make a hub, and half of the hubs there are at most.
SALTS, HUB, MOST_HUBS = 16, 1024, 250_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (id, component), component being the smallest id that is reachable, for ids with edges.

    Loops, repeated edges and either direction are allowed; nulls are ignored.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = stored(pairs, "edges")
    digest = _digest(now)
    for _ in range(max_rounds):
        new = stored(_small_star(_large_star(now, digest[0])), "edges")
        forget(now)
        now, before, digest = new, digest, _digest(new)
        if digest == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))


def _digest(e: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and the sum and exclusive or of their hashes."""
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest of u and its neighbours.

    The edges of a hub, which has more than a bound of neighbours, are dealt out by u and a salt of the other end, and its
    minimum is repeated for each salt, so they meet in SALTS tasks instead of one. As the bound grows with the edges there
    are at most 2 * MOST_HUBS hubs to broadcast.
    """
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    bound = max(HUB, edges // MOST_HUBS)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), (F.count("*") > bound).alias("hub"))
    hubs = F.broadcast(least.where("hub").select("u", "hub"))
    salted = both.where("v > u").join(hubs, "u", "left").withColumn("s", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hub")
    repeated = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.when(F.col("hub"), SALTS - 1).otherwise(0))))
    return salted.join(repeated, ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of these. A node has as many smaller neighbours as larger
    ones tied to it by the step before, which are few, so this side has no hubs."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
