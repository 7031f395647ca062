"""Claims, edges and sources derived from the order tables by fixed arithmetic, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import verification
from attestra.plans.registry import Tables

#: ev, pr and st by number.
EV = ["official_data", "independent_benchmark", "third_party_estimate", "qualitative_trend", "expert_opinion"]
PR = ["exact", "range", "qualitative"]
ST = ["official_report", "independent_test", "production_case", "survey", "vendor_benchmark", "analyst_forecast", "vendor_survey", "vendor_blog"]


def _pick(names: list[str], k) -> F.Column:
    return F.get(F.array(*map(F.lit, names)), k.cast("int"))


def sources(t: Tables) -> DataFrame:
    named = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("s_suppkey", (1 + F.col("s_suppkey") % 4).cast("int").alias("tier"), F.lower("n_name").alias("host"), "s_name", F.col("n_name").alias("direction"))


def claims(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        k.alias("cid"), F.col("o_orderpriority").alias("section"), _pick(EV, k % 5).alias("ev"), _pick(PR, (k + c) % 3).alias("pr"), _pick(ST, c % 8).alias("st"),
        (1 + k % 50).alias("num"), F.lit(True).alias("has_number"), F.concat(F.lit("m"), c % 7).alias("metric_type"), F.concat(F.lit("claim "), (1 + k % 50)).alias("summary"),
    )


def edges(t: Tables) -> DataFrame:
    """claim -> source, with the tier and whether the source has the claim's number."""
    own = t.lineitem.select(F.col("l_orderkey").alias("cid"), F.col("l_suppkey").alias("s_suppkey"), (F.col("l_quantity").cast("long") == 1 + F.col("l_orderkey") % 50).alias("hit"))
    # dealt out by claim once: both this aggregation and the one by claim, and the join with the claims, use that partitioning
    return own.repartition("cid").groupBy("cid", "s_suppkey").agg(F.bool_or("hit").alias("supports")).join(sources(t).select("s_suppkey", "tier", "host"), "s_suppkey")


def classified(t: Tables, ruleset: str = "v2") -> DataFrame:
    return verification.classified(claims(t), verification.edge_flags(edges(t)), ruleset)


def _list(names: list[str]) -> str:
    return "list_value(" + ", ".join(f"'{n}'" for n in names) + ")"


SQL = f"""
src AS (SELECT s_suppkey, CAST(1 + s_suppkey % 4 AS INTEGER) AS tier, lower(n_name) AS host, s_name, n_name AS direction FROM supplier JOIN nation ON s_nationkey = n_nationkey),
claim AS (SELECT o_orderkey AS cid, o_orderpriority AS section, {_list(EV)}[o_orderkey % 5 + 1] AS ev, {_list(PR)}[(o_orderkey + o_custkey) % 3 + 1] AS pr, {_list(ST)}[o_custkey % 8 + 1] AS st,
                 1 + o_orderkey % 50 AS num, 'm' || (o_custkey % 7) AS metric_type, 'claim ' || (1 + o_orderkey % 50) AS summary FROM orders),
edge AS (SELECT l_orderkey AS cid, l_suppkey AS s_suppkey, bool_or(CAST(l_quantity AS BIGINT) = 1 + l_orderkey % 50) AS supports FROM lineitem GROUP BY 1, 2),
flag AS (SELECT cid, bool_or(tier >= 3) AS low, bool_or(tier <= 2) AS high, bool_or(supports) AS hit, count(*) AS n FROM edge JOIN src USING (s_suppkey) GROUP BY cid),
cls AS (SELECT claim.*, coalesce(n, 0) AS n_sources, CASE
          WHEN (ev IN ('official_data', 'third_party_estimate') AND coalesce(low, false)) OR (st IN ('vendor_benchmark', 'vendor_survey', 'vendor_blog') AND pr IN ('exact', 'range') AND coalesce(low, false)) THEN 'source_indirect'
          WHEN coalesce(hit, false) THEN 'source_confirmed' ELSE 'source_absent' END AS sv
        FROM claim LEFT JOIN flag USING (cid))
"""
