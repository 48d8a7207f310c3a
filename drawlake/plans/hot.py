"""Queries over one hot key: running sums, runs and nearest values whose rows lie over all tasks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.operators import ranges as R
from drawlake.plans.registry import query
from drawlake.sources.tables import table


@query(
    "C12",
    """WITH c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 10 = 0 THEN c_nationkey ELSE -1 END AS k FROM customer), s AS (SELECT s_suppkey, s_acctbal, CASE WHEN s_suppkey % 10 = 0 THEN s_nationkey ELSE -1 END AS k FROM supplier)
       SELECT c_custkey, s_suppkey, rank FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS rank FROM c JOIN s USING (k)) WHERE rank <= 5""",
)
def nearest_hot_key(spark, root):
    """The five suppliers with the nearest balance, where nine of ten customers and suppliers have the same key."""
    key = lambda i, n: F.when(F.col(i) % 10 == 0, F.col(n)).otherwise(-1).alias("k")
    c = table(spark, root, "customer", ["c_custkey", "c_nationkey", "c_acctbal"]).select("c_custkey", "c_acctbal", key("c_custkey", "c_nationkey"))
    s = table(spark, root, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]).select("s_suppkey", "s_acctbal", key("s_suppkey", "s_nationkey"))
    return R.nearest_of_any(c, s, ["k"], "c_acctbal", "s_acctbal", "s_suppkey", 5).select("c_custkey", "s_suppkey", F.col("rank").cast("long").alias("rank"))


@query("F-8", "SELECT o_orderkey FROM (SELECT o_orderkey, sum(o_totalprice::BIGINT) OVER (ORDER BY o_orderdate, o_orderkey) AS s, (sum(o_totalprice::BIGINT) OVER ()) / 2 AS half FROM orders) WHERE s <= half")
def budget_hot_key(spark, root):
    """All orders by date under one key, as long as they add up to half of the whole."""
    o = table(spark, root, "orders", ["o_orderkey", "o_orderdate", "o_totalprice"]).withColumn("size", F.round("o_totalprice").cast("long"))
    half = (o.agg(F.sum("size")).first()[0] or 0) / 2
    return R.budget_prefix(o, [], [F.col("o_orderdate"), F.col("o_orderkey")], "size", half).select("o_orderkey")


@query(
    "E10 E11",
    """WITH p AS (SELECT event_type = 'error' AS bad, floor(epoch(ts))::BIGINT // 60 AS m FROM events), g AS (SELECT bad, m, m - lag(m) OVER (PARTITION BY bad ORDER BY m) AS d FROM p),
       r AS (SELECT bad, m, sum(CASE WHEN d IS NULL OR d > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY bad ORDER BY m) AS run FROM g) SELECT bad, min(m) AS first, max(m) AS last, count(*) AS rows FROM r GROUP BY bad, run""",
)
def islands_hot_key(spark, root):
    """Runs of minutes with events, at most three apart; most events have the same key."""
    e = table(spark, root, "events", ["event_type", "ts"])
    minute = F.floor(F.floor(F.col("ts").cast("timestamp").cast("double")) / 60)
    return R.islands(e.select((F.col("event_type") == "error").alias("bad"), minute.alias("m")), ["bad"], "m", 3)
