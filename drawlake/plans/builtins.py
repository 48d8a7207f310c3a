"""Forms that the engine's users have beside its own operators: outer and cross joins, set operations, ranks, frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from drawlake.plans.registry import query
from drawlake.sources.tables import table


@query("C24", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, nc, ns FROM (SELECT c_nationkey, count(*)::BIGINT AS nc FROM customer WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*)::BIGINT AS ns FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON c_nationkey = s_nationkey")
def full_join(spark, root):
    c = table(spark, root, "customer", ["c_nationkey", "c_acctbal"]).where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("nc"))
    s = table(spark, root, "supplier", ["s_nationkey", "s_acctbal"]).where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("ns"))
    return c.join(s, "nation", "full")


@query("C24", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_join(spark, root):
    s, n = table(spark, root, "supplier", ["s_suppkey", "s_nationkey"]), table(spark, root, "nation", ["n_nationkey", "n_name"])
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").select("n_name", "s_suppkey")


@query("H7 H1", "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 3 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def set_operations(spark, root):
    a = table(spark, root, "customer", ["c_nationkey"]).union(table(spark, root, "supplier", ["s_nationkey"])).toDF("k").distinct()
    n = table(spark, root, "nation", ["n_nationkey", "n_regionkey"])
    return a.intersect(n.where("n_nationkey > 3").select("n_nationkey")).subtract(n.where("n_regionkey = 2").select("n_nationkey"))


@query(
    "E12",
    """SELECT o_orderkey, (rank() OVER w)::INT AS r, (dense_rank() OVER w)::INT AS d, (ntile(4) OVER t)::INT AS q, lead(o_orderkey) OVER t AS next, round(sum(o_totalprice) OVER (t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), t AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def rank_functions(spark, root):
    o = table(spark, root, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice"])
    w, t = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(t).alias("q"), F.lead("o_orderkey").over(t).alias("next"), F.round(F.sum("o_totalprice").over(t.rowsBetween(-2, 0)), 2).alias("last3"))


@query(
    "D23",
    "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, grouping(o_orderstatus)::INT AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority) HAVING count(*) > 5",
)
def cube_having(spark, root):
    return table(spark, root, "orders", ["o_orderstatus", "o_orderpriority"]).cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("g")).where("n > 5")


@query(
    "A22",
    r"""SELECT CASE WHEN regexp_matches(p_type, 'BRASS') THEN 'ID' WHEN regexp_matches(p_type, 'COPPER|STEEL') THEN 'SERVICE' ELSE 'OTHER' END AS kind, count(*)::BIGINT AS n FROM part GROUP BY 1""",
)
def annotated_types(spark, root):
    kind = F.when(F.col("p_type").rlike("BRASS"), "ID").when(F.col("p_type").rlike("COPPER|STEEL"), "SERVICE").otherwise("OTHER")
    return table(spark, root, "part", ["p_type"]).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
