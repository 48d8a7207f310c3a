"""Windows, ranking, deduplication, paging, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from drawlake.functions.text import occurrence_key
from drawlake.operators import windows as W
from drawlake.plans.registry import query
from drawlake.sources.tables import table


@query(
    "E1 E2 I1",
    """SELECT event_id, (row_number() OVER w)::BIGINT AS occurrence_index, (count(*) OVER (PARTITION BY user_id, event_type))::BIGINT AS occurrence_total FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""",
)
def occurrence_index(spark, root):
    e = table(spark, root, "events", ["event_id", "user_id", "event_type", "ts"])
    key = occurrence_key(F.col("user_id").cast("string"), F.col("event_type"))
    return W.occurrences(e, [key], ["ts", "event_id"]).select("event_id", "occurrence_index", "occurrence_total")


@query(
    "E3",
    """SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn))::BIGINT AS occurrence_index, (count(*) OVER (PARTITION BY conv_id, role))::BIGINT AS occurrence_total FROM conversations""",
)
def occurrence_recomputed(spark, root):
    c = table(spark, root, "conversations", ["conv_id", "turn", "role"])
    old = W.occurrences(c, [F.col("conv_id"), F.col("role")], ["turn"])
    stale = old.withColumn("occurrence_index", F.when(F.col("role") == "user", F.lit(0).cast("long")).otherwise(F.col("occurrence_index")))
    return W.recomputed(stale, c.where("role = 'user'"), ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "occurrence_index", "occurrence_total")


@query(
    "E4",
    """SELECT c_custkey, CASE WHEN p > 1 THEN i END AS occurrence_index, CASE WHEN p > 1 THEN p END AS occurrence_total FROM (SELECT *, max(i) OVER (PARTITION BY c_nationkey, c_mktsegment) AS p FROM
       (SELECT c_custkey, c_nationkey, c_mktsegment, (dense_rank() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY round(c_acctbal / 1000, 0) ASC NULLS LAST))::BIGINT AS i FROM customer))""",
)
def dense_cluster_occurrence(spark, root):
    c = table(spark, root, "customer", ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"]).withColumn("y", F.col("c_acctbal") / 1000).withColumn("x", F.lit(0.0))
    return W.clustered_occurrences(c, ["c_nationkey", "c_mktsegment"], "x", "y", 0).select("c_custkey", "occurrence_index", "occurrence_total")


@query("E5", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def distinct_on_latest(spark, root):
    e = table(spark, root, "events", ["user_id", "event_type", "event_id", "ts", "value"])
    return W.first_of(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("E6", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 2")
def top2_per_group(spark, root):
    return W.first_of(table(spark, root, "orders", ["o_custkey", "o_orderkey", "o_orderdate"]), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query("", "SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY md5(text)")
def first_wins_dedup(spark, root):
    """First document of each text. The least id is an aggregate, so that copies meet as partial results only."""
    d = table(spark, root, "documents", ["doc_id", "text"]).select("doc_id", F.md5("text").alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"))


@query(
    "E8",
    """SELECT doc_id, n_chars FROM (SELECT d.doc_id, n_chars, CASE WHEN lang = 'en' THEN NULL ELSE source END AS k, lang, quality FROM documents d LEFT JOIN labels USING (doc_id))
       QUALIFY k IS NULL OR row_number() OVER (PARTITION BY k, lang ORDER BY quality IS NOT NULL DESC, n_chars DESC, doc_id) = 1""",
)
def prefer_dedup(spark, root):
    d = table(spark, root, "documents", ["doc_id", "lang", "source", "n_chars"]).join(table(spark, root, "labels", ["doc_id", "quality"]), "doc_id", "left")
    d = d.withColumn("k", F.when(F.col("lang") != "en", F.col("source")))
    return W.preferred(d, ["k", "lang"], F.col("quality").isNotNull(), "n_chars", "doc_id").select("doc_id", "n_chars")


@query(
    "E9",
    """SELECT source, arg_min(quality, doc_id) FILTER (WHERE quality IS NOT NULL) AS quality, arg_min(lang, doc_id) AS lang FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def coalesce_merge(spark, root):
    d = table(spark, root, "documents", ["doc_id", "lang", "source"]).join(table(spark, root, "labels", ["doc_id", "quality"]), "doc_id", "left")
    return W.merged_first(d, ["source"], "doc_id", ["quality", "lang"])


@query(
    "E10",
    """SELECT user_id, min(d) AS start, max(d) AS "end", count(*)::BIGINT AS n FROM (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g
         FROM (SELECT DISTINCT user_id, event_id // 20 AS d FROM events)) GROUP BY user_id, g""",
)
def gaps_islands(spark, root):
    e = table(spark, root, "events", ["user_id", "event_id"]).select("user_id", F.expr("event_id div 20").alias("d")).distinct()
    return W.runs(e, ["user_id"], "d")


@query(
    "E11",
    """SELECT user_id, count(gap)::BIGINT AS gaps, max(gap)::BIGINT AS longest, coalesce(bool_and(gap <= 400), true) AS regular FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) GROUP BY 1""",
)
def lag_gap_regularity(spark, root):
    g = W.gaps(table(spark, root, "events", ["user_id", "event_id"]), ["user_id"], ["event_id"], "event_id")
    return g.groupBy("user_id").agg(F.count("gap").alias("gaps"), F.max("gap").alias("longest"), F.coalesce(F.bool_and(F.col("gap") <= 400), F.lit(True)).alias("regular"))


@query(
    "G1 G3 G6",
    """SELECT event_id, sum(b) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS session FROM (SELECT event_id, user_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= 100 THEN 0 ELSE 1 END AS b FROM events)""",
)
def session_runs(spark, root):
    e = table(spark, root, "events", ["user_id", "event_id"])
    w = Window.partitionBy("user_id").orderBy("event_id")
    return W.sessions(e, ["user_id"], ["event_id"], F.col("event_id") - F.lag("event_id").over(w) > 100).select("event_id", "session")


@query(
    "G2 G4",
    """WITH RECURSIVE s AS (SELECT conv_id, turn, length(text)::DOUBLE AS y, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS i FROM conversations),
       r AS (SELECT conv_id, turn, i, y AS a, 1::BIGINT AS line FROM s WHERE i = 1
         UNION ALL SELECT s.conv_id, s.turn, s.i, CASE WHEN abs(s.y - r.a) > 200 THEN s.y ELSE r.a END, r.line + CASE WHEN abs(s.y - r.a) > 200 THEN 1 ELSE 0 END FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
       SELECT conv_id, turn, line FROM r""",
)
def line_fold(spark, root):
    c = table(spark, root, "conversations", ["conv_id", "turn", "text"]).select("conv_id", "turn", F.length("text").alias("y"))
    return W.anchored_lines(c, ["conv_id"], "y", "turn", 200.0)


@query("F-1 B10", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def paged_sort(spark, root):
    from drawlake.operators.filters import page_request

    limit, offset = page_request(None, 100)
    return W.paged(table(spark, root, "events", ["event_id", "ts"]), [F.desc("ts"), "event_id"], limit, offset)


@query("F-6", "SELECT o_orderkey, o_orderpriority FROM orders")
def canonical_sort(spark, root):
    o = table(spark, root, "orders", ["o_orderkey", "o_orderpriority"])
    return o.orderBy(*W.canonical_order(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"]), "o_orderkey").select("o_orderkey", "o_orderpriority")


@query(
    "F-8",
    """SELECT conv_id, turn, running FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM conversations) WHERE running <= 1500""",
)
def budget_prefix(spark, root):
    c = table(spark, root, "conversations", ["conv_id", "turn", "text"]).select("conv_id", "turn", F.length("text").alias("n"))
    return W.budget_prefix(c, ["conv_id"], [F.desc("n"), "turn"], "n", 1500).select("conv_id", "turn", "running")


@query(
    "F-9",
    """WITH RECURSIVE s AS (SELECT conv_id, turn, least(length(text), 600)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
       r AS (SELECT conv_id, turn, n, i, n AS used, 1::BIGINT AS batch FROM s WHERE i = 1
         UNION ALL SELECT s.conv_id, s.turn, s.n, s.i, CASE WHEN r.used + s.n > 900 THEN s.n ELSE r.used + s.n END, r.batch + CASE WHEN r.used + s.n > 900 THEN 1 ELSE 0 END FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
       SELECT conv_id, turn, n, batch FROM r""",
)
def next_fit_batches(spark, root):
    c = table(spark, root, "conversations", ["conv_id", "turn", "text"]).select("conv_id", "turn", F.length("text").alias("n"))
    return W.next_fit(c, ["conv_id"], "turn", "n", 900, 600)


@query(
    "H1 H6 K1",
    """SELECT o, list_sort(list_distinct(list_concat(a, b))) AS both, list_sort(list_filter(range(1, 8), lambda x: NOT list_contains(a, x))) AS missing, len(list_intersect(a, b))::BIGINT AS shared FROM
       (SELECT l_orderkey AS o, list(DISTINCT l_linenumber::BIGINT) AS a, list(DISTINCT l_suppkey % 7 + 1) AS b FROM lineitem GROUP BY 1)""",
)
def array_setops(spark, root):
    g = table(spark, root, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey"]).groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set(F.col("l_linenumber").cast("long")).alias("a"), F.collect_set(F.col("l_suppkey") % 7 + 1).alias("b"))
    full = F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))
    return g.select("o", F.array_sort(F.array_union("a", "b")).alias("both"), F.array_sort(F.array_except(full, F.col("a"))).alias("missing"), F.size(F.array_intersect("a", "b")).cast("long").alias("shared"))


@query(
    "",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' WHEN '3-MEDIUM' THEN 'whenever' ELSE '-' END AS label FROM orders""",
)
def map_overlay(spark, root):
    base = F.create_map(*[F.lit(x) for x in ("1-URGENT", "urgent", "2-HIGH", "high", "3-MEDIUM", "whenever")])
    over = F.create_map(*[F.lit(x) for x in ("1-URGENT", "now", "2-HIGH", "soon")])
    # The later map's entries come first where both hold a key.
    found = F.coalesce(F.try_element_at(over, "o_orderpriority"), F.try_element_at(base, "o_orderpriority"), F.lit("-"))
    return table(spark, root, "orders", ["o_orderkey", "o_orderpriority"]).select("o_orderkey", found.alias("label"))


@query("H6", "SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'part', p_partkey FROM part")
def union_with_constants(spark, root):
    a = table(spark, root, "orders", ["o_orderkey"]).select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return a.unionByName(table(spark, root, "part", ["p_partkey"]).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id")))
