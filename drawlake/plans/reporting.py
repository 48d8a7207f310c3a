"""Scans, predicates, joins and aggregates of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.functions.text import cost
from drawlake.operators import aggregates as A
from drawlake.operators import filters as P
from drawlake.operators import joins as J
from drawlake.plans.registry import query
from drawlake.sources.tables import table

SparkDF = DataFrame


@query(
    "D3",
    """SELECT n.n_name AS tenant, count(o.o_orderkey)::BIGINT AS n_jobs, max(o.o_orderdate) AS last_job,
         (count(*) FILTER (WHERE o.o_orderstatus = 'F'))::BIGINT AS n_finished, (count(*) FILTER (WHERE o.o_orderpriority = '1-URGENT'))::BIGINT AS n_urgent
       FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1""",
)
def tenant_report(spark: SparkSession, root: str) -> SparkDF:
    """Jobs, latest activity and filtered counts per tenant; tenants without jobs stay."""
    n = table(spark, root, "nation", ["n_nationkey", "n_name"])
    c = table(spark, root, "customer", ["c_custkey", "c_nationkey"])
    o = table(spark, root, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"])
    # Orders are counted per customer before they meet the tenants: the wide side shrinks first.
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("at"), A.count_where(F.col("o_orderstatus") == "F").alias("f"), A.count_where(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    rows = n.join(c, n.n_nationkey == c.c_nationkey, "left").join(per, c.c_custkey == per.o_custkey, "left")
    total = lambda x: A.sum_or_zero(F.col(x)).cast("long")
    return rows.groupBy(F.col("n_name").alias("tenant")).agg(total("n").alias("n_jobs"), F.max("at").alias("last_job"), total("f").alias("n_finished"), total("u").alias("n_urgent"))


@query("A1 A2", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_prune(spark, root):
    return table(spark, root, "documents", drop=["text"])


@query(
    "B1 B2 B3 B4 P2 T29",
    """SELECT event_id, ts, user_id, event_type, value FROM events WHERE user_id = 7 AND event_type IN ('click', 'view', 'purchase')
         AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-03-20' + INTERVAL 1 DAY AND event_type <> 'view'""",
)
def filter_scoped_optional(spark, root):
    who = P.Principal(user_id=7, org_id=1)
    asked = [P.one_of("event_type", ["click", "view", "purchase", "bogus"], ["click", "view", "purchase", "signup", "logout", "error"]), P.time_range("ts", "2024-01-03", "2024-03-20"), P.time_range("ts", "no date"), P.not_null_safe_equal("event_type", "view")]
    return table(spark, root, "events", ["event_id", "ts", "user_id", "event_type", "value"]).where(P.all_of([who.activity_scope(None, "user_id"), *asked]))


@query("B5 B6", "SELECT doc_id, contains(text, 'License') AS cased FROM documents WHERE text ILIKE '%license%'")
def ilike_search(spark, root):
    d = table(spark, root, "documents", ["doc_id", "text"]).where(P.containing("text", "license", any_case=True))
    return d.select("doc_id", P.containing("text", "License").alias("cased"))


@query(
    "B7 B8",
    """SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id)
       WHERE NOT coalesce(l.toxic = 1, false) AND (l.quality IS NULL OR d.lang <> 'en' OR l.quality = 1)""",
)
def null_aware_visible(spark, root):
    d = table(spark, root, "documents", ["doc_id", "lang"]).join(table(spark, root, "labels", ["doc_id", "quality", "toxic"]), "doc_id", "left")
    method = F.when(F.col("quality").isNotNull(), F.when(F.col("lang") == "en", "image").otherwise("text"))
    return d.where(P.visible(F.col("toxic") == 1, method, F.when(F.col("quality") == 0, 1))).select("doc_id")


@query("B9", "SELECT p_partkey, '(' || p_name || ') ' || p_type AS label FROM part WHERE length('(' || p_name || ') ' || p_type) > 30")
def noise_filter(spark, root):
    p = table(spark, root, "part", ["p_partkey", "p_name", "p_type"]).select("p_partkey", F.concat(F.lit("("), "p_name", F.lit(") "), "p_type").alias("label"))
    return p.where(P.noisy(F.col("label"), 30))


@query(
    "B11 B12",
    r"""SELECT p_partkey, regexp_matches(lower(p_type), 'brass|steel') AS has_metal, regexp_matches(p_type, '(?i)\b(?:large|small)\b') AS sized FROM part""",
)
def keyword_predicates(spark, root):
    p = table(spark, root, "part", ["p_partkey", "p_type"])
    return p.select("p_partkey", P.any_substring(F.col("p_type"), ["Brass", "Steel"]).alias("has_metal"), P.any_word(F.col("p_type"), ["large", "small"]).alias("sized"))


@query(
    "C8",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) OR doc_id IS NULL",
)
def anti_join_missing(spark, root):
    d, l = table(spark, root, "documents", ["doc_id", "source"]), table(spark, root, "labels", ["doc_id"])
    return J.not_found(d, l, [F.col("doc_id")], [F.col("doc_id")])


@query(
    "B18",
    """SELECT doc_id, coalesce(CASE WHEN doc_id % 50 = 0 THEN 'explicit' END, CASE WHEN q AND s THEN 'both' WHEN q THEN 'floor_plan' WHEN s THEN 'sign_schedule' ELSE 'other' END) AS page_type
       FROM (SELECT doc_id, coalesce(quality = 1, false) AS q, coalesce(toxic = 1, false) AS s FROM documents LEFT JOIN labels USING (doc_id))""",
)
def page_types(spark, root):
    d = table(spark, root, "documents", ["doc_id"]).join(table(spark, root, "labels", ["doc_id", "quality", "toxic"]), "doc_id", "left")
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return d.select("doc_id", P.page_type(F.when(F.col("doc_id") % 50 == 0, F.lit("explicit")), flag("quality"), flag("toxic")).alias("page_type"))


@query("C3 F-3", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_projection(spark, root):
    return J.lookup(table(spark, root, "documents", ["doc_id", "lang"]), table(spark, root, "labels", ["doc_id", "quality", "toxic"]), ["doc_id"]).orderBy("lang", "doc_id")


@query("C4", "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_orderstatus IN ('F', 'O')")
def inner_join_scope(spark, root):
    c = table(spark, root, "customer", ["c_custkey", "c_name", "c_nationkey"]).where(P.Principal(org_id=3).org_scope("c_nationkey"))
    o = table(spark, root, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]).where(P.one_of("o_orderstatus", ["F", "O"]))
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_custkey", "c_name")


@query(
    "C5 F-2",
    """SELECT c_custkey, o_orderkey AS last_order, o_totalprice AS last_price, o_orderdate AS last_date FROM customer
       LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey""",
)
def scalar_subquery_latest(spark, root):
    last = J.latest(table(spark, root, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice", "o_orderdate"])
    c = table(spark, root, "customer", ["c_custkey"])
    return c.join(last, c.c_custkey == last.o_custkey, "left").select("c_custkey", F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("last_price"), F.col("o_orderdate").alias("last_date"))


@query("C6", "SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def broadcast_lookup(spark, root):
    s = table(spark, root, "supplier", ["s_suppkey", "s_name", "s_nationkey"]).withColumnRenamed("s_nationkey", "n_nationkey")
    s = J.lookup(s, table(spark, root, "nation"), ["n_nationkey"]).withColumnRenamed("n_regionkey", "r_regionkey")
    return J.lookup(s, table(spark, root, "region"), ["r_regionkey"]).select("s_suppkey", "s_name", "n_name", "r_name")


@query("C7 P3 P4", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")
def semi_join_subset(spark, root):
    o = table(spark, root, "orders", ["o_orderkey", "o_custkey"])
    c = table(spark, root, "customer", ["c_custkey", "c_nationkey"]).withColumnRenamed("c_custkey", "o_custkey")
    return P.calls_of_jobs(o, c, P.Principal(org_id=5, role="ADMIN"), "c_nationkey", "o_custkey").select("o_orderkey", "o_custkey")


@query(
    "C16 C17",
    """SELECT o_orderkey, section FROM orders LEFT JOIN LATERAL (SELECT section FROM (VALUES (1, 0, 100000, 'small'), (2, 50000, 200000, 'middle'), (3, 150000, 1000000, 'large')) s(seq, lo, hi, section)
         WHERE o_totalprice >= lo AND o_totalprice < hi ORDER BY seq LIMIT 1) ON true""",
)
def interval_join_first(spark, root):
    o = table(spark, root, "orders", ["o_orderkey", "o_totalprice"])
    s = spark.sql("SELECT * FROM VALUES (1, 0, 100000, 'small'), (2, 50000, 200000, 'middle'), (3, 150000, 1000000, 'large') AS s(seq, lo, hi, section)")
    hit = (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))
    return J.first_by_priority(o, s, ["o_orderkey"], hit, ["seq"], ["section"]).select("o_orderkey", "section")


@query(
    "C12 J3",
    """SELECT c, s, rank FROM (SELECT c_custkey AS c, s_suppkey AS s, (row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey))::BIGINT AS rank
       FROM customer JOIN supplier ON c_nationkey = s_nationkey) WHERE rank <= 5""",
)
def knn_join_k5(spark, root):
    """The five suppliers of each customer's nation with the nearest balance."""
    c = table(spark, root, "customer", ["c_custkey", "c_nationkey", "c_acctbal"]).withColumnRenamed("c_nationkey", "k")
    s = table(spark, root, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]).withColumnRenamed("s_nationkey", "k")
    near = J.nearest_by_value(c, s, ["k"], "c_acctbal", "s_acctbal", "s_suppkey", 5)
    return near.select(F.col("c_custkey").alias("c"), F.col("s_suppkey").alias("s"), "rank")


@query(
    "C13 C14 C22 J1",
    """SELECT a.event_id, b.event_id AS near_id, abs(epoch(a.ts) - epoch(b.ts))::BIGINT AS gap FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
       AND abs(epoch(a.ts) - epoch(b.ts)) <= 21600 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch(a.ts) - epoch(b.ts)), b.event_id) = 1""",
)
def band_join_nearest(spark, root):
    e = table(spark, root, "events", ["event_id", "user_id", "event_type", "ts"]).withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double") + F.extract(F.lit("SECOND"), "ts").cast("double") - F.floor(F.extract(F.lit("SECOND"), "ts").cast("double")))
    a = e.where("event_type = 'click'").select("event_id", "user_id", "at")
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("near_id"), F.col("at").alias("near_at"))
    pairs = J.band_join(a, b, ["user_id"], "at", "near_at", 21600.0).withColumn("gap", F.abs(F.col("at") - F.col("near_at")))
    return J.nearest(pairs, ["event_id"], "gap", "near_id", ["near_id"]).select("event_id", "near_id", F.round("gap").cast("long").alias("gap"))


@query(
    "C19 C20",
    """WITH m AS (SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_returnflag = 'R'
         UNION ALL SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND o.o_orderdate = l.l_shipdate)
       SELECT o.o_orderkey, x.l_linenumber, x.l_suppkey FROM orders o LEFT JOIN (SELECT o_orderkey, min(l_linenumber) AS l_linenumber, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS l_suppkey FROM m GROUP BY 1) x USING (o_orderkey)""",
)
def or_join_first(spark, root):
    o = table(spark, root, "orders", ["o_orderkey", "o_orderdate"])
    l = table(spark, root, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"])
    l = l.withColumn("line", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    on = [([F.col("o_orderkey"), F.lit("R")], [F.col("l_orderkey"), F.col("l_returnflag")]), ([F.col("o_orderkey"), F.col("o_orderdate")], [F.col("l_orderkey"), F.col("l_shipdate")])]
    return J.or_join_first(o, l, on, "o_orderkey", "line", []).select("o_orderkey", "line.l_linenumber", "line.l_suppkey")


@query("D1", "SELECT (SELECT count(*) FROM customer)::BIGINT AS customers, (SELECT count(*) FROM orders)::BIGINT AS orders, (SELECT count(*) FROM events)::BIGINT AS events")
def global_counts(spark, root):
    n = [table(spark, root, t).agg(F.count("*").alias(t + ("s" if t == "customer" else ""))) for t in ("customer", "orders", "events")]
    return n[0].join(F.broadcast(n[1])).join(F.broadcast(n[2]))  # three rows of one row each


@query("D3", "SELECT user_id, count(*)::BIGINT AS n, (count(*) FILTER (WHERE event_type = 'error'))::BIGINT AS n_error, (count(*) FILTER (WHERE value > 50))::BIGINT AS n_large FROM events GROUP BY 1")
def filtered_counts(spark, root):
    return table(spark, root, "events").groupBy("user_id").agg(F.count("*").alias("n"), A.count_where(F.col("event_type") == "error").alias("n_error"), A.count_where(F.col("value") > 50).alias("n_large"))


@query("D4", "SELECT coalesce(sum(n_chars), 0)::BIGINT AS chars, coalesce(sum(CASE WHEN lang = 'xx' THEN n_chars END), 0)::BIGINT AS none FROM documents")
def coalesce_sum(spark, root):
    d = table(spark, root, "documents", ["lang", "n_chars"])
    return d.agg(A.sum_or_zero(F.col("n_chars")).cast("long").alias("chars"), A.sum_or_zero(F.when(F.col("lang") == "xx", F.col("n_chars"))).cast("long").alias("none"))


@query(
    "D5 D22 B17",
    """SELECT l_suppkey, sum(l_linenumber)::BIGINT AS a, sum(l_linenumber + l_partkey)::BIGINT AS b, count(*)::BIGINT AS n, round(sum(l_linenumber) * 0.15e-6 + sum(l_partkey) * 0.6e-6, 8) AS usd
       FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_suppkey IS NOT NULL GROUP BY 1""",
)
def page_summary(spark, root):
    l = table(spark, root, "lineitem", ["l_suppkey", "l_linenumber", "l_partkey", "l_returnflag"]).where(P.one_of("l_returnflag", ["A", "R"]) & F.col("l_suppkey").isNotNull())
    g = l.groupBy("l_suppkey").agg(F.sum("l_linenumber").cast("long").alias("a"), F.sum(F.col("l_linenumber") + F.col("l_partkey")).alias("b"), F.count("*").alias("n"), F.sum("l_partkey").alias("p"))
    return g.select("l_suppkey", "a", "b", "n", F.round(cost(F.col("a"), F.col("p")), 8).alias("usd")).orderBy(F.desc("b"), "l_suppkey")


@query(
    "D6 D23",
    """SELECT lang, source, sum(n_chars)::BIGINT AS chars, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2
       UNION ALL SELECT 'TOTAL', NULL, sum(n_chars)::BIGINT, count(*)::BIGINT FROM documents""",
)
def group_collect_total(spark, root):
    return A.with_total(table(spark, root, "documents", ["lang", "source", "n_chars"]), ["lang", "source"], [F.sum("n_chars").alias("chars"), F.count("*").alias("n")])


@query("D6", "SELECT source, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS langs, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def sorted_distinct_sheets(spark, root):
    return table(spark, root, "documents", ["source", "lang"]).groupBy("source").agg(A.joined_set(F.col("lang")).alias("langs"), F.count("*").alias("n"))


@query(
    "D18",
    """SELECT lang, count(*)::BIGINT AS items, coalesce(sum(quality), 0)::BIGINT AS good, (count(*) FILTER (WHERE toxic = 1))::BIGINT AS flagged, (count(*) FILTER (WHERE quality IS NULL))::BIGINT AS unlabelled
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def summary_metrics(spark, root):
    d = table(spark, root, "documents", ["doc_id", "lang"]).join(table(spark, root, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("items"), A.sum_or_zero(F.col("quality")).cast("long").alias("good"), A.count_where(F.col("toxic") == 1).alias("flagged"), A.count_where(F.col("quality").isNull()).alias("unlabelled"))


@query("D17", "SELECT (n_chars // 500)::BIGINT AS bucket, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def histogram(spark, root):
    return table(spark, root, "documents", ["n_chars"]).groupBy(F.expr("n_chars div 500").alias("bucket")).agg(F.count("*").alias("n"))


@query("D8 K1", "SELECT l_orderkey, coalesce(sum(len(xs)), 0)::BIGINT AS total FROM (SELECT l_orderkey, CASE WHEN l_linenumber > 1 THEN [l_partkey, l_suppkey] END AS xs FROM lineitem) GROUP BY 1")
def array_length_sums(spark, root):
    """Sums of array sizes; a group whose arrays are all null has 0."""
    l = table(spark, root, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    xs = F.when(F.col("l_linenumber") > 1, F.array("l_partkey", "l_suppkey"))
    return l.groupBy("l_orderkey").agg(F.sum(F.when(xs.isNotNull(), F.size(xs)).otherwise(0)).alias("total"))


@query(
    "T11",
    """SELECT c_custkey % 10 AS bucket, (2 * count(*))::BIGINT AS pages, array_to_string(list_sort(list(DISTINCT c_custkey % 5 + 1)), ',') AS schedules FROM customer GROUP BY 1""",
)
def array_totals(spark, root):
    c = table(spark, root, "customer", ["c_custkey"])
    k = F.col("c_custkey")
    d = c.select((k % 10).alias("bucket"), F.array(k, k + 1).alias("pages"), F.array(k % 5 + 1).alias("schedules"))
    return A.array_totals(d, ["bucket"], "pages", "schedules").select("bucket", F.col("total").alias("pages"), F.array_join("members", ",").alias("schedules"))


@query(
    "D9",
    """SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*)::BIGINT AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""",
)
def mode_with_ties(spark, root):
    return A.mode_first(table(spark, root, "events", ["user_id", "event_type", "event_id"]), ["user_id"], "event_type", "event_id")


@query("", "SELECT user_id, count(DISTINCT regexp_extract(event_type, '^([a-z])', 1))::BIGINT AS kinds FROM events WHERE value > 20 GROUP BY 1")
def distinct_key_count(spark, root):
    e = table(spark, root, "events", ["user_id", "event_type", "value"]).where("value > 20")
    return e.groupBy("user_id").agg(F.countDistinct(F.regexp_extract("event_type", "^([a-z])", 1)).alias("kinds"))


@query("D11 D12", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts, bool_or(l_returnflag = 'R') AS any_returned, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS first_supp FROM lineitem GROUP BY 1")
def page_audit(spark, root):
    l = table(spark, root, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"])
    return l.groupBy("l_orderkey").agg(F.array_join(A.ordered_list(F.struct("l_linenumber", "l_partkey"), F.col("l_partkey").cast("string")), ",").alias("parts"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.min_by("l_suppkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first_supp"))


@query("D13", "SELECT kind, total FROM (SELECT round(sum(l_quantity), 2) AS l_quantity, round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax FROM lineitem) UNPIVOT (total FOR kind IN (l_quantity, l_discount, l_tax))")
def conditional_unpivot_sums(spark, root):
    l = table(spark, root, "lineitem", ["l_quantity", "l_discount", "l_tax"])
    return A.unpivot_sums(l, ["l_quantity", "l_discount", "l_tax"]).select("kind", F.round("total", 2).alias("total"))


@query("D14", "SELECT o_custkey, CASE count(DISTINCT o_orderstatus) WHEN 1 THEN min(o_orderstatus) ELSE 'mixed' END AS status, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def step_rollup(spark, root):
    return table(spark, root, "orders").groupBy("o_custkey").agg(A.one_source(F.col("o_orderstatus")).alias("status"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "D15 I27",
    """SELECT phase, seq, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('click', 1), ('view', 2), ('purchase', 3), ('refund', 4), ('signup', 5), ('legacy', 6)) d(phase, seq)
       LEFT JOIN (SELECT event_type AS phase, count(*) AS n FROM events GROUP BY 1) USING (phase)""",
)
def rollup_phase_zero_fill(spark, root):
    dim = spark.sql("SELECT * FROM VALUES ('click', 1), ('view', 2), ('purchase', 3), ('refund', 4), ('signup', 5), ('legacy', 6) AS d(phase, seq)")
    e = table(spark, root, "events", ["event_type"]).withColumnRenamed("event_type", "phase")
    return A.zero_filled(e, dim, "phase", {"n": F.count("*")})


@query(
    "D19",
    """SELECT l_suppkey, (list_sort(list(l_quantity)))[(count(*) // 2) + 1] AS median FROM lineitem GROUP BY 1""",
)
def upper_median(spark, root):
    return A.upper_median_distributed(table(spark, root, "lineitem", ["l_suppkey", "l_quantity"]), ["l_suppkey"], "l_quantity")


@query("", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sigma, round(var_pop(l_discount), 8) AS variance FROM lineitem GROUP BY 1")
def stddev_pop(spark, root):
    return table(spark, root, "lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_pop("l_quantity"), 6).alias("sigma"), F.round(F.var_pop("l_discount"), 8).alias("variance"))


@query(
    "D20 F-10",
    """SELECT p_brand, prefix, n FROM (SELECT p_brand, regexp_extract(p_type, '^([A-Z]+)', 1) AS prefix, count(*)::BIGINT AS n FROM part GROUP BY 1, 2)
       QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, prefix) <= 2""",
)
def convention_mining(spark, root):
    from drawlake.operators.windows import first_of

    n = table(spark, root, "part", ["p_brand", "p_type"]).groupBy("p_brand", F.regexp_extract("p_type", "^([A-Z]+)", 1).alias("prefix")).agg(F.count("*").alias("n"))
    return first_of(n, ["p_brand"], [F.desc("n"), "prefix"], 2)


@query("D21", "SELECT lang, bool_and(quality = 1) AS all_good, bool_or(toxic = 1) AS some_toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def bool_and_or_groups(spark, root):
    d = table(spark, root, "labels").join(table(spark, root, "documents", ["doc_id", "lang"]), "doc_id")
    return d.groupBy("lang").agg(F.bool_and(F.col("quality") == 1).alias("all_good"), F.bool_or(F.col("toxic") == 1).alias("some_toxic"))


@query(
    "T10",
    """SELECT o_custkey, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN '1-URGENT' WHEN bool_or(o_orderpriority = '2-HIGH') THEN '2-HIGH' WHEN bool_or(o_orderpriority = '5-LOW') THEN '5-LOW' END AS top FROM orders GROUP BY 1""",
)
def dominant_source(spark, root):
    return table(spark, root, "orders", ["o_custkey", "o_orderpriority"]).groupBy("o_custkey").agg(A.dominant(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "5-LOW"]).alias("top"))


@query("T13", "SELECT o_orderpriority, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1)")
def share_and_slowest(spark, root):
    n = table(spark, root, "orders", ["o_orderpriority"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return A.share_of_total(n, "n").withColumn("share", F.round("share", 6))
