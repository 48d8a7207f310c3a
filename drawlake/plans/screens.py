"""Screens, exports, logs, access and state changes over the standard tables (sources, joins, derived views and N1-N11 of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import text as T
from drawlake.functions import vocab as W
from drawlake.operators import aggregates as A
from drawlake.operators import classify as C
from drawlake.operators import filters as P
from drawlake.operators import matching as M
from drawlake.operators import state as N
from drawlake.operators import views as V
from drawlake.plans.registry import query
from drawlake.session import scratch
from drawlake.sources import files as S
from drawlake.sources.tables import table

_ANY = lambda c, words: "(" + " OR ".join("contains({}, '{}')".format(c, w.lower().replace("'", "''")) for w in words) + ")"


def _outline(spark, root):
    """Parts as outline entries: brands are files, sizes are pages."""
    p = table(spark, root, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    above = F.array(F.when(F.col("p_partkey") % 5 == 0, "Electrical Drawings").otherwise(F.col("p_type")), F.lit("Set"))
    return p.select(F.col("p_brand").alias("file_id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 11 > 0, F.col("p_size")).alias("page"), above.alias("ancestors"), (F.col("p_partkey") % 3 > 0).alias("is_leaf"))


@query(
    "A7 E7",
    f"""SELECT file_id, page, seq, title FROM (SELECT p_brand AS file_id, p_size AS page, p_partkey AS seq, p_name AS title, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS n
        FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 11 > 0 AND NOT {_ANY("lower(CASE WHEN p_partkey % 5 = 0 THEN 'Electrical Drawings' ELSE p_type END)", W.OTHER_DISCIPLINES)}) WHERE n = 1""",
)
def outline_leaves(spark, root):
    return V.outline_leaves(_outline(spark, root)).select("file_id", "page", "seq", "title")


@query(
    "C17",
    "SELECT p_brand AS file_id, p_partkey AS seq, p_size AS start_page, greatest(p_size, coalesce(lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1, 60))::INT AS end_page FROM part WHERE p_partkey % 11 > 0",
)
def outline_sections(spark, root):
    o = _outline(spark, root)
    pages = o.select("file_id").distinct().withColumn("page_count", F.lit(60))
    return V.outline_sections(o, pages).select("file_id", "seq", "start_page", "end_page")


def _page_files(spark, root):
    """Customers as files of six pages with lists of classified ones."""
    k = F.col("c_custkey")
    c = table(spark, root, "customer", ["c_custkey"])
    n = lambda e: e.cast("int")
    return c.select(
        k.alias("file_id"), F.array(n(k % 4 + 1), n(k % 3 + 2)).alias("floor_plan_pages"), F.array(n(k % 5 + 1)).alias("schedule_pages"), F.array(n(k % 6 + 1)).alias("both_pages"), F.lit(6).alias("page_count"),
        F.create_map(F.lit(1), F.lit("A-1"), F.lit(3), F.lit("A-3")).alias("page_labels"),
        F.array(F.struct(F.lit("front").alias("title"), F.lit(1).alias("start_page"), F.lit(2).alias("end_page")), F.struct(F.lit("plans").alias("title"), F.lit(2).alias("start_page"), F.lit(4).alias("end_page"))).alias("sections"),
    )


@query(
    "H2 T9 H1",
    """SELECT c_custkey AS file_id, p::INT AS page, CASE WHEN p IN (c_custkey % 4 + 1, c_custkey % 3 + 2) AND p = c_custkey % 5 + 1 THEN 'both' WHEN p IN (c_custkey % 4 + 1, c_custkey % 3 + 2) THEN 'floor_plan' WHEN p = c_custkey % 5 + 1 THEN 'sign_schedule' ELSE 'other' END AS type
       FROM customer, range(1, 7) r(p)""",
)
def fallback_rows(spark, root):
    return V.fallback_rows(_page_files(spark, root))


@query(
    "T8 H1",
    """SELECT c_custkey AS file_id, p::INT AS page, CASE p WHEN 1 THEN 'A-1' WHEN 3 THEN 'A-3' END AS label, CASE WHEN p <= 2 THEN 'front' WHEN p <= 4 THEN 'plans' END AS section
       FROM customer, range(1, 7) r(p) WHERE p IN (c_custkey % 5 + 1, c_custkey % 6 + 1)""",
)
def detection_rows(spark, root):
    return V.detection_rows(_page_files(spark, root))


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
_STEPS = ("sheet_manifest", "text_extraction", "upload", "phase-2-classification")


def _log(spark, root):
    """Events as steps of processing logs: users are jobs."""
    e = table(spark, root, "events", ["event_id", "user_id", "event_type", "value"])
    e = e.withColumn("h", F.md5((F.col("event_id") % 40).cast("string"))).withColumn("uuid", F.expr(_UUID))
    step = F.concat_ws("_", F.array(*map(F.lit, _STEPS))[(F.col("event_id") % 4).cast("int")], "uuid")
    return e.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), step.alias("step"), (F.col("event_id") % 7).alias("file_id"), F.floor(F.col("value") * 10).alias("duration_ms"), F.when(F.col("event_type") == "error", "bad").alias("error"),
        (F.col("event_type") == "view").alias("skipped"), F.concat(F.lit("label "), "event_type").alias("label"), F.when(F.col("event_id") % 3 > 0, F.when(F.col("event_id") % 7 > 2, "text").otherwise("image")).alias("source"),
        F.when(F.col("event_type") == "click", F.lit(5)).alias("tokens_in"), F.lit(None).cast("int").alias("tokens_out"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("details"),
    )


@query(
    "D10",
    """SELECT user_id AS job_id, count(DISTINCT CASE WHEN event_type = 'error' THEN event_id % 40 END)::BIGINT AS failed_files, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id % 40 END)::BIGINT AS skipped_files
       FROM events WHERE event_id % 4 <> 2 GROUP BY 1""",
)
def failure_counts(spark, root):
    return V.failure_counts(_log(spark, root))


@query(
    "D14 D16 F-5",
    """SELECT user_id AS job_id, event_id % 7 AS file_id, sum(floor(value * 10))::BIGINT AS duration_ms, bool_or(event_type = 'error') AS failed, bool_or(event_type = 'view') AS skipped, 'label ' || arg_min(event_type, event_id) AS label,
         CASE count(DISTINCT s) WHEN 0 THEN 'none' WHEN 1 THEN max(s) ELSE 'mixed' END AS source
       FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 7 > 2 THEN 'text' ELSE 'image' END END AS s FROM events) GROUP BY 1, 2""",
)
def file_summary(spark, root):
    return V.file_summary(_log(spark, root))


@query("T14", "SELECT user_id AS job_id, event_id AS seq FROM events WHERE event_type = 'click' OR event_id % 4 = 1")
def model_steps(spark, root):
    return V.model_steps(_log(spark, root), ["text_"]).select("job_id", "seq")


@query("K2", "SELECT user_id AS job_id, 'd' || max(event_id) AS details FROM events WHERE event_id % 40 = 6 GROUP BY 1")
def last_steps(spark, root):
    import hashlib

    h = hashlib.md5(b"6").hexdigest()
    return V.last_step(_log(spark, root), f"upload_{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}")


@query(
    "T15",
    """SELECT l_orderkey AS file_id, array_to_string(list(l_linenumber || ':' || l_quantity::INT ORDER BY l_linenumber, l_quantity), ',') AS pages FROM lineitem GROUP BY 1""",
)
def audit_by_file(spark, root):
    q = F.col("l_quantity").cast("int")
    l = table(spark, root, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"]).select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("pdf_page"), F.lit(0).alias("rooms_found"), F.lit(0).alias("rows_emitted"), q.alias("quantity"))
    d = V.audit_by_file(l)
    return d.select("file_id", F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["pdf_page"], p["quantity"])), ",").alias("pages"))


def _signs(spark, root):
    """Parts as signs: 50 a file, two pages a file."""
    k = F.col("p_partkey")
    p = table(spark, root, "part", ["p_partkey", "p_name", "p_type", "p_size"])
    return p.select(
        F.floor(k / 50).alias("job_id"), F.floor(k / 50).alias("file_id"), k.alias("sign_id"), F.when(k % 13 > 0, (k % 2 + 1).cast("int")).alias("page_number"), F.concat(F.lit("S-"), (k % 90).cast("string")).alias("sign_identifier"),
        F.col("p_type").alias("sign_type"), F.col("p_name").alias("location"), F.when(k % 4 > 0, (k * 37 % 100) / 100).alias("x_pos"), F.when(k % 4 > 0, (k * 53 % 100) / 100).alias("y_pos"), F.when(k % 6 > 0, F.col("p_size")).alias("quantity"),
        F.concat((k % 3).cast("string"), F.lit(" in")).alias("dimensions"), ((k * 7 % 10) / 10).alias("confidence_score"), (k % 5 == 0).alias("review_flag"), F.when(k % 17 > 0, k % 9 == 0).alias("hidden"),
        (k % 10 == 0).alias("verified"), F.when(k % 8 == 0, True).alias("manual"),
    )


#: The same signs in SQL.
_SIGNS_SQL = """s AS (SELECT p_partkey // 50 AS job_id, p_partkey // 50 AS file_id, p_partkey AS sign_id, CASE WHEN p_partkey % 13 > 0 THEN (p_partkey % 2 + 1)::INT END AS page_number, 'S-' || (p_partkey % 90) AS sign_identifier, p_type AS sign_type, p_name AS location,
  CASE WHEN p_partkey % 4 > 0 THEN (p_partkey * 37 % 100) / 100 END AS x_pos, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey * 53 % 100) / 100 END AS y_pos, CASE WHEN p_partkey % 6 > 0 THEN p_size END AS quantity, (p_partkey % 3) || ' in' AS dimensions,
  (p_partkey * 7 % 10) / 10 AS confidence_score, p_partkey % 5 = 0 AS review_flag, CASE WHEN p_partkey % 17 > 0 THEN p_partkey % 9 = 0 END AS hidden, p_partkey % 10 = 0 AS verified, CASE WHEN p_partkey % 8 = 0 THEN true END AS manual FROM part)"""


@query("T7", f"WITH {_SIGNS_SQL} SELECT sign_id, page_number, x_pos, y_pos, round(x_pos * 100, 2) AS x_percent, round(y_pos * 100, 2) AS y_percent FROM s WHERE x_pos IS NOT NULL")
def coordinates(spark, root):
    return V.coordinates_table(_signs(spark, root)).select("sign_id", "page_number", "x_pos", "y_pos", "x_percent", "y_percent")


@query(
    "A16 J7",
    f"""WITH {_SIGNS_SQL} SELECT sign_id, CASE r WHEN 90 THEN y_pos WHEN 180 THEN 1 - x_pos WHEN 270 THEN 1 - y_pos ELSE x_pos END AS x, CASE r WHEN 90 THEN 1 - x_pos WHEN 180 THEN 1 - y_pos WHEN 270 THEN x_pos ELSE y_pos END AS y,
          dense_rank() OVER (PARTITION BY file_id, page_number ORDER BY sign_type)::INT AS legend FROM (SELECT *, (file_id + page_number) % 4 * 90 AS r FROM s WHERE x_pos IS NOT NULL AND page_number IS NOT NULL)""",
)
def placed_markers(spark, root):
    s = _signs(spark, root)
    pages = s.where("page_number IS NOT NULL").select("file_id", F.col("page_number").alias("page")).distinct().withColumn("rotation", (F.col("file_id") + F.col("page")) % 4 * 90)
    return S.markers(s, pages).select("sign_id", "x", "y", "legend")


def _written_sheet(spark, root, name):
    out = scratch(spark, "sheets")
    S.write_sheets(S.export_sheets(_signs(spark, root)), out)
    return spark.read.parquet(f"{out}/{name}")


@query(
    "A15 A19 D7",
    f"WITH {_SIGNS_SQL} SELECT count(*)::BIGINT AS items, sum(coalesce(quantity, 1))::BIGINT AS signs, count(*) FILTER (confidence_score >= 0.8)::BIGINT AS confident, count(*) FILTER (review_flag)::BIGINT AS flagged FROM s WHERE NOT coalesce(hidden, false)",
)
def exported_summary(spark, root):
    return _written_sheet(spark, root, "summary")


@query(
    "A15 D6 F-3",
    f"""WITH {_SIGNS_SQL} SELECT CASE WHEN grouping(sign_type) = 1 THEN 'TOTAL' ELSE sign_type END AS sign_type, dimensions, sum(coalesce(quantity, 1))::BIGINT AS quantity, coalesce(string_agg(DISTINCT page_number::VARCHAR, ', ' ORDER BY page_number::VARCHAR), '') AS pages
        FROM s WHERE NOT coalesce(hidden, false) GROUP BY GROUPING SETS ((sign_type, dimensions), ())""",
)
def exported_types(spark, root):
    return _written_sheet(spark, root, "types")


@query(
    "T6 T21",
    f"""WITH {_SIGNS_SQL} SELECT sign_id, CASE WHEN coalesce(manual, false) THEN 'manual' WHEN verified THEN 'ai' WHEN sign_id % 3 = 0 AND sign_id % 2 = 0 THEN 'both' WHEN sign_id % 2 = 0 THEN 'visual' ELSE 'text' END AS label,
          CASE WHEN confidence_score >= 0.8 THEN 'good' WHEN confidence_score >= 0.6 THEN 'fair' ELSE 'poor' END AS band FROM s""",
)
def source_labels(spark, root):
    k = F.col("sign_id")
    return _signs(spark, root).select("sign_id", V.source_label(F.coalesce("manual", F.lit(False)), F.col("verified"), k % 3 == 0, k % 2 == 0).alias("label"), V.match_band(F.col("confidence_score")).alias("band"))


@query(
    "T18",
    """SELECT coalesce(a.n_name, b.k) AS key, coalesce(b.o, a.l) AS label, CASE WHEN a.l IS NULL THEN 'custom' WHEN b.o IS NOT NULL AND b.o <> a.l THEN 'override' ELSE 'built-in' END AS origin
       FROM (SELECT n_name, lower(n_name) AS l FROM nation) a FULL JOIN (SELECT DISTINCT CASE WHEN s_nationkey % 5 = 0 THEN n_name || '+' ELSE n_name END AS k, CASE WHEN s_nationkey % 2 = 0 THEN lower(n_name) ELSE 'other' END AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey) b ON a.n_name = b.k""",
)
def vocabulary_origin(spark, root):
    n = table(spark, root, "nation", ["n_nationkey", "n_name"])
    base = n.select(F.col("n_name").alias("key"), F.lower("n_name").alias("label"))
    s = table(spark, root, "supplier", ["s_nationkey"]).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    over = s.select(F.when(F.col("s_nationkey") % 5 == 0, F.concat("n_name", F.lit("+"))).otherwise(F.col("n_name")).alias("key"), F.when(F.col("s_nationkey") % 2 == 0, F.lower("n_name")).otherwise("other").alias("label")).distinct()
    return V.provenance(base, over)


@query(
    "H4 A12",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'pressed' WHEN 'view' THEN 'seen' WHEN 'error' THEN 'failed' END AS label FROM events""",
)
def overlaid_labels(spark, root):
    path = scratch(spark, "overlay")
    spark.createDataFrame([('{"error": "failed", "view": "seen"}',)], "value string").coalesce(1).write.text(path)
    labels = V.overlaid({"click": "click", "view": "view"}, {"click": "pressed"}, S.overlay(spark, path))
    e = table(spark, root, "events", ["event_id", "event_type"])
    return e.select("event_id", F.try_element_at(labels, F.col("event_type")).alias("label"))


@query(
    "A8 I19",
    """SELECT 'id' || s_suppkey AS identifier, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS sign_type, s_nationkey::VARCHAR AS quantity FROM supplier""",
)
def sign_list_rows(spark, root):
    """Suppliers written as a CSV sign list below its header, and read back with its columns found by name."""
    path = scratch(spark, "list")
    s = table(spark, root, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    rows = s.select(F.concat(F.lit("id"), F.col("s_suppkey").cast("string")).alias("a"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_name")).alias("b"), F.col("s_nationkey").cast("string").alias("c"), F.lit("x").alias("d"))
    head = spark.createDataFrame([("Sign ID", "Sign Type", "Qty", "Remarks by"), ("", "", "7", "")], rows.schema)
    head.unionByName(rows).coalesce(1).write.csv(path)
    return S.sign_list(spark, path).select("identifier", "sign_type", "quantity")


#: Lines of the table for each file that a sign list is written in.
_LIST_ROWS = 500_000


@query(
    "A8 I19",
    """SELECT l_orderkey % 3 AS list, CASE WHEN l_orderkey % 7 > 0 THEN 'S-' || l_orderkey || '.' || l_linenumber END AS identifier, CASE WHEN l_orderkey % 3 <> 1 THEN l_returnflag END AS sign_type, CASE WHEN l_orderkey % 3 = 1 THEN l_linestatus END AS location, l_quantity::INT AS quantity
       FROM lineitem WHERE l_orderkey % 7 > 0 OR l_orderkey % 5 > 0""",
)
def title_rows(spark, root):
    """All lines in three sign lists of other columns, below titles, notes and rows for the eye; later rows that are as full as the header stay."""
    path = scratch(spark, "lists")
    k = F.col("l_orderkey")
    l = table(spark, root, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"])
    ident = F.when(k % 7 > 0, F.concat(F.lit("S-"), k.cast("string"), F.lit("."), F.col("l_linenumber").cast("string")))
    kind, count = F.when((k % 7 > 0) | (k % 5 > 0), F.concat(F.lit(" "), F.col("l_returnflag"))), F.col("l_quantity").cast("int").cast("string")
    place = F.when((k % 7 > 0) | (k % 5 > 0), F.col("l_linestatus"))
    layouts = (
        ([("Sign list of the north wing", "", "", ""), ("Sign ID", "Sign Type", "Qty", "Remarks"), ("", "", "9", "")], (ident, kind, count, F.lit("x"))),
        ([("", "", "", ""), ("Project", "Tower", "", ""), ("as of", "May", "", ""), ("Count", "Room", "Sign No", "Size")], (count, place, ident, F.lit("6x6"))),
        ([("Identifier", "Type", "Quantity", "Finish")], (ident, kind, count, F.lit(None).cast("string"))),
    )
    parts = l.count() // _LIST_ROWS + 1
    for n, (top, cells) in enumerate(layouts):
        rows = l.where(k % 3 == n).select(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(parts)).alias("part"), F.lit(len(top)).alias("line"), *[c.alias(a) for c, a in zip(cells, "abcd", strict=True)])
        heads = spark.createDataFrame([(i, *t) for i, t in enumerate(top)], "line int, a string, b string, c string, d string").join(spark.range(parts).withColumnRenamed("id", "part"))
        # A list comes in as many files, each with title and header above its rows: a task writes a file in this order.
        rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "line").drop("line").write.partitionBy("part").csv(f"{path}/list={n}")
    d = S.sign_lists(spark, f"{path}/*/*/*.csv")
    return d.select(F.regexp_extract("file", "list=([0-9])", 1).cast("long").alias("list"), "identifier", "sign_type", "location", F.col("quantity").cast("int").alias("quantity"))


@query(
    "B14",
    r"""SELECT p_partkey, len(list_filter(regexp_split_to_array(l, '[\s,/|_-]+'), lambda t: length(t) >= 3 AND regexp_matches(t, '(?i)[aeiou]') AND regexp_matches(t, '^[A-Za-z''.]+$'))) = 0 AS code_only
        FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'A-' || p_partkey WHEN 2 THEN p_brand || ' / ' || p_size ELSE 'RM ' || (p_partkey % 300) || ' TYP' END AS l FROM part)""",
)
def code_only_locations(spark, root):
    k = F.col("p_partkey")
    p = table(spark, root, "part", ["p_partkey", "p_name", "p_brand", "p_size"])
    place = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.concat(F.lit("A-"), k.cast("string"))).when(k % 4 == 2, F.concat_ws(" / ", "p_brand", F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("RM "), (k % 300).cast("string"), F.lit(" TYP")))
    return p.select("p_partkey", P.code_only(place).alias("code_only"))


@query(
    "B15 N5 H5",
    f"""WITH {_SIGNS_SQL}, r AS (SELECT job_id, list_sort(CASE WHEN job_id % 2 = 0 THEN [1] WHEN job_id % 3 = 0 THEN [2] ELSE [1, 2] END) AS pages FROM (SELECT DISTINCT job_id FROM s))
       SELECT sign_id FROM s JOIN r USING (job_id) WHERE page_number IS NULL OR NOT list_contains(pages, page_number)""",
)
def rejected_pages(spark, root):
    """Each job rejects page 1, toggles page 2 if its number is odd, and takes page 1 back if it is a multiple of three as well; signs of rejected pages go."""
    s = _signs(spark, root)
    j = s.select("job_id").distinct().withColumn("pages", F.array(F.lit(1)))
    j = j.withColumn("pages", F.when(F.col("job_id") % 2 == 1, N.toggled(F.col("pages"), F.lit(2))).otherwise(F.col("pages")))
    j = j.withColumn("pages", F.when((F.col("job_id") % 2 == 1) & (F.col("job_id") % 3 == 0), N.toggled(F.col("pages"), F.lit(1))).otherwise(F.col("pages")))
    return P.without_pages(s, j.select("job_id", F.explode("pages").alias("page_number")), ["job_id", "page_number"]).select("sign_id")


@query(
    "P5 C2",
    """SELECT c_custkey AS user_id, s_nationkey AS org_id, coalesce(CASE WHEN s_acctbal > 5000 THEN 'ADMIN' WHEN s_acctbal > 0 THEN 'MANAGER' END, 'SALES') AS role, n_name AS org_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def user_memberships(spark, root):
    users = table(spark, root, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("user_id"))
    role = F.when(F.col("s_acctbal") > 5000, "ADMIN").when(F.col("s_acctbal") > 0, "MANAGER")
    members = table(spark, root, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]).select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("org_id"), role.alias("role"))
    orgs = table(spark, root, "nation", ["n_nationkey", "n_name"]).toDF("org_id", "name")
    return P.memberships(users, members, orgs).select("user_id", "org_id", "role", "org_name")


@query(
    "T31 C1 D2",
    """SELECT n_nationkey AS org_id, coalesce(m, 0)::BIGINT AS members, coalesce(j, 0)::BIGINT AS jobs, last_job FROM nation
       LEFT JOIN (SELECT s_nationkey, count(*) AS m FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS j, max(o_orderdate) AS last_job FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON c_nationkey = n_nationkey""",
)
def organisation_counts(spark, root):
    orgs = table(spark, root, "nation", ["n_nationkey"]).toDF("org_id")
    members = table(spark, root, "supplier", ["s_nationkey", "s_acctbal"]).where("s_acctbal > 9000").select(F.col("s_nationkey").alias("org_id"))
    o, c = table(spark, root, "orders", ["o_custkey", "o_orderdate"]), table(spark, root, "customer", ["c_custkey", "c_nationkey"])
    jobs = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("org_id"), F.col("o_orderdate").alias("created_at"))
    return P.organisations(orgs, members, jobs)


@query("T12", "SELECT event_type, total FROM (SELECT event_type, round(sum(value), 3) AS total, row_number() OVER (ORDER BY sum(value) DESC) AS n, lead(sum(value)) OVER (ORDER BY sum(value) DESC) AS next FROM events GROUP BY 1) WHERE n = 1 AND total >= next * 1.001")
def slowest_type(spark, root):
    g = table(spark, root, "events", ["event_type", "value"]).groupBy("event_type").agg(F.round(F.sum("value"), 3).alias("total"))
    return A.slowest(g, "event_type", "total", 1.001)


@query(
    "F-4",
    "SELECT c_custkey, c_name, c_acctbal FROM customer",
)
def sorted_customers(spark, root):
    from drawlake.operators.windows import sorted_by

    return sorted_by(table(spark, root, "customer", ["c_custkey", "c_name", "c_acctbal"]), "c_acctbal", {"c_acctbal": "number", "c_name": "text"}, True, "c_custkey")


# State changes.


def _new_signs(spark, root):
    """What a rescan found: every third sign again, with other words."""
    s = _signs(spark, root).where("sign_id % 3 = 0")
    return s.select("job_id", "file_id", (F.col("sign_id") + 1_000_000_000).alias("sign_id"), F.concat(F.lit("new "), "location").alias("location"), F.lit(False).alias("verified"), F.lit(False).alias("manual"))


_KEEP = "(verified OR coalesce(manual, false))"


def _rescan(spark, root, files):
    s = _signs(spark, root).select("job_id", "file_id", "sign_id", "location", "verified", "manual")
    n = _new_signs(spark, root)
    hit = s.where("job_id % 2 = 0")
    return N.rescanned(s, n.where("job_id % 2 = 0"), hit.select("job_id"), hit.select("job_id", "file_id") if files else None).select("job_id", "sign_id", "location")


_RESCAN_SQL = f"WITH {_SIGNS_SQL} SELECT job_id, sign_id, location FROM s WHERE job_id % 2 = 1 OR {_KEEP} UNION ALL SELECT job_id, sign_id + 1000000000, 'new ' || location FROM s WHERE job_id % 2 = 0 AND sign_id % 3 = 0"


@query("N1 B8", _RESCAN_SQL)
def rescanned_jobs(spark, root):
    return _rescan(spark, root, False)


@query("N2 B8", _RESCAN_SQL)
def rescanned_files(spark, root):
    return _rescan(spark, root, True)


@query(
    "N3",
    f"""WITH {_SIGNS_SQL} SELECT sign_id, CASE WHEN NOT {_KEEP} AND sign_id % 3 = 0 THEN coalesce(x_pos, 0.5) ELSE x_pos END AS x_pos, CASE WHEN NOT {_KEEP} AND sign_id % 3 = 0 THEN coalesce(quantity, 9) ELSE quantity END AS quantity FROM s
        UNION ALL SELECT sign_id + 1000000000, 0.5, 9 FROM s WHERE sign_id % 10 = 3""",
)
def merged_signs(spark, root):
    s = _signs(spark, root).select("sign_id", "x_pos", "quantity", "verified", "manual")
    of = lambda where, add: s.where(where).select((F.col("sign_id") + add).alias("sign_id"), F.lit(0.5).alias("x_pos"), F.lit(9).alias("quantity"))
    return N.merged(s, of("sign_id % 3 = 0", 0).unionByName(of("sign_id % 10 = 3", 1_000_000_000)), ["sign_id"], ["x_pos", "quantity"]).select("sign_id", "x_pos", "quantity")


@query(
    "N4",
    f"""WITH {_SIGNS_SQL} SELECT sign_id, CASE WHEN sign_id % 7 = 1 THEN 'edited' ELSE location END AS location, CASE WHEN sign_id % 7 = 2 THEN 0.25 ELSE x_pos END AS x_pos, verified OR sign_id % 7 = 1 AS verified FROM s WHERE sign_id % 7 <> 3
        UNION ALL SELECT sign_id + 1000000000, 'created', NULL, false FROM s WHERE sign_id % 7 = 4""",
)
def changed_signs(spark, root):
    """A change log: locations patched (twice, the last counts), places patched, rows deleted and created."""
    s = _signs(spark, root).select("sign_id", "location", "x_pos", "verified")
    k = F.col("sign_id")
    none = F.lit(None)
    of = lambda r, seq, op, add=0, loc=none, x=none: s.where(k % 7 == r).select((k * 10 + seq).alias("seq"), F.lit(op).alias("op"), (k + add).alias("sign_id"), loc.cast("string").alias("location"), x.cast("double").alias("x_pos"))
    log = of(1, 0, "patch", loc=F.lit("first")).unionByName(of(1, 1, "patch", loc=F.lit("edited"))).unionByName(of(2, 0, "patch", x=F.lit(0.25)))
    log = log.unionByName(of(3, 0, "delete")).unionByName(of(4, 0, "create", 1_000_000_000, F.lit("created")))
    return N.applied(s, log, "sign_id", ["location"])


@query("N6 N11", f"WITH {_SIGNS_SQL} SELECT sign_id, CASE WHEN page_number = 1 THEN file_id END AS file_id FROM s WHERE job_id % 4 <> 0")
def deleted_jobs(spark, root):
    """Signs of deleted jobs go; a file that is gone (here: what only second pages name) becomes null."""
    s = _signs(spark, root)
    left = N.without_jobs(s, s.where("job_id % 4 = 0").select("job_id")).withColumn("file_id", F.when(F.col("page_number") == 1, F.col("file_id")).otherwise(-1))
    return N.detached(left, s.select("file_id").distinct(), "file_id", "file_id").select("sign_id", "file_id")


@query(
    "N7 B17",
    f"""WITH {_SIGNS_SQL} SELECT sign_id AS id, CASE WHEN sign_id % 6 = 0 THEN 'both' ELSE 'text' END AS found_by, CASE WHEN sign_id % 6 = 0 THEN least(1.0, confidence_score + 0.15) ELSE confidence_score END::DOUBLE AS confidence FROM s WHERE sign_id % 2 = 0
        UNION ALL SELECT sign_id, 'image', confidence_score FROM s WHERE sign_id % 2 = 1 AND (sign_id - 1) % 6 <> 0""",
)
def compared_passes(spark, root):
    s = _signs(spark, root).select(F.col("sign_id").alias("id"), F.col("confidence_score").alias("confidence"))
    pairs = s.where("id % 6 = 0").select(F.col("id").alias("text_id"), (F.col("id") + 1).alias("image_id"))
    return N.compared(s.where("id % 2 = 0"), s.where("id % 2 = 1"), pairs)


@query(
    "N8",
    """SELECT o_custkey AS job_id, CASE WHEN bool_or(o_orderstatus = 'P' AND o_orderkey % 3 = 0) THEN 'processing' WHEN bool_and(o_orderstatus = 'P') THEN 'pending' WHEN bool_or(o_orderstatus = 'P') THEN 'processing' WHEN bool_and(o_orderstatus = 'F') THEN 'failed' ELSE 'completed' END AS status
       FROM orders GROUP BY 1""",
)
def job_statuses(spark, root):
    o = table(spark, root, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderkey") % 3 == 0, "processing").otherwise("pending")
    return N.job_status(o.select(F.col("o_custkey").alias("job_id"), status.alias("status")))


@query(
    "N9 T35",
    "SELECT c_custkey AS job_id, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey ELSE 99 END AS org_id FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
)
def empty_jobs(spark, root):
    c = table(spark, root, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    jobs = c.select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("org_id"), F.when(F.col("c_mktsegment") == "BUILDING", "completed").otherwise("failed").alias("status"))
    signs = table(spark, root, "orders", ["o_custkey", "o_orderstatus"]).where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("job_id"))
    return N.adopted(N.empty_jobs(jobs, signs), 99).select("job_id", "org_id")


# Names and places.


def _score_sql(a, b):
    """The mean over the tokens of list a of their best token in list b."""
    best = f"coalesce(list_max([CASE WHEN q = t THEN 1.0 WHEN starts_with(q, t) OR starts_with(t, q) THEN least(length(q), length(t)) / greatest(length(q), length(t)) ELSE 1 - levenshtein(q, t) / greatest(length(q), length(t)) END FOR t IN {b}]), 0.0)"
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE list_sum([{best} FOR q IN {a}]) / len({a}) END"


def _tokens_sql(c):
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda z: length(z) >= 2))"


@query(
    "I9 I7 I10 I3",
    f"""SELECT p_partkey, round({_score_sql("a", "b")}, 9) AS score, round({_score_sql("a", "c")}, 9) AS written_out, regexp_matches(lower(n), '(^|[^a-z0-9])ring($|[^a-z0-9])') AS bounded
        FROM (SELECT p_partkey, n, {_tokens_sql("n")} AS a, {_tokens_sql("m")} AS b, [CASE z WHEN 'sm' THEN 'small' WHEN 'wdg' THEN 'widget' ELSE z END FOR z IN {_tokens_sql("m")}] AS c
              FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END AS n, CASE WHEN p_partkey % 2 = 0 THEN 'sm rings wdg' ELSE p_type || ' bold' END AS m FROM part))""",
)
def phrase_scores(spark, root):
    k = F.col("p_partkey")
    p = table(spark, root, "part", ["p_partkey", "p_name", "p_type"]).withColumn("n", F.concat("p_name", F.when(k % 3 == 0, "x").otherwise(""))).withColumn("m", F.when(k % 2 == 0, "sm rings wdg").otherwise(F.concat("p_type", F.lit(" bold"))))
    a, b = T.tokens_alnum(F.col("n")), T.tokens_alnum(F.col("m"))
    full = V.canonical_words(b, {"sm": "small", "wdg": "widget"})
    return p.select("p_partkey", F.round(T.phrase_score(a, b), 9).alias("score"), F.round(T.phrase_score(a, full), 9).alias("written_out"), T.bounded(F.col("n"), "ring").alias("bounded"))


@query(
    "I12 T27",
    r"""SELECT p_partkey, nullif(room, '') AS room, trim(regexp_replace(regexp_replace(l, '\b(?:[A-Za-z]{1,2}\d{2,4}[A-Za-z]?|\d{2,4}[A-Za-z]{0,2})\b', ' ', 'g'), '\s+', ' ', 'g')) AS kind, CASE WHEN room <> '' THEN p = lower(room) OR (length(p) = length(room) + 1 AND regexp_matches(p, '^[a-z]') AND substr(p, 2) = lower(room)) END AS near
        FROM (SELECT *, regexp_extract(l, '\b(?:[A-Za-z]{1,2}\d{2,4}[A-Za-z]?|\d{2,4}[A-Za-z]{0,2})\b', 0) AS room FROM
              (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type || ' ' || (p_partkey % 300) || ' ' || p_name END AS l, CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE '' END || (p_partkey % 300) AS p FROM part))""",
)
def location_parts(spark, root):
    k = F.col("p_partkey")
    n = (k % 300).cast("string")
    p = table(spark, root, "part", ["p_partkey", "p_name", "p_type"]).withColumn("l", F.when(k % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_type", n, "p_name"))).withColumn("p", F.concat(F.when(k % 2 == 0, "b").otherwise(""), n))
    d = p.withColumn("x", M.location_parts(F.col("l")))
    return d.select("p_partkey", "x.room", "x.kind", M.near_room(F.col("p"), F.lower("x.room")).alias("near"))


_PLACES = ("Grand Hotel", "Elementary School", "Tech Park Tower", "Baptist Church", "City Library", "River Lofts", "Sports Arena", "Plain Box")


@query(
    "I17 T24",
    "SELECT p_partkey, CASE "
    + " ".join(f"WHEN {_ANY('t', words)} THEN '{name}'" for name, words in W.BUILDING_TYPES)
    + f" END AS building_type FROM (SELECT p_partkey, lower({list(_PLACES)}[(p_partkey % {len(_PLACES)})::INT + 1] || ' ' || p_name) AS t FROM part)",
)
def building_types(spark, root):
    p = table(spark, root, "part", ["p_partkey", "p_name"])
    name = F.concat_ws(" ", F.array(*map(F.lit, _PLACES))[(F.col("p_partkey") % len(_PLACES)).cast("int")], "p_name")
    return p.select("p_partkey", V.building_type(name).alias("building_type"))


_HEADS = ("First Floor Plan Area B", "Mezzanine Bldg C", "ROOF LEVEL", "Level 2 - building q", "Attic", "Lower Level area d", "Details")
_LEVEL_SQL = "CASE " + " ".join(f"WHEN {_ANY('low', words)} THEN '{name}'" for name, words in W.LEVELS) + " END"
_RAW_SQL = "CASE " + " ".join(f"WHEN contains(low, '{w}') THEN substr(t, instr(low, '{w}'), {len(w)})" for _, words in W.LEVELS for w in words) + " END"
_CANONICAL_SQL = "CASE " + " ".join(f"WHEN contains(low, '{n}') THEN '{n}'" for n in W.CANONICAL_LEVELS) + " END"


@query(
    "I15 I16 I18 I23",
    rf"""SELECT p_partkey, {_LEVEL_SQL} AS level, {_RAW_SQL} AS raw, CASE WHEN regexp_matches(t, '(?i)\barea\s+[A-D]\b') THEN 'AREA ' || upper(regexp_extract(t, '(?i)\barea\s+([A-D])\b', 1)) END AS area,
          CASE WHEN regexp_matches(t, '(?i)\b(?:building|bldg)\s+[A-Z]\b') THEN 'BUILDING ' || upper(regexp_extract(t, '(?i)\b(?:building|bldg)\s+([A-Z])\b', 1)) END AS building, {_CANONICAL_SQL} AS canonical,
          CASE WHEN p_partkey % 4 = 0 OR p_partkey % 4 = 1 THEN 'spec' ELSE 'data' END AS file_type, upper(substr(p_type, 1, 1) || CASE WHEN p_partkey % 5 > 0 THEN substr(p_name, 1, 1) ELSE '' END) AS initials
        FROM (SELECT *, lower(t) AS low FROM (SELECT p_partkey, p_type, p_name, {list(_HEADS)}[(p_partkey % {len(_HEADS)})::INT + 1] || ' ' || p_name AS t FROM part))""",
)
def title_parts(spark, root):
    from drawlake.operators.labels import file_type

    k = F.col("p_partkey")
    p = table(spark, root, "part", ["p_partkey", "p_type", "p_name"]).withColumn("t", F.concat_ws(" ", F.array(*map(F.lit, _HEADS))[(k % len(_HEADS)).cast("int")], "p_name"))
    t = F.col("t")
    name = F.array(F.lit("10_14-signs.pdf"), F.lit("Sign_SPEC.pdf"), F.lit("plans.pdf"), F.lit("1 4.pdf"))[(k % 4).cast("int")]
    return p.select(
        "p_partkey", C.level(t).alias("level"), C.level_raw(t).alias("raw"), C.area(t).alias("area"), C.building(t).alias("building"), F.lower(C.canonical_level(t)).alias("canonical"), file_type(name).alias("file_type"),
        T.initials(F.col("p_type"), F.when(k % 5 > 0, F.col("p_name"))).alias("initials"),
    )


@query(
    "G14 G15",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'floor_plan' WHEN 1 THEN 'sign_schedule' WHEN 2 THEN 'sign_schedule' ELSE 'other' END AS section,
         CASE WHEN p_partkey % 7 = 0 THEN 'both' ELSE coalesce(CASE p_partkey % 3 WHEN 1 THEN 'floor_plan' END, CASE WHEN p_partkey % 2 = 0 THEN 'sign_schedule' END, CASE WHEN p_partkey % 7 = 1 THEN 'floor_plan' END, 'other') END AS type FROM part""",
)
def page_type_override(spark, root):
    k = F.col("p_partkey")
    title = F.array(F.lit("First Floor Plan"), F.lit("Signage Schedule"), F.lit("Life Safety"), F.lit("Roof Details"))[(k % 4).cast("int")]
    spatial = F.when(k % 3 == 1, "floor_plan").when(k % 3 == 2, "unknown")
    kind = C.overridden_type(spatial, F.when(k % 2 == 0, "sign_schedule"), F.when(k % 7 == 0, "both").when(k % 7 == 1, "floor_plan"))
    return table(spark, root, "part", ["p_partkey"]).select("p_partkey", C.section_type(title).alias("section"), kind.alias("type"))


@query(
    "G29 C21 G26",
    """SELECT * FROM (SELECT p_partkey // 50 AS job_id, arg_min(p_name, p_partkey) AS project_name, arg_min(p_type, p_partkey) FILTER (p_size > 25) AS building_type FROM part GROUP BY 1)
       JOIN (SELECT p_partkey // 50 AS job_id, upper(trim(p_brand)) AS code, max(p_partkey) AS entry_id FROM part GROUP BY 1, 2) USING (job_id)""",
)
def primary_files(spark, root):
    p = table(spark, root, "part", ["p_partkey", "p_name", "p_type", "p_size", "p_brand"]).withColumn("job_id", F.floor(F.col("p_partkey") / 50))
    files = p.select("job_id", F.col("p_partkey").alias("seq"), F.col("p_name").alias("project_name"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("building_type"))
    entries = p.select("job_id", F.col("p_partkey").alias("seq"), F.concat(F.lit(" "), F.lower("p_brand")).alias("type_code"), F.col("p_partkey").alias("entry_id"))
    return C.primary_metadata(files).join(C.last_entry(entries), "job_id")


@query(
    "A4 J2 A13 A14 J8 J1",
    """SELECT p_partkey, least(e, e + a * w, e + c * h, e + a * w + c * h) AS x0, greatest(f, f + b * w, f + d * h, f + b * w + d * h) AS y1, least(1.0, sqrt(8e6 / ((w * 40) * (h * 40)))) AS scale,
         CASE WHEN least(1000.0, e + w / 2 + greatest(w * 3, 64) / 2) - greatest(0.0, e + w / 2 - greatest(w * 3, 64) / 2) >= 4 AND least(800.0, f + h / 2 + greatest(h * 3, 64) / 2) - greatest(0.0, f + h / 2 - greatest(h * 3, 64) / 2) >= 4 THEN greatest(0.0, e + w / 2 - greatest(w * 3, 64) / 2) END AS crop_x0,
         CASE WHEN contains(p_name, ' ') THEN e + instr(p_name, ' ') * (w / length(p_name)) END AS tight_x0
       FROM (SELECT p_partkey, p_name, (p_partkey % 5 - 2) / 2 AS a, (p_partkey % 3 - 1) / 2 AS b, (p_partkey % 7 - 3) / 2 AS c, (p_partkey % 4 - 1) / 2 AS d, (p_partkey * 37 % 1200)::DOUBLE AS e, (p_partkey * 53 % 900)::DOUBLE AS f, (10 + p_size)::DOUBLE AS w, (5 + p_size)::DOUBLE AS h FROM part)""",
)
def box_geometry(spark, root):
    from drawlake.operators import geometry as G

    k = F.col("p_partkey")
    m = [(k % 5 - 2) / 2, (k % 3 - 1) / 2, (k % 7 - 3) / 2, (k % 4 - 1) / 2, (k * 37 % 1200).cast("double"), (k * 53 % 900).cast("double")]
    p = table(spark, root, "part", ["p_partkey", "p_name", "p_size"]).select("p_partkey", "p_name", F.array(*m).alias("m"), (F.col("p_size") + 10).cast("double").alias("w"), (F.col("p_size") + 5).cast("double").alias("h"))
    w, h, x, y = F.col("w"), F.col("h"), F.col("m")[4], F.col("m")[5]
    box = G.transformed_box(F.col("m"), w, h)
    crop = G.padded_crop(x, y, w, h, F.lit(1000.0), F.lit(800.0))
    rest = F.substring_index("p_name", " ", -1)
    tight = F.when(F.col("p_name").contains(" "), V.tight_box(x, x + w, F.col("p_name"), F.concat(F.lit(" "), rest)))
    return p.select("p_partkey", box["x0"].alias("x0"), box["y1"].alias("y1"), G.raster_scale(w * 40, h * 40).alias("scale"), crop["x0"].alias("crop_x0"), (tight["x0"] + w / F.length("p_name")).alias("tight_x0"))
