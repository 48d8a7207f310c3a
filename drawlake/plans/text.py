"""Text, classification, rule and retrieval queries over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import text as T
from drawlake.operators import classify as C
from drawlake.operators import joins as J
from drawlake.operators import knowledge as K
from drawlake.operators import rules as U
from drawlake.operators import vector_index as I
from drawlake.plans.registry import query
from drawlake.session import scratch
from drawlake.sources.tables import table


@query(
    "I2 B13",
    r"""WITH t AS (SELECT p_partkey, list_filter(regexp_split_to_array(replace(lower(p_name || ' ' || p_type), '''', ''), '[\s/\-_]+'), lambda x: length(x) > 0) AS ts, lower(p_name || ' ' || p_type) AS low FROM part),
       b AS (SELECT *, [ts[i] || ' ' || ts[i + 1] FOR i IN generate_series(1, len(ts) - 1)] AS bs FROM t)
       SELECT p_partkey, array_to_string(ts, ' ') AS tokens, array_to_string(bs, '|') AS pairs, list_has_any(ts, ['brass', 'tin']) OR list_has_any(bs, ['small plated', 'brass', 'tin']) OR contains(low, 'small plated') AS hit FROM b""",
)
def tokenise_bigrams(spark, root):
    p = table(spark, root, "part", ["p_partkey", "p_name", "p_type"]).withColumn("s", F.concat_ws(" ", "p_name", "p_type"))
    ts = T.tokens_spaced(F.col("s"))
    return p.select("p_partkey", F.array_join(ts, " ").alias("tokens"), F.array_join(T.bigrams(ts), "|").alias("pairs"), T.hits_set(F.col("s"), ["Brass", "Tin", "small plated"]).alias("hit"))


@query(
    "I3 I4 I11 H3",
    r"""SELECT c_custkey, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / greatest(len(a), len(b)) END, 6) AS overlap,
         round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM
       (SELECT c_custkey, list_distinct(list_filter(regexp_split_to_array(lower(c_name), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS a,
               list_distinct(list_filter(regexp_split_to_array(lower(c_mktsegment || ' customer'), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS b FROM customer)""",
)
def word_overlap(spark, root):
    c = table(spark, root, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    a, b = T.tokens_alnum(F.col("c_name")), T.tokens_alnum(F.concat_ws(" ", "c_mktsegment", F.lit("customer")))
    return c.select("c_custkey", F.round(T.word_overlap(a, b), 6).alias("overlap"), F.round(T.jaccard(a, b), 6).alias("jaccard"))


@query(
    "I8",
    """SELECT n_name, s_suppkey, round(1 - levenshtein(lower(n_name), lower(s_name)) / greatest(length(n_name), length(s_name)), 6) AS similarity FROM nation JOIN supplier ON n_nationkey = s_nationkey""",
)
def fuzzy_pairs_levenshtein(spark, root):
    n, s = table(spark, root, "nation", ["n_nationkey", "n_name"]), table(spark, root, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    d = n.join(s, n.n_nationkey == s.s_nationkey)
    return d.select("n_name", "s_suppkey", F.round(T.similarity(F.lower("n_name"), F.lower("s_name")), 6).alias("similarity"))


@query(
    "I14",
    r"""SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '')) AS title FROM pages""",
)
def regex_first_capture(spark, root):
    p = table(spark, root, "pages", ["page_id", "url", "html"])
    return p.select("page_id", T.first_capture(F.col("url"), ["^https?://([^/]+)"]).alias("host"), T.first_capture(F.col("html"), ["<title>([^<]*)</title>", "<h1>([^<]*)</h1>"]).alias("title"))


@query(
    "I5 I6 I22 I24 I28 J9",
    r"""SELECT c_custkey, regexp_replace(c_name, '[\s\-_]', '', 'g') AS bare, upper(regexp_replace(c_name, '[\s\-_.]', '', 'g')) AS sheet, substr(regexp_replace(upper(c_mktsegment), '\s+', '_', 'g'), 1, 5) AS slug,
         CASE WHEN length(c_name) > 10 THEN substr(c_name, 1, 10) || '…' ELSE c_name END AS short, regexp_replace(c_name, '[^a-zA-Z0-9]', '_', 'g') AS chunk_id, ceil(length(c_name) / 4)::BIGINT AS tokens FROM customer""",
)
def string_keys(spark, root):
    c = table(spark, root, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    n = F.col("c_name")
    return c.select("c_custkey", T.squeezed_id(n).alias("bare"), T.squeezed_id(n, ".").alias("sheet"), T.slug(F.col("c_mktsegment"), 5).alias("slug"), T.cut(n, 10).alias("short"), T.chunk_id(n).alias("chunk_id"), T.estimated_tokens(n).alias("tokens"))


@query(
    "J3 J4 J5 J6 J10",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN d < 0.1 THEN 1.0 WHEN d < 0.25 THEN 0.5 ELSE 0.0 END::DOUBLE AS near, floor((CASE WHEN l_returnflag = 'R' THEN 2 ELSE 3 END) / 5 * 10 + 0.5) / 10 AS confidence,
         CASE WHEN l_quantity > 1 AND l_quantity <= 100 THEN l_quantity / 100 ELSE greatest(0, least(1, l_quantity)) END AS fraction, floor(l_discount / 0.02 + 0.5)::BIGINT AS bucket
       FROM (SELECT *, sqrt(l_discount * l_discount + l_tax * l_tax) AS d FROM lineitem)""",
)
def numeric_steps(spark, root):
    l = table(spark, root, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax", "l_quantity", "l_returnflag"])
    fields = [F.lit("a"), F.lit("b"), F.when(F.col("l_returnflag") != "R", F.lit("c")), F.lit(None).cast("string"), F.lit("")]
    return l.select(
        "l_orderkey", "l_linenumber", "l_partkey", T.proximity(F.hypot("l_discount", "l_tax")).alias("near"), T.confidence(*fields).alias("confidence"),
        T.fraction(F.col("l_quantity")).alias("fraction"), F.floor(F.col("l_discount") / 0.02 + 0.5).alias("bucket"),
    )


_HAS = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def _classifier_sql() -> str:
    from drawlake.functions import vocab as W

    ignored = tuple(p for p in W.NOT_FLOOR_PLAN if p not in ("general notes", "abbreviation")) + W.IGNORED_PLANS
    bare = _HAS(W.FLOOR_PLAN).replace("contains(t", "contains(b")
    return rf"""SELECT title, CASE WHEN t = '' THEN 'other' WHEN {_HAS(W.SIGN_SCHEDULE + W.SCHEDULE_ALSO)} THEN 'signage_schedule' WHEN {_HAS(W.LIFE_SAFETY)} THEN 'life_safety' WHEN {_HAS(W.KEY_PLAN)} THEN 'key_plan'
      WHEN {_HAS(ignored)} THEN 'ignore' WHEN ({bare} OR regexp_matches(b, '\b\w+ level plan\b')) AND NOT {_HAS(W.NOT_FLOOR_PLAN)} THEN 'floor_plan' WHEN {_HAS(W.GENERAL_NOTES)} THEN 'general_notes'
      WHEN {_HAS(W.ACCESSIBILITY)} THEN 'accessibility' WHEN {_HAS(W.MILLWORK)} THEN 'millwork_interiors' WHEN {_HAS(W.SPECIFICATIONS)} THEN 'specifications' ELSE 'other' END AS bucket, n
    FROM (SELECT title, lower(trim(title)) AS t, regexp_replace(lower(trim(title)), '\b(?:see|per|ref(?:erence)?|refer\s+to|as\s+shown\s+on|shown\s+on)\s+floor\s+plan\b', '', 'g') AS b, count(*)::BIGINT AS n
      FROM (SELECT CASE p_size % 9 WHEN 0 THEN 'First Floor Plan ' WHEN 1 THEN 'Sign Schedule ' WHEN 2 THEN 'Roof ' WHEN 3 THEN 'General Notes ' WHEN 4 THEN 'See Floor Plan ' WHEN 5 THEN 'Upper Level Plan ' WHEN 6 THEN 'Key Plan ' WHEN 7 THEN 'Specs ' ELSE 'Casework ' END || p_type AS title FROM part) GROUP BY 1)"""


@query("G10 B11", _classifier_sql())
def case_classifier(spark, root):
    heads = ["First Floor Plan ", "Sign Schedule ", "Roof ", "General Notes ", "See Floor Plan ", "Upper Level Plan ", "Key Plan ", "Specs ", "Casework "]
    title = F.concat(F.array(*map(F.lit, heads))[F.col("p_size") % 9], F.col("p_type"))
    n = table(spark, root, "part", ["p_size", "p_type"]).groupBy(title.alias("title")).agg(F.count("*").alias("n"))
    return n.select("title", C.title_bucket(F.col("title")).alias("bucket"), "n")


@query(
    "G13",
    """SELECT doc_id, (contains(t, 'the') AND true)::INT + contains(t, 'license')::INT + contains(t, 'password')::INT AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)""",
)
def score_classifier(spark, root):
    d = table(spark, root, "documents", ["doc_id", "text"])
    return d.select("doc_id", C.score(F.col("text"), ("the", "license", "password")).alias("score"))


@query("K7", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type || ':' || coalesce(json_extract_string(props, '$.k'), '-') AS label FROM events""")
def json_extract(spark, root):
    e = table(spark, root, "events", ["event_id", "event_type", "props"]).withColumn("v", F.get_json_object("props", "$.k"))
    return e.select("event_id", F.col("v").try_cast("int").alias("k"), F.concat_ws(":", "event_type", F.coalesce("v", F.lit("-"))).alias("label"))


@query(
    "T16 D18",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN quality = 0 THEN 'poor' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN n_chars < 200 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS labels
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def label_arrays(spark, root):
    d = table(spark, root, "documents", ["doc_id", "lang", "n_chars"]).join(table(spark, root, "labels"), "doc_id", "left")
    flags = {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "foreign": F.col("lang") != "en", "short": F.col("n_chars") < 200}
    return d.select("doc_id", F.array_join(T.labels(flags), ",").alias("labels"))


@query(
    "",
    """SELECT doc_id, CASE WHEN quality IS NULL THEN 'custom' WHEN toxic = 1 THEN 'override' ELSE 'built-in' END AS origin, CASE WHEN n_chars >= 3000 THEN 'high' WHEN n_chars >= 1000 THEN 'middle' ELSE 'low' END AS band FROM documents LEFT JOIN labels USING (doc_id)""",
)
def provenance_case(spark, root):
    d = table(spark, root, "documents", ["doc_id", "n_chars"]).join(table(spark, root, "labels"), "doc_id", "left")
    return d.select("doc_id", F.when(F.col("quality").isNull(), "custom").when(F.col("toxic") == 1, "override").otherwise("built-in").alias("origin"), F.when(F.col("n_chars") >= 3000, "high").when(F.col("n_chars") >= 1000, "middle").otherwise("low").alias("band"))


@query(
    "I26",
    """SELECT c_custkey, coalesce(r, 'generic rules') AS rule FROM customer LEFT JOIN (VALUES (1, 'rules A'), (5, 'rules B'), (9, 'rules C')) s(k, r) ON c_nationkey = k""",
)
def rule_lookup(spark, root):
    dim = spark.sql("SELECT * FROM VALUES (1, 'rules A'), (5, 'rules B'), (9, 'rules C') AS s(c_nationkey, r)")
    d = J.lookup(table(spark, root, "customer", ["c_custkey", "c_nationkey"]), dim, ["c_nationkey"])
    return d.select("c_custkey", F.coalesce("r", F.lit("generic rules")).alias("rule"))


_ROOM_NAMES = ("OFFICE", "TENANT SUITE", "CONFERENCE", "MAIN LOBBY", "WOMEN RESTROOM", "STAIR", "STORAGE", "JANITOR CLOSET", "MECHANICAL", "ELECTRICAL", "CHAPEL", "ELEVATOR", "EXIT VESTIBULE", "PARKING", "CORRIDOR")


def _rooms(spark, root):
    """Parts as rooms: brands are files, sizes are levels and door counts, and a fixed list gives the names."""
    p = table(spark, root, "part", ["p_partkey", "p_brand", "p_size", "p_retailprice"])
    name = F.array(*map(F.lit, _ROOM_NAMES))[(F.col("p_partkey") % len(_ROOM_NAMES)).cast("int")]
    none = {f: F.lit(False) for f in ("is_restroom", "is_stair", "is_elevator", "is_corridor_or_hall", "is_vehicle_bay", "is_mep_unoccupied", "is_variable_use", "is_public_facing", "is_staff_only", "is_assembly", "is_office", "is_suite")}
    return p.select(
        F.concat_ws(":", "p_brand", (F.col("p_partkey") % 50).cast("string")).alias("file_id"), F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("room_number"), name.alias("room_name"),
        F.concat(F.lit("Level "), (F.col("p_size") % 4).cast("string")).alias("level"), F.lit(1).alias("pdf_page"), F.when(F.col("p_size") > 25, F.col("p_size") * 20).alias("occupant_load"),
        F.when(F.col("p_size") % 3 == 0, F.lit(2)).alias("door_count"), F.lit(None).cast("string").alias("zone_qualifier"), *[c.alias(f) for f, c in none.items()],
    )


def _rules_sql() -> str:
    names = "[" + ", ".join(f"'{n}'" for n in _ROOM_NAMES) + "]"
    return f"""WITH r AS (SELECT p_brand || ':' || (p_partkey % 50) AS file_id, p_partkey AS seq, {names}[(p_partkey % {len(_ROOM_NAMES)})::INT + 1] AS n, p_size AS s FROM part),
      q AS (SELECT file_id, seq, n,
        CASE n WHEN 'OFFICE' THEN CASE WHEN s % 3 = 0 THEN 2 ELSE 1 END WHEN 'TENANT SUITE' THEN 1 WHEN 'STORAGE' THEN 1 WHEN 'JANITOR CLOSET' THEN 1 WHEN 'CHAPEL' THEN CASE WHEN s % 3 = 0 THEN 2 ELSE 1 END WHEN 'CONFERENCE' THEN 0 WHEN 'CORRIDOR' THEN 0
          WHEN 'MAIN LOBBY' THEN 1 WHEN 'EXIT VESTIBULE' THEN 1 END AS room_id,
        CASE WHEN n = 'CONFERENCE' THEN CASE WHEN s % 3 = 0 THEN 2 ELSE 1 END END AS room_id_insert, CASE WHEN n = 'TENANT SUITE' THEN 1 END AS suite_id, CASE WHEN n = 'WOMEN RESTROOM' THEN 1 END AS restroom,
        CASE WHEN n IN ('MAIN LOBBY', 'EXIT VESTIBULE') THEN 1 WHEN n = 'CHAPEL' THEN CASE WHEN s > 25 AND s * 20 >= 1000 THEN 4 WHEN s > 25 AND s * 20 >= 500 THEN 3 ELSE 2 END END AS exits, CASE WHEN n = 'CHAPEL' THEN 1 END AS max_occupancy,
        CASE WHEN n = 'STAIR' THEN CASE WHEN s % 3 = 0 THEN 2 ELSE 1 END END AS stair_corridor,
        CASE WHEN n = 'ELEVATOR' AND row_number() OVER (PARTITION BY file_id, n ORDER BY seq) = 1 THEN 1 END AS in_case_of_fire, CASE WHEN n IN ('ELEVATOR', 'MAIN LOBBY', 'EXIT VESTIBULE') THEN 1 END AS evacuation_map FROM r)
      SELECT seq, room_id::INT AS room_id, room_id_insert::INT AS room_id_insert, suite_id::INT AS suite_id, restroom::INT AS restroom, exits::INT AS exits, max_occupancy::INT AS max_occupancy, stair_corridor::INT AS stair_corridor, in_case_of_fire::INT AS in_case_of_fire, evacuation_map::INT AS evacuation_map FROM q"""


@query("R1 R2 R3 R4 R5 R6 R7 R9 R10 R11 R12 R13", _rules_sql())
def rules_chain(spark, root):
    a = U.assign(_rooms(spark, root))
    return a.select("seq", "room_id", "room_id_insert", "suite_id", "restroom", F.col("exit").alias("exits"), "max_occupancy", "stair_corridor", "in_case_of_fire", "evacuation_map")


@query(
    "D13",
    "SELECT l_returnflag, kind, total FROM (SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1) UNPIVOT (total FOR kind IN (quantity, price))",
)
def unpivot_rows(spark, root):
    from drawlake.operators.aggregates import unpivot_sums

    l = table(spark, root, "lineitem", ["l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")])
    return unpivot_sums(l, ["quantity", "price"], ["l_returnflag"]).select("l_returnflag", "kind", F.round("total", 2).alias("total"))


_VECTOR = [round(((k * 37) % 19 - 9) / 9, 3) for k in range(64)]
_TOPK_SQL = f"""SELECT vec_id, label, round(1 + c, 6) / 2 AS score FROM (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]) AS c FROM embeddings WHERE {{where}}) ORDER BY c DESC, vec_id LIMIT {{n}}"""


def _topk(spark, root, n, keep=None):
    d = K.vector_query(table(spark, root, "embeddings"), _VECTOR, n, keep)
    return d.select("vec_id", "label", (F.round(F.col("score") * 2, 6) / 2).alias("score"))


@query("S4", _TOPK_SQL.format(where="true", n=10))
def vector_topk(spark, root):
    return _topk(spark, root, 10)


@query("S4", _TOPK_SQL.format(where="label IN (1, 3)", n=5))
def filtered_vector_topk(spark, root):
    return _topk(spark, root, 5, F.col("label").isin(1, 3))


_CHANGED = "(SELECT vec_id, label, CASE WHEN vec_id % 10 = 3 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings)"


def _vector_index(spark, root):
    """An index of all vectors in 16 cells; then those of every tenth come again, reversed, as an upsert."""
    v, path = table(spark, root, "embeddings", ["vec_id", "label", "embedding"]), scratch(spark, "vectors")
    I.build(v, path, 16)
    I.upsert(v.where("vec_id % 10 = 3").withColumn("embedding", F.reverse("embedding")), path, 1)
    return path


@query("S3 S4 A20", _TOPK_SQL.format(where="label <> 2", n=20).replace("FROM embeddings", f"FROM {_CHANGED}"))
def indexed_topk(spark, root):
    """The nearest rows from the index, after an upsert, of those that a filter keeps."""
    d = I.nearest(spark, _vector_index(spark, root), _VECTOR, 20, F.col("label") != 2)
    return d.select("vec_id", "label", (F.round(F.col("score") * 2, 6) / 2).alias("score"))


@query(
    "S4",
    f"""SELECT q_id, vec_id, rank FROM (SELECT q.vec_id AS q_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
       FROM {_CHANGED} v JOIN embeddings q ON q.vec_id % 20 = 0) WHERE rank <= 5""",
)
def indexed_topk_of_each(spark, root):
    """The five nearest rows of every vector whose id is divisible by 20, against all rows."""
    q = table(spark, root, "embeddings", ["vec_id", "embedding"]).where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vector"))
    return I.nearest_of_each(q, _vector_index(spark, root), 5).select("q_id", "vec_id", "rank")


@query(
    "S1 A10",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN source = 'src3' THEN 'missing section' END, CASE WHEN lang = 'fr' THEN 'invalid status' END, CASE WHEN n_chars > 5000 THEN 'invalid effective_date' END], lambda x: x IS NOT NULL), ', ') AS errors FROM documents""",
)
def metadata_validation(spark, root):
    d = table(spark, root, "documents", ["doc_id", "lang", "source", "n_chars"])
    head = F.concat(
        F.lit("---\njurisdiction: city\ndoc_type: 'city_codes'\nsection: "), F.when(F.col("source") == "src3", " ").otherwise(F.col("source")), F.lit("\neffective_date: "), F.when(F.col("n_chars") > 5000, "soon").otherwise("2024-01-31"),
        F.lit("\nstatus: "), F.when(F.col("lang") == "fr", "gone").otherwise('"active"'), F.lit("\n---\nbody"),
    )
    m = K.front_matter(d.withColumn("content", head))
    return m.select("doc_id", F.array_join(K.metadata_errors(F.col("metadata")), ", ").alias("errors"))


@query(
    "L5",
    """SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
)
def stream_tumbling(spark, root):
    """Events by the hour: the form that batch and stream share, here over the whole table."""
    from drawlake.streaming.events import tumbling_counts

    e = table(spark, root, "events", ["ts", "event_type", "value"]).withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "L6",
    """SELECT w AS start, count(*)::BIGINT AS n FROM (SELECT unnest(generate_series(date_trunc('minute', ts) - INTERVAL 59 MINUTE, date_trunc('minute', ts), INTERVAL 1 MINUTE)) AS w FROM events WHERE event_type = 'error') GROUP BY 1 HAVING count(*) > 1""",
)
def error_windows(spark, root):
    from drawlake.streaming.events import sliding_counts

    e = table(spark, root, "events", ["ts", "event_type"]).withColumn("ts", F.col("ts").cast("timestamp")).where("event_type = 'error'")
    return sliding_counts(e, 60).where("n > 1").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("L1 L5", "SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT ON (event_id) event_type, value FROM events) GROUP BY 1")
def stream_dedup(spark, root):
    """The events read as a stream, de-duplicated under a watermark and written once; the finished stream's rows by type."""
    from drawlake.session import scratch
    from drawlake.streaming.events import deduplicated, event_stream, run_to_end

    path = f"{root}/event[s].parquet"  # a pattern, as a stream reads folders or patterns
    out, state = scratch(spark, "events"), scratch(spark, "state")
    run_to_end(deduplicated(event_stream(spark, path, table(spark, root, "events")), ["event_id"], "3650 days"), out, state)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
