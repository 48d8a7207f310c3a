"""Model calls, answers, knowledge store, verifier and live-log queries over the standard tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from drawlake.functions import vocab as W
from drawlake.operators import knowledge as K
from drawlake.operators import models as M
from drawlake.operators import rules as U
from drawlake.operators import verify as V
from drawlake.operators import views as Z
from drawlake.plans.registry import query
from drawlake.plans.text import _ROOM_NAMES, _rooms, _rules_sql
from drawlake.session import scratch
from drawlake.sources import files as S
from drawlake.sources.tables import table


@dataclass(frozen=True)
class OddFails:
    """A stand-in that refuses prompts of odd length and answers others as the echo does."""

    def answer(self, kind: str, prompt: str) -> str:
        if len(prompt) % 2:
            raise ValueError("odd")
        return M.EchoClient().answer(kind, prompt)


@query("M1 T34", "SELECT * FROM (VALUES " + ", ".join(map(repr, M.CALL_TYPES)) + ") t(kind, reads, gives)")
def call_types(spark, root):
    return M.registry(spark)


def _turns(spark, root):
    """Conversations as files, turns as pages."""
    return table(spark, root, "conversations", ["conv_id", "turn", "text"]).select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("page"), "text")


#: Next-fit batches of a conversation's turns: up to 1500 characters, each turn cut at 600.
_BATCH_SQL = """t AS (SELECT conv_id AS file_id, turn + 1 AS page, substr(text, 1, 600) AS x, least(length(text), 600) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
b AS (SELECT file_id, page, x, n, i, 1 AS batch, n AS used FROM t WHERE i = 1
      UNION ALL SELECT t.file_id, t.page, t.x, t.n, t.i, CASE WHEN b.used + t.n > 1500 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.used + t.n > 1500 THEN t.n ELSE b.used + t.n END FROM b JOIN t ON t.file_id = b.file_id AND t.i = b.i + 1),
p AS (SELECT file_id, batch, min(page) AS first_page, string_agg('--- page ' || page || ' ---' || chr(10) || x, chr(10) ORDER BY page) AS prompt FROM b GROUP BY 1, 2)"""


def _prompts(spark, root):
    return M.batched_prompts(_turns(spark, root), 1500, 600)


@query("M3 M18 F-9", f"WITH RECURSIVE {_BATCH_SQL} SELECT file_id, batch::BIGINT AS batch, first_page, prompt FROM p")
def batched_prompts(spark, root):
    return _prompts(spark, root)


@query(
    "M2 M3 K3 K4 K6 T25",
    f"WITH RECURSIVE {_BATCH_SQL} SELECT file_id, batch::BIGINT AS batch, 'floor_plan_text' AS kind, length(prompt)::INT AS length, '---' AS first FROM p",
)
def text_answers(spark, root):
    called = M.call_model(_prompts(spark, root), "floor_plan_text", M.EchoClient())
    return M.answered_rows(called, "kind string, length int, first string").select("file_id", "batch", "kind", "length", "first")


@query(
    "M16 A21",
    f"WITH RECURSIVE {_BATCH_SQL} SELECT file_id AS job_id, 'callout_scan' AS call_type, ceil(length(prompt) / 4)::BIGINT AS prompt_tokens, length(prompt) % 2 = 0 AS ok, CASE WHEN length(prompt) % 2 = 1 THEN 'ValueError: odd' END AS error FROM p",
)
def call_logs(spark, root):
    called = M.call_model(_prompts(spark, root), "callout_scan", OddFails(), retries=0)
    return M.call_log(called, "callout_scan", "file_id").select("job_id", "call_type", "prompt_tokens", "ok", "error")


@query("M12", f"WITH RECURSIVE {_BATCH_SQL} SELECT file_id AS job_id, avg(length(prompt) % 2) AS failed FROM p GROUP BY 1 HAVING avg(length(prompt) % 2) > 0.4")
def failure_alerts(spark, root):
    called = M.call_model(_prompts(spark, root), "room_classification", OddFails(), retries=0)
    return M.failure_alert(called.withColumnRenamed("file_id", "job_id"), 0.4)


@query(
    "M6",
    """SELECT conv_id AS file_id, batch::BIGINT AS batch, first_page + p - 1 AS page FROM (SELECT conv_id, turn // 2 AS batch, min(turn // 2 * 2 + 1) AS first_page FROM conversations GROUP BY 1, 2), range(1, 3) r(p)""",
)
def remapped_callouts(spark, root):
    """Pages in calls of two; every call names its pages 0 to 3, of which the first two count."""
    b = M.page_batches(_turns(spark, root), 2).groupBy("file_id", "batch").agg(F.min("first_page").alias("first_page"))
    c = b.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return M.remapped_pages(c).select("file_id", "batch", "page")


@query("M11", "SELECT p_partkey, p_size * 400 AS occupant_load FROM part WHERE p_partkey % 4 > 0 AND p_size * 400 BETWEEN 0 AND 9999")
def valid_loads(spark, root):
    p = table(spark, root, "part", ["p_partkey", "p_size"])
    return M.valid_loads(p.select("p_partkey", F.when(F.col("p_partkey") % 4 > 0, F.lit("1")).alias("room_number"), (F.col("p_size") * 400).alias("occupant_load"))).select("p_partkey", "occupant_load")


@query("M17", "SELECT conv_id AS file_id, turn + 1 AS page FROM conversations WHERE conv_id % 3 = 0")
def unmarked_pages(spark, root):
    t = _turns(spark, root)
    return M.fallback_pages(t, t.select("file_id", F.when(F.col("file_id") % 3 > 0, F.col("page")).alias("page"))).select("file_id", "page")


@query(
    "M13",
    """SELECT sign_id, l_linenumber AS seq FROM (SELECT l_orderkey AS sign_id, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_linenumber) AS n
       FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
       JOIN (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 40 ORDER BY o_orderkey) AS i FROM orders) ON o_orderkey = l_orderkey WHERE i <= 20 AND q BETWEEN 0 AND 40) WHERE n <= 3""",
)
def located_doors(spark, root):
    """Orders as signs, 40 to a job; their lines as candidates, of which those off the page do not count."""
    l = table(spark, root, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"]).groupBy(F.col("l_orderkey").alias("sign_id"), F.col("l_linenumber").alias("seq")).agg(F.max("l_quantity").alias("confidence"))
    c = l.withColumn("x", F.col("confidence") / 40).withColumn("y", F.lit(0.5))
    signs = table(spark, root, "orders", ["o_orderkey"]).select(F.floor(F.col("o_orderkey") / 40).alias("job_id"), F.col("o_orderkey").alias("sign_id"))
    return M.located(c, signs).select("sign_id", "seq")


_PARSE = lambda n: "CASE n " + " ".join(f"WHEN {i} THEN '[' || array_to_string([props FOR i IN range({i})], ',') || ']'" for i in range(1, n + 1)) + " ELSE '[]' END"


@query(
    "K3 K4 K6",
    f"""SELECT event_id, {_PARSE(3)} AS rows FROM (SELECT event_id, replace(props, ' ', '') AS props, greatest(0, least(3, (m - 8) // (length(props) + 1))) AS n
        FROM (SELECT event_id, props, length(props) * 3 + 16 - event_id % (length(props) * 3 + 17) AS m FROM events))""",
)
def json_repair(spark, root):
    """Answers of three objects in a fence, cut off at every length: the complete objects are what is left."""
    e = table(spark, root, "events", ["event_id", "props"])
    answer = F.concat(F.lit("```json\n["), "props", F.lit(","), "props", F.lit(","), "props", F.lit("]\n```"))
    cut = F.substring(answer, F.lit(1), (F.length(answer) - F.col("event_id") % (F.length(answer) + 1)).cast("int"))
    return e.select("event_id", M.repaired(cut).alias("rows"))


@query(
    "K5",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[]' WHEN event_id % 100 >= 75 THEN '[{"confidence":' || CASE event_id % 100 WHEN 80 THEN '0.8' WHEN 90 THEN '0.9' ELSE '0.' || (event_id % 100) END || ',"id":' || event_id || '},{"confidence":1,"id":0}]' ELSE '[{"confidence":1,"id":0}]' END AS callouts FROM events""",
)
def recovered_callouts(spark, root):
    """Two objects among words, one of a doubtful confidence; every third answer has both broken."""
    k = F.col("event_id")
    conf = F.concat(F.lit("0."), F.lpad((k % 100).cast("string"), 2, "0"))
    close = F.when(k % 3 == 0, F.lit(" ")).otherwise(F.lit("}"))
    answer = F.concat(F.lit('I found {"id": '), k.cast("string"), F.lit(', "confidence": '), conf, close, F.lit(' and {"id": 0, "confidence": 1'), close, F.lit(" then {oops}"))
    return table(spark, root, "events", ["event_id"]).select("event_id", M.recovered(answer).alias("callouts"))


@query("K8", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN replace(props, ' ', '') ELSE '{"raw":"not ' || event_type || '"}' END AS answer FROM events""")
def parsed_or_wrapped(spark, root):
    e = table(spark, root, "events", ["event_id", "event_type", "props"])
    return e.select("event_id", M.parsed_or_wrapped(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("not "), "event_type"))).alias("answer"))


@query("K9", "SELECT event_id, user_id, 7 AS pages, event_type AS last FROM events")
def patched_stats(spark, root):
    e = table(spark, root, "events", ["event_id", "user_id", "event_type"]).withColumn("stats", F.struct("user_id", F.lit(0).alias("pages")))
    return e.select("event_id", Z.patched(F.col("stats"), {"pages": F.lit(7), "last": F.col("event_type")}).alias("s")).select("event_id", "s.*")


# Knowledge store.


def _notes(spark, root):
    """Documents as knowledge files; every fifth lacks its section, Spanish ones have a status that is none."""
    d = table(spark, root, "documents", ["doc_id", "lang", "text"])
    head = F.concat(
        F.lit("---\njurisdiction: 'city'\ndoc_type: city_codes\nsection: "), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("doc_id").cast("string")), F.lit("\neffective_date: 2024-01-31\nstatus: "),
        F.when(F.col("lang") == "es", "gone").otherwise("active"), F.lit("\n---\n"), "text",
    )
    return K.front_matter(d.select("doc_id", F.concat(F.lit("codes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), head.alias("content")))


@query(
    "S5 S1",
    "SELECT finding, count(*)::BIGINT AS n FROM (SELECT unnest(CASE WHEN len(e) = 0 THEN ['valid'] ELSE e END) AS finding FROM (SELECT list_filter([CASE WHEN doc_id % 5 = 0 THEN 'missing section' END, CASE WHEN lang = 'es' THEN 'invalid status' END], lambda x: x IS NOT NULL) AS e FROM documents)) GROUP BY 1",
)
def knowledge_report(spark, root):
    return K.validation_report(_notes(spark, root))


_TRIM = r"regexp_replace(regexp_replace({}, '^[\s\x0B\x{{a0}}\x{{feff}}]+', ''), '[\s\x0B\x{{a0}}\x{{feff}}]+$', '')"


def _chunk_sql(source: str) -> str:
    """Chunks of ``source(id, t)`` step by step: each cut is the sentence end nearest to 2000 characters, the next chunk begins 200 earlier."""
    ends = ", ".join("'" + e.replace("\n", "' || chr(10) || '") + "'" for e in W.SENTENCE_ENDS)
    return rf"""c AS (SELECT id, {_TRIM.format("regexp_replace(t, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS t FROM ({source})),
k(id, t, s, i, a, b) AS (SELECT id, t, 0::BIGINT, 0, NULL::BIGINT, NULL::BIGINT FROM c WHERE length(t) > 0
  UNION ALL SELECT id, t, CASE WHEN e >= length(t) THEN length(t) ELSE greatest(e - 200, s + 1) END, i + (length({_TRIM.format("substr(t, s + 1, e - s)")}) >= 50)::INT, s, e FROM
   (SELECT id, t, s, i, CASE WHEN s + 2000 >= length(t) THEN length(t) ELSE coalesce(list_sort(list_transform(list_filter(list_transform([{ends}], lambda z, n: {{'n': n, 'p':
       CASE WHEN instr(reverse(substr(t, s + 1801, 200 + length(z))), reverse(z)) > 0 THEN s + 1800 + length(substr(t, s + 1801, 200 + length(z))) - instr(reverse(substr(t, s + 1801, 200 + length(z))), reverse(z)) + 1 END}}), lambda y: y.p IS NOT NULL),
       lambda y: {{'d': abs(y.p - s - 2000), 'n': y.n, 'p': y.p}}))[1].p, s + 2000) END AS e FROM k WHERE s < length(t)))"""


@query("S2", f"""WITH RECURSIVE {_chunk_sql("SELECT doc_id AS id, coalesce(text, '') AS t FROM documents")} SELECT id AS doc_id, (i - 1)::INT AS chunk_index, a::INT AS start_char, b::INT AS end_char, (b - a)::INT AS n FROM k WHERE length({_TRIM.format("substr(t, a + 1, b - a)")}) >= 50""")
def chunk_text(spark, root):
    return K.chunks(table(spark, root, "documents", ["doc_id", "text"]), body="text", texts=False).withColumn("n", F.col("end_char") - F.col("start_char"))


@query(
    "S3 A20",
    f"""WITH RECURSIVE {_chunk_sql("SELECT doc_id AS id, coalesce(text, '') AS t FROM documents WHERE doc_id % 5 > 0 AND lang <> 'es'")}, r AS (SELECT 'codes_' || id || '_md_' || (i - 1) AS chunk_id, (b - a)::INT AS n FROM k WHERE length({_TRIM.format("substr(t, a + 1, b - a)")}) >= 50)
        SELECT chunk_id, n FROM r UNION ALL SELECT * FROM (SELECT 'codes_' || doc_id || '_md_0' AS chunk_id, -1 AS n FROM documents) WHERE chunk_id NOT IN (SELECT chunk_id FROM r)""",
)
def upserted_chunks(spark, root):
    """A store with a first chunk of every document, replaced and added to by the chunks of valid files."""
    n = _notes(spark, root)
    rows = K.chunk_rows(n, texts=False).select("chunk_id", (F.col("end_char") - F.col("start_char")).alias("n"))
    store = n.select(F.concat(F.lit("codes_"), F.col("doc_id").cast("string"), F.lit("_md_0")).alias("chunk_id"), F.lit(-1).alias("n"))
    return K.upserted(store, rows)


@query("A9 A10 T37", "SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'missing section' ELSE '' END AS errors, 'about ' || n_name AS body FROM nation")
def knowledge_folder(spark, root):
    """A file for each nation, written to a folder and read back."""
    path = scratch(spark, "knowledge")
    n = table(spark, root, "nation", ["n_nationkey", "n_name"])
    lines = F.concat(F.lit('---\njurisdiction: "x"\ndoc_type: city_codes\nsection: '), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("1"), F.lit("\neffective_date: 2024-01-31\nstatus: draft\nname: "), "n_name", F.lit("\n---\nabout "), "n_name")
    n.select(lines.alias("value"), "n_nationkey").coalesce(1).write.partitionBy("n_nationkey").text(path)
    m = K.front_matter(K.knowledge_files(spark, path))
    return m.select(F.try_element_at("metadata", F.lit("name")).alias("name"), F.array_join(K.metadata_errors(F.col("metadata")), ", ").alias("errors"), "body")


class Words:
    """A decoder of plain text: a word is an item, its place its number."""

    def items(self, content: bytes):
        for i, w in enumerate(content.decode().split()):
            yield 1, i, w, float(10 * i), 0.0, 8.0, 8.0, 100.0, 100.0


@query("A3 A4", "SELECT r_name, i::INT AS seq, w[i + 1] AS text, (i * 10)::DOUBLE AS x FROM (SELECT r_name, w, unnest(range(0, len(w))) AS i FROM (SELECT r_name, string_split('name ' || r_name || ' end', ' ') AS w FROM region))")
def decoded_items(spark, root):
    """A document for each region, written to a folder, opened and decoded to items."""
    path = scratch(spark, "documents")
    r = table(spark, root, "region", ["r_name"])
    r.select(F.concat(F.lit("name "), "r_name", F.lit(" end")).alias("value"), F.col("r_name").alias("region")).coalesce(1).write.partitionBy("region").text(path)
    items = S.raw_items(spark, path, Words(), "*.txt")
    return items.select(F.regexp_extract("file_id", "region=([^/]+)/", 1).alias("r_name"), "seq", "text", "x")


@query("A11", "SELECT r_name FROM region WHERE r_regionkey % 2 = 0")
def uploaded_files(spark, root):
    """Files of a landing folder, one for each region: every second is named as a PDF."""
    path = scratch(spark, "uploads")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in table(spark, root, "region", ["r_regionkey", "r_name"]).collect():  # regions are few by their nature
        out = fs.create(fs_path(f"{path}/{r['r_name']}.{'txt' if r['r_regionkey'] % 2 else 'PDF'}"))
        out.write(bytearray(b"content"))
        out.close()
    return S.uploads(spark, path).select(F.regexp_extract("path", r"/([^/]+)\.[A-Za-z]+$", 1).alias("r_name"))


# Verifier.

_ASSIGNED = f"""a AS (SELECT q.*, r.n, r.level FROM ({_rules_sql()}) q JOIN (SELECT p_partkey AS seq, 'Level ' || (p_size % 4) AS level, {list(_ROOM_NAMES)}[(p_partkey % {len(_ROOM_NAMES)})::INT + 1] AS n FROM part) r USING (seq))"""


@query(
    "V1 V2 V3 V4 V6 V7",
    f"""WITH {_ASSIGNED}, f AS (SELECT count(*) FILTER (coalesce(room_id, room_id_insert, suite_id, restroom, exits, max_occupancy, stair_corridor, in_case_of_fire, evacuation_map) IS NULL AND n NOT IN ('MECHANICAL', 'ELECTRICAL', 'PARKING', 'ELEVATOR')) AS incomplete,
          count(*) FILTER (n = 'STAIR') AS stairs, sum(stair_corridor) AS corridor, count(*) FILTER (max_occupancy > 0 AND coalesce(exits, 0) < 2) AS few, sum(in_case_of_fire) AS fire, count(*) FILTER (n = 'ELEVATOR') AS lifts, count(*) FILTER (n = 'CHAPEL' AND coalesce(max_occupancy, 0) = 0) AS empty FROM a),
        v AS (SELECT count(*) FILTER (NOT m) AS unmapped FROM (SELECT level, bool_or(coalesce(evacuation_map > 0, false)) AS m FROM a GROUP BY 1))
        SELECT c.check_id, c.severity, c.passed, c.found::BIGINT AS found, c.expected::BIGINT AS expected FROM (SELECT unnest([
          {{'check_id': 'V1', 'severity': 'error', 'passed': incomplete = 0, 'found': incomplete, 'expected': 0}}, {{'check_id': 'V2', 'severity': 'error', 'passed': true, 'found': stairs, 'expected': stairs}},
          {{'check_id': 'V2-corridor', 'severity': 'error', 'passed': stairs = 0 OR corridor > 0, 'found': corridor, 'expected': stairs}}, {{'check_id': 'V3', 'severity': 'error', 'passed': few = 0, 'found': few, 'expected': 0}},
          {{'check_id': 'V4', 'severity': 'error', 'passed': fire = lifts, 'found': fire, 'expected': lifts}}, {{'check_id': 'V6', 'severity': 'error', 'passed': empty = 0, 'found': empty, 'expected': 0}},
          {{'check_id': 'V7', 'severity': 'warning', 'passed': unmapped = 0, 'found': unmapped, 'expected': 0}}]) AS c FROM f, v)""",
)
def verify_checks(spark, root):
    return V.checks(U.assign(_rooms(spark, root)))


@query(
    "V5",
    f"""WITH {_ASSIGNED}, t AS (SELECT coalesce(sum(room_id), 0)::BIGINT AS room_id, coalesce(sum(room_id_insert), 0)::BIGINT AS room_id_insert, coalesce(sum(restroom), 0)::BIGINT AS restroom, coalesce(sum(exits), 0)::BIGINT AS exit, coalesce(sum(max_occupancy), 0)::BIGINT AS max_occupancy,
          coalesce(sum(stair_corridor), 0)::BIGINT AS stair_corridor, coalesce(sum(in_case_of_fire), 0)::BIGINT AS in_case_of_fire, coalesce(sum(evacuation_map), 0)::BIGINT AS evacuation_map, coalesce(sum(suite_id), 0)::BIGINT AS suite_id, count(*) FILTER (n = 'STAIR')::BIGINT AS stair_landing, count(*) FILTER (n = 'MAIN LOBBY')::BIGINT AS office_directory FROM a),
        u AS (UNPIVOT (SELECT * EXCLUDE (suite_id) FROM t) ON COLUMNS(*) INTO NAME kind VALUE total)
        SELECT kind, total FROM u WHERE total > 0 UNION ALL SELECT 'total_signs', (SELECT sum(total)::BIGINT FROM u) UNION ALL SELECT 'total_signs_incl_suite', (SELECT sum(total)::BIGINT FROM u) + (SELECT suite_id FROM t)""",
)
def sign_totals(spark, root):
    return V.summary(U.assign(_rooms(spark, root)))


# Live logs.


@query(
    "L6",
    """SELECT start, n / 5 AS per_minute, CASE WHEN n / 5 > 1 THEN 'critical' ELSE 'warning' END AS level FROM
       (SELECT unnest([date_trunc('minute', ts) - INTERVAL (i) MINUTE FOR i IN range(0, 5)]) AS start, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) WHERE n / 5 > 0.3""",
)
def error_alerts(spark, root):
    from drawlake.streaming.events import error_rates

    e = table(spark, root, "events", ["ts", "event_type"]).withColumn("ts", F.col("ts").cast("timestamp"))
    return error_rates(e, 5, 0.3, 1).select(F.col("start").cast("timestamp_ntz").alias("start"), "per_minute", "level")


@query("L2", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_snapshots(spark, root):
    """The events as a stream whose micro-batches write the last row of each user."""
    from drawlake.streaming.events import event_stream, latest_snapshots

    out, state = scratch(spark, "snapshots"), scratch(spark, "state")
    stream = event_stream(spark, f"{root}/event[s].parquet", table(spark, root, "events"))
    latest_snapshots(stream, "user_id", lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), state).awaitTermination()
    w = Window.partitionBy("user_id").orderBy(F.desc("batch"))
    return spark.read.parquet(out).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("user_id", "event_id")


@query(
    "L2 L5 L6",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE event_type = 'error' AND ts IS NOT NULL),
       r AS (SELECT user_id, t, sum(CASE WHEN p IS NULL OR t - p > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM e),
       i AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY t) AS i FROM r)
       SELECT user_id, make_timestamp(min(t)) AS opened, make_timestamp(min(CASE WHEN i = 2 THEN t END)) AS raised, make_timestamp(max(t)) AS last, count(*) AS n, CASE WHEN count(*) >= 4 THEN 'critical' ELSE 'warning' END AS level
       FROM i GROUP BY user_id, run HAVING count(*) >= 2 AND max(t) + 172800000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events) - 3600000000""",
)
def stream_alerts(spark, root):
    """A user's errors that follow within two days are an alert; those that the watermark has closed when the events end."""
    from drawlake.streaming.alerts import alerts, run_alerts
    from drawlake.streaming.events import event_stream

    out = scratch(spark, "alerts")
    stream = event_stream(spark, f"{root}/event[s].parquet", table(spark, root, "events"))
    run_alerts(alerts(stream, "user_id", 172_800, 2, 4), out, scratch(spark, "state"))
    d = spark.read.schema("user_id long, kind string, opened timestamp, raised timestamp, last timestamp, n long, level string").parquet(out).where("kind = 'closed'")
    return d.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("opened", "raised", "last")], "n", "level")
