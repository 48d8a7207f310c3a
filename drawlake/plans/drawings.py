"""Drawing queries: glyphs, phrases, zones, titles, schedules, rooms and sign places (sections 2.7 to 2.12 of the survey).

Parts stand for what is drawn: 50 of them are a file of two pages, and each is a phrase of one. Places and texts follow
from the part's number, so that SQL can lay the same drawings out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import vocab as W
from drawlake.operators import classify as C
from drawlake.operators import geometry as G
from drawlake.operators import labels as L
from drawlake.operators import matching as M
from drawlake.operators import models as O
from drawlake.operators import rooms as R
from drawlake.operators import schedule as H
from drawlake.operators import views as V
from drawlake.operators import windows as N
from drawlake.plans.registry import query
from drawlake.plans.screens import _SIGNS_SQL, _signs
from drawlake.plans.screens import _ANY, _score_sql, _tokens_sql
from drawlake.sources.tables import table

#: What phrases say; ``#`` stands for a number.
_TEXTS = (
    "OFFICE", "#", "CONFERENCE / C#", "Stair", "12'-6\"", "FLOOR PLAN", "2", "doors", "B#", "WOMEN RR", "Mechanical", "SIGN SCHEDULE", "A-101", "1/8 = 1", "LOBBY", "EXIT", "3", "Storage Closet of the long west wing here", "Level 2", "ROOF FRAMING PLAN",
)


def _phrases(spark, root):
    k = F.col("p_partkey")
    p = table(spark, root, "part", ["p_partkey"])
    text = F.array(*map(F.lit, _TEXTS))[((k * 7 + F.floor(k / 50)) % len(_TEXTS)).cast("int")]
    p = p.select(F.floor(k / 50).alias("file_id"), (k % 2 + 1).cast("int").alias("page"), k.alias("seq"), F.regexp_replace(text, "#", (k % 40 + 100).cast("string")).alias("text"), F.when(k % 4 == 1, 0.5).otherwise((k * 37 % 90) / 100).alias("x0"), F.when(k % 4 == 1, (k % 50) * 0.014).otherwise((k * 53 % 95) / 100).alias("y0"))
    tall = F.when(F.col("seq") % 9 == 0, 0.035).otherwise(0.0125)
    return p.select("file_id", "page", "seq", "text", "x0", "y0", (F.col("x0") + 0.05).alias("x1"), (F.col("y0") + tall).alias("y1"), F.lit(1000.0).alias("page_width"), F.lit(800.0).alias("page_height"))


_Q = lambda s: s.replace("'", "''")
_PHRASES_SQL = (
    "p AS (SELECT *, x0 + 0.05 AS x1, y0 + CASE WHEN seq % 9 = 0 THEN 0.035 ELSE 0.0125 END AS y1, (x0 + (x0 + 0.05)) / 2 AS cx, (y0 + (y0 + CASE WHEN seq % 9 = 0 THEN 0.035 ELSE 0.0125 END)) / 2 AS cy FROM (SELECT p_partkey // 50 AS file_id, (p_partkey % 2 + 1)::INT AS page, p_partkey AS seq, "
    + "replace(["
    + ", ".join(f"'{_Q(t)}'" for t in _TEXTS)
    + f"][((p_partkey * 7 + p_partkey // 50) % {len(_TEXTS)})::INT + 1], '#', (p_partkey % 40 + 100)::VARCHAR) AS text, CASE WHEN p_partkey % 4 = 1 THEN 0.5 ELSE (p_partkey * 37 % 90) / 100 END::DOUBLE AS x0, CASE WHEN p_partkey % 4 = 1 THEN (p_partkey % 50) * 0.014::DOUBLE ELSE (p_partkey * 53 % 95) / 100 END::DOUBLE AS y0 FROM part))"
)
_TITLE = "((cx > 0.60 AND cy > 0.60) OR cy > 0.80 OR cx > 0.75)"


def _items(spark, root):
    """Parts as glyph runs: 50 a file, one page, in rows of ten."""
    k = F.col("p_partkey")
    p = table(spark, root, "part", ["p_partkey", "p_name"])
    n = F.col("p_partkey") % 50
    return p.select(
        F.floor(k / 50).alias("file_id"), F.lit(1).alias("page"), k.alias("seq"), F.when(k % 11 > 0, F.expr("substring(p_name, 1, cast(1 + p_partkey % 4 AS int))")).otherwise(" ").alias("text"), ((n % 10) * 20 + k * 3 % 7).cast("double").alias("x"),
        (F.floor(n / 10) * 12 + k % 3).cast("double").alias("y"), (F.lit(10) + k % 9).cast("double").alias("w"), F.lit(8.0).alias("h"), F.lit(400.0).alias("page_width"), F.lit(100.0).alias("page_height"),
    )


_GLYPHS_SQL = """i AS (SELECT p_partkey // 50 AS f, p_partkey AS seq, CASE WHEN p_partkey % 11 > 0 THEN substr(p_name, 1, 1 + (p_partkey % 4)::INT) ELSE ' ' END AS t, ((p_partkey % 50 % 10) * 20 + p_partkey * 3 % 7)::DOUBLE AS x, ((p_partkey % 50 // 10) * 12 + p_partkey % 3)::DOUBLE AS y, (10 + p_partkey % 9)::DOUBLE AS w FROM part),
l AS (SELECT *, sum(CASE WHEN y - py <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY f ORDER BY y, x, seq) AS line FROM (SELECT *, lag(y) OVER (PARTITION BY f ORDER BY y, x, seq) AS py FROM i WHERE trim(t) <> '')),
o AS (SELECT *, lag(x) OVER z AS px, lag(w) OVER z AS pw, lag(y) OVER z AS qy, lag(t) OVER z AS pt, row_number() OVER z AS ord FROM l WINDOW z AS (PARTITION BY f ORDER BY line, x, seq)),
j AS (SELECT *, coalesce(abs(y - qy) <= 5 AND x - px - pw < least(1.2 * pw, 4 * pw / greatest(length(pt), 1)), false) AS joins, (length(t) > 1 AND length(pt) > 1) OR x - px - pw > 0.3 * pw AS blank FROM o),
g AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY f ORDER BY ord) AS n FROM j),
m AS (SELECT f AS file_id, n::BIGINT AS seq, string_agg(CASE WHEN joins AND blank THEN ' ' || t ELSE t END, '' ORDER BY ord) AS text, least(1, greatest(0, min(x / 400))) AS x0, least(1, greatest(0, max((y + 8) / 100))) AS y1 FROM g GROUP BY 1, 2)"""


@query("G1 A5 F-7 J1", f"WITH {_GLYPHS_SQL} SELECT * FROM m")
def glyph_phrases(spark, root):
    return G.merged_glyphs(_items(spark, root)).select("file_id", "seq", "text", "x0", "y1")


@query("A6", f"WITH {_GLYPHS_SQL} SELECT file_id, string_agg(text, ' ' ORDER BY seq) AS text FROM m GROUP BY 1")
def page_texts(spark, root):
    return G.page_text(G.merged_glyphs(_items(spark, root))).select("file_id", "text")


_SCORE = lambda words: "(" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + ")"


@query(
    "T23 G13 A6",
    f"""WITH {_PHRASES_SQL}, x AS (SELECT file_id, page, lower(string_agg(text, ' ' ORDER BY seq)) AS t FROM p GROUP BY 1, 2), s AS (SELECT *, {_SCORE(W.FLOOR_PLAN)} AS plan, {_SCORE(W.SIGN_SCHEDULE)} AS sched FROM x)
        SELECT file_id, page, CASE WHEN regexp_matches(t, 'legend:|(?:signage|symbol|drawing|life safety) legend|symbol key') AND plan < 10 THEN 'other' WHEN sched > 0 THEN 'sign_schedule' WHEN plan >= 4 THEN 'floor_plan' ELSE 'other' END AS type FROM s""",
)
def page_text_types(spark, root):
    return G.page_text(_phrases(spark, root)).select("file_id", "page", C.page_text_type(F.col("text")).alias("type"))


@query(
    "G8",
    f"WITH {_PHRASES_SQL} SELECT seq, {_TITLE} AS block, cy > 0.90 AS strip, (x0 <= 0.72 OR y0 <= 0.82) AND cx BETWEEN 0.04 AND 0.96 AND cy BETWEEN 0.04 AND 0.96 AS drawing FROM p",
)
def title_zones(spark, root):
    return _phrases(spark, root).select("seq", G.in_title_block().alias("block"), G.in_title_strip().alias("strip"), G.in_drawing().alias("drawing"))


_TABLE_SQL = """b AS (SELECT *, floor(x0 / 0.02 + 0.5) AS bin FROM d), gp AS (SELECT *, (y0 - lag(y0) OVER (PARTITION BY file_id, page, bin ORDER BY y0, seq)) * 800 AS gap FROM b),
co AS (SELECT file_id, page, bin, count(*) AS n, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS xs FROM gp GROUP BY 1, 2, 3),
tb AS (SELECT * FROM co WHERE n >= 6 AND xs[len(xs) // 2 + 1] > 0 AND len([g FOR g IN xs IF abs(g - xs[len(xs) // 2 + 1]) > 15]) = 0),
dr AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.file_id = b.file_id AND tb.page = b.page AND tb.bin = b.bin))"""


@query("G7 G28 G8", f"WITH {_PHRASES_SQL}, d AS (SELECT * FROM p WHERE NOT {_TITLE}), {_TABLE_SQL} SELECT seq FROM dr")
def drawing_phrases(spark, root):
    return V.drawing_phrases(_phrases(spark, root)).select("seq")


@query(
    "G6",
    f'WITH {_PHRASES_SQL} SELECT seq, sum(CASE WHEN cx - px < 0.08 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id, page ORDER BY cx, seq)::BIGINT AS "column" FROM (SELECT *, lag(cx) OVER (PARTITION BY file_id, page ORDER BY cx, seq) AS px FROM p)',
)
def column_split(spark, root):
    return G.columns(_phrases(spark, root)).select("seq", "column")


_SHEET = r"\b([A-Z]{1,2}[-.]?\d{1,3}(?:\.\d{1,2})?)\b"


@query("T22", rf"WITH {_PHRASES_SQL} SELECT file_id, page, arg_min(regexp_extract(text, '{_SHEET}', 1), seq) AS sheet_number FROM p WHERE {_TITLE} AND regexp_extract(text, '{_SHEET}', 1) <> '' GROUP BY 1, 2")
def sheet_numbers(spark, root):
    return V.sheet_number(_phrases(spark, root))


_PLAN = lambda c: f"({_ANY(c, W.FLOOR_PLAN)} OR regexp_matches({c}, '{W.LEVEL_PLAN}'))"


@query(
    "G12",
    f"""WITH {_PHRASES_SQL}, q AS (SELECT *, lower(text) AS t FROM p), g AS (SELECT file_id, page, coalesce(lower(string_agg(text, ' ' ORDER BY seq) FILTER ({_TITLE})), '') AS z,
          coalesce(bool_or({_TITLE} AND ({_PLAN("t")} OR {_ANY("t", W.SIGN_SCHEDULE)}) AND {_ANY("t", W.NOT_FLOOR_PLAN + W.HARD_DISCIPLINES)}), false) AS veto FROM q GROUP BY 1, 2)
        SELECT file_id, page, CASE WHEN veto THEN 'unknown' WHEN {_PLAN("z")} AND {_ANY("z", W.SIGN_SCHEDULE)} THEN 'both' WHEN {_ANY("z", W.SIGN_SCHEDULE)} THEN 'sign_schedule' WHEN {_PLAN("z")} THEN 'floor_plan' ELSE 'unknown' END AS type FROM g""",
)
def spatial_page_types(spark, root):
    return V.spatial_page_type(_phrases(spark, root))


# Room labels.

_NOT_LABEL = lambda c: f"regexp_matches({c}, '{_Q(W.NOT_A_LABEL)}')"
_KINDS_SQL = f"""h AS (SELECT *, trim(text) AS t, (y1 - y0) * 800 AS height FROM p WHERE NOT (x0 > 0.72 AND y0 > 0.82)),
hn AS (SELECT *, regexp_matches(t, '{W.ROOM_NUMBER}') AS is_number,
  length(t) BETWEEN 2 AND 40 AND regexp_matches(t, '[A-Za-z]') AND NOT {_NOT_LABEL("t")} AND NOT regexp_matches(upper(t), '^[A-Z]{{1,2}}[-/]\\d{{2,4}}$') AND NOT regexp_matches(t, '{W.ROOM_NUMBER}') AND height BETWEEN 4 AND 20 AND len(string_split(t, ' ')) <= 6 AS is_name,
  CASE WHEN regexp_matches(t, '^(.+?)\\s*/\\s*([A-Za-z0-9\\-]+)\\s*$') AND length(trim(regexp_extract(t, '^(.+?)\\s*/\\s*([A-Za-z0-9\\-]+)\\s*$', 1))) >= 2 AND NOT {_NOT_LABEL("trim(regexp_extract(t, '^(.+?)\\s*/\\s*([A-Za-z0-9\\-]+)\\s*$', 1))")}
    THEN upper(trim(regexp_extract(t, '^(.+?)\\s*/\\s*([A-Za-z0-9\\-]+)\\s*$', 1))) END AS s_name, upper(regexp_extract(t, '^(.+?)\\s*/\\s*([A-Za-z0-9\\-]+)\\s*$', 2)) AS s_number FROM h)"""


@query("I20 I21", f"WITH {_PHRASES_SQL}, {_KINDS_SQL} SELECT seq, is_number, is_name, s_name, CASE WHEN s_name IS NOT NULL THEN s_number END AS s_number FROM hn")
def label_kinds(spark, root):
    p = _phrases(spark, root).where("NOT (x0 > 0.72 AND y0 > 0.82)").withColumn("s", L.slash_label(F.col("text")))
    return p.select("seq", (L.likely_number(F.col("text"))).alias("is_number"), L.likely_name(F.col("text"), (F.col("y1") - F.col("y0")) * F.col("page_height")).alias("is_name"), F.col("s.name").alias("s_name"), F.col("s.number").alias("s_number"))


def _greedy_sql(pairs: str, group: str, left: str, right: str, score: str) -> str:
    """Recursive CTE: a group's left rows in order take their best free candidate."""
    return f"""gc AS (SELECT {group}, {left} AS l, list({{'s': -{score}, 'r': {right}, 'v': {score}}} ORDER BY -{score}, {right}) AS c, row_number() OVER (PARTITION BY {group} ORDER BY {left}) AS i FROM ({pairs}) GROUP BY {group}, {left}),
gr AS (SELECT {group}, i, l, c[1] AS b, [c[1].r] AS used FROM gc WHERE i = 1
  UNION ALL SELECT {", ".join(f"gc.{x.strip()}" for x in group.split(","))}, gc.i, gc.l, list_filter(gc.c, lambda y: NOT list_contains(gr.used, y.r))[1], list_append(gr.used, list_filter(gc.c, lambda y: NOT list_contains(gr.used, y.r))[1].r)
  FROM gr JOIN gc ON {" AND ".join(f"gr.{x.strip()} = gc.{x.strip()}" for x in group.split(","))} AND gc.i = gr.i + 1)"""


@query(
    "C9 C10",
    f"""WITH RECURSIVE {_greedy_sql("SELECT l_orderkey, l_partkey, l_suppkey, ((l_partkey * 7 + l_suppkey * 13) % 10)::DOUBLE AS score FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) USING (l_orderkey) WHERE (l_partkey * 7 + l_suppkey * 13) % 10 >= 4", "l_orderkey", "l_partkey", "l_suppkey", "score")}
        SELECT l_orderkey, l AS l_partkey, b.r AS l_suppkey, b.v AS score FROM gr WHERE b IS NOT NULL""",
)
def greedy_match(spark, root):
    """One-to-one pairs of the parts and suppliers of an order, best score first; the score is made up from the keys, not from words."""
    from drawlake.operators.joins import greedy_members

    l = table(spark, root, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey"])
    return greedy_members(l, ["l_orderkey"], "l_partkey", "l_suppkey", lambda part, supplier: F.pmod(part * 7 + supplier * 13, F.lit(10)), 4)


_REACH_SQL = """rg AS (SELECT file_id, page, cy - lag(cy) OVER (PARTITION BY file_id, page ORDER BY cy, seq) AS gap FROM hn WHERE is_name),
rm AS (SELECT file_id, page, count(*) AS n, list_sort(list(gap) FILTER (gap > 0)) AS xs FROM rg GROUP BY 1, 2),
rc AS (SELECT file_id, page, CASE WHEN n >= 3 AND len(xs) > 0 THEN xs[len(xs) // 2 + 1] END AS mid FROM rm),
re AS (SELECT file_id, page, coalesce(greatest(0.03, least(0.15, mid * 1.5)), 0.06) AS vert, coalesce(greatest(0.06, least(0.25, mid * 2.5)), 0.12) AS horiz FROM rc)"""
_DIGITS = "TRY_CAST(regexp_extract({}, '^(\\d+)', 1) AS INTEGER)"


def _door_sql() -> str:
    """Door words with a count among the two phrases above or below."""
    near = lambda f, k: f"CASE WHEN abs({f}(cy, {k}) OVER dw - cy) <= vert AND {_DIGITS.format(f'{f}(t, {k}) OVER dw')} BETWEEN 1 AND 20 THEN {_DIGITS.format(f'{f}(t, {k}) OVER dw')} END"
    return f"""dc AS (SELECT file_id, page, seq, cx, cy, t, coalesce({near("lag", 2)}, {near("lag", 1)}, {near("lead", 1)}, {near("lead", 2)}) AS cnt FROM hn JOIN re USING (file_id, page) WINDOW dw AS (PARTITION BY file_id, page ORDER BY cy, seq)),
dd AS (SELECT * FROM dc WHERE lower(t) IN ({", ".join(f"'{w}'" for w in W.DOOR_WORDS)}) AND cnt IS NOT NULL)"""


_PAIRS = """SELECT n.file_id, n.page, n.seq, m.seq AS n_seq, -sqrt((n.cx - m.cx) * (n.cx - m.cx) + (n.cy - m.cy) * (n.cy - m.cy)) AS closeness FROM hn n JOIN re USING (file_id, page) JOIN hn m ON n.file_id = m.file_id AND n.page = m.page
  WHERE n.is_name AND n.s_name IS NULL AND m.is_number AND m.height BETWEEN 4 AND 20 AND abs(n.cy - m.cy) < vert AND abs(n.cx - m.cx) < horiz"""


@query(
    "G19 C14 I21",
    f"""WITH RECURSIVE {_PHRASES_SQL}, {_KINDS_SQL}, {_REACH_SQL}, {_door_sql()}, {_greedy_sql(_PAIRS, "file_id, page", "seq", "n_seq", "closeness")},
        nu AS (SELECT gr.l AS seq, upper(hn.t) AS near_number FROM gr JOIN hn ON hn.seq = gr.b.r),
        dh AS (SELECT n.seq, arg_min(dd.cnt, (dd.cy, dd.seq)) AS door_count FROM hn n JOIN re USING (file_id, page) JOIN dd ON dd.file_id = n.file_id AND dd.page = n.page WHERE n.is_name AND abs(dd.cy - n.cy) < vert AND abs(dd.cx - n.cx) < horiz GROUP BY 1)
        SELECT seq, coalesce(s_name, upper(t)) AS room_name, coalesce(CASE WHEN s_name IS NOT NULL THEN s_number END, near_number) AS room_number, CASE WHEN s_name IS NOT NULL THEN 0.85 WHEN near_number IS NOT NULL THEN 0.75 ELSE 0.6 END::DOUBLE AS extraction_confidence,
               CASE WHEN s_name IS NULL THEN door_count END AS door_count FROM hn LEFT JOIN nu USING (seq) LEFT JOIN dh USING (seq) WHERE is_name""",
)
def room_labels(spark, root):
    return L.room_labels(_phrases(spark, root)).select("seq", "room_name", "room_number", "extraction_confidence", "door_count")


def _drawn_rooms(spark, root):
    """Parts as rooms of two pages a file."""
    k = F.col("p_partkey")
    p = table(spark, root, "part", ["p_partkey", "p_size", "p_type"])
    names = F.array(*map(F.lit, _ROOMS))
    return p.select(
        F.floor(k / 50).alias("file_id"), k.alias("seq"), (k % 2 + 1).cast("int").alias("pdf_page"), names[(k * 3 % len(_ROOMS)).cast("int")].alias("room_name"), F.when(k % 3 > 0, F.concat(F.lit("r"), (k % 60).cast("string"))).alias("room_number"), F.concat(F.lit("L"), (k % 2).cast("string")).alias("level"),
        F.when(k % 4 > 0, F.col("p_size")).alias("occupant_load"), F.when(k % 5 == 0, F.concat(F.lit("A-"), (k % 4).cast("string"))).alias("occupancy_group"), F.when(k % 7 > 0, (k * 37 % 100) / 100).alias("x"), F.when(k % 7 > 0, (k * 53 % 100) / 100).alias("y"), ((k % 10) / 10).alias("extraction_confidence"),
    )


_ROOMS = ("OFFICE", "WOMEN TOILET", "STAIR 2", "ELEV LOBBY", "JAN", "MEN RR", "ELECTRICAL", "TRAINING STORAGE", "STAFF LOUNGE", "101A", "XY", "SUITE 200", "VEST", "COMMUNITY", "QUIET CORNER", "GARAGE BAY")
_ROOMS_SQL = f"""r AS (SELECT p_partkey // 50 AS file_id, p_partkey AS seq, (p_partkey % 2 + 1)::INT AS pdf_page, {list(_ROOMS)}[(p_partkey * 3 % {len(_ROOMS)})::INT + 1] AS room_name, CASE WHEN p_partkey % 3 > 0 THEN 'r' || (p_partkey % 60) END AS room_number, 'L' || (p_partkey % 2) AS level,
  CASE WHEN p_partkey % 4 > 0 THEN p_size END AS occupant_load, CASE WHEN p_partkey % 5 = 0 THEN 'A-' || (p_partkey % 4) END AS occupancy_group, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey * 37 % 100) / 100 END AS x, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey * 53 % 100) / 100 END AS y, (p_partkey % 10) / 10 AS extraction_confidence FROM part)"""
_UP = lambda words: "(" + " OR ".join(f"contains(upper(room_name), '{w.upper()}')" for w in words) + ")"
_WORD = lambda words: "regexp_matches(room_name, '(?i)\\b(?:" + "|".join(w.replace("-", "\\-") for w in words) + ")\\b')"
_MEP = f"({_UP(W.LABEL_MEP)} AND coalesce(occupant_load, 0) = 0)"
_FLAGS = {
    "is_restroom": f"{_UP(W.LABEL_RESTROOM)} OR {_WORD(W.LABEL_RESTROOM_WORDS)}", "is_stair": "starts_with(upper(room_name), 'STAIR')", "is_elevator": _UP(W.LABEL_ELEVATOR), "is_vestibule": _UP(W.LABEL_VESTIBULE), "is_corridor_or_hall": _UP(W.LABEL_CORRIDOR),
    "is_vehicle_bay": _UP(W.LABEL_VEHICLE), "is_mep_unoccupied": _MEP, "is_variable_use": f"{_WORD(W.LABEL_VARIABLE_WORDS)} AND NOT {_MEP} AND NOT {_UP(W.LABEL_STORAGE)}", "is_public_facing": _UP(W.LABEL_PUBLIC), "is_staff_only": _UP(W.LABEL_STAFF),
    "is_assembly": "coalesce(regexp_matches(occupancy_group, '^A[-\\s]?[0-9]'), false) OR coalesce(occupant_load >= 50, false)", "is_office": _UP(W.OFFICE), "is_suite": _UP(W.SUITE), "is_residential_unit": f"regexp_matches(trim(room_name), '{W.RESIDENTIAL_UNIT}')",
}
_FLAGS_SQL = "f AS (SELECT *, " + ", ".join(f"({c}) AS {n}" for n, c in _FLAGS.items()) + " FROM r)"
_SHORT = "upper(regexp_replace(room_name, '\\s+', '', 'g'))"
_AMBIGUOUS = f"(NOT is_residential_unit AND (extraction_confidence < 0.5 OR (length({_SHORT}) < 4 AND {_SHORT} NOT IN ({', '.join(repr(w) for w in W.KNOWN_SHORT)})) OR NOT ({' OR '.join(n for n in _FLAGS if n not in ('is_office', 'is_suite', 'is_residential_unit'))})))"


@query("G21 G22 I13", f"WITH {_ROOMS_SQL}, {_FLAGS_SQL} SELECT seq, {', '.join(_FLAGS)}, {_AMBIGUOUS} AS ambiguous FROM f")
def label_flags(spark, root):
    d = R.label_flags(_drawn_rooms(spark, root))
    return d.select("seq", *_FLAGS, R.ambiguous().alias("ambiguous"))


@query(
    "M12 G22",
    f"""WITH {_ROOMS_SQL}, {_FLAGS_SQL} SELECT seq, ((row_number() OVER (PARTITION BY file_id ORDER BY seq) - 1) // 20)::BIGINT AS batch FROM f WHERE {_AMBIGUOUS} AND file_id % 2 = 0""",
)
def rooms_to_ask(spark, root):
    d = R.label_flags(_drawn_rooms(spark, root))
    manifest = d.select("file_id", F.when(F.col("file_id") % 2 == 0, "life_safety").otherwise("other").alias("bucket"))
    return O.asks_for_rooms(d, manifest).select("seq", "batch")


@query(
    "C12",
    f"""WITH {_ROOMS_SQL}, {_FLAGS_SQL}, k AS (SELECT a.seq, o.*, row_number() OVER (PARTITION BY a.seq ORDER BY sqrt((a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y)), o.seq) AS n FROM f a JOIN f o ON a.file_id = o.file_id AND a.pdf_page = o.pdf_page WHERE a.is_restroom AND a.x IS NOT NULL AND NOT o.is_restroom AND o.x IS NOT NULL),
        s AS (SELECT seq, bool_and(is_office OR is_mep_unoccupied OR is_staff_only) AND NOT bool_or(is_public_facing OR is_assembly) AS staff FROM k WHERE n <= 1 GROUP BY 1)
        SELECT seq, is_staff_only OR coalesce(staff, false) AS is_staff_only, is_public_facing AND NOT coalesce(staff, false) AS is_public_facing FROM f LEFT JOIN s USING (seq)""",
)
def staff_only_rooms(spark, root):
    return R.staff_only_by_neighbours(R.label_flags(_drawn_rooms(spark, root)), 1).select("seq", "is_staff_only", "is_public_facing")


@query(
    "C15",
    f"WITH {_ROOMS_SQL}, w AS (SELECT upper(room_number) AS n, arg_max(occupant_load, seq) AS load FROM r WHERE seq % 2 = 0 AND room_number IS NOT NULL AND occupant_load IS NOT NULL GROUP BY 1) SELECT seq, coalesce(load, occupant_load) AS occupant_load FROM r LEFT JOIN w ON upper(room_number) = n",
)
def rooms_with_loads(spark, root):
    r = _drawn_rooms(spark, root)
    return R.with_loads(r, r.where("seq % 2 = 0 AND room_number IS NOT NULL AND occupant_load IS NOT NULL").select("seq", "room_number", "occupant_load")).select("seq", "occupant_load")


@query("T17", f"WITH {_ROOMS_SQL} SELECT seq, count(*) OVER (PARTITION BY file_id, level, room_name)::BIGINT AS group_size FROM r WHERE room_number IS NULL")
def duplicate_rooms(spark, root):
    return R.duplicate_rooms(_drawn_rooms(spark, root)).select("seq", "group_size")


@query(
    "G20",
    f"""WITH RECURSIVE {_ROOMS_SQL}, d AS (SELECT file_id, pdf_page, list({{'seq': seq, 'x': x, 'y': y, 'c': extraction_confidence}} ORDER BY seq) AS xs FROM r WHERE x IS NOT NULL GROUP BY 1, 2),
        k AS (SELECT file_id, pdf_page, xs, 2 AS i, [xs[1]] AS kept FROM d
          UNION ALL SELECT file_id, pdf_page, xs, i + 1, CASE WHEN h IS NULL THEN list_append(kept, xs[i]) WHEN xs[i].c > kept[h].c THEN list_concat(list_append(kept[1:h - 1], xs[i]), kept[h + 1:]) ELSE kept END
          FROM (SELECT *, list_filter(range(1, len(kept) + 1), lambda j: (kept[j].x - xs[i].x) * (kept[j].x - xs[i].x) + (kept[j].y - xs[i].y) * (kept[j].y - xs[i].y) < 0.1 * 0.1)[1] AS h FROM k WHERE i <= len(xs)))
        SELECT unnest(kept).seq AS seq FROM k WHERE i = len(xs) + 1""",
)
def deduplicated_rooms(spark, root):
    r = _drawn_rooms(spark, root).where("x IS NOT NULL").select("file_id", "pdf_page", "seq", "x", "y", "extraction_confidence")
    return R.deduplicated(r, 0.1).select("seq")


@query(
    "C11",
    rf"""WITH {_PHRASES_SQL}, {_ROOMS_SQL}, z AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM p WHERE (y1 - y0) * 800 > 20 AND (y1 - y0) * 800 <= 36 AND regexp_matches(trim(text), '[A-Za-z]') AND length(trim(text)) BETWEEN 3 AND 30 AND NOT regexp_matches(trim(text), '{W.ROOM_NUMBER}') AND NOT (x0 > 0.72 AND y0 > 0.82)),
        n AS (SELECT r.seq, arg_min({{'t': upper(trim(z.text)), 'd': sqrt((r.x - cx) * (r.x - cx) + (r.y - cy) * (r.y - cy)), 'm': 2 * greatest(w, h)}}, (sqrt((r.x - cx) * (r.x - cx) + (r.y - cy) * (r.y - cy)), z.seq)) AS b FROM r JOIN z ON r.file_id = z.file_id AND r.pdf_page = z.page WHERE r.x IS NOT NULL GROUP BY 1)
        SELECT r.seq, CASE WHEN b.d <= b.m THEN b.t END AS zone_qualifier FROM r LEFT JOIN n USING (seq) WHERE r.x IS NOT NULL""",
)
def zone_qualifiers(spark, root):
    return R.zone_qualifiers(_drawn_rooms(spark, root).where("x IS NOT NULL"), L.zone_anchors(_phrases(spark, root))).select("seq", "zone_qualifier")


_LABEL_SQL = f"""c AS (SELECT *, length(text) < 8 AS small, lower(text) IN ({', '.join("'" + _Q(w) + "'" for w in W.ROOM_WORDS)}) AS word FROM (SELECT file_id, page, seq, trim(text) AS text, cx, cy FROM dr) WHERE NOT regexp_matches(text, '^[0-9\\s\\-_/().,''"]+$') AND NOT (regexp_matches(text, '[''"/]') AND regexp_matches(text, '[0-9]'))
  AND NOT regexp_matches(text, '^[A-Z][0-9]{{1,3}}$') AND (length(text) > 3 OR (length(text) = 3 AND lower(text) IN ({', '.join(f"'{w}'" for w in W.ROOM_ABBREVIATIONS)})))),
e AS (SELECT a.file_id, a.page, a.seq AS a, b.seq AS b, row_number() OVER (PARTITION BY a.file_id, a.page ORDER BY a.seq, b.seq) AS n FROM c a JOIN c b ON a.file_id = b.file_id AND a.page = b.page AND b.seq > a.seq
  WHERE (b.cx - a.cx) * 1000 > 0 AND (b.cx - a.cx) * 1000 <= 200 AND abs(b.cy - a.cy) * 800 <= 60 AND ((a.small AND b.small) OR a.word OR (a.small AND b.word))),
w AS (SELECT file_id, page, 0::BIGINT AS n, CAST([] AS BIGINT[]) AS used, NULL::BIGINT AS a, NULL::BIGINT AS b FROM e GROUP BY 1, 2
  UNION ALL SELECT file_id, page, n, CASE WHEN free THEN list_concat(used, [a, b]) ELSE used END, CASE WHEN free THEN a END, CASE WHEN free THEN b END
  FROM (SELECT e.*, w.used, NOT list_contains(w.used, e.a) AND NOT list_contains(w.used, e.b) AS free FROM w JOIN e ON e.file_id = w.file_id AND e.page = w.page AND e.n = w.n + 1)),
j AS (SELECT a, b FROM w WHERE a IS NOT NULL)"""


@query(
    "G9",
    f"""WITH RECURSIVE {_PHRASES_SQL}, d AS (SELECT * FROM p WHERE NOT {_TITLE}), {_TABLE_SQL}, {_LABEL_SQL} SELECT c.seq, concat_ws(' ', c.text, o.text) AS text, CASE WHEN o.seq IS NULL THEN c.cx ELSE (c.cx + o.cx) / 2 END AS x, CASE WHEN o.seq IS NULL THEN c.cy ELSE (c.cy + o.cy) / 2 END AS y
        FROM c LEFT JOIN j ON j.a = c.seq LEFT JOIN c o ON o.seq = j.b WHERE c.seq NOT IN (SELECT b FROM j)""",
)
def joined_labels(spark, root):
    """Labels of all drawings, at a wider reach than usual: these phrases stand apart."""
    return L.label_candidates(_phrases(spark, root), dx=200.0, dy=60.0).select("seq", "text", "x", "y")


# Sign places.

_LOCATED_SQL = _SIGNS_SQL.replace("p_name AS location", "replace([" + ", ".join(f"'{_Q(t)}'" for t in _TEXTS) + f"][(p_partkey * 3 % {len(_TEXTS)})::INT + 1], '#', (p_partkey % 40 + 100)::VARCHAR) || CASE WHEN p_partkey % 5 = 0 THEN ' wing' ELSE '' END AS location")
_BEST_SQL = f"""pt AS (SELECT *, {_tokens_sql("text")} AS tt FROM p),
q AS (SELECT file_id, page_number AS page, sign_id, {_tokens_sql("location")} AS qt, lower(sign_identifier) AS num FROM s WHERE x_pos IS NULL AND page_number IS NOT NULL AND location IS NOT NULL),
sc AS (SELECT sign_id, seq, cx, cy, greatest({_score_sql("qt", "tt")}, CASE WHEN list_contains(tt, num) THEN 0.85 ELSE 0 END) AS score FROM q JOIN pt USING (file_id, page)),
be AS (SELECT sign_id, arg_min({{'x': cx, 'y': cy}}, (-score, seq)) AS b FROM sc WHERE score >= 0.5 GROUP BY 1)"""


@query("G23 G25 I9", f"WITH {_PHRASES_SQL}, {_LOCATED_SQL}, {_BEST_SQL} SELECT sign_id, coalesce(x_pos, b.x) AS x_pos, coalesce(y_pos, b.y) AS y_pos FROM s LEFT JOIN be USING (sign_id)")
def filled_coordinates(spark, root):
    return V.filled_coordinates(_located_signs(spark, root), _phrases(spark, root)).select("sign_id", "x_pos", "y_pos")


def _located_signs(spark, root):
    """Signs whose locations name what the phrases say."""
    k = F.col("sign_id")
    text = F.array(*map(F.lit, _TEXTS))[(k * 3 % len(_TEXTS)).cast("int")]
    return _signs(spark, root).withColumn("location", F.concat(F.regexp_replace(text, "#", (k % 40 + 100).cast("string")), F.when(k % 5 == 0, " wing").otherwise("")))


_PASSES_SQL = f"""sg AS (SELECT file_id, page_number AS page, sign_id, lower(regexp_replace(sign_identifier, '[\\s\\-_]', '', 'g')) AS id, {_tokens_sql("location")} AS w, lower(regexp_extract(location, '{M.ROOM_TOKEN}', 0)) AS room FROM s WHERE page_number IS NOT NULL),
ph AS (SELECT file_id, page, seq, cx, cy, lower(regexp_replace(text, '[\\s\\-_]', '', 'g')) AS sq, {_tokens_sql("text")} AS tt FROM p),
pr AS (SELECT *, {_score_sql("w", "tt")} AS sc, CASE WHEN len(list_distinct(list_concat(w, tt))) = 0 THEN 0 ELSE len(list_intersect(w, tt)) / len(list_distinct(list_concat(w, tt))) END AS ja FROM sg JOIN ph USING (file_id, page)),
ha AS (SELECT *, CASE WHEN length(id) >= 2 AND sq = id THEN {{'n': 1, 's': 1.0::DOUBLE}} WHEN len(w) > 0 AND ja >= 0.4 THEN {{'n': 2, 's': ja::DOUBLE}} WHEN room <> '' AND sq = room THEN {{'n': 3, 's': 0.85::DOUBLE}} WHEN sc >= 0.65 THEN {{'n': 4, 's': sc::DOUBLE}}
  WHEN room <> '' AND (sq = room OR (length(sq) = length(room) + 1 AND regexp_matches(sq, '^[a-z]') AND substr(sq, 2) = room)) THEN {{'n': 5, 's': 0.75::DOUBLE}} WHEN sc >= 0.6 THEN {{'n': 6, 's': sc::DOUBLE}} END AS h FROM pr),
mt AS (SELECT sign_id, arg_min({{'n': h.n, 's': h.s, 'x': cx, 'y': cy}}, (h.n, -h.s, seq)) AS b FROM ha WHERE h IS NOT NULL GROUP BY 1)"""


def _matched(spark, root):
    s = _located_signs(spark, root).where("page_number IS NOT NULL")
    return M.matched(s.select("file_id", F.col("page_number").alias("page"), "sign_id", F.col("sign_identifier").alias("identifier"), "sign_type", "location"), _phrases(spark, root))


@query("G24 I3", f'WITH {_PHRASES_SQL}, {_LOCATED_SQL}, {_PASSES_SQL} SELECT sign_id, b.n AS "pass", round(b.s, 9) AS score, b.x AS x, b.y AS y FROM mt')
def sign_places(spark, root):
    return _matched(spark, root).select("sign_id", "pass", F.round("score", 9).alias("score"), "x", "y")


_PLACED_SQL = "pl AS (SELECT s.*, CASE WHEN x_pos IS NOT NULL AND y_pos IS NOT NULL THEN x_pos WHEN b IS NOT NULL THEN greatest(0.02, least(0.98, b.x)) ELSE 0.5 END AS x, CASE WHEN x_pos IS NOT NULL AND y_pos IS NOT NULL THEN y_pos WHEN b IS NOT NULL THEN greatest(0.02, least(0.98, b.y + 0.03)) ELSE 0.5 END AS y, CASE WHEN x_pos IS NOT NULL AND y_pos IS NOT NULL THEN 1.0 ELSE coalesce(b.s, 0.0) END AS score FROM s LEFT JOIN mt USING (sign_id))"


@query("T1 T2", f"WITH {_PHRASES_SQL}, {_LOCATED_SQL}, {_PASSES_SQL}, {_PLACED_SQL} SELECT sign_id, x, y, round(score, 9) AS score FROM pl WHERE coalesce(page_number, 1) = 1 OR (x_pos IS NULL AND page_number = 2)")
def page_markers(spark, root):
    """Markers of every first page: its own signs, and unplaced ones of the second, which counts as a schedule."""
    d = M.placed(M.signs_of_page(_located_signs(spark, root), 1, [2]), _matched(spark, root))
    return d.select("sign_id", "x", "y", F.round("score", 9).alias("score"))


_CROWD_SQL = """WITH RECURSIVE c AS (SELECT p_partkey // 50 AS file_id, (p_partkey % 2 + 1)::INT AS page, p_partkey AS seq, (CASE WHEN p_partkey % 3 = 0 THEN 0.975 ELSE 0.4 END + p_partkey * 7 % 13 * 0.004)::DOUBLE AS x, (0.5 + p_partkey * 11 % 17 * 0.004)::DOUBLE AS y,
  CASE WHEN p_partkey % 7 = 0 THEN 1.0 WHEN p_partkey % 11 = 0 THEN 0.0 WHEN p_partkey % 23 > 0 THEN 0.8 END::DOUBLE AS score, row_number() OVER (PARTITION BY p_partkey // 50, p_partkey % 2 ORDER BY p_partkey) AS n FROM part),
w AS (SELECT file_id, page, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::DOUBLE AS x, NULL::DOUBLE AS y, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS solid FROM c GROUP BY 1, 2
 UNION ALL SELECT file_id, page, n, seq, q.x, q.y, CASE WHEN coalesce(score, 0) = 0 THEN solid ELSE list_append(solid, {'x': q.x, 'y': q.y}) END FROM (
  SELECT *, CASE WHEN d > 0.001 THEN {'x': least(0.98, greatest(0.02, x + (x - f.x) * (0.012 - d) / d)), 'y': least(0.98, greatest(0.02, y + (y - f.y) * (0.012 - d) / d))} ELSE {'x': x, 'y': y} END AS q FROM (
   SELECT *, CASE WHEN coalesce(score, 0) NOT IN (0, 1) THEN sqrt((x - f.x) * (x - f.x) + (y - f.y) * (y - f.y)) END AS d FROM (
    SELECT c.*, w.solid, list_filter(w.solid, lambda o: sqrt((c.x - o.x) * (c.x - o.x) + (c.y - o.y) * (c.y - o.y)) < 0.012)[1] AS f FROM w JOIN c ON c.file_id = w.file_id AND c.page = w.page AND c.n = w.n + 1))))
SELECT seq, round(x, 9) AS x, round(y, 9) AS y FROM w WHERE n > 0"""


@query("T3", _CROWD_SQL)
def nudged_markers(spark, root):
    """Parts as crowded markers, 50 on the two pages of a file; some are stored, some are ghosts."""
    k = F.col("p_partkey")
    p = table(spark, root, "part", ["p_partkey"])
    x = F.when(k % 3 == 0, 0.975).otherwise(0.4) + k * 7 % 13 * 0.004
    score = F.when(k % 7 == 0, 1.0).when(k % 11 == 0, 0.0).when(k % 23 > 0, 0.8)
    m = p.select(F.floor(k / 50).alias("file_id"), (k % 2 + 1).cast("int").alias("page"), k.alias("seq"), x.alias("x"), (F.lit(0.5) + k * 11 % 17 * 0.004).alias("y"), score.alias("score"))
    return G.nudged(m).select("seq", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("T4", f"WITH {_PHRASES_SQL}, {_LOCATED_SQL}, {_PASSES_SQL}, {_PLACED_SQL} SELECT sign_id, x, y FROM pl WHERE x_pos IS NULL AND y_pos IS NULL AND score >= 0.5")
def written_back(spark, root):
    return M.written_back(M.placed(_located_signs(spark, root), _matched(spark, root)))


_CLUSTER_SQL = """ca AS (SELECT s.sign_id, s.rn, a.seq AS s1, a.cx AS x1, a.cy AS y1, p.seq AS s2, p.cx AS x2, p.cy AS y2, sqrt((a.cx - p.cx) * (a.cx - p.cx) + (a.cy - p.cy) * (a.cy - p.cy)) AS dist FROM cs s JOIN p a ON a.file_id = s.file_id AND a.page = s.page AND contains(lower(a.text), s.st)
  JOIN p ON p.file_id = s.file_id AND p.page = s.page AND lower(p.text) = s.rn AND p.seq <> a.seq),
cb AS (SELECT *, row_number() OVER z AS n, lead(dist) OVER z AS nx FROM ca WHERE dist <= 0.6 WINDOW z AS (PARTITION BY sign_id ORDER BY dist, s1, s2)),
cl AS (SELECT sign_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, coalesce(nx - dist <= 0.02, false) AS ambiguous FROM cb WHERE n = 1)"""
_CS_SQL = "cs AS (SELECT file_id, page_number AS page, sign_id, CASE WHEN sign_id % 4 < 2 THEN 'stair' ELSE 'exit' END AS st, (sign_id % 40 + 100)::VARCHAR AS rn FROM s WHERE page_number IS NOT NULL)"


def _clusters(spark, root):
    k = F.col("sign_id")
    s = _signs(spark, root).where("page_number IS NOT NULL").select("file_id", F.col("page_number").alias("page"), "sign_id", F.when(k % 4 < 2, "STAIR").otherwise("EXIT").alias("sign_type"), (k % 40 + 100).cast("string").alias("room_number"))
    return G.clusters(_phrases(spark, root), s, 0.6)


@query("C22", f"WITH {_PHRASES_SQL}, {_SIGNS_SQL}, {_CS_SQL}, {_CLUSTER_SQL} SELECT sign_id, x, y, ambiguous FROM cl")
def type_and_number(spark, root):
    return _clusters(spark, root)


@query(
    "T5",
    f"""WITH {_PHRASES_SQL}, {_SIGNS_SQL}, {_CS_SQL}, {_CLUSTER_SQL}, td AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sign_id) AS n FROM s WHERE x_pos IS NULL AND NOT starts_with(lower(location), 'red')) WHERE n <= 20)
        SELECT td.sign_id, CASE WHEN cl.sign_id IS NULL THEN 'failed' ELSE 'applied' END AS outcome FROM td LEFT JOIN cl ON cl.sign_id = td.sign_id AND NOT ambiguous""",
)
def auto_located(spark, root):
    """Signs of red things count as those of residential units here, which are never located."""
    s = _signs(spark, root).withColumn("location", F.when(F.col("location").startswith("red"), F.concat(F.lit("Unit "), "location")).otherwise(F.col("location")))
    return M.auto_located(_clusters(spark, root), s).select("sign_id", "outcome")


# Schedules, titles and intake.


def _schedule_items(spark, root):
    """Ten lines a file: a header, a room, sign rows, the type legend, keynotes and a diagram's label; a word is an item."""
    k = F.col("p_partkey")
    p = table(spark, root, "part", ["p_partkey", "p_name", "p_size"])
    n, word = k % 10, F.substring_index("p_name", " ", 1)
    size = F.col("p_size").cast("string")
    line = (
        F.when(n == 0, "SIGNAGE SCHEDULE")
        .when(n == 1, F.concat(F.lit("ROOM "), (k % 90 + 100).cast("string")))
        .when(n == 2, F.concat_ws(" ", F.lit("12A"), size, word, F.lit("YES"), F.lit("A")))
        .when(n == 3, F.concat_ws(" ", F.lit("7b"), F.lit("3"), word, F.lit("B,A")))
        .when(n == 4, "SIGN TYPE LEGEND")
        .when(n == 5, F.concat(F.lit('12A 6" x 8" '), word, F.lit(" raised")))
        .when(n == 6, "KEYNOTE LEGEND")
        .when(n == 7, F.concat(F.lit("A "), word, F.lit(" mount")))
        .when(n == 8, "A second text")
        .otherwise("SIGN TYPE 7B")
    )
    d = p.select(F.floor(k / 10).alias("file_id"), F.lit(1).alias("page"), F.lit(1).alias("column"), n.alias("line"), F.posexplode(F.split(line, " ")).alias("i", "text"))
    return d.select("file_id", "page", "column", (F.col("line") * 100 + F.col("i")).alias("seq"), "text", (F.col("i") * 30.0).alias("x"), (F.col("line") * 12.0 + F.col("i") % 2).alias("y"), F.lit(20.0).alias("w"), F.lit(8.0).alias("h"))


def _parsed(spark, root):
    return H.parsed(H.lines(_schedule_items(spark, root)))


_WORD1 = "string_split(p_name, ' ')[1]"
_PER_FILE = f"f AS (SELECT p_partkey // 10 AS file_id, max(CASE WHEN p_partkey % 10 = 1 THEN p_partkey % 90 + 100 END) AS room, max(CASE WHEN p_partkey % 10 = 5 THEN {_WORD1} END) AS material, max(CASE WHEN p_partkey % 10 = 7 THEN {_WORD1} END) AS note, count(*) FILTER (p_partkey % 10 = 9) AS drawn FROM part GROUP BY 1)"


@query(
    "G2 G16 G17 E9",
    f"""WITH {_PER_FILE}, r AS (SELECT p_partkey // 10 AS file_id, p_partkey % 10 AS n, p_size, {_WORD1} AS w FROM part WHERE p_partkey % 10 IN (2, 3))
        SELECT file_id, CASE n WHEN 2 THEN '12A' ELSE '7B' END AS code, CASE n WHEN 2 THEN p_size ELSE 3 END AS quantity, w AS signage_text, CASE n WHEN 2 THEN true END AS glass_backer, CASE n WHEN 2 THEN 'A' ELSE 'B,A' END AS raw_comments, room::VARCHAR AS room_number,
          'second text' AS expanded_comments, CASE n WHEN 2 THEN '6" x 8"' END AS dimensions, CASE n WHEN 2 THEN material END AS material FROM r JOIN f USING (file_id)""",
)
def schedule_entries(spark, root):
    d = H.entries(_parsed(spark, root))
    return d.select("file_id", "code", "quantity", "signage_text", "glass_backer", "raw_comments", "room_number", "expanded_comments", "dimensions", "material")


@query("E9 G17", f"WITH {_PER_FILE} SELECT file_id, '12A' AS code, material, false AS has_drawing FROM f UNION ALL SELECT file_id, '7B', NULL, true FROM f WHERE drawn > 0")
def schedule_specs(spark, root):
    return H.specs(_parsed(spark, root)).select("file_id", "code", "material", "has_drawing")


@query("T20 T26", "SELECT 'SIGNAGE SCHEDULE' AS table_name, '12A,7B' AS codes, count(*)::BIGINT AS rows FROM part WHERE p_partkey % 10 IN (2, 3)")
def codes_by_table(spark, root):
    return H.codes_by_table(H.entries(_parsed(spark, root))).select("table_name", F.array_join("codes", ",").alias("codes"), "rows")


@query("T26 G16", "SELECT p_partkey // 10 AS file_id, CASE p_partkey % 10 WHEN 0 THEN 'schedule' WHEN 4 THEN 'type_legend' WHEN 6 THEN 'keynote_legend' ELSE 'diagram' END AS opens FROM part WHERE p_partkey % 10 IN (0, 4, 6, 9)")
def schedule_sections(spark, root):
    return _parsed(spark, root).where("opens IS NOT NULL").select("file_id", "opens")


_TITLES = ("First Floor Plan", "Signage Schedule", "Life Safety Plan", "Roof Plan", "Mezzanine", "General Notes", "", "Level 2 - Upper Level Plan")


def _bucket_sql(t: str, n: str) -> str:
    """The title classifier over a lowered title and a sheet's number."""
    has = lambda words: _ANY(t, words)
    ignored = tuple(p for p in W.NOT_FLOOR_PLAN if p not in ("general notes", "abbreviation")) + W.IGNORED_PLANS
    plan = f"(({_ANY(t, W.FLOOR_PLAN)} OR regexp_matches({t}, '{W.LEVEL_PLAN}')) AND NOT {has(W.NOT_FLOOR_PLAN)})"
    number = f"(regexp_matches({n}, '{W.FLOOR_PLAN_SHEET}') AND len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')) < 6 AND NOT {has(W.SHEET_ONLY_VETO)})"
    return f"""CASE WHEN {t} = '' THEN 'other' WHEN {has(W.SIGN_SCHEDULE + W.SCHEDULE_ALSO)} THEN 'signage_schedule' WHEN {has(W.LIFE_SAFETY)} THEN 'life_safety' WHEN {has(W.KEY_PLAN)} THEN 'key_plan' WHEN {has(ignored)} THEN 'ignore' WHEN {plan} OR {number} THEN 'floor_plan'
      WHEN {has(W.GENERAL_NOTES)} OR regexp_matches({n}, '{W.GENERAL_NOTES_SHEET}') THEN 'general_notes' WHEN {has(W.ACCESSIBILITY)} THEN 'accessibility' WHEN {has(W.MILLWORK)} OR regexp_matches({n}, '{W.MILLWORK_SHEET}') THEN 'millwork_interiors' WHEN {has(W.SPECIFICATIONS)} THEN 'specifications' ELSE 'other' END"""


def _manifest(spark, root):
    """A page for each part: its bookmark, its row of the drawing index, or its title block names it."""
    k = F.col("p_partkey")
    p = table(spark, root, "part", ["p_partkey", "p_name"]).withColumn("file_id", F.floor(k / 50)).withColumn("page", (k % 50 + 1).cast("int"))
    title = lambda add: F.array(*map(F.lit, _TITLES))[((k + add) % len(_TITLES)).cast("int")]
    sheet = F.when(k % 6 > 0, F.concat(F.lit("A-"), (k % 50 + 100).cast("string")))
    pages = p.select("file_id", "page", F.when(k % 5 > 0, title(0)).alias("title"), sheet.alias("sheet_number"))
    outline = p.where(k % 4 == 0).select("file_id", k.alias("seq"), title(1).alias("title"), F.when(k % 12 > 0, F.col("page")).alias("page"))
    index = p.where(k % 3 == 0).select("file_id", k.alias("seq"), F.concat(F.lit("a "), (k % 50 + 100).cast("string")).alias("sheet_number"), title(2).alias("title"))
    return C.manifest(pages, outline, index)


_MANIFEST_SQL = f"""t AS (SELECT p_partkey // 50 AS file_id, (p_partkey % 50 + 1)::INT AS page, p_partkey AS k, {list(_TITLES)} AS ts, CASE WHEN p_partkey % 6 > 0 THEN 'A-' || (p_partkey % 50 + 100) END AS sheet FROM part),
c AS (SELECT file_id, page, sheet, CASE WHEN k % 4 = 0 AND k % 12 > 0 THEN ts[(k + 1) % {len(_TITLES)} + 1] END AS mark, CASE WHEN k % 3 = 0 AND sheet IS NOT NULL THEN ts[(k + 2) % {len(_TITLES)} + 1] END AS listed, CASE WHEN k % 5 > 0 THEN ts[k % {len(_TITLES)} + 1] END AS own FROM t),
m AS (SELECT file_id, page, coalesce(mark, listed, own) AS title, CASE WHEN mark IS NOT NULL THEN 'bookmark' WHEN listed IS NOT NULL THEN 'index_page' WHEN own IS NOT NULL THEN 'title_block' ELSE 'none' END AS source, coalesce(sheet, '') AS n, lower(trim(coalesce(mark, listed, own, ''))) AS low FROM c),
mf AS (SELECT file_id, page, title, source, {_bucket_sql("low", "n")} AS bucket, CASE WHEN title IS NOT NULL THEN CASE {" ".join(f"WHEN {_ANY('low', words)} THEN '{name}'" for name, words in W.LEVELS)} END END AS level FROM m)"""


@query("G11 G10 C18 E7", f"WITH {_MANIFEST_SQL} SELECT * FROM mf")
def page_manifest(spark, root):
    return _manifest(spark, root).select("file_id", "page", "title", "source", "bucket", "level")


@query("G27", f"WITH {_MANIFEST_SQL} SELECT file_id, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (bucket = 'floor_plan'), '') AS floor_plans, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (bucket = 'signage_schedule'), '') AS schedules, count(*)::INT AS titles FROM mf GROUP BY 1")
def page_lists(spark, root):
    d = C.page_lists(_manifest(spark, root))
    return d.select("file_id", F.array_join("floor_plan_pages", ",").alias("floor_plans"), F.array_join("schedule_pages", ",").alias("schedules"), F.size("titles").alias("titles"))


@query("E10", f'WITH {_MANIFEST_SQL}, g AS (SELECT file_id, title, page, page - row_number() OVER (PARTITION BY file_id, title ORDER BY page) AS r FROM mf) SELECT file_id, title, min(page) AS start, max(page) AS "end", count(*)::BIGINT AS n FROM g GROUP BY file_id, title, r')
def title_ranges(spark, root):
    return C.page_ranges(_manifest(spark, root))


@query(
    "G26 I14 I16",
    """SELECT file_id, 'Hall ' || arg_min(p_size, k) FILTER (k % 3 = 1) AS project_name, 'City of ' || arg_min(p_size, k) FILTER (k % 3 = 2) AS jurisdiction, (min(k + 1) FILTER (k % 10 = 5))::INT AS index_page,
         coalesce(string_agg(DISTINCT CASE k % 4 WHEN 0 THEN 'basement' WHEN 2 THEN 'second floor' END, ',' ORDER BY CASE k % 4 WHEN 0 THEN 'basement' WHEN 2 THEN 'second floor' END), '') AS levels FROM (SELECT p_partkey // 10 AS file_id, p_partkey % 10 AS k, p_size FROM part) GROUP BY 1""",
)
def drawing_intake(spark, root):
    """Ten pages a file, each a phrase with what it announces and one in its title block with its level."""
    n = F.col("p_partkey") % 10
    p = table(spark, root, "part", ["p_partkey", "p_size"])
    said = F.when(n % 10 == 5, "Drawing Index").otherwise("Plan")
    said = F.concat(said, F.when(n % 3 == 1, F.concat(F.lit("\nProject: Hall "), "p_size")).when(n % 3 == 2, F.concat(F.lit("\nAHJ: City of "), "p_size")).otherwise(""))
    level = F.when(n % 4 == 0, "BASEMENT").when(n % 4 == 2, "Second Floor").otherwise("Details")
    phrases = [F.struct(F.lit(0).alias("seq"), said.alias("text"), F.lit(0.1).alias("x0"), F.lit(0.1).alias("y0")), F.struct(F.lit(1).alias("seq"), level.alias("text"), F.lit(0.9).alias("x0"), F.lit(0.9).alias("y0"))]
    d = p.select(F.floor(F.col("p_partkey") / 10).alias("file_id"), (n + 1).cast("int").alias("page"), F.explode(F.array(*phrases)).alias("p")).select("file_id", "page", "p.*")
    d = L.intake(d.withColumn("x1", F.col("x0") + 0.05).withColumn("y1", F.col("y0") + 0.05))
    return d.select("file_id", "project_name", "jurisdiction", "index_page", F.array_join(F.transform("levels", F.lower), ",").alias("levels"))


@query(
    "G3 G18",
    """SELECT p_partkey // 10 AS file_id, 'R-' || (p_partkey % 10 + 100) AS room_number, p_size AS occupant_load, CASE WHEN p_partkey % 2 = 0 THEN 'B' END AS occupancy_group FROM part WHERE p_partkey % 10 BETWEEN 5 AND 9 AND (p_partkey // 10) % 4 > 0""",
)
def occupant_loads(spark, root):
    """Two pages a file with a table of loads, of which the first is a plan, so that the second counts; every fourth file announces none."""
    k = F.col("p_partkey")
    n = k % 10
    p = table(spark, root, "part", ["p_partkey", "p_size"])
    file, page = F.floor(k / 10), F.when(n < 5, 1).otherwise(2)
    row = F.array(F.concat(F.lit("R-"), (n + 100).cast("string")), F.lit("room"), F.concat(F.col("p_size").cast("string"), F.lit(" OCC")), F.when(n % 2 == 0, "B").otherwise(""))
    items = p.select(file.alias("file_id"), page.alias("page"), n.alias("line"), F.posexplode(row).alias("i", "text")).where("text <> ''")
    head = p.where("p_partkey % 5 = 0").select(file.alias("file_id"), page.alias("page"), F.lit(-2).cast("long").alias("line"), F.lit(0).alias("i"), F.when(file % 4 > 0, "Occupant Load").otherwise("Areas").alias("text"))
    d = items.unionByName(head).select("file_id", "page", (F.col("line") * 10 + F.col("i")).alias("seq"), "text", (F.col("i") * 50.0).alias("x"), (F.col("line") * 20.0 + F.col("i")).alias("y"))
    plans = d.where("page = 1").select("file_id", "page").distinct()
    return L.occupant_loads(d, plans).select("file_id", "room_number", "occupant_load", "occupancy_group")
