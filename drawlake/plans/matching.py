"""Queries of the full sign matcher and of joins by similarity, over parts as phrases and signs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.functions import vocab as W
from drawlake.operators import sign_matcher as M
from drawlake.operators import similarity as S
from drawlake.operators import state as N
from drawlake.plans.registry import query
from drawlake.plans.screens import _tokens_sql
from drawlake.sources.tables import table

#: What phrases say and what signs ask for; ``#`` stands for a number of two digits, ``@`` for one of three.
_SAID = ("CONFERENCE,", "A#/", "B#.", "STOR, EAST, LONG, HALL,", "S-#", "Sign S-# here", "JAN closet west", "ROOM @", "xb#", "observatry", "MECH, PLANT,", "lobby, north", "stair B@ north", "stair A@ north", "C#/", "Q#.", "Q#/", "boiler", "pumps", "CONFERENCE C# EAST WING NORTH CORRIDOR BUILDING", "depot")
_ASKED = ("CONFERENCE A#", "conference C#", "storage of hall", "zone @", "JANITOR closet", "observatory", "mechanical plant B#", "lobby", "x", None, "stair B@", "stair A@", "boiler plant", "pumps hall", "CONFERENCE C#")
_NAMED = ("S-#", None, "Q#", "K-@", None, "Q-#", "")
_TOLD = (None, "near B# of a depot and many more words", "lobby", None, "conference")


def _drawn(spark, root):
    k = F.col("p_partkey")
    p = table(spark, root, "part", ["p_partkey"])
    n = k % 50
    filled = lambda texts, at: F.replace(F.replace(F.array(*map(F.lit, texts))[at.cast("int")], F.lit("#"), (k % 6 + 10).cast("string")), F.lit("@"), (k % 6 + 200).cast("string"))
    x0 = F.lit(0.03) + F.floor(n / 3) % 6 * 0.15 + n % 3 * 0.03
    y0 = F.lit(0.01) + F.floor(n / 18) * 0.3 + F.floor(k / 50) % 4 * 0.01 + n % 2 * 0.02
    phrases = p.select(F.floor(k / 50).alias("file_id"), F.lit(1).alias("page"), k.alias("seq"), filled(_SAID, (k * 5 + F.floor(k / 50)) % len(_SAID)).alias("text"), x0.alias("x0"), y0.alias("y0")).withColumn("x1", F.col("x0") + 0.05).withColumn("y1", F.col("y0") + 0.0125)
    signs = p.select(F.floor(k / 50).alias("file_id"), F.when(k % 29 > 0, 1).alias("page"), k.alias("sign_id"), filled(_NAMED, (k * 3 + F.floor(k / 7)) % len(_NAMED)).alias("identifier"), filled(_ASKED, k % len(_ASKED)).alias("location"), filled(_TOLD, F.floor(k / 15) % len(_TOLD)).alias("message"))
    return signs, phrases


def _filled_sql(texts, at):
    return "replace(replace([" + ", ".join("NULL" if t is None else f"'{t}'" for t in texts) + f"][(({at}) % {len(texts)})::INT + 1], '#', (p_partkey % 6 + 10)::VARCHAR), '@', (p_partkey % 6 + 200)::VARCHAR)"


_DRAWN_SQL = f"""raw AS (SELECT p_partkey // 50 AS file_id, 1 AS page, p_partkey AS seq, {_filled_sql(_SAID, "p_partkey * 5 + p_partkey // 50")} AS text,
  0.03::DOUBLE + (p_partkey % 50) // 3 % 6 * 0.15::DOUBLE + (p_partkey % 50) % 3 * 0.03::DOUBLE AS x0, 0.01::DOUBLE + (p_partkey % 50) // 18 * 0.3::DOUBLE + (p_partkey // 50) % 4 * 0.01::DOUBLE + (p_partkey % 50) % 2 * 0.02::DOUBLE AS y0 FROM part),
ask AS (SELECT p_partkey // 50 AS file_id, CASE WHEN p_partkey % 29 > 0 THEN 1 END AS page, p_partkey AS sign_id, {_filled_sql(_NAMED, "p_partkey * 3 + p_partkey // 7")} AS identifier, {_filled_sql(_ASKED, "p_partkey")} AS location, {_filled_sql(_TOLD, "p_partkey // 15")} AS message FROM part)"""


def _score(a: str, b: str) -> str:
    long = "greatest(length(q), length(t))"
    one = f"CASE WHEN q = t THEN 1.0::DOUBLE ELSE greatest(CASE WHEN starts_with(q, t) OR starts_with(t, q) THEN least(length(q), length(t)) / {long} ELSE 0 END, CASE WHEN coalesce(m[q], q) = coalesce(m[t], t) THEN 0.95::DOUBLE ELSE 1 - levenshtein(q, t) / {long} END) END"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE list_sum([coalesce(list_max([{one} FOR t IN {b}]), 0.0::DOUBLE) FOR q IN {a}]) / len({a}) END"


def _sq(c: str) -> str:
    return rf"lower(regexp_replace({c}, '[\s\-_]', '', 'g'))"


def _blank(c: str) -> str:
    return rf"[coalesce(m[w], w) FOR w IN regexp_split_to_array(lower(trim({c})), '\s+') IF length(w) >= 2]"


_APART = "sqrt((p.cx - h.cx) * (p.cx - h.cx) + (p.cy - h.cy) * (p.cy - h.cy))"


def _rank(out: str, hits: str, source: str, exclude: str, keys: str) -> str:
    """CTEs that rank ``hits`` by their surroundings and keep the best one of each ``keys``, if it is decided."""
    ask = rf"list_distinct([{_sq('w')} FOR w IN regexp_extract_all({source}, '\S+') IF length({_sq('w')}) >= 2 AND {_sq('w')} <> {exclude}])"
    said = "(p.sq = w OR (length(w) >= 3 AND contains(p.sq, w)) OR (length(p.sq) >= 3 AND contains(w, p.sq)))"
    on = "p.file_id = h.file_id AND p.page = h.page AND p.drawn AND p.cx BETWEEN h.x_low AND h.x_high"
    return f"""{out}_h AS (SELECT *, {ask} AS aw, [lower(t) FOR t IN regexp_extract_all({source}, '{W.SIGN_ROOM_TOKEN}')] AS rooms FROM {hits}),
{out}_n AS (SELECT {keys}, h.seq, len(list_distinct(flatten(list(list_filter(h.aw, lambda w: {said})) FILTER (WHERE {_APART} <= 0.08)))) AS told, bool_or({_APART} <= 0.06 AND len(list_intersect(p.runs, h.rooms)) > 0) AS room,
  bool_or({_APART} <= 0.05 AND len(list_filter(h.aw, lambda w: {said})) > 0) AS ctx FROM {out}_h h JOIN p ON {on} GROUP BY {keys}, h.seq),
{out}_t AS (SELECT h.*, CASE WHEN len(aw) = 0 THEN 1.0::DOUBLE ELSE n.told / len(aw) END AS told_w, n.room AS at_room, n.ctx OR len(aw) = 0 AS ctx FROM {out}_h h JOIN {out}_n n USING ({keys}, seq)),
{out}_v AS (SELECT *, CASE WHEN len(rooms) > 0 THEN CASE WHEN at_room THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.6::DOUBLE + told_w * 0.3::DOUBLE + score * 0.1::DOUBLE ELSE told_w * 0.65::DOUBLE + score * 0.35::DOUBLE END AS total FROM {out}_t),
{out}_w AS (SELECT *, row_number() OVER z AS n, lead(total) OVER z AS nx FROM {out}_v {"WHERE ctx" if "pos" in keys else ""} WINDOW z AS (PARTITION BY {keys} ORDER BY total DESC, seq)),
{out} AS (SELECT * FROM {out}_w WHERE n = 1 AND (nx IS NULL OR total - nx >= 0.12 OR total >= 0.75))"""


def _tight(said: str) -> str:
    words, ask = r"[w FOR w IN regexp_split_to_array(text, '\s+') IF w <> '']", rf"[w FOR w IN regexp_split_to_array(upper(trim({said})), '\s+') IF w <> '']"
    hits = f"[len([j FOR j IN range(1, len({ask}) + 1) IF upper({words}[(k + j)::INT]) = {ask}[j::INT]]) FOR k IN range(0, greatest(0, len({words}) - len({ask}) + 1))]"
    chars = lambda n: f"coalesce(list_sum([length(w) FOR w IN {words}[1:{n}]]), 0)"
    best = f"list_max({hits})"
    at = f"(list_position({hits}, {best}) - 1)"
    edge = lambda n: f"(x0 + CASE WHEN {n} = 0 THEN 0 ELSE {chars(n)} END / {chars(f'len({words})')} * (x1 - x0))"
    return f"CASE WHEN len({ask}) > 0 AND coalesce({best}, 0) > 0 AND {best} / len({ask}) >= 0.5 THEN ({edge(at)} + {edge(f'({at} + len({ask}))')}) / 2 ELSE cx END"


_NUMBER, _TOKEN = W.SIGN_ROOM_NUMBER, W.SIGN_ROOM_TOKEN
_MATCH_SQL = rf"""WITH {_DRAWN_SQL},
m0 AS (SELECT MAP {{{", ".join(f"'{a}': '{b}'" for a, b in W.SIGN_WORDS.items())}}} AS m),
p AS (SELECT *, [r FOR r IN list_distinct(regexp_split_to_array(sq, '[^a-z0-9]+')) IF r <> ''] AS runs, cy >= 0.04 AND cy <= 0.96 AND length(trim(text)) >= 2 AS drawn
      FROM (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, {_sq("text")} AS sq, {_tokens_sql("text")} AS tw FROM (SELECT *, x0 + 0.05::DOUBLE AS x1, y0 + 0.0125::DOUBLE AS y1 FROM raw))),
s AS (SELECT *, CASE WHEN regexp_matches(upper(loc), '\bB\d{{3}}[A-Z]?\b') THEN 0.45 ELSE 0 END AS x_low, CASE WHEN regexp_matches(upper(loc), '\bA\d{{3}}[A-Z]?\b') AND NOT regexp_matches(upper(loc), '\bB\d{{3}}[A-Z]?\b') THEN 0.55 ELSE 1 END AS x_high,
        trim(regexp_replace(regexp_replace(loc, '{_TOKEN}', ' ', 'g'), '\s+', ' ', 'g')) AS kind, lower(regexp_extract_all(loc, '{_TOKEN}')[1]) AS room
      FROM (SELECT file_id, page, sign_id, coalesce(location, '') AS loc, concat_ws(' ', nullif(coalesce(location, ''), ''), nullif(coalesce(message, ''), '')) AS "both", upper(trim(coalesce(identifier, ''))) AS verbatim, {_sq("coalesce(identifier, '')")} AS id_sq, length(coalesce(identifier, '')) AS id_len FROM ask WHERE page IS NOT NULL)),
pr AS (SELECT s.*, p.seq, p.text, p.x0, p.x1, p.cx, p.cy, p.sq, p.tw, p.runs, p.drawn, m FROM s JOIN p ON p.file_id = s.file_id AND p.page = s.page AND p.cx BETWEEN x_low AND x_high, m0),
w1 AS (SELECT sign_id, 1 AS pass, cx AS x, cy AS y, 1.0::DOUBLE AS score, seq FROM pr WHERE drawn AND length(verbatim) >= 2 AND contains(upper(trim(text)), verbatim) QUALIFY row_number() OVER (PARTITION BY sign_id ORDER BY seq) = 1),
b2 AS (SELECT *, {_blank("loc")} AS lw, {_blank("text")} AS pw FROM pr WHERE drawn),
c2 AS (SELECT *, len([w FOR w IN lw IF list_contains(pw, w)]) / len(list_distinct(list_concat(lw, pw))) AS score FROM b2 WHERE len(lw) > 0 AND len(pw) > 0),
w2 AS (SELECT sign_id, 2 AS pass, cx AS x, cy AS y, score, seq FROM c2 WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY sign_id ORDER BY score DESC, seq) = 1),
c3 AS (SELECT *, list_min([i FOR i IN range(1, len(a) + 1) IF list_contains(b, a[i::INT])]) AS pos FROM (SELECT *, regexp_extract_all(upper(trim(loc)), '{_NUMBER}') AS a, regexp_extract_all(upper(trim(text)), '{_NUMBER}') AS b FROM pr WHERE drawn)),
w3 AS (SELECT sign_id, 3 AS pass, cx AS x, cy AS y, 0.85::DOUBLE AS score, seq FROM c3 WHERE pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sign_id ORDER BY pos, seq) = 1),
h4 AS (SELECT *, count(*) OVER (PARTITION BY sign_id) AS n FROM pr WHERE id_len >= 3 AND length(id_sq) >= 3 AND regexp_matches(sq, '(^|[^a-z0-9])' || regexp_escape(id_sq) || '($|[^a-z0-9])')),
n4 AS (SELECT h.sign_id, h.seq, h.cx, h.cy, h.loc, list_distinct(flatten(list(p.tw))) AS said FROM h4 h JOIN p ON p.file_id = h.file_id AND p.page = h.page AND p.cx BETWEEN h.x_low AND h.x_high AND {_APART} <= 0.12 WHERE h.n > 1 AND h.loc <> '' GROUP BY ALL),
l4 AS (SELECT *, row_number() OVER z AS n, lead(lk) OVER z AS nx FROM (SELECT *, {_score(_tokens_sql("loc"), "said")} AS lk FROM n4, m0) WINDOW z AS (PARTITION BY sign_id ORDER BY lk DESC, seq)),
w4 AS (SELECT sign_id, 4 AS pass, cx AS x, cy AS y, 1.0::DOUBLE AS score, seq FROM h4 WHERE n = 1 UNION ALL SELECT sign_id, 4, cx, cy, 0.95, seq FROM l4 WHERE n = 1 AND (nx IS NULL OR lk - nx >= 0.15)),
al AS (SELECT *, {_score("kw", "tw")} AS lkind, {_score("lw", "tw")} AS lloc, {_score("bw", "tw")} AS lboth FROM (SELECT *, {_tokens_sql("CASE WHEN length(kind) >= 2 THEN kind ELSE '' END")} AS kw, {_tokens_sql("loc")} AS lw, {_tokens_sql('"both"')} AS bw FROM pr WHERE drawn)),
c5 AS (SELECT h.sign_id, h.seq AS kseq, p.seq, p.cx, p.cy, {_APART} AS apart FROM al h JOIN p ON p.file_id = h.file_id AND p.page = h.page AND p.drawn AND p.cx BETWEEN h.x_low AND h.x_high AND {_APART} <= 0.05 WHERE lkind >= 0.7 AND room IS NOT NULL AND list_contains(p.runs, room)),
w5 AS (SELECT sign_id, 5 AS pass, CASE WHEN nx - apart < 0.02 THEN NULL ELSE cx END AS x, cy AS y, 0.95::DOUBLE AS score, seq FROM (SELECT *, row_number() OVER z AS n, lead(apart) OVER z AS nx FROM c5 WINDOW z AS (PARTITION BY sign_id ORDER BY apart, kseq, seq)) WHERE n = 1),
c6 AS (SELECT *, lloc AS score FROM al WHERE lloc >= 0.65),
{_rank("r6", "c6", "loc", "''", "sign_id")},
w6 AS (SELECT sign_id, 6 AS pass, {_tight("loc")} AS x, cy AS y, least(1.0::DOUBLE, 0.8::DOUBLE + (score - 0.65::DOUBLE) / (1 - 0.65::DOUBLE) * 0.2::DOUBLE) AS score, seq FROM r6),
t7 AS (SELECT sign_id, lower(t.t) AS tok, t.t AS token, row_number() OVER (PARTITION BY sign_id ORDER BY -length(t.t), t.i) AS pos FROM (SELECT sign_id, unnest([{{'t': ts[i::INT], 'i': i}} FOR i IN range(1, len(ts) + 1) IF list_position(ts, ts[i::INT]) = i]) AS t FROM (SELECT sign_id, regexp_extract_all("both", '{_TOKEN}') AS ts FROM s))),
c7 AS (SELECT pr.*, tok, token, pos, 0.75::DOUBLE AS score FROM pr JOIN t7 USING (sign_id) WHERE drawn AND (list_contains(runs, tok) OR (regexp_matches(sq, '^[a-z]') AND substr(sq, 2) = tok))),
{_rank("r7", "c7", '"both"', "tok", "sign_id, pos")},
w7 AS (SELECT sign_id, 7 AS pass, {_tight("token")} AS x, cy AS y, 0.75::DOUBLE AS score, seq FROM r7 QUALIFY row_number() OVER (PARTITION BY sign_id ORDER BY pos) = 1),
w8 AS (SELECT sign_id, 8 AS pass, {_tight('"both"')} AS x, cy AS y, lboth AS score, seq FROM al WHERE lboth >= 0.6 QUALIFY row_number() OVER (PARTITION BY sign_id ORDER BY lboth DESC, seq) = 1),
ev AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4 UNION ALL SELECT * FROM w5 UNION ALL SELECT * FROM w6 UNION ALL SELECT * FROM w7 UNION ALL SELECT * FROM w8)
SELECT sign_id, pass, round(x, 9) AS x, round(y, 9) AS y, round(score, 9) AS score, seq FROM ev QUALIFY row_number() OVER (PARTITION BY sign_id ORDER BY pass) = 1"""


@query("G24 I9", f"SELECT * FROM ({_MATCH_SQL}) WHERE x IS NOT NULL")
def sign_matches(spark, root):
    """All eight passes over every part as a sign and as a phrase, 50 on a page."""
    d = M.sign_places(*_drawn(spark, root))
    return d.select("sign_id", "pass", *[F.round(c, 9).alias(c) for c in ("x", "y", "score")], "seq")


def _labels(spark, root):
    """Names with a number behind them, so that many are alike and few are equal."""
    k = F.col("p_partkey")
    return table(spark, root, "part", ["p_partkey", "p_name"]).select(k.alias("id"), (k % 40).alias("job_id"), F.concat("p_name", F.lit(" "), (k * 7 % 997).cast("string")).alias("label"), (k * 7 % 10 / 10).alias("confidence"))


_LABEL_SQL = "lb AS (SELECT p_partkey AS id, p_partkey % 40 AS job_id, p_name || ' ' || (p_partkey * 7 % 997) AS label, (p_partkey * 7 % 10 / 10)::DOUBLE AS confidence FROM part)"


@query(
    "I8",
    f"""WITH {_LABEL_SQL}, d AS (SELECT DISTINCT label FROM lb) SELECT a.label, b.label AS other, round(1 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label)), 9) AS similarity
       FROM d a JOIN d b ON a.label < b.label AND 1 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label)) >= 0.85 - 1e-9""",
)
def similar_labels(spark, root):
    """Every two labels of all parts of a similarity of .85 or more."""
    s = _labels(spark, root).select(F.col("label").alias("s"))
    d = S.similar_pairs(s, 0.85)
    return d.select(F.col("s").alias("label"), F.col("t").alias("other"), F.round("similarity", 9).alias("similarity"))


@query(
    "N7 C9 I8",
    f"""WITH RECURSIVE {_LABEL_SQL}, c AS (SELECT a.job_id, a.id AS text_id, b.id AS image_id, 1 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label)) AS sim
          FROM lb a JOIN lb b ON a.job_id = b.job_id AND a.id % 3 > 0 AND b.id % 3 = 0 WHERE 1 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label)) >= 0.7 - 1e-9),
        o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY text_id, sim DESC, image_id) AS n FROM c),
        w(job_id, n, used, done, a, b) AS (SELECT DISTINCT job_id, 0::BIGINT, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), NULL::BIGINT, NULL::BIGINT FROM o
          UNION ALL SELECT job_id, n, CASE WHEN f THEN list_append(used, image_id) ELSE used END, CASE WHEN f THEN list_append(done, text_id) ELSE done END, CASE WHEN f THEN text_id END, CASE WHEN f THEN image_id END
          FROM (SELECT o.*, w.used, w.done, NOT list_contains(w.used, o.image_id) AND NOT list_contains(w.done, o.text_id) AS f FROM w JOIN o ON o.job_id = w.job_id AND o.n = w.n + 1)),
        g AS (SELECT a, b FROM w WHERE a IS NOT NULL)
        SELECT id, CASE WHEN id IN (SELECT a FROM g) THEN 'both' ELSE 'text' END AS found_by, CASE WHEN id IN (SELECT a FROM g) THEN least(1.0, confidence + 0.15) ELSE confidence END::DOUBLE AS confidence FROM lb WHERE id % 3 > 0
        UNION ALL SELECT id, 'image', confidence FROM lb WHERE id % 3 = 0 AND id NOT IN (SELECT b FROM g)""",
)
def paired_passes(spark, root):
    """What a text pass and an image pass found, paired one to one within a job by similar labels; the pairs gain confidence."""
    d = _labels(spark, root)
    text, image = d.where("id % 3 > 0"), d.where("id % 3 = 0")
    pairs = S.greedy_alike(text, image, "id", "id", F.col("label"), 0.7, ["job_id"]).select(F.col("id").alias("text_id"), F.col("other_id").alias("image_id"))
    return N.compared(text.select("id", "confidence"), image.select("id", "confidence"), pairs)
