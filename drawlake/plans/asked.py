"""Queries of model calls that are retried, kept and resumed, and of what each kind of call gives (M3-M15), with their SQL.

The stand-in answers by the length of the prompt, so that SQL can say what comes out: the calls, their limits and what is done
with good and bad answers are what is shown, not the answers.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from drawlake.operators import model_calls as C
from drawlake.operators import models as M
from drawlake.plans.calls import _BATCH_SQL, _prompts
from drawlake.plans.registry import query
from drawlake.session import scratch
from drawlake.sources.tables import table


@dataclass
class Moody:
    """Asks to wait as many times as the prompt's length leaves on division by 3; fails where 7 divides it."""

    tries: dict = field(default_factory=dict)

    def answer(self, kind: str, prompt: str) -> str:
        n = len(prompt)
        if n % 7 == 0:
            raise ValueError("seven")
        self.tries[prompt] = self.tries.get(prompt, 0) + 1
        if self.tries[prompt] <= n % 3:
            raise M.RateLimited("wait")
        return json.dumps([{"length": n}])


class Draft:
    """Answers of every kind, by the length of the prompt; some fail, some are empty, some have rows that do not count."""

    def answer(self, kind: str, prompt: str) -> str:
        n = len(prompt)
        ids = [line.split(" ", 1)[0] for line in prompt.split("\n")]
        if kind == "callout_scan":
            return f'I see {{"page": 1, "label": "a{n}", "confidence": 0.{n % 100:02d}}} and {{"page": 2, "label": "b", "confidence": 0.8}} and {{"page": 3, "label": "c", "confidence": 1}}'
        if kind == "title_levels":
            return ("On the SECOND FLOOR plan", "roof", "Basement, first floor", "Mezzanine")[n % 4]
        if kind == "schedule":
            if n % 4 == 0:
                raise ValueError("no image")
            return "[]" if n % 4 == 1 else f'```json\n[{{"typeCode": " T{n % 7} ", "hasBraille": true, "dimensions": "6x6"}}]\n```'
        if kind == "spec_enrichment":
            return "sorry" if n % 3 == 0 else f'```json\n{{"height": "{n}", "has_braille_note": true, "confidence": 0.5}}\n```'
        if kind == "occupant_loads":
            return json.dumps([{"room_num": f" r{n % 50} ", "occupant_load": n * 37 % 20000, "occupancy_group": " b "}, {"room_name": "hall", "occupant_load": str(n)}, {"occupant_load": 5}, {"room_num": "x", "occupant_load": "many"}])
        if kind == "room_classification":
            if n % 2:
                raise ValueError("odd")
            return json.dumps([{"seq": int(i), "kind": "office" if int(i) % 2 else "suite", "confidence": 0.75} for i in ids if int(i) % 5])
        if kind == "locate_doors":
            return json.dumps([{"signId": int(i), "candidates": [{"x": int(i) % 13 / 10, "y": 0.5}, {"x": 0.25, "y": 0.25}, {"x": 0.5, "y": -1}, {"x": 0.75, "y": 0.5}, {"x": 1, "y": 1}]} for i in ids if int(i) % 4])
        sign = {"sign_identifier": f"S{n % 5}", "location": "door", "confidence_score": 0.5, "page": 1}
        empty = {"floor_plan_text": n % 3 > 0, "general_text": n % 2 > 0}.get(kind, False)
        return json.dumps([] if empty else [sign, sign | {"quantity": 1, "confidence_score": 0.25, "page": 2}, {"location": "no name", "page": 3}])

    def answers(self, kind: str, prompts: list[str]) -> list[str]:
        """Vectors, ten at a time at most; a text of an odd length spoils nothing."""
        if len(prompts) > 10:
            raise ValueError("too many")
        return [json.dumps([len(p), p.count(" "), p.count(".")]) for p in prompts]


def _pages(spark, root):
    """Conversations as files, turns as pages with an image that is their text."""
    return table(spark, root, "conversations", ["conv_id", "turn", "text"]).select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("page"), F.coalesce("text", F.lit("")).alias("image"))


_PAGES_SQL = "pg AS (SELECT conv_id AS file_id, turn + 1 AS page, coalesce(text, '') AS image FROM conversations)"


@query("M3 M15 M16", f"WITH RECURSIVE {_BATCH_SQL} SELECT file_id, batch::BIGINT AS batch, CASE WHEN length(prompt) % 7 = 0 THEN 1 ELSE 1 + length(prompt) % 3 END::INT AS attempts, CASE WHEN length(prompt) % 7 = 0 THEN 'ValueError: seven' END AS error, CASE WHEN length(prompt) % 7 > 0 THEN '[{{\"length\": ' || length(prompt) || '}}]' END AS response FROM p".replace("{{", "{").replace("}}", "}"))
def asked_with_retries(spark, root):
    """Every batch of turns, with waits that are asked for and failures that are not tried again, 4,000 calls a second at most."""
    called = C.ask(_prompts(spark, root), "floor_plan_text", Moody(), budget=C.Budget(first=0.0, per_second=4000.0))
    return called.select("file_id", "batch", "attempts", "error", "response")


@query("M15", f"WITH RECURSIVE {_BATCH_SQL} SELECT file_id, batch::BIGINT AS batch, length(prompt) % 7 > 0 AND prompt IN (SELECT prompt FROM p WHERE file_id % 2 = 0) AS kept, length(prompt) % 7 > 0 AS answered FROM p")
def resumed_answers(spark, root):
    """A job that asked for half of the files, and one that asks for all: good answers are kept, failures are asked again."""
    p, store = _prompts(spark, root), scratch(spark, "answers")
    budget = C.Budget(first=0.0)
    C.ask(p.where("file_id % 2 = 0"), "floor_plan_text", Moody(), store=store, budget=budget)
    return C.ask(p, "floor_plan_text", Moody(), store=store, budget=budget).select("file_id", "batch", F.coalesce("kept", F.lit(False)).alias("kept"), F.col("response").isNotNull().alias("answered"))


@query(
    "M6 M8",
    f"""WITH {_PAGES_SQL}, b AS (SELECT file_id, (page - 1) // 2 AS batch, sum(length(image)) + count(*) - 1 AS n FROM pg WHERE file_id % 3 > 0 GROUP BY 1, 2)
        SELECT file_id, batch * 2 + 1 AS page, 'a' || n AS label, (n % 100 / 100)::DOUBLE AS confidence FROM b WHERE n % 100 >= 75 UNION ALL SELECT file_id, batch * 2 + 2, 'b', 0.8 FROM b UNION ALL SELECT file_id, page, 'said', 1.0 FROM pg WHERE file_id % 3 = 0""",
)
def scanned_callouts(spark, root):
    """Files whose text named callouts, and scans of two pages a call for the others."""
    pages = _pages(spark, root)
    found = pages.where("file_id % 3 = 0").select("file_id", "page", F.lit("said").alias("label"), F.lit(1.0).alias("confidence"))
    return C.callouts_or_scan(found, pages, Draft())


@query("M7", f"WITH {_PAGES_SQL} SELECT file_id, page, CASE length(image) % 4 WHEN 0 THEN 'second floor' WHEN 2 THEN 'first floor' ELSE 'mezzanine' END AS level FROM pg WHERE length(image) % 4 <> 1")
def titled_levels(spark, root):
    return C.page_levels(_pages(spark, root), Draft())


@query(
    "M9 T25",
    f"""WITH {_PAGES_SQL}, c AS (SELECT file_id, sum(length(image)) + count(*) - 1 AS n FROM pg GROUP BY 1),
        t AS (SELECT file_id, page, (CASE WHEN page % 2 = 0 THEN 'T' ELSE 't' END) || page % 3 AS code, page FROM pg QUALIFY row_number() OVER (PARTITION BY file_id, page % 3 ORDER BY page) = 1)
        SELECT file_id, 'T' || n % 7 AS code, 'T' || n % 7 AS name, true AS has_braille, false AS has_insert, '6x6' AS dimensions, NULL AS note, 'visual' AS method FROM c WHERE n % 4 >= 2
        UNION ALL SELECT file_id, code, code, page % 2 = 0, page % 5 = 0, '8x8', nullif(concat_ws('; ', CASE WHEN page % 2 = 0 THEN 'Grade 2 Braille' END, CASE WHEN page % 5 = 0 THEN 'paper insert' END), ''), 'text_fallback' FROM t JOIN c USING (file_id) WHERE n % 4 < 2""",
)
def schedule_reads(spark, root):
    """Schedules read from images; where the call fails or names no type, from the text."""
    pages = _pages(spark, root)
    k = F.col("page")
    features = F.array_compact(F.array(F.when(k % 2 == 0, "Grade 2 Braille"), F.when(k % 5 == 0, "paper insert")))
    specs = pages.select("file_id", "page", F.concat(F.when(k % 2 == 0, "T").otherwise("t"), (k % 3).cast("string")).alias("code"), F.lit("8x8").alias("dimensions"), F.lit(None).cast("string").alias("material"), features.alias("features"))
    return C.schedule_types(pages, specs, Draft()).drop("material")


@query("M10", f"WITH {_PAGES_SQL} SELECT file_id, page AS code, CASE WHEN length(image) % 3 > 0 THEN length(image)::VARCHAR END AS height, CASE WHEN length(image) % 3 > 0 THEN 0.5::DOUBLE END AS confidence FROM pg")
def enriched_types(spark, root):
    d = C.enriched_specs(_pages(spark, root).withColumnRenamed("page", "code"), Draft())
    return d.select("file_id", "code", "notes.height", "notes.confidence")


@query("M11", f"WITH {_PAGES_SQL} SELECT file_id, page, 'R' || length(image) % 50 AS room_number, (length(image) * 37 % 20000)::DOUBLE AS load, 'B' AS occupancy FROM pg WHERE length(image) * 37 % 20000 < 10000 UNION ALL SELECT file_id, page, 'HALL', length(image), NULL FROM pg WHERE length(image) < 10000")
def read_loads(spark, root):
    return C.occupant_loads(_pages(spark, root), Draft())


_ROOM_SQL = """rm AS (SELECT p_partkey // 100 AS job_id, p_partkey AS seq, p_name AS room_name, 0.5 + p_partkey % 5 / 10 AS confidence, (row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1) // 20 AS batch FROM part),
rb AS (SELECT job_id, batch, sum(length(room_name) + length(seq::VARCHAR) + 1) + count(*) - 1 AS n FROM rm GROUP BY 1, 2)"""


def _classified(spark, root):
    k = F.col("p_partkey")
    rooms = table(spark, root, "part", ["p_partkey", "p_name"]).select(F.floor(k / 100).alias("job_id"), k.alias("seq"), F.col("p_name").alias("room_name"), (F.lit(0.5) + k % 5 / 10).alias("confidence"))
    first = rooms.groupBy("job_id").agg(F.min("seq").alias("first"))
    return C.classified_rooms(rooms.join(first, "job_id").withColumn("batch", F.floor((F.col("seq") - F.col("first")) / 20)).drop("first"), Draft())


@query("M12", f"WITH {_ROOM_SQL} SELECT seq, CASE WHEN n % 2 = 0 AND seq % 5 > 0 THEN CASE WHEN seq % 2 = 1 THEN 'office' ELSE 'suite' END END AS kind, CASE WHEN n % 2 = 0 AND seq % 5 > 0 THEN greatest(confidence, 0.75) ELSE confidence END::DOUBLE AS confidence FROM rm JOIN rb USING (job_id, batch)")
def rooms_classified(spark, root):
    """All parts as rooms, twenty a call; calls that fail leave their rooms as they are."""
    return _classified(spark, root)[0].select("seq", "kind", F.round("confidence", 9).alias("confidence"))


@query("M12", f"WITH {_ROOM_SQL} SELECT job_id, avg(n % 2)::DOUBLE AS failed FROM rb GROUP BY 1 HAVING avg(n % 2) > 0.5")
def classification_alerts(spark, root):
    return _classified(spark, root)[1]


@query(
    "M13",
    """SELECT job_id, page, sign_id, CASE WHEN sign_id % 4 = 0 THEN '' WHEN sign_id % 13 <= 10 THEN (sign_id % 13 / 10)::DOUBLE || ' 0.25 0.75' ELSE '0.25 0.75 1.0' END AS xs
       FROM (SELECT o_custkey AS job_id, o_orderkey % 2 AS page, o_orderkey AS sign_id, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 20""",
)
def doors_located(spark, root):
    """Orders as signs, customers as jobs: the first three places on the page of each of a page's first twenty."""
    k = F.col("o_orderkey")
    signs = table(spark, root, "orders", ["o_orderkey", "o_custkey"]).select(F.col("o_custkey").alias("job_id"), (k % 2).alias("page"), k.alias("sign_id"), F.lit("door").alias("location"))
    return C.located_doors(signs, Draft()).select("job_id", "page", "sign_id", F.array_join(F.transform("candidates", lambda c: c["x"].cast("string")), " ").alias("xs"))


@query("M14", "SELECT doc_id, length(coalesce(text, '')) AS n, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', ''))) AS blanks, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '.', ''))) AS stops FROM documents")
def embedded_texts(spark, root):
    """Whole documents, ten a call; a text that repeats is asked once."""
    d = C.vectors(table(spark, root, "documents", ["doc_id", "text"]), Draft())
    return d.select("doc_id", *[F.get("vector", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("n", "blanks", "stops"))])


@query(
    "M4 M5 E8",
    f"""WITH {_PAGES_SQL}, a AS (SELECT file_id, 'floor_plan_text' AS found_by, sum(length(image)) + count(*) - 1 AS n, 0 AS shift FROM pg WHERE page % 2 = 1 GROUP BY 1 HAVING (sum(length(image)) + count(*) - 1) % 3 = 0),
        g AS (SELECT file_id, 'general_text' AS found_by, sum(length(image)) + count(*) - 1 AS n, 0 AS shift FROM pg WHERE file_id NOT IN (SELECT file_id FROM a) GROUP BY 1 HAVING (sum(length(image)) + count(*) - 1) % 2 = 0),
        im AS (SELECT file_id, 'image_extraction' AS found_by, sum(length(image)) + count(*) - 1 AS n, (CASE WHEN file_id % 2 = 0 THEN (page - 1) // 25 * 25 ELSE 0 END) AS shift FROM pg WHERE file_id NOT IN (SELECT file_id FROM a UNION ALL SELECT file_id FROM g) GROUP BY file_id, shift),
        r AS (SELECT * FROM a UNION ALL SELECT * FROM g UNION ALL SELECT * FROM im)
        SELECT file_id, found_by, sign_identifier, location, quantity, page FROM (
          SELECT file_id, found_by, 'S' || n % 5 AS sign_identifier, 'door' AS location, 1::BIGINT AS quantity, 2 + shift AS page FROM r QUALIFY row_number() OVER (PARTITION BY file_id, n % 5 ORDER BY shift) = 1
          UNION ALL SELECT file_id, found_by, NULL, 'no name', NULL, 3 + shift FROM r)""",
)
def extraction_passes(spark, root):
    """Odd pages as floor plans; files of even number are over 19 MB, so that their images go in calls of 25 pages."""
    k = F.col("file_id")
    pages = _pages(spark, root).select("file_id", "page", F.when(F.col("page") % 2 == 1, "floor_plan").otherwise("other").alias("kind"), F.col("image").alias("text"), "image", F.when(k % 2 == 0, 20_000_000).otherwise(100).alias("bytes"))
    return C.extracted(pages, Draft()).select("file_id", "found_by", "sign_identifier", "location", "quantity", "page")
