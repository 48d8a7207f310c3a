"""External models as table functions (M1-M18): calls in batches, retries, repair and validation of answers (K3-K8), call logs."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: The kinds of calls (M1): name, what it reads, what it gives.
CALL_TYPES = (
    ("project_info", "first pages", "project fields"),
    ("floor_plan_text", "page texts", "sign rows"),
    ("image_extraction", "page images", "sign rows"),
    ("callout_scan", "page images", "callouts"),
    ("title_levels", "title blocks", "page levels"),
    ("spec_enrichment", "schedule rows", "notes"),
)


class RateLimited(Exception):
    """The model asks to wait; only this is tried again."""


class ModelClient(Protocol):
    """Anything that answers a prompt; it must be picklable, as it runs in the tasks."""

    def answer(self, kind: str, prompt: str) -> str: ...


@dataclass(frozen=True)
class EchoClient:
    """Deterministic stand-in: an array with the prompt's length and first word."""

    def answer(self, kind: str, prompt: str) -> str:
        return json.dumps([{"kind": kind, "length": len(prompt), "first": (prompt.split() or [""])[0]}])


def with_retries(call: Callable[[], str], retries: int = 4, first: float = 8.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's answer; after RateLimited it is tried again, each wait twice the last, up to ``most`` seconds."""
    for n in range(retries + 1):
        try:
            return call()
        except RateLimited:
            if n == retries:
                raise
            sleep(min(most, first * 2**n))
    raise AssertionError("unreachable")


def registry(spark: SparkSession) -> DataFrame:
    """The static table of call types (M1)."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(map(repr, CALL_TYPES)) + " AS t(kind, reads, gives)")


def call_model(rows: DataFrame, kind: str, client: ModelClient, prompt: str = "prompt", retries: int = 4) -> DataFrame:
    """``rows`` with ``response, error, duration_ms``: one call a row, failures in ``error`` and never the task's."""
    schema = rows.select("*", F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("duration_ms")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b[prompt]:
                began = time.monotonic()
                try:
                    got, bad = with_retries(lambda p=p: client.answer(kind, p or ""), retries), None
                except Exception as e:  # the row carries it
                    got, bad = None, f"{type(e).__name__}: {e}"
                out.append((got, bad, int((time.monotonic() - began) * 1000)))
            yield b.assign(response=[o[0] for o in out], error=[o[1] for o in out], duration_ms=[o[2] for o in out])

    return rows.mapInPandas(run, schema)


def call_log(called: DataFrame, kind: str, job: str) -> DataFrame:
    """A log row for each call (M16); failures go to a table of their own."""
    return called.select(F.col(job).alias("job_id"), F.lit(kind).alias("call_type"), F.ceil(F.length("prompt") / 4).alias("prompt_tokens"), F.ceil(F.length("response") / 4).alias("response_tokens"), F.col("error").isNull().alias("ok"), "error", "duration_ms")


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{}\[\]]', re.S)


def complete_objects(text: str) -> list | None:
    """The complete top-level objects of an array that may be cut off (K4); None without any, or if one is no JSON."""
    at = text.find("[")
    if at < 0:
        return None
    depth, begin, found = 0, None, []
    for m in _TOKEN.finditer(text, at):
        c = m[0]
        if c == '"':
            break  # a string that never ends
        if c == "[":
            depth += 1
        elif c == "{":
            if depth == 1:
                begin = m.start()
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 1 and begin is not None:
                found.append(text[begin : m.end()])
                begin = None
        elif c == "]":
            if depth == 1:
                break
            depth -= 1
    try:
        return json.loads("[" + ",".join(found) + "]") if found else None
    except ValueError:
        return None


def parsed_rows(raw: str | None, valid: Callable[[dict], bool]) -> list[dict]:
    """The rows of an answer: fences stripped, the outermost array, repaired if cut off; one invalid row voids them all (K3, K6)."""
    text = (raw or "").strip()
    if text.startswith("```"):
        text = re.sub(r"\n?```[\s\S]*$", "", re.sub(r"^```[a-zA-Z]*\n?", "", text)).strip()
    a, b = text.find("["), text.rfind("]")
    if a < 0:
        return []
    rows = None
    if b > a:
        try:
            rows = json.loads(text[a : b + 1])
        except ValueError:
            rows = None
    if rows is None:
        rows = complete_objects(text)
    return rows if isinstance(rows, list) and all(isinstance(r, dict) and valid(r) for r in rows) else []


def recovered_callouts(raw: str | None, least: float = 0.75) -> list[dict]:
    """Objects without inner braces that parse by themselves and are confident enough (K5)."""
    out = []
    for m in re.finditer(r"\{[^{}]*\}", raw or ""):
        try:
            o = json.loads(m[0])
        except ValueError:
            continue
        if isinstance(o.get("confidence"), int | float) and o["confidence"] >= least:
            out.append(o)
    return out


def recovered(response: Column) -> Column:
    """The recovered callouts of an answer as canonical JSON text (K5)."""

    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(recovered_callouts(t), separators=(",", ":"), sort_keys=True))

    return pandas_udf(f, "string")(response)


def repaired(response: Column) -> Column:
    """The repaired array of an answer as canonical JSON text, ``[]`` where nothing is left (K4, K6)."""

    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(parsed_rows(t, lambda r: True), separators=(",", ":"), sort_keys=True))

    return pandas_udf(f, "string")(response)


def parsed_or_wrapped(response: Column) -> Column:
    """The answer if it is JSON, else an object that holds it as ``raw`` (K8)."""
    return F.coalesce(F.to_json(F.try_parse_json(response)), F.to_json(F.struct(response.alias("raw"))))


def remapped_pages(callouts: DataFrame, pages_per_call: int = 2) -> DataFrame:
    """Pages of a call, counted from 1, as pages of the document; those out of range are left out (M6)."""
    return callouts.where(F.col("page").between(1, pages_per_call)).withColumn("page", F.col("first_page") + F.col("page") - 1)


def failure_alert(calls: DataFrame, most: float = 0.5) -> DataFrame:
    """Jobs of whose calls more than the share failed."""
    rate = F.avg(F.col("error").isNotNull().cast("int"))
    return calls.groupBy("job_id").agg(rate.alias("failed")).where(F.col("failed") > most)


def batched_prompts(pages: DataFrame, capacity: int = 240_000, longest: int = 5_000) -> DataFrame:
    """Page texts (``file_id, page, text``) in prompts of bounded length, next-fit in order of pages (M3, F-9)."""
    from drawlake.operators.windows import next_fit

    d = pages.withColumn("n", F.least(F.length("text"), F.lit(longest)))
    batch = next_fit(d, ["file_id"], "page", "n", capacity).select("file_id", "page", "batch")
    text = F.transform(F.array_sort(F.collect_list(F.struct("page", F.substring("text", 1, longest).alias("t")))), lambda s: F.concat(F.lit("--- page "), s["page"].cast("string"), F.lit(" ---\n"), s["t"]))
    return pages.join(batch, ["file_id", "page"]).groupBy("file_id", "batch").agg(F.min("page").alias("first_page"), F.array_join(text, "\n").alias("prompt"))


def page_batches(pages: DataFrame, size: int = 25) -> DataFrame:
    """Pages in calls of ``size``; answers count from the call's first page (M5, M6)."""
    b = F.floor((F.col("page") - 1) / size)
    return pages.withColumn("batch", b).withColumn("first_page", b * size + 1)


def answered_rows(called: DataFrame, schema: str) -> DataFrame:
    """The rows of repaired answers under a schema, with the call's page offset added to ``page`` if both are there (M3-M5)."""
    rows = F.from_json(repaired(F.col("response")), f"array<struct<{schema}>>")
    d = called.withColumn("_r", F.explode(rows))
    keep = [c for c in called.columns if c not in ("prompt", "response")]
    d = d.select(*keep, "_r.*")
    return d.withColumn("page", F.col("page") + F.col("first_page") - 1) if {"page", "first_page"} <= set(d.columns) else d


def valid_loads(rows: DataFrame) -> DataFrame:
    """Occupant loads of 0 to 9999 with a room number."""
    return rows.where("room_number IS NOT NULL AND occupant_load BETWEEN 0 AND 9999")


def asks_for_rooms(rooms: DataFrame, manifest: DataFrame, size: int = 20) -> DataFrame:
    """Ambiguous rooms in batches, of files with a life-safety page only."""
    from pyspark.sql import Window

    from drawlake.operators.rooms import ambiguous

    safe = manifest.where("bucket = 'life_safety'").select("file_id").distinct()
    d = rooms.where(ambiguous()).join(safe, "file_id", "left_semi")
    return d.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("file_id").orderBy("seq")) - 1) / size))


def located(candidates: DataFrame, signs: DataFrame, most: int = 20, keep: int = 3) -> DataFrame:
    """Candidates with a place on the page, three a sign at most, of each job's first twenty signs (M13). signs: ``job_id, sign_id``."""
    from drawlake.operators.windows import first_of

    asked = first_of(signs, ["job_id"], ["sign_id"], most).select("sign_id")
    good = candidates.where("x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1").join(asked, "sign_id", "left_semi")
    return first_of(good, ["sign_id"], [F.desc("confidence"), "seq"], keep)


def fallback_pages(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """All pages of the files whose outline names none."""
    return pages.join(outline.where("page IS NOT NULL").select("file_id").distinct(), "file_id", "left_anti")
