"""Model calls that survive (M3-M15): open calls in lanes, a budget of calls a second, and answers that are kept by the prompt's hash.

A prompt is called once, whatever the rows that ask it. Prompts without a kept answer are dealt to a fixed number of lanes, a
task each, however large the cluster is: a lane has some calls open and its share of the rate, so that the whole job keeps to
both bounds. A lane writes every answer to its journal in the shared folder as soon as it is there (answers that took under 10 ms within a
second); a lane that is run again after a lost executor, and a job that is started again, read what the journals hold and call
the rest. Only calls that were open when their executor was lost, or such short ones of its last second, are made twice.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.functions import vocab as V
from drawlake.functions.text import first_listed
from drawlake.operators.models import ModelClient, RateLimited, answered_rows, recovered, repaired
from drawlake.operators.windows import first_of, preferred
from drawlake.session import scratch


@dataclass(frozen=True)
class Budget:
    """``lanes`` tasks with ``in_flight`` open calls each, ``per_second`` calls (tries included) of all lanes together, ``batch`` prompts a call; waits after RateLimited double from ``first`` to ``most`` seconds."""

    lanes: int = 8
    in_flight: int = 3
    per_second: float | None = None
    batch: int = 1
    retries: int = 4
    first: float = 8.0
    most: float = 60.0


#: Answers that a lane's journal holds back at most, and rows of the frames that a lane hands on.
PENDING, ROWS = 5_000, 1_000
#: Milliseconds from which a call counts as long.
SHORT = 10
_ANSWER = "key string, response string, error string, attempts int, duration_ms long"


class Journal:
    """A lane's answers in files that are moved to their names when complete.

    An answer is written at once, unless it took under ``SHORT`` milliseconds, less than a repeated call would be missed: those
    share a file a second, or one for ``PENDING`` answers.
    """

    def __init__(self, path: str, lane: int) -> None:
        self.fs, base = pafs.FileSystem.from_uri(path)
        self.folder = f"{base}/lane={lane}"
        self.fs.create_dir(self.folder)
        self.pending, self.written, self.lock = [], 0.0, threading.Lock()

    def rows(self) -> Iterator[list[dict]]:
        for f in self.fs.get_file_info(pafs.FileSelector(self.folder)):
            if f.path.endswith(".json"):
                with self.fs.open_input_stream(f.path) as s:
                    yield [json.loads(line) for line in s.read().decode().splitlines()]

    def add(self, rows: list[dict]) -> None:
        with self.lock:
            self.pending.extend(rows)
        self.write_due(now=any(r["duration_ms"] >= SHORT for r in rows))

    def write_due(self, now: bool = False) -> None:
        """Write what is pending if its time has come, or in any case."""
        with self.lock:
            if not self.pending or not (now or len(self.pending) >= PENDING or time.monotonic() - self.written >= 1):
                return
            rows, self.pending, self.written = self.pending, [], time.monotonic()
        name = f"{self.folder}/{uuid.uuid4().hex}"
        with self.fs.open_output_stream(name) as s:
            s.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        self.fs.move(name, f"{name}.json")


class _Pace:
    """Starts that are ``seconds`` apart, over all threads of a lane."""

    def __init__(self, seconds: float) -> None:
        self.seconds, self.next, self.lock = seconds, 0.0, threading.Lock()

    def wait(self) -> None:
        if self.seconds:
            with self.lock:
                at = max(self.next, time.monotonic())
                self.next = at + self.seconds
            time.sleep(max(0.0, at - time.monotonic()))


def _called(client: ModelClient, kind: str, keys: list[str], prompts: list[str], budget: Budget, pace: _Pace) -> list[dict]:
    """The answers of one call; what fails says so in its rows and never ends the task."""
    began, n, answers, error = time.monotonic(), 0, None, None
    while answers is None and error is None:
        pace.wait()
        n += 1
        try:
            answers = client.answers(kind, prompts) if budget.batch > 1 else [client.answer(kind, prompts[0])]
            if len(answers) != len(prompts):
                answers, error = None, f"ValueError: {len(prompts)} prompts"
        except RateLimited as e:
            if n > budget.retries:
                error = f"RateLimited: {e}"
            else:
                time.sleep(min(budget.most, budget.first * 2 ** (n - 1)))
        except Exception as e:  # the rows carry it
            error = f"{type(e).__name__}: {e}"
    took = int((time.monotonic() - began) * 1000)
    return [{"key": k, "response": a, "error": error, "attempts": n, "duration_ms": took} for k, a in zip(keys, answers or [None] * len(keys), strict=True)]


def _lane(kind: str, client: ModelClient, budget: Budget, path: str):
    names = [c.split(" ")[0] for c in _ANSWER.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        journal, done = Journal(path, TaskContext.get().partitionId()), set()
        frame = lambda rows: pd.DataFrame(rows, columns=names, dtype=object)
        for rows in journal.rows():
            done.update(r["key"] for r in rows)
            yield frame(rows)
        pace, running, group, ready = _Pace(budget.lanes / budget.per_second if budget.per_second else 0.0), set(), [], []

        def finished(least: int) -> None:
            nonlocal running
            while len(running) > least:
                over, running = wait(running, timeout=1, return_when=FIRST_COMPLETED)
                journal.write_due()
                for f in over:
                    ready.extend(f.result())

        def call(pairs: list) -> list[dict]:
            rows = _called(client, kind, [k for k, _ in pairs], [p for _, p in pairs], budget, pace)
            journal.add(rows)
            return rows

        with ThreadPoolExecutor(budget.in_flight) as pool:
            for b in batches:
                for pair in zip(b["key"], b["prompt"], strict=True):
                    if pair[0] in done:
                        continue
                    group.append(pair)
                    if len(group) == budget.batch:
                        finished(budget.in_flight - 1)
                        running.add(pool.submit(call, group))
                        group = []
                    if len(ready) >= ROWS:
                        yield frame(ready)
                        ready.clear()
            if group:
                finished(budget.in_flight - 1)
                running.add(pool.submit(call, group))
            finished(0)
        journal.write_due(now=True)
        if ready:
            yield frame(ready)

    return run


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def known_answers(spark: SparkSession, store: str) -> DataFrame:
    """The good answers of a store, each prompt once: those of complete runs, and what broken ones have in their journals."""
    found = spark.createDataFrame([], _ANSWER)
    for part, read in (("calls", lambda r, p: r.parquet(p)), ("journals", lambda r, p: r.json(p))):
        at, fs = _folder(spark, f"{store}/{part}")
        if fs.exists(at):
            files = spark.read.schema(_ANSWER).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet" if part == "calls" else "*.json")
            found = found.unionByName(read(files, f"{store}/{part}"))
    return found.where("response IS NOT NULL").dropDuplicates(["key"])


def ask(rows: DataFrame, kind: str, client: ModelClient, prompt: str = "prompt", store: str | None = None, budget: Budget = Budget()) -> DataFrame:  # noqa: B008
    """``rows`` with ``response, error, attempts, duration_ms`` and ``kept`` (the answer was there before).

    ``store`` is a folder that outlives the job; without one the answers are the job's. Failures are not kept: the next job
    asks again. A null prompt is the empty one; prompts that repeat are one call; no rows, no calls. The calls are made here, once, and not when
    the result is read.
    """
    spark = rows.sparkSession
    store, run = store or scratch(spark, "answers"), uuid.uuid4().hex
    keyed = rows.withColumn("_prompt", F.coalesce(F.col(prompt).cast("string"), F.lit(""))).withColumn("_key", F.sha2(F.concat(F.lit(f"{kind}\n"), "_prompt"), 256))
    known = known_answers(spark, store)
    before = f"{store}/known/{run}"
    known.write.parquet(before)
    known = spark.read.schema(known.schema).parquet(before)
    todo = keyed.select(F.col("_key").alias("key"), F.col("_prompt").alias("prompt")).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    todo.repartition(budget.lanes, "key").mapInPandas(_lane(kind, client, budget, f"{store}/journals/{run}"), _ANSWER).write.parquet(f"{store}/calls/{run}")
    at, fs = _folder(spark, f"{store}/journals/{run}")
    fs.delete(at, True)
    now = spark.read.schema(known.schema).parquet(f"{store}/calls/{run}").withColumn("kept", F.lit(False))
    got = now.unionByName(known.withColumn("kept", F.lit(True))).withColumnRenamed("key", "_key")
    return keyed.join(got, "_key", "left").drop("_key", "_prompt")


# What the calls are for.


def image_batches(pages: DataFrame, most: int = 19_000_000, size: int = 25) -> DataFrame:
    """``file_id, page, bytes, image`` -> a call per file, or per 25 pages of a file over 19 MB; answers count from the call's first page (M5)."""
    total = pages.groupBy("file_id").agg(F.sum("bytes").alias("_all"))
    batch = F.when(F.col("_all") > most, F.floor((F.col("page") - 1) / size)).otherwise(F.lit(0).cast("long"))
    d = pages.join(total, "file_id").withColumn("batch", batch)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "image"))), lambda p: p["image"]), "\n")
    return d.groupBy("file_id", "batch").agg((F.col("batch") * size + 1).alias("first_page"), parts.alias("prompt"))


def callouts(pages: DataFrame, client: ModelClient, size: int = 2, least: float = 0.75, **asked) -> DataFrame:
    """``file_id, page, image`` -> ``file_id, page, label, confidence``: two pages a call, pages of the call turned into pages of the document, the doubtful and those off the call left out (M6)."""
    d = pages.withColumn("batch", F.floor((F.col("page") - 1) / size))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "image"))), lambda p: p["image"]), "\n")
    calls = d.groupBy("file_id", "batch").agg(parts.alias("prompt"))
    called = ask(calls, "callout_scan", client, **asked)
    found = F.from_json(recovered(F.col("response")), "array<struct<page: long, label: string, confidence: double>>")
    rows = called.select("file_id", "batch", F.explode(found).alias("c")).where(F.col("c.page").between(1, size) & (F.col("c.confidence") >= least))
    return rows.select("file_id", (F.col("batch") * size + F.col("c.page")).alias("page"), F.col("c.label").alias("label"), F.col("c.confidence").alias("confidence"))


def page_levels(pages: DataFrame, client: ModelClient, **asked) -> DataFrame:
    """``file_id, page, image`` -> ``file_id, page, level`` of the pages whose answer names a known level, the first listed (M7)."""
    called = ask(pages, "title_levels", client, prompt="image", **asked)
    return called.select("file_id", "page", first_listed(F.coalesce("response", F.lit("")), list(V.CANONICAL_LEVELS)).alias("level")).where("level IS NOT NULL")


def callouts_or_scan(found: DataFrame, pages: DataFrame, client: ModelClient, **asked) -> DataFrame:
    """Callouts that the text gave, and a scan of the images of those files that have none (M8)."""
    rest = pages.join(found.select("file_id").distinct(), "file_id", "left_anti")
    return found.select("file_id", "page", "label", "confidence").unionByName(callouts(rest, client, **asked))


_TYPE = "typeCode: string, displayName: string, letterHeight: string, hasBraille: boolean, hasInsert: boolean, dimensions: string, material: string, rawNote: string"


def schedule_types(pages: DataFrame, specs: DataFrame, client: ModelClient, **asked) -> DataFrame:
    """Sign types of each file (M9): from the images of its schedule pages, or from the text where the call fails or names none.

    pages: ``file_id, page, image``; specs, from the text: ``file_id, page, code, dimensions, material, features``. A code is
    trimmed; of a code that repeats in the text, in any case, the first page's counts. Braille and inserts of the text are what its features say.
    """
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "image"))), lambda p: p["image"]), "\n")
    called = ask(pages.groupBy("file_id").agg(parts.alias("prompt")), "schedule", client, **asked)
    called = called.select("file_id", F.from_json(repaired(F.col("response")), f"array<struct<{_TYPE}>>").alias("rows"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    code = F.trim(F.coalesce("t.typeCode", F.lit("")))
    visual = called.select("file_id", F.explode("rows").alias("t")).select(
        "file_id", code.alias("code"), F.trim(F.coalesce("t.displayName", "t.typeCode", F.lit(""))).alias("name"), yes("t.hasBraille").alias("has_braille"), yes("t.hasInsert").alias("has_insert"),
        F.col("t.dimensions").alias("dimensions"), F.col("t.material").alias("material"), F.col("t.rawNote").alias("note"), F.lit("visual").alias("method"),
    )
    without = called.where("coalesce(size(rows), 0) <= 0").select("file_id")
    says = lambda w: F.exists(F.coalesce("features", F.array().cast("array<string>")), lambda f: F.lower(f).contains(w))
    text = first_of(specs.join(without, "file_id", "left_semi").withColumn("_code", F.upper("code")), ["file_id", "_code"], ["page", "code"]).select(
        "file_id", "code", F.col("code").alias("name"), says("braille").alias("has_braille"), says("insert").alias("has_insert"), "dimensions", "material",
        F.when(F.size("features") > 0, F.array_join("features", "; ")).alias("note"), F.lit("text_fallback").alias("method"),
    )
    return visual.unionByName(text)


def enriched_specs(specs: DataFrame, client: ModelClient, **asked) -> DataFrame:
    """``file_id, code, image`` -> the same with the ``notes`` that the answer holds as JSON, three calls at a time; others have none."""
    asked = {"budget": Budget(lanes=3, in_flight=1)} | asked
    called = ask(specs, "spec_enrichment", client, prompt="image", **asked)
    bare = F.regexp_replace(F.regexp_replace(F.trim("response"), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return called.select(*specs.columns, F.when(F.left(bare, F.lit(1)) == "{", F.from_json(bare, "height string, width string, mounting_height string, has_braille_note boolean, confidence double")).alias("notes"))


def occupant_loads(pages: DataFrame, client: ModelClient, **asked) -> DataFrame:
    """``file_id, page, image`` -> ``file_id, page, room_number, load, occupancy``: rows that name a room and a load of 0 or more and under 10,000."""
    called = ask(pages, "occupant_loads", client, prompt="image", **asked)
    rows = F.from_json(repaired(F.col("response")), "array<struct<room_num: string, room_name: string, occupant_load: string, occupancy_group: string>>")
    d = called.select("file_id", "page", F.explode(rows).alias("r"))
    room = F.upper(F.trim(F.coalesce(F.nullif("r.room_num", F.lit("")), "r.room_name", F.lit(""))))
    d = d.select("file_id", "page", room.alias("room_number"), F.expr("try_cast(r.occupant_load AS double)").alias("load"), F.upper(F.trim("r.occupancy_group")).alias("occupancy"))
    return d.where("room_number <> '' AND load >= 0 AND load < 10000")


def classified_rooms(batches: DataFrame, client: ModelClient, most: float = 0.5, **asked) -> tuple[DataFrame, DataFrame]:
    """Batches of rooms (``job_id, batch, seq, room_name, confidence``; see ``asks_for_rooms``) -> the rooms with ``kind`` and the greater confidence where the model gave them, and the jobs of whose calls more than ``most`` failed."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "room_name"))), lambda r: F.concat(r["seq"].cast("string"), F.lit(" "), r["room_name"])), "\n")
    called = ask(batches.groupBy("job_id", "batch").agg(names.alias("prompt")), "room_classification", client, **asked)
    answers = F.from_json(repaired(F.col("response")), "array<struct<seq: long, kind: string, confidence: double>>")
    failed = F.col("error").isNotNull() | (F.size(F.coalesce(answers, F.array())) == 0)
    alerts = called.groupBy("job_id").agg(F.avg(failed.cast("int")).alias("failed")).where(F.col("failed") > most)
    said = called.select("job_id", "batch", F.explode(answers).alias("a")).select("job_id", "batch", F.col("a.seq").alias("seq"), F.col("a.kind").alias("kind"), F.col("a.confidence").alias("_said"))
    said = said.groupBy("job_id", "batch", "seq").agg(F.max_by("kind", "_said").alias("kind"), F.max("_said").alias("_said"))
    rooms = batches.join(said, ["job_id", "batch", "seq"], "left")
    return rooms.withColumn("confidence", F.greatest("confidence", "_said")).drop("_said"), alerts


def located_doors(signs: DataFrame, client: ModelClient, most: int = 20, keep: int = 3, **asked) -> DataFrame:
    """``job_id, page, sign_id, location`` -> one row for each of a page's first twenty signs, with the first three ``candidates`` on the page; none where the call fails."""
    asked_for = first_of(signs, ["job_id", "page"], ["sign_id"], most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sign_id", F.coalesce("location", F.lit("")).alias("l")))), lambda s: F.concat(s["sign_id"].cast("string"), F.lit(" "), s["l"])), "\n")
    called = ask(asked_for.groupBy("job_id", "page").agg(text.alias("prompt")), "locate_doors", client, **asked)
    rows = F.from_json(repaired(F.col("response")), "array<struct<signId: long, candidates: array<struct<x: double, y: double>>>>")
    told = called.select("job_id", "page", F.explode(rows).alias("r")).select("job_id", "page", F.col("r.signId").alias("sign_id"), F.col("r.candidates").alias("candidates"))
    told = told.groupBy("job_id", "page", "sign_id").agg(F.first("candidates").alias("candidates"))
    inside = F.filter(F.coalesce("candidates", F.array().cast("array<struct<x: double, y: double>>")), lambda c: c["x"].between(0, 1) & c["y"].between(0, 1))
    return asked_for.join(told, ["job_id", "page", "sign_id"], "left").withColumn("candidates", F.slice(inside, 1, keep))


def vectors(chunks: DataFrame, client: ModelClient, text: str = "text", **asked) -> DataFrame:
    """``chunks`` with ``vector`` (array of double), ten texts a call; null where the call fails (M14). The client has ``answers``, a JSON array of numbers for each text."""
    asked = {"budget": Budget(batch=10)} | asked
    return ask(chunks, "vectors", client, prompt=text, **asked).withColumn("vector", F.from_json("response", "array<double>")).drop("response", "error", "attempts", "duration_ms", "kept")


_SIGN = "sign_identifier string, location string, quantity long, confidence_score double, page long"


def extracted(pages: DataFrame, client: ModelClient, detail: Column | None = None, **asked) -> DataFrame:
    """Sign rows of every file, from the first pass that gives any (M4): floor plans' text, all text, images; one row for each identifier and location.

    pages: ``file_id, page, kind`` (``floor_plan`` or other), ``text, image, bytes``. ``found_by`` names the pass; pages of images are those of the document.
    """

    def text_pass(rows: DataFrame, kind: str) -> DataFrame:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda p: p["t"]), "\n")
        called = ask(rows.groupBy("file_id").agg(text.alias("prompt")), kind, client, **asked)
        return answered_rows(called, _SIGN).select("file_id", F.lit(kind).alias("found_by"), *[c.split(" ")[0] for c in _SIGN.split(", ")])

    def kept(rows: DataFrame) -> DataFrame:
        path = scratch(rows.sparkSession, "sign-rows")
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    plans = kept(text_pass(pages.where("kind = 'floor_plan'"), "floor_plan_text"))
    rest = pages.join(plans.select("file_id").distinct(), "file_id", "left_anti")
    general = kept(text_pass(rest, "general_text"))
    images = image_batches(rest.join(general.select("file_id").distinct(), "file_id", "left_anti"))
    seen = answered_rows(ask(images, "image_extraction", client, **asked), _SIGN).select("file_id", F.lit("image_extraction").alias("found_by"), *[c.split(" ")[0] for c in _SIGN.split(", ")])
    rows = plans.unionByName(general).unionByName(seen)
    return preferred(rows, ["file_id", "sign_identifier", "location"], F.col("quantity").isNotNull() if detail is None else detail, "confidence_score", "page")
