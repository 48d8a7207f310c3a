"""The takeoff of drawing sets from phrases to verified sign rows, one logical plan a table (section 3.1 of the survey)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.operators import classify as C
from drawlake.operators import labels as L
from drawlake.operators import rooms as R
from drawlake.operators import rules as U
from drawlake.operators import verify as V
from drawlake.operators import views as W
from drawlake.operators.windows import occurrences
from drawlake.functions.text import occurrence_key


@dataclass(frozen=True)
class Takeoff:
    """Tables of a run; each is lazy."""

    manifest: DataFrame
    rooms: DataFrame
    assignments: DataFrame
    signs: DataFrame
    checks: DataFrame


def takeoff(phrases: DataFrame, outline: DataFrame, index: DataFrame, loads: DataFrame | None = None, plaques: DataFrame | None = None) -> Takeoff:
    """Phrases, outline and drawing index of files -> manifest, rooms of the floor plans, assignments, numbered sign rows, checks.

    loads: ``seq, room_number, occupant_load``; plaques as the rule engine takes them.
    """
    numbers = W.sheet_number(phrases)
    title = phrases.where(F.col("y0") > 0.9).groupBy("file_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ").alias("title"))
    pages = phrases.select("file_id", "page").distinct().join(title, ["file_id", "page"], "left").join(numbers, ["file_id", "page"], "left")
    manifest = C.manifest(pages, outline, index)
    plans = manifest.where("bucket = 'floor_plan'").select("file_id", "page", F.col("level"))

    found = L.room_labels(phrases.join(plans.select("file_id", "page"), ["file_id", "page"], "left_semi"))
    rooms = found.join(plans, ["file_id", "page"]).select(
        "file_id", (F.col("page") * 100_000 + F.col("seq")).alias("seq"), "room_number", "room_name", F.coalesce("level", F.concat(F.lit("Page "), F.col("page").cast("string"))).alias("level"), F.col("page").alias("pdf_page"),
        F.lit(None).cast("int").alias("occupant_load"), F.lit(None).cast("string").alias("occupancy_group"), "door_count", "extraction_confidence", "x", "y",
    )
    rooms = R.deduplicated(rooms)
    if loads is not None:
        rooms = R.with_loads(rooms, loads)
    rooms = R.staff_only_by_neighbours(R.label_flags(rooms))
    anchors = L.zone_anchors(phrases)
    rooms = R.zone_qualifiers(rooms, anchors)

    assignments = U.assign(rooms, plaques)
    signs = occurrences(U.sign_rows(assignments), [F.col("file_id"), occurrence_key(F.col("sign_type"), F.col("sign_identifier"), F.col("location"), F.col("page_number").cast("string"))], ["seq"], singleton_null=True)
    return Takeoff(manifest, rooms, assignments, signs, V.checks(assignments))
