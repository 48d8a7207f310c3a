"""Checks V1-V7 over the rule engine's assignments (section 2.11): one aggregation gives every figure, a small table the findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The types that the summary counts; suite signs are counted beside it.
COUNTED = ("room_id", "room_id_insert", "restroom", "exit", "max_occupancy", "stair_corridor", "stair_landing", "in_case_of_fire", "evacuation_map", "office_directory")


def _total(c: str):
    return F.coalesce(F.sum(F.when(F.col(c) > 0, F.col(c))), F.lit(0)).cast("long")


def figures(assignments: DataFrame) -> DataFrame:
    """One row: everything that the checks compare."""
    levels = assignments.groupBy("level").agg(F.bool_or(F.coalesce(F.col("evacuation_map") > 0, F.lit(False))).alias("mapped"))
    level = levels.agg(F.count("*").alias("levels"), F.count_if(~F.col("mapped")).alias("unmapped"))
    a = assignments.agg(
        F.count("*").alias("rooms"),
        F.count_if((F.size("applied_rules") == 0) & (F.size("exclusion_reasons") == 0)).alias("incomplete"),
        F.count_if("is_stair").alias("stairs"),
        F.count_if("is_elevator").alias("elevators"),
        F.count_if(F.coalesce(F.col("max_occupancy") > 0, F.lit(False)) & (F.coalesce("exit", F.lit(0)) < 2)).alias("few_exits"),
        F.count_if(F.array_contains("applied_rules", "R10") & (F.coalesce("max_occupancy", F.lit(0)) == 0)).alias("no_capacity"),
        *[_total(c).alias(c) for c in (*COUNTED, "suite_id")],
    )
    return a.join(F.broadcast(level))  # one row each


def checks(assignments: DataFrame, stair_count: int | None = None, elevator_count: int | None = None, page_count: int = 1) -> DataFrame:
    """``check_id, severity, passed, found, expected``; counts that the caller knows replace those of the assignments."""
    f = figures(assignments)
    stairs = F.lit(stair_count) if stair_count is not None else F.col("stairs")
    lifts = F.lit(elevator_count) if elevator_count is not None else F.col("elevators")
    row = lambda i, s, ok, found, want: F.struct(F.lit(i).alias("check_id"), F.lit(s).alias("severity"), ok.alias("passed"), found.cast("long").alias("found"), want.cast("long").alias("expected"))
    zero = F.lit(0)
    every = F.array(
        row("V1", "error", F.col("incomplete") == 0, F.col("incomplete"), zero),
        row("V2", "error", F.col("stair_landing") == stairs, F.col("stair_landing"), stairs),
        row("V2-corridor", "error", (stairs == 0) | (F.col("stair_corridor") > 0), F.col("stair_corridor"), stairs),
        row("V3", "error", F.col("few_exits") == 0, F.col("few_exits"), zero),
        row("V4", "error", F.col("in_case_of_fire") == lifts, F.col("in_case_of_fire"), lifts),
        row("V6", "error", F.col("no_capacity") == 0, F.col("no_capacity"), zero),
        row("V7", "warning", F.col("unmapped") == 0, F.col("unmapped"), zero),
    )
    guard = F.array(row("V1-V7", "warning", F.lit(page_count == 0), zero, zero))
    return f.select(F.explode(F.when(F.col("rooms") > 0, every).otherwise(guard)).alias("c")).select("c.*")


def summary(assignments: DataFrame) -> DataFrame:
    """V5: ``kind, total`` of the types with signs, ``total_signs`` and ``total_signs_incl_suite``."""
    f = figures(assignments)
    total = sum((F.col(c) for c in COUNTED), F.lit(0))
    pairs = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("total")) for c in COUNTED]
    pairs += [F.struct(F.lit("total_signs").alias("kind"), total.alias("total")), F.struct(F.lit("total_signs_incl_suite").alias("kind"), (total + F.col("suite_id")).alias("total"))]
    return f.select(F.explode(F.filter(F.array(*pairs), lambda p: (p["total"] > 0) | p["kind"].startswith("total"))).alias("p")).select("p.*")


def questions(assignments: DataFrame) -> DataFrame:
    """Distinct notes of ambiguous rooms, in order of first occurrence."""
    note = F.concat(F.concat_ws(" ", "room_number", "room_name"), F.lit(" ["), F.coalesce("level", F.lit("")), F.lit("]: "), "ambiguity_note")
    return assignments.where("ambiguous AND ambiguity_note IS NOT NULL").groupBy(note.alias("question")).agg(F.min(F.struct("file_id", "seq")).alias("first")).orderBy("first").select("question")
