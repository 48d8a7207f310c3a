"""The export of a job: all its sheets and the verification report as JSON lines, or nothing.

One Spark job writes every sheet into a folder of its own name, and a commit row makes it the job's export. A task that fails
leaves no commit: readers see the export before, or none.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from drawlake.operators import verify

_COMMIT = "export string, at timestamp"


def verification_report(assignments: DataFrame, **counts: int | None) -> DataFrame:
    """``kind, check, status, detail``: failed checks, questions, passed checks, and the overall result, which errors alone decide.

    ``counts`` go to ``verify.checks``. Sorted by kind as listed, questions by their first occurrence, this is the report's order.
    """
    c = verify.checks(assignments, **counts)
    figures = F.concat(F.col("check_id"), F.lit(": found "), F.col("found").cast("string"), F.lit(", expected "), F.col("expected").cast("string"))
    rows = c.select(
        F.when(F.col("passed"), "pass").otherwise(F.col("severity")).alias("kind"), F.col("check_id").alias("check"),
        F.when(F.col("passed"), "✓").when(F.col("severity") == "error", "✗").otherwise("⚠").alias("status"), F.when(F.col("passed"), "Passed").otherwise(figures).alias("detail"),
    )
    asked = verify.questions(assignments).select(F.lit("question").alias("kind"), F.lit("Question").alias("check"), F.lit("?").alias("status"), F.col("question").alias("detail"))
    found = rows.unionByName(asked)
    n = {k: F.count_if(F.col("kind") == k) for k in ("error", "warning", "question")}
    total = found.agg(*[v.alias(k) for k, v in n.items()])
    text = F.concat(F.col("error").cast("string"), F.lit(" error(s), "), F.col("warning").cast("string"), F.lit(" warning(s), "), F.col("question").cast("string"), F.lit(" question(s) for review"))
    passed = F.col("error") == 0
    overall = total.select(F.lit("overall").alias("kind"), F.lit("Overall Result").alias("check"), F.when(passed, "✓").otherwise("✗").alias("status"), F.when(passed, "All checks passed").otherwise(text).alias("detail"))
    return found.unionByName(overall)


def write_job(sheets: dict[str, DataFrame], folder: str) -> str:
    """Writes all sheets in one Spark job, then commits them; gives the export's name. Sheets are JSON lines; their order is that of their columns, not of the lines."""
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("sheet"), F.to_json(F.struct(*d.columns)).alias("value")) for name, d in sheets.items()])
    name = uuid.uuid4().hex
    rows.write.partitionBy("sheet").text(f"{folder}/{name}")
    done = rows.sparkSession.range(1).select(F.lit(name).alias("export"), F.current_timestamp().alias("at"))
    done.coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return name


def latest_export(spark: SparkSession, folder: str) -> str:
    """The name of the last committed export; LookupError where there is none."""
    try:
        last = spark.read.schema(_COMMIT).parquet(f"{folder}/commits").agg(F.max_by("export", F.struct("at", "export"))).first()[0]
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is None:
        raise LookupError(f"no export in {folder}")
    return last


def read_sheet(spark: SparkSession, folder: str, sheet: str, schema: StructType | str) -> DataFrame:
    """A sheet of the last committed export; one without rows is empty."""
    d = spark.read.schema("value string, sheet string").text(f"{folder}/{latest_export(spark, folder)}").where(F.col("sheet") == sheet)
    return d.select(F.from_json("value", schema).alias("_")).select("_.*")
