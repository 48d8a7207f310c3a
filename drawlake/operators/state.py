"""Changes of state as new versions of a table (N1-N9, N11, A19, A20): Parquet has no UPDATE, so each gives the rows that replace a job's partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.operators.aggregates import count_where


def protected() -> Column:
    """Rows that a rescan leaves alone: verified or added by hand."""
    return F.coalesce("verified", F.lit(False)) | F.coalesce("manual", F.lit(False))


def rescanned(old: DataFrame, new: DataFrame, jobs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """After a full rescan of some jobs, or of single files: protected rows and the new ones; other jobs as they are."""
    on = ["job_id"] if files is None else ["job_id", "file_id"]
    scope = (jobs if files is None else files).select(*on).distinct().withColumn("_scope", F.lit(True))
    kept = old.join(scope, on, "left").where(F.col("_scope").isNull() | protected()).drop("_scope")
    return kept.unionByName(new, allowMissingColumns=True)


def merged(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Additive merge: null columns of unprotected rows are filled, unknown keys are added."""
    n = new.dropDuplicates(keys).select(*keys, *[F.col(c).alias("_new_" + c) for c in columns])
    d = old.join(n, keys, "left")
    filled = {c: F.when(protected(), F.col(c)).otherwise(F.coalesce(F.col(c), F.col("_new_" + c))) for c in columns}
    kept = d.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in old.columns])
    return kept.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def applied(old: DataFrame, changes: DataFrame, key: str, content: list[str]) -> DataFrame:
    """A change log (``seq, op`` create, patch or delete, columns) applied: the last change of a row counts; a change of content verifies it, one of place does not."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), "seq").alias("c"))
    d = old.join(last, key, "full")
    gone = F.coalesce(F.col("c.op") == "delete", F.lit(False))
    edited = F.lit(False)
    for c in content:
        edited = edited | (F.col(f"c.{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"c.{c}")))
    have = set(changes.columns)
    cols = []
    for c in old.columns:
        if c == key:
            cols.append(F.col(c))
        elif c == "verified":
            cols.append(F.when(F.col("c.op") == "patch", F.coalesce(F.col(c), F.lit(False)) | edited).otherwise(F.coalesce(F.col(c), F.lit(False))).alias(c))
        else:
            cols.append((F.coalesce(F.col(f"c.{c}"), F.col(c)) if c in have else F.col(c)).alias(c))
    return d.where(~gone).select(*cols)


def without_jobs(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """The rows of jobs that are left: deletes cascade by anti-join."""
    return rows.join(deleted.select("job_id").distinct(), "job_id", "left_anti")


def detached(rows: DataFrame, parents: DataFrame, column: str, key: str) -> DataFrame:
    """A reference whose row is gone becomes null."""
    known = parents.select(F.col(key).alias(column)).distinct().withColumn("_there", F.lit(True))
    d = rows.join(known, column, "left")
    return d.withColumn(column, F.when(F.col("_there"), F.col(column))).select(*rows.columns)


def toggled(pages: Column, page: Column) -> Column:
    """A list with the page taken out if it is in, else added."""
    return F.when(F.array_contains(pages, page), F.array_remove(pages, page)).otherwise(F.array_append(pages, page))


def job_status(files: DataFrame) -> DataFrame:
    """A job fails only if all its files fail; it runs while one does."""
    g = files.groupBy("job_id").agg(F.count("*").alias("n"), count_where(F.col("status") == "failed").alias("failed"), count_where(F.col("status").isin("pending", "processing")).alias("open"), count_where(F.col("status") == "processing").alias("running"))
    s = F.when(F.col("running") > 0, "processing").when(F.col("open") == F.col("n"), "pending").when(F.col("open") > 0, "processing").when(F.col("failed") == F.col("n"), "failed").otherwise("completed")
    return g.select("job_id", s.alias("status"))


def empty_jobs(jobs: DataFrame, signs: DataFrame) -> DataFrame:
    """Finished jobs without a single sign: a warning of the bulk rescan."""
    return jobs.where("status = 'completed'").join(signs.select("job_id").distinct(), "job_id", "left_anti")


def adopted(jobs: DataFrame, default_org: int) -> DataFrame:
    """Jobs without an organisation go to the default one."""
    return jobs.withColumn("org_id", F.coalesce("org_id", F.lit(default_org)))


def compared(text: DataFrame, image: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of both passes with ``found_by`` text, image or both; paired ones gain .15 of confidence up to 1."""
    p = pairs.select("text_id", "image_id")
    t = text.join(p.select(F.col("text_id").alias("id"), "image_id"), "id", "left").withColumn("found_by", F.when(F.col("image_id").isNotNull(), "both").otherwise("text")).drop("image_id")
    i = image.join(p.select(F.col("image_id").alias("id")), "id", "left_anti").withColumn("found_by", F.lit("image"))
    d = t.unionByName(i, allowMissingColumns=True)
    return d.withColumn("confidence", F.when(F.col("found_by") == "both", F.least(F.lit(1.0), F.col("confidence") + 0.15)).otherwise(F.col("confidence")))
