"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every operator here means it: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables under this many bytes may be a single row group, which a single task would read; their rows are dealt to all cores.
SMALL = 32_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents. A small table is shuffled once so that all cores work on it; larger ones have row groups enough and stay where they are."""
    d = table(spark, sf_dir, "documents")
    size = int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return d.repartition(spark.sparkContext.defaultParallelism) if size < SMALL else d


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set a local one serves, on a local master only."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    now = spark.sparkContext.getCheckpointDir()
    if not now:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="drawlake-"))
        now = spark.sparkContext.getCheckpointDir()
    return now.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one, or that of the innermost ``scope``."""
    return _SCOPE.get() or f"{shared_dir(spark)}/drawlake/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession, name: str):
    """Tables that operators write inside go to a folder of their own; yields a call that deletes it, once its readers are done."""
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    token = _SCOPE.set(path)
    try:
        yield lambda: _delete(spark, path)
    finally:
        _SCOPE.reset(token)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_tables(spark: SparkSession) -> None:
    """Delete the tables that this application's operators wrote in the shared folder; for when nothing that reads them is left to run."""
    _delete(spark, run_dir(spark))


def frame(rows: Iterable[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows for Arrow as plain objects: long strings as pandas' own string type may be in chunks, which Arrow's struct arrays refuse."""
    return pd.DataFrame(list(rows), columns=columns, dtype=object)


def whole(text: Column) -> Column:
    """A text, null as the empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


def row_hash(docs: DataFrame) -> Column:
    """A hash of whole rows. Maps, which cannot be hashed, go through their JSON."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return F.xxhash64(F.to_json(row) if "map<" in docs.schema.simpleString() else row)


def words(text: Column) -> Column:
    """Array of the words of a text; none for null."""
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def whole_text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of whole texts hold fewer rows than the default of 10,000, so that long texts stay a few MB a batch.

    The setting is the session's and stays: plans are made when a result is asked for, long after this returns.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)
