"""Session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for comparable timestamps, adaptive plans with skew joins, and maps whose last value wins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; ``settings`` (underscores for dots are not translated) come on top."""
    builder = SparkSession.builder.appName("drawlake")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Where none is set a local one serves, on a local master only."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="drawlake-")
    return f"{base.rstrip('/')}/drawlake/{name}-{uuid.uuid4().hex}"
