"""Knowledge files: front matter (A9, A10, T37), validation (S1, S5), chunks (S2), upsert (S3, A20), vector query."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from drawlake.functions import vocab as V
from drawlake.functions.text import chunk_id, trimmed
from drawlake.session import scratch


def knowledge_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of the .md and .txt files of a folder and those below it, without README.md."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt}").text(folder, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).where(~F.col("path").rlike("(?i)/README\\.md$"))


def front_matter(files: DataFrame) -> DataFrame:
    """``metadata`` (flat ``key: value`` lines, quotes stripped, the last of a key) and ``body`` beside the columns (A10)."""
    # The pattern ends with the header, however long the body is.
    head = F.regexp_extract("content", r"^---\r?\n[\s\S]*?\r?\n---\r?\n?", 0)
    d = files.withColumn("_head", F.coalesce(head, F.lit("")))
    lines = F.filter(F.split(F.regexp_extract("_head", r"^---\r?\n([\s\S]*?)\r?\n---\r?\n?$", 1), r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    entry = lambda x: F.struct(trimmed(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), F.regexp_replace(trimmed(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), "^[\"']|[\"']$", "").alias("v"))
    entries = F.filter(F.transform(lines, entry), lambda e: e["k"] != "")
    # Of a repeated key the last line counts: earlier ones are left out before the map is made. Entries are a column, which the lambda does not make anew for each.
    d, made = d.withColumn("_entries", entries), F.col("_entries")
    last = F.filter(made, lambda e, i: ~F.exists(F.slice(made, i + 2, F.size(made)), lambda o: o["k"] == e["k"]))
    d = d.withColumn("metadata", F.when(F.col("_head") != "", F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>")))
    return d.withColumn("body", trimmed(F.expr("substring(content, length(_head) + 1)"))).drop("_head", "_entries")


def metadata_errors(metadata: Column) -> Column:
    """What is missing or not allowed, as a list; empty for valid metadata."""
    get = lambda k: F.try_element_at(metadata, F.lit(k))
    missing = [F.when(F.coalesce(F.trim(get(k)), F.lit("")) == "", F.lit(f"missing {k}")) for k in V.KNOWLEDGE_FIELDS]
    given = lambda k: F.coalesce(get(k), F.lit("")) != ""
    wrong = [
        F.when(given("status") & ~get("status").isin(*V.KNOWLEDGE_STATUS), F.lit("invalid status")),
        F.when(given("effective_date") & ~get("effective_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("invalid effective_date")),
        F.when(given("doc_type") & ~get("doc_type").isin(*V.KNOWLEDGE_TYPES), F.lit("invalid doc_type")),
    ]
    return F.array_compact(F.array(*missing, *wrong))


def validation_report(files: DataFrame) -> DataFrame:
    """Counts of valid files and of each error."""
    e = files.select(metadata_errors(F.col("metadata")).alias("e"))
    return e.select(F.explode(F.when(F.size("e") == 0, F.array(F.lit("valid"))).otherwise(F.col("e"))).alias("finding")).groupBy("finding").agg(F.count("*").alias("n"))


def chunk_spans(text: str | None, size: int = 2000, overlap: int = 200, least: int = 50) -> Iterator[tuple[int, int, int, str]]:
    """``(index, start, end, text)``: cuts at the sentence end nearest before the size, the next chunk begins the overlap earlier."""
    clean = re.sub(r"\n{3,}", "\n\n", text or "").strip()
    start = index = 0
    while start < len(clean):
        end = min(start + size, len(clean))
        if end < len(clean):
            low = max(0, end - overlap)
            ends = [at + len(e) for e in V.SENTENCE_ENDS if (at := clean.rfind(e, low, min(end + overlap, end + len(e)))) >= 0]
            end = min(ends, key=lambda p: abs(p - (start + size)), default=end)
        piece = clean[start:end].strip()
        if len(piece) >= least:
            yield index, start, end, piece
            index += 1
        if end >= len(clean):
            return
        start = max(end - overlap, start + 1)


#: Whole texts that a task hands to Python at a time.
TEXTS = 1_000


def chunks(files: DataFrame, body: str = "body", texts: bool = True, **sizes: int) -> DataFrame:
    """The rows of ``files``, one for each chunk, with ``chunk_index, start_char, end_char, chunk``; where a cut falls depends on the cuts before it.

    Without ``texts`` the column ``chunk`` is left out, and no text comes back from Python. Arrow batches hold TEXTS rows at most: the
    session's setting is lowered and stays so, as plans run long after this returns.
    """
    conf, setting = files.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(setting)) <= TEXTS:
        conf.set(setting, TEXTS)
    names = ("chunk_index", "start_char", "end_char", "chunk")[: 4 if texts else 3]

    def split(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda t: [dict(zip(names, c, strict=False)) for c in chunk_spans(t, **sizes)])

    made = pandas_udf(split, f"array<struct<chunk_index:int,start_char:int,end_char:int{',chunk:string' if texts else ''}>>")(F.col(body))
    return files.withColumn("_c", F.explode(made)).select(*[c for c in files.columns if c != body], "_c.*")


def chunk_rows(files: DataFrame, texts: bool = True) -> DataFrame:
    """Chunks of the valid files with their ids and metadata, ready for the store (S3); without their texts if not ``texts``."""
    # A filter would be pushed below the header and read it anew for each field: an invalid file has a null body instead, which has no chunks.
    valid = F.size(metadata_errors(F.col("metadata"))) == 0
    c = chunks(files.select("path", "metadata", F.when(valid, F.col("body")).alias("body")), texts=texts)
    return c.withColumn("chunk_id", F.concat_ws("_", chunk_id(F.col("path")), F.col("chunk_index").cast("string")))


def last_of_key(rows: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row a key: the last by ``order``, without one, and among equals, that of the greatest hash, so that reruns agree. Rows with a null key stay."""
    by = F.struct(*(order or []), F.xxhash64(F.to_json(F.struct(*rows.columns))))
    keyed = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), by).alias("_")).select("_.*")
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def upserted(store: DataFrame, rows: DataFrame, key: str = "chunk_id", order: list[str] | None = None) -> DataFrame:
    """The store with rows replaced or added by key (A20); of rows that repeat a key the last by ``order`` (see ``last_of_key``). They are written once, as they are read twice."""
    rows = last_of_key(rows, key, order)
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "upserted")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    return store.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where a length is zero or not finite."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((norm > 0) & (norm < float("inf")), dot(a, b) / norm)


def vector_query(store: DataFrame, vector: list[float], n: int = 5, keep: Column | None = None, embedding: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The n rows nearest to a vector with ``score`` = (1 + cosine) / 2, of those that the filter keeps."""
    d = store if keep is None else store.where(keep)
    q = F.array(*[F.lit(float(x)) for x in vector])
    return d.withColumn("score", (1 + cosine(F.col(embedding), q)) / 2).orderBy(F.desc_nulls_last("score"), tie).limit(n)
