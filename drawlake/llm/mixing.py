"""Mixing sources to target weights: hash-random keys, distributed prefix sums, exact cuts.

A source's documents are put in a random but repeatable order by the MD5 of their id and text. Rows of equal id and
text are one row with a count from the start, so that neither a bulk of null ids nor a row that repeats a million times
is a task of its own. The key's first hex digits are range buckets of that order. Sizes are summed per (source,
bucket); a running sum over the buckets and one inside each bucket give every document the number of words before it,
so that no task ever holds a whole source. A source's budget is then cut exactly: ``budget div size`` full epochs, and
one more pass that stops inside the document where the budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlake.llm.common import documents, materialize, row_hash, whole, word_count

#: Documents of a (source, bucket) at most, about: the unit of the second prefix sum.
ROWS_PER_BUCKET = 2000


def targets(per_source: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``source, source_size`` -> the same with ``target`` (double).

    Weights repeat over the sources by code point, null last, and share the sum of all sizes; a target stops
    at ``cap`` times its source's size and what is over goes to the others by weight. Sources in the order of
    size per weight reach their cap first, so that running sums in that order say which do. One row a source, in one
    task: sources are a vocabulary (a million of them would still be 50 MB), not hosts or documents.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = per_source.withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    )
    before = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * cap
    w = w.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0)))
    w = w.withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    w = w.withColumn("capped", F.col("rest") * F.col("w") > limit * F.col("rest_w"))
    w = w.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), limit)).over(everything), F.lit(0)))
    w = w.withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(everything), F.lit(0)))
    shared = (F.col("left") * F.col("w")).cast("double") / F.col("left_w").cast("double")
    return w.select("source", "source_size", F.when(F.col("capped"), limit.cast("double")).otherwise(shared).alias("target"))


def _name(source: Column) -> Column:
    """A source as a key that is never null, so that a null source joins like others."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _key(doc_id: Column, text: Column) -> Column:
    """The hash that orders a source's documents: rows that differ in id or text have different ones."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(whole(text))))


def _cuts(docs: DataFrame, text: str, source: str, doc_id: str, weights: tuple[int, ...], cap: int, rows_per_bucket: int, tie: Column | None = None) -> DataFrame:
    """One row for rows of equal id, text and ``tie``: ``key, tie, doc_id, size, n`` (how many), source_size, target, ``epochs`` of each and ``rest``, the words left for the last pass of the first of them."""
    ids = docs.select(
        _name(F.col(source)).alias("name"),
        F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("size"),
        _key(F.col(doc_id), F.col(text)).alias("key"), (F.lit(0).cast("long") if tie is None else tie).alias("tie"),
    )
    # Written, so that texts are cut into words once; equal rows meet before they are shuffled.
    ids = materialize(ids.groupBy("name", "source", "doc_id", "size", "key", "tie").agg(F.count("*").alias("n")), "mix-sizes")
    digits = max(1, math.ceil(math.log(max(ids.count() / rows_per_bucket, 1), 16)))
    d = ids.withColumn("bucket", F.substring("key", 1, digits))

    sums = d.groupBy("name", "source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("bucket_size"))
    earlier = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    goals = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("source").join(goals.select(_name(F.col("source")).alias("name"), "source_size", "target"), "name")

    d = d.join(offsets.select("name", "bucket", "offset", "source_size", "target"), ["name", "bucket"])
    inside = Window.partitionBy("name", "bucket").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0))
    d = d.withColumn("before", before).withColumn("epochs", epochs)
    rest = F.floor(F.col("target") + 0.5) - F.col("epochs") * F.col("source_size") - F.col("before")
    return d.select("key", "tie", "doc_id", "size", "n", "source_size", "target", "epochs", rest.alias("rest"))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each document.

    Null or empty texts have size 0 and take 0. A null source is a source of its own, last in order. Rows with the same
    id and text follow each other and are interchangeable; those with a null id are documents like others. An empty
    table gives an empty result. Columns that are not named are ignored.
    """
    d = _cuts(docs, text, source, doc_id, weights, cap, rows_per_bucket)
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("copy") * F.col("size")))
    return d.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The documents as the mix takes them, their columns as they are: as many whole copies as ``taken`` goes into the size, rounded half up.

    Documents without words are never taken. Whole rows move once, after the mix is known; rows that are equal in all
    columns are one row until they are copied.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tie = row_hash(docs)
    d = _cuts(docs, text, source, doc_id, weights, cap, rows_per_bucket, tie)
    # Of n equal rows the last pass takes so many whole ones, and one more if half of it or more is left.
    last = F.least(F.col("n"), F.greatest(F.lit(0), F.floor(F.col("rest") / F.col("size") + 0.5)))
    copies = d.where("size > 0").select("key", "tie", (F.col("epochs") * F.col("n") + last).cast("int").alias("copies")).where("copies > 0")
    rows = docs.select(_key(F.col(doc_id), F.col(text)).alias("key"), tie.alias("tie"), row.alias("row")).dropDuplicates(["key", "tie"])
    return rows.join(copies, ["key", "tie"]).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::BIGINT AS rest,
             (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS rest_w FROM w
      WINDOW b AS (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, rest * w > 3 * source_size * rest_w AS capped FROM r),
t AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE
        (((sum(source_size) OVER ())::BIGINT - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0)::BIGINT) * w)::DOUBLE
        / ((sum(w) OVER ())::BIGINT - coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0)::BIGINT)::DOUBLE END AS target FROM c),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef FROM d),
e AS (SELECT p.doc_id, p.size, t.source_size, t.target, p.bef, floor(t.target + 0.5)::BIGINT AS budget,
        CASE WHEN t.source_size > 0 THEN floor(t.target + 0.5)::BIGINT // t.source_size ELSE 0 END AS epochs
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - bef)))::BIGINT AS taken FROM e
"""
