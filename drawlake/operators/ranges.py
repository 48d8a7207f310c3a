"""Running sums, earlier rows, ranks and nearest values over keys of any size: two levels, with carry rows between sampled ranges.

Rows are range-partitioned by key and order, so that a key that holds most of the rows lies over most of the tasks; each
range is written with its number. Sums run within a range of a key; what the earlier ranges of the key add up to is one small
row each and is carried in by an equi-join. No task holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.operators.joins import k_nearest
from drawlake.session import scratch


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _named(on: list[str]) -> Column:
    """A key as one string that is never null, so that null keys join like others."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in on]
    return F.concat(*parts) if parts else F.lit("")


def in_ranges(rows: DataFrame, on: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with ``_key`` and ``_range``, a table; ranges of a key follow its order. Rows that are equal in key and order share a range: let the order end in a column that tells them apart."""
    keyed = rows.withColumn("_key", _named(on))
    dealt = keyed.repartitionByRange(ranges, "_key", *order) if ranges else keyed.repartitionByRange("_key", *order)
    return _written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, on: list[str], order: list[Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """``rows`` with running sums over each key, the row itself included (F-8, E10). Null amounts add nothing; no rows in, no rows out."""
    d = in_ranges(rows.withColumns({f"_a_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}), on, order, ranges)
    total = d.groupBy("_key", "_range").agg(*[F.sum(f"_a_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = _written(total.select("_key", "_range", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]), "carries")
    inside = Window.partitionBy("_key", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(carry, ["_key", "_range"]).withColumns({n: F.col(f"_c_{n}") + F.sum(f"_a_{n}").over(inside) for n in sums})
    return out.select(*rows.columns, *sums)


def earlier(rows: DataFrame, on: list[str], order: list[Column], columns: dict[str, str], ranges: int | None = None) -> DataFrame:
    """``rows`` with values of the row before in their key (``columns``: new name to column), null for the first (E11); ``has_earlier`` tells a null value from none."""
    d = in_ranges(rows, on, order, ranges)
    inside = Window.partitionBy("_key", "_range").orderBy(*order)
    d = d.withColumn("_n", F.row_number().over(inside)).withColumn("_before", F.lag(F.struct(*columns.values())).over(inside))
    last = d.groupBy("_key", "_range").agg(F.max_by(F.struct(*columns.values()), "_n").alias("_last"))
    carry = _written(last.select("_key", "_range", F.lag("_last").over(Window.partitionBy("_key").orderBy("_range")).alias("_carry")), "carries")
    before = F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_before"))
    out = d.join(carry, ["_key", "_range"]).withColumn("_before", before)
    return out.select(*rows.columns, *[F.col("_before")[c].alias(n) for n, c in columns.items()], F.col("_before").isNotNull().alias("has_earlier"))


def islands(rows: DataFrame, on: list[str], position: str, gap: int = 1, ranges: int | None = None) -> DataFrame:
    """Runs of positions at most ``gap`` apart: ``on, first, last, rows`` of each (E10, G1), over keys of any size. Positions that repeat are in one run; nulls in none."""
    d = earlier(rows.where(F.col(position).isNotNull()).select(*on, position).withColumn("_id", F.monotonically_increasing_id()), on, [F.col(position), F.col("_id")], {"_p": position}, ranges)
    starts = F.when(F.col("has_earlier") & (F.col(position) - F.col("_p") <= gap), 0).otherwise(1)
    d = running(d.withColumn("_starts", starts), on, [F.col(position), F.col("_id")], {"_run": F.col("_starts")}, ranges)
    return d.groupBy(*on, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("rows")).drop("_run")


def budget_prefix(rows: DataFrame, on: list[str], order: list[Column], size: str, budget: float, ranges: int | None = None) -> DataFrame:
    """Each key's rows in order as long as their sizes add up to the budget at most (F-8), over keys of any size."""
    return running(rows, on, order, {"_sum": F.col(size)}, ranges).where(F.col("_sum") <= budget).drop("_sum")


def nearest_of_any(left: DataFrame, right: DataFrame, on: list[str], x: str, rx: str, tie: str, k: int, ranges: int | None = None) -> DataFrame:
    """Of each left row the k right rows of equal ``on`` with the nearest value, with ``distance`` and ``rank`` (C12); like ``nearest_by_value``, for keys of any size.

    Right rows have their ranks upwards and downwards from running counts over ranges, left rows the count of right rows below
    them; the k ranks on either side meet by equality. ``tie`` tells right rows apart. Rows without a key or a value have no
    neighbours. Left columns other than ``on`` and right columns must have different names.
    """
    there = F.lit(True)
    for c in on:
        there = there & F.col(c).isNotNull()
    one = {"_n": F.lit(1)}
    r = right.where(F.col(rx).isNotNull() & there)
    up = running(r, on, [F.col(rx).asc(), F.col(tie).asc()], one, ranges).withColumnRenamed("_n", "_up")
    down = running(up, on, [F.col(rx).desc(), F.col(tie).asc()], one, ranges).withColumnRenamed("_n", "_down")
    numbered = _written(down, "numbered")
    every = numbered.groupBy(*on).agg(F.count("*").alias("_all"))
    ours = left.where(F.col(x).isNotNull() & there).select(*on, F.col(x).alias("_v"), F.lit(0).alias("_r"), F.monotonically_increasing_id().alias("_t"), F.struct(*left.columns).alias("_l"))
    marks = ours.unionByName(numbered.select(*on, F.col(rx).alias("_v"), F.lit(1).alias("_r"), F.col("_up").cast("long").alias("_t")), allowMissingColumns=True)
    below = running(marks, on, [F.col("_v").asc(), F.col("_r").asc(), F.col("_t").asc()], {"_below": F.col("_r")}, ranges).where("_r = 0").join(every, on)
    steps = F.sequence(F.lit(1), F.lit(k))
    near = F.concat(F.transform(steps, lambda i: F.struct(F.lit("_up").alias("s"), (F.col("_below") + i).alias("n"))), F.transform(steps, lambda i: F.struct(F.lit("_down").alias("s"), (F.col("_all") - F.col("_below") + i).alias("n"))))
    asked = below.select("_l", F.explode(near).alias("_a")).select("_l.*", F.col("_a.s").alias("_side"), F.col("_a.n").cast("long").alias("_n"))
    sides = F.array(*[F.struct(F.lit(c).alias("s"), F.col(c).cast("long").alias("n")) for c in ("_up", "_down")])
    sided = numbered.withColumn("_e", F.explode(sides)).select(*right.columns, F.col("_e.s").alias("_side"), F.col("_e.n").alias("_n"))
    pairs = asked.join(sided, [*on, "_side", "_n"]).withColumn("distance", F.abs(F.col(x) - F.col(rx)))
    # A row within k on both sides is met twice.
    pairs = pairs.drop("_side", "_n").dropDuplicates([*left.columns, tie])
    return k_nearest(pairs, left.columns, "distance", tie, k)
