"""Windows, ranking, deduplication, runs and folds (E1-E11, F-1..F-10, G1-G6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrences(rows: DataFrame, key: list[Column], order: list, singleton_null: bool = False) -> DataFrame:
    """``occurrence_index, occurrence_total`` within equal keys (E1); singletons are 1/1 or null."""
    names = [f"_k{i}" for i in range(len(key))]
    d = rows.select("*", *[k.alias(n) for k, n in zip(key, names, strict=True)])
    w = Window.partitionBy(*names)
    total = F.count("*").over(w).cast("long")
    index = F.row_number().over(w.orderBy(*order)).cast("long")
    several = total > 1 if singleton_null else F.lit(True)
    d = d.select("*", F.when(several, index).alias("occurrence_index"), F.when(several, total).alias("occurrence_total"))
    return d.drop(*names)


def recomputed(rows: DataFrame, changed: DataFrame, key: list[str], order: list) -> DataFrame:
    """Occurrences of the groups that ``changed`` (old and new keys) names, the rest as they are."""
    touched = changed.select(*key).distinct()
    old = ["occurrence_index", "occurrence_total"]
    again = occurrences(rows.join(touched, key, "left_semi").drop(*old), [F.col(k) for k in key], order)
    return rows.join(touched, key, "left_anti").unionByName(again.select(*rows.columns))


def clustered_occurrences(rows: DataFrame, key: list[str], x: str, y: str, digits: int = 4) -> DataFrame:
    """Dense index of a key's places (coordinates rounded), by y then x, rows without a place last; null where there is one place only."""
    d = rows.withColumn("_x", F.round(x, digits)).withColumn("_y", F.round(y, digits))
    w = Window.partitionBy(*key)
    place = F.dense_rank().over(w.orderBy(F.col("_y").asc_nulls_last(), F.col("_x").asc_nulls_last())).cast("long")
    d = d.withColumn("_place", place).withColumn("_places", F.max("_place").over(w))
    several = F.col("_places") > 1
    return d.select(*rows.columns, F.when(several, F.col("_place")).alias("occurrence_index"), F.when(several, F.col("_places")).alias("occurrence_total"))


def first_of(rows: DataFrame, key: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key (E5, E6, E7, F-10)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def preferred(rows: DataFrame, key: list[str], has_detail: Column, confidence: str, order: str) -> DataFrame:
    """One row a key: with detail before without, then the most confident, then the earliest; rows with a null key all stay."""
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    w = Window.partitionBy(*key).orderBy(has_detail.desc(), F.col(confidence).desc_nulls_last(), F.col(order))
    one = rows.where(known).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.unionByName(rows.where(~known))


def merged_first(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row a key, each column its first value that is not null."""
    return rows.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def runs(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """Runs of consecutive positions of equal keys: ``start, end, n``."""
    w = Window.partitionBy(*key).orderBy(position)
    new = F.coalesce((F.col(position) != F.lag(position).over(w) + 1).cast("int"), F.lit(1))
    d = rows.select(*key, position, new.alias("_new")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*key, "_run").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("n")).drop("_run")


def sessions(rows: DataFrame, key: list[str], order: list, breaks: Column, name: str = "session") -> DataFrame:
    """Numbers from 1 the stretches between breaks; ``breaks`` may use lag over ``_w``-like windows and is true on first rows."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = rows.withColumn("_b", F.coalesce(breaks.cast("int"), F.lit(1)))
    return d.withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_b")


def gaps(rows: DataFrame, key: list[str], order: list, value: str) -> DataFrame:
    """Distance to the row before, null on first rows."""
    return rows.withColumn("gap", F.col(value) - F.lag(value).over(Window.partitionBy(*key).orderBy(*order)))


def paged(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """ORDER BY, LIMIT and OFFSET; the order must be total (F-1)."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def sorted_by(rows: DataFrame, column: str, allowed: dict[str, str], descending: bool, tie: str) -> DataFrame:
    """Order by a column that a caller names, from a list of those allowed, as text or number (F-4)."""
    if column not in allowed:
        raise ValueError(f"cannot sort by {column}")
    c = F.col(column).cast("double") if allowed[column] == "number" else F.lower(F.col(column).cast("string"))
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)


def canonical_order(column: Column, order: list[str]) -> list[Column]:
    """Sort keys: the place in a fixed list, what is not in it last, then by text (F-6)."""
    place = F.array_position(F.array(*map(F.lit, order)), column)
    return [F.when(place == 0, F.lit(len(order) + 1)).otherwise(place), column]


def budget_prefix(rows: DataFrame, key: list[str], order: list, size: str, budget: int) -> DataFrame:
    """A key's rows by order until the budget would be passed; nothing after the first that does not fit (F-8)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w).cast("long")).where(F.col("running") <= budget)


def folded(rows: DataFrame, key: list[str], order: list, step: Callable, columns: list[str], name: str, kind: str) -> DataFrame:
    """Rows with ``name``, what ``step(state, *values of columns)`` gives for each in the order of its key's rows; it returns the next state, and None to drop the row.

    state is None at a key's first row. Rows are read as a stream sorted by key, so a task holds one key's state and never
    its rows; a key's rows are one after the other in one task, as the fold asks.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{name}` {kind}"

    def run(batches):
        last, state = None, None
        for b in batches:
            out, keep = [], []
            keys = zip(*(b[c].tolist() for c in key), strict=True)
            for k, values in zip(keys, zip(*(b[c].tolist() for c in columns), strict=True), strict=True):
                k = tuple(None if v != v else v for v in k)
                if k != last:
                    last, state = k, None
                state, got = step(state, *values)
                keep.append(got is not None)
                if got is not None:
                    out.append(got)
            yield b[keep].assign(**{name: out})

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def next_fit(rows: DataFrame, key: list[str], order: str, size: str, capacity: int, truncate: int | None = None) -> DataFrame:
    """Batches in order: a row opens a new one when it does not fit in the last (F-9).

    What fits depends on all before it: a fold. Out come the key, the order, the size and ``batch`` from 1.
    """
    s = F.least(F.col(size), F.lit(truncate)) if truncate else F.col(size)

    def step(state, n):
        batch, used = state or (0, 0)
        batch, used = (batch, used + n) if batch and used + n <= capacity else (batch + 1, n)
        return (batch, used), batch

    return folded(rows.select(*key, order, s.cast("long").alias(size)), key, [order, size], step, [size], "batch", "long")


def anchored_lines(rows: DataFrame, key: list[str], y: str, seq: str, tolerance: float) -> DataFrame:
    """Groups of rows whose y is within the tolerance of their group's FIRST row, in order of y (G2, G4); ``line`` from 1.

    The anchor does not drift, so a row's group depends on where its group began: a fold.
    """

    def step(state, at):
        line, anchor = state or (0, 0.0)
        if not line or abs(at - anchor) > tolerance:
            line, anchor = line + 1, at
        return (line, anchor), line

    d = rows.select(*key, F.col(y).cast("double").alias("_y"), seq)
    return folded(d, key, ["_y", seq], step, ["_y"], "line", "long").drop("_y")
