"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    """``count(*) FILTER (WHERE ...)`` as a long (D3)."""
    return F.count_if(condition).cast("long")


def sum_or_zero(value: Column) -> Column:
    """Sum, 0 over nothing."""
    return F.coalesce(F.sum(value), F.lit(0))


def with_total(rows: DataFrame, keys: list[str], aggregates: list[Column], label: str = "TOTAL") -> DataFrame:
    """Groups and one grand total, whose keys are ``label`` and null."""
    out = rows.rollup(*keys).agg(*aggregates, F.grouping_id().alias("_g"))
    out = out.where((F.col("_g") == 0) | (F.col("_g") == 2 ** len(keys) - 1))
    first = F.when(F.col("_g") > 0, F.lit(label)).otherwise(F.col(keys[0])).alias(keys[0])
    return out.select(first, *[c for c in out.columns if c not in (keys[0], "_g")])


def joined_set(value: Column, separator: str = ", ") -> Column:
    """Distinct values, sorted, as one string."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def mode_first(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Each key's most frequent value; of equals the one met first by ``order``."""
    n = rows.groupBy(*key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.struct(F.col(value), "n"), F.struct("n", (-F.col("first").cast("long")).alias("x")))
    return n.groupBy(*key).agg(best.alias("_")).select(*key, "_.*")


def upper_median(value: Column) -> Column:
    """The middle value; of two the greater, never their mean (D19). Exact: the group's values are collected, so groups are those of a page."""
    xs = F.sort_array(F.collect_list(value))
    return F.element_at(xs, (F.floor(F.size(xs) / 2) + 1).cast("int"))


def upper_median_distributed(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The same for groups of any size: counts per distinct value give each value its ranks, and the middle rank picks it."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key)
    upto = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("_upto", upto).withColumn("_mid", F.floor(F.sum("n").over(w) / 2) + 1)
    return n.where((F.col("_upto") >= F.col("_mid")) & (F.col("_upto") - F.col("n") < F.col("_mid"))).select(*key, F.col(value).alias("median"))


def unpivot_sums(rows: DataFrame, columns: list[str], key: list[str] | None = None) -> DataFrame:
    """Sum of each column as a row of its own (D13): columns are summed first, so only one row a group is unpivoted."""
    sums = rows.groupBy(*(key or [])).agg(*[sum_or_zero(F.col(c)).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return sums.selectExpr(*(key or []), f"stack({len(columns)}, {pairs}) AS (kind, total)")


def zero_filled(rows: DataFrame, dim: DataFrame, key: str, aggregates: dict[str, Column]) -> DataFrame:
    """One row for each member of a dimension, 0 where no row has it."""
    n = rows.groupBy(key).agg(*[c.alias(a) for a, c in aggregates.items()])
    return dim.join(n, key, "left").select(*dim.columns, *[F.coalesce(a, F.lit(0)).alias(a) for a in aggregates])


def one_source(value: Column) -> Column:
    """The only value of a group, ``mixed`` for several, ``none`` without any."""
    found = F.collect_set(value)
    return F.when(F.size(found) == 0, "none").when(F.size(found) == 1, found[0]).otherwise("mixed")


def dominant(value: Column, precedence: list[str]) -> Column:
    """Of the values that a group holds the first of a fixed order."""
    found = F.collect_set(value)
    out = F.when(F.array_contains(found, precedence[0]), precedence[0])
    for p in precedence[1:]:
        out = out.when(F.array_contains(found, p), p)
    return out


def share_of_total(rows: DataFrame, value: str, within: list[str] | None = None) -> DataFrame:
    """Each group's share of the total (T13); for rows that are groups already."""
    total = F.sum(value).over(Window.partitionBy(*(within or [])))
    return rows.withColumn("share", F.col(value) / total)


def array_totals(rows: DataFrame, key: list[str], sized: str, flattened: str) -> DataFrame:
    """``total``, the sum of the sizes of one array column, and ``members``, the distinct members of another, sorted (T11); null arrays count nothing."""
    n = F.when(F.col(sized).isNotNull(), F.size(sized)).otherwise(0)
    return rows.groupBy(*key).agg(F.sum(n).alias("total"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(flattened)))).alias("members"))


def slowest(rows: DataFrame, name: str, value: str, by: float = 1.1) -> DataFrame:
    """The greatest of few groups, if it is ``by`` times the next."""
    top = rows.orderBy(F.desc(value), name).limit(2).agg(F.max(F.struct(value, name)).alias("a"), F.min(value).alias("b"), F.count("*").alias("n"))
    return top.where((F.col("n") == 1) | (F.col(f"a.{value}") >= F.col("b") * by) & (F.col(f"a.{value}") > F.col("b"))).select(f"a.{name}", f"a.{value}")


def ordered_list(order: Column, value: Column) -> Column:
    """A group's values in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])
