"""Joins beyond the built-in kinds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rules that a condition join may hold against every row.
MOST_RULES = 10_000


def latest(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last row by ``order``: one aggregation in place of correlated subqueries (C5, F-2)."""
    picked = F.max_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(*key).agg(picked.alias("_")).select(*key, "_.*")


def lookup(rows: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a dimension; adaptive execution broadcasts it where its measured size allows."""
    return rows.join(dim, on, "left")


def not_found(rows: DataFrame, known: DataFrame, keys: list[Column], known_keys: list[Column]) -> DataFrame:
    """Rows whose normalised key is not among the known; rows with a null key stay."""
    names = [f"_k{i}" for i in range(len(keys))]
    left = rows.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    right = known.select(*[k.alias(n) for k, n in zip(known_keys, names, strict=True)]).distinct()
    return left.join(right, names, "left_anti").drop(*names)


def first_by_priority(rows: DataFrame, rules: DataFrame, key: list[str], condition: Column, order: list[str], columns: list[str]) -> DataFrame:
    """For each row the columns of the first rule, by ``order``, that meets the condition; null without one.

    Rules are a bounded table (templates, sections, plaques) of MOST_RULES rows at most, which is counted (ValueError
    beyond): they are broadcast. The rows' key must be unique.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    hit = rows.join(F.broadcast(rules), condition, "left")
    best = F.min_by(F.struct(*columns), F.struct(*order))
    kept = [c for c in rows.columns if c not in key]
    return hit.groupBy(*key).agg(*[F.first(c).alias(c) for c in kept], best.alias("_")).select(*rows.columns, "_.*")


def band_join(left: DataFrame, right: DataFrame, on: list[str], x: str, rx: str, width: float) -> DataFrame:
    """Rows of both sides with equal ``on`` and |x - rx| <= width, by an equi-join on cells of that width and their neighbours."""
    cell = F.floor(F.col(x) / width).cast("long")
    near = left.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    other = right.withColumn("_cell", F.floor(F.col(rx) / width).cast("long"))
    return near.join(other, [*on, "_cell"]).where(F.abs(F.col(x) - F.col(rx)) <= width).drop("_cell")


def dealt_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An equi-join whose pairs cost more than its rows: both sides are dealt by the key to spark.sql.shuffle.partitions parts, which are not joined up.

    Pairs that are compared at length (the texts of a page) come from few bytes. By those alone adaptive execution would make one part of
    them, or leave them with the few tasks that read the table.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *on).join(right.repartition(n, *on).hint("merge"), on)


def nearest(pairs: DataFrame, key: list[str], distance: str, tie: str, columns: list[str]) -> DataFrame:
    """Of each key's candidate pairs the closest; ties by ``tie``."""
    return pairs.groupBy(*key).agg(F.min_by(F.struct(*columns, distance), F.struct(distance, tie)).alias("_")).select(*key, "_.*")


def k_nearest(pairs: DataFrame, key: list[str], distance: str, tie: str, k: int = 5) -> DataFrame:
    """Of each key's candidate pairs the k closest, with their rank."""
    w = Window.partitionBy(*key).orderBy(distance, tie)
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def nearest_by_value(left: DataFrame, right: DataFrame, on: list[str], x: str, rx: str, tie: str, k: int) -> DataFrame:
    """Of each left row the k right rows of equal ``on`` with the nearest value, ties by ``tie``, with ``distance`` and ``rank``.

    Never all pairs: right rows are numbered upwards and downwards by value, a running count says how many stand below a
    left row, and the k numbers on either side are joined by equality. Rows without a value have no neighbours. Left
    columns other than ``on`` and right columns must have different names.
    """
    r = right.where(F.col(rx).isNotNull())
    up, down = Window.partitionBy(*on).orderBy(F.col(rx).asc(), tie), Window.partitionBy(*on).orderBy(F.col(rx).desc(), tie)
    r = r.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down))
    marks = left.where(F.col(x).isNotNull()).select(*on, F.col(x).alias("_v"), F.lit(0).alias("_r"), F.struct(*left.columns).alias("_l"))
    marks = marks.unionByName(r.select(*on, F.col(rx).alias("_v"), F.lit(1).alias("_r")), allowMissingColumns=True)
    # Right rows below a left row: those counted before it, as at equal values left rows come first.
    below = Window.partitionBy(*on).orderBy("_v", "_r").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("_below", F.sum("_r").over(below)).withColumn("_all", F.sum("_r").over(Window.partitionBy(*on))).where("_r = 0")
    near = F.concat(
        F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct(F.lit("_up").alias("side"), (F.col("_below") + i).cast("int").alias("n"))),
        F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct(F.lit("_down").alias("side"), (F.col("_all") - F.col("_below") + i).cast("int").alias("n"))),
    )
    asked = marks.select("_l", F.explode(near).alias("_a")).select("_l.*", F.col("_a.side").alias("_side"), F.col("_a.n").alias("_n"))
    sides = F.array(*[F.struct(F.lit(c).alias("s"), F.col(c).alias("n")) for c in ("_up", "_down")])
    numbered = r.withColumn("_e", F.explode(sides)).select(*right.columns, F.col("_e.s").alias("_side"), F.col("_e.n").alias("_n"))
    pairs = asked.join(numbered, [*on, "_side", "_n"]).withColumn("distance", F.abs(F.col(x) - F.col(rx)))
    return k_nearest(pairs, left.columns, "distance", tie, k).drop("_side", "_n")


def greedy_pairs(pairs: DataFrame, group: list[str], left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs within each group: left rows in order take their best free right row, the first of equals.

    What a left row may take depends on all before it, so a group's candidates are taken one after the other, in time
    that grows with their number; left rows are not null. A group is a job or a page; its candidates are those that an equi-join leaves.
    """
    from drawlake.operators.windows import folded

    def step(state, a, b):
        last, used = state or (None, set())
        if a == last or b in used:
            return (last, used), None
        used.add(b)
        return (a, used), True

    d = pairs.select(*group, left, right, score)
    return folded(d, group, [left, F.desc(score), right], step, [left, right], "_taken", "boolean").drop("_taken")


def greedy_members(rows: DataFrame, group: list[str], left: str, right: str, score: Callable[[Column, Column], Column], least: float) -> DataFrame:
    """What ``greedy_pairs`` gives over the pairs of each group's distinct left and right values with a score of ``least`` or more, without making the pairs.

    Rows hold a left and a right value each; nulls pair with nothing. They meet once, by group, and a group's values are two
    arrays, folded where they are: nothing is joined or sorted by pair. So a group's values must fit a task, and its work is their product.
    The partitions are not joined up: their number is spark.sql.shuffle.partitions, so that a task's part stays small.
    """
    n, kinds = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), dict(rows.dtypes)
    d = rows.select(*group, left, right).where(" AND ".join(f"`{g}` IS NOT NULL" for g in group)).repartition(n, *group)
    d = d.groupBy(*group).agg(F.sort_array(F.collect_set(left)).alias("_l"), F.sort_array(F.collect_set(right)).alias("_r"))

    def take(state: Column, a: Column) -> Column:
        scored = F.transform(state["free"], lambda b: F.struct((-score(a, b).cast("double")).alias("s"), b.alias("r")))
        best = F.array_min(F.filter(scored, lambda c: c["s"] <= -least))

        def after(b: Column) -> Column:
            pair = F.struct(a.alias("l"), b["r"].alias("r"), (-b["s"]).alias("s"))
            return F.struct(F.filter(state["free"], lambda r: r != b["r"]).alias("free"), F.concat(state["out"], F.array(pair)).alias("out"))

        # An array of one, so that the best is sought once.
        return F.transform(F.array(best), lambda b: F.when(b.isNull(), state).otherwise(after(b)))[0]

    start = F.struct(F.col("_r").alias("free"), F.array().cast(f"array<struct<l:{kinds[left]},r:{kinds[right]},s:double>>").alias("out"))
    taken = F.aggregate("_l", start, take, lambda state: state["out"])
    return d.select(*group, F.explode(taken).alias("_")).select(*group, F.col("_.l").alias(left), F.col("_.r").alias(right), F.col("_.s").alias("score"))


def or_join_first(left: DataFrame, right: DataFrame, conditions: list[tuple[list[Column], list[Column]]], left_id: str, right_id: str, right_columns: list[str]) -> DataFrame:
    """An OR of equalities as a union of equi-joins; of several right rows the first by id (C20)."""
    found = None
    for lk, rk in conditions:
        names = [f"_k{i}" for i in range(len(lk))]
        a = left.select(left_id, *[k.alias(n) for k, n in zip(lk, names, strict=True)])
        b = right.select(right_id, *right_columns, *[k.alias(n) for k, n in zip(rk, names, strict=True)])
        hit = a.join(b, names).drop(*names)
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(left_id).agg(F.min_by(F.struct(right_id, *right_columns), right_id).alias("_")).select(left_id, "_.*")
    return left.join(best, left_id, "left")

