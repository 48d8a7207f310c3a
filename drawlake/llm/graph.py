"""Connected components of large graphs as joins: nobody holds the links of more than one node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (any order; loops and repeats allowed) -> ``node, root``: one root for each component; nodes without links are missing.

    Union by contraction: each node hooks to the smallest of itself and its neighbours, chains of hooks are followed
    once, and the links between what is left form the next, smaller graph. Node ids should be hashes or be in no
    order along the links, so that each round leaves a fraction of the nodes. No rows in, no rows out. A null end
    makes no link.
    """
    live = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        hook = materialize(hook, "hooks")
        over = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = materialize(hook.join(over, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "hooks")
        if labels is None:
            labels = hook.select("node", F.col("up").alias("root"))
        else:
            step = hook.select(F.col("node").alias("root"), F.col("up").alias("next"))
            labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        a, b = (hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in ("a", "b"))
        live = live.join(a, "a").join(b, "b").where("a_up <> b_up")
        live = materialize(live.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "links")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
