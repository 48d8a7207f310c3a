"""Trees from parent pointers (A7, C17): cycles cut, ancestors by pointer jumping, joins whose number grows with the logarithm of the depth.

Nodes are joined by shuffles only, so that nothing that grows with them passes the driver. In every round a node's pointer jumps as far again as it reaches, so that a chain of a thousand entries takes ten rounds. Rounds are
tables, so that a lost executor repeats one of them and both sides of a join are shuffled for themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.operators.ranges import _written
from drawlake.operators.windows import folded


def _pointers(nodes: DataFrame, on: list[str], key: str, parent: str) -> DataFrame:
    """``on, k, up``: one row a key, the least parent where a key repeats; null for a parent that is not there."""
    there = nodes.where(F.col(key).isNotNull()).groupBy(*on, F.col(key).alias("k")).agg(F.min(parent).alias("up"))
    there = _written(there, "nodes")
    known = there.select(*on, F.col("k").alias("up"), F.lit(True).alias("_known"))
    return there.join(known.hint("merge"), [*on, "up"], "left").select(*on, "k", F.when(F.col("_known"), F.col("up")).alias("up"))


def cut_cycles(pointers: DataFrame, on: list[str]) -> DataFrame:
    """``on, k, up`` with one pointer of every cycle cut: that of its least key, which becomes a root.

    Pointers jump until no more nodes come to a root: what is left lies on a cycle or below one. Those jump on until they
    have gone as far as there are of them, with the least key that they pass; where they land is a cycle, and all of it
    is landed on.
    """
    left, count, reach = _written(pointers.where("up IS NOT NULL").withColumn("least", F.col("k")), "jumps"), -1, 1
    while True:
        n = left.count()
        if n == 0:
            return pointers
        # Depths leave no gap: a round in which nobody arrives has only cycles left, but for the reach that they still need.
        if n == count and reach >= n:
            break
        count = n
        # A node of the rest whose target is not in the rest has come to a root.
        far = left.select(*on, F.col("k").alias("up"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        left = _written(left.join(far.hint("merge"), [*on, "up"]).select(*on, "k", F.col("_up").alias("up"), F.least("least", "_least").alias("least")), "jumps")
        reach *= 2
    cycle = left.select(*on, F.col("up").alias("k")).distinct()
    cut = left.where("least = k").join(cycle.hint("merge"), [*on, "k"], "left_semi").select(*on, "k", F.lit(True).alias("_cut"))
    return pointers.join(_written(cut, "cuts").hint("merge"), [*on, "k"], "left").select(*on, "k", F.when(F.col("_cut").isNull(), F.col("up")).alias("up"))


def with_ancestors(nodes: DataFrame, on: list[str], key: str, parent: str, label: str) -> DataFrame:
    """``nodes`` with ``ancestors``, the labels above a node from the root down, and ``depth``.

    ``on`` names the tree (a file); null names join with nothing, so their nodes are roots. A parent that is not there is
    none. Cycles are cut above their least key. Where a key repeats, all its rows stay, with the ancestors that the least
    parent gives and, above others, the least label; rows with a null key are roots.
    """
    pointers = _written(cut_cycles(_written(_pointers(nodes, on, key, parent), "pointers"), on), "pointers")
    names = _written(nodes.where(F.col(key).isNotNull()).groupBy(*on, F.col(key).alias("up")).agg(F.min(label).alias("_name")), "names")
    # A path leads from below the node that the pointer shows, with it, to the node itself, without it.
    d = _written(pointers.join(names.hint("merge"), [*on, "up"], "left").select(*on, "k", "up", F.when(F.col("up").isNotNull(), F.array("_name")).otherwise(F.array().cast("array<string>")).alias("path")), "paths")
    done = None
    while True:
        arrived = d.where("up IS NULL")
        done = arrived if done is None else done.unionByName(arrived)
        going = d.where("up IS NOT NULL")
        if going.isEmpty():
            break
        # Those that have arrived are targets as well: done holds the whole way of everyone near the root.
        targets = done.unionByName(going).select(*on, F.col("k").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        d = _written(going.join(targets.hint("merge"), [*on, "up"]).select(*on, "k", F.col("_up").alias("up"), F.concat("_path", "path").alias("path")), "paths")
    done = done.select(*on, F.col("k").alias(key), F.col("path").alias("ancestors"))
    out = nodes.join(done.hint("merge"), [*on, key], "left").withColumn("ancestors", F.coalesce("ancestors", F.array().cast("array<string>")))
    return out.select(*nodes.columns, "ancestors", F.size("ancestors").alias("depth"))


def outline_of(entries: DataFrame) -> DataFrame:
    """Outline entries ``file_id, seq, parent, title, page`` as ``views.outline_leaves`` takes them: with ``ancestors``, ``depth`` and ``is_leaf``."""
    d = with_ancestors(entries, ["file_id"], "seq", "parent", "title")
    above = _written(entries.where("parent IS NOT NULL").select("file_id", F.col("parent").alias("seq"), F.lit(True).alias("_above")).distinct(), "above")
    return d.join(above.hint("merge"), ["file_id", "seq"], "left").withColumn("is_leaf", F.col("_above").isNull()).drop("_above")


def nested_sections(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """``file_id, seq, start_page, end_page``: the pages that entries span in the tree, up to the page before the next entry that is no deeper (C17), or the file's last page.

    ``entries`` have ``file_id, seq, page, depth``; those without a page, or in a file without pages, have no section.
    Entries follow each other by page and seq. They are read backwards, and a task holds one entry for each depth of a file.
    """

    def step(state, page, depth):
        later = [e for e in state or [] if e[0] <= depth]
        end = later[-1][1] - 1 if later else -1
        return [e for e in later if e[0] < depth] + [(depth, page)], end

    d = entries.where("page IS NOT NULL AND file_id IS NOT NULL").select("file_id", "seq", "page", "depth")
    d = folded(d, ["file_id"], [F.desc("page"), F.desc("seq")], step, ["page", "depth"], "_end", "int").join(pages.select("file_id", "page_count"), "file_id")
    end = F.when(F.col("_end") >= 0, F.col("_end")).otherwise(F.col("page_count"))
    return d.select("file_id", "seq", F.col("page").alias("start_page"), F.greatest("page", end).alias("end_page"))
