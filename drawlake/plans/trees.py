"""Queries over a tree that is laid on a table, with cycles in it, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.operators import trees as O
from drawlake.plans.registry import query
from drawlake.sources.tables import table

#: Seven files; in each a tree by halves, where entries 5 and 6 of every 97 stand above each other.
_TREE_SQL = """n AS (SELECT p_partkey % 7 AS file_id, p_partkey // 7 AS seq, p_name AS title, p_size AS page, CASE WHEN p_partkey // 7 = 0 OR p_partkey // 7 % 97 = 5 THEN NULL WHEN p_partkey // 7 % 97 = 6 THEN p_partkey // 7 - 1 ELSE (p_partkey // 7 - 1) // 2 END AS parent FROM part),
t AS (SELECT file_id, seq, title, page, ''::VARCHAR AS above, 0 AS depth FROM n WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM n m WHERE m.file_id = n.file_id AND m.seq = n.parent)
      UNION ALL SELECT n.file_id, n.seq, n.title, n.page, t.above || '/' || t.title, t.depth + 1 FROM n JOIN t ON n.file_id = t.file_id AND n.parent = t.seq)"""


def _entries(spark, root):
    p = table(spark, root, "part", ["p_partkey", "p_name", "p_size"])
    seq = F.floor(F.col("p_partkey") / 7)
    parent = F.when(seq == 0, F.lit(None)).when(seq % 97 == 5, seq + 1).when(seq % 97 == 6, seq - 1).otherwise(F.floor((seq - 1) / 2))
    return p.select((F.col("p_partkey") % 7).alias("file_id"), seq.alias("seq"), parent.alias("parent"), F.col("p_name").alias("title"), F.col("p_size").alias("page"))


@query("A7", f"WITH RECURSIVE {_TREE_SQL} SELECT file_id, seq, above, depth, NOT EXISTS (SELECT 1 FROM n WHERE n.file_id = t.file_id AND (n.parent = t.seq OR n.seq % 97 = 5 AND n.seq + 1 = t.seq)) AS is_leaf FROM t")
def outline_tree(spark, root):
    """Entries with what stands above them, from parent pointers with cycles."""
    d = O.outline_of(_entries(spark, root))
    above = F.array_join(F.transform("ancestors", lambda a: F.concat(F.lit("/"), a)), "")
    return d.select("file_id", "seq", above.alias("above"), "depth", "is_leaf")


@query(
    "C17",
    f"""WITH RECURSIVE {_TREE_SQL} SELECT a.file_id, a.seq, a.page AS start_page, greatest(a.page, coalesce(min(b.page) - 1, 60))::INT AS end_page
        FROM t a LEFT JOIN t b ON b.file_id = a.file_id AND b.depth <= a.depth AND (b.page > a.page OR b.page = a.page AND b.seq > a.seq) GROUP BY a.file_id, a.seq, a.page""",
)
def tree_sections(spark, root):
    """The pages that each entry spans, those below it included."""
    d = O.outline_of(_entries(spark, root))
    return O.nested_sections(d, d.select("file_id").distinct().withColumn("page_count", F.lit(60)))
