"""Trees from parent pointers, and exports that are whole or not there."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import udf

from drawlake.operators import trees as T
from drawlake.session import scratch
from drawlake.sources import export as E

SCHEMA = "file_id string, seq long, parent long, title string, page int"


def plain(rows):
    """``(file, seq) -> titles above``, by walking up; a cycle is cut above its least key."""
    up = {(f, k): p for f, k, p, *_ in rows if (f, p) in {(f, k) for f, k, *_ in rows}}
    title = {(f, k): t for f, k, _, t, _ in rows}
    for f, k in list(up):
        seen, at = [], k
        while at is not None and at not in seen:
            seen.append(at)
            at = up.get((f, at))
        if at is not None:  # a cycle from ``at`` on
            up[f, min(seen[seen.index(at) :])] = None
    out = {}
    for f, k in title:
        path, at = [], up.get((f, k))
        while at is not None:
            path.insert(0, title[f, at])
            at = up.get((f, at))
        out[f, k] = path
    return out


def test_depth_and_cycles(spark):
    """A chain of 50, cycles of one, two and seven with tails, a hub with most of the rows, and missing parents."""
    rows = [("chain", i, i - 1 if i else None, f"c{i}", i + 1) for i in range(51)]
    rows += [("self", 4, 4, "s4", 1), ("self", 5, 4, "s5", 2)]
    rows += [("ring", i, (i + 1) % 7 + 10 if i >= 10 else None, f"r{i}", 1) for i in range(10, 17)]
    rows = [r if r[0] != "ring" else ("ring", r[1], 10 + (r[1] - 10 + 1) % 7, r[3], 1) for r in rows]
    rows += [("ring", 20 + i, 12 if i == 0 else 19 + i, f"t{i}", 1) for i in range(20)]
    rows += [("two", 1, 2, "a", 1), ("two", 2, 1, "b", 1), ("two", 3, 2, "c", 1), ("two", 9, 77, "lost", 1)]
    rows += [("hub", 0, None, "hub", 1)] + [("hub", i, 0, f"h{i}", 1) for i in range(1, 400)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r["file_id"], r["seq"]): r["ancestors"] for r in T.outline_of(d).collect()}
    assert got == plain(rows) and len(got["chain", 50]) == 50
    assert got["two", 3] == ["a", "b"] and got["self", 5] == ["s4"]
    empty = T.outline_of(d.where("false"))
    assert empty.count() == 0 and {"ancestors", "depth", "is_leaf"} <= set(empty.columns)


def test_random_pointers_nulls_and_repeats(spark):
    rng = random.Random(2)
    rows = [("f", i, rng.choice([None, *range(60)]), f"n{i}", 1) for i in range(60)]
    d = spark.createDataFrame(rows + [("f", None, 3, "null key", 1), (None, 1, 0, "null file", 1), rows[7]], SCHEMA)
    found = T.with_ancestors(d, ["file_id"], "seq", "parent", "title").collect()
    assert len(found) == 63
    assert {(r["file_id"], r["seq"]): r["ancestors"] for r in found if r["file_id"] and r["seq"] is not None} == plain(rows)
    assert all(r["ancestors"] == [] for r in found if r["file_id"] is None or r["seq"] is None)


def test_sections_span_what_lies_below(spark):
    rows = [("f", 1, 1, 0), ("f", 2, 1, 1), ("f", 3, 4, 2), ("f", 4, 9, 1), ("f", 5, 9, 0), ("f", 6, None, 0), ("g", 1, 3, 0)]
    d = spark.createDataFrame(rows, "file_id string, seq long, page int, depth int")
    pages = spark.createDataFrame([("f", 20), ("g", 2)], "file_id string, page_count int")
    got = {(r[0], r[1]): (r[2], r[3]) for r in T.nested_sections(d, pages).collect()}
    assert got == {("f", 1): (1, 8), ("f", 2): (1, 8), ("f", 3): (4, 8), ("f", 4): (9, 9), ("f", 5): (9, 20), ("g", 1): (3, 3)}


def test_an_export_is_whole_or_not_there(spark):
    folder = scratch(spark, "export")
    good, other = spark.range(5).withColumn("x", F.col("id") * 2), spark.createDataFrame([("a", 1.5)], "name string, v double")

    @udf("long")
    def fails(i):
        if i == 3:
            raise RuntimeError("a task fails")
        return i

    broken = {"rows": good, "types": other, "bad": good.repartition(4).withColumn("x", fails("id"))}
    with pytest.raises(Exception, match="a task fails"):
        E.write_job(broken, folder)
    with pytest.raises(LookupError):
        E.latest_export(spark, folder)
    first = E.write_job({"rows": good, "types": other}, folder)
    with pytest.raises(Exception, match="a task fails"):
        E.write_job(broken, folder)
    assert E.latest_export(spark, folder) == first
    assert sorted(map(tuple, E.read_sheet(spark, folder, "rows", good.schema).collect())) == [(i, 2 * i) for i in range(5)]
    assert E.read_sheet(spark, folder, "types", other.schema).collect() == [("a", 1.5)]
    assert E.read_sheet(spark, folder, "bad", other.schema).count() == 0
    second = E.write_job({"rows": good.limit(1)}, folder)
    assert E.latest_export(spark, folder) == second and E.read_sheet(spark, folder, "rows", good.schema).count() == 1


def test_nodes_do_not_pass_the_driver(spark):
    from drawlake.operators.trees import outline_of

    e = spark.range(40).selectExpr("0L AS file_id", "id AS seq", "CASE WHEN id > 0 THEN (id - 1) div 2 END AS parent", "concat('t', id) AS title", "1 AS page")
    d = outline_of(e)
    assert max(r["depth"] for r in d.collect()) == 5
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
