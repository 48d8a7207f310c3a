"""The vector index against scans of the whole store."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlake.operators import knowledge as K
from drawlake.operators import vector_index as I
from drawlake.session import scratch


@pytest.fixture(scope="module")
def store(spark):
    """Vectors in 12 clusters, a third of them the same, and rows without a length."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 24)) * 3
    v = [(i, int(i % 5), (centres[i % 12] + rng.normal(size=24) * 0.2).tolist()) for i in range(1500)]
    v += [(1500 + i, 9, centres[0].tolist()) for i in range(700)]
    v += [(3000, 1, None), (3001, 1, []), (3002, 1, [0.0] * 24), (3003, 1, [float("nan")] * 24), (3004, 1, [1.0] * 7), (3005, 1, [None] + [1.0] * 23), (3006, 1, [1e200] * 24)]
    d = spark.createDataFrame(v, "vec_id long, label int, embedding array<double>").repartition(4).cache()
    path = scratch(spark, "index")
    I.build(d, path, 12)
    return d, path, centres


def same(a, b):
    rows = lambda d: [(r["vec_id"], None if r["score"] is None else round(r["score"], 9)) for r in d.collect()]
    assert rows(a) == rows(b)


def test_same_rows_as_the_scan_from_a_part_of_the_cells(spark, store):
    d, path, centres = store
    for q, n, keep in ((centres[3], 5, None), (centres[0], 20, None), (-centres[5], 7, F.col("label") == 2), (centres[4], 3, F.col("label") == 9), (np.ones(24), 2300, None), (np.zeros(24), 4, None)):
        same(I.nearest(spark, path, q.tolist(), n, keep), K.vector_query(d, q.tolist(), n, keep))
    assert len(I.chosen_cells(spark, path, centres[3].tolist(), 5)) <= 3
    plan = I.nearest(spark, path, centres[3].tolist(), 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+", plan)


def test_every_row_lies_in_one_cell_within_its_radius(spark, store):
    d, path, _ = store
    assert sorted(r[0] for r in I.live(spark, path).select("vec_id").collect()) == sorted(r[0] for r in d.select("vec_id").collect())
    assert I.live(spark, path, [-1]).count() == 7


def test_upserts_replace_and_add_and_repeat(spark, store):
    d, _, centres = store
    path = scratch(spark, "index")
    I.build(d, path, 12)
    moved = d.where("vec_id < 300").withColumn("embedding", F.transform("embedding", lambda x: -x))
    added = spark.createDataFrame([(5000, 0, centres[2].tolist()), (5000, 1, centres[2].tolist())], d.schema)
    for _ in range(2):  # the same batch again replaces itself
        I.upsert(moved.unionByName(added), path, 1, order=["label"])
    I.upsert(d.where("vec_id = 7"), path, 2)
    want = K.upserted(K.upserted(d, moved.unionByName(added), "vec_id", ["label"]), d.where("vec_id = 7"), "vec_id")
    assert I.live(spark, path).count() == want.count() == d.count() + 1
    assert I.live(spark, path).where("vec_id = 5000").select("label").collect() == [(1,)]
    for q in (centres[2], -centres[7], centres[7]):
        same(I.nearest(spark, path, q.tolist(), 30), K.vector_query(want, q.tolist(), 30))
    with pytest.raises(ValueError):
        I.upsert(d, path, 0)


def test_a_table_of_queries(spark, store):
    d, path, centres = store
    q = [(i, c.tolist()) for i, c in enumerate(centres)] + [(50, None), (51, [0.0] * 24), (52, [1.0] * 3), (53, (-centres[0]).tolist())]
    got = {}
    for r in I.nearest_of_each(spark.createDataFrame(q, "q_id int, q_vector array<double>"), path, 6).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append((r["vec_id"], round(r["score"], 9)))
    want = {i: [(r["vec_id"], round(r["score"], 9)) for r in K.vector_query(d, c, 6).collect()] for i, c in q if i in (0, 5, 53)}
    assert set(got) == set(range(12)) | {53}
    assert {i: got[i] for i in want} == want


def test_queries_in_slices_meet_shares_of_cells(spark, store):
    """Many tasks, none with a whole cell or all queries; of 700 equal rows the first by key; no pair of rows is an expression of its own."""
    d, path, centres = store
    q = [(i, c.tolist()) for i, c in enumerate(centres)]
    asked = I.nearest_of_each(spark.createDataFrame(q, "q_id int, q_vector array<double>"), path, 6, share=24 * 40, asked=5)
    got = [(r["vec_id"], round(r["score"], 9)) for r in asked.where("q_id = 0").orderBy("rank").collect()]
    assert got == [(r["vec_id"], round(r["score"], 9)) for r in K.vector_query(d, q[0][1], 6).collect()]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin [cell" not in plan


def test_an_empty_store(spark, store):
    d, path = store[0].where("false"), scratch(spark, "index")
    I.build(d, path, 4)
    assert I.nearest(spark, path, [1.0] * 24, 3).count() == 0
    I.upsert(store[0].where("vec_id < 4"), path, 1)
    same(I.nearest(spark, path, [1.0] * 24, 3), K.vector_query(store[0].where("vec_id < 4"), [1.0] * 24, 3))
