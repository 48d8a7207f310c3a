"""Running sums, earlier rows, runs and nearest values over hot keys against plain versions; sign lists of many files."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from drawlake.operators import ranges as R
from drawlake.sources import files as X

NINE = lambda rng: rng.choice(["hot"] * 9 + ["cold"])


def test_running_sums_over_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(NINE(rng) if i % 50 else None, i, rng.randrange(100), rng.choice([None, 1, 2, 3])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k string, id long, v long, n long").repartition(5)
    got = {r["id"]: (r["s"], r["p"], r["has_earlier"]) for r in R.running(R.earlier(df, ["k"], [F.col("v"), F.col("id")], {"p": "id"}, 8), ["k"], [F.col("v"), F.col("id")], {"s": F.col("n")}, 8).collect()}
    for key in ("hot", "cold", None):
        total, before = 0, None
        for _, i, _, n in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            total += n or 0
            assert got[i] == (total, before, before is not None)
            before = i
    assert R.running(df.where("false"), ["k"], [F.col("v")], {"s": F.col("n")}).count() == 0
    spread = R.in_ranges(df, ["k"], [F.col("v"), F.col("id")], 8).groupBy("_range").count().collect()
    assert len(spread) >= 6 and max(r["count"] for r in spread) < 900, "a key of nine tenths of the rows lies over the ranges"


def test_islands_and_budgets(spark):
    rng = random.Random(2)
    at = [(NINE(rng), rng.randrange(4_000)) for _ in range(1_500)] + [("hot", None)]
    got = sorted(tuple(r) for r in R.islands(spark.createDataFrame(at, "k string, p long"), ["k"], "p", 2, 8).collect())
    want = []
    for key in ("cold", "hot"):
        run = []
        for p in sorted(p for k, p in at if k == key and p is not None):
            if run and p - run[-1] > 2:
                want.append((key, run[0], run[-1], len(run)))
                run = []
            run.append(p)
        want.append((key, run[0], run[-1], len(run)))
    assert got == sorted(want)
    sized = spark.createDataFrame([(i, i % 7) for i in range(500)], "id long, size long")
    assert {r["id"] for r in R.budget_prefix(sized, [], [F.col("id")], "size", 100, 8).collect()} == {i for i in range(500) if sum(j % 7 for j in range(i + 1)) <= 100}


def test_nearest_of_a_hot_key(spark):
    rng = random.Random(3)
    left = [(i, NINE(rng), rng.choice([None, *range(200)])) for i in range(300)]
    right = [(i, NINE(rng), rng.choice([None, *range(200)])) for i in range(150)]
    a, b = spark.createDataFrame(left, "i long, k string, x long"), spark.createDataFrame(right, "j long, k string, y long")
    got = {}
    for r in R.nearest_of_any(a, b, ["k"], "x", "y", "j", 4, 8).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["distance"], r["j"]))
    for i, k, x in left:
        best = sorted((abs(x - y), j) for j, kk, y in right if kk == k and y is not None)[:4] if x is not None else []
        assert sorted(got.get(i, [])) == [(n + 1, d, j) for n, (d, j) in enumerate(best)], i


def test_sign_lists_of_many_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Sign list of the north wing,,\n,,\nSign ID,Type,Room\n1,T1,Lobby\n,,\n 2 ,,Hall\n,x,\n")
    (tmp_path / "b.csv").write_text("\n" + "note,,,\n" * 8 + "Qty,Room,Sign No,Remarks\n3,Attic,B-1,\n4,,,none\n5,Cellar,B-2,Qty\n")
    (tmp_path / "c.csv").write_text("")
    got = {(r["file"][-5:], r["identifier"], r["sign_type"], r["location"], r["quantity"]) for r in X.sign_lists(spark, str(tmp_path)).collect()}
    assert got == {("a.csv", "1", "T1", "Lobby", None), ("a.csv", "2", None, "Hall", None), ("a.csv", None, "x", None, None), ("b.csv", "B-1", None, "Attic", "3"), ("b.csv", "B-2", None, "Cellar", "5")}
    assert X.sign_list(spark, str(tmp_path / "a.csv")).columns == ["identifier", "sign_type", "location"]
