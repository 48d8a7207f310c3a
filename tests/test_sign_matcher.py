"""The sign matcher's passes, one by one, on small pages; similar strings against brute force."""

from __future__ import annotations

import random

import pytest

from drawlake.operators.sign_matcher import canonical_word, sign_places
from drawlake.operators.joins import greedy_pairs
from drawlake.operators.similarity import greedy_alike, similar_pairs, similar_rows, similar_strings
from pyspark.sql import functions as F


def page(*phrases):
    return [(k, t, x - h, y - h, x + h, y + h) for k, (t, x, y, h) in enumerate([(*p, 0.02)[:4] for p in phrases])]


def match(spark, scenes):
    """Signs and phrases, a page for each pair -> what each sign of each page got, None for no place."""
    s = spark.createDataFrame([(1, n, n * 100 + k, *x) for n, (signs, _) in enumerate(scenes) for k, x in enumerate(signs)], "file_id long, page int, sign_id long, identifier string, location string, message string")
    p = spark.createDataFrame([(1, n, *x) for n, (_, phrases) in enumerate(scenes) for x in phrases], "file_id long, page int, seq long, text string, x0 double, y0 double, x1 double, y1 double")
    got = {r["sign_id"]: (r["pass"], round(r["x"], 4), round(r["y"], 4), round(r["score"], 4)) for r in sign_places(s, p).collect()}
    return [[got.get(n * 100 + k) for k in range(len(signs))] for n, (signs, _) in enumerate(scenes)]


def test_short_words(spark):
    words = {"collab": "collaboration", "collaboration": "collaboration", "wrr": "restroom", "mrr": "restroom", "rr": "restroom", "unknown_word": "unknown_word"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", canonical_word(F.col("w")).alias("c")).collect()
    assert {r["w"]: r["c"] for r in got} == words


def test_each_pass(spark):
    """The passes, the margins that keep the earlier ones out, vetoes, and what falls through."""
    mixed = page(
        ("Sign S-9 here", 0.3, 0.3), ("s-9", 0.2, 0.02), ("JAN closet west", 0.7, 0.7), ("ROOM 204", 0.1, 0.5), ("CONFERENCE,", 0.5, 0.5), ("A12/", 0.52, 0.5), ("LECTURE,", 0.9, 0.3), ("B77/", 0.92, 0.3), ("B77.", 0.88, 0.3),
        ("xy31", 0.62, 0.1), ("depot", 0.64, 0.1), ("observatry", 0.4, 0.9),
    )
    signs = [("S-9", None, None), (None, "JANITOR closet", None), (None, "zone 204", None), (None, "CONFERENCE A12", None), (None, "LECTURE B77", None), (None, None, None), (None, "", "depot Y31 of a hundred more things"), (None, "observatory", None), (None, "x", "observatory of")]
    hits = [(1, 0.3, 0.3, 1.0), (2, 0.7, 0.7, 0.6667), (3, 0.1, 0.5, 0.85), (5, 0.52, 0.5, 0.95), None, None, (7, 0.62, 0.1, 0.75), (6, 0.4, 0.9, 0.948), None]
    twice = page(("Q-55.", 0.2, 0.2), ("Q 55.", 0.8, 0.8), ("boiler", 0.85, 0.85), ("plant", 0.75, 0.8), ("pumps", 0.2, 0.25))
    edge = [(s, t, x0, y0 * 0.03 / 0.9, x1, y1 * 0.03 / 0.9) for s, t, x0, y0, x1, y1 in twice]
    long = page(("CONFERENCE 12A EAST WING NORTH CORRIDOR BUILDING", 0.5, 0.5, 0.1))
    sides = page(("stair B101 north", 0.2, 0.5), ("stair B101 north", 0.8, 0.5), ("stair A101 north", 0.9, 0.2), ("stair A101 north", 0.3, 0.2))
    got = match(spark, [
        (signs, mixed),
        ([("Q55", "boiler plant", None), ("Q55", "55", None), ("Q55", None, None)], edge),
        ([("Q55", None, None)], edge[:1]),
        ([("S-1", "CONFERENCE 12A", None)], long),
        ([("S-1", "CONFERENCE 12A", None)], page(("LOBBY", 0.5, 0.5), ("PARKING", 0.1, 0.1))),
        ([("S-1", "CONFERENCE Q12", None)], page(("CONFERENCE,", 0.1, 0.5), ("Q12/", 0.9, 0.5))),
        ([(None, "stair B101", None), (None, "stair A101", None)], sides),
        ([(None, "nothing here", None)], []),
    ])
    assert got[0][:7] == hits[:7], "passes 1, 2, 3, 5, a veto, nothing, 7"
    assert got[0][7][0] == 6 and got[0][7][1:3] == (0.4, 0.9)
    assert got[1] == [(4, 0.8, got[1][0][2], 0.95), None, None], "an identifier twice: by its neighbours, not without them"
    assert got[2][0][0::3] == (4, 1.0)
    # The words CONFERENCE 12A are the first 13 of 42 letters.
    assert got[3] == [(6, round(0.4 + 13 / 42 * 0.2 / 2, 4), 0.5, 1.0)] and got[4] == [None]
    assert got[5] == [None], "kind and number far apart"
    assert [g[1] for g in got[6]] == [0.8, 0.3], "buildings A and B keep to their sides"
    assert got[7] == [None]


def test_similar_strings_equal_brute_force(spark):
    def edits(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng = random.Random(1)
    a, b = (["".join(rng.choice("abé") for _ in range(rng.randrange(0, 13))) for _ in range(200)] for _ in range(2))
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None, xs[0]]], "s string")
    for least in (0.55, 0.6, 0.75, 0.9, 1.0):
        rows = [(r["s"], r["t"]) for r in similar_strings(frame(a), frame(b), least).collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == {(x, y) for x in set(a) for y in set(b) if x and y and 1 - edits(x, y) / max(len(x), len(y)) >= least - 1e-9}
    assert similar_strings(frame(a).where("false"), frame(b)).count() == 0
    with pytest.raises(ValueError):
        similar_strings(frame(a), frame(b), 0.5)
    plan = similar_strings(frame(a), frame(b))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    left = spark.createDataFrame([(1, "x", "corridor"), (2, "y", "corridor"), (3, "x", None)], "id long, g string, name string")
    right = spark.createDataFrame([(7, "x", "coridor"), (8, "y", "kitchen")], "id long, g string, name string")
    assert [tuple(r)[:3] for r in similar_rows(left, right, "id", "id", F.col("name"), 0.8, ["g"]).collect()] == [("x", 1, 7)]


def test_pairs_of_one_table_are_the_half_of_both_sides(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([("".join(rng.choice("ab1") for _ in range(rng.randrange(0, 15))),) for _ in range(300)], "s string")
    for least in (0.7, 0.85):
        rows = sorted(map(tuple, similar_pairs(d, least).collect()))
        assert rows and rows == sorted(tuple(r) for r in similar_strings(d, d, least).collect() if r["s"] < r["t"])
        assert "Aggregate" not in similar_pairs(d.limit(0), least)._jdf.queryExecution().optimizedPlan().toString().split("Join")[0], "found pairs are not shuffled to be told apart"


def test_greedy_by_likeness_equals_greedy_over_all_pairs(spark):
    rng = random.Random(3)
    rows = lambda n, at: spark.createDataFrame([(k + at, rng.randrange(3) if k % 17 else None, None if k % 19 == 0 else "".join(rng.choice("abé") for _ in range(rng.choice((0, 3, 5, 8, 70))))) for k in range(n)], "id long, g long, name string")
    left, right = rows(150, 0), rows(90, 1000)
    for least in (0.6, 0.8, 1.0):
        alike = similar_rows(left, right, "id", "id", F.col("name"), least, ["g"])
        want = sorted(map(tuple, greedy_pairs(alike, ["g"], "id", "other_id", "similarity").select("g", "id", "other_id", "similarity").collect()))
        d = greedy_alike(left, right, "id", "id", F.col("name"), least, ["g"])
        assert want and sorted(map(tuple, d.collect())) == want
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString(), "no pairs are made"


def test_what_signs_look_for_does_not_pass_the_driver(spark):
    s = spark.range(40).selectExpr("id div 20 AS file_id", "1 AS page", "id AS sign_id", "concat('S-', id) AS identifier", "concat('stair B', 100 + id) AS location", "CAST(NULL AS string) AS message")
    p = spark.range(40).selectExpr("id div 20 AS file_id", "1 AS page", "id AS seq", "concat('stair B', 100 + id) AS text", "0.5D AS x0", "0.1D + id % 20 * 0.04D AS y0", "0.55D AS x1", "0.11D + id % 20 * 0.04D AS y1")
    d = sign_places(s, p)
    assert len(d.collect()) == 40
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
