"""Schedules, labels, intake and matching on small drawings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from drawlake.operators import geometry as G
from drawlake.operators import joins as J
from drawlake.operators import labels as L
from drawlake.operators import matching as M
from drawlake.operators import schedule as S

LINES = "file_id string, page int, column int, line int, tokens array<string>"
PHRASES = "file_id string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"


def schedule(spark, rows):
    return spark.createDataFrame([("f", 1, 1, i, r) for i, r in enumerate(rows)], LINES)


@pytest.mark.parametrize(
    ("tokens", "number"),
    [(["UNIT", "1C"], "1C"), (["SUITE", "2B"], "2B"), (["ROOM", "LOBBY"], None), (["101"], "101"), (["101", "LOBBY"], "101"), (["101", "1A", "2"], None), (["WOMEN"], "WOMEN"), (["MAIN", "THING"], None), (["1A", "2"], None)],
)
def test_headings(spark, tokens, number):
    r = schedule(spark, [tokens]).select(S.room_heading(F.array_join("tokens", " ")).alias("h")).first()["h"]
    assert (r and r["number"]) == number


def test_schedule(spark):
    p = S.parsed(schedule(spark, [
        ["SIGNAGE", "SCHEDULE"], ["101", "LOBBY"], ["1A", "2", "WELCOME", "HALL", "YES", "A,B"], ["2B", "1", "EXIT", "A"], ["WOMEN"], ["3", "1", "WOMEN", "NO"],
        ["SIGN", "TYPE", "LEGEND"], ["1A", '8"', "x", '10"', "ACRYLIC", "BRAILLE"], ["2B", "METAL"], ["KEYNOTES"], ["A", "SEE", "ELEVATION"], ["SIGN", "TYPE", "1A"],
    ]))
    e = {r["code"]: r for r in S.entries(p).collect()}
    assert (e["1A"]["room_number"], e["1A"]["room_name"], e["1A"]["quantity"], e["1A"]["signage_text"], e["1A"]["glass_backer"], e["1A"]["raw_comments"]) == ("101", "101 LOBBY", 2, "WELCOME HALL", True, "A,B")
    assert e["1A"]["expanded_comments"] == "SEE ELEVATION" and e["1A"]["dimensions"] == '8" x 10"' and e["1A"]["material"] == "ACRYLIC" and e["1A"]["features"] == ["BRAILLE"] and e["1A"]["has_drawing"]
    assert (e["2B"]["quantity"], e["2B"]["signage_text"], e["2B"]["raw_comments"], e["2B"]["material"], e["2B"]["has_drawing"]) == (1, "EXIT", "A", "METAL", False)
    assert (e["3"]["room_number"], e["3"]["glass_backer"], e["3"]["signage_text"]) == ("WOMEN", False, "WOMEN")
    assert S.codes_by_table(S.entries(p)).first()["codes"] == ["1A", "2B", "3"]


def test_lines_from_items(spark):
    d = spark.createDataFrame([("f", 1, 1, 3, "B", 50.0, 101.0, 5.0, 10.0), ("f", 1, 1, 1, "A", 10.0, 100.0, 5.0, 10.0), ("f", 1, 1, 2, "C", 10.0, 120.0, 5.0, 10.0)], "file_id string, page int, column int, seq int, text string, x double, y double, w double, h double")
    assert [r["tokens"] for r in S.lines(d).orderBy("line").collect()] == [["A", "B"], ["C"]]


def phrase(seq, text, x, y, h=0.01, page=1):
    return ("f", page, seq, text, x, y, x + 0.05, y + h, 1000.0, 1000.0)


def test_room_labels(spark):
    d = spark.createDataFrame([
        phrase(1, "LOBBY", 0.1, 0.1), phrase(2, "101", 0.1, 0.115), phrase(3, "OFFICE / 102", 0.3, 0.3), phrase(4, "STORAGE", 0.5, 0.5), phrase(5, "12'-6\"", 0.5, 0.52), phrase(6, "AREA A", 0.6, 0.6, 0.03), phrase(7, "TITLE", 0.8, 0.9),
        phrase(8, "doors", 0.1, 0.12), phrase(9, "2", 0.12, 0.125),
    ], PHRASES)
    got = {r["room_name"]: (r["room_number"], r["extraction_confidence"], r["door_count"]) for r in L.room_labels(d).collect()}
    assert got["LOBBY"] == ("101", 0.75, 2) and got["OFFICE"] == ("102", 0.85, None) and got["STORAGE"][:2] == (None, 0.6) and "TITLE" not in got and "12'-6\"" not in got
    assert [r["text"] for r in L.zone_anchors(d).collect()] == ["AREA A"]


def test_a_number_serves_one_name(spark):
    d = spark.createDataFrame([phrase(1, "CLOSET", 0.1, 0.1), phrase(2, "PANTRY", 0.1, 0.12), phrase(3, "101", 0.1, 0.11)], PHRASES)
    assert {r["room_name"]: r["room_number"] for r in L.room_labels(d).collect()} == {"CLOSET": "101", "PANTRY": None}


def test_occupant_loads(spark):
    rows = [(p, i, t, x, y) for p in (1, 2) for i, (t, x, y) in enumerate([("OCCUPANT", 0.0, 0.0), ("LOAD", 30.0, 0.0), ("101", 0.0, 20.0), ("LOBBY", 30.0, 21.0), ("45", 60.0, 20.0), ("A103", 0.0, 40.0), ("HALL", 30.0, 40.0), ("300", 60.0, 40.0)])]
    d = spark.createDataFrame([("f", p, i, t, x, y) for p, i, t, x, y in rows], "file_id string, page int, seq int, text string, x double, y double")
    plans = spark.createDataFrame([("f", 1)], "file_id string, page int")
    assert {r["room_number"]: r["occupant_load"] for r in L.occupant_loads(d, plans).collect()} == {"101": 45, "A103": 300}


def test_intake(spark):
    names = spark.createDataFrame([("101400 - SIGNAGE.pdf", "spec"), ("Sign Specifications.pdf", "spec"), ("A-101.pdf", "data"), ("spec book.pdf", "data")], "n string, want string")
    assert names.where(L.file_type(F.col("n")) != F.col("want")).count() == 0
    d = spark.createDataFrame([phrase(1, "Project Name: New Hall", 0.8, 0.9), phrase(2, "Issue Date: 01/02/2024", 0.8, 0.92), phrase(3, "SHEET INDEX", 0.2, 0.2, page=2), phrase(4, "UPPER LEVEL", 0.8, 0.9, page=3), phrase(5, "AHJ: City", 0.8, 0.9, page=11)], PHRASES)
    r = L.intake(d).first()
    assert (r["project_name"], r["issue_date"], r["index_page"], r["levels"], r["level_count"], r["jurisdiction"]) == ("New Hall", "01/02/2024", 2, ["upper level"], 1, None)


def test_matching(spark):
    d = spark.createDataFrame([phrase(1, "S-12", 0.1, 0.1), phrase(2, "MAIN LOBBY", 0.3, 0.3), phrase(3, "204", 0.5, 0.5), phrase(4, "B207", 0.6, 0.6), phrase(5, "CONFERENCE", 0.7, 0.2)], PHRASES)
    s = spark.createDataFrame([("f", 1, "a", "S12", None, None), ("f", 1, "b", "x1", None, "Main Lobby"), ("f", 1, "c", "x2", None, "Room 204 at the end of the north wing"), ("f", 1, "d", "x3", None, "207"), ("f", 1, "e", "x4", None, "zzz")], "file_id string, page int, sign_id string, identifier string, sign_type string, location string")
    m = M.matched(s, d)
    assert {r["sign_id"]: r["pass"] for r in m.collect()} == {"a": 1, "b": 2, "c": 3, "d": 4} or {r["sign_id"]: r["pass"] for r in m.collect()} == {"a": 1, "b": 2, "c": 3, "d": 5}
    signs = spark.createDataFrame([("a", 0.9, 0.9, 1), ("b", None, None, 1), ("e", None, None, 7)], "sign_id string, x_pos double, y_pos double, page_number int")
    p = {r["sign_id"]: (r["score"], round(r["y"], 3)) for r in M.placed(signs, m).collect()}
    assert p["a"] == (1.0, 0.9) and p["b"][0] == 1.0 and p["b"][1] == 0.335 and p["e"] == (0.0, 0.5)
    assert [r["sign_id"] for r in M.written_back(M.placed(signs, m)).collect()] == ["b"]
    assert sorted(r["sign_id"] for r in M.signs_of_page(signs, 1, [7]).collect()) == ["a", "b", "e"]
    c = spark.createDataFrame([("b", 0.1, 0.1, False)], "sign_id string, x double, y double, ambiguous boolean")
    assert {r["sign_id"]: r["outcome"] for r in M.auto_located(c, signs.selectExpr("*", "1 AS job_id", "'Hall' AS location")).collect()} == {"b": "applied", "e": "failed"}


def test_pairs_of_a_page_are_scored_in_all_parts(spark):
    """Few bytes make many pairs: neither side is broadcast to the one task that reads the other, and the parts are not joined up."""
    d = spark.createDataFrame([phrase(k, f"ROOM {k}", 0.1, 0.1, page=k % 40) for k in range(200)], PHRASES).coalesce(1)
    s = d.selectExpr("file_id", "page", "CAST(seq AS STRING) AS sign_id", "'' AS identifier", "'' AS sign_type", "text AS location").coalesce(1)
    q = s.selectExpr("file_id", "page", "sign_id", "location AS query", "'1' AS room_number")
    for m in (M.matched(s, d), G.best_phrase(q, d)):
        plan = m._jdf.queryExecution().executedPlan().toString()
        assert m.count() == 200
        assert plan.count("REPARTITION_BY_NUM") == 2 and "SortMergeJoin" in plan and "Broadcast" not in plan
    both = J.dealt_join(s.select("page"), d.select("page"), ["page"])
    assert both.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and both.count() == 1000


def test_nudged_markers(spark):
    rows = [(1, 1, 1, 0.5, 0.5, 1.0), (1, 1, 2, 0.506, 0.5, 0.8), (1, 1, 3, 0.5, 0.5005, 0.8), (1, 1, 4, 0.7, 0.7, 0.0), (1, 1, 5, 0.705, 0.7, 0.8), (1, 1, 6, 0.975, 0.3, 0.7), (1, 1, 7, 0.979, 0.3, 0.7), (1, 1, 8, 0.504, 0.5, 1.0), (1, 1, 9, None, 0.5, 0.8), (1, 2, 1, 0.506, 0.5, None)]
    d = spark.createDataFrame(rows, "file_id int, page int, seq int, x double, y double, score double")
    got = {(r["page"], r["seq"]): r["x"] if r["x"] is None else round(r["x"], 6) for r in G.nudged(d).collect()}
    # 2 moves to the full distance; 3 is as good as on 1; a ghost (4) pushes none; 7 stops at the edge; 8 is stored.
    assert got == {(1, 1): 0.5, (1, 2): 0.512, (1, 3): 0.5, (1, 4): 0.7, (1, 5): 0.705, (1, 6): 0.975, (1, 7): 0.98, (1, 8): 0.504, (1, 9): None, (2, 1): 0.506}
    assert G.nudged(d.limit(0)).count() == 0


def test_label_candidates(spark):
    rows = [phrase(1, "CONFERENCE", 0.10, 0.10), phrase(2, "WEST", 0.14, 0.105), phrase(3, "WING", 0.18, 0.105), phrase(4, "12'-0\"", 0.3, 0.1), phrase(5, "A1", 0.3, 0.2), phrase(6, "LAB", 0.4, 0.4), phrase(7, "LONGER LABEL", 0.44, 0.4), phrase(8, "TITLES", 0.9, 0.9), phrase(9, "ABC", 0.6, 0.1)]
    got = {r["text"]: round(r["x"], 3) for r in L.label_candidates(spark.createDataFrame(rows, PHRASES)).collect()}
    assert got == {"CONFERENCE WEST": 0.145, "WING": 0.205, "LAB": 0.425, "LONGER LABEL": 0.465}


def test_memberships(spark):
    from drawlake.operators import filters as P

    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    members = spark.createDataFrame([(1, 10, "ADMIN")], "user_id int, org_id int, role string")
    orgs = spark.createDataFrame([(10, "a"), (11, "b")], "org_id int, name string")
    assert {r["user_id"]: (r["role"], r["org_name"]) for r in P.memberships(users, members, orgs).collect()} == {1: ("ADMIN", "a"), 2: ("SALES", None)}
    jobs = spark.createDataFrame([(10, 5), (10, 7)], "org_id int, created_at int")
    assert {r["org_id"]: (r["members"], r["jobs"], r["last_job"]) for r in P.organisations(orgs, members, jobs).collect()} == {10: (1, 2, 7), 11: (0, 0, None)}


def test_distances_that_differ_in_the_last_bit_are_no_tie(spark):
    from drawlake.operators.geometry import clusters

    at = [(1, "STAIR", 0.025, 0.00625), (2, "101", 0.765, 0.11624999999999999), (28, "101", 0.485, 0.59625)]
    p = spark.createDataFrame([(1, 1, n, t, x, y, x, y) for n, t, x, y in at], "file_id long, page int, seq long, text string, x0 double, y0 double, x1 double, y1 double")
    s = spark.createDataFrame([(1, 1, 7, "Stair", "101")], "file_id long, page int, sign_id long, sign_type string, room_number string")
    assert [tuple(r) for r in clusters(p, s, 1.0).collect()] == [(7, (0.025 + 0.485) / 2, (0.00625 + 0.59625) / 2, True)]
