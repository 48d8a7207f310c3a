"""The whole takeoff of a small drawing set, and the model steps around it."""

from __future__ import annotations

from drawlake.operators import models as M
from drawlake.plans.takeoff import takeoff

PHRASES = "file_id string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"


def phrase(page, seq, text, x, y, h=0.01, file="f"):
    return (file, page, seq, text, x, y, x + 0.05, y + h, 1000.0, 1000.0)


def drawings(spark):
    plan = [("OFFICE", 0.1, 0.1, "101"), ("MAIN LOBBY", 0.3, 0.1, "102"), ("STAIR A", 0.5, 0.1, "103"), ("ELEVATOR", 0.1, 0.5, "104"), ("MECHANICAL", 0.3, 0.5, "105"), ("CHAPEL", 0.5, 0.5, "106")]
    rows = [phrase(1, 1, "SHEET INDEX", 0.1, 0.1), phrase(2, 90, "FIRST FLOOR PLAN", 0.8, 0.95), phrase(3, 1, "ROOF PLAN", 0.8, 0.95)]
    for i, (name, x, y, number) in enumerate(plan):
        rows += [phrase(2, 2 * i, name, x, y), phrase(2, 2 * i + 1, number, x, y + 0.015)]
    outline = spark.createDataFrame([], "file_id string, seq int, title string, page int")
    index = spark.createDataFrame([], "file_id string, seq int, sheet_number string, title string")
    return spark.createDataFrame(rows, PHRASES), outline, index


def test_takeoff(spark):
    loads = spark.createDataFrame([(1, "106", 700)], "seq int, room_number string, occupant_load int")
    t = takeoff(*drawings(spark), loads)
    assert {r["page"]: r["bucket"] for r in t.manifest.collect()} == {1: "other", 2: "floor_plan", 3: "ignore"}
    a = {r["room_number"]: r for r in t.assignments.collect()}
    assert set(a) == {"101", "102", "103", "104", "105", "106"}
    assert a["101"]["room_id"] == 1 and a["103"]["stair_landing"] == 1 and a["104"]["in_case_of_fire"] == 1 and a["105"]["reason"] == "VETOED_MEP" and a["102"]["reason"] == "EXPLICIT_EXCLUSION"
    assert a["106"]["exit"] == 3 and a["106"]["level"] == "L1" and a["106"]["ambiguity_note"].startswith("R3")
    assert {r["check_id"]: r["passed"] for r in t.checks.collect()} == {"V1": True, "V2": True, "V2-corridor": True, "V3": True, "V4": True, "V6": True, "V7": True}
    signs = t.signs.collect()
    assert all(r["occurrence_total"] is None for r in signs) and ("106", "EXIT SIGN", 3) in {(r["sign_identifier"], r["sign_type"], r["quantity"]) for r in signs}


def test_takeoff_does_not_depend_on_the_order_of_rows(spark):
    p, o, i = drawings(spark)
    one = sorted(map(str, takeoff(p, o, i).signs.collect()))
    assert one == sorted(map(str, takeoff(p.orderBy("text").repartition(3), o, i).signs.collect()))


def test_model_steps(spark):
    pages = spark.createDataFrame([("f", n, "x" * 50) for n in range(1, 8)], "file_id string, page int, text string")
    b = M.batched_prompts(pages, 120, 40)
    assert sorted((r["batch"], r["first_page"]) for r in b.collect()) == [(1, 1), (2, 4), (3, 7)]
    assert sorted({(r["batch"], r["first_page"]) for r in M.page_batches(pages, 3).collect()}) == [(0, 1), (1, 4), (2, 7)]
    called = spark.createDataFrame([("f", 4, '[{"page":1,"t":"a"},{"page":2,"t":"b"},{"pa'), ("g", 1, "no")], "file_id string, first_page int, response string")
    assert sorted((r["file_id"], r["page"], r["t"]) for r in M.answered_rows(called, "page:int,t:string").collect()) == [("f", 4, "a"), ("f", 5, "b")]
    assert M.remapped_pages(spark.createDataFrame([(1, 5), (3, 5)], "page int, first_page int")).first()["page"] == 5
    c = spark.createDataFrame([("s", i, 0.1 * i, 0.5, 0.1 * i) for i in range(1, 6)] + [("s", 9, 3.0, 0.5, 1.0), ("z", 1, 0.5, 0.5, 1.0)], "sign_id string, seq int, x double, y double, confidence double")
    assert sorted(r["seq"] for r in M.located(c, spark.createDataFrame([("j", "s")], "job_id string, sign_id string")).collect()) == [3, 4, 5]
    assert M.fallback_pages(pages, spark.createDataFrame([("g", 1)], "file_id string, page int")).count() == 7
    assert M.valid_loads(spark.createDataFrame([("1", 5), ("2", 10_000), (None, 3)], "room_number string, occupant_load int")).count() == 1
