"""The golden mixed-occupancy building, single rules, and the verifier's pairs."""

from __future__ import annotations

import pytest

from drawlake.operators import rooms as R
from drawlake.operators import rules as U
from drawlake.operators import verify as V

FLAGS = ("is_restroom", "is_stair", "is_elevator", "is_vestibule", "is_corridor_or_hall", "is_vehicle_bay", "is_mep_unoccupied", "is_variable_use", "is_public_facing", "is_staff_only", "is_assembly", "is_office", "is_suite", "is_residential_unit")
SCHEMA = "file_id string, seq int, room_number string, room_name string, level string, pdf_page int, occupant_load int, occupancy_group string, door_count int, zone_qualifier string, extraction_confidence double, x double, y double, " + ", ".join(f"{f} boolean" for f in FLAGS)


def room(seq, number, name, level="Level 1", load=None, doors=None, zone=None, xy=(None, None), page=1, **flags):
    return ("f", seq, number, name, level, page, load, None, doors, zone, 0.9, *xy, *[flags.get(f, False) for f in FLAGS])


GOLDEN = [
    room(1, "101", "OFFICE", is_office=True),
    room(2, "200", "SUITE", is_suite=True),
    room(3, "102", "CONFERENCE", is_variable_use=True),
    room(4, "103", "LOBBY", is_public_facing=True, is_corridor_or_hall=True),
    room(5, "104", "WOMEN'S RESTROOM", is_restroom=True),
    room(6, "105", "STAIR A", is_stair=True),
    room(7, "106", "STORAGE"),
    room(8, "107", "JANITOR CLOSET", is_mep_unoccupied=True),
    room(9, "108", "MECHANICAL", is_mep_unoccupied=True),
    room(10, "109", "ELECTRICAL", is_mep_unoccupied=True),
    room(11, "110", "MEZZANINE STORAGE", level="Mezzanine", is_mep_unoccupied=True),
]


def rows(df):
    return {r["room_number"]: r for r in df.collect()}


def test_golden_building(spark):
    a = U.assign(spark.createDataFrame(GOLDEN, SCHEMA))
    got = rows(a)
    signed = [n for n, r in got.items() if r["reason"] is None]
    assert sorted(signed) == ["101", "102", "104", "105", "106", "110", "200"]
    assert got["101"]["room_id"] == 1 and "R5" in got["101"]["applied_rules"]
    assert got["200"]["suite_id"] == 1 and "R6" in got["200"]["applied_rules"]
    assert got["102"]["room_id_insert"] == 1 and got["102"]["room_id"] == 0
    assert got["103"]["reason"] == "EXPLICIT_EXCLUSION"
    assert got["104"]["restroom"] == 1 and got["104"]["ambiguous"]
    assert got["105"]["stair_landing"] == 1 and got["105"]["stair_corridor"] == 1
    assert {got[n]["reason"] for n in ("107", "108", "109")} == {"VETOED_MEP"}
    assert got["110"]["exclusion_reasons"] == ["R15-near-veto"]
    assert {r["reason"]: r["rooms"] for r in U.zero_sign_summary(a).collect()} == {"EXPLICIT_EXCLUSION": 1, "VETOED_MEP": 3}
    emitted = {(r["sign_identifier"], r["sign_type"]) for r in U.sign_rows(a).collect()}
    assert ("105", "STAIR LANDING SIGN") in emitted and ("104", "RESTROOM SIGN") in emitted
    assert sum(r["rooms_found"] for r in U.page_audit(a).collect()) == 11
    assert any(r["entry"].startswith("Room 103 LOBBY") and "no signs" in r["entry"] for r in U.decision_log(a).collect())


def test_order_of_input_rows_does_not_matter(spark):
    d = spark.createDataFrame(GOLDEN, SCHEMA)
    assert rows(U.assign(d)) == rows(U.assign(d.orderBy("room_name").repartition(3)))


def test_lobby_switch_and_exits(spark):
    d = spark.createDataFrame([room(1, "1", "MAIN LOBBY", is_corridor_or_hall=True, is_public_facing=True), room(2, "2", "SANCTUARY", load=600), room(3, "3", "CHAPEL", doors=3), room(4, "4", "EXIT VESTIBULE")], SCHEMA)
    got = rows(U.assign(d, corridor_veto_lobby=False))
    assert (got["1"]["exit"], got["1"]["evacuation_map"], got["1"]["office_directory"]) == (1, 1, 1)
    assert got["2"]["exit"] == 3 and got["2"]["max_occupancy"] == 1
    assert got["3"]["room_id"] == 3 and got["3"]["exit"] == 2 and got["3"]["ambiguous"]
    assert got["4"]["exit"] == 1
    assert rows(U.assign(d))["1"]["exit"] is None


def test_one_fire_sign_and_plaques(spark):
    d = spark.createDataFrame([room(2, "2", "ELEVATOR 2"), room(1, "1", "ELEVATOR 1"), room(3, "3", "MEN"), room(4, "4", "UNISEX RESTROOM"), room(5, "5", "RESTROOM")], SCHEMA)
    p = spark.createDataFrame([("f", 1, None, None, "WRR-1", 2), ("f", 2, "5", None, "X", None), ("f", 3, None, "unisex", "U", 4)], "file_id string, seq int, room_number string, room_name string, sign_type_code string, quantity int")
    got = rows(U.assign(d, p))
    assert [got[n]["in_case_of_fire"] for n in "12"] == [1, None]
    assert got["3"]["ambiguous"] and not got["4"]["ambiguous"]
    assert (got["4"]["restroom"], got["5"]["restroom"]) == (4, 1)


def test_women_code_also_serves_men(spark):
    d = spark.createDataFrame([room(1, "1", "MEN")], SCHEMA)
    p = spark.createDataFrame([("f", 1, None, None, "WOMEN-1", 2)], "file_id string, seq int, room_number string, room_name string, sign_type_code string, quantity int")
    assert rows(U.assign(d, p))["1"]["restroom"] == 2


def test_staff_restroom_by_level(spark):
    d = spark.createDataFrame([room(1, "1", "RESTROOM"), room(2, "2", "OFFICE"), room(3, "3", "STAIR")], SCHEMA)
    got = {r["room_number"]: r["f_public"] for r in U.bridged(d).collect()}
    assert got["1"] is False
    mixed = spark.createDataFrame([room(1, "1", "RESTROOM"), room(2, "2", "STORAGE")], SCHEMA)
    assert {r["room_number"]: r["f_public"] for r in U.bridged(mixed).collect()}["1"] is True


@pytest.mark.parametrize(
    ("name", "flag"),
    [("CORRIDOR", "is_corridor_or_hall"), ("BATHROOM", "is_restroom"), ("MRR", "is_restroom"), ("STAIR 2", "is_stair"), ("ELEV", "is_elevator"), ("UNIT 5", "is_residential_unit"), ("GYM", "is_variable_use"), ("RECEPTION", "is_public_facing")],
)
def test_label_flags(spark, name, flag):
    d = spark.createDataFrame([(name, None, None)], "room_name string, occupant_load int, occupancy_group string")
    r = R.label_flags(d).first()
    assert r[flag]
    assert not (name == "CORRIDOR" and r["is_restroom"])  # RR stands inside it


def test_zone_anchor_and_neighbours(spark):
    a = spark.createDataFrame([("f", 1, "A", 1, 200.0, 150.0, 200.0, 20.0), ("f", 2, "B", 1, 700.0, 150.0, 180.0, 20.0)], "file_id string, seq int, text string, pdf_page int, x double, y double, w double, h double")
    d = spark.createDataFrame([room(1, "1", "R", xy=(200.0, 150.0)), room(2, "2", "R", xy=(680.0, 150.0)), room(3, "3", "R", xy=(2000.0, 2000.0)), room(4, "4", "R", xy=(200.0, 150.0), page=2)], SCHEMA).drop("zone_qualifier")
    assert {r["room_number"]: r["zone_qualifier"] for r in R.zone_qualifiers(d, a).collect()} == {"1": "A", "2": "B", "3": None, "4": None}
    n = spark.createDataFrame([room(1, "1", "RR", xy=(0.0, 0.0), is_restroom=True, is_public_facing=True), room(2, "2", "O", xy=(1.0, 0.0), is_office=True), room(3, "3", "O", xy=(2.0, 0.0), is_office=True)], SCHEMA)
    assert {r["room_number"]: (r["is_staff_only"], r["is_public_facing"]) for r in R.staff_only_by_neighbours(n).collect()}["1"] == (True, False)


def test_spatial_dedup(spark):
    d = spark.createDataFrame([(1, 0.1, 0.1, 0.6), (2, 0.11, 0.1, 0.9), (3, 0.5, 0.5, 0.7)], "seq int, x double, y double, extraction_confidence double").selectExpr("'f' AS file_id", "1 AS pdf_page", "*")
    assert sorted(r["seq"] for r in R.deduplicated(d).collect()) == [2, 3]


def assigned(spark, rooms_):
    return U.assign(spark.createDataFrame(rooms_, SCHEMA))


def verdicts(df):
    return {r["check_id"]: r["passed"] for r in df.collect()}


def test_verifier(spark):
    good = assigned(spark, [room(1, "1", "STAIR"), room(2, "2", "ELEVATOR"), room(3, "3", "CHAPEL")])
    assert all(verdicts(V.checks(good)).values())
    two = assigned(spark, [room(1, "1", "ELEVATOR 1"), room(2, "2", "ELEVATOR 2")])
    assert verdicts(V.checks(two))["V4"] is False
    assert verdicts(V.checks(good, stair_count=2))["V2"] is False
    unmapped = assigned(spark, [room(1, "1", "OFFICE")])
    assert verdicts(V.checks(unmapped))["V7"] is False
    few = good.withColumn("exit", good["exit"] * 0 + 1)
    assert verdicts(V.checks(few))["V3"] is False
    none = good.where("false")
    assert verdicts(V.checks(none, page_count=3)) == {"V1-V7": False}
    assert verdicts(V.checks(none, page_count=0)) == {"V1-V7": True}
    s = {r["kind"]: r["total"] for r in V.summary(assigned(spark, GOLDEN)).collect()}
    assert s["total_signs_incl_suite"] == s["total_signs"] + 1
    assert V.questions(assigned(spark, GOLDEN)).count() == 1
