"""Derived tables on small inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawlake.operators import views as V

PHRASES = "file_id string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"


def phrase(page, seq, text, x=0.8, y=0.9):
    return ("f", page, seq, text, x, y, x + 0.05, y + 0.02, 1000.0, 1000.0)


def test_outline(spark):
    o = spark.createDataFrame([("f", 1, "E1 POWER", 1, ["ELECTRICAL", "LEVEL 1"], True), ("f", 2, "A1", 1, ["ARCH"], True), ("f", 3, "A1 again", 1, [], True), ("f", 4, "A", 2, ["ARCH"], False), ("f", 5, "A2", 3, None, True)], "file_id string, seq int, title string, page int, ancestors array<string>, is_leaf boolean")
    assert {r["page"]: r["title"] for r in V.outline_leaves(o).collect()} == {1: "A1", 3: "A2"}
    s = V.outline_sections(o.where("seq IN (2, 5)"), spark.createDataFrame([("f", 9)], "file_id string, page_count int"))
    assert {r["title"]: (r["start_page"], r["end_page"]) for r in s.collect()} == {"A1": (1, 2), "A2": (3, 9)}


def test_page_types_and_phrases(spark):
    d = spark.createDataFrame([phrase(1, 1, "MAIN LEVEL FLOOR PLAN"), phrase(1, 2, "FIRE NOTES"), phrase(2, 1, "MECHANICAL FLOOR PLAN"), phrase(3, 1, "FLOOR PLAN"), phrase(3, 2, "SIGNAGE"), phrase(4, 1, "FLOOR PLAN", 0.1, 0.1), phrase(5, 1, "A-101 X")], PHRASES)
    assert {r["page"]: r["type"] for r in V.spatial_page_type(d).collect()} == {1: "floor_plan", 2: "unknown", 3: "both", 4: "unknown", 5: "unknown"}
    assert [r["page"] for r in V.drawing_phrases(d).collect()] == [4]
    assert {r["page"]: r["sheet_number"] for r in V.sheet_number(d).collect()} == {5: "A-101"}
    signs = spark.createDataFrame([("s", "f", 4, "floor plan", "q", None, None), ("t", "f", 4, "floor plan", "q", 0.5, 0.6), ("u", "f", None, "x", "q", None, None)], "sign_id string, file_id string, page_number int, location string, sign_identifier string, x_pos double, y_pos double")
    got = {r["sign_id"]: r["x_pos"] for r in V.filled_coordinates(signs, d).collect()}
    assert round(got["s"], 3) == 0.125 and got["t"] == 0.5 and got["u"] is None
    assert [r["sign_id"] for r in V.coordinates_table(signs).collect()] == ["t"]


def test_scalars(spark):
    d = spark.createDataFrame([("Grace Church Campus", "Lincoln Tower"), ("x", "Baptist Hall")], "a string, b string")
    assert [tuple(r) for r in d.select(V.building_type(F.col("a")), V.building_type(F.col("b"))).collect()] == [("school", "office"), (None, "church")]
    r = spark.range(1).select(V.canonical_words(F.array(F.lit("conf"), F.lit("rm")), {"conf": "conference"}).alias("w"), V.tight_box(F.lit(0.0), F.lit(1.0), F.lit("ab cd"), F.lit("CD")).alias("b"), V.match_band(F.lit(0.7)).alias("m"), V.source_label(F.lit(False), F.lit(False), F.lit(True), F.lit(True)).alias("s"), V.overlaid({"a": "1"}, {"a": "2"})["a"].alias("o"), V.patched(F.struct(F.lit(1).alias("x")), {"x": F.lit(2)}).alias("p")).first()
    assert r["w"] == ["conference", "rm"] and round(r["b"]["x0"], 2) == 0.6 and (r["m"], r["s"], r["o"], r["p"]["x"]) == ("fair", "both", "2", 2)


def test_logs(spark):
    u = "0123abcd-0000-0000-0000-00000000000"
    log = spark.createDataFrame([("j", 1, f"sheet_manifest_{u}1", "bad", None), ("j", 2, f"phase-2-classification_{u}2", "bad", None), ("j", 3, f"text_extraction_{u}1", "bad", True), ("j", 4, f"other_{u}3", "bad", True)], "job_id string, seq int, step string, error string, skipped boolean")
    assert tuple(V.failure_counts(log).first()) == ("j", 2, 1)
    steps = spark.createDataFrame([("j", "a", 1, "x", 5, None, None, "pdf"), ("j", "a", 2, "y", 7, "e", None, "ocr"), ("j", "b", 1, "z", 90, None, True, "pdf")], "job_id string, file_id string, seq int, label string, duration_ms int, error string, skipped boolean, source string")
    assert [tuple(r)[1:] for r in V.file_summary(steps).collect()] == [("a", 12, True, False, "x", "mixed"), ("b", 90, False, True, "z", "pdf")]
    calls = spark.createDataFrame([("j", 1, "ai_x", None, None, "p"), ("j", 2, "plain", None, 3, "q"), ("j", 3, "plain", 0, 0, "r")], "job_id string, seq int, step string, tokens_in int, tokens_out int, details string")
    assert sorted(r["seq"] for r in V.model_steps(calls, ["ai_"]).collect()) == [1, 2]
    assert V.last_step(calls, "plain").first()["details"] == "r"


def test_pages(spark):
    f = spark.createDataFrame([("f", 5, [1, 2], [2, 4])], "file_id string, page_count int, floor_plan_pages array<int>, schedule_pages array<int>")
    assert [(r["page"], r["type"]) for r in V.fallback_rows(f).collect()] == [(1, "floor_plan"), (2, "both"), (3, "other"), (4, "sign_schedule"), (5, "other")]
    d = spark.createDataFrame([("f", [3], [1], ["i", "ii"], [(1, 2, "S"), (3, 9, "T")])], "file_id string, schedule_pages array<int>, both_pages array<int>, page_labels array<string>, sections array<struct<start_page:int,end_page:int,title:string>>")
    assert [(r["page"], r["label"], r["section"]) for r in V.detection_rows(d).collect()] == [(1, "i", "S"), (3, None, "T")]
    page, more = V.page_with_next(spark.range(5), ["id"], 2, 2)
    assert [r["id"] for r in page.collect()] == [2, 3] and more.first()["has_next"]
    base, over = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, label string"), spark.createDataFrame([("b", "3"), ("c", "4")], "key string, label string")
    assert {r["key"]: (r["label"], r["origin"]) for r in V.provenance(base, over).collect()} == {"a": ("1", "built-in"), "b": ("3", "override"), "c": ("4", "custom")}


def test_sign_lists_come_in_many_files(spark, monkeypatch):
    from drawlake.plans import screens

    root = "/root/testdata/sf0.001"
    whole = sorted(screens.title_rows(spark, root).collect(), key=repr)
    monkeypatch.setattr(screens, "_LIST_ROWS", 1000)
    d = screens.title_rows(spark, root)
    assert len(d.inputFiles()) > 9 and sorted(d.collect(), key=repr) == whole
