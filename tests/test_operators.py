"""Operators on small fixtures: classification, geometry, folds, knowledge, models, state, files, streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from drawlake.functions import text as T
from drawlake.operators import classify as C
from drawlake.operators import filters as P
from drawlake.operators import geometry as G
from drawlake.operators import joins as J
from drawlake.operators import knowledge as K
from drawlake.operators import models as M
from drawlake.operators import state as S
from drawlake.operators import windows as W
from drawlake.sources import files as X
from drawlake.streaming import events as E

DATA = "/root/testdata/sf0.001"

TITLES = [
    ("SIGN SCHEDULE", None, "signage_schedule"), ("LIFE SAFETY PLAN", None, "life_safety"), ("EGRESS PLAN", None, "life_safety"), ("OVERALL KEY PLAN", None, "key_plan"), ("ROOF PLAN", None, "ignore"), ("MECHANICAL FLOOR PLAN", None, "ignore"),
    ("MAIN LEVEL FLOOR PLAN", None, "floor_plan"), ("FOUNDATION PLAN", None, "ignore"), ("REFLECTED CEILING PLAN", None, "ignore"), ("FINISH PLAN", None, "ignore"), ("SANITARY PLAN", None, "ignore"), ("WALL TYPES SEE FLOOR PLAN", None, "other"),
    ("BUILDING", "A-101", "floor_plan"), ("STAIR DETAIL", "A-201", "other"), ("SEE FLOOR PLAN", "A-301", "other"), ("GENERAL NOTES", None, "general_notes"), ("LEGENDS", "G-001", "general_notes"), ("ADA DETAILS", None, "accessibility"),
    ("CASEWORK", None, "millwork_interiors"), ("X", "A-701", "millwork_interiors"), ("SPECIFICATIONS", None, "specifications"), ("", None, "other"), (None, None, "other"), ("THIRD LEVEL PLAN", None, "floor_plan"),
]


def test_titles(spark):
    d = spark.createDataFrame(TITLES, "title string, number string, want string").withColumn("got", C.title_bucket(F.col("title"), F.col("number")))
    assert [(r["title"], r["number"], r["got"]) for r in d.collect() if r["got"] != r["want"]] == []


def test_levels(spark):
    d = spark.createDataFrame([("Second Floor Plan - Area B", "L2", "Second Floor", "AREA B", None), ("BLDG C BASEMENT", "B1", "BASEMENT", None, "BUILDING C"), ("Plan", None, None, None, None)], "t string, l string, r string, a string, b string")
    for r in d.select("*", C.level(F.col("t")).alias("gl"), C.level_raw(F.col("t")).alias("gr"), C.area(F.col("t")).alias("ga"), C.building(F.col("t")).alias("gb"), C.canonical_level(F.col("t")).alias("c")).collect():
        assert (r["gl"], r["gr"], r["ga"], r["gb"]) == (r["l"], r["r"], r["a"], r["b"])


def test_manifest(spark):
    pages = spark.createDataFrame([("f", 2, "X", "A101"), ("f", 3, None, "A-102"), ("f", 4, "SIGN SCHEDULE", "S-1"), ("f", 5, "ROOF", None)], "file_id string, page int, title string, sheet_number string")
    outline = spark.createDataFrame([("f", 2, "LATER", 5), ("f", 1, "MAIN LEVEL FLOOR PLAN", 5)], "file_id string, seq int, title string, page int")
    index = spark.createDataFrame([("f", 1, "A-101", "FIRST FLOOR PLAN"), ("f", 2, "A.102", "SECOND FLOOR PLAN")], "file_id string, seq int, sheet_number string, title string")
    m = C.manifest(pages, outline, index)
    got = {r["page"]: (r["source"], r["bucket"], r["level"]) for r in m.collect()}
    assert got == {2: ("index_page", "floor_plan", "L1"), 3: ("index_page", "floor_plan", "L2"), 4: ("title_block", "signage_schedule", None), 5: ("bookmark", "floor_plan", "L1")}
    assert C.page_lists(m).first()["floor_plan_pages"] == [2, 3, 5]


def items(spark, rows):
    return spark.createDataFrame([("f", 1, i, t, x, y, w, 10.0, 1000.0, 800.0) for i, (t, x, y, w) in enumerate(rows)], X.ITEMS)


def test_glyph_merge(spark):
    d = items(spark, [("R", 10.0, 100.0, 8.0), ("M", 18.5, 101.0, 8.0), ("LOBBY", 300.0, 100.0, 50.0), ("FAR", 450.0, 100.0, 30.0), ("MAIN", 300.0, 300.0, 40.0), ("HALL", 345.0, 300.0, 40.0)])
    got = sorted(r["text"] for r in G.merged_glyphs(d).collect())
    assert got == ["FAR", "LOBBY", "MAIN HALL", "RM"]
    assert G.page_text(G.merged_glyphs(d)).first()["text"] == "RM LOBBY FAR MAIN HALL"
    shuffled = G.merged_glyphs(d.repartition(3).orderBy(F.rand(1)))
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, G.merged_glyphs(d).collect()))


def test_table_columns(spark):
    col = [("f", 1, i, f"t{i}", 0.5, 0.1 + 0.05 * i, 0.55, 0.12 + 0.05 * i, 1000.0, 800.0) for i in range(7)]
    lab = [("f", 1, 10 + i, f"r{i}", 0.1 + 0.1 * i, 0.3 * i, 0.2, 0.4, 1000.0, 800.0) for i in range(3)]
    schema = "file_id string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"
    assert sorted(r["text"] for r in G.without_table_columns(spark.createDataFrame(col + lab, schema)).collect()) == ["r0", "r1", "r2"]
    assert G.without_table_columns(spark.createDataFrame(col[:4], schema)).count() == 4
    signs = spark.createDataFrame([("f", 1, "s", "r1 label", "r2"), ("f", 1, "u", "nothing", None)], "file_id string, page int, sign_id string, query string, room_number string")
    got = {r["sign_id"]: r["text"] for r in G.best_phrase(signs, spark.createDataFrame(lab, schema)).collect()}
    assert got == {"s": "r2"}


@pytest.mark.parametrize("seed", range(3))
def test_folds_equal_plain_loops(spark, seed):
    rng = random.Random(seed)
    data = [(k, s, float(rng.randint(0, 40)), rng.randint(1, 60)) for k in range(6) for s in range(rng.randint(1, 12))]
    d = spark.createDataFrame(data, "k int, s int, y double, n int").repartition(3)
    lines, batches = {}, {}
    for k in range(6):
        own = sorted((y, s) for kk, s, y, _ in data if kk == k)
        line, anchor = 0, None
        for y, s in own:
            if anchor is None or abs(y - anchor) > 5:
                line, anchor = line + 1, y
            lines[k, s] = line
        used = batch = 0
        for s, n in sorted((s, min(n, 50)) for kk, s, _, n in data if kk == k):
            if batch == 0 or used + n > 80:
                batch, used = batch + 1, 0
            used += n
            batches[k, s] = batch
    assert {(r["k"], r["s"]): r["line"] for r in W.anchored_lines(d, ["k"], "y", "s", 5.0).collect()} == lines
    assert {(r["k"], r["s"]): r["batch"] for r in W.next_fit(d, ["k"], "s", "n", 80, 50).collect()} == batches
    pairs = [(k, a, b, float(rng.randint(1, 5))) for k in range(6) for a in range(5) for b in range(5) if rng.random() < 0.6]
    want = []
    for k in range(6):
        taken = set()
        for a in range(5):
            free = [(-s, b) for kk, aa, b, s in pairs if (kk, aa) == (k, a) and b not in taken]
            if free:
                s, b = min(free)
                taken.add(b)
                want.append((k, a, b, -s))
    got = J.greedy_pairs(spark.createDataFrame(pairs, "k int, a int, b int, s double"), ["k"], "a", "b", "s")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_greedy_members_give_the_pairs_of_greedy_pairs_without_making_them(spark):
    rng = random.Random(6)
    rows = [(rng.choice([0, 1, 2, 3, None]), *(rng.choice([*range(12), None]) for _ in range(2))) for _ in range(300)]
    d = spark.createDataFrame([*rows, (9, 1, None), (10, None, 1), (11, None, None)], "k int, a int, b int")
    score = lambda a, b: F.pmod(a * 7 + b * 5, F.lit(6)) - 1
    pairs = d.select("k", "a").distinct().join(d.select("k", "b").distinct(), "k").withColumn("s", score(F.col("a"), F.col("b")).cast("double"))
    for least in (-1, 0, 3):
        want = J.greedy_pairs(pairs.where(F.col("s") >= least), ["k"], "a", "b", "s")
        got = J.greedy_members(d, ["k"], "a", "b", score, least)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
        assert [t for _, t in got.dtypes] == [t for _, t in want.dtypes]


def test_greedy_match_reads_its_table_once_and_sorts_no_pairs(spark):
    from drawlake.plans import REGISTRY

    plan = REGISTRY["greedy_match"].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Sort [" not in plan
    assert "REPARTITION_BY_NUM" in plan, "adaptive execution does not join the parts up"


def test_band_join_equals_a_loop(spark):
    rng = random.Random(4)
    a = [(i, i % 3, rng.uniform(0, 50)) for i in range(60)]
    b = [(i, i % 3, rng.uniform(0, 50)) for i in range(60)]
    got = J.band_join(spark.createDataFrame(a, "i int, k int, x double"), spark.createDataFrame(b, "j int, k int, rx double"), ["k"], "x", "rx", 2.5)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, k, x in a for j, m, y in b if k == m and abs(x - y) <= 2.5)


def test_dedup_and_occurrences(spark):
    d = spark.createDataFrame([(1, "A", "x", None, 0.9), (2, "A", "x", "d", 0.5), (3, "A", "x", "e", 0.5), (4, None, "x", None, 0.1), (5, None, "x", None, 0.1)], "seq int, loc string, typ string, detail string, conf double")
    assert sorted(r["seq"] for r in W.preferred(d, ["loc", "typ"], F.col("detail").isNotNull(), "conf", "seq").collect()) == [2, 4, 5]
    o = W.occurrences(d, [T.occurrence_key(F.col("loc"), F.col("typ"))], ["seq"], singleton_null=True)
    assert {r["seq"]: (r["occurrence_index"], r["occurrence_total"]) for r in o.collect()} == {1: (1, 3), 2: (2, 3), 3: (3, 3), 4: (1, 2), 5: (2, 2)}
    kept = J.not_found(d, d.where("seq = 1"), [F.col("loc")], [F.col("loc")])
    assert sorted(r["seq"] for r in kept.collect()) == [4, 5]


def test_scalars(spark):
    d = spark.createDataFrame([("  x \t", "12abc", "abc")], "a string, b string, c string")
    r = d.select(T.trimmed(F.col("a")), T.leading_int(F.col("b")), T.leading_int(F.col("c")), T.half_up(F.lit(-2.5)), T.initials(F.lit("ann"), F.lit("bee")), T.bounded(F.lit("room 12a"), "12"), T.joined_notes(F.lit("a"), F.lit(None), F.lit("b"))).first()
    assert tuple(r) == ("x", 12, None, -2, "AB", False, "a; b")
    s = d.select(T.phrase_score(F.array(F.lit("lobby"), F.lit("main")), F.array(F.lit("main"), F.lit("lobbies"))).alias("s"), P.code_only(F.lit("A-101")).alias("c"), P.code_only(F.lit("A-101 LOBBY")).alias("w")).first()
    assert 0.75 < s["s"] < 1 and s["c"] and not s["w"]
    with pytest.raises(ValueError):
        P.page_request(500)
    with pytest.raises(PermissionError):
        P.Principal(role="SALES").org_scope("org_id")


def test_knowledge(spark, tmp_path):
    good = "---\njurisdiction: US\ndoc_type: federal_codes\nsection: \"7\"\neffective_date: 2020-01-01\nstatus: draft\nstatus: active\n---\n" + "A sentence. " * 400
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.md").write_text(good)
    (tmp_path / "b.txt").write_text("---\njurisdiction: US\nstatus: old\neffective_date: 1/2/3\n---\nbody")
    (tmp_path / "README.md").write_text("no")
    f = K.front_matter(K.knowledge_files(spark, str(tmp_path)))
    by = {r["path"].rsplit("/", 1)[1]: r for r in f.withColumn("e", K.metadata_errors(F.col("metadata"))).collect()}
    assert set(by) == {"a.md", "b.txt"} and by["a.md"]["e"] == [] and by["a.md"]["metadata"]["status"] == "active" and by["a.md"]["metadata"]["section"] == "7"
    assert sorted(by["b.txt"]["e"]) == ["invalid effective_date", "invalid status", "missing doc_type", "missing section"]
    c = K.chunk_rows(f).orderBy("chunk_index").collect()
    assert len(c) == 3 and all(len(r["chunk"]) <= 2000 and r["chunk"].endswith(".") for r in c) and c[1]["start_char"] == c[0]["end_char"] - 200
    assert list(K.chunk_spans("x" * 49)) == [] and [s[:3] for s in K.chunk_spans("x" * 4100)] == [(0, 0, 2000), (1, 1800, 3800), (2, 3600, 4100)]
    bare = K.chunk_rows(f, texts=False).orderBy("chunk_index")
    assert "chunk" not in bare.columns and [(r["chunk_id"], r["start_char"], r["end_char"]) for r in bare.collect()] == [(r["chunk_id"], r["start_char"], r["end_char"]) for r in c]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= K.TEXTS, "a batch holds few whole texts"
    plan = K.chunk_rows(f)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Filter" in x and "missing section" in x], "the header is read once, not in a filter for each field"
    merged = K.upserted(bare, bare)._jdf.queryExecution().optimizedPlan().toString()
    assert merged.count("ArrowEvalPython") == 1, "new rows are made once: here only the store is a plan"
    store = K.upserted(K.chunk_rows(f).limit(0), K.chunk_rows(f))
    assert K.upserted(store, K.chunk_rows(f)).count() == 3
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id int, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in K.vector_query(v, [1.0, 0.0], 2).collect()] == [(1, 1.0), (2, 0.5)]


@pytest.mark.parametrize(
    ("raw", "want"),
    [('[{"a":1}]', [{"a": 1}]), ('```json\n[{"a":1},{"b":2}]\n```', [{"a": 1}, {"b": 2}]), ('[{"a":1},{"b":"x', [{"a": 1}]), ('[{"a":"}{"},{"b', [{"a": "}{"}]), ("no array", []), (None, []), ('[{"a":1},3]', []), ('[{"a":{"c":[1,2]}},{"b":', [{"a": {"c": [1, 2]}}])],
)
def test_answers(raw, want):
    assert M.parsed_rows(raw, lambda r: True) == want


def test_one_bad_row_voids_all():
    assert M.parsed_rows('[{"a":1},{"a":null}]', lambda r: r["a"] is not None) == []
    assert M.recovered_callouts('x {"confidence":0.9,"t":1} {"confidence":0.5} {bad}') == [{"confidence": 0.9, "t": 1}]


def test_model_calls(spark):
    waits = []

    def flaky():
        if len(waits) < 3:
            raise M.RateLimited
        return "ok"

    assert M.with_retries(flaky, sleep=waits.append) == "ok" and waits == [8.0, 16.0, 32.0]
    d = spark.createDataFrame([("j", "hello there"), ("j", None)], "job string, prompt string")
    got = M.call_model(d, "project_info", M.EchoClient())
    assert got.where("error IS NULL").count() == 2 and M.call_log(got, "project_info", "job").where("ok").count() == 2
    assert M.registry(spark).count() == 6
    assert M.failure_alert(spark.createDataFrame([("a", "e"), ("a", None), ("b", "e")], "job_id string, error string")).collect()[0]["job_id"] == "b"


def test_state(spark):
    cols = "id int, job_id string, file_id string, typ string, note string, verified boolean, manual boolean"
    old = spark.createDataFrame([(1, "a", "f", "T", None, True, False), (2, "a", "f", "U", None, False, False), (3, "b", "g", "V", "n", False, None)], cols)
    new = spark.createDataFrame([(4, "a", "f", "N", None, False, False)], cols)
    jobs = spark.createDataFrame([("a",)], "job_id string")
    assert sorted(r["id"] for r in S.rescanned(old, new, jobs).collect()) == [1, 3, 4]
    assert sorted(r["id"] for r in S.without_jobs(old, jobs).collect()) == [3]
    fill = spark.createDataFrame([(9, "a", "f", "U", "filled", False, False), (10, "a", "f", "T", "no", False, False), (11, "a", "f", "Z", "new", False, False)], cols)
    got = {r["id"]: r["note"] for r in S.merged(old, fill, ["job_id", "typ"], ["note"]).collect()}
    assert got == {1: None, 2: "filled", 3: "n", 11: "new"}
    log = spark.createDataFrame([(1, "patch", 2, "W", None), (2, "delete", 3, None, None), (3, "create", 7, "C", "c")], "seq int, op string, id int, typ string, note string")
    after = {r["id"]: (r["typ"], r["verified"]) for r in S.applied(old, log, "id", ["typ"]).collect()}
    assert after == {1: ("T", True), 2: ("W", True), 7: ("C", False)}
    files = spark.createDataFrame([("a", "failed"), ("a", "completed"), ("b", "failed"), ("c", "pending"), ("d", "processing"), ("d", "failed")], "job_id string, status string")
    assert {r["job_id"]: r["status"] for r in S.job_status(files).collect()} == {"a": "completed", "b": "failed", "c": "pending", "d": "processing"}
    t = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id int, confidence double")
    i = spark.createDataFrame([(5, 0.4), (6, 0.4)], "id int, confidence double")
    p = spark.createDataFrame([(1, 5)], "text_id int, image_id int")
    assert {r["id"]: (r["found_by"], r["confidence"]) for r in S.compared(t, i, p).collect()} == {1: ("both", 1.0), 2: ("text", 0.5), 6: ("image", 0.4)}


def test_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Project,,\nSign ID,Type,Room\n1,T1,Lobby\n,,\n2,,Hall\n")
    got = X.sign_list(spark, str(tmp_path / "s.csv"))
    assert got.columns == ["identifier", "sign_type", "location"] and {"1", "2"} <= {r["identifier"] for r in got.collect()}
    (tmp_path / "up").mkdir()
    (tmp_path / "up/a.pdf").write_bytes(b"x y")
    (tmp_path / "up/b.txt").write_bytes(b"x")

    class Words:
        def items(self, content):
            for k, w in enumerate(content.decode().split()):
                yield (1, k, w, 10.0 * k, 5.0, 8.0, 10.0, 100.0, 100.0)

    import pickle

    with pytest.raises((AttributeError, pickle.PicklingError)):
        pickle.dumps(Words())  # local classes go by value through the closure instead
    assert [r["text"] for r in X.raw_items(spark, str(tmp_path / "up"), Words()).orderBy("seq").collect()] == ["x", "y"]
    assert X.uploads(spark, str(tmp_path / "up")).count() == 1
    (tmp_path / "o.json").write_text('{"a": "b"}')
    assert X.overlay(spark, str(tmp_path / "o.json")) == {"a": "b"}
    signs = spark.createDataFrame([("f", 1, "T", "d", None, False, 0.9, True, "i", 0.2, 0.3), ("f", 2, "T", "d", 3, False, 0.5, False, "j", None, None), ("f", 2, "T", "d", 3, True, 0.5, False, "k", None, None)], "file_id string, page_number int, sign_type string, dimensions string, quantity int, hidden boolean, confidence_score double, review_flag boolean, sign_identifier string, x_pos double, y_pos double")
    sheets = X.export_sheets(signs)
    assert tuple(sheets["summary"].first()) == (2, 4, 1, 1)
    assert {(r["sign_type"], r["quantity"], r["pages"]) for r in sheets["types"].collect()} == {("T", 4, "1, 2"), ("TOTAL", 4, "1, 2")}
    X.write_sheets(sheets, str(tmp_path / "out"))
    pages = spark.createDataFrame([("f", 1, 90)], "file_id string, page int, rotation int")
    assert [(r["x"], r["y"], r["legend"]) for r in X.markers(signs, pages).collect()] == [(0.3, 0.8, 1)]


def test_stream_ends_with_the_batch_rows(spark, tmp_path):
    src = spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts")
    src.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = E.event_stream(spark, str(tmp_path / "in"), src)
    stream.groupBy("event_type").count().writeStream.outputMode("complete").format("memory").queryName("by_type").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("by_type").collect())) == sorted(map(tuple, src.groupBy("event_type").count().collect()))
    E.run_to_end(E.deduplicated(stream, ["event_id"], "3650 days").select("event_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == src.select("event_id").distinct().count()
    seen = []
    E.latest_snapshots(stream, "user_id", lambda b, n: seen.append(b.count()), str(tmp_path / "cp2")).awaitTermination()
    assert sum(seen) >= src.select("user_id").distinct().count()
    assert E.session_counts(src.withColumn("ts", F.col("ts").cast("timestamp"))).agg(F.sum("n")).first()[0] == src.count()
    assert E.error_rates(src.withColumn("ts", F.col("ts").cast("timestamp")), warn=0).count() >= 0


def test_nearest_by_value_equals_a_loop(spark):
    rng = random.Random(7)
    a = [(i, i % 2, float(rng.randint(0, 12))) for i in range(40)] + [(40, 0, None), (41, 7, 1.0)]
    b = [(i, i % 2, float(rng.randint(0, 12))) for i in range(25)] + [(25, 1, None)]
    got = J.nearest_by_value(spark.createDataFrame(a, "i int, k int, x double"), spark.createDataFrame(b, "j int, k int, rx double"), ["k"], "x", "rx", "j", 3)
    want = {(i, j, n + 1) for i, k, x in a if x is not None for n, (_, j) in enumerate(sorted((abs(x - y), j) for j, m, y in b if m == k and y is not None)[:3])}
    assert {(r["i"], r["j"], r["rank"]) for r in got.collect()} == want


def test_rules_are_bounded(spark):
    from drawlake.operators import joins as J

    rows, hit = spark.range(3).withColumnRenamed("id", "k"), F.col("k") <= F.col("id")
    assert [r["first"] for r in J.first_by_priority(rows, spark.range(5).withColumn("first", F.col("id")), ["k"], hit, ["id"], ["first"]).orderBy("k").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        J.first_by_priority(rows, spark.range(J.MOST_RULES + 1), ["k"], hit, ["id"], ["id"])
