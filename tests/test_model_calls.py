"""Calls that are counted: once for each prompt, bounded, retried, and resumed after a killed task."""

from __future__ import annotations

import os
import sys
import time
import uuid
from dataclasses import dataclass

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from drawlake.operators import model_calls as C
from drawlake.operators.models import RateLimited
from drawlake.plans.asked import Draft

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests

@dataclass
class Counting:
    """Leaves a file for each call, with its begin and end; may kill its worker at a prompt, the first time only."""

    folder: str
    kill: str = "nobody"
    slow: float = 0.0

    def answer(self, kind, prompt):
        began = time.time()
        name = f"{self.folder}/{uuid.uuid4().hex}"
        with open(name, "w") as f:
            f.write(f"{prompt}\t{began}\t0")
        if prompt == self.kill and not os.path.exists(f"{self.folder}.killed"):
            open(f"{self.folder}.killed", "w").close()
            os._exit(1)
        time.sleep(self.slow)
        with open(name, "w") as f:
            f.write(f"{prompt}\t{began}\t{time.time()}")
        if prompt == "bad":
            raise ValueError("bad")
        return f"<{prompt}>"


def calls(folder):
    return [(p, float(a), float(b)) for p, a, b in (open(f"{folder}/{n}").read().split("\t") for n in os.listdir(folder))]


def test_a_prompt_is_called_once(spark, tmp_path):
    folder, store = str(tmp_path / "calls"), str(tmp_path / "store")
    os.mkdir(folder)
    rows = spark.createDataFrame([(i, None if i % 10 == 9 else "bad" if i % 10 == 8 else f"p{i % 10}", "x") for i in range(60)], "id long, prompt string, error_ string").repartition(5)
    got = C.ask(rows, "k", Counting(folder), store=store).collect()
    assert len(got) == 60 and sorted(p for p, _, _ in calls(folder)) == sorted({"", "bad", *[f"p{i}" for i in range(8)]})
    assert all((r["response"], r["error"]) == ((None, "ValueError: bad") if r["prompt"] == "bad" else (f"<{r['prompt'] or ''}>", None)) for r in got)
    again = C.ask(rows.union(spark.createDataFrame([(99, "new", "x")], rows.schema)), "k", Counting(folder), store=store).collect()
    assert sorted(p for p, _, _ in calls(folder))[-1] == "p7" and len(calls(folder)) == 12, "the new one, and the one that failed"
    assert {r["prompt"] for r in again if not r["kept"]} == {"new", "bad"}
    assert C.ask(rows.where("false"), "k", Counting(folder), store=store).count() == 0
    other = C.ask(rows, "another kind", Counting(folder), store=store)
    assert other.where("kept").count() == 0, "answers belong to a kind"


def test_a_killed_task_repeats_no_answered_call(spark, tmp_path):
    folder, store = str(tmp_path / "calls"), str(tmp_path / "store")
    os.mkdir(folder)
    rows = spark.createDataFrame([(f"q{i:02d}",) for i in range(40)], "prompt string")
    budget = C.Budget(lanes=2, in_flight=1)
    with pytest.raises(Exception, match="(?i)worker|job|abort"):
        C.ask(rows, "k", Counting(folder, kill="q17", slow=0.01), store=store, budget=budget)
    before = calls(folder)
    assert 0 < len(before) < 41
    got = C.ask(rows, "k", Counting(folder, kill="q17"), store=store, budget=budget).collect()
    assert {r["prompt"]: r["response"] for r in got} == {f"q{i:02d}": f"<q{i:02d}>" for i in range(40)}
    made = [p for p, _, _ in calls(folder)]
    twice = {p for p in made if made.count(p) > 1}
    assert "q17" in twice and len(twice) <= 2, "only what was open when its worker died"


def test_a_lane_that_runs_again_reads_its_journal(spark, tmp_path):
    folder, path = str(tmp_path / "calls"), str(tmp_path / "journal")
    os.mkdir(folder)
    rows = spark.createDataFrame([(f"k{i}", f"p{i}" if i else "bad") for i in range(20)], "key string, prompt string")
    run = lambda: {tuple(r)[:3] for r in rows.repartition(3, "key").mapInPandas(C._lane("k", Counting(folder), C.Budget(lanes=3), path), C._ANSWER).collect()}
    first = run()
    assert run() == first and len(first) == 20 and len(calls(folder)) == 20


def test_open_calls_and_rate_are_bounded(spark, tmp_path):
    folder = str(tmp_path / "calls")
    os.mkdir(folder)
    rows = spark.createDataFrame([(f"p{i}",) for i in range(30)], "prompt string")
    C.ask(rows, "k", Counting(folder, slow=0.05), budget=C.Budget(lanes=2, in_flight=3)).count()
    made = calls(folder)
    open_at = [sum(a <= t < b for _, a, b in made) for _, t, _ in made]
    assert 3 <= max(open_at) <= 6
    slow = str(tmp_path / "slow")
    os.mkdir(slow)
    C.ask(rows, "k", Counting(slow), budget=C.Budget(lanes=2, in_flight=4, per_second=20.0)).count()
    starts = sorted(a for _, a, _ in calls(slow))
    assert len(starts) == 30 and all(sum(s <= t < s + 1 for t in starts) <= 23 for s in starts)


def test_waits_double_and_end():
    class Never:
        def answer(self, kind, prompt):
            raise RateLimited("later")

    slept = []
    real, C.time.sleep = C.time.sleep, slept.append
    try:
        rows = C._called(Never(), "k", ["a"], ["p"], C.Budget(retries=4), C._Pace(0.0))
    finally:
        C.time.sleep = real
    assert slept == [8.0, 16.0, 32.0, 60.0] and rows[0]["attempts"] == 5 and rows[0]["error"] == "RateLimited: later"


def test_batches_of_ten(spark):
    rows = spark.createDataFrame([(i, "a b." * i) for i in range(37)] + [(99, None)], "id long, text string")
    got = {r["id"]: r["vector"] for r in C.vectors(rows, Draft()).collect()}
    assert got == {i: [4.0 * i, float(i), float(i)] for i in range(37)} | {99: [0.0, 0.0, 0.0]}
    wrong = C.ask(rows.where("id > 0"), "k", Draft(), prompt="text", budget=C.Budget(batch=11, lanes=1)).where(F.col("error").isNotNull())
    assert wrong.count() >= 33, "a call of eleven fails as a whole"


def test_short_calls_share_a_file_of_the_journal(tmp_path):
    from drawlake.operators.model_calls import Journal

    j = Journal(f"file://{tmp_path}", 0)
    for i in range(400):
        j.add([{"key": str(i), "duration_ms": 0}])
    j.write_due(now=True)
    assert sorted(int(r["key"]) for rows in j.rows() for r in rows) == list(range(400))
    assert len(list((tmp_path / "lane=0").iterdir())) <= 10
    j.add([{"key": "long", "duration_ms": 10}])
    assert "long" in {r["key"] for rows in j.rows() for r in rows}, "a long call is kept at once"
