"""Alerts over a live log: late events, restarts, and state that goes."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from drawlake.session import scratch
from drawlake.streaming.alerts import alerts, joined, run_alerts

START = datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, event_type string"


def plain(events, gap, least):
    """``user, opened, raised, last, n`` in minutes, by one pass over each user's sorted errors."""
    out = []
    for user in {u for u, _, kind in events if kind == "error"}:
        runs = []
        for m in sorted(m for u, m, kind in events if u == user and kind == "error"):
            if runs and m - runs[-1][-1] <= gap:
                runs[-1].append(m)
            else:
                runs.append([m])
        out += [(user, r[0], r[least - 1], r[-1], len(r)) for r in runs if len(r) >= least]
    return sorted(out)


def test_any_order_gives_the_same_alerts():
    rng = random.Random(5)
    for _ in range(200):
        times = [rng.randrange(100) for _ in range(rng.randrange(1, 25))]
        bursts = []
        for t in times:
            bursts, _ = joined(bursts, t, 4, 3)
        assert sorted((1, b[0], b[3][2], b[1], b[2]) for b in bursts if b[2] >= 3) == plain([(1, t, "error") for t in times], 4, 3)


def test_late_rows_and_a_restart(spark):
    """Three micro-batches in three runs of the same query; the second has late rows that bridge two alerts, the third drops one that is too late."""
    folder, out, state = scratch(spark, "events"), scratch(spark, "alerts"), scratch(spark, "state")
    minute = lambda m: START + timedelta(minutes=m)
    first = [(1, 0, "error"), (1, 5, "error"), (1, 20, "error"), (1, 26, "error"), (2, 3, "error"), (2, 30, "view"), (None, 8, "error"), (None, 9, "error")]
    late = [(1, 13, "error"), (2, 9, "error"), (3, 28, "error"), (3, 31, "error")]
    last = [(1, 1000, "view"), (9, 1000, None)]
    too_late = [(2, 14, "error"), (5, 3000, "view")]
    found = None
    for part in (first, late, last, too_late):
        spark.createDataFrame([(u, minute(m), kind) for u, m, kind in part], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        found = run_alerts(alerts(stream, "user_id", 600, 2, 5, "60 minutes"), out, state)
    rows = spark.read.parquet(out)
    at = lambda ts: round((ts - START).total_seconds() / 60)
    closed = sorted((r["user_id"] or 0, at(r["opened"]), at(r["raised"]), at(r["last"]), r["n"]) for r in rows.where("kind = 'closed'").collect())
    assert closed == plain([(u or 0, m, kind) for u, m, kind in first + late], 10, 2)
    assert (1, 0, 5, 26, 5) in closed
    assert {r["level"] for r in rows.where("kind = 'closed' AND user_id = 1").collect()} == {"critical"}
    # Each raised alert ends once.
    assert rows.where("kind = 'raised'").count() == rows.where("kind <> 'raised'").count() == 5
    assert rows.where("kind = 'merged'").count() == 1
    assert found.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_keys_of_a_bucket_share_state_and_a_timer(spark):
    """Many keys with several alerts each: calls to the state store grow with the buckets, not with keys and alerts."""
    rng = random.Random(8)
    events = [(u, m, "error") for u in range(300) for m in rng.sample(range(200), 8)]
    folder, out, state = scratch(spark, "events"), scratch(spark, "alerts"), scratch(spark, "state")
    at = lambda ts: round((ts - START).total_seconds() / 60)
    for part in (events[::2], events[1::2], [(1, 120, "view"), (7, 150, "error")], [(1, 9000, "view")]):
        spark.createDataFrame([(u, START + timedelta(minutes=m), kind) for u, m, kind in part], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        found = run_alerts(alerts(stream, "user_id", 600, 2, 5, "300 minutes", buckets=8), out, state)
        timers = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in found.recentProgress if p["stateOperators"]]
        assert timers and max(timers) <= 8
    rows = spark.read.parquet(out)
    closed = sorted((r["user_id"], at(r["opened"]), at(r["raised"]), at(r["last"]), r["n"]) for r in rows.where("kind = 'closed'").collect())
    assert closed == plain([*events, (7, 150, "error")], 10, 2)
    assert rows.where("kind = 'raised'").count() == rows.where("kind <> 'raised'").count()
    assert found.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0
