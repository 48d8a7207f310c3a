"""Spelling variants, conversation repair and sharding against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from drawlake.llm import repair, shards, spelling

# --- spelling variants


def near(a, b):
    """One letter inserted, deleted or replaced, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, min_length=7, min_count=2, ratio=10):
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    forms, out = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = len(others)

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return {(w, forms[w], root(w), n, out[w], words.get(forms[w])) for w, n in words.items()}


def test_variants_equal_plain_ones(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcéÿ") for _ in range(rng.randrange(6, 11))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaab", "baaaaaaa", "aaaabaaa", "zz" * 400, "zz" * 400 + "q"]
    counts = Counter()
    for w in base:
        counts[w] += rng.choice((1, 2, 30, 500, 9000))
        for _ in range(6):
            k = rng.randrange(len(w))
            counts[rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice("abcéÿ") + w[k:], w[:k] + rng.choice("abcéÿ") + w[k + 1 :]))] += rng.choice((1, 2, 3, 25, 300))
    rows = [(w, n) for w, n in counts.items()] + [(None, 5), ("", 9)]
    halves = [(w, n - n // 2) for w, n in rows] + [(w, n // 2) for w, n in rows]
    got = spelling.variants(spark.createDataFrame(halves, "word string, n long").repartition(5)).collect()
    assert {tuple(r) for r in got} == plain_variants(counts) and len(got) == len({r["word"] for r in got})
    assert any(r["root"] not in (r["word"], r["form"]) for r in got), "a chain of forms"
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(halves, "word string, n long"), ratio=1)


def test_words_are_damaged_by_their_crc(spark, edges, nothing):
    want = Counter()
    for r in edges.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{w}".encode())
            w = w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                want[w] += 1
    assert {r["word"]: r["n"] for r in spelling.damaged_words(edges).collect()} == want and "x" * 50_000 in want
    assert spelling.variants(spelling.damaged_words(nothing)).count() == 0


def test_long_words_meet(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    rows = [(long, 100), (long[:15_000] + long[15_001:], 2), (long[:99] + "é" + long[100:], 3), (long[:5] + long[7:], 4)]
    got = {(len(r["word"]), r["n_near"], r["form_n"]) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {(30_000, 2, None), (29_999, 2, 100), (30_000, 1, 100), (29_998, 0, None)} or got == {(30_000, 2, None), (29_999, 1, 100), (30_000, 1, 100), (29_998, 0, None)}


# --- conversation repair


def plain_repair(turns):
    """Least (cost, audit) by a search in order of cost and audit over (turns done, roles so far)."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "0")], set()
    while heap:
        cost, audit, j, state = heapq.heappop(heap)
        if (j, state) in done:
            continue
        done.add((j, state))
        if j == len(turns) and state in "0a":
            return cost, audit
        nxt = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", j, nxt))
        if j < len(turns):
            initial, fault = turns[j]
            heapq.heappush(heap, (cost + 2, audit + "D", j + 1, state))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + more + 1, audit + "R", j + 1, nxt))
                if (state, initial) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", j + 1, step[state, initial]))
    raise AssertionError


def some_turns(rng, n):
    return [(rng.choice("suauauat"), rng.choices(("", "blank", "duplicate", "truncated"), (8, 1, 1, 1))[0]) for _ in range(n)]


def test_layers_equal_a_plain_search():
    rng = random.Random(1)
    for n in [0, 1, 2, 3] * 40 + list(range(4, 50)):
        turns = some_turns(rng, n)
        assert repair.least_edits(turns) == plain_repair(turns), turns
    for faults in ("blank", "truncated", "duplicate"):
        for initial in "sua":
            assert repair.least_edits([(initial, faults)] * 37) == plain_repair([(initial, faults)] * 37)


def test_matrices_join_like_the_turns():
    rng = random.Random(2)
    for _ in range(30):
        a, b = some_turns(rng, rng.randrange(1, 40)), some_turns(rng, rng.randrange(1, 40))
        behind = repair._behind(b, repair.ENDS)[0]
        first = repair.matrix(a)
        assert tuple(min(first[4 * q + r] + behind[r] for r in range(4)) for q in range(4)) == repair._behind(a + b, repair.ENDS)[0]


def plain_digest(rows):
    """Rows ``turn, role, text`` of a conversation -> what op12 says of it."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, turns = set(), []
    for _, role, text in rows:
        kept = text.rstrip(" \t\n\x0b\x0c\r")
        turns.append((role[:1], "blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    cost, audit = repair.least_edits(turns) if len(turns) > 300 else plain_repair(turns)
    lines, at, state = [], iter(rows), "0"
    for letter in audit:
        _, role, text = (None, "", "") if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if state == "u" else "user"
        state = role[0]
        lines.append(f"{role}:{text}")
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    faults = Counter(f for _, f in turns)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_conversations_of_any_length(spark):
    rng = random.Random(7)
    talk = lambda k, n: [(k, rng.choice((None, t, t, t, t + 2)), rng.choice(("user", "assistant", "assistant", "user", "system", "tool", "")), rng.choice(("Hi.", "", " \n", f"said {t}!", f"cut {t}", "é🎉?"))) for t in range(n)]
    rows = [r for k in range(60) for r in talk(k, rng.randrange(1, 9))] + talk(1 << 60, 9_000) + talk(None, 30) + [(77, 4, "user", "same.")] * 5_000 + [(78, None, None, None)]
    df = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, piece int").repartition(6)
    want = defaultdict(list)
    for k, t, role, text in rows:
        want[k].append((t, " " if role is None else role, " " if text is None else text))
    pieces = repair.materialize(repair.repair(df), "pieces")
    assert pieces.where("conv_id = 1152921504606846976").count() >= 3, "cut into pieces"
    assert pieces.selectExpr("max(size(edits))").first()[0] < 2 * repair.PIECE
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_digests(pieces).collect()}
    assert got.keys() == want.keys()
    for k, talked in want.items():
        assert got[k] == plain_digest(talked), k


def test_damage_and_nothing_left(spark):
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.", "x") for k in range(300) for t in range(k % 4)] + [(None, None, None, None, None), (5, 0, "user", "Turn 0.", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string")
    hurt = defaultdict(list)
    for k, t, role, text, _ in rows:
        c = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if c:
            hurt[k] += [(t, "user" if c == 4 else role, "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text)] * (2 if c == 3 else 1)
    got = defaultdict(list)
    for r in repair.damaged(df).collect():
        got[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in hurt.items()}
    assert len(hurt) < len({r[0] for r in rows}), "some conversation loses all its rows"
    assert repair.repair(df.where("false")).count() == 0 and repair.repair_digests(repair.repair(df.where("false"))).count() == 0


# --- sharding


def plain_best_fit(sizes, capacity, bins):
    left = [capacity] * bins
    at = []
    for s in sorted(sizes, reverse=True):
        fits = [(room, k) for k, room in enumerate(left) if room >= s]
        if not fits:
            return None
        room, k = min(fits)
        left[k] -= s
        at.append((s, k))
    return at


def test_runs_pack_like_single_items():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.choice((rng.randrange(1, 40), rng.randrange(1, 400))) for _ in range(rng.randrange(1, 300))]
        bins = rng.randrange(1, 12)
        capacity = max(max(sizes), -(-sum(sizes) // bins)) + rng.randrange(30)
        runs = sorted(Counter(sizes).items(), reverse=True)
        found = shards.best_fit(runs, capacity, bins)
        plain = plain_best_fit(sizes, capacity, bins)
        assert (found and Counter(k for s, b, n in found for k in [(s, b)] * n)) == (plain and Counter(plain))
        even = shards.equal_bins(runs, bins)
        assert sorted(s for s, _, n in even for _ in range(n)) == sorted(sizes) and {b for _, b, _ in even} <= set(range(bins))
        fill = Counter()
        for s, b, n in even:
            fill[b] += s * n
        assert max(fill.values()) <= max(max(sizes), sum(sizes) / bins) + 1 + 2 * max(sizes)
        few = shards.best_fit(runs, max(sizes) + 50)
        assert max(b for _, b, _ in few) + 1 <= -(-sum(sizes) // (max(sizes) + 50)) * 11 / 9 + 2, "few shards"


def test_tree_stays_in_order():
    rng, tree, plain = random.Random(6), shards.Tree(), []
    for _ in range(20_000):
        if plain and rng.random() < 0.45:
            bound = (rng.randrange(3_000), -1)
            want = min((e for e in plain if e >= bound), default=None)
            assert tree.take(bound) == want
            if want:
                plain.remove(want)
        else:
            e = (rng.randrange(3_000), rng.randrange(1 << 30))
            tree.add(e)
            plain.append(e)
            if len(plain) > 1_500:
                plain.remove(tree.take((0, -1)))


def checked(rows, n_shards):
    """Slots gapless, equal texts together; returns the bytes of each shard."""
    fill, slots, at = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        fill[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        at[r["key"]].add(r["shard"])
    assert set(fill) <= set(range(n_shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    return fill, at


def test_shards_of_equal_bytes(spark, edges, nothing):
    rng = random.Random(8)
    texts = ["w" * rng.randrange(0, 300) + str(k % 1900) for k in range(4_000)] + [None, "", "same"] * 5
    docs = spark.createDataFrame([(k // 2 if k % 5 else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, shard string").repartition(7)
    fill, at = checked(shards.assign(shards.numbered(docs), 24).collect(), 24)
    mean = sum(fill.values()) / 24
    assert len(fill) == 24 and all(abs(f - mean) < 0.02 * mean for f in fill.values()) and all(len(s) == 1 for s in at.values())
    rows = shards.assign(shards.numbered(edges), 4).collect()
    assert len(rows) == edges.count() and shards.assign(shards.numbered(nothing), 4).count() == 0
    for r in shards.numbered(edges, carry=True).collect():
        raw = (r["row"]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    with pytest.raises(ValueError):
        shards.assign(shards.numbered(docs), None)


def test_a_third_of_all_rows_is_one_text(spark):
    docs = spark.range(9_000).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copied " * 9)).otherwise(F.concat(F.lit("own " * 9), F.col("id"))).alias("text"))
    rows = shards.assign(shards.numbered(docs), 24).collect()
    fill, at = checked(rows, 24)
    mean = sum(fill.values()) / 24
    assert all(abs(f - mean) < 0.15 * mean for f in fill.values()) and max(map(len, at.values())) <= 12 and sum(len(s) > 1 for s in at.values()) == 1


def test_fixed_capacity_and_files(spark, edges, tmp_path):
    told = shards.write_shards(edges, str(tmp_path / "out"), shards=None, capacity=60_000).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select("row.*").collect())) == sorted(map(repr, edges.collect()))
    assert {r["shard"]: r["rows"] for r in told} == {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()}
    assert all(r["bytes"] <= 60_000 or r["rows"] == 1 for r in told) and len(told) < 10


def test_queries_run(spark):
    import __spark_entry__ as e

    for name in ("op11_spelling_variants", "op12_conversation_repair", "op13_shards"):
        df = e.queries()[name](spark, "/root/testdata/sf0.001")
        assert df.count() > 0 and name in e.oracle_sql()
