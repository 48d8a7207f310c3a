"""Quality rules, SentencePiece, mixing, rollups, tool calls and the pipeline."""

from __future__ import annotations

import json
import random
import struct
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from drawlake.llm import mixing, quality, rollups, sentencepieces, toolcalls

DATA = "/root/testdata/sf0.001"


def plain_counts(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_counts_equal_plain_ones(spark, edges, nothing):
    extra = ["a b c d e a b c d e f", "x\nx\n\n\ny\nx", "a a a a a a a", "#*$%&|<> é" * 3, "a b c d e\nq a b c d e z a b c d e", "l1 \nl1 \n l1"]
    rows = [(i, t) for i, t in enumerate(extra)] + [(r["doc_id"], r["text"]) for r in edges.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.with_counts(df).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(r["row"]["text"]), r["row"]["text"][:60]
    assert quality.with_counts(nothing).count() == 0


def test_rules_are_learned_and_ordered(spark):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        w = [f"w{rng.randrange(5000)}" for _ in range(40)]
        docs.append((i, " ".join(x + ("!!" if bad else "") for x in w)))
        labels.append((i, 0 if bad else 1, 0))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.learn(quality.sample(d, lab))
    assert rules and all(r for r in rules)
    kept = {r["doc_id"] for r in quality.kept_documents(d, lab).collect()}
    good = {i for i in range(900) if i % 3}
    assert len(kept & good) / len(good) > 0.99 and len(kept - good) / 300 < 0.05
    none = quality.learn(quality.sample(d, lab.where("false")))
    assert none == [] and quality.kept_documents(d, lab.where("false")).count() == 900
    assert quality.kept_documents(d.where("false"), lab).count() == 0


def test_verdict_on_documents_that_taught_nothing(spark):
    """Two kinds of bad documents, told by different statistics, and one label in two hundred wrong: precision and recall on unseen rows."""
    rng = random.Random(4)

    def made(kind):
        w = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(rng.randint(40, 80))]
        tail = {0: "", 1: "!", 2: "42"}[kind]
        w = [x[: 4 - len(tail)] + tail if rng.random() < 0.5 else x for x in w]
        return " ".join(w)

    kinds = [rng.choice([0, 0, 0, 1, 2]) for _ in range(8000)]
    d = spark.createDataFrame([(i, made(k)) for i, k in enumerate(kinds)], "doc_id long, text string")
    taught = [(i, int((k == 0) != (rng.random() < 0.005))) for i, k in enumerate(kinds[:4000])]
    rules = quality.learn(quality.sample(d.where("doc_id < 4000"), spark.createDataFrame(taught, "doc_id long, quality int")))
    unseen = quality.with_counts(d.where("doc_id >= 4000")).select("row.doc_id", quality.verdict(rules).alias("kept")).collect()
    rejected = {r["doc_id"] for r in unseen if not r["kept"]}
    bad = {i for i in range(4000, 8000) if kinds[i]}
    assert len(rejected & bad) / len(rejected) > 0.97  # precision
    assert len(rejected & bad) / len(bad) > 0.9  # recall
    assert len({c.statistic for rule in rules for c in rule}) >= 2


def test_quality_keeps_columns(edges, spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.kept_documents(edges, lab)
    assert out.columns == edges.columns
    assert {r["text"] for r in out.collect()} == {r["text"] for r in edges.collect() if plain_counts(r["text"])[0] >= 10 and 100 * plain_counts(r["text"])[4] <= 20 * plain_counts(r["text"])[0]}


@pytest.fixture(scope="module")
def codec():
    return sentencepieces.PieceCodec(sentencepieces.load_pieces())


TEXTS = ["", " ", "Hello world", "  two  blanks ", "line\nfeed\r\n\ttab", "ünï cödé 🎉", "a▁b ▁ c▁", "Hello,world. don't (stop)!", "x" * 3000, "\x00\x01", "日本語 テキスト", "a" + " " * 40 + "b", "<0x0A> <s>", "\n", "▁"]


def test_round_trip(codec, spark, edges, nothing):
    rng = random.Random(1)
    more = ["".join(rng.choice("ab é▁\n 🎉,.x日") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t in TEXTS + more:
        assert codec.decode(codec.encode(t)) == t
    assert codec.encode(None) is None and codec.decode(None) is None
    got = sentencepieces.encode_documents(edges).collect()
    assert len(got) == 15 and all(r["decoded_ok"] for r in got)
    assert sentencepieces.encode_documents(nothing).count() == 0
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert sorted(r[0] for r in df.select(sentencepieces.decode(spark, sentencepieces.encode(spark, df["text"]))).collect()) == sorted(TEXTS)


def test_viterbi_equals_dynamic_programming(codec):
    pieces = {p: (i, s) for i, (p, s, k) in enumerate(sentencepieces.load_pieces()) if k == 0}
    rng = random.Random(2)
    for t in ["Hello world, this is plain text", "ünïcödé 日本 x"] + ["".join(rng.choice("abcdeth r.é") for _ in range(25)) for _ in range(40)]:
        marked = ("▁" + t).replace(" ", "▁")
        best = [0.0] + [float("-inf")] * len(marked)
        for e in range(1, len(marked) + 1):
            best[e] = best[e - 1] + codec.unknown
            for s in range(max(0, e - 20), e):
                if marked[s:e] in pieces:
                    best[e] = max(best[e], best[s] + pieces[marked[s:e]][1])
        ids = codec.encode(t)
        names = {i: s for i, s in pieces.values()}
        unknown = sum(c not in pieces for c in marked)
        assert abs(sum(names[i] for i in ids if i in names) + unknown * codec.unknown - best[-1]) < 1e-6


def test_whole_unigram_model_agrees_with_the_library(codec, tmp_path):
    """The same pieces and scores as a unigram model in the library's own format: equal total scores."""
    import sentencepiece

    def field(n, data):
        return bytes([n << 3 | 2]) + _varint(len(data)) + data

    def _varint(v):
        out = b""
        while v > 127:
            out += bytes([v & 127 | 128])
            v >>= 7
        return out + bytes([v])

    kinds = {0: 1, 1: 6}
    body = b""
    pieces = sentencepieces.load_pieces()
    for i, (p, s, k) in enumerate(pieces):
        t = 2 if i == 0 else kinds.get(k, 3)
        body += field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s if k == 0 else 0.0) + b"\x18" + bytes([t]))
    trainer = b"\x18\x01" + _varint(35 << 3) + b"\x01"  # unigram, byte fallback
    normalizer = field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01"  # dummy prefix, extra blanks stay, blanks escaped
    path = tmp_path / "unigram.model"
    path.write_bytes(body + field(2, trainer) + field(3, normalizer))
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    score = lambda ids: sum(pieces[i][1] for i in ids if pieces[i][2] == 0)
    for t in ["Hello world, this is plain text", "don't stop  two blanks", "The quick brown fox", "internationalization"]:
        ours, theirs = codec.encode(t), sp.encode(t)
        assert abs(score(ours) - score(theirs)) < 1e-3 and sp.decode(ours) == t


def water(sizes, weights, cap=3):
    """Exact targets by raising one level until everything is shared."""
    left, open_, out = Fraction(sum(sizes)), set(range(len(sizes))), {}
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > cap * sizes[i]}
        if not full:
            return out | {i: level * weights[i] for i in open_}
        for i in full:
            out[i] = Fraction(cap * sizes[i])
            left -= out[i]
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 100], [5, 0, 900, 3], [7], [0, 0], [1000, 1, 1, 1, 1, 1]])
def test_targets_equal_water_filling(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    for i in range(len(sizes)):
        assert abs(got[f"s{i}"] - float(want[i])) < 1e-6


def test_mix(spark, edges, nothing):
    for df, per in ((edges, 2000), (edges, 1), (spark.read.parquet(f"{DATA}/documents.parquet"), 7)):
        m = mixing.mix(df, rows_per_bucket=per)
        rows = m.collect()
        assert len(rows) == df.count() and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(2), rows_per_bucket=per).collect()), key=repr)
        by = {}
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"]
            by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
        for (size, target), taken in by.items():
            if size and sum(k == (size, target) for k in by) == 1:
                assert abs(sum(taken) - target) <= 0.5 or len(by) < 3
    assert mixing.mix(nothing).count() == 0
    out = mixing.mixed_documents(edges)
    assert out.columns == edges.columns


def test_rollup(spark, tmp_path):
    roll = rollups.TokenRollup(spark, f"file://{tmp_path}/roll")
    assert roll.totals().count() == 0
    rows = lambda *r: spark.createDataFrame(r, "source string, lang string, tokenizer string, tokens long")
    load = rows(("a", "en", "v1", 10), ("a", "en", "v1", 5), (None, None, "v1", None))
    assert roll.commit("b1", rollups.deltas(inserts=load))
    assert not roll.commit("b1", rollups.deltas(inserts=load))
    assert roll.commit("b2", rollups.deltas(inserts=rows(("a", "en", "v1", 7)), deletes=rows(("a", "en", "v1", 5))))
    assert roll.commit("b3", rollups.deltas(deletes=rows(("a", "en", "v1", 10))))
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in roll.totals().collect()}
    assert got == {("a", "en"): (1, 7), (None, None): (1, 0)}
    # A try that failed before its marker leaves rows that a later try replaces.
    rollups.deltas(inserts=rows(("z", "z", "v1", 1))).write.parquet(f"{tmp_path}/roll/batches/b4/torn")
    assert roll.totals().where("source = 'z'").count() == 0
    assert roll.commit("b4", rollups.deltas(inserts=rows(("y", "y", "v1", 2)))) and roll.totals().where("source = 'z'").count() == 0
    with pytest.raises(ValueError):
        roll.commit("../x", rollups.deltas(inserts=load))


def test_rollup_of_two_drivers_and_compaction(spark, tmp_path):
    path = f"file://{tmp_path}/roll"
    rows = lambda *r: rollups.deltas(inserts=spark.createDataFrame(r, "source string, lang string, tokenizer string, tokens long"))
    a, b = rollups.TokenRollup(spark, path), rollups.TokenRollup(spark, path)
    b.committed = lambda batch: False  # it looked before the other was done
    assert a.commit("x", rows(("a", "en", "v", 1))) and not b.commit("x", rows(("a", "en", "v", 100)))
    total = lambda: {r["source"]: (r["n_docs"], r["n_tokens"]) for r in a.totals().collect()}
    assert total() == {"a": (1, 1)}
    assert a.compact() and not a.compact() and total() == {"a": (1, 1)}
    assert not a.commit("x", rows(("a", "en", "v", 7))) and a.commit("y", rows(("b", "en", "v", 3))) and total() == {"a": (1, 1), "b": (1, 3)}
    assert a.compact() and total() == {"a": (1, 1), "b": (1, 3)} and len(a._state()[0]) == 1
    (tmp_path / "roll" / "commits" / "z").write_text("")  # a torn marker
    assert total() == {"a": (1, 1), "b": (1, 3)} and a.commit("z", rows(("c", "en", "v", 4))) and total()["c"] == (1, 4)


def test_a_commit_during_a_compaction_counts_once(spark, tmp_path):
    rows = lambda *r: rollups.deltas(inserts=spark.createDataFrame(r, "source string, lang string, tokenizer string, tokens long"))
    a, b = (rollups.TokenRollup(spark, f"file://{tmp_path}/roll") for _ in range(2))
    a.commit("a", rows(("s", "en", "v", 10)))
    real = a._sum
    a._sum = lambda paths: (b.commit("b", rows(("s", "en", "v", 5))), real(paths))[1]
    assert a.compact()
    a._sum = real
    total = lambda: [(r["n_docs"], r["n_tokens"]) for r in a.totals().collect()]
    assert total() == [(2, 15)]
    assert a.compact() and total() == [(2, 15)] and not b.commit("b", rows(("s", "en", "v", 5)))
    # A marker is there whole or not at all: what is still being written is no marker.
    (tmp_path / "roll" / "marks").mkdir(exist_ok=True)
    (tmp_path / "roll" / "marks" / "open").write_text("")
    assert not a.committed("c") and b.commit("c", rows(("s", "en", "v", 1))) and not a._mark("commits/c", "other") and total() == [(3, 16)]


def test_rollup_query_deducts_every_repeat(spark, edges, tmp_path):
    """Repeated rows, null ids and null texts: each text counts once."""
    rows = [(7, "x y", "en", "s"), (7, "x y", "en", "s"), (None, "x y", "de", "t"), (None, None, None, None), (None, "", "en", "s"), (8, "one", "en", "s"), (None, "two words", "en", None), (None, "two words", "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollups.op8_token_rollups(spark, str(tmp_path)).where("tokenizer = 'words-1' AND n_docs <> 0").collect()}
    assert got == {("s", "en"): (2, 3), (None, "en"): (1, 2), (None, None): (1, 0)}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert rollups.op8_token_rollups(spark, f"{tmp_path}/none").count() == 0


def test_rollup_query_equals_plain_counts(spark):
    import tiktoken  # noqa: F401

    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    enc = rollups._encoding(open(rollups.TOKENIZER_FILE, "rb").read(), rollups.PATTERN)
    first = docs.groupby("text")["doc_id"].transform("min")
    docs = docs[docs["doc_id"] == first]
    want = {}
    for _, r in docs.iterrows():
        for name, n in (("words-1", len(r["text"].split())), ("byte-bpe-50k", len(enc.encode_ordinary(r["text"])))):
            a, b = want.get((r["source"], r["lang"], name), (0, 0))
            want[r["source"], r["lang"], name] = a + 1, b + n
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollups.op8_token_rollups(spark, DATA).collect()}
    assert {k: v for k, v in got.items() if v[0]} == want


def test_tool_calls(spark, edges):
    s = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}, "additionalProperties": False}}
    schema = "conv_id long, turn long, role string, kind string, call_id string, name string, arguments string, parents array<string>, content string, wave int, status string"
    rows = [
        (1, 0, "assistant", "call", "a", "add", '{"a": 1}', [], None), (1, 1, "tool", "result", "a", None, None, None, "one"), (1, 2, "tool", "result", "a", None, None, None, "again"),
        (1, 3, "assistant", "call", "b", "add", '{"a": "x"}', ["a"], None), (1, 4, "tool", "result", "zz", None, None, None, "lost"), (1, 5, "user", "message", None, None, None, None, 'héllo "q"\n'),
        (2, 0, "assistant", "call", "c", "add", "{no json", ["d"], None), (2, 1, "assistant", "call", "d", "other", "{}", [], None),
        (3, 0, "assistant", "call", "e", "add", '{"a":1,"b":2}', ["f"], None), (3, 1, "assistant", "call", "f", "add", None, ["e"], None),
        (None, None, None, "call", None, "add", "{}", None, None), (None, None, None, "message", None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], schema)
    got = {(r["conv_id"], r["turn"], r["kind"]): r for r in toolcalls.link_tool_calls(df, s).collect()}
    assert len(got) == len(rows)
    assert (got[1, 0, "call"]["status"], got[1, 0, "call"]["result_turn"], got[1, 0, "call"]["args_valid"]) == ("answered", 1, True)
    assert (got[1, 3, "call"]["status"], got[1, 3, "call"]["args_valid"]) == ("unanswered", False)
    assert got[1, 4, "result"]["status"] == "orphan" and got[1, 2, "result"]["status"] == "linked"
    assert [got[2, t, "call"]["wave"] for t in (0, 1)] == [1, 0] and got[1, 0, "call"]["wave"] == 0
    assert [got[3, t, "call"]["wave"] for t in (0, 1)] == [None, None]
    assert got[1, 0, "call"]["json"] == '{"role":"assistant","tool_call":{"arguments":{"a":1},"id":"a","name":"add"}}'
    assert json.loads(got[1, 5, "message"]["json"])["content"] == 'héllo "q"\n' and got[1, 5, "message"]["json"].startswith('{"content":"héllo')
    assert not got[2, 0, "call"]["args_valid"] and not got[2, 1, "call"]["args_valid"] and not got[3, 0, "call"]["args_valid"]
    assert toolcalls.link_tool_calls(df.where("false"), s).count() == 0


def _calls(spark, rows):
    schema = "conv_id long, turn long, role string, kind string, call_id string, name string, arguments string, parents array<string>, content string"
    return spark.createDataFrame([(c, t, "assistant", "call", i, n, a, p, None) for c, t, i, n, a, p in rows], schema)


def test_hostile_arguments(spark):
    deep, wide = "[" * 200_000 + "]" * 200_000, json.dumps({"a": "[{" * 1000})
    bad = [deep, "[" * 1000, '{"a": "\\ud800"}', '{"a": NaN}', '{"a": 1e999}', '{"a": -Infinity}', "", None, "{", '{"a": 1} 2', "9" * 5000]
    good = [(wide, {"type": "object"}), ('{"a": 1, "a": "x"}', {"properties": {"a": {"type": "string"}}}), ("1.0", {"type": "integer"}), ('"é🎉\\ud83c\\udf89"', {"type": "string", "maxLength": 3})]
    schemas = {"any": {}} | {f"t{k}": s for k, (_, s) in enumerate(good)}
    rows = [(1, i, f"c{i}", "any", a, None) for i, a in enumerate(bad)] + [(2, k, f"g{k}", f"t{k}", a, None) for k, (a, _) in enumerate(good)]
    got = {r["call_id"]: r for r in toolcalls.link_tool_calls(_calls(spark, rows), schemas).collect()}
    for i, a in enumerate(bad):
        r = got[f"c{i}"]
        assert not r["args_valid"] and json.loads(r["json"])["tool_call"]["arguments"] == a, i
        json.loads(r["json"], parse_constant=toolcalls._no_number)
    assert [got[f"g{k}"]["args_valid"] for k in range(len(good))] == [True] * len(good)


def test_schema_words():
    v = toolcalls.valid
    assert v(None, {"type": ["string", "null"]}) and not v(3, {"type": ["string", "null"]})
    assert not v(True, {"enum": [1]}) and v(1.0, {"enum": [1]}) and not v([True], {"const": [1]}) and v({"a": 1.0}, {"const": {"a": 1}})
    assert not v(1.5, {"type": "integer"}) and v(1e20, {"type": "integer"}) and not v(True, {"type": "number"})
    assert not v("abc", {"maxLength": 2}) and v("abc", {"pattern": "b"}) and not v("abc", {"pattern": "^b"})
    assert not v(5, {"maximum": 4}) and not v(5, {"exclusiveMinimum": 5}) and v(5, {"exclusiveMaximum": 6})
    assert v(5, {"anyOf": [{"type": "string"}, {"minimum": 5}]}) and not v(5, {"oneOf": [{}, {"minimum": 5}]}) and not v(5, {"not": {}}) and v(5, {"allOf": [{}, True]})
    assert not v({"x": 1}, {"additionalProperties": {"type": "string"}}) and not v([1, 2], {"maxItems": 1}) and not v([1], {"items": False})
    for schema in ({"type": "text"}, {"type": ["string", "blob"]}, {"format": "date"}, {"pattern": "("}, {"properties": {"a": {"minProperties": 1}}}):
        with pytest.raises(ValueError):
            toolcalls.check_schema(schema)


def test_long_chains_and_large_conversations(spark):
    chain = [(1, 5000 - k, f"c{k}", "any", "{}", [f"c{k - 1}"] if k else None) for k in range(1500)]
    cycle = [(2, 0, "a", "any", "{}", ["b"]), (2, 1, "b", "any", "{}", ["a"]), (2, 2, "c", "any", "{}", ["b"]), (2, 3, "d", "any", "{}", ["nobody"])]
    df = _calls(spark, chain + cycle)
    got = {(r["conv_id"], r["call_id"]): r["wave"] for r in toolcalls.link_tool_calls(df, {}).collect()}
    assert [got[1, f"c{k}"] for k in range(1500)] == list(range(1500))
    assert [got[2, c] for c in "abcd"] == [None, None, None, 0]
    nodes = df.where("conv_id = 2 OR turn > 4990").select("conv_id", "call_id")
    edges = df.where("conv_id = 2 OR turn > 4990").select("conv_id", "call_id", F.explode("parents").alias("parent")).where("parent <> 'nobody'")
    both = [sorted(map(tuple, toolcalls._waves(nodes, edges, most).collect())) for most in (100_000, 5)]
    assert both[0] == both[1] and len(both[0]) == 11


def test_mix_of_null_and_repeated_ids(spark):
    """A bulk of null ids spreads over the buckets; equal rows are one row with a count."""
    many = spark.range(30_000).selectExpr("CASE WHEN id % 3 > 0 THEN 7L END AS doc_id", "CASE WHEN id % 3 = 2 THEN 'the same words' ELSE concat('w ', id) END AS text", "'a' AS source", "id % 2 AS extra")
    d = mixing._cuts(many, "text", "source", "doc_id", (5, 2, 1), 3, 100)
    assert d.where("n > 1").count() == 1 and d.groupBy(F.substring("key", 1, 2)).count().agg(F.max("count")).first()[0] < 200
    m = mixing.mix(many, rows_per_bucket=100)
    assert m.count() == 30_000 and m.agg(F.sum("taken")).first()[0] == m.agg(F.sum("size")).first()[0]
    assert sorted(map(tuple, m.groupBy("size", "taken").count().collect())) == sorted(map(tuple, mixing.mix(many.repartition(5), rows_per_bucket=7).groupBy("size", "taken").count().collect()))
    out = mixing.mixed_documents(many, cap=3)
    assert out.count() == 30_000 and out.groupBy("extra").count().count() == 2
    two = many.withColumn("source", F.when(F.col("text") == "the same words", "b"))
    copies = {r["source"]: r["n"] for r in mixing.mixed_documents(two).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    want = {r["source_size"]: r["target"] for r in mixing.mix(two).select("source_size", "target").distinct().collect()}
    assert abs(copies["b"] - want[30_000]) <= 3 and abs(copies[None] - want[40_000]) <= 2


def test_pipeline_stages(spark, edges):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "token_ids"]
    for n, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, edges, DATA).columns == edges.columns, n
        assert f(spark, edges.where("false"), DATA).count() == 0


def test_pipeline_equals_plain_stages(spark):
    """Each stage's rows from those of the one before, by plain means."""
    from drawlake.llm import pii
    from drawlake.llm.common import materialize

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    first = materialize(corpus_pipeline.quality_rules(spark, docs, DATA), "q")
    rules = quality.learn(quality.sample(docs, labels))
    judged = quality.with_counts(docs).select("row.doc_id", quality.verdict(rules).alias("k")).collect()
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in judged if r["k"]}
    second = materialize(corpus_pipeline.near_duplicates(spark, first, DATA), "n")
    from test_dedup import brute

    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert {r["doc_id"] for r in second.collect()} == {d for d, n, c in brute(rows, 5) if c == d}
    third = materialize(corpus_pipeline.personal_data(spark, second, DATA), "p")
    texts = {r["doc_id"]: r["text"] for r in second.collect()}
    assert {r["doc_id"]: r["text"] for r in third.collect()} == {d: pii.redacted(t) for d, t in texts.items()}
    fourth = materialize(corpus_pipeline.source_mix(spark, third, DATA), "m")
    copies = Counter(r["doc_id"] for r in fourth.collect())
    want = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(third).collect() if r["size"]}
    assert copies == {d: n for d, n in want.items() if n}
    codec = sentencepieces.PieceCodec(sentencepieces.load_pieces())
    last = corpus_pipeline.run(spark, DATA).collect()
    assert Counter(r["doc_id"] for r in last) == copies
    clean = {r["doc_id"]: r["text"] for r in third.collect()}
    assert all(codec.decode(r["ids"]) == clean[r["doc_id"]] and r["decoded_ok"] for r in last)


def test_tool_waves_of_a_stream_of_conversations():
    """Conversations that cross batches, ids beyond a double's digits, chains, joins and cycles."""
    import pyarrow as pa

    big = 2**60
    rows = [(1, big + 1, None), (1, big + 2, big + 1), (1, big + 3, big + 2), (1, big + 3, big + 1), (2, 5, None), (2, 6, 7), (2, 7, 6), (2, 8, 7), (3, 9, None), (3, 9, None)]
    schema = pa.schema([("conv_id", pa.int64()), ("call_id", pa.int64()), ("parent", pa.int64())])
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in range(3)], schema=schema)
    want = [(1, big + 1, 0), (1, big + 2, 1), (1, big + 3, 2), (2, 5, 0), (3, 9, 0)]
    for size in (1, 3, 4, 100):
        found = [tuple(r.values()) for b in toolcalls._ordered_stream(batch(rows[i : i + size]) for i in range(0, len(rows), size)) for r in b.to_pylist()]
        assert sorted(found) == want
    assert list(toolcalls._ordered_stream(iter([]))) == []
