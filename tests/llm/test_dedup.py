"""Near-duplicate documents and vectors against brute force."""

from __future__ import annotations

import random

import numpy as np

from drawlake.llm import embeddings, minhash
from drawlake.llm.graph import components
from drawlake.llm.hnsw import Hnsw


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    """Smallest id reachable, by comparing every two rows; null ids never name a component."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), d if not sets[i] else min(ids, default=None)))
    return sorted(out, key=repr)


def result(df, **kw):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, **kw).collect()), key=repr)


def test_edge_cases(edges, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert result(edges) == brute(rows, 5)
    assert result(nothing) == []
    kept = minhash.without_near_duplicates(edges)
    assert kept.columns == edges.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len([t for _, t in left if t and t.lower().startswith("a b c")]) == 1
    assert sum(t is None or not t.strip() for _, t in left) == 4


def test_edited_copies_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(rng.choice([1, 2, 9])):
            rows.append((len(rows), " ".join(w if rng.random() > 0.02 else "edit" for w in base)))
    hub = [f"h{k}" for k in range(200)]
    for _ in range(60):  # a large group about one text, many pairs of which are just under the threshold
        t = hub[:]
        for k in rng.sample(range(200), rng.randint(0, 9)):
            t[k] = "q"
        rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, words=4) == brute(rows, 4)


def test_blocks_of_a_large_component(spark, monkeypatch):
    rng = random.Random(2)
    hub = [f"h{k}" for k in range(60)]
    rows = [(i, " ".join("q" if rng.random() < 0.03 else w for w in hub)) for i in range(80)]
    monkeypatch.setattr(minhash, "BLOCK", 700)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, words=4) == brute(rows, 4)


def test_superminhash_by_hand():
    """Level by level equals one shuffle an element; the share of equal places estimates the similarity."""
    m = 32
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 40, 300)] + [np.zeros(0, np.uint64)]
    got = minhash.superminhash(sets, m)
    for s, sig in zip(sets, got, strict=True):
        want = np.full(m, np.iinfo(np.uint64).max, np.uint64)
        for e in s:
            p = list(range(m))
            for j in range(m):
                x = int(minhash._mix(np.array([(int(e) + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
                k = j + ((x >> 32) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], np.uint64((j << 32) + (x & 0xFFFFFFFF)))
        assert (sig == want).all()
    a, b = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    one, two = minhash.superminhash([np.unique(a), np.unique(np.concatenate([a[100:], b]))], 512)
    assert abs((one == two).mean() - 800 / 1000) < 0.07


def test_shingle_sets_match_words():
    for k in (1, 3, 5):
        texts = ["A b\tC d e f", "", None, "a b", "x\n\ny\x0bz q", "é É é É é É", "a  b c d e f"]
        sets = minhash.shingle_sets(texts, k)
        assert [len(s) for s in sets] == [len(shingles(t, k)) for t in texts]
        assert (sets[0] == sets[6]).all()


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab \n\t") for _ in range(n)) for n in (0, 5, 300, 2000)] + ["x" * 500 + " y z " + "w" * 90]
    want = minhash.shingle_sets(texts, 3)
    monkeypatch.setattr(minhash, "SLAB", 64)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(want, minhash.shingle_sets(texts, 3), strict=True))


def test_components(spark):
    rng = random.Random(5)
    ids = [f"{rng.random():.12f}" for _ in range(300)]
    edges = [(ids[i], ids[i + 1]) for i in range(99)] + [(ids[100], ids[i]) for i in range(101, 200)] + [(ids[5], ids[5]), (None, ids[3])]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len({got[i] for i in ids[:100]}) == 1 and len({got[i] for i in ids[100:200]}) == 1 and got[ids[0]] != got[ids[100]]
    assert len(got) == 200
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def vectors(n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    near = base[: n // 4] + rng.normal(size=(n // 4, d)) * 0.03
    hub = base[0] + rng.normal(size=(60, d)) * 0.02
    return np.concatenate([base, near, hub, base[:5]]).astype(np.float32)


def brute_vectors(rows):
    good = [(i, r) for i, r in enumerate(rows) if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {i: set() for i in range(len(rows))}
    for i, a in good:
        for j, b in good:
            if i < j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        usable = any(i == k for k, _ in good)
        out.append((r[0], len(links[i]), min(ids, default=None) if usable else r[0]))
    return sorted(out, key=repr)


def test_vectors_equal_brute_force(spark):
    v = vectors()
    rows = [(i, v[i].tolist(), i % 3 if i < 400 else (i - 400) % 3) for i in range(len(v))]
    rows += [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [], 1), (9004, v[0].tolist(), None), (None, v[1].tolist(), 1), (9005, [1.0, None] + [0.0] * 14, 1), (9006, v[1].tolist()[:8], 1), (3, v[3].tolist(), 0), (9007, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "'x' AS root").repartition(4)
    want = brute_vectors([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b], c) for a, b, c in rows])
    for shard in (20_000, 60):
        got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df, shard=shard).collect()), key=repr)
        assert got == want
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_hnsw_recall():
    v = vectors(3000, 32, 4).astype(np.float64)
    u = embeddings._units(v[np.random.default_rng(1).permutation(len(v))])
    index = Hnsw.load(Hnsw.build(u.astype(np.float32)).dump(), u.astype(np.float32))
    a, _, recall = embeddings.audited_links(index, u, u, 0.98, True)
    assert recall >= embeddings.RECALL
    truth = (u @ u.T >= 0.98).sum() - len(u)
    assert len(a) >= 0.99 * truth > 1000


def test_audit_weighs_queries_not_links():
    """A group of copies holds nearly all links; the audit still sees what small groups lose, and measures where no vector has a link."""
    rng = np.random.default_rng(3)
    hub = rng.normal(size=16)
    big = hub + rng.normal(size=(900, 16)) * 0.01
    pairs = rng.normal(size=(150, 16))
    v = np.concatenate([big, pairs, pairs + rng.normal(size=(150, 16)) * 0.01])
    u = embeddings._units(v[rng.permutation(len(v))])

    class Forgets(Hnsw):
        def within(self, q, least, width):
            a, b = super().within(q, least, width)
            n = np.bincount(a, minlength=len(q))
            keep = (n[a] > 100) | (width > 100)
            return a[keep], b[keep]

    index = Forgets.load(Hnsw.build(u.astype(np.float32)).dump(), u.astype(np.float32))
    a, b, recall = embeddings.audited_links(index, u, u, 0.98, True)
    assert recall >= embeddings.RECALL and len(a) >= 0.99 * ((u @ u.T >= 0.98).sum() - len(u))
    far = embeddings._units(rng.normal(size=(300, 16)) + 50)
    alone = Hnsw.load(Hnsw.build((-far).astype(np.float32)).dump(), (-far).astype(np.float32))
    a, _, recall = embeddings.audited_links(alone, -far, far, 0.98, False)
    assert len(a) == 0 and recall >= embeddings.RECALL
    # An index that finds nothing with a narrow beam: the planted queries widen it, and the two true links, which no audit drew, are found.
    near = np.concatenate([rng.normal(size=(6000, 16)), far[:1], far[:1] + 1e-4])
    u = embeddings._units(near)

    class Narrow(Hnsw):
        def within(self, q, least, width):
            a, b = super().within(q, least, width)
            return (a, b) if width > 100 else (a[:0], b[:0])

    blind = Narrow.load(Hnsw.build(u.astype(np.float32)).dump(), u.astype(np.float32))
    a, b, recall = embeddings.audited_links(blind, u, u, 0.98, True)
    assert {(6000, 6001), (6001, 6000)} <= set(zip(a.tolist(), b.tolist(), strict=True)) and recall >= embeddings.RECALL
    assert embeddings.audited_links(blind, u, u[:0], 0.98, False)[2] is None


def test_planted_queries_have_a_link():
    for dim in (1, 2, 64):
        u = embeddings._units(np.random.default_rng(dim).normal(size=(500, dim)))
        planted = embeddings._planted(u, 0.98)
        assert planted.shape == (embeddings.AUDITED, dim) and ((planted @ u.T).max(1) >= 0.98).all()


def test_vectors_of_any_length(spark):
    small, large, tiny = [1e-200, 2e-200], [1e200, 2e200], [5e-324, 1e-323]
    df = spark.createDataFrame([(0, small, 1), (1, large, 1), (2, [1.0, 2.0], 1), (3, [2.0, -1.0], 1), (4, tiny, 1)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (0, 3), 4: (3, 0)}


def test_rows_that_repeat_in_number(spark):
    """Repeats of the row that stands for a set, and null ids with one text, do not gather in a group."""
    text = " ".join(f"w{k}" for k in range(30))
    near = text.replace("w29", "q")
    df = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 5L END AS doc_id", f"'{text}' AS text").unionByName(spark.createDataFrame([(9, near)], "doc_id long, text string"))
    got = minhash.near_duplicates(df).groupBy("doc_id", "component_id", "n_shingles").count().collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(5, 5, 26, 10_000), (None, 5, 26, 10_000), (9, 5, 26, 1)], key=repr)
    real = minhash._verified

    def counted(k, percent):
        f = real(k, percent)
        return lambda block: f(block.assign(_n=len(block)).drop(columns="_n")) if len(block) <= 2 else (_ for _ in ()).throw(AssertionError(len(block)))

    minhash._verified = counted
    try:
        assert minhash.near_duplicates(df).count() == 20_001
    finally:
        minhash._verified = real
    assert minhash.without_near_duplicates(df).count() == 1


def test_rows_of_equal_id_and_text_leave_the_same_one(spark):
    """Whatever the order of the rows; maps among the columns do no harm."""
    from drawlake.llm import mixing

    rows = [(i % 3, "one two three four five six seven eight", src, {"k": src, "a": "b"}) for i, src in enumerate(["web", "books", "code", "news"] * 6)]
    schema = "doc_id long, text string, source string, extra map<string, string>"
    left = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        d = spark.createDataFrame(rows, schema).repartition(1 + 2 * seed)
        left.add(tuple(sorted((r["doc_id"], r["source"]) for r in minhash.without_near_duplicates(d).collect())))
        assert mixing.mixed_documents(d).columns == d.columns and mixing.mixed_documents(d).count() > 0
    assert len(left) == 1 and len(next(iter(left))) == 1
