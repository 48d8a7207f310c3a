"""Embedding near-duplicates: an HNSW graph per shard, every shard queried, audited beams, verified cosine, union.

Equal vectors of a label are one node with a count. A label's nodes are dealt to shards by hash; each shard's vectors
and graph become one row of the index table. Every shard's vectors are then the queries of its own shard and all before
it, and a link counts at both ends: one row for each pair of shards, so that a task holds two shards at a time. A sample
of queries and slightly turned copies of the shard's own vectors, which have a link for certain, are also searched by brute
force, and beams widen until they find what it finds, up to a product with the whole shard. Links are verified in double
precision; a pair of shards gives each vector's number of links and a spanning set of the links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import materialize, table
from drawlake.llm.graph import components
from drawlake.llm.hnsw import Hnsw

COSINE = 0.98
#: Vectors of a shard, about, and bytes of them: what a task holds twice.
SHARD, SHARD_BYTES = 20_000, 64_000_000
#: First beam, audited queries with links of a pair of shards (as many planted ones come on top), and the recall that either must reach.
BEAM, AUDITED, RECALL = 32, 96, 0.995


def _units(v: np.ndarray) -> np.ndarray:
    """Unit vectors; the greatest component goes first, so that squares neither vanish nor overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _indexed(shard: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a shard -> one row of the index table."""
    shard = shard.sort_values("node")  # ids are hashes: an order at random that every run repeats
    v = np.stack(shard["embedding"].to_list()).astype(np.float64)
    graph = Hnsw.build(_units(v).astype(np.float32))
    first = shard.iloc[0]
    row = (first["label"], first["dim"], first["shard"], first["shards"], b"".join(shard["node"]), shard["copies"].to_numpy(np.int64).tobytes(), v.tobytes(), graph.dump())
    return pd.DataFrame([row], columns=["label", "dim", "shard", "shards", "nodes", "copies", "vectors", "graph"])


def _audit(unit: np.ndarray, q: np.ndarray, least: float, skip_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """``queries, true links of each`` by brute force: batches of queries until AUDITED of them have a link, an eighth of all at most."""
    order = np.random.default_rng(0).permutation(len(q))
    most, done, asked, truth = max(AUDITED, len(q) // 8), 0, [], []
    while done < min(most, len(q)) and sum(map(np.count_nonzero, truth)) < AUDITED:
        part = order[done : done + 2 * AUDITED]
        hit = q[part] @ unit.T >= least
        if skip_self:
            hit[np.arange(len(part)), part] = False
        asked.append(part)
        truth.append(hit.sum(1))
        done += len(part)
    return np.concatenate(asked), np.concatenate(truth)


def _planted(unit: np.ndarray, least: float) -> np.ndarray:
    """Copies of AUDITED of the vectors, each turned by an angle whose cosine lies between ``least`` and 1: queries that have a link."""
    rng = np.random.default_rng(1)
    of = unit[rng.choice(len(unit), min(AUDITED, len(unit)), replace=False)]
    side = rng.standard_normal(of.shape)
    side -= np.einsum("ij,ij->i", side, of)[:, None] * of
    length = np.linalg.norm(side, axis=1, keepdims=True)
    side = np.where(length > 1e-9, side / np.maximum(length, 1e-9), 0.0)  # in one dimension there is no side to turn to
    c = least + (1 - least) * rng.uniform(0.01, 0.99, (len(of), 1))
    return c * of + np.sqrt(1 - c * c) * side


def audited_links(index: Hnsw, unit: np.ndarray, q: np.ndarray, least: float, skip_self: bool) -> tuple[np.ndarray, np.ndarray, float | None]:
    """Verified links (query, node) between double-precision unit vectors, and the recall that the last audit saw (null only without queries).

    Beams double until the audited queries find, on average over those that have links at all, RECALL of their links (a
    large group of copies weighs no more than a small one), and the planted queries as much of theirs. So the recall is
    measured where no vector has a link, too. The widest beams are a product with the whole shard, which finds all.
    """
    if not len(q):
        return np.zeros(0, int), np.zeros(0, int), None

    def searched(queries, width):
        a, b = index.within(queries.astype(np.float32), least, width)
        sure = np.einsum("ij,ij->i", queries[a], unit[b]) >= least if len(a) else np.zeros(0, bool)
        return a[sure], b[sure]

    asked, truth = _audit(unit, q, least, skip_self)
    some = truth > 0
    planted = _planted(unit, least)
    theirs = np.count_nonzero(planted @ unit.T >= least, axis=1)
    width = BEAM
    while True:
        # The planted queries are few: they are asked first, and all others once these are content with the beam.
        a, _ = searched(planted, width)
        recall = float((np.bincount(a, minlength=len(planted))[theirs > 0] / theirs[theirs > 0]).mean()) if (theirs > 0).any() else 1.0
        if recall >= RECALL or width >= len(unit):
            a, b = searched(q, width)
            if skip_self:
                a, b = a[a != b], b[a != b]
            if some.any():
                found = np.bincount(a, minlength=len(q))[asked[some]]
                recall = min(recall, float((found / truth[some]).mean()))
            if recall >= RECALL or width >= len(unit):
                return a, b, recall
        width *= 2


def _spanning(pairs: list[tuple[int, int]], n: int) -> np.ndarray:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def _searched(least: float):
    def f(batches):
        for batch in batches:
            for p in batch.itertuples(index=False):
                yield _pair(p, least)

    return f


def _pair(p, least: float) -> pd.DataFrame:
    """One shard's vectors as queries of another, once for both: ``node, links, root, recall`` of each node that has a link here."""
    same = p.shard == p.q_shard
    unit = _units(np.frombuffer(p.vectors).reshape(-1, p.dim))
    q = unit if same else _units(np.frombuffer(p.q_vectors).reshape(-1, p.dim))
    a, b, recall = audited_links(Hnsw.load(p.graph, unit.astype(np.float32)), unit, q, least, same)
    copies, names = np.frombuffer(p.copies, np.int64), np.frombuffer(p.nodes, "V16")
    links = np.bincount(a, copies[b], minlength=len(q))
    if not same:  # queries come first, the shard's own after them, and each end of a link counts it
        links = np.concatenate([links, np.bincount(b, np.frombuffer(p.q_copies, np.int64)[a], minlength=len(unit))])
        names = np.concatenate([np.frombuffer(p.q_nodes, "V16"), names])
        b = b + len(q)
    root = _spanning(list(zip(a.tolist(), b.tolist(), strict=True)), len(names))
    met = np.unique(np.concatenate([a, b]))
    return pd.DataFrame({"node": [x.tobytes() for x in names[met]], "links": links[met].astype(np.int64), "root": [x.tobytes() for x in names[root[met]]], "recall": recall})


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """``vec_id, n_links, component_id`` for each row of ``vectors``.

    Rows link when their labels are equal and not null, their vectors are as long and their cosine is ``cosine`` or
    more. Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, have 0 links and
    keep their own id. Rows with a null id link like others and never name a component unless all its ids are null.
    Repeated rows are vectors of their own. Other columns are ignored.
    """
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), "label", "embedding")), 16, "0")
    v = v.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), F.unhex(F.concat(half(1), half(2)))))
    good = v.where("node IS NOT NULL").withColumn("dim", F.size("embedding"))
    nodes = good.groupBy("label", "dim", "node").agg(F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    per = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(1), F.least(F.lit(shard), F.floor(F.lit(SHARD_BYTES) / (F.col("dim") * 8))))
    per = per.select("label", "dim", F.ceil(F.col("n") / most).cast("int").alias("shards"))
    dealt = nodes.join(per, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    index = dealt.groupBy("label", "dim", "shard").applyInPandas(_indexed, "label string, dim int, shard int, shards int, nodes binary, copies binary, vectors binary, graph binary")
    index = materialize(index, "hnsw")

    queries = index.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("shard"), F.col("shard").alias("q_shard"), F.col("nodes").alias("q_nodes"), F.col("copies").alias("q_copies"), F.col("vectors").alias("q_vectors"))
    pairs = index.join(queries, ["label", "dim", "shard"]).select("dim", "shard", "nodes", "copies", "vectors", "graph", "q_shard", "q_nodes", "q_copies", "q_vectors")
    found = materialize(pairs.mapInPandas(_searched(cosine), "node binary, links long, root binary, recall double"), "vector-links")

    grouped = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = good.groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    named = known.join(counted, "node", "left").join(grouped, "node", "left")
    named = materialize(named.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"), "least"), "vector-nodes")
    # Written, so that the join shuffles both sides for itself and a large component's rows can be split.
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "vector-names")
    named = named.join(least, "root").select("node", "n_links", "component_id")
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return v.select("vec_id", "node").join(named, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l USING (a)),
c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
