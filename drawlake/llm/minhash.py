"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, union.

SuperMinHash gives every element a random permutation of the signature's places and lets the place at rank j take the
minimum of j + r, r uniform. Ranks are worked through level by level for all elements of a batch of texts, and a text
stops as soon as all its places hold less than the next rank. Texts with the same set are one node. Bands group
nodes; members of a group are tied to its smallest member, and the ties' components hold every pair that shares a
band. Within a component the exact similarities are counted over an inverted list of its shingles, in blocks of bounded
size, and only a spanning set of the links found goes out. The links' components are the groups.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from drawlake.llm.common import WORD, documents, materialize, row_hash, whole, whole_text_batches
from drawlake.llm.graph import components

#: Words of a shingle and percent of similarity, where no contract says otherwise.
WORDS, PERCENT = 5, 80
#: Bands and their rows: texts at a similarity of 0.8 share no band with a chance of (1 - 0.8^6)^42 < 1e-5.
BANDS, ROWS = 42, 6
#: Bytes of text worked on at once in a task, and shingles of a block of texts that is verified at once.
SLAB, BLOCK = 2_000_000, 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word. A hash is a polynomial in the word's bytes: running sums at its end less those at its start, shifted to 0."""
    inside = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up, dtype=np.uint64)))
    return _mix((total[end] - total[start]) * down[start]), start


def _pieces(raw: bytes):
    """A long text in pieces of a slab at most, cut at blanks; a word that is longer stays whole."""
    at = 0
    while len(raw) - at > SLAB:
        cut = max(raw.rfind(c, at, at + SLAB) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            found = [i for i in (raw.find(c, at + SLAB) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0]
            cut = min(found, default=len(raw))
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def _set(word: np.ndarray, k: int) -> np.ndarray:
    n = len(word)
    if n >= k:
        shingle = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            shingle = _mix(shingle * np.uint64(0xD6E8FEB86659FD93) + word[j : n - k + 1 + j])
        return np.unique(shingle)
    h = np.zeros(min(n, 1), np.uint64)
    for w in word:
        h = _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + w)
    return h


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The set of each whole text: sorted distinct 64-bit hashes of its ``k``-word shingles, A-Z lowered.

    With fewer words, the whole sequence is the only one; without words or text the set is empty. Texts longer than a
    slab are hashed piece by piece.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    short = [r if len(r) <= SLAB else b"" for r in raw]
    data = _LOWER[np.frombuffer(b" ".join([*short, b""]), dtype=np.uint8)]
    word, start = _words(data)
    bound = np.concatenate(([0], np.searchsorted(start, np.cumsum([len(r) + 1 for r in short]))))
    out = []
    for r, a, b in zip(raw, bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        own = word[a:b]
        if len(r) > SLAB:
            own = np.concatenate([_words(_LOWER[np.frombuffer(p, dtype=np.uint8)])[0] for p in _pieces(r)])
        out.append(_set(own, k))
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of ``m`` places, one row for each set; the row of an empty set is all ones.

    A place holds rank * 2^32 + fraction as an integer. Level j handles rank j of every element at once: the element's
    j-th swap of a Fisher-Yates shuffle is followed back through its earlier swaps to the place it brings forward.
    """
    sizes = np.array([len(s) for s in sets])
    sig = np.full((len(sets), m), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = sig.reshape(-1)
    doc = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(element):
            break
        drawn = _mix(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        fraction, choice = drawn & np.uint64(0xFFFFFFFF), (drawn >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)
        place = choice.astype(np.int32) + j
        swaps.append(place)
        at = place.copy()
        for i in range(j - 1, -1, -1):
            at[at == swaps[i]] = i
        np.minimum.at(flat, doc * m + at, fraction + np.uint64(j << 32))
        top = sig.max(axis=1)
        live = top >= np.uint64((j + 1) << 32)
        stay = live[doc]
        if not stay.all():
            element, doc = element[stay], doc[stay]
            swaps = [s[stay] for s in swaps]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; different bands never mean the same key."""
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) * np.ones((len(sig), 1), np.uint64)
    for r in range(rows):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, r : bands * rows : rows])
    return key.view(np.int64)


def _slabs(texts: list[str | None]):
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += 1 + len(t or "")
        if held >= SLAB:
            yield texts[at : i + 1]
            at, held = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def _signed(k: int, bands: int, rows: int):
    def f(text: pd.Series) -> pd.DataFrame:
        node, n, keys = [], [], []
        for slab in _slabs(text.tolist()):
            sets = shingle_sets(slab, k)
            band = band_keys(superminhash(sets, bands * rows), bands, rows)
            for i, s in enumerate(sets):
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                n.append(len(s))
                keys.append(band[i] if len(s) else None)
        return pd.DataFrame({"node": node, "n": n, "bands": keys})

    return f


def _verified(k: int, percent: int):
    """Texts of a block (node, comp, side, text) -> ``a, b``: a spanning set of the block's links."""

    def f(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates(["comp", "node", "side"])
        out: list[tuple[bytes, bytes]] = []
        for _, own in block.groupby("comp", sort=False):
            nodes, sides = own["node"].tolist(), own["side"].to_numpy()
            if len(nodes) < 2:
                continue
            texts = own["text"].tolist()
            sets = [s for slab in _slabs(texts) for s in shingle_sets(slab, k)]
            out += [(nodes[a], nodes[b]) for a, b in linked(sets, sides, percent)]
        return pd.DataFrame(out, columns=["a", "b"])

    return f


def linked(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that join everything the links between sides join (side 0: with all, else 1 with 2); links are counted exactly."""
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    every, owner_by = every[order], owner[order]
    first = np.concatenate(([True], every[1:] != every[:-1]))
    begin = np.flatnonzero(first)
    length = np.diff(np.concatenate((begin, [len(every)])))
    which = np.empty(len(every), dtype=np.int64)
    which[order] = np.cumsum(first) - 1
    start = np.concatenate(([0], np.cumsum(size)))
    root = np.arange(len(sets))
    out = []
    # The text with the most company goes first. What is joined to it need not be asked: a link to something that is not
    # is found when that is asked.
    company = np.bincount(owner, weights=length[which], minlength=len(sets))
    asked = np.argsort(-company, kind="stable").tolist()
    for a in asked:
        if a != asked[0] and root[a] == root[asked[0]]:
            continue
        lists = which[start[a] : start[a + 1]]
        n = length[lists]
        if n.sum() == len(lists):
            continue  # it shares nothing
        at = np.repeat(begin[lists] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        shared = np.bincount(owner_by[at], minlength=len(sets))
        hit = 100 * shared >= percent * (size + size[a] - shared)
        hit &= (sides != sides[a]) | (sides == 0)
        others = np.flatnonzero(hit)
        for b in others[np.unique(root[others], return_index=True)[1]].tolist():
            if root[b] != root[a]:
                out.append((a, b))
                low, high = sorted((int(root[a]), int(root[b])))
                root[root == high] = low
    return out


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, group`` for each document; text_key is the MD5 of its text.

    group names the component by a hash, null where there are no shingles.

    Documents with the same set, or linked directly or through others, share the smallest doc_id among them. Null and
    empty texts have no shingles, link with nothing and keep their own id. Rows with a null id link like others and
    never name a component unless all of its ids are null. Repeated rows stay. Other columns are ignored.
    """
    spark = docs.sparkSession
    whole_text_batches(spark)
    d = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text)).alias("text")).withColumn("text_key", F.unhex(F.md5("text")))
    made = pandas_udf(_signed(words, bands, rows), "struct<node:binary,n:long,bands:array<long>>")
    sig = materialize(d.select("doc_id", "text_key", made("text").alias("s")).select("doc_id", "text_key", "s.*"), "signatures")

    # One row for each set, with the row whose text stands for it.
    nodes = sig.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("least"), F.max("n").alias("n"))
    keyed = sig.where("node IS NOT NULL").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    groups = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least")
    groups = materialize(groups, "bands")  # so that the join can split a band that very many share
    ties = keyed.join(groups, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    tied = components(ties)

    # Components in blocks: small ones share a bin, large ones are cut into parts of which every two meet.
    weight = tied.join(nodes, "node").select("node", F.col("root").alias("comp"), "rep", "n")
    weight = materialize(weight, "tied")
    total = materialize(weight.groupBy("comp").agg(F.sum("n").alias("mass")), "mass")
    parts = F.ceil(F.col("mass") / (BLOCK // 2)).cast("int")
    bins = max(1, int((weight.agg(F.sum("n")).first()[0] or 0) / BLOCK * 2))
    w = weight.join(total, "comp").withColumn("parts", F.when(F.col("mass") <= BLOCK, F.lit(1)).otherwise(parts))
    w = w.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    meets = F.when(
        F.col("parts") == 1,
        F.array(F.struct(F.concat_ws(":", F.lit("bin"), F.pmod(F.xxhash64("comp"), F.lit(bins))).alias("block"), F.lit(0).alias("side"))),
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda o: F.struct(
                F.concat_ws(":", F.hex("comp"), F.least(F.col("part"), o), F.greatest(F.col("part"), o)).alias("block"),
                F.when(o == F.col("part"), F.lit(0)).when(F.col("part") < o, F.lit(1)).otherwise(F.lit(2)).alias("side"),
            ),
        )
    )
    w = w.select("node", "comp", _name(F.col("rep.doc_id"), F.col("rep.text_key")).alias("name"), meets.alias("meets"))
    # A row that repeats is one before its text moves: the first step of this aggregate runs where the rows are read.
    once = d.select(_name(F.col("doc_id"), F.col("text_key")).alias("name"), "text").dropDuplicates(["name"])
    texts = once.join(w, "name").select("node", "comp", "text", F.explode("meets").alias("m")).select("node", "comp", "text", "m.*")
    links = texts.groupBy("block").applyInPandas(_verified(words, percent), "a binary, b binary")
    grouped = components(links)

    name = nodes.join(grouped, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    name = materialize(name, "nodes")
    least = materialize(name.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = name.join(least, "root").select("node", F.col("root").alias("group"), "component_id")
    out = sig.join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), own.alias("component_id"), "group")


def _name(doc_id: Column, text_key: Column) -> Column:
    """A hash that names a row by id and text; null ids are ids."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.hex(text_key))))


def kept() -> Column:
    """One of each component stays: the smallest doc_id."""
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def without_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **params) -> DataFrame:
    """The documents, their columns as they are, with one of each group: that of the smallest doc_id, null ids last, then of the smallest text hash; of rows of equal id and text that of the smallest hash of all columns.

    Texts without words are in no group and all stay.
    """
    found = near_duplicates(docs, text, doc_id, **params)
    best = found.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key")).alias("w"))
    best = best.select(_name(F.col("w.doc_id"), F.col("w.text_key")).alias("name"))
    t = whole(F.col(text))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), t.rlike(WORD).alias("worded"), _name(F.col(doc_id), F.unhex(F.md5(t))).alias("name"), row_hash(docs).alias("tie"))
    one = d.where("worded").groupBy("name").agg(F.min_by("row", "tie").alias("row")).join(best, "name", "left_semi")
    return one.select("row").unionByName(d.where("NOT worded").select("row")).select("row.*")


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", kept().alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN generate_series(1, len(w) - 3)]) END AS s FROM d),
p AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n FROM p a JOIN p b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * n >= 80 * (na + nb - n)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l USING (a)),
c AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
