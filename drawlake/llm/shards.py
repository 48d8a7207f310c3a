"""Sharding: best-fit-decreasing bin packing of groups that stay whole, the tightest bin from a balanced tree.

A group is all rows of equal text. Groups of one size are interchangeable, so that packing needs how many there are of
each size, no more: sizes times counts add up to the bytes of the corpus, hence there are fewer than twice the square root of
those bytes (for 100 TB under 20 million pairs of numbers, in practice as many as there are lengths of texts). One task packs these runs, largest first: a run fills the
tightest bin that it fits as often as it fits, then the next, which is what best fit does one by one. Runs come back as
ranks from-to within a size, groups get their rank by distributed prefix sums, and rows theirs from their group.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlake.llm.common import documents, materialize, whole
from drawlake.llm.spelling import CRC, CRC_TABLE

#: A group over this many times a shard's fair share cannot stay whole without breaking the law of equal bytes.
WHOLE = 1.1
#: Rows of a bucket at most, about: the unit of the second prefix sum.
ROWS_PER_BUCKET = 2000


class Tree:
    """Entries in order, as a tree of two levels whose leaves split when they are full: least entry not under a bound in log n."""

    LEAF = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []

    def add(self, entry: tuple[int, int]) -> None:
        if not self.leaves:
            self.leaves, self.tops = [[entry]], [entry]
            return
        k = min(bisect_left(self.tops, entry), len(self.tops) - 1)
        leaf = self.leaves[k]
        insort(leaf, entry)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
            self.tops[k : k + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.tops[k] = leaf[-1]

    def take(self, bound: tuple[int, int]) -> tuple[int, int] | None:
        """Remove and return the least entry that is not under ``bound``."""
        k = bisect_left(self.tops, bound)
        if k == len(self.tops):
            return None
        leaf = self.leaves[k]
        entry = leaf.pop(bisect_left(leaf, bound))
        if leaf:
            self.tops[k] = leaf[-1]
        else:
            del self.leaves[k], self.tops[k]
        return entry


def best_fit(runs: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """``(size, count)``, largest first -> ``(size, bin, count)`` in the order of packing; None if more than ``bins`` are needed.

    Among equally tight bins the first wins. A size over the capacity gets a bin of its own.
    """
    tree, opened, out = Tree(), 0, []
    for size, count in runs:
        while count:
            entry = tree.take((size, -1))
            if entry is None:
                if opened == bins:
                    return None
                entry, opened = (max(capacity, size), opened), opened + 1
            left, at = entry
            n = min(count, left // size)
            out.append((size, at, n))
            count -= n
            if left > n * size:
                tree.add((left - n * size, at))
    return out


def equal_bins(runs: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """``best_fit`` into so many bins of nearly equal fill.

    Groups over the mean of what is left have a bin of their own; the others go to bins of the mean and a little more, by
    steps of the smallest size times 1, 2, 3, 4, 6, 8, 12 and so on, the first that holds all. A step as large as the
    largest size always does.
    """
    rest, own, runs = sum(s * n for s, n in runs), [], [list(r) for r in runs]
    while runs and runs[0][0] * (bins - len(own)) >= rest:
        size = runs[0][0]
        own.append((size, len(own), 1))
        rest -= size
        runs[0][1] -= 1
        if not runs[0][1]:
            runs.pop(0)
    if not runs:
        return own
    left, step = bins - len(own), runs[-1][0]
    while True:
        for more in (step, step * 3 // 2) if step > runs[-1][0] else (step,):
            found = best_fit(runs, -(-rest // left) + more, left)
            if found is not None:
                return own + [(s, at + len(own), n) for s, at, n in found]
        step *= 2


def _packed(shards: int | None, capacity: int | None):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["bytes"].to_numpy(), b["n"].to_numpy()) for b in batches]
        if not parts:
            return
        sizes, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(-sizes, kind="stable")
        runs = list(zip(sizes[order].tolist(), counts[order].tolist(), strict=True))
        found = equal_bins(runs, shards) if capacity is None else best_fit(runs, capacity)
        out = pd.DataFrame(found, columns=["bytes", "shard", "n"])
        out["till"] = out.groupby("bytes")["n"].cumsum()
        out["from"] = out["till"] - out["n"]
        for k in range(0, len(out), 100_000):
            yield out.iloc[k : k + 100_000][["bytes", "shard", "from", "till"]]

    return pack


def _ranked(df: DataFrame, group: str, digest: str, ties: list[str], rank: str) -> DataFrame:
    """``rank`` of each row within its group by a hexadecimal digest and ``ties``, from 0: rows are counted by bucket, buckets are added up, no task holds a group."""
    digits = max(1, math.ceil(math.log(max(df.count() / ROWS_PER_BUCKET, 1), 16)))
    d = df.withColumn("bucket", F.substring(digest, 1, digits))
    sums = d.groupBy(group, "bucket").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
    inside = Window.partitionBy(group, "bucket").orderBy(digest, *ties)
    return d.join(sums, [group, "bucket"]).withColumn(rank, F.col("before") + F.row_number().over(inside) - 1).drop("bucket", "before")


def assign(rows: DataFrame, shards: int | None = 24, capacity: int | None = None) -> DataFrame:
    """``rid, doc_id, size, key`` (read from a table; key: digest of the text) -> the same with ``shard, slot``.

    With ``shards`` their sizes come out nearly equal; with ``capacity`` as few shards as best fit needs hold at most so
    many bytes. Rows of one key share a shard, unless they are over 1.1 fair shares (over the capacity), in which case they are
    dealt by hash to several groups; a single row over the capacity has a shard of its own. Slots go by a hash of
    id and text, rows of equal id and text are interchangeable. No rows in, no rows out.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    if (shards or capacity) < 1:
        raise ValueError("at least one shard or byte")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("members"))
    groups = materialize(groups.withColumn("part", F.lit(0)), "shard-groups")
    most = capacity if shards is None else WHOLE * (groups.agg(F.sum("bytes")).first()[0] or 0) / shards
    # At most shards / 1.1 of them where the number of shards is given; the join is not hinted where it is not.
    large = groups.where((F.col("bytes") > most) & (F.col("members") > 1)).select("key", F.ceil(F.col("bytes") * (1 if shards else 1.25) / (most / WHOLE if shards else most)).cast("int").alias("parts"))
    large = materialize(large, "large-groups")
    if large.isEmpty():
        dealt = rows.withColumn("part", F.lit(0))
    else:
        dealt = rows.join(F.broadcast(large) if shards and shards < 10_000 else large, "key", "left")
        dealt = materialize(dealt.withColumn("part", F.coalesce(F.expr("pmod(xxhash64(doc_id, rid), parts)").cast("int"), F.lit(0))).drop("parts"), "dealt-rows")
        groups = materialize(dealt.groupBy("key", "part").agg(F.sum("size").alias("bytes")), "shard-groups")
    runs = groups.groupBy("bytes").agg(F.count("*").alias("n"))
    plan = materialize(runs.repartition(1).mapInPandas(_packed(shards, capacity), "bytes long, shard int, from long, till long"), "shard-plan")
    at = _ranked(groups.select("key", "part", "bytes"), "bytes", "key", ["part"], "rank").join(plan, "bytes").where("rank >= from AND rank < till")
    # Written, so that the join below can split the rows of a frequent text.
    at = materialize(at.select("key", "part", "shard"), "group-shards")
    placed = materialize(dealt.join(at, ["key", "part"]).drop("part"), "row-shards")
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("key")))
    return _ranked(placed.withColumn("digest", order), "shard", "digest", ["rid"], "slot").drop("digest")


def numbered(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: bool = False) -> DataFrame:
    """A table of ``rid, doc_id, size, text_crc32, key``, and ``row`` with all columns if they are carried. A null text has no bytes and goes with the empty ones.

    Row numbers are written, so that whatever is lost and made again meets the same ones.
    """
    t = whole(F.col(text))
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.md5(t).alias("key"), *kept
    )
    return materialize(rows, "numbered-rows")


def write_shards(docs: DataFrame, path: str, shards: int | None = 24, capacity: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write the documents, all their columns, to ``path/shard=N`` as Parquet, about one file each, in order of slot; returns ``shard, rows, bytes``."""
    rows = numbered(docs, text, doc_id, carry=True)
    at = materialize(assign(rows.drop("row", "text_crc32"), shards, capacity).select("rid", "shard", "slot", "size"), "slots")
    whole_rows = rows.select("rid", "row").join(at, "rid")
    whole_rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("row", "slot", "shard").write.partitionBy("shard").parquet(path)
    return at.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes (law ``bytes``); equal texts share a shard."""
    d = assign(numbered(documents(spark, sf_dir)), 24)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Without the cutting of groups over 1.1 fair shares, which hashes row numbers. Steps of the capacity run side by side.
SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {CRC.format(x="coalesce(text, '')")} AS crc32, md5(coalesce(text, '')) AS key FROM documents, crc),
grouped AS (SELECT key, sum(size)::BIGINT AS s FROM d GROUP BY key),
items AS (SELECT *, row_number() OVER o AS i, sum(s) OVER () - coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM grouped WINDOW o AS (ORDER BY s DESC, key)),
own AS (SELECT coalesce(min(i) FILTER (WHERE i > 24 OR s * (24 - (i - 1)) < rest), max(i) + 1) - 1 AS n FROM items),
small AS (SELECT i - n AS i, s, key FROM items, own WHERE i > n),
steps AS (SELECT DISTINCT (f * 2 ** e)::BIGINT // g AS f FROM (VALUES (1, 1), (3, 2)) v(f, g), range(50) r(e) WHERE f * 2 ** e >= g AND NOT (f = 3 AND e < 1)),
pack(more, i, b, bins) AS (
  SELECT f * least_s, 0::BIGINT, 0::BIGINT, list_transform(range(24 - n), lambda x: ceil(sum_s / (24 - n))::BIGINT + f * least_s)
  FROM steps, own, (SELECT min(s) AS least_s, max(s) AS most_s, sum(s) AS sum_s FROM small) WHERE f <= 2 * most_s
  UNION ALL
  SELECT more, i, b, list_transform(bins, lambda x, j: CASE WHEN j = b THEN x - s ELSE x END)
  FROM (SELECT p.more, t.i, t.s, p.bins, list_position(p.bins, list_min(list_filter(p.bins, lambda x: x >= t.s))) AS b FROM pack p JOIN small t ON t.i = p.i + 1) WHERE b IS NOT NULL),
held AS (SELECT min(more) AS more FROM pack WHERE i = (SELECT max(i) FROM small)),
placed AS (SELECT t.key, n + p.b - 1 AS shard FROM small t, own, pack p, held WHERE p.more = held.more AND p.i = t.i UNION ALL SELECT key, i - 1 FROM items, own WHERE i <= n)
SELECT doc_id, size::BIGINT AS size, crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || d.key)) - 1 AS slot, NULL::INT AS grown_shard
FROM d JOIN placed ON placed.key = d.key
"""
