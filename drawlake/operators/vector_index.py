"""A store of vectors in cells, so that nearest rows are found exactly without reading the whole store.

Vectors are dealt to the cells of a k-means model that is fitted on a bounded sample; every vector is indexed. A cell keeps the
radius of its vectors around its centre, so no row of it can score higher than its bound: a query reads the cells of the
highest bounds until it has its rows, then those whose bound still reaches the last of them. Cells are partitions of the
table, so that what is not chosen is not read. Rows without a length (null, empty, zero, overflowing or of another
dimension) lie in cell -1 and are read only where all others are too few.

Upserts come as batches of their own folder: rows, their keys, and at last the statistics of their cells, which make the batch
visible; a batch that is written again replaces itself. Of a key's rows those of the last batch count.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType

from drawlake.operators.knowledge import cosine, last_of_key, vector_query

#: Rows that the model is fitted on, about, and numbers that all centres together may have: what the driver holds.
SAMPLE, CENTRES = 65_536, 16_000_000
#: Numbers in a cell's share, queries of a slice, and products that a task holds at once, where a table of queries is asked.
SHARE, ASKED, BLOCK = 1_000_000, 4_096, 4_000_000
#: Rounding of distances in double precision.
SLACK = 1e-9


def _unit(e: Column) -> Column:
    """The vector at length one, null where it has no length."""

    def one(e):
        e = None if e is None else np.asarray(e, float)
        norm = 0.0 if e is None else float(np.sqrt((e * e).sum()))
        return e / norm if 0 < norm < np.inf else None

    @pandas_udf("array<double>")
    def f(vectors: pd.Series) -> pd.Series:
        return vectors.map(one)

    return f(e)


def fitted_centres(rows: DataFrame, cells: int, embedding: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Centres of k-means over about ``sample`` rows, taken by the hash of the vector; fewer than ``cells`` where vectors repeat, none without a usable row."""
    u = rows.select(_unit(F.col(embedding)).alias("u")).where("u IS NOT NULL")
    n = u.count()
    if not n:
        return np.zeros((0, 0))
    dim = u.groupBy(F.size("u").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    if cells * dim > CENTRES:
        raise ValueError(f"{cells} cells of {dim} numbers are more than {CENTRES}")
    part = u.where((F.size("u") == dim) & (F.pmod(F.xxhash64("u"), F.lit(1_000_000)) < min(1.0, sample / n) * 1_000_000))
    if part.isEmpty():
        part = u.where(F.size("u") == dim).limit(cells)
    model = KMeans(k=cells, seed=1, maxIter=10, featuresCol="v").fit(part.select(array_to_vector("u").alias("v")))
    return np.array(model.clusterCenters())


def _dealt(centres: np.ndarray):
    squares = (centres**2).sum(1) if len(centres) else None

    @pandas_udf("struct<cell:int,distance:double>")
    def f(units: pd.Series) -> pd.DataFrame:
        cell, distance = np.full(len(units), -1, np.int32), np.full(len(units), np.nan)
        good = np.array([u is not None and len(centres) > 0 and len(u) == centres.shape[1] for u in units], bool)
        if good.any():
            v = np.stack(units[good].to_list())
            near = (squares - 2 * v @ centres.T).argmin(1)
            cell[good], distance[good] = near, np.linalg.norm(v - centres[near], axis=1)
        return pd.DataFrame({"cell": cell, "distance": distance})

    return f


def _write(rows: DataFrame, path: str, batch: int, centres: np.ndarray, key: str, embedding: str) -> None:
    made = rows.withColumn("_d", _dealt(centres)(_unit(F.col(embedding)))).withColumn("cell", F.col("_d.cell")).withColumn("_distance", F.col("_d.distance")).select(*rows.columns, "_distance", "cell")
    # A cell's rows share files as far as adaptive execution finds them small enough: it splits a hot cell.
    made.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows/batch={batch}")
    spark = rows.sparkSession
    written = spark.read.schema(made.schema).parquet(f"{path}/rows/batch={batch}")
    written.select(key).where(F.col(key).isNotNull()).write.mode("overwrite").parquet(f"{path}/keys/batch={batch}")
    stats = written.groupBy("cell").agg(F.max("_distance").alias("radius"), F.count("*").alias("n"))
    stats.write.mode("overwrite").parquet(f"{path}/cells/batch={batch}")


def build(rows: DataFrame, path: str, cells: int = 256, key: str = "vec_id", embedding: str = "embedding", order: list[str] | None = None) -> None:
    """A new index in the folder ``path``: centres, and ``rows`` as batch 0. Of rows that repeat a key the last by ``order`` counts."""
    centres = fitted_centres(rows, cells, embedding)
    spark = rows.sparkSession
    kept = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    spark.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    _write(last_of_key(rows, key, order), path, 0, centres, key, embedding)


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    found = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").orderBy("cell").collect()
    return np.array([r["centre"] for r in found]) if found else np.zeros((0, 0))


def upsert(rows: DataFrame, path: str, batch: int, key: str = "vec_id", embedding: str = "embedding", order: list[str] | None = None) -> None:
    """Rows replaced or added by key (A20), with the columns of the store. Batches have growing numbers from 1; the same number again replaces its batch."""
    if batch < 1:
        raise ValueError("batch 0 is the build")
    _write(last_of_key(rows, key, order), path, batch, _centres(rows.sparkSession, path), key, embedding)


def _cells(spark: SparkSession, path: str) -> tuple[list[int], pd.DataFrame]:
    """The visible batches, and ``radius, n`` of each cell over them: one row for each cell of the model."""
    stats = spark.read.schema("cell int, radius double, n long, batch int").parquet(f"{path}/cells")
    # Every batch is asked for by its folder, as one without rows has no statistics.
    batches = sorted({int(f.split("/batch=")[1].split("/")[0]) for f in stats.inputFiles()})
    return batches, stats.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).toPandas()


def live(spark: SparkSession, path: str, cells: list[int] | None = None, key: str = "vec_id") -> DataFrame:
    """The store's rows, those of some cells only: of each key those of its last batch."""
    batches = _cells(spark, path)[0]
    columns = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema", wholetext=True).first()[0]))
    d = spark.read.schema(columns.add("_distance", "double").add("cell", "integer").add("batch", "integer")).parquet(f"{path}/rows").where(F.col("batch").isin(batches))
    if cells is not None:
        d = d.where(F.col("cell").isin(cells))
    if len(batches) > 1:
        # Keys of the build are not needed to tell what came later.
        later = spark.read.parquet(f"{path}/keys").where(F.col("batch").isin(batches[1:])).groupBy(key).agg(F.max("batch").alias("_last"))
        d = d.join(later, key, "left").where("_last IS NULL OR batch >= _last").drop("_last")
    return d.drop("batch", "_distance")


def _bounds(q: np.ndarray, centres: np.ndarray, stats: pd.DataFrame) -> pd.DataFrame:
    """The statistics with ``bound``, the greatest cosine a row of the cell can have with the unit vector; highest first, cell -1 last."""
    known = stats["cell"].to_numpy() >= 0
    bound = np.full(len(stats), -np.inf)
    at = stats["cell"].to_numpy()[known]
    gap = np.maximum(0.0, np.linalg.norm(centres[at] - q, axis=1) - stats["radius"].to_numpy()[known] - SLACK)
    bound[known] = 1 - gap**2 / 2
    return stats.assign(bound=bound).sort_values(["bound", "cell"], ascending=[False, True])


def chosen_cells(spark: SparkSession, path: str, vector: list[float], n: int = 5, keep: Column | None = None, key: str = "vec_id", embedding: str = "embedding") -> list[int]:
    """The cells that can hold any of the n rows nearest to the vector, of those that the filter keeps."""
    centres, (_, stats) = _centres(spark, path), _cells(spark, path)
    q = np.array(vector, float)
    norm = float(np.linalg.norm(q))
    if not len(centres) or len(q) != centres.shape[1] or not 0 < norm < np.inf:
        return sorted(int(c) for c in stats["cell"])  # no row has a score: the order is that of the keys
    ranked = _bounds(q / norm, centres, stats)
    want = n
    while True:
        first = ranked[(ranked["n"].cumsum().shift(fill_value=0) < want)]
        scores = [r["score"] for r in vector_query(live(spark, path, first["cell"].astype(int).to_list(), key), vector, n, keep, embedding, key).select("score").collect()]
        if len(scores) == n and scores[-1] is not None:
            least = 2 * scores[-1] - 1 - SLACK
            return sorted(int(c) for c in ranked[ranked["bound"] >= least]["cell"])
        if len(first) == len(ranked):
            return sorted(int(c) for c in ranked["cell"])
        want = max(2 * want, int(2 * first["n"].sum()))


def nearest(spark: SparkSession, path: str, vector: list[float], n: int = 5, keep: Column | None = None, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """What ``knowledge.vector_query`` gives over the whole store, from a part of its cells."""
    cells = chosen_cells(spark, path, vector, n, keep, key, embedding)
    return vector_query(live(spark, path, cells, key).drop("cell"), vector, n, keep, embedding, key)


def _scored(n: int, q_key: str, key: str):
    """The n nearest of a share's rows for each of its queries: all products at once, then the cosine of those that may count, summed as ``knowledge.cosine`` sums it."""

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(column), -1)

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for j in range(a.shape[1]):
            total += a[:, j] * b[:, j]
        return total

    def f(asked: pa.Table, rows: pa.Table) -> pa.Table:
        names = [q_key, key, "score"]
        if not len(asked) or not len(rows):
            return pa.table({q_key: asked[q_key].slice(0, 0), key: rows[key].slice(0, 0), "score": pa.array([], pa.float64())})
        q, e = matrix(asked["_q"]), matrix(rows["_e"])
        q_norm, e_norm = np.sqrt(dot(q, q)), np.sqrt(dot(e, e))
        q_unit, e_unit = q / q_norm[:, None], (e / e_norm[:, None]).T
        place = np.empty(len(rows), np.int64)
        place[pc.sort_indices(rows[key].combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(len(rows))
        at, of, scores = [], [], []
        step = max(1, BLOCK // len(rows))
        for low in range(0, len(q), step):
            near = q_unit[low : low + step] @ e_unit
            least = np.partition(near, -min(n, len(rows)), axis=1)[:, -min(n, len(rows))]
            i, j = np.nonzero(near >= least[:, None] - SLACK)
            i += low
            total = np.zeros(len(i))
            for d in range(q.shape[1]):
                total += e[j, d] * q[i, d]
            score = (1 + total / (e_norm[j] * q_norm[i])) / 2
            order = np.lexsort((place[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, i)
            kept = np.arange(len(i)) - first < n
            at.append(i[kept]), of.append(j[kept]), scores.append(score[kept])
        return pa.table([asked[q_key].take(pa.array(np.concatenate(at))), rows[key].take(pa.array(np.concatenate(of))), pa.array(np.concatenate(scores))], names)

    return f


def nearest_of_each(queries: DataFrame, path: str, n: int = 5, q_key: str = "q_id", q_vector: str = "q_vector", key: str = "vec_id", embedding: str = "embedding", share: int = SHARE, asked: int = ASKED) -> DataFrame:
    """``q_key, key, score, rank``: the n nearest rows of each of a table of queries, exactly; ties by key.

    A query first meets the cells of the highest bounds that together hold n rows, which gives a score that the nearest
    rows must reach, then the other cells whose bound does. Cells are cut into shares of about ``share`` numbers, the queries into
    slices of about ``asked``: a task holds one of each at a time, and gives n rows at most to a query. Queries have keys of their own; those without
    a length, and rows without one, have no partners.
    """
    spark = queries.sparkSession
    centres, (_, stats) = _centres(spark, path), _cells(spark, path)
    if not len(centres):
        raise ValueError("the index has no cells: build it over rows")
    stats = stats[stats["cell"] >= 0]
    dim = centres.shape[1]

    @pandas_udf("array<struct<cell:int,bound:double,first:boolean>>")
    def ranked(units: pd.Series) -> pd.Series:
        out = []
        for u in units:
            if u is None or not len(stats) or len(u) != dim:
                out.append([])
                continue
            b = _bounds(np.asarray(u, float), centres, stats)
            before = b["n"].cumsum().shift(fill_value=0) < n
            out.append([{"cell": int(c), "bound": float(x), "first": bool(f)} for c, x, f in zip(b["cell"], b["bound"], before, strict=True)])
        return pd.Series(out)

    shares = spark.createDataFrame([(int(c), -(-int(m) * dim // share)) for c, m in zip(stats["cell"], stats["n"], strict=True)], "cell int, _shares long")
    slices = -(-queries.count() // asked) or 1
    q = queries.select(q_key, F.col(q_vector).cast("array<double>").alias("_q")).withColumn("_c", ranked(_unit(F.col("_q")))).withColumn("_slice", F.pmod(F.xxhash64(q_key), F.lit(slices)))
    store = live(spark, path, None, key).where("cell >= 0").select("cell", key, F.col(embedding).alias("_e")).join(F.broadcast(shares), "cell")
    store = store.withColumn("_share", F.pmod(F.xxhash64(key), F.col("_shares"))).drop("_shares").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>")))
    out = StructType([queries.schema[q_key], store.schema[key]]).add("score", "double")

    def best(asked_for: DataFrame) -> DataFrame:
        dealt = asked_for.join(F.broadcast(shares), "cell").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).select("cell", "_share", "_slice", q_key, "_q")
        by = ["cell", "_share", "_slice"]
        scored = dealt.groupBy(*by).cogroup(store.groupBy(*by)).applyInArrow(_scored(n, q_key, key), out)
        near = F.row_number().over(Window.partitionBy(q_key).orderBy(F.desc("score"), key))
        return scored.withColumn("rank", near).where(F.col("rank") <= n).select(q_key, key, "score", "rank")

    every = q.select(q_key, "_q", "_slice", F.explode("_c").alias("c")).select(q_key, "_q", "_slice", "c.*")
    first = best(every.where("first"))
    least = first.where(F.col("rank") == n).select(q_key, (2 * F.col("score") - 1 - SLACK).alias("_least"))
    # The first cells are among those that are asked again: their bound reaches any score found in them.
    again = every.join(least, q_key, "left").where("_least IS NULL OR bound >= _least").drop("_least")
    return best(again.select(q_key, "_q", "_slice", "cell")).withColumn("rank", F.col("rank").cast("long"))
