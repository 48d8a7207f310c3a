"""File sources and sinks: spreadsheets (A8), landing folders (A11), overlays (A12), decoders (A3-A5), exports."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from drawlake.operators.aggregates import count_where, joined_set, with_total

#: Header words of the fields of a sign list, in order of choice.
FIELDS = (
    ("identifier", ("sign id", "identifier", "id", "sign no", "number")),
    ("sign_type", ("sign type", "type")),
    ("location", ("location", "room", "area")),
    ("quantity", ("quantity", "qty", "count")),
    ("dimensions", ("dimensions", "dimension", "size")),
    ("message", ("message", "copy", "text")),
    ("page", ("page", "sheet")),
    ("notes", ("notes", "remarks", "comments")),
)
ITEMS = "file_id string, page int, seq int, text string, x double, y double, w double, h double, page_width double, page_height double"


class Decoder(Protocol):
    """Turns a document's bytes into text items as ITEMS lists them, without file_id."""

    def items(self, content: bytes) -> Iterator[tuple]: ...


def raw_items(spark: SparkSession, folder: str, decoder: Decoder, glob: str = "*.pdf") -> DataFrame:
    """Text items of a folder's documents; a document that cannot be read gives none (A3, A4)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in ITEMS.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = [(path, *r) for r in decoder.items(bytes(content))]
                except Exception:
                    rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(decode, ITEMS)


def uploads(spark: SparkSession, folder: str, most: int = 500_000_000) -> DataFrame:
    """``path, length`` of the documents of a landing folder that are PDF by name and not too large."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return d.where(F.lower("path").endswith(".pdf") & (F.col("length") <= most))


def field_columns(header: list[str | None]) -> dict[str, int]:
    """Which column holds which field: equality or a word of the field inside the header, each field once, from the left."""
    found: dict[str, int] = {}
    for i, h in enumerate(header):
        low = (h or "").strip().lower()
        for field, names in FIELDS:
            if field not in found and low and any(low == n or n in low for n in names):
                found[field] = i
                break
    return found


def _list_rows(spark: SparkSession, path: str, columns: int) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files with their file, block and place, and the header of each file: the fullest of its first ten rows, the first of equals, with the columns of its fields."""
    schema = ", ".join(f"c{i} string" for i in range(columns))
    cells = F.array(*[F.trim(F.coalesce(F.col(f"c{i}"), F.lit(""))) for i in range(columns)])
    d = spark.read.schema(schema).option("header", "false").csv(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), cells.alias("cells")
    )
    # A task reads a block from its begin to its end, so that places go up within it; the first block of a file has its first rows.
    first = Window.partitionBy("file").orderBy("place")
    top = d.where("block = 0").withColumn("n", F.row_number().over(first)).where("n <= 10")
    filled = F.size(F.filter("cells", lambda c: c != ""))
    heads = top.groupBy("file").agg(F.min_by(F.struct("place", "cells"), F.struct((-filled).alias("f"), F.col("n"))).alias("h"))
    found = pandas_udf(lambda cells: cells.map(lambda c: list(field_columns(list(c)).items())), "array<struct<field: string, at: int>>")
    return d, heads.select("file", F.col("h.place").alias("head"), F.map_from_entries(found("h.cells")).alias("fields"))


def sign_lists(spark: SparkSession, path: str, columns: int = 64) -> DataFrame:
    """CSV sign lists (A8), any number of files: ``file`` and every field as text, null where empty or not in that file's header.

    The header is the fullest of a file's first ten rows; what stands above it is no sign, nor are rows without identifier, type
    and location. Columns beyond ``columns`` are not read; empty files give no rows. Headers are found in the tasks, a row for each file.
    """
    d, heads = _list_rows(spark, path, columns)
    d = d.join(heads, "file").where("block > 0 OR place > head")
    cell = lambda f: F.nullif(F.get("cells", F.try_element_at("fields", F.lit(f))), F.lit(""))
    out = d.select("file", *[cell(f).alias(f) for f, _ in FIELDS])
    return out.where("identifier IS NOT NULL OR sign_type IS NOT NULL OR location IS NOT NULL")


def sign_list(spark: SparkSession, path: str) -> DataFrame:
    """``sign_lists`` without the file, with those fields only that some header has; the driver sees their names."""
    fields = _list_rows(spark, path, 64)[1].select(F.explode(F.map_keys("fields")).alias("f")).distinct().collect()
    there = {r["f"] for r in fields}
    return sign_lists(spark, path).select(*[f for f, _ in FIELDS if f in there])


def overlay(spark: SparkSession, path: str) -> dict[str, str]:
    """A JSON object of names to labels; a vocabulary, so it is read whole."""
    import json

    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return {str(k): str(v) for k, v in json.loads(rows[0][0]).items()} if rows else {}


def export_sheets(signs: DataFrame) -> dict[str, DataFrame]:
    """The export's sheets (A15): rows in order of page and identifier, a summary, and types with sizes, pages and a total."""
    q = F.coalesce("quantity", F.lit(1))
    rows = signs.where("NOT coalesce(hidden, false)").orderBy(F.col("page_number").asc_nulls_last(), "sign_identifier")
    summary = signs.where("NOT coalesce(hidden, false)").agg(F.count("*").alias("items"), F.coalesce(F.sum(q), F.lit(0)).alias("signs"), count_where(F.col("confidence_score") >= 0.8).alias("confident"), count_where(F.col("review_flag")).alias("flagged"))
    types = with_total(signs.where("NOT coalesce(hidden, false)"), ["sign_type", "dimensions"], [F.sum(q).alias("quantity"), joined_set(F.col("page_number").cast("string")).alias("pages")])
    return {"rows": rows, "summary": summary, "types": types}


def markers(signs: DataFrame, pages: DataFrame) -> DataFrame:
    """Placed signs of each page with its rotation, joined by file AND page, and a number per type for the legend."""


    from drawlake.operators.geometry import rotated

    d = signs.where("x_pos IS NOT NULL AND y_pos IS NOT NULL").join(pages.select("file_id", F.col("page").alias("page_number"), "rotation"), ["file_id", "page_number"])
    x, y = rotated(F.col("x_pos"), F.col("y_pos"), F.col("rotation"))
    w = Window.partitionBy("file_id", "page_number").orderBy("sign_type")
    return d.withColumns({"x": x, "y": y}).withColumn("legend", F.dense_rank().over(w))


def write_sheets(sheets: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each sheet as a folder of files (A15, A17, A18); the writer batches."""
    for name, df in sheets.items():
        df.write.mode("overwrite").format(form).save(f"{folder}/{name}")
