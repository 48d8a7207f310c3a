"""Sheets and pages: title classifier (G10), page text classifier (G13), levels (I15, I16), manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.functions import vocab as V
from drawlake.functions.text import first_listed, squeezed_id
from drawlake.operators.filters import any_substring
from drawlake.operators.joins import latest
from drawlake.operators.windows import first_of, runs

BUCKETS = ("signage_schedule", "life_safety", "key_plan", "ignore", "floor_plan", "general_notes", "accessibility", "millwork_interiors", "specifications", "other")


def title_bucket(title: Column, sheet_number: Column | None = None) -> Column:
    """One of BUCKETS for a sheet's title and number; the first that holds, in that order."""
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    number = F.trim(F.coalesce(sheet_number, F.lit(""))) if sheet_number is not None else F.lit("")
    has = lambda words: any_substring(t, list(words))
    ignored = tuple(p for p in V.NOT_FLOOR_PLAN if p not in ("general notes", "abbreviation")) + V.IGNORED_PLANS
    bare = F.regexp_replace(t, V.FLOOR_PLAN_REFERENCE, "")
    plan = (any_substring(bare, list(V.FLOOR_PLAN)) | bare.rlike(V.LEVEL_PLAN)) & ~has(V.NOT_FLOOR_PLAN)
    n_words = F.size(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 0))
    by_number = number.rlike(V.FLOOR_PLAN_SHEET) & (n_words < 6) & ~t.rlike(V.FLOOR_PLAN_REFERENCE) & ~has(V.SHEET_ONLY_VETO)
    return (
        F.when(t == "", "other")
        .when(has(V.SIGN_SCHEDULE + V.SCHEDULE_ALSO), "signage_schedule")
        .when(has(V.LIFE_SAFETY), "life_safety")
        .when(has(V.KEY_PLAN), "key_plan")
        .when(has(ignored), "ignore")
        .when(plan | by_number, "floor_plan")
        .when(has(V.GENERAL_NOTES) | number.rlike(V.GENERAL_NOTES_SHEET), "general_notes")
        .when(has(V.ACCESSIBILITY), "accessibility")
        .when(has(V.MILLWORK) | number.rlike(V.MILLWORK_SHEET), "millwork_interiors")
        .when(has(V.SPECIFICATIONS), "specifications")
        .otherwise("other")
    )


def section_type(title: Column) -> Column:
    """What an outline entry stands for; life safety counts as a schedule."""
    b = title_bucket(title)
    return F.when(b.isin("signage_schedule", "life_safety"), "sign_schedule").when(b == "floor_plan", "floor_plan").otherwise("other")


def overridden_type(spatial: Column, outline: Column, heuristic: Column) -> Column:
    """Page type: spatial if known, else outline, else heuristic; two that disagree on the same page mean both."""
    known = F.nullif(spatial, F.lit("unknown"))
    return F.when(heuristic == "both", "both").otherwise(F.coalesce(known, outline, heuristic, F.lit("other")))


def level(title: Column) -> Column:
    """Normalised level of a title, null if it names none."""
    low = F.lower(title)
    out = None
    for name, phrases in V.LEVELS:
        hit = any_substring(low, list(phrases))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def level_raw(title: Column) -> Column:
    """The words of the title that name its level, as written."""
    low = F.lower(title)
    cases = [(p, F.instr(low, p)) for _, phrases in V.LEVELS for p in phrases]
    out = None
    for p, at in cases:
        text = F.substring(title, at, F.lit(len(p)))
        out = F.when(at > 0, text) if out is None else out.when(at > 0, text)
    return out


def area(title: Column) -> Column:
    """``AREA A`` .. ``AREA D``."""
    return F.nullif(F.concat(F.lit("AREA "), F.upper(F.regexp_extract(title, r"(?i)\barea\s+([A-D])\b", 1))), F.lit("AREA "))


def building(title: Column) -> Column:
    """``BUILDING A`` .. ``BUILDING Z``."""
    return F.nullif(F.concat(F.lit("BUILDING "), F.upper(F.regexp_extract(title, r"(?i)\b(?:building|bldg)\s+([A-Z])\b", 1))), F.lit("BUILDING "))


def canonical_level(text: Column) -> Column:
    """The first of the canonical level names that occurs (I16)."""
    return first_listed(text, list(V.CANONICAL_LEVELS))


def score(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases occur."""
    low = F.lower(text)
    return sum((low.contains(p).cast("int") for p in phrases), F.lit(0))


def page_text_type(text: Column) -> Column:
    """Page type by its text: a clear schedule title first, then the greater of both scores if it is four or more."""
    plan, sched = score(text, V.FLOOR_PLAN), score(text, V.SIGN_SCHEDULE)
    both = (plan >= 8) & (sched >= 8) & (plan / sched).between(0.35, 2.85)
    legend = (F.size(F.regexp_extract_all(F.lower(text), F.lit("legend:|(?:signage|symbol|drawing|life safety) legend|symbol key"), F.lit(0))) >= 1) & (plan < 10)
    return F.when(legend, "other").when(sched > 0, "sign_schedule").when(both, "both").when((plan >= 4) & (plan >= sched), "floor_plan").when(sched >= 4, "sign_schedule").otherwise("other")


def manifest(pages: DataFrame, outline: DataFrame, index: DataFrame) -> DataFrame:
    """A page's title and class: bookmark first, then the drawing index by sheet number, then the title block.

    pages: ``file_id, page, title, sheet_number`` of the title block; outline: ``file_id, seq, title, page``; index:
    ``file_id, seq, sheet_number, title``.
    """
    marks = first_of(outline.where("page IS NOT NULL"), ["file_id", "page"], ["seq"]).select("file_id", "page", F.col("title").alias("mark"))
    listed = first_of(index.withColumn("_sheet", squeezed_id(F.col("sheet_number"), ".")), ["file_id", "_sheet"], ["seq"]).select("file_id", "_sheet", F.col("title").alias("listed"))
    d = pages.withColumn("_sheet", squeezed_id(F.col("sheet_number"), ".")).join(marks, ["file_id", "page"], "left").join(listed, ["file_id", "_sheet"], "left")
    source = F.when(F.col("mark").isNotNull(), "bookmark").when(F.col("listed").isNotNull(), "index_page").when(F.col("title").isNotNull(), "title_block").otherwise("none")
    d = d.withColumn("source", source).withColumn("title", F.coalesce("mark", "listed", "title"))
    return d.select("file_id", "page", "sheet_number", "title", "source", title_bucket(F.col("title"), F.col("sheet_number")).alias("bucket"), level(F.col("title")).alias("level"))


def page_lists(manifest_: DataFrame) -> DataFrame:
    """Pages of each class per file, sorted, and their titles by page."""
    pages = lambda b: F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.col("page"))))
    titles = F.map_from_entries(F.collect_list(F.struct("page", "title")))
    return manifest_.groupBy("file_id").agg(pages("floor_plan").alias("floor_plan_pages"), pages("signage_schedule").alias("schedule_pages"), pages("life_safety").alias("life_safety_pages"), titles.alias("titles"))


def page_ranges(manifest_: DataFrame) -> DataFrame:
    """Runs of pages with the same title."""
    return runs(manifest_, ["file_id", "title"], "page")


def primary_metadata(files: DataFrame) -> DataFrame:
    """A job's metadata: that of its first file in order, the building type of the first that has one."""
    first = files.groupBy("job_id").agg(F.min_by("project_name", "seq").alias("project_name"), F.min_by("building_type", F.when(F.col("building_type").isNotNull(), F.col("seq"))).alias("building_type"))
    return first


def last_entry(entries: DataFrame) -> DataFrame:
    """A sign's schedule entry by type code, trimmed and in upper case; the last counts."""
    return latest(entries.withColumn("code", F.upper(F.trim("type_code"))), ["job_id", "code"], ["seq"], ["entry_id"])
