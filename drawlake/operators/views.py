"""Derived tables of the screens and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions import vocab as V
from drawlake.operators.aggregates import one_source
from drawlake.operators.filters import any_substring
from drawlake.operators.geometry import best_phrase, in_title_block, without_table_columns
from drawlake.operators.windows import first_of


def outline_leaves(outline: DataFrame) -> DataFrame:
    """The first leaf of each page that no section of another discipline stands above (A7): ``file_id, seq, title, page, ancestors, is_leaf``."""
    other = F.exists("ancestors", lambda a: any_substring(a, list(V.OTHER_DISCIPLINES)))
    return first_of(outline.where(F.col("is_leaf") & F.col("page").isNotNull() & ~F.coalesce(other, F.lit(False))), ["file_id", "page"], ["seq"])


def outline_sections(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Each entry with the pages it spans, up to the next entry's page or the last page of its file (C17)."""
    w = Window.partitionBy("file_id").orderBy("page", "seq")
    d = outline.where("page IS NOT NULL").join(pages.select("file_id", "page_count"), "file_id")
    return d.withColumn("end_page", F.greatest(F.col("page"), F.coalesce(F.lead("page").over(w) - 1, F.col("page_count")))).withColumnRenamed("page", "start_page")


def spatial_page_type(phrases: DataFrame) -> DataFrame:
    """``file_id, page, type``: floor_plan, sign_schedule, both or unknown by the title block; only phrases that name a type can veto it."""
    low = F.lower("text")
    plan = any_substring(low, list(V.FLOOR_PLAN)) | low.rlike(V.LEVEL_PLAN)
    sched = any_substring(low, list(V.SIGN_SCHEDULE))
    veto = (plan | sched) & any_substring(low, list(V.NOT_FLOOR_PLAN + V.HARD_DISCIPLINES))
    zone = in_title_block()
    joined = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(zone, F.struct("seq", "text")))), lambda s: s["text"]), " "))
    g = phrases.groupBy("file_id", "page").agg(joined.alias("t"), F.bool_or(zone & veto).alias("veto"))
    p = any_substring(F.col("t"), list(V.FLOOR_PLAN)) | F.col("t").rlike(V.LEVEL_PLAN)
    s = any_substring(F.col("t"), list(V.SIGN_SCHEDULE))
    kind = F.when(F.col("veto"), "unknown").when(p & s, "both").when(s, "sign_schedule").when(p, "floor_plan").otherwise("unknown")
    return g.select("file_id", "page", kind.alias("type"))


def drawing_phrases(phrases: DataFrame) -> DataFrame:
    """Phrases of the drawing itself: neither title block nor table column."""
    return without_table_columns(phrases.where(~in_title_block()))


def filled_coordinates(signs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Signs without a place, but with page and location, get that of their best phrase."""
    todo = signs.where("x_pos IS NULL AND page_number IS NOT NULL AND location IS NOT NULL").select("file_id", F.col("page_number").alias("page"), "sign_id", F.col("location").alias("query"), F.col("sign_identifier").alias("room_number"))
    m = best_phrase(todo, phrases).select("sign_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    return signs.join(m, "sign_id", "left").withColumns({"x_pos": F.coalesce("x_pos", "_x"), "y_pos": F.coalesce("y_pos", "_y")}).select(*signs.columns)


def canonical_words(tokens: Column, abbreviations: dict[str, str]) -> Column:
    """Tokens with abbreviations written out; what scores on them counts .95 of an equal word."""
    m = F.create_map(*[F.lit(x) for kv in abbreviations.items() for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(m, t), t))


def building_type(text: Column) -> Column:
    """The first building type one of whose words occurs."""
    out = None
    for name, words in V.BUILDING_TYPES:
        hit = any_substring(text, list(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def tight_box(x0: Column, x1: Column, text: Column, needle: Column) -> Column:
    """The part of a phrase's box that a run of its characters covers, by its share of them; null where less than half matches."""
    at = F.instr(F.lower(text), F.lower(needle))
    step = (x1 - x0) / F.greatest(F.length(text), F.lit(1))
    return F.when(at > 0, F.struct((x0 + (at - 1) * step).alias("x0"), (x0 + (at - 1 + F.length(needle)) * step).alias("x1")))


def overlaid(base: dict[str, str], *layers: dict[str, str]) -> Column:
    """A map column in which later layers come over earlier ones (H4)."""
    merged = dict(base)
    for layer in layers:
        merged.update(layer)
    return F.create_map(*[F.lit(x) for kv in merged.items() for x in kv])


def provenance(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Vocabulary rows as built-in, override or custom (T18): ``key, label`` of both sides."""
    d = base.select("key", F.col("label").alias("b")).join(overrides.select("key", F.col("label").alias("o")), "key", "full")
    return d.select("key", F.coalesce("o", "b").alias("label"), F.when(F.col("b").isNull(), "custom").when(F.col("o").isNotNull() & (F.col("o") != F.col("b")), "override").otherwise("built-in").alias("origin"))


def source_label(manual: Column, ai: Column, text: Column, image: Column) -> Column:
    """Where a sign comes from; by hand comes before model, model before passes."""
    return F.when(manual, "manual").when(ai, "ai").when(text & image, "both").when(image, "visual").otherwise("text")


def match_band(rate: Column) -> Column:
    """good from .8, fair from .6, else poor."""
    return F.when(rate >= 0.8, "good").when(rate >= 0.6, "fair").otherwise("poor")


def coordinates_table(signs: DataFrame) -> DataFrame:
    """Placed signs by page (none as 0) and identifier, as fractions and as percent."""
    d = signs.where("x_pos IS NOT NULL").withColumns({"x_percent": F.round(F.col("x_pos") * 100, 2), "y_percent": F.round(F.col("y_pos") * 100, 2)})
    return d.orderBy(F.coalesce("page_number", F.lit(0)), "sign_identifier")


def detection_rows(files: DataFrame) -> DataFrame:
    """Pages that count as schedules, with label and section (T8): ``file_id, schedule_pages, both_pages, page_labels, sections``."""
    d = files.select("file_id", "page_labels", "sections", F.explode(F.array_sort(F.array_union("schedule_pages", "both_pages"))).alias("page"))
    inside = F.filter("sections", lambda s: (s["start_page"] <= F.col("page")) & (F.col("page") <= s["end_page"]))
    return d.select("file_id", "page", F.try_element_at("page_labels", F.col("page")).alias("label"), F.try_element_at(inside, F.lit(1))["title"].alias("section"))


def fallback_rows(files: DataFrame) -> DataFrame:
    """A row for each page that a file's lists name, and the pages that none does as "other" (H2, T9)."""
    kinds = {"floor_plan": F.array_except("floor_plan_pages", "schedule_pages"), "sign_schedule": F.array_except("schedule_pages", "floor_plan_pages"), "both": F.array_intersect("floor_plan_pages", "schedule_pages")}
    named = F.array_union("floor_plan_pages", "schedule_pages")
    kinds["other"] = F.array_except(F.sequence(F.lit(1), F.col("page_count")), named)
    out = None
    for kind, pages in kinds.items():
        d = files.select("file_id", F.explode(pages).alias("page"), F.lit(kind).alias("type"))
        out = d if out is None else out.unionByName(d)
    return out.orderBy("file_id", "page")


def failure_counts(log: DataFrame) -> DataFrame:
    """Distinct files with errors and with skips per job (D10): ``job_id, step, error, skipped``; both names of the manifest step count."""
    d = log.withColumn("prefix", F.regexp_extract("step", V.FILE_STEP, 1)).withColumn("file_id", F.regexp_extract("step", V.FILE_STEP, 2)).where(F.col("prefix").isin(*V.FAILURE_STEPS))
    n = lambda c: F.countDistinct(F.when(c, F.col("file_id")))
    return d.groupBy("job_id").agg(n(F.col("error").isNotNull()).alias("failed_files"), n(F.coalesce("skipped", F.lit(False))).alias("skipped_files"))


def file_summary(log: DataFrame) -> DataFrame:
    """Per file: time, error, skip, first label, sources (D14, D16), slowest first after failed and skipped ones (F-5)."""
    g = log.groupBy("job_id", "file_id").agg(F.sum("duration_ms").alias("duration_ms"), F.bool_or(F.col("error").isNotNull()).alias("failed"), F.bool_or(F.coalesce("skipped", F.lit(False))).alias("skipped"), F.min_by("label", "seq").alias("label"), one_source(F.col("source")).alias("source"))
    return g.orderBy(F.desc("failed"), F.desc("skipped"), F.desc("duration_ms"))


def audit_by_file(audit: DataFrame) -> DataFrame:
    """Page rows of an audit by file, in the order of pages."""
    return audit.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pdf_page", "rooms_found", "rows_emitted", "quantity"))).alias("pages"))


def model_steps(log: DataFrame, prefixes: list[str]) -> DataFrame:
    """Steps of the log that called a model: they hold tokens, or their name begins with a known prefix."""
    known = F.lit(False)
    for p in prefixes:
        known = known | F.col("step").startswith(p)
    return log.where((F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0)) > 0) | known)


def last_step(log: DataFrame, name: str) -> DataFrame:
    """Each job's last step of a name (K2)."""
    return log.where(F.col("step") == name).groupBy("job_id").agg(F.max_by("details", "seq").alias("details"))


def patched(stats: Column, changes: dict[str, Column]) -> Column:
    """A struct with some of its fields replaced (K9)."""
    for k, v in changes.items():
        stats = stats.withField(k, v)
    return stats


def page_with_next(rows: DataFrame, order: list, limit: int, offset: int) -> tuple[DataFrame, DataFrame]:
    """A page of rows, and one row that says whether another follows."""
    more = rows.orderBy(*order).offset(offset).limit(limit + 1)
    return more.limit(limit), more.agg((F.count("*") > limit).alias("has_next"))


def sheet_number(phrases: DataFrame, pattern: str = r"\b([A-Z]{1,2}[-.]?\d{1,3}(?:\.\d{1,2})?)\b") -> DataFrame:
    """Each page's first phrase that holds a sheet number."""
    d = phrases.where(in_title_block()).withColumn("n", F.regexp_extract("text", pattern, 1)).where("n <> ''")
    return d.groupBy("file_id", "page").agg(F.min_by("n", "seq").alias("sheet_number"))
