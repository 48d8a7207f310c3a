"""Room labels on plans (G19, C13, C14, I20, I21), occupant load tables (G18), intake of a drawing set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions import vocab as V
from drawlake.functions.text import first_capture, straight
from drawlake.operators.classify import canonical_level
from drawlake.operators.filters import any_substring
from drawlake.operators.geometry import in_title_block
from drawlake.operators.windows import sessions


def slash_label(text: Column) -> Column:
    """(name, number) of a label like NAME / NUMBER."""
    name, number = F.trim(F.regexp_extract(text, r"^(.+?)\s*/\s*([A-Za-z0-9\-]+)\s*$", 1)), F.regexp_extract(text, r"^(.+?)\s*/\s*([A-Za-z0-9\-]+)\s*$", 2)
    return F.when((F.length(name) >= 2) & ~name.rlike(V.NOT_A_LABEL), F.struct(F.upper(name).alias("name"), F.upper(number).alias("number")))


def likely_number(text: Column) -> Column:
    """Looks like a room's number."""
    return F.trim(text).rlike(V.ROOM_NUMBER)


def likely_name(text: Column, height: Column) -> Column:
    """Looks like a room's name: 2 to 40 characters, up to 6 words, letters, no dimension, 4 to 20 points high."""
    t = F.trim(text)
    return F.length(t).between(2, 40) & t.rlike("[A-Za-z]") & ~t.rlike(V.NOT_A_LABEL) & ~F.upper(t).rlike(r"^[A-Z]{1,2}[-/]\d{2,4}$") & ~likely_number(t) & height.between(4, 20) & (F.size(F.split(t, " ")) <= 6)


def thresholds(names: DataFrame) -> DataFrame:
    """How far a number may stand from its name, per page: from the upper median of the distances between names' heights, within bounds."""
    w = Window.partitionBy("file_id", "page").orderBy("cy", "seq")
    gap = F.col("cy") - F.lag("cy").over(w)
    g = names.withColumn("gap", F.when(gap > 0, gap)).groupBy("file_id", "page").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("gap")).alias("xs"))
    mid = F.when((F.col("n") >= 3) & (F.size("xs") > 0), F.try_element_at("xs", (F.floor(F.size("xs") / 2) + 1).cast("int")))
    clamp = lambda c, a, b: F.greatest(F.lit(a), F.least(F.lit(b), c))
    return g.select("file_id", "page", F.coalesce(clamp(mid * 1.5, 0.03, 0.15), F.lit(0.06)).alias("vert"), F.coalesce(clamp(mid * 2.5, 0.06, 0.25), F.lit(0.12)).alias("horiz"))


def room_labels(phrases: DataFrame) -> DataFrame:
    """Phrases of plans -> rooms with number, confidence (.85 slash label, .75 with a number near, .6 without) and door count.

    A page's names take their nearest free number in order of seq, which depends on the names before; that fold runs
    over the pairs of a page that are near enough.
    """
    p = phrases.where(~((F.col("x0") > 0.72) & (F.col("y0") > 0.82)))
    p = p.withColumn("height", (F.col("y1") - F.col("y0")) * F.col("page_height")).withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2).withColumn("t", F.trim("text"))
    numbers = p.where(likely_number(F.col("t")) & F.col("height").between(4, 20)).select("file_id", "page", F.col("seq").alias("n_seq"), F.upper("t").alias("number"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    names = p.where(likely_name(F.col("t"), F.col("height"))).withColumn("slash", slash_label(F.col("t")))
    reach = thresholds(names)
    near = names.where("slash IS NULL").join(reach, ["file_id", "page"]).join(numbers, ["file_id", "page"])
    near = near.where((F.abs(F.col("cy") - F.col("ny")) < F.col("vert")) & (F.abs(F.col("cx") - F.col("nx")) < F.col("horiz")))
    near = near.withColumn("closeness", -straight(F.col("cx") - F.col("nx"), F.col("cy") - F.col("ny")))
    from drawlake.operators.joins import greedy_pairs

    taken = greedy_pairs(near, ["file_id", "page"], "seq", "n_seq", "closeness").join(numbers.select("file_id", "page", "n_seq", F.col("number").alias("near_number")), ["file_id", "page", "n_seq"])
    doors = _door_hints(p, reach)
    d = names.join(taken.select("file_id", "page", "seq", "near_number"), ["file_id", "page", "seq"], "left").join(reach, ["file_id", "page"])
    hint = d.select("file_id", "page", "seq", "cx", "cy", "vert", "horiz").join(doors, ["file_id", "page"]).where((F.abs(F.col("dy") - F.col("cy")) < F.col("vert")) & (F.abs(F.col("dx") - F.col("cx")) < F.col("horiz")))
    hint = hint.groupBy("file_id", "page", "seq").agg(F.min_by("count", F.struct("dy", "d_seq")).alias("door_count"))
    d = d.join(hint, ["file_id", "page", "seq"], "left")
    return d.select(
        "file_id", "page", "seq", F.coalesce("slash.name", F.upper("t")).alias("room_name"), F.coalesce("slash.number", "near_number").alias("room_number"),
        F.when(F.col("slash").isNotNull(), 0.85).when(F.col("near_number").isNotNull(), 0.75).otherwise(0.6).alias("extraction_confidence"), F.when(F.col("slash").isNull(), F.col("door_count")).alias("door_count"),
        F.col("cx").alias("x"), F.col("cy").alias("y"),
    )


def _door_hints(p: DataFrame, reach: DataFrame) -> DataFrame:
    """Door words with a count of 1 to 20 among the two phrases above or below (C14)."""
    w = Window.partitionBy("file_id", "page").orderBy("cy", "seq")
    d = p.join(reach, ["file_id", "page"])
    best = None
    for k in (2, 1, -1, -2):
        text, cy = F.lag("t", k).over(w), F.lag("cy", k).over(w)
        n = F.regexp_extract(F.trim(text), r"^(\d+)", 1).try_cast("int")
        c = F.when((F.abs(cy - F.col("cy")) <= F.col("vert")) & n.between(1, 20), n)
        best = c if best is None else F.coalesce(best, c)
    d = d.withColumn("count", best).where(F.lower("t").isin(*V.DOOR_WORDS) & F.col("count").isNotNull())
    return d.select("file_id", "page", F.col("seq").alias("d_seq"), F.col("cx").alias("dx"), F.col("cy").alias("dy"), "count")


def zone_anchors(phrases: DataFrame) -> DataFrame:
    """Large labels (over 20 and up to 36 points): anchors of zones, not rooms."""
    height = (F.col("y1") - F.col("y0")) * F.col("page_height")
    t = F.trim("text")
    d = phrases.where((height > 20) & (height <= 36) & t.rlike("[A-Za-z]") & F.length(t).between(3, 30) & ~likely_number(t) & ~((F.col("x0") > 0.72) & (F.col("y0") > 0.82)))
    return d.select("file_id", F.col("page").alias("pdf_page"), "seq", F.upper(t).alias("text"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))


def occupant_loads(items: DataFrame, plan_pages: DataFrame) -> DataFrame:
    """``room_number, occupant_load, occupancy_group`` of the first page that announces loads and has rows; pages that are no plans come first."""
    w = Window.partitionBy("file_id", "page").orderBy("y", "x", "seq")
    rows = sessions(items, ["file_id", "page"], ["y", "x", "seq"], F.col("y") - F.lag("y").over(w) > 8, "row")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "seq", "text"))), lambda s: s["text"]), " ")
    signal = items.groupBy("file_id", "page").agg(F.upper(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ")).alias("t"))
    signal = signal.where(any_substring(F.col("t"), list(V.OCCUPANT_SIGNALS))).select("file_id", "page")
    d = rows.join(signal, ["file_id", "page"], "left_semi").groupBy("file_id", "page", "row").agg(text.alias("t"))
    get = lambda k: F.upper(F.trim(F.regexp_extract("t", V.OCCUPANT_ROW, k)))
    d = d.withColumn("room_number", get(1)).withColumn("occupant_load", get(2).try_cast("int")).withColumn("occupancy_group", F.nullif(get(3), F.lit(""))).where("room_number <> '' AND occupant_load BETWEEN 0 AND 9999")
    d = d.join(plan_pages.select("file_id", "page", F.lit(True).alias("plan")), ["file_id", "page"], "left").withColumn("rank", F.struct(F.coalesce("plan", F.lit(False)), "page"))
    first = d.groupBy("file_id").agg(F.min("rank").alias("best"))
    return d.join(first, "file_id").where(F.col("rank") == F.col("best")).select("file_id", F.col("row").alias("seq"), "room_number", "occupant_load", "occupancy_group")


def file_type(name: Column) -> Column:
    """``spec`` for sign specifications by file name, else ``data``."""
    low = F.regexp_replace(F.lower(name), "[^a-z0-9]", " ")
    return F.when(low.rlike(r"10\s*14") | (low.contains("spec") & low.contains("sign")), "spec").otherwise("data")


def intake(phrases: DataFrame, pages: int = 10) -> DataFrame:
    """Per file: project, jurisdiction and date of the first page that names them, the index page, the levels and how many."""
    text = lambda zone: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(zone, F.struct("seq", "text")))), lambda s: s["text"]), "\n")
    d = phrases.groupBy("file_id", "page").agg(text(F.lit(True)).alias("t"), text(in_title_block()).alias("z"))
    d = d.withColumn("z", F.when(F.col("z") == "", F.col("t")).otherwise(F.col("z"))).withColumn("level", canonical_level(F.regexp_replace("z", "\n", " ")))
    early = F.col("page") <= pages
    first = lambda patterns: F.min_by(F.trim(first_capture(F.col("t"), list(patterns))), F.when(early & first_capture(F.col("t"), list(patterns)).isNotNull(), F.col("page")))
    return d.groupBy("file_id").agg(
        first(V.PROJECT_NAME).alias("project_name"), first(V.JURISDICTION).alias("jurisdiction"), first(V.ISSUE_DATE).alias("issue_date"),
        F.min(F.when(early & any_substring(F.col("t"), list(V.INDEX_PAGES)), F.col("page"))).alias("index_page"),
        F.array_sort(F.collect_set("level")).alias("levels"), F.countDistinct("level").alias("level_count"),
    )


def candidate_token(text: Column, abbreviations: tuple[str, ...] = V.ROOM_ABBREVIATIONS) -> Column:
    """May be part of a room's label: no bare figures, dimensions or grid marks, four characters or a known abbreviation of three."""
    t = F.trim(text)
    bare = t.rlike(r"""^[0-9\s\-_/().,'"]+$""") | (t.rlike("['\"/]") & t.rlike("[0-9]")) | t.rlike("^[A-Z][0-9]{1,3}$")
    return ~bare & ((F.length(t) > 3) | ((F.length(t) == 3) & F.lower(t).isin(*abbreviations)))


def label_candidates(phrases: DataFrame, keywords: tuple[str, ...] = V.ROOM_WORDS, dx: float = 60.0, dy: float = 20.0, short: int = 8) -> DataFrame:
    """Labels of a drawing (G9): phrases outside title block and tables, each joined with the first free one close to its right.

    Two join if both are short or one is a room's keyword. Which are free depends on the joins before: a fold over each
    page's pairs in order. Out come ``file_id, page, seq, text, x, y``, the place in the middle of what was joined.
    """
    from drawlake.operators.geometry import without_table_columns

    d = without_table_columns(phrases.where(~in_title_block())).where(candidate_token(F.col("text")))
    d = d.select("file_id", "page", "seq", F.trim("text").alias("text"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), "page_width", "page_height")
    d = d.withColumn("small", F.length("text") < short).withColumn("word", F.lower("text").isin(*keywords))
    b = d.select("file_id", "page", F.col("seq").alias("b_seq"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("small").alias("b_small"), F.col("word").alias("b_word"))
    right = (F.col("bx") - F.col("x")) * F.col("page_width")
    near = d.join(b, ["file_id", "page"]).where((F.col("b_seq") > F.col("seq")) & (right > 0) & (right <= dx) & (F.abs(F.col("by") - F.col("y")) * F.col("page_height") <= dy))
    near = near.where((F.col("small") & F.col("b_small")) | F.col("word") | (F.col("b_word") & F.col("small")))
    kind = dict(near.dtypes)["seq"]
    items = near.groupBy("file_id", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("a"), F.col("b_seq").alias("b")))).alias("_i"))
    start = F.struct(F.expr(f"cast(array() AS array<{kind}>)").alias("used"), F.expr(f"cast(array() AS array<struct<a:{kind},b:{kind}>>)").alias("out"))

    def step(s: Column, p: Column) -> Column:
        free = ~F.array_contains(s["used"], p["a"]) & ~F.array_contains(s["used"], p["b"])
        return F.struct(F.when(free, F.concat(s["used"], F.array(p["a"], p["b"]))).otherwise(s["used"]).alias("used"), F.when(free, F.array_append(s["out"], p)).otherwise(s["out"]).alias("out"))

    joined = items.select("file_id", "page", F.explode(F.aggregate("_i", start, step)["out"]).alias("o")).select("file_id", "page", F.col("o.a").alias("seq"), F.col("o.b").alias("b_seq"))
    second = d.select("file_id", "page", F.col("seq").alias("b_seq"), F.col("text").alias("bt"), F.col("x").alias("bx"), F.col("y").alias("by"))
    gone = joined.select("file_id", "page", F.col("b_seq").alias("seq"))
    out = d.join(gone, ["file_id", "page", "seq"], "left_anti").join(joined, ["file_id", "page", "seq"], "left").join(second, ["file_id", "page", "b_seq"], "left")
    mid = lambda a, c: F.when(F.col("bt").isNull(), F.col(a)).otherwise((F.col(a) + F.col(c)) / 2)
    return out.select("file_id", "page", "seq", F.concat_ws(" ", "text", "bt").alias("text"), mid("x", "bx").alias("x"), mid("y", "by").alias("y"))
