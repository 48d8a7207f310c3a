"""Text geometry: glyph merge, rows, columns, zones, table columns (G1-G9), transforms (J1-J7), matching phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawlake.functions.text import phrase_score, straight, tokens_alnum
from drawlake.operators.joins import dealt_join
from drawlake.operators.windows import sessions


def reading_order(items: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``ord``: lines top to bottom, left to right inside one; a line ends where the next y is more than the tolerance away (F-7)."""
    w = Window.partitionBy("file_id", "page").orderBy("y", "x", "seq")
    new = F.coalesce((F.col("y") - F.lag("y").over(w) > tolerance).cast("int"), F.lit(1))
    d = items.withColumn("_new", new)
    d = d.withColumn("_line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = Window.partitionBy("file_id", "page").orderBy("_line", "x", "seq")
    return d.withColumn("ord", F.row_number().over(order)).drop("_new", "_line")


def merged_glyphs(items: DataFrame) -> DataFrame:
    """Glyph runs (``file_id, page, seq, text, x, y, w, h, page_width, page_height``) -> phrases with boxes in [0, 1] (G1).

    A run joins the one before it when their centres differ by 5 or less and the gap is under 1.2 widths and 4
    characters of that one; runs of several characters, or a gap over .3 widths, put a blank between.
    """
    d = reading_order(items.where("text IS NOT NULL AND trim(text) <> ''"))
    w = Window.partitionBy("file_id", "page").orderBy("ord")
    prev = lambda c: F.lag(c).over(w)
    centre = F.col("y") + F.col("h") / 2
    gap = F.col("x") - (prev("x") + prev("w"))
    char = prev("w") / F.greatest(F.length(prev("text")), F.lit(1))
    joins = (F.abs(centre - F.lag(centre).over(w)) <= 5) & (gap < F.least(1.2 * prev("w"), 4 * char))
    blank = ((F.length("text") > 1) & (F.length(prev("text")) > 1)) | (gap > 0.3 * prev("w"))
    d = d.withColumn("_blank", blank).withColumn("_joins", joins)
    d = sessions(d, ["file_id", "page"], ["ord"], ~F.col("_joins"), "_group")
    piece = F.when(F.col("_joins") & F.col("_blank"), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("t")))), lambda s: s["t"]), "")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return d.groupBy("file_id", "page", F.col("_group").alias("seq")).agg(
        text.alias("text"),
        unit(F.min(F.col("x") / F.col("page_width"))).alias("x0"),
        unit(F.min(F.col("y") / F.col("page_height"))).alias("y0"),
        unit(F.max((F.col("x") + F.col("w")) / F.col("page_width"))).alias("x1"),
        unit(F.max((F.col("y") + F.col("h")) / F.col("page_height"))).alias("y1"),
        F.first("page_width").alias("page_width"),
        F.first("page_height").alias("page_height"),
    )


def page_text(phrases: DataFrame) -> DataFrame:
    """A page's phrases in order with blanks between."""
    return phrases.groupBy("file_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ").alias("text"))


def _centre() -> tuple[Column, Column]:
    return (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2


def in_title_block() -> Column:
    """The corner and edges where title blocks stand."""
    cx, cy = _centre()
    return ((cx > 0.60) & (cy > 0.60)) | (cy > 0.80) | (cx > 0.75)


def in_title_strip() -> Column:
    """The lowest tenth."""
    return _centre()[1] > 0.90


def in_drawing() -> Column:
    """Outside the title block's corner and inside the margins."""
    cx, cy = _centre()
    return ((F.col("x0") <= 0.72) | (F.col("y0") <= 0.82)) & cx.between(0.04, 0.96) & cy.between(0.04, 0.96)


def without_table_columns(phrases: DataFrame, bucket: float = 0.02, least: int = 6, slack: float = 15.0) -> DataFrame:
    """Phrases that are not in a column of ``least`` or more whose distances are all within the slack of their upper median."""
    d = phrases.withColumn("_bin", F.floor(F.col("x0") / bucket + 0.5).cast("long"))
    w = Window.partitionBy("file_id", "page", "_bin").orderBy("y0", "seq")
    gaps = d.withColumn("_gap", (F.col("y0") - F.lag("y0").over(w)) * F.col("page_height"))
    xs = F.sort_array(F.collect_list("_gap"))
    cols = gaps.groupBy("file_id", "page", "_bin").agg(F.count("*").alias("n"), xs.alias("xs"))
    mid = F.element_at("xs", (F.floor(F.size("xs") / 2) + 1).cast("int"))
    table = cols.where(F.col("n") >= least).withColumn("_mid", mid).where((F.col("_mid") > 0) & F.forall("xs", lambda g: F.abs(g - F.col("_mid")) <= slack))
    return d.join(table.select("file_id", "page", "_bin"), ["file_id", "page", "_bin"], "left_anti").drop("_bin")


def columns(phrases: DataFrame, gap: float = 0.08) -> DataFrame:
    """``column``: phrases by centre, a new one where the next is the gap or more to the right."""
    d = phrases.withColumn("_cx", _centre()[0])
    w = Window.partitionBy("file_id", "page").orderBy("_cx", "seq")
    return sessions(d, ["file_id", "page"], ["_cx", "seq"], F.col("_cx") - F.lag("_cx").over(w) >= gap, "column").drop("_cx")


def rotated(x: Column, y: Column, rotation: Column) -> tuple[Column, Column]:
    """A point of the upright page on the page as stored, for quarter turns."""
    nx = F.when(rotation == 90, y).when(rotation == 180, 1 - x).when(rotation == 270, 1 - y).otherwise(x)
    ny = F.when(rotation == 90, 1 - x).when(rotation == 180, 1 - y).when(rotation == 270, x).otherwise(y)
    return nx, ny


def transformed_box(transform: Column, width: Column, height: Column) -> dict[str, Column]:
    """The upright box of a w x h rectangle under a 2x3 transform."""
    a, b, c, d, e, f = (transform[i] for i in range(6))
    xs = [e, e + a * width, e + c * height, e + a * width + c * height]
    ys = [f, f + b * width, f + d * height, f + b * width + d * height]
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}


def raster_scale(width: Column, height: Column, pixels: float = 8e6) -> Column:
    """The scale at which a page stays within a number of pixels."""
    return F.least(F.lit(1.0), F.sqrt(pixels / (width * height)))


def padded_crop(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, factor: float = 3.0, least: float = 64.0) -> Column:
    """A box padded about its centre and cut to the page; null if under 4 pixels a side."""
    cw, ch = F.greatest(w * factor, F.lit(least)), F.greatest(h * factor, F.lit(least))
    x0, y0 = F.greatest(F.lit(0.0), x + w / 2 - cw / 2), F.greatest(F.lit(0.0), y + h / 2 - ch / 2)
    x1, y1 = F.least(page_w, x + w / 2 + cw / 2), F.least(page_h, y + h / 2 + ch / 2)
    return F.when((x1 - x0 >= 4) & (y1 - y0 >= 4), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def best_phrase(signs: DataFrame, phrases: DataFrame, least: float = 0.5, number_bonus: float = 0.85) -> DataFrame:
    """Each sign's best phrase of its page by score, the first of equals (G23, G25); a phrase that holds the room number scores the bonus at least.

    signs: ``file_id, page, sign_id, query, room_number``. Pairs are those of one page.
    """
    q = signs.withColumn("_q", tokens_alnum(F.col("query")))
    p = phrases.withColumn("_t", tokens_alnum(F.col("text"))).select("file_id", "page", "seq", "text", "x0", "y0", "x1", "y1", "_t")
    pairs = dealt_join(q, p, ["file_id", "page"])
    number = F.coalesce(F.array_contains("_t", F.lower("room_number")), F.lit(False))
    pairs = pairs.withColumn("score", F.greatest(phrase_score(F.col("_q"), F.col("_t")), F.when(number, F.lit(number_bonus)).otherwise(0.0))).where(F.col("score") >= least)
    best = F.max_by(F.struct("seq", "text", "score", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")), F.struct("score", (-F.col("seq")).alias("s")))
    return pairs.groupBy("sign_id").agg(best.alias("m")).select("sign_id", "m.*")


def clusters(phrases: DataFrame, signs: DataFrame, reach: float = 0.05, margin: float = 0.02) -> DataFrame:
    """A type phrase and a number phrase near each other for a sign; ambiguous if the runner-up is nearly as near.

    signs: ``file_id, page, sign_id, sign_type, room_number``.
    """
    cx, cy = _centre()
    p = phrases.select("file_id", "page", "seq", F.lower("text").alias("t"), cx.alias("cx"), cy.alias("cy"))
    a = signs.join(p, ["file_id", "page"]).where(F.col("t").contains(F.lower("sign_type"))).select("file_id", "page", "sign_id", "room_number", F.col("seq").alias("s1"), F.col("cx").alias("x1"), F.col("cy").alias("y1"))
    b = p.select("file_id", "page", F.col("seq").alias("s2"), F.col("t").alias("t2"), F.col("cx").alias("x2"), F.col("cy").alias("y2"))
    hit = a.join(b, ["file_id", "page"]).where((F.col("t2") == F.lower("room_number")) & (F.col("s1") != F.col("s2")))
    hit = hit.withColumn("dist", straight(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))).where(F.col("dist") <= reach)
    w = Window.partitionBy("sign_id").orderBy("dist", "s1", "s2")
    hit = hit.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("dist").over(w)).where("_n = 1")
    return hit.select("sign_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.coalesce(F.col("_next") - F.col("dist") <= margin, F.lit(False)).alias("ambiguous"))


def nudged(markers: DataFrame, near: float = 0.012) -> DataFrame:
    """Markers moved straight away from the first earlier one that is too near, to that distance; one after the other on each page.

    markers: ``file_id, page, seq, x, y, score`` and more. Score 1 (stored, or matched in full) stays and pushes others; score
    0 or null (a ghost) stays and pushes none. Within 0.001 there is no direction: such a marker stays, and no later one is
    looked at for it. Places end within 0.02 and 0.98. Null places stay and push none; ties of seq go by place.
    """

    def push(page):
        page = page.sort_values(["seq", "x", "y"], kind="stable").reset_index(drop=True)
        xs, ys, score = page["x"].to_numpy(float).copy(), page["y"].to_numpy(float).copy(), page["score"].fillna(0).to_numpy(float)
        solid = score != 0
        for i in range(1, len(xs)):
            if score[i] in (0, 1):
                continue
            dx, dy = xs[i] - xs[:i], ys[i] - ys[:i]
            dist = (dx * dx + dy * dy) ** 0.5
            close = (solid[:i] & (dist < near)).nonzero()[0]
            if len(close) and dist[close[0]] > 0.001:
                j = close[0]
                by = (near - dist[j]) / dist[j]
                xs[i], ys[i] = min(0.98, max(0.02, xs[i] + dx[j] * by)), min(0.98, max(0.02, ys[i] + dy[j] * by))
        return page.assign(x=xs, y=ys)

    return markers.groupBy("file_id", "page").applyInPandas(push, markers.schema)
